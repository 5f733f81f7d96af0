"""Sharding by balanced label propagation.

Linked documents (here: equal texts) start in seeded shards.  In each round a
Spark join brings every document its neighbours' shards; it wants to move to
the one with most links.  Moves between two shards are allowed as far as they
are matched by moves the other way or by free room, so sizes stay within the
capacity; which of the wanted moves happen is drawn by a seeded hash at the
allowed rate.  So that neighbours don't swap places for ever, a document with
at least as many links as each neighbour (of equals, the least) is an anchor that stays, and in odd rounds half of the others rest.
Then every group of links that fits a shard goes whole to the shard that has
most of it, or whole to another with room; of what is still above a shard's
size, one group gives up a part.  Groups bigger than a shard take the room that is left.
Documents without links (and the parts given up) come last and fill every shard up to the same size, in seeded order, cut where the running size reaches it.

A table of links and labels is written each round; the driver holds one sum per pair of shards.

Defined cases: null text has size 1 (0 bytes) and equals the empty text only;
null ids are nodes like others; rows with equal id and text share a shard
unless a cut of the fill order falls between them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.llm.common import materialise, unit_hash

#: The seeded order is cut into so many ranges for running sums and slots.
RANGES = 4096
_WIDTH = 2**52 // RANGES


def propagate(labels: DataFrame, links: DataFrame, capacity: float, shards: int, *, rounds: int = 4, seed: int = 10) -> DataFrame:
    """labels (node, size, shard) after the rounds; links (u, v), each once.

    Cut links shrink as long as moves are matched or there is room under the capacity (of one shard, in sizes).
    """
    links = materialise(links.select("u", "v").union(links.select("v", "u")), "shard-links")
    degrees = links.groupBy(F.col("u").alias("w")).agg(F.count("*").alias("degree"))
    rank = links.join(degrees.select(F.col("w").alias("v"), F.struct("degree", (-F.col("w")).alias("w")).alias("theirs")), "v")
    rank = rank.groupBy("u").agg(F.max("theirs").alias("theirs"), F.count("*").alias("n"))
    anchors = rank.where(F.struct(F.col("n").alias("degree"), (-F.col("u")).alias("w")) > F.col("theirs")).select("u", F.lit(True).alias("anchor"))
    labels = materialise(labels.join(anchors, F.col("node") == F.col("u"), "left").drop("u"), "shard-labels")
    for turn in range(rounds):
        seen = links.join(labels.select(F.col("node").alias("v"), F.col("shard").alias("there")), "v")
        votes = seen.groupBy(F.col("u").alias("node"), "there").agg(F.count("*").alias("n"))
        votes = votes.groupBy("node").agg(
            F.max(F.struct("n", (-F.col("there")).alias("there"))).alias("best"), F.map_from_entries(F.collect_list(F.struct("there", "n"))).alias("by")
        )  # at most one entry a shard
        wish = labels.join(votes, "node", "left")
        gain = F.col("best.n") > F.coalesce(F.col("by")[F.col("shard")], F.lit(0))
        awake = F.col("anchor").isNull() & ((unit_hash(seed + turn, F.col("node")) % 2 == 0) | F.lit(turn % 2 == 0))
        wish = wish.withColumn("to", F.when(gain & awake, -F.col("best.there"))).drop("best", "by")
        wish = materialise(wish, "shard-wishes")
        flows = {(r.shard, r.to): float(r.w) for r in wish.where("to is not null").groupBy("shard", "to").agg(F.sum("size").alias("w")).collect()}
        if not flows:
            break
        full = {r.shard: float(r.w) for r in wish.groupBy("shard").agg(F.sum("size").alias("w")).collect()}
        rates = _rates(flows, {s: max(0.0, capacity - full.get(s, 0.0)) for s in range(shards)})
        rate = F.create_map(*(F.lit(x) for (a, b), p in rates.items() for x in (a * shards + b, p)))
        drawn = unit_hash(seed + 1000 + turn, F.col("node")) < F.coalesce(rate[F.col("shard") * shards + F.col("to")], F.lit(0.0)) * 2.0**52
        labels = wish.select("node", "size", "anchor", F.when(F.col("to").isNotNull() & drawn, F.col("to")).otherwise(F.col("shard")).alias("shard"))
        labels = materialise(labels, "shard-labels")
    return labels


def _rates(flows: dict[tuple[int, int], float], room: dict[int, float]) -> dict[tuple[int, int], float]:
    """Share of each wanted flow that may happen: what the opposite flow matches, and a part of the target's room."""
    matched = {k: min(w, flows.get(k[::-1], 0.0)) for k, w in flows.items()}
    over = {k: w - matched[k] for k, w in flows.items()}
    into = {b: sum(w for (_, to), w in over.items() if to == b) for _, b in flows}
    return {(a, b): (matched[a, b] + over[a, b] * min(1.0, room[b] / into[b] if into[b] else 0.0)) / w for (a, b), w in flows.items()}


def _full(rows: DataFrame, shard: str = "shard") -> dict[int, float]:
    """Sum of sizes in each shard."""
    return {r[0]: float(r[1]) for r in rows.groupBy(shard).agg(F.sum("size")).collect()}


def _range(u: str) -> Column:
    return F.floor(F.col(u) / _WIDTH).cast("int")


def _fill(rows: DataFrame, needs: list[float]) -> DataFrame:
    """Add `shard` to rows (size, u, ...): the seeded order is cut where the running size reaches the needs."""
    cuts, at = [], 0.0
    for n in needs[:-1]:
        at += n
        cuts.append(at)
    shard_at = lambda x: sum(((x >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    sums = rows.groupBy(_range("u").alias("part")).agg(F.sum("size").alias("part_size"))
    sums = sums.withColumn("before", F.sum("part_size").over(Window.orderBy("part")) - F.col("part_size"))  # RANGES rows at most
    sums = sums.withColumn("first", shard_at(F.col("before"))).withColumn("last", shard_at(F.col("before") + F.col("part_size")))
    sums = F.broadcast(materialise(sums.withColumnRenamed("part", "__part"), "shard-ranges"))
    placed = rows.join(sums, _range("u") == F.col("__part"))
    sure = placed.where("first = last").withColumn("shard", F.col("first"))
    order = Window.partitionBy("__part").orderBy("u", "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where("first <> last").withColumn("upto", F.sum("size").over(order))
    edge = edge.withColumn("shard", shard_at(F.col("before") + F.col("upto") - F.col("size") / 2)).drop("upto")
    return sure.unionByName(edge).drop("__part", "part_size", "before", "first", "last")


def shard_documents(docs: DataFrame, *, shards: int = 8, rounds: int = 4, seed: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, text_hash, shard, slot; one row per row of docs. Equal texts are linked."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    rows = rows.withColumn("node", F.xxhash64("doc_id", "text_hash")).withColumn("u", unit_hash(seed, F.col("node")))
    rows = materialise(rows, "shard-rows")

    groups = rows.groupBy("text_hash").agg(F.min("node").alias("hub"), F.max("node").alias("other"))
    groups = materialise(groups.where("hub <> other").select(F.col("text_hash").alias("__hash"), "hub"), "shard-groups")
    linked = rows.join(groups, F.col("text_hash") == F.col("__hash")).groupBy("node", "hub").agg(F.sum("size").alias("size"))
    linked = materialise(linked.withColumn("shard", (unit_hash(seed, F.col("node")) % shards).cast("int")), "shard-linked")
    total = rows.agg(F.sum("size")).first()[0] or 0
    goal = total / shards
    sizes = linked.groupBy("hub").agg(F.sum("size").alias("group_size"))
    linked = materialise(linked.join(sizes, "hub"), "shard-sized")
    small = linked.where(F.col("group_size") <= goal)
    links = small.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    labels = propagate(small.select("node", "size", "shard"), links, goal, shards, rounds=rounds, seed=seed)

    # a group that fits a shard goes whole to where most of it is; shards above their size give up a seeded part of their groups
    at = labels.join(small.select(F.col("node").alias("__node"), "hub"), F.col("node") == F.col("__node"))
    at = at.groupBy("hub", "shard").agg(F.sum("size").alias("w"))
    whole = at.groupBy("hub").agg(F.sum("w").alias("size"), F.max(F.struct("w", (-F.col("shard")).alias("s"))).alias("best"))
    whole = materialise(whole.select("hub", "size", (-F.col("best.s")).alias("shard")), "shard-whole")
    full = _full(whole)
    spare = F.create_map(*(F.lit(x) for s in range(shards) for x in (s, max(0.0, 1 - goal / max(goal, full.get(s, 0.0), 1.0)))))
    stays = unit_hash(seed + 1, F.col("hub")) >= spare[F.col("shard")] * 2.0**52
    stay = materialise(whole.where(stays), "shard-stay")
    full = _full(stay)
    moved = whole.where(~stays).select(F.lit(0).alias("doc_id"), F.col("hub").alias("text_hash"), "size", unit_hash(seed + 2, F.col("hub")).alias("u"))
    moved = _fill(moved, [max(0.0, goal - full.get(s, 0.0)) for s in range(shards)])
    whole = materialise(stay.unionByName(moved.select(F.col("text_hash").alias("hub"), "size", "shard")), "shard-whole")

    # what is still too much is one group's part in each shard
    free = {}
    for s, w in sorted(_full(whole).items()):
        over = w - goal
        if over > 0:
            pick = F.struct((F.col("size") >= over).alias("enough"), F.when(F.col("size") >= over, -F.col("size")).otherwise(F.col("size")).alias("o"), "hub", "size")
            cut = whole.where(F.col("shard") == s).agg(F.max(pick).alias("p")).first().p
            free[cut.hub] = min(1.0, over / cut.size)
    part = F.lit(0.0)
    for hub, share in free.items():
        part = F.when(F.col("hub") == hub, share).otherwise(part)
    named = small.select("node", "hub", "size").join(whole.select("hub", "shard"), "hub").where(unit_hash(seed + 3, F.col("node")) >= part * 2.0**52)
    named = materialise(named.select("node", "size", "shard"), "shard-named")

    # groups too big for a shard take what room is left, the largest first; each is more than a shard, so they are few
    full = _full(named)
    room = {s: goal - full.get(s, 0.0) for s in range(shards)}
    for big in linked.where(F.col("group_size") > goal).select("hub", "group_size").distinct().orderBy(F.desc("group_size"), "hub").collect():
        takes, rest = [0.0] * shards, float(big.group_size)
        for s in sorted(room, key=lambda s: (-room[s], s)):
            takes[s] = min(max(0.0, room[s]), rest)
            room[s], rest = room[s] - takes[s], rest - takes[s]
        own = linked.where(F.col("hub") == big.hub).select("node", "size", unit_hash(seed + 4, F.col("node")).alias("u"), F.lit(0).alias("doc_id"), F.col("node").alias("text_hash"))
        named = named.unionByName(_fill(own, takes).select("node", "size", "shard"))
    labels = materialise(named.select(F.col("node").alias("__node"), F.col("shard").alias("__shard"), "size"), "shard-stays")
    full = _full(labels, "__shard")
    needs = [max(0.0, goal - full.get(s, 0.0)) for s in range(shards)]

    marked = rows.join(labels.drop("size"), F.col("node") == F.col("__node"), "left")
    kept = marked.where("__shard is not null").withColumn("shard", F.col("__shard"))
    loose = _fill(marked.where("__shard is null"), needs)
    placed = materialise(kept.unionByName(loose).select("doc_id", "size", "text_crc32", "text_hash", "u", "shard"), "shard-placed")

    counts = placed.groupBy("shard", _range("u").alias("part")).agg(F.count("*").alias("n"))
    first = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")  # RANGES rows a shard at most
    counts = counts.select(F.col("shard").alias("__shard"), F.col("part").alias("__part"), first.alias("first"))
    counts = F.broadcast(materialise(counts, "shard-slots"))
    numbered = placed.withColumn("part", _range("u")).join(counts, (F.col("shard") == F.col("__shard")) & (F.col("part") == F.col("__part")))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("u", "doc_id", "text_hash"))
    numbered = numbered.withColumn("slot", F.col("first") + place - 1)
    return numbered.select("doc_id", "size", "text_crc32", "text_hash", "shard", F.col("slot").cast("long").alias("slot"))
