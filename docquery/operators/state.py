"""Keyed event state in batch form: each operator replays a table of events.

A key may hold a third of all events, so no step gathers the events of a key.
Time is cut into slots as wide as the rule's window; a slot's events combine to
one row, and what crosses slots is decided on those rows, whose number is bounded by the time that the key spans.
Greedy rules, where an accepted event moves the window, are folded within short
runs; long runs are cut into slices of slots that are solved for every possible entry, stitched, and solved again for the real one.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.operators.keys import join_on, placed
from docquery.plans.scratch import written

#: Events of a run, or rows of a session, that are folded in one row at most.
MOST_FOLDED = 2000
#: Slots of a slice.
SLICE = 64
#: Requests of a slice of a bounded cache.
SLICE_ROWS = 20_000


def micros(ts: Column) -> Column:
    """Local time as microseconds since 1970; the session's time zone plays no part for zoneless times."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def seconds(ts: Column) -> Column:
    """Local time as seconds since 1970, with fractions."""
    return micros(ts) / 1_000_000.0


def _slots(events: DataFrame, keys: list[str], width: int, *more: Column) -> DataFrame:
    """keys, __slot, first, last, n and `more` of each slot; events have __at in microseconds."""
    rows = events.withColumn("__slot", F.floor(F.col("__at") / width))
    return rows.groupBy(*keys, "__slot").agg(F.min("__at").alias("first"), F.max("__at").alias("last"), F.count("*").alias("n"), *more)


def _runs(slots: DataFrame, keys: list[str], apart: int, out: str) -> DataFrame:
    """slots numbered by run: a run ends where the next event comes `apart` or more later. No gap within a slot is that long."""
    order = Window.partitionBy(*keys).orderBy("__slot")
    new = F.when(F.col("first") - F.lag("last").over(order) < apart, 0).otherwise(1)
    return slots.withColumn("__new", new).withColumn(out, F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def greedy_window(events: DataFrame, keys: list[str], time: str, seconds_apart: float, tie: str, most: int = MOST_FOLDED) -> DataFrame:
    """events that are accepted: at least seconds_apart after the last accepted one of their key; without a time none is.

    Keys of up to `most` events, by a count, are folded in a row each.  Longer ones are cut into runs: the first event of a run
    is accepted whatever came before, so runs are independent; short runs are folded too, longer ones go slice by slice, in parallel.
    """
    apart = max(1, round(seconds_apart * 1_000_000))
    rows = events.withColumn("__at", micros(F.col(time))).where("__at is not null")
    long = written(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > most).drop("__n"), "long-keys")
    if long.isEmpty():
        return _folded(rows, keys, keys, tie, apart).select(*events.columns)
    short, held = join_on(rows, long, keys, "left_anti"), join_on(rows, long, keys, "left_semi")
    accepted = _by_runs(held.select(*keys, tie, "__at"), keys, tie, apart, most)
    return _folded(short, keys, keys, tie, apart).unionByName(join_on(held, accepted, [*keys, tie], "left_semi")).select(*events.columns)


def _folded(rows: DataFrame, keys: list[str], group: list[str], tie: str, apart: int) -> DataFrame:
    """Accepted rows (with __at) of short groups, each folded in a row."""
    rest = [c for c in rows.columns if c not in (*group, "__at", tie)]
    sortable = not any(k in t for t in dict(rows.select(*rest).dtypes).values() for k in ("map<", "variant"))
    held = F.struct("__at", tie, *(rest if sortable else []))
    folded = rows.groupBy(*group).agg(F.array_sort(F.collect_list(held)).alias("__e"))
    kind = folded.schema["__e"].dataType.simpleString()
    zero = F.struct(F.lit(-(1 << 62)).cast("long").alias("last"), F.array().cast(kind).alias("ok"))
    take = lambda acc, e: F.when(e["__at"] - acc["last"] >= apart, F.struct(e["__at"].alias("last"), F.concat(acc["ok"], F.array(e)).alias("ok"))).otherwise(acc)
    accepted = folded.select(*group, F.explode(F.aggregate("__e", zero, take)["ok"]).alias("__a")).select(*group, "__a.*")
    return accepted.select(*rows.columns) if sortable else join_on(rows, accepted.select(*keys, tie), [*keys, tie], "left_semi")


def _by_runs(rows: DataFrame, keys: list[str], tie: str, apart: int, most: int) -> DataFrame:
    """keys and tie of the accepted events of long keys (keys, tie, __at)."""
    runs = _runs(_slots(rows, keys, apart), keys, apart, "__run")
    runs = runs.withColumn("__size", F.sum("n").over(Window.partitionBy(*keys, "__run"))).select(*keys, "__slot", "__run", "__size")
    rows = join_on(rows.withColumn("__slot", F.floor(F.col("__at") / apart)), runs, [*keys, "__slot"])
    short = rows.where(F.col("__size") <= most).select(*keys, "__run", tie, "__at")
    accepted = _folded(short, keys, [*keys, "__run"], tie, apart).select(*keys, tie)
    return accepted.unionByName(_sliced(rows.where(F.col("__size") > most), keys, tie, apart))


def _sliced(rows: DataFrame, keys: list[str], tie: str, apart: int) -> DataFrame:
    """keys and tie of the accepted events of long runs (keys, tie, __at, __slot, __run)."""
    kinds = dict(rows.dtypes)
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    rows = rows.withColumn("__slice", F.floor(F.col("__slot") / SLICE))

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        """For each event that may be the slice's first accepted one, the last accepted one; equal outcomes once."""
        t = np.unique(group["__at"].to_numpy())
        after = np.searchsorted(t, t + apart)
        end = np.where(after < len(t), after, np.arange(len(t)))
        while (end[end] != end).any():
            end = end[end]
        entries = min(len(t), np.searchsorted(t, (group["__slice"].iloc[0] * SLICE + 1) * apart) + 1)
        last = np.flatnonzero(np.append(np.diff(end[:entries]) != 0, True))
        out = group[[*keys, "__run", "__slice"]].head(1).copy()
        out["entry"], out["exit"] = [t[last]], [t[end[last]]]
        return out

    def stitched(group: pd.DataFrame) -> pd.DataFrame:
        group, carry, before = group.sort_values("__slice"), -(1 << 62), []
        for entry, leave in zip(group["entry"], group["exit"]):
            before.append(carry)
            at = bisect_left(entry, carry + apart)
            carry = int(leave[at]) if at < len(entry) else carry
        return group[[*keys, "__run", "__slice"]].assign(carry=before)

    def solved(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["__at", tie])
        t, ok = group["__at"].to_numpy(), []
        at = np.searchsorted(t, group["carry"].iloc[0] + apart)
        while at < len(t):
            ok.append(at)
            at = np.searchsorted(t, t[at] + apart)
        return group[[*keys, tie]].iloc[ok]

    place = [*keys, "__run", "__slice"]
    slices = rows.groupBy(*place).applyInPandas(summed, f"{named}, __run long, __slice long, entry array<long>, exit array<long>")
    carried = slices.groupBy(*keys, "__run").applyInPandas(stitched, f"{named}, __run long, __slice long, carry long")
    rows = join_on(rows.select(*place, tie, "__at"), carried, place)
    return rows.groupBy(*place).applyInPandas(solved, f"{named}, `{tie}` {kinds[tie]}")


def content_dedup(files: DataFrame, scope: list[str], content: Column, order: list[str]) -> DataFrame:
    """files with sha256 and reused: whether equal bytes came before in the same scope; null is a scope, and null content is never reused.

    The first of each content is found by a combining aggregate, not by sorting copies in one task.
    """
    hashed = files.withColumn("sha256", F.sha2(content, 256))
    first = hashed.where("sha256 is not null").groupBy(*scope, "sha256").agg(F.min(F.struct(*order)).alias("__first"))
    joined = join_on(hashed, first, [*scope, "sha256"], "left")
    return joined.withColumn("reused", F.coalesce(F.struct(*order) != F.col("__first"), F.lit(False))).drop("__first")


def split_known(new: DataFrame, known: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose content is indexed already, rows to ingest); null keys are keys."""
    seen = known.select(*keys).distinct()
    return join_on(new, seen, keys, "left_semi"), join_on(new, seen, keys, "left_anti")


def in_flight(events: DataFrame, scope: list[str], file_id: str, url: str, name: str, size: str, order: str) -> DataFrame:
    """First holder of each identity: file id, else url, else name and size."""
    filled = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    ident = F.coalesce(F.concat(F.lit("id:"), filled(file_id)), F.concat(F.lit("url:"), filled(url)), F.concat_ws(":", F.lit("name"), F.col(name), F.col(size)))
    rows = events.withColumn("ident", ident)
    first = Window.partitionBy(*scope, "ident").orderBy(order)
    return rows.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")


def daily_quota(events: DataFrame, time: str, tie: str, most: int, *scope: str) -> DataFrame:
    """events with day, place (from 1) and admitted: the first `most` of each calendar day; 0 is no limit. A task ranks a minute of a day."""
    rows = placed(events.withColumn("day", F.to_date(time)), [*scope, "day"], F.date_trunc("minute", time), [time, tie], "place")
    return rows.withColumn("admitted", F.lit(most == 0) | (F.col("place") <= most))


def activity(touches: DataFrame, keys: list[str], time: str, idle_seconds: float) -> DataFrame:
    """keys, spell, started, ended, touches: spells in which no gap exceeds idle_seconds (a gap of exactly that stays inside); touches without a time don't count.

    Slots of that width combine to a row each, and only those are put in order by key.
    """
    idle = max(1, round(idle_seconds * 1_000_000))
    rows = touches.withColumn("__at", micros(F.col(time))).where("__at is not null")
    slots = _slots(rows, keys, idle, F.min(time).alias("started"), F.max(time).alias("ended"))
    spells = _runs(slots, keys, idle + 1, "spell")
    return spells.groupBy(*keys, "spell").agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("n").alias("touches"))


def expired(files: DataFrame, now: Column, *, retention: float, max_rounds: int, absolute_ttl: float = 0) -> DataFrame:
    """files (upload_time, last_used, rounds) with the reason they go: idle, rounds, age, or null."""
    idle = seconds(now) - seconds(F.coalesce("last_used", "upload_time")) > retention
    age = F.lit(bool(absolute_ttl)) & (seconds(now) - seconds(F.col("upload_time")) > absolute_ttl)
    return files.withColumn("expiry", F.when(idle, "idle").when(F.col("rounds") >= max_rounds, "rounds").when(age, "age"))


def memo(requests: DataFrame, keys: list[str], time: str, ttl_seconds: float, tie: str) -> DataFrame:
    """requests with hit: an answer written at most ttl_seconds ago; hits don't renew it."""
    misses = greedy_window(requests, keys, time, ttl_seconds + 1e-6, tie)
    marked = join_on(requests, misses.select(*keys, tie, F.lit(True).alias("__m")), [*keys, tie], "left")
    return marked.withColumn("hit", F.col("__m").isNull()).drop("__m")


def bounded_cache(requests: DataFrame, keys: list[str], item: list[str], time: str, tie: str, capacity: int, ttl_seconds: float | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """requests with hit: a cache per key of at most `capacity` items, first in first out, replayed in order of time (null times last) and tie.

    A miss puts its item at the end and, if the cache is full, drops the oldest; a hit changes nothing.  With a lifetime, an item
    older than that is a miss and is put anew.  keys may be empty: one cache for all.

    Whether a request hits depends on all before it, yet no key is gathered: its requests are cut into slices by their place, and each slice is
    replayed from the cache that the one before is believed to leave, at first an empty one.  Slices whose belief was wrong are
    replayed again until none is.  The first slice starts right, so what is left when nothing changes is the replay in order.  A cache
    forgets what came before once it has taken in `capacity` new items, so few rounds are needed; the worst case is one round a slice.
    """
    named = F.to_json(F.struct(*(F.col(k).alias(f"k{n}") for n, k in enumerate(keys)))) if keys else F.lit("")
    held = F.to_json(F.struct(*(F.col(i).alias(f"i{n}") for n, i in enumerate(item))))
    at = micros(F.col(time))
    rows = requests.select(named.alias("__k"), held.alias("__i"), F.coalesce(at, F.lit((1 << 63) - 1)).alias("__at"), F.col(tie).alias("__tie"))
    rows = written(rows.repartitionByRange("__k", "__at", "__tie").withColumn("__range", F.spark_partition_id()), "cache-ranges")
    placed_rows = placed(rows, ["__k"], F.col("__range"), ["__at", "__tie"], "__place")
    rows = written(placed_rows.select("__k", "__i", "__at", "__tie", F.floor((F.col("__place") - 1) / slice_rows).cast("long").alias("__slice")), "cache-slices")
    life = None if ttl_seconds is None else round(ttl_seconds * 1_000_000)
    kind = dict(rows.dtypes)["__tie"]
    state = "__k string, __slice long, items array<string>, times array<long>"

    def start(caches: pd.DataFrame) -> dict[str, int]:
        return dict(zip(caches["items"].iloc[0], caches["times"].iloc[0])) if len(caches) else {}

    def step(cache: dict[str, int], i: str, t: int) -> bool:
        if i in cache and (life is None or t - cache[i] <= life):
            return True
        cache.pop(i, None)
        if len(cache) >= capacity:
            del cache[next(iter(cache))]
        cache[i] = t
        return False

    def left(part: pd.DataFrame, caches: pd.DataFrame) -> pd.DataFrame:
        part, cache = part.sort_values(["__at", "__tie"]), start(caches)
        for i, t in zip(part["__i"], part["__at"]):
            step(cache, i, t)
        return pd.DataFrame({"__k": [part["__k"].iloc[0]], "__slice": [part["__slice"].iloc[0] + 1], "items": [[*cache]], "times": [[*cache.values()]]})

    def answered(part: pd.DataFrame, caches: pd.DataFrame) -> pd.DataFrame:
        part, cache = part.sort_values(["__at", "__tie"]), start(caches)
        return part.assign(hit=[step(cache, i, t) for i, t in zip(part["__i"], part["__at"])])[["__k", "__tie", "hit"]]

    slices = ["__k", "__slice"]
    both = lambda some, caches, f, out: some.groupBy(*slices).cogroup(caches.groupBy(*slices)).applyInPandas(f, out)
    sizes = written(rows.groupBy("__k").agg(F.max("__slice").alias("__last")), "cache-keys")
    caches = believed = rows.sparkSession.createDataFrame([], state)
    active = rows.join(sizes.where("__last > 0").select("__k"), "__k", "left_semi")
    while sizes.agg(F.max("__last")).first()[0]:
        told = written(both(active, believed, left, state).join(sizes, "__k").where(F.col("__slice") <= F.col("__last")).drop("__last"), "cache-states")
        had = caches.select("__k", "__slice", F.col("items").alias("__had"), F.col("times").alias("__when"))
        wrong = told.join(had, slices, "left").where(F.col("__had").isNull() | (F.col("__had") != F.col("items")) | (F.col("__when") != F.col("times")))
        believed = wrong = written(wrong.select(*slices, "items", "times"), "cache-wrong")
        if wrong.isEmpty():
            break
        caches = written(caches.join(wrong.select(*slices), slices, "left_anti").unionByName(wrong), "cache-states")
        active = rows.join(wrong.select(*slices), slices, "left_semi")
    hits = both(rows, caches, answered, f"__k string, __tie {kind}, hit boolean")
    keyed = requests.withColumn("__k", named).withColumn("__tie", F.col(tie))
    return join_on(keyed, hits, ["__k", "__tie"]).drop("__k", "__tie")


def tumbling_rounds(touches: DataFrame, keys: list[str], time: str, width_seconds: int) -> DataFrame:
    """keys, slot, touches: one round per slot of fixed width (for touches without a query)."""
    slot = F.floor(seconds(F.col(time)) / width_seconds)
    return touches.groupBy(*keys, slot.alias("slot")).agg(F.count("*").alias("touches"))


def retry_schedule(failures: DataFrame, keys: list[str], time: str, *, first_seconds: int = 30, minutes: float = 2, most: int = 30) -> DataFrame:
    """keys, attempt, due: when the latest failure of each key is tried again."""
    last = failures.groupBy(*keys).agg(F.max(time).alias("__t"))
    rows = last.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(max(1, most)))))
    wait = first_seconds + (F.col("attempt") - 1) * int(max(0.5, minutes) * 60)
    return rows.select(*keys, "attempt", (F.col("__t") + F.make_dt_interval(secs=wait)).alias("due"))


def notices(events: DataFrame, session: str, name: str, time: str, tie: str, now: Column, *, ttl: float = 600, most: int = 10) -> DataFrame:
    """The last notice of each name in a session, the newest `most` of a session, and of these what is within the ttl."""
    last = Window.partitionBy(session, name).orderBy(F.col(time).desc(), F.col(tie).desc())
    rows = events.withColumn("__r", F.row_number().over(last)).where("__r = 1")
    newest = Window.partitionBy(session).orderBy(F.col(time).desc(), F.col(tie).desc())
    rows = rows.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= most)
    return rows.where(seconds(now) - seconds(F.col(time)) <= ttl).drop("__r")


def last_n(events: DataFrame, group: list[str], time: str, tie: str, n: int) -> DataFrame:
    """The last n rows of each group: a ring buffer's content."""
    order = Window.partitionBy(*group).orderBy(F.col(time).desc(), F.col(tie).desc())
    return events.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def cooldown(rows: DataFrame, time: str, tie: str, now: Column, *, hours: float = 24, most: int = 256) -> DataFrame:
    """Rows young enough, the newest `most` of them."""
    young = rows.where(seconds(now) - seconds(F.col(time)) <= hours * 3600)
    return young.orderBy(F.col(time).desc(), F.col(tie).desc()).limit(most)


def budget_admission(files: DataFrame, session: str, order: list[str], size: str, budget: int, slot: Column | None = None) -> DataFrame:
    """files with admitted: taken in order while they still fit into what the session has left; a rejected one takes no room.

    Room only shrinks, so what exceeds it once is out for good.  A round takes, of what is small enough, all before the
    first that does not fit; running sums are built by slots, so that one task adds up a slot, not a session.  Without a given slot (which must
    not fall along the order) rows are range-sorted and each range is one.  Once few candidates are left in every session, a fold decides them in a row each.
    """
    rows = files.select(session, F.struct(*order).alias("__o"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("__n"), *([] if slot is None else [slot.alias("__slot")]))
    kind = rows.schema["__o"].dataType.simpleString()
    most = rows.groupBy(session).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= MOST_FOLDED:  # every session is short: one fold
        rounds = rows.select(session).limit(0).select(session, F.lit(None).cast(kind).alias("__from"), F.lit(None).cast(kind).alias("__to"), F.lit(0).cast("long").alias("__room"))
        return _admitted(files, session, order, size, rounds, rows.withColumn("__room", F.lit(budget).cast("long")), kind)
    if slot is None:
        rows = rows.repartitionByRange(session, "__o").withColumn("__slot", F.spark_partition_id())
    rows = written(rows, "budget")
    state = written(rows.select(session).distinct().select(session, F.lit(None).cast(kind).alias("__from"), F.lit(budget).cast("long").alias("__room")), "budget")
    rounds = None
    while True:
        left = join_on(rows, state, [session]).where("(__from is null or __o > __from) and __n <= __room")
        if rounds is not None and not (left.groupBy(session).count().agg(F.max("count")).first()[0] or 0) > MOST_FOLDED:
            break
        sums = left.groupBy(session, "__slot").agg(F.sum("__n").alias("__s"), F.first("__room").alias("__room"))
        sums = sums.withColumn("__before", F.sum("__s").over(Window.partitionBy(session).orderBy("__slot")) - F.col("__s"))
        full = sums.where("__before + __s > __room").groupBy(session).agg(F.min(F.struct("__slot", "__before")).alias("f")).select(session, "f.*")
        inside = join_on(left, full, [session, "__slot"])
        running = F.col("__before") + F.sum("__n").over(Window.partitionBy(session, "__slot").orderBy("__o").rowsBetween(Window.unboundedPreceding, 0))
        misfit = inside.withColumn("__upto", running).where("__upto > __room").groupBy(session)
        misfit = misfit.agg(F.min(F.struct("__o", (F.col("__upto") - F.col("__n")).alias("used"))).alias("m"))
        done = written(join_on(state, misfit, [session], "left").withColumn("__to", F.col("m.__o")), "budget")
        rounds = done if rounds is None else rounds.unionByName(done)
        state = done.where("m is not null").select(session, F.col("__to").alias("__from"), (F.col("__room") - F.col("m.used")).alias("__room"))
    return _admitted(files, session, order, size, rounds, left, kind)


def _admitted(files: DataFrame, session: str, order: list[str], size: str, rounds: DataFrame, left: DataFrame, kind: str) -> DataFrame:
    """files with admitted, by the rounds (session, __from, __to, __room) and a fold of what is left (session, __o, __n, __room)."""
    spans = rounds.groupBy(session).agg(F.collect_list(F.struct("__from", "__to", "__room")).alias("__spans"))  # a round each

    used = left.groupBy(session).agg(F.array_sort(F.collect_list(F.struct("__o", "__n"))).alias("__e"), F.first("__room").alias("__room"))
    zero = F.struct(F.col("__room").alias("room"), F.array().cast(f"array<{kind}>").alias("ok"))
    take = lambda acc, e: F.when(e["__n"] <= acc["room"], F.struct((acc["room"] - e["__n"]).alias("room"), F.concat(acc["ok"], F.array(e["__o"])).alias("ok"))).otherwise(acc)
    late = used.select(session, F.explode(F.aggregate("__e", zero, take)["ok"]).alias("__o")).withColumn("__late", F.lit(True))

    out = files.withColumn("__o", F.struct(*order)).withColumn("__n", F.coalesce(F.col(size), F.lit(0)))
    out = join_on(join_on(out, spans, [session], "left"), late, [session, "__o"], "left")
    o, n = F.col("__o"), F.col("__n")
    within = lambda s: (s["__from"].isNull() | (o > s["__from"])) & (s["__to"].isNull() | (o < s["__to"])) & (n <= s["__room"])
    taken = F.coalesce(F.exists("__spans", within), F.lit(False)) | F.col("__late").isNotNull()
    return out.withColumn("admitted", taken).drop("__o", "__n", "__spans", "__late")
