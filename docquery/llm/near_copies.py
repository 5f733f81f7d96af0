"""Edited copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash fingerprints meet first: those at two or fewer differing bits, found by
Golay keys as in simhash.py, are candidates.  Keys for two bits can't find all: at similarity 0.8 about ten of 64 bits
differ.  So each text also gets 16 seeded fingerprints, each the hash of four seeded
minima over its shingles (MinHash).  Texts that share one are candidates if SimHash has not put them into one component: at
similarity 0.8 a pair shares one with probability 1 - (1 - 0.8^4)^16 = 0.9998, more above.
Every candidate pair is verified on the whole shingle sets in a join.  Sets are large, so counts of their
hashes by bucket meet before: the lesser counts add up to no less than the common shingles, and a pair that can't reach the similarity goes.

Texts of equal shingle sets are one node throughout.  Only components are asked for, so links inside one don't matter:
first every node meets the hub of its most common fingerprint; then nodes that share a fingerprint are compared by pairs
if their components still differ.  A fingerprint that more than MOST_SHARED nodes share is a crowd and makes no pairs: if it
is in several components after that, its nodes get 64 finer fingerprints of eight minima and go the same way.  What
is still a crowd in several components is settled exactly: all nodes outside its largest component meet all the others, in blocks.
No partner or candidate is capped.

Components grow with the links: new ones are contracted to the roots known so far, so rounds run over few rows.

Defined cases: words are as in SimHash (ASCII case and white space don't count); null and
empty texts are equal; fewer words than a shingle are one shingle; null and repeated ids as there; an empty table gives an empty result;
other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquery.llm.common import connected_components, materialise, small_side
from docquery.llm.simhash import keep_least, links, majority

#: Fingerprints of a text, and minima in each.
BANDS, MINIMA = 16, 4
#: A fingerprint that more nodes share than this is a crowd.
MOST_SHARED = 32
#: Fingerprints of a crowd's nodes, and minima in each: 1 - (1 - 0.8^8)^64 = 0.99999.
FINER_BANDS, FINER_MINIMA = 64, 8
#: About so many shingles (of 8 bytes) make a block, and so many postings are looked at at a time.
BLOCK, _POSTINGS = 500_000, 1_000_000
#: A node in more pairs than this is sent to several tasks.
_SALT = 64


def _shingles(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """Distinct XXH64 values of the word shingles, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    n, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    return np.unique(np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends[-n:])), np.uint64, n))


def _factors(seed: int, n: int = BANDS * MINIMA) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, np.uint64) | np.uint64(1)


def _node(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64)) if len(hashes) else 0


def _keys(hashes: np.ndarray, factors: np.ndarray, minima: int = MINIMA) -> np.ndarray:
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(len(factors), 2**64 - 1, np.uint64)
    for some in range(0, len(hashes), 4096):  # memory stays small for very long texts
        np.minimum(least, (hashes[some : some + 4096, None] * factors).min(axis=0), out=least)
    made = [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(-1, minima))]
    return np.array(made, np.uint64).view(np.int64)


def _counts(hashes: np.ndarray) -> bytes:
    """Numbers of hashes by their low bits, one or two in each bucket on average; empty if one doesn't fit a byte."""
    buckets = 1 << max(4, (len(hashes) // 2).bit_length())
    counts = np.bincount((hashes & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _may_reach(a: bytes, b: bytes, similarity: float) -> bool:
    """False only if sets of these counts can't be that similar."""
    if not a or not b:
        return True
    a, b = (np.frombuffer(x, np.uint8).reshape(-1, min(len(a), len(b))).sum(axis=0, dtype=np.int64) for x in (a, b))
    common = np.minimum(a, b).sum()
    return bool(common >= similarity * (a.sum() + b.sum() - common) - 1e-9)


def node(text: Column, shingle: int = 5, seed: int = 42) -> Column:
    """A hash of the set of shingles; 0 for texts without a word."""

    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_node(_shingles(x, shingle, seed)) for x in texts], dtype="int64")

    return hashed(text)


def _signature(text: Column, shingle: int, seed: int) -> Column:
    factors = _factors(seed)

    @F.pandas_udf("fp long, bits long, size int, keys array<long>")
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [_shingles(x, shingle, seed) for x in texts]
            fps, sizes = np.array([_node(s) for s in sets], np.int64), np.array([len(s) for s in sets], np.int32)
            bits = np.array([majority(s) for s in sets], np.int64)
            yield pd.DataFrame({"fp": fps, "bits": bits, "size": sizes, "keys": [_keys(s, factors) for s in sets]})

    return signed(text)


def _sets(texts: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(fp, counts, shingles) of a column of texts, made a few hundred at a time: a set is larger than its text."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                sets = [_shingles(x, shingle, seed) for x in batch.iloc[at : at + 256, 0]]
                fps, shingles = np.array([_node(s) for s in sets], np.int64), [s.view(np.int64) for s in sets]
                yield pd.DataFrame({"fp": fps, "counts": [_counts(s) for s in sets], "shingles": shingles})

    return texts.mapInPandas(made, "fp long, counts binary, shingles array<long>")


def _both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """The pairs (u, v) with that column of their sets as a and b; a set that many pairs need as v is copied to several tasks."""
    often = pairs.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > _SALT)
    often = small_side(often.select(F.col("v").alias("__v"), F.ceil(F.col("n") / _SALT).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    left = pairs.join(often, F.col("v") == F.col("__v"), "left").select("u", "v", F.pmod(F.xxhash64("u"), salts).cast("int").alias("salt"))
    left = left.join(sets.select(F.col("fp").alias("u"), F.col(column).alias("a")), "u")
    right = sets.select("fp", column).join(pairs.select(F.col("v").alias("fp")).distinct(), "fp", "left_semi")
    right = right.join(often, F.col("fp") == F.col("__v"), "left")
    right = right.select(F.col("fp").alias("v"), F.col(column).alias("b"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return left.join(right, ["v", "salt"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """The pairs (u, v) whose shingle sets are that similar, None if there are no pairs; only those whose counts allow it meet as sets."""

    @F.pandas_udf("boolean")
    def may_reach(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_may_reach(x, y, similarity) for x, y in zip(a, b)], dtype="bool")

    pairs = materialise(pairs, "copies-pairs")
    if pairs.isEmpty():
        return None
    pairs = materialise(_both(pairs, sets, "counts").where(may_reach("a", "b")).select("u", "v"), "copies-possible")
    if pairs.isEmpty():
        return None
    common = F.size(F.array_intersect("a", "b"))
    enough = common >= similarity * (F.size("a") + F.size("b") - common) - 1e-9
    return materialise(_both(pairs, sets, "shingles").where(enough).select("u", "v"), "copies-verified")


class _Components:
    """Components that grow: new links are contracted to the roots known so far, and rounds run over what is then left of them."""

    def __init__(self):
        self.roots: DataFrame | None = None  # (node, root) of all nodes with a link

    def grow(self, found: DataFrame | None) -> DataFrame | None:
        """Takes in the links found; (root, now) of the roots that moved, None if none did."""
        if found is None:
            return None
        if self.roots is not None:
            ends = {c: self.roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "uv"}
            found = found.join(ends["u"], "u", "left").join(ends["v"], "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
            found = materialise(found.where("u <> v").distinct(), "copies-contracted")
            if found.isEmpty():
                return None
        moved = materialise(connected_components(found, "copies-roots"), "copies-moved")
        new = small_side(moved.select(F.col("node").alias("root"), F.col("root").alias("now")))
        if self.roots is None:
            self.roots = moved
        else:
            kept = self.roots.join(new, "root", "left").select("node", F.coalesce("now", "root").alias("root"))
            self.roots = materialise(kept.unionByName(moved.join(self.roots, "node", "left_anti")), "copies-roots")
        return new

    def link(self, rows: DataFrame, found: DataFrame | None) -> DataFrame:
        """rows (fp, key, root, ...) after the links found: with their new roots, at keys that still have several."""
        new = self.grow(found)
        if new is None:
            return rows
        return _several(rows.join(new, "root", "left").withColumn("root", F.coalesce("now", "root")).drop("now"))

    def rooted(self, rows: DataFrame) -> DataFrame:
        """rows (fp, ...) with the roots of now."""
        rows = rows.drop("root")
        if self.roots is None:
            return rows.withColumn("root", F.col("fp"))
        roots = self.roots.select(F.col("node").alias("fp"), "root")
        return rows.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _several(rows: DataFrame) -> DataFrame:
    """The rows (key, root, ...) at keys with several roots."""
    rows = materialise(rows, "copies-rooted")
    keys = rows.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    return materialise(rows.join(keys, "key", "left_semi"), "copies-open")


def _near_sizes(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def _near_bits(nodes: DataFrame, similarity: float) -> DataFrame:
    """Candidates (u, v) of the nodes (fp, bits, size): equal SimHash fingerprints, and by Golay keys those at up to two differing bits."""
    hubs = materialise(nodes.groupBy("bits").agg(F.min(F.struct("fp", "size")).alias("h")), "copies-bits")
    ends = {c: hubs.select(F.col("bits").alias(c), F.col("h.fp").alias(f"{c}_fp"), F.col("h.size").alias(f"{c}_size")) for c in "uv"}
    far = links(hubs.select(F.col("bits").alias("fp"))).join(ends["u"], "u").join(ends["v"], "v")
    equal = nodes.join(ends["v"].withColumnRenamed("v", "bits"), "bits").where("fp <> v_fp")
    equal = equal.select(F.col("fp").alias("u_fp"), F.col("size").alias("u_size"), "v_fp", "v_size")
    pairs = far.select("u_fp", "u_size", "v_fp", "v_size").unionByName(equal).where(_near_sizes("u_size", "v_size", similarity))
    return materialise(pairs.select(F.col("u_fp").alias("u"), F.col("v_fp").alias("v")), "copies-near-bits")


def roots_of(docs: DataFrame, nodes: DataFrame, *, shingle: int, similarity: float, seed: int, id_col: str, text_col: str) -> DataFrame | None:
    """(node, root) of the nodes (fp, least, bits, size, keys) with a link, None if there is no link; `least` is an id in docs."""
    close = _near_bits(nodes.select("fp", "bits", "size"), similarity)
    met = _shared(nodes.select("fp", "size", F.explode("keys").alias("key")))

    # sets of the candidates only
    wanted = met.select("fp").unionByName(close.select(F.explode(F.array("u", "v")).alias("fp"))).distinct()
    wanted = wanted.join(nodes.select("fp", "least"), "fp").select(F.col("fp").alias("__fp"), F.col("least").alias("__id"))
    wanted = materialise(wanted, "copies-wanted")
    texts = docs.join(wanted.select("__id").where("__id is not null").distinct(), F.col(id_col) == F.col("__id"), "left_semi").select(text_col)
    texts = texts.unionByName(docs.where(F.col(id_col).isNull()).select(text_col))
    sets = _sets(texts, shingle, seed).join(wanted.select(F.col("__fp").alias("fp")), "fp", "left_semi").dropDuplicates(["fp"])
    sets = materialise(sets, "copies-sets")

    grown = _Components()
    grown.grow(_verified(close, sets, similarity))
    crowd = _compared(materialise(grown.rooted(met), "copies-rooted"), grown, sets, similarity)
    if not crowd.isEmpty():
        members = materialise(sets.join(crowd.select("fp", "root").distinct(), "fp"), "copies-members")
        crowd = _compared(_shared(_finer(members, seed)), grown, members, similarity)
        if not crowd.isEmpty():
            members = materialise(members.join(crowd.select("fp").distinct(), "fp", "left_semi"), "copies-members")
            _in_blocks(crowd, grown, members, similarity)
    return grown.roots


def _shared(keyed: DataFrame) -> DataFrame:
    """keyed (fp, size, key) with n, the number of nodes at the key, where that is over one."""
    keyed = materialise(keyed, "copies-keys")
    return materialise(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "copies-met")


def _finer(sets: DataFrame, seed: int) -> DataFrame:
    """(fp, root, size, key) of sets (fp, shingles, root) by fingerprints of more minima: texts that have only a passage in common part here."""
    factors = _factors(seed + 1, FINER_BANDS * FINER_MINIMA)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fp, root, shingles in zip(batch["fp"], batch["root"], batch["shingles"]):
                yield pd.DataFrame({"fp": fp, "root": root, "size": len(shingles), "key": _keys(shingles.view(np.uint64), factors, FINER_MINIMA)})

    return sets.select("fp", "root", "shingles").mapInPandas(made, "fp long, root long, size int, key long")


def _compared(rows: DataFrame, grown: _Components, sets: DataFrame, similarity: float) -> DataFrame:
    """Links rows (fp, size, key, n, root) by hubs and pairs; returns the rows of crowds that are still in several components."""
    near = _near_sizes("size", "hub_size", similarity)
    tops = rows.groupBy("fp").agg(F.count("*").alias("weight"), F.max(F.struct("n", "key")).alias("top"), F.first("size").alias("size"), F.first("root").alias("root"))
    tops = tops.withColumn("key", F.col("top.key"))  # a node's size and root are the same at all its keys
    hubs = tops.groupBy("key").agg(F.max(F.struct("weight", "fp", "size", "root")).alias("h"))
    hubs = hubs.select("key", F.col("h.fp").alias("hub"), F.col("h.size").alias("hub_size"), F.col("h.root").alias("hub_root"))
    pairs = tops.join(hubs, "key").where((F.col("root") != F.col("hub_root")) & near).select(F.col("fp").alias("u"), F.col("hub").alias("v"))
    few = grown.link(rows.where(F.col("n") <= MOST_SHARED), _verified(pairs, sets, similarity))

    other = few.select("key", F.col("fp").alias("hub"), F.col("size").alias("hub_size"), F.col("root").alias("hub_root"))
    pairs = few.join(other, "key").where((F.col("fp") > F.col("hub")) & (F.col("root") != F.col("hub_root")) & near)
    grown.grow(_verified(pairs.select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct(), sets, similarity))
    return _several(grown.rooted(rows.where(F.col("n") > MOST_SHARED)))


def _in_blocks(rows: DataFrame, grown: _Components, members: DataFrame, similarity: float) -> None:
    """Links all components of each crowd (fp, size, key, root).

    Every node outside its crowd's largest component meets all members once, in blocks of bounded size that
    the tasks hold as postings; nothing is shuffled, and a member gives one link for each component it meets.
    """
    spent, turn = None, 0
    while True:
        main = rows.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"))
        outside = rows.join(main.select("key", F.col("m.root").alias("main")), "key").where("root <> main").select("fp", "size", "root").distinct()
        outside = materialise(outside if spent is None else outside.join(spent, "fp", "left_anti"), "copies-outside")
        short = F.col("size") <= BLOCK // 8
        left, total, one = outside.agg(F.count("*"), F.sum(F.when(short, F.greatest("size", F.lit(1)))), F.max(F.when(~short, F.col("fp")))).first()
        if not left:
            return
        if total:
            block = outside.where(short & (F.pmod(F.xxhash64("fp", F.lit(turn)), F.lit(-(-total // BLOCK))) == 0))
        else:  # a set larger than that makes a block of its own
            block = outside.where(F.col("fp") == one)
        turn += 1
        block = materialise(block.join(members.select("fp", "shingles"), "fp").select("fp", "root", "shingles"), "copies-block")
        rows = grown.link(rows, materialise(_meeting(members, block, similarity), "copies-verified"))
        ids = block.select("fp")
        spent = ids if spent is None else spent.unionByName(ids)


def _meeting(members: DataFrame, block: DataFrame, similarity: float) -> DataFrame:
    """(u, v): members and the nodes of block (fp, root, shingles) that similar, one v of each root."""
    held = block.toPandas()
    hubs, roots = held["fp"].to_numpy(np.int64), held["root"].to_numpy(np.int64)
    sizes = np.array([len(s) for s in held["shingles"]], np.int64)
    shingles = np.concatenate([np.empty(0, np.int64), *held["shingles"]]).astype(np.int64)
    owner, order = np.repeat(np.arange(len(hubs), dtype=np.int32), sizes), np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], owner[order]

    def overlaps(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.searchsorted(shingles, own, "left")
        many = np.searchsorted(shingles, own, "right") - start
        start, many = start[many > 0], many[many > 0]
        at, counts = 0, {}
        slices = np.searchsorted(np.cumsum(many), np.arange(_POSTINGS, many.sum() + _POSTINGS, _POSTINGS), "left") + 1
        parts = []
        for to in np.unique(slices):  # a bounded number of postings at a time
            n = many[at:to]
            if n.size:
                first = np.repeat(start[at:to] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                parts.append(np.unique(owner[first + np.arange(n.sum())], return_counts=True))
            at = to
        if not parts:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        which, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)
        return which, counts

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            us, vs = [], []
            for fp, own in zip(batch["fp"], batch["shingles"]):
                which, common = overlaps(own)
                enough = which[common >= similarity * (len(own) + sizes[which] - common) - 1e-9]
                enough = enough[hubs[enough] != fp]
                enough = enough[np.unique(roots[enough], return_index=True)[1]]
                us += [fp] * len(enough)
                vs += hubs[enough].tolist()
            yield pd.DataFrame({"u": np.array(us, np.int64), "v": np.array(vs, np.int64)})

    return members.select("fp", "shingles").mapInPandas(met, "u long, v long")


def near_copies(
    docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fp, root, component_id), one row per row of docs; component_id is the smallest id reachable over links."""
    rows = docs.select(F.col(id_col).alias("doc_id"), _signature(F.col(text_col), shingle, seed).alias("s")).select("doc_id", "s.*")
    rows = materialise(rows, "copies-rows")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("bits").alias("bits"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    nodes = materialise(nodes, "copies-nodes")
    roots = roots_of(docs, nodes, shingle=shingle, similarity=similarity, seed=seed, id_col=id_col, text_col=text_col)
    named = nodes.select("fp", "least", F.col("fp").alias("root"))
    if roots is not None:
        named = nodes.select("fp", "least").join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select(F.col("fp").alias("__fp"), "root", "component_id")
    return rows.select("doc_id", "fp").join(named, F.col("fp") == F.col("__fp")).select("doc_id", "fp", "root", "component_id")


def drop_near_copies(docs: DataFrame, *, shingle: int = 5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, that of the smallest id; columns as in docs."""
    found = materialise(near_copies(docs, shingle=shingle, seed=seed, id_col=id_col, text_col=text_col, **options), "copies-found")
    return keep_least(docs, found, node(F.col(text_col), shingle, seed), id_col=id_col)
