"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints of 64 bits link when at most two bits differ.  A fingerprint is
cut into three segments of 22, 21 and 21 bits.  Of two errors, by the
pigeonhole principle one segment is free and, read in cyclic order, there is a
segment without error whose successor has at most one.  The successor, padded
to 23 bits, is decoded by the perfect binary Golay code: every word lies
within three bits of exactly one of 4096 codewords.  Decoding the segment and
its 23 one-bit neighbours gives one index or six; two segments that differ in
one bit share the first's own index among the second's.  So the join key is
(which segment, its raw bits, a codeword index), and candidates are verified bit by bit.

Keys that would give many candidates (a cloud of near copies) go another exact
way without pairs: each of their fingerprints is spread to the 65 words within
one bit, and fingerprints that meet in a word, so differing in at most two bits, link to the smallest there.

Equal fingerprints are one node throughout, so copies cost nothing but their
row.  Links are turned into components by star rounds over written tables.

Defined cases: null and empty texts have fingerprint zero and link like any
other; fewer words than a shingle are one shingle; rows with a null id take
part, but a component whose ids are all null has a null component_id; repeated rows share a component; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquery.llm.common import connected_components, materialise

#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the binary Golay code [23, 12, 7] (a fixed value).
GOLAY = 0b101011100011
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A key with more home-probe pairs than this takes the way without pairs.
MOST_PAIRS = 64


def fingerprint(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """64-bit SimHash: a bit is 1 if set in over half of the XXH64 values of the word shingles, repeats included."""

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_simhash(x, shingle, seed) for x in texts], dtype="int64")

    return simhash(text)


def _simhash(text: str | None, shingle: int, seed: int) -> int:
    # bytes lower and split by ASCII only
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    n, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    return majority(np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends[-n:])), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 if there are none."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for some in range(0, n, 65_536):  # memory stays small for very long texts
        bits = np.unpackbits(hashes[some : some + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _remainder(words: np.ndarray) -> np.ndarray:
    """Syndromes: remainders of 23-bit words by the generator."""
    words = words.copy()
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ (GOLAY << (bit - 11)), words)
    return words


def _error_table() -> np.ndarray:
    """Syndrome -> error pattern of at most three bits; the code is perfect, so all 2048 are met once."""
    one = 1 << np.arange(23)
    two = one[:, None] | one
    three = two[:, :, None] | one
    errors = np.unique(np.concatenate([[0], one, two.ravel(), three.ravel()]))
    table = np.zeros(2048, np.int64)
    table[_remainder(errors)] = errors
    return table


_ERRORS = _error_table()
#: A word and its one-bit neighbours.
_BALL = np.concatenate([[0], 1 << np.arange(23)])


def golay_index(words: np.ndarray) -> np.ndarray:
    """Index of the codeword within three bits of each 23-bit word."""
    return (words ^ _ERRORS[_remainder(words)]) >> 11


def golay_keys(fps: pd.Series) -> Iterator[pd.DataFrame]:
    """(fp, key, home): for each segment the own key and the neighbours' keys, each once."""
    fp = fps.to_numpy(np.int64)
    for k, (start, width) in enumerate(SEGMENTS):
        after, length = SEGMENTS[(k + 1) % 3]
        raw = fp >> start & (1 << width) - 1
        near = golay_index((fp >> after & (1 << length) - 1)[:, None] ^ _BALL[None, : length + 1])
        keys = (k << 34 | raw << 12)[:, None] | near
        own = keys[:, 0]
        yield pd.DataFrame({"fp": fp, "key": own, "home": True})
        keys = np.sort(keys, axis=1)
        fresh = np.ones(keys.shape, bool)
        fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
        yield pd.DataFrame({"fp": np.repeat(fp, fresh.sum(axis=1)), "key": keys[fresh], "home": False})


def links(fps: DataFrame, most_bits: int = 2) -> DataFrame:
    """(u, v) with u > v that connect exactly the fingerprints at up to two differing bits; fps: distinct longs `fp`.

    Every pair of linked fingerprints is in one component of the result.
    """
    if most_bits != 2:
        raise ValueError("the keys are made for two errors")
    keyed = fps.mapInPandas(lambda batches: (out for b in batches for out in golay_keys(b["fp"])), "fp long, key long, home boolean")
    keyed = materialise(keyed, "golay-keys")
    sizes = keyed.groupBy("key").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("probes"))
    sizes = sizes.where("homes > 0 and probes > 1").withColumn("hot", F.col("homes") * F.col("probes") > MOST_PAIRS)
    met = materialise(keyed.join(sizes.select("key", "hot"), "key"), "golay-met")

    home = met.where("home and not hot").select("key", F.col("fp").alias("u"))
    probe = met.where("not home and not hot").select("key", F.col("fp").alias("v"))
    pairs = home.join(probe, "key").where("u <> v and bit_count(u ^ v) <= 2")
    pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))

    # the same bits apart, met halfway: a word within one bit of both
    crowd = met.where("hot").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)))
    spread = crowd.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    spread = materialise(spread, "golay-spread")
    least = spread.groupBy("word").agg(F.min("fp").alias("v"), F.max("fp").alias("top")).where("v <> top")
    stars = spread.join(least.select("word", "v"), "word").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id), one row per row of docs; component_id is the smallest id reachable over links."""
    rows = docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), shingle, seed).alias("fp"))
    rows = materialise(rows, "simhash-rows")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    return component_rows(rows, nodes, links(nodes.select("fp")))


def component_rows(rows: DataFrame, nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """rows (doc_id, fp) with root and component_id, from nodes (fp, least id) and their links (u, v)."""
    roots = connected_components(linked, "simhash-components").withColumnRenamed("node", "fp")
    nodes = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(ids, "root").select(F.col("fp").alias("__fp"), "root", "component_id")
    named = materialise(named, "simhash-named")
    return rows.join(named, F.col("fp") == F.col("__fp")).select("doc_id", "fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, that of the smallest id; columns as in docs.

    Where that id is null or repeated, rows are told apart by fingerprint and one of the equal ones stays.
    """
    found = materialise(near_duplicates(docs, id_col=id_col, text_col=text_col, **options), "simhash-found")
    return keep_least(docs, found, fingerprint(F.col(text_col), **options), id_col=id_col)


def keep_least(docs: DataFrame, found: DataFrame, own: Column, *, id_col: str = "doc_id") -> DataFrame:
    """docs' row of the smallest id of each component in found (doc_id, fp, root, component_id); own: a row's fp."""
    least = F.col("doc_id").eqNullSafe(F.col("component_id"))
    per_id = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(least).alias("keep"))
    per_id = materialise(per_id.withColumnRenamed("doc_id", "__id"), "simhash-ids")
    # a shuffle at any size: the ids grow with the documents
    kept = per_id.where("n = 1 and keep and __id is not null").hint("merge")
    once = docs.join(kept, F.col(id_col) == F.col("__id"), "left_semi")
    if per_id.where("n > 1 or __id is null").isEmpty():
        return once

    repeated = per_id.where("n > 1 and __id is not null").select("__id")
    odd = docs.join(repeated, F.col(id_col) == F.col("__id"), "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
    odd = odd.withColumn("__own", own)
    odd_ids = found.where(least).join(repeated, F.col("doc_id") == F.col("__id"), "left_semi")
    odd_ids = odd_ids.unionByName(found.where(least & F.col("doc_id").isNull()))
    firsts = odd_ids.groupBy("root").agg(F.min("doc_id").alias("__id"), F.min("fp").alias("__fp"))
    firsts = firsts.withColumnRenamed("root", "__root")
    thin = odd.join(firsts, (F.col("__own") == F.col("__fp")) & F.col(id_col).eqNullSafe(F.col("__id")))
    return once.unionByName(thin.dropDuplicates(["__root"]).select(*docs.columns))
