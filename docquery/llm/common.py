"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: A side of a join is broadcast up to so many rows (each a few dozen bytes).
BROADCAST_ROWS = 50_000


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset a local folder serves if the master is local, for then all tasks run on this machine; on a cluster it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (shared or f"file://{_own_folder()}").rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, with a broadcast hint only if a count shows at most `limit` rows; beyond it Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(seed: int, *cols: Column) -> Column:
    """A whole number in [0, 2**52) that depends on the seed and the columns only; nulls hash as empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 13), 16, 10).cast("long")


def learned_on(doc_id: Column, folds: int, held_out: int) -> Column:
    """True for rows that may be learned from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds != held_out, F.lit(False))


#: The hashes that may be sampled are dealt into so many ranges.
SAMPLE_RANGES = 256


def sample_per_group(keys: DataFrame, group: str, id_col: str, most: int, seed: int) -> DataFrame:
    """(group, id_col): at most `most` ids of each group, those of smallest seeded hash: the same ids in any order or partitioning.

    A sketch of the group's distinct ids gives a hash threshold that leaves about four times as many as wanted.  What is
    below is counted by ranges of the hash; whole ranges are taken by the counts, and only within a
    range (a few dozen ids) are rows ranked.  Rows with a null group are left out; repeated ids count once.
    """
    keys = keys.select(group, id_col).where(F.col(group).isNotNull()).withColumn("__h", unit_hash(seed, F.col(id_col)))
    sizes = keys.groupBy(F.col(group).alias("__g")).agg(F.approx_count_distinct("__h").alias("__n"))
    near = keys.join(small_side(sizes), F.col(group) == F.col("__g"))
    place = F.floor(F.col("__h") / (F.lit(2.0**52) * (4.0 * most + 200) / F.greatest("__n", F.lit(1))) * SAMPLE_RANGES).cast("int")
    near = near.withColumn("__p", place).where(F.col("__p") < SAMPLE_RANGES).select(group, id_col, "__h", "__p").distinct()
    counts = near.groupBy(F.col(group).alias("__g"), F.col("__p").alias("__q")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__g").orderBy("__q")) - F.col("__n")  # SAMPLE_RANGES rows a group at most
    counts = counts.withColumn("__before", before).where(F.col("__before") < most)
    near = near.join(small_side(counts), (F.col(group) == F.col("__g")) & (F.col("__p") == F.col("__q")))
    rank = F.row_number().over(Window.partitionBy(group, "__p").orderBy("__h", id_col))
    return near.withColumn("__r", F.col("__before") + rank).where(F.col("__r") <= most).select(group, id_col)


def connected_components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node reachable. edges: (u, v), either direction, not null.

    Rounds of large-star and small-star: every edge is turned towards the
    smallest neighbour, so paths of any shape shrink to stars in logarithmically many rounds.
    Each round ends in a written table.  Nodes without an edge to another node aren't returned.
    """
    cur = materialise(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name
    )

    def star(pairs: DataFrame, keep: Column) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(least, "u").where(keep)

    def mark(df: DataFrame) -> tuple:
        # order-free fingerprint of the edge set
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(cur)
    for _ in range(most_rounds):
        if before[0] == 0:
            break
        both = cur.union(cur.select("v", "u"))
        large = star(both, F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = star(large, F.lit(True))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        cur = materialise(small.where("u <> v").distinct(), name)
        after = mark(cur)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
