"""Versioned tables under a folder, where a write touches only the partitions that it changes.

A partition is a session's part of a table.  A write puts the new content of the touched partitions into a folder of its own
(`<table>/v=<version>/p=<partition>`), then a commit names these folders in a small table (`commits/<number>`): partitions
that it does not name stay as they are, files and all.  What is live is the newest name of each table and partition.  Every
FULL_EVERY commits all live names are written, so that a reader needs the last full commit and the few after it.  A write
that fails before its commit leaves nothing that a reader sees, and of two writers of one number one fails.

Readers keep what they have opened: folders that are no longer named are only removed by `sweep`.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docquery.operators.keys import join_on

NAMES = "n long, full boolean, name string, p string, v string, n_rows long, n_bytes long, n_tokens long, n_postings long"
COUNTS = ("n_bytes", "n_tokens", "n_postings")
#: Commits between two that name everything.
FULL_EVERY = 16
#: Up to so many folders are opened by name; more are found by a join over the table's root.
MOST_PATHS = 256


def partition_of(session: Column) -> Column:
    """The name of a session's partition; null is a session."""
    return F.md5(F.coalesce(F.concat(F.lit("="), session), F.lit("")).cast("binary"))


def partition_name(session: str | None) -> str:
    return hashlib.md5(b"" if session is None else f"={session}".encode()).hexdigest()


class Taken(RuntimeError):
    """Another writer has made the commit that this one was to be."""


class Store:
    """Tables (name -> DDL with session_id), and how each partition is ordered for pruned reads (name -> columns)."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str], order: dict[str, list[str]] | None = None, session: str = "session_id"):
        self.spark, self.path, self.session, self.order = spark, path.rstrip("/"), session, order or {}
        self.schemas = {name: spark.createDataFrame([], ddl).schema for name, ddl in tables.items()}

    # -- what is live ------------------------------------------------------------------------------

    def _files(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _listed(self, path: str) -> list[str]:
        fs, at = self._files(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def commits(self) -> list[int]:
        """Numbers of the commits that are there."""
        fs, _ = self._files(self.path)
        jvm = self.spark.sparkContext._jvm
        done = [n for n in self._listed(f"{self.path}/commits") if n.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{n}/_SUCCESS"))]
        return sorted(map(int, done))

    def live(self) -> DataFrame:
        """name, p, v and counts of each live partition."""
        last = self.commits()
        if not last:
            return self.spark.createDataFrame([], NAMES).drop("n", "full")
        start = last[-1] - last[-1] % FULL_EVERY
        paths = [f"{self.path}/commits/{n:012d}" for n in last if n >= start]
        rows = self.spark.read.schema(NAMES).parquet(*paths)
        named = [c for c in rows.columns if c not in ("n", "full", "name", "p")]
        newest = rows.groupBy("name", "p").agg(F.max_by(F.struct(*named), "n").alias("s"))
        return newest.select("name", "p", "s.*").where("v is not null")

    # -- reading -----------------------------------------------------------------------------------

    def _open(self, name: str, live: DataFrame) -> DataFrame:
        """The table's rows in the live partitions given."""
        schema = self.schemas[name]
        mine = live.where(F.col("name") == name).select("p", "v")
        folders = mine.limit(MOST_PATHS + 1).collect()
        if not folders:
            return self.spark.createDataFrame([], schema)
        if len(folders) <= MOST_PATHS:
            return self.spark.read.schema(schema).parquet(*(f"{self.path}/{name}/v={r.v}/p={r.p}" for r in folders))
        every = self.spark.read.schema(StructType([*schema.fields]).add("v", "string").add("p", "string")).parquet(f"{self.path}/{name}")
        return every.join(mine, ["v", "p"], "left_semi").select(*schema.names)

    def table(self, name: str) -> DataFrame:
        return self._open(name, self.live())

    def of_sessions(self, sessions: Iterable[str | None], *names: str) -> list[DataFrame]:
        """Tables cut to some sessions: only their folders are opened."""
        live = self.live().where(F.col("p").isin([partition_name(s) for s in sessions]))
        live = self.spark.createDataFrame(live.collect(), live.schema)  # a row per table and session asked for
        return [self._open(name, live) for name in names]

    def touched(self, sessions: DataFrame, *names: str) -> list[DataFrame]:
        """Tables cut to the sessions in a DataFrame."""
        asked = sessions.select(partition_of(F.col(self.session)).alias("p")).distinct()
        live = self.live().join(asked, "p", "left_semi")
        return [self._open(name, live) for name in names]

    # -- writing -----------------------------------------------------------------------------------

    def next_number(self) -> int:
        """The number of the next commit: what is read now and written as that commit has seen all before it."""
        done = self.commits()
        return done[-1] + 1 if done else 0

    def replace(self, sessions: DataFrame, tables: dict[str, DataFrame], number: int | None = None) -> int:
        """All rows of the sessions in these tables are now the given ones (rows of other sessions are not allowed). Returns the commit's number.

        With a number, the commit must be that one; if another writer was faster, Taken is raised and nothing has changed.
        """
        touched = sessions.select(partition_of(F.col(self.session)).alias("p")).distinct()
        done = self.commits()
        n, v = (done[-1] + 1 if done else 0), uuid.uuid4().hex
        if number is not None and n != number:
            raise Taken(f"commit {number} is there already")
        full = n % FULL_EVERY == 0
        names = []
        for name, rows in tables.items():
            root, schema = f"{self.path}/{name}/v={v}", self.schemas[name]
            placed = rows.select(*(F.col(f.name).cast(f.dataType) for f in schema)).withColumn("p", partition_of(F.col(self.session)))
            order = ["p", *self.order.get(name, [])]
            # a session with many rows is divided by the order of its columns, and its files don't overlap
            placed.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("p").option("parquet.page.row.count.limit", "4000").parquet(root)
            names.append(self._counted(name, root, v, touched))
        new = reduce(DataFrame.unionByName, names)
        if full and done:
            new = new.unionByName(join_on(self.live(), new.select("name", "p"), ["name", "p"], "left_anti"))
        new = new.select(F.lit(n).cast("long").alias("n"), F.lit(full).alias("full"), *(c for c in new.columns))
        try:
            new.coalesce(1).write.mode("error").parquet(f"{self.path}/commits/{n:012d}")
        except AnalysisException as e:
            raise Taken(f"commit {n} is there already") from e
        return n

    def _counted(self, name: str, root: str, v: str, touched: DataFrame) -> DataFrame:
        """Names of a version's partitions with their counts; a touched partition without rows has no folder."""
        schema = self.schemas[name]
        sums = [F.sum(c).cast("long").alias(c) if c in schema.names else F.lit(None).cast("long").alias(c) for c in COUNTS]
        if any(x.startswith("p=") for x in self._listed(root)):
            rows = self.spark.read.schema(StructType([*schema.fields]).add("p", "string")).parquet(root).groupBy("p").agg(F.count("*").alias("n_rows"), *sums)
        else:
            rows = self.spark.createDataFrame([], "p string, n_rows long, n_bytes long, n_tokens long, n_postings long")
        rows = touched.join(rows, "p", "left")
        return rows.select(F.lit(name).alias("name"), "p", F.when(F.col("n_rows").isNotNull(), F.lit(v)).alias("v"), "n_rows", *COUNTS)

    # -- retention ---------------------------------------------------------------------------------

    def sweep(self, keep: Iterable[str] = ()) -> int:
        """Remove version folders in which nothing is live, and commits before the last full one; returns how many folders went.

        For times without readers of older states; versions in `keep` stay.
        """
        used = {(r.name, r.v) for r in self.live().select("name", "v").distinct().collect()}  # versions, not partitions
        gone = [f"{name}/{x}" for name in self.schemas for x in self._listed(f"{self.path}/{name}") if x.startswith("v=") and (name, x[2:]) not in used and x[2:] not in keep]
        done = self.commits()
        gone += [f"commits/{n:012d}" for n in done if n < done[-1] - done[-1] % FULL_EVERY]
        for folder in gone:
            fs, at = self._files(f"{self.path}/{folder}")
            fs.delete(at, True)
        return len(gone)
