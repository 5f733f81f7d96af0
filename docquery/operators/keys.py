"""Joins on keys where null equals null, places within large groups, and work dealt over all cores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on keys, null keys being equal; right's keys are dropped."""
    names = {k: f"__right_{n}" for n, k in enumerate(keys)}
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(names[k])) for k in keys))
    out = left.join(right.withColumnsRenamed(names), same, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*names.values())


def placed(rows: DataFrame, group: list[str], slot: Column, order: list[str], out: str) -> DataFrame:
    """rows with their place (from 1) within the group by slot and order.

    slot must not fall along the order; counts of slots give the places before each, so one task ranks a slot of a group, not the group.
    """
    rows = rows.withColumn("__slot", slot)
    counts = rows.groupBy(*group, "__slot").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__slot")) - F.col("__n")
    rows = join_on(rows, counts.select(*group, "__slot", before.alias("__before")), [*group, "__slot"])
    within = F.row_number().over(Window.partitionBy(*group, "__slot").orderBy(*order))
    return rows.withColumn(out, (F.col("__before") + within).cast("int")).drop("__slot", "__before")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores where their scan makes no more tasks than there are cores (a table of one row group): for costly work on each row.

    Plans with a shuffle stay as they are: that has dealt the rows, and counting its partitions would run it. Rows are dealt by a
    hash of their place, in parts for several rounds of tasks: dealing them round robin would sort each scanned part, texts and all, in its task first.
    """
    if rows._jdf.queryExecution().executedPlan().toString().startswith("AdaptiveSparkPlan"):
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() > cores:
        return rows
    return rows.withColumn("__place", F.monotonically_increasing_id()).repartition(4 * cores, "__place").drop("__place")
