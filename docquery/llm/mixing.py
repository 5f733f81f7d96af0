"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the word budget in proportion to its weight; no
source may be read more than `max_epochs` times, and what a clamped source
cannot take goes to the others by weight until none is above its limit.
Within a source every document is read floor(target / size) times, and the
fractional rest is a seeded sample without replacement that stops nearest to the target.

Defined cases: null text counts 0 words; null source is a source of its own;
a source without a positive weight gets target 0; equal rows are told apart
by nothing and may swap places; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.llm.common import materialise, small_side, unit_hash, word_count

#: The seeded order of each source is cut into so many ranges; only the range that holds the cut is ranked row by row.
RANGES = 4096


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """(source, weight): sources by code point, null last, weighted in turn. One row per source comes in."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    return sources.select("source", F.element_at(F.array(*map(F.lit, map(float, weights))), place % len(weights) + 1).alias("weight"))


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Add `target` to (source, source_size, weight).

    Clamping only ever raises the level for the rest, so the clamped set grows until it is stable.
    The driver holds three sums a round, no rows.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)
    level, clamped = 0.0, -1
    while True:
        above = (weight > 0) & (cap < F.lit(level) * weight) if clamped >= 0 else F.lit(False)
        taken, free, n = sources.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, weight)), F.lit(0.0)),
            F.count_if(above),
        ).first()
        if n == clamped or not free:
            break
        level, clamped = (budget - taken) / free, n
    goal = F.least(cap, F.lit(level) * weight) if free else cap
    return sources.withColumn("target", F.when(weight > 0, goal).otherwise(0.0))


def mix_plan(
    docs: DataFrame,
    weights=cyclic_weights,
    *,
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """(sized rows, plan): the plan has a row per source with target, whole repetitions and the cut of the seeded order.

    weights: DataFrame (source, weight), or a function from a DataFrame of sources to one.
    """
    sized = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            unit_hash(seed, F.col(id_col)).alias("u"),
        ),
        "mix-sizes",
    )
    ranges = sized.groupBy("source", _part("u").alias("part")).agg(F.sum("size").alias("part_size"))
    ranges = materialise(ranges, "mix-ranges")
    sources = ranges.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    given = weights(sources.select("source")) if callable(weights) else weights
    given = given.select(F.col("source").alias("__s"), "weight")
    sources = materialise(sources.join(given, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s"), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    plan = water_fill(sources, share * total, max_epochs)
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = plan.withColumn("whole", whole.cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).drop("weight")
    plan = small_side(plan.withColumnRenamed("source", "plan_source"))
    same = F.col("source").eqNullSafe(F.col("plan_source"))

    # the range in which the running size of the seeded order passes the rest, then the last row before the cut
    before = F.sum("part_size").over(Window.partitionBy("source").orderBy("part")) - F.col("part_size")
    cut = ranges.withColumn("before", before).join(plan, same).where("before <= rest")
    cut = cut.groupBy(F.col("source").alias("cut_source"), "rest").agg(F.max("part").alias("cut_part"), F.max("before").alias("before"))
    cut = small_side(materialise(cut, "mix-cuts"))
    edge = sized.join(cut, F.col("source").eqNullSafe(F.col("cut_source")) & (_part("u") == F.col("cut_part")))
    order = Window.partitionBy("source").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("start", F.col("before") + F.sum("size").over(order) - F.col("size"))
    edge = edge.where(F.col("start") + F.col("size") / 2 < F.col("rest"))
    last = edge.groupBy(F.col("source").alias("last_source")).agg(F.max(F.struct("u", "doc_id", "size")).alias("cut_row"))
    plan = plan.join(cut.drop("rest", "before"), F.col("plan_source").eqNullSafe(F.col("cut_source")), "left")
    plan = plan.join(last, F.col("plan_source").eqNullSafe(F.col("last_source")), "left")
    plan = plan.select("plan_source", "source_size", "target", "whole", "cut_part", "cut_row")
    return sized, small_side(materialise(plan, "mix-plan"))


def _part(u: str) -> Column:
    return F.floor(F.col(u) / (2**52 // RANGES))


def _copies() -> Column:
    in_order = F.struct("u", "doc_id", "size") <= F.col("cut_row")
    extra = (_part("u") < F.col("cut_part")) | ((_part("u") == F.col("cut_part")) & in_order)
    return F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long")


def mix(docs: DataFrame, weights=cyclic_weights, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row per row of docs; options as in mix_plan."""
    sized, plan = mix_plan(docs, weights, **options)
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).withColumn("copies", _copies())
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_rows(docs: DataFrame, weights=cyclic_weights, *, seed: int = 17, **options) -> DataFrame:
    """docs with every row as often as the mix takes it; columns as in docs.

    The plan is a row per source, so the texts aren't shuffled.
    """
    _, plan = mix_plan(docs, weights, seed=seed, **options)
    id_col, text_col, source_col = (options.get(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    row = F.struct(*docs.columns).alias("row")
    rows = docs.select(
        row, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        unit_hash(seed, F.col(id_col)).alias("u"),
    )
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).withColumn("copies", _copies().cast("int"))
    rows = rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select("row.*")
