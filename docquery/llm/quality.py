"""Quality rules with thresholds that adapt to language and source.

Each document has five measures, kept per million as whole numbers.  Four are odds, part / rest, so that every fence lies where a
text can be: symbols and capitals among word characters, repeated lines among lines, and words in repeated three-word
windows among half the words (the base rule takes those above half).  The fifth is characters a word.  Counts are
smoothed by one, so that even a measure that most documents lack has a spread: that of their lengths.  Lines are few, so one more
repeated line would say how short a text is; they are smoothed by PRIOR_LINES lines at the mean of the group (documents with
a repeated line, per line: one bad document moves it little), itself drawn to the mean of all by MEAN_LINES lines.

The distribution of a measure is kept per language and source as a quantile sketch: counts of logarithmic
buckets of relative width 1/32.  Sketches merge by adding counts, in any order,
so a source with few documents falls back on its language's sketch and that on
the sketch of all, and a rerun gives the same thresholds.

The fence is set on the sketch's own logarithmic scale: a document fails a
measure above q3 * (q3 / q1)^reach, for word length also below
q1 / (q3 / q1)^reach, with the quartiles q1 and q3 of its group.  The reach of a measure is a fixed parameter: it says how heavy the tail
of clean text may be in ratios of its quartiles; the fences themselves follow the groups.  A ratio below one bucket counts as one
bucket.  Thresholds are joined to the documents by language and source.

Defined cases: null text is an empty one and fails the base rule; null language
or source is a group of its own; repeated rows count and are judged alike; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.llm.common import materialise, small_side

#: measure -> (how many ratios of the quartiles the fence is away, judged below as well)
MEASURES = {
    "symbols": (2, False),
    "capitals": (4, False),
    "dup_lines": (4, False),
    "repeats": (4, False),
    "word_length": (6, True),
}
#: Width of a bucket: the least ratio of the quartiles that counts.
LEAST_RATIO = 33 / 32
#: Lines at the group's mean that smooth a document's repeated lines, and lines at the mean of all that smooth a group's.
PRIOR_LINES, MEAN_LINES = 20, 1000
#: A group with fewer documents uses the next wider group's sketch.
LEAST_DOCS = 50

FEATURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_capitals long"
_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
_SPACES = str.maketrans("", "", " \t\n\x0b\x0c\r")
_CAPITALS = str.maketrans("", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def measure_text(text: str | None) -> tuple[int, ...]:
    """The features of one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # at ASCII white space
    chars = len(text.translate(_SPACES))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            counts, reach = Counter(windows), 0
            for i, window in enumerate(windows):
                if counts[window] > 1:
                    repeated += i + 3 - max(i, reach)
                    reach = i + 3
    return (
        len(words), chars, len(text) - len(text.translate(_SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated,
        len(text) - len(text.translate(_CAPITALS)),
    )


def features(text: Column) -> Column:
    names = [x.split()[0] for x in FEATURES.split(", ")]

    @F.pandas_udf(FEATURES)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([measure_text(x) for x in texts], columns=names, dtype="int64")

    return measured(text)


def _odds(part: str, rest: str) -> Column:
    """Smoothed odds per million, 1 at least."""
    return F.expr(f"greatest(1L, ({part} + 1) * 1000000 div (greatest(0L, {rest}) + 1))")


def with_line_odds(rows: DataFrame) -> DataFrame:
    """rows (lang, source, n_lines, n_dup_lines, base_failed) with dup_lines: odds smoothed by the group's mean; two sums come to the driver."""
    sums = rows.where("not base_failed").groupBy(F.col("lang").alias("__lang"), F.col("source").alias("__source"))
    sums = materialise(sums.agg(F.count_if(F.col("n_dup_lines") > 0).alias("__dup"), F.sum("n_lines").alias("__lines")), "quality-lines")
    dup, lines = sums.agg(F.sum("__dup"), F.sum("__lines")).first()
    overall = (dup or 0) / (lines or 1)
    joined = rows.join(small_side(sums), F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    group = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    mean = (group("__dup") + F.lit(MEAN_LINES * overall)) / (group("__lines") + float(MEAN_LINES))
    odds = 1e6 * (F.col("n_dup_lines") + PRIOR_LINES * mean) / (F.col("n_lines") - F.col("n_dup_lines") + 1).cast("double")
    return joined.withColumn("dup_lines", F.greatest(F.lit(1).cast("long"), F.floor(odds))).drop("__lang", "__source", "__dup", "__lines")


def bucket(value: str) -> Column:
    """Number of the sketch's bucket for a column: exact below 64, then the upper six bits and their place."""
    shift = f"greatest(length(bin({value})) - 6, 0)"
    return F.expr(f"cast({shift} * 64 + shiftright({value}, {shift}) as long)")


def _floor_of(place: Column) -> Column:
    """Least value of a bucket."""
    return F.when(place < 64, place).otherwise((place % 64) * F.pow(F.lit(2.0), F.floor(place / 64))).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, place, n): the sketch of each group, from columns lang, source and the measures."""
    pairs = F.explode(F.create_map(*(x for m in MEASURES for x in (F.lit(m), F.col(m)))))
    rows = measured.select("lang", "source", pairs.alias("measure", "value"))
    return rows.groupBy("lang", "source", "measure", bucket("value").alias("place")).agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, *keys: str) -> DataFrame:
    """Sketches of wider groups: counts add up."""
    return sketch.groupBy(*keys, "measure", "place").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, measure, docs, q1, q3): the first bucket whose running count reaches the quantile."""
    group = [*keys, "measure"]
    running = sketch.withColumn("upto", F.sum("n").over(Window.partitionBy(*group).orderBy("place")))
    running = running.withColumn("docs", F.sum("n").over(Window.partitionBy(*group)))
    value = _floor_of(F.col("place"))
    return running.groupBy(*group).agg(
        F.max("docs").alias("docs"),
        F.min(F.when(F.col("upto") * 4 >= F.col("docs"), value)).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("docs") * 3, value)).alias("q3"),
    )


def thresholds(sketch: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, group_docs, lo_<measure>, hi_<measure>), a row per language and source."""
    own = quartiles(sketch, "lang", "source")
    langs = quartiles(merge(sketch, "lang"), "lang").select(F.col("lang").alias("l2"), F.col("measure").alias("m2"), F.col("docs").alias("d2"), F.struct("q1", "q3").alias("w2"))
    every = quartiles(merge(sketch)).select(F.col("measure").alias("m3"), F.struct("q1", "q3").alias("w3"))
    joined = own.join(langs, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("measure") == F.col("m2")))
    joined = joined.join(F.broadcast(every), F.col("measure") == F.col("m3"))  # a row per measure
    use = F.when(F.col("docs") >= least_docs, F.struct("q1", "q3")).when(F.col("d2") >= least_docs, F.col("w2")).otherwise(F.col("w3"))
    joined = joined.withColumn("use", use).select("lang", "source", "measure", "docs", "use.q1", "use.q3")
    joined = joined.withColumn("ratio", F.greatest(F.col("q3") / F.col("q1"), F.lit(LEAST_RATIO)))
    picks = [F.max("docs").alias("group_docs")]
    for m, (reach, _) in MEASURES.items():
        hi, lo = F.col("q3").cast("double"), F.col("q1").cast("double")
        for _ in range(reach):
            hi, lo = hi * F.col("ratio"), lo / F.col("ratio")
        picks += [F.max(F.when(F.col("measure") == m, x)).alias(f"{name}_{m}") for name, x in (("lo", lo), ("hi", hi))]
    return joined.groupBy("lang", "source").agg(*picks)


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, features, measures, base_failed, failed (names of the measures beyond their thresholds), kept."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), features(F.col(text_col)).alias("f"))
    rows = rows.select("doc_id", "lang", "source", "f.*")
    rows = rows.withColumns(
        {
            "symbols": _odds("n_symbols", "word_chars - n_symbols"),
            "capitals": _odds("n_capitals", "word_chars - n_capitals"),
            "repeats": _odds("2 * n_repeat_words", "n_words - 2 * n_repeat_words"),
            "word_length": _odds("word_chars", "n_words"),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )
    rows = with_line_odds(materialise(rows, "quality-rows"))
    limits = materialise(thresholds(sketches(rows.where("not base_failed"))), "quality-limits")
    limits = limits.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    same = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    joined = rows.join(small_side(limits), same, "left")
    beyond = [
        F.when((F.col(m) > F.col(f"hi_{m}")) | (F.lit(both) & (F.col(m) < F.col(f"lo_{m}"))), F.lit(m)) for m, (_, both) in MEASURES.items()
    ]
    joined = joined.withColumn("failed", F.array_join(F.array(*beyond), ","))
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("failed") == "")).drop("__lang", "__source")
