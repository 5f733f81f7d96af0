"""The pipeline's stages one by one on the smallest tables, and as a whole."""

from collections import Counter

from against import SF
from pyspark.sql import functions as F

import corpus_pipeline
from docquery.llm import toxicity
from docquery.llm.common import materialise
from test_near_copies import kept_by_brute_force


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, SF), f"test-{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
            scores = before.select("doc_id", toxicity.score(F.col("text"), model).alias("s"))
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in scores.where("s < 0.5").collect()}
        if name == "simhash":
            want = kept_by_brute_force([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in docs.collect()) == sorted(want)
        if name == "secrets":
            assert docs.count() == before.count()
            assert docs.where("text rlike '[0-9a-f]{24,}' or text rlike 'AKIA[A-Z0-9]{16,}'").count() == 0
            assert docs.where("n_chars <> length(text)").count() == 0
        if name == "mixing":
            assert max(Counter(r.doc_id for r in docs.collect()).values()) <= 2
            assert docs.select(*columns).distinct().join(before, columns, "left_anti").count() == 0
    assert seen["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_odd_documents(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", None, "s", 0), (2, "x" * 10_000, "en", None, 1), (2, "x" * 10_000, "en", None, 1), (3, "one two three", "en", "s", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.where("false")):
        out = frame
        for name, stage in corpus_pipeline.STAGES:
            out = materialise(stage(spark, out, SF), f"odd-{name}")
        assert (out.count() > 0) == (frame is docs)


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries().keys()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
