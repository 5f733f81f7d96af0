"""What bounds a task: rows dealt without a sort, Python functions over small parts, and postings in tasks of bounded rows."""

import pyarrow as pa
from pyspark.sql import functions as F

from docquery.functions import parts
from docquery.operators import keys, retrieve
from docquery.sources import pages


def test_dealt_by_place(spark):
    rows = keys.spread(spark.range(0, 100, 1, 2).select("id", F.repeat(F.lit("x"), 50).alias("t")))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plan and "RoundRobin" not in plan and rows.columns == ["id", "t"]
    assert rows.rdd.getNumPartitions() == 16 and sorted(r.id for r in rows.collect()) == list(range(100))


def test_small_parts(spark, monkeypatch):
    """Parts are small or one row, in order; a column made of them has each row's own value, nulls too."""
    texts = pa.array(["a" * 1000, None, "b" * 5000, "", "c"] * 300)
    monkeypatch.setattr(parts, "PART_BYTES", 4000)
    cut = [p for (p,) in parts.parts((texts,))]
    assert pa.chunked_array(cut).to_pylist() == texts.to_pylist() and all(len(p) == 1 or p.nbytes <= 4000 for p in cut)
    rows = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.repeat(F.lit("y"), (F.col("id") % 50).cast("int"))).alias("t"))
    out = rows.select("id", parts.mapped(lambda x, n: [f"{a}{b}" for a, b in zip(x, n)], "string", pa.string(), F.col("t"), F.col("id")).alias("v"))
    assert all(r.v == (f"{'y' * (r.id % 50)}{r.id}" if r.id % 7 else f"None{r.id}") for r in out.collect())


def test_meeting_rows(spark, monkeypatch):
    """More tasks sum the postings when more of them meet questions, with the same hits."""
    chunks = spark.createDataFrame([(n, f"red w{n % 3} blue") for n in range(60)], "k int, text string")
    asked = spark.createDataFrame([(1, "red w1"), (2, "blue w2")], "query_id int, text string")
    got = []
    for most in (1_000_000, 10):
        monkeypatch.setattr(retrieve, "MEETING_ROWS", most)
        hits = retrieve.bm25(chunks, ["k"], asked, 5)
        got.append(sorted((r.query_id, r.k, round(r.score, 9), r["rank"]) for r in hits.collect()))
        plan = hits._jdf.queryExecution().executedPlan().toString()
        n = {1_000_000: 4, 10: 16}[most]
        assert f", {n}), REPARTITION_BY_NUM" in plan
    assert got[0] == got[1] and len(got[0]) == 10


def test_file_is_opened_once():
    seen = []

    def engine(data):
        seen.append(data)
        return [lambda n=n: f"page {n}" for n in range(10)]

    def broken(data):
        seen.append(b"broken")
        raise ValueError("no")

    got = pages.ranges_text(b"x", [(0, 4), (4, 4), (8, 2)], [("b", broken), ("e", engine)])
    assert [t.count("page") for t, _ in got] == [4, 4, 2] and all(e == ["b ValueError: no"] for _, e in got) and seen == [b"broken", b"x"]
