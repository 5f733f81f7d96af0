"""Every measure's fence lies where a text can be: planted documents fail it in at least 95 of 100 groups of the tables, and clean labelled ones stay."""

import random

from against import SF
from pyspark.sql import functions as F

from docquery.llm import quality

LARGE = SF.replace("0.001", "0.1")


def planted(rng):
    word = lambda k=5: "".join(rng.choices("bcdfghjklm", k=k))
    plain = [word() for _ in range(300)]
    lines = [" ".join(plain[i : i + 5]) + "\none\ntwo\nthree\nfour" for i in range(0, 300, 5)]  # eight in ten lines are repeated
    again = [" ".join(plain[:150])] + ["the same four words"] * 36  # 144 of 294 words
    return {
        "symbols": " ".join(w + "##" for w in plain), "capitals": " ".join(plain).upper(), "dup_lines": "\n".join(lines), "repeats": " ".join(again),
        "word_length": " ".join(word(40) for _ in range(300)),
    }


def test_planted_documents_fail(spark):
    docs = spark.read.parquet(f"{LARGE}/documents.parquet")
    texts = planted(random.Random(1))
    assert texts.keys() == quality.MEASURES.keys()
    rows = [(-1 - n, x) for n, x in enumerate(texts.values())]
    groups = docs.select("lang", "source").distinct().crossJoin(F.broadcast(spark.createDataFrame(rows, "doc_id long, text string")))  # five texts
    judged = quality.judge(docs.select("doc_id", "text", "lang", "source").unionByName(groups.select("doc_id", "text", "lang", "source")))
    missed = judged.where("doc_id < 0").select("doc_id", "lang", "source", "base_failed", "failed").collect()
    assert len(missed) == 5 * docs.select("lang", "source").distinct().count()
    for name, (key, _) in zip(texts, rows):
        mine = [r for r in missed if r.doc_id == key]
        assert not any(r.base_failed for r in mine)
        assert sum(name in r.failed.split(",") for r in mine) >= 0.95 * len(mine), (name, [(r.lang, r.source, r.failed) for r in mine if name not in r.failed.split(",")])
    labels = judged.where("doc_id >= 0").join(spark.read.parquet(f"{LARGE}/labels.parquet"), "doc_id")
    clean = labels.where("not base_failed").groupBy("quality").agg(F.count_if("kept").alias("kept"), F.count("*").alias("n")).collect()
    share = {r.quality: r.kept / r.n for r in clean}
    assert share[1] > 0.99 and share[0] < 0.01
