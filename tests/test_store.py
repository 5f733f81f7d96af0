"""The versioned store, and the engine on it: reopening, untouched files, null keys, equal bytes, pruned reads."""

import datetime as dt
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docquery.config import EngineConfig
from docquery.operators import retrieve
from docquery.operators import store as stores
from docquery.operators.store import Store, partition_name
from docquery.plans.engine import Engine, of_tokens

T0 = dt.datetime(2026, 1, 1, 12)
SCHEMA = "session_id string, conversation_id string, file_name string, content binary, upload_time timestamp"


def incoming(spark, *rows):
    return spark.createDataFrame([(s, c, n, bytearray(b), T0 + dt.timedelta(minutes=m)) for s, c, n, b, m in rows], SCHEMA)


def files_under(path, name):
    return {str(p): p.stat().st_mtime_ns for p in (Path(path) / name).rglob("*.parquet")}


def test_commits(spark, tmp_path, monkeypatch):
    """Newest names win, sessions may be emptied, full commits and sweeping keep what is live."""
    monkeypatch.setattr(stores, "FULL_EVERY", 4)
    s = Store(spark, str(tmp_path), {"t": "session_id string, x int, n_bytes long"}, {"t": ["x"]})
    rows = lambda *r: spark.createDataFrame(r, "session_id string, x int, n_bytes long")
    assert s.table("t").count() == 0 and s.live().count() == 0
    want = {}
    for n in range(6):
        who = [None, "", "a", "b=/ %"][n % 4]
        want[who] = n
        assert s.replace(rows((who, n, 1)), {"t": rows((who, n, 1), (who, -n, 2))}) == n
    other = Store(spark, str(tmp_path), {"t": "session_id string, x int, n_bytes long"})
    assert {(r.session_id, r.x) for r in other.table("t").collect()} == {(k, x) for k, n in want.items() for x in (n, -n)}
    assert {r.n_bytes for r in other.live().collect()} == {3} and {r.n_rows for r in other.live().collect()} == {2}
    other.replace(rows(("a", 0, 0)), {"t": rows()})
    del want["a"]
    assert {r.session_id for r in s.table("t").collect()} == want.keys()
    assert [df.count() for df in s.of_sessions(["a", None], "t", "t")] == [2, 2]
    with pytest.raises(Exception):  # a number is taken once
        s.commits = lambda: list(range(3))
        s.replace(rows(("a", 0, 0)), {"t": rows()})
    del s.commits
    assert s.sweep() > 0 and {(r.session_id, r.x) for r in s.table("t").collect()} == {(k, x) for k, n in want.items() for x in (n, -n)}
    assert s.sweep() == 0


def test_many_sessions_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "MOST_PATHS", 2)
    s = Store(spark, str(tmp_path), {"t": "session_id string, x int"})
    rows = spark.createDataFrame([(f"{i}" * 32, i) for i in range(9)], "session_id string, x int")
    s.replace(rows, {"t": rows})
    s.replace(rows.where("x = 3"), {"t": rows.where("x = 3").withColumn("x", F.lit(30))})
    assert sorted(r.x for r in s.table("t").collect()) == [0, 1, 2, 4, 5, 6, 7, 8, 30]
    assert sorted(r.x for r in s.touched(rows.where("x < 4"), "t")[0].collect()) == [0, 1, 2, 30]


def test_reopened(spark, tmp_path):
    c = EngineConfig(chunk_size=60, chunk_overlap=10, min_score=0.0)
    e = Engine(spark, str(tmp_path), c)
    e.ingest(incoming(spark, ("s", "c", "a.txt", b"apples and pears", 0), ("t", "c", "b.txt", b"cars and lorries", 0)))
    before = {n: files_under(tmp_path, n) for n in ("files", "chunks", "postings", "vectors")}
    again = Engine(spark, str(tmp_path), c)
    assert {r.file_name for r in again.files.collect()} == {"a.txt", "b.txt"}
    again.ingest(incoming(spark, ("t", "c", "new.txt", b"ships and planes", 1)))
    for name, had in before.items():  # what another session holds is the same file as before
        now = files_under(tmp_path, name)
        mine = {p: t for p, t in had.items() if f"p={partition_name('s')}" in p}
        assert mine and all(now[p] == t for p, t in mine.items())
        added = now.keys() - had.keys()
        assert added and all(f"p={partition_name('t')}" in p for p in added)
    asked = spark.createDataFrame([(1, "ships")], "query_id int, text string")
    assert e.search(asked, "t").where("rank = 1").first().file_name == "new.txt"  # the first engine sees it too
    e.store.sweep()
    assert {r.file_name for r in again.files.collect()} == {"a.txt", "b.txt", "new.txt"}


def test_null_keys(spark, tmp_path):
    e = Engine(spark, str(tmp_path), EngineConfig(chunk_size=60, chunk_overlap=10, min_score=0.0))
    e.ingest(incoming(spark, ("s", None, "a.txt", b"apples and pears", 0), (None, None, "n.txt", b"null and void", 0)))
    e.ingest(incoming(spark, ("s", None, "a.txt", b"plums and cherries", 1), (None, None, "n.txt", b"nothing at all", 1)))
    assert {(r.session_id, r.file_name, r.text) for r in e.files.collect()} == {("s", "a.txt", "plums and cherries"), (None, "n.txt", "nothing at all")}
    assert e.chunks.count() == e.vectors.count() == 2
    asked = spark.createDataFrame([(1, "plums"), (2, "nothing")], "query_id int, text string")
    assert {(r.query_id, r.file_name) for r in e.search(asked, "s").where("source = 'both'").collect()} == {(1, "a.txt")}
    assert {(r.query_id, r.file_name) for r in e.search(asked, None).where("source = 'both'").collect()} == {(2, "n.txt")}
    e.ingest(incoming(spark, ("s", None, "b.txt", b"plums and cherries", 5)))  # known bytes only touch
    assert e.files.where("session_id = 's'").count() == 1 and e.files.where("session_id = 's'").first().last_used == T0 + dt.timedelta(minutes=5)
    e.touch(e.files.where("session_id is null"), T0 + dt.timedelta(minutes=9))
    assert [r.rounds for r in e.files.where("session_id is null").collect()] == [1]
    e.clear(spark.createDataFrame([(None,)], "session_id string"))
    assert {r.session_id for r in e.files.collect()} == {"s"}


def test_equal_bytes_in_one_batch(spark, tmp_path):
    e = Engine(spark, str(tmp_path), EngineConfig(chunk_size=60, chunk_overlap=10))
    refused = e.ingest(incoming(spark, ("s", "c", "b.txt", b"same", 1), ("s", "c", "a.txt", b"same", 3), ("s", "d", "a.txt", b"same", 0), ("s", "c", "x.rtf", b"{\\rtf1", 0), ("s", "c", "y.rtf", b"{\\rtf1", 2)))
    assert {r.file_name for r in refused.collect()} == {"x.rtf", "y.rtf"}
    assert {(r.conversation_id, r.file_name, r.last_used.minute) for r in e.files.collect()} == {("c", "b.txt", 3), ("d", "a.txt", 0)}


def test_search_reads_only_asked_tokens(spark, tmp_path):
    """The plan scans no text for the lexical arm, and the scan of postings skips pages by the asked tokens."""
    words = [f"w{i:05d}" for i in range(40_000)]
    text = " ".join(words).encode()
    e = Engine(spark, str(tmp_path), EngineConfig(min_score=0.0, lexical_postings=0, lexical_tokens=0, lexical_global_tokens=0))
    e.ingest(incoming(spark, ("s", "c", "a.txt", text, 0), ("t", "c", "b.txt", b"w00007 elsewhere", 0)))
    every = e.postings.where("session_id = 's'").count()
    assert every >= 40_000
    asked = spark.createDataFrame([(1, "w00007 w00009")], "query_id int, text string")
    files, postings = e.store.of_sessions(["s"], "files", "postings")
    n, total, _ = e._lexical_sizes(files, "s")
    lex = e._lexical(asked, postings, n, total)
    hit = lex.collect()
    best, want = {r.chunk_index for r in hit if r["rank"] == 1}, {r.chunk_index for r in e.chunks.where("session_id = 's' and text like '%w00007%'").collect()}
    assert hit and best <= want and len(hit) == len({r.chunk_index for r in hit})
    assert "chunks/v=" not in lex._jdf.queryExecution().executedPlan().toString()
    cut = of_tokens(postings, ["w00007", "w39990"])
    assert {r.token for r in cut.collect()} == {"w00007", "w39990"}
    plan = cut._jdf.queryExecution().executedPlan()
    assert "PushedFilters: [Or(" in plan.toString()
    leaves = plan.collectLeaves()
    read = sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
    assert 0 < read < every / 2


def test_stored_index_agrees_with_texts(spark, tmp_path):
    """BM25 from stored postings is BM25 over the texts."""
    rows = [("s", "c", f"{i}.txt", f"apples {'pears ' * (i % 4)} and plum{i % 3} trees number {i}".encode(), i) for i in range(12)]
    e = Engine(spark, str(tmp_path), EngineConfig(min_score=0.0, min_ratio=0.0))
    e.ingest(incoming(spark, *rows))
    asked = spark.createDataFrame([(1, "pears plum1"), (2, "trees number 7 7"), (3, "nothing here")], "query_id int, text string")
    keys = ["session_id", "conversation_id", "file_name", "chunk_index"]
    want = {(r.query_id, r.file_name): (round(r.score, 9), r["rank"]) for r in retrieve.bm25(e.chunks, keys, asked, 20).collect()}
    files, postings = e.store.of_sessions(["s"], "files", "postings")
    n, total, allowed = e._lexical_sizes(files, "s")
    got = {(r.query_id, r.file_name): (round(r.score, 9), r["rank"]) for r in e._lexical(asked, postings, n, total).collect()}
    assert allowed and got == want and len(got) > 12 and os.path.isdir(tmp_path / "commits")
