"""What waits: files whose model did not answer, summaries and their claims, and what is given when nothing is found."""

import datetime as dt
import os

import pytest

from docquery.config import EngineConfig
from docquery.operators import index
from docquery.operators.store import Taken
from docquery.plans.engine import Engine

T0 = dt.datetime(2026, 1, 1, 12)
SCHEMA = "session_id string, conversation_id string, file_name string, content binary, upload_time timestamp"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def incoming(spark, *rows):
    return spark.createDataFrame([(s, c, n, bytearray(b), at(m)) for s, c, n, b, m in rows], SCHEMA)


def moody(flag):
    """A model that fails on texts with `pears` while the flag's file is there."""

    def model(texts):
        if os.path.exists(flag) and any("pears" in x for x in texts):
            raise RuntimeError("no answer")
        return index.character_histogram(texts)

    return model


def test_bundles(spark, tmp_path):
    """Files wait with their text, are tried when due, also by an engine opened later, and enter the store or are given up."""
    flag, path = tmp_path / "flag", str(tmp_path / "store")
    flag.write_text("")
    c = EngineConfig(chunk_size=40, chunk_overlap=5, min_score=0.0, retry_first_seconds=30, retry_minutes=2, retry_max=3, retry_disk_bytes=60, embed_batch=1)
    e = Engine(spark, path, c, moody(flag))
    refused = e.ingest(incoming(spark, ("s", None, "p.txt", b"apples and pears are fruit, all of them", 0), ("s", None, "c.txt", b"cars and lorries", 0), ("t", "c", "q.txt", b"pears again, too many for the room left", 1)))
    assert {r.file_name: r.error for r in refused.collect()} == {"p.txt": "embed_queued", "q.txt": "retry_disk_full"}
    assert {r.file_name for r in e.files.collect()} == {"c.txt"} and {(r.file_name, r.attempts, r.n_bytes) for r in e.bundles.collect()} == {("p.txt", 0, 39)}
    assert {r.reply for r in e.replies(refused).collect()}.isdisjoint({"embed_queued", "retry_disk_full"})
    assert [(r.session_id, r.listed, r.waited) for r in e.waiting(at(1)).collect()] == [("s", "《p.txt》", "60 秒")]
    assert e.retry(T0).count() == 0  # not due
    assert [r.outcome for r in e.retry(at(1)).collect()] == ["waiting"] and e.retry(at(2)).count() == 0
    later = Engine(spark, path, c, moody(flag))
    flag.unlink()
    assert [(r.session_id, r.outcome) for r in later.retry(at(4)).collect()] == [("s", "stored")]
    assert later.bundles.count() == 0 and later.errors.where("session_id = 's'").count() == 0
    asked = spark.createDataFrame([(1, "pears")], "query_id int, text string")
    assert later.search(asked, "s").where("rank = 1").first().file_name == "p.txt"
    flag.write_text("")
    later.ingest(incoming(spark, ("s", None, "z.txt", b"more pears", 10)))
    later.ingest(incoming(spark, ("s", None, "z.txt", b"other pears", 11)))  # only the newest waits
    assert [r.text for r in later.bundles.collect()] == ["other pears"]
    outcomes = [later.retry(at(m)).first().outcome for m in (12, 15, 18)]
    assert outcomes == ["waiting", "waiting", "embed_failed"] and later.bundles.count() == 0
    assert {(r.file_name, r.error) for r in later.errors.where("session_id = 's'").collect()} == {("z.txt", "embed_failed")}


def test_summaries(spark, tmp_path):
    """One worker a file, claims that expire, cooldowns after failures, and summaries as heads of what is found."""
    flag = tmp_path / "flag"
    c = EngineConfig(chunk_size=40, chunk_overlap=5, min_score=0.0, direct_limit=10, summary_claim_seconds=60, summary_retry_seconds=120, memo_seconds=0)
    one = Engine(spark, str(tmp_path / "store"), c, moody(flag))
    two = Engine(spark, str(tmp_path / "store"), c, moody(flag))
    one.ingest(incoming(spark, ("s", None, "p.txt", b"apples and pears are fruit, all of them", 0)))
    names = lambda df: [r.file_name for r in df.collect()]
    assert names(one.claim_summaries("w1", at(1))) == ["p.txt"] and names(two.claim_summaries("w2", at(1.5))) == []
    assert names(two.claim_summaries("w2", at(3))) == ["p.txt"]  # the first claim is too old
    made = lambda text: spark.createDataFrame([("s", None, "p.txt", text)], "session_id string, conversation_id string, file_name string, summary string")
    one.store_summaries(made("too late"), "w1", at(3))
    assert one.summaries.where("state = 'done'").count() == 0
    two.store_summaries(made(" "), "w2", at(3))
    assert names(one.claim_summaries("w1", at(4))) == [] and names(one.claim_summaries("w1", at(6))) == ["p.txt"]
    one.store_summaries(made("about fruit"), "w1", at(6))
    assert names(two.claim_summaries("w2", at(99))) == []

    asked = spark.createDataFrame([(1, "pears fruit")], "query_id int, text string")
    found = two.context(asked, "s").first()
    assert found["mode"] == "retrieved" and found["context"].startswith("《p.txt》概要：\nabout fruit\n《p.txt》\n")
    strict = two.with_settings(min_score=2.0, hybrid=False)
    assert strict.context(asked, "s").count() == 0  # nothing found gives nothing
    flag.write_text("")
    assert two.context(asked, "s").first()["mode"] == "retrieved"  # the index answers
    blind = strict.context(asked, "s")
    assert [(r["mode"], r["context"]) for r in blind.collect()] == [("summary", "《p.txt》概要：\nabout fruit")]
    item = strict.items(blind).first()
    assert item.kind == "summary" and item.item_id.startswith("docquery:summary:")
    given = strict.items(blind).select("query_id", "item_id", "text")
    assert strict.context(asked, "s", injected=given).count() == 0
    one.ingest(incoming(spark, ("s", None, "p.txt", b"plums instead, which are fruit as well", 9)))
    assert names(one.claim_summaries("w1", at(100))) == ["p.txt"]  # other bytes need another summary


def test_claims_at_once(spark, tmp_path, monkeypatch):
    """Two workers that saw the same state: one commit is made, the loser finds the claim."""
    c = EngineConfig(direct_limit=10)
    one, two = (Engine(spark, str(tmp_path), c) for _ in range(2))
    one.ingest(incoming(spark, ("s", "c", "p.txt", b"apples and pears are fruit", 0)))
    seen = two.store.next_number()
    assert one.claim_summaries("w1", at(1)).count() == 1
    numbers = [seen]
    real = two.store.next_number
    monkeypatch.setattr(two.store, "next_number", lambda: numbers.pop() if numbers else real())
    assert two.claim_summaries("w2", at(1)).count() == 0
    assert [r.worker for r in one.summaries.collect()] == ["w1"]
    with pytest.raises(Taken):
        two.store.replace(spark.createDataFrame([("s",)], "session_id string"), {}, seen)


def test_groups(spark, tmp_path):
    rows = spark.createDataFrame([(1, '{"message_info": {"group_id": 7}}'), (2, '{"session_id": "s", "message_info": {}}'), (3, None), (4, "no json")], "k int, body string")
    e = Engine(spark, str(tmp_path), EngineConfig(enable_group=False))
    assert sorted((r.k, r.session_id) for r in e.wanted(rows).collect()) == [(2, "s"), (3, ""), (4, "")] and e.with_settings(enable_group=True).wanted(rows).count() == 4
    assert e.with_settings(top_k=3).config.top_k == 3
