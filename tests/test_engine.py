"""The engine on a small store, and keyed state on small events."""

import datetime as dt
import random

from pyspark.sql import functions as F

from docquery.config import EngineConfig
from docquery.operators import session, state
from docquery.plans.engine import Engine
from docquery.sources import files

T0 = dt.datetime(2026, 1, 1, 12)
SCHEMA = "session_id string, conversation_id string, file_name string, content binary, upload_time timestamp"


def incoming(spark, *rows):
    return spark.createDataFrame([(s, "c", n, bytearray(b), T0 + dt.timedelta(minutes=m)) for s, n, b, m in rows], SCHEMA)


def test_store(spark, tmp_path):
    e = Engine(spark, str(tmp_path), EngineConfig(chunk_size=60, chunk_overlap=10, direct_limit=150, min_score=0.0))
    fruit, cars = b"apples and pears are fruit. " * 5, b"cars and lorries drive on roads. " * 5
    refused = e.ingest(incoming(spark, ("s", "fruit.txt", fruit, 0), ("s", "cars.txt", cars, 0), ("s", "x.rtf", b"{\\rtf1", 0), ("t", "note.txt", b"short note", 0)))
    assert [r.file_name for r in refused.collect()] == ["x.rtf"]
    asked = spark.createDataFrame([(1, "pears fruit"), (2, "lorries")], "query_id int, text string")
    best = {r.query_id: r.file_name for r in e.search(asked, "s").where("rank = 1").collect()}
    assert best == {1: "fruit.txt", 2: "cars.txt"}
    assert {r.mode for r in e.context(asked, "s").collect()} == {"retrieved"} and {r.mode for r in e.context(asked, "t").collect()} == {"direct"}
    assert {r.session_id: r.n_files for r in e.announce().collect()} == {"s": 2, "t": 1}

    e.ingest(incoming(spark, ("s", "fruit.txt", b"now about stars", 10), ("s", "again.txt", cars, 30)))  # replaced; equal bytes only touch
    names = {r.file_name: r for r in e.files.where("session_id = 's'").collect()}
    assert names.keys() == {"fruit.txt", "cars.txt"} and names["fruit.txt"].text == "now about stars"
    assert names["cars.txt"].last_used == T0 + dt.timedelta(minutes=30)
    e.touch(e.files.where("file_name = 'fruit.txt'"), T0 + dt.timedelta(minutes=80))
    gone = e.expire(T0 + dt.timedelta(minutes=85))
    assert {r.file_name: r.expiry for r in gone.collect()} == {"note.txt": "idle"}
    e.clear(spark.createDataFrame([("s",)], "session_id string"))
    assert e.files.count() == e.chunks.count() == e.vectors.count() == 0
    assert [r.files for r in e.status().where("level = 3").collect()] in ([], [None], [0])


def test_greedy_window_is_not_sliding(spark):
    rows = [(k, i, T0 + dt.timedelta(seconds=s)) for k in "ab" for i, s in enumerate((0, 6, 10, 12, 19, 20, 100))]
    df = spark.createDataFrame(rows, "k string, id int, ts timestamp")
    for most in (2000, 1):  # folded, and by slices
        got = sorted((r.k, r.id) for r in state.greedy_window(df, ["k"], "ts", 10, "id", most).collect())
        assert got == [(k, i) for k in "ab" for i in (0, 2, 5, 6)]


def accepted(rows, apart):
    last, out = {}, set()
    for k, i, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1])):
        if k not in last or (t - last[k]).total_seconds() >= apart:
            last[k] = t
            out.add((k, i))
    return out


def test_a_hot_key_goes_by_slices(spark):
    """One key has most events, close together over many slices; another is null; some have no time."""
    rng = random.Random(1)
    hot = [("hot", i, T0 + dt.timedelta(seconds=rng.uniform(0, 9000))) for i in range(3000)]
    rest = [(rng.choice(["a", "b", None]), 5000 + i, T0 + dt.timedelta(seconds=rng.uniform(0, 900))) for i in range(300)]
    dense = [("dense", 7000 + i, T0 + dt.timedelta(seconds=i)) for i in range(2000)]  # entries that never meet
    rows = [*hot, *rest, *dense, ("a", 9000, None)]
    df = spark.createDataFrame(rows, "k string, id int, ts timestamp")
    for apart in (10, 37):
        for most in (2000, 100):
            got = {(r.k, r.id) for r in state.greedy_window(df, ["k"], "ts", apart, "id", most).collect()}
            assert got == accepted(rows, apart)
    hits = {r.id: r.hit for r in state.memo(df.where("ts is not null"), ["k"], "ts", 10, "id").collect()}
    assert len(hits) == len(rows) - 1 and not hits[min((r for r in rest if r[0] is None), key=lambda r: r[2])[1]]


def test_null_keys_are_keys(spark):
    held = spark.createDataFrame([(None, "c", "a", b"x", 1), (None, "c", "b", b"x", 2), ("s", "c", "a", None, 3), ("s", "c", "b", None, 4), ("s", None, "d", b"y", 5)], "session_id string, conversation_id string, file_name string, content binary, total_chars int")
    got = {(r.session_id, r.file_name): r.reused for r in state.content_dedup(held, ["session_id"], F.col("content"), ["file_name"]).collect()}
    assert got == {(None, "a"): False, (None, "b"): True, ("s", "a"): False, ("s", "b"): False, ("s", "d"): False}
    assert {(r.session_id, r.n_files, r.listed) for r in session.announced(held, ["session_id"]).collect()} == {(None, 2, "《a》、《b》"), ("s", 3, "《a》、《b》、《d》")}
    first = session.first_conversation(held, created="total_chars").collect()
    assert sorted(r.total_chars for r in first) == [1, 2, 3, 4]


def test_keys_of_several_rows(spark):
    records = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    twice = spark.createDataFrame([(1, b"b"), (1, b"a"), (2, None)], "k int, content binary")
    last = spark.createDataFrame([(2, b"z"), (2, b"z")], "k int, content binary")
    got = {r.k: (bytes(r.content) if r.content is not None else None, r.channel) for r in files.acquired(records, "k", twice, last).collect()}
    assert got == {1: (b"a", 0), 2: (b"z", 1), 3: (None, None)} and files.acquired(records, "k", twice, last).count() == 3


def replayed(rows, capacity, life):
    caches, hits = {}, {}
    for k, i, item, t in sorted(rows, key=lambda r: (r[3] is None, r[3] or T0, r[1])):
        cache = caches.setdefault(k, {})
        t = t or dt.datetime(9000, 1, 1)
        hits[i] = item in cache and (life is None or (t - cache[item]).total_seconds() <= life)
        if not hits[i]:
            cache.pop(item, None)
            if len(cache) >= capacity:
                del cache[next(iter(cache))]
            cache[item] = t
    return hits


def test_bounded_caches(spark):
    """A key of half of all requests over many slices, with evictions and lifetimes, equals the plain replay; null keys, items and times count."""
    rng = random.Random(8)
    draw = lambda n: int(n * rng.random() ** 2)
    rows = [(rng.choice(["hot", "hot", "a", None]), i, rng.choice([f"x{draw(40)}", f"x{draw(90)}", None]), T0 + dt.timedelta(seconds=rng.randint(0, 4000))) for i in range(1500)]
    rows += [("late", 5000 + i, f"x{i % 3}", None) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, id int, item string, ts timestamp")
    for capacity, life, each in ((12, None, 100), (3, 30, 64), (500, 600, 10_000)):
        got = {r.id: r.hit for r in state.bounded_cache(df, ["k"], ["item"], "ts", "id", capacity, life, each).collect()}
        assert got == replayed(rows, capacity, life)
    one = {r.id: r.hit for r in state.bounded_cache(df, [], ["k", "item"], "ts", "id", 20, 900, 150).collect()}
    assert one == replayed([(0, i, (k, x), t) for k, i, x, t in rows], 20, 900)
    assert state.bounded_cache(df.where("false"), ["k"], ["item"], "ts", "id", 3).count() == 0


def test_quota_and_spells_of_one_day(spark):
    rows = [(i, T0 + dt.timedelta(seconds=37 * i % 5000)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, ts timestamp")
    want = {r[0]: n + 1 for n, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r.id: r.place for r in state.daily_quota(df, "ts", "id", 20).collect()} == want
    times = sorted(r[1] for r in rows)
    spells = 1 + sum((b - a).total_seconds() > 12 for a, b in zip(times, times[1:]))
    got = state.activity(df.withColumn("k", F.lit(None).cast("string")), ["k"], "ts", 12).collect()
    assert len(got) == spells and sum(r.touches for r in got) == 400


def test_rejected_files_take_no_room(spark):
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate((5, 6, 4, 2, 1))], "s string, i int, n long")
    got = {r.i: r.admitted for r in state.budget_admission(df, "s", ["i"], "n", 10).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True}


def test_budget_in_rounds(spark, monkeypatch):
    """Rounds, and the fold at their end, admit what a plain loop admits."""
    rng = random.Random(2)
    rows = [(rng.choice(["s", "s", "s", "t", None]), i, rng.choice([0, 1, 3, 9, 40, 90, 400])) for i in range(900)]
    want, left = {}, {}
    for s, i, n in rows:
        fits = n <= left.setdefault(s, 1000)
        left[s] -= n * fits
        want[i] = fits
    df = spark.createDataFrame(rows, "s string, i int, n long")
    for most in (2000, 20):
        monkeypatch.setattr(state, "MOST_FOLDED", most)
        got = state.budget_admission(df, "s", ["i"], "n", 1000, slot=F.floor(F.col("i") / 50)).collect()
        assert {r.i: r.admitted for r in got} == want and len(got) == len(rows)


def test_boundaries(spark):
    at = lambda *s: spark.createDataFrame([(1, T0 + dt.timedelta(seconds=x)) for x in s], "k int, ts timestamp")
    assert state.activity(at(0, 60, 121), ["k"], "ts", 60).count() == 2  # a gap of exactly the limit stays inside
    aged = spark.createDataFrame([(T0, None, 0), (T0, T0 + dt.timedelta(seconds=5), 3)], "upload_time timestamp, last_used timestamp, rounds int")
    got = state.expired(aged, F.lit(T0 + dt.timedelta(seconds=10)), retention=10, max_rounds=3).orderBy("rounds").collect()
    assert [r.expiry for r in got] == [None, "rounds"]


def test_settings_act(spark, tmp_path):
    """Limits, budgets, memo, rounds, notices, retries, links, media and questions follow the configuration."""
    at = lambda m: T0 + dt.timedelta(minutes=m)
    text = b"apples and pears are fruit. " * 20
    files_in = incoming(spark, ("s", "a.txt", text, 0), ("s", "b.txt", text + b"more", 1), ("s", "c.txt", b"small", 2), ("s", "long.txt", b"x" * 3000, 3))
    e = Engine(spark, str(tmp_path / "1"), EngineConfig(chunk_size=60, chunk_overlap=10, direct_limit=100, min_score=0.0, data_budget_bytes=700, text_chars=2000))
    assert {r.file_name: r.error.split(" ")[0] for r in e.ingest(files_in).collect()} == {"b.txt": "data_budget", "long.txt": "3000"}
    assert {(r.file_name, r.attempt) for r in e.due_retries(at(6)).collect()} == {("b.txt", 3)}
    assert {r.file_name for r in e.failures(at(5)).collect()} == {"b.txt", "long.txt"} and {r.file_name for r in e.failures(at(5)).collect()} == {"b.txt"}
    assert e.failures(at(50)).count() == 0

    asked = spark.createDataFrame([(1, "pears fruit")], "query_id int, text string")
    first = e.context(asked, "s", now=at(5)).first().context
    searched, e._context = e._context, None
    assert e.context(asked, "s", now=at(6)).first().context == first  # from the memo
    e._context = searched
    assert e.memo.count() == 1 and e.context(asked, "s", now=at(9)).first().context == first and e.memo.count() == 1
    e.ingest(incoming(spark, ("s", "d.txt", b"tiny", 10)))
    assert e.memo.count() == 0
    given = spark.createDataFrame([(1, "docquery:doc:1", "x")], "query_id int, item_id string, text string")
    assert e.context(asked, "s", injected=given).count() == 0

    used = e.files.where("file_name = 'a.txt'").select("session_id", "conversation_id", "file_name", F.lit("q").alias("query_key"))
    for minute, rounds in ((20, 1), (21, 1), (23, 2)):
        e.touch(used, at(minute))
        assert e.files.where("file_name = 'a.txt'").first().rounds == rounds
    assert [r.sample for r in e.summary_inputs().where("file_name = 'c.txt'").collect()] == ["small"]

    lexical = {r.source for r in e.search(asked, "s").collect()}
    poor = Engine(spark, str(tmp_path / "2"), EngineConfig(chunk_size=60, chunk_overlap=10, min_score=0.0, lexical_tokens=5))
    poor.ingest(files_in)
    assert "both" in lexical and {r.source for r in poor.search(asked, "s").collect()} == {"vector"}

    turns = spark.createDataFrame([(1, 1, "user", "what does the report say about apples"), (1, 2, "user", "它呢")], "conv_id int, turn int, role string, text string")
    plain = Engine(spark, str(tmp_path / "3"), EngineConfig(rewrite_queries=False, download_policy="off", dedup_seconds=60, video_per_day=1))
    assert e.questions(turns).first().text.endswith("apples 它呢") and plain.questions(turns).first().text == "它呢"
    links = spark.createDataFrame([("https://elsewhere.example/x",)], "url string")
    assert e.checked_links(links).first().reply == "the link's host is not allowed" and plain.checked_links(links).first().reason is None
    events = spark.createDataFrame([("s", "f", i, T0 + dt.timedelta(seconds=20 * i)) for i in range(4)], "session_id string, ident string, event_id int, ts timestamp")
    assert e.accepted(events).count() == 4 and plain.accepted(events).count() == 2
    mp4 = bytes.fromhex("00000010") + b"ftypisom" + bytes(4) + bytes.fromhex("00000024") + b"moov" + bytes.fromhex("0000001c") + b"mvhd" + bytes(12) + (600).to_bytes(4, "big") + (6000).to_bytes(4, "big")
    clips = incoming(spark, ("s", "a.mp4", mp4, 0), ("s", "b.mp4", mp4, 1), ("s", "c.mp4", b"", 2), ("s", "d.txt", b"x", 3))
    assert {r.file_name: (r.seconds, r.reason) for r in plain.checked_media(clips).collect()} == {"a.mp4": (10.0, None), "b.mp4": (10.0, "quota"), "c.mp4": (None, "empty")}


def test_retries_survive_a_restart(spark, tmp_path):
    """Half of the events, a restart from the checkpoint, and the other half give the attempts of all: waits and their timers are in the state."""
    from docquery.streaming import stateful

    rng = random.Random(4)
    times = sorted(rng.uniform(0, 40_000) for _ in range(60))
    rows = [(i, rng.choice(["a", "b", None]), T0 + dt.timedelta(seconds=t), rng.random() < 0.7) for i, t in enumerate(times)]
    rows += [(100, "end", T0 + dt.timedelta(seconds=60_000), False)]
    want, last = set(), {}
    for i, k, t, bad in [*rows, *((1000, k, T0 + dt.timedelta(seconds=60_000 - 600), False) for k in ("a", "b", None))]:
        if k in last:
            want |= {(k, a, last[k] + dt.timedelta(seconds=30 + 600 * (a - 1))) for a in range(1, 5) if last[k] + dt.timedelta(seconds=30 + 600 * (a - 1)) < t}
        last[k] = t
        if not bad:
            last.pop(k)
    schema = "event_id int, k string, ts timestamp, failed boolean"
    got = []
    for part in (rows[:31], rows[31:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stateful.retry_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k", "ts", "event_id", "failed", every=600, most=4)
        got.append({(r.k, r.attempt, r.due) for r in stateful.replay(stream, str(tmp_path / "state"), str(tmp_path / "out")).collect()})
    assert got[1] == want and got[0] < want and len(want) > 40
