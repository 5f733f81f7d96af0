"""The ten operators against brute force, libraries and round trips, with odd inputs."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from against import SF, agree
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquery.llm import bpe_count, common, langid, matroska, mixing, packing, quality, queries, secrets, sharding, simhash, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [None, "", " ", "\n\n", "one", "one two three", "one two three", "x" * 50_000, "héé ß 日本語 😀", "\x00\x1c odd\x85", "a b\tc\nd"]


def odd_rows():
    return [*enumerate(ODD), (3, "\n\n"), (None, "one"), (None, None), (None, "two words")]


def empty(docs):
    return docs.where("false")


# -- 1 ---------------------------------------------------------------------------------------------


def test_mix_against_sql(spark):
    agree(queries.op1_mix_sources(spark, SF), queries.OP1_SQL)


def test_mix_targets_and_limits(spark, docs_of):
    rng = random.Random(1)
    docs = docs_of([(i, "w " * rng.randint(0, 60), s) for i, s in enumerate(rng.choices(["a", "b", "c", None], (60, 20, 15, 5), k=400))])
    got = mixing.mix(docs).collect()
    total = sum(r.size for r in got)
    by = defaultdict(list)
    for r in got:
        assert r.size == len(WORD.findall("w " * r.size)) and r.taken <= 2 * r.size
        by[r.source].append(r)
    assert sum(v[0].target for v in by.values()) == pytest.approx(1.5 * total)
    for rows in by.values():
        assert rows[0].target <= 2 * rows[0].source_size == 2 * sum(r.size for r in rows)
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows)
    assert sorted(map(repr, mixing.mix(docs.repartition(7)).collect())) == sorted(map(repr, got))
    again = mixing.mixed_rows(docs)
    assert again.columns == docs.columns
    copies = Counter(r.doc_id for r in again.collect())
    assert copies == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_mix_odd(docs_of):
    docs = docs_of(odd_rows())
    assert mixing.mix(docs).count() == docs.count()
    assert mixing.mix(empty(docs)).count() == 0 == mixing.mixed_rows(empty(docs)).count()
    weights = docs.select("source").distinct().withColumn("weight", F.lit(0.0))
    assert mixing.mix(docs, weights).where("taken > 0").count() == 0


# -- 2 ---------------------------------------------------------------------------------------------


def test_every_word_decodes_within_three_bits():
    words = np.random.default_rng(1).integers(0, 1 << 23, 5000)
    errors = simhash._ERRORS[simhash._remainder(words)]
    assert (np.bitwise_count(errors) <= 3).all() and (simhash._remainder(words ^ errors) == 0).all()
    own, near = simhash.golay_index(words), simhash.golay_index(words[:, None] ^ simhash._BALL)
    assert {len(set(r)) for r in near.tolist()} == {1, 6} and (near[:, 0] == own).all()


def brute_components(pairs):
    """(id, fingerprint) -> smallest id reachable."""
    root = {f: f for _, f in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(list(root), 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    least = {}
    for i, f in pairs:
        least[find(f)] = min(least.get(find(f), i), i)
    return {(i, f): least[find(f)] for i, f in pairs}


@pytest.mark.parametrize("limit", [0, 64, 10**9])
def test_links_are_complete(spark, monkeypatch, limit):
    """Random fingerprints, chains and clouds, by pairs and by the way without pairs."""
    monkeypatch.setattr(simhash, "MOST_PAIRS", limit)
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:30]:
        for _ in range(8):  # chains
            f ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(f)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)} | {0, 1, 3}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in common.connected_components(simhash.links(nodes)).collect()}
    want = brute_components([(f, f & (1 << 64) - 1) for f in signed])
    for f in signed:
        assert roots.get(f, f) == want[f, f & (1 << 64) - 1]


def plain_simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op2_simhash(spark, SF).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == {i: plain_simhash(t) for i, t in texts.items()}
    want = brute_components([(r.doc_id, int(r.fingerprint, 16)) for r in rows])
    assert all(want[r.doc_id, int(r.fingerprint, 16)] == r.component_id for r in rows)


def test_simhash_odd(docs_of):
    docs = docs_of(odd_rows())
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[0].fp == by[1].fp == by[3].fp == 0 and by[3].component_id == 0 and by[6].component_id == 5
    assert [r.component_id for r in rows if r.doc_id is None].count(4) == 1  # the text of document 4
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(repr(r.text) for r in kept.collect()) == sorted(map(repr, {(t or "").strip() and t for _, t in odd_rows()} - {""} | {None}))
    assert simhash.near_duplicates(empty(docs)).count() == 0 == simhash.drop_near_duplicates(empty(docs)).count()


# -- 3 ---------------------------------------------------------------------------------------------


def _library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="ab1 \n\t'sdré́É²½ßÀ×÷<|>endoftx 　日Σ\x1c\x85.,!", max_size=80)))
def test_token_counts(text):
    assert bpe_count.counter(public_tokenizers.path("word_bpe_49k.json"))(text) == len(_WORDS.encode(text, add_special_tokens=False).ids)


_WORDS = _library("word_bpe_49k.json")


def test_token_counts_in_spark(spark, docs_of):
    texts = [t for t in ODD if t] + ["a<|endoftext|>b <|startoftext|> I'm", "antidisestablishmentarianism " * 3]
    docs = docs_of([*enumerate([None, "", *texts])])
    got = bpe_count.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), limit=5).collect()
    want = [0, 0, *(len(_WORDS.encode(t, add_special_tokens=False).ids) for t in texts)]
    assert [r.n_tokens for r in sorted(got)] == want and [r.n_bytes for r in sorted(got)] == [0, 0, *(len(t.encode()) for t in texts)]
    assert all(r.over_limit == (r.n_tokens > 5) for r in got)
    some = spark.read.parquet(f"{SF}/documents.parquet")
    counts = {r.doc_id: r.n_tokens for r in queries.op3_token_counts(spark, SF).collect()}
    assert counts == {r.doc_id: len(_WORDS.encode(r.text, add_special_tokens=False).ids) for r in some.collect()}


# -- 4 ---------------------------------------------------------------------------------------------


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n#|\t\x1c\x85日", max_size=60))
def test_measures(text):
    n_words, chars, symbols, _, dup, repeats, _ = quality.measure_text(text)
    assert (n_words, chars, symbols, dup, repeats) == plain_measures(text)


def test_sketch_merges_and_bounds(spark):
    values = [int(10 ** random.Random(i).uniform(0, 6)) for i in range(3000)]
    rows = spark.createDataFrame([("ab"[i % 2], "s", v) for i, v in enumerate(values)], "lang string, source string, symbols long")
    rows = rows.selectExpr("lang", "source", "symbols", *(f"0L as {m}" for m in quality.MEASURES if m != "symbols"))
    whole = quality.merge(quality.sketches(rows)).where("measure = 'symbols'")
    parts = quality.sketches(rows.where("lang = 'a'")).unionByName(quality.sketches(rows.where("lang = 'b'")))
    assert sorted(quality.merge(parts).where("measure = 'symbols'").collect()) == sorted(whole.collect())
    q = quality.quartiles(whole).first()
    for got, part in ((q.q1, 0.25), (q.q3, 0.75)):
        true = sorted(values)[int(part * len(values)) - 1]
        assert true * (1 - 1 / 16) <= got <= true * (1 + 1 / 16)


def test_quality_verdicts(spark, docs_of):
    rng = random.Random(3)
    clean = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(n))
    rows = [(i, clean(rng.randint(60, 200)), f"s{i % 3}") for i in range(300)]
    noisy = [(1000, clean(90).replace(" ", "%%% "), "s0"), (1001, clean(90).upper(), "s1"), (1002, "short", "s1"), (1003, "same old words " * 40, "s2"), (1004, None, None)]
    got = {r.doc_id: r for r in quality.judge(docs_of(rows + noisy)).collect()}
    assert all(got[i].kept for i in range(300)) and not any(got[i].kept for i in range(1000, 1005))
    assert "symbols" in got[1000].failed and "capitals" in got[1001].failed and got[1002].base_failed and got[1003].base_failed
    odd = quality.judge(docs_of(odd_rows()))
    assert odd.count() == len(odd_rows()) and quality.judge(empty(docs_of(odd_rows()))).count() == 0
    for r in queries.op4_quality(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").limit(40).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_measures(r.text)


def test_quality_against_sql(spark):
    agree(queries.op4_quality(spark, SF), queries.OP4_SQL)
    agree(queries.op4_quality(spark, SF.replace("0.001", "0.01")), queries.OP4_SQL, SF.replace("0.001", "0.01"))


def test_thresholds_follow_their_group(docs_of):
    """The same text is kept where its group writes like it, and fails where the group does not."""
    rng = random.Random(8)

    def text(share):
        words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(100)]
        return " ".join(w.upper() if i < share else w for i, w in enumerate(words))

    plain = [(i, text(rng.randint(8, 10)), "plain") for i in range(100)]
    loud = [(200 + i, text(rng.randint(40, 50)), "loud") for i in range(100)]
    few = [(400 + i, text(45), "few") for i in range(5)]  # too few for a sketch of their own
    got = {r.doc_id: r for r in quality.judge(docs_of([*plain, *loud, *few, (500, text(45), "plain"), (501, text(45), "loud")])).collect()}
    assert "capitals" in got[500].failed and got[501].kept
    assert all(r.kept for i, r in got.items() if i < 400)
    hi = {r.source: r.hi_capitals for r in got.values()}
    assert hi["loud"] > 2 * hi["plain"] and hi["few"] not in (hi["loud"], hi["plain"])


def test_thresholds_differ_by_group(spark):
    """Over the tables most thresholds come from the groups' own spread, not from the least ratio of one bucket."""
    rows = quality.judge(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet"))
    limits = rows.select("lang", "source", *(f"hi_{m}" for m in quality.MEASURES), *(f"lo_{m}" for m in quality.MEASURES)).distinct().collect()
    narrow = total = 0
    for m, (reach, _) in quality.MEASURES.items():
        # hi / lo is ratio ** (2 * reach + 1), or more where the least ratio took the place of a smaller one
        least = quality.LEAST_RATIO ** (2 * reach + 1)
        narrow += sum(r[f"hi_{m}"] / r[f"lo_{m}"] <= least * 1.001 for r in limits)
        total += len(limits)
        assert len({r[f"hi_{m}"] for r in limits}) > 2
    assert narrow < total / 4


# -- 5 ---------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op5_toxicity(spark, sf).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.9


def test_toxicity_odd(spark, docs_of):
    docs = docs_of(odd_rows())
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_documents(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    texts = [f"word{i % 7} " * 20 + ("vile" if i % 2 else "kind") for i in range(60)]
    model = toxicity.train(texts, [i % 2 for i in range(60)], ["en"] * 60, weights=(1, 1))
    scores = [r.score for r in toxicity.score_documents(docs, model).orderBy("doc_id").collect()]
    assert len(scores) == len(odd_rows()) and all(0 <= s <= 1 for s in scores)
    assert toxicity.score_documents(empty(docs), model).count() == 0
    seen = toxicity.Scorer(model)(["such a vile thing", "such a kind thing", "vile", ""])
    assert seen[0] > seen[1] and seen[2] > 0.5 > seen[3]


def test_toxicity_learns_from_long_and_repeated_rows(spark, docs_of):
    """Rows are drawn whatever their length; of several texts of one id the same one counts in any order."""
    long = lambda word, i: f"{word} " * 9 + f"filler{i} " * 9000
    rows = [(i, long("vile" if i % 2 else "kind", i % 5)) for i in range(40)] + [(1, "another text"), (1, "a third")] * 3
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(rows), labels, folds=1, held_out=9)
    again = toxicity.fit(docs_of(rows[::-1]).repartition(3), labels, folds=1, held_out=9)
    texts = ["vile", "kind", "another text"]
    assert not model.empty and (toxicity.Scorer(model)(texts) == toxicity.Scorer(again)(texts)).all()
    seen = toxicity.Scorer(model)(texts)
    assert seen[0] > seen[1]


def plain_score(model, text):
    """The model's score in plain Python: every filter at every place, its maximum, the logistic layer, the language's threshold."""
    words = [p for w in (text or "").split() for p in (re.findall(r"[^\W\d_]{1,20}", w) if len(w) > 40 else [w])]
    features = [toxicity.word_features(w) for w in words]
    embedded = [model.embed[f].sum(axis=0) for f in features] + [np.zeros(toxicity.DIMENSIONS)] * (len(toxicity.WIDTHS) - 1)
    hidden = []
    for width, conv in zip(toxicity.WIDTHS, model.conv):
        at = range(len(embedded))
        hidden += [max(sum(embedded[i + o] @ conv[o][:, f] for o in range(width) if i + o < len(embedded)) for i in at) for f in range(toxicity.FILTERS)]
    hidden = [h + b for h, b in zip(hidden, model.bias)]
    logit = sum((h if h > 0 else toxicity.LEAK * h) * o for h, o in zip(hidden, model.out)) + model.base
    fit = sum((model.lang_fit[f[0] % toxicity._LANG_BUCKETS] for f in features), np.zeros(len(model.langs)))
    return 1 / (1 + np.exp(-(logit - model.shift[int(np.argmax(fit))])))


def test_scores_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    known = [r for r in docs if r.doc_id in labels]
    model = toxicity.train([r.text for r in known], [labels[r.doc_id] for r in known], [r.lang for r in known], weights=(1, 1))
    texts = [r.text for r in docs][:30] + ["", "one", "日本語" * 200]
    assert np.allclose(toxicity.Scorer(model)(texts), [plain_score(model, t) for t in texts], atol=1e-4)


def test_ids_are_drawn_by_least_hash(spark):
    rows = [(g, i) for g, n in (("a", 3000), ("b", 40), (None, 9)) for i in range(n)] + [("a", 5)] * 5000
    df = spark.createDataFrame(rows, "g string, i long")
    hashed = {r.i: r.h for r in df.select("i", common.unit_hash(3, F.col("i")).alias("h")).distinct().collect()}
    for part in (df, df.repartition(9)):
        got = common.sample_per_group(part, "g", "i", 50, 3).collect()
        want = {("a", i) for i in sorted(range(3000), key=hashed.get)[:50]} | {("b", i) for i in range(40)}
        assert len(got) == 90 and {(r.g, r.i) for r in got} == want


# -- 6 ---------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    rows = queries.op6_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95


def test_language_odd(docs_of):
    docs = docs_of([*odd_rows(), (50, "123 !!", "s", "fr"), (51, "le chat est la", "s", "fr"), (52, "the cat is here", "s", "en"), (53, "the dog", "s", None)])
    content = langid.fit(docs, folds=1, held_out=9)
    assert content.keys() == {"en", "fr"}
    got = {r.doc_id: r for r in langid.identify_documents(docs, content).where("doc_id is not null").collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[50].lang_pred == "und" and got[0].score == 0
    assert got[51].lang_pred == "fr" and got[52].lang_pred == "en"
    assert {r.lang_pred for r in langid.identify_documents(docs, {}).collect()} == {"und"}
    assert langid.identify_documents(empty(docs), content).count() == 0 and langid.fit(empty(docs)) == {}


def test_language_of_long_or_repeated_rows(docs_of):
    """A language that has long texts only is learned; an id that is repeated brings one text to the driver."""
    rng = random.Random(9)
    french, english = "le chat est dans la maison avec une souris".split(), "the cat sits in a house with some mouse".split()
    rows = [(i, " ".join(rng.choices(french, k=4000)), "s", "fr") for i in range(60)] + [(100 + i, " ".join(rng.choices(english, k=30)), "s", "en") for i in range(60)]
    rows += [(7, " ".join(rng.choices(french, k=3000)), "s", "fr")] * 400
    docs = docs_of(rows)
    content = langid.fit(docs, folds=1, held_out=9, dictionary_bytes=50_000)
    assert content.keys() == {"en", "fr"} and all(len(x) <= 51_000 for x in content.values())
    assert content == langid.fit(docs.repartition(5), folds=1, held_out=9, dictionary_bytes=50_000)
    got = langid.identify_documents(docs, content).select("lang_pred", "doc_id").distinct().collect()
    assert all(r.lang_pred == ("en" if r.doc_id >= 100 else "fr") for r in got) and len(got) == 120


def test_languages_against_brute_force(spark):
    """Whole texts in blocks against every dictionary, the fewest bytes first."""
    import zstandard

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    content = langid.fit(docs)
    made = {}
    for lang, raw in sorted(content.items()):
        known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made[lang] = zstandard.ZstdCompressor(dict_data=known, level=langid.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    got = {r.doc_id: r.lang_pred for r in langid.identify_documents(docs, content).collect()}
    for r in docs.collect():
        plain = " ".join(re.findall(r"[^\W\d_]+", (r.text or "").lower()))
        blocks = [plain[a : a + langid.BLOCK_CHARS].encode() for a in range(0, len(plain), langid.BLOCK_CHARS)]
        sizes = {lang: sum(len(c.compress(b)) for b in blocks) for lang, c in made.items()}
        assert got[r.doc_id] == (min(sizes, key=lambda x: (sizes[x], x)) if plain else "und")


# -- 7 ---------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 150), st.integers(0, 255))
def test_media_round_trip(units, seed):
    payload = bytes((i * 31 + seed) % 256 for i in range(192 * units))
    data = matroska.mux(payload)
    packets, cues, error = matroska.demux(data)
    assert error is None and b"".join(data[p[2] : p[2] + p[3]] for p in packets) == payload
    assert [p[1] for p in packets] == sorted(p[1] for p in packets) and {p[4] for p in packets} <= {0, 1, 2, 3}
    assert all(data[c[2] : c[2] + 4] == bytes.fromhex("1f43b675") for c in cues)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9), st.integers(0, 255))
def test_broken_media_never_raises(at, value):
    data = bytearray(matroska.mux(bytes(range(192)) * 5))
    data[at % len(data)] = value
    matroska.demux(bytes(data))
    matroska.demux(bytes(data[: at % len(data)]))


def test_unknown_sizes_groups_and_big_laces():
    cluster = matroska.number(matroska.TIMESTAMP, 7)
    sizes = (300, 20, 500)
    body = b"\x81\x00\x05\x06" + matroska.lace(sizes, 3) + bytes(820)
    group = matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, body) + matroska.number(matroska.REFERENCE, 1))
    unknown = lambda kind, b: kind.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + b
    data = unknown(matroska.SEGMENT, unknown(matroska.CLUSTER, cluster + group) + matroska.element(matroska.CLUSTER, cluster + matroska.element(matroska.SIMPLE_BLOCK, b"\x82\x00\x00\x80abc")))
    packets, _, error = matroska.demux(data)
    assert error is None
    assert [(p[0], p[1], p[3], p[4], p[5]) for p in packets] == [(1, 12, 300, 3, False), (1, 12, 20, 3, False), (1, 12, 500, 3, False), (2, 7, 3, 0, True)]


def plain_ebml(data, at, end):
    """(id, first, last + 1) of elements of known size."""
    while at < end:
        width = 9 - data[at].bit_length()
        kind, at = data[at : at + width].hex(), at + width
        width = 9 - data[at].bit_length()
        size = int.from_bytes(data[at : at + width], "big") - (1 << 7 * width)
        at += width
        yield kind, at, at + size
        at += size


def plain_demux(data):
    """The frames' bytes in order, blocks by lacing and number of clusters, read apart from the operator."""
    out, lacings, clusters = b"", Counter(), 0
    for kind, a, b in plain_ebml(data, 0, len(data)):
        for top, c, d in plain_ebml(data, a, b) if kind == "18538067" else ():
            clusters += top == "1f43b675"
            for block, x, y in plain_ebml(data, c, d) if top == "1f43b675" else ():
                if block != "a3":
                    continue
                assert data[x] == 0x81  # track 1
                lacing = data[x + 3] >> 1 & 3
                x += 4
                count = data[x] + 1 if lacing else 1
                x += bool(lacing)
                lacings[lacing] += count
                if lacing == 1:  # sizes in bytes of 255 and a rest
                    for _ in range(count - 1):
                        while data[x] == 255:
                            x += 1
                        x += 1
                elif lacing == 3:  # a number and differences
                    for _ in range(count - 1):
                        x += 9 - data[x].bit_length()
                out += data[x:y]
    return out, lacings, clusters


def test_media_query(spark, docs_of):
    docs = docs_of(odd_rows())
    rows = matroska.stored_texts(docs).collect()
    assert sorted(r.n_bytes for r in rows) == sorted(len((t or "").encode()) for _, t in odd_rows())
    for r in rows:
        payload, lacings, clusters = plain_demux(bytes(r.media))
        assert bytes(r.r.payload) == payload and r.r.error is None and r.r.packets == sum(lacings.values()) and r.r.clusters == clusters == r.r.cues and r.r.seekable
        assert payload[: r.n_bytes].decode() in {t or "" for i, t in odd_rows() if i == r.doc_id}
        assert payload[r.n_bytes :].strip(b" ") == b"" and len(payload) % 192 == 0 and r.r.duration_ms == len(payload) // 8
    assert matroska.stored_texts(empty(docs)).count() == 0
    table = matroska.packet_table(matroska.stored_texts(docs), "doc_id", "media")
    assert table.where("id = 7").count() > 100 and table.where("duration_ms <= 0").count() == 0
    assert matroska.cue_table(matroska.stored_texts(docs), "doc_id", "media").where("id = 7").count() > 1


def test_media_of_all_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op7_matroska(spark, SF).collect()
    assert {r.doc_id for r in rows} == texts.keys() and len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (192 * max(1, -(-len(raw) // 192)) - len(raw))
        media = matroska.mux(payload)
        read, lacings, _ = plain_demux(media)
        assert read == payload and (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(media)) and r.error is None
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:]) and r.media_sha256 == hashlib.sha256(media).hexdigest()
        assert f"packets={sum(lacings.values())};" in r.feature and f"total={sum(payload)};" in r.feature


def test_media_batches_are_small(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "long text " * 3000) for i in range(12)], "doc_id long, text string")
    assert matroska.stored_texts(docs.coalesce(1)).selectExpr("sum(r.packets)", "count(distinct sha2(media, 256))").first()[1] == 1


# -- 8 ---------------------------------------------------------------------------------------------


def test_secrets_against_sql(spark):
    agree(queries.op8_secrets(spark, SF), queries.OP8_SQL)


def base_spans(text):
    kinds = {"assign": r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    found = []
    for k, (name, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text or "", re.I | re.A if name == "assign" else 0):
            if (len(m[2]) >= 6) if name == "assign" else len(m[0]) >= (20 if name == "access" else 24):
                found.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return sorted(found)


def test_secret_spans(docs_of):
    rng = random.Random(4)
    bits = ["token", "PassWord", "secret=", ":", "= ", "'", '"', "abc", "AKIA", "ABCDEFGHIJKLMNOP1234", "0123456789abcdef", "é😀", "api_key", "apikey=", " ", "\n", "x9_K" * 7, "zz", "https://u:pa55word@h/"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(1, 25)))) for i in range(200)] + [(300, None), (301, ""), (5, "token=abcdefgh"), (None, "token=abcdefgh")]
    got = secrets.scan(docs_of(rows), owner=F.col("source"), repo=F.col("lang")).collect()
    assert len(got) == len(rows)
    want = Counter((i, hashlib.sha256(",".join(s[2] for s in base_spans(t)).encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.base_sha256) for r in got) == want
    assert all({s[2] for s in base_spans(t)} <= set(r.spans.split(",")) for i, t in rows for r in got if r.doc_id == i and i not in (5, None))
    assert secrets.scan(empty(docs_of(rows)), owner=F.col("source"), repo=F.col("lang")).count() == 0


def test_ownership_separates_examples(docs_of):
    common_key, own_key = "Zx9kLm2Qw8Er5Ty7Ui3Op1As", "Bv4nMq8Wz2Xc6Vb9Nm1Lk5Jh"
    rows = [(i, f"key {common_key} end", f"s{i}") for i in range(4)] + [(9, f"key {own_key} end", "s1")]
    got = {r.doc_id: r for r in secrets.scan(docs_of(rows), owner=F.col("source"), repo=F.col("lang")).collect()}
    assert got[9].spans == f"mixed:4:{4 + len(own_key)}" and got[9].n_live == 1 and got[0].spans == ""


def test_repositories_count(docs_of):
    """One owner's key in many repositories is the owner's; two owners' key in many is an example; null parts are kept apart."""
    one, two, few = "Zx9kLm2Qw8Er5Ty7Ui3Op1As", "Bv4nMq8Wz2Xc6Vb9Nm1Lk5Jh", "Qa7wSx3Ed9Rf5Tg1Yh8Uj2Ik"
    rows = [(i, f"key {one}", "mine", f"r{i}") for i in range(9)]
    rows += [(20 + i, f"key {two}", f"s{i % 2}", f"r{i}") for i in range(6)]
    rows += [(40, f"key {few}", None, "en"), (41, f"key {few}", "en", None), (42, f"key {few}", "en", None)]
    got = {r.doc_id: r for r in secrets.scan(docs_of(rows), owner=F.col("source"), repo=F.col("lang")).collect()}
    assert got[0].n_live == 1 and (got[0].most_owners, got[0].most_repos) == (1, 9) and got[0].spans == "mixed:4:28"
    assert got[20].spans == "" and got[20].n_shared == 0
    assert got[40].n_shared == 1 and (got[41].most_owners, got[41].most_repos) == (2, 2)


def test_redaction(docs_of):
    docs = docs_of([(1, "a token = \"0123456789abcdef01234567\" b password:hunter22 c"), (2, "nothing"), (3, None), (1, "other")])
    found = secrets.classify(secrets.find(docs, owner=F.col("source"), repo=F.col("lang")))
    clean = secrets.redact(docs, found)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in clean.where("text is not null").collect()) == [(1, 'a [secret]" b [secret] c'), (1, "other"), (2, "nothing")]
    assert clean.where("text is null").count() == 1


# -- 9 ---------------------------------------------------------------------------------------------


def check_packing(rows, texts, size=1024):
    library = _library("byte_bpe_50k.json")
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for i, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(ids[i])
    assert by_doc.keys() == texts.keys()
    short = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        short += at < size
    return short


def test_packing(spark, docs_of):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op9_pack(spark, SF).collect()
    assert check_packing(rows, {r.doc_id: r.text for r in docs.collect()}) <= docs.rdd.getNumPartitions()
    odd = docs_of([*enumerate([*ODD, "<|endoftext|> a  b <|endoftext|>"])])
    check_packing(packing.pack(odd, public_tokenizers.path("byte_bpe_50k.json")).collect(), dict(enumerate([*ODD, "<|endoftext|> a  b <|endoftext|>"])))
    assert packing.pack(empty(odd), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert packing.pack(docs_of([(None, "x"), (None, None), (1, "x"), (1, "x")]), public_tokenizers.path("byte_bpe_50k.json")).count() >= 4


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="ab1 \n\t'sdré<|>endofx 　日\x1c\x85.,!", max_size=80)))
def test_encoder_is_the_librarys(text):
    got = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == _BYTES.encode(text, add_special_tokens=False).ids


_BYTES = _library("byte_bpe_50k.json")


def test_texts_without_blanks_are_not_kept():
    """20,000 texts without a blank: what stays in the tables is bounded by bytes, and the memory with it."""
    import tracemalloc

    rng = random.Random(12)
    text = lambda: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(200))
    words, pieces = bpe_count.Counter(public_tokenizers.path("word_bpe_49k.json")), packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    first = text()
    assert words(first) == len(_WORDS.encode(first, add_special_tokens=False).ids)
    tracemalloc.start()
    for _ in range(200):
        some = [text() for _ in range(100)]
        pieces(some)
        if _ % 20 == 0:
            sum(map(words, some))
    kept, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 20 << 20 and max(map(len, [*words.runs, *words.words]), default=0) <= bpe_count.CACHE_BYTES and not pieces.first and not pieces.later


def test_encoding_a_few_at_a_time():
    import pyarrow as pa

    texts = [None, "a"] * 700 + ["b" * 700_000] * 3 + ["c"]
    parts = list(packing.some_texts(pa.array(texts)))
    assert [x for _, part in parts for x in part] == [x or "" for x in texts]
    assert [at for at, _ in parts] == [sum(len(p) for _, p in parts[:k]) for k in range(len(parts))] and all(len(p) <= packing.AT_ONCE for _, p in parts)


def test_level_choice_is_the_least_sum_of_squares():
    rng, w = random.Random(5), packing.Windows(64)
    for i in range(2000):
        n = rng.randint(1, 63)
        level, counts = w.level_for(n), w.count[:64].copy()

        def after(h):
            c = counts.copy()
            c[h] -= h > 0
            if h + n < 64:
                c[h + n] += 1
            return int((c[1:] ** 2).sum())

        assert after(level) == min(after(h) for h in range(64 - n + 1) if h == 0 or counts[h])
        w.place((i, 0, bytes(4 * n), n), n)


# -- 10 --------------------------------------------------------------------------------------------


def test_shards(spark, docs_of):
    rng = random.Random(6)
    rows = [(i, rng.choice(["copy one " * 40, "copy two " * 30]) if i % 3 == 0 else f"text {i} " * rng.randint(1, 60)) for i in range(600)] + [(601, None), (602, "")]
    got = sharding.shard_documents(docs_of(rows)).collect()
    assert len(got) == len(rows) and {r.doc_id: r.size for r in got} == {i: len((t or "").encode()) + 1 for i, t in rows}
    assert all(r.text_crc32 == zlib.crc32((dict(rows)[r.doc_id] or "").encode()) for r in got)
    bytes_, slots, where = Counter(), defaultdict(list), defaultdict(Counter)
    for r in got:
        bytes_[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[dict(rows)[r.doc_id]][r.shard] += 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(bytes_) == set(range(8))
    assert max(bytes_.values()) - min(bytes_.values()) < 0.03 * sum(bytes_.values()) / 8 + 1500
    again = sharding.shard_documents(docs_of(rows).repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert sharding.shard_documents(docs_of(odd_rows())).count() == len(odd_rows())
    assert sharding.shard_documents(empty(docs_of(rows))).count() == 0


def test_equal_texts_meet(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    placed = queries.op10_shards(spark, SF).join(docs, "doc_id").groupBy("text").agg(F.countDistinct("shard").alias("k"))
    assert placed.where("k > 1").count() == 0


def test_propagation_cuts_links(spark):
    rng = random.Random(7)
    nodes = [(i, 1, rng.randrange(4)) for i in range(400)]
    links = [(a, b) for g in range(40) for a, b in itertools.combinations(range(10 * g, 10 * g + 10), 2) if rng.random() < 0.5]
    labels = spark.createDataFrame(nodes, "node long, size long, shard int")
    out = {r.node: r.shard for r in sharding.propagate(labels, spark.createDataFrame(links, "u long, v long"), 130, 4, rounds=6).collect()}
    cut = lambda at: sum(at[a] != at[b] for a, b in links)
    assert cut(out) < 0.5 * cut({n: s for n, _, s in nodes}) and max(Counter(out.values()).values()) < 160
