"""Phrase mining against brute force, with common words, small tables and odd inputs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from against import SF, agree
from hypothesis import given, settings
from hypothesis import strategies as st

from docquery.llm import phrases, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, most=2000):
    """Rows (lang, rank, phrase, a, l, r, n, score) from (lang, text)."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        own = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                own.update(zip(*(words[i:] for i in range(k))))
    out = []
    for lang, own in counts.items():
        often = {p: n for p, n in own.items() if n >= least}
        found = []
        for p, a in often.items():
            if len(p) < 2:
                continue
            score, _, l, r = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            holds = (n for q, n in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if not any(100 * n >= 80 * a for n in holds):
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = rows_of(queries.op13_phrases(spark, SF))
    assert got == brute((r.lang, r.text) for r in docs.collect()) and len(got) > 20


def test_against_sql(spark):
    agree(queries.op13_phrases(spark, SF), queries.OP13_SQL)


def some_texts(seed, n=150):
    rng = random.Random(seed)
    words = ["The", "of", "a", "b", "c", "d'e", "É", "日本", "x\x00y", "z\x85"]
    text = lambda: "".join(rng.choices(words, (9, 7, 3, 2, 1, 1, 1, 1, 1, 1))[0] + rng.choice([" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
    return [(rng.choice(["en", "en", "de", None]), rng.choice([text(), text(), text(), "the of the of a", None, ""])) for _ in range(n)]


@pytest.mark.parametrize("common, buffer, rows_each", [(100_000, 2_000_000, 1_000_000), (100, 50, 200), (300, 1, 10_000), (0, 70, 300)])
def test_common_words(spark, docs_of, monkeypatch, common, buffer, rows_each):
    """Words that are routed by more than two words, small buffers and many partitions change nothing."""
    monkeypatch.setattr(phrases, "COMMON_PART", 1 << 40)
    monkeypatch.setattr(phrases.suffixes, "__defaults__", (buffer,))
    monkeypatch.setattr(phrases, "PER_PARTITION", rows_each)
    texts = some_texts(1)
    docs = docs_of([(i, text, "s", lang) for i, (lang, text) in enumerate(texts)]).repartition(3)
    assert rows_of(phrases.mine(docs, common=common)) == brute(texts)
    assert rows_of(phrases.mine(docs, common=common, least=2, most=40)) == brute(texts, 2, 40)


def test_full_bit_table(docs_of, monkeypatch):
    """A bit table that says yes to everything only costs work."""
    monkeypatch.setattr(phrases, "MOST_BITS", 6)
    monkeypatch.setattr(phrases, "frequent_bits", lambda words, n: np.full(1, 2**64 - 1, np.uint64))
    texts = some_texts(2)
    assert rows_of(phrases.mine(docs_of([(i, text, "s", lang) for i, (lang, text) in enumerate(texts)]))) == brute(texts)


def test_odd_texts(docs_of):
    odd = [None, "", " ", ".,;:!?", "one", "One one ONE oné", "a b.c d\ta b", "x" * 100_000, "w " * 30_000]
    rows = [(i, t, "s", lang) for i, t in enumerate(odd) for lang in ("en", None)]
    rows += [*rows[:4], (None, "a b", "s", "en")]
    docs = docs_of(rows)
    assert rows_of(phrases.mine(docs, least=1)) == brute([(r[3], r[1]) for r in rows], 1)
    assert rows_of(phrases.mine(docs)) == brute([(r[3], r[1]) for r in rows])
    assert phrases.mine(docs.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(1, 4), st.integers(1, 4), st.integers(0, 4), st.integers(0, 4), st.integers(1, 9)), min_size=1, max_size=60), st.integers(1, 30))
def test_quicksort(rows, least):
    """Equal parts are the prefixes whose weight is at least the bound."""
    rows = [(a, b, c, d, e if d else 0, n) for a, b, c, d, e, n in rows]
    columns, weights = [np.array(x) + (i == 0) for i, x in enumerate(zip(*(r[:5] for r in rows)))], np.array([r[5] for r in rows])
    want = Counter()
    for r in rows:
        for depth in range(2, 5):
            if all(r[1 : depth + 1]):
                want[r[: depth + 1]] += r[5]
    for lead in (2, 3, 4):
        got = phrases.equal_parts(columns, weights, lead, least)
        found = {rows[i][: depth + 1]: n for i, depth, n in got}
        assert len(found) == len(got) and found == {k: n for k, n in want.items() if n >= least or len(k) - 1 < lead != 2}
