"""Best-fit packing against the library's ids, sequential best fit, and odd inputs."""

import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from against import SF

from docquery.llm import bestfit, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "  a  b", "x<|endoftext|>y <|startoftext|> z", "é café é a ́", "日本語 😀", "a\x00b\x1c\x85c\xa0d e", "\x0b\x0c\r\n",
    "don't WE'LL 'S 123 4_5 ...", "x" * 50_000, " ́", "A‍ b", "ŉ İ ẞ ﬁ", "one two", "one two",
]


def library_ids(texts):
    from tokenizers import Tokenizer

    return [x.ids + [0] for x in Tokenizer.from_file(PATH).encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_pieces(rows, ids_of, window=2048):
    """Every id in one piece, only long documents cut, sequences gapless; returns the number of sequences."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == ids_of.keys()
    for key, pieces in by_doc.items():
        ids, pieces = ids_of[key], sorted(pieces, key=lambda r: r.piece)
        assert len(pieces) == -(-len(ids) // window)
        for n, r in enumerate(pieces):
            part = ids[n * window : (n + 1) * window]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (n, n * window, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return len(by_seq)


def sequential(sizes, window):
    gaps, n = [], 0
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(gaps, s)
        if i == len(gaps):
            n += 1
            bisect.insort(gaps, window - s)
        else:
            bisect.insort(gaps, gaps.pop(i) - s)
    return n


def test_all_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = dict(zip(texts, library_ids(texts.values())))
    got = check_pieces(queries.op12_best_fit(spark, SF).collect(), ids)
    assert got <= 1.01 * sequential([min(2048, len(x) - at) for x in ids.values() for at in range(0, len(x), 2048)], 2048) + 1


def test_odd_texts(docs_of):
    docs = docs_of(list(enumerate(ODD)))
    ids = dict(enumerate(library_ids(ODD)))
    for window in (2048, 7, 1):
        check_pieces(bestfit.best_fit(docs.repartition(3), PATH, window=window).collect(), ids, window)
    twice = bestfit.best_fit(docs_of([(1, "one two"), (1, "one two"), (None, "one two"), (None, None)]), PATH).collect()
    assert Counter(r.doc_id for r in twice) == {1: 2, None: 2} and len({(r.sequence_id, r.offset) for r in twice}) == 4
    assert bestfit.best_fit(docs.where("false"), PATH).count() == 0


def test_texts_in_parts():
    """Small batches of bytes, and a table of words that is emptied all the time, change nothing."""
    encode = bestfit.Encoder(PATH)
    for at_once in (1, 50, 1 << 20):
        got = []
        for _, data, ends in bestfit.joined(pa.array([None, *ODD])[1:], at_once):
            ids, totals = encode(data, ends, 0)
            got += [x.tolist() for x in np.split(ids, np.cumsum(totals)[:-1])]
        assert got == library_ids(ODD)


def test_small_tables_of_words(monkeypatch):
    monkeypatch.setattr(bestfit, "CACHE", 2)
    test_texts_in_parts()


@pytest.mark.parametrize("kind", ["even", "skewed", "few", "hot"])
def test_matches(kind):
    """Each document has one place, no window overflows, and rounds are no worse than one document after the other by over one percent."""
    rng = random.Random(kind)
    draw = {
        "even": lambda: rng.randint(1, 2047), "skewed": lambda: min(2047, int(rng.lognormvariate(5.5, 1)) + 1), "few": lambda: rng.choice([1, 341, 700, 701, 1025]),
        "hot": lambda: rng.choice([600, rng.randint(1, 2047)]),
    }[kind]
    counts = Counter(draw() for _ in range(20_000))
    windows, seen = defaultdict(list), defaultdict(list)
    plan = bestfit.match(counts, 2048)
    for size, first, n, seq, each, offset in plan:
        seen[size] += range(first, first + n)
        for i in range(n):
            windows[seq + i // each].append((offset + i % each * size, size))
    assert {s: sorted(x) for s, x in seen.items()} == {s: list(range(n)) for s, n in counts.items()}
    for pieces in windows.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= 2048
    assert len(windows) <= 1.01 * sequential(counts.elements(), 2048) and len(plan) < 4 * 2048


def test_plan_does_not_grow():
    """A thousand times the documents make hardly more matches."""
    rng = random.Random(5)
    counts = Counter(min(2047, int(rng.lognormvariate(5.5, 1)) + 1) for _ in range(20_000))
    assert len(bestfit.match({s: 1000 * n for s, n in counts.items()}, 2048)) < 4 * len(bestfit.match(counts, 2048))
