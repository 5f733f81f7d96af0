"""Bulk-synchronous best-fit packing of token sequences into fixed windows.

Documents become token ids plus an end mark; only what is longer than a window is cut, into whole windows and a rest.

Sizes are whole numbers up to the window, so documents are range-sorted by size and rank: the tasks that
make the ids number the documents of each size in their order, sums of these counts by task give ranks over all tasks.  Documents
of one size are a run, and windows with one gap size, opened or filled together, are a run of numbers too.

A round sweeps both orders from the largest size down: each run of documents takes its successor,
the smallest gap that holds it and no larger document took in this round.  Of the documents that meet a gap the
first ranks go in, as often as they fit, and later ranks go to the next gap.  Then gaps are updated and the round is repeated;
once no document fits, as many windows are opened as the largest documents left (over half a window,
then over three quarters of the largest one) need at least.  A round sees runs,
at most one a size for the documents, so its work doesn't grow with the table; every document then
finds its place among the matches by size and rank in a task of its own.  The plan's size depends on the window, not on the table.

Defined cases: null or empty text is the end mark alone; null ids stay null; repeated rows are packed once per row;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquery.llm.common import materialise, small_side

#: A worker's table of encoded words is emptied before a batch once it has more words or ids than this.
CACHE, CACHE_IDS = 400_000, 4_000_000
#: So many plain words are encoded as one text; words of these letters are plain.
TOGETHER = 50
_PLAIN = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: Bytes of text that are encoded at a time.
AT_ONCE = 8 << 20
#: Windows that are full from one document have numbers from here on.
WHOLE = 1 << 62

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Encoder:
    """Token ids of many texts at once, for a tokenizer that drops white space: the words between ASCII white space are encoded on their own.

    A batch's words are gathered in one array and made distinct; each distinct word is encoded once, and ids are laid out by position.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix")
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[n for x, n in vocabulary.items() if suffix and x.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}  # word -> its number in the order of learning
        self.ids, self.ends = array("I"), array("q", [0])

    def learn(self, words: list[bytes]) -> None:
        """Encode new words; plain ones go many in a text, whose ids are cut behind each one that ends a word."""
        text = [w.decode("utf-8", "replace") for w in words]
        plain = [n for n, x in enumerate(text) if _PLAIN.fullmatch(x)]
        parts = [plain[at : at + TOGETHER] for at in range(0, len(plain), TOGETHER)]
        alone = [n for n, x in enumerate(text) if not _PLAIN.fullmatch(x)]
        for part, x in zip(parts, self.library.encode_batch_fast([" ".join([text[n] for n in part]) for part in parts], add_special_tokens=False)):
            ids = np.array(x.ids, np.uint32)
            cuts = np.flatnonzero(self.is_end[ids]) + 1
            if len(cuts) == len(part):  # every word ends at least once, so each did once
                self.add([words[n] for n in part], ids, cuts)
            else:
                alone += part
        for at in range(0, len(alone), 10_000):
            part = alone[at : at + 10_000]
            made = [x.ids for x in self.library.encode_batch_fast([text[n] for n in part], add_special_tokens=False)]
            self.add([words[n] for n in part], np.array([i for ids in made for i in ids], np.uint32), np.cumsum([len(ids) for ids in made]))

    def add(self, words: list[bytes], ids: np.ndarray, cuts: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.ends.frombytes((cuts.astype(np.int64) + len(self.ids)).tobytes())
        self.ids.frombytes(ids.tobytes())

    def numbers(self, distinct: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE or len(self.ids) > CACHE_IDS:
            self.forget()
        self.learn([w for w in distinct if w not in self.known])
        return np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))

    def __call__(self, data: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by end_id; number of ids of each text). data: bytes of the texts, each followed by a blank; ends: where each text's blank is."""
        letter = ~_SPACE[data]
        edge = np.flatnonzero(np.diff(letter, prepend=False))  # starts and ends in turn: the last byte is a blank
        starts, stops = edge[::2], edge[1::2]
        places = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data[letter]))]).dictionary_encode()
        number = self.numbers(words.dictionary.to_pylist())
        ends_of = np.frombuffer(self.ends, np.int64)
        first, sizes = np.append(ends_of[:-1][number], len(self.ids)), np.append(np.diff(ends_of)[number], 1)
        flat = np.append(np.frombuffer(self.ids, np.uint32), np.uint32(end_id))

        per_text = np.searchsorted(starts, ends)  # words up to the end of each text
        which = np.insert(words.indices.to_numpy().astype(np.int64), per_text, len(number))
        many = sizes[which]
        upto = np.cumsum(many)
        out = flat[np.repeat(first[which] - (upto - many), many) + np.arange(upto[-1] if len(upto) else 0)]
        marks = upto[per_text + np.arange(len(ends))]
        return out, np.diff(marks, prepend=0)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def joined(texts: pa.Array, at_once: int = AT_ONCE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, ends) of some texts each, every text followed by a blank; null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + at_once, "right")) - 1)
        own = offsets[at : to + 1] - offsets[at]
        yield at, np.insert(data[offsets[at] : offsets[to]], own[1:], 32), own[1:] + np.arange(to - at)
        at = to


def _cut(batches: Iterator[pa.RecordBatch], path: str, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encode, part = encoder(path), TaskContext.get().partitionId() if TaskContext.get() else 0
    seen = np.zeros(window + 1, np.int64)  # pieces of each size so far
    names = [x.split()[0] for x in PIECES.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    for batch in batches:
        for at, data, ends in joined(batch.column(1)):
            ids, totals = encode(data, ends, end_id)
            pieces = -(-totals // window)
            row = np.repeat(np.arange(len(totals)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * window
            length = np.minimum(totals[row] - start, window)
            begin = (np.cumsum(totals) - totals)[row] + start
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            sizes, firsts, counts = np.unique(length[order], return_index=True, return_counts=True)
            place = np.empty(len(row), np.int64)
            place[order] = np.arange(len(row)) - np.repeat(firsts, counts) + np.repeat(seen[sizes], counts)
            seen[sizes] += counts
            columns = [batch.column(0).take(pa.array(at + row)), piece, start, length, crc, np.full(len(row), part), place]
            yield pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(t) for c, t in zip(columns, types)], names)
    encode.forget()  # workers outlive their tasks


def match(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Matches (size, first rank, documents, first window, documents a window, offset) that place all documents; counts: documents of each size."""
    left = {s: n for s, n in counts.items() if n}
    taken: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[list[int]]] = {}  # gap size -> runs (first window, windows)
    out: list[tuple[int, int, int, int, int, int]] = []
    opened = 0
    while left:
        updated: dict[int, list[list[int]]] = defaultdict(list)
        placed = 0
        waiting: list[int] = []  # gap sizes seen by the sweep and not used up, the smallest last
        sizes, free = sorted(left, reverse=True), sorted(gaps, reverse=True)
        at = 0
        for size in sizes:
            while at < len(free) and free[at] >= size:
                waiting.append(free[at])
                at += 1
            while waiting and left.get(size):
                gap, fits = waiting[-1], waiting[-1] // size
                first, n = gaps[gap][-1]
                many = min(left[size], n * fits)
                full, odd = divmod(many, fits)
                for windows, each, rest in ((full, fits, gap - fits * size), (1 if odd else 0, odd, gap - odd * size)):
                    if windows:
                        out.append((size, taken[size], windows * each, first, each, window - gap))
                        taken[size] += windows * each
                        if rest:
                            updated[rest].append([first, windows])
                        first, n = first + windows, n - windows
                placed += many
                left[size] -= many
                if n:
                    gaps[gap][-1] = [first, n]
                else:
                    gaps[gap].pop()
                    if not gaps[gap]:
                        waiting.pop()
            if not left[size]:
                del left[size]
        gaps = {g: runs for g, runs in gaps.items() if runs}
        for gap, runs in updated.items():
            gaps.setdefault(gap, []).extend(runs)
        if left and not placed:
            large = sum(n for s, n in left.items() if 2 * s > window)  # no two of these share a window
            new = large or -(-sum(s * n for s, n in left.items() if 4 * s > 3 * max(left)) // window)
            gaps.setdefault(window, []).append([opened, new])
            opened += new
    return out


def best_fit(docs: DataFrame, tokenizer_path: str, *, window: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The pieces of a sequence_id lie gapless from offset 0; only documents above the window have more than one piece.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialise(rows.mapInArrow(lambda batches: _cut(batches, tokenizer_path, window, end_id), PIECES), "fit-pieces")
    counts = pieces.where(F.col("length") < window).groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row per task
    counts = materialise(counts.select(F.col("part").alias("__part"), F.col("length").alias("__length"), "n", F.coalesce(before, F.lit(0)).alias("before")), "fit-counts")
    found = {r[0]: r[1] for r in counts.groupBy("__length").agg(F.sum("n")).collect()}  # fewer rows than the window
    plan = np.array(match(found, window), np.int64).reshape(-1, 6)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    def found_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        spans = {int(s): (a, b) for s, a, b in _spans(plan[:, 0])}
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = np.empty(len(length), np.int64)
            for size in np.unique(length):
                a, b = spans[int(size)]
                mine = length == size
                row[mine] = a + np.searchsorted(plan[a:b, 1], rank[mine], "right") - 1
            size, first, _, seq, each, offset = plan[row].T
            seq, offset = seq + (rank - first) // each, offset + (rank - first) % each * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = pieces.where(F.col("length") == window).select(*keys, (F.lit(WHOLE) + F.col("part").cast("long") * (1 << 36) + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < window).join(small_side(counts), (F.col("part") == F.col("__part")) & (F.col("length") == F.col("__length")))
    return rest.select(*keys, (F.col("before") + F.col("place")).alias("rank")).mapInArrow(found_places, SCHEMA).unionByName(whole)


def _spans(sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """(size, first row, row after the last) of a sorted column."""
    if not len(sizes):
        return []
    at = np.flatnonzero(np.diff(sizes, prepend=sizes[0] - 1))
    return list(zip(sizes[at].tolist(), at.tolist(), [*at[1:].tolist(), len(sizes)]))
