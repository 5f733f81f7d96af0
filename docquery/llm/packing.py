"""Sum-of-squares online packing of token sequences into fixed windows.

Documents become token ids plus an end mark.  Whole windows are cut off first;
the remainder goes to the open window whose choice makes the sum of squared
counts of partly filled windows, taken by fill level, smallest.  What is still
open at the end of a partition is merged by cutting, so that at most one
window a partition stays short.

Each partition packs its own documents as they stream by: nothing is shuffled,
memory holds only the open windows, and a lost task repacks its partition alone.
Window numbers carry the partition's number in their upper bits.

Defined cases: null or empty text is the end mark alone; null ids stay null;
repeated rows are packed once per row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a task's cache of encoded words (it is emptied when full), and the longest word that is kept.
CACHE = 400_000
CACHE_CHARS = 40
#: Documents and characters that are encoded at a time.
AT_ONCE, CHARS_AT_ONCE = 512, 1 << 20
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_ODD_SPACE = re.compile(r"\s\s|^\s|\s\Z")

#: The split rule of byte-level pre-tokenizers (a fixed value).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _byte_pairs(path: str):
    """text -> ids for a byte-level tokenizers file.

    If its merges are in order of their ids, as is usual, its table is handed
    to tiktoken, which gives the same ids at an eighth of the time; else the file's own library encodes.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec["pre_tokenizer"]
    made = [model["vocab"][a + b] for a, b in model["merges"]]
    plain = cut == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if plain and made == sorted(made) and len(made) + 256 == len(model["vocab"]) and not spec["normalizer"]:
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        letter = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(letter[c] for c in word): n for word, n in model["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        known = tiktoken.Encoding(path, pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda texts: [known.encode(x, allowed_special="all") for x in texts]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return lambda texts: [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]


class Encoder:
    """Token ids as little-endian bytes.

    A byte-level pre-tokenizer always starts a new piece at a single space
    between two other characters, so the text between such spaces can be encoded on its own and kept.
    """

    def __init__(self, path: str):
        self.encode = _byte_pairs(path)
        self.first: dict[str, bytes] = {}  # of a text
        self.later: dict[str, bytes] = {}  # after a space

    def forget(self) -> None:
        self.first.clear()
        self.later.clear()

    def learn(self, parts: set[str], lead: str, known: dict[str, bytes]) -> list[str]:
        """Encode lead + part for each part; the library takes them in batches. Returns the long ones, which are not to be kept."""
        new = list(parts)
        known.update(zip(new, (array("I", ids).tobytes() for ids in self.encode([lead + p for p in new])), strict=True))
        return [p for p in new if len(p) > CACHE_CHARS]

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [_LONE_SPACE.split(x) if _ODD_SPACE.search(x) else x.split(" ") for x in texts]
        if len(self.first) + len(self.later) > CACHE:
            self.forget()
        first, later = self.first, self.later
        long_first = self.learn({parts[0] for parts in cut}.difference(first), "", first)
        long_later = self.learn(set().union(*(parts[1:] for parts in cut)).difference(later), " ", later)
        out = [first[parts[0]] + b"".join([later[p] for p in parts[1:]]) for parts in cut]
        for known, parts in ((first, long_first), (later, long_later)):
            for p in parts:
                del known[p]
        return out


def some_texts(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of a few texts each, by their number and length; null is empty."""
    at, part, chars = 0, [], 0
    for n, x in enumerate(texts):
        part.append(x.as_py() or "")
        chars += len(part[-1])
        if len(part) == AT_ONCE or chars >= CHARS_AT_ONCE:
            yield at, part
            at, part, chars = n + 1, [], 0
    if part:
        yield at, part


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Windows:
    """The open windows of one partition, by fill level."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)  # open windows at each level; the last entry stays 0
        self.open: list[list[list]] = [[] for _ in range(size)]
        self.done = 0  # windows closed so far

    def level_for(self, n: int) -> int:
        """The level (0: a new window) that n tokens join: least sum of squares after it, then the fullest."""
        left = self.count[1 : self.size - n + 1]
        right = self.count[1 + n : self.size + 1]
        cost = 2 * (right - left) + 2
        if len(cost):
            cost[-1] -= 1  # a full window no longer counts
            cost = np.where(left > 0, cost, np.iinfo(np.int64).max)
            best = len(cost) - 1 - int(np.argmin(cost[::-1]))
            if cost[best] <= 2 * self.count[n] + 1:
                return best + 1
        return 0

    def place(self, piece: tuple, n: int) -> list | None:
        """Put a piece into a window; the window's pieces if it is now full."""
        level = self.level_for(n)
        window = self.open[level].pop() if level else []
        if level:
            self.count[level] -= 1
        window.append(piece)
        if level + n == self.size:
            return window
        self.count[level + n] += 1
        self.open[level + n].append(window)
        return None

    def rest(self) -> Iterator[list]:
        """Close what is open: the emptiest windows are cut up to fill the fullest."""
        left = [(level, w) for level in range(self.size - 1, 0, -1) for w in self.open[level]]
        low, high = len(left) - 1, 0
        while high <= low:
            level, window = left[high]
            while level < self.size and low > high:
                have, donor = left[low]
                row, start, ids, total = donor.pop()
                n = len(ids) // 4
                take = min(n, self.size - level)
                window.append((row, start + n - take, ids[4 * (n - take) :], total))
                if take < n:
                    donor.append((row, start, ids[: 4 * (n - take)], total))
                level, left[low] = level + take, (have - take, donor)
                if have == take:
                    low -= 1
            yield window
            high += 1


def _pack(batches: Iterator[pa.RecordBatch], path: str, size: int, end: int) -> Iterator[pa.RecordBatch]:
    encode, windows = encoder(path), Windows(size)
    base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    tail = np.array([end], "<u4").tobytes()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    out: list[list] = [[] for _ in names]

    def close(window: list) -> None:
        offset = 0
        for row, start, ids, total in window:
            n = len(ids) // 4
            for column, x in zip(out, (row, start, n, zlib.crc32(ids), total, base + windows.done, offset), strict=True):
                column.append(x)
            offset += n
        windows.done += 1

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)
        for c in out:
            c.clear()
        return batch

    for batch in batches:
        rows = batch.column(0).to_pylist()
        for at, texts in some_texts(batch.column(1)):
            for row, ids in zip(rows[at : at + len(texts)], encode(texts), strict=True):
                ids += tail
                total = len(ids) // 4
                full = total - total % size
                for start in range(0, full, size):
                    close([(row, start, ids[4 * start : 4 * (start + size)], total)])
                if total > full and (window := windows.place((row, full, ids[4 * full :], total), total - full)):
                    close(window)
            if len(out[0]) > 20_000:
                yield flush()
    for window in windows.rest():
        close(window)
    encode.forget()  # workers outlive their tasks
    yield flush()


def pack(
    docs: DataFrame, tokenizer_path: str, *, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's pieces cover its ids (and its end mark) exactly once; the pieces of a sequence_id lie gapless from offset 0.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: _pack(batches, tokenizer_path, window, end_id), SCHEMA)
