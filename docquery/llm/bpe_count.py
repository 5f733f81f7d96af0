"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as one symbol per byte, the last one marked as the word's end.
A heap yields the adjacent pair of lowest rank; merging relinks its neighbours
in a doubly linked list and pushes the pairs that this forms.  The count is the
initial number of symbols less the number of merges; no token ids arise.

The tokenizer file's own normalizer and pre-tokenizer are run by its library,
on one space-separated run of text at a time.  Counts of short runs and words are
kept per worker, in two tables of at most CACHE entries of up to CACHE_BYTES each, so of bounded
size; long ones (texts without blanks) are counted anew each time.

Defined cases: null and empty texts have 0 tokens and 0 bytes; special strings
inside a text count as one token each, as the library does by default; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of each of a worker's tables of known runs and words (a table is emptied when full), and the longest key that is kept.
CACHE = 400_000
CACHE_BYTES = 48
_PLACE = (1 << 40) - 1


#: Visible characters of Latin-1: normalization leaves them alone, and every library agrees on their classes.
_LATIN = re.compile("[\x21-\x7e\xa1-\xac\xae-\xff]+")


def _plain_rules(spec: dict) -> tuple:
    """The split pattern and the byte-to-letter table, if the file has the usual steps; else no pattern."""
    import regex

    steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in cuts] != ["Split", "ByteLevel"]:
        return None, {}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return regex.compile(cuts[0]["pattern"]["Regex"]), letters


class _Known(dict):
    """Remembers what a function gave for short keys."""

    def __init__(self, function):
        self.function = function

    def __missing__(self, key):
        value = self.function(key)
        if len(key) <= CACHE_BYTES:
            if len(self) >= CACHE:
                self.clear()
            self[key] = value
        return value


class Counter:
    """Counts the tokens of a word-end byte-pair vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.end = spec["model"]["end_of_word_suffix"] or ""
        # symbols as small whole numbers: a pair is one number, and a rank gives the symbol that its merge makes
        self.symbols: dict[str, int] = spec["model"]["vocab"]
        pairs = [(self.symbols[a], self.symbols[b], self.symbols[a + b]) for a, b in spec["model"]["merges"]]
        self.ranks = {a << 20 | b: r for r, (a, b, _) in enumerate(pairs)}
        self.merged = [c for *_, c in pairs]
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern, self.letters = _plain_rules(spec)
        self.runs, self.words = _Known(self.run), _Known(self.merge)

    def merge(self, word: str) -> int:
        """Tokens of one pre-tokenized word."""
        symbols = [*map(self.symbols.__getitem__, word[:-1]), self.symbols[word[-1] + self.end]]
        ranks, merged, size = self.ranks, self.merged, len(symbols)
        # rank of the pair that starts at each place, -1 if none; a heap entry that differs from it is out of date
        rank = [ranks.get(a << 20 | b, -1) for a, b in zip(symbols, symbols[1:])]
        rank.append(-1)
        heap = [r << 40 | i for i, r in enumerate(rank) if r >= 0]
        if not heap:
            return size
        heapq.heapify(heap)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        count = size
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> 40, top & _PLACE
            if rank[i] != r:
                continue
            j = after[i]
            now = symbols[i] = merged[r]
            rank[j] = -1
            count -= 1
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                r = rank[i] = ranks.get(now << 20 | symbols[k], -1)
                if r >= 0:
                    heapq.heappush(heap, r << 40 | i)
            else:
                rank[i] = -1
            h = before[i]
            if h >= 0:
                r = rank[h] = ranks.get(symbols[h] << 20 | now, -1)
                if r >= 0:
                    heapq.heappush(heap, r << 40 | h)
        return count

    def split(self, text: str) -> list[str]:
        """Normalized words in byte-level letters, as the library's normalizer and pre-tokenizer give them."""
        if self.pattern and _LATIN.fullmatch(text):  # already composed; lower case is one to one
            return [w.encode().decode("latin-1").translate(self.letters) for w in self.pattern.findall(text.lower())]
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def run(self, raw: bytes) -> int:
        """Tokens of a run of text without ASCII white space."""
        text, total = raw.decode("utf-8", "surrogatepass"), 0
        parts = [text]
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            total = len(parts) - 1
        for part in parts:
            total += sum(map(self.words.__getitem__, self.split(part)))
        return total

    def __call__(self, text: str | None) -> int:
        # bytes split at ASCII white space; no word of the vocabulary spans it
        return sum(map(self.runs.__getitem__, (text or "").encode("utf-8", "surrogatepass").split()))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_count(text: Column, tokenizer_path: str) -> Column:
    """Number of tokens of each text."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counted = counter(tokenizer_path)
        for texts in batches:
            yield texts.map(counted).astype("int64")

    return count(text)


def count_tokens(docs: DataFrame, tokenizer_path: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; one row per row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(
        F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, tokenizer_path).alias("n_tokens")
    )
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
