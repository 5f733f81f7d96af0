"""Phrase collocations by multikey quicksort of suffix pointers.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line breaks and those into words.  A phrase is two to
four words of a piece; everything is counted per language.

First the words are counted.  Words below the least count break a piece, for no phrase with them is frequent; a bit table
of bounded size tells the tasks which words may be frequent, and where it errs only work is lost.  Each suffix of what is left, cut at
four words, is sent to a partition by its leading words: two, or where these are very common as many
as it takes to meet a word that isn't, so that no word or pair makes a large group.  Equal suffixes of a task are one row with a count.

A partition sorts pointers to its suffixes by three-way quicksort, word by word: what equals the pivot goes on to the next
word, and its weight is the count of the phrase so far; parts whose weight is below the least count are abandoned.  Counts of phrases shorter
than the routing prefix come from several partitions and are added up.

Scores and containment are joins over the frequent phrases.

Defined cases: null text is empty, null language is `und`; repeated rows count each time; ties in
score go to the greater count, then by phrase in byte order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.llm.bestfit import joined
from docquery.llm.common import materialise, small_side

#: Longest phrase, in words.
DEPTH = 4
#: Suffixes that a task gathers before it counts equal ones, and that a partition is to have.
BUFFER, PER_PARTITION = 1_000_000, 500_000
#: A word is very common above this count (two partitions' size), or above this part of all words: so there are at most that many such words.
COMMON, COMMON_PART = 2 * PER_PARTITION, 4096
#: Most bits of the table of frequent words (16 MB), and bits a word as long as there are fewer.
MOST_BITS, BITS_EACH = 27, 32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER, _BREAK = np.ones(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
_LETTER[[*b" \t"]] = False
_LETTER[_BREAK] = False


def _words(data: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(number of each word among the distinct ones, the distinct words, whether a piece starts there); data ends with a break."""
    data = _LOWER[data]
    letter = _LETTER[data]
    edge = np.flatnonzero(np.diff(letter, prepend=False))
    starts, stops = edge[::2], edge[1::2]
    places = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data[letter])]).dictionary_encode()
    piece = np.searchsorted(np.flatnonzero(_BREAK[data]), starts)
    return found.indices.to_numpy().astype(np.int64), found.dictionary.to_pylist(), np.diff(piece, prepend=-1) != 0


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """(language, bytes of some of its texts, each followed by a line break)."""
    langs = batch.column(0).dictionary_encode()
    codes = langs.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    ends = np.searchsorted(codes[order], np.arange(len(langs.dictionary) + 1))
    for lang, a, b in zip(langs.dictionary.to_pylist(), ends, ends[1:]):
        for _, data, at in joined(batch.column(1).take(pa.array(order[a:b]))):
            data[at] = 10
            yield lang, data


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of rows (lang, text); the row without a word has the number of all words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, data in _by_language(batch):
                which, words, _ = _words(data)
                n = np.append(np.bincount(which, minlength=len(words)), len(which))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array([*words, None], pa.binary()), pa.array(n)], ["lang", "word", "n"])

    made = rows.mapInArrow(counted, "lang string, word binary, n long")
    return made.groupBy("lang", F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))


def _places(lang: str, words: list[bytes], bits: int) -> np.ndarray:
    seed, digest = zlib.crc32(lang.encode()), xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words)) & np.uint64((1 << bits) - 1)


def frequent_bits(words: DataFrame, n: int) -> np.ndarray:
    """A table of bits in which each of the n words (lang, word) has its own set."""
    bits = max(10, min(MOST_BITS, (BITS_EACH * n).bit_length()))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            words = batch.column(1).cast(pa.binary()).to_pylist()
            at = np.concatenate([_places(x, [w], bits) for x, w in zip(langs, words)]) if words else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_pydict({"slot": (at >> np.uint64(6)).astype(np.int64), "bit": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    rows = words.select("lang", "word").mapInArrow(placed, "slot long, bit long").groupBy("slot").agg(F.bit_or("bit").alias("bit"))
    table = np.zeros(1 << max(0, bits - 6), np.uint64)
    found = rows.toArrow()  # 2^21 rows at most
    table[found.column("slot").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    return table


def _follow(codes: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Rows of DEPTH codes: each word with those after it in its piece, up to a 0."""
    out = np.zeros((len(codes), DEPTH), np.int32)
    out[:, 0] = codes
    for d in range(1, DEPTH):
        out[:-d, d] = np.where((out[:-d, d - 1] > 0) & ~fresh[d:], codes[d:], 0)
    return out[(out[:, 0] > 0) & (out[:, 1] > 0)]


def _counted_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and how often each is there."""
    high, low = rows[:, 0].astype(np.int64) << 32 | rows[:, 1], rows[:, 2].astype(np.int64) << 32 | rows[:, 3]
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    first = np.flatnonzero((np.diff(high, prepend=-1) != 0) | (np.diff(low, prepend=-1) != 0))
    return rows[order[first]], np.diff(np.append(first, len(rows)))


def suffixes(rows: DataFrame, table: np.ndarray, common: dict[str, set[bytes]], buffer: int = BUFFER) -> DataFrame:
    """(lang, words, lead, n): suffixes of two to DEPTH words that may be frequent, the number of words that they are routed by, and how many there are."""
    held = rows.sparkSession.sparkContext.broadcast((table, common))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, very_common = held.value
        known: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (numbers, parts) in known.items():
                found, n = _counted_rows(np.concatenate([np.empty((0, DEPTH), np.int32), *parts]))
                words = pa.array([None, *numbers], pa.large_binary())
                hot = np.zeros(len(words), bool)
                hot[[numbers[w] for w in very_common.get(lang, ()) if w in numbers]] = True
                rest = ~hot[found]
                lead = np.where(rest.any(axis=1), np.clip(rest.argmax(axis=1) + 1, 2, DEPTH), DEPTH)
                for at in range(0, len(found), 100_000):
                    some = [words.take(pa.array(found[at : at + 100_000, d])) for d in range(DEPTH)]
                    text = pc.binary_join_element_wise(*some, pa.scalar(b" ", pa.large_binary()), null_handling="skip")
                    size = len(text)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * size), text.cast(pa.binary()), pa.array(lead[at : at + size].astype(np.int32)), pa.array(n[at : at + size].astype(np.int64))], ["lang", "words", "lead", "n"]
                    )
            known.clear()

        for batch in batches:
            for lang, data in _by_language(batch):
                which, words, fresh = _words(data)
                at = _places(lang, words, int(len(bits) * 64).bit_length() - 1)
                numbers, parts = known.setdefault(lang, ({}, []))
                codes = np.zeros(len(words), np.int32)
                for i in np.flatnonzero(bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).tolist():
                    codes[i] = numbers.setdefault(words[i], len(numbers) + 1)
                parts.append(_follow(codes[which], fresh))
                waiting += len(parts[-1])
                if waiting > buffer:
                    yield from flush()
                    waiting = 0
        yield from flush()

    made_rows = rows.mapInArrow(made, "lang string, words binary, lead int, n long")
    return made_rows.withColumn("words", F.col("words").cast("string"))


def equal_parts(columns: list[np.ndarray], weights: np.ndarray, lead: int, least: int) -> list[tuple[int, int, int]]:
    """(row, depth, weight) of the equal parts of a three-way quicksort, word by word: the row's first words up to the depth are a phrase of that weight.

    columns: language, then the words' numbers, 0 where a suffix ends.  Parts lighter than `least` are abandoned; phrases
    shorter than the routing prefix `lead` are only part of their number here, and none of these is left out.
    """
    pointers = np.arange(len(weights))
    out: list[tuple[int, int, int]] = []
    todo = [(0, len(pointers), 0)]
    while todo:
        low, high, depth = todo.pop()
        own = pointers[low:high]
        values = columns[depth][own]
        bound = least if lead == 2 or depth >= lead else 1
        pivot = sorted((values[0], values[len(values) // 2], values[-1]))[1]
        less, equal = values < pivot, values == pivot
        parts = own[less], own[equal], own[~(less | equal)]
        pointers[low:high] = np.concatenate(parts)
        a, b = low + len(parts[0]), low + len(parts[0]) + len(parts[1])
        for part, begin, end in ((parts[0], low, a), (parts[2], b, high)):
            if len(part) and weights[part].sum() >= bound:
                todo.append((begin, end, depth))
        if pivot:
            weight = int(weights[parts[1]].sum())
            if weight >= bound:
                if depth >= 2:
                    out.append((int(parts[1][0]), depth, weight))
                if depth < DEPTH:
                    todo.append((a, b, depth + 1))
    return out


def sorted_counts(routed: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, n_words, n) from suffixes that are together by their leading words; n is to be added up by phrase."""
    names = ["lang", "phrase", "n_words", "n"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        parts = pc.split_pattern(rows.column("words").combine_chunks().cast(pa.large_binary()), pattern=b" ")
        words = parts.flatten().dictionary_encode()
        sizes = pc.list_value_length(parts).to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        codes = np.zeros((DEPTH + 1, len(sizes)), np.int32)
        langs = rows.column("lang").combine_chunks().dictionary_encode()
        codes[0] = langs.indices.to_numpy() + 1
        codes[place + 1, row] = words.indices.to_numpy() + 1
        weights, lead = rows.column("n").to_numpy(), rows.column("lead").to_numpy()
        for some in np.unique(lead):
            mine = np.flatnonzero(lead == some)
            found = np.array(equal_parts([c[mine] for c in codes], weights[mine], int(some), least), np.int64).reshape(-1, 3)
            for depth in np.unique(found[:, 1]):
                at, _, n = found[found[:, 1] == depth].T
                at = mine[at]
                texts = [words.dictionary.take(pa.array(codes[d, at] - 1)) for d in range(1, depth + 1)]
                phrase = pc.binary_join_element_wise(*texts, pa.scalar(b" ", pa.large_binary())).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(codes[0, at] - 1)), phrase, pa.array(np.full(len(at), depth, np.int32)), pa.array(n)], names)

    made = routed.mapInArrow(counted, "lang string, phrase binary, n_words int, n long")
    return made.withColumn("phrase", F.col("phrase").cast("string"))


def frequent_phrases(docs: DataFrame, least: int = 30, *, text_col: str = "text", lang_col: str = "lang", common: int = COMMON) -> tuple[DataFrame, DataFrame, int]:
    """(phrases (lang, phrase, n_words, n) of one to DEPTH words with n >= least, totals (lang, n), the count above which a phrase is very common)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = materialise(word_counts(rows).where((F.col("n") >= least) | F.col("word").isNull()), "phrase-words")
    words, totals = counts.where("word is not null"), counts.where("word is null").select("lang", "n")
    n_words, occurrences = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    every = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(common, every // COMMON_PART)
    very: dict[str, set[bytes]] = {}
    for r in words.where(F.col("n") > limit).collect():  # fewer than COMMON_PART rows
        very.setdefault(r.lang, set()).add(bytes(r.word, "utf-8"))
    made = suffixes(rows, frequent_bits(words, n_words), very)
    routed = made.repartition(max(1, -(-int(occurrences) // PER_PARTITION)), "lang", F.expr("substring_index(words, ' ', lead)"))
    found = sorted_counts(routed, least).groupBy("lang", "phrase", "n_words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    single = words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("n_words"), "n")
    return materialise(found.unionByName(single), "phrases"), totals, limit


def _exact(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def scored(phrases: DataFrame, limit: int, scale: int = 2_000_000) -> DataFrame:
    """(lang, phrase, n_words, a, l, r, score) of the phrases of two words or more: the cut of lowest score, the earliest of equal ones.

    Both parts of every cut are looked up; the few parts that are very common, which most phrases have, come from a broadcast table.
    """
    longer = phrases.where("n_words > 1").withColumnRenamed("n", "a")
    cuts = longer.select("*", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("cut"))
    halves = F.array(
        F.struct(F.lit(True).alias("first"), F.expr("substring_index(phrase, ' ', cut)").alias("part")),
        F.struct(F.lit(False).alias("first"), F.expr("substring_index(phrase, ' ', cut - n_words)").alias("part")),
    )
    parts = cuts.select("lang", "phrase", "n_words", "a", "cut", F.inline(halves))
    names = {"lang": "__lang", "phrase": "__part", "n": "n"}
    table = phrases.select(*(F.col(k).alias(v) for k, v in names.items()))
    same = (F.col("lang") == F.col("__lang")) & (F.col("part") == F.col("__part"))
    heavy = F.broadcast(table.where(F.col("n") > limit))  # DEPTH * COMMON_PART rows at most
    known = parts.join(heavy, same, "left").withColumn("__known", F.col("n").isNotNull()).drop("__lang", "__part")
    rest = known.where("not __known").drop("n").join(small_side(table.where(F.col("n") <= limit)), same).drop("__lang", "__part")
    both = known.where("__known").unionByName(rest)
    pick = lambda first: F.max(F.when(F.col("first") == F.lit(first), F.col("n")))
    sums = both.groupBy("lang", "phrase", "n_words", "a", "cut").agg(pick(True).alias("l"), pick(False).alias("r"))
    score = F.expr(f"cast({scale} as decimal(38,0)) * cast(a as decimal(38,0)) div (cast(l as decimal(38,0)) + cast(r as decimal(38,0)))")
    best = sums.withColumn("score", score).groupBy("lang", "phrase", "n_words", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "n_words", "a", "b.l", "b.r", "b.score")


def contained(phrases: DataFrame) -> DataFrame:
    """(lang, part, most): the greatest count of a longer phrase that holds the part, for parts of two words or more."""
    longer = phrases.where("n_words > 2")
    words = F.split("phrase", " ")
    inside = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("n_words") - 1),
            lambda size: F.transform(F.sequence(F.lit(1), F.col("n_words") - size + 1), lambda at: F.array_join(F.slice(words, at, size), " ")),
        )
    )
    return longer.select("lang", F.explode(inside).alias("part"), "n").groupBy("lang", "part").agg(F.max("n").alias("most"))


def mine(docs: DataFrame, *, least: int = 30, most: int = 2000, scale: int = 2_000_000, share: int = 80, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language.

    A phrase is left out if a longer one that holds it has at least `share` hundredths of its count.
    """
    phrases, totals, limit = frequent_phrases(docs, least, **options)
    inside = contained(phrases).select(F.col("lang").alias("__lang"), F.col("part").alias("__part"), "most")
    rows = scored(phrases, limit, scale)
    rows = rows.join(inside, (F.col("lang") == F.col("__lang")) & (F.col("phrase") == F.col("__part")), "left")
    rows = rows.where(F.col("most").isNull() | (100 * _exact(F.col("most")) < share * _exact(F.col("a"))))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    rows = rows.join(small_side(totals.withColumnsRenamed({"lang": "__of"})), F.col("lang") == F.col("__of"))
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
