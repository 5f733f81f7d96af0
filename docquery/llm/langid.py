"""Language identification by compression.

Each language has a raw-content zstandard dictionary of letters and spaces
taken from a bounded sample of training texts.  A text is reduced to lower-case
letter words, cut into blocks, and every block is compressed with every
dictionary; the language with the fewest bytes in sum wins.  Blocks keep a
dictionary near throughout a long text, and all of the text counts.  The score
is the share of the winner against the runner-up after a logistic of the
relative margin; answers with a margin below `margin` are marked rejected.

Defined cases: null texts and texts without a letter are `und` with score 0;
so is everything if no training row has a language; rows without a language, with a null id or of
the held-out fold are never learned from; equal sizes go to the first language by name; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquery.llm.common import learned_on, sample_per_group

#: Bounds of the training sample: bytes of a dictionary, rows of a language, and the first characters of each row's text.
DICTIONARY_BYTES = 112 * 1024
TRAIN_ROWS = 150
TRAIN_CHARS = 16_384
#: Characters that are compressed at a time.
BLOCK_CHARS = 4096
LEVEL = 6
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-case words of letters, one space between."""
    return _OTHER.sub(" ", (text or "").lower()).strip()


def dictionaries(rows: list[tuple[str, str]], size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """language -> raw content: the rows' letters take equal parts of it."""
    by: dict[str, list[bytes]] = {}
    for lang, text in rows:
        if x := letters(text):
            by.setdefault(lang, []).append(x.encode())
    out = {}
    for lang, texts in sorted(by.items()):
        texts.sort(key=len)
        left, parts = size, []
        for k, x in enumerate(texts):  # short ones leave room for the longer
            part = x[: left // (len(texts) - k)]
            parts.append(part)
            left -= len(part)
        out[lang] = b" ".join(parts)
    return out


@lru_cache(maxsize=4)
def _compressors(content: tuple) -> list:
    made = []
    for _, raw in content:
        known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(dict_data=known, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def identify(text: str | None, content: tuple, margin: float) -> tuple[str, float, bool]:
    """(language, score, rejected). content: sorted (language, dictionary) pairs."""
    plain = letters(text)
    if not plain or not content:
        return "und", 0.0, True
    sizes = [0] * len(content)
    for at in range(0, len(plain), BLOCK_CHARS):
        block = plain[at : at + BLOCK_CHARS].encode()
        for k, c in enumerate(_compressors(content)):
            sizes[k] += len(c.compress(block))
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    best = order[0]
    gap = 1.0 if len(order) < 2 else (sizes[order[1]] - sizes[best]) / sizes[order[1]]
    return content[best][0], 1 / (1 + math.exp(-min(60.0, 40 * gap))), gap < margin


def language(text: Column, content: dict[str, bytes], margin: float = 0.02) -> Column:
    """struct(lang_pred, score, rejected) of each whole text."""
    fixed = tuple(sorted(content.items()))

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([identify(x, fixed, margin) for x in texts], columns=["lang_pred", "score", "rejected"])

    return predict(text)


def fit(
    docs: DataFrame, *, folds: int = 4, held_out: int = 2, rows_per_language: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS,
    dictionary_bytes: int = DICTIONARY_BYTES, seed: int = 6, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> dict[str, bytes]:
    """Dictionaries of `dictionary_bytes` from at most `rows_per_language` ids of each language, of each text the first `train_chars` characters.

    Ids are drawn before any text is read, whatever its length.  Of several rows with one id and language the text of least hash counts.
    """
    known = docs.where(learned_on(F.col(id_col), folds, held_out) & F.col(lang_col).isNotNull())
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chosen = sample_per_group(known, "lang", "id", rows_per_language, seed).withColumnsRenamed({"id": "__id", "lang": "__lang"})
    rows = known.join(F.broadcast(chosen), (F.col("id") == F.col("__id")) & (F.col("lang") == F.col("__lang")))  # so many rows a language
    one = F.min(F.struct(F.xxhash64("text").alias("h"), F.left("text", F.lit(train_chars)).alias("text"))).alias("m")
    rows = rows.groupBy("lang", "id").agg(one).select("lang", "m.text")
    return dictionaries([(r.lang, r.text) for r in sorted(rows.collect())], dictionary_bytes)


def identify_documents(
    docs: DataFrame, content: dict[str, bytes], *, folds: int = 4, held_out: int = 2, margin: float = 0.02, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; one row per row of docs."""
    out = docs.select(
        F.col(id_col).alias("doc_id"), (~learned_on(F.col(id_col), folds, held_out)).alias("held_out"), language(F.col(text_col), content, margin).alias("p")
    )
    return out.select("doc_id", "held_out", "p.*")
