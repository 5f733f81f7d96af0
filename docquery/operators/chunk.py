"""Recursive chunking as a table function.

Pieces end with their separator: paragraph, line, sentence, clause, blank, in
this order, each tried only on pieces still too long; what has none is cut
hard.  Pieces are then packed greedily up to the chunk size, and a new chunk
starts with the end of the one before where both fit.

One Arrow function over small parts of each batch of texts does the recursion; everything around it is relational.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquery.functions.parts import mapped
from docquery.operators.keys import spread

#: Separators in order (fixed values).
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", ".", "!", "?", ";", "，", ",", " ")
#: A leading run of separators joins the first piece; every piece takes the run behind it.
_PIECES = [re.compile(rf"(?:^(?:{s})+)?(?:(?!{s}).)+(?:{s})*|^(?:{s})+", re.S) for s in map(re.escape, SEPARATORS)]


def _split(text: str, size: int, overlap: int, level: int = 0) -> Iterator[str]:
    if len(text) <= size:
        yield text
        return
    while level < len(SEPARATORS) and SEPARATORS[level] not in text:
        level += 1
    if level == len(SEPARATORS):
        yield from (text[at : at + size] for at in range(0, len(text), size - overlap))
        return
    found = _PIECES[level].findall(text)
    if found == [text] and not text.strip(SEPARATORS[level]):
        return  # nothing but separators
    for piece in found:
        yield from _split(piece, size, overlap, level + 1)


def split_text(text: str | None, size: int, overlap: int, merge: bool = True) -> list[str]:
    """The chunks of one text; blank pieces join the one before if they fit."""
    text = (text or "").strip()
    if len(text) <= size:
        return [text] if text else []
    pieces: list[str] = []
    for piece in _split(text, size, overlap):
        if piece.strip():
            pieces.append(piece)
        elif pieces and len(pieces[-1]) + len(piece) <= size:
            pieces[-1] += piece
    if not merge:
        return pieces
    chunks, open_ = [], ""
    for piece in pieces:
        if len(open_) + len(piece) <= size:
            open_ += piece
            continue
        if open_:
            chunks.append(open_)
        lead = open_[len(open_) - overlap :] if 0 < overlap < len(open_) else open_ if overlap else ""
        open_ = lead + piece if len(lead) + len(piece) <= size else piece
    return [*chunks, open_] if open_ else chunks


def chunks_of(text: Column, size: int = 1024, overlap: int = 128, merge: bool = True) -> Column:
    """array<string> of the chunks of each text."""
    if size <= 0 or overlap >= size:
        raise ValueError("size must be positive and above overlap")
    return mapped(lambda texts: [split_text(x, size, overlap, merge) for x in texts], "array<string>", pa.list_(pa.string()), text)


def chunked(files: DataFrame, keys: list[str], size: int = 1024, overlap: int = 128, merge: bool = True, text_col: str = "text") -> DataFrame:
    """keys, chunk_index, text: one row per chunk."""
    held = spread(files.select(*keys, F.col(text_col).alias("__text")))
    return held.select(*keys, F.posexplode(chunks_of(F.col("__text"), size, overlap, merge)).alias("chunk_index", "text"))
