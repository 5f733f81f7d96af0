"""Inverted and vector index as plain tables, keyed by whatever columns name a chunk.

`postings` has a row per chunk and token, `doc_stats` one per chunk, and corpus
and token frequencies derive from them.  Written once and partitioned by
session, they are read with pruning; nothing here keeps state in the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.functions import text as T
from docquery.functions import vector as V
from docquery.operators.keys import join_on, spread


def tokenised(chunks: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, tokens (array, repeats included), dl."""
    return chunks.select(*keys, T.tokens(F.col(text_col)).alias("tokens")).withColumn("dl", F.size("tokens"))


def postings(chunks: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, token, tf, dl; a chunk's tokens are counted in its row, so nothing is shuffled."""
    rows = spread(chunks.select(*keys, F.col(text_col).alias("__text")))
    return T.term_counts(tokenised(rows, keys, "__text"), "tokens").select(*keys, "token", "tf", "dl")


def doc_stats(chunks: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, dl: tokens of each chunk, repeats included."""
    return chunks.select(*keys, T.token_count(F.col(text_col)).alias("dl"))


def corpus_stats(stats: DataFrame, *group: str) -> DataFrame:
    """n and avgdl (chunks without tokens count), overall or by group."""
    return stats.groupBy(*group).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def doc_freq(posted: DataFrame, *group: str) -> DataFrame:
    """token, df: chunks that have the token."""
    return posted.groupBy(*group, "token").agg(F.count("*").alias("df"))


def lexical_allowance(own: Column, others: Column, per_session: int, overall: int) -> Column:
    """Tokens a session may index: its own limit, and what others leave of the overall one (at least 1); 0 is no limit."""
    if not overall:
        return F.lit(per_session)
    left = F.greatest(F.lit(0), F.lit(overall) - others)
    return F.greatest(F.lit(1), F.least(F.lit(per_session), left) if per_session else left)


def within_budget(posted: DataFrame, stats: DataFrame, session: str, max_tokens: int, max_postings: int) -> DataFrame:
    """session, tokens, postings, disabled: an index above a limit is dropped as a whole; 0 is no limit."""
    sizes = stats.groupBy(session).agg(F.sum("dl").alias("tokens"))
    counts = posted.groupBy(F.col(session).alias("__s")).agg(F.count("*").alias("postings"))
    out = sizes.join(counts, F.col(session).eqNullSafe(F.col("__s")), "left").drop("__s")
    out = out.withColumn("postings", F.coalesce("postings", F.lit(0)))
    over = (F.lit(max_tokens > 0) & (F.col("tokens") > max_tokens)) | (F.lit(max_postings > 0) & (F.col("postings") > max_postings))
    return out.withColumn("disabled", over)


def remove_files(table: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """table without the rows of the given files; null keys are keys."""
    return join_on(table, files.select(*keys).distinct(), keys, "left_anti")


def replace_files(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """table with all rows of new's files replaced by new."""
    return remove_files(table, new, keys).unionByName(new)


def latest(table: DataFrame, keys: list[str], time: str, *tie: str) -> DataFrame:
    """The last written row of each key: what an upsert leaves."""
    order = Window.partitionBy(*keys).orderBy(F.col(time).desc(), *(F.col(t).desc() for t in tie))
    return table.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def normalised(vectors: DataFrame, keys: list[str], vector_col: str = "embedding") -> DataFrame:
    """keys, vec, norm: unit vectors in double, and the norm they had."""
    return vectors.select(*keys, V.normalise(F.col(vector_col)).alias("vec"), V.norm(F.col(vector_col)).alias("norm"))


def embed(chunks: DataFrame, keys: list[str], embedder: Callable[[list[str]], list], text_col: str = "text", batch: int = 64, tolerant: bool = False) -> DataFrame:
    """keys, embedding: the embedder gets lists of up to `batch` texts, in order.

    A failure fails the task, so no file is half embedded; with `tolerant` the texts of a failed call get null instead.
    """

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            got: list = []
            for at in range(0, len(texts), batch):
                part = [x or "" for x in texts.iloc[at : at + batch]]
                try:
                    made = list(embedder(part))
                    if len(made) != len(part):
                        raise ValueError(f"{len(made)} vectors for {len(part)} texts")
                except Exception:
                    if not tolerant:
                        raise
                    made = None
                got += [None] * len(part) if made is None else [np.asarray(v, "f4") for v in made]
            yield pd.Series(got)

    return chunks.select(*keys, vectors(F.col(text_col)).alias("embedding"))


def character_histogram(texts: list[str]) -> np.ndarray:
    """Stand-in embedding without a model: 64 counts of code points, unit length."""
    out = np.zeros((len(texts), 64), "f4")
    for row, x in zip(out, texts):
        np.add.at(row, np.array([ord(c) % 64 for c in x], int), 1)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length == 0, 1, length)
