"""Batched retrieval: lexical and vector top-k, fusion, relevance gate, grouping.

Everything works on many queries at once (`query_id`).  The total order of
hits is score (rounded to nine places) descending, then the chunk's keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.functions import text as T
from docquery.functions import vector as V
from docquery.operators.keys import spread
from docquery.plans.scratch import written

K1, B = 1.2, 0.75
#: A block of queries is broadcast: at most so many tokens, or bytes of vectors.  More queries go in several blocks.
MOST_TOKENS = 100_000
MOST_VECTOR_BYTES = 8 << 20
#: Pairs of a posting and a question that a task sums.
MEETING_ROWS = 1_000_000
#: Queries that are multiplied with a batch of vectors at a time.
AT_ONCE = 256


def _blocks(queries: DataFrame, size: Column, most: int) -> list[DataFrame]:
    """queries in parts whose sizes sum up to about `most` (a query is never divided)."""
    total = queries.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n = -(-int(total) // most) or 1
    return [queries] if n == 1 else [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k) for k in range(n)]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ranked(hits: DataFrame, keys: list[str], k: int | None = None, score: str = "score") -> DataFrame:
    """Add rank (from 1) within each query, and keep the first k."""
    order = Window.partitionBy("query_id").orderBy(F.round(score, 9).desc(), *keys)
    out = hits.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= max(1, k))


def query_tokens(queries: DataFrame) -> DataFrame:
    """query_id, token: the distinct tokens of each query (query_id, text)."""
    return queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))


def asked_postings(chunks: DataFrame, keys: list[str], asked: DataFrame, text_col: str = "text") -> DataFrame:
    """keys, token, tf, dl of the asked tokens (a written table), from one pass over the texts; each chunk has a row of the empty token, so all chunks and lengths are in it."""
    words = asked.select("token").distinct().union(asked.sparkSession.createDataFrame([("",)], "token string"))
    rows = spread(chunks.select(*keys, F.col(text_col).alias("__text"))).select(*keys, T.tokens(F.col("__text")).alias("tokens")).withColumn("dl", F.size("tokens"))
    rows = T.term_counts(rows.withColumn("tokens", F.array_append("tokens", "")), "tokens")
    return written(rows.join(F.broadcast(words), "token", "left_semi").select(*keys, "token", "tf", "dl"), "asked-postings")


def bm25_of_postings(posted: DataFrame, keys: list[str], asked: DataFrame, n: int, avgdl: float | None) -> DataFrame:
    """query_id, keys, score of asked (query_id, token) from postings (keys, token, tf, dl) that hold all rows of these tokens; n, avgdl: of all chunks.

    Frequencies combine before their shuffle; postings are shuffled once, by chunk, which serves the sum over a question's tokens too.
    They tell how many rows meet, so a task sums a bounded number, however many chunks there are.
    """
    found = posted.where(F.col("token") != "")
    df = written(found.groupBy("token").agg(F.count("*").alias("df")), "asked-frequencies")  # asked tokens only
    meet = asked.join(F.broadcast(df), "token").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    tasks = max(posted.sparkSession.sparkContext.defaultParallelism, -(-int(meet) // MEETING_ROWS))
    df = F.broadcast(df)
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(df, "token").select("query_id", "token", idf.alias("idf"))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(avgdl or 1))))
    return found.repartition(tasks, *keys).join(F.broadcast(weights), "token").groupBy("query_id", *keys).agg(F.sum(F.col("idf") * weight).alias("score"))


def bm25(chunks: DataFrame, keys: list[str], queries: DataFrame, k: int | None = 20, text_col: str = "text") -> DataFrame:
    """query_id, keys, score, rank: BM25 over all chunks, whose texts are read once for each block of questions.

    Tokens are counted within a chunk's row and cut to the asked ones by a broadcast semi-join; these postings are written, and
    frequencies, lengths and scores come from them.  Every task keeps k rows a query before the ranks' shuffle.
    """
    hits = []
    for block in _blocks(written(query_tokens(queries), "asked"), F.lit(1), MOST_TOKENS):
        posted = asked_postings(chunks, keys, block, text_col)
        n, avgdl = posted.where("token = ''").agg(F.count("*"), F.avg("dl")).first()
        hits.append(bm25_of_postings(posted, keys, block, n, avgdl))
    return ranked(_union(hits), keys, k)


def cosine_top_k(vectors: DataFrame, keys: list[str], queries: DataFrame, k: int | None = 20, vector_col: str = "embedding") -> DataFrame:
    """query_id, keys, score, rank: exact cosine of queries (query_id, embedding) with every vector.

    A query without length has no hits; a null vector, one with null entries or one of no or another length scores 0.
    The queries are a stated set against all rows, in blocks of bounded bytes.  An Arrow batch of vectors is a matrix, multiplied
    with a block's queries at once, and of each product only the best k rows a query leave the task (all for k = None).
    """
    rows = queries.select("query_id", F.transform("embedding", lambda x: x.cast("double")).alias("__q"), V.norm(F.col("embedding")).alias("__qn")).where("__qn > 0").drop("__qn")
    rows = written(rows, "asked-vectors")
    whole = F.when(F.forall(vector_col, lambda x: x.isNotNull()), F.transform(vector_col, lambda x: x.cast("double")))
    held = spread(vectors.select(*keys, whole.alias("__v")))
    kinds = dict(rows.dtypes) | dict(held.dtypes)
    out = ", ".join(f"`{c}` {kinds[c]}" for c in ("query_id", *keys)) + ", score double"
    hits = [held.mapInArrow(_products(block.toArrow(), keys, k), out) for block in _blocks(rows, 8 * F.size("__q") + 32, MOST_VECTOR_BYTES)]
    return ranked(_union(hits), keys, k)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Unit rows of the vectors of that length (zero rows for others)."""
    column = pc.if_else(pc.fill_null(pc.equal(pc.list_value_length(column), size), False), column, pa.scalar([0.0] * size, column.type))
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return rows / np.where(norm > 0, norm, 1)[:, None]


def _products(asked: pa.Table, keys: list[str], k: int | None):
    """A function from batches (keys, vector) to the best rows of each query in a batch; equal scores go by keys."""
    asked = asked.combine_chunks()
    sizes = pc.list_value_length(asked.column("__q")).to_numpy()

    def best(scores: np.ndarray, order: np.ndarray) -> np.ndarray:
        if k is None or k >= len(scores):
            return np.arange(len(scores))
        rounded = np.round(scores, 9)
        least = np.partition(rounded, len(rounded) - k)[len(rounded) - k]
        above, equal = np.flatnonzero(rounded > least), np.flatnonzero(rounded == least)
        return np.concatenate([above, equal[np.argsort(order[equal])[: k - len(above)]]])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = [(size, np.flatnonzero(sizes == size)) for size in np.unique(sizes).tolist()]
        blocks = [(of, _matrix(asked.column("__q").combine_chunks().take(pa.array(of)), size), size) for size, of in groups]
        for batch in batches:
            named = pa.table({f"k{n}": batch.column(n) for n in range(len(keys))})
            order = np.empty(batch.num_rows, np.int64)
            order[pc.sort_indices(named, sort_keys=[(c, "ascending") for c in named.column_names], null_placement="at_start").to_numpy()] = np.arange(batch.num_rows)
            for of, block, size in blocks:
                matrix = _matrix(batch.column(len(keys)), size)
                for at in range(0, len(of), AT_ONCE):
                    scores = block[at : at + AT_ONCE] @ matrix.T
                    picks = [best(s, order) for s in scores]
                    row, query = pa.array(np.concatenate(picks)), np.repeat(of[at : at + AT_ONCE], [len(x) for x in picks])
                    columns = [asked.column("query_id").combine_chunks().take(pa.array(query)), *(batch.column(n).take(row) for n in range(len(keys)))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([s[x] for s, x in zip(scores, picks)]))], ["query_id", *keys, "score"])

    return met


def rrf(vector_hits: DataFrame, lexical_hits: DataFrame, keys: list[str], rrf_k: int = 60) -> DataFrame:
    """query_id, keys, score, vector_score, lexical_score, source of two ranked lists: one union and one shuffle."""
    both = vector_hits.select("query_id", *keys, "rank", "score", F.lit("vector").alias("arm")).unionByName(
        lexical_hits.select("query_id", *keys, "rank", "score", F.lit("lexical").alias("arm"))
    )
    arm = lambda a: F.max(F.when(F.col("arm") == a, F.col("score")))
    k = rrf_k if rrf_k and rrf_k > 0 else 60
    fused = both.groupBy("query_id", *keys).agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"), arm("vector").alias("vector_score"), arm("lexical").alias("lexical_score"),
        F.count("*").alias("__n"), F.max("arm").alias("__arm"),
    )
    return fused.withColumn("source", F.when(F.col("__n") > 1, "both").otherwise(F.col("__arm"))).drop("__n", "__arm")


def gate(hits: DataFrame, min_score: float = 0.0, min_ratio: float = 0.0) -> DataFrame:
    """Drop hits whose vector score is known and low, then those far below the query's best."""
    out = hits
    if min_score > 0:
        out = out.where(F.col("vector_score").isNull() | (F.col("vector_score") >= min_score))
    if 0 < min_ratio < 1:
        best = F.max("score").over(Window.partitionBy("query_id"))
        out = out.withColumn("__best", best).where((F.col("__best") <= 0) | (F.col("score") >= F.col("__best") * min_ratio)).drop("__best")
    return out


def hybrid(
    chunks: DataFrame, vectors: DataFrame, keys: list[str], queries: DataFrame, *, candidates: int = 20, rrf_k: int = 60,
    min_score: float = 0.15, min_ratio: float = 0.5, top_k: int = 6, use_lexical: bool = True, use_vector: bool = True,
) -> DataFrame:
    """Both arms, fused, gated, cut to top_k. queries: query_id, text, embedding (null: lexical only)."""
    kind = queries.schema["query_id"].dataType
    none = chunks.where(F.lit(False)).select(F.lit(None).cast(kind).alias("query_id"), *keys, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    vec = cosine_top_k(vectors, keys, queries.where("embedding is not null"), candidates) if use_vector else none
    lex = bm25(chunks, keys, queries.select("query_id", "text"), candidates) if use_lexical else none
    return fused(vec, lex, keys, rrf_k=rrf_k, min_score=min_score, min_ratio=min_ratio, top_k=top_k)


def fused(vec: DataFrame, lex: DataFrame, keys: list[str], *, rrf_k: int = 60, min_score: float = 0.15, min_ratio: float = 0.5, top_k: int = 6) -> DataFrame:
    """Two ranked lists fused, gated and cut."""
    return ranked(gate(rrf(vec, lex, keys, rrf_k), min_score, min_ratio), keys, top_k)


def diagnosis(vec: DataFrame, lex: DataFrame, fused: DataFrame, gated: DataFrame, kept: DataFrame) -> DataFrame:
    """A row per query: hits of each arm, after fusion, gate and cut, the best score, and the sources of what is kept."""
    parts = [("vector", vec), ("lexical", lex), ("fused", fused), ("after_gate", gated), ("kept", kept)]
    rows = None
    for name, df in parts:
        source = F.col("source") if name == "kept" else F.lit(None).cast("string")
        part = df.select("query_id", F.lit(name).alias("part"), "score", source.alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    count = lambda p: F.count_if(F.col("part") == p)
    of = lambda s: F.count_if((F.col("part") == "kept") & (F.col("source") == s))
    out = rows.groupBy("query_id").agg(
        *(count(n).alias(n) for n, _ in parts), F.round(F.max(F.when(F.col("part") == "kept", F.col("score"))), 4).alias("top1"),
        *(of(s).alias(f"from_{s}") for s in ("vector", "lexical", "both")),
    )
    mode = F.when((F.col("vector") > 0) & (F.col("lexical") > 0), "hybrid").when(F.col("vector") > 0, "vector").otherwise("lexical")
    return out.withColumn("mode", mode)


def grouped_by_file(hits: DataFrame, file: str, text: Column | None = None) -> DataFrame:
    """query_id, file, first_rank, text: each file's hits joined by line breaks, in order of rank."""
    items = F.array_sort(F.collect_list(F.struct("rank", (F.col("text") if text is None else text).alias("t"))))
    out = hits.groupBy("query_id", file).agg(F.min("rank").alias("first_rank"), items.alias("__i"))
    return out.withColumn("text", F.array_join(F.transform("__i", lambda x: x["t"]), "\n")).drop("__i")


#: References to what was said before (a fixed pattern).
REFERENCE = "这|那|它|上面|刚才|前面|该|此|第[一二三四五六七八九十百\\d]{1,3}[章节页条]"


def rewritten(turns: DataFrame, conversation: str = "conv_id", *, short: int = 12, question: int = 20, reference: str = REFERENCE) -> DataFrame:
    """turns of users (conversation, turn, text) with previous and query: the question before is put in front of one that leans on it."""
    said = turns.withColumn("text", T.strip(F.coalesce("text", F.lit("")))).where("text <> ''")
    before = F.lag("text").over(Window.partitionBy(conversation).orderBy("turn"))
    cur, prev = F.col("text"), F.col("previous")
    leans = (F.length(cur) <= short) | cur.rlike(reference) | ((F.length(cur) <= question) & cur.rlike("[呢吗]$"))
    apart = prev.isNotNull() & ~prev.contains(cur)
    return said.withColumn("previous", before).withColumn("query", F.when(apart & leans, F.concat_ws(" ", prev, cur)).otherwise(cur))


def last_user_query(turns: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """conversation, text: what the user said last, blank turns left out."""
    said = turns.where((F.col("role") == "user") & (T.strip(F.coalesce("text", F.lit(""))) != ""))
    return said.groupBy(conversation).agg(F.max_by(T.strip(F.col("text")), "turn").alias("text"))
