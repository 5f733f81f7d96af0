"""Queries for indexing and retrieval over the given tables, and the same in SQL.

A document stands for a file and chunk, its source for a session, its language for a conversation; benchmark items are
the questions, and the embedding with a document's or item's number is its vector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.functions import text as T
from docquery.functions import vector as V
from docquery.operators import index, retrieve

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TOKENS = """flatten(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]*(?:[._-][A-Za-z0-9_]+)*|[0-9]+'),
  lambda w: CASE WHEN regexp_matches(w, '[._-]') THEN list_concat([lower(w)], list_filter(string_split_regex(lower(w), '[._-]'), lambda p: p <> '')) ELSE [lower(w)] END))"""
DOC_TOKENS = f"d AS MATERIALIZED (SELECT doc_id, {TOKENS} AS toks FROM documents)"
POSTINGS = f"{DOC_TOKENS}, tf AS MATERIALIZED (SELECT doc_id, dl, token, count(*) AS tf FROM (SELECT doc_id, len(toks)::INT AS dl, unnest(toks) AS token FROM d) GROUP BY ALL)"


@query(f"WITH {POSTINGS} SELECT doc_id, token, tf, dl FROM tf")
def postings_tf(spark, sf_dir):
    return index.postings(table(spark, sf_dir, "documents"), ["doc_id"])


@query(f"WITH {DOC_TOKENS} SELECT doc_id, len(toks)::INT AS dl FROM d")
def doc_length(spark, sf_dir):
    return index.doc_stats(table(spark, sf_dir, "documents"), ["doc_id"])


@query(f"WITH {POSTINGS} SELECT token, count(*) AS df FROM tf GROUP BY token")
def doc_freq(spark, sf_dir):
    return index.doc_freq(index.postings(table(spark, sf_dir, "documents"), ["doc_id"]))


@query(f"WITH {DOC_TOKENS} SELECT count(*) AS n, round(avg(len(toks)), 6) AS avgdl FROM d")
def corpus_stats(spark, sf_dir):
    stats = index.corpus_stats(index.doc_stats(table(spark, sf_dir, "documents"), ["doc_id"]))
    return stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"""WITH {DOC_TOKENS}, t AS (SELECT doc_id, unnest(toks) AS token FROM d)
SELECT doc_id, count(*) FILTER (regexp_matches(token, '[._-]')) AS compounds, count(*) AS tokens FROM t GROUP BY doc_id HAVING count(*) FILTER (regexp_matches(token, '[._-]')) > 0""")
def token_subwords(spark, sf_dir):
    """Documents with compound identifiers, and how many."""
    rows = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    rows = rows.select("doc_id", F.size(F.filter("t", lambda w: w.rlike("[._-]"))).cast("long").alias("compounds"), F.size("t").cast("long").alias("tokens"))
    return rows.where("compounds > 0")


_LATIN, _HAN = "abcdefghijklmnopqrstuvwxyz", "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余"


@query(f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, '{_LATIN}', '{_HAN}'), '[一-鿿㐀-䶿]+') AS runs FROM documents),
r AS (SELECT doc_id, unnest(runs) AS run FROM d),
t AS (SELECT doc_id, unnest(CASE WHEN length(run) = 1 THEN [run] ELSE list_transform(range(1, length(run)), lambda i: substr(run, i, 2)) END) AS token FROM r)
SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t GROUP BY token""")
def ideograph_pairs(spark, sf_dir):
    """Pairs of ideographs; the letters of the documents are mapped to ideographs first."""
    text = F.translate("text", _LATIN, _HAN)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.ideograph_pairs(text)).alias("token"))
    rows = rows.groupBy("token", "doc_id").agg(F.count("*").alias("c"))
    return rows.groupBy("token").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


@query(f"""WITH {POSTINGS}, s AS (SELECT source, sum(len(toks))::BIGINT AS tokens FROM d JOIN documents USING (doc_id) GROUP BY source),
p AS (SELECT source, count(*) AS postings FROM tf JOIN documents USING (doc_id) GROUP BY source)
SELECT source, tokens, postings, tokens > 25000 OR postings > 12000 AS disabled FROM s JOIN p USING (source)""")
def index_budget(spark, sf_dir):
    """Sources whose index exceeds 25000 tokens or 12000 postings."""
    docs = table(spark, sf_dir, "documents")
    keys = ["doc_id", "source"]
    return index.within_budget(index.postings(docs, keys), index.doc_stats(docs, keys), "source", 25_000, 12_000)


@query("""WITH t AS (SELECT source, sum(n_chars)::BIGINT AS own, sum(sum(n_chars)) OVER ()::BIGINT AS every FROM documents GROUP BY source)
SELECT source, own, greatest(1, least(2000000, greatest(0, 400000 - (every - own))))::BIGINT AS allowance FROM t""")
def lexical_allowance(spark, sf_dir):
    """What the overall limit leaves each source, with characters for tokens."""
    own = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("own"))
    every = own.agg(F.sum("own").alias("every"))
    rows = own.crossJoin(F.broadcast(every))  # one row
    return rows.select("source", "own", index.lexical_allowance(F.col("own"), F.col("every") - F.col("own"), 2_000_000, 400_000).cast("long").alias("allowance"))


@query("""SELECT doc_id, source, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'second version: ' || text ELSE text END AS text FROM documents""")
def index_replace(spark, sf_dir):
    """Labelled files are sent again with a new heading and replace their rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    new = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").withColumn("text", F.concat(F.lit("second version: "), "text"))
    return index.replace_files(docs, new, ["doc_id"])


@query("SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY source")
def index_remove(spark, sf_dir):
    """Files and characters by source once the toxic ones are removed."""
    bad = table(spark, sf_dir, "labels").where("toxic = 1")
    kept = index.remove_files(table(spark, sf_dir, "documents"), bad, ["doc_id"])
    return kept.groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))


@query("""SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type""")
def upsert_latest(spark, sf_dir):
    """The last event of each user and type: what an upsert by that key leaves."""
    rows = index.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id")
    return rows.select("user_id", "event_type", "event_id")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)
SELECT vec_id, unnest(range(0, len(e)))::INT AS pos, round(unnest(list_transform(e, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END)), 6) AS value FROM v""")
def l2_normalise(spark, sf_dir):
    rows = index.normalised(table(spark, sf_dir, "embeddings"), ["vec_id"])
    return rows.select("vec_id", F.posexplode("vec").alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("value"))


COSINE = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, list_cosine_similarity(e, qe) AS score FROM v, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)"""


@query(f"WITH {COSINE} SELECT query_id, vec_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 20")
def cosine_topk(spark, sf_dir):
    """The twenty nearest vectors of every fiftieth."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = retrieve.cosine_top_k(rows, ["vec_id"], asked, 20)
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("""WITH v AS (SELECT vec_id, CASE label % 4 WHEN 0 THEN list_transform(embedding::DOUBLE[], lambda x: 0.0::DOUBLE) WHEN 1 THEN (embedding::DOUBLE[])[1:10] WHEN 2 THEN []::DOUBLE[] ELSE embedding::DOUBLE[] END AS e FROM embeddings),
q AS (SELECT embedding::DOUBLE[] AS qe FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, round(CASE WHEN len(e) = len(qe) AND list_sum(list_transform(e, lambda x: x * x)) > 0 THEN list_cosine_similarity(e, CASE WHEN len(e) = len(qe) THEN qe ELSE e END) ELSE 0 END, 6) AS score FROM v, q""")
def cosine_edge_cases(spark, sf_dir):
    """Zero, short and empty vectors score 0 against the first vector."""
    rows = table(spark, sf_dir, "embeddings")
    zero = F.transform("embedding", lambda x: F.lit(0.0).cast("float"))
    kind = F.col("label") % 4
    odd = F.when(kind == 0, zero).when(kind == 1, F.slice("embedding", 1, 10)).when(kind == 2, F.array().cast("array<float>")).otherwise(F.col("embedding"))
    first = rows.agg(F.min_by("embedding", "vec_id").alias("q"))
    pairs = rows.select("vec_id", odd.alias("e")).crossJoin(F.broadcast(first))  # one row
    return pairs.select("vec_id", F.round(V.cosine(F.col("e"), F.col("q"), V.norm(F.col("e")), V.norm(F.col("q"))), 6).alias("score"))


BM25 = f"""{POSTINGS},
asked AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS}) AS token FROM benchmark),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
ls AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))) AS score
       FROM asked JOIN tf USING (token) JOIN df USING (token), st GROUP BY query_id, doc_id),
lex AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ls QUALIFY rank <= 20)"""
FUSED = f"""{BM25},
vs AS (SELECT item_id AS query_id, e.vec_id AS doc_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
       FROM benchmark JOIN embeddings q ON q.vec_id = item_id, embeddings e WHERE EXISTS (SELECT 1 FROM documents WHERE doc_id = e.vec_id)),
vec AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM vs QUALIFY rank <= 20),
fused AS MATERIALIZED (SELECT query_id, doc_id, coalesce(1.0::DOUBLE / (60 + vec.rank), 0) + coalesce(1.0::DOUBLE / (60 + lex.rank), 0) AS score,
                 vec.score AS vector_score, lex.score AS lexical_score,
                 CASE WHEN vec.rank IS NULL THEN 'lexical' WHEN lex.rank IS NULL THEN 'vector' ELSE 'both' END AS source
          FROM vec FULL JOIN lex USING (query_id, doc_id))"""
GATED = f"""{FUSED}, g1 AS (SELECT * FROM fused WHERE vector_score IS NULL OR vector_score >= 0.15),
gated AS MATERIALIZED (SELECT * FROM g1 QUALIFY score >= 0.5 * max(score) OVER (PARTITION BY query_id)),
kept AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM gated QUALIFY rank <= 6)"""
_HITS = "query_id, doc_id, round(score, 6) AS score, round(vector_score, 6) AS vector_score, round(lexical_score, 6) AS lexical_score, source"


def _inputs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").join(docs.select("doc_id"), "doc_id", "left_semi")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return docs, vectors, asked.join(vec, "query_id", "left")


def _hits(df, *more):
    return df.select("query_id", "doc_id", *(F.round(c, 6).alias(c) for c in ("score", "vector_score", "lexical_score")), "source", *more)


@query(f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM lex")
def bm25_topk(spark, sf_dir):
    """The twenty best documents for each benchmark item."""
    docs, _, asked = _inputs(spark, sf_dir)
    hits = retrieve.bm25(docs, ["doc_id"], asked, 20)
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _arms(spark, sf_dir):
    docs, vectors, asked = _inputs(spark, sf_dir)
    return retrieve.cosine_top_k(vectors, ["doc_id"], asked, 20), retrieve.bm25(docs, ["doc_id"], asked, 20)


@query(f"WITH {FUSED} SELECT {_HITS} FROM fused")
def rrf_fuse(spark, sf_dir):
    """Both arms of every benchmark item, fused by reciprocal ranks."""
    return _hits(retrieve.rrf(*_arms(spark, sf_dir), ["doc_id"]))


@query(f"WITH {GATED} SELECT {_HITS} FROM g1")
def gate_min_score(spark, sf_dir):
    return _hits(retrieve.gate(retrieve.rrf(*_arms(spark, sf_dir), ["doc_id"]), min_score=0.15))


@query(f"WITH {GATED} SELECT {_HITS} FROM fused QUALIFY score >= 0.5 * max(score) OVER (PARTITION BY query_id)")
def gate_ratio(spark, sf_dir):
    return _hits(retrieve.gate(retrieve.rrf(*_arms(spark, sf_dir), ["doc_id"]), min_ratio=0.5))


@query(f"WITH {GATED} SELECT {_HITS}, rank::INT AS rank FROM kept")
def hybrid_search(spark, sf_dir):
    """The six best documents of each benchmark item by both arms."""
    docs, vectors, asked = _inputs(spark, sf_dir)
    hits = retrieve.hybrid(docs, vectors, ["doc_id"], asked)
    return _hits(hits, "rank")


@query(f"WITH {BM25} SELECT query_id, doc_id, round(1.0::DOUBLE / (60 + rank), 6) AS score, rank::INT AS rank FROM lex WHERE rank <= 6")
def hybrid_lexical_only(spark, sf_dir):
    docs, vectors, asked = _inputs(spark, sf_dir)
    hits = retrieve.hybrid(docs, vectors, ["doc_id"], asked, use_vector=False)
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {FUSED}, g AS (SELECT query_id, doc_id, rank FROM vec WHERE score >= 0.15), k AS (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS score FROM g), w AS (SELECT * FROM k QUALIFY score >= 0.5 * max(score) OVER (PARTITION BY query_id)), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM w) SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM z WHERE rank <= 6")
def hybrid_vector_only(spark, sf_dir):
    docs, vectors, asked = _inputs(spark, sf_dir)
    hits = retrieve.hybrid(docs, vectors, ["doc_id"], asked, use_lexical=False)
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {GATED}, q AS (SELECT DISTINCT query_id FROM fused), c AS (SELECT query_id,
 (SELECT count(*) FROM vec WHERE vec.query_id = q.query_id) AS vector, (SELECT count(*) FROM lex WHERE lex.query_id = q.query_id) AS lexical,
 (SELECT count(*) FROM fused f WHERE f.query_id = q.query_id) AS fused, (SELECT count(*) FROM gated g WHERE g.query_id = q.query_id) AS after_gate,
 (SELECT count(*) FROM kept k WHERE k.query_id = q.query_id) AS kept, (SELECT round(max(score), 4) FROM kept k WHERE k.query_id = q.query_id) AS top1,
 (SELECT count(*) FROM kept k WHERE k.query_id = q.query_id AND source = 'vector') AS from_vector,
 (SELECT count(*) FROM kept k WHERE k.query_id = q.query_id AND source = 'lexical') AS from_lexical,
 (SELECT count(*) FROM kept k WHERE k.query_id = q.query_id AND source = 'both') AS from_both FROM q)
SELECT *, CASE WHEN vector > 0 AND lexical > 0 THEN 'hybrid' WHEN vector > 0 THEN 'vector' ELSE 'lexical' END AS mode FROM c""")
def hybrid_diag(spark, sf_dir):
    """What each step of the hybrid search left of each benchmark item."""
    vec, lex = _arms(spark, sf_dir)
    fused = retrieve.rrf(vec, lex, ["doc_id"])
    gated = retrieve.gate(fused, 0.15, 0.5)
    return retrieve.diagnosis(vec, lex, fused, gated, retrieve.ranked(gated, ["doc_id"], 6))


@query(f"""WITH {GATED} SELECT query_id, d.source AS file, min(rank)::INT AS first_rank, md5(string_agg(coalesce(d.text, ''), chr(10) ORDER BY rank)) AS text_md5
FROM kept JOIN documents d USING (doc_id) GROUP BY query_id, d.source""")
def hits_grouped(spark, sf_dir):
    """Hits joined by file, the source standing for the file."""
    docs, vectors, asked = _inputs(spark, sf_dir)
    hits = retrieve.hybrid(docs, vectors, ["doc_id"], asked).select("query_id", "doc_id", "rank")
    rows = docs.select("doc_id", F.col("source").alias("file"), "text").join(hits, "doc_id")
    return retrieve.grouped_by_file(rows, "file").select("query_id", "file", "first_rank", F.md5("text").alias("text_md5"))


@query("SELECT conv_id, arg_max(trim(text, ' \t\n\r'), turn) AS text FROM conversations WHERE role = 'user' AND trim(text, ' \t\n\r') <> '' GROUP BY conv_id")
def last_user_query(spark, sf_dir):
    return retrieve.last_user_query(table(spark, sf_dir, "conversations"))


@query("""WITH u AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM (SELECT conv_id, turn, trim(text, ' \t\n\r') AS text FROM conversations WHERE role = 'user') WHERE text <> '')
SELECT conv_id, turn, CASE WHEN prev IS NOT NULL AND NOT contains(prev, text) AND (length(text) <= 60 OR regexp_matches(text, '\\b(this|that|it)\\b')) THEN prev || ' ' || text ELSE text END AS query FROM u""")
def query_rewrite(spark, sf_dir):
    """Questions of users; short ones and those with a pronoun take the question before along."""
    said = table(spark, sf_dir, "conversations").where("role = 'user'")
    return retrieve.rewritten(said, short=60, reference="\\b(this|that|it)\\b").select("conv_id", "turn", "query")
