"""Queries over the whole tables for the operators of this subpackage, with SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm import bestfit, bpe_count, langid, matroska, mixing, packing, phrases, quality, secrets, sharding, simhash, toxicity, whitening


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped water-filling of all documents over their sources."""
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-pair token counts of all documents."""
    return bpe_count.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive quality rules over all documents."""
    judged = quality.judge(_documents(spark, sf_dir))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *base, "base_failed", "kept", "failed")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned outside the held-out fold."""
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_documents(docs, model)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by compression, learned outside the held-out fold."""
    docs = _documents(spark, sf_dir)
    return langid.identify_documents(docs, langid.fit(docs))


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as Matroska sound and read back."""
    rows = matroska.stored_texts(_documents(spark, sf_dir))
    payload = F.col("r.payload")
    parts = ("packets", "clusters", "cues", "seekable", "laced", "duration_ms", "total", "energy")
    feature = F.concat_ws(";", *(F.concat(F.lit(f"{x}="), F.col(f"r.{x}").cast("string")) for x in parts))
    return rows.select(
        "doc_id", "n_bytes", F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -16, 16)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), F.col("r.error").alias("error"),
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents; a document's source is its owner, its language within the source the repository."""
    docs = _documents(spark, sf_dir)
    return secrets.scan(docs, owner=F.col("source"), repo=F.col("lang"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum-of-squares packing of all documents into windows of 1024 tokens."""
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes, equal texts together."""
    placed = sharding.shard_documents(_documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened on their four largest components."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk-synchronous best-fit packing of all documents into windows of 2048 tokens."""
    return bestfit.best_fit(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language over all documents."""
    return phrases.mine(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_mix_sources, op2_simhash, op3_token_counts, op4_quality, op5_toxicity, op6_language, op7_matroska, op8_secrets, op9_pack, op10_shards,
            op11_whiten, op12_best_fit, op13_phrases,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op4_quality": OP4_SQL, "op8_secrets": OP8_SQL, "op13_phrases": OP13_SQL}


#: All phrases of one to four words, the cuts of the frequent ones, and what longer ones hold.
OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) x(k) WHERE len(ws) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 30),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
cut AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS c1 FROM f WHERE k > 1),
part AS (SELECT c.lang, c.k, c.phrase, c.a, c.c1, x.n AS l, y.n AS r, ((2000000::HUGEINT * c.a) // (x.n + y.n))::BIGINT AS score
         FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1 : c.c1], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.c1 + 1 :], ' ')),
best AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c1) = 1),
sub AS (SELECT lang, n, string_split(phrase, ' ') AS ws, k, unnest(range(2, k)) AS size FROM f WHERE k > 2),
held AS (SELECT lang, unnest(list_transform(range(1, k - size + 2), lambda i: array_to_string(ws[i : i + size - 1], ' '))) AS phrase, n FROM sub),
most AS (SELECT lang, phrase, max(n) AS n FROM held GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN most m ON m.lang = b.lang AND m.phrase = b.phrase WHERE m.n IS NULL OR 100::HUGEINT * m.n < 80::HUGEINT * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, total.n AS n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


#: Closed form of the water level: sources fill up in order of limit by weight.
OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS u
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         list_extract([5.0, 2.0, 1.0]::DOUBLE[], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT) AS w
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS k FROM src),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())
             - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS lvl FROM ordered),
filled AS (
  SELECT source, source_size, least(cap, w * (SELECT arg_min(lvl, k) FROM levels WHERE cap >= lvl * w)) AS target FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM filled),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY u, doc_id, size ROWS UNBOUNDED PRECEDING) - s.size AS start
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
taken AS (SELECT *, whole + CASE WHEN start + size / 2.0::DOUBLE < rest THEN 1 ELSE 0 END AS copies FROM placed)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM taken
"""


def _op8_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = [
        f"""SELECT doc_id, owner, repo, '{k.name}' AS kind, {n} AS k, {str(k.base).lower()} AS base, {k.least} AS least, {k.value} AS grp,
                unnest(range(1, len(hits) + 1)) AS pos, unnest(hits) AS hit, unnest(list_transform(gaps[1:len(hits)], lambda x: length(x))) AS gap,
                {quoted(k.pattern)} AS pattern
         FROM (SELECT *, regexp_extract_all(t, {quoted(k.pattern)}) AS hits, string_split_regex(t, {quoted(k.pattern)}) AS gaps FROM d)
         WHERE len(hits) > 0"""
        for n, k in enumerate(secrets.KINDS)
    ]
    value = " ".join(f"WHEN kind = '{k.name}' THEN regexp_extract(hit, {quoted(k.pattern)}, {k.value})" for k in secrets.KINDS if k.value)
    needs = " AND ".join(f"(kind <> '{k.name}' OR regexp_matches(v, '{x}'))" for k in secrets.KINDS for x in k.needs)
    varied = " ".join(f"WHEN '{k.name}' THEN {k.varied}" for k in secrets.KINDS)
    verdicts = ", ".join(f"count(*) FILTER (verdict = '{v}') AS n_{v}" for v in secrets.VERDICTS)
    more = ", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("n_assign", "n_access", "n_hex", *(f"n_{v}" for v in secrets.VERDICTS), "most_owners", "most_repos"))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source AS owner, lang AS repo FROM documents),
m AS ({" UNION ALL ".join(parts)}),
p AS (SELECT *, sum(gap + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS e,
             CASE {value} ELSE hit END AS v FROM m),
f AS (SELECT *, e - length(hit) AS s, length(list_distinct(string_split(v, ''))) >= CASE kind {varied} END AND NOT regexp_matches(lower(v), '{secrets.PLACEHOLDERS}') AS live
      FROM p WHERE length(v) >= least AND {needs}),
o AS (SELECT v, count(DISTINCT coalesce('=' || owner, '')) AS owners, count(DISTINCT coalesce('=' || owner, '') || chr(0) || coalesce('=' || repo, '')) AS repos FROM f GROUP BY v),
c AS (SELECT f.*, owners, repos, CASE WHEN owners >= {secrets.EXAMPLE_OWNERS} OR owners > 1 AND repos >= {secrets.EXAMPLE_REPOS} THEN 'example' WHEN NOT live THEN 'dull' WHEN owners > 1 THEN 'shared' ELSE 'live' END AS verdict
      FROM f JOIN o USING (v)),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (base) AS b,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans, max(owners) AS most_owners, max(repos) AS most_repos, {verdicts}
      FROM c WHERE base OR verdict IN ('live', 'shared') GROUP BY doc_id)
SELECT d.doc_id, {more}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""


OP8_SQL = _op8_sql()


def _op4_sql() -> str:
    per = lambda part, rest: f"greatest(1, ({part} + 1) * 1000000 // (greatest(0, {rest}) + 1))::BIGINT"
    mean = f"((coalesce(dup, 0)::DOUBLE + {quality.MEAN_LINES} * (all_dup / all_lines)) / (coalesce(lines, 0)::DOUBLE + {quality.MEAN_LINES}))"
    measures = {
        "symbols": per("n_symbols", "word_chars - n_symbols"), "capitals": per("n_capitals", "word_chars - n_capitals"),
        "dup_lines": f"greatest(1, floor(1000000::DOUBLE * (n_dup_lines + {quality.PRIOR_LINES} * {mean}) / (n_lines - n_dup_lines + 1)::DOUBLE)::BIGINT)",
        "repeats": per("2 * n_repeat_words", "n_words - 2 * n_repeat_words"), "word_length": per("word_chars", "n_words"),
    }
    fence = lambda start, step: "CASE m " + " ".join(f"WHEN '{m}' THEN {start}::DOUBLE{f' {step} ratio' * reach}" for m, (reach, _) in quality.MEASURES.items()) + " END"
    both = ", ".join(f"'{m}'" for m, (_, below) in quality.MEASURES.items() if below)
    longer = " UNION ALL ".join(f"SELECT doc_id, lang, source, base_failed, '{m}' AS m, {m} AS v FROM b" for m in quality.MEASURES)
    failed = " || ".join(f"coalesce(max(CASE WHEN m = '{m}' AND out THEN ',{m}' END), '')" for m in quality.MEASURES)
    value = "(CASE WHEN place < 64 THEN place ELSE (place % 64) * pow(2, place // 64) END)"
    marks = lambda keys, source: f"""SELECT {keys} m, max(docs) AS docs, min(CASE WHEN upto * 4 >= docs THEN {value} END)::BIGINT AS q1, min(CASE WHEN upto * 4 >= docs * 3 THEN {value} END)::BIGINT AS q3
      FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} m ORDER BY place) AS upto, sum(n) OVER (PARTITION BY {keys} m) AS docs FROM ({source})) GROUP BY {keys} m"""  # noqa: E731
    return rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(ws) AS a, unnest(range(len(ws))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t)),
g AS (SELECT doc_id, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i FROM g WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
r AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM k, range(3) x(d) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
f AS (SELECT t.doc_id, lang, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals, len(ls) AS n_lines,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM t JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
z AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
zs AS (SELECT lang AS zl, source AS zs, count(*) FILTER (n_dup_lines > 0) AS dup, sum(n_lines)::BIGINT AS lines FROM z WHERE NOT base_failed GROUP BY ALL),
za AS (SELECT coalesce(sum(dup), 0)::DOUBLE AS all_dup, coalesce(sum(lines), 1)::DOUBLE AS all_lines FROM zs),
b AS (SELECT z.*, {", ".join(f"{x} AS {m}" for m, x in measures.items())} FROM z LEFT JOIN zs ON lang IS NOT DISTINCT FROM zl AND source IS NOT DISTINCT FROM zs.zs, za),
v AS ({longer}),
s AS (SELECT lang, source, m, greatest(length(bin(v)) - 6, 0) * 64 + (v >> greatest(length(bin(v)) - 6, 0)::INT) AS place, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
q1 AS ({marks("lang, source,", "SELECT * FROM s")}),
q2 AS ({marks("lang,", "SELECT lang, m, place, sum(n) AS n FROM s GROUP BY ALL")}),
q3 AS ({marks("", "SELECT m, place, sum(n) AS n FROM s GROUP BY ALL")}),
h AS (SELECT q1.lang, q1.source, q1.m, CASE WHEN q1.docs >= {quality.LEAST_DOCS} THEN q1.q1 WHEN q2.docs >= {quality.LEAST_DOCS} THEN q2.q1 ELSE q3.q1 END AS a,
        CASE WHEN q1.docs >= {quality.LEAST_DOCS} THEN q1.q3 WHEN q2.docs >= {quality.LEAST_DOCS} THEN q2.q3 ELSE q3.q3 END AS z
      FROM q1 JOIN q2 ON q1.lang IS NOT DISTINCT FROM q2.lang AND q1.m = q2.m JOIN q3 ON q1.m = q3.m),
y AS (SELECT lang, source, m, {fence("z", "*")} AS hi, {fence("a", "/")} AS lo FROM (SELECT *, greatest(z / a, 33::DOUBLE / 32) AS ratio FROM h)),
e AS (SELECT v.doc_id, v.m, v.v > hi OR (v.m IN ({both}) AND v.v < lo) AS out
      FROM v JOIN y ON v.lang IS NOT DISTINCT FROM y.lang AND v.source IS NOT DISTINCT FROM y.source AND v.m = y.m),
d AS (SELECT doc_id, substr({failed}, 2) AS failed FROM e GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(failed, '') AS failed, NOT base_failed AND coalesce(failed, '') = '' AS kept FROM b LEFT JOIN d USING (doc_id)
"""


OP4_SQL = _op4_sql()
