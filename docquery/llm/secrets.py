"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Every text is scanned for credential patterns.  A match's value is hashed, and
the hashes are counted over distinct repositories and owners.  A value that
EXAMPLE_OWNERS owners hold, or several owners in EXAMPLE_REPOS repositories together, is a widely copied
example; one owner's value is that owner's in however many repositories it lies.  What is no example and looks
live (varied characters, of a login in a URL any; no placeholder words) is somebody's credential:
`live` if it has one owner, `shared` if more.
Patterns of the base kinds always count as spans; the wider, noisier kinds add a span only where the verdict is live or shared.

Positions are code points.  They come from the lengths of the matches and of
the text between, summed up by a window over the matches of one document, so no step is worse than linear in a text.

Defined cases: null text is an empty one; null owner or repository is one of
its own; rows with equal id and text share their spans; texts without a match
get zero counts, an empty `spans` and the hash of the empty string; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.llm.common import materialise


def _either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Kind:
    """pattern: matches leftmost and apart; value: group that is the credential; needs: what a value must match; least: its length; varied: distinct characters of a live one."""

    name: str
    pattern: str
    value: int = 0
    least: int = 0
    needs: tuple[str, ...] = ()
    base: bool = True
    varied: int = 8


#: Letters of these words in either case, as classes: the same in any regex dialect.
_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
KINDS = (
    Kind("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", value=2, least=6),
    Kind("access", r"AKIA[A-Z0-9]{16,}"),
    Kind("hex", r"[0-9a-f]{24,}"),
    Kind("mixed", r"[A-Za-z0-9_-]{24,}", needs=("[a-z]", "[A-Z]", "[0-9]"), base=False),
    Kind("login", r"://[^\x00-\x20:/@]+:([^\x00-\x20:/@]+)@", value=1, least=4, base=False, varied=1),
    Kind("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x0A\x0D]*", least=64, base=False),
)
#: Words that show a made-up value.
PLACEHOLDERS = "example|sample|dummy|changeme|placeholder|your|test|xxxx|1234567|abcdef"


#: Owners, or repositories of several owners, from which on a value is an example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 6
VERDICTS = ("example", "live", "shared", "dull")


def _matches(text: Column, kind: Kind) -> Column:
    """array<struct<kind, gap, hit>>: each match and the length of the text since the one before."""
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.transform(F.split(text, kind.pattern, -1), F.length)  # one more than hits
    rows = F.zip_with(hits, gaps, lambda h, g: F.struct(F.lit(kind.name).alias("kind"), g.alias("gap"), h.alias("hit")))
    some = F.filter(rows, lambda r: r["hit"].isNotNull())
    return F.when(text.rlike(kind.pattern), some).otherwise(F.array().cast("array<struct<kind:string,gap:int,hit:string>>"))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None) -> DataFrame:
    """(doc_id, text_hash, kind, start, end, value_hash, live, owner, repo): one row per match that holds, of each distinct document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.lit(None).cast("string")
    every = F.concat(*(_matches(text, k) for k in KINDS))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), (none if owner is None else owner).cast("string").alias("owner"),
        (none if repo is None else repo).cast("string").alias("repo"), F.posexplode(every).alias("pos", "m"),
    )
    rows = rows.select("doc_id", "text_hash", "owner", "repo", "pos", "m.*")
    rows = rows.repartition("doc_id", "text_hash")  # serves the two steps below
    rows = rows.dropDuplicates(["doc_id", "text_hash", "pos", "owner", "repo"])
    upto = Window.partitionBy("doc_id", "text_hash", "owner", "repo", "kind").orderBy("pos")
    end = F.sum(F.col("gap") + F.length("hit")).over(upto)
    rows = rows.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.length("hit"))
    value, holds, varied = F.col("hit"), F.lit(True), F.lit(8)
    for k in KINDS:
        own = F.regexp_extract("hit", k.pattern, k.value) if k.value else F.col("hit")
        value = F.when(F.col("kind") == k.name, own).otherwise(value)
        fits = F.length(own) >= k.least
        for need in k.needs:
            fits = fits & own.rlike(need)
        holds = F.when(F.col("kind") == k.name, fits).otherwise(holds)
        varied = F.when(F.col("kind") == k.name, k.varied).otherwise(varied)
    live = (F.size(F.array_distinct(F.split(value, ""))) >= varied) & ~F.lower(value).rlike(PLACEHOLDERS)
    return rows.where(holds).select("doc_id", "text_hash", "kind", "start", "end", F.xxhash64(value).alias("value_hash"), live.alias("live"), "owner", "repo")


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, owners, repos): distinct owners and repositories (each within its owner) of each value. Equal rows meet on the map side."""
    pairs = found.groupBy("value_hash", "owner", "repo").agg(F.lit(1))
    by_owner = pairs.groupBy("value_hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repos"))


def classify(found: DataFrame, *, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """found with owners, repos and verdict: `example`, `live`, `shared` or `dull`; spans of noisy kinds stay only if live or shared."""
    found = materialise(found, "secret-matches")
    freq = ownership(found).withColumnRenamed("value_hash", "__hash")
    rows = found.join(freq, F.col("value_hash") == F.col("__hash")).drop("__hash")
    copied = (F.col("owners") >= example_owners) | ((F.col("owners") > 1) & (F.col("repos") >= example_repos))
    verdict = F.when(copied, "example").when(~F.col("live"), "dull").when(F.col("owners") > 1, "shared").otherwise("live")
    rows = rows.withColumn("verdict", verdict).withColumn("base", F.col("kind").isin([k.name for k in KINDS if k.base]))
    return rows.where(F.col("base") | F.col("verdict").isin("live", "shared"))


def per_document(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_<base kind>, base_sha256, spans, n_<verdict>, most_owners and most_repos of its values; one row per row of docs."""
    place = F.create_map(*(F.lit(x) for n, k in enumerate(KINDS) for x in (k.name, n)))
    spans = spans.select("doc_id", "text_hash", "kind", "start", "end", "verdict", "base", "owners", "repos").distinct()
    item = F.struct("start", place[F.col("kind")].alias("k"), F.concat_ws(":", "kind", "start", "end").alias("s"), "base")
    by_doc = spans.groupBy("doc_id", "text_hash").agg(
        *(F.count_if(F.col("kind") == k.name).alias(f"n_{k.name}") for k in KINDS if k.base),
        F.array_sort(F.collect_list(item)).alias("items"),
        *(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in VERDICTS),
        F.max("owners").alias("most_owners"),
        F.max("repos").alias("most_repos"),
    )
    by_doc = by_doc.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    rows = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left")
    joined = lambda items: F.coalesce(F.array_join(F.transform(items, lambda x: x["s"]), ","), F.lit(""))
    return rows.select(
        "doc_id", *(F.coalesce(f"n_{k.name}", F.lit(0)).cast("long").alias(f"n_{k.name}") for k in KINDS if k.base),
        F.sha2(joined(F.filter("items", lambda x: x["base"])), 256).alias("base_sha256"), joined(F.col("items")).alias("spans"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*(f"n_{v}" for v in VERDICTS), "most_owners", "most_repos")),
    )


def scan(docs: DataFrame, *, owner: Column, repo: Column, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """find, classify (limits: its options) and per_document in one."""
    found = find(docs, id_col=id_col, text_col=text_col, owner=owner, repo=repo)
    return per_document(docs, classify(found, **limits), id_col=id_col, text_col=text_col)


def redact(docs: DataFrame, spans: DataFrame, *, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span (overlapping ones together) replaced by the mark; columns as in docs."""
    order = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.select("doc_id", "text_hash", "start", "end").distinct().withColumn("done", F.coalesce(F.max("end").over(order), F.lit(0)))
    rows = rows.where("end > done")
    cuts = rows.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("done", "start", "end"))).alias("__cuts"))
    cuts = cuts.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    text = F.coalesce(F.col(text_col), F.lit(""))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash"))
    joined = docs.withColumn("__own", F.xxhash64(text)).join(cuts, same, "left")
    piece = lambda c: F.when(  # noqa: E731  a span that runs on from the one before adds nothing
        (c["start"] >= c["done"]) & ((c["start"] > c["done"]) | (c["done"] == 0)),
        F.concat(text.substr(c["done"] + 1, c["start"] - c["done"]), F.lit(mark)),
    ).otherwise("")
    tail = text.substr(F.element_at("__cuts", -1)["end"] + 1, F.length(text))
    new = F.when(F.col("__cuts").isNull(), F.col(text_col)).otherwise(F.concat(F.array_join(F.transform("__cuts", piece), ""), tail))
    return joined.select(*(new.alias(c) if c == text_col else F.col(c) for c in docs.columns))
