"""The engine: tables of one store under a folder, and what a chat service asks of them.

Files come in as DataFrames and are parsed, deduplicated by content, chunked, indexed and embedded; questions are
batches.  A model (embedder) is any function from texts to vectors.  The store keeps a partition per session: a write replaces the
partitions of the sessions it touches and leaves all other files alone, and an engine opened on the folder later sees what is there.
A search opens one session's partitions; its postings are sorted by token, so only the asked tokens' pages are read, and no text is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.config import EngineConfig
from docquery.functions import media, urls
from docquery.functions import text as T
from docquery.operators import chunk, index, retrieve, session, state
from docquery.operators.keys import join_on
from docquery.operators.store import Store, Taken, partition_name
from docquery.plans.scratch import written
from docquery.sources import formats
from docquery.sources.messages import from_group, session_key

FILE_KEYS = ["session_id", "conversation_id", "file_name"]
CHUNK_KEYS = [*FILE_KEYS, "chunk_index"]
CONTENT_KEYS = ["session_id", "conversation_id", "sha256"]
FILES = (
    "session_id string, conversation_id string, file_name string, text string, total_chars int, sha256 string, upload_time timestamp, last_used timestamp, rounds int, notes array<string>, "
    "n_bytes long, n_chunks long, n_tokens long, n_postings long"
)
CHUNKS = "session_id string, conversation_id string, file_name string, chunk_index int, text string, dl int"
POSTINGS = "session_id string, conversation_id string, file_name string, chunk_index int, token string, tf long, dl int"
ERRORS = "session_id string, conversation_id string, file_name string, error string, upload_time timestamp"
MEMO = "session_id string, query string, mode string, context string, at timestamp"
ROUNDS = "session_id string, query_key string, at timestamp"
VECTORS = "session_id string, conversation_id string, file_name string, chunk_index int, embedding array<float>"
BUNDLES = "session_id string, conversation_id string, file_name string, text string, sha256 string, upload_time timestamp, notes array<string>, attempts int, next_at timestamp, n_bytes long"
SUMMARIES = "session_id string, conversation_id string, file_name string, sha256 string, state string, worker string, at timestamp, summary string"
TABLES = {
    "files": FILES, "chunks": CHUNKS, "postings": POSTINGS, "vectors": VECTORS, "errors": ERRORS, "memo": MEMO, "counted": ROUNDS, "bundles": BUNDLES, "summaries": SUMMARIES,
}
ORDER = {
    "files": ["file_name"], "chunks": ["file_name", "chunk_index"], "postings": ["token", "file_name", "chunk_index"], "vectors": ["file_name", "chunk_index"],
    "errors": ["file_name"], "memo": ["query"], "counted": ["query_key"], "bundles": ["file_name"], "summaries": ["file_name"],
}
CONTENT = ("files", "chunks", "postings", "vectors")
#: What is told of a refusal, by its code; parse errors speak for themselves.
REPLIES = {
    "too_large": "the file is larger than allowed", "data_budget": "there is no room for the file now", "no text": "the file has no text",
    "missing_dependency": "files of this kind cannot be read here", "embed_queued": "the file was read, and will be searchable once the model answers again",
    "embed_failed": "the model did not answer, please send the file again", "retry_disk_full": "the model does not answer, and no more files can wait for it",
}
#: Refusals that another attempt may mend.
PASSING = ("unavailable", "data_budget", "embed_queued")
#: Up to so many asked tokens are handed to the scan one by one; more are cut by a join.
MOST_PUSHED = 200


def of_tokens(postings: DataFrame, tokens: list[str]) -> DataFrame:
    """The postings of some tokens; as equalities they reach the scan one by one, and skip what lies between them."""
    return postings.where(reduce(lambda a, b: a | b, (F.col("token") == t for t in tokens)))


class Engine:
    """One store. `path` must be a folder that all executors see; a folder with a store in it is opened as it is."""

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig | None = None, embedder: Callable[[list[str]], list] = index.character_histogram):
        self.spark, self.config, self.embedder = spark, config or EngineConfig(), embedder
        self.store = Store(spark, path, TABLES, ORDER)

    def __getattr__(self, name: str) -> DataFrame:
        """A whole table by its name: files, chunks, postings, vectors, errors, memo, counted."""
        if name in TABLES:
            return self.store.table(name)
        raise AttributeError(name)

    def ingest(self, incoming: DataFrame) -> DataFrame:
        """incoming: session_id, conversation_id, file_name, content, upload_time. Returns the refused files with their errors.

        Files whose bytes the conversation has already, or gets from an earlier file of the batch, are only touched; equal names replace. Null keys are keys.
        """
        c = self.config
        keyed = written(index.latest(incoming, FILE_KEYS, "upload_time").withColumn("sha256", F.sha2("content", 256)), "incoming")
        touched = keyed.select("session_id").distinct()
        old = dict(zip((*CONTENT, "errors"), self.store.touched(touched, *CONTENT, "errors")))
        known, new = state.split_known(keyed, old["files"], CONTENT_KEYS)
        new = state.content_dedup(new, ["session_id", "conversation_id"], F.col("content"), ["upload_time", "file_name"])
        twins, new = new.where("reused").drop("reused"), new.where("not reused").drop("reused")
        big = (F.length("content") > c.max_file_bytes) & F.lit(c.max_file_bytes > 0)
        small = new.where(~F.coalesce(big, F.lit(False)))
        limits = formats.Limits(member_bytes=c.unzip_bytes, text_chars=c.text_chars)
        parsed = formats.parse_files(small, [*FILE_KEYS, "sha256", "upload_time"], limits=limits)
        blank = T.strip(F.coalesce("text", F.lit(""))) == ""
        parsed = written(parsed.withColumn("error", F.when(blank, F.coalesce("error", F.lit("no text"))).otherwise(F.col("error"))), "parsed")
        good = parsed.where("error is null")
        refusal = [*FILE_KEYS, "sha256", "error", "upload_time"]
        refused = parsed.where("error is not null").select(*refusal)
        if c.data_budget_bytes:
            good = written(self._within_data_budget(good, old["files"]), "admitted")
            refused = refused.unionByName(good.where("not admitted").withColumn("error", F.lit("data_budget")).select(*refusal))
            good = good.where("admitted")
        refused = refused.unionByName(new.where(big).withColumn("error", F.lit("too_large")).select(*refusal))
        alike = refused.groupBy(*CONTENT_KEYS).agg(F.min("error").alias("error"))
        refused = written(refused.unionByName(join_on(twins, alike, CONTENT_KEYS).select(*refusal)).drop("sha256"), "refused")
        made, failed = self._indexed(good)
        queued, told = self._queued(good, failed, touched)
        seen = known.select(*CONTENT_KEYS, "upload_time").unionByName(twins.select(*CONTENT_KEYS, "upload_time")).groupBy(*CONTENT_KEYS).agg(F.max("upload_time").alias("__seen"))
        files = join_on(index.replace_files(old["files"], made["files"], FILE_KEYS), seen, CONTENT_KEYS, "left")
        made["files"] = files.withColumn("last_used", F.greatest("last_used", "__seen")).drop("__seen").select(*old["files"].columns)
        changed = {n: index.replace_files(old[n], made[n], FILE_KEYS) for n in ("chunks", "postings", "vectors")} | {"files": made["files"]}
        refused = refused.unionByName(told)
        errors = index.replace_files(index.remove_files(old["errors"], good, FILE_KEYS), refused, FILE_KEYS)
        # answers of sessions whose files changed no longer hold
        self.store.replace(touched, {**changed, "errors": errors, "memo": self._none("memo"), "bundles": queued})
        return refused.select(*FILE_KEYS, "error")

    def _indexed(self, good: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
        """New rows of the content tables for files (FILE_KEYS, text, sha256, upload_time, notes), and the keys of files that the model gave no vectors for."""
        c = self.config
        tokenised = chunk.chunked(good, FILE_KEYS, c.chunk_size, c.chunk_overlap, c.chunk_merge).withColumn("__t", T.tokens(F.col("text")))
        chunks = written(tokenised.withColumn("dl", F.size("__t")), "chunks")
        vectors = written(index.embed(chunks, CHUNK_KEYS, self.embedder, batch=c.embed_batch, tolerant=True), "vectors")
        failed = written(vectors.where("embedding is null").select(*FILE_KEYS).distinct(), "failed")
        chunks, vectors, good = (join_on(df, failed, FILE_KEYS, "left_anti") for df in (chunks, vectors, good))
        posted = written(T.term_counts(chunks.withColumnRenamed("__t", "tokens"), "tokens").select(*CHUNK_KEYS, "token", "tf", "dl"), "postings")
        sizes = chunks.groupBy(*FILE_KEYS).agg(F.count("*").alias("n_chunks"), F.sum("dl").alias("n_tokens"))
        rows = good.select(
            *FILE_KEYS, "text", F.length("text").alias("total_chars"), "sha256", "upload_time", F.col("upload_time").alias("last_used"), F.lit(0).alias("rounds"), "notes",
            F.octet_length("text").cast("long").alias("n_bytes"),
        )
        rows = join_on(rows, sizes, FILE_KEYS, "left")
        rows = join_on(rows, posted.groupBy(*FILE_KEYS).agg(F.count("*").alias("n_postings")), FILE_KEYS, "left").na.fill(0, ["n_chunks", "n_tokens", "n_postings"])
        return {"files": rows, "chunks": chunks.drop("__t"), "postings": posted, "vectors": vectors}, failed

    def _queued(self, good: DataFrame, failed: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(retry bundles of the touched sessions, what is told of new ones): files without vectors wait with their text, as far as the room for that goes.

        A file that comes again replaces its bundle; the room that bundles take is counted by the store.
        """
        c = self.config
        (old,) = self.store.touched(touched, "bundles")
        kept = index.remove_files(old, good, FILE_KEYS)
        first = F.col("upload_time") + F.make_dt_interval(secs=F.lit(c.retry_first_seconds))
        new = join_on(good, failed, FILE_KEYS, "left_semi").select(
            *FILE_KEYS, "text", "sha256", "upload_time", "notes", F.lit(0).alias("attempts"), first.alias("next_at"), F.octet_length("text").cast("long").alias("n_bytes")
        )
        fits = F.lit(True)
        if c.retry_disk_bytes and not failed.isEmpty():
            held = self.store.live().where("name = 'bundles'").agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
            freed = join_on(old, good.select(*FILE_KEYS).distinct(), FILE_KEYS, "left_semi").agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
            room = max(0, c.retry_disk_bytes - int(held) + int(freed))
            new = state.budget_admission(new.withColumn("__all", F.lit(0)), "__all", ["upload_time", *FILE_KEYS], "n_bytes", room).drop("__all")
            fits = F.col("admitted")
        new = written(new.withColumn("error", F.when(fits, "embed_queued").otherwise("retry_disk_full")), "bundles")
        return kept.unionByName(new.where("error = 'embed_queued'").select(*old.columns)), new.select(*FILE_KEYS, "error", "upload_time")

    def retry(self, now) -> DataFrame:
        """Ask the model again for the bundles that are due; FILE_KEYS with outcome: stored, waiting or embed_failed.

        What it answers for enters the store and its bundle goes; after the last attempt the bundle goes too.
        """
        c, at = self.config, F.lit(now).cast("timestamp")
        due = written(self.bundles.where(F.col("next_at") <= at), "due")
        if due.isEmpty():
            return due.select(*FILE_KEYS, F.lit("stored").alias("outcome"))
        old = dict(zip((*CONTENT, "errors", "bundles"), self.store.touched(due, *CONTENT, "errors", "bundles")))
        made, failed = self._indexed(due)
        tried = join_on(due, failed.withColumn("__failed", F.lit(True)), FILE_KEYS, "left").withColumn("attempts", F.col("attempts") + 1)
        outcome = F.when(F.col("__failed").isNull(), "stored").when(F.col("attempts") >= max(1, c.retry_max), "embed_failed").otherwise("waiting")
        wait = F.make_dt_interval(secs=F.lit(int(max(0.5, c.retry_minutes) * 60)))
        tried = written(tried.withColumn("outcome", outcome).withColumn("next_at", at + wait).drop("__failed"), "tried")
        changed = {n: index.replace_files(old[n], made[n].select(*old[n].columns), FILE_KEYS) for n in CONTENT}
        changed["bundles"] = index.remove_files(old["bundles"], tried, FILE_KEYS).unionByName(tried.where("outcome = 'waiting'").select(*old["bundles"].columns))
        lost = tried.where("outcome = 'embed_failed'").select(*FILE_KEYS, F.col("outcome").alias("error"), "upload_time")
        changed["errors"] = index.remove_files(old["errors"], tried.where("outcome <> 'waiting'"), FILE_KEYS).unionByName(lost)
        self.store.replace(due, changed | {"memo": self._none("memo")})
        return tried.select(*FILE_KEYS, "outcome")

    def replies(self, refused: DataFrame) -> DataFrame:
        """refused (with error) and the reply for the sender."""
        texts = F.create_map(*(F.lit(x) for pair in REPLIES.items() for x in pair))
        return refused.withColumn("reply", F.coalesce(texts[F.col("error")], F.col("error")))

    def with_settings(self, **changes) -> Engine:
        """An engine on the same store with other settings."""
        return Engine(self.spark, self.store.path, replace(self.config, **changes), self.embedder)

    def _none(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], TABLES[name])

    def _within_data_budget(self, good: DataFrame, old: DataFrame) -> DataFrame:
        """good with admitted: the store's texts are bounded in sum; a file that replaces one of its name frees that one's room.

        What is held comes from the counts that the store keeps of each partition.
        """
        held = self.store.live().where("name = 'files'").agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
        freed = join_on(old, good.select(*FILE_KEYS).distinct(), FILE_KEYS, "left_semi").agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
        rows = good.withColumns({"__all": F.lit(0), "__bytes": F.octet_length("text")})
        room = max(0, self.config.data_budget_bytes - int(held) + int(freed))
        return state.budget_admission(rows, "__all", ["upload_time", *FILE_KEYS], "__bytes", room).drop("__all", "__bytes")

    def clear(self, gone: DataFrame) -> None:
        """Remove sessions (gone: session_id) or files (gone: the file keys)."""
        gone = written(gone, "gone")
        keys = [k for k in FILE_KEYS if k in gone.columns]
        tables = (*CONTENT, "bundles", "summaries")
        left = {n: index.remove_files(df, gone, keys) for n, df in zip(tables, self.store.touched(gone, *tables))}
        self.store.replace(gone, left | {"memo": self._none("memo")})

    def expire(self, now) -> DataFrame:
        """Remove what is idle, used up or old at a time; returns the removed files with the reason."""
        c = self.config
        aged = state.expired(self.files, F.lit(now), retention=60 * c.retention_minutes, max_rounds=c.max_rounds, absolute_ttl=60 * c.absolute_ttl_minutes)
        gone = written(aged.where("expiry is not null").select(*FILE_KEYS, "expiry"), "expired")
        self.clear(gone.drop("expiry"))
        return gone

    def touch(self, used: DataFrame, now) -> None:
        """Files that were given to a model stay longer and count a round.

        used may have query_key: one question counts a round at most every `round_seconds`; without it every call counts.
        """
        at = F.lit(now).cast("timestamp")
        keyed = written(used.select(*FILE_KEYS, (F.col("query_key") if "query_key" in used.columns else F.lit(None).cast("string")).alias("query_key")), "used")
        files, counted = self.store.touched(keyed, "files", "counted")
        late = counted.where(F.unix_seconds("at") > F.unix_seconds(at) - self.config.round_seconds)
        again = late.where("query_key is not null").select("session_id", "query_key").distinct()
        fresh = written(join_on(keyed, again, ["session_id", "query_key"], "left_anti").distinct(), "rounds")
        hit = keyed.select(*FILE_KEYS).distinct().withColumn("__hit", F.lit(True))
        counts = fresh.select(*FILE_KEYS).distinct().withColumn("__counts", F.lit(1))
        rows = join_on(join_on(files, hit, FILE_KEYS, "left"), counts, FILE_KEYS, "left")
        rows = rows.withColumn("rounds", F.col("rounds") + F.coalesce("__counts", F.lit(0)))
        rows = rows.withColumn("last_used", F.when(F.col("__hit"), at).otherwise(F.col("last_used")))
        new = fresh.where("query_key is not null").select("session_id", "query_key", at.alias("at")).distinct()
        self.store.replace(keyed, {"files": rows.select(*files.columns), "counted": late.unionByName(new)})

    def embed_queries(self, queries: DataFrame) -> DataFrame:
        """queries with embedding, null where the model failed."""
        return queries.join(written(index.embed(queries, ["query_id"], self.embedder, batch=self.config.embed_batch, tolerant=True), "embedded"), "query_id")

    def search(self, queries: DataFrame, session_id: str | None, use_vector: bool = True) -> DataFrame:
        """query_id, file_name, chunk_index, text, score, source, rank of questions (query_id, text) to one session."""
        c = self.config
        files, chunks, vectors, postings = self.store.of_sessions([session_id], "files", "chunks", "vectors", "postings")
        lists = self._none("chunks").select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), *CHUNK_KEYS, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        vec = retrieve.cosine_top_k(vectors, CHUNK_KEYS, self.embed_queries(queries), c.candidates) if use_vector else lists
        lex = lists
        if c.hybrid or not use_vector:
            n, total, allowed = self._lexical_sizes(files, session_id)
            if allowed:
                lex = self._lexical(queries, postings, n, total)
        hits = retrieve.fused(vec, lex, CHUNK_KEYS, rrf_k=c.rrf_k, min_score=c.min_score, min_ratio=c.min_ratio, top_k=c.top_k)
        return join_on(hits, chunks.drop("dl"), CHUNK_KEYS)

    def _lexical(self, queries: DataFrame, postings: DataFrame, n: int, total: int) -> DataFrame:
        """Hits by BM25 from the stored postings: the scan gets the asked tokens, and skips pages without them."""
        asked = written(retrieve.query_tokens(queries), "asked")
        tokens = [r.token for r in asked.select("token").distinct().limit(MOST_PUSHED + 1).collect()]
        if not tokens or not n:
            return self._none("chunks").select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), *CHUNK_KEYS, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        if len(tokens) <= MOST_PUSHED:
            postings = of_tokens(postings, tokens)
        return retrieve.ranked(retrieve.bm25_of_postings(postings, CHUNK_KEYS, asked, n, total / n), CHUNK_KEYS, self.config.candidates)

    def _lexical_sizes(self, files: DataFrame, session_id: str | None) -> tuple[int, int, bool]:
        """Chunks and tokens of the session, and whether these and its postings are within its own limits and what others leave of the overall one.

        The other sessions' tokens come from the counts that the store keeps of each partition.
        """
        c, none = self.config, F.lit(0)
        n, mine, postings = files.agg(*(F.coalesce(F.sum(x), none) for x in ("n_chunks", "n_tokens", "n_postings"))).first()
        fits = not c.lexical_postings or postings <= c.lexical_postings
        if fits and (c.lexical_tokens or c.lexical_global_tokens):
            others = self.store.live().where((F.col("name") == "files") & (F.col("p") != partition_name(session_id))).agg(F.coalesce(F.sum("n_tokens"), none).alias("others"))
            most = others.select(index.lexical_allowance(F.lit(mine), F.col("others"), c.lexical_tokens, c.lexical_global_tokens)).first()[0]
            fits = mine <= most
        return int(n), int(mine), fits

    def resolve(self, requests: DataFrame) -> DataFrame:
        """request_id, asked, session_id: the asked session if it has files, else the only one that has."""
        return session.resolve(requests, self.files)

    def questions(self, turns: DataFrame, conversation: str = "conv_id") -> DataFrame:
        """query_id (the conversation), text: what its user said last, with the question before it where it leans on that."""
        if not self.config.rewrite_queries:
            return retrieve.last_user_query(turns, conversation).withColumnRenamed(conversation, "query_id")
        said = retrieve.rewritten(turns.where("role = 'user'"), conversation)
        return said.groupBy(F.col(conversation).alias("query_id")).agg(F.max_by("query", "turn").alias("text"))

    def context(self, queries: DataFrame, session_id: str | None, now=None, injected: DataFrame | None = None) -> DataFrame:
        """query_id, mode, context: all texts where they fit, else the hits by file.

        With `now`, answers of the last `memo_seconds` are given again, and new ones are kept.  injected (query_id, item_id,
        text): what a question has been given already; where that holds a context, none is added.
        """
        if injected is not None:
            had = session.already_injected(injected).where("injected").select("query_id")
            queries = queries.join(had, "query_id", "left_anti")
        if now is None or not self.config.memo_seconds:
            return self._context(queries, session_id)
        at, keep = F.lit(now).cast("timestamp"), self.config.memo_seconds
        (memo,) = self.store.of_sessions([session_id], "memo")
        young = memo.where(F.unix_seconds(at) - F.unix_seconds("at") <= keep)
        asked = queries.select("query_id", F.col("text").alias("query"))
        known = asked.join(young.select("query", "mode", "context"), "query")
        left = queries.join(known.select("query_id"), "query_id", "left_anti")
        answers = known.select("query_id", "query", "mode", "context", F.lit(False).alias("new"))
        if left.isEmpty():
            return answers.select("query_id", "mode", "context")
        new = self._context(left, session_id).join(asked, "query_id")
        out = written(answers.unionByName(new.select("query_id", "query", "mode", "context", F.lit(True).alias("new"))), "answers")
        fresh = out.where("new").groupBy("query").agg(F.min("mode").alias("mode"), F.min("context").alias("context"))
        one = self.spark.createDataFrame([(session_id,)], "session_id string")
        self.store.replace(one, {"memo": young.unionByName(fresh.select(F.lit(session_id).alias("session_id"), "query", "mode", "context", at.alias("at")))})
        return out.select("query_id", "mode", "context")

    def _context(self, queries: DataFrame, session_id: str | None) -> DataFrame:
        (mine,) = self.store.of_sessions([session_id], "files")
        whole = session.direct_text(mine, "session_id", self.config.direct_limit).limit(1).collect()  # bounded by the limit
        if whole:
            return queries.select("query_id", F.lit("direct").alias("mode"), F.lit(whole[0].context).alias("context"))
        heads = self._summary_heads(session_id)
        files = retrieve.grouped_by_file(self.search(queries, session_id), "file_name")
        block = F.concat(F.lit("《"), F.col("file_name"), F.lit("》\n"), F.col("text"))
        items = F.array_sort(F.collect_list(F.struct("first_rank", block.alias("t"))))
        out = files.groupBy("query_id").agg(F.array_join(F.transform(items, lambda x: x["t"]), "\n").alias("context"))
        found = F.concat(F.lit(heads + "\n"), F.col("context")) if heads else F.col("context")
        out = out.select("query_id", F.lit("retrieved").alias("mode"), found.alias("context"))
        # summaries take the place of hits only where neither arm could look: no vector of the question, and no index
        if not heads or self.config.hybrid and self._lexical_sizes(mine, session_id)[2]:
            return out
        blind = self.embed_queries(queries).where("embedding is null").select("query_id", F.lit("summary").alias("mode"), F.lit(heads).alias("context"))
        return out.unionByName(blind.join(out.select("query_id"), "query_id", "left_anti"))

    def _summary_heads(self, session_id: str | None) -> str:
        """The session's summaries by file; each is short, and a session has one a file."""
        (rows,) = self.store.of_sessions([session_id], "summaries")
        held = rows.where("state = 'done'").select("file_name", F.left("summary", F.lit(self.config.summary_most_chars)).alias("summary")).orderBy("file_name").collect()
        return "\n".join(f"《{r.file_name}》概要：\n{r.summary}" for r in held)

    def items(self, contexts: DataFrame) -> DataFrame:
        """A system item for each context (query_id, mode, context): item_id, kind and text; the id tells later calls that it was given."""
        kind = F.when(F.col("mode") == "summary", "summary").otherwise("context")
        ident = F.concat_ws(":", F.lit("docquery"), kind, F.md5(F.concat_ws(":", F.col("query_id").cast("string"), F.col("context"))))
        return contexts.select("query_id", F.lit("system").alias("item_type"), ident.alias("item_id"), kind.alias("kind"), F.col("context").alias("text"))

    def accepted(self, triggers: DataFrame, tie: str = "event_id") -> DataFrame:
        """triggers (session_id, ident, ts) that start work: none within `dedup_seconds` of the last that did."""
        return state.greedy_window(triggers, ["session_id", "ident"], "ts", self.config.dedup_seconds, tie)

    def checked_links(self, links: DataFrame) -> DataFrame:
        """links (url) with the reason against fetching each by the download policy, and what the sender is told."""
        c = self.config
        reason = F.lit(None).cast("string") if c.download_policy == "off" else urls.reject_reason(F.col("url"), c.download_policy, urls.host_list(F.lit(c.allowed_hosts)))
        return links.withColumn("reason", reason).withColumn("reply", urls.reply(F.col("reason")))

    def checked_media(self, incoming: DataFrame, time: str = "upload_time") -> DataFrame:
        """Sound and video files (file_name, content) with kind, seconds and the reason against sending each to a model."""
        c, ext = self.config, media.extension(F.col("file_name"))
        rows = incoming.withColumn("kind", media.media_kind(ext)).where("kind in ('audio', 'video')").withColumn("seconds", media.duration(F.col("content")))
        size, seconds = F.length("content"), F.col("seconds")
        reason = F.when(F.col("kind") == "audio", media.audio_reject(ext, size, seconds, c.audio_bytes, c.audio_seconds))
        rows = rows.withColumn("reason", reason.otherwise(media.video_reject(ext, size, seconds, c.video_bytes, c.video_seconds)))
        fine = state.daily_quota(rows.where("kind = 'video' and reason is null"), time, "file_name", c.video_per_day)
        fine = fine.withColumn("reason", F.when(~F.col("admitted"), F.lit("quota"))).drop("day", "place", "admitted")
        return rows.where("kind = 'audio' or reason is not null").unionByName(fine)

    def summary_inputs(self) -> DataFrame:
        """What summaries are made from: samples of the files of sessions that don't fit in full."""
        large = session.direct_fits(self.files, "session_id", self.config.direct_limit).where("not direct").select("session_id")
        rows = self.files.join(large, "session_id", "left_semi")
        return rows.select(*FILE_KEYS, T.sample_for_summary(F.col("text"), self.config.summary_chars).alias("sample"))

    def claim_summaries(self, worker: str, now, attempts: int = 5) -> DataFrame:
        """FILE_KEYS and sample of the files that this worker is to summarise; each is claimed by one worker until its claim expires.

        A file is up for a claim if its session doesn't fit in full, its bytes have no summary, no claim is young enough and
        no failure is within its cooldown.  Of two workers who claim at once the store lets one commit; the other looks again.
        """
        c, at = self.config, F.lit(now).cast("timestamp")
        for turn in range(attempts):
            base = self.store.next_number()
            wanted = self.summary_inputs().join(self.files.select(*(F.col(k).alias(f"__{k}") for k in FILE_KEYS), "sha256"), self._same_file()).drop(*(f"__{k}" for k in FILE_KEYS))
            age = F.unix_seconds(at) - F.unix_seconds("at")
            busy = ((F.col("state") == "claimed") & (age < c.summary_claim_seconds)) | ((F.col("state") == "failed") & (age < c.summary_retry_seconds)) | (F.col("state") == "done")
            mine = written(join_on(wanted, self.summaries.where(busy).select(*FILE_KEYS, "sha256"), [*FILE_KEYS, "sha256"], "left_anti"), "claims")
            if mine.isEmpty() or self._put_summaries(mine.select(*FILE_KEYS, "sha256", F.lit("claimed").alias("state"), F.lit(worker).alias("worker"), at.alias("at"), F.lit(None).cast("string").alias("summary")), base):
                return mine.drop("sha256")
        return mine.drop("sha256").limit(0)

    @staticmethod
    def _same_file():
        return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in FILE_KEYS))

    def _put_summaries(self, rows: DataFrame, base: int | None = None) -> bool:
        """Replace rows of these files; False if base is given and another commit came first."""
        (old,) = self.store.touched(rows, "summaries")
        try:
            self.store.replace(rows, {"summaries": index.replace_files(old, rows, FILE_KEYS)}, base)
        except Taken:
            return False
        return True

    def store_summaries(self, made: DataFrame, worker: str, now) -> None:
        """made: FILE_KEYS, summary (null or blank: it failed, and waits for its cooldown). Only what the worker has claimed, of the bytes it claimed, is taken."""
        at = F.lit(now).cast("timestamp")
        given = made.select(*FILE_KEYS, F.col("summary").alias("__summary"))
        claims = join_on(self.summaries.where((F.col("state") == "claimed") & (F.col("worker") == worker)), given, FILE_KEYS)
        fine = F.length(F.trim(F.coalesce("__summary", F.lit("")))) > 0
        rows = claims.select(*FILE_KEYS, "sha256", F.when(fine, "done").otherwise("failed").alias("state"), "worker", at.alias("at"), F.when(fine, F.col("__summary")).alias("summary"))
        rows = written(join_on(rows, self.files.select(*FILE_KEYS, "sha256"), [*FILE_KEYS, "sha256"], "left_semi"), "summaries")
        if not rows.isEmpty():
            self._put_summaries(rows)

    def wanted(self, messages: DataFrame, body: str = "body") -> DataFrame:
        """messages that files are taken from (all, or those outside groups) with the session_id that each names."""
        kept = messages if self.config.enable_group else messages.where(~from_group(F.col(body)))
        return kept.withColumn("session_id", session_key(F.col(body)))

    def waiting(self, now) -> DataFrame:
        """session_id, listed, waited: a line for each session on the files that are read but not searchable yet."""
        started = self.bundles.select("session_id", "file_name", F.unix_seconds("upload_time").alias("started"))
        return session.parsing_notice(started, F.unix_seconds(F.lit(now).cast("timestamp")))

    def failures(self, now) -> DataFrame:
        """session_id, file_name, error: the newest refusals of each session, young enough; what is given once is not given again."""
        c = self.config
        new = state.notices(self.errors, "session_id", "file_name", "upload_time", "conversation_id", F.lit(now), ttl=c.notice_seconds, most=c.notices_per_session)
        given = written(new.select(*FILE_KEYS, "error", "upload_time"), "notices")
        if not given.isEmpty():
            (errors,) = self.store.touched(given, "errors")
            self.store.replace(given, {"errors": index.remove_files(errors, given.where(~F.col("error").isin(*PASSING)), FILE_KEYS)})
        return given.select("session_id", "file_name", "error")

    def due_retries(self, now) -> DataFrame:
        """Files whose refusal may pass, with the attempt that is due."""
        c, failed = self.config, self.errors.where(F.col("error").isin(*PASSING))
        plan = state.retry_schedule(failed, FILE_KEYS, "upload_time", first_seconds=c.retry_first_seconds, minutes=c.retry_minutes, most=c.retry_max)
        return plan.where(F.col("due") <= F.lit(now).cast("timestamp")).groupBy(*FILE_KEYS).agg(F.max("attempt").alias("attempt"))

    def announce(self) -> DataFrame:
        """What each conversation holds, in a line."""
        return session.announced(self.files, ["session_id", "conversation_id"])

    def status(self) -> DataFrame:
        """Files, chunks, characters and bytes by conversation, session and in all."""
        n = {x: F.lit(0).cast("long").alias(x) for x in ("n_files", "n_chunks", "n_chars", "n_bytes")}
        one = F.lit(1).cast("long")
        size = {"n_chunks": one.alias("n_chunks"), "n_chars": F.length("text").cast("long").alias("n_chars"), "n_bytes": F.octet_length("text").cast("long").alias("n_bytes")}
        rows = self.chunks.select("session_id", "conversation_id", *(n | size).values())
        names = self.files.select("session_id", "conversation_id", *(n | {"n_files": one.alias("n_files")}).values())
        return session.store_stats(rows.unionByName(names), "session_id", "conversation_id")
