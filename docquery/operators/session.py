"""What a session holds: which one is meant, what fits directly, how it is announced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.operators.keys import join_on

def first_conversation(files: DataFrame, session: str = "session_id", conversation: str = "conversation_id", created: str = "upload_time") -> DataFrame:
    """Rows of each session's oldest conversation."""
    ages = files.groupBy(session, conversation).agg(F.min(created).alias("__born"))
    order = Window.partitionBy(session).orderBy("__born", conversation)
    first = ages.withColumn("__r", F.row_number().over(order)).where("__r = 1").select(session, conversation)
    return join_on(files, first, [session, conversation], "left_semi")


def resolve(requests: DataFrame, files: DataFrame) -> DataFrame:
    """request_id, asked, session_id: the asked session if it has files, else the only session that has, else null."""
    have = files.select("session_id").distinct()
    only = have.agg(F.count("*").alias("__n"), F.max("session_id").alias("__only"))  # one row
    hit = requests.join(have.withColumnRenamed("session_id", "__have"), F.col("asked") == F.col("__have"), "left").crossJoin(F.broadcast(only))
    chosen = F.coalesce("__have", F.when(F.col("__n") == 1, F.col("__only")))
    return hit.select("request_id", "asked", chosen.alias("session_id"))


def direct_fits(files: DataFrame, session: str, limit: int = 6000) -> DataFrame:
    """session, files, total_chars, direct: whether all of it may be given in full."""
    sums = files.groupBy(session).agg(F.count("*").alias("files"), F.sum("total_chars").alias("total_chars"))
    return sums.withColumn("direct", (F.lit(limit) > 0) & (F.col("total_chars") <= limit))


def direct_text(files: DataFrame, session: str, limit: int = 6000) -> DataFrame:
    """session, context: the full texts of sessions that fit; only those sessions' texts are gathered, so a group is bounded by the limit."""
    fit = direct_fits(files, session, limit).where("direct").select(session)
    items = F.array_sort(F.collect_list(F.struct("file_name", F.concat(F.lit("《"), F.col("file_name"), F.lit("》全文：\n"), F.col("text")).alias("t"))))
    rows = join_on(files, fit, [session], "left_semi").groupBy(session).agg(items.alias("__i"))
    return rows.select(session, F.array_join(F.transform("__i", lambda x: x["t"]), "\n").alias("context"))


def announced(files: DataFrame, group: list[str], name: str = "file_name", most: int = 3) -> DataFrame:
    """group, n_files, total_chars, listed: up to `most` names, and how many there are if more.

    The first names are ranked before they are gathered, so no group's names meet in one row.
    """
    order = Window.partitionBy(*group).orderBy(name)
    first = files.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= most)
    first = first.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("__r", name))).alias("__i"))
    sums = files.groupBy(*group).agg(F.count("*").alias("n_files"), F.sum("total_chars").alias("total_chars"))
    both = join_on(sums, first, group)
    names = F.array_join(F.transform("__i", lambda x: F.concat(F.lit("《"), x[name], F.lit("》"))), "、")
    rest = F.when(F.col("n_files") > most, F.concat(F.lit(" 等 "), F.col("n_files").cast("string"), F.lit(" 个"))).otherwise("")
    return both.withColumn("listed", F.concat(names, rest)).drop("__i")


def parsing_notice(records: DataFrame, now: Column, group: str = "session_id") -> DataFrame:
    """group, listed, waited: files still being read; records older than three hours are leaks and left out."""
    live = records.where(now - F.col("started") <= 3 * 3600).withColumn("total_chars", F.lit(0))
    waited = live.groupBy(group).agg(F.greatest(F.lit(0), F.max(now - F.col("started"))).cast("long").alias("s"))
    span = F.when(F.col("s") < 90, F.concat(F.col("s").cast("string"), F.lit(" 秒"))).otherwise(F.concat(F.floor(F.col("s") / 60).cast("string"), F.lit(" 分钟")))
    return join_on(announced(live, [group]), waited, [group]).select(group, "listed", span.alias("waited"))


def already_injected(items: DataFrame, prefix: str = "docquery:", marker: str = "【") -> DataFrame:
    """items (query_id, item_id, text) -> query_id, injected."""
    hit = F.coalesce(F.startswith("item_id", F.lit(prefix)), F.lit(False)) | F.coalesce(F.contains("text", F.lit(marker)), F.lit(False))
    return items.groupBy("query_id").agg(F.bool_or(hit).alias("injected"))


def store_stats(chunks: DataFrame, session: str, conversation: str) -> DataFrame:
    """session, conversation, files, chunks, chars, bytes; nulls mark the sums of a session and of all."""
    return chunks.rollup(session, conversation).agg(
        F.sum("n_files").alias("files"), F.sum("n_chunks").alias("chunks"), F.sum("n_chars").alias("chars"), F.sum("n_bytes").alias("bytes"),
        F.grouping_id().cast("int").alias("level"),
    )
