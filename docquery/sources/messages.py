"""File records in chat messages: segments of JSON messages, hints in plain text, and matching one to the other."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquery.functions import text as T
from docquery.functions.media import base_name
from docquery.operators.keys import join_on

KINDS = ("file", "attachment", "video")
#: Marks of a file or video in a message's plain text (fixed values).
MARKS = "\\[(?:文件|视频)\\]"

#: The fields that name, place or describe a file, under all their names.
SEGMENT = (
    "type string, name string, file_name string, filename string, title string, file string, file_id string, id string, base64 string, "
    "content_base64 string, url string, file_url string, path string, file_path string, local_path string, tmp_path string, "
    "size string, file_size string, busid string"
)
_FIELDS = [x.strip().split()[0] for x in SEGMENT.split(",")]
_SEGMENTS = f"array<struct<{', '.join(':'.join(x.split()) for x in SEGMENT.split(', '))}, data: struct<{', '.join(':'.join(x.split()) for x in SEGMENT.split(', '))}>>>"
_PLACES = ("$.segments", "$.message_chain", "$.content", "$.message", "$.raw_message", "$.raw_message.file", "$.raw_message.attachment", "$.raw_message.files", "$.raw_message.message", "$.data.message")


def filled(col: Column) -> Column:
    """Null for what counts as missing: blank or 0."""
    return F.when(~col.isin("", "0"), col)


def segments(messages: DataFrame, keys: list[str], body: str = "body", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """keys, pos, seg_type and seg (all fields of SEGMENT) of each file segment; body is a JSON message.

    All places where messages keep segments are read in one pass; objects that
    stand alone under raw_message count as segments without a type test.
    """
    lists = F.concat(*(F.coalesce(_segment_list(F.col(body), p), F.array().cast(_PLACED)) for p in _PLACES))
    rows = messages.select(*keys, F.posexplode(lists).alias("pos", "s"))
    inner = F.when(F.col("s.seg.data").isNotNull(), F.col("s.seg.data")).otherwise(
        F.struct(*(F.col(f"s.seg.{f}").alias(f) for f in _FIELDS))
    )
    kept = rows.where(F.lower(F.coalesce("s.seg.type", F.lit(""))).isin(*kinds) | F.col("s.alone"))
    return kept.select(*keys, "pos", F.lower("s.seg.type").alias("seg_type"), inner.alias("seg"))


_PLACED = f"array<struct<seg: {_SEGMENTS[6:-1]}, alone: boolean>>"


def _segment_list(body: Column, place: str) -> Column:
    raw = F.get_json_object(body, place)
    many = F.transform(F.from_json(raw, _SEGMENTS), lambda s: F.struct(s.alias("seg"), F.lit(False).alias("alone")))
    if place in _PLACES[5:8]:
        one = F.array(F.struct(F.from_json(raw, _SEGMENTS[6:-1]).alias("seg"), F.lit(True).alias("alone")))
        return F.when(raw.startswith("["), many).when(raw.startswith("{"), one)
    return F.when(raw.startswith("["), many)


def file_records(segs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, name, channel, content, path, url, file_id, size_hint, busid: the first usable source of each segment; none drops it."""
    f = lambda *names: F.coalesce(*(filled(F.col(f"seg.{n}")) for n in names))
    name = F.coalesce(f("name", "file_name", "filename", "title"), filled(base_name(F.col("seg.file"))), f("file_id"), F.lit("unnamed_file"))
    link = F.coalesce(f("url", "file_url"), F.when(F.col("seg.file").rlike("^https?://"), F.col("seg.file")))
    number = lambda c: F.coalesce(F.trim(c).try_cast("long"), F.lit(0))
    out = segs.select(
        *keys, "pos", name.alias("name"), F.try_to_binary(f("base64", "content_base64"), F.lit("base64")).alias("content"),
        f("path", "file_path", "local_path", "tmp_path").alias("path"), link.alias("url"), f("file_id", "id").alias("file_id"),
        number(f("size", "file_size")).alias("size_hint"), number(f("busid")).alias("busid"),
    )
    channel = F.when(F.col("content").isNotNull(), "bytes").when(F.col("path").isNotNull(), "path").when(F.col("url").isNotNull(), "url")
    return out.withColumn("channel", channel.when(F.col("file_id").isNotNull(), "file_id")).where("channel is not null")


def looks_like_file(plain: Column, types: Column | None = None) -> Column:
    """Whether the text has a mark or a segment type says file."""
    marked = F.coalesce(plain, F.lit("")).rlike(MARKS)
    return marked if types is None else marked | F.coalesce(F.exists(types, lambda t: F.lower(t).isin(*KINDS)), F.lit(False))


def hints(messages: DataFrame, keys: list[str], plain: str = "plain") -> DataFrame:
    """keys, line, name, size_hint, url: one row per marked line of a message's plain text."""
    lines = messages.select(*keys, F.posexplode(F.split(F.coalesce(plain, F.lit("")), "\\R")).alias("line", "t"))
    lines = lines.withColumn("t", T.strip(F.col("t"))).where(F.col("t").rlike(MARKS))
    link = "链接[:：]\\s*(https?://\\S+)"
    url = F.regexp_replace(F.regexp_extract("t", link, 1), "[，,。]+$", "")
    head = F.regexp_replace("t", "链接[:：]\\s*https?://.*$", "")  # the name stands before the link
    form = f"{MARKS}\\s*(?:文件\\s*[:：]\\s*)?([^，,]+?)(?:\\s*[，,]\\s*大小[:：]\\s*(\\d+))?(?:\\s*[，,].*)?$"
    name = F.trim(F.regexp_extract(head, form, 1))
    size = F.coalesce(F.regexp_extract(head, form, 2).try_cast("long"), F.lit(0))
    out = lines.select(*keys, "line", name.alias("name"), size.alias("size_hint"), F.nullif(url, F.lit("")).alias("url"))
    return out.where("name <> ''")


def first_hint(messages: DataFrame, keys: list[str], plain: str = "plain") -> DataFrame:
    """keys, line, name, size_hint, url of the first hint of each message that has one."""
    rest = ("line", "name", "size_hint", "url")
    found = hints(messages, keys, plain).groupBy(*keys).agg(F.min_by(F.struct(*rest), "line").alias("h"))
    return found.select(*keys, *(F.col(f"h.{c}").alias(c) for c in rest))


def match_segments(asked: DataFrame, segs: DataFrame, message: str = "message_id") -> DataFrame:
    """asked (message, hint_id, name, size_hint) with pos and mode of the segment (message, pos, name, size) that is meant.

    Equal names win, sizes exclude; several are ambiguous; a lone one of the right size is taken for any name; else the first.
    Segments are counted by name and size, by either and in all, and a hint looks up at most five of these counts: no hint meets every segment.
    """
    known = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("long")
    each = segs.select(message, "pos", F.lower(base_name(F.col("name"))).alias("__name"), known(F.col("size")).alias("__size"))
    each = each.groupBy(message, "__name", "__size").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    sums = each
    for by in (["__name"], ["__size"], []):  # null stands for any
        part = each.groupBy(message, *by).agg(F.sum("n").alias("n"), F.min("pos").alias("pos"))
        any_ = {"__name": F.lit(None).cast("string"), "__size": F.lit(None).cast("long")}
        sums = sums.unionByName(part.select(message, "n", "pos", *(c if c in by else any_[c].alias(c) for c in any_)))
    want, hint = F.nullif(F.lower(base_name(F.col("name"))), F.lit("")), known(F.col("size_hint"))
    look = lambda kind, name, size: F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("__name"), size.cast("long").alias("__size"))
    none = F.lit(None)
    sized = [look(kind, name, size) for kind, name in (("named", want), ("fits", none)) for size in (hint, F.lit(0))]
    keys = F.concat(F.array(look("all", none, none)), F.when(hint > 0, F.array(*sized)).otherwise(F.array(look("named", want, none), look("fits", none, none))))
    rows = asked.select(message, "hint_id", hint.alias("hint"), F.explode(keys).alias("k")).select(message, "hint_id", "hint", "k.*")
    rows = join_on(rows, sums, [message, "__name", "__size"], "left")
    of = lambda kind, f, c: f(F.when(F.col("kind") == kind, F.col(c)))
    out = rows.groupBy(message, "hint_id").agg(
        F.coalesce(of("named", F.sum, "n"), F.lit(0)).alias("n"), F.coalesce(of("fits", F.sum, "n"), F.lit(0)).alias("s"), of("named", F.min, "pos").alias("at"),
        of("fits", F.min, "pos").alias("sized"), of("all", F.min, "pos").alias("first"), F.max("hint").alias("hint"),
    )
    mode = F.when(F.col("first").isNull(), "none").when(F.col("n") > 1, "ambiguous").when(F.col("n") == 1, "name")
    mode = mode.when((F.col("hint") > 0) & (F.col("s") == 1), "size").otherwise("fallback")
    pos = F.when(F.col("n") > 0, F.col("at")).when(mode == "size", F.col("sized")).otherwise(F.col("first"))
    return out.select(message, "hint_id", pos.alias("pos"), mode.alias("mode"))


def context(messages: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """keys, user_id, group_id, platform: first filled field of each; a bare id is never taken for a user's."""
    at = lambda *paths: F.coalesce(*(filled(F.get_json_object(body, p)) for p in paths))
    spots = ("$", "$.message_info", "$.message_info.user_info")
    users = [f"{s}.{k}" for s in spots for k in ("user_id", "sender_id", "qq", "user_openid")]
    groups = [f"{s}.{k}" for s in ("$", "$.message_info", "$.message_info.group_info") for k in ("group_id", "group_all")]
    return messages.select(
        *keys, F.coalesce(at(*users), F.lit("")).alias("user_id"), F.coalesce(at(*groups), F.lit("")).alias("group_id"),
        F.coalesce(at("$.message_info.platform", "$.platform"), F.lit("qq")).alias("platform"),
    )


def from_group(body: Column) -> Column:
    """Whether a JSON message comes from a group: an id, or the group's own id, name or all-flag."""
    spots = ("$.message_info.group_id", "$.message_info.group_info.group_id", "$.message_info.group_info.group_name", "$.message_info.group_info.group_all", "$.is_group")
    said = lambda p: F.lower(F.coalesce(F.get_json_object(body, p), F.lit("")))
    return reduce(Column.__or__, (~said(p).isin("", "0", "false", "null") for p in spots))


def session_key(body: Column, *paths: str) -> Column:
    """First filled of the given JSON paths."""
    usual = paths or ("$.session_id", "$.stream_id", "$.chat_id", "$.message_info.session_id")
    return F.coalesce(*(filled(F.get_json_object(body, p)) for p in usual), F.lit(""))


def response_url(payload: Column) -> Column:
    """Link of an answer: at data.url, at url, else the first link down to five levels."""

    @F.pandas_udf("string")
    def search(texts: pd.Series) -> pd.Series:
        return texts.map(_first_link)

    link = lambda p: F.when(F.get_json_object(payload, p).rlike("^https?://"), F.get_json_object(payload, p))
    plain = F.coalesce(link("$.data.url"), link("$.url"))
    return F.when(plain.isNotNull(), plain).otherwise(search(payload))


def _first_link(text: str | None) -> str | None:
    try:
        level = [json.loads(text or "null")]
    except ValueError:
        return None
    stack = [(level[0], 0)]
    while stack:
        node, depth = stack.pop()
        if isinstance(node, str) and node.startswith(("http://", "https://")):
            return node
        below = list(node.values()) if isinstance(node, dict) else node if isinstance(node, list) else []
        if depth < 5:
            stack += [(x, depth + 1) for x in reversed(below)]
    return None
