"""Column builders for text: tokens, trimming, splitting, joining overlapping chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ideographs that are indexed as overlapping pairs.
IDEOGRAPHS = "[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}]+"
#: What a text with compound identifiers has somewhere.
COMPOUND = "_|[A-Za-z0-9][.-][A-Za-z0-9_]"
#: Identifiers, with their dotted, dashed or underscored parts, and numbers.
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*(?:[._-][A-Za-z0-9_]+)*|[0-9]+"


def ideograph_pairs(text: Column) -> Column:
    """Two-character tokens of each run of ideographs; a single one stays as it is."""
    runs = F.regexp_extract_all(text, F.lit(IDEOGRAPHS), F.lit(0))
    pairs = lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: r.substr(i, F.lit(2)))
    )
    return F.flatten(F.transform(runs, pairs))


def identifiers(text: Column) -> Column:
    """Lower-case identifiers, each followed by its parts if it has any."""
    found = F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))
    parts = lambda w: F.filter(F.split(w, "[._-]"), lambda p: p != "")
    with_parts = lambda w: F.when(w.rlike("[._-]"), F.concat(F.array(w), parts(w))).otherwise(F.array(w))
    words = F.transform(found, F.lower)
    # most texts have no compound, and are spared the test of each word
    return F.when(text.rlike(COMPOUND), F.flatten(F.transform(words, with_parts))).otherwise(words)


def tokens(text: Column) -> Column:
    """Index tokens of a text, repeats included; empty for null."""
    text = F.coalesce(text, F.lit(""))
    # most texts have no ideographs: the cheap test spares them the second scan
    return F.when(text.rlike(IDEOGRAPHS), F.concat(ideograph_pairs(text), identifiers(text))).otherwise(identifiers(text))


def token_count(text: Column) -> Column:
    """Number of index tokens, without making them where each match is one."""
    text = F.coalesce(text, F.lit(""))
    plain = ~text.rlike(f"{COMPOUND}|{IDEOGRAPHS}")
    return F.when(plain, F.regexp_count(text, F.lit(IDENTIFIER))).otherwise(F.size(tokens(text)))


def term_counts(rows: DataFrame, tokens: str) -> DataFrame:
    """rows with token and tf in place of the array column `tokens`: a row per distinct token, counted within the row.

    The sorted array is cut where its value changes.  The explode is an outer one, as an inner one would have the optimizer test
    the counts' size below, with the sort copied into every step; rows without tokens are dropped behind it.
    """
    s, at = F.col("__sorted"), F.col("__starts")
    changes = F.filter(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0))), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    counts = F.zip_with(at, F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(s))), lambda a, b: F.struct(F.get(s, a).alias("token"), (b - a).cast("long").alias("tf")))
    rest = [c for c in rows.columns if c != tokens]
    cut = rows.withColumn("__sorted", F.sort_array(tokens)).withColumn("__starts", changes)
    out = cut.select(*rest, counts.alias("__counts")).select(*rest, F.explode_outer("__counts").alias("__c"))
    return out.select(*rest, "__c.token", "__c.tf").where("token is not null")


def strip(text: Column) -> Column:
    """Cut white space as Unicode knows it, and the separators U+001C to U+001F, from both ends."""
    return F.regexp_replace(text, "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")


def hard_split(text: Column, size: int, overlap: int) -> Column:
    """Pieces of `size` characters, each starting size - overlap after the one before."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    pieces = F.transform(starts, lambda i: text.substr(i + 1, F.lit(size)))
    return F.when(F.length(text) > 0, pieces).otherwise(F.array().cast("array<string>"))


def full_text(chunks: Column, overlap: int) -> Column:
    """Chunks joined; the longest beginning of a chunk (up to overlap) that ends the one before is dropped."""
    if overlap <= 0:
        return F.array_join(chunks, "")
    last = F.zip_with(chunks, F.concat(F.array(F.lit("")), chunks), lambda c, before: F.struct(c.alias("c"), before.alias("b")))

    def cut(pair: Column) -> Column:
        c, before = pair["c"], pair["b"]
        most = F.least(F.lit(overlap), F.length(c), F.length(before))
        fits = F.filter(F.sequence(most, F.lit(1), F.lit(-1)), lambda k: F.endswith(before, F.left(c, k)))
        drop = F.when(most > 0, F.coalesce(F.get(fits, F.lit(0)), F.lit(0))).otherwise(0)
        return c.substr(drop + 1, F.length(c))

    whole = F.filter(last, lambda p: p["c"].isNotNull())  # zip_with pads the shorter side
    return F.array_join(F.transform(whole, cut), "")


def sample_for_summary(text: Column, most: int) -> Column:
    """The text itself up to `most` characters, else a third each of its head, middle and tail."""
    part = most // 3
    middle = F.greatest(F.lit(0), F.floor((F.length(text) - part) / 2)).cast("int")
    gap = F.lit("\n……（中略）……\n")
    cut = F.concat(F.left(text, F.lit(part)), gap, text.substr(middle + 1, F.lit(part)), gap, F.right(text, F.lit(part)))
    return F.when(F.length(text) <= most, text).otherwise(cut)
