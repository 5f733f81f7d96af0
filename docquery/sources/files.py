"""Files as rows: scans that prune by metadata before any byte is read, spooling limits, acquisition order, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.functions.media import base_name


def scan(spark: SparkSession, path: str, *, name: str | None = None, size: int | None = None, most: int | None = None) -> DataFrame:
    """path, file_name, length, modificationTime, content; the filters run on metadata, so other files' bytes are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = files.option("pathGlobFilter", name) if name else files
    rows = files.load(path)
    if size is not None:
        rows = rows.where(F.col("length") == size)
    if most is not None:
        rows = rows.where(F.col("length") <= most)
    return rows.withColumn("file_name", base_name(F.col("path")))


def find(spark: SparkSession, path: str, name: str, size: int) -> DataFrame:
    """path of the first file of that name and size; contents are pruned from the scan."""
    return scan(spark, path, name=name, size=size).select("path", "length").orderBy("path").limit(1)


def spooled(files: DataFrame, most: int) -> DataFrame:
    """files with size, sha256 and error: contents above the limit are refused, never cut."""
    size = F.length("content")
    error = F.when(F.col("content").isNull(), "unavailable").when(size > most, "too_large")
    out = files.withColumn("size", size).withColumn("error", error)
    return out.withColumn("sha256", F.when(error.isNull(), F.sha2("content", 256))).withColumn("content", F.when(error.isNull(), F.col("content")))


def acquired(records: DataFrame, key: str, *channels: DataFrame) -> DataFrame:
    """records with content and channel of the first channel that has it; channels: (key, content), in order of precedence.

    Where a channel has several contents for a key, the least by bytes counts, so a record stays one row.
    """
    out = records
    picks = []
    for n, c in enumerate(channels):
        one = c.groupBy(F.col(key).alias(f"__k{n}")).agg(F.min("content").alias(f"__c{n}"))
        out = out.join(one, F.col(key) == F.col(f"__k{n}"), "left")
        picks.append(F.when(F.col(f"__c{n}").isNotNull(), n))
    out = out.withColumn("content", F.coalesce(*(F.col(f"__c{n}") for n in range(len(channels)))))
    out = out.withColumn("channel", F.coalesce(*picks))
    return out.drop(*(f"__{x}{n}" for n in range(len(channels)) for x in "kc"))
