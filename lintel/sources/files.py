"""Source files as rows: a directory tree, or a table of texts as virtual files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.catalog.languages import MAX_FILE_BYTES
from lintel.functions import paths


def scan_tree(spark: SparkSession, target: str, cap: int = MAX_FILE_BYTES) -> DataFrame:
    """All files below target: path, rel_path, size, language, status, text of the analysable.

    Rows that are skipped stay, so counters can be computed; their content isn't
    decoded. Bytes that aren't UTF-8 become replacement characters. Empty files have no
    rows, as Spark's reader leaves them out.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(target)
    root = target.rstrip("/") + "/"
    rel = F.regexp_replace(F.col("path"), "^.*?" + "\\Q" + root.split("://")[-1].lstrip("/") + "\\E", "")
    rows = found.select("path", rel.alias("rel_path"), F.col("length").alias("size"), "content")
    return with_status(rows, cap).withColumn("text", F.when(F.col("status") == "analysable", F.make_valid_utf8(F.col("content").cast("string")))).drop("content")


def with_status(files: DataFrame, cap: int = MAX_FILE_BYTES) -> DataFrame:
    return files.withColumn("language", paths.language(F.col("rel_path"))).withColumn("status", paths.scan_status(F.col("rel_path"), F.col("size"), cap))


def virtual_files(table: DataFrame, rel_path: Column, text: str = "text") -> DataFrame:
    """Rows of a table as files."""
    rows = table.withColumn("rel_path", rel_path).withColumn("size", F.octet_length(F.coalesce(text, F.lit(""))).cast("bigint"))
    return with_status(rows)


def analysable(files: DataFrame, most: int | None = None) -> DataFrame:
    kept = files.where("status = 'analysable'")
    return kept.orderBy("rel_path").limit(most) if most else kept


def stats(files: DataFrame) -> DataFrame:
    """One row of counters, with the analysable files by language."""
    by_language = (
        files.where("status = 'analysable'").groupBy("language").count()
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "count")))).alias("by_language"))
    )
    names = ("analysable", "skipped_binary", "skipped_unknown_lang", "skipped_too_large", "skipped_dirs")
    counts = files.agg(
        F.count_if(F.col("status") != "skipped_dirs").alias("total_seen"), *(F.count_if(F.col("status") == n).alias(n) for n in names)
    )
    return counts.join(F.broadcast(by_language), how="left")
