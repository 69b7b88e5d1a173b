"""The folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL = "/tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session does without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = LOCAL
    return root.rstrip("/")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by key over all cores. What is parsed from a row costs far more than its bytes, by which Spark
    cuts its scans: a table of a few megabytes, or of short expressions for long texts, would be one task's work."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder, with its lineage cut; the folder goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
