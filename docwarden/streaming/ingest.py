"""Incremental ingestion: content hashes against a cache, in batches or as a stream of file versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.operators.merge import latest, snapshot_diff


def changes(cache: DataFrame, files: DataFrame) -> DataFrame:
    """repo_id, file_path, file_type and change of files (with content_hash) against the cache."""
    return snapshot_diff(cache, files, ["repo_id", "file_path", "file_type"], "content_hash")


def change_counts(found: DataFrame) -> DataFrame:
    """changed, skipped, reprocessed, deleted and total, in one row."""
    n = lambda *kinds: F.count_if(F.col("change").isin(*kinds))
    return found.agg(n("added", "modified", "deleted").alias("changed"), n("unchanged").alias("skipped"), n("added", "modified").alias("reprocessed"), n("deleted").alias("deleted"), F.count("*").alias("total"))


BUCKETS = 16


def latest_versions(stream: DataFrame, target: str, checkpoint: str, key: str, order: str, buckets: int = BUCKETS) -> None:
    """Drains a stream of versions and leaves the last one of each key in a Parquet folder.

    The table is dealt into buckets of keys; a batch reads and replaces those that it has keys of. Merging a batch twice changes nothing, so a batch
    that is run again does no harm. A larger table asks for more buckets."""
    columns = [f.name for f in stream.schema]

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in batch.select("bucket").distinct().collect()]  # at most as many as there are buckets
        old = merged(spark, target)
        rows = batch if old is None else batch.unionByName(old.where(F.col("bucket").isin(touched)).select(*batch.columns))
        latest(rows, [key], [F.col(order).desc()]).select(*columns, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merged(spark: SparkSession, target: str) -> DataFrame | None:
    """The merged table as it is now, with its bucket; none before the first batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    return spark.read.parquet(target) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None
