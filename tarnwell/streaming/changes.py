"""File changes as streams: coalescing, incremental upkeep and recent rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..operators.tabular import latest, upsert
from ..session import Scratch


def coalesce_changes(batch: DataFrame, most: int = 100_000) -> DataFrame:
    """(repo_id, changed, deleted, recheck) of file events (repo_id, path, event, at): the last event of a path counts;
    a repository with more than most paths is to be checked whole."""
    last = latest(batch.select("repo_id", "path", "at", "event"), ["repo_id", "path"], ["at"])
    n = lambda deleted: F.count_if((F.col("event") == "deleted") == F.lit(deleted))
    return last.groupBy("repo_id").agg(n(False).alias("changed"), n(True).alias("deleted"), (F.count(F.lit(1)) > most).alias("recheck"))


def current(spark: SparkSession, target: str, schema) -> DataFrame:
    """The rows that keep_current() holds in a folder: of each bucket those of its last epoch."""
    try:
        kept = spark.read.schema(_kept(schema)).parquet(f"{target}/rows")
    except AnalysisException:  # nothing was kept yet
        return spark.createDataFrame([], schema)
    last = F.broadcast(kept.groupBy("bucket").agg(F.max("epoch").alias("epoch")))  # one row a bucket
    return kept.join(last, ["bucket", "epoch"], "left_semi").select(*schema.fieldNames())


def _kept(schema):
    return StructType([*schema.fields, StructField("bucket", IntegerType()), StructField("epoch", LongType())])


def keep_current(spark: SparkSession, source: str, schema, keys: list[str], order: list[str], target: str | None = None, buckets: int = 64) -> DataFrame:
    """The current row of each key of a stream of Parquet files, kept by one merge a micro-batch.

    Equal to one batch over all rows: within a batch and between it and what is kept, the greatest by order wins. Rows
    lie in buckets by the hash of their key, and a micro-batch writes anew only the buckets it touches, under its epoch.
    With a target folder the stream goes on where it stopped: its progress is kept there, and an epoch that is run again
    after a failure replaces what it wrote. Without one, a scratch folder serves one run.
    """
    target = target or f"{Scratch(spark, 'current').base}/table"

    def merge(batch: DataFrame, epoch: int) -> None:
        new = latest(batch.select(*schema.fieldNames()), keys, order).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        try:
            kept = spark.read.schema(_kept(schema)).parquet(f"{target}/rows").where(F.col("epoch") < epoch)
            touched = F.broadcast(new.select("bucket").distinct())  # at most one row a bucket
            kept = kept.join(touched, "bucket", "left_semi")
            last = F.broadcast(kept.groupBy("bucket").agg(F.max("epoch").alias("epoch")))
            new = latest(kept.join(last, ["bucket", "epoch"], "left_semi").drop("epoch").unionByName(new), [*keys, "bucket"], order)
        except AnalysisException:  # nothing was kept yet
            pass
        rows = new.select(*schema.fieldNames(), "bucket", F.lit(epoch).cast("bigint").alias("epoch"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "epoch").parquet(f"{target}/rows")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "4").parquet(source)
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{target}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return current(spark, target, schema)


def windowed_counts(spark: SparkSession, source: str, schema, at: str, key: str, width: str = "1 day", late: str = "10 minutes", target: str | None = None) -> DataFrame:
    """(start, key, n): tumbling counts with a watermark, as they stand when the stream is read to its end.

    Micro-batches give the windows that changed (update mode), so state beyond the watermark is dropped, and rows later
    than that count no more; the last count of a window holds. With a target folder the stream goes on where it stopped.
    """
    target = target or f"{Scratch(spark, 'windows').base}/table"
    stream = spark.readStream.schema(schema).parquet(source).withColumn("at", F.col(at).cast("timestamp"))
    counts = stream.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))

    def take(batch: DataFrame, epoch: int) -> None:
        rows = batch.select(F.col("w.start").alias("start"), "key", "n", F.lit(epoch).cast("bigint").alias("epoch"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(f"{target}/rows")

    query = counts.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", f"{target}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = spark.read.schema("start timestamp, key string, n bigint, epoch bigint").parquet(f"{target}/rows")
    return kept.groupBy("start", "key").agg(F.max_by("n", "epoch").alias("n"))


def freshness(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """(repo_id, path, label): fresh, stale or missing by comparing content hashes."""
    a = indexed.select("repo_id", "path", F.col("content_hash").alias("was"))
    b = current.select("repo_id", "path", F.col("content_hash").alias("now"))
    label = F.when(F.col("was").isNull(), "missing").when(F.col("now").isNull() | (F.col("was") != F.col("now")), "stale").otherwise("fresh")
    return a.join(b, ["repo_id", "path"], "full_outer").select("repo_id", "path", label.alias("label"))


__all__ = ["coalesce_changes", "freshness", "keep_current", "upsert", "windowed_counts"]
