"""Streaming forms: arriving rows are scored, labels close queue entries, groups are counted per window.

Every job reads files as they arrive, keeps its progress in a checkpoint folder and writes to a folder; `run_available`
drains what is there and stops, so the same job serves a schedule and a test.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.operators.neighbours import ReferenceSet
from tamis.operators.scoring import Head, decide, score
from tamis.session import scratch_path


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    query = (stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    query = (stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def score_and_route(stream: DataFrame, head: Head, reference: ReferenceSet, vector: str = "e") -> DataFrame:
    """The batch operators on a stream: a narrow pass with the shipped head and reference, no state."""
    return decide(score(stream, head, reference, vector=vector), head)


def batch_log(out: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to its own folder; a replayed batch overwrites the same folder, so nothing counts twice."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/part={batch_id}")

    return write


def latest_by_key(log: DataFrame, key: str, stamp: str, tie: str) -> DataFrame:
    """The state of a keyed table from its change log: the newest row per key. Late labels are upserts and never dropped."""
    best = log.groupBy(key).agg(F.max_by(F.struct(*log.columns), F.struct(stamp, tie)).alias("_r"))
    return best.select("_r.*")


def group_windows(stream: DataFrame, ts: str, group: str, flagged: Column, window: str = "7 days", late: str = "1 day") -> DataFrame:
    """Rows and flagged rows per group and window; windows close when the watermark passes."""
    return (stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), group)
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(flagged).alias("x"))
            .select(group, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "x"))


def latest_submission(stream: DataFrame, key: str, stamp: str, tie: str) -> DataFrame:
    """Running newest row per key, one state entry per key."""
    return stream.groupBy(key).agg(F.max_by(F.struct(*stream.columns), F.struct(F.col(stamp), (-F.col(tie)).alias("t"))).alias("_r"))


def merge_once(spark: SparkSession, schema: T.StructType, keys: list[str], path: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends each record once by key to the table at `path` (null keys are equal), however late it or its replay comes.
    A batch that is tried again leaves its own part of the table out of account and replaces it."""
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/batch=-1")
    kept = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])

    def write(batch: DataFrame, batch_id: int) -> None:
        known = batch.sparkSession.read.schema(kept).parquet(path).where(F.col("batch") != batch_id).select(*keys)
        same = [F.col(f"n.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys]
        rows = batch.dropDuplicates(keys).alias("n").join(known.alias("k"), same, "left_anti").select("n.*")
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def arrivals(df: DataFrame, order: str, least: int = 4) -> DataFrame:
    """A table replayed as a stream: written in arrival order as several files and read back in about two batches. There
    are as many files as the table has scan partitions, and at least `least`."""
    files = max(least, df.rdd.getNumPartitions())
    path = scratch_path(df.sparkSession, "arrivals")
    df.repartitionByRange(files, order).sortWithinPartitions(order).write.parquet(path)
    return read_stream(df.sparkSession, path, df.schema, -(-files // 2))
