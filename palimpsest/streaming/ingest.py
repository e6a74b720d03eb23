"""Structured Streaming: incremental ingest, session spans, high-water marks and per-session warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.storage import new_path
from palimpsest.streaming.session_store import SessionStore


def file_stream(spark: SparkSession, path: str, *, files_per_trigger: int | None = 64) -> DataFrame:
    """New Parquet files of a folder, or one file, a bounded number at a time or, for None, all that are there."""
    schema = spark.read.parquet(path).schema
    # a stream takes a file only as a pattern: one that nothing else matches
    pattern = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(pattern)


def drain(stream: DataFrame, each_batch, *, mode: str = "append", progress: str | None = None) -> None:
    """Run a stream over all that is new since the last run with the same ``progress``, a folder of its own if there is none."""
    where = progress or new_path(stream.sparkSession, "stream")
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", where)
    writer.foreachBatch(each_batch).start().awaitTermination()


def ingest_messages(stream: DataFrame, store: str, *, source: str = "main") -> None:
    """Append each batch's new messages to the session store in the folder ``store``; what has come before adds nothing.

    The progress of each source is kept beside the store, so a later run reads new files only.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        missing = {"seq": F.lit(None).cast("long"), "tool_name": F.lit(None).cast("string")}
        SessionStore(batch.sparkSession, store).add(batch.withColumns({c: v for c, v in missing.items() if c not in batch.columns}), source, batch_id)

    drain(stream, write, progress=f"{store}.progress/{source}")


def latest(stream: DataFrame, path: str, mode: str) -> None:
    """Keep a streaming aggregate's newest state as one table for each batch; readers take the last."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{batch_id:08d}")

    drain(stream, write, mode=mode)


def spans(stream: DataFrame, key: str, time: str) -> DataFrame:
    """Count and first and last time of each key; late rows are always taken, so there is no watermark."""
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.min(time).alias("first_at"), F.max(time).alias("last_at"))


WARNED = "key long, event_id long, value double"


def warnings(stream: DataFrame, threshold: float, path: str) -> None:
    """Write (key, event_id, value) under ``path``/warned: each key warns once above the threshold, and again after a boundary.

    ``stream`` has key, at, event_id, value and boundary; rows of a key are taken in the order of time within what arrives
    together. Which keys have warned since their last boundary is kept from batch to batch under ``path``/state.
    """
    order = (F.col("at").asc_nulls_last(), F.col("event_id").asc_nulls_last())
    cycle = F.count_if("boundary").over(Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        high = ~F.col("boundary") & (F.col("value") > threshold)
        rows = batch.withColumn("cycle", cycle).withColumn("high", F.coalesce(high, F.lit(False)))
        if batch_id:
            before = spark.read.schema("was long").parquet(f"{path}/state/{batch_id - 1:08d}")
        else:
            before = spark.createDataFrame([], "was long")
        nth = F.row_number().over(Window.partitionBy("key", "cycle").orderBy(*order))
        first = rows.filter("high").withColumn("nth", nth).filter("nth = 1")
        silent = F.col("key").eqNullSafe(F.col("was")) & (F.col("cycle") == 0)
        first.join(before, silent, "left_anti").select("key", "event_id", "value").write.mode("overwrite").parquet(f"{path}/warned/{batch_id:08d}")
        ends = rows.groupBy("key").agg(F.max("cycle").alias("last"), F.max(F.when(F.col("high"), F.col("cycle"))).alias("warned"), F.lit(True).alias("came"))
        both = ends.join(before.withColumn("held", F.lit(True)), F.col("key").eqNullSafe(F.col("was")), "full")
        still = F.col("came").isNull() | F.coalesce(F.col("warned") == F.col("last"), F.lit(False)) | (F.col("held") & (F.col("last") == 0))
        both.filter(still).select(F.when(F.col("came"), F.col("key")).otherwise(F.col("was")).alias("was")).write.mode("overwrite").parquet(f"{path}/state/{batch_id:08d}")

    drain(stream, write)
