"""Streams of activity: windowed counts with late data, sessions, decayed hotspot scores kept up to date, and upserts by batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrygraph import params as P
from quarrygraph.operators.tables import shared_folder

LATE = "2 hours"


def events(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A file stream of events with an event-time column that watermarks accept."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(stream: DataFrame, late: str = LATE) -> DataFrame:
    """window_start, event_type, n, total for each hour; rows later than the watermark are left out."""
    w = F.window("ts", "1 hour")
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(stream: DataFrame, late: str = LATE) -> DataFrame:
    """window_start, n for each hour that begins every quarter of an hour."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """user_id, started, ended, n for each session: events with no gap that long between them."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def decayed_hotspots(stream: DataFrame, half_life_days: float = P.HALF_LIFE_DAYS) -> DataFrame:
    """user_id, score, last_ts after each batch: a decayed sum of values, kept as one number and its time for each key."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        score, at = state.get if state.exists else (0.0, None)
        rows = pd.concat(list(batches)).sort_values("ts")
        if len(rows):
            micros = pd.to_datetime(rows["ts"]).map(lambda t: t.value // 1000).to_numpy()
            last = max(int(micros.max()), at or 0)
            rate = 0.6931471805599453 / (half_life_days * 86400e6)
            fresh = float(sum(v * 2.718281828459045 ** (-rate * (last - t)) for v, t in zip(rows["value"], micros, strict=True)))
            score = score * 2.718281828459045 ** (-rate * (last - at)) + fresh if at is not None else fresh
            at = last
        state.update((float(score), int(at or 0)))
        yield pd.DataFrame({"user_id": [key[0]], "score": [score], "last_us": [int(at or 0)]})

    return stream.select("user_id", "ts", "value").groupBy("user_id").applyInPandasWithState(update, "user_id long, score double, last_us long", "score double, last_us long", "update", "NoTimeout")


def upserts(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands each batch to apply (for writes that replace rows by key). Batches may come again after a failure: apply must be idempotent."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(spark: SparkSession, path: str, schema: T.StructType, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A job over what is there now, as a table: the path is a file or a folder of files, read as a stream to its end."""
    work = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_file = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    reader = spark.readStream.schema(schema)
    # a stream watches a folder: of a single file's folder, that file alone
    source = reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString()) if is_file else reader.parquet(path)
    result = job(source.withColumn("ts", F.col("ts").cast("timestamp")))
    # each batch gives the whole result so far, which tasks write: none of it comes to the driver
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{work}/result")
    spark.createDataFrame([], result.schema).write.parquet(f"{work}/result")
    result.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{work}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{work}/result")
