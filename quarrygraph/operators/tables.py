"""Small helpers for iterative plans."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors see. Where that is unset, a local master gets a folder of its own; a cluster is refused."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir")
    if not found:
        held = context._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quarrygraph-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def numbered(df: DataFrame, name: str = "n") -> DataFrame:
    """df, pinned, with a long column of whole numbers from 0 without gaps. Rows are counted where they are; only the number of rows of each partition is brought together."""
    place = pinned(df.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = place.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    joined = place.withColumn("_part", part).join(F.broadcast(before), "_part")
    return pinned(joined.select(*df.columns, (F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1)).alias(name)))


def pinned(df: DataFrame) -> DataFrame:
    """df checkpointed to the shared folder: cuts the lineage of an iteration, and survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows of a table of nodes that joins with edges may broadcast.
BROADCAST_ROWS = 1_000_000


def beside_edges(df: DataFrame) -> DataFrame:
    """df, a table with a row for each node at most that stands somewhere already, for a join with edges: broadcast up to BROADCAST_ROWS, so that edges, many times as many, stay where they are."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def swept(df: DataFrame) -> None:
    """Ask the driver to collect its garbage: shuffle files of df's finished rounds go from the executors' disks then. Python's own garbage holds plans, so it goes first."""
    gc.collect()
    for _ in range(2):
        df.sparkSession._jvm.System.gc()
