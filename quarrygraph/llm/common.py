"""What the operators of this subpackage share: scratch tables in the shared folder, and vectorised word hashing over Arrow buffers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.runtime import ship as ship

#: Bytes of text that a Python worker hashes at once; a single longer text makes a slice of its own.
SLICE_BYTES = 1 << 19

_made: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where that is unset, a local master, as in tests, gets a folder of its own; a cluster is refused."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="quarrygraph-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: this cuts the lineage, and survives lost executors. Removed at exit."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quarrygraph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(_clear)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote and that nothing reads any more. Shuffle files of finished plans go when the driver collects its garbage, which this asks for."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        spark._jvm.System.gc()


def _clear() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is None:
                continue
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone by now; the folder is the cluster's scratch space
            return


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random64(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = random64(256, 11)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> None:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(n + n // 4, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)


#: Rows whose texts a Python worker has as Python objects at once.
PART_ROWS = 512


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of PART_ROWS rows, so that a worker's memory doesn't follow the batch size."""
    for b in batches:
        for i in range(0, b.num_rows, PART_ROWS):
            yield b.slice(i, PART_ROWS)


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of a string column, in slices of about SLICE_BYTES: first and last row, the bytes, and the offset of each row in them. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    n = len(column)
    if not n:
        return
    at = np.frombuffer(where, width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, "right")) - 1)
        j = min(j, n)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (run of bytes other than 9-13 and 32) and the number of words of each row."""
    n = len(at) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    b = _LOWER[data] if lower else data
    space = _SPACE[b]
    first, last = np.ones(len(b), bool), np.ones(len(b), bool)
    first[1:], last[:-1] = space[:-1], space[1:]
    full = at[1:] > at[:-1]
    first[at[:-1][full]] = True
    last[at[1:][full] - 1] = True
    start, end = np.flatnonzero(first & ~space), np.flatnonzero(last & ~space) + 1
    _grow(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_VALUE[b] * _powers[0][: len(b)], out=total[1:])
    h = (total[end] - total[start]) * _powers[1][start]
    counts = np.bincount(np.searchsorted(at, start, "right") - 1, minlength=n) if len(start) else np.zeros(n, np.int64)
    return mix64(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), counts.astype(np.int64)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def crc32_mod5(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5
