"""Snapshots of the relations in a warehouse folder.

A table is a set of buckets, each a folder of Parquet files; a row's bucket is the crc32 of its key. The pointer of a table (CURRENT, a line of JSON) names the folder of
each bucket, so an update writes the buckets it touches and leaves the others where they are. The pointer is rewritten last: readers see a whole snapshot or the one before.
"""

from __future__ import annotations

import json
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.operators.incremental import latest_wins
from quarrygraph.schemas import DDL, KEYS, RENAMED, VERSION, schema

#: Rows of the table `files` for each bucket, about.
BUCKET_FILES = 20_000


def bucket_of(key: Column, buckets: int) -> Column:
    """A key's bucket; null keys are in the first."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(buckets)), F.lit(0)).cast("int")


class Store:
    """Tables of one repository. buckets: how many a table gets when it is written whole."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 1):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self, name: str) -> dict | None:
        """The pointer: version (of the schemas), buckets, and parts (bucket -> folder). Stores of version 1 point to one folder."""
        pointer, fs = self._path(name, "CURRENT"), self._fs()
        if not fs.exists(pointer):
            return None
        stream = fs.open(pointer)
        text = bytes(stream.readAllBytes()).decode()
        stream.close()
        return json.loads(text) if text.startswith("{") else {"version": 1, "buckets": 1, "parts": {"0": text.strip()}}

    def _point(self, name: str, manifest: dict) -> None:
        before, fs = self.manifest(name), self._fs()
        stream = fs.create(self._path(name, "NEXT"), True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        fs.delete(self._path(name, "CURRENT"), False)
        fs.rename(self._path(name, "NEXT"), self._path(name, "CURRENT"))
        if before:
            still = set(manifest["parts"].values())
            for folder in set(before["parts"].values()) - still:
                fs.delete(self._path(name, folder), True)

    def _fitted(self, name: str, df: DataFrame) -> DataFrame:
        """df with the columns of the table's schema; missing ones are null."""
        there = set(df.columns)
        return df.selectExpr(*(f"cast({f'`{f.name}`' if f.name in there else 'NULL'} AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema(name)))

    def _written(self, name: str, df: DataFrame, buckets: int, only: list[int] | None = None) -> dict[str, str]:
        """Write df as one folder for each bucket; returns the folders. A single bucket is not shuffled."""
        version, df = f"v-{uuid.uuid4().hex}", self._fitted(name, df)
        wanted = range(buckets) if only is None else only
        if buckets == 1:
            df.write.parquet(f"{self.path}/{name}/{version}")
            return {"0": version}
        at = bucket_of(F.col(KEYS.get(name, df.columns[0])), buckets)
        df.withColumn("bucket", at).repartition(max(1, len(wanted)), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}/{version}")
        there = {f"bucket={b}" for b in wanted}
        found = {x.getPath().getName() for x in self._fs().listStatus(self._path(name, version))} & there
        return {x.removeprefix("bucket="): f"{version}/{x}" for x in found}

    def write(self, name: str, df: DataFrame) -> None:
        """Replace a table. Columns are brought to the table's schema; missing ones are null."""
        self._point(name, {"version": VERSION, "buckets": self.buckets, "parts": self._written(name, df, self.buckets)})

    def touched(self, name: str, keys: DataFrame) -> list[int]:
        """Buckets of the table that the keys (one column) fall in."""
        manifest = self.manifest(name)
        if manifest is None or manifest["buckets"] == 1:
            return [0]
        return sorted(r[0] for r in keys.select(bucket_of(F.col(keys.columns[0]), manifest["buckets"])).distinct().collect())

    def replace(self, name: str, gone: DataFrame, fresh: DataFrame, buckets: list[int] | None = None) -> None:
        """Take the rows whose columns equal those of a row of gone out of a table, and put those of fresh in; only the buckets that this touches are written.

        gone holds the table's key, and maybe more columns. buckets: those touched, if the caller knows them (all keys of gone and fresh must be in them).
        """
        manifest, key = self.manifest(name), KEYS[name]
        if manifest is None or manifest["version"] != VERSION:
            self.write(name, self.read(name).join(gone, gone.columns, "left_anti").unionByName(self._fitted(name, fresh)))
            return
        if buckets is None:
            buckets = self.touched(name, gone.select(key).unionByName(fresh.select(key)))
        kept = self.read(name, buckets=buckets).join(gone, gone.columns, "left_anti")
        written = self._written(name, kept.unionByName(self._fitted(name, fresh)), manifest["buckets"], buckets)
        parts = {b: folder for b, folder in manifest["parts"].items() if int(b) not in buckets} | written
        self._point(name, {**manifest, "parts": parts})

    def append(self, name: str, fresh: DataFrame) -> None:
        """Put rows in beside those that are there, which are not read."""
        manifest = self.manifest(name)
        if manifest is None or manifest["version"] != VERSION:
            self.write(name, self.read(name).unionByName(self._fitted(name, fresh)))
            return
        version = f"v-{uuid.uuid4().hex}"
        self._fitted(name, fresh).write.parquet(f"{self.path}/{name}/{version}")
        self._point(name, {**manifest, "parts": manifest["parts"] | {f"+{len(manifest['parts'])}-{version[2:10]}": version}})

    def exists(self, name: str) -> bool:
        return self.manifest(name) is not None

    def read(self, name: str, buckets: list[int] | None = None, **keys: object) -> DataFrame:
        """A table, filtered by equal keys if given: only the bucket of the table's key is read, and the filter reaches the files. A table never written is empty.

        Tables of older versions are read by the mapping of their columns.
        """
        manifest, target = self.manifest(name), schema(name)
        key = KEYS.get(name)
        if manifest is not None and key in keys and keys[key] is not None:
            buckets = [zlib.crc32(str(keys[key]).encode()) % manifest["buckets"]]
        parts = [] if manifest is None else [f for b, f in sorted(manifest["parts"].items()) if buckets is None or not b.isdigit() or int(b) in buckets]
        if not parts:
            df = self.spark.createDataFrame([], target)
        else:
            renamed = RENAMED.get((name, manifest["version"]), {})
            paths = [f"{self.path}/{name}/{f}" for f in parts]
            if manifest["version"] == VERSION:
                df = self.spark.read.schema(target).parquet(*paths)
            else:
                old = self.spark.read.option("mergeSchema", "true").parquet(*paths)
                df = self._fitted(name, old.withColumnsRenamed({a: b for a, b in renamed.items() if a in old.columns}))
        for column, value in keys.items():
            df = df.filter(F.col(column) == value)
        return df

    def read_keys(self, name: str, keys: list[str]) -> DataFrame:
        """The rows of a few keys: only their buckets are read, and the filter reaches the files."""
        manifest, key = self.manifest(name), KEYS[name]
        buckets = None if manifest is None else sorted({zlib.crc32(k.encode()) % manifest["buckets"] for k in keys})
        return self.read(name, buckets).filter(F.col(key).isin(keys))

    def migrate(self) -> list[str]:
        """Write the tables of older versions anew in the present layout; returns their names. Each is whole before and after its own step, so a stopped migration goes on where it stood."""
        old = [n for n in DDL if (m := self.manifest(n)) is not None and m["version"] != VERSION]
        for name in old:
            self.write(name, self.read(name))
        return old

    def upsert(self, name: str, fresh: DataFrame, keys: list[str]) -> None:
        """Rows of fresh replace those with the same keys."""
        self.write(name, latest_wins(self.read(name), fresh, keys))

    def hashes(self) -> DataFrame:
        """path, content_hash of the files indexed with one."""
        return self.read("nodes").filter(F.length("content_hash") > 0).select("path", "content_hash")

    def meta(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.read("meta").collect()}

    def put_meta(self, known: dict[str, str] | None = None, **values: object) -> dict[str, str]:
        """Set values beside those that are there (known, if the caller has read them); returns all."""
        rows = {**(self.meta() if known is None else known), **{k: str(v) for k, v in values.items()}}
        table = self.spark.createDataFrame(sorted(rows.items()), schema("meta")).coalesce(1)
        self._point("meta", {"version": VERSION, "buckets": 1, "parts": self._written("meta", table, 1)})
        return rows

    def size_bytes(self) -> int:
        fs = self._fs()
        return int(fs.getContentSummary(self._path()).getLength()) if fs.exists(self._path()) else 0


TABLES = tuple(DDL)
