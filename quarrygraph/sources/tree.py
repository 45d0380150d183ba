"""Two data sources of repositories: the files under a folder (`repository_tree`) and what git tells (`repository_log`), both listed in tasks.

The tree is walked on the driver only until there are enough folders to deal out (at most SEED_FOLDERS are opened for that); each task walks its own. The log is cut into
ranges of commits, and each task asks git for its range. Filters on path, length, is_merge and ts reach the readers.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, Not, StringStartsWith

from quarrygraph import params as P

#: Folders that the driver opens at most to find work for all tasks; rows of a batch; commits of one task.
SEED_FOLDERS, BATCH_ROWS, TASK_COMMITS = 512, 4096, 2000
#: One record a commit: its header in fields, then one line for each file.
LOG_FORMAT = "%x00%H%x1f%an%x1f%ae%x1f%ct%x1f%P%x1f%s"


def file_system(root: str) -> tuple[pafs.FileSystem, str]:
    """A file system that also sees names with a leading dot or underscore, which Spark's own sources skip; and the root in it."""
    if "://" in root or root.startswith("file:"):
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), root


class Folders(InputPartition):
    """Files that are known already, and folders to walk."""

    def __init__(self, files: list[tuple], folders: list[str]):
        super().__init__(None)
        self.files, self.folders = files, folders


class TreeReader(DataSourceReader):
    """Files under a root, blocked folders not entered."""

    def __init__(self, root: str, tasks: int):
        self.root, self.tasks = root.rstrip("/"), tasks
        self.longest: int | None = None
        self.prefixes: list[str] = []
        self.exact: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, LessThanOrEqual | LessThan) and f.attribute == ("length",):
                most = f.value if isinstance(f, LessThanOrEqual) else f.value - 1
                self.longest = most if self.longest is None else min(self.longest, most)
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.prefixes.append(f.value)
            elif isinstance(f, EqualTo | In) and f.attribute == ("path",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.exact = named if self.exact is None else self.exact & named
            else:
                yield f

    def _fits(self, path: str, size: int) -> bool:
        return (self.longest is None or size <= self.longest) and all(path.startswith(p) for p in self.prefixes) and (self.exact is None or path in self.exact)

    def _may_hold(self, folder: str) -> bool:
        """Whether a file that fits may stand below a folder (path with a slash at the end)."""
        return all(folder.startswith(p) or p.startswith(folder) for p in self.prefixes) and (self.exact is None or any(x.startswith(folder) for x in self.exact))

    def _open(self, fs: pafs.FileSystem, base: str, folder: str) -> tuple[list[tuple], list[str]]:
        files, below = [], []
        for info in fs.get_file_info(pafs.FileSelector(folder)):
            path = info.path[len(base) :].lstrip("/")
            if info.type == pafs.FileType.Directory:
                if info.base_name not in P.BLOCKED_DIRS and self._may_hold(path + "/"):
                    below.append(info.path)
            elif info.type == pafs.FileType.File and self._fits(path, info.size):
                files.append((path, info.path, info.size, info.mtime.replace(tzinfo=None) if info.mtime else None))
        return files, below

    def partitions(self) -> list[InputPartition]:
        fs, base = file_system(self.root)
        files, folders, opened = [], [base], 0
        while folders and len(folders) < 4 * self.tasks and opened < SEED_FOLDERS:
            more, below = self._open(fs, base, folders.pop(0))
            files += more
            folders += below
            opened += 1
        n = max(1, min(4 * self.tasks, len(folders)))
        return [Folders(files[i::n], folders[i::n]) for i in range(n)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(self.root)
        rows, folders = list(partition.files), list(partition.folders)
        while folders or rows:
            while folders and len(rows) < BATCH_ROWS:
                more, below = self._open(fs, base, folders.pop())
                rows += more
                folders += below
            for i in range(0, len(rows), BATCH_ROWS):
                part = rows[i : i + BATCH_ROWS]
                columns = list(zip(*part, strict=True))
                yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.timestamp("us", "UTC"))], ["path", "abs_path", "length", "modificationTime"])
            rows = []


class Tree(DataSource):
    """Options: path (a folder that the executors see too, or a URI), tasks."""

    @classmethod
    def name(cls) -> str:
        return "repository_tree"

    def schema(self) -> str:
        return "path string, abs_path string, length long, modificationTime timestamp"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options["path"], int(self.options.get("tasks", "8")))


class Commits(InputPartition):
    """A range of the log of one commit."""

    def __init__(self, skip: int, count: int):
        super().__init__(None)
        self.skip, self.count = skip, count


def git(repo: str, *args: str, timeout: int = 600) -> str:
    """What git prints; an error of git, and a run that takes too long, is raised."""
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, check=True, timeout=timeout).stdout.decode("utf-8", "replace")


class LogReader(DataSourceReader):
    """Records of LOG_FORMAT, in the order of git's log."""

    def __init__(self, repo: str, head: str, since: str | None):
        self.repo, self.span = repo, [head] + ([f"^{since}"] if since else [])
        self.only: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            plain = isinstance(f, EqualTo) and f.attribute == ("is_merge",) and f.value is False or isinstance(f, Not) and isinstance(f.child, EqualTo) and f.child.attribute == ("is_merge",) and f.child.value is True
            if plain:
                self.only.append("--no-merges")
                continue
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("ts",) and isinstance(f.value, datetime):
                # git compares whole seconds; Spark still tests the rest
                self.only.append(f"--since-as-filter={int(f.value.timestamp())}")
            yield f

    def partitions(self) -> list[InputPartition]:
        # counting doesn't know --since-as-filter, so ranges are cut without it
        n = int(git(self.repo, "rev-list", "--count", *[x for x in self.only if x == "--no-merges"], *self.span))
        return [Commits(i, TASK_COMMITS) for i in range(0, n, TASK_COMMITS)] or [Commits(0, 0)]

    def read(self, partition: Commits) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        call = ["git", "-C", self.repo, "log", "--numstat", f"--format={LOG_FORMAT}", f"--skip={partition.skip}", f"--max-count={partition.count}", *self.only, *self.span]
        with subprocess.Popen(call, stdout=subprocess.PIPE, stderr=subprocess.PIPE) as run:
            held = b""
            while block := run.stdout.read(1 << 22):
                *records, held = (held + block).split(b"\0")
                yield self._batch(records)
            yield self._batch([held])
            error = run.stderr.read()
        if run.returncode:
            raise RuntimeError(error.decode("utf-8", "replace"))

    @staticmethod
    def _batch(records: list[bytes]) -> pa.RecordBatch:
        rows = []
        for r in records:
            text = r.decode("utf-8", "replace")
            fields = text.split("\n", 1)[0].split("\x1f")
            if len(fields) >= 6:
                rows.append((text, len(fields[4].split()) > 1, int(fields[3]) * 1_000_000 if fields[3].isdigit() else None))
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        return pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.timestamp("us", "UTC"))], ["value", "is_merge", "ts"])


class TrackedReader(DataSourceReader):
    """Paths in git's index, which is one file and so one task."""

    def __init__(self, repo: str):
        self.repo = repo

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        paths = [x for x in git(self.repo, "ls-files", "-z", timeout=3600).split("\0") if x]
        for i in range(0, len(paths), BATCH_ROWS):
            part = paths[i : i + BATCH_ROWS]
            yield pa.record_batch([pa.array(part, pa.string()), pa.array([False] * len(part)), pa.array([None] * len(part), pa.timestamp("us", "UTC"))], ["value", "is_merge", "ts"])


class Log(DataSource):
    """Options: path (a repository that the executors see too), head and since (commits; since and all before it are left out), tracked (true: the tracked paths instead)."""

    @classmethod
    def name(cls) -> str:
        return "repository_log"

    def schema(self) -> str:
        return "value string, is_merge boolean, ts timestamp"

    def reader(self, schema) -> DataSourceReader:
        if self.options.get("tracked") == "true":
            return TrackedReader(self.options["path"])
        return LogReader(self.options["path"], self.options.get("head", "HEAD"), self.options.get("since"))


def register(spark: SparkSession) -> None:
    """Make both sources known to the session, with their filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Tree)
    spark.dataSource.register(Log)


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, abs_path, length, modificationTime of every file under root."""
    register(spark)
    return spark.read.format("repository_tree").option("path", root).option("tasks", str(spark.sparkContext.defaultParallelism)).load()
