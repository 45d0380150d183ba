"""What a session needs once: this package on the executors, and tables that are derived once."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import wraps
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_derived: dict[tuple[str, str, str], DataFrame] = {}


#: Rows of an Arrow batch between the JVM and Python, where the session has Spark's own default: texts are long, and both sides hold a batch.
ARROW_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application (as --py-files would), and bound the batches they get."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        to = Path(tempfile.mkdtemp(prefix="quarrygraph-")) / f"{root.name}.zip"
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(to))
        _shipped.add(context.applicationId)


def shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """f, after the package has been sent."""

    @wraps(f)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return query


def together(*jobs: Callable[[], object]) -> list:
    """Results of jobs that do not need one another, run at once: many small jobs of one driver would leave the executors idle one after another. The first error is raised."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(job)) for job in jobs]]


def once(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """f's table, checkpointed when it is first asked for in an application, and shared from then on: as an index is built once and queried often."""
    from quarrygraph.operators.tables import pinned

    @wraps(f)
    def table(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, f.__name__, sf_dir)
        if key not in _derived:
            _derived[key] = pinned(f(spark, sf_dir))
        return _derived[key]

    return table
