import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    made = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def sample(spark):
    """(nodes, edges): ten files, eleven edges, two tests, one orphan."""
    n = [
        ("src/main.py", True, False, 0.15), ("src/utils.py", False, False, 0.12), ("src/auth.py", False, False, 0.10), ("src/api.py", False, False, 0.08), ("src/models.py", False, False, 0.06),
        ("src/db.py", False, False, 0.05), ("src/config.py", False, False, 0.04), ("src/orphan.py", False, False, 0.005), ("tests/test_utils.py", False, True, 0.01), ("tests/test_auth.py", False, True, 0.01),
    ]
    rows = [(p, "file", "python", 3, False, e, t, pr, 0.0, "h" + p) for p, e, t, pr in n]
    nodes = spark.createDataFrame(rows, "path string, node_kind string, language string, symbol_count int, has_error boolean, is_entry_point boolean, is_test boolean, pagerank double, betweenness double, content_hash string")
    pairs = [("main", "utils"), ("main", "auth"), ("main", "api"), ("api", "models"), ("api", "db"), ("api", "auth"), ("db", "config")]
    e = [(f"src/{a}.py", f"src/{b}.py", [b], "IMPORTS_FROM") for a, b in pairs]
    e += [(f"tests/test_{x}.py", f"src/{x}.py", [x], "IMPORTS_FROM") for x in ("utils", "auth")] + [(f"src/{x}.py", f"tests/test_{x}.py", [x], "TESTED_BY") for x in ("utils", "auth")]
    return nodes, spark.createDataFrame(e, "source string, target string, imported_names array<string>, edge_type string")
