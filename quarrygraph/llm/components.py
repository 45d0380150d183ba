"""Connected components of an edge list by alternating large-star and small-star steps, as joins and aggregates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.llm.common import stored


def _least(edges: DataFrame) -> DataFrame:
    """For each u of (u, v), the least of u and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


#: Edges that one task may hold.
TASK_EDGES = 1_000_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    """components of an edge list whose length has been checked, by union and find."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        up: dict[int, int] = {}

        def root(i: int) -> int:
            while up.setdefault(i, i) != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
        ids = sorted(up)
        return pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "component": pd.Series([root(i) for i in ids], dtype="int64")})

    return edges.groupBy(F.lit(0).alias("one")).applyInPandas(run, "id long, component long")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of long ids, in any order and repeated, loops allowed -> (id, component): the least id that each end can reach.

    An id that is its own component's least is returned too. No edges: no rows. Ends of a null edge are ignored. Up to TASK_EDGES different edges
    are one task's union and find; beyond that stars are made larger and smaller until nothing changes. Each such step pre-aggregates and
    joins on the node, so that a node with very many edges is summed before it is shuffled and split by adaptive execution where it is joined.
    """
    cur = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    if cur.count() <= TASK_EDGES:
        return _in_one_task(cur)
    before = None
    while True:
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not state[0] or tuple(state) == before:
            break
        before = tuple(state)
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.filter("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # each edge now points to a smaller id
        least = _least(large)
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        cur = stored(small.filter("u <> v").distinct(), "edges")
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).union(cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
