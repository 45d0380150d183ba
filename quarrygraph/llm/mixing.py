"""Mixing sources to target weights by temperature, with DataFrame functions only.

Source i with token share p_i gets a weight in proportion to p_i ** a. The exponent a is bisected (several interior points a job) to the least that
meets the repetition limit, or to the one that meets a target entropy. Weights become a budget of epochs for each source: whole epochs take
every row, and the last, partial epoch takes the head of a permutation of the source's blocks until its tokens are spent.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.llm.common import stored

#: Interior points that one job tries; jobs of a bisection; rows of a block, about; blocks of a source in one group of the prefix sum.
POINTS, JOBS, BLOCK_ROWS, GROUP = 15, 8, 1024, 1024
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _bisect(measure, met, low: float = 0.0, high: float = 1.0) -> float:
    """The least exponent in [low, high] that is met (met rises from False to True); high if none is. measure: exponents -> values, in one job."""
    ends = measure([low, high])
    if met(ends[0]):
        return low
    for _ in range(JOBS if met(ends[1]) else 0):
        points = [low + (high - low) * k / (POINTS + 1) for k in range(1, POINTS + 1)]
        for point, value in zip(points, measure(points), strict=True):
            if met(value):
                high = point
                break
            low = point
    return high


def exponent(sources: DataFrame, max_repeats: float | None = None, target_entropy: float | None = None) -> float:
    """Exponent for sources (source, n_tokens): the least in [0, 1] at which no source is repeated more than max_repeats times as often as
    the one repeated least; or, given a target entropy in nats, the greatest in [0, 1] that reaches it (0 if none does).

    Sources without tokens have no part. Without any source with tokens: 1.
    """
    shares = sources.filter("n_tokens > 0").select(F.log(F.col("n_tokens").cast("double")).alias("l"))
    top = shares.agg(F.max("l")).first()[0]
    if top is None:
        return 1.0
    x = F.col("l") - F.lit(top)
    if target_entropy is not None:

        def entropy(points: list[float]) -> list[float]:
            cols = [c for k, a in enumerate(points) for c in (F.sum(F.exp(x * a)).alias(f"z{k}"), F.sum(F.exp(x * a) * x * a).alias(f"s{k}"))]
            r = shares.agg(*cols).first()
            # H = ln Z - sum(w ln u) with u = exp(a x) and w = u / Z
            return [math.log(r[f"z{k}"]) - r[f"s{k}"] / r[f"z{k}"] for k in range(len(points))]

        # entropy falls with the exponent: the least exponent below the target bounds the greatest that reaches it
        return _bisect(entropy, lambda h: h < target_entropy)

    def spread(points: list[float]) -> list[float]:
        # epochs are in proportion to exp((a - 1) x)
        r = shares.agg(*(c for k, a in enumerate(points) for c in (F.max(x * (a - 1)).alias(f"h{k}"), F.min(x * (a - 1)).alias(f"l{k}")))).first()
        return [math.exp(min(700.0, r[f"h{k}"] - r[f"l{k}"])) for k in range(len(points))]

    limit = 2.0 if max_repeats is None else max_repeats
    return _bisect(spread, lambda s: s <= limit)


#: Sources up to which a table of one row for each source is broadcast.
BROADCAST_SOURCES, SALTS = 100_000, 32


def _with_source(rows: DataFrame, small: DataFrame, n_sources: int) -> DataFrame:
    """rows (key, source, ...) with the row of small (s, ...) for their source, null included.

    A source may hold a third of all rows, so rows aren't dealt by source: small is broadcast up to BROADCAST_SOURCES rows; beyond that it is
    repeated SALTS times and rows are dealt by source and a hash of their key.
    """
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(small), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    spread = small.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s_salt"))
    salted = rows.withColumn("r_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, F.col("source").eqNullSafe(F.col("s")) & (F.col("r_salt") == F.col("s_salt"))).drop("s", "s_salt", "r_salt")


def plan(rows: DataFrame, max_repeats: float | None = 2.0, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """For rows (key, source, n_tokens), a stored table: source, weight, blocks, full (whole epochs), and turn, block, place of the last row that the partial epoch
    after them takes (turn is -1 if it takes none, 2 if it takes all).

    budget is the tokens of the mixture; by default, the least with which every source appears whole at least once.
    """
    sources = stored(rows.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows")), "sources")
    a = exponent(sources, max_repeats, target_entropy)
    power = F.when(F.col("n_tokens") > 0, F.pow(F.col("n_tokens").cast("double"), F.lit(a))).otherwise(0.0)
    total = sources.agg(F.sum(power).alias("z"), F.max(F.when(F.col("n_tokens") > 0, F.col("n_tokens") / power)).alias("most")).first()
    z, most = total["z"] or 1.0, total["most"] or 0.0
    spend = float(budget) if budget is not None else most * z
    epochs = F.when(F.col("n_tokens") > 0, F.lit(spend) * power / F.lit(z) / F.col("n_tokens")).otherwise(1.0)
    # a millionth of an epoch is rounding
    full = F.floor(epochs + 1e-6)
    dealt = stored(
        sources.select(
            "source", (power / F.lit(z)).alias("weight"), full.cast("long").alias("full"), F.greatest(F.lit(0.0), (epochs - full) * F.col("n_tokens")).alias("left"),
            F.greatest(F.lit(1), F.ceil(F.col("n_rows") / BLOCK_ROWS)).cast("long").alias("blocks"),
        ),
        "dealt",
    )
    partial = dealt.filter("left > 0").select(F.col("source").alias("s"), "full", "left", "blocks")
    placed = _with_source(rows, partial, dealt.count()).withColumn("block", home("key", F.col("blocks")))
    epoch = F.col("full") + 1
    sums = placed.groupBy("source", "left", "blocks", "full", "block").agg(F.sum("n_tokens").alias("t")).withColumn("turn", turn("source", epoch, F.col("block")))
    sums = stored(sums.withColumn("g", F.floor(F.col("turn") * F.ceil(F.col("blocks") / GROUP)).cast("long")), "blocks")
    # prefix sums in the order of turns in two steps, so that no task holds all blocks of a source
    groups = sums.groupBy("source", "g").agg(F.sum("t").alias("gt"))
    groups = groups.withColumn("g_before", F.sum("gt").over(Window.partitionBy("source").orderBy("g")) - F.col("gt")).drop("gt")
    sums = sums.alias("x").join(groups.alias("y"), F.expr("x.source <=> y.source AND x.g = y.g")).select("x.*", "y.g_before")
    sums = sums.withColumn("before", F.col("g_before") + F.sum("t").over(Window.partitionBy("source", "g").orderBy("turn", "block")) - F.col("t"))
    edge = sums.filter("before < left AND before + t >= left").select(F.col("source").alias("s"), F.col("block").alias("e"), "turn", "before")
    inside = _with_source(placed, edge, dealt.count()).filter(F.col("block") == F.col("e")).select("source", "left", "before", "turn", "block", "n_tokens", position("key", epoch).alias("place"))
    running = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("place").rangeBetween(Window.unboundedPreceding, 0))
    # the first row that spends the rest is the last one taken
    cut = inside.withColumn("after", F.col("before") + running).filter("after >= left").groupBy("source", "turn", "block").agg(F.min("place").alias("place"))
    out = dealt.alias("d").join(cut.alias("c"), F.expr("d.source <=> c.source"), "left")
    none = F.when(F.col("left") > 0, 2.0).otherwise(-1.0)
    return out.select("d.source", "weight", "blocks", "full", F.coalesce("c.turn", none).alias("turn"), F.coalesce("c.block", F.lit(-1)).cast("long").alias("block"), F.coalesce("c.place", F.lit(-1.0)).alias("place"))


def _unit(*values: Column) -> Column:
    """A hash in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(2027).cast("long"), *values), 11) * F.lit(2.0**-53)


def home(key: str, blocks: Column) -> Column:
    """Block of a row, the same in every epoch."""
    return F.floor(_unit(F.lit("home"), F.col(key)) * blocks).cast("long")


def turn(source: str, epoch: Column, block: Column) -> Column:
    """Place in [0, 1) of a block in an epoch's permutation of its source's blocks (ties go by block)."""
    return _unit(F.lit("turn"), F.col(source), epoch.cast("long"), block.cast("long"))


def position(key: str, epoch: Column) -> Column:
    """Place in [0, 1) of a row in its block, in an epoch."""
    return _unit(F.lit("place"), epoch.cast("long"), F.col(key))


def mix(docs: DataFrame, max_repeats: float | None = 2.0, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block, turn, place: a row for each time that a document is taken.

    block is one of the blocks that the budget is cut in, turn its place in the epoch's permutation of blocks, place that of the row in its block. Read in the order of
    epoch, turn, block and place, the sources' shares are their weights. A null source is a source of its own; null or blank text has no tokens and, in a source of such texts only, one epoch.
    Rows that share a doc_id are taken together; an empty table gives none; other columns are not read.
    """
    rows = _tokens(docs)
    taken = _taken(rows, plan(rows, max_repeats, target_entropy, budget), ["key", "source", "n_tokens"])
    block = F.col("block")
    return taken.select(F.col("key").alias("doc_id"), "source", "n_tokens", "epoch", "block", turn("source", F.col("epoch"), block).alias("turn"), position("key", F.col("epoch")).alias("place"))


def _tokens(docs: DataFrame) -> DataFrame:
    return stored(docs.select(F.col("doc_id").cast("long").alias("key"), F.col("source").cast("string").alias("source"), tokens(F.col("text")).alias("n_tokens")), "tokens")


def _taken(rows: DataFrame, planned: DataFrame, names: list[str]) -> DataFrame:
    """The named columns of rows (key, source, ...), epoch and block, a row for each time that it is taken."""
    p = stored(planned.select(F.col("source").alias("s"), F.col("blocks").alias("p_blocks"), F.col("full").alias("p_full"), F.struct("turn", "block", "place").alias("p_cut")), "plan")
    joined = _with_source(rows, p, p.count()).withColumn("p_block", home("key", F.col("p_blocks")))
    epoch = F.col("p_full") + 1
    here = F.struct(turn("source", epoch, F.col("p_block")).alias("turn"), F.col("p_block").alias("block"), position("key", epoch).alias("place"))
    last = F.when(here <= F.col("p_cut"), 1).otherwise(0)
    times = F.when(F.col("p_full") + last > 0, F.sequence(F.lit(1).cast("long"), F.col("p_full") + last)).otherwise(F.array().cast("array<long>"))
    return joined.select(*names, F.col("p_block").alias("block"), F.explode(times).alias("epoch"))


def mixture(docs: DataFrame, max_repeats: float | None = 2.0, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """docs, all columns, each row as often as mix takes its document.

    Null and blank texts stay (in a source with other texts, as often as its other rows); a null source is one of its own; a null doc_id is a key like any other;
    rows that share a doc_id are taken together; an empty table gives none; clashing extra columns are kept as they are.
    """
    names = docs.columns
    planned = plan(_tokens(docs), max_repeats, target_entropy, budget)
    inner = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("source").cast("string").alias("source"), F.struct(*(F.col(f"`{n}`") for n in names)).alias("whole"))
    return _taken(inner, planned, ["whole"]).select("whole.*")
