"""Filter interaction audit: what each order of applying filters keeps, from one count for each combination of failed filters.

Each document gets a mask of the filters it fails. A part's documents are counted by mask, and a subset-zeta transform of the counts gives the survivors of every
subset of filters. A step of an order goes from one subset to that subset with one filter more, so what it removes is a difference of two survivor counts; so it
is for labelled documents. No order is run over documents.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.llm.common import stored

_SPACES = "[\\x20\\x09-\\x0D]+"


def text_failures() -> dict[str, Column]:
    """The filters that a text decides alone, by letter: under 200 words; under half of the words distinct; over 2 % capitals; one of `#$%&*|`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, _SPACES), "")
    n = F.size("words")
    return {"words": words, "A": n < 200, "B": 100 * F.size(F.array_distinct("words")).cast("long") < 50 * n.cast("long"), "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text).cast("long"), "D": text.rlike("[#$%&*|]")}


def masks(docs: DataFrame) -> DataFrame:
    """part, digest (SHA-256 of the text), key (doc_id), mask and n: documents by the bits of A to D (1, 2, 4, 8) that they fail. Rows that share all of it are one with n of them."""
    f = text_failures()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("key"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    read = plain.select("key", "part", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), "text", f["words"].alias("words"))
    bits = sum((F.when(f[x], F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate("ABCD")), F.lit(0))
    return read.select("key", "part", "digest", bits.alias("mask")).groupBy("key", "part", "digest", "mask").agg(F.count("*").alias("n"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (key, digest, ...) with good and toxic: whether a row of labels says quality = 1 or toxic = 1 of the key. A null key has no labels; such rows are dealt by digest."""
    said = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").cast("string").alias("l_key"))
    said = said.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    joined = rows.join(said, F.coalesce(F.col("key").cast("string"), F.hex("digest")) == F.col("l_key"), "left")
    return joined.select(*rows.columns, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def with_repeats(rows: DataFrame, bit: int) -> DataFrame:
    """(part, mask, good, toxic, n) of rows (key, part, digest, mask, n, good, toxic): bit is set where the text stands under a smaller key too, in any part.

    A text may be that of a third of all documents: its rows are summed before they are dealt by digest, to one for each part, mask and labels, with the least key.
    A null key is no smaller one and has none.
    """
    known = F.col("key").isNotNull()
    summed = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_null"), F.min("key").alias("least"), F.coalesce(F.min_by("n", "key"), F.lit(0)).alias("n_least")
    )
    first = F.when(F.col("least") == F.min("least").over(Window.partitionBy("digest")), F.col("n_least")).otherwise(0)
    held = summed.withColumn("first", F.coalesce(first, F.lit(0)))
    both = F.array(F.struct(F.col("mask"), (F.col("first") + F.col("n_null")).alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("first")).alias("n")))
    each = held.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.mask", "x.n").filter("n > 0")
    return each.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def survivors(counts: DataFrame, n_filters: int) -> DataFrame:
    """part, and for n, good and toxic an array of 2 ** n_filters: at place S (bits of filters), documents that fail no filter of S. counts: part, mask, good, toxic, n.

    The zeta transform sums counts over all subsets of a mask in one step for each filter; the survivors of S are the sum over the subsets of its complement.
    """
    size, kinds = 1 << n_filters, {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    zero = F.lit(0).cast("long")

    def filled(found: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at(found, i), zero))

    def summed(counted: Column, bit: int) -> Column:
        """To each place with the bit, what the place without it has is added."""
        return F.transform(counted, lambda x, i: x + F.when(i.bitwiseAND(bit) != 0, F.get(counted, i - bit)).otherwise(zero))

    each = counts.groupBy("part", "mask").agg(*(F.sum(F.when(c, F.col("n")).otherwise(zero)).alias(f"c_{k}") for k, c in kinds.items()))
    found = each.groupBy("part").agg(*(F.map_from_entries(F.collect_list(F.struct("mask", f"c_{k}"))).alias(k) for k in kinds))
    out = found.select("part", *(filled(F.col(k)).alias(k) for k in kinds))
    for i in range(n_filters):
        out = out.select("part", *(summed(F.col(k), 1 << i).alias(k) for k in kinds))
    return out.select("part", *(F.reverse(k).alias(k) for k in kinds))


def worths(survive: DataFrame, n_filters: int) -> DataFrame:
    """survive with worth, an array with a place for each filter: what it removes after each subset of the others, times the orders that begin with that subset and go on with it."""
    everything = range(1 << n_filters)

    def worth(i: int) -> Column:
        terms = [(s, math.factorial(s.bit_count()) * math.factorial(n_filters - 1 - s.bit_count())) for s in everything if not s >> i & 1]
        return sum((F.lit(times) * (F.get("n", F.lit(s)) - F.get("n", F.lit(s | 1 << i))) for s, times in terms), F.lit(0).cast("long"))

    return survive.withColumn("worth", F.array(*(worth(i) for i in range(n_filters))))


def steps(survive: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for every order of the letters: differences between neighbouring subsets."""
    count, full = len(letters), (1 << len(letters)) - 1
    orders = F.array(*(F.lit("".join(p)) for p in permutations(letters)))
    rows = worths(survive, count).select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("step"))
    place = {x: F.instr("filter_order", x) for x in letters}
    before = sum((F.when(place[x] < F.col("step"), 1 << i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))
    which = F.instr(F.lit(letters), F.substring(F.col("filter_order"), F.col("step"), F.lit(1))) - 1
    rows = rows.select("*", before.alias("before"), which.alias("which")).withColumn("own", F.expr("shiftleft(1, which)")).withColumn("after", F.col("before") + F.col("own"))
    lost = lambda kind: F.get(kind, F.col("before")) - F.get(kind, F.col("after"))
    fails = F.get("n", F.lit(0)) - F.get("n", F.col("own"))
    alone = F.get("n", F.lit(full) - F.col("own")) - F.get("n", F.lit(full))
    return rows.select(
        "part", "filter_order", "step", F.get("n", F.col("after")).alias("kept"), lost("n").alias("removed"), (fails - lost("n")).alias("redundant"), alone.alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("worth", F.col("which")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part (source) of docs, each of the 120 orders of the filters A to E and each of its five steps, a row of counts of the part's documents.

    part, filter_order, step; kept after the step; removed by it; redundant: fail its filter, but were removed earlier; unique_fails: fail its filter only; good_lost and
    toxic_lost: removed here, with a label quality = 1 or toxic = 1; shapley: removed by this filter, summed over the orders, at any step.
    A to D are text_failures; E: the same text stands under a smaller doc_id, in any part, removed or not. Null text counts as empty, a null source as ''. A null doc_id is
    smaller than none and fails E never; rows that share a doc_id don't make each other fail. Several labels of a doc_id: one of them is enough. An empty table gives none; other
    columns are not read.
    """
    counts = stored(with_repeats(with_labels(masks(docs), labels), 16), "masks")
    return steps(survivors(counts, 5), "ABCDE")
