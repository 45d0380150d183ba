"""Source divergence audit: how far the sources of a language are apart in their terms, and which terms set a source apart.

Terms are counted in each slice of texts before they are shuffled. Shares are whole numbers (parts of 10 ** 9, smoothed). Pairs of sources are sparse: where neither source has a
term, both shares are their baselines, so a pair begins with the baselines' difference for every term and is corrected only where one of the two has the term. The top terms of each
group are found by radix selection: histograms of ten bits of the values at a time give each group's kth value, and ties go on by two bytes of the term at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.llm.common import _LOWER, parts, stored, text_slices

#: Documents of a language that a kept term stands in at least; added to each count; shares are parts of SCALE; terms ranked.
LEAST_DOCS, ADD, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Terms of one bucket of the pair sums at most, and of its matrix of terms by sources; rows of a table that may be broadcast.
BUCKET_TERMS, MATRIX, BROADCAST_ROWS = 2048, 1 << 21, 100_000

_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def term_array(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms (runs of A-Z, a-z and characters beyond ASCII, only A-Z lower-cased) in texts that stand one after another at offsets `at`, and the text of each."""
    inside = _TERM[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    where = np.cumsum(inside)
    offsets = np.concatenate([where[start] - 1, where[-1:]]).astype(np.int64) if len(data) else np.zeros(1, np.int64)
    terms = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(_LOWER[data[inside]]))])
    return terms, np.searchsorted(at, start, "right") - 1


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents), summed over all documents. Null lang, source and text are ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            lang, source = (c.dictionary_encode() for c in b.columns[:2])
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            for i, j, data, at in text_slices(b.column(2)):
                terms, owner = term_array(data, at)
                if not len(terms):
                    continue
                coded = terms.dictionary_encode()
                size = len(coded.dictionary)
                code = coded.indices.to_numpy().astype(np.int64)
                each, n = np.unique(owner * size + code, return_counts=True)  # document and term
                doc, term = each // size, each % size
                pair, back = np.unique(group[i:j][doc] * size + term, return_inverse=True)
                of, term = pair // size, pair % size
                yield pa.record_batch([
                    lang.dictionary.take(pa.array(of // len(source.dictionary))), source.dictionary.take(pa.array(of % len(source.dictionary))), pc.cast(coded.dictionary.take(pa.array(term)), pa.string()),
                    pa.array(np.bincount(back, n, len(pair)).astype(np.int64)), pa.array(np.bincount(back, minlength=len(pair)).astype(np.int64)),
                ], ["lang", "source", "term", "n", "docs"])

    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = plain.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + ADD) / (total + ADD * terms)), in two steps that stay within 64 bits for totals up to 2.8e14."""
    whole, high, low = total + ADD * terms, 31_250, 32_000
    first = (n + ADD) * high
    div = lambda x: F.call_function("div", x, whole)
    return 1 + div(first) * low + div(F.pmod(first, whole) * low)


def cells_and_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two stored tables. Cells: lang, source, term, n, p and q (shares in the group and in the language) where a group has a kept term. Groups: lang, source, total, terms
    (kept by the language), sources (of the language), lang_total and base (the share of a term that the group doesn't have), for every group that occurs.
    """
    counts = stored(term_counts(docs), "terms")
    within = Window.partitionBy("lang", "term")
    spread = counts.select("lang", "source", "term", "n", F.sum("docs").over(within).alias("in_docs"), F.sum("n").over(within).alias("lang_n"))
    kept = stored(spread.filter(F.col("in_docs") >= LEAST_DOCS).drop("in_docs"), "kept")
    there = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    vocabulary = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    size = there.groupBy("lang").agg(F.count("*").alias("sources")).join(vocabulary, "lang", "left")
    sized = there.join(totals, ["lang", "source"], "left").join(size, "lang", "left")
    zero = F.lit(0).cast("long")
    sized = sized.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "terms", "lang_total")), "sources")
    base = F.when(F.col("terms") > 0, share(zero, F.col("total"), F.col("terms"))).otherwise(zero)
    groups = stored(sized.withColumn("base", base), "groups")
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    cells = kept.join(small(groups.select("lang", "source", "total", "terms", "lang_total")), ["lang", "source"])
    return stored(cells.select("lang", "source", "term", "n", p.alias("p"), q.alias("q")), "cells"), groups


def small(table: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it has BROADCAST_ROWS rows or fewer; else joined by merging, where Spark splits large keys."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table.hint("merge")


def pair_sums(terms: list[str], sources: list[str], p: np.ndarray, names: list[str], base: np.ndarray) -> np.ndarray:
    """Sums over these terms (cells: terms, sources, p) of |p of a - p of b| for all pairs (a, b) of names, whose shares of absent terms are base.

    Pairs start from the baselines' distance for each term; a term corrects the pairs of the sources that have it.
    """
    row, held = pd.factorize(pd.Series(terms, dtype=object))
    column = pd.Index(names).get_indexer(sources)
    away = np.abs(base[:, None] - base[None, :])
    out = away * len(held)
    shares = np.tile(base, (len(held), 1))
    shares[row, column] = p
    has = np.zeros(shares.shape, bool)
    has[row, column] = True
    for a in range(len(names)):
        rows = np.flatnonzero(has[:, a])
        if len(rows):
            more = np.abs(shares[rows, a][:, None] - shares[rows]) - away[a]
            more[:, :a][has[rows, :a]] = 0  # a source before a that has the term too has corrected this pair
            more = more.sum(0)
            out[a] += more
            out[:, a] += more
    return out


def pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value: the sum of |p - q| over the language's kept terms (0 without any).

    A language's terms are dealt to buckets of so many terms that a bucket's matrix of terms by sources is bounded; its groups go to each of its buckets. Rows of sums, and no
    pairs of single cells, leave a bucket.
    """
    each = F.greatest(F.lit(1), F.least(F.lit(BUCKET_TERMS), F.floor(F.lit(MATRIX) / F.col("sources"))))
    sized = groups.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("terms") / each)).cast("int"))
    of_lang = small(stored(sized.select("lang", "buckets").distinct(), "buckets"))
    dealt = cells.join(of_lang, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"), "term", "source", "p")
    there = sized.select("lang", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), "source", "base")

    def run(cell: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("source")
        names, base = group["source"].tolist(), group["base"].to_numpy(np.int64)
        sums = pair_sums(cell["term"].tolist(), cell["source"].tolist(), cell["p"].to_numpy(np.int64), names, base)
        a, b = np.nonzero(~np.eye(len(names), dtype=bool))
        at = np.array(names, object)
        return pd.DataFrame({"lang": group["lang"].iloc[0] if len(group) else "", "source": at[a], "item": at[b], "value": sums[a, b]})

    made = dealt.groupBy("lang", "bucket").cogroup(there.groupBy("lang", "bucket")).applyInPandas(run, "lang string, source string, item string, value long")
    return made.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _chosen(histogram: DataFrame, digit: Column) -> DataFrame:
    """For each group of histogram (lang, source, need, digit, n), in the order of digit: the digit that its need-th row has, the rows left to find among that digit's, and their number."""
    order = Window.partitionBy("lang", "source").orderBy(digit)
    running = histogram.withColumn("up_to", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = running.filter((F.col("up_to") >= F.col("need")) & (F.col("up_to") - F.col("n") < F.col("need")))
    return found.select("lang", "source", "digit", (F.col("need") - F.col("up_to") + F.col("n")).alias("need"), "n")


def top(rows: DataFrame, k: int = TOP) -> DataFrame:
    """The rows (lang, source, item, value) of each group (lang, source) that are its first k by value descending and UTF-8 bytes of the item ascending, by radix selection; items
    are distinct in a group and values below 2 ** 30. No group is sorted: three histograms of ten bits of the values find the kth value, and while more rows tie than are needed, a
    histogram of two bytes more of the items does. Groups of fewer rows are whole.
    """
    rows = stored(rows, "ranked")
    state = None
    for shift in (20, 10, 0):
        digit = F.shiftright("value", shift).bitwiseAND(1023).alias("digit")
        if state is None:
            histogram = rows.select("lang", "source", F.lit(k).cast("long").alias("need"), F.lit(0).cast("long").alias("above"), digit)
        else:
            histogram = rows.join(small(state), ["lang", "source"]).filter(F.shiftright("value", shift + 10) == F.col("above")).select("lang", "source", "need", "above", digit)
        histogram = histogram.groupBy("lang", "source", "need", "above", "digit").agg(F.count("*").alias("n"))
        above = histogram.select("lang", "source", "above").distinct()
        state = _chosen(histogram, F.desc("digit")).join(above, ["lang", "source"]).select("lang", "source", (F.col("above") * 1024 + F.col("digit")).alias("above"), "need", "n")
        state = stored(state, "threshold")
    # a group without a kth row is not in state and is taken whole; ties of the kth value go on by bytes
    state = stored(state.select("lang", "source", F.col("above").alias("least"), "need", "n", F.lit(b"").alias("until")), "ties")
    ties = stored(rows.join(small(state.select("lang", "source", "least")), ["lang", "source"]).filter(F.col("value") == F.col("least")).select("lang", "source", F.encode("item", "UTF-8").alias("bytes")), "tied")
    while not state.filter("n > need").isEmpty():
        ended, still = state.filter("n <= need"), state.filter("n > need")
        length = F.length("until")
        inside = ties.join(small(still.drop("n")), ["lang", "source"]).filter(F.substring("bytes", F.lit(1), length) == F.col("until"))
        histogram = inside.groupBy("lang", "source", "need", "least", "until", F.substring("bytes", length + 1, F.lit(2)).alias("digit")).agg(F.count("*").alias("n"))
        further = _chosen(histogram, F.asc("digit")).join(still.select("lang", "source", "least", "until"), ["lang", "source"])
        state = stored(ended.unionByName(further.select("lang", "source", "least", "need", "n", F.concat("until", "digit").alias("until"))), "ties")
    edge = state.select("lang", "source", "least", "until")
    bytes_ = F.encode("item", "UTF-8")
    within = F.col("least").isNull() | (F.col("value") > F.col("least")) | ((F.col("value") == F.col("least")) & (F.substring(bytes_, F.lit(1), F.length("until")) <= F.col("until")))
    return rows.join(small(edge), ["lang", "source"], "left").filter(within).select("lang", "source", "item", "value")


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: for each group (lang, source), each other source of the language by the sum of |p - q| over the language's kept terms. Part `term`: the TOP kept terms that the
    group has and whose share p is above the language's q, by p - q. rank is from 1 in each group and part, by value descending, then by UTF-8 bytes of the item.
    Null lang, source and text count as ''. A group without terms has pairs only; a language with one source has no pairs, and one without kept terms pairs of value 0. Repeated rows are
    documents of their own; an empty table gives no rows; other columns are not read.
    """
    cells, groups = cells_and_groups(docs)
    apart = cells.filter("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    found = pairs(cells, groups).withColumn("part", F.lit("pair")).unionByName(top(apart).withColumn("part", F.lit("term")))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return found.select("lang", "source", "part", "item", "value", rank.alias("rank"))
