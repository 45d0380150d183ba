"""Substring dedup by content-defined chunking.

A gear hash rolls over the words of a text (MEMORY words deep). A word is a cut if its hash is the least of some run of SPREAD places: cuts
depend on the words around them only, so an insertion moves no cut beyond its own neighbourhood, and any SPREAD places in a row hold
one. Chunks, the words between two cuts, are deduplicated by digest. A passage of MIN_WORDS words or more that two documents share holds
at least one whole chunk in common (MEMORY - 1 + 2 * SPREAD words at most are needed). Around shared chunks, every window of MIN_WORDS words is
then held against the other documents by a 64-bit digest (independent of the chunks'), and shared windows that touch become one span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.llm.common import mix64, random64, released, stored, text_slices, word_hashes

#: Words that a repeated passage has at least; words that the gear hash remembers; places of which the least hash is a cut.
MIN_WORDS, MEMORY, SPREAD = 51, 4, 24
_ROLL = [np.uint64(x | 1) for x in random64(3, 77).tolist()]


def gear(words: np.ndarray) -> np.ndarray:
    """Gear hash at each word: h = (h << 16) + g(word), which 64 bits make MEMORY words deep."""
    g = mix64(words ^ np.uint64(0xA0761D6478BD642F))
    h = g.copy()
    for k in range(1, MEMORY):
        h[k:] += g[: len(g) - k] << np.uint64(16 * k)
    return mix64(h)


def cuts(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places, among all words, at which a chunk begins. The first MEMORY - 1 words of a row can't be cuts."""
    n = len(words)
    end = np.cumsum(counts)
    start = end - counts
    row = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(n) - start[row]
    h = gear(words)
    valid = inside >= MEMORY - 1
    # the least of every SPREAD places in a row, by doubling; equal hashes: the last place
    h = np.where(valid, h, np.uint64(2**64 - 1))
    size, least = 1, h.copy()
    while size < SPREAD:
        step = min(size, SPREAD - size)
        nxt = least.copy()
        if step < n:
            nxt[: n - step] = np.minimum(least[: n - step], least[step:])
        least, size = nxt, size + step
    # runs that lie within one row's valid places
    ok = valid & (inside + SPREAD <= counts[row])
    at = np.flatnonzero(ok)
    if not len(at):
        return at
    is_cut = np.zeros(n, bool)
    # place i is a cut if some run that holds it has its hash as the least: i.e. h[i] == max over those runs of their least
    best = np.where(ok, least, np.uint64(0))
    size, most = 1, best.copy()
    while size < SPREAD:
        step = min(size, SPREAD - size)
        nxt = most.copy()
        if step < n:
            nxt[step:] = np.maximum(most[step:], most[: n - step])
        most, size = nxt, size + step
    is_cut = valid & (h == most)
    return np.flatnonzero(is_cut)


def _prefix(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(words), _ROLL[k], np.uint64)]))
    inverse = np.uint64(pow(int(_ROLL[k]), -1, 1 << 64))
    back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(words), inverse, np.uint64)]))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix64(words + np.uint64(k)) * powers[:-1], out=total[1:])
    return total, back


def spans_hash(prefix: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Digest of words a..b for each pair, equal for equal words."""
    total, back = prefix
    return mix64((total[b] - total[a]) * back[a])


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, words for each row: two digests of all its words, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in text_slices(batch.column(1)):
                words, counts = word_hashes(data, at, lower=False)
                end = np.cumsum(counts)
                k1, k2 = (spans_hash(_prefix(words, k), end - counts, end) for k in (1, 2))
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(counts)], ["doc_id", "k1", "k2", "words"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, k1 long, k2 long, words long")


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, k1 (digest of all its words), digest, start, n: every chunk between two cuts of a text, in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _j, data, at in text_slices(batch.column(1)):
                words, counts = word_hashes(data, at, lower=False)
                end = np.cumsum(counts)
                c = cuts(words, counts)
                row = np.searchsorted(end, c, "right")
                inner = np.flatnonzero(row[1:] == row[:-1])
                a, b, r = c[:-1][inner], c[1:][inner], row[:-1][inner]
                k1 = spans_hash(_prefix(words, 1), end - counts, end)[r]
                digest = spans_hash(_prefix(words, 0), a, b)
                columns = [ids[i + r].astype(np.int64), k1.view(np.int64), digest.view(np.int64), (a - (end - counts)[r]).astype(np.int32), (b - a).astype(np.int32)]
                yield pa.record_batch([pa.array(x) for x in columns], ["doc_id", "k1", "digest", "start", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, k1 long, digest long, start int, n int")


def _windows(texts: DataFrame) -> DataFrame:
    """doc_id, h, start for every window of MIN_WORDS words that holds one of the row's chunks (at: array<struct<start,n>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            for i, _j, data, at in text_slices(batch.column(1)):
                words, counts = word_hashes(data, at, lower=False)
                first = np.cumsum(counts) - counts
                held = np.zeros(len(words) + 1, np.int64)
                for r in range(len(counts)):
                    if counts[r] >= MIN_WORDS:
                        part = spans[i + r].values
                        s, n = part.field(0).to_numpy(), part.field(1).to_numpy()
                        low = np.maximum(0, s + n - MIN_WORDS)
                        high = np.minimum(s, counts[r] - MIN_WORDS) + 1
                        fits = high > low
                        np.add.at(held, first[r] + low[fits], 1)
                        np.add.at(held, first[r] + high[fits], -1)
                a = np.flatnonzero(np.cumsum(held)[:-1] > 0)
                row = np.searchsorted(np.cumsum(counts), a, "right")
                h = spans_hash(_prefix(words, 1), a, a + MIN_WORDS)
                yield pa.record_batch([pa.array(ids[i + row].astype(np.int64)), pa.array(h.view(np.int64)), pa.array((a - first[row]).astype(np.int32))], ["doc_id", "h", "start"])

    return texts.select("doc_id", "text", "at").mapInArrow(run, "doc_id long, h long, start int")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, n_words, whole: the spans of MIN_WORDS words or more of a document that stand in another document too.

    Words are runs of characters other than 9-13 and 32, as they are written. Each span is as long as shared windows of MIN_WORDS words that overlap or
    touch make it; a document that another one equals word for word is one span, whole true. Passages repeated within one document alone
    don't count. Texts that are null or shorter than MIN_WORDS words have no rows, nor has an empty table or a null doc_id; rows that share doc_id and text count once, rows
    that share a doc_id only are one document; other columns are not read.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("doc_id is not null")
    # Texts with equal words are one class, which its least doc_id stands for; between them nothing is compared.
    members = stored(profile(plain).filter(f"words >= {MIN_WORDS}"), "members")
    classes = stored(members.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "classes")
    found = stored(chunks(plain), "chunks")
    shared = found.groupBy("digest").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).filter("a <> b").select("digest")
    where = found.join(shared, "digest", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("at"))
    where = stored(where.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), "where")
    released(found)
    texts = stored(plain.join(where, "doc_id"), "texts")
    released(where)
    twice = stored(_windows(texts).groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a <> b").select("h"), "twice")
    hits = _windows(texts).join(twice, "h", "left_semi").select("doc_id", "start")
    order = Window.partitionBy("doc_id").orderBy("start")
    fresh = F.when(F.col("start") > F.lag("start").over(order) + MIN_WORDS, 1).otherwise(F.when(F.lag("start").over(order).isNull(), 1).otherwise(0))
    spans = hits.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(order)).groupBy("doc_id", "span").agg(F.min("start").alias("start_word"), (F.max("start") - F.min("start") + MIN_WORDS).alias("n_words"))
    # the members of a class of several documents are whole spans; a class of one has those found
    several = classes.filter("rep <> last").select("k1", "k2")
    whole = members.join(several, ["k1", "k2"], "left_semi").groupBy("doc_id").agg(F.max("words").alias("n_words")).select("doc_id", F.lit(0).alias("start_word"), F.col("n_words").cast("int").alias("n_words"), F.lit(True).alias("whole"))
    parts = spans.join(whole.select("doc_id"), "doc_id", "left_anti").select("doc_id", "start_word", F.col("n_words").cast("int"), F.lit(False).alias("whole"))
    return whole.unionByName(parts)
