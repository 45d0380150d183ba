"""MinHash near-duplicates by a multi-index Hamming join, with every link confirmed on full shingle sets.

1. Each document's set of distinct word shingles becomes a digest and a signature of SYMBOLS b-bit minhashes. Documents with equal sets
   are one class from here on, known by their smallest doc_id.
2. Multi-index join: signatures are split into CHUNKS chunks. Two signatures that differ in at most 2 * CHUNKS - 1 symbols differ in at most one
   symbol of some chunk (pigeonhole), so each chunk is entered once for each of its symbols left out: all such pairs meet in a bucket.
3. In each bucket every class is paired with the bucket's least id; pairs within MOST_DIFFERENT symbols make neighbourhoods (connected components). Each class
   is first held against the one of these hubs that its signature is nearest to, on full sets: that is one pair a class, and joins nearly all that belongs together.
4. A neighbourhood that these links leave in several pieces is compared whole, but for pairs within a piece: the classes outside its largest piece
   are held in blocks of bounded size, and the sets of all its classes pass each block once, as arrays of shingle hashes. What comes out is a
   forest between pieces: no pairs are emitted.
5. Buckets that hold several neighbourhoods are compared by signature across them, by pairs of bounded blocks, and pairs within MOST_DIFFERENT
   are confirmed on full sets as well. Nothing is capped.

Sets are sets of 64-bit hashes of shingles: two different shingles of a pair are taken for one with a probability of about 2 ** -64 for each two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.llm.common import mix64, random64, stored, text_slices, word_hashes
from quarrygraph.llm.components import components

SYMBOLS, CHUNKS = 64, 16
#: At similarity 0.8 a symbol differs with probability 0.2 (and 2 ** -16 less): 64 of them differ in more than 28 places for about 4 pairs of a million.
MOST_DIFFERENT = 28
#: Classes of a block and their shingles, about; signatures of a block; columns of the matrices by which a task intersects sets, and rows that pass a block at once; pairs of a hub in one task.
BLOCK, BLOCK_SHINGLES, BLOCK_SIGNATURES, COLUMNS, PASSING, SLOT = 4096, 2_000_000, 8192, 1024, 512, 256

#: Ids up to which a set of them is broadcast against the texts; beyond that the texts are dealt by id.
BROADCAST_IDS = 1_000_000

_MULTIPLY = random64(SYMBOLS, 101) | np.uint64(1)
_ADD = random64(SYMBOLS, 102)


def shingles(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one row after another, and how many each has. A row of fewer words has one shingle: all its words."""
    words, counts = word_hashes(data, at)
    end = np.cumsum(counts)
    row = np.repeat(np.arange(len(counts)), counts)
    left = end[row] - np.arange(len(words))  # words from here to the row's end
    found, rows = [], []
    for n in range(1, size + 1):
        starts = np.flatnonzero(left >= size) if n == size else np.flatnonzero((left == n) & (counts[row] == n))
        h = np.full(len(starts), n, np.uint64)
        for j in range(n):
            h = (h ^ words[starts + j]) * np.uint64(0x9DDFEA08EB382D69)
            h ^= h >> np.uint64(32)
        found.append(mix64(h))
        rows.append(row[starts])
    h, r = np.concatenate(found), np.concatenate(rows)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[fresh], np.bincount(r[fresh], minlength=len(counts))


def signatures(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SYMBOLS 16-bit minhashes of each row (zeros without shingles)."""
    out = np.zeros((len(counts), SYMBOLS), np.uint16)
    some = np.flatnonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        for k in range(SYMBOLS):
            least = np.minimum.reduceat((h * _MULTIPLY[k] + _ADD[k]) >> np.uint64(16), starts)
            out[some, k] = mix64(least) & np.uint64(0xFFFF)
    return out


def keys(sig: np.ndarray) -> np.ndarray:
    """The SYMBOLS bucket keys of each signature: chunk, symbol left out, the chunk's other symbols."""
    each = SYMBOLS // CHUNKS
    s = sig.reshape(len(sig), CHUNKS, each).astype(np.int64)
    out = np.empty((len(sig), CHUNKS, each), np.int64)
    for out_k in range(each):
        key = np.arange(CHUNKS, dtype=np.int64)[None, :] * each + out_k
        for j in range(each):
            if j != out_k:
                key = key * 65536 + s[:, :, j]
        out[:, :, out_k] = key
    return out.reshape(len(sig), -1)


def profile(docs: DataFrame, size: int, text: bool = False) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set), sig; one row for each row of docs; its text too, if asked for."""
    names = ["doc_id", "n_shingles", "d1", "d2", "sig"] + ["text"] * text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, at in text_slices(b.column(1)):
                h, counts = shingles(data, at, size)
                end = np.cumsum(counts)
                sums = []
                for salt in (0x51ED270B7A1F9A3D, 0xC2B2AE3D27D4EB4F):
                    total = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(mix64(h ^ np.uint64(salt)), out=total[1:])
                    sums.append((total[end] - total[end - counts]).view(np.int64))
                sig = signatures(h, counts)
                own = [b.column(1).slice(i, j - i)] * text
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array(counts, pa.int64()), *map(pa.array, sums), pa.array([x.tobytes() for x in sig], pa.binary()), *own], names)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sig binary" + ", text string" * text)


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """rep, set (its sorted shingle hashes, as bytes) of texts (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, at in text_slices(b.column(1)):
                h, counts = shingles(data, at, size)
                end = np.cumsum(counts)
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array([h[e - n : e].tobytes() for e, n in zip(end.tolist(), counts.tolist(), strict=True)], pa.binary())], ["rep", "set"])

    return texts.select("id", "text").mapInArrow(run, "rep long, set binary")


def _bucket_keys(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                yield pa.record_batch([pa.array(np.repeat(part.column(0).to_numpy(), SYMBOLS)), pa.array(keys(sig).ravel())], ["rep", "key"])

    return classes.select("rep", "sig").mapInArrow(run, "rep long, key long")


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose signatures differ in at most MOST_DIFFERENT symbols, and in how many they do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for k in (2, 3))
                apart = (x != y).sum(1)
                near = pa.array(apart <= MOST_DIFFERENT)
                yield pa.record_batch([b.column(0).filter(near), b.column(1).filter(near), pa.array(apart, pa.int64()).filter(near)], ["a", "b", "apart"])

    sigs = classes.select("rep", "sig")
    both = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, apart long")


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets have 100 * intersection >= percent * union. A hub a with many pairs is dealt to several tasks, with its text."""
    pairs = stored(pairs.select("a", "b"), "pairs")
    slots = pairs.groupBy("a").agg(F.ceil(F.count("*") / SLOT).cast("long").alias("slots"))
    hubs = slots.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot")).join(texts.withColumnRenamed("id", "a"), "a").select("a", "slot", F.lit(None).cast("long").alias("b"), "text")
    rest = pairs.join(slots, "a").select("a", F.pmod(F.xxhash64("b"), "slots").alias("slot"), "b").join(texts.withColumnRenamed("id", "b"), "b").select("a", "slot", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            ids, members = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            found: list[tuple[int, int]] = []
            for i, j, data, at in text_slices(batch.column(3)):
                h, counts = shingles(data, at, size)
                end = np.cumsum(counts)
                for k in range(i, j):
                    mine = h[end[k - i] - counts[k - i] : end[k - i]]
                    if members[k] is None:
                        hub, own = ids[k], mine.copy()
                    elif hub == ids[k] and len(own) and len(mine):
                        both = np.concatenate([own, mine])
                        both.sort()
                        shared = int((both[1:] == both[:-1]).sum())
                        if 100 * shared >= percent * (len(both) - shared):
                            found.append((hub, members[k]))
            yield pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    dealt = hubs.union(rest).repartition("a", "slot").sortWithinPartitions("a", "slot", F.col("b").asc_nulls_first())
    return stored(dealt.mapInArrow(run, "a long, b long"), "links")


def _shared(held: list[np.ndarray], passing: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets, one row for each of held, one column for each of passing."""
    out = np.zeros((len(held), len(passing)), np.float32)
    sides = []
    for sets in (held, passing):
        flat = np.concatenate(sets)
        sides.append((flat, np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
    known = np.intersect1d(*(x for x, _ in sides))
    entries = []
    for flat, owner in sides:
        # only shingles of both sides can be in an intersection
        at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
        some = known[at] == flat if len(known) else np.zeros(len(flat), bool)
        order = np.argsort(at[some], kind="stable")
        entries.append((at[some][order], owner[some][order]))
    for first in range(0, len(known), COLUMNS):
        parts = []
        for (column, owner), n in zip(entries, out.shape, strict=True):
            i, j = np.searchsorted(column, (first, first + COLUMNS))
            part = np.zeros((n, COLUMNS), np.float32)
            part[owner[i:j], column[i:j] - first] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


class _Block:
    """Held sets of one neighbourhood, and the links that were found between its pieces."""

    def __init__(self, percent: int):
        self.percent = percent
        self.reps: list[int] = []
        self.pieces: list[int] = []
        self.sets: list[np.ndarray] = []
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.up.setdefault(i, i) != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def meet(self, reps: list[int], pieces: list[int], sets: list[np.ndarray]) -> None:
        """Link what passes to what is held, where that joins two pieces."""
        for i in range(0, len(reps), PASSING):
            some = sets[i : i + PASSING]
            shared = _shared(self.sets, some).astype(np.int64)
            sizes = np.array([len(x) for x in self.sets])[:, None] + np.array([len(x) for x in some])[None, :]
            linked = 100 * shared >= self.percent * (sizes - shared)
            linked &= np.array([self.root(p) for p in self.pieces])[:, None] != np.array([self.root(p) for p in pieces[i : i + PASSING]])[None, :]
            for h, p in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
                x, y = self.root(self.pieces[h]), self.root(pieces[i + p])
                if x != y:
                    self.up[max(x, y)] = min(x, y)
                    self.links.append((self.reps[h], reps[i + p]))


def _within(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between the pieces of neighbourhoods. members: rep, nc, piece, n_shingles.

    Sorted groups are streamed by tasks: a block's held sets, then the sets that pass it. Two held sets meet in the block of one of them.
    """
    pieces = members.groupBy("nc", "piece").agg(F.count("*").alias("n"))
    largest = pieces.groupBy("nc").agg(F.count("*").alias("pieces"), F.max(F.struct("n", -F.col("piece"))).alias("top")).filter("pieces > 1").select("nc", (-F.col("top.col2")).alias("major"))
    open_ = stored(members.join(largest, "nc").withColumn("minor", F.col("piece") != F.col("major")), "open")
    if open_.isEmpty():
        return open_.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    sized = open_.filter("minor").groupBy("nc").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    placed = open_.join(sized, "nc").withColumn("block", F.when(F.col("minor"), F.pmod(F.xxhash64("rep"), "blocks")).otherwise(F.col("blocks")))
    # what isn't held passes every block; what is held passes the blocks before its own
    visits = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: k < F.col("block")), lambda k: F.struct(k.alias("k"), F.lit(1).alias("passing")))
    visits = F.when(F.col("minor"), F.concat(F.array(F.struct(F.col("block").alias("k"), F.lit(0).alias("passing"))), visits)).otherwise(visits)
    found = _sets(_by_ids(texts, stored(open_.select(F.col("rep").alias("id")), "members"), "id", "left_semi"), size)
    dealt = placed.select("rep", "nc", "piece", F.explode(visits).alias("v")).select("rep", "nc", "v.k", "v.passing", "piece").join(found, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, block = None, _Block(percent)
        waiting: tuple[list, list, list] = ([], [], [])
        own = True  # held sets have not met each other yet

        def settle() -> None:
            nonlocal own
            if own and block.reps:
                block.meet(block.reps, block.pieces, block.sets)
            own = False
            if waiting[0] and block.reps:
                block.meet(*waiting)
            for x in waiting:
                x.clear()

        def batch_of(rows: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64())], ["a", "b"])

        for batch in batches:
            out: list[tuple[int, int]] = []
            for nc, k, passing, rep, piece, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (nc, k) != group:
                    settle()
                    out += block.links
                    group, block, own = (nc, k), _Block(percent), True
                to = waiting if passing else (block.reps, block.pieces, block.sets)
                for x, y in zip(to, (rep, piece, np.frombuffer(raw, np.uint64)), strict=True):
                    x.append(y)
                if len(waiting[0]) >= PASSING or sum(map(len, waiting[2][-1:])) > BLOCK_SHINGLES:
                    settle()
            yield batch_of(out)
        settle()
        yield batch_of(block.links)

    dealt = dealt.select("nc", "k", "passing", "rep", "piece", "set").repartition("nc", "k").sortWithinPartitions("nc", "k", "passing", "rep")
    return stored(dealt.mapInArrow(run, "a long, b long"), "within")


def _across(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket, of different neighbourhoods, within MOST_DIFFERENT symbols and of sizes that allow a link.

    mixed: key, rep, nc, n_shingles, sig, blocks (of the key). Sorted groups are streamed; each is of two blocks at most.
    """
    own = F.pmod(F.xxhash64("rep"), "blocks")
    dealt = mixed.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("g1"), F.greatest("block", "other").alias("g2"), "block", "rep", "nc", "n_shingles", "sig")

    def pairs(group: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        block, rep, nc, size = (np.array([x[k] for x in group], np.int64) for k in (3, 4, 5, 6))
        sig = np.frombuffer(b"".join([x[7] for x in group]), np.uint16).reshape(-1, SYMBOLS)
        a, b = [], []
        split = group[0][1] != group[0][2]
        for i in range(len(rep) - 1):
            ok = (nc[i + 1 :] != nc[i]) & (100 * np.minimum(size[i], size[i + 1 :]) >= percent * np.maximum(size[i], size[i + 1 :]))
            if split:
                ok &= block[i + 1 :] != block[i]
            hit = np.flatnonzero(ok) + i + 1
            hit = hit[(sig[hit] != sig[i]).sum(1) <= MOST_DIFFERENT]
            a.append(np.minimum(rep[i], rep[hit]))
            b.append(np.maximum(rep[i], rep[hit]))
        return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen: set[tuple[int, int]] = set()  # what this task has returned of late: buckets repeat pairs

        def flush(group: list[tuple]) -> list[tuple[int, int]]:
            out = []
            if len(group) > 1:
                if len(seen) > 200_000:
                    seen.clear()
                for x in zip(*(v.tolist() for v in pairs(group)), strict=True):
                    if x not in seen:
                        seen.add(x)
                        out.append(x)
            return out

        def batch_of(rows: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64())], ["a", "b"])

        for batch in batches:
            out: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:3] != row[:3]:
                    out += flush(held)
                    held = []
                held.append(row)
            yield batch_of(out)
        yield batch_of(flush(held))

    return dealt.repartition("key", "g1", "g2").sortWithinPartitions("key", "g1", "g2").mapInArrow(run, "a long, b long")


def _by_ids(docs: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """docs semi- or anti-joined with a stored table of ids, whose size decides whether texts have to move."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, how)


def _texts(docs: DataFrame, ids: DataFrame, one: DataFrame, size: int) -> DataFrame:
    """id, text of the documents whose id is in ids (a stored table): for rows that share an id, the text of the set that counts."""
    texts = _by_ids(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")), ids, "id", "left_semi")
    twice = stored(one.filter("n_rows > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id")), "twice")
    if twice.isEmpty():
        return texts
    own = profile(_by_ids(texts, twice, "id", "left_semi").withColumnRenamed("id", "doc_id"), size, text=True)
    chosen = own.groupBy(F.col("doc_id").alias("id")).agg(F.min_by("text", F.struct("d1", "d2", "n_shingles")).alias("text"))
    return _by_ids(texts, twice, "id", "left_anti").union(chosen)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, n_rows: one row for each doc_id; n_rows is how many rows of docs have it.

    Words are runs of characters other than 9-13 and 32, letters A-Z in lower case; a document's set holds its distinct shingles of `size` words,
    the whole sequence if it has fewer. Documents with 100 * intersection >= percent * union are linked; component_id is the smallest doc_id that
    links reach, kept says whether that is the document itself. Null, empty or blank text: an empty set, linked with nothing. Rows that
    share a doc_id count as one document, with the set of the least digest among them. A null doc_id stands alone: component_id is null
    and it is kept. Repeated rows give one; an empty table gives none; other columns are not read.
    """
    rows = stored(profile(docs, size), "profile")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("d1", "d2", "n_shingles", "sig")).alias("x"), F.count("*").alias("n_rows")).select("doc_id", "n_rows", "x.*")
    full = one.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = stored(full.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")

    entries = _bucket_keys(classes)
    shared = entries.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last"), F.count("*").alias("n")).filter("hub <> last")
    buckets = stored(entries.join(shared.select("key", "hub", "n"), "key"), "buckets")
    texts = _texts(docs, stored(buckets.select(F.col("rep").alias("id")).distinct(), "candidates"), one, size)

    star = buckets.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    near = stored(_near(star, classes), "near")
    around = stored(components(near), "around").select(F.col("id").alias("rep"), F.col("component").alias("nc"))
    first = _confirm(near.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("x")).select("x.a", "b"), texts, size, percent)
    joined = components(first)
    members = around.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "nc", F.coalesce("component", "rep").alias("piece")).join(classes.select("rep", "n_shingles"), "rep")
    links = first.union(_within(members, texts, size, percent))

    labelled = buckets.join(around, "rep", "left").select("key", "rep", "n", F.coalesce("nc", "rep").alias("nc"))
    several = labelled.groupBy("key").agg(F.min("nc").alias("x"), F.max("nc").alias("y")).filter("x <> y").select("key")
    mixed = labelled.join(several, "key", "left_semi").join(classes.select("rep", "n_shingles", "sig"), "rep")
    apart = _across(mixed.select("key", "rep", "nc", "n_shingles", "sig", F.ceil(F.col("n") / BLOCK_SIGNATURES).cast("long").alias("blocks")), percent).distinct()
    more = _confirm(apart, texts, size, percent)
    final = components(links.union(more))

    member = full.select("doc_id", "n_rows", "d1", "d2", "n_shingles").join(classes.select("d1", "d2", "n_shingles", "rep"), ["d1", "d2", "n_shingles"])
    member = member.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n_rows", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    rest = one.filter((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "n_rows", "n_shingles", F.col("doc_id").alias("component_id"))
    return member.union(rest).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "n_rows")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs, all columns, for each component: its smallest doc_id's (of rows that share a doc_id, the first by a hash of the text).

    Rows whose doc_id is null are all kept.
    """
    found = stored(near_duplicates(docs, size, percent).filter("doc_id is not null"), "found")
    # what stays as it is doesn't move: rows of ids that go, or that several rows share, are left out
    gone = stored(found.filter("not kept or n_rows > 1").select("doc_id"), "gone")
    shared = stored(found.filter("kept and n_rows > 1").select("doc_id"), "shared")
    rest = _by_ids(docs, gone, "doc_id", "left_anti")
    if shared.isEmpty():
        return rest
    names = docs.columns
    mark = next(n for n in (f"_row{i or ''}" for i in range(len(names) + 1)) if n not in names)
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(F.col("text")), "text")
    one = _by_ids(docs, shared, "doc_id", "left_semi").withColumn(mark, F.row_number().over(order)).filter(F.col(mark) == 1)
    return rest.select(*names).unionByName(one.select(*names))
