"""Traversals and centralities over edges (source, target, edge_type) and nodes (path, ...)."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph import params as P
from quarrygraph.operators.tables import beside_edges, numbered, pinned, shared_folder, swept
from quarrygraph.sources.tree import file_system


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def degrees(nodes: DataFrame, edges: DataFrame, edge_type: str | None = None) -> DataFrame:
    """path, in_degree, out_degree of every node."""
    kept = edges if edge_type is None else edges.filter(F.col("edge_type") == edge_type)
    incoming = kept.groupBy(F.col("target").alias("path")).agg(F.count("*").alias("in_degree"))
    outgoing = kept.groupBy(F.col("source").alias("path")).agg(F.count("*").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return nodes.select("path").join(incoming, "path", "left").join(outgoing, "path", "left").select("path", zero("in_degree"), zero("out_degree"))


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """seeds (seed, node) -> seed, node, depth: everything a seed reaches along edges, itself at 0, by the fewest edges.

    Breadth first: each round joins the frontier with the edges and anti-joins what was visited, so a node is expanded once for each seed. Repeated edges find a node again, which the
    round's one distinct drops, after it has dropped most of what each task found.
    """
    steps = edges.select(F.col("source").alias("node"), F.col("target").alias("next"))
    visited = frontier = pinned(seeds.select("seed", "node").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = steps.join(beside_edges(frontier), "node").select("seed", F.col("next").alias("node")).distinct()
        frontier = pinned(found.join(visited.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def reachable(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (source, target), each once, with reached: whether edges lead from source to target (a node reaches itself). All pairs are one traversal with bitmaps of the sources."""
    wanted = pairs.select("source", "target").distinct()
    found = reach_sets(edges, wanted.select(F.col("source").alias("path"))).select(F.col("seed").alias("source"), F.col("node").alias("target"), F.lit(True).alias("reached"))
    return wanted.join(found, ["source", "target"], "left").select("source", "target", F.coalesce("reached", F.lit(False)).alias("reached"))


#: Seeds of one long word of a bitmap.
WORD = 64


def reachable_between(edges: DataFrame, sources: DataFrame, targets: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """source, target, reached of every pair of a path of sources and one of targets. The pairs are made last, from bitmaps: a row of a target and a word gives its 64 pairs where it stands, so no pair is shuffled.

    nodes (path): names that ends of edges are known to have, so that they needn't be gathered from the edges; it changes no row.
    """
    if nodes is None:
        ids, steps = keyed(edges, ends(edges).unionByName(sources.select("path")))
    else:
        ids, rows = keyed_whole(nodes.select("path").unionByName(sources.select("path")), edges)
        steps = rows.filter("a is not null AND b is not null")
    state, starts = _followed(ids, steps, sources.select("path").distinct().join(ids, "path").select("id"), None, False)
    named = starts.join(ids.select(F.col("id").alias("node"), F.col("path").alias("seed_path")), "node")
    names = named.groupBy(F.floor(F.col("seed") / WORD).alias("word")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seed", "seed_path"))), lambda x: x["seed_path"]).alias("names"))
    words = names.agg(F.max("word")).first()[0]
    if words is None:
        return targets.select(F.lit("").alias("source"), F.col("path").alias("target"), F.lit(False).alias("reached")).limit(0)
    cells = targets.select("path").distinct().join(ids, "path", "left").select(F.col("path").alias("target"), F.col("id").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(words).cast("long"))).alias("word"))
    held = cells.join(state.select("node", "word", "bits"), ["node", "word"], "left").join(beside_edges(names), "word")
    place, bits = F.col("place"), F.coalesce("bits", F.lit(0).cast("long"))
    return held.select("target", bits.alias("bits"), F.posexplode("names").alias("place", "source")).select("source", "target", (F.call_function("shiftrightunsigned", F.col("bits"), place).bitwiseAND(1) == 1).alias("reached"))


def keyed(edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ids (path, id) of the names (path), whole numbers in the order of paths, and edges among them as pairs of ids (a, b), pinned; repeated edges stay. The names go to the edges, which no step of this shuffles."""
    ids = numbered(names.select("path").distinct().orderBy("path"), "id")
    return ids, pinned(between(edges, ids))


def keyed_whole(nodes: DataFrame, edges: DataFrame, *kept: Column) -> tuple[DataFrame, DataFrame]:
    """ids (path, id) of nodes and of all that stands at an end of an edge, whole numbers in the order of paths; and every edge, pinned, as a pair of ids (a, b; null for a null end) with kept columns of it.

    One pass of the edges, if all ends are nodes: names are numbers from then on. Else the others are found in it, and a second pass follows.
    """
    names = nodes.select("path").distinct()
    while True:
        ids = numbered(names.filter("path is not null").orderBy("path"), "id")
        held = beside_edges(ids)
        by = lambda c, to: held.select(F.col("path").alias(c), F.col("id").alias(to))
        other = lambda c, to: F.when(F.col(to).isNull(), F.col(c)).alias(c)
        rows = pinned(edges.select("source", "target", *kept).join(by("source", "a"), "source", "left").join(by("target", "b"), "target", "left").withColumns({"source": other("source", "a"), "target": other("target", "b")}))
        left = rows.filter("source is not null OR target is not null")
        if left.isEmpty():
            return ids, rows.drop("source", "target")
        names = pinned(names.unionByName(ends(left)).distinct())


def between(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose both ends have an id (path, id), as pairs of ids (a, b)."""
    held = beside_edges(ids)
    by = lambda c, to: held.select(F.col("path").alias(c), F.col("id").alias(to))
    return edges.select("source", "target").join(by("source", "a"), "source").join(by("target", "b"), "target").select("a", "b")


def ends(edges: DataFrame) -> DataFrame:
    """path of everything that an edge has at an end, with repeats, in one pass of the edges."""
    return edges.select(F.explode(F.array("source", "target")).alias("path"))


def parts(ids: DataFrame, steps: DataFrame) -> DataFrame:
    """id, part (its least id), pinned: the weakly connected parts of steps (a, b) over ids. Each task first brings its edges down to one for each node that they join; labels are passed along these, and then along labels."""
    steps = pinned(steps.select("a", "b").mapInArrow(_joined_nodes, "a long, b long").distinct())
    label = pinned(ids.select("id", F.col("id").alias("part")))
    while True:
        held = beside_edges(label)
        of = lambda end, name: held.select(F.col("id").alias(end), F.col("part").alias(name))
        least = steps.join(of("a", "pa"), "a").join(of("b", "pb"), "b").filter("pa <> pb").select(F.when(F.col("pa") > F.col("pb"), F.struct(F.col("a").alias("id"), F.col("pa").alias("old"), F.col("pb").alias("seen"))).otherwise(F.struct(F.col("b").alias("id"), F.col("pb").alias("old"), F.col("pa").alias("seen"))).alias("x")).select("x.*")
        # the label that is given up takes the lesser one too, so that a whole tree of labels moves at once
        seen = least.select(F.explode(F.array("id", "old")).alias("id"), "seen").groupBy("id").agg(F.min("seen").alias("seen"))
        step = label.join(seen, "id", "left").select("id", F.least("part", F.coalesce("seen", "part")).alias("part"), F.col("part").alias("was"))
        up = step.select(F.col("id").alias("part"), F.col("part").alias("up"))
        fresh = pinned(step.join(up, "part").select("id", F.least("part", "up").alias("part"), "was"))
        label = fresh.select("id", "part")
        if fresh.filter("was <> part").isEmpty():
            return label


def _joined_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For edges a - b, pairs that join the same nodes: each node with the least one of its part, itself left out. A label for each node and PIECE_EDGES edges are held."""
    label = np.zeros(0, np.int64)
    for a, b, _ in _many(batches, PIECE_EDGES):
        label = np.concatenate([label, np.arange(len(label), max(a.max(), b.max()) + 1)])
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (label[label] != label).any():
                label = label[label]
    away = np.flatnonzero(label != np.arange(len(label)))
    yield pa.record_batch([pa.array(away), pa.array(label[away])], ["a", "b"])


def _many(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """a, b and their number, of batches of edges put together until they are so many."""
    held, size = [], 0
    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
        size += batch.num_rows
        if size >= most:
            yield *(np.concatenate(x) for x in zip(*held, strict=True)), size
            held, size = [], 0
    if size:
        yield *(np.concatenate(x) for x in zip(*held, strict=True)), size


def split(ids: DataFrame, steps: DataFrame, most: int) -> tuple[DataFrame, DataFrame, bool]:
    """Parts of at most so many edges and nodes: (id, part) and (part, a, b), each a group that one task may hold; and whether others are left."""
    label = parts(ids, steps)
    own = steps.join(beside_edges(label).withColumnRenamed("id", "a"), "a").select("part", "a", "b")
    size = own.groupBy("part").agg(F.count("*").alias("n")).unionByName(label.groupBy("part").agg(F.count("*").alias("n"))).groupBy("part").agg(F.max("n").alias("n"))
    large = pinned(size.filter(F.col("n") > most).select("part"))
    if large.isEmpty():
        return label, own, False
    large = beside_edges(large)
    return label.join(large, "part", "left_anti"), own.join(large, "part", "left_anti"), True


def _bits(steps: DataFrame, starts: DataFrame, max_depth: int | None) -> tuple[list[DataFrame], DataFrame]:
    """From steps (a, b) and starts (seed, node): what is new in each round, and all that was found.

    A node holds the set of seeds that have reached it as bits of long words, one row for each word that has a bit: a round sends words along the edges, joins those that meet at
    a node by a bitwise or, and goes on with the bits that are new there. So an edge carries 64 seeds at a time, and nodes and seeds are numbers; paths return at the end.
    """
    bit = F.expr(f"shiftleft(1L, cast(seed % {WORD} AS int))")
    state = pinned(starts.select("node", F.floor(F.col("seed") / WORD).alias("word"), bit.alias("bits")).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")).select("*", F.col("bits").alias("fresh")))
    rounds, depth = [state.filter("fresh <> 0").withColumn("depth", F.lit(0))], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        sent = steps.join(beside_edges(state.filter("fresh <> 0").select(F.col("node").alias("a"), "word", "fresh")), "a")
        met = sent.groupBy(F.col("b").alias("node"), "word").agg(F.bit_or("fresh").alias("got"))
        both = state.select("node", "word", F.col("bits").alias("had")).join(met, ["node", "word"], "full_outer")
        had, got = F.coalesce("had", F.lit(0).cast("long")), F.coalesce("got", F.lit(0).cast("long"))
        state = pinned(both.select("node", "word", had.bitwiseOR(got).alias("bits"), got.bitwiseAND(F.bitwise_not(had)).alias("fresh")))
        fresh = state.filter("fresh <> 0")
        if fresh.isEmpty():
            break
        rounds.append(fresh.withColumn("depth", F.lit(depth)))
    return rounds, state


def _each_bit(rounds: list[DataFrame]) -> DataFrame:
    """seed, node, depth of rounds of words."""
    found = rounds[0]
    for r in rounds[1:]:
        found = found.unionByName(r)
    places = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.call_function("shiftrightunsigned", F.col("fresh"), i).bitwiseAND(1) == 1)
    return found.select("node", "depth", "word", F.explode(places).alias("place")).select((F.col("word") * WORD + F.col("place")).alias("seed"), "node", "depth")


def reach_sets(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """What reach gives, for many seeds at once: seeds (path) -> seed, node, depth. Nodes are numbers on the way."""
    ids, steps = keyed(edges, ends(edges).unionByName(seeds.select("path")))
    found = reach_numbers(ids, steps, seeds.select("path").distinct().join(ids, "path").select("id"), max_depth)
    held = beside_edges(ids)
    named = lambda c: held.select(F.col("id").alias(c), F.col("path").alias(f"{c}_path"))
    return found.join(named("seed"), "seed").join(named("node"), "node").select(F.col("seed_path").alias("seed"), F.col("node_path").alias("node"), "depth")


def reach_numbers(ids: DataFrame, steps: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """What reach gives, all in numbers: ids (id) from 0 without gaps, steps (a, b) pinned and starts (id), each once -> seed, node, depth, pinned."""
    return _followed(ids, steps, starts, max_depth, True)[0]


#: Rows that the seeds of a part may reach for one task to follow it, and tasks for each core that parts and seeds are dealt to.
TASK_CELLS, DEALT = 1 << 22, 8


def _followed(ids: DataFrame, steps: DataFrame, starts: DataFrame, max_depth: int | None, rows: bool) -> tuple[DataFrame, DataFrame]:
    """What starts (id) reach, pinned: seed, node, depth if rows, else node, word, bits (of all depths); and seed (its number), node of the starts.

    Parts of the graph that no edge joins are followed one by one, each of at most TASK_EDGES edges and nodes and TASK_CELLS nodes times seeds as a group of a task. The seeds of larger parts are
    dealt to tasks, which read the edges in pieces. Up to 64 seeds, whose bits fit one word of each node, go by joins. Seeds are numbered by part, so that the words of a part's nodes are few.
    """
    kind = "seed long, node long, depth int" if rows else "node long, word long, bits long"

    def joins(steps: DataFrame, places: DataFrame) -> DataFrame:
        rounds, state = _bits(steps, places, max_depth)
        if not rows:
            return state.select("node", "word", "bits")
        return _each_bit(rounds).join(beside_edges(places.select("seed", F.col("node").alias("start"))), "seed").select(F.col("start").alias("seed"), "node", "depth")

    starts = pinned(starts)
    if starts.count() <= WORD:
        places = numbered(starts.select(F.col("id").alias("node")).orderBy("node"), "seed")
        return pinned(joins(steps, places)), places
    label = parts(ids, steps)
    placed = numbered(starts.join(label, "id").select(F.col("id").alias("node"), "part").orderBy("part", "node"), "seed")
    places = placed.select("seed", "node")
    count = lambda df, name: df.groupBy("part").agg(F.count("*").alias(name))
    own = steps.join(beside_edges(label).withColumnRenamed("id", "a"), "a").select("part", "a", "b")
    size = count(placed, "seeds").join(count(label, "nodes"), "part").join(count(own, "edges"), "part", "left")
    size = pinned(size.select("part", ((F.coalesce("edges", F.lit(0)) > TASK_EDGES) | (F.col("nodes") > TASK_EDGES) | (F.col("nodes") * F.col("seeds") > TASK_CELLS)).alias("large")))
    tasks = DEALT * ids.sparkSession.sparkContext.defaultParallelism
    few, many = (beside_edges(size.filter(x).select("part")) for x in (~F.col("large"), F.col("large")))
    given = own.join(few, "part").unionByName(placed.join(few, "part").select("part", F.col("node").alias("a"), (-1 - F.col("seed")).alias("b")))
    # the number of tasks is by the rows that come out, of which the rows that go in tell nothing
    found = given.repartition(tasks, "part").groupBy("part").applyInPandas(lambda pdf: reach_kernel(pdf["a"].to_numpy(), pdf["b"].to_numpy(), max_depth, rows), kind)
    if many.isEmpty():
        return pinned(found), places
    # the edges of other parts do no harm there: no seed of these leads to them
    rest = pinned(placed.join(many, "part").select("seed", "node"))
    more = joins(steps, rest) if rest.count() <= WORD else _reach_in_pieces(ids.count(), steps, rest.repartition(tasks, F.floor(F.col("seed") / WORD)), max_depth, rows, kind)
    return pinned(found.unionByName(more)), places


def _words(seeds: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the seeds (numbers) of one word after another."""
    order = np.argsort(seeds, kind="stable")
    return iter(np.split(order, np.flatnonzero(np.diff(seeds[order] // WORD)) + 1)) if len(seeds) else iter(())


_BIT = np.left_shift(np.uint64(1), np.arange(WORD, dtype=np.uint64))


def reach_kernel(a: np.ndarray, b: np.ndarray, max_depth: int | None, rows: bool = True) -> pd.DataFrame:
    """seed, node, depth, or node, word, bits, over the edges a -> b of one part; b < 0 marks a as the seed of number -1 - b. The seeds of a word are followed at once, as its bits at each node."""
    start, inside = b < 0, b >= 0
    seeds, number = a[start], -1 - b[start]
    names, place = np.unique(np.concatenate([a[inside], b[inside], seeds]), return_inverse=True)
    m, n = int(inside.sum()), len(names)
    order = np.argsort(place[m : 2 * m], kind="stable")
    u, v, at = place[:m][order], place[m : 2 * m][order], place[2 * m :]
    first = np.flatnonzero(np.diff(v, prepend=-1))
    out = []
    for some in _words(number):
        fresh = np.zeros(n, np.uint64)
        fresh[at[some]] = _BIT[number[some] % WORD]
        by_bit = np.zeros(WORD, np.int64)
        by_bit[number[some] % WORD] = seeds[some]
        had, depth = fresh.copy(), 0
        while fresh.any():
            if rows:
                here = np.flatnonzero(fresh)
                node, bit = np.nonzero(fresh[here, None] & _BIT)
                out.append((by_bit[bit], names[here[node]], np.full(len(node), depth, np.int32)))
            if not m or depth == max_depth:
                break
            depth += 1
            got = np.zeros(n, np.uint64)
            got[v[first]] = np.bitwise_or.reduceat(fresh[u], first)
            fresh = got & ~had
            had |= fresh
        if not rows:
            here = np.flatnonzero(had)
            out.append((names[here], np.full(len(here), number[some[0]] // WORD), had[here].view(np.int64)))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return pd.DataFrame(dict(zip(("seed", "node", "depth") if rows else ("node", "word", "bits"), columns, strict=True)))


#: Edges in pieces that a task may hold instead of reading them for each step, and nodes of a frame of rows.
HELD_EDGES, FRAME_NODES = 8_000_000, 1 << 14


def _reach_in_pieces(n: int, steps: DataFrame, dealt: DataFrame, max_depth: int | None, rows: bool, kind: str) -> DataFrame:
    """What _followed gives for dealt (seed, node), pinned, over nodes 0 to n - 1: the edges stand in the shared folder in pieces by target, which tasks read one by one for each step of PIECE_CELLS nodes times words."""
    spark = steps.sparkSession
    root = f"{shared_folder(spark)}/reach-{uuid.uuid4().hex}"
    total = steps.count()
    files = max(1, math.ceil(total / (PIECE_EDGES * FILE_PIECES)))
    # a node may be in several pieces, so edges are written where they stand
    steps.select("a", "b").coalesce(files).mapInArrow(_pieces_by_target, "nodes binary, starts binary, others binary").write.parquet(root)
    hold, together = total <= HELD_EDGES, max(1, PIECE_CELLS // n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given = [*batches]
        number, node = (np.concatenate([np.zeros(0, np.int64), *(pdf[c].to_numpy(np.int64) for pdf in given)]) for c in ("seed", "node"))
        words = [*_words(number)]
        held = [*_read_pieces(root)] if hold and words else None
        for i in range(0, len(words), together):
            group = words[i : i + together]
            fresh, by_bit = np.zeros((len(group), n), np.uint64), np.zeros((len(group), WORD), np.int64)
            for w, some in enumerate(group):
                fresh[w, node[some]] = _BIT[number[some] % WORD]
                by_bit[w, number[some] % WORD] = node[some]
            had, depth = fresh.copy(), 0
            whole = np.bitwise_or.reduce(fresh, axis=1)[:, None]
            while fresh.any():
                if rows:
                    for w in range(len(group)):
                        here = np.flatnonzero(fresh[w])
                        for at in range(0, len(here), FRAME_NODES):
                            some = here[at : at + FRAME_NODES]
                            x, bit = np.nonzero(fresh[w, some, None] & _BIT)
                            yield pd.DataFrame({"seed": by_bit[w, bit], "node": some[x], "depth": np.full(len(x), depth, np.int32)})
                if depth == max_depth:
                    break
                depth += 1
                got = np.zeros_like(fresh)
                # edges from nodes that nothing new has reached, and to nodes that all seeds have, are left out
                new, open_ = (fresh != 0).any(axis=0), (had != whole).any(axis=0)
                for nodes, starts, others in held or _read_pieces(root):
                    sent, wants = new[others], open_[nodes]
                    if not wants.all():
                        sent &= np.repeat(wants, np.diff(starts, append=len(others)))
                    if (k := np.count_nonzero(sent)) == 0:
                        continue
                    if k < len(others) // 2:
                        nodes, starts, others = _some_edges(nodes, starts, others, np.flatnonzero(sent))
                    for w in range(len(group)):
                        got[w, nodes] |= np.bitwise_or.reduceat(fresh[w, others], starts)
                fresh = got & ~had
                had |= fresh
            if not rows:
                for w, some in enumerate(group):
                    here = np.flatnonzero(had[w])
                    yield pd.DataFrame({"node": here, "word": np.full(len(here), number[some[0]] // WORD), "bits": had[w, here].view(np.int64)})

    found = pinned(dealt.mapInPandas(run, kind))
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return found


def _some_edges(nodes: np.ndarray, starts: np.ndarray, others: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges at these places (ascending, one at least) of a piece, as a piece."""
    node = np.searchsorted(starts, at, side="right") - 1
    first = np.flatnonzero(np.diff(node, prepend=-1))
    return nodes[node[first]], first, others[at]


def _pieces_by_target(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) as pieces of about PIECE_EDGES edges, each in the order of targets: the different targets, where the sources of each begin, and the sources. FILE_PIECES pieces are put in order together."""
    for a, b, size in _many(batches, PIECE_EDGES * FILE_PIECES):
        order = np.argsort(b, kind="stable")
        a, b = a[order].astype(np.int32), b[order].astype(np.int32)
        for at in range(0, size, PIECE_EDGES):
            some = b[at : at + PIECE_EDGES]
            starts = np.flatnonzero(np.diff(some, prepend=-1)).astype(np.int32)
            yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in (some[starts], starts, a[at : at + PIECE_EDGES])], ["nodes", "starts", "others"])


def k_hops(edges: DataFrame, seeds: DataFrame, max_depth: int = P.IMPACT_DEPTH) -> DataFrame:
    """seeds (path) -> path, depth: files within max_depth forward or backward of any seed (directions aren't mixed), the seeds left out."""
    # both directions, and all seeds of each, are one traversal of an edge list with two kinds of nodes
    side = lambda kind, path: F.concat(F.lit(kind), path)
    two = edges.select(side(">", F.col("source")).alias("source"), side(">", F.col("target")).alias("target")).unionByName(edges.select(side("<", F.col("target")).alias("source"), side("<", F.col("source")).alias("target")))
    start = seeds.select(F.lit("s").alias("seed"), F.explode(F.array(side(">", F.col("path")), side("<", F.col("path")))).alias("node"))
    both = reach(two, start, max_depth).select(F.expr("substring(node, 2)").alias("node"), "depth")
    both = both.filter(~F.col("node").startswith(P.EXTERNAL)).groupBy(F.col("node").alias("path")).agg(F.min("depth").alias("depth"))
    return both.join(seeds.select("path"), "path", "left_anti")


def dependents(edges: DataFrame, changed: DataFrame, hops: int = 2) -> DataFrame:
    """path of the files that lead to a changed path within so many hops; the changed ones are left out."""
    back = edges.select(F.col("target").alias("path"), F.col("source").alias("next"))
    frontier = pinned(changed.select("path").distinct())
    together = None
    for _ in range(hops):
        frontier = pinned(back.join(beside_edges(frontier), "path").select(F.col("next").alias("path")).distinct())
        together = frontier if together is None else together.unionByName(frontier)
    return together.distinct().join(changed.select("path"), "path", "left_anti")


def shortest_path(edges: DataFrame, source: str, target: str, max_depth: int | None = None) -> DataFrame:
    """hops, path (array): a shortest path, of equal ones the least; no row if there is none. Each round keeps the least path to each node."""
    steps = edges.select(F.col("source").alias("node"), F.col("target").alias("next"))
    spark = edges.sparkSession
    visited = frontier = pinned(spark.createDataFrame([(source, [source])], "node string, path array<string>"))
    while max_depth is None or max_depth > 0:
        hit = visited.filter(F.col("node") == target)
        if not hit.isEmpty():
            return hit.select((F.size("path") - 1).alias("hops"), "path")
        # of the ways to a node, each task keeps the least before its path is made longer
        found = steps.join(beside_edges(frontier), "node").groupBy("next").agg(F.min("path").alias("path")).select(F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
        frontier = pinned(found.join(visited.select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        max_depth = None if max_depth is None else max_depth - 1
    return visited.filter(F.col("node") == target).select((F.size("path") - 1).alias("hops"), "path")


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = P.PAGERANK_ALPHA, rounds: int = P.PAGERANK_ROUNDS, tolerance: float | None = P.PAGERANK_TOLERANCE, start: DataFrame | None = None) -> DataFrame:
    """path, pagerank: power iteration with uniform teleport, dangling mass spread evenly, until the L1 change is below n * tolerance.

    start (path, pagerank): ranks of a graph nearly the same, to begin from; it changes the number of rounds, and the ranks within the tolerance.

    tolerance None: exactly so many rounds. If the rounds don't suffice, every node gets 1 / n. A graph of at most TASK_EDGES edges and nodes is one
    task. Beyond that edges are pairs of numbers, dealt by target once; each round brings the nodes' shares to them and adds up where they stand. The dangling
    mass is one number, fetched with the change.
    """
    n = nodes.count()
    if n == 0:
        return nodes.select("path", F.lit(0.0).alias("pagerank"))
    known = nodes.select("path").join(start.select("path", F.col("pagerank").alias("start")), "path", "left") if start is not None else nodes.select("path", F.lit(None).cast("double").alias("start"))
    known = known.select("path", F.coalesce("start", F.lit(1.0 / n)).alias("start"))
    if n <= TASK_EDGES and edges.count() <= TASK_EDGES:
        out = edges.select("source", "target").distinct()
        return in_one_task(known, out, lambda names, pairs, begin: pagerank_kernel(names, pairs, alpha, rounds, tolerance, begin), "path string, pagerank double", ["path", "pagerank"], "start")
    ids, steps = keyed(edges, nodes)
    # dealt by target once: a round's sums are whole where the edges stand, and only a row of each node is shuffled
    pairs = pinned(steps.repartition("b").distinct())
    leads = pairs.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("out"))
    mass = known.agg(F.sum("start")).first()[0]
    first = ids.join(known, "path").join(leads, "id", "left").select("id", F.coalesce("out", F.lit(0)).alias("out"), (F.col("start") / F.lit(mass)).alias("pagerank"))
    rank = pinned(first.dropDuplicates(["id"]))
    dangles = F.col("out") == 0
    lost = rank.filter(dangles).agg(F.sum("pagerank")).first()[0] or 0.0
    named = lambda df: df.join(ids, "id").select("path", "pagerank")
    for _ in range(rounds):
        shares = rank.filter(~dangles).select(F.col("id").alias("a"), (F.col("pagerank") / F.col("out")).alias("share"))
        sent = pairs.join(beside_edges(shares), "a").groupBy(F.col("b").alias("id")).agg(F.sum("share").alias("got"))
        fresh = alpha * (F.coalesce("got", F.lit(0.0)) + F.lit(lost / n)) + F.lit((1 - alpha) / n)
        step = pinned(rank.join(sent, "id", "left").select("id", "out", fresh.alias("pagerank"), F.col("pagerank").alias("before")))
        seen = step.agg(F.sum(F.abs(F.col("pagerank") - F.col("before"))).alias("change"), F.sum(F.when(dangles, F.col("pagerank"))).alias("lost")).first()
        rank, lost = step.select("id", "out", "pagerank"), seen["lost"] or 0.0
        if tolerance is not None and seen["change"] < n * tolerance:
            return named(rank)
    if tolerance is not None:
        return nodes.select("path").distinct().select("path", F.lit(1.0 / n).alias("pagerank"))
    return named(rank)


#: Edges, and nodes, of a graph that one task may hold.
TASK_EDGES = 1_000_000


def in_one_task(nodes: DataFrame, edges: DataFrame, kernel: Callable, schema: str, columns: list[str], value: str | None = None) -> DataFrame:
    """kernel(names, pairs) -> a column of values for the names, over a graph whose size the caller has checked. value: a column of nodes that the kernel gets too, in the order of the names."""
    given = F.lit(None).cast("double") if value is None else F.col(value).cast("double")
    rows = nodes.select(F.col("path").alias("a"), F.lit(None).cast("string").alias("b"), given.alias("v")).dropDuplicates(["a"])
    rows = rows.unionByName(edges.select(F.col("source").alias("a"), F.col("target").alias("b"), F.lit(None).cast("double").alias("v")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        alone = pdf["b"].isna()
        names = sorted(pdf.loc[alone, "a"])
        index = {x: i for i, x in enumerate(names)}
        pairs = np.array([(index[a], index[b]) for a, b in zip(pdf.loc[~alone, "a"], pdf.loc[~alone, "b"], strict=True) if a in index and b in index], np.int64).reshape(-1, 2)
        more = () if value is None else (pdf.loc[alone].set_index("a")["v"].reindex(names).to_numpy(),)
        return pd.DataFrame({columns[0]: names, columns[1]: kernel(names, pairs, *more)})

    return rows.groupBy(F.lit(0).alias("one")).applyInPandas(run, schema)


def pagerank_kernel(names: list[str], pairs: np.ndarray, alpha: float, rounds: int, tolerance: float | None, begin: np.ndarray | None = None) -> np.ndarray:
    """Power iteration over an edge array without repeats."""
    n = len(names)
    out = np.bincount(pairs[:, 0], minlength=n)
    rank = np.full(n, 1.0 / n) if begin is None else begin / begin.sum()
    for _ in range(rounds):
        share = np.divide(rank, out, out=np.zeros(n), where=out > 0)
        fresh = alpha * (np.bincount(pairs[:, 1], weights=share[pairs[:, 0]], minlength=n) + rank[out == 0].sum() / n) + (1 - alpha) / n
        change, rank = np.abs(fresh - rank).sum(), fresh
        if tolerance is not None and change < n * tolerance:
            return rank
    return rank if tolerance is None else np.full(n, 1.0 / n)


def components_kernel(names: list[str], pairs: np.ndarray) -> list[str]:
    """Least member of each node's strongly connected component, by depth-first search with an explicit stack."""
    n = len(names)
    order = np.argsort(pairs[:, 0], kind="stable")
    to = pairs[order, 1]
    start = np.searchsorted(pairs[order, 0], np.arange(n + 1))
    number, low, on = [-1] * n, [0] * n, [False] * n
    component, stack, count = [0] * n, [], 0
    for root in range(n):
        if number[root] >= 0:
            continue
        work = [(root, start[root])]
        number[root] = low[root] = count
        count += 1
        stack.append(root)
        on[root] = True
        while work:
            u, at = work.pop()
            if at < start[u + 1]:
                work.append((u, at + 1))
                v = int(to[at])
                if number[v] < 0:
                    number[v] = low[v] = count
                    count += 1
                    stack.append(v)
                    on[v] = True
                    work.append((v, start[v]))
                elif on[v]:
                    low[u] = min(low[u], number[v])
                continue
            if low[u] == number[u]:
                members = []
                while True:
                    v = stack.pop()
                    on[v] = False
                    members.append(v)
                    if v == u:
                        break
                least = min(members)  # names are sorted
                for v in members:
                    component[v] = least
            if work:
                p = work[-1][0]
                low[p] = min(low[p], low[u])
    return [names[c] for c in component]


def betweenness(nodes: DataFrame, edges: DataFrame, sample: int | None = None, slices: int | None = None) -> DataFrame:
    """path, betweenness: normalised shortest-path betweenness of a directed graph.

    From BETWEENNESS_EXACT_BELOW nodes on, BETWEENNESS_SAMPLE sources are taken, the first by a hash (a feature, as in the tool whose results these are). Nodes are numbers. Sources are
    dealt to tasks, each with the adjacency as two broadcast arrays (4 bytes an edge and a node, which BETWEENNESS_EDGES bounds), and a task follows many sources at once; partial
    sums are added by node. Beyond that bound the adjacency stands in the shared folder in pieces, which tasks read one by one for each step of their sources.
    """
    n = nodes.count()
    spark = nodes.sparkSession
    if n < 3:
        return nodes.select("path", F.lit(0.0).alias("betweenness"))
    if sample is None and n > P.BETWEENNESS_EXACT_BELOW:
        sample = P.BETWEENNESS_SAMPLE
    swept(nodes)  # what the edges' own shuffles left
    ids = numbered(nodes.select("path").distinct(), "id")
    sources = ids if sample is None else ids.orderBy(F.xxhash64("path"), "path").limit(sample)
    pairs = pinned(between(edges, ids).filter("a <> b").select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")).distinct())
    scale = 1.0 / ((n - 1) * (n - 2)) * (1.0 if sample is None else n / min(n, sample))
    dealt = sources.select("id").repartition(slices or spark.sparkContext.defaultParallelism, "id")
    if pairs.count() > BETWEENNESS_EDGES or n > BETWEENNESS_EDGES:
        found = _betweenness_in_pieces(ids.count(), pairs, dealt)
    else:
        found = _betweenness_held(n, pairs, dealt)
    parts = found.groupBy("id").agg(F.sum("part").alias("total"))
    return ids.join(parts, "id", "left").select("path", (F.coalesce("total", F.lit(0.0)) * scale).alias("betweenness"))


def _betweenness_held(n: int, pairs: DataFrame, dealt: DataFrame) -> DataFrame:
    """id, part: sums of the dependencies of the sources (id) of a task, with the adjacency broadcast."""
    pairs = pairs.toPandas().to_numpy(np.int32).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    held = dealt.sparkSession.sparkContext.broadcast((np.searchsorted(pairs[:, 0], np.arange(n + 1)).astype(np.int32), np.ascontiguousarray(pairs[:, 1])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, to = held.value
        total = np.zeros(len(start) - 1)
        together = max(1, min(64, SOURCE_CELLS // max(len(total), len(to), 1)))
        for pdf in batches:
            each = pdf["id"].to_numpy(np.int64)
            for i in range(0, len(each), together):
                total += dependencies(start, to, each[i : i + together])
        some = np.flatnonzero(total)
        yield pd.DataFrame({"id": some, "part": total[some]})

    return dealt.mapInPandas(run, "id long, part double")


#: Edges, and nodes, that betweenness may broadcast; nodes or edges times sources that a task follows at once.
BETWEENNESS_EDGES, SOURCE_CELLS = 5_000_000, 1 << 21
#: Edges of a piece of a larger adjacency, pieces of a file, and nodes times sources that a task follows at once over pieces.
PIECE_EDGES, FILE_PIECES, PIECE_CELLS = 1_000_000, 4, 1 << 23


def dependencies(start: np.ndarray, to: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Of each node, the sum of the sources' dependencies on it. to[start[u] : start[u + 1]] are the targets of u.

    Breadth first from all sources together: a cell is a node of one source's search. Path counts go forward level by level, shares come back over the same steps.
    """
    n, k = len(start) - 1, len(sources)
    depth, paths = np.full(k * n, -1, np.int32), np.zeros(k * n)
    frontier = np.arange(k) * n + sources
    depth[frontier], paths[frontier] = 0, 1.0
    steps = []
    while len(frontier):
        u = frontier % n
        size = (start[u + 1] - start[u]).astype(np.int64)
        a = np.repeat(frontier, size)
        at = np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[u], size)
        b = a - a % n + to[at]
        fresh = depth[b] < 0
        depth[b[fresh]] = len(steps) + 1
        onward = depth[b] == len(steps) + 1
        a, b = a[onward], b[onward]
        frontier = np.unique(b)
        np.add.at(paths, b, paths[a])
        steps.append((a, b))
    share = np.zeros(k * n)
    for a, b in reversed(steps):
        part = paths[a] / paths[b] * (1 + share[b])
        np.add.at(share, a, part)
    share[np.arange(k) * n + sources] = 0
    return share.reshape(k, n).sum(0)


def _betweenness_in_pieces(n: int, pairs: DataFrame, dealt: DataFrame) -> DataFrame:
    """id, part, pinned: as _betweenness_held, with the edges in pieces in the shared folder, once by target and once by source. A task holds one piece and PIECE_CELLS cells, whatever the graph's size."""
    spark = pairs.sparkSession
    root = f"{shared_folder(spark)}/betweenness-{uuid.uuid4().hex}"
    files = max(1, math.ceil(pairs.count() / (PIECE_EDGES * FILE_PIECES)))
    for by, other in (("b", "a"), ("a", "b")):
        lined = pairs.select(F.col(by).alias("node"), F.col(other).alias("other")).repartition(files, "node").sortWithinPartitions("node")
        lined.mapInPandas(_pieces, "nodes binary, starts binary, others binary").write.parquet(f"{root}/{by}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n)
        together = max(1, PIECE_CELLS // n)
        waiting = np.concatenate([np.zeros(0, np.int64), *(pdf["id"].to_numpy(np.int64) for pdf in batches)])
        for i in range(0, len(waiting), together):
            total += dependencies_in_pieces(n, waiting[i : i + together], lambda: _read_pieces(f"{root}/b"), lambda: _read_pieces(f"{root}/a"))
        some = np.flatnonzero(total)
        yield pd.DataFrame({"id": some, "part": total[some]})

    found = pinned(dealt.mapInPandas(run, "id long, part double"))
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return found


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (node, other) in the order of nodes, as pieces of PIECE_EDGES edges: the different nodes, where the others of each begin, and the others."""
    held, size = [], 0

    def piece() -> pd.DataFrame:
        pdf = pd.concat(held)
        node = pdf["node"].to_numpy(np.int32)
        starts = np.flatnonzero(np.diff(node, prepend=-1)).astype(np.int32)
        return pd.DataFrame({"nodes": [node[starts].tobytes()], "starts": [starts.tobytes()], "others": [pdf["other"].to_numpy(np.int32).tobytes()]})

    for pdf in batches:
        held.append(pdf)
        size += len(pdf)
        if size >= PIECE_EDGES:
            yield piece()
            held, size = [], 0
    if size:
        yield piece()


def _read_pieces(folder: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pieces in a folder, one by one: nodes, starts and others."""
    system, path = file_system(folder)
    for info in system.get_file_info(pafs.FileSelector(path)):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as f:
                for b in pq.ParquetFile(f).iter_batches(1):
                    for row in b.to_pylist():
                        yield tuple(np.frombuffer(row[c], np.int32) for c in ("nodes", "starts", "others"))


def dependencies_in_pieces(n: int, sources: np.ndarray, by_target: Callable, by_source: Callable) -> np.ndarray:
    """What dependencies gives, from pieces of edges by target and by source: each step, forward and back, goes over all pieces once, for all sources together."""
    k = len(sources)
    depth, paths = np.full((k, n), -1, np.int32), np.zeros((k, n))
    depth[np.arange(k), sources], paths[np.arange(k), sources] = 0, 1.0

    def met(pieces: Callable, values: np.ndarray) -> np.ndarray:
        out, live = np.zeros((k, n)), np.flatnonzero(values.any(1))
        for nodes, starts, others in pieces() if len(live) else ():
            for j in live:
                out[j, nodes] += np.add.reduceat(values[j][others], starts)
        return out

    level, last = 0, 0
    while (depth == level).any():
        got = met(by_target, np.where(depth == level, paths, 0.0))
        got[depth >= 0] = 0
        level, last = level + 1, level
        fresh = got > 0
        depth[fresh] = level
        paths += got
    share = np.zeros((k, n))
    for level in range(last - 1, -1, -1):
        back = met(by_source, np.divide(1 + share, paths, out=np.zeros((k, n)), where=depth == level + 1))
        share += np.where(depth == level, paths * back, 0.0)
    share[np.arange(k), sources] = 0
    return share.sum(0)


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """path, component (its least member): strongly connected components.

    A graph of at most TASK_EDGES edges and nodes is one task's depth-first search; so is each part of a larger one that no edge joins with others, up to that size. Larger parts are coloured:

    Rounds: nodes without an edge in or out of what is left are components alone; every other node takes the greatest path that reaches it as
    its colour; those that reach the colour's own node inside the colour are its component. Each round removes at least one component of each colour.
    """
    left_nodes = pinned(nodes.select("path").distinct())
    plain = edges.select("source", "target").filter("source <> target")
    if left_nodes.count() <= TASK_EDGES and plain.count() <= TASK_EDGES:
        return in_one_task(left_nodes, plain, components_kernel, "path string, component string", ["path", "component"])
    ids, steps = keyed(plain, left_nodes)
    label, own, more = split(ids, steps, TASK_EDGES)
    rows = label.select("part", F.col("id").alias("a"), F.lit(-1).cast("long").alias("b")).unionByName(own)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["a"].to_numpy(), pdf["b"].to_numpy()
        names, inside = np.unique(a[b < 0]), b >= 0
        pairs = np.stack([np.searchsorted(names, a[inside]), np.searchsorted(names, b[inside])], 1)
        return pd.DataFrame({"id": names, "least": components_kernel(names.tolist(), pairs)})

    least = rows.groupBy("part").applyInPandas(run, "id long, least long")
    held = beside_edges(ids)
    whole = least.join(held, "id").join(held.select(F.col("id").alias("least"), F.col("path").alias("component")), "least").select("path", "component")
    if not more:
        return whole
    rest = ids.join(beside_edges(label.select("id")), "id", "left_anti").select("path")
    kept = beside_edges(pinned(rest))
    left = plain.join(kept.withColumnRenamed("path", "source"), "source", "left_semi").join(kept.withColumnRenamed("path", "target"), "target", "left_semi").distinct()
    return whole.unionByName(_strong_rounds(pinned(rest), pinned(left)))


def _strong_rounds(left_nodes: DataFrame, left: DataFrame) -> DataFrame:
    """strong_components by colours, for parts that no task may hold."""
    found = []
    while True:
        while True:  # trim
            inside = left.select(F.col("target").alias("path")).distinct().join(left.select(F.col("source").alias("path")).distinct(), "path", "left_semi")
            alone = left_nodes.join(inside, "path", "left_anti")
            if alone.isEmpty():
                break
            found.append(alone.select("path", F.col("path").alias("component")))
            left_nodes = pinned(left_nodes.join(inside, "path", "left_semi"))
            left = pinned(left.join(left_nodes.withColumnRenamed("path", "source"), "source", "left_semi").join(left_nodes.withColumnRenamed("path", "target"), "target", "left_semi"))
        if left_nodes.isEmpty():
            break
        colour = pinned(left_nodes.select("path", F.col("path").alias("colour")))
        while True:
            given = left.join(beside_edges(colour.withColumnRenamed("path", "source")), "source").groupBy(F.col("target").alias("path")).agg(F.max("colour").alias("given"))
            fresh = pinned(colour.join(given, "path", "left").select("path", F.greatest("colour", "given").alias("colour"), (F.col("given") > F.col("colour")).alias("changed")))
            colour = fresh.select("path", "colour")
            if fresh.filter("changed").isEmpty():
                break
        held = beside_edges(colour)
        inner = left.join(held.withColumnRenamed("path", "source").withColumnRenamed("colour", "c1"), "source").join(held.withColumnRenamed("path", "target").withColumnRenamed("colour", "c2"), "target").filter("c1 = c2")
        back = reach(inner.select(F.col("target").alias("source"), F.col("source").alias("target")), colour.filter("path = colour").select(F.col("colour").alias("seed"), F.col("path").alias("node")))
        part = pinned(back.select(F.col("node").alias("path"), F.col("seed").alias("colour")))
        found.append(part.join(part.groupBy("colour").agg(F.min("path").alias("component")), "colour").select("path", "component"))
        left_nodes = pinned(left_nodes.join(part, "path", "left_anti"))
        left = pinned(left.join(left_nodes.withColumnRenamed("path", "source"), "source", "left_semi").join(left_nodes.withColumnRenamed("path", "target"), "target", "left_semi"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def cycles(nodes: DataFrame, edges: DataFrame, min_size: int = 2) -> DataFrame:
    """component, size, members (sorted), cycle_path: strongly connected groups of imports with min_size files or more, each with one cycle through its least member.

    The cycle is a shortest one, of equal ones the least path: a traversal from all components' least members at once.
    """
    imports = edges.filter(F.col("edge_type") == P.IMPORTS).select("source", "target").filter(~F.col("target").startswith(P.EXTERNAL))
    member = pinned(strong_components(nodes.filter(~F.col("path").startswith(P.EXTERNAL)), imports))
    big = member.groupBy("component").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("path")).alias("members")).filter(F.col("size") >= min_size)
    big = pinned(big)
    # members come to the edges, and of the ways to a file each task keeps the least before its path is made longer
    held = beside_edges(member.join(big.select("component"), "component", "left_semi"))
    inner = imports.filter("source <> target").join(held.withColumnRenamed("path", "source"), "source").join(held.withColumnRenamed("path", "target").withColumnRenamed("component", "c2"), "target").filter("component = c2")
    inner = pinned(inner.select("component", F.col("source").alias("node"), F.col("target").alias("next")))
    frontier = pinned(big.select("component", F.col("component").alias("node"), F.array("component").alias("path")))
    visited, closed = frontier, None
    while not frontier.isEmpty():
        found = inner.join(beside_edges(frontier), ["component", "node"]).groupBy("component", "next").agg(F.min("path").alias("path"))
        found = pinned(found.select("component", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path")))
        ring = found.filter("node = component").select("component", F.col("path").alias("cycle_path"))
        closed = pinned(ring if closed is None else closed.unionByName(ring.join(closed, "component", "left_anti")))
        frontier = pinned(found.join(closed, "component", "left_anti").join(visited.select("component", "node"), ["component", "node"], "left_anti"))
        visited = visited.unionByName(frontier)
    if closed is None:
        return big.select("component", "size", "members", F.array().cast("array<string>").alias("cycle_path"))
    return big.join(closed, "component", "left").select("component", "size", "members", F.coalesce("cycle_path", "members").alias("cycle_path"))


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, json: nodes and links in node-link form (for graphs that fit one document)."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct(F.col("path").alias("id"), "language", "symbol_count", "is_entry_point", "is_test"))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct("source", "target", "edge_type"))).alias("links"))
    return n.join(e, F.lit(True)).select(F.to_json(F.struct(F.lit(True).alias("directed"), F.lit(False).alias("multigraph"), "nodes", "links")).alias("json"))
