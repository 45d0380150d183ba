"""URL filters: rules first, then the ratio of two character language models, one of accepted and one of rejected URLs.

Each model is a Markov chain of variable order over bytes: a byte follows the longest context (up to ORDER bytes) that training has seen, smoothed by the shorter
ones (Witten-Bell: a context gives the rest of the probability to the next shorter one in proportion to the number of different bytes seen after it). A URL is
kept if the difference of its log-likelihoods, divided by its length, reaches a threshold that is calibrated on labelled URLs kept out of the counts.

`judge` learns from every labelled URL, whole. A byte's log ratio depends on the byte and the ORDER bytes before it alone, so the models are a table of such grams: each task counts those of its
URLs, one aggregation adds them up, and the counts of shorter contexts are sums over longer ones. `fit` is the same on two lists in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrygraph.llm.common import parts, text_slices
from quarrygraph.operators.tables import numbered, pinned

#: Bytes of the longest context. Of `train` alone: distinct labelled URLs of a verdict at most, and characters of each.
ORDER, SAMPLE_URLS, SAMPLE_CHARS = 6, 20_000, 2_000
#: One in so many of the labelled URLs is kept out of the counts, for the threshold.
HELD_OUT = 5
#: Grams whose log ratios are broadcast, the most frequent; the others are joined.
HELD_GRAMS = 1_000_000
#: Log ratios are whole numbers of this part, so that their sums don't depend on the order of rows.
UNIT = 2.0**-32
#: Rules (host with its subdomains, beginning of the path): whether a URL that fits is kept. Fixed values.
RULES = {
    "org/": True,
    "example.org/es/": False,
    "example.org/en/1": False,
    "com/fr/": True,
    "com/de/": False,
}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; path: from there up to `?`, `#` or the end. Without `://`, and for null: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    part = lambda pattern, k: F.coalesce(F.regexp_extract(rest, pattern, k), F.lit(""))
    host = F.translate(part(r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, part(r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, bool] = RULES) -> Column:
    """The longest rule (ties: the least) whose host is the URL's or a domain above it, and whose path the URL's begins with; null if none is."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r), r), reverse=True):
        domain, slash, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        out = F.when(fits, rule).otherwise(out)
    return out


@dataclass
class Chain:
    """Counts of one model: for each order, contexts with total count and number of different next bytes, and contexts with a next byte and their count; sorted keys."""

    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    nexts: list[tuple[np.ndarray, np.ndarray]]


def keys(data: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of texts that stand one after another at offsets `at`: its context of `order` bytes as a number, and that with the byte itself. Before a text stand bytes 0.

    A context of six bytes and the next one fit in 64 bits, so no two share a number.
    """
    context = np.zeros(len(data), np.uint64)
    place = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    for k in range(order, 0, -1):
        context <<= np.uint64(8)
        inside = place >= k
        context[inside] |= data[np.flatnonzero(inside) - k].astype(np.uint64)
    return context, context << np.uint64(8) | data


def count(data: np.ndarray, at: np.ndarray, order: int = ORDER) -> Chain:
    """The model of texts (bytes one after another, offsets)."""
    contexts, nexts = [], []
    for k in range(order + 1):
        pair, n = np.unique(keys(data, at, k)[1], return_counts=True)
        context, first = np.unique(pair >> np.uint64(8), return_index=True)
        contexts.append((context, np.add.reduceat(n, first) if len(pair) else n, np.diff(np.append(first, len(pair)))))
        nexts.append((pair, n))
    return Chain(contexts, nexts)


def _found(keys_: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of the wanted keys; 0 where there is none."""
    if not len(keys_):
        return np.zeros(len(wanted))
    i = np.minimum(np.searchsorted(keys_, wanted), len(keys_) - 1)
    return np.where(keys_[i] == wanted, values[i], 0).astype(float)


def log_likelihood(chain: Chain, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logarithm of each byte's probability."""
    p = np.full(len(data), 1 / 256)
    for k, ((context, total, kinds), (pair, n)) in enumerate(zip(chain.contexts, chain.nexts, strict=True)):
        c, cx = keys(data, at, k)
        seen, different = _found(context, total, c), _found(context, kinds, c)
        p = np.where(seen > 0, (_found(pair, n, cx) + different * p) / np.maximum(1, seen + different), p)
    return np.log(p)


@dataclass
class Model:
    """accepted and rejected; None where one of the verdicts has no example: then every URL has score 0. threshold: of the mean log ratio."""

    accepted: Chain | None
    rejected: Chain | None
    threshold: float = 0.0

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The mean over its bytes of each text's log ratio (an empty text: 0)."""
        out, size = np.zeros(len(at) - 1), np.diff(at)
        if self.accepted is None or self.rejected is None or not len(data):
            return out
        ratio = np.concatenate([[0.0], np.cumsum(log_likelihood(self.accepted, data, at) - log_likelihood(self.rejected, data, at))])
        return np.where(size > 0, (ratio[at[1:]] - ratio[at[:-1]]) / np.maximum(size, 1), 0.0)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of the texts one after another, and their offsets."""
    raw = [t.encode("utf-8") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def fit(accepted: list[str], rejected: list[str]) -> Model:
    """A model of two lists of distinct URLs. Every HELD_OUT-th of each is kept out of the counts; the threshold has the least sum of error shares on those (of several, that
    nearest to the middle of the gap). Without both verdicts every score is 0 and every URL is kept.
    """
    used, held = ([[u for i, u in enumerate(x) if (i % HELD_OUT == 0) == out] for x in (accepted, rejected)] for out in (False, True))
    if not all(used):
        used, held = [accepted, rejected], [accepted, rejected]
    if not (accepted and rejected):
        return Model(None, None)
    model = Model(*(count(*joined(x)) for x in used))
    good, bad = (np.sort(np.round(model.scores(*joined(x)), 9)) for x in held)
    both = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([both[:1] - 1, (both[:-1] + both[1:]) / 2, both[-1:] + 1])
    wrong = np.searchsorted(good, cuts) / len(good) + 1 - np.searchsorted(bad, cuts) / len(bad)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    model.threshold = float(cuts[best[len(best) // 2]])
    return model


def train(labelled: DataFrame, most: int = SAMPLE_URLS) -> Model:
    """A model in memory, for callers that ask for one of bounded size (`judge` learns from all): of labelled URLs (url, accepted boolean), of each verdict, at most `most` distinct URLs, the
    first by a hash of the URL, and SAMPLE_CHARS characters of each.

    Null URLs and verdicts are no examples. A URL counts once, however often it stands in the table; with both verdicts, under both.
    """
    known = labelled.select(F.substring(F.col("url").cast("string"), 1, SAMPLE_CHARS).alias("url"), F.col("accepted").cast("boolean").alias("accepted")).filter("url is not null AND accepted is not null")
    spot = F.shiftrightunsigned(F.xxhash64(F.lit(11).cast("long"), "url"), 11) * F.lit(2.0**-53)
    rough = {r.accepted: r.n for r in known.groupBy("accepted").agg(F.approx_count_distinct("url").alias("n")).collect()}
    chosen: dict[bool, list[str]] = {True: [], False: []}
    for verdict, n in rough.items():
        # the hash spreads distinct URLs evenly: a share of its range holds about as many as are wanted, and is widened if it doesn't
        share = min(1.0, 1.5 * most / max(1, n))
        while True:
            rows = known.filter((F.col("accepted") == verdict) & (spot < share)).groupBy("url").agg(F.min(spot).alias("spot")).orderBy("spot", "url").limit(most).collect()
            if len(rows) >= most or share >= 1:
                break
            share = min(1.0, share * 2)
        chosen[verdict] = [r.url for r in rows]
    return fit(chosen[True], chosen[False])


def examples(labelled: DataFrame) -> tuple[DataFrame, int, int]:
    """url, accepted, used, held of every distinct labelled URL (null URLs and verdicts are none; with both verdicts, under both), and the numbers of accepted and rejected ones.

    Every HELD_OUT-th of a verdict, in the order of a hash, is held: kept out of the counts. Where a verdict has one example, all are used and held.
    """
    known = labelled.select(F.col("url").cast("string").alias("url"), F.col("accepted").cast("boolean").alias("accepted")).filter("url is not null AND accepted is not null").distinct()
    spot = F.shiftrightunsigned(F.xxhash64(F.lit(11).cast("long"), "url"), 11)
    placed = numbered(known.orderBy("accepted", spot, "url"))
    sizes = {row.accepted: row.n for row in placed.groupBy("accepted").agg(F.count("*").alias("n")).collect()}
    good, bad = sizes.get(True, 0), sizes.get(False, 0)
    if min(good, bad) < 2:
        return placed.select("url", "accepted", F.lit(True).alias("used"), F.lit(True).alias("held")), good, bad
    held = (F.col("n") - F.when(F.col("accepted"), bad).otherwise(0)) % HELD_OUT == 0
    return placed.select("url", "accepted", (~held).alias("used"), held.alias("held")), good, bad


def grams(texts: DataFrame) -> DataFrame:
    """gram, n, a, r: each byte with the ORDER bytes before it, as a number, in texts (url, a boolean, r boolean); how often it stands there, in those with a, and in those with r."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2)]
            for i, j, data, at in text_slices(b.column(0)):
                gram, which = np.unique(keys(data, at, ORDER)[1].view(np.int64), return_inverse=True)
                marked = [np.bincount(which, np.repeat(m[i:j], np.diff(at)), len(gram)).astype(np.int64) for m in marks]
                yield pa.record_batch([pa.array(x) for x in (gram, np.bincount(which, minlength=len(gram)), *marked)], ["gram", "n", "a", "r"])

    each = texts.select("url", "a", "r").mapInArrow(run, "gram long, n long, a long, r long")
    return each.groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("n", "a", "r")))


def ratios(counted: DataFrame) -> DataFrame:
    """gram, n, ratio (long, of UNIT): the log ratio of the gram's last byte after the others, by both models. counted: gram, n, a, r.

    The grams of a shorter context are the ends of longer ones. The probability at a context of k bytes takes that at k - 1, so the tables of the contexts' lengths are joined one after another;
    a context has at most 256 next bytes, and a gram as many longer by a byte, so no key is hot.
    """
    of = lambda k: F.struct(F.lit(k).alias("k"), F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("g"), "a", "r")
    ends = counted.select(F.explode(F.array(*(of(k) for k in range(ORDER + 1)))).alias("x")).select("x.*").groupBy("k", "g").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    context = Window.partitionBy("k", F.shiftright("g", 8))
    whole = [f(c).over(context).alias(name + c) for c in ("a", "r") for name, f in (("seen_", F.sum), ("kinds_", lambda c: F.count_if(F.col(c) > 0)))]
    levels = pinned(ends.select("k", "g", "a", "r", *whole))
    chance = lambda c: F.when(F.col(f"seen_{c}") > 0, (F.col(c) + F.col(f"kinds_{c}") * F.col(f"p_{c}")) / (F.col(f"seen_{c}") + F.col(f"kinds_{c}"))).otherwise(F.col(f"p_{c}")).alias(f"p_{c}")
    found = levels.filter("k = 0").withColumns({"p_a": F.lit(1 / 256), "p_r": F.lit(1 / 256)}).select("g", chance("a"), chance("r"))
    for k in range(1, ORDER + 1):
        level = levels.filter(F.col("k") == k).drop("k").withColumn("end", F.col("g").bitwiseAND((1 << 8 * k) - 1))
        found = level.join(found.withColumnRenamed("g", "end"), "end").select("g", chance("a"), chance("r"))
    return counted.select("gram", "n").join(found.withColumnRenamed("g", "gram"), "gram").select("gram", "n", F.round((F.log("p_a") - F.log("p_r")) / UNIT).cast("long").alias("ratio"))


@dataclass
class Learned:
    """ratios: gram, n, ratio of all grams of the URLs that are judged or held; None where one of the verdicts has no example: then every URL has score 0. frequent: those with this n or more are broadcast."""

    ratios: DataFrame | None
    frequent: int = 0
    threshold: float = 0.0


def score(rows: DataFrame, learned: Learned) -> DataFrame:
    """rows with score (double) of their column url in place of a column so named: the mean over its bytes of the log ratio; null url: that of an empty text, 0.

    The frequent grams' ratios are broadcast, and added up where the URLs stand; what others a row has is exploded and joined with theirs.
    """
    rows = rows.drop("score")
    if learned.ratios is None:
        return rows.withColumn("score", F.lit(0.0))
    few = learned.ratios.filter(F.col("n") >= learned.frequent).select("gram", "ratio").toPandas().sort_values("gram")
    held = rows.sparkSession.sparkContext.broadcast((few["gram"].to_numpy(np.int64), few["ratio"].to_numpy(np.int64)))
    names = rows.columns
    place = names.index("url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, value = held.value
        for b in parts(batches):
            sums, rare = [np.zeros(0, np.int64)], []
            for _, _, data, at in text_slices(b.column(place)):
                gram = keys(data, at, ORDER)[1].view(np.int64)
                spot = np.minimum(np.searchsorted(known, gram), max(0, len(known) - 1))
                found = known[spot] == gram if len(known) else np.zeros(len(gram), bool)
                total = np.concatenate([[0], np.cumsum(np.where(found, value[spot] if len(known) else 0, 0))])
                sums.append(total[at[1:]] - total[at[:-1]])
                left = np.concatenate([[0], np.cumsum(~found)])[at]
                rare += [x.tolist() for x in np.split(gram[~found], left[1:-1])]
            yield pa.record_batch([*b.columns, pa.array(np.concatenate(sums).astype(np.int64)), pa.array(rare, pa.list_(pa.int64()))], [*names, "_sum", "_rare"])

    added = [T.StructField("_sum", T.LongType()), T.StructField("_rare", T.ArrayType(T.LongType()))]
    some = rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added]))
    total = F.col("_sum")
    if learned.frequent > 1:
        some = pinned(some.withColumn("_row", F.monotonically_increasing_id()))
        each = some.select("_row", F.explode("_rare").alias("gram")).join(learned.ratios.filter(F.col("n") < learned.frequent).select("gram", "ratio"), "gram")
        some = some.join(each.groupBy("_row").agg(F.sum("ratio").alias("_more")), "_row", "left")
        total = total + F.coalesce("_more", F.lit(0))
    size = F.octet_length("url")
    return some.select(*names, F.when(size > 0, F.round(total * UNIT / size, 9)).otherwise(0.0).alias("score"))


def cut(scored: DataFrame) -> float:
    """The threshold of scored URLs (accepted, score), some of each verdict: of the cuts between neighbouring scores, below all and above all, that with the least sum of error shares; of several, the middle one.

    Counts below a score are sums of whole ranges of scores and of the rows before it in its own range.
    """
    good, bad = F.count_if("accepted"), F.count_if(~F.col("accepted"))
    at = pinned(scored.groupBy("score").agg(good.alias("good"), bad.alias("bad")).orderBy("score").withColumn("_place", F.monotonically_increasing_id()))
    at = at.withColumn("_part", F.shiftright("_place", 33))
    ranges = at.groupBy("_part").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.max("score").alias("last"))
    order, inner = Window.orderBy("_part"), Window.partitionBy("_part").orderBy("score")
    before = ranges.select("_part", (F.sum("g").over(order) - F.col("g")).alias("g"), (F.sum("b").over(order) - F.col("b")).alias("b"), F.lag("last").over(order).alias("last"))
    whole = ranges.agg(F.sum("g").alias("g"), F.sum("b").alias("b"), F.max("last").alias("last")).first()
    below = lambda c, start: F.sum(c).over(inner) - F.col(c) + F.col(start)
    lower = F.coalesce(F.lag("score").over(inner), "last")
    # shares times both numbers, so that equal sums are equal
    wrong = lambda g, b: (g * F.lit(whole.b) + (F.lit(whole.b) - b) * F.lit(whole.g)).alias("wrong")
    cuts = at.join(F.broadcast(before), "_part").select(F.coalesce((lower + F.col("score")) / 2, F.col("score") - 1).alias("cut"), wrong(below("good", "g"), below("bad", "b")))
    above = scored.sparkSession.range(1).select(F.lit(whole.last + 1).alias("cut"), wrong(F.lit(whole.g), F.lit(whole.b)))
    cuts = pinned(cuts.unionByName(above))
    best = cuts.join(F.broadcast(cuts.agg(F.min("wrong").alias("wrong"))), "wrong").select("cut")
    several = best.count()
    if several > 1:
        best = numbered(best.orderBy("cut")).filter(F.col("n") == several // 2)
    return float(best.first()["cut"])


def learn(labelled: DataFrame, rows: DataFrame) -> Learned:
    """Models of all labelled URLs (url, accepted boolean), for the grams of rows (url), and their threshold."""
    known, good, bad = examples(labelled)
    if not (good and bad):
        return Learned(None)
    texts = known.select("url", (F.col("used") & F.col("accepted")).alias("a"), (F.col("used") & ~F.col("accepted")).alias("r"))
    no = F.lit(False)
    table = pinned(ratios(pinned(grams(texts.unionByName(rows.select("url", no.alias("a"), no.alias("r")))))))
    learned = Learned(table)
    if table.count() > HELD_GRAMS:
        # by powers of two: the least one that leaves few enough
        sizes = {row.k: row.n for row in table.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("n")).collect()}
        k = max(sizes) + 1
        while k - 1 in range(max(sizes) + 1) and sum(n for x, n in sizes.items() if x >= k - 1) <= HELD_GRAMS:
            k -= 1
        learned.frequent = 1 << k
    learned.threshold = cut(score(known.filter("held").select("url", "accepted"), learned).select("accepted", "score"))
    return learned


def judge(pages: DataFrame, rules: dict[str, bool] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), score: one row for each row of pages.

    A rule decides where one fits; else the score against its threshold does. The models are learned from all of labelled (url, accepted), by default the URLs of pages that a rule
    decides. A null URL, and one without `://`, has an empty host and path, fits no rule and is scored as it is (null as empty, score 0). Repeated rows give equal rows, an empty table
    none; where no URL is labelled, or all alike, what no rule decides is allowed. Only page_id and url are read.
    """
    host, path = host_and_path(F.col("url"))
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    ruled = read.withColumn("host", host).withColumn("path", path).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    allowed = [r for r, keep in rules.items() if keep]
    if labelled is None:
        labelled = ruled.filter("rule is not null").select("url", F.col("rule").isin(allowed).alias("accepted"))
    learned = learn(labelled, ruled)
    keep = F.when(F.col("rule").isNotNull(), F.col("rule").isin(allowed)).otherwise(F.col("score") >= learned.threshold)
    return score(ruled, learned).select("page_id", "host", "path", "rule", F.when(keep, "allow").otherwise("block").alias("verdict"), "score")
