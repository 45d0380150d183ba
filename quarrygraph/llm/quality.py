"""Quality rules: base counts of each text, and a hashed n-gram log-likelihood ratio between two multinomials, with DataFrame functions only.

Words and word pairs fall into buckets, whose number grows with the square root of the corpus, about as its vocabulary does. Their counts over the trusted documents and over the whole corpus, smoothed, are two multinomials; a text's
score is the mean over its n-grams of log(trusted / raw). Every document is kept or not by one fixed threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph.llm.common import stored

#: Buckets of the n-gram multinomials at least and at most; and characters of a word, about, with the space after it.
BUCKETS, MOST_BUCKETS, CHARS_PER_WORD = 16384, 1 << 18, 6
#: Added to each bucket's count, as a share of the mean count. Texts with a lower mean log ratio go.
SMOOTH, THRESHOLD = 0.01, -0.1
#: Log ratios are held to this range: it bounds what one n-gram adds to a score.
CLIP = 8.0

_SPACES = " \t\n\x0b\f\r"
#: Ids up to which the trusted documents are broadcast; beyond that texts are dealt by id.
BROADCAST_IDS = 500_000


def _with_each(text: Column, chars: str, new: str) -> Column:
    """text with each of the characters replaced (a byte search for each, which is faster than one translation by a map)."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(new))
    return text


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_hashes(text: Column) -> Column:
    """Hashes of the words in order, array<long>; null or blank text: empty."""
    plain = _with_each(F.coalesce(text, F.lit("")), _SPACES[1:], " ")
    words = F.array_remove(F.split(plain, " "), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def buckets(docs: DataFrame) -> int:
    """The least power of two, from BUCKETS to MOST_BUCKETS, that is at least twice the square root of the number of n-grams in docs' texts, as its characters tell it."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return min(MOST_BUCKETS, max(BUCKETS, 1 << math.ceil(math.log2(max(1.0, 2 * math.sqrt(2 * chars / CHARS_PER_WORD))))))


def grams(hashes: Column, n_buckets: int = BUCKETS) -> Column:
    """Buckets of the words and of the pairs of neighbours, array<int>."""

    def pairs(h: Column) -> Column:
        ones = F.transform(h, lambda x: F.pmod(x, F.lit(n_buckets)).cast("int"))
        twos = F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(n_buckets)).cast("int"))
        return F.concat(ones, twos)

    return _let(hashes, pairs)


def repeated_words(hashes: Column, window: int = 5) -> Column:
    """Words that lie in windows of `window` words found twice or more in the text."""

    if window != 5:
        raise ValueError("windows are of five words")

    def beside(x: Column, y: Column, first: int) -> Column:
        """Hashes of x's elements with those of y, first - 1 places further on."""
        n = F.size(y) - first + 1
        return F.zip_with(F.slice(x, 1, n), F.slice(y, first, n), lambda a, b: F.xxhash64(a, b))

    def unless_distinct(x: Column, body) -> Column:
        return F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0).cast("long")).otherwise(body(x))

    def covered(w: Column) -> Column:
        def starts(s: Column) -> Column:
            same = lambda i: (F.get(s, i - 1)["h"] == F.get(s, i)["h"]) | (F.get(s, i + 1)["h"] == F.get(s, i)["h"])
            hit = F.filter(F.transform(s, lambda x, i: F.when(F.coalesce(same(i), (F.get(s, i + 1)["h"] == x["h"]), (F.get(s, i - 1)["h"] == x["h"]), F.lit(False)), x["i"])), lambda x: x.isNotNull())
            return F.array_sort(hit)

        def length(d: Column) -> Column:
            zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
            step = lambda a, x: F.struct((a["n"] + x + F.lit(window) - F.greatest(a["end"], x)).cast("long").alias("n"), (x + F.lit(window)).alias("end"))
            return F.aggregate(d, zero, step, lambda a: a["n"])

        order = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(_let(order, starts), length)

    # Two words, twice two, and one: each step runs over two arrays side by side. Five words found twice have four found twice in them, which few texts have.
    def five(h: Column) -> Column:
        longer = lambda four: _let(beside(four, h, 5), lambda w: unless_distinct(w, covered))
        return _let(_let(beside(h, h, 2), lambda two: beside(two, two, 3)), lambda four: unless_distinct(four, longer))

    return _let(hashes, lambda h: F.when(F.size(h) > 4, five(h)).otherwise(F.lit(0).cast("long")))


def base(docs: DataFrame) -> DataFrame:
    """docs' doc_id with the base counts and the word hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(_SPACES)) != "")
    drop = lambda chars: F.length(_with_each(text, chars, ""))
    return docs.select(
        "doc_id",
        F.size("h").cast("long").alias("n_words"),
        drop(_SPACES).cast("long").alias("word_chars"),
        (F.length(text) - drop("#*$%&|<>")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("h")).alias("n_repeat_words"),
        "h",
    )


def multinomials(docs: DataFrame, trusted: DataFrame, n_buckets: int = BUCKETS) -> DataFrame:
    """Counts (bucket, raw, trusted) over all documents and over those whose doc_id is in trusted; docs: doc_id, text. All n-grams of the corpus are counted.

    Texts stay where they are: the ids of the trusted documents are broadcast, up to BROADCAST_IDS of them; beyond that a merge join deals texts by id. A third of all
    rows may be copies, or one word: buckets are summed in each task before they are shuffled.
    """
    good = trusted.select(F.col("doc_id").alias("t_id")).filter("t_id is not null").distinct()
    few = good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    known = docs.join(F.broadcast(good) if few else good.hint("merge"), F.col("doc_id") == F.col("t_id"), "left")
    marked = known.select(F.col("t_id").isNotNull().cast("long").alias("t"), F.explode(grams(word_hashes(F.col("text")), n_buckets)).alias("bucket"))
    return marked.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("trusted"))


def ratios(counts: DataFrame, n_buckets: int = BUCKETS) -> DataFrame:
    """bucket, ratio: log(trusted / raw) of each bucket that has n-grams, within CLIP; 0 without any trusted one."""
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("n_raw"), F.coalesce(F.sum("trusted"), F.lit(0)).alias("n_trusted")).first()

    def log_share(x: Column, total: int) -> Column:
        add = max(total, 1) / n_buckets * SMOOTH
        return F.log((x + F.lit(add)) / F.lit(total + add * n_buckets))

    if not total["n_trusted"]:
        return counts.select("bucket", F.lit(0.0).alias("ratio"))
    ratio = log_share(F.col("trusted").cast("double"), total["n_trusted"]) - log_share(F.col("raw").cast("double"), total["n_raw"])
    return counts.select("bucket", F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), ratio)).alias("ratio"))


def assess(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept: one row for each row of docs.

    Words are runs of characters other than 9-13 and 32. base_failed: fewer than 10 words, or more than a fifth of them in repeated windows of
    5 words. score: mean log ratio of the text's words and pairs (0 without any). kept: not base_failed, and score >= threshold. Null text
    counts as empty; without any trusted document every score is 0; repeated rows give equal rows; an empty table none; other columns aren't read.

    The ratios, at most MOST_BUCKETS numbers, go to the tasks as one array.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_buckets = buckets(plain)
    counts = stored(multinomials(plain, trusted, n_buckets), "counts")
    values = constant(ratios(counts, n_buckets), n_buckets)

    def score(g: Column) -> Column:
        return F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda a, x: a + F.get(values, x)) / F.size(g)).otherwise(0.0)

    out = base(plain.withColumn("h", word_hashes(F.col("text")))).withColumn("score", F.round(_let(grams(F.col("h"), n_buckets), score), 9)).drop("h")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))


def constant(table: DataFrame, n_buckets: int) -> Column:
    """An array of the ratios of a table (bucket, ratio), 0 where a bucket has none: one text that the optimiser turns into an array once, not an expression for each number."""
    given = {r["bucket"]: r["ratio"] for r in table.collect()}
    return F.split(F.lit(",".join(repr(given.get(i, 0.0)) for i in range(n_buckets))), ",").cast("array<double>")


def trusted_documents(labels: DataFrame) -> DataFrame:
    """Documents whose quality label is 1."""
    return labels.filter("quality = 1").select("doc_id")
