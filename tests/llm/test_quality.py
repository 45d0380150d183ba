import math
import random
import re
import struct
from collections import Counter

import pytest

from quarrygraph.llm import quality
from tests.llm.conftest import odd_rows

xxhash = pytest.importorskip("xxhash")


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def of_word(w):
    return signed(xxhash.xxh64_intdigest(w.encode(), seed=42))


def chain(*hashes):
    seed = 42
    for h in hashes:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", h), seed=seed)
    return signed(seed)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    w = words(text)
    seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = set()
    for k in range(len(w) - 4):
        if seen[tuple(w[k : k + 5])] > 1:
            covered.update(range(k, k + 5))
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def grams(text):
    h = [of_word(w) for w in words(text)]
    return [x % quality.BUCKETS for x in h] + [chain(a, b) % quality.BUCKETS for a, b in zip(h, h[1:], strict=False)]


def scores(rows, trusted):
    raw, good = Counter(), Counter()
    for i, t in rows:
        g = grams(t)
        raw.update(g)
        if i in trusted:
            good.update(g)
    n, m = sum(raw.values()), sum(good.values())

    def share(c, total):
        add = max(total, 1) / quality.BUCKETS * quality.SMOOTH
        return math.log((c + add) / (total + add * quality.BUCKETS))

    out = []
    for _, t in rows:
        g = grams(t)
        out.append(sum(max(-quality.CLIP, min(quality.CLIP, share(good[b], m) - share(raw[b], n))) if m else 0.0 for b in g) / len(g) if g else 0.0)
    return out


def check(docs, rows, trusted, spark):
    got = sorted(quality.assess(docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long")).collect(), key=lambda r: (r.doc_id or 0, r.n_words))
    rows = sorted(rows, key=lambda x: (x[0] or 0, len(words(x[1]))))
    for r, (_, t), s in zip(got, rows, scores(rows, trusted), strict=True):
        n, chars, symbols, lines, repeated = base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeated)
        failed = n < 10 or 100 * repeated > 20 * n
        assert r.base_failed == failed and abs(r.score - s) < 1e-6 and r.kept == (not failed and r.score >= quality.THRESHOLD)
    return got


def test_against_brute_force(spark, docs_of):
    rng = random.Random(4)
    good, bad = [f"good{i}" for i in range(80)], [f"junk{i}#" for i in range(40)]
    rows = []
    for i in range(150):
        pool = bad if i % 5 == 0 else good
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(60)))
        text = text.replace(" ", "\n", rng.randrange(4)) + ("\nsame line" * rng.randrange(3)) + (" a b c d e f" * rng.randrange(4) if i % 7 == 0 else "")
        rows.append((i, text))
    got = check(docs_of(rows), rows, {i for i in range(0, 150, 2) if i % 5}, spark)
    long = {i for i, t in rows if len(words(t)) > 25}
    junk = [r.score for r in got if r.doc_id % 5 == 0 and r.doc_id in long]
    clean = [r.score for r in got if r.doc_id % 5 and r.doc_id in long]
    assert sum(junk) / len(junk) < sum(clean) / len(clean) - 1


def test_odd_rows(spark, odd, docs_of, clashing):
    check(odd, odd_rows(), {5, 7}, spark)
    none = spark.createDataFrame([], "doc_id long")
    assert quality.assess(docs_of([]), none).count() == 0
    assert all(r.score == 0 for r in quality.assess(odd, none).collect()) and quality.assess(clashing, none).count() == 2


@pytest.mark.parametrize("text", ["a b c d e a b c d e", "a a a a a a", "a a a a a", "x a b c d e y a b c d e z a b c d e", " a b", "a\x0bb\x0cc", "l\n\nl\n l\nl"])
def test_base_counts(docs_of, text):
    from pyspark.sql import functions as F

    r = quality.base(docs_of([(1, text)]).withColumn("h", quality.word_hashes(F.col("text")))).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(text)


@pytest.mark.parametrize("most", [10**6, 0])
def test_trusted_ids_beyond_the_broadcast(spark, docs_of, monkeypatch, most):
    monkeypatch.setattr(quality, "BROADCAST_IDS", most)
    rows = [(i, " ".join(f"w{(i * 7 + k) % 31}" for k in range(30))) for i in range(40)]
    check(docs_of(rows), rows, set(range(0, 40, 3)), spark)


def test_buckets_grow_with_the_corpus(spark, docs_of):
    assert quality.buckets(docs_of([])) == quality.buckets(docs_of([(1, None)])) == quality.BUCKETS
    big = spark.range(4).selectExpr("id doc_id", "repeat('x', 100000000) text")
    assert quality.buckets(big) == 32768


def test_ties_at_the_threshold_stay(spark, docs_of):
    rows = [(1, " ".join(f"a{k}" for k in range(20))), (2, " ".join(f"b{k}" for k in range(20)))]
    trusted = spark.createDataFrame([(1,)], "doc_id long")
    score = {r.doc_id: r.score for r in quality.assess(docs_of(rows), trusted).collect()}
    kept = {r.doc_id: r.kept for r in quality.assess(docs_of(rows), trusted, threshold=score[2]).collect()}
    assert kept == {1: True, 2: True} and score[2] < score[1]
