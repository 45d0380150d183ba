import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrygraph.llm import urlmarkov

SCHEMA = "page_id long, url string, html string"


def chance(texts, order=urlmarkov.ORDER):
    """p(byte | text before) by the definition, from counts in dictionaries."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        padded = b"\0" * order + t.encode()
        for i in range(order, len(padded)):
            for k in range(order + 1):
                counts[k][padded[i - k : i], padded[i]] += 1
    follow = [{} for _ in range(order + 1)]
    for k in range(order + 1):
        for (c, x), n in counts[k].items():
            follow[k].setdefault(c, {})[x] = n

    def p(before, x):
        out = 1 / 256
        before = b"\0" * order + before
        for k in range(order + 1):
            seen = follow[k].get(before[len(before) - k :])
            if seen:
                out = (seen.get(x, 0) + len(seen) * out) / (sum(seen.values()) + len(seen))
        return out

    return p


def by_hand(good, bad, text):
    raw = text.encode()
    if not raw:
        return 0.0
    return sum(math.log(good(raw[:i], raw[i])) - math.log(bad(raw[:i], raw[i])) for i in range(len(raw))) / len(raw)


def parsed(url):
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    fit = []
    for rule in urlmarkov.RULES:
        domain, _, start = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
            fit.append(rule)
    return max(fit, key=len, default=None)


URLS = [
    "http://a.example.org/en/7", "http://EXAMPLE.org/en/12?x=1", "https://blog.example.org/en/1", "http://example.org/es/3", "http://notexample.org/es/3", "http://x.com/fr/1", "http://x.com/de/1#f", "http://com/de/9", "http://com.de/de/9",
    "http://x.com/en/?/fr/", "http://x.com", "http://org", "http://org/", "http://org?/a", "http://a.org#/es/", "no scheme", "", "://", "a://b://c/d", "http://x.net/ñ/É", "mailto:a@b.org", "http://Ä.ORG/en/", "http://u@x.org:80/es/", "x\n://a.org/\ny?z",
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate([*URLS, None])], SCHEMA)
    got = {r.page_id: r for r in urlmarkov.judge(pages).collect()}
    assert len(got) == len(URLS) + 1
    for i, u in enumerate([*URLS, None]):
        host, path = parsed(u)
        rule = ruled(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        if rule:
            assert got[i].verdict == ("allow" if urlmarkov.RULES[rule] else "block"), u
    assert got[2].rule == "example.org/en/1" and got[4].rule == "org/" and got[7].rule == "com/de/" and got[8].rule is None


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab/.é"), max_size=9), min_size=1, max_size=6), st.lists(st.text(st.sampled_from("ab/.é"), max_size=9), min_size=1, max_size=6), st.lists(st.text(st.sampled_from("abc/é"), max_size=12), min_size=1, max_size=5))
def test_scores_against_definition(good, bad, texts):
    model = urlmarkov.Model(urlmarkov.count(*urlmarkov.joined(good)), urlmarkov.count(*urlmarkov.joined(bad)))
    p, q = chance(good), chance(bad)
    assert np.allclose(model.scores(*urlmarkov.joined(texts)), [by_hand(p, q, t) for t in texts], atol=1e-9)


def test_probabilities_sum_to_one():
    data, at = urlmarkov.joined(["http://a.org/x", "http://b.org/y"])
    chain = urlmarkov.count(data, at)
    for before in (b"", b"http", b"http://a", b"zz"):
        texts, where = urlmarkov.joined([(before + bytes([x])).decode("latin1") for x in range(128)])
        inside = np.exp(urlmarkov.log_likelihood(chain, texts, where)[where[1:] - 1]).sum()
        beyond = chance(["http://a.org/x", "http://b.org/y"])
        assert abs(inside + sum(beyond(before, x) for x in range(128, 256)) - 1) < 1e-9


def made(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        good = rng.random() < 0.6
        host = "".join(rng.choice(["news", "wiki", "read"] if good else ["bet", "win", "ads"]) for _ in range(2))
        out.append((i, f"http://{host}{rng.randrange(50)}.{rng.choice(['net', 'info'])}/{rng.choice(['article', 'page'] if good else ['click', 'offer'])}/{rng.randrange(10**5)}", good))
    return out


def test_held_out_verdicts(spark):
    """Labelled URLs of two kinds: 99 % of others of these kinds, none of them seen in training, are told apart."""
    rows, new = made(1500, 1), made(600, 2)
    labelled = spark.createDataFrame([r[1:] for r in rows], "url string, accepted boolean")
    got = {r.page_id: r for r in urlmarkov.judge(spark.createDataFrame([(i, u, None) for i, u, _ in new], SCHEMA), {}, labelled).collect()}
    assert sum((got[i].verdict == "allow") == good for i, _, good in new) >= 594 and not {u for _, u, _ in new} & {u for _, u, _ in rows}


def test_whole_query_against_brute_force(spark):
    """Labels by the rules, models, threshold and verdicts again by hand."""
    rows = [(i, f"http://{h}.{d}/{p}/{i}", None) for i, (h, d, p) in enumerate((h, d, p) for h in ("alpha", "beta", "gamma") for d in ("example.org", "b.com", "c.net") for p in ("en", "es", "fr", "de") for _ in range(4))]
    got = {r.page_id: r for r in urlmarkov.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    verdict = {u: ruled(*parsed(u)) for _, u, _ in rows}
    spot = {r.url: r.h for r in spark.createDataFrame([(u,) for u in verdict], "url string").selectExpr("url", "shiftrightunsigned(xxhash64(11L, url), 11) h").collect()}
    sides = [sorted((u for u, r in verdict.items() if r and urlmarkov.RULES[r] == keep), key=spot.get) for keep in (True, False)]
    models = [chance([u for i, u in enumerate(x) if i % 5]) for x in sides]
    held = [[round(by_hand(*models, u), 9) for i, u in enumerate(x) if i % 5 == 0] for x in sides]
    threshold = urlmarkov.fit(*sides).threshold
    wrong = lambda c: sum(s < c for s in held[0]) / len(held[0]) + sum(s >= c for s in held[1]) / len(held[1])
    assert wrong(threshold) <= min(wrong(c) for c in (x + e for x in sum(held, []) for e in (-1e-6, 1e-6))) + 1e-9
    for i, u, _ in rows:
        assert abs(got[i].score - by_hand(*models, u)) < 1e-8
        rule = verdict[u]
        assert got[i].verdict == ("allow" if (urlmarkov.RULES[rule] if rule else got[i].score >= threshold) else "block")


def test_sample_is_bounded_and_counts_urls_once(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(urlmarkov, "fit", lambda a, r: seen.update(a=a, r=r))
    rows = [("http://hot", True)] * 500 + [(f"http://u{i}", i % 2 == 0) for i in range(400)] + [(None, True), ("http://n", None), ("x" * 5000, False)]
    urlmarkov.train(spark.createDataFrame(rows, "url string, accepted boolean").repartition(3), 50)
    assert len(seen["a"]) == len(set(seen["a"])) == 50 and len(seen["r"]) == len(set(seen["r"])) == 50
    urlmarkov.train(spark.createDataFrame(rows, "url string, accepted boolean"), 10_000)
    assert len(seen["a"]) == 201 and len(seen["r"]) == 201 and max(map(len, seen["r"])) == urlmarkov.SAMPLE_CHARS


@pytest.mark.parametrize("rules", [{}, {"org/": True}, {"org/": False}])
def test_one_verdict_only(spark, rules):
    got = urlmarkov.judge(spark.createDataFrame([(1, "http://a.org/x", None), (2, "http://b.net/", None)], SCHEMA), rules).collect()
    assert {r.page_id: r.verdict for r in got} == {1: "block" if rules.get("org/") is False else "allow", 2: "allow"} and all(r.score == 0 for r in got)


def test_odd_rows(spark):
    long = "http://x.org/" + "a/" * 200_000
    rows = [(1, long, None), (1, long, None), (None, "http://y.com/de/", None), (2, None, None), (3, "", None)]
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'z' AS host", "'z' AS rule", "1 AS score", "'z' AS verdict", "0 AS accepted")
    got = urlmarkov.judge(pages).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in got) == [(0, "block"), (1, "allow"), (1, "allow"), (2, next(r.verdict for r in got if r.page_id == 2)), (3, next(r.verdict for r in got if r.page_id == 3))]
    assert urlmarkov.judge(pages.limit(0)).count() == 0


def test_every_labelled_url_counts_whole(spark, monkeypatch):
    """Labels beyond a sample's bounds, by number and by length, count: scores and threshold are those of all of them in memory, with all grams broadcast, some of them, and none."""
    monkeypatch.setattr(urlmarkov, "SAMPLE_URLS", 40)
    monkeypatch.setattr(urlmarkov, "SAMPLE_CHARS", 12)
    rows = [(u, good) for _, u, good in made(300, 4)] + [(u, not good) for _, u, good in made(20, 4)] + [("http://x.net/" + "ab/" * 900, True), ("", False), (None, True), ("http://n", None)]
    labelled = spark.createDataFrame(rows * 2, "url string, accepted boolean").repartition(3)
    new = [u for _, u, _ in made(60, 5)] + ["", None, "é", "http://x.net/" + "ab/" * 950]
    hashes = {r.url: r.h for r in spark.createDataFrame([(u,) for u, _ in rows if u is not None], "url string").selectExpr("url", "shiftrightunsigned(xxhash64(11L, url), 11) h").collect()}
    model = urlmarkov.fit(*(sorted({u for u, g in rows if g is good and u is not None}, key=hashes.get) for good in (True, False)))
    expected = model.scores(*urlmarkov.joined([u or "" for u in new]))
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(new)], SCHEMA)
    for most in (10**6, 50, 0):
        monkeypatch.setattr(urlmarkov, "HELD_GRAMS", most)
        got = {r.page_id: r for r in urlmarkov.judge(pages, {}, labelled).collect()}
        assert len(got) == len(new) and all(abs(got[i].score - x) < 2e-9 for i, x in enumerate(expected))
        assert all(got[i].verdict == ("allow" if x >= model.threshold else "block") for i, x in enumerate(expected) if abs(x - model.threshold) > 1e-8)


def test_cut_against_fit(spark):
    """The threshold of scores in several ranges, with ties and none, is that of the lists in memory."""
    rng = random.Random(3)
    for size, digits in ((400, 2), (300, 9), (6, 0), (2, 9)):
        rows = [(i % 2 == 0, round(rng.gauss(0.5 if i % 2 == 0 else -0.5, 1), digits)) for i in range(size)]
        good, bad = (sorted(x for g, x in rows if g is side) for side in (True, False))
        both = sorted(set(good + bad))
        cuts = [both[0] - 1, *((x + y) / 2 for x, y in zip(both, both[1:], strict=False)), both[-1] + 1]
        wrong = [sum(x < c for x in good) * len(bad) + sum(x >= c for x in bad) * len(good) for c in cuts]
        best = [c for c, w in zip(cuts, wrong, strict=True) if w == min(wrong)]
        assert abs(urlmarkov.cut(spark.createDataFrame(rows, "accepted boolean, score double")) - best[len(best) // 2]) < 1e-12
