import hashlib
import math
import os
import random
import zlib
from collections import Counter

import pytest

from quarrygraph.llm import media
from quarrygraph.runtime import ship
from tests.llm.conftest import odd_rows


def test_png_round_trip():
    for text in ("", "a", "é" * 500, "x" * 192, "y" * 193):
        payload, n = media.payload_of(text)
        assert len(payload) % media.ROW == 0 and len(payload) >= media.ROW and n == len(text.encode()) and media.from_png(media.to_png(payload)) == payload
    with pytest.raises(ValueError):
        media.from_png(b"nothing")
    image = bytearray(media.to_png(payload))
    image[50] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(image))


def brute_png(payload):
    """The image's bytes put together by hand."""
    lines = b"".join(b"\0" + payload[i : i + 192] for i in range(0, len(payload), 192))
    part = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", (192).to_bytes(4, "big") + (len(payload) // 192).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])) + part(b"IDAT", zlib.compress(lines, 1)) + part(b"IEND", b"")


def brute_feature(payload):
    n = len(payload)
    share = [c / n for c in Counter(payload).values()]
    edge = [int(k * n / 65) for k in range(66)]
    means = [sum(payload[a:b]) / (b - a) for a, b in zip(edge, edge[1:], strict=False)]
    bits = "".join("1" if b > a else "0" for a, b in zip(means, means[1:], strict=False))
    return f"{n // 192};{sum(payload) / n:.4f};{-sum(p * math.log2(p) for p in share):.4f};{int(bits, 2):016x}"


def test_text_media(odd, docs_of, clashing):
    texts = dict(odd_rows())
    got = media.text_media(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert r.media_sha256 == hashlib.sha256(brute_png(padded)).hexdigest() and r.media_bytes == len(brute_png(padded)) and r.feature == brute_feature(padded) and r.position == int(bool((texts[r.doc_id] or "").split("\n")[0].split())) and r.caption == f"{r.doc_id}: {len(raw)} bytes"
    same = [tuple(r)[1:8] for r in got if r.doc_id in (5, 6)]
    assert same[0] == same[1]
    assert media.text_media(docs_of([])).count() == 0 and media.text_media(clashing).count() == 2


def test_captions_before_after_and_without_a_picture():
    item = lambda page: [(x["kind"], x["text"] or x["ref"], x["caption"]) for x in media.sequence(page)]
    assert item("<figure><figcaption>Before</figcaption><img src=a alt=x></figure>") == [("image", "a", "Before")]
    assert item("<figure><img src=a><img src=b><figcaption>Both</figcaption></figure>t") == [("image", "a", "Both"), ("image", "b", "Both"), ("text", "t", None)]
    assert item("<figure><figcaption>Alone</figcaption></figure>") == [("text", "Alone", None)]
    assert item("<figure><img src=a><figcaption>Never closed") == [("image", "a", "Never closed")]
    assert item("<figcaption>No figure</figcaption>") == [("text", "No figure", None)]
    assert item("<figure><img src=a><figure><img src=b><figcaption>In</figcaption></figure><figcaption>Out</figcaption></figure>") == [("image", "a", "Out"), ("image", "b", "In")]


def test_interleaved_documents_against_brute_force(spark, docs_of):
    """Pages of several texts and references in random order: every item keeps its place, and each reference gets its own payload's row."""
    ship(spark)
    rng = random.Random(4)
    store = media.store_texts(docs_of([(i, f"text {i} " * (i + 1)) for i in range(20)]))
    digest = {r.doc_id: r.digest for r in store.collect()}
    expected, rows = [], []
    for page_id in range(30):
        page = ""
        for position in range(rng.randrange(9)):
            if rng.random() < 0.5:
                page += f"<p>words {position}</p>"
                expected.append((page_id, position, "text", f"words {position}", None, None))
            else:
                i = rng.randrange(25)
                caption = f"<figcaption>about {i}</figcaption>"
                before, after = (caption, "") if rng.random() < 0.5 else ("", caption)
                page += f'<figure>{before}<img src="{media.SCHEME}{digest.get(i, "0" * 64)}">{after}</figure>'
                payload = media.payload_of(f"text {i} " * (i + 1))[0]
                expected.append((page_id, position, "image", None, f"about {i}", hashlib.sha256(payload).hexdigest() if i in digest else None))
        rows.append((page_id, page))
    got = media.resolve(media.sequences(spark.createDataFrame(rows, "page_id long, html string")), media.index_store(store)).collect()
    assert sorted((r.page_id, r.position, r.kind, r.text, r.caption, r.payload_sha256) for r in got) == sorted(expected)


def test_sequences_of_pages(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    ship(spark)
    pages = spark.read.parquet(path)
    rows = media.sequences(pages).collect()
    assert len(rows) == pages.count() and all([x.position for x in r["items"]] == list(range(len(r["items"]))) for r in rows) and sum(len(r["items"]) for r in rows) > len(rows)


def test_sequences_keep_order_and_captions(spark):
    ship(spark)
    a = "a" * 64
    page = f'<h1>T</h1><p>one <b>two</b></p><figure><img src="{media.SCHEME}{a}" alt="alt"><figcaption>Cap  tion</figcaption></figure><p>three</p><img src="http://x/y.png" alt="other"><video src="v.mp4"></video><img>tail<script>no</script>'
    items = media.sequence(page)
    assert [(x["position"], x["kind"], x["text"] or x["ref"], x["caption"]) for x in items] == [
        (0, "text", "T", None), (1, "text", "one two", None), (2, "image", media.SCHEME + a, "Cap tion"), (3, "text", "three", None), (4, "image", "http://x/y.png", "other"), (5, "video", "v.mp4", None), (6, "text", "tail", None),
    ]
    index = spark.createDataFrame([(a, 7)], "digest string, payload_bytes long")
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    got = media.resolve(media.sequences(pages), index).orderBy("position").collect()
    assert [(r.page_id, r.position, r.payload_bytes) for r in got] == [(1, k, 7 if k == 2 else None) for k in range(7)]


def test_frequent_digests_are_joined_by_broadcast(docs_of, monkeypatch):
    """Half of the texts are one text, some are null: with every digest frequent, with the usual bound and with none, the rows are the same."""
    rows = [(i, "the hot text\nof many" if i % 2 else None if i % 10 == 0 else f"text {i % 7}\nlast") for i in range(90)]
    docs = docs_of(rows)
    got = []
    for least in (0, 20, 10**9):
        monkeypatch.setattr(media, "FREQUENT_ROWS", least)
        got.append(sorted(map(tuple, media.text_media(docs).collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) == 90 and all(r[2] for r in got[0])
    store = media.store_texts(docs)
    monkeypatch.setattr(media, "FREQUENT_ROWS", 20)
    assert media.frequent(store.select("digest")).count() == 1


def test_items_without_a_payload_stay(spark):
    """Text items and references that the index does not know keep their place, with nulls."""
    pages = spark.createDataFrame([(1, f'<p>a</p><img src="{media.SCHEME}{"0" * 64}"><p>b</p><img src="http://x/y.png"><img src="{media.SCHEME}{"1" * 64}">')], "page_id long, html string")
    index = spark.createDataFrame([("0" * 64, 7)], "digest string, payload_bytes long")
    often = spark.createDataFrame([("0" * 64,)], "digest string")
    for o in (None, often, often.limit(0)):
        got = [(r.position, r.kind, r.payload_bytes) for r in media.resolve(media.sequences(pages), index, o).orderBy("position").collect()]
        assert got == [(0, "text", None), (1, "image", 7), (2, "text", None), (3, "image", None), (4, "image", None)]
