"""Media columns: interleaved document sequences.

HTML is parsed into an ordered sequence of text and media-reference structs. Media live in a store keyed by the SHA-256 of their payload; references
carry that digest, and a join on it resolves them, with positions and captions kept. Payloads are stored as 8-bit greyscale PNG images, 192
samples a row, and read back from the stored bytes.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrygraph.llm.common import parts, stored

ROW = 192
#: Digests that a task remembers, so as not to store a payload again.
REMEMBERED = 100_000
SCHEME = "media:sha256/"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
SEQUENCE = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A payload of whole rows as an 8-bit greyscale image."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = rows
    return _SIGNATURE + _part(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + _part(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _part(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image that to_png made; checks every part's CRC."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, size = 8, [], None
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError("damaged PNG image")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("another kind of PNG image")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("a line is filtered")
    return lines[:, 1:].tobytes()


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with spaces up to a positive multiple of ROW, and the length without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw)), len(raw)


def feature_of(payload: bytes) -> str:
    """Rows, mean, entropy in bits, and a 64-bit difference hash over 64 parts of the samples."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    edge = np.linspace(0, len(x), 66).astype(np.int64)[:-1]
    means = np.add.reduceat(x.astype(np.int64), edge) / np.diff(np.append(edge, len(x)))
    bits = int("".join("1" if b > a else "0" for a, b in zip(means, means[1:], strict=False)), 2)
    return f"{len(x) // ROW};{x.mean():.4f};{entropy:.4f};{bits:016x}"


# ---- sequences


class _Sequence(HTMLParser):
    """Text and media references in page order. A figure's caption belongs to its references; without one, the alternative text does."""

    MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "source", "embed": "embed"}
    BREAK = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 table tr td th figure figcaption section article header footer nav aside blockquote pre body html hr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.skip = 0
        self.figures: list[tuple[list[int], list[str]]] = []  # places of the open figures' references, and their captions
        self.caption: list[str] | None = None

    def end_text(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "title"):
            self.skip += 1
        if tag in self.BREAK or tag in self.MEDIA:
            self.end_text()
        if tag == "figure":
            self.figures.append(([], []))
        elif tag == "figcaption" and self.figures:
            self.end_caption()
            self.caption = []
        elif tag in self.MEDIA:
            a = dict(attrs)
            if a.get("src"):
                if self.figures:
                    self.figures[-1][0].append(len(self.items))
                self.items.append({"kind": self.MEDIA[tag], "text": None, "ref": a["src"], "caption": a.get("alt") or None})

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "title"):
            self.skip = max(0, self.skip - 1)
        if tag in self.BREAK:
            self.end_text()
        if tag == "figcaption":
            self.end_caption()
        elif tag == "figure" and self.figures:
            self.end_figure()

    def end_caption(self) -> None:
        if self.caption is not None:
            caption = " ".join("".join(self.caption).split())
            if caption:
                self.figures[-1][1].append(caption)
            self.caption = None

    def end_figure(self) -> None:
        """A caption stands before or after its pictures, so it is handed out here. Without a picture it is text."""
        self.end_caption()
        places, captions = self.figures.pop()
        for k in places:
            self.items[k]["caption"] = " ".join(captions) or self.items[k]["caption"]
        if captions and not places:
            self.items.append({"kind": "text", "text": " ".join(captions), "ref": None, "caption": None})

    def end(self) -> list[dict]:
        self.close()
        while self.figures:
            self.end_figure()
        self.end_text()
        return self.items

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        (self.text if self.caption is None else self.caption).append(data)


def sequence(page: str | None) -> list[dict]:
    p = _Sequence()
    p.feed(page or "")
    return [{"position": i, **x} for i, x in enumerate(p.end())]


def sequences(pages: DataFrame, keys: tuple[str, ...] = ("page_id",), column: str = "html") -> DataFrame:
    """The key columns and items: each page's ordered text and media references. Null or empty html: no items."""
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            yield pa.record_batch([*b.columns[1:], pa.array([sequence(x) for x in b.column(0).to_pylist()], kind)], [*keys, "items"])

    plain = pages.select(F.col(column).cast("string").alias(column), *keys)
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields[1:], T.StructField("items", T._parse_datatype_string(SEQUENCE))]))


#: A digest is frequent from so many rows on, and from this share of all rows: at most MOST_FREQUENT digests are.
FREQUENT_ROWS, MOST_FREQUENT = 1000, 10_000


def frequent(digests: DataFrame) -> DataFrame:
    """digest of those that very many rows (digest) have, such as that of a third of all texts; MOST_FREQUENT at most."""
    least = max(FREQUENT_ROWS, digests.count() // MOST_FREQUENT)
    return digests.groupBy("digest").agg(F.count("*").alias("n")).filter((F.col("n") > least) & F.col("digest").isNotNull()).select("digest")


def resolve(seqs: DataFrame, index: DataFrame, often: DataFrame | None = None) -> DataFrame:
    """One row for each item of each sequence: the key columns, position, kind, text, ref, caption, and the index's columns where ref's digest is known (else null).

    index: digest and what is known of each payload, one row for each digest. The join is on the digest alone; payloads don't move. often (see frequent): digests whose few
    index rows are broadcast, so that no task gets all their rows; items without a known digest and those are dealt by their own place.
    """
    keys = [c for c in seqs.columns if c != "items"]
    known = [c for c in index.columns if c != "digest"]
    items = seqs.select(*keys, F.explode("items").alias("i")).select(*keys, "i.*")
    digest = F.when(F.col("ref").startswith(SCHEME), F.substring("ref", len(SCHEME) + 1, 64))
    items = items.withColumn("digest", digest)
    if often is None:
        hot = F.lit(None)
    else:
        few = index.join(F.broadcast(often), "digest", "left_semi").select("digest", F.struct(*known).alias("hot"))
        items, hot = items.join(F.broadcast(few), "digest", "left"), F.col("hot")
    # nothing in the index begins with a dash
    place = F.concat(F.lit("-"), F.xxhash64(*keys, "position", "ref").cast("string"))
    dealt = items.withColumn("at", F.when(hot.isNull() & F.col("digest").isNotNull(), F.col("digest")).otherwise(place))
    joined = dealt.join(index.select(F.col("digest").alias("at"), F.struct(*known).alias("cold")), "at", "left")
    found = F.coalesce(F.col("hot"), F.col("cold")) if often is not None else F.col("cold")
    return joined.select(*keys, "position", "kind", "text", "ref", "caption", *(found[c].alias(c) for c in known))


# ---- store


def page_of(doc_id: int | None, text: str | None, digest: str, n_bytes: int) -> str:
    """An interleaved page: the first line of a text, its picture with a caption, and the last line if there are several."""
    lines = (text or "").split("\n")
    tail = f"<p>{html.escape(lines[-1])}</p>" if len(lines) > 1 else ""
    return f'<p>{html.escape(lines[0])}</p><figure><figcaption>{doc_id}: {n_bytes} bytes</figcaption><img src="{SCHEME}{digest}"></figure>{tail}'


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, html, digest, media: each text's payload as an image in a written table, and a page that refers to it between the text's first line and its last. A task
    stores equal payloads once (else media is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for part in parts(batches):
            n_bytes, pages, digests, media = [], [], [], []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                payload, n = payload_of(text)
                digest = hashlib.sha256(payload).hexdigest()
                n_bytes.append(n)
                digests.append(digest)
                pages.append(page_of(doc_id, text, digest, n))
                media.append(None if digest in seen else to_png(payload))
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(digest)
            yield pa.record_batch([part.column(0), pa.array(n_bytes, pa.int64()), pa.array(pages, pa.string()), pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "html", "digest", "media"])

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, html string, digest string, media binary"), "media")


def index_store(store: DataFrame) -> DataFrame:
    """What the stored bytes read back as, one row for each digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            rows = []
            for digest, image in zip(b.column(0), b.column(1), strict=True):
                image = image.as_py()
                payload = from_png(image)
                rows.append((digest.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature_of(payload)))
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names)

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    read = store.filter("media is not null").select("digest", "media").mapInArrow(run, schema)
    # equal digests have equal rows: any of them will do
    rest = [c for c in read.columns if c != "digest"]
    return read.groupBy("digest").agg(F.min(F.struct(*rest)).alias("x")).select("digest", "x.*")


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, position, caption, n_items: one row for each row of docs; the last three are
    the picture's place in its page, its caption, and the items of the page.

    Null text counts as empty: its payload is ROW spaces. Equal texts give equal values; repeated rows give equal rows, a null doc_id stays null,
    an empty table gives none; other columns are not read.
    """
    store = store_texts(docs)
    index = stored(index_store(store), "index")
    seqs = sequences(store.select("doc_id", "n_bytes", "html"), ("doc_id", "n_bytes")).withColumn("n_items", F.size("items"))
    found = resolve(seqs, index, frequent(store.select("digest"))).filter("kind = 'image'")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_items")
