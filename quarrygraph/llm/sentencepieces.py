"""SentencePiece encoding and decoding with a table of distinct marked words.

No piece of the model has a whitespace marker after another character, so no merge crosses the place where a marker follows
another character. Texts are cut at those places. Of each slice of texts the distinct marked words become a table, whose words are each segmented once;
ids are joined back by position. The model's normaliser must be the identity; both facts are checked on loading.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Bytes of the texts that one table is made of; a longer text makes a slice of its own.
TABLE_BYTES = 3 << 20


@dataclass
class Segmented:
    """A slice of texts: its distinct marked words with their ids, and which of them stand where."""

    words: list[str]  # distinct marked words: runs of spaces (each stands for a marker) with what follows
    ids: list[list[int]]
    place: np.ndarray  # word of each position, in the order of the texts
    counts: np.ndarray  # positions of each text

    def __post_init__(self) -> None:
        self.at = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.counts)])

    def sizes(self) -> np.ndarray:
        """Number of ids of each text."""
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, self.ids), np.int64, len(self.ids))[self.place])])
        return total[self.at[1:]] - total[self.at[:-1]]

    def flat(self) -> np.ndarray:
        """The ids of all texts, one after another."""
        size = np.fromiter(map(len, self.ids), np.int64, len(self.ids))
        all_ids = np.fromiter((i for x in self.ids for i in x), np.int32, int(size.sum()))
        first, n = (np.cumsum(size) - size)[self.place], size[self.place]
        return all_ids[np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)]

    def joined(self, of_word: list[str]) -> list[bytes]:
        """For each text, what its words stand for, one after another, in UTF-8."""
        each = pa.array(of_word, pa.large_string()).take(pa.array(self.place))
        _, where, data = each.buffers()
        at = np.frombuffer(where, np.int64)[: len(each) + 1][self.at].tolist() if len(each) else [0] * len(self.at)
        data = memoryview(data) if data is not None else memoryview(b"")
        return [bytes(data[i:j]) for i, j in zip(at, at[1:], strict=False)]


class Segmenter:
    """Encodes and decodes whole texts exactly as the library does, without begin or end ids."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece of this model crosses a whitespace marker")
        if self.lib.normalize("①  a ") != f"{MARK}①{MARK}{MARK}a{MARK}":
            raise ValueError("this model's normaliser changes texts")
        self.mark_id = self.lib.piece_to_id(MARK)
        self.decimal = [str(i) for i in range(len(pieces))]

    def segmented(self, texts: pa.Array) -> Segmented:
        """The table of the distinct marked words of texts (strings without nulls), each segmented once, and the positions."""
        texts = texts.cast(pa.large_string())
        plain = pc.replace_substring(texts, MARK, " ")
        # the library puts a marker before a text; an empty text has no ids
        plain = pc.if_else(pc.equal(plain, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), plain, pa.scalar("", pa.large_string())))
        _, where, data = plain.buffers()
        at = np.frombuffer(where, np.int64)[plain.offset : plain.offset + len(plain) + 1]
        b = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        at = at - at[0]
        if not len(b):
            return Segmented([], [], np.zeros(0, np.int64), np.zeros(len(texts), np.int64))
        first = b == 32
        first[1:] &= b[:-1] != 32
        first[at[:-1][at[1:] > at[:-1]]] = True
        start = np.flatnonzero(first)
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(b)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(b))).dictionary_encode()
        table = words.dictionary.to_pylist()
        ids = [x or [self.mark_id] for x in self.lib.encode([w[1:] for w in table])]
        return Segmented(table, ids, words.indices.to_numpy().astype(np.int64), np.searchsorted(start, at[1:]) - np.searchsorted(start, at[:-1]))

    def encode(self, text: str) -> list[int]:
        return self.segmented(pa.array([text])).flat().tolist()

    def digests(self, texts: pa.Array) -> list[tuple[int, str, str]]:
        """Of each text: number of ids, digest of the ids as decimals joined by commas, digest of the text that they decode to."""
        s = self.segmented(texts)
        ids = s.joined([",".join([self.decimal[i] for i in x]) + "," for x in s.ids])
        decoded = s.joined([" " + x for x in self.lib.decode(s.ids)] if s.ids else [])
        return [(n, hashlib.sha256(a[:-1]).hexdigest(), hashlib.sha256(d[1:]).hexdigest()) for n, a, d in zip(s.sizes().tolist(), ids, decoded, strict=True)]


def slices(column: pa.Array) -> Iterator[pa.Array]:
    """A column of texts in slices of about TABLE_BYTES; null is empty."""
    column = column.fill_null("") if column.null_count else column
    size = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + TABLE_BYTES, "right")))
        yield column.slice(i, j - i)
        i = j


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches joined to ones of about TABLE_BYTES, so that a table serves as many texts as memory allows."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= TABLE_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


_loaded: dict[str, Segmenter] = {}


def segmenter(model_file: str) -> Segmenter:
    if model_file not in _loaded:
        _loaded[model_file] = Segmenter(model_file)
    return _loaded[model_file]


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id and the whole text's ids as array<int>. Null and empty texts: no ids. Repeated rows stay; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = segmenter(model_file)
        for b in together(batches):
            at = 0
            for texts in slices(b.column(1)):
                found = s.segmented(texts)
                size = np.concatenate([np.zeros(1, np.int32), np.cumsum(found.sizes())]).astype(np.int32)
                yield pa.record_batch([b.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(size), pa.array(found.flat()))], ["doc_id", "ids"])
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id and the text that the library decodes its ids to. Null ids: empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = segmenter(model_file)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([s.lib.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row's whole text; one row for each row of docs.

    Null text counts as empty (no ids, the digests of the empty string), an empty table gives no rows, a null doc_id stays null,
    repeated rows give equal rows, columns other than doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = segmenter(model_file)
        for b in together(batches):
            rows = [x for texts in slices(b.column(1)) for x in s.digests(texts)]
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
