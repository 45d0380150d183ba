"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy.

Subwords are the 1- to 4-byte sequences of the lower-cased text in which a run of characters other than letters is one space. Since the
softmax is linear in the averaged embedding, embedding times weights is folded into one table of logits per bucket, which scores
whole texts. A temperature, fitted on training documents kept back, calibrates the probabilities; a text is rejected if
it has no letter, if its calibrated probability is below the threshold that the same documents give (with a cap, so that texts of several
learned languages stay), or if too many of its 4-byte subwords are in no training document: unlearned languages and junk, for which the softmax may be as peaked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrygraph.llm.common import SLICE_BYTES, crc32_mod5, parts

BUCKET_BITS, DIM, ORDERS = 16, 12, (1, 2, 3, 4)
#: Bound of the training sample: documents of each language, the first by a hash of the id; the number of languages learned at most; and characters of a document.
SAMPLE_PER_LANGUAGE, MOST_LANGUAGES, SAMPLE_CHARS = 400, 256, 20_000
#: Calibrated probability of a wrong rejection of a training document kept back.
WRONG_REJECTIONS = 0.0005
#: Subwords added to a text's when the share of unseen ones is taken, so that short texts are not judged by few; and the factor between the share
#: that WRONG_REJECTIONS of the training documents exceed, each against all others, and the share from which a text is rejected.
SHORT, UNSEEN_MARGIN = 40, 1.5
UNDETERMINED = "und"

_OTHER = re.compile(r"[\W\d_]+")


def normal(text: str | None) -> bytes:
    """Lower-cased letters (and the signs of numbers that aren't decimal digits), runs of all else as one space; empty without a letter, i.e. a character of category L."""
    if not text or not any(map(str.isalpha, text)):
        return b""
    return f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-8", "replace")


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of the texts one after another, and how many each text has."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    b = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    text_end = np.repeat(np.cumsum(lengths), lengths)
    where = np.arange(len(b))
    buckets, owners = [], []
    owner = np.repeat(np.arange(len(texts)), lengths)
    h = np.zeros(len(b), np.uint32)
    for n in ORDERS:
        # h covers n bytes: shifted so that position i has bytes i..i+n-1
        nxt = np.zeros(len(b), np.uint32)
        nxt[: len(b) - n + 1] = b[n - 1 :] if len(b) >= n else 0
        h = (h ^ (nxt + np.uint32(1))) * np.uint32(0x9E3779B1) + np.uint32(n)
        fits = where + n <= text_end
        x = h[fits]
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA77)
        buckets.append(x >> np.uint32(32 - BUCKET_BITS))
        owners.append(owner[fits])
    flat, own = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return flat[order], np.bincount(own, minlength=len(texts))


def quads(text: bytes) -> np.ndarray:
    """Hashes of the 4-byte subwords of a text, as Model.scan has them."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    size = max(0, len(b) - ORDERS[-1] + 1)
    h = np.zeros(size, np.uint32)
    for n in ORDERS:
        h = (h ^ (b[n - 1 : n - 1 + size] + np.uint32(1))) * np.uint32(0x9E3779B1) + np.uint32(n)
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)


def novelty(texts: list[bytes]) -> tuple[np.ndarray, float]:
    """Table of the 4-byte subwords of training texts, eight places or more for each up to 2**26, and the share of unseen ones from which a text is rejected."""
    each = [np.unique(quads(t)) for t in texts if t]
    if not each:
        return np.ones(2, bool), 1.0
    known, times = np.unique(np.concatenate(each), return_counts=True)
    bits = int(np.clip(np.ceil(np.log2(8 * len(known) + 1)), 16, 26))
    seen = np.zeros(1 << bits, bool)
    seen[known >> np.uint32(32 - bits)] = True
    # against all others, a document's unseen subwords are those that no other has
    shares = [(times[np.searchsorted(known, q)] == 1).sum() / (len(q) + SHORT) for q in map(quads, texts) if len(q)]
    if not shares:
        return seen, 1.0
    return seen, float(UNSEEN_MARGIN * np.quantile(shares, 1 - WRONG_REJECTIONS))


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # buckets x languages: embeddings times weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    seen: np.ndarray = field(default_factory=lambda: np.ones(2, bool))  # 4-byte subwords of the training documents, by the upper bits of their hash
    most_unseen: float = 1.0

    def raw(self, texts: list[bytes]) -> np.ndarray:
        """Logits of each text (zeros without subwords)."""
        return self.scan(texts)[0]

    def scan(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each text (zeros without subwords), and the share of its 4-byte subwords that no training document has, SHORT more of them counted as seen."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        out, unseen = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        some = np.flatnonzero(lengths)
        if not len(some):
            return out, unseen
        b = np.frombuffer(b"".join([texts[i] for i in some]), np.uint8).astype(np.uint32)
        end = np.cumsum(lengths[some])
        start = end - lengths[some]
        text_end = np.repeat(end, lengths[some])
        where = np.arange(len(b))
        total = np.zeros((len(some), len(self.languages)))
        h = np.zeros(len(b), np.uint32)
        for n in ORDERS:
            nxt = np.zeros(len(b), np.uint32)
            nxt[: len(b) - n + 1] = b[n - 1 :] if len(b) >= n else 0
            h = (h ^ (nxt + np.uint32(1))) * np.uint32(0x9E3779B1) + np.uint32(n)
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
            got = self.logits[x >> np.uint32(32 - BUCKET_BITS)]
            got[where + n > text_end] = 0
            total += np.add.reduceat(got, start, axis=0, dtype=np.float64)
        new = ~self.seen[x >> np.uint32(33 - len(self.seen).bit_length())]
        new[where + n > text_end] = False
        unseen[some] = np.add.reduceat(new, start, dtype=np.int64) / (np.maximum(0, lengths[some] - n + 1) + SHORT)
        size = sum(np.maximum(0, lengths[some] - n + 1) for n in ORDERS)
        out[some] = total / size[:, None] + self.bias
        return out, unseen

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated probability, rejected."""
        plain = [normal(t) for t in texts]
        out, unseen = np.zeros((len(plain), len(self.languages))), np.zeros(len(plain))
        i = 0
        while i < len(plain):
            j, size = i, 0
            while j < len(plain) and (j == i or (size + len(plain[j])) * len(self.languages) <= 4 * SLICE_BYTES):
                size += len(plain[j])
                j += 1
            out[i:j], unseen[i:j] = self.scan(plain[i:j])
            i = j
        p = softmax(out / self.temperature)
        best = p.argmax(1)
        score = p[np.arange(len(p)), best]
        some = np.array([bool(x) for x in plain], bool)
        score = np.where(some, score, 0.0)
        return [self.languages[k] if s else UNDETERMINED for k, s in zip(best, some, strict=True)], score, ~some | (score < self.threshold) | (unseen > self.most_unseen)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def pieces(texts: list[str], langs: list[int], rng: np.random.Generator, each: int) -> tuple[list[bytes], np.ndarray]:
    """Passages of 2 to 60 words from each text, so that short texts are learned too."""
    out, y = [], []
    for text, lang in zip(texts, langs, strict=True):
        words = text.split()
        for n in np.exp(rng.uniform(np.log(2), np.log(60), each)).astype(int):
            at = rng.integers(0, max(1, len(words) - n + 1))
            if x := normal(" ".join(words[at : at + n])):
                out.append(x)
                y.append(lang)
    return out, np.array(y, np.int64)


def fit(texts: list[str], langs: list[str], epochs: int = 6, rate: float = 4.0, seed: int = 5) -> Model:
    """A model of labelled texts (a bounded sample). A sixth of the texts is kept back for temperature and threshold. Without texts, a model that rejects all."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    if not names:
        return Model([UNDETERMINED], np.zeros((1 << BUCKET_BITS, 1), np.float32), np.zeros(1), 1.0, 2.0)
    order = rng.permutation(len(texts))
    kept = order[: len(texts) // 6]
    used = order[len(texts) // 6 :]
    code = {x: i for i, x in enumerate(names)}
    x, y = pieces([texts[i] for i in used], [code[langs[i]] for i in used], rng, 5)
    flat, size = subwords(x)
    end = np.cumsum(size)
    start = end - size
    embed = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    weight, bias = rng.normal(0, 0.3, (DIM, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    share = np.bincount(y, minlength=len(names)) / max(1, len(y))
    steps, step, batch = epochs * (len(x) // 32 + 1), 0, 32
    for _ in range(epochs):
        perm = rng.permutation(len(x))
        for i in range(0, len(perm), batch):
            k = perm[i : i + batch]
            idx = np.concatenate([flat[start[j] : end[j]] for j in k])
            n = size[k]
            at = np.cumsum(n) - n
            hidden = np.add.reduceat(embed[idx], at, axis=0) / n[:, None]
            g = softmax(hidden @ weight + bias)
            g[np.arange(len(k)), y[k]] -= 1
            g /= (share[y[k]] * len(names))[:, None]  # every language weighs the same
            lr = rate * (1 - step / steps)
            back = (g @ weight.T) / n[:, None]
            weight -= (lr / len(k) * (hidden.T @ g)).astype(np.float32)
            bias -= (lr / len(k) * g.sum(0) * 0.1).astype(np.float32)
            np.add.at(embed, idx, np.repeat((-lr * back).astype(np.float32), n, axis=0))
            step += 1
    model = Model(names, (embed @ weight).astype(np.float32), bias.astype(np.float64))
    model.seen, model.most_unseen = novelty([normal(t) for t in texts])
    vx, vy = pieces([texts[i] for i in kept], [code[langs[i]] for i in kept], rng, 5)
    if len(vx):
        raw = model.raw(vx)
        loss = {t: -np.log(softmax(raw / t)[np.arange(len(vy)), vy] + 1e-12).mean() for t in np.geomspace(0.05, 20, 60)}
        model.temperature = float(min(loss, key=loss.get))
        whole = [normal(texts[i]) for i in kept]
        p = softmax(model.raw(whole) / model.temperature).max(1)[[bool(w) for w in whole]]
        # no higher than one and a half times what an even guess between all languages has
        model.threshold = float(min(1.5 / len(names), np.quantile(p, WRONG_REJECTIONS) * 0.9)) if len(p) else 0.0
    return model


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on at most per_language documents of each of the MOST_LANGUAGES most frequent languages, the first by a hash of their ids, of those with text and lang whose
    crc32(id) mod 5 isn't 0. Of a longer text, SAMPLE_CHARS characters from a hashed place are taken. Rows that share an id, lang and text count once.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    spot = F.shiftrightunsigned(F.xxhash64(F.lit(17).cast("long"), "doc_id"), 11) * F.lit(2.0**-53)
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc32_mod5(F.col("doc_id")) != 0)).withColumn("spot", spot)
    size = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not size:
        return fit([], [])
    # A document's place in the order of hashes is uniform: a share of it holds enough of a language's documents. No task gets all of a language's rows.
    share, slack = {}, 2.0
    missing = set(size)
    while missing:
        share |= {x: min(1.0, slack * per_language / size[x]) for x in missing}
        within = usable.filter(F.col("spot") < _by_language(share))
        found = {r["lang"]: r["n"] for r in within.groupBy("lang").agg(F.count_distinct("doc_id").alias("n")).collect()}
        missing = {x for x in missing if share[x] < 1 and found.get(x, 0) < per_language}
        slack *= 4
    order = Window.partitionBy("lang").orderBy("spot", "doc_id")
    ranked = within.select("lang", "spot", "doc_id").distinct().withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_language)
    last = {r["lang"]: r["spot"] for r in ranked.groupBy("lang").agg(F.max("spot").alias("spot")).collect()}
    start = F.pmod(F.xxhash64(F.lit(18).cast("long"), "doc_id"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS)).cast("int")
    passage = F.when(F.length("text") > SAMPLE_CHARS, F.substring(F.col("text"), start + 1, F.lit(SAMPLE_CHARS))).otherwise(F.col("text"))
    chosen = usable.filter(F.col("spot") <= _by_language(last)).select("doc_id", "lang", passage.alias("text")).distinct()
    # ids that many texts share must not make the sample larger
    rows = chosen.orderBy(F.xxhash64(F.lit(17).cast("long"), "doc_id"), "doc_id", "lang", "text").limit(2 * per_language * len(last)).collect()
    rows.sort(key=lambda r: (r.doc_id, r.lang, r.text))
    return fit([r.text for r in rows], [r.lang for r in rows])


def _by_language(values: dict[str, float]) -> F.Column:
    """The value of the row's language; null for others."""
    return F.create_map(*(F.lit(x) for pair in sorted(values.items()) for x in pair))[F.col("lang")]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Every column of docs, then lang_pred, lang_score (0 to 1) and lang_rejected, in place of columns so named before. Null text or no letter: 'und', 0, rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    fresh = ["lang_pred", "lang_score", "lang_rejected"]
    docs = docs.drop(*fresh)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            lang, score, rejected = held.value.predict(b.column(at).to_pylist())
            yield pa.record_batch([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*names, *fresh])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(fresh, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: one row for each row of docs.

    Learned on docs itself (see train). lang, source and doc_id are no inputs of a prediction. Null text, or text without a letter: 'und', score 0.
    A null doc_id is held out. An empty table gives no rows, repeated rows equal rows; other columns are not read.
    """
    model = train(docs)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = predict(plain, model)
    held = F.coalesce(crc32_mod5(F.col("doc_id")) == 0, F.lit(True))
    return ids.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose language the model does not reject; a null lang becomes the predicted language.

    text and lang are needed; clashing extra columns are kept as they are. Null text, or text without a letter, is rejected. Repeated rows stay or go together;
    an empty table, or one without a labelled document, gives none.
    """
    model = train(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at, lang_at = names.index("text"), names.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            lang, _, rejected = held.value.predict(b.column(at).to_pylist())
            known = b.column(lang_at)
            if known.null_count and pa.types.is_string(known.type):
                b = b.set_column(lang_at, b.schema.field(lang_at), pc.coalesce(known, pa.array(lang, known.type)))
            yield b.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)
