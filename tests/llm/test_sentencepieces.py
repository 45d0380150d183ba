import hashlib
import random

import pyarrow as pa
import pytest

from quarrygraph.llm import queries, sentencepieces
from tests.llm.conftest import odd_rows

sentencepiece = pytest.importorskip("sentencepiece")
FILE = queries.tokenizer_file()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


def expected(library, text):
    ids = library.encode(text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_random_texts(library):
    s, rng = sentencepieces.Segmenter(FILE), random.Random(3)
    letters = " ▁  ab\n\t\x00é①ﬁ😀<s>　中the "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(4000)]
    assert s.digests(pa.array(texts)) == [expected(library, t) for t in texts]
    assert all(s.encode(t) == library.encode(t) for t in texts[:500])


def test_each_distinct_word_is_segmented_once(library):
    s = sentencepieces.Segmenter(FILE)
    found = s.segmented(pa.array(["some words and some more words", "", "more  words", " "] * 30))
    assert sorted(found.words) == sorted([" some", " words", " and", " more", "  words", "  "]) and found.counts.tolist() == [6, 0, 2, 1] * 30
    assert len(found.place) == 30 * 9


@pytest.mark.parametrize("most", [1, 50])
def test_slices(monkeypatch, library, docs_of, most):
    monkeypatch.setattr(sentencepieces, "TABLE_BYTES", most)
    texts = ["some words", None, "", "and some more words " * 9, "é", "a"]
    assert [x for part in sentencepieces.slices(pa.array(texts)) for x in part.to_pylist()] == [t or "" for t in texts]
    batches = [pa.record_batch([pa.array([t], pa.string())], ["text"]) for t in texts]
    assert [x for b in sentencepieces.together(iter(batches)) for x in b.column(0).to_pylist()] == texts
    assert not list(sentencepieces.slices(pa.array([], pa.string())))


def test_operators(odd, docs_of, clashing, library):
    texts = dict(odd_rows())
    got = sentencepieces.round_trip(odd, FILE).collect()
    assert len(got) == odd.count()
    for r in got:
        ids = library.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    back = {r.doc_id: r.text for r in sentencepieces.decode(sentencepieces.encode(odd, FILE), FILE).collect()}
    assert back[5] == texts[5] and back[1] == "" and back[7] == texts[7]
    assert sentencepieces.round_trip(docs_of([]), FILE).count() == 0 and sentencepieces.round_trip(clashing, FILE).count() == 2
