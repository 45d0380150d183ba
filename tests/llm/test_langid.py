import os
import zlib

import pytest

from quarrygraph.llm import langid

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_held_out_accuracy(spark, docs_of):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.identify(docs).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got) and 100 < len(held) < 300
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) / len(got) < 0.01  # clean documents stay


def small():
    fr, en = "le chat et la maison de la rue que nous avons", "the cat and the house of the street that we have"
    return [(i, (fr if i % 2 else en) + f" {'ou' if i % 2 else 'or'} " * (i % 7), "fr" if i % 2 else "en", "s", 0) for i in range(80)]


def test_odd_rows(docs_of, odd):
    rows = small() + [(100, None, "en", "s", 0), (101, "", None, "s", 0), (102, "12 34 !!", None, "s", 0), (103, "le " * 100_000, None, "s", 0), (None, "the house", "en", "s", 0), (104, "日本語", None, None, None)]
    got = {r.doc_id: r for r in langid.identify(docs_of(rows)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (100, 101, 102))
    assert got[103].lang_pred == "fr" and got[None].lang_pred == "en" and got[None].held_out and got[104].lang_pred in ("en", "fr")
    kept = {r.doc_id for r in langid.keep_identified(docs_of(rows)).collect()}
    assert kept.isdisjoint({100, 101, 102}) and set(range(80)) <= kept


def test_nothing_to_learn_from(docs_of, clashing):
    assert langid.identify(docs_of([])).count() == 0
    assert {r.lang_pred for r in langid.identify(docs_of([(1, "text", None, "s", 4)])).collect()} == {"und"}
    assert langid.keep_identified(clashing).columns == clashing.columns and langid.identify(clashing).count() == 2


def test_inputs_are_the_text_alone(docs_of):
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs_of(small()), langid.train(docs_of(small()))).select("doc_id", "lang_pred", langid.F.col("lang_score").alias("score")).collect()}
    other = [(i, t, None, "x", 1) for i, t, *_ in small()]
    b = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.predict(docs_of(other), langid.train(docs_of(small()))).collect()}
    assert a == b


def test_one_document_scores_alone_as_in_a_batch():
    m = langid.fit([t for _, t, *_ in small()], [x[2] for x in small()])
    texts = [t for _, t, *_ in small()][:9] + ["", None, "le"]
    together = m.predict(texts)[1]
    assert all(abs(m.predict([t])[1][0] - s) < 1e-9 for t, s in zip(texts, together, strict=True))


JUNK = ["xkqjzvwpgt" * 6, "asdf jkl qwer zxcv", "bcdfgh qrstvw zxkljp mnbvcx qwrtpl", "привет как дела сегодня хорошо", "日本語の文章です。これは試験です", "tämä on suomenkielinen lause jota malli ei ole nähnyt aikaisemmin"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("left_out", ["fr", "es", "en"])
def test_unlearned_languages_and_junk_go_and_mixed_texts_stay(spark, left_out):
    rows = sorted((r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect())
    learned = [r for r in rows if r[2] != left_out]
    m = langid.fit([t for i, t, _ in learned if i % 5], [x for i, _, x in learned if i % 5])
    foreign = m.predict([t for _, t, x in rows if x == left_out])[2]
    assert foreign.mean() > 0.9 and m.predict(JUNK)[2].all()
    held = [t for i, t, _ in learned if i % 5 == 0]
    mixed = [f"{a[:700]} {b[:700]}" for a, b in zip(held, held[7:], strict=False)]
    assert m.predict(held)[2].mean() < 0.01 and m.predict(mixed)[2].mean() < 0.01


def test_unseen_subwords_are_counted_alike():
    texts = [langid.normal(t) for _, t, *_ in small()]
    m = langid.fit([t for _, t, *_ in small()], [x[2] for x in small()])
    one = langid.normal("the cat zzzz und der Hund of the street")
    known = set(langid.np.concatenate([langid.quads(t) for t in texts]).tolist())
    q = langid.quads(one)
    assert abs(m.scan([texts[0], b"", one])[1][2] - sum(int(x) not in known for x in q) / (len(q) + langid.SHORT)) < 0.03
    assert list(m.scan([texts[0], b""])[1]) == [0, 0]


def test_letters_are_of_category_l():
    assert langid.normal("² ½ ④ 12 ٣ _ !") == b"" and langid.normal("a²") and langid.normal("ª") and langid.normal("日")


def test_the_sample_is_the_first_of_each_language_by_hash(docs_of, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "fit", lambda texts, langs: seen.append((texts, langs)))
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 30)
    rows = [(i, f"text of {i} " * (9 if i % 10 == 0 else 1), ["en", "fr", "de"][i % 3] if i % 50 else None, "s", 0) for i in range(600)] + [(7, "again", "fr", "s", 0), (7, "text of 7 ", "fr", "s", 0)]
    langid.train(docs_of(rows), 20)
    langid.train(docs_of(rows).repartition(1), 20)
    assert seen[0] == seen[1] and all(len(t) <= 30 for t in seen[0][0])
    from pyspark.sql import functions as F

    frame = docs_of(rows).filter("lang is not null").filter(langid.crc32_mod5(F.col("doc_id")) != 0).select("doc_id", "lang", F.shiftrightunsigned(F.xxhash64(F.lit(17).cast("long"), "doc_id"), 11).alias("h")).distinct().collect()
    for lang in ("en", "fr", "de"):
        first = sorted((r.h, r.doc_id) for r in frame if r.lang == lang)[:20]
        texts = [t for t, x in zip(*seen[0], strict=True) if x == lang]
        assert all(any(t in f"text of {i} " * 9 or i == 7 for _, i in first) for t in texts) and len(texts) in (20, 21)


def test_unknown_languages_are_filled_in(docs_of):
    rows = small() + [(200, "the cat and the street of the house that we have", None, "s", 0), (201, "la rue et le chat de la maison que nous avons", "xx", "s", 0)]
    got = {r.doc_id: r.lang for r in langid.keep_identified(docs_of(rows)).collect()}
    assert got[200] == "en" and got[201] == "xx" and got[0] == "en" and got[1] == "fr"


def test_a_score_at_the_threshold_stays():
    m = langid.fit([t for _, t, *_ in small()], [x[2] for x in small()])
    text = small()[3][1]
    m.threshold = float(m.predict([text])[1][0])
    assert not m.predict([text])[2][0]
