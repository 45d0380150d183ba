import re
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quarrygraph.llm import queries  # noqa: E402
from tests.llm.conftest import odd_rows  # noqa: E402

EN, FR = "the cat and the house of the street that we have seen once more", "le chat et la maison de la rue que nous avons vu une fois"


def rows():
    out = [(i, f"{FR if i % 3 == 0 else EN} number{i} {'x' * (i % 5)} item{i * 7} thing{i * 11} last{i}", "fr" if i % 3 == 0 else "en", "hot" if i % 2 else f"s{i % 4}", 0) for i in range(60)]
    out += [(100 + i, out[7][1], "en", "hot", 0) for i in range(5)]  # copies
    out += [(200, f'{EN} token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" and so on', "en", "s1", 0), (201, None, "en", "s1", 0), (202, "12 34", None, "s1", 0)]
    return out


def test_stages(spark, docs_of, tmp_path):
    docs = docs_of(rows())
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secret_scan", "mixing", "sentencepiece"]
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        kept[name] = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == columns
    ids = {n: Counter(r.doc_id for r in x) for n, x in kept.items()}
    assert set(ids["language_id"]) == {r[0] for r in rows()} - {201, 202}
    assert set(ids["near_dedup"]) == set(range(60)) | {200} and max(ids["near_dedup"].values()) == 1
    assert ids["secret_scan"] == ids["near_dedup"] and not any(re.search("[0-9a-f]{40}", r.text) for r in kept["secret_scan"])
    assert set(ids["mixing"]) == set(ids["near_dedup"]) and max(ids["mixing"].values()) == 2
    assert ids["sentencepiece"] == ids["mixing"]


def test_run(spark, docs_of, tmp_path):
    docs_of(rows()).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(range(60)) | {200} and all(len(r.ids_sha256) == 64 for r in got)


def test_odd_and_empty(spark, odd, docs_of, tmp_path):
    for name, docs in (("odd", odd), ("empty", docs_of([]))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            docs.write.parquet(str(tmp_path / f"{name}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{k}"))
        assert docs.count() == 0 if name == "empty" else docs.count() >= 5
    assert odd_rows()


def test_registered():
    assert [n for n in queries.QUERIES] == ["op1_secrets", "op2_htmlcut", "op3_chunkdedup", "op4_sentencepiece", "op5_media", "op6_langid", "op7_mixing", "op8_quality", "op9_neardup", "op10_licenses", "op11_urlmarkov", "op12_filteraudit", "op13_divergence"]
    import __spark_entry__ as e

    assert set(queries.QUERIES) | {"pipeline"} <= set(e.queries()) and set(queries.ORACLE_SQL) == {"op12_filteraudit", "op13_divergence"}
