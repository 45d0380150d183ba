import pytest

from quarrygraph.runtime import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) or whole rows, dealt to several partitions."""
    ship(spark)

    def make(rows, extra=""):
        full = [r if len(r) > 2 else (r[0], r[1], "en", f"s{(r[0] or 0) % 3}", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS + extra).repartition(3)

    return make


def odd_rows():
    """Rows that every operator has to take: nulls, blanks, a very long text, repeats, ties, a null id."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    return [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "same text here for two"), (6, "same text here for two"), (7, long), (7, long), (None, "no id at all"), (8, "é" * 50), (9, "a b c \x00 d")]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(odd_rows())


@pytest.fixture(scope="session")
def clashing(spark):
    """Extra columns named as the operators' own."""
    names = ["key", "rep", "h", "k", "block", "path", "epoch", "bucket", "score", "kept", "digest", "x", "n", "whole", "lang_pred", "n_words", "rank", "component_id", "slot", "at"]
    return spark.createDataFrame([(1, "some words stand here", "en", "a", 21, *["z"] * len(names)), (2, "other words stand there", "en", "b", 23, *["z"] * len(names))], DOCS + "".join(f", {n} string" for n in names))
