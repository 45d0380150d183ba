import random
import re
import time

import pytest

from quarrygraph.llm import licenses
from tests.llm.conftest import odd_rows


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = sorted((i, label) for i in range(len(w)) for p, label in licenses.BASE_PHRASES.items() if w[i : i + len(p.split())] == p.split())
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


@pytest.mark.parametrize(
    ("expression", "expected"),
    [("MIT", (["mit"], True)), ("GPL-3.0-only OR MIT", (["gpl", "mit"], True)), ("GPL-3.0 AND MIT", (["gpl", "mit"], False)), ("(MIT OR GPL-2.0) AND Apache-2.0", (["apache", "gpl", "mit"], True)), ("GPL-2.0-or-later WITH Classpath-exception-2.0", (["gpl"], False)),
     ("mit or gpl-2.0 and apache-2.0", (["apache", "gpl", "mit"], True)), ("LGPL-2.1+ OR BSD-3-Clause", (["bsd", "lgpl"], True)), ("MIT this is prose", (["mit"], True)), ("MIT AND", None), ("(MIT", None), ("", None), ("MIT)", None), ("AND MIT", None), ("LicenseRef-own", ([], False))],
)
def test_expressions(expression, expected):
    assert licenses.evaluate(expression) == expected


def test_postfix():
    assert licenses.postfix("A or B and C with D") == ["A", "B", "C", "D", "with", "and", "or"]
    assert licenses.postfix("(A or B) and C") == ["A", "B", "or", "C", "and"]


def test_against_brute_force(docs_of, odd):
    rng = random.Random(8)
    bits = ["MIT", "License", "license,", "apache", "Apache-License", "general", "public", "Lesser General Public License", "\n", "é", "x.y", "İ", "_", "--", "mit license mit license", "MİT", "license"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(30)))) for i in range(400)] + [(900 + (i or 0), t) for i, t in odd_rows()]
    for r, text in zip(sorted(licenses.scan(docs_of(rows)).collect(), key=lambda r: (r.doc_id, r.n_words)), [t for _, t in sorted(rows, key=lambda x: (x[0], brute(x[1])[0]))], strict=True):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scan(docs_of([])).count() == 0


def test_tags(docs_of, clashing):
    text = "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND ISC\ncode\n// spdx-license-identifier: GPL-2.0 WITH foo"
    r = licenses.scan(docs_of([(1, text), (2, "Licensed under CC BY-NC 4.0.")])).orderBy("doc_id").collect()
    assert r[0].labels == "apache,gpl,isc,mit" and not r[0].permissive and r[0].n_base == 0 and "cc-by-nc" in r[1].labels
    assert licenses.scan(clashing).count() == 2


@pytest.mark.parametrize(
    ("identifier", "label"),
    [("MPL-2.0", "mpl"), ("CC-BY-SA-4.0", "cc-by-sa"), ("BSD-2-Clause-Patent", "bsd"), ("0BSD", "bsd"), ("EUPL-1.2", "eupl"), ("AGPL-3.0-or-later", "agpl"), ("Zlib", "zlib"), ("CC0-1.0", "cc0"), ("see", ""), ("NOASSERTION", ""), ("2024", ""), ("a" * 5000 + "-1", "")],
)
def test_labels_of_public_identifiers(identifier, label):
    assert licenses.label_of(identifier) == label


def test_long_texts_take_linear_time():
    a = licenses.automaton()
    texts = ["mit license " * 90_000, "SPDX-License-Identifier: " + " OR ".join(f"X{i}-1.0" for i in range(60_000)), "SPDX-License-Identifier: " + "(" * 900_000, "spdx license identifier " * 40_000]
    for text in texts:
        began = time.process_time()
        n, places, *_ = licenses.scan_text(text, a)
        assert time.process_time() - began < 3
    assert licenses.scan_text(texts[0], a)[1][-1][0] == 2 * 90_000 - 2
