"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard parser evaluates expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.llm.common import parts

# The contract's phrases and labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notice phrases and labels of this method.
MORE_PHRASES = {
    "mit licence": "mit", "apache licence": "apache", "apache 2 0": "apache", "general public licence": "gpl", "gnu gpl": "gpl",
    "lesser general public license": "lgpl", "affero general public license": "agpl", "mozilla public license": "mpl", "bsd license": "bsd",
    "2 clause bsd": "bsd", "3 clause bsd": "bsd", "redistribution and use in source and binary forms": "bsd", "isc license": "isc",
    "eclipse public license": "epl", "boost software license": "bsl", "the unlicense": "unlicense", "creative commons": "cc", "cc by": "cc-by",
    "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc0 1 0": "cc0", "all rights reserved": "proprietary",
}
# Identifier families whose label is another word.
FAMILIES = {"0bsd": "bsd", "bsl": "bsl", "gfdl": "gfdl", "x11": "mit", "expat": "mit"}
# Identifiers without a digit or a hyphen.
PLAIN = frozenset("mit isc unlicense zlib postgresql curl wtfpl beerware ruby vim ncsa openssl libpng intel ipa ftl fair x11".split())
#: Characters of the longest identifier.
IDENTIFIER_CHARS = 64
PERMISSIVE = {"mit", "apache", "bsd", "isc", "bsl", "unlicense", "cc0", "cc-by", "zlib"}
TAG = "spdx license identifier"

_TABLE = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
_TAG_TEXT = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


_FAMILY = re.compile(r"([a-z0-9]*[a-z][a-z0-9.]*(?:-[a-z][a-z0-9.]*)*?)(?:-(?:v?\d[\w.]*|only|or-later|clause|patent|variant)\b.*)?", re.DOTALL)


def label_of(identifier: str) -> str:
    """The label of a public licence identifier: its family in lower case, which is what stands before its version (MPL-2.0: mpl, CC-BY-SA-4.0: cc-by-sa).

    Words that aren't identifiers (neither in PLAIN nor with a digit or a hyphen) have none, nor have NONE, NOASSERTION
    and a document's own LicenseRef- names.
    """
    name = identifier.lower().rstrip("+")
    m = _FAMILY.fullmatch(name) if len(name) <= IDENTIFIER_CHARS and not name.startswith("licenseref-") else None
    if m is None or name not in PLAIN and name not in FAMILIES and not re.search(r"[0-9-]", name):
        return ""
    return FAMILIES.get(m[1], m[1])


def postfix(expression: str) -> list[str] | None:
    """A licence expression in postfix order by the shunting-yard method ('with' binds closest, then 'and', then 'or'); None if it isn't well formed."""
    out: list[str] = []
    held: list[str] = []
    operand = False  # whether the last token ended an operand
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if word in _RANK:
            if not operand:
                return None
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[word]:
                out.append(held.pop())
            held.append(word)
            operand = False
        elif token == "(":
            if operand:
                return None
            held.append(token)
        elif token == ")":
            if not operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif operand:
            break  # prose after the expression
        else:
            out.append(token)
            operand = True
    while held:
        if held[-1] == "(":
            return None
        out.append(held.pop())
    return out if operand else None


def evaluate(expression: str, allowed: set[str] | frozenset[str] = frozenset(PERMISSIVE)) -> tuple[list[str], bool] | None:
    """Labels that an expression names, and whether it can be met with allowed licences alone; None if it isn't well formed."""
    tokens = postfix(expression)
    if tokens is None:
        return None
    stack: list[tuple[set[str], bool]] = []
    for token in tokens:
        if token in _RANK:
            (right, b), (left, a) = stack.pop(), stack.pop()
            if token != "with":
                # the smaller set goes into the larger one
                left, right = (left, right) if len(left) >= len(right) else (right, left)
                left |= right
            stack.append((left, a if token == "with" else a and b if token == "and" else a or b))
        else:
            label = label_of(token)
            stack.append(({label} if label else set(), label in allowed))
    labels, met = stack.pop()
    return sorted(labels), met


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, label in {**MORE_PHRASES, **BASE_PHRASES, TAG: ""}.items():
        a.add_word(f" {phrase} ", (phrase, label))
    a.make_automaton()
    return a


def scan_text(text: str | None, a: ahocorasick.Automaton) -> tuple[int, list[tuple[int, str, str]], list[str], bool]:
    """Number of words; places (word, phrase, label) of every phrase, overlapping ones too; labels of tagged expressions; whether each of those can be met permissively."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_TABLE).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    places, tagged, met = [], False, True
    words_before = at = 0  # words that end before the place `at`, counted on from one match's end to the next
    for end, (phrase, label) in a.iter(line):
        words_before += line.count(" ", at, end)
        at = end
        if label:
            places.append((words_before - 1 - phrase.count(" "), phrase, label))
        else:
            tagged = True
    labels: set[str] = set()
    if tagged:
        for m in _TAG_TEXT.finditer(text):
            if found := evaluate(m[1]):
                labels.update(found[0])
                met = met and found[1]
    return len(words), sorted(places), sorted(labels), met


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, permissive, places.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, letters A-Z in lower case. n_base counts the places where a
    base phrase's words stand consecutively, overlapping ones too; first_word and last_word are the smallest and largest start (null without
    any). labels has base_labels and those of the further phrases and tagged expressions. score is 1 - 0.5 ** (1 for each base place and
    tagged label, 0.5 for each other place). Null and empty texts: no words, empty labels, score 0. Repeated rows give equal rows; an empty
    table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for b in parts(batches):
            cols: list[list] = [[] for _ in range(9)]
            for text in b.column(1).to_pylist():
                n, places, tagged, met = scan_text(text, a)
                base = [p for p in places if p[1] in BASE_PHRASES]
                labels = {p[2] for p in places} | set(tagged)
                evidence = len(base) + len(tagged) + 0.5 * (len(places) - len(base))
                row = (
                    n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({p[2] for p in base})), ",".join(sorted(labels)),
                    1 - 0.5 ** min(evidence, 60), bool(labels) and met and {p[2] for p in places} <= PERMISSIVE, [{"word": w, "phrase": p} for w, p, _ in places],
                )
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.list_(pa.struct([("word", pa.int64()), ("phrase", pa.string())]))]
            yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], NAMES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean, places array<struct<word:long,phrase:string>>"
NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "permissive", "places"]
