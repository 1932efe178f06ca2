"""License scans against plain expressions, and the evaluator against a recursive reading."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import SCHEMA, TEXTS, rows_of
from pyspark.sql import functions as F

from llm import licenses
from llm.queries import op12_licenses

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def plain_base(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    places = [
        (i, label)
        for phrase, label in BASE.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    return len(words), sorted(places)


PIECES = st.lists(
    st.sampled_from(
        ["CC", "by", "cc-by", " ", "-", ".", "General", "Public", "license", "all", "Rights", "RESERVED", "é", " ", "日", "\n", "nc", "sa",
         "mit", "cc by", "SPDX-License-Identifier:", "spdx license identifier", "(", ")", "AND", "or", "With", "GPL-2.0-only", "\x7f", "`", "{"]
    ),
    max_size=40,
)


@settings(max_examples=400, deadline=None)
@given(PIECES, st.sampled_from([" ", "", "-"]))
def test_base_places_equal_plain_search(pieces, between):
    text = between.join(pieces)
    found = licenses.find(text)
    n, places = plain_base(text)
    assert (found.n_words, sorted(found.base)) == (n, places)
    assert found.base_labels <= found.labels and 0 <= found.score <= 1
    assert (found.score > 0) == bool(found.labels)


# An independent reading: an expression as a nested tuple, written out and evaluated by recursion.
NAMES = {"MIT": 1, "Apache-2.0": 1, "MPL-2.0": 2, "LGPL-2.1-or-later": 2, "GPL-3.0-only": 3, "AGPL-3.0+": 4, "LicenseRef-x": 4}


def tree(rng, depth):
    if not depth or rng.random() < 0.2:
        name = rng.choice(list(NAMES))
        return ("with", name) if rng.random() < 0.3 else name
    return (rng.choice(["and", "or"]), tree(rng, depth - 1), tree(rng, depth - 1))


def written(node, rng, outer=0):
    if isinstance(node, str):
        text, own = node, 4
    elif node[0] == "with":
        text, own = f"{node[1]} {rng.choice(['WITH', 'with'])} Some-exception-2.0", 3
    else:
        own = {"and": 2, "or": 1}[node[0]]
        text = f"{written(node[1], rng, own)} {rng.choice([node[0], node[0].upper()])} {written(node[2], rng, own)}"
    return f"({text})" if own < outer or rng.random() < 0.1 else text


def plain_demand(node):
    if isinstance(node, str):
        return NAMES[node]
    if node[0] == "with":
        return max(1, NAMES[node[1]] - 1)
    sides = plain_demand(node[1]), plain_demand(node[2])
    return min(sides) if node[0] == "or" else max(sides)


def test_expressions_equal_a_recursive_reading():
    rng = random.Random(5)
    for _ in range(1500):
        node = tree(rng, 5)
        text = written(node, rng)
        value, end = licenses.evaluate(text.encode())
        assert (value.demand, end) == (plain_demand(node), len(text)), text
        found = licenses.find(f"x\n// SPDX-License-Identifier: {text}\n and more")
        assert [(w, v) for w, v in found.expressions] == [(1, value)]
        assert found.score == plain_demand(node) / 5


@pytest.mark.parametrize(
    ("text", "labels", "demand"),
    [
        ("MIT OR GPL-3.0-only AND", ["gpl-3.0", "mit"], 1),
        ("GPL-2.0+ AND (MIT OR (", ["gpl-2.0", "mit"], 3),
        ("((AGPL-3.0-only", ["agpl-3.0"], 4),
        ("MIT) AND AGPL-3.0", ["mit"], 1),
        ("MIT GPL-3.0", ["mit"], 1),
        ("GPL-2.0 WITH Classpath-exception-2.0 AND MIT", ["gpl-2.0", "mit"], 2),
        ("", None, None),
        ("AND MIT", None, None),
        ("()", None, None),
    ],
)
def test_unfinished_expressions(text, labels, demand):
    value, _ = licenses.evaluate(text.encode())
    assert (value and sorted(value.labels), value and value.demand) == (labels, demand)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under CC BY-NC 4.0.", {"cc-by", "cc-by-nc"}),
        ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
        ("This work is licensed under the GNU General Public License, version 3.", {"gpl", "gpl-3.0"}),
        ("the GNU Lesser General Public License", {"gpl", "lgpl"}),
        ("Released under the MIT License.", {"mit"}),
        ("MIT License Zero", {"mit-0"}),
        ("Tous droits réservés", {"reserved"}),
        ("the license of the public general", set()),
        ("spdx license identifier MIT", set()),
        ("SPDX-License-Identifier: (MIT OR Apache-2.0) # all rights reserved", {"mit", "apache-2.0", "reserved"}),
    ],
)
def test_labels(text, labels):
    assert licenses.find(text).labels == labels


def test_long_texts_take_linear_time():
    for piece in ("SPDX-License-Identifier: AND ", "SPDX-License-Identifier: (", "SPDX-License-Identifier: a AND ", "(", "cc by "):
        text = "SPDX-License-Identifier: " + piece * (1_000_000 // len(piece))
        assert len(text) > 900_000
        start = time.perf_counter()
        licenses.find(text)
        assert time.perf_counter() - start < 8
    start = time.perf_counter()
    found = licenses.find("SPDX-License-Identifier: " + " AND ".join(f"x{i}" for i in range(100_000)))
    assert len(found.labels) == 100_000 and time.perf_counter() - start < 8


def test_odd_rows(spark, save, odd_docs, no_docs):
    """Nulls, repeated rows, long texts, clashing columns, no rows; the query's digest columns."""
    odd = odd_docs.unionByName(odd_docs).unionByName(
        odd_docs.withColumns({c: F.lit(None).cast(t) for c, t in odd_docs.dtypes}).limit(2)
    )
    made = licenses.scan(odd).collect()
    assert len(made) == 2 * len(TEXTS) + 2
    texts = dict(enumerate(TEXTS))
    for r in made:
        n, places = plain_base(texts.get(r.id))
        assert (r.n_words, sorted((b.word, b.label) for b in r.base)) == (n, places)
    assert licenses.scan(no_docs).count() == 0
    extra = ["CC BY cc by x All rights-reserved", None, "General public license. MIT license"]
    docs = spark.createDataFrame(rows_of(extra), SCHEMA)
    rows = {r.doc_id: tuple(r)[1:] for r in op12_licenses(spark, save(documents=docs)).collect()}
    assert rows == {
        0: (8, 3, 0, 5, "cc-by,reserved", "cc-by,reserved", 1.0),
        1: (0, 0, None, None, "", "", 0.0),
        2: (5, 1, 0, 0, "gpl", "gpl,mit", 0.6),
    }
