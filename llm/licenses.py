"""License scans: identifier tags and notice phrases by Aho-Corasick, expressions by shunting-yard.

A text is reduced to its words (ASCII letters lowered, digits, all characters from U+0080 on),
joined by single blanks. One automaton over that line of words finds every place of every
phrase; a place is the number of its first word. Two kinds of phrases:

* base phrases, whose places are all reported: ``cc by`` (label cc-by), ``general public license``
  (gpl), ``all rights reserved`` (reserved);
* phrases of the method, ``NOTICES``: names of licenses and sentences of their notices. A place that
  lies inside a longer one of the method's is not reported (``mit license`` in ``mit license zero``).

Where the words of the tag ``SPDX-License-Identifier:`` stand, the expression behind its colon is read
from the text itself: identifiers, parentheses, and the operators ``and``, ``or`` and ``with`` in any
case, where ``with`` binds closest and ``or`` least. Two stacks turn it into a value: the
labels of its identifiers, and how much it asks of a user. An expression ends where
neither an operand nor an operator can follow; what was complete up to there counts.
Tags inside an expression that has been read are not read again, so a text is read once.

Demands are steps: 1 for licenses that ask for a notice only, 2 for those whose changes to files
stay open, 3 for those that reach the whole work, 4 for those that also reach network use or forbid
some uses, 5 where all rights are reserved. ``or`` leaves the choice of the least, ``and`` asks
for all, so the most counts; ``with`` an exception takes one step off, down to 1. The score of a text
is the most that any of its notices and expressions demands, in fifths; 0 if it has none.

A null or empty text has no words, no labels and a score of 0. Rows that repeat are scanned each,
null ids too; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from llm.common import map_batches, texts_of

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

NOTICE, FILE, WORK, USE, ALL = 1, 2, 3, 4, 5

# Labels, with what they demand and the phrases that name them.
NOTICES = {
    "mit": (NOTICE, "mit license", "permission is hereby granted free of charge to any person obtaining a copy"),
    "mit-0": (NOTICE, "mit no attribution", "mit license zero"),
    "apache-2.0": (NOTICE, "apache license version 2 0", "apache license 2 0", "apache 2 0 license"),
    "apache": (NOTICE, "apache license", "apache software license"),
    "bsd": (NOTICE, "bsd license", "redistribution and use in source and binary forms"),
    "bsd-2-clause": (NOTICE, "bsd 2 clause", "2 clause bsd", "simplified bsd license"),
    "bsd-3-clause": (NOTICE, "bsd 3 clause", "3 clause bsd", "new bsd license", "modified bsd license"),
    "isc": (NOTICE, "isc license", "permission to use copy modify and or distribute this software"),
    "zlib": (NOTICE, "zlib license"),
    "bsl-1.0": (NOTICE, "boost software license"),
    "cc0-1.0": (NOTICE, "cc0", "cc zero", "no rights reserved"),
    "unlicense": (NOTICE, "unlicense", "released into the public domain"),
    "cc-by": (NOTICE, "creative commons attribution"),
    "lgpl": (FILE, "gnu lesser general public license", "lesser general public license", "library general public license"),
    "mpl-2.0": (FILE, "mozilla public license"),
    "epl": (FILE, "eclipse public license"),
    "gpl": (WORK, "gnu general public license", "gnu gpl"),
    "gpl-2.0": (WORK, "general public license version 2", "gnu general public license version 2", "gpl v2", "gplv2"),
    "gpl-3.0": (WORK, "general public license version 3", "gnu general public license version 3", "gpl v3", "gplv3"),
    "cc-by-sa": (WORK, "cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"),
    "agpl": (USE, "affero general public license", "gnu affero general public license"),
    "cc-by-nc": (USE, "cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"),
    "cc-by-nc-sa": (USE, "cc by nc sa", "creative commons attribution noncommercial sharealike"),
    "cc-by-nc-nd": (USE, "cc by nc nd", "creative commons attribution noncommercial noderivatives"),
    "cc-by-nd": (USE, "cc by nd", "creative commons attribution noderivatives"),
    "reserved": (ALL, "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados"),
}
DEMANDS = {label: demand for label, (demand, *_) in NOTICES.items()}
TAG = "spdx license identifier"
UNKNOWN_DEMAND = USE  # of an identifier that no label fits

# Bytes that are no part of a word become blanks; capitals become small.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
TAG_SIGN = re.compile(rb"(?i:spdx-license-identifier)[\x20\t]*:")
TOKEN = re.compile(rb"[\x20\t]*([()]|[0-9A-Za-z][0-9A-Za-z.+-]*)")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Leads from the blank behind a phrase to its length with both blanks, words, and labels:
    that of the base (or None), that of the method (or None), and whether it is the tag."""
    meant: dict[str, list] = {f" {TAG} ": [None, None, True]}
    for phrase, label in BASE.items():
        meant[f" {phrase} "] = [label, None, False]
    for label, (_, *phrases) in NOTICES.items():
        for phrase in phrases:
            meant.setdefault(f" {phrase} ", [None, None, False])[1] = label
    made = ahocorasick.Automaton()
    for text, labels in meant.items():
        made.add_word(text.encode().decode("latin-1"), (len(text.encode()), *labels))
    made.make_automaton()
    return made


# --- expressions ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Value:
    """What an expression comes to."""

    labels: set[str]
    demand: int


def of_identifier(name: str) -> Value:
    """The value of an identifier: its own label; what the label it begins with demands."""
    name = name.lower()
    base = re.sub(r"(\+|-or-later|-only)$", "", name)
    fits = [label for label in DEMANDS if base == label or base.startswith(f"{label}-")]
    demand = DEMANDS[max(fits, key=len)] if fits else UNKNOWN_DEMAND
    return Value({base}, demand)


PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def combined(operator: str, left: Value, right: Value) -> Value:
    if operator == "with":
        return Value(left.labels, max(left.demand - 1, NOTICE))
    pick = min if operator == "or" else max
    few, many = sorted((left.labels, right.labels), key=len)
    many |= few  # in place, so that a chain of many identifiers takes linear time
    return Value(many, pick(left.demand, right.demand))


@dataclass
class Yard:
    """Two stacks; ``operators`` also holds open parentheses."""

    values: list[Value] = field(default_factory=list)
    operators: list[str] = field(default_factory=list)

    def reduce(self, least: int) -> None:
        """Apply the operators on top that bind at least as closely."""
        while self.operators and PRECEDENCE.get(self.operators[-1], 0) >= least:
            right, left = self.values.pop(), self.values.pop()
            self.values.append(combined(self.operators.pop(), left, right))

    def close(self) -> bool:
        """Reduce to the open parenthesis; False if there is none."""
        self.reduce(1)
        if not self.operators:
            return False
        self.operators.pop()
        return True


def evaluate(data: bytes, at: int = 0) -> tuple[Value | None, int]:
    """The value of the expression that starts at ``at`` and where it ends; None if there is none."""
    yard = Yard()
    operand = True  # is one expected
    end = at
    while token := TOKEN.match(data, at):
        word = token[1].decode().lower()
        if operand:
            if word == "(":
                yard.operators.append(word)
            elif word == ")" or word in PRECEDENCE:
                break
            else:
                yard.values.append(of_identifier(token[1].decode()))
                operand = False
        elif word in PRECEDENCE:
            yard.reduce(PRECEDENCE[word])
            yard.operators.append(word)
            operand = True
        elif word != ")" or not yard.close():
            break
        at = end = token.end()
    if operand:  # open parentheses and one operator may wait for an operand that never came
        while yard.operators and yard.operators[-1] == "(":
            yard.operators.pop()
        yard.operators = yard.operators[:-1]
    while yard.close():
        pass
    return (yard.values[0] if yard.values else None), end


# --- texts ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Found:
    """What a text holds. ``base`` are places (first word) and labels of base phrases, ``notices``
    places, numbers of words and labels of the method's, ``expressions`` places and values."""

    n_words: int
    base: list[tuple[int, str]]
    notices: list[tuple[int, int, str]]
    expressions: list[tuple[int, Value]]

    @property
    def base_labels(self) -> set[str]:
        return {label for _, label in self.base}

    @property
    def labels(self) -> set[str]:
        return self.base_labels.union(
            (label for _, _, label in self.notices), *(value.labels for _, value in self.expressions)
        )

    @property
    def score(self) -> float:
        demands = [DEMANDS[label] for _, label in self.base]
        demands += [DEMANDS[label] for _, _, label in self.notices]
        demands += [value.demand for _, value in self.expressions]
        return max(demands, default=0) / ALL


def outermost(places: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """``start, words, label`` without those that lie inside a longer one."""
    kept, reach = [], -1
    for start, words, label in sorted(places, key=lambda p: (p[0], -p[1])):
        if start + words > reach:
            kept.append((start, words, label))
            reach = start + words
    return kept


def find(text: str) -> Found:
    data = text.encode("utf-8", "surrogatepass")
    words = data.translate(WORD_BYTES).split()
    line = b" %s " % b" ".join(words) if words else b""
    base, notices, tags = [], [], []
    place, at = 0, 0  # the word that starts behind the blank at ``at``
    hits = [(end - meant[0] + 1, meant) for end, meant in automaton().iter(line.decode("latin-1"))]
    for start, (size, of_base, of_method, is_tag) in sorted(hits, key=lambda h: h[0]):
        place += line.count(b" ", at, start)
        at = start
        if of_base:
            base.append((place, of_base))
        if of_method:
            notices.append((place, line.count(b" ", start, start + size) - 1, of_method))
        if is_tag:
            tags.append(place)
    return Found(len(words), base, outermost(notices), expressions(data, tags) if tags else [])


def expressions(data: bytes, tags: list[int]) -> list[tuple[int, Value]]:
    """The values behind the tags whose first words are given, in one run over the words."""
    out, wanted, read = [], iter(tags), 0
    sought = next(wanted)
    for place, word in enumerate(WORD.finditer(data)):
        if place == sought:
            sign = TAG_SIGN.match(data, word.start())
            if sign and word.start() >= read:
                value, read = evaluate(data, sign.end())
                if value:
                    out.append((place, value))
            sought = next(wanted, None)
            if sought is None:
                break
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, base, notices, expressions, base_labels, labels, score``: what ``find`` gives.

    ``base`` and ``notices`` are arrays of structs by place; ``base_labels`` and ``labels`` are
    distinct, sorted and joined by commas."""
    kind = df.schema[id_col].dataType.simpleString()
    base_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    notice_type = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("label", pa.string())]))
    value_type = pa.list_(
        pa.struct([("word", pa.int64()), ("labels", pa.list_(pa.string())), ("demand", pa.int64())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t) for t in texts_of(batch)]
            columns = {
                "id": batch.column("id"),
                "n_words": pa.array([f.n_words for f in found], pa.int64()),
                "base": pa.array([[{"word": w, "label": x} for w, x in f.base] for f in found], base_type),
                "notices": pa.array(
                    [[{"word": w, "words": n, "label": x} for w, n, x in f.notices] for f in found], notice_type
                ),
                "expressions": pa.array(
                    [
                        [{"word": w, "labels": sorted(v.labels), "demand": v.demand} for w, v in f.expressions]
                        for f in found
                    ],
                    value_type,
                ),
                "base_labels": pa.array([",".join(sorted(f.base_labels)) for f in found], pa.string()),
                "labels": pa.array([",".join(sorted(f.labels)) for f in found], pa.string()),
                "score": pa.array([f.score for f in found], pa.float64()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = (
        f"id {kind}, n_words bigint, base array<struct<word:bigint,label:string>>,"
        " notices array<struct<word:bigint,words:bigint,label:string>>,"
        " expressions array<struct<word:bigint,labels:array<string>,demand:bigint>>,"
        " base_labels string, labels string, score double"
    )
    return map_batches(df.selectExpr(f"`{id_col}` id", f"`{text_col}` text"), run, schema)
