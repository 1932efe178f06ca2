"""Toxicity by FTRL-proximal logistic regression over hashed word features.

The features of a text are the presence of its words, word pairs, pairs with one or two words
between them (skip-grams), and four-letter word stems, hashed to ``2**BITS`` places. Training
takes one example at a time with a rate of its own for each weight; L1 keeps most weights at
exactly zero, so the model is a short list of places and weights that goes to every task.

Training sees at most ``TRAIN_ROWS`` labelled rows, those with the smallest hashes of their
ids, in that order. Texts are scored whole, in blocks. A null text is empty; its score is that
of the bias, like any text without known features. Without training rows every score is 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import blocks, map_batches, one_row_each, texts_of

BITS = 20
TRAIN_ROWS = 8000
EPOCHS = 3
STEM = 4
SKIPS = (1, 2, 3)  # distance between the two words of a pair
BLOCK_BYTES = 6 << 20
WORD = re.compile(r"[^\W_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of their stems."""
    hash_of = xxhash.xxh64_intdigest
    own = np.array([hash_of(w.encode("utf-8", "surrogatepass"), 1) for w in words], dtype=np.uint64)
    stems = np.array([hash_of(w[:STEM].encode("utf-8", "surrogatepass"), 2) for w in words], dtype=np.uint64)
    return own, stems


def block_features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of text numbers and feature places that cover a block; they may repeat."""
    numbers: dict[str, int] = {}
    number = numbers.setdefault
    rows = [[number(w, len(numbers)) for w in WORD.findall(t.lower())] for t in texts]
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.fromiter((w for r in rows for w in r), dtype=np.int32, count=int(sizes.sum()))
    del rows
    if not len(flat):
        return
    own, stems = word_hashes(list(numbers))
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    shift = np.uint64(64 - BITS)
    place = lambda h: (h * MIX >> shift).astype(np.int32)
    yield doc, place(own)[flat]
    yield doc, place(stems)[flat]
    hashes = own[flat]
    for gap in SKIPS:
        if len(flat) > gap:
            inside = doc[gap:] == doc[:-gap]
            yield doc[gap:][inside], place(hashes[:-gap] * np.uint64(2 * gap + 1) + (hashes[gap:] >> np.uint64(7)))[inside]


def feature_sets(texts: list[str]) -> list[np.ndarray]:
    """The distinct feature places of each text."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for doc, place in block_features(texts):
        cuts = np.searchsorted(doc, np.arange(1, len(texts)))
        for held, own in zip(parts, np.split(place, cuts)):
            held.append(own)
    return [np.unique(np.concatenate(p)) if p else np.zeros(0, np.int32) for p in parts]


@dataclass
class Model:
    """Non-zero weights by place, and the bias."""

    places: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -np.inf

    def score(self, texts: list[str]) -> np.ndarray:
        """The probability that each text is toxic."""
        dense = np.zeros(1 << BITS)
        dense[self.places] = self.weights
        hits = []
        for doc, place in block_features(texts):
            known = dense[place] != 0
            hits.append(doc[known].astype(np.int64) << BITS | place[known])
        pairs = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        total = np.bincount(pairs >> BITS, weights=dense[pairs & ((1 << BITS) - 1)], minlength=len(texts))
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-(total + self.bias)))


class Ftrl:
    """FTRL-proximal: per-coordinate rates, L1 and L2; place ``2**BITS`` is the bias."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << BITS, 0.0, self.l1)
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, places: np.ndarray, label: int) -> None:
        at = np.append(places, 1 << BITS)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - rate * w
        self.n[at] += g * g

    def model(self) -> Model:
        places = np.flatnonzero(self.z[:-1])
        w = self.weights(places)
        bias = float(self.weights(np.array([1 << BITS]))[0])
        return Model(places[w != 0], w[w != 0], bias)


def fit(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> Model:
    learner = Ftrl()
    for _ in range(epochs):
        for places, label in examples:
            learner.learn(places, label)
    return learner.model()


def train(
    docs: DataFrame,
    labels: DataFrame,
    rows: int = TRAIN_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """A model from the ``rows`` labelled ids with the smallest hashes; only they are broadcast.
    Null labels and ids are left out, the largest label of an id counts, labels without a text
    teach nothing, and of rows that share an id the text with the smallest hash teaches."""
    known = labels.selectExpr(f"`{id_col}` id", f"int(`{label_col}`) label").dropna()
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    picked = known.withColumn("at", F.xxhash64(F.lit(8), "id")).orderBy("at", "id").limit(rows)
    sample = one_row_each(docs.selectExpr(f"`{id_col}` id", f"`{text_col}` text"), picked, ["id"], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            sets = feature_sets(texts_of(block))
            yield pa.RecordBatch.from_arrays(
                [block.column("at"), block.column("label"), pa.array(sets, pa.list_(pa.int32()))], ["at", "label", "places"]
            )

    made = map_batches(
        sample.select("at", "label", "text"), run, "at bigint, label int, places array<int>"
    ).toArrow()
    if not made.num_rows:
        return Model()
    made = made.take(pc.sort_indices(made, sort_keys=[("at", "ascending"), ("label", "ascending")]))
    labels = made.column("label").to_pylist()
    lists = made.column("places").combine_chunks()
    return fit([(lists[i].values.to_numpy(), int(y > 0)) for i, y in enumerate(labels)])


def scored(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every text. Other columns are ignored."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), pa.array(model.score(texts_of(block)), pa.float64())], ["id", "score"]
            )

    return map_batches(df.selectExpr(f"`{id_col}` id", f"`{text_col}` text"), run, f"id {kind}, score double")
