"""Language by a string kernel: blended-spectrum presence, Nyström landmarks, ridge regression.

A text is the set of its letter n-grams of one to ``LONGEST`` characters (lower case, runs of
other characters as one space), hashed to ``PLACES`` places. The kernel of two texts is the
size of their common set over the geometric mean of both sizes. Some texts of each language are
landmarks; a text's kernel values with them, whitened by the landmarks' own kernel matrix, are
its coordinates, and one ridge regression per language (1 for its texts, -1 for others) gives
scores. A batch of texts is scored by two matrix products.

Every language is learned. Training sees at most ``TRAIN_ROWS`` texts of each, those with the
smallest hashes of their ids, and the first ``LANDMARKS`` of each are landmarks. Where there are
many languages they share ``ALL_ROWS`` texts and ``ALL_LANDMARKS`` landmarks evenly, at least one
of each a language. ``LANGUAGES`` may limit them to the most frequent ones; by default nothing
does. Texts are read whole. A null text and
a text without a letter are ``und`` with score 0, as is every text where nothing could be
learned; other scores are the softmax of the regressions. Ties go to the language that sorts first.
Rows that repeat are classified each, null ids too.

As a filter the model accepts a text whose language it is asked to keep, if the score is at least
``SURE`` times what chance gives. A text in no learned language shares few n-grams with any
landmark and scores hardly more than that. Where nothing was learned, letters decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import map_batches, one_row_each, stored

PLACES = 1 << 13
LONGEST = 4
TRAIN_ROWS = 600
LANDMARKS = 24
ALL_ROWS = 64 * TRAIN_ROWS
ALL_LANDMARKS = 64 * LANDMARKS
LANGUAGES: int | None = None
RIDGE = 1e-2
SHARPNESS = 4.0
SURE = 1.3
UNKNOWN = "und"
BATCH = 256
CHUNK = 1 << 20


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def presence(text: str | None, out: np.ndarray) -> bool:
    """Mark the places of a text's n-grams in ``out``; false if it has no letter."""
    found = False
    for at in range(0, len(text or ""), CHUNK - LONGEST):  # chunks overlap, so no n-gram is lost
        codes = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = letters()[codes]
        if not is_letter.any():
            continue
        found = True
        codes = np.where(is_letter, codes, np.uint32(32))
        codes = codes[is_letter | np.r_[True, is_letter[:-1]]]
        mark = codes * np.uint32(0x9E3779B1)
        for n in range(1, LONGEST + 1):
            if n > 1:
                mark = (mark[:-1] ^ mark[:-1] >> np.uint32(15)) * np.uint32(0x85EBCA6B) + codes[n - 1 :] * np.uint32(0xC2B2AE35)
            out[(mark ^ mark >> np.uint32(16)) * np.uint32(0x7FEB352D) >> np.uint32(32 - 13)] = 1
    return found


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


@dataclass
class Model:
    """Landmarks as unit rows of presence, and weights of their kernel values by language."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def classify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        for at in range(0, len(texts), BATCH):
            part = texts[at : at + BATCH]
            x = np.zeros((len(part), PLACES), dtype=np.float32)
            known = np.array([presence(t, row) for t, row in zip(part, x)], dtype=bool)
            if not self.languages:
                names += [UNKNOWN] * len(part)
                continue
            raw = SHARPNESS * (unit_rows(x) @ self.landmarks.T) @ self.weights
            share = np.exp(raw - raw.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            best = raw.argmax(axis=1)
            names += [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)]
            scores[at : at + len(part)] = np.where(known, share[np.arange(len(part)), best], 0.0)
        return names, scores

    def accepts(self, texts: list[str | None], keep: set[str] | None = None, sure: float = SURE) -> list[bool]:
        """Which texts are in one of the languages to ``keep`` (None: in any learned one)."""
        if not self.languages:
            return [has_letter(t) for t in texts]
        least = min(1.0, sure / len(self.languages)) if len(self.languages) > 1 else 0.0
        return [
            name != UNKNOWN and score >= least and (keep is None or name in keep)
            for name, score in zip(*self.classify(texts))
        ]


def unpacked(marks: list[bytes]) -> np.ndarray:
    """Unit rows from packed presence bits."""
    bits = np.frombuffer(b"".join(marks), dtype=np.uint8).reshape(len(marks), PLACES // 8)
    return unit_rows(np.unpackbits(bits, axis=1).astype(np.float32))


def fit(rows: list[tuple[str, bytes]]) -> Model:
    """A model from languages and packed presence bits, in the order in which landmarks are
    taken. Only the landmarks and sums over blocks of rows are held unpacked."""
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return Model([], np.zeros((0, PLACES), np.float32), np.zeros((0, 0), np.float32))
    number = {lang: k for k, lang in enumerate(languages)}
    label = np.array([number[lang] for lang, _ in rows])
    each = min(LANDMARKS, max(1, ALL_LANDMARKS // len(languages)))
    marks = np.concatenate([np.flatnonzero(label == k)[:each] for k in range(len(languages))])
    landmarks = unpacked([rows[i][1] for i in marks])
    own = (landmarks @ landmarks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(own)
    good = values > 1e-6 * values[-1]
    white = vectors[:, good] / np.sqrt(values[good])
    # Every language counts alike, however many texts it has.
    share = 1.0 / np.bincount(label)[label]
    ridge = RIDGE * np.eye(white.shape[1])
    target = np.zeros((white.shape[1], len(languages)))
    for at in range(0, len(rows), BATCH):
        own_label = label[at : at + BATCH]
        points = (unpacked([m for _, m in rows[at : at + BATCH]]) @ landmarks.T).astype(np.float64) @ white
        weighted = points * share[at : at + BATCH, None]
        ridge += weighted.T @ points
        target += weighted.T @ np.where(own_label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weights = white @ np.linalg.solve(ridge, target)
    return Model(languages, landmarks, weights.astype(np.float32))


def order_of(key: str) -> Column:
    """A reproducible random order of keys, as 16 hex digits."""
    return F.lower(F.lpad(F.hex(F.xxhash64(F.lit(9), key)), 16, "0"))


def train(df: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from at most ``rows`` texts of each language, ``ALL_ROWS`` in all but one of each;
    rows without a language, a text with letters or an id are left out. Of rows that share
    id and language the one whose text has the smallest hash is taken."""
    table = df.selectExpr(f"`{id_col}` id", f"`{text_col}` text", f"`{lang_col}` lang").where(
        "id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL"
    )
    if LANGUAGES is not None:
        common = table.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
        table = table.join(F.broadcast(common.select("lang")), "lang", "left_semi")
    pairs = stored(table.select("id", "lang").distinct().withColumn("at", order_of("id")), "language-pairs")
    sizes = pairs.groupBy("lang").agg(F.count("*").alias("n"))
    quota = min(rows, max(1, ALL_ROWS // max(1, sizes.count())))
    # The smallest hashes of a language are below a bound that leaves several times as many as are
    # wanted, and fewer with a probability below 1e-12; so no task and no group holds a language.
    share = F.conv(F.substring("at", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    thin = pairs.join(sizes, "lang").where(share * F.col("n") < 8 * quota + 40).select(*pairs.columns).toArrow().sort_by(
        [("lang", "ascending"), ("at", "ascending"), ("id", "ascending")]
    )
    names = thin.column("lang").to_numpy()
    first = np.searchsorted(names, names) if len(names) else np.zeros(0, dtype=np.int64)
    chosen = thin.filter(pa.array(np.arange(len(names)) - first < quota))
    picked = df.sparkSession.createDataFrame(chosen.to_pandas(), pairs.schema) if len(names) else pairs.limit(0)
    sample = one_row_each(table, picked, ["id", "lang"], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, known = [], []
            for text in batch.column("text").to_pylist():
                row = np.zeros(PLACES, dtype=np.uint8)
                known.append(presence(text, row))
                marks.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("at"), pa.array(marks, pa.binary()), pa.array(known)],
                ["lang", "at", "marks", "known"],
            )

    made = map_batches(sample.select("lang", "at", "text"), run, "lang string, at string, marks binary, known boolean")
    table = made.where("known").drop("known").toArrow().to_pylist()
    table.sort(key=lambda r: (r["at"], r["lang"], r["marks"]))
    return fit([(r["lang"], r["marks"]) for r in table])


def classified(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` of every text. Other columns are ignored."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.classify(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["id", "lang_pred", "score"],
            )

    return map_batches(
        df.selectExpr(f"`{id_col}` id", f"`{text_col}` text"), run, f"id {kind}, lang_pred string, score double"
    )
