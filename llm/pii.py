"""Personal data: rules for four kinds, and a linear-chain CRF for other spellings.

The base rules are searched from what each kind must contain (``@``, ``+``, digits), so a
text is read in linear time. The base spans always stay. The conditional random field
labels white-space words by their shapes and those of both neighbours; it is trained by
full-batch gradient ascent on a small labelled table: windows of words from a bounded sample
of documents, labelled by the base rules, and a fixed list of other spellings. Spans that it
finds apart from base spans, with as many digits as the kind needs (and for cards their check
digit), are added as ``crf_<kind>``.

Decoding is exact Viterbi in numpy batches. A word whose shape makes "no data" the best label
whatever stands beside it splits the sequence; the runs between such words are decoded
together, padded by length.

A null text is empty and has no spans. Offsets are code points, end exclusive. Other columns
are ignored. With no documents the model is trained on the fixed list alone. Rows that repeat
are scanned each, null ids too; of rows that share an id one may be in the sample.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from llm.common import blocks, code_points, map_batches, sample_by_hash, span_digest, texts_of

BASE = ("email", "ip", "card", "phone")
LABELS = ("none", *BASE)
KINDS = (*BASE, *(f"crf_{k}" for k in BASE))
SAMPLE_DOCS = 6000  # bound of the sample of documents that training windows come from
WINDOWS_PER_DOC = 8  # of them around personal data, at most
WINDOWS = 3000  # bound of the windows with personal data, and of those without
LEAST_PLAIN = 1000
AROUND = 8
BUCKETS = 4096
BLOCK_BYTES = 8 << 20

DOMAIN = re.compile(rb"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match that starts inside a run of digits would also start at the run's first digit.
IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)

#: Labelled spellings that the base rules miss: ``{kind|text}`` marks a span. ``#`` stands for a
#: digit and ``~`` for a number up to 255, which a seeded generator fills in.
FORMATS = (
    "call {phone|(###) ###-####} today",
    "phone {phone|###-###-####} or write",
    "tel {phone|### ### ####} please",
    "fax: {phone|(###) ###-####} and more",
    "ring {phone|###.###.####} now",
    "at {phone|# (###) ###-####} we are",
    "card {card|#### #### #### ####} was paid",
    "number {card|####-####-####-####} is valid",
    "with {card|################} as given",
    "mail {email|anna.##[at]example.com} for it",
    "write to {email|tom@mailhost} soon",
    "from {email|ben(at)example.org} we heard",
    "host {ip|~.~.~.~:####} is down",
    "server {ip|[~.~.~.~]} answers",
    "page 12 of 40 in 2019",
    "in 1998 there were 250 of them",
    "price 19.99 and 5.50 in all",
    "version 2.4.1 of part 7",
    "on 12-05-2020 at 10:30 sharp",
    "room 101, floor 3",
    "the and of to a in is it",
    "One more. Another one, and THE LAST ONE!",
)


def luhn(digits: bytes) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = digit - 48
        total += (value * 2 - 9 * (value > 4)) if place % 2 else value
    return total % 10 == 0


def base_byte_spans(data: bytes) -> list[tuple[str, int, int]]:
    """Base spans with byte offsets, by start and then kind."""
    found = []
    at, free = data.find(b"@"), 0
    while at >= 0:
        match = DOMAIN.match(data, at)
        if match:
            start = at
            while start > free and data[start - 1] in LOCAL:
                start -= 1
            if start < at:
                found.append(("email", start, match.end()))
                free = match.end()
        at = data.find(b"@", max(at + 1, free))
    for m in IP.finditer(data):
        parts = [p.lstrip(b"0") for p in m[0].split(b".")]
        if all(len(p) <= 3 and int(p or b"0") <= 255 for p in parts):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(data):
        if m.end() - m.start() >= 12:
            digits = m[0].translate(None, NOT_DIGIT)
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    at = data.find(b"+")
    while at >= 0:
        m = PHONE.match(data, at)
        if m and 9 <= len(m[0].translate(None, NOT_DIGIT)) <= 15:
            found.append(("phone", m.start(), m.end()))
        at = data.find(b"+", m.end() if m else at + 1)
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    data = text.encode("utf-8", "surrogatepass")
    return code_points(data, text, base_byte_spans(data))


# ---- features -----------------------------------------------------------------------------

CLASSES = str.maketrans(
    {chr(c): "x" for c in range(97, 123)}
    | {chr(c): "X" for c in range(65, 91)}
    | {chr(c): "d" for c in range(48, 58)}
    | {chr(c): "x" for c in range(128, 0x250) if chr(c).isalpha()}
)
RUN = re.compile(r"([xXd])\1+")
WORD = re.compile(r"\S+")


def shape_of(word: str) -> str:
    """The classes of a word's characters; features depend on nothing else."""
    return word.translate(CLASSES)


def shape_features(shape: str) -> tuple[int, int, int]:
    """Buckets of a shape with runs as one, of its first twelve classes, and of its number of
    digits with marked characters."""
    if not shape.isascii():
        shape = "".join(c if c.isascii() else "x" for c in shape)
    facts = (RUN.sub(r"\1", shape), shape[:12], f"{min(shape.count('d'), 20)}{'@' in shape}{'+' in shape}")
    return tuple(zlib.crc32(f"{i}{fact}".encode()) % BUCKETS for i, fact in enumerate(facts))


def features(word: str) -> tuple[int, int, int]:
    return shape_features(shape_of(word))


@dataclass
class Model:
    """Weights by place (word before, word itself, word after), feature bucket and label."""

    own: np.ndarray
    step: np.ndarray

    def emissions(self, rows: np.ndarray) -> np.ndarray:
        """Scores that a word with features ``rows`` gives to the labels of the word after
        it, of itself, and of the word before it: three (words, labels) arrays."""
        return np.stack([self.own[p][rows].sum(axis=1) for p in range(3)])


def scores(model: Model, rows: np.ndarray) -> np.ndarray:
    """Label scores of each place of padded sequences ``rows`` (sequences, places, features)."""
    out = model.own[1][rows].sum(axis=2)
    out[:, 1:] += model.own[0][rows[:, :-1]].sum(axis=2)
    out[:, :-1] += model.own[2][rows[:, 1:]].sum(axis=2)
    return out


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(sequences: list[tuple[list[tuple], list[int]]], rounds: int = 80, rate: float = 0.5, l2: float = 1e-4) -> Model:
    """Maximise the likelihood of labelled sequences (features and labels of each word), with
    per-weight step sizes. Words beside a sequence count as "none" without features."""
    k, pad = len(LABELS), BUCKETS  # bucket BUCKETS is that of no word; its weights stay 0
    longest = max(len(y) for _, y in sequences)
    n = len(sequences)
    rows = np.full((n, longest, 3), pad)
    labels = np.zeros((n, longest), dtype=np.int64)
    inside = np.zeros((n, longest), dtype=bool)
    for i, (x, y) in enumerate(sequences):
        rows[i, : len(y)], labels[i, : len(y)], inside[i, : len(y)] = x, y, True
    model = Model(np.zeros((3, BUCKETS + 1, k)), np.zeros((k, k)))
    squares = [np.full_like(model.own, 1e-2), np.full_like(model.step, 1e-2)]
    hot = np.eye(k)[labels] * inside[..., None]
    padded = np.pad(labels, ((0, 0), (1, 1)))
    for _ in range(rounds):
        # Places past the end are fixed to "none" by a large penalty.
        e = scores(model, rows) * inside[..., None]
        e[~inside, 1:] = -1e4
        forward, backward = np.empty_like(e), np.empty_like(e)
        forward[:, 0] = model.step[0] + e[:, 0]
        for t in range(1, longest):
            forward[:, t] = logsum(forward[:, t - 1, :, None] + model.step, 1) + e[:, t]
        backward[:, -1] = model.step[:, 0]
        for t in range(longest - 2, -1, -1):
            backward[:, t] = logsum(model.step + (e[:, t + 1] + backward[:, t + 1])[:, None], 2)
        total = logsum(forward[:, -1] + backward[:, -1], 1)
        share = np.exp(forward + backward - total[:, None, None]) * inside[..., None]
        diff = (hot - share) / n
        own = np.zeros_like(model.own)
        for f in range(3):
            np.add.at(own[1], rows[:, :, f], diff)
            np.add.at(own[0], rows[:, :-1, f], diff[:, 1:])
            np.add.at(own[2], rows[:, 1:, f], diff[:, :-1])
        own[:, pad] = 0
        pair = forward[:, :-1, :, None] + model.step + (e[:, 1:] + backward[:, 1:])[:, :, None]
        step = -np.exp(pair - total[:, None, None, None]).sum(axis=(0, 1)) / n
        np.add.at(step, (labels[:, :-1], labels[:, 1:]), 1 / n)
        first, last = np.exp(forward[:, 0] + backward[:, 0] - total[:, None]), np.exp(forward[:, -1] + backward[:, -1] - total[:, None])
        step[0] += np.eye(k)[padded[:, 1]].mean(0) - first.mean(0)
        step[:, 0] += np.eye(k)[padded[:, -2]].mean(0) - last.mean(0)
        for weight, grad, square in ((model.own, own, squares[0]), (model.step, step, squares[1])):
            grad -= l2 * weight
            square += grad * grad
            weight += rate * grad / np.sqrt(square)
    return model


# ---- training table -----------------------------------------------------------------------


def labelled(words: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[int]:
    """The label of each word, given the places of words and spans: that of a span it overlaps."""
    out, at = [0] * len(words), 0
    for kind, start, end in sorted(spans, key=lambda s: s[1]):
        while at < len(words) and words[at][1] <= start:
            at += 1
        i = at
        while i < len(words) and words[i][0] < end:
            out[i] = LABELS.index(kind)
            i += 1
    return out


def filled(kind: str, body: str, rng: random.Random) -> str:
    """``body`` with digits and numbers; a card's last digit is its check digit."""
    body = re.sub("~", lambda m: str(rng.randrange(256)), re.sub("#", lambda m: str(rng.randrange(10)), body))
    if kind == "card":
        body = next(x for x in (body[:-1] + str(d) for d in range(10)) if luhn(x.encode().translate(None, NOT_DIGIT)))
    return body


def formats(copies: int = 1, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """``FORMATS`` as words and labels, each ``copies`` times with other digits."""
    rng = random.Random(seed)
    out = []
    for line in FORMATS * copies:
        words, labels = [], []
        for part in re.split(r"(\{\w+\|[^}]*\})", line):
            kind, _, body = part.strip("{}").partition("|") if part.startswith("{") else ("none", "", part)
            body = filled(kind, body, rng)
            words += body.split()
            labels += [LABELS.index(kind)] * len(body.split())
        out.append((words, labels))
    return out


Window = tuple[list[tuple], list[int]]  # features and labels of its words


def training_windows(df: DataFrame, id_col: str, text_col: str, docs: int, per_doc: int) -> list[Window]:
    """Windows of at most ``docs`` documents, by the hashes of their words: around base spans,
    ``per_doc`` of them at most, and one at a place that the text's own hash names. Only features
    and labels leave the tasks, so the size of what is collected is bounded, however long words are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, rows, labels = [], [], []
            for text in texts_of(batch):
                places = [(m.start(), m.end()) for m in WORD.finditer(text)]
                if not places:
                    continue
                own = labelled(places, base_spans(text))
                marked = [i for i, y in enumerate(own) if y and (i == 0 or own[i - 1] != y)]
                marked.sort(key=lambda i: zlib.crc32(b"%d" % i))
                anywhere = zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(places)
                for i in [anywhere, *marked[:per_doc]]:
                    low, high = max(0, i - AROUND), i + AROUND + 4
                    words = [text[a:b] for a, b in places[low:high]]
                    order.append(zlib.crc32(" ".join(words).encode("utf-8", "surrogatepass")))
                    rows.append([bucket for w in words for bucket in features(w)])
                    labels.append(own[low:high])
            yield pa.RecordBatch.from_arrays(
                [pa.array(order, pa.int64()), pa.array(rows, pa.list_(pa.int32())), pa.array(labels, pa.list_(pa.int32()))],
                ["order", "rows", "labels"],
            )

    sample = sample_by_hash(df.selectExpr(f"`{id_col}` id", f"`{text_col}` text"), docs, "id", "text")
    table = map_batches(sample.select("text"), run, "order bigint, rows array<int>, labels array<int>").toArrow()
    found = sorted(zip(*(table.column(c).to_pylist() for c in ("order", "rows", "labels"))))
    return [(list(zip(rows[::3], rows[1::3], rows[2::3])), labels) for _, rows, labels in found]


def train(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    docs: int = SAMPLE_DOCS,
    per_doc: int = WINDOWS_PER_DOC,
    windows: int = WINDOWS,
) -> Model:
    """A model from windows of a bounded sample of documents and the fixed list, ten times with
    other digits. Of windows with personal data and of those without, the ``windows`` with the
    smallest hashes are used; of the latter no more than of the former, or ``LEAST_PLAIN``."""
    found = training_windows(df, id_col, text_col, docs, per_doc)
    having = [w for w in found if any(w[1])][:windows]
    plain = [w for w in found if not any(w[1])][: min(windows, max(LEAST_PLAIN, len(having)))]
    known: dict[str, tuple] = {}
    fixed = [([known.setdefault(w, features(w)) for w in words], labels) for words, labels in formats(10)]
    return fit(having + plain + fixed)


# ---- decoding -----------------------------------------------------------------------------


def viterbi(e: np.ndarray, sizes: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The best labels of padded runs of ``sizes`` words with "none" before and after."""
    n, longest, k = e.shape
    best = step[0] + e[:, 0]
    back = np.zeros((n, longest, k), dtype=np.int8)
    end = np.where((sizes == 1)[:, None], best, -np.inf)
    for t in range(1, longest):
        through = best[:, :, None] + step
        back[:, t] = through.argmax(axis=1)
        best = through.max(axis=1) + e[:, t]
        end = np.where((sizes == t + 1)[:, None], best, end)
    label = (end + step[:, 0]).argmax(axis=1)
    out = np.zeros((n, longest), dtype=np.int8)
    for t in range(longest - 1, -1, -1):
        live = sizes > t
        out[live, t] = label[live]
        label = np.where(live & (t > 0), back[np.arange(n), t, label], label)
    return out


def decode(model: Model, docs: list[list[str]], cells: int = 1 << 20) -> list[dict[int, int]]:
    """Of each document (its words), the places whose label is not "none", and the label."""
    numbers: dict[str, int] = {}
    number = numbers.setdefault
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    words = np.fromiter((number(w, len(numbers)) for d in docs for w in d), np.int32, int(sizes.sum()))
    out: list[dict[int, int]] = [{} for _ in docs]
    if not len(words):
        return out
    shapes: dict[str, int] = {}
    shape = shapes.setdefault
    flat = np.fromiter((shape(shape_of(w), len(shapes)) for w in numbers), np.int32, len(numbers))[words]
    after, own, before = model.emissions(np.array([shape_features(x) for x in shapes]))
    # A label can win at a word only if some neighbours' scores and labels let it.
    lead = own[:, :1] - own + (after[:, :1] - after).min(axis=0) + (before[:, :1] - before).min(axis=0)
    lead += (model.step[:, :1] - model.step).min(axis=0) + (model.step[:1] - model.step).min(axis=1)
    sure = (lead[:, 1:] > 1e-9).all(axis=1)
    open_ = np.flatnonzero(~sure[flat])
    if not len(open_):
        return out
    doc = np.repeat(np.arange(len(docs)), sizes)
    start = np.cumsum(sizes) - sizes
    starts = np.flatnonzero(np.r_[True, (np.diff(open_) > 1) | (np.diff(doc[open_]) > 0)])
    lengths = np.diff(np.r_[starts, len(open_)])
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop - at + 1) * lengths[order[stop]] <= cells:
            stop += 1
        runs = order[at:stop]
        longest = int(lengths[runs[-1]])
        places = open_[starts[runs]][:, None] + np.arange(longest)
        inside = np.arange(longest) < lengths[runs][:, None]
        places = np.where(inside, places, open_[starts[runs]][:, None])
        e = own[flat[places]]
        left, right = places - 1, np.minimum(places + 1, len(flat) - 1)
        e += after[flat[left]] * ((places > start[doc[places]])[..., None])
        e += before[flat[right]] * ((places + 1 < (start + sizes)[doc[places]])[..., None])
        labels = viterbi(e, lengths[runs], model.step)
        for i, t in zip(*np.nonzero((labels > 0) & inside)):
            place = int(places[i, t])
            out[doc[place]][place - int(start[doc[place]])] = int(labels[i, t])
        at = stop
    return out


#: Digits that an added span of each kind has, least and most.
DIGITS = {"email": (0, 99), "ip": (4, 17), "card": (12, 19), "phone": (7, 15)}


def added_spans(text: str, marks: dict[int, int], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of runs of equal labels, without marks around them, apart from base spans."""
    places = [(m.start(), m.end()) for m in WORD.finditer(text)]
    out, runs = [], []
    for i in sorted(marks):
        if runs and runs[-1][1] == i - 1 and runs[-1][2] == marks[i]:
            runs[-1][1] = i
        else:
            runs.append([i, i, marks[i]])
    for first, last, label in runs:
        start, end = places[first][0], places[last][1]
        while start < end and not (text[start].isalnum() or text[start] in "+(["):
            start += 1
        while end > start and not (text[end - 1].isalnum() or text[end - 1] in ")]"):
            end -= 1
        kind = LABELS[label]
        digits = text[start:end].encode("utf-8", "surrogatepass").translate(None, NOT_DIGIT)
        low, high = DIGITS[kind]
        valid = low <= len(digits) <= high and (kind != "card" or luhn(digits))
        if valid and start < end and not any(a < end and start < b for _, a, b in base):
            out.append((f"crf_{kind}", start, end))
    return out


def detect(df: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, found array<struct<kind, start, end>>``, ``n_<kind>`` of the base kinds,
    ``base_sha256`` and ``spans`` as written by ``span_digest``. Trains where no model is given."""
    model = model or train(df, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            texts = texts_of(block)
            base = [base_spans(t) for t in texts]
            marks = decode(model, [t.split() for t in texts])
            rows = [
                sorted(b + added_spans(t, m, b), key=lambda s: (s[1], KINDS.index(s[0]))) if m else b
                for t, m, b in zip(texts, marks, base)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("id"),
                    pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in r] for r in rows], pa.list_(span)),
                    *(pa.array([sum(s[0] == k for s in r) for r in base], pa.int64()) for k in BASE),
                    pa.array([span_digest(r)[1] for r in base], pa.string()),
                    pa.array([span_digest(r)[0] for r in rows], pa.string()),
                ],
                ["id", "found", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    schema = (
        f"id {kind}, found array<struct<kind:string,start:bigint,end:bigint>>, "
        + ", ".join(f"n_{k} bigint" for k in BASE)
        + ", base_sha256 string, spans string"
    )
    return map_batches(df.selectExpr(f"`{id_col}` id", f"`{text_col}` text"), run, schema)
