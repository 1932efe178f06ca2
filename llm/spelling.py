"""Spelling variants: words one edit apart, found in k-d trees over their letter counts.

A word is a point of as many dimensions as there are letters: how often it holds each. Putting
one letter in moves the point by one in one dimension, replacing one letter by one up in a
dimension and one down in another. So the words at one edit of a word of ``L`` letters lie, among
those of ``L`` letters and those of ``L + 1``, within an L1 distance of two.

Words of one length are dealt over the leaves of a k-d tree. Its cuts are fitted to a bounded
sample; all words are indexed. A word looks for its partners in each leaf whose box it reaches
with the steps it has (one up, and one down at the same length), and of two leaves of one length
only the lower one sends its words to the other, so a pair meets once. Inside a leaf a k-d tree
of all its words is descended with all words that look there at once; boxes are the true
bounds of the points below a node. What is left is compared by counts and then letter by letter.

Words that all have the same counts cannot be told apart by a tree. A leaf where the sample holds
many of those is dealt further by the first and second halves of its words: of two words
at one edit, one half is the same. A pair that meets by both halves counts once.

Runs of letters come from whole texts; only their counts are shuffled. No word, length or
leaf goes to the driver: only the sample's letter counts, ``2 * SAMPLE`` points at most.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import map_batches, sorted_groups, stored, texts_of

RUN = re.compile("[a-zÀ-ÿ]+")
EVERY = 31  # one run in so many loses a letter
LEAST_LENGTH = 7
LEAST_COUNT = 2
FACTOR = 10  # how much more often a form occurs

SAMPLE = 1 << 15  # points that the dealing tree is fitted to, twice as many at most
LEAF_WORDS = 16000  # words a leaf of the dealing tree is meant to hold
LEAF_BYTES = 8 << 20  # and letters and counts, for very long words
TIP_WORDS = 96  # words that are compared at once at the end of a descent
CELLS = 1 << 22  # of a matrix of distances
HELD_BYTES = 16 << 20  # of counted words before a task passes them on

# Letters are numbered from a, then from U+00C0; both fit in Latin-1.
LETTERS = 26 + 64
NUMBER = np.zeros(256, dtype=np.uint8)
NUMBER[97:123] = np.arange(26)
NUMBER[0xC0:] = np.arange(26, LETTERS)


# --- words ---------------------------------------------------------------------------------


def words_of(doc_id, text: str) -> Counter:
    """The words of one text, and how often it holds each."""
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in Counter(RUN.findall(lower)).items():
        if len(run) < LEAST_LENGTH:
            continue
        h = zlib.crc32(run.encode(), start)
        if h % EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        out[run] += n
    return out


def counted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: the words of all texts with their occurrences, those below the bounds left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        size = 0

        def passed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), texts_of(batch)):
                for word, n in words_of(doc_id, text).items():
                    if word not in held:
                        size += 100 + len(word)
                    held[word] += n
                if size > HELD_BYTES:
                    yield passed_on()
                    held.clear()
                    size = 0
        if held:
            yield passed_on()

    parts = map_batches(df.selectExpr(f"`{id_col}` id", f"`{text_col}` text"), run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letters_of(words: list[str]) -> np.ndarray:
    """Words of one length as rows of Latin-1 bytes."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)


def counts_of(letters: np.ndarray) -> np.ndarray:
    """How often each row holds each letter; 255 stands for that and more."""
    rows = len(letters)
    out = np.zeros((rows, LETTERS), dtype=np.uint8)
    step = max(1, CELLS // max(letters.shape[1], LETTERS))
    for at in range(0, rows, step):
        part = NUMBER[letters[at : at + step]].astype(np.int64)
        part += np.arange(len(part))[:, None] * LETTERS
        made = np.bincount(part.ravel(), minlength=(min(at + step, rows) - at) * LETTERS)
        out[at : at + step] = np.minimum(made, 255).reshape(-1, LETTERS)
    return out


# --- the dealing tree ----------------------------------------------------------------------


def cut_of(points: np.ndarray) -> tuple[int, int] | None:
    """The letter whose counts spread most and the count up to which points go left, about
    half of them; None where all points are equal."""
    spread = points.var(axis=0)
    letter = int(spread.argmax())
    if not spread[letter]:
        return None
    upto = np.bincount(points[:, letter]).cumsum()
    below = upto[: int(np.flatnonzero(upto == len(points))[0])]  # a cut at the last count parts nothing
    valid = np.flatnonzero(below)
    return letter, int(valid[np.abs(2 * below[valid] - len(points)).argmin()])


@dataclass
class Tree:
    """Cuts of one length. ``kids`` of a node are nodes, or leaves as ``-1 - leaf``."""

    cuts: list[tuple[int, int]] = field(default_factory=list)
    kids: list[list[int]] = field(default_factory=list)
    crowded: list[bool] = field(default_factory=list)

    def grow(self, points: np.ndarray, most: float) -> int:
        """The node or leaf for ``points``; a leaf holds ``most`` of them, or equal ones."""
        cut = cut_of(points) if len(points) > most else None
        if cut is None:
            self.crowded.append(len(points) > 2 * most)
            return -len(self.crowded)
        node = len(self.cuts)
        self.cuts.append(cut)
        self.kids.append([0, 0])
        left = points[:, cut[0]] <= cut[1]
        self.kids[node] = [self.grow(points[left], most), self.grow(points[~left], most)]
        return node

    @property
    def root(self) -> int:
        return 0 if self.cuts else -1

    def homes(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(points), dtype=np.int32)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            letter, upto = self.cuts[node]
            left = points[rows, letter] <= upto
            todo += zip(self.kids[node], (rows[left], rows[~left]))
        return out

    def reached(self, points: np.ndarray, downs: int) -> Iterator[tuple[int, np.ndarray]]:
        """``leaf, rows``: the points that reach its box by one letter more, ``downs`` fewer."""
        zero = np.zeros(len(points), dtype=np.int16)
        todo = [(self.root, np.arange(len(points)), zero, zero, {}, {})]
        while todo:
            node, rows, up, down, low, high = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -1 - node, rows
                continue
            letter, upto = self.cuts[node]
            c = points[rows, letter].astype(np.int16)
            down_left = down + np.maximum(c - upto, 0) - np.maximum(c - high.get(letter, 255), 0)
            up_right = up + np.maximum(upto + 1 - c, 0) - np.maximum(low.get(letter, 0) - c, 0)
            left, right = down_left <= downs, up_right <= 1
            todo.append((self.kids[node][0], rows[left], up[left], down_left[left], low, high | {letter: upto}))
            todo.append((self.kids[node][1], rows[right], up_right[right], down[right], low | {letter: upto + 1}, high))


ONE_LEAF = Tree(crowded=[False])


def fit_trees(words: DataFrame, rows: int, sample: int = SAMPLE, leaf_words: int = LEAF_WORDS) -> dict[int, Tree]:
    """A tree for each length that occurs in a sample of about ``sample`` of the ``rows`` words,
    those with small hashes. Other lengths are rare and have one leaf."""
    rate = min(1.0, sample / max(rows, 1))
    picked = words.where(F.pmod(F.xxhash64(F.lit(3), "word"), F.lit(1 << 30)) < int(rate * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("word").to_pylist()
            points = [counts_of(letters_of([w])).tobytes() for w in texts]
            lengths = pa.array([len(w) for w in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([lengths, pa.array(points, pa.binary())], ["length", "point"])

    found = map_batches(picked.limit(2 * sample).select("word"), run, "length int, point binary").toArrow()
    lengths = found.column("length").to_numpy()
    points = np.frombuffer(b"".join(found.column("point").to_pylist()), dtype=np.uint8).reshape(-1, LETTERS)
    order = np.lexsort(points.T)  # whatever the order in which rows arrive
    lengths, points = lengths[order], points[order]
    trees = {}
    for length in np.unique(lengths).tolist():
        most = min(leaf_words, LEAF_BYTES // (length + LETTERS)) * rate
        tree = Tree()
        tree.grow(points[lengths == length], max(most, 1.0))
        trees[length] = tree
    return trees


def halves(word: str, length: int) -> tuple[str, str]:
    """What a word shares with one of ``length`` letters at one edit: one of the two."""
    return word[: length // 2], word[len(word) - (length - length // 2) :]


def half_keys(word: str, length: int) -> tuple[int, int]:
    """Keys of both halves: even for the first, odd for the second."""
    return tuple(2 * zlib.crc32(half.encode()) + i for i, half in enumerate(halves(word, length)))


WHOLE = -1  # the key of a word in a leaf that is not dealt further
DEALT = "length int, leaf int, part bigint, looks boolean, word string, n bigint"


def dealt(words: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """Each word once per leaf (or half of a leaf) that it belongs to or looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ns = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            lengths = np.array([len(w) for w in texts], dtype=np.int64)
            for own in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == own)
                points = counts_of(letters_of([texts[i] for i in rows]))
                tree = trees.get(own, ONE_LEAF)
                home = tree.homes(points)
                places = [(own, leaf, False, np.flatnonzero(home == leaf)) for leaf in np.unique(home).tolist()]
                places += [(own, leaf, True, at[home[at] < leaf]) for leaf, at in tree.reached(points, 1)]
                longer = trees.get(own + 1, ONE_LEAF)
                places += [(own + 1, leaf, True, at) for leaf, at in longer.reached(points, 0)]
                for length, leaf, looks, at in places:
                    if not len(at):
                        continue
                    chosen = [texts[i] for i in rows[at]]
                    numbers = ns[rows[at]]
                    parts = [WHOLE] * len(chosen)
                    if trees.get(length, ONE_LEAF).crowded[leaf]:
                        parts = [k for w in chosen for k in half_keys(w, length)]
                        chosen, numbers = [w for w in chosen for _ in (0, 1)], numbers.repeat(2)
                    size = len(chosen)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([length] * size, pa.int32()),
                            pa.array([leaf] * size, pa.int32()),
                            pa.array(parts, pa.int64()),
                            pa.array([looks] * size, pa.bool_()),
                            pa.array(chosen, pa.string()),
                            pa.array(numbers, pa.int64()),
                        ],
                        ["length", "leaf", "part", "looks", "word", "n"],
                    )

    return map_batches(words.select("word", "n"), run, DEALT)


# --- inside a leaf -------------------------------------------------------------------------


def close(points: np.ndarray, seekers: np.ndarray, downs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``seeker, point`` numbers of pairs whose counts differ by one letter more in the point
    and ``downs`` (0 or 1, per seeker) fewer. Counts at 255 may hide a difference."""
    todo = [(np.arange(len(points)), np.arange(len(seekers)))]
    while todo:
        rows, asking = todo.pop()
        here, there = points[rows], seekers[asking]
        low, high = here.min(axis=0), here.max(axis=0)
        reach = (np.maximum(low, there) - there).sum(axis=1, dtype=np.int64) <= 1
        reach &= (there - np.minimum(high, there)).sum(axis=1, dtype=np.int64) <= downs[asking]
        if not reach.any():
            continue
        asking = asking[reach]
        cut = cut_of(here) if len(rows) > TIP_WORDS else None
        if cut is not None:
            left = here[:, cut[0]] <= cut[1]
            todo += [(rows[left], asking), (rows[~left], asking)]
            continue
        step = max(1, CELLS // len(rows))
        for at in range(0, len(asking), step):
            yield from _compared(points, rows, seekers, asking[at : at + step], downs)


def _compared(points, rows, seekers, asking, downs) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs by their squared distance, which is a matrix product: 1 or 2 for what is sought."""
    p, s = points[rows].astype(np.float32), seekers[asking].astype(np.float32)
    distance = (s * s).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * (s @ p.T)
    sought = (1 + downs[asking])[:, None]
    hidden = (s == 255).any(axis=1)[:, None]
    i, j = np.nonzero((distance == sought) | (hidden & (distance < sought)))
    if len(i):
        yield asking[i], rows[j]


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of the same length differ at exactly one place."""
    return (a != b).sum(axis=1) == 1


def inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``b`` are those of ``a`` with one letter put in."""
    size = a.shape[1]
    differ = a != b[:, :-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), size)  # letters in common at the start
    differ = (a != b[:, 1:])[:, ::-1]
    last = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
    return first + last >= size


def group_links(length: int, part: int, owners: list[str], same: list[str], shorter: list[str]) -> Iterator[tuple]:
    """``kind, seekers, owners`` as arrays of numbers, for all near pairs of one leaf: owners with
    owners (kind 0), and words of the same length (1) or one letter less (2) that look into it."""
    kinds = [letters_of(ws) for ws in (owners, same, shorter) if ws]
    numbers = [k for k, ws in enumerate((owners, same, shorter)) if ws]
    base = kinds[0]
    points = counts_of(base)
    seekers = np.concatenate([counts_of(x) for x in kinds])
    kind = np.concatenate([np.full(len(x), k) for k, x in zip(numbers, kinds)])
    place = np.concatenate([np.arange(len(x)) for x in kinds])
    of = dict(zip(numbers, kinds))
    for i, j in close(points, seekers, (kind != 2).astype(np.int64)):
        for k in numbers:
            chosen = kind[i] == k
            a, b = place[i[chosen]], j[chosen]
            if k == 0:
                a, b = a[a > b], b[a > b]
            step = max(1, CELLS // length)
            for at in range(0, len(a), step):
                x, y = a[at : at + step], b[at : at + step]
                left, right = of[k][x], base[y]
                near = inserted(left, right) if k == 2 else replaced(left, right)
                if part >= 0 and part % 2:  # the first halves bring the others together
                    near &= (left[:, : length // 2] != right[:, : length // 2]).any(axis=1)
                if near.any():
                    yield k, x[near], y[near]


LINKS = "a string, a_n bigint, b string, b_n bigint"


def links(words: DataFrame, trees: dict[int, Tree], tasks: int) -> DataFrame:
    """``a, a_n, b, b_n``: each pair of words at one edit, once."""
    keys = ["length", "leaf", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, keys):
            length, part = (group.column(c)[0].as_py() for c in ("length", "part"))
            texts, ns = group.column("word").to_pylist(), group.column("n").to_numpy()
            looks = group.column("looks").to_numpy()
            sides = [[], [], []]
            for i, word in enumerate(texts):
                sides[0 if not looks[i] else 1 if len(word) == length else 2].append(i)
            if not sides[0]:
                continue
            words_of_side = [[texts[i] for i in side] for side in sides]
            at = [np.array(side, dtype=np.int64) for side in sides]
            for kind, a, b in group_links(length, part, *words_of_side):
                left, right = at[kind][a], at[0][b]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([texts[i] for i in left.tolist()], pa.string()),
                        pa.array(ns[left], pa.int64()),
                        pa.array([texts[i] for i in right.tolist()], pa.string()),
                        pa.array(ns[right], pa.int64()),
                    ],
                    ["a", "a_n", "b", "b_n"],
                )

    # Words arrive as few large files; dealing them takes longer than reading them.
    placed = dealt(words.repartition(tasks, "word"), trees).repartition(tasks, *keys).sortWithinPartitions(*keys)
    return map_batches(placed, run, LINKS)


# --- forms ---------------------------------------------------------------------------------


def described(words: DataFrame, pairs: DataFrame, factor: int = FACTOR) -> DataFrame:
    """``word, n, n_near, form, form_n``: the near words of each counted, and its form."""
    one, other = F.struct(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("word")).alias("near")), \
        F.struct(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("word")).alias("near"))
    sides = pairs.select(F.explode(F.array(one, other)).alias("s")).select("s.word", "s.near")
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("best"))
    most = -F.col("best.less")
    found = most >= factor * F.col("n")
    return words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(found, F.col("best.word")).alias("form"),
        F.when(found, most).alias("form_n"),
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words with a form: where following forms ends.

    A form occurs more often than its word by the factor, so there are no rings, and a chain of
    19 would pass the largest long: pointers that double in reach arrive in five rounds.
    """
    current = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(current.join(ahead, "root", "left"), "spelling-roots")
        current = moved.select("word", F.coalesce("further", "root").alias("root"))
        if moved.where("further IS NOT NULL").isEmpty():
            return current


def variants(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
    leaf_words: int = LEAF_WORDS,
) -> DataFrame:
    """``word, n, n_near, form, form_n, root``: every word of the texts that occurs often enough.

    A word is a run of letters, A-Z lowered; in a run that the CRC-32 of ``<id>:<run>`` picks, one
    letter is left out. Null and empty texts have no words; a null id counts as the empty
    text; a row that repeats counts again; of forms that tie in ``n`` the first in code-point order
    is taken. A very long run is one word. An empty table gives no rows, other columns are
    ignored. ``sample`` and ``leaf_words`` move work, never results.
    """
    words = stored(counted(df, id_col, text_col), "spelling-words")
    rows = words.count()
    trees = fit_trees(words, rows, sample, leaf_words)
    leaves = sum(len(t.crowded) for t in trees.values())
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, min(leaves, 2 * rows // leaf_words + 1))
    made = stored(described(words, links(words, trees, tasks)), "spelling-described")
    return made.join(roots(made), "word", "left").withColumn("root", F.coalesce("root", "word"))
