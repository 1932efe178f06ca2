"""Context-triggered piecewise hashing: fingerprints of texts that stay alike under edits.

A rolling hash over the last seven bytes decides where a chunk of the UTF-8 text ends, so
an edit moves chunk ends only near itself. Each chunk contributes one character, six bits of
its hash, to a signature. The block size is the mean length of a chunk: the largest
``3 * 2**k`` that gives a signature of half ``SIGNATURE`` characters or more where there is
one. A fingerprint is ``block:signature:signature at twice the block size``; ends at
twice the block size are a subset of the others. Texts that repeat a few bytes over and over
may end a chunk at every place at all block sizes; beyond ``LONGEST`` characters, neighbouring
chunks are joined in pairs, so every signature covers its whole text.

Fingerprints are compared at compatible block sizes: equal ones by both signatures, and where
one block size is twice the other by the two signatures that share it. Likeness is one minus
the insertions and deletions that turn one signature into the other, over the length of
both (0 to 1); the larger of two comparisons counts. It is 0 where block sizes do not fit or
the signatures share no run of ``RUN`` characters (half the shorter one, if that is less),
as chance makes any two signatures a little alike.

A null text is empty; the fingerprint of an empty text is ``3::``. Equal fingerprints have
likeness 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import map_batches, stored

WINDOW = 7
SMALLEST = 3
SIGNATURE = 32
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
ROLL = np.uint32(0x01000193)  # an odd factor of the rolling hash
STEP = np.uint64(0x9E3779B97F4A7C15)  # an odd factor of the chunk hash
SPREAD = np.uint64(0xBF58476D1CE4E5B9)
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
LEVELS = 24
LONGEST = 16 * SIGNATURE
RUN = 5


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the last ``WINDOW`` bytes at every place; places before the text are 0."""
    values = data.astype(np.uint32) + np.uint32(1)
    out = values.copy()
    factor = np.uint32(1)
    for back in range(1, min(WINDOW, len(data))):
        factor = np.uint32((int(factor) * int(ROLL)) & 0xFFFFFFFF)
        out[back:] += values[:-back] * factor
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA6B)
    out ^= out >> np.uint32(13)
    return out


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Keeps the tables that depend on length only."""

    def __init__(self):
        self.grow(1 << 12)

    def grow(self, n: int) -> None:
        self.forward, self.back = powers(n, STEP), powers(n, BACK)

    def signature(self, prefix: np.ndarray, ends: np.ndarray) -> str:
        """One character for each chunk; ``ends`` are exclusive and rise."""
        if not len(ends):
            return ""
        starts = np.r_[0, ends[:-1]]
        # The sum over a chunk of byte times STEP**place, moved back to its first place.
        hashes = (prefix[ends] - prefix[starts]) * self.back[starts]
        hashes ^= hashes >> np.uint64(29)
        hashes *= SPREAD
        return ALPHABET[hashes >> np.uint64(58)].tobytes().decode()

    def fingerprint(self, text: str) -> str:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        n = len(data)
        if not n:
            return f"{SMALLEST}::"
        if n >= len(self.forward):
            self.grow(2 * n)
        prefix = np.empty(n + 1, dtype=np.uint64)
        prefix[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.forward[:n], out=prefix[1:])
        # An end at block size 3 * 2**k needs h % 3 == 0 and k low zero bits in h // 3.
        rolled = rolling(data)
        ends = np.flatnonzero(rolled % np.uint32(3) == 0)
        level = rolled[ends] // np.uint32(3)
        k = 0
        while True:
            keep = level & np.uint32((2 << k) - 1) == 0
            if k == LEVELS or np.count_nonzero(keep) < SIGNATURE:
                break
            ends, level, k = ends[keep], level[keep], k + 1
        marks = []
        for own in (ends, ends[keep]):
            cuts = own + 1
            if not len(cuts) or cuts[-1] != n:
                cuts = np.r_[cuts, n]  # the rest is a chunk too
            while len(cuts) > LONGEST:  # periodic texts may end a chunk anywhere
                cuts = cuts[len(cuts) % 2 ^ 1 :: 2]
            marks.append(self.signature(prefix, cuts))
        return f"{SMALLEST << k}:{marks[0]}:{marks[1]}"


def common_lengths(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Lengths of the longest common subsequences, bit-parallel over Python integers."""
    out = []
    for left, right in pairs:
        places: dict[str, int] = {}
        for i, c in enumerate(left):
            places[c] = places.get(c, 0) | 1 << i
        mask = (1 << len(left)) - 1
        row = mask
        get = places.get
        for c in right:
            hit = row & get(c, 0)
            row = ((row + hit) | (row - hit)) & mask
        out.append(len(left) - row.bit_count())
    return np.array(out, dtype=np.int64)


def share_run(left: str, right: str) -> bool:
    size = max(1, min(RUN, min(len(left), len(right)) // 2))
    runs = {left[i : i + size] for i in range(len(left) - size + 1)}
    return any(right[i : i + size] in runs for i in range(len(right) - size + 1))


def likeness(one: str, other: str) -> float:
    """0 to 1; see the module."""
    if one == other:
        return 1.0
    block_a, a, a2 = one.split(":")
    block_b, b, b2 = other.split(":")
    if block_a == block_b:
        pairs = [(a, b), (a2, b2)]
    elif int(block_a) == 2 * int(block_b):
        pairs = [(a, b2)]
    elif int(block_b) == 2 * int(block_a):
        pairs = [(a2, b)]
    else:
        return 0.0
    pairs = [p for p in pairs if share_run(*p)]
    if not pairs:
        return 0.0
    shared = common_lengths(pairs)
    return max(2 * int(k) / (len(x) + len(y)) for k, (x, y) in zip(shared, pairs))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fingerprint`` of every text. Other columns are ignored."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            made = [hasher.fingerprint(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.string())], ["id", "fingerprint"])

    return map_batches(
        df.selectExpr(f"`{id_col}` id", f"`{text_col}` text"), run, f"id {kind}, fingerprint string"
    )


# ---- each text against an edited one and the next -------------------------------------------

FACTS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


class _Follower:
    """Makes the row of a text once the text after it is known."""

    def __init__(self):
        self.hasher = Hasher()
        self.last: tuple | None = None

    def facts(self, text: str, own: str, after: str, next_mark: str) -> tuple:
        moved = len(text) // 3
        edited = text[: len(text) - moved] + after[:moved]
        mark = self.hasher.fingerprint(edited)
        return (
            len(text),
            hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
            own,
            mark,
            likeness(own, mark),
            likeness(own, next_mark),
        )


def against_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """``id`` and ``FACTS``: every text beside an edited one, whose last third comes from the
    beginning of the text that follows in descending order of ids (the last is followed by the
    first), and beside that next text.

    The table is range-partitioned by id and a hash of the text once, so that many rows of one id
    are many ranges, and each range is read in order. The text after
    the last of a range is the first of the next range that has rows: the ends of ranges, two
    rows for each at most, are stored with their texts and matched in a second small step.
    Repeated ids follow each other by the hash of their texts; null ids come last.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = df.selectExpr(f"`{id_col}` id", f"coalesce(`{text_col}`, '') text")
    # Rows of one id are dealt by a hash of their text, and equal rows by their number.
    order = [F.col("id").desc_nulls_last(), F.col("mark"), F.col("text").desc()]
    ranged = (
        rows.withColumn("mark", F.xxhash64("text"))
        .withColumn("number", F.monotonically_increasing_id())
        .repartitionByRange(parts, *order[:2], "number")
        .sortWithinPartitions(*order)
        .select("id", "text")
    )
    fact_types = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follower, part = _Follower(), TaskContext.get().partitionId()
        held: tuple | None = None  # id, text and fingerprint of the last row so far
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("id").type
            out = []
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                mark = follower.hasher.fingerprint(text)
                if held is None:
                    out.append((part, 0, id_, text, *[None] * 6))
                else:
                    out.append((part, 2, held[0], None, *follower.facts(held[1], held[2], text, mark)))
                held = (id_, text, mark)
            yield _rows(out, id_type)
        if held is not None:
            yield _rows([(part, 1, held[0], held[1], *[None] * 6)], id_type)

    made = stored(
        map_batches(ranged, run, f"part int, place int, id {kind}, text string, {fact_types}"), "ctph-ranges"
    )
    # Of every range its first text (place 0) and its last row (place 1), in order.
    ends = made.where("place < 2").select("part", "place", "id", "text")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follower = _Follower()
        for batch in batches:
            out = []
            for part, id_, text, after in zip(*(batch.column(c).to_pylist() for c in ("part", "id", "text", "after"))):
                mark, next_mark = follower.hasher.fingerprint(text), follower.hasher.fingerprint(after)
                out.append((part, 2, id_, None, *follower.facts(text, mark, after, next_mark)))
            yield _rows(out, batch.schema.field("id").type)

    firsts = ends.where("place = 0").selectExpr("part next", "text after")
    numbers = sorted(r[0] for r in firsts.select("next").collect())  # one for each range
    following = list(zip(numbers, numbers[1:] + numbers[:1]))
    lasts = ends.where("place = 1").join(spark.createDataFrame(following, "part int, next int"), "part")
    linked = lasts.join(firsts, "next").select("part", "id", lasts["text"], "after")
    closed = map_batches(linked, close, f"part int, place int, id {kind}, text string, {fact_types}")
    return made.where("place = 2").unionByName(closed).select("id", *FACTS)


def _rows(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [
        ("part", pa.int32()), ("place", pa.int32()), ("id", id_type), ("text", pa.string()), ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ]
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types)], [n for n, _ in types])
