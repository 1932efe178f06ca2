"""Sum-of-squares online packing of documents into windows of a fixed number of tokens.

Every task packs its documents as they come. A level array counts the open windows at each
fill level; a document goes to the level that makes the sum of squared counts of partially
filled windows smallest (a new window counts as level 0; ties go to the fullest window), so
no level piles up and gaps keep being filled. Documents longer than a window are cut into
whole windows and a rest, which is packed. When a task runs out of documents, its open
windows are closed by moving the tokens of the emptiest ones into the gaps of the fullest,
cut as needed, so that a task leaves at most one window with padding.

Token ids are those of a ``tokenizers`` file with byte-level BPE, special strings included,
and an end id after each document. The ids are computed from that file's vocabulary by
tiktoken, which gives the same ids about five times as fast.

A null text is empty: its only token is the end id. Rows are documents of their own, also those
that repeat an id or have none; other columns are ignored, and an empty table gives an empty
one. Placement depends only on the rows of a
task, so a task that runs again gives the same rows, as long as its input does.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from llm.common import map_batches, texts_of

WINDOW = 1024


def byte_of_char() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable
    Latin-1 characters for themselves, the others from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def byte_level(path: str, pattern: str) -> tiktoken.Encoding:
    """A tiktoken encoding with the vocabulary and special strings of a tokenizers file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte = byte_of_char()
    ranks = {
        bytes(byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special
    }
    return tiktoken.Encoding("byte level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


class Levels:
    """Open windows by fill level and the sum-of-squares rule."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.open: dict[int, list[int]] = {}

    def choose(self, length: int) -> int:
        """The level for a piece of ``length`` tokens; 0 is a new window."""
        if length == self.size:
            return 0
        old = self.count[1 : self.size - length + 1]
        new = self.count[length + 1 : self.size + 1]
        # Squares change by (new+1)^2 - new^2 + (old-1)^2 - old^2; a full window counts no more.
        change = 2 * (new - old) + 2
        change[-1] = 1 - 2 * old[-1]
        change[old == 0] = np.iinfo(np.int64).max
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return best + 1 if change[best] <= 2 * self.count[length] + 1 else 0

    def take(self, level: int) -> int:
        self.count[level] -= 1
        return self.open[level].pop()

    def put(self, level: int, window: int) -> None:
        if level < self.size:
            self.count[level] += 1
            self.open.setdefault(level, []).append(window)


class Packer:
    """Packs the documents of a task; ``pieces`` holds the rows that are final."""

    def __init__(self, size: int, first: int):
        self.levels = Levels(size)
        self.size, self.next = size, first
        self.held: dict[int, list[tuple]] = {}  # of open windows
        self.pieces: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) // self.size * self.size
        for start in range(0, whole, self.size):
            self.pieces.append((doc, start, ids[start : start + self.size], len(ids), self.next, 0))
            self.next += 1
        if whole < len(ids):
            self.place((doc, whole, ids[whole:], len(ids)))

    def place(self, piece: tuple) -> None:
        length = len(piece[2])
        level = self.levels.choose(length)
        if level:
            window = self.levels.take(level)
        else:
            window, self.next = self.next, self.next + 1
            self.held[window] = []
        self.held[window].append((*piece, window, level))
        self.levels.put(level + length, window)
        if level + length == self.size:
            self.pieces += self.held.pop(window)

    def finish(self) -> None:
        """Close the open windows: the emptiest are emptied into the gaps of the fullest."""
        fill = {w: sum(len(p[2]) for p in pieces) for w, pieces in self.held.items()}
        order = sorted(fill, key=lambda w: (-fill[w], w))
        low, high = 0, len(order) - 1
        while low < high:
            into, source = order[low], order[high]
            room = self.size - fill[into]
            if not room:
                low += 1
                continue
            doc, start, ids, total, _, offset = self.held[source].pop()
            cut = max(0, len(ids) - room)
            if cut:
                self.held[source].append((doc, start, ids[:cut], total, source, offset))
            moved = len(ids) - cut
            self.held[into].append((doc, start + cut, ids[cut:], total, into, fill[into]))
            fill[into] += moved
            fill[source] -= moved
            if not fill[source]:
                high -= 1
        self.pieces += [piece for w in order for piece in self.held[w]]
        self.held = {}


def pack(
    df: DataFrame,
    path: str,
    pattern: str,
    window: int = WINDOW,
    end_id: int = 0,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``id, start, length, ids_crc32`` (of the ids as little-endian 32-bit
    words), ``doc_tokens`` (with the end id), ``sequence_id, offset``, and ``ids`` if asked for.
    """
    kind = df.schema[id_col].dataType.simpleString()
    fields = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def rows(pieces: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        doc, start, ids, total, sequence, offset = zip(*pieces)
        columns = [
            pa.array(doc, id_type),
            *(
                pa.array(x, pa.int64())
                for x in (start, map(len, ids), (zlib.crc32(x.astype("<u4").tobytes()) for x in ids), total, sequence, offset)
            ),
        ]
        if with_ids:
            columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, [*fields, *["ids"] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_level(path, pattern)
        packer = Packer(window, TaskContext.get().partitionId() << 32)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for doc, text in zip(batch.column("id").to_pylist(), texts_of(batch)):
                ids = encoding.encode_to_numpy(text, allowed_special="all")
                packer.add(doc, np.append(ids, ids.dtype.type(end_id)))
            if packer.pieces:
                yield rows(packer.pieces, id_type)
                packer.pieces = []
        packer.finish()
        if packer.pieces:
            yield rows(packer.pieces, id_type)

    schema = f"id {kind}, " + ", ".join(f"{f} bigint" for f in fields[1:]) + ", ids array<int>" * with_ids
    return map_batches(df.selectExpr(f"`{id_col}` id", f"`{text_col}` text"), run, schema)
