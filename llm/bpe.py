"""Byte-level BPE by replaying the merges over all words of a block at once.

The distinct words of a block of documents are laid out as one array of tokens with links
to both neighbours. An inverted index leads from a merge to the positions where its pair
stands. Merges are taken in rank order; each is applied to all its positions, and only the
pairs that touch a merged token are looked up and indexed again. Words are independent, so
blocks give the same ids as one corpus-wide replay, and no word is ever shuffled.

``encode`` and ``decode`` need a ranks file (one ``base64 rank`` per line) and a pattern.
A null text is empty; an empty text has no ids. Rows are encoded one by one, also those that
repeat an id or have none. Columns other than id and text are ignored; an empty table gives an
empty one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from llm.common import blocks, map_batches, texts_of

BLOCK_BYTES = 24 << 20


class Ranks:
    """A vocabulary and its merges: which pair of ids makes which id."""

    def __init__(self, vocab: dict[bytes, int]):
        self.ids = vocab
        self.words = {i: w for w, i in vocab.items()}
        self.byte_ids = np.array([vocab[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for word, merged in vocab.items():
            for cut in range(1, len(word)):
                left, right = vocab.get(word[:cut]), vocab.get(word[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = merged
        self.codes = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[c] for c in self.codes.tolist()], dtype=np.int64)
        # Tokens that are part of an earlier merge than their own: after such a merge an
        # earlier one may become due, so it is applied to one place of a word at a time.
        early = (self.codes >> 32 > self.merged) | ((self.codes & 0xFFFFFFFF) > self.merged)
        parts = np.concatenate([self.codes[early] >> 32, self.codes[early] & 0xFFFFFFFF])
        self.careful = frozenset(parts[parts > np.tile(self.merged[early], 2)].tolist())

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair, -1 where there is none."""
        code = left << 32 | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.merged[at], -1)


@lru_cache(maxsize=2)
def ranks_file(path: str) -> Ranks:
    with open(path, "rb") as f:
        pairs = (line.split() for line in f if line.strip())
        return Ranks({base64.b64decode(word): int(rank) for word, rank in pairs})


def replay(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all ``words``, one after the other, and how many each word has."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    n = int(sizes.sum())
    if not n:
        return np.zeros(0, np.int64), sizes
    token = ranks.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    word = np.repeat(np.arange(len(words)), sizes)
    after = np.arange(1, n + 1)
    before = np.arange(-1, n - 1)
    ends = np.cumsum(sizes)
    after[ends[sizes > 0] - 1] = -1
    before[(ends - sizes)[sizes > 0]] = -1
    due = np.full(n, -1, dtype=np.int64)  # merge of the pair that begins here

    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def add(places: np.ndarray) -> None:
        """Look up the pairs that begin at ``places`` and index those that merge."""
        nxt = after[places]
        inner = nxt >= 0
        due[places[~inner]] = -1
        places, nxt = places[inner], nxt[inner]
        found = ranks.lookup(token[places], token[nxt])
        due[places] = found
        places, found = places[found >= 0], found[found >= 0]
        if not len(places):
            return
        order = np.argsort(found, kind="stable")
        places, found = places[order], found[order]
        starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
        for rank, own in zip(found[starts].tolist(), np.split(places, starts[1:])):
            if rank not in index:
                index[rank] = []
                heapq.heappush(queue, rank)
            index[rank].append(own)

    add(np.arange(n))
    while queue:
        rank = heapq.heappop(queue)
        parts = index.pop(rank)
        places = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
        places = places[due[places] == rank]
        if not len(places):
            continue
        if len(places) > 1:
            # In a run of overlapping pairs every second one merges, from the left.
            chained = np.r_[False, after[places[:-1]] == places[1:]]
            at = np.arange(len(places))
            start = np.maximum.accumulate(np.where(chained, 0, at))
            chosen = (at - start) % 2 == 0
            if rank in ranks.careful:
                own = word[places]
                chosen &= np.r_[True, own[1:] != own[:-1]]
                rest = places[~chosen]
                if len(rest):
                    index[rank] = [rest]
                    heapq.heappush(queue, rank)
            places = places[chosen]
        gone = after[places]
        beyond = after[gone]
        token[places] = rank
        token[gone] = -1
        due[gone] = -1
        after[places] = beyond
        inner = beyond >= 0
        before[beyond[inner]] = places[inner]
        left = before[places]
        add(np.unique(np.concatenate([left[left >= 0], places])))
    alive = token >= 0
    return token[alive], np.bincount(word[alive], minlength=len(words))


class Encoder:
    """Encodes blocks of texts; ``pattern`` splits a text into words."""

    def __init__(self, path: str, pattern: str):
        self.ranks = ranks_file(path)
        self.split = regex.compile(pattern).findall

    def block(self, texts: list[str]) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        """Word numbers of each text, and the ids and number of ids of each distinct word."""
        numbers: dict[str, int] = {}
        number = numbers.setdefault
        rows = [[number(w, len(numbers)) for w in self.split(t)] for t in texts]
        words = [w.encode("utf-8", "surrogatepass") for w in numbers]
        whole = [self.ranks.ids.get(w) for w in words]  # a word of the vocabulary is one id
        ids, counts = replay([b"" if k is not None else w for w, k in zip(words, whole)], self.ranks)
        single = np.array([-1 if k is None else k for k in whole], dtype=np.int64)
        counts = np.where(single >= 0, 1, counts)
        out = np.empty(int(counts.sum()), dtype=np.int64)
        at_single = (np.cumsum(counts) - counts)[single >= 0]
        mask = np.ones(len(out), dtype=bool)
        mask[at_single] = False
        out[at_single] = single[single >= 0]
        out[mask] = ids
        return rows, out, counts


def gather(row: list[int], ids: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of a text from the numbers of its words."""
    w = np.asarray(row, dtype=np.int64)
    own = counts[w]
    first = np.repeat(starts[w] - (np.cumsum(own) - own), own)
    return ids[first + np.arange(len(first))]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids``: the token ids of every text, without special tokens."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for block in blocks(batches, BLOCK_BYTES):
            rows, ids, counts = encoder.block(texts_of(block))
            starts = np.cumsum(counts) - counts
            for at in range(0, len(rows), 500):
                lists = [gather(r, ids, counts, starts).astype(np.int32) for r in rows[at : at + 500]]
                yield pa.RecordBatch.from_arrays(
                    [block.column("id").slice(at, 500), pa.array(lists, type=pa.list_(pa.int32()))],
                    ["id", "ids"],
                )

    return map_batches(df.selectExpr(f"`{id_col}` id", f"`{text_col}` text"), run, f"id {kind}, ids array<int>")


def decode_ids(ids: list[int], ranks: Ranks) -> bytes:
    return b"".join(map(ranks.words.__getitem__, ids))


def decode(df: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``id, bytes``: the bytes that the ids stand for; null ids stand for none."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_file(path)
        for batch in batches:
            made = [decode_ids(ids or [], ranks) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.binary())], ["id", "bytes"])

    return map_batches(df.selectExpr(f"`{id_col}` id", f"`{ids_col}` ids"), run, f"id {kind}, bytes binary")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of ids and of the decoded bytes, in one pass that keeps the ids in the task:
    ``id, n_tokens, ids_sha256`` (decimal ids joined by a space), ``decoded_sha256``.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        ranks = encoder.ranks
        for block in blocks(batches, BLOCK_BYTES):
            rows, ids, counts = encoder.block(texts_of(block))
            starts = np.cumsum(counts) - counts
            listed = ids.tolist()
            decimal = [" ".join(map(str, listed[s : s + c])) for s, c in zip(starts.tolist(), counts.tolist())]
            n, of_ids, of_bytes = [], [], []
            for row in rows:
                own = gather(row, ids, counts, starts).tolist()
                n.append(len(own))
                of_ids.append(hashlib.sha256(" ".join([decimal[w] for w in row]).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(decode_ids(own, ranks)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_batches(
        df.selectExpr(f"`{id_col}` id", f"`{text_col}` text"),
        run,
        f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )
