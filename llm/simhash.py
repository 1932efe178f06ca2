"""SimHash near-duplicates: fingerprints within a few bits, joined on a popcount grid.

A fingerprint is cut into segments of four bits; the vector of their popcounts is a point of
a grid. Two fingerprints that differ in ``d`` bits have points at Manhattan distance ``d`` or
less, so for ``d = 2`` some grid cell is at distance 1 or less from both: each fingerprint is
listed in its own cell and the cells next to it, and fingerprints that share a cell are
candidates, which an exact bit count verifies.

Equal fingerprints are one node from the start, so copies never meet each other. A cell with
more than ``CELL_LIMIT`` different fingerprints is not paired: its members are listed under
themselves and all fingerprints one bit away, and those listed under one key, which are within
two bits of each other, are linked to the smallest by a grouped minimum. That finds the same
links without pairs. Components come from alternating star contraction.

A text without words has fingerprint zero, a null text too; both are linked like any other.
A null id belongs to its fingerprint's component but never names it. Rows that repeat are
returned each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import components, map_batches, stored, texts_of

SHINGLE = 3
SEED = 42
SEGMENT = 4
BITS = 2  # cells at distance 1 of both sides prove no more
CELL_LIMIT = 256
CHUNK = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the XXH64 of all word shingles, as an unsigned number."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # both know ASCII only
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    hash_of, join = xxhash.xxh64_intdigest, b" ".join
    shingles = zip(*(words[i:] for i in range(shingle)))
    hashes = np.array([hash_of(join(s), SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp``: the fingerprint of every text, as a signed long."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t) for t in texts_of(batch)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made.view(np.int64))], ["id", "fp"])

    return map_batches(df.selectExpr(f"`{id_col}` id", f"`{text_col}` text"), run, f"id {kind}, fp bigint")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def cells(fp: Column) -> Column:
    """The grid cell of a fingerprint and those at distance 1, each packed into a long."""
    counts = [
        F.bit_count(F.shiftrightunsigned(fp, i).bitwiseAND(F.lit((1 << SEGMENT) - 1))).cast("bigint")
        for i in range(0, 64, SEGMENT)
    ]
    width = SEGMENT.bit_length()
    own = sum((c * F.lit(1 << width * i) for i, c in enumerate(counts)), F.lit(0).cast("bigint"))
    beside = [
        F.when(c < SEGMENT if step > 0 else c > 0, own + F.lit(step * (1 << width * i)))
        for i, c in enumerate(counts)
        for step in (1, -1)
    ]
    return F.array_compact(F.array(own, *beside))


def smallest_reachable(near: np.ndarray) -> np.ndarray:
    """Of each member, the first one reachable by a symmetric matrix of links."""
    first = np.arange(len(near))
    while True:
        step = np.where(near, first, len(near)).min(axis=1)
        if (step == first).all():
            return first
        first = step


def _verified(groups: DataFrame) -> DataFrame:
    """Of lists ``fps, nodes`` of at most ``CELL_LIMIT`` members: a link ``a, b`` from each
    member to the first one that it reaches over links of ``BITS`` bits or fewer."""
    kind = groups.schema["nodes"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for fps, nodes in zip(batch.column("fps").to_pylist(), batch.column("nodes").to_pylist()):
                f = np.array(fps, dtype=np.int64).view(np.uint64)
                first = smallest_reachable(np.bitwise_count(f[:, None] ^ f) <= BITS)
                for i in np.flatnonzero(first != np.arange(len(f))).tolist():
                    left.append(nodes[i])
                    right.append(nodes[first[i]])
            type_ = batch.schema.field("nodes").type.value_type
            yield pa.RecordBatch.from_arrays([pa.array(left, type_), pa.array(right, type_)], ["a", "b"])

    return map_batches(groups, run, f"a {kind}, b {kind}")


def links(nodes: DataFrame) -> DataFrame:
    """Links ``a, b`` between the ids of different fingerprints ``fp, node``: they connect
    the same ids as all pairs that differ in ``BITS`` bits or fewer."""
    listed = nodes.select("fp", "node", F.explode(cells(F.col("fp"))).alias("cell"))
    sizes = listed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    # A fingerprint is listed up to 33 times, and 65 times below, which the optimizer's sizes leave
    # out: unless told it would copy all of a list to the driver and every executor.
    shared = stored(listed.join(sizes.hint("merge"), "cell"), "simhash-cells")
    lists = shared.where(F.col("n") <= CELL_LIMIT).groupBy("cell")
    pairs = _verified(
        lists.agg(F.collect_list("fp").alias("fps"), F.collect_list("node").alias("nodes")).select("fps", "nodes")
    )
    crowded = shared.where(F.col("n") > CELL_LIMIT).select("fp", "node").distinct()
    flips = [F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)]
    keyed = crowded.select("node", F.explode(F.array("fp", *flips)).alias("key"))
    first = keyed.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    stars = keyed.join(first.hint("merge"), "key").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return pairs.unionByName(stars).where("a <> b").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp, component``: the smallest id reachable over links of ``BITS`` bits or fewer."""
    made = stored(fingerprints(df, id_col, text_col), "simhash-fingerprints")
    nodes = made.groupBy("fp").agg(F.min("id").alias("node"))
    found = components(links(nodes.where("node IS NOT NULL")), "simhash-stars")
    # Files of ids and of few components are many times smaller than their rows.
    found = found.hint("merge")
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return made.join(named.hint("merge"), "fp").select("id", "fp", "component")
