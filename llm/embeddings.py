"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations.

A table of buckets rotates each unit vector by random signs and Hadamard transforms, three
times over, and takes the nearest of the signed axes; a few such axes name a bucket, as many
as leave few vectors of no relation in one (``shape``). A vector is listed in its own bucket
and, as probes, in those where one axis is replaced by the next best one, nearest first.
Vectors that share a bucket in any of the tables are candidates, and their cosine is verified
in double precision. More axes mean more tables, so that pairs are found as surely.

Equal vectors are one node from the start. A pair is counted in the first bucket that it shares
only, so no pair is ever listed: a bucket gives, for each of its nodes, how many others it
links with and one link to the smallest node in reach. A bucket of more than ``BLOCK`` nodes
is dealt out by pairs of blocks, so no task holds a whole hot bucket, though all its pairs are
verified: exact counts of links need that.

Vectors of different lengths have no cosine: each length is hashed and linked on its own.
Vectors that are null, empty, all zero or with null or non-finite components link with nothing,
not even with equal ones. Null ids are allowed: they are counted as links, but name no
component. Rows that repeat an id are vectors of their own. Other columns are ignored; an
empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import components, map_batches, stored

COSINE = 0.95
PROBES = 2
BLOCK = 512
IN_BUCKET = 4  # vectors of no relation that an average bucket may hold
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    width = x.shape[1]
    half = 1
    while half < width:
        parts = x.reshape(len(x), -1, 2, half)
        x = np.stack([parts[:, :, 0] + parts[:, :, 1], parts[:, :, 0] - parts[:, :, 1]], axis=2).reshape(len(x), width)
        half *= 2
    return x / np.sqrt(width)


def shape(width: int, vectors: int) -> tuple[int, int]:
    """How many axes name a bucket of ``vectors`` of that padded width, and how many tables there
    are. Tables double with each axis, which keeps the recall at a cosine of 0.95 above 0.99."""
    hashes = 2
    while IN_BUCKET * (2 * width) ** hashes < vectors:
        hashes += 1
    return hashes, 2 << hashes


class Buckets:
    """The buckets of unit vectors of one dimension in a table of ``vectors``."""

    def __init__(self, dim: int, vectors: int = 1):
        self.width = 1 << max(1, (dim - 1).bit_length())
        self.hashes, self.tables = shape(self.width, vectors)
        rng = np.random.default_rng(SEED)
        self.signs = rng.choice([-1.0, 1.0], size=(self.tables, self.hashes, 3, self.width))
        # Numbers wrap around where they do not fit; buckets that meet so are verified as any.
        self.power = np.cumprod([1] + [2 * self.width] * (self.hashes - 1), dtype=np.int64)

    def of(self, unit: np.ndarray) -> np.ndarray:
        """Bucket numbers (vectors, tables, probes), the own bucket first."""
        n = len(unit)
        padded = np.zeros((n, self.width))
        padded[:, : unit.shape[1]] = unit
        out = np.empty((n, self.tables, PROBES), dtype=np.int64)
        at = np.arange(n)
        for t in range(self.tables):
            own = np.full(n, t, dtype=np.int64)
            loss, change = [], []
            for signs_of, power in zip(self.signs[t], self.power):
                x = padded
                for signs in signs_of:
                    x = hadamard(x * signs)
                size = np.abs(x)
                order = np.argpartition(-size, 1, axis=1)[:, :2]
                top = np.take_along_axis(size, order, axis=1)
                swap = top[:, 0] < top[:, 1]
                order[swap] = order[swap][:, ::-1]
                axes = 2 * order + (np.take_along_axis(x, order, axis=1) < 0)
                step = self.tables * power
                own += axes[:, 0] * step
                loss.append(np.abs(top[:, 0] - top[:, 1]))
                change.append((axes[:, 1] - axes[:, 0]) * step)
            out[:, t, 0] = own
            by_loss = np.argsort(np.stack(loss, axis=1), axis=1, kind="stable")
            changes = np.stack(change, axis=1)
            for probe in range(1, PROBES):
                out[:, t, probe] = own + changes[at, by_loss[:, probe - 1]]
        return out


def _by_length(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each length but 0: the places of its vectors, and these as rows; null is NaN."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[lengths > 0]):
        places = np.flatnonzero(lengths == dim)
        flat = vectors.take(pa.array(places)).flatten().cast(pa.float64())
        yield places, flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; neither squares nor sums overflow."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x**2).sum(axis=1))[:, None]


def keyed(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, key``: a digest of the components, null for a vector that links with nothing."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes | None] = [None] * batch.num_rows
            for places, x in _by_length(batch.column("vector")):
                good = np.isfinite(x).all(axis=1) & x.any(axis=1)
                for at, row in zip(places[good].tolist(), x[good] + 0.0):
                    keys[at] = hashlib.blake2b(row.tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary())], ["id", "key"])

    return map_batches(df.selectExpr(f"`{id_col}` id", f"`{vector_col}` vector"), run, f"id {kind}, key binary")


def bucketed(nodes: DataFrame, vectors: int) -> DataFrame:
    """``node, copies, vector, buckets``: with the bucket numbers of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Buckets] = {}
        for batch in batches:
            buckets: list[np.ndarray | None] = [None] * batch.num_rows
            for places, x in _by_length(batch.column("vector")):
                dim = x.shape[1]
                if dim not in hashers:
                    hashers[dim] = Buckets(dim, vectors)
                hasher = hashers[dim]
                for at in range(0, len(x), 500):
                    lists = hasher.of(_unit(x[at : at + 500])).reshape(-1, hasher.tables * PROBES)
                    for place, numbers in zip(places[at : at + 500].tolist(), lists):
                        buckets[place] = numbers
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("node", "copies", "vector")), pa.array(buckets, pa.list_(pa.int64()))],
                ["node", "copies", "vector", "buckets"],
            )

    kind = nodes.schema["vector"].dataType.simpleString()
    return map_batches(
        nodes.select("node", "copies", "vector"), run, f"node bigint, copies bigint, vector {kind}, buckets array<bigint>"
    )


def _first_shared(nodes: np.ndarray, buckets: np.ndarray, bucket: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the pairs (i, j) share no bucket before ``bucket``, in the order of the list of the
    smaller node."""
    out = np.empty(len(i), dtype=bool)
    for at in range(0, len(i), 1 << 16):
        one, two = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        swap = nodes[one] > nodes[two]
        lead, rest = buckets[np.where(swap, two, one)], buckets[np.where(swap, one, two)]
        earliest = np.full(len(one), -1, dtype=np.int64)
        open_ = np.arange(len(one))
        for p in range(lead.shape[1]):
            hit = (lead[open_, p : p + 1] == rest[open_]).any(axis=1)
            earliest[open_[hit]] = lead[open_[hit], p]
            open_ = open_[~hit]
        out[at : at + (1 << 16)] = earliest == bucket[one]
    return out


def _forest(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between places of ``nodes``: each node and the smallest node in its reach."""
    reach = nodes.copy()
    while True:
        step = reach.copy()
        np.minimum.at(step, i, reach[j])
        np.minimum.at(step, j, reach[i])
        if (step == reach).all():
            break
        reach = step
    moved = reach != nodes
    return nodes[moved], reach[moved]


GROUP = ["dim", "bucket", "low", "high"]


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches sorted by ``GROUP``, cut between groups: a table and where its groups start and end.
    Holds a batch and one group."""
    carry: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if carry is None else pa.concat_tables([carry, table])
        edges = _edges(table)
        if len(edges) > 2:
            yield table.slice(0, edges[-2]), edges[:-1]
        carry = table.slice(edges[-2])
    if carry is not None:
        yield carry, _edges(carry)


def _edges(table: pa.Table) -> np.ndarray:
    change = np.zeros(table.num_rows - 1, dtype=bool)
    for column in GROUP:
        values = table.column(column).to_numpy()
        change |= values[1:] != values[:-1]
    return np.r_[0, np.flatnonzero(change) + 1, table.num_rows]


def _near(table: pa.Table, edges: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the same group that are near: inside a block, or of one with the other."""
    low, high, block, dims = (table.column(c).to_numpy() for c in ("low", "high", "block", "dim"))
    vectors = table.column("vector").combine_chunks()
    ones, others = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at = 0
    while at < len(edges) - 1:  # groups of one length
        upto = int(np.searchsorted(edges, np.searchsorted(dims, dims[edges[at]], side="right")))
        base, end = int(edges[at]), int(edges[upto])
        flat = vectors.slice(base, end - base).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        unit = _unit(flat.reshape(end - base, -1))
        for start, stop in zip((edges[at:upto] - base).tolist(), (edges[at + 1 : upto + 1] - base).tolist()):
            if low[base + start] == high[base + start]:
                i, j = np.nonzero(np.triu(unit[start:stop] @ unit[start:stop].T >= cosine, 1))
                cut = start
            else:
                cut = start + int((block[base + start : base + stop] == low[base + start]).sum())
                i, j = np.nonzero(unit[start:cut] @ unit[cut:stop].T >= cosine)
            if len(i):
                ones.append(i + (base + start))
                others.append(j + (base + cut))
        at = upto
    return np.concatenate(ones), np.concatenate(others)


def near_links(nodes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """From ``node, vector, copies``: rows ``a, b, n``. ``n`` is how many vectors ``a`` links
    with in one bucket (0 in rows of links only); ``b`` is a node it is connected to."""
    made = stored(bucketed(nodes, nodes.count()), "vector-buckets")
    each = made.select("node", F.size("vector").alias("dim"), F.explode("buckets").alias("bucket"))
    sizes = each.groupBy("dim", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    # Only numbers are joined to sizes; the vectors are attached last and dealt out once.
    split = (
        each.join(sizes, ["dim", "bucket"])
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("dim", "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node")
        .join(made, "node")
    )
    dealt = split.repartition(*GROUP).sortWithinPartitions(*GROUP, "block", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _whole_groups(batches):
            i, j = _near(table, edges, cosine)
            if not len(i):
                continue
            # Only rows with a partner go on; the others would be most of them.
            some, places = np.unique(np.r_[i, j], return_inverse=True)
            i, j = places[: len(i)], places[len(i) :]
            table = table.take(pa.array(some))
            node, copies, bucket = (table.column(c).to_numpy() for c in ("node", "copies", "bucket"))
            lists = table.column("buckets").combine_chunks()
            n = np.zeros(len(some), dtype=np.int64)
            counted = np.zeros(len(i), dtype=bool)
            widths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            for width in np.unique(widths):  # lengths of vectors may differ in their tables
                rows = np.flatnonzero(widths == width)
                own = np.zeros(len(some), dtype=np.int64)
                own[rows] = np.arange(len(rows))
                numbers = lists.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), width)
                mine = np.flatnonzero(widths[i] == width)
                counted[mine] = _first_shared(node[rows], numbers, bucket[rows], own[i[mine]], own[j[mine]])
            i, j = i[counted], j[counted]
            np.add.at(n, i, copies[j])
            np.add.at(n, j, copies[i])
            a, b = _forest(node, i, j)
            linked = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[node[linked], a]),
                    pa.array(np.r_[node[linked], b]),
                    pa.array(np.r_[n[linked], np.zeros(len(a), np.int64)]),
                ],
                ["a", "b", "n"],
            )

    return map_batches(dealt, run, "a bigint, b bigint, n bigint")


def near_duplicates(df: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, n_links, component``; ids are longs."""
    base = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"))
    made = stored(base.withColumn("row", F.monotonically_increasing_id()), "vectors")
    keys = stored(keyed(made.select("row", "vector"), "row", "vector").withColumnRenamed("id", "row"), "vector-keys")
    groups = stored(
        keys.where("key IS NOT NULL").groupBy("key").agg(F.min("row").alias("node"), F.count("*").alias("copies")),
        "vector-nodes",
    )
    nodes = groups.join(made.select(F.col("row").alias("node"), "vector"), "node").select("node", "vector", "copies")
    found = stored(near_links(nodes, cosine), "vector-links")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    reach = components(found.select("a", "b"), "vector-stars")
    members = (
        made.select("row", "id")
        .join(keys, "row", "left")
        .join(groups, "key", "left")
        .join(counts, "node", "left")
        .join(reach, "node", "left")
        .withColumn("root", F.coalesce("component", "node"))
        .select("id", "root", "copies", "others")
    )
    smallest = members.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("smallest"))
    return members.join(smallest, "root", "left").select(
        "id",
        F.when(F.col("root").isNull(), F.lit(0)).otherwise(F.col("copies") - 1 + F.coalesce("others", F.lit(0))).cast("bigint").alias("n_links"),
        F.coalesce("smallest", "id").alias("component"),
    )
