"""Merkle manifest of a dataset: a content-addressed DAG, and proofs by descent from its root.

Every row is a leaf: the SHA-256 of its columns. The leaves of a language ascend by id; runs of
eight nodes become one until one is left, the subroot; subroots, by language, become the
root in the same way. What is stored is one record per node: its digest and those of its
children. Equal nodes have one record.

A proof is found from the top. The request of a leaf is its rank; written with base-8 digits, the
rank names the child to take at each level. The children that are not taken are collected, those
to the left and to the right of the one taken, as one segment of a path; at the leaf the
path is reversed, as a proof is read from the leaf to the root. Requests that go through the
same node descend together: a level holds a row per node that some request goes through,
never one per request, and finds its children by a join on the digest. A run of requests parts only
at its leaf, where hashing up the path needs no further shuffle.

Ranks come from a range partitioning by language, id and digest, so one language may span many
tasks; a task numbers its rows, and the totals of the tasks before give the offset. Groups
hold eight digests at most. Rows that are equal in everything, ids included, are dealt by a stored
row number, so a large group of them is many tasks too.

All work is column expressions. Digests are hex text. A null id comes first in its language, a
null language first of all; rows that repeat are a leaf each and tie by digest, where they are
interchangeable. Texts of any length are hashed whole. An empty table has no root and no rows. Columns
besides the named ones take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import stored

WIDTH = 8
SEGMENT = "struct<left:string,right:string>"
ALL = "all"  # the one key of the tree above the subroots


def digest(*parts: Column) -> Column:
    """SHA-256 of texts put together, in lower-case hex."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """A value as it enters a leaf: its UTF-8 size, a colon, its text; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: Sequence[Column]) -> Column:
    return digest(*[framed(c) for c in columns])


def key_of(group: Column) -> Column:
    """A group as a text that is never null and sorts like it, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


# --- ranks ---------------------------------------------------------------------------------


def ranked(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``rank`` (from 0) by ``order`` within ``key``, and ``size``, the rows of the key.

    ``nodes`` is a stored table."""
    dealt = nodes.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    numbered = stored(
        dealt.withColumn("slice", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()),
        "merkle-ranked",
    )
    slices = numbered.groupBy("key", "slice").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("key").orderBy("slice")
    offsets = slices.select(
        "key",
        "slice",
        (F.sum("rows").over(before) - F.col("rows") - F.col("first")).alias("offset"),
        F.sum("rows").over(Window.partitionBy("key")).alias("size"),
    )
    placed = numbered.join(offsets, ["key", "slice"])
    return placed.withColumn("rank", F.col("row") + F.col("offset")).drop("slice", "row", "offset")


# --- the DAG -------------------------------------------------------------------------------


@dataclass
class Forest:
    """Trees by key. ``levels[h]`` holds the records ``digest, children`` of the nodes of height
    ``h + 1``; ``tops`` one row ``key, digest, height`` per key."""

    levels: list[DataFrame]
    tops: DataFrame


def grown(nodes: DataFrame) -> Forest:
    """From ``key, rank, size, digest``, the nodes at the bottom, one tree per key."""
    current, height, levels, tops = nodes.select("key", "rank", "size", "digest"), 0, [], []
    while True:
        tops.append(current.where("size = 1").select("key", "digest", F.lit(height).alias("height")))
        runs = current.where("size > 1").groupBy(
            "key", F.expr(f"rank DIV {WIDTH}").alias("rank"), F.expr(f"(size + {WIDTH - 1}) DIV {WIDTH}").alias("size")
        )
        children = F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda c: c["digest"])
        made = stored(
            runs.agg(children.alias("children")).withColumn("digest", digest(F.array_join("children", ""))),
            f"merkle-level-{height}",
        )
        if made.isEmpty():
            break
        levels.append(made.select("digest", "children").dropDuplicates(["digest"]))
        current, height = made.select("key", "rank", "size", "digest"), height + 1
    out = tops[0]
    for more in tops[1:]:
        out = out.unionByName(more)
    return Forest(levels, out)


# --- descent -------------------------------------------------------------------------------


def segment(children: Column, place: Column) -> Column:
    """The children beside the one at ``place`` (from 0), as texts to its left and right."""
    left = F.array_join(F.slice(children, F.lit(1), place), "")
    right = F.array_join(F.slice(children, place + 2, F.lit(WIDTH)), "")
    return F.struct(left.alias("left"), right.alias("right"))


def descended(forest: Forest, start: DataFrame, requests: DataFrame | None, to: int) -> DataFrame:
    """Go from the tops down to the nodes of height ``to``: ``key, rank, digest, path`` and what
    else ``start`` holds by ``key``.

    ``start`` gives the path above each top. ``requests`` holds ``key, rank`` of the leaves that
    are sought; None seeks all. Paths are arrays of segments from the top down."""
    carried = [c for c in start.columns if c not in ("key", "path")]
    entered = forest.tops.join(start, "key").withColumn("rank", F.lit(0).cast("bigint"))
    current = None
    for height in range(len(forest.levels), to - 1, -1):
        here = entered.where(F.col("height") == height).select("key", "rank", "digest", "path", *carried)
        if current is not None:
            steps = current.join(forest.levels[height], "digest").select(
                "key", "path", *carried, F.col("rank").alias("above"), "children", F.posexplode("children").alias("place", "digest")
            )
            taken = steps.select(
                "key",
                (F.col("above") * WIDTH + F.col("place")).alias("rank"),
                "digest",
                F.concat("path", F.array(segment(F.col("children"), F.col("place")))).alias("path"),
                *carried,
            )
            here = here.unionByName(taken)
        if requests is not None:
            wanted = requests.select("key", F.expr(f"rank DIV {WIDTH**height}").alias("rank")).distinct()
            here = here.join(wanted, ["key", "rank"], "left_semi")
        current = stored(here, f"merkle-descent-{height}") if height else here
    return current


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the segments of its path, from the leaf up."""
    return F.aggregate(path, leaf, lambda below, s: digest(s["left"], below, s["right"]))


def siblings_digest(path: Column) -> Column:
    """SHA-256 of all siblings, level by level from the leaf up, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


@dataclass
class Manifest:
    """The stored DAG of a table.

    ``leaves`` holds ``key, rank, id, digest, other`` (a second leaf digest per row, or null);
    ``by_key`` the trees of the groups, ``above`` the tree over their subroots (``members``)."""

    leaves: DataFrame
    by_key: Forest
    above: Forest
    members: DataFrame
    root: str | None

    def proofs(self, requests: DataFrame | None = None) -> DataFrame:
        """``id, leaf, other, subroot, root, path``, a row for each leaf that is sought.

        ``requests`` holds ``key, rank``; None seeks all leaves. ``path`` runs from the leaf up."""
        top = self.above.tops.select("key").withColumn("path", F.array().cast(f"array<{SEGMENT}>"))
        sought = None if requests is None else self.members.join(requests.select("key").distinct(), F.col("name") == F.col("key"), "left_semi")
        above = descended(self.above, top, None if sought is None else sought.select(F.lit(ALL).alias("key"), "rank"), 0)
        places = self.members.select(F.col("name"), "rank", F.col("digest").alias("subroot"))
        start = above.join(places, "rank").select(F.col("name").alias("key"), "path", "subroot")

        leaves = self.leaves
        if requests is not None:
            leaves = leaves.join(requests.select("key", "rank"), ["key", "rank"], "left_semi")
        # One digit is left at height 1: the place in the run, found beside its leaves.
        runs = leaves.groupBy("key", F.expr(f"rank DIV {WIDTH}").alias("run")).agg(
            F.collect_list(F.struct("rank", "id", F.col("digest").alias("leaf"), "other")).alias("leaves")
        )
        alone = self.by_key.tops.where("height = 0").join(start, "key").select(
            "key", F.lit(0).cast("bigint").alias("run"), F.array("digest").alias("children"), "path", "subroot", F.lit(True).alias("top")
        )
        parents = alone
        if self.by_key.levels:
            nodes = descended(self.by_key, start, requests, 1)
            parents = alone.unionByName(
                nodes.join(self.by_key.levels[0], "digest").select(
                    "key", F.col("rank").alias("run"), "children", "path", "subroot", F.lit(False).alias("top")
                )
            )
        each = runs.join(parents, ["key", "run"]).select("children", "path", "subroot", "top", F.explode("leaves").alias("at"))
        place = (F.col("at.rank") % WIDTH).cast("int")
        last = F.when(F.col("top"), F.array().cast(f"array<{SEGMENT}>")).otherwise(F.array(segment(F.col("children"), place)))
        return each.select(
            "at.id",
            "at.leaf",
            "at.other",
            "subroot",
            F.lit(self.root).cast("string").alias("root"),
            F.reverse(F.concat("path", last)).alias("path"),
        )


def manifest(leaves: DataFrame) -> Manifest:
    """The DAG over ``id, grouping, digest, other``: a leaf per row, a tree per ``grouping``."""
    salted = leaves.select(
        key_of(F.col("grouping")).alias("key"), "id", "digest", "other", F.monotonically_increasing_id().alias("salt")
    )
    base = stored(ranked(stored(salted, "merkle-leaves"), ["id", "digest", "salt"]).drop("salt"), "merkle-placed")
    by_key = grown(base)
    by_key.tops = stored(by_key.tops, "merkle-subroots")
    subroots = stored(by_key.tops.select(F.lit(ALL).alias("key"), F.col("key").alias("name"), "digest"), "merkle-names")
    members = stored(ranked(subroots, ["name"]), "merkle-members")
    above = grown(members)
    top = above.tops.first()
    return Manifest(base, by_key, above, members.select("name", "rank", "digest"), top.digest if top else None)
