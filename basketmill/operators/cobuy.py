"""How many bills two items share, and the best partners of each anchor item."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketmill.columns import BILL, ITEM
from basketmill.functions.relational import top_per
from basketmill.session import stored

ANCHOR, CO_ITEM, COUNT = "anchor_item", "co_item", "cobuy_count"

# Pairs for each line of the bills up to which they are joined as rows: ordinary bills.
PAIRS_PER_LINE = 32
# Tasks that the anchors are dealt over: one for so many pairs, up to a limit.
PAIRS_PER_PART, PARTS = 1_000_000, 256
# Pairs that are counted at once, besides those of the last anchor; one anchor's, which is
# counted in pieces if it has more.
PAIRS_PER_BATCH, PAIRS_PER_PIECE = 1_000_000, 4_000_000

Counts = tuple[np.ndarray, np.ndarray]


def numbered(values: DataFrame, column: str, label: str) -> DataFrame:
    """The distinct values with numbers ``no`` from 0 in their order."""
    in_order = values.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column)
    placed = stored(in_order.withColumn("_id", F.monotonically_increasing_id()), label)
    slices = placed.groupBy(F.shiftright("_id", 33).alias("_slice")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per slice.
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    sliced = placed.withColumn("_slice", F.shiftright("_id", 33))
    row = F.col("_id") - F.shiftleft("_slice", 33)
    return sliced.join(F.broadcast(offsets), "_slice").select(column, (row + F.col("_before")).cast("int").alias("no"))


def _counted(keys: np.ndarray, room: int) -> Counts:
    """The distinct keys, which are below ``room``, in order, and how often each occurs."""
    if room <= 2 * len(keys):
        n = np.bincount(keys, minlength=room)
        found = np.flatnonzero(n)
        return found, n[found]
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def _partners(top: int, items: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Counts the partners of a part's anchors in the part's bills, some million pairs at a time.
    Of an anchor that is there whole only the best are given."""

    def batches(own: pa.Table, bills: pa.Table) -> Iterator[pa.Table]:
        bills, own = bills.sort_by("bill_no"), own.sort_by([("no", "ascending"), ("piece", "ascending")])
        lists = bills["items"].combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy().astype("int64"))
        numbers, row = np.unique(bills["bill_no"].to_numpy(), return_index=True)
        start = np.concatenate(([0], ends))[row]
        size = np.diff(np.append(start, len(flat)))
        at = np.searchsorted(numbers, own["bill_no"].to_numpy())
        no, piece, whole = (own[c].to_numpy() for c in ("no", "piece", "whole"))
        new = np.concatenate(([True], (no[1:] != no[:-1]) | (piece[1:] != piece[:-1])))
        unit, head, load = np.cumsum(new) - 1, np.flatnonzero(new), size[at]
        # Whole units to a batch, by the pairs before them.
        pairs = np.add.reduceat(load, head)
        batch = (np.cumsum(pairs) - pairs) // PAIRS_PER_BATCH
        for units in np.split(np.arange(len(head)), np.flatnonzero(np.diff(batch)) + 1):
            rows = slice(head[units[0]], head[units[-1] + 1] if units[-1] + 1 < len(head) else len(no))
            n = load[rows]
            place = np.repeat(start[at[rows]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            room = len(units) * items
            kind = "int32" if room < 2**31 else "int64"
            keys = np.repeat(((unit[rows] - units[0]) * items).astype(kind), n) + flat[place]
            found, count = _counted(keys, room)
            ends = np.searchsorted(found, np.arange(1, len(units) + 1) * items)
            long = np.diff(ends, prepend=0)
            count[np.searchsorted(found, np.arange(len(units)) * items + no[head[units]])] = 0  # the anchor itself
            # Of those that occur once only the first can be among the best.
            once = count == 1
            before = np.cumsum(once) - once
            late = before - np.repeat(before[ends - long], long) >= top
            keep = np.flatnonzero((count > 1) | (once & ~(late & np.repeat(whole[head[units]], long))))
            if len(keep):
                of, count = np.searchsorted(ends, keep, side="right"), count[keep]
                partner = found[keep] - of * items
                # Stable: of equal counts the smaller number stays first.
                order = np.argsort(of * (count.max() + 1) + (count.max() - count), kind="stable")
                of, partner, count = of[order], partner[order], count[order]
                first = np.searchsorted(of, np.arange(len(units)))
                kept = (np.arange(len(of)) - first[of] < top) | ~whole[head[units]][of]
                yield pa.table({
                    "no": no[head[units]][of[kept]].astype("int32"),
                    "co_no": partner[kept].astype("int32"),
                    COUNT: count[kept].astype("int64"),
                })

    def counts(own: pa.Table, bills: pa.Table) -> pa.Table:
        empty = pa.schema([("no", pa.int32()), ("co_no", pa.int32()), (COUNT, pa.int64())]).empty_table()
        return pa.concat_tables([empty, *batches(own, bills)])

    return counts


def shared_bill_counts(
    baskets: DataFrame, anchors: DataFrame, top: int, pairs_per_chunk: int
) -> DataFrame:
    """The ``top`` partners of each anchor by shared bills, ties by item.

    ``baskets`` holds distinct (bill, item) rows with known bills, ``anchors``
    distinct items. Where the bills make a bounded number of pairs per line, pairs are rows
    that are summed up before the shuffle; else anchors are dealt over parts, and pairs are
    neither shuffled nor kept. Either way a bill travels in chunks: as many as its measured
    number of pairs asks for, one for an ordinary bill, so no row or task holds a whole large
    bill (a till's "no bill" number, say).
    """
    chosen = anchors.select(ITEM, F.lit(True).alias("is_anchor"))
    marked = stored(
        baskets.join(chosen, ITEM, "left").fillna(False, ["is_anchor"]).select(BILL, ITEM, "is_anchor"),
        "bill-lines",
    )
    sizes = marked.where(F.col(BILL).isNotNull() & F.col(ITEM).isNotNull()).groupBy(BILL).agg(
        F.count(F.lit(1)).alias("items"), F.count_if("is_anchor").alias("anchors")
    ).where("anchors > 0")
    lines, pairs = sizes.agg(
        F.coalesce(F.sum("items"), F.lit(0)), F.coalesce(F.sum(F.col("items") * F.col("anchors")), F.lit(0))
    ).first()
    if pairs <= PAIRS_PER_LINE * lines:
        counts = _pairs_as_rows(marked, sizes, pairs_per_chunk)
        order = [F.col(COUNT).desc(), F.col(CO_ITEM)]
        return top_per(counts, [ANCHOR], order, top, "_rank").drop("_rank")
    return _best_by_parts(marked, sizes, top, pairs_per_chunk, pairs)


def _pairs_as_rows(marked: DataFrame, sizes: DataFrame, pairs_per_chunk: int) -> DataFrame:
    """A chunk holds some anchors and all items of the bill."""
    chunks = F.greatest(F.ceil(F.col("items") * F.col("anchors") / F.lit(pairs_per_chunk)), F.lit(1))
    lines = marked.join(sizes.select(BILL, chunks.cast("int").alias("chunks")), BILL)
    own = lines.where("is_anchor").select(
        BILL,
        F.expr(f"CAST(pmod(xxhash64({ITEM}), chunks) AS INT) AS chunk"),
        F.col(ITEM).alias(ANCHOR),
    )
    others = lines.select(
        BILL, F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), F.col(ITEM).alias(CO_ITEM)
    )
    return (
        own.join(others, [BILL, "chunk"])
        .where(F.col(ANCHOR) != F.col(CO_ITEM))
        .groupBy(ANCHOR, CO_ITEM)
        .agg(F.count(F.lit(1)).alias(COUNT))
    )


def _best_by_parts(
    marked: DataFrame, sizes: DataFrame, top: int, pairs_per_chunk: int, pairs: int
) -> DataFrame:
    """Anchors are dealt over parts by a hash, and a bill's items are sent, as numbers, once to
    each part that has an anchor of the bill, in chunks that make some ``pairs_per_chunk``
    pairs there. A part counts all pairs of its anchors. An anchor with very many pairs is dealt
    by bills over several parts, whose counts are added up."""
    names = stored(numbered(marked.where(F.col(ITEM).isNotNull()), ITEM, "item-slices"), "item-numbers")
    bills = stored(sizes.withColumn("bill_no", F.monotonically_increasing_id()), "bills")
    lines = marked.join(names, ITEM).join(bills, BILL).select("bill_no", "no", "is_anchor", "items", "anchors")
    lines = stored(lines, "wanted-lines")
    own = lines.where("is_anchor")
    parts = min(PARTS, 1 + pairs // PAIRS_PER_PART)
    pieces = own.groupBy("no").agg(F.ceil(F.sum("items") / F.lit(PAIRS_PER_PIECE)).cast("int").alias("pieces"))
    piece = F.pmod(F.xxhash64("bill_no"), F.col("pieces")).cast("int")
    dealt = own.join(pieces, "no").withColumn("piece", piece).select(
        F.pmod(F.xxhash64("no", "piece"), F.lit(parts)).cast("int").alias("part"),
        "bill_no", "no", "piece", (F.col("pieces") == 1).alias("whole"),
    )
    dealt = stored(dealt, "anchor-lines")
    to = dealt.groupBy("bill_no").agg(F.collect_set("part").alias("parts"))
    chunks = F.ceil(F.col("items") * F.col("anchors") / (F.size("parts") * F.lit(pairs_per_chunk)))
    chunk = F.pmod(F.xxhash64("no"), F.greatest(F.least(chunks, F.col("items")), F.lit(1)))
    sent = (
        lines.join(to, "bill_no")
        .groupBy("bill_no", "parts", chunk.alias("chunk"))
        .agg(F.collect_list("no").alias("items"))
        .select(F.explode("parts").alias("part"), "bill_no", "items")
    )
    counts = dealt.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(
        _partners(top, names.count()), f"no int, co_no int, {COUNT} bigint"
    )
    added = counts.groupBy("no", "co_no").agg(F.sum(COUNT).alias(COUNT))
    best = top_per(added, ["no"], [F.col(COUNT).desc(), F.col("co_no")], top, "_rank")
    named = best.join(names.select("no", F.col(ITEM).alias(ANCHOR)), "no")
    partner = names.select(F.col("no").alias("co_no"), F.col(ITEM).alias(CO_ITEM))
    return named.join(partner, "co_no").select(ANCHOR, CO_ITEM, COUNT)
