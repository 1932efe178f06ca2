"""Lists as files: one JSON object over many part files, and runs that resume part by part."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketmill.columns import ITEM, USER
from basketmill.operators.ranking import RECOMMENDATIONS
from basketmill.session import run_scope, stored
from basketmill.sources.tables import path_exists

PARTS = 32


def write_object(lists: DataFrame, path: str, key: str = USER, files: int | None = None) -> None:
    """``{"user": ["item", ...], ...}``: one object, written in parallel.

    The part files hold ranges of keys and, one after the other in the order of their names,
    are the object; each is read on its own by ``lists_from_json``. ``lists`` has one row per
    key, which is not null. Without rows the object is ``{}``. There are as many files as the
    bytes ask for, or at most ``files``.
    """
    named = F.to_json(F.create_map(F.col(key).cast("string"), F.col("items")))
    entry = F.substring("_object", F.lit(2), F.length("_object") - 2)
    rows = lists.select(F.col(key).cast("string").alias("key"), named.alias("_object"))
    entries = stored(rows.select("key", entry.alias("entry")), "entries")
    ends = entries.agg(F.min("key").alias("first"), F.max("key").alias("last")).first()
    if ends["first"] is None:
        lines = entries.sparkSession.createDataFrame([("{}",)], "value string").coalesce(1)
    else:
        opening = F.when(F.col("key") == ends["first"], "{").otherwise(",")
        closing = F.when(F.col("key") == ends["last"], "}").otherwise("")
        number = () if files is None else (files,)
        in_order = entries.repartitionByRange(*number, "key").sortWithinPartitions("key")
        lines = in_order.select(F.concat(opening, "entry", closing).alias("value"))
    lines.write.mode("errorifexists").text(path)


def _part_of(user: str, parts: int):
    return F.pmod(F.xxhash64(user), F.lit(parts))


def _finished(spark: SparkSession, path: str) -> list[int]:
    done = f"{path}/done"
    if not path_exists(spark, done):
        return []
    return sorted(r.part for r in spark.read.schema("part int").parquet(done).distinct().collect())


def _same_run(spark: SparkSession, path: str, run: str) -> None:
    """Note down which run the folder is of; another one's folder is an error."""
    note = f"{path}/run"
    if path_exists(spark, note):
        known = [r.value for r in spark.read.text(note).collect()]
        if known == [run]:
            return
        if known:
            raise ValueError(f"{path} holds another run: {known[0]!r}, not {run!r}")
    spark.createDataFrame([(run,)], "value string").coalesce(1).write.mode("overwrite").text(note)


def write_in_parts(
    users: DataFrame,
    make: Callable[[DataFrame], DataFrame],
    path: str,
    parts: int = PARTS,
    tag: str = "",
    at_most: int | None = None,
) -> int:
    """Lists of all ``users``, made and written part by part; how many parts are left.

    Users (distinct) are dealt over ``parts`` by a hash. ``make`` turns the users of a part into
    their lists (``customer_id, items``). A part counts once its files are complete and it is
    noted as done; a run that died is called again with the same arguments, writes over what it
    left half done and makes no finished part twice. ``tag`` names what the lists are (month,
    scorer): another tag, other users or another number of parts in the same folder is an
    error. ``at_most`` parts are made in this call.
    """
    spark = users.sparkSession
    users = stored(users.select(USER), "users")
    mark = users.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(USER)).alias("h")).first()
    _same_run(spark, path, f"{tag}|{parts}|{mark.n}|{mark.h}")
    done = set(_finished(spark, path))
    todo = [p for p in range(parts) if p not in done]
    for part in todo[:at_most]:
        with run_scope(spark):
            lists = make(users.where(_part_of(USER, parts) == part))
            lists.select(USER, "items").write.mode("overwrite").json(f"{path}/lists/part={part}")
        spark.createDataFrame([(part,)], "part int").coalesce(1).write.mode("append").parquet(f"{path}/done")
    return len(todo) - len(todo[:at_most])


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """The finished parts as (user, item, rank)."""
    paths = [f"{path}/lists/part={p}" for p in _finished(spark, path)]
    if not paths:
        return spark.createDataFrame([], f"{USER} bigint, {ITEM} string, rank int")
    lists = spark.read.schema(RECOMMENDATIONS).json(paths)
    rows = lists.select(USER, F.posexplode("items").alias("rank", ITEM))
    return rows.select(USER, ITEM, (F.col("rank") + 1).alias("rank"))
