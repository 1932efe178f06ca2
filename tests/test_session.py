"""Settings, scratch folders and run scopes."""

import os

import pytest

from basketmill import session

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


class NoMaster:
    """A session that names neither a master nor a shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default


def test_a_session_without_a_master_is_not_local():
    with pytest.raises(RuntimeError):
        session.scratch_dir(NoMaster)


def test_tune_leaves_the_shuffle_partitions_of_the_user(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        session.tune(spark, spark.range(10))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shuffles_start_from_the_bytes_of_the_inputs(spark, monkeypatch):
    before = spark.conf.get(INITIAL, None)
    try:
        table = spark.range(1 << 20)  # estimated at 8 MB
        monkeypatch.setattr(session, "PARTITION_BYTES", 1 << 16)
        session.tune(spark, table)
        assert spark.conf.get(INITIAL) == "128"
        session.tune(spark, spark.range(1))  # ours may change
        assert int(spark.conf.get(INITIAL)) == spark.sparkContext.defaultParallelism
        spark.conf.set(INITIAL, "33")  # a user's may not
        session.tune(spark, table)
        assert spark.conf.get(INITIAL) == "33"
    finally:
        spark.conf.unset("basketmill.initialPartitionNum")
        spark.conf.unset(INITIAL) if before is None else spark.conf.set(INITIAL, before)


def test_a_task_of_a_shuffle_gets_a_few_megabytes_of_files(spark):
    """A shuffle of 35 million rows of the log is 2.2 GB from 0.5 GB of files."""
    before = spark.conf.get(INITIAL, None)
    try:
        session.tune(spark, spark.range(1 << 26))  # estimated at 512 MB
        assert int(spark.conf.get(INITIAL)) >= 100
    finally:
        spark.conf.unset("basketmill.initialPartitionNum")
        spark.conf.unset(INITIAL) if before is None else spark.conf.set(INITIAL, before)


def test_scopes_nest_and_delete_only_their_own(spark):
    with session.run_scope(spark) as outer:
        kept = session.stored(spark.range(3), "outer")
        with session.run_scope(spark) as inner:
            session.stored(spark.range(3), "inner")
            assert len(os.listdir(inner)) == 1
        assert not os.path.exists(inner) and kept.count() == 3
        gone = session.Stored(spark.range(2), "gone")
        gone.discard()
        assert not os.path.exists(gone.path) and len(os.listdir(outer)) == 1
    assert not os.path.exists(outer)
    assert session.scratch_path(spark, "x").startswith(session.scratch_dir(spark))


def test_a_table_of_small_files_and_many_rows_is_not_copied_to_the_driver(spark, tmp_path):
    """2 MB of candidates were 213 MB as a broadcast."""
    path = str(tmp_path / "flags")
    spark.range(1 << 19).selectExpr("id % 8 AS a", "id % 4 AS b", "id").coalesce(1).write.parquet(path)
    size = sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith("parquet"))
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", INITIAL)}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(2 * size))
        flags = spark.read.parquet(path)
        plan = flags.join(flags.withColumnRenamed("b", "c"), "id")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
        # Partitions of shuffles still follow the bytes of the files.
        assert size / 2 < session._bytes(flags) < 2 * size
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
