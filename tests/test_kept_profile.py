"""A profile kept per file equals one of all files, and known files are not read again."""

import random
from datetime import datetime, timedelta

from basketmill.operators import profile
from basketmill.plans import kept_profile as K

SCHEMA = "n bigint, x double, t string, d timestamp_ntz, v array<int>"


def some_rows(seed, n):
    rnd = random.Random(seed)
    start = datetime(2025, 1, 1)
    return [(rnd.choice([None, rnd.randrange(5000)]), rnd.choice([None, 0.0, -0.0, rnd.gauss(1e6, 1)]), rnd.choice([None, "", "é" * rnd.randrange(40)]),
             start + timedelta(hours=rnd.randrange(9000)), rnd.choice([None, [], [1, None], [rnd.randrange(3)]])) for _ in range(n)]


def check(spark, path, book):
    df = spark.read.parquet(path)
    got = {r.column_name: r for r in K.kept_profile(spark, path, book).collect()}
    assert set(got) == set(df.columns)
    for r in profile.column_profile(df).collect():
        own = got[r.column_name]
        assert (own.null_count, own.null_ratio, own.type, own.row_count) == (r.null_count, r.null_ratio, r.type, df.count())
        assert abs(own.unique_count - r.unique_count) <= max(1, 0.05 * r.unique_count)
    for r in profile.numeric_summary(df).collect():
        own = got[r.column_name]
        assert (own.min, own.max) == (r.min, r.max)
        assert abs(own.mean - r.mean) < 1e-4 and abs(own.std - r.std) < 1e-4
    for r in profile.datetime_range(df).collect():
        assert (got[r.column_name].min_date, got[r.column_name].max_date) == (r.min_date, r.max_date)
    texts = {r.column_name: r for r in profile.text_summary(df).collect()}
    assert (got["t"].max_length, got["t"].avg_length) == (texts["t"].max_length, texts["t"].avg_length)


def test_files_are_added_changed_and_removed(spark, tmp_path):
    path, book = str(tmp_path / "data set"), str(tmp_path / "book")
    first = spark.createDataFrame(some_rows(1, 4000), SCHEMA).repartition(3)
    first.write.parquet(path)
    assert K.refresh(spark, path, book) == 3
    check(spark, path, book)
    assert K.refresh(spark, path, book) == 0
    spark.createDataFrame(some_rows(2, 900), SCHEMA).coalesce(1).write.mode("append").parquet(path)
    assert K.refresh(spark, path, book) == 1
    check(spark, path, book)
    # A file of the same name with other rows is read again; what it held before no longer counts.
    spark.createDataFrame(some_rows(3, 50), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "other"))
    (old, *_), (new,) = sorted((tmp_path / "data set").glob("part-*")), (tmp_path / "other").glob("part-*")
    old.write_bytes(new.read_bytes())
    (old.parent / f".{old.name}.crc").unlink(missing_ok=True)
    spark.catalog.refreshByPath(path)
    assert K.refresh(spark, path, book) == 1
    check(spark, path, book)


def test_a_column_that_older_files_lack_is_missing_there(spark, tmp_path):
    path, book = str(tmp_path / "data"), str(tmp_path / "book")
    spark.sql("SELECT 1 AS a").write.parquet(path)
    assert K.refresh(spark, path, book) == 1
    spark.sql("SELECT 2 AS a, 'x' AS b").write.mode("append").parquet(path)
    assert K.refresh(spark, path, book) == 1
    got = {r.column_name: r for r in K.kept_profile(spark, path, book).collect()}
    assert (got["b"].row_count, got["b"].null_count, got["a"].null_count) == (2, 1, 0)


def test_facts_that_were_added_twice_count_once(spark, tmp_path):
    path, book = str(tmp_path / "data"), str(tmp_path / "book")
    spark.range(100).coalesce(1).write.parquet(path)
    K.refresh(spark, path, book)
    copy = spark.createDataFrame(spark.read.parquet(book).collect(), spark.read.parquet(book).schema)
    copy.write.mode("append").parquet(book)
    row = K.kept_profile(spark, path, book).first()
    assert (row.row_count, row.null_count, row.mean, row.unique_count) == (100, 0, 49.5, 100)
