import json
from datetime import datetime

from basketmill.config import full_year_months, resolve_months
from basketmill.functions.time import month_minus, month_window, previous_months
from basketmill.operators import ranking, users
from basketmill.sources import tables


def test_months_roll_over_the_year():
    december = month_window("2025-12")
    assert (december.start, december.end) == (datetime(2025, 12, 1), datetime(2026, 1, 1))
    assert month_minus("2025-02", 3) == "2024-11"
    assert previous_months("2025-02", 3) == ["2024-11", "2024-12", "2025-01"]
    assert resolve_months("2025-10", "2025-11").train == ("2025-08", "2025-09")
    assert resolve_months("2025-10", "2025-11", ["2025-01"]).train == ("2025-01",)
    year = full_year_months("2026-01")
    assert (year.train[0], year.train[-1], year.validation) == ("2025-01", "2025-11", "2025-12")


def test_log_is_typed_and_needs_user_and_item(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.sql(
        "SELECT * FROM VALUES (1, 7, 11, TIMESTAMP_NTZ '2025-01-01 00:00:00', 2, 0, 1, 3, 'x'),"
        " (1, NULL, 11, TIMESTAMP_NTZ '2025-01-01 00:00:00', 2, 0, 1, 3, 'x'),"
        " (NULL, 8, NULL, TIMESTAMP_NTZ '2025-01-01 00:00:00', 2, 0, 1, 3, 'x') AS"
        " t(bill_id, customer_id, item_id, updated_date, price, discount, quantity, location, more)"
    ).write.parquet(path)
    log = tables.transactions(spark, path)
    assert [f.dataType.simpleString() for f in log.schema] == [
        "bigint", "bigint", "string", "timestamp_ntz", "double", "double", "double", "bigint",
    ]
    assert [tuple(r)[:3] for r in log.collect()] == [(1, 7, "11")]


def test_date_filter_reaches_the_scan(spark, log, tmp_path):
    path = str(tmp_path / "log")
    log([(1, 1, "a", "2025-01-01", 1.0, 0.0, 1.0, 1)]).write.parquet(path)
    before = users.history_before(tables.transactions(spark, path), datetime(2025, 2, 1))
    plan = before.select("item_id")._jdf.queryExecution().toString()
    assert "LessThan(updated_date" in plan.split("PushedFilters")[1]
    assert "price" not in plan.split("ReadSchema")[1]


def test_items_keep_the_smallest_copy(spark, tmp_path):
    path = str(tmp_path / "items")
    assert tables.items(spark, path) is None
    spark.sql(
        "SELECT * FROM VALUES ('a', 2.0, 'x', 'y', 'z', 'c', 'b', 1, 'four'),"
        " ('a', 1.0, 'x', 'y', 'z', 'c', NULL, 1, 'five!'), ('b', NULL, 'x', 'y', 'z', 'c', 'b', 1, NULL) AS"
        " t(item_id, price, category_l1, category_l2, category_l3, category, brand, sale_status, description)"
    ).write.parquet(path)
    rows = {r.item_id: r for r in tables.items(spark, path).collect()}
    assert (rows["a"].item_catalog_price, rows["a"].item_description_len) == (1.0, 5)
    assert rows["a"].brand is None and rows["b"].item_description_len is None


def test_truth_object_in_any_layout(spark, tmp_path):
    truth = {"1": ["a", "b c"], "22": [], "3": ["d{e}", "f,g"], "4": ['"q"', "é"]}
    for name, text in {
        "line": json.dumps(truth),
        "pretty": json.dumps(truth, indent=2),
        "entries": "{\n" + ",\n".join(f"{json.dumps(k)}: {json.dumps(v)}" for k, v in truth.items()) + "\n}",
    }.items():
        path = tmp_path / f"{name}.json"
        path.write_text(text)
        rows = tables.lists_from_json(spark, str(path)).collect()
        got = {u: [] for u in truth}
        for r in sorted(rows, key=lambda r: r.position or 0):
            got[r.user] += [r.item_id] if r.item_id is not None else []
        assert got == truth, name
        assert {r[0] for r in tables.users_from_truth(spark, str(path)).collect()} == {1, 22, 3, 4}
    brackets = tmp_path / "brackets.json"
    brackets.write_text(json.dumps({"1": ["a]b", "c"]}))
    rows = tables.lists_from_json(spark, str(brackets), brackets_in_ids=True).collect()
    assert [r.item_id for r in sorted(rows, key=lambda r: r.position)] == ["a]b", "c"]
    assert tables.users_from_truth(spark, str(tmp_path / "none.json")) is None


def test_lists_survive_the_file(spark, tmp_path):
    ranked = spark.createDataFrame(
        [(1, "b", 1), (1, "a", 2), (2, "c", 1)], "customer_id bigint, item_id string, rank int"
    )
    path = str(tmp_path / "lists")
    ranking.write_recommendations(ranking.as_lists(ranked), path)
    back = ranking.read_recommendations(spark, path)
    assert sorted(map(tuple, back.collect())) == [(1, "a", 2), (1, "b", 1), (2, "c", 1)]


def test_rekey_keeps_keys_that_are_no_numbers(spark):
    lists = spark.createDataFrame(
        [("12", 1, "a"), ("x9", 1, "b")], "user string, position int, item_id string"
    )
    rows = sorted(tuple(r) for r in ranking.rekey(lists).collect() if r.customer_id)
    assert rows == [(12, None, 1, "a")]
    other = [tuple(r) for r in ranking.rekey(lists).collect() if r.customer_id is None]
    assert other == [(None, "x9", 1, "b")]


def test_samples_are_exact_and_repeatable(spark):
    everyone = spark.range(1000).withColumnRenamed("id", "customer_id")
    first = {r[0] for r in users.sample_users(everyone, 137).collect()}
    again = {r[0] for r in users.sample_users(everyone.repartition(7), 137).collect()}
    assert len(first) == 137 and first == again
    assert users.sample_users(everyone, 5000).count() == 1000
