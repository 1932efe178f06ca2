"""Association, profiles and comparisons against pandas."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from basketmill.operators import association as A
from basketmill.operators import compare, frequent, profile


@pytest.fixture(scope="module")
def frame(spark):
    rnd = random.Random(8)
    rows = []
    for n in range(400):
        y = int(rnd.random() < 0.3)
        rows.append((y, 7.0, 0.0, float(y), float(rnd.choice([0, 1, 2, 3]) + y), float(n == 5),
                     None if n % 4 == 0 else float(n % 5)))
    names = ["label", "fixed", "zero", "perfect", "noisy", "rare", "gappy"]
    pdf = pd.DataFrame(rows, columns=names)
    df = spark.createDataFrame(rows, "label tinyint, " + ", ".join(f"{n} double" for n in names[1:]))
    return df, pdf


def test_association_matches_pandas(spark, frame):
    df, pdf = frame
    features = ("fixed", "zero", "perfect", "noisy", "rare", "gappy", "absent")
    rows = {r.feature: r for r in A.feature_report(df, features).collect()}
    assert set(rows) == set(features)
    y = pdf["label"].astype(float)
    for name in ("perfect", "noisy", "rare", "gappy"):
        x = pdf[name].fillna(0)
        assert rows[name].pearson == pytest.approx(x.corr(y))
        assert rows[name].spearman == pytest.approx(x.rank().corr(y))
        ranks, n1 = x.rank(), int(y.sum())
        area = (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))
        assert rows[name].auc_directionless == pytest.approx(max(area, 1 - area))
        assert rows[name].mean_delta == pytest.approx(x[y == 1].mean() - x[y == 0].mean())
        assert rows[name].nonzero_rate == pytest.approx((x != 0).mean())
        assert rows[name].unique_values == x.nunique()
        assert rows[name].positive_rate_when_nonzero == pytest.approx(y[x != 0].mean())
    assert rows["gappy"].null_rate == 0.25
    assert rows["perfect"].average_precision == pytest.approx(1.0)
    status = {f: rows[f].status for f in features}
    assert status["fixed"] == status["zero"] == "constant"
    assert status["perfect"] == "usable" and status["absent"] == "missing"
    gone = rows["absent"]
    assert (gone.null_rate, gone.auc_directionless, gone.unique_values, gone.ap_lift) == (1, 0.5, 0, 0)
    assert gone.global_positive_rate == pytest.approx(y.mean())
    counts = {r.status: r.features for r in A.status_counts(A.feature_report(df, features)).collect()}
    assert sum(counts.values()) == len(features) and counts["missing"] == 1


def test_status_rules_in_order(spark):
    columns = "feature string, unique_values int, nonzero_rate double, abs_pearson double, abs_spearman double, auc_lift double, positive_rate_lift double, ap_lift double"
    rows = [
        ("missing", 0, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0), ("constant", 1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0),
        ("all_zero", 2, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0), ("usable", 9, 0.5, 0.0, 0.01, 0.0, 0.0, -1.0),
        ("usable_sparse", 9, 0.0005, 0.0, 0.0, 0.0, -0.005, -1.0),
        ("too_sparse", 9, 0.0005, 0.0, 0.0, 0.0, 0.0, 0.0), ("weak_signal", 9, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0),
    ]
    for r in A.classify(spark.createDataFrame(rows, columns)).collect():
        assert r.status == r.feature


def test_report_file_is_sorted(spark, frame, tmp_path):
    report = A.feature_report(frame[0], ("fixed", "perfect", "noisy"))
    A.write_report(report, str(tmp_path / "report"))
    text = next((tmp_path / "report").glob("*.csv")).read_text().splitlines()
    assert text[0].startswith("feature,") and text[1].startswith("perfect,")
    assert [r.feature for r in A.usable_features(report, 1).collect()] == ["perfect"]
    assert "fixed" in [r.feature for r in A.features_to_inspect(report).collect()]


def test_profile_matches_pandas(spark):
    rnd = random.Random(2)
    pdf = pd.DataFrame({
        "n": [None if k % 9 == 0 else float(rnd.randrange(30)) for k in range(200)],
        "t": [None if k % 7 == 0 else rnd.choice(["a", "bb", "ccc", "é"]) for k in range(200)],
    })
    rows = [(None if np.isnan(n) else n, t) for n, t in zip(pdf["n"], pdf["t"])]
    df = spark.createDataFrame(rows, "n double, t string")
    columns = {r.column_name: r for r in profile.column_profile(df).collect()}
    assert columns["n"].null_count == pdf["n"].isna().sum()
    assert columns["n"].unique_count == pdf["n"].nunique() and columns["t"].unique_count == 4
    numbers = profile.numeric_summary(df).first()
    assert numbers.median == pdf["n"].median() and numbers["max"] == pdf["n"].max()
    assert numbers["std"] == pytest.approx(pdf["n"].std(), abs=1e-6)
    text = profile.text_summary(df).first()
    assert text.max_length == 3 and text.sample_values == "a, bb, ccc, é"
    top = [(r.value, r.n) for r in profile.top_values(df.select("t")).orderBy("rank").collect()]
    assert sorted(n for _, n in top) == sorted(pdf["t"].value_counts(dropna=False))
    over = profile.table_overview(df).first()
    assert over.duplicate_rows == pdf.duplicated().sum() and over.missing_cells == pdf.isna().sum().sum()
    assert [tuple(r) for r in profile.schema_table(df).collect()] == [
        ("n", "double", True), ("t", "string", True)]
    assert {tuple(r) for r in profile.type_distribution(df).collect()} == {("double", 1), ("string", 1)}


def test_empty_and_all_null_columns(spark):
    df = spark.createDataFrame([(None, None)], "n double, t string")
    text = profile.text_summary(df).first()
    assert (text.avg_length, text.max_length, text.sample_values) == (0, 0, None)
    assert profile.numeric_summary(df).first().median is None
    assert profile.table_overview(df.where("false")).first().row_count == 0


def test_comparison_by_position(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    left = [(n, f"i{n}") for n in range(100)]
    right = [(n + (n in (7, 50)), None if n in (9, 50) else f"i{n}") for n in range(100)]
    for path, rows in ((a, left), (b, right)):
        spark.createDataFrame(rows, "c bigint, i string").repartitionByRange(3, "c").sortWithinPartitions("c").write.parquet(path)
    one, two = (compare.with_row_index(spark, p) for p in (a, b))
    assert sorted(r.row_index for r in one.collect()) == list(range(100))
    counts = compare.positional_summary(one, two, "row_index", ["c", "i"]).first()
    assert (counts.total_rows, counts.matched_rows, counts.different_rows) == (100, 97, 3)
    sample = compare.positional_sample(one, two, "row_index", ["c", "i"]).collect()
    # A difference left open by a null is counted but not shown; row 50 also differs in c.
    assert [r.row_index for r in sample] == [7, 50]
    diff = compare.multiset_diff(one, two, ["c", "i"]).first()
    assert (diff.matched_rows, diff.only_left, diff.only_right) == (97, 3, 3)


def test_file_facts(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).repartition(2).write.parquet(path)
    files = profile.file_table(spark, path).collect()
    assert sum(f.row_count for f in files) == 10 and all(f.file_size > 0 for f in files)


def test_absent_kinds_of_columns_give_empty_frames(spark):
    texts = spark.createDataFrame([("a", [1.0])], "t string, v array<float>")
    numbers = spark.createDataFrame([(1,)], "n int")
    assert profile.numeric_summary(texts).collect() == []
    assert profile.datetime_range(texts).collect() == []
    assert profile.text_summary(numbers).collect() == []
    assert {r.column_name: r.unique_count for r in profile.column_profile(texts).collect()} == {"t": 1, "v": 1}
    for step in (profile.numeric_summary, profile.datetime_range, profile.text_summary):
        full = step(spark.createDataFrame([(1, "a", None)], "n int, t string, d timestamp_ntz"))
        assert step(texts).columns == full.columns or step(numbers).columns == full.columns


def test_approximate_profile(spark):
    df = spark.range(10_001).selectExpr("id", "id % 50 AS few")
    numbers = {r.column_name: r.median for r in profile.numeric_summary(df, approximate=True).collect()}
    assert abs(numbers["id"] - 5000) <= 5 and abs(numbers["few"] - 25) <= 1
    plan = profile.numeric_summary(df, approximate=True)._jdf.queryExecution().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
    unique = {r.column_name: r.unique_count for r in profile.column_profile(df, approximate=True).collect()}
    assert abs(unique["few"] - 50) <= 5 and abs(unique["id"] - 10_001) < 1_000


def test_null_counts_and_lengths_do_not_shuffle_texts(spark):
    df = spark.createDataFrame([("a" * 50, None), (None, 2)], "t string, n int")
    rows = {r.column_name: r for r in profile.column_profile(df).collect()}
    assert (rows["t"].null_count, rows["n"].null_count, rows["t"].null_ratio) == (1, 1, 0.5)
    assert profile.text_summary(df).first().avg_length == 50


def test_medians_by_radix_equal_sorted_middles(spark):
    """Signs, zeros, huge and tiny values, infinities, NaN, nulls, even and odd sizes."""
    rnd = random.Random(17)
    odd = [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf"), float("nan"), None]
    rows = []
    for i in range(1001):
        rows.append((rnd.gauss(0, 1e6), rnd.choice(odd), float(rnd.randrange(5)), -rnd.random() if i else None, None, rnd.choice([1.5, None]) if i < 3 else None, i, rnd.randrange(-3, 3)))
    df = spark.createDataFrame(rows, "a double, b double, c float, d double, e double, f double, g bigint, h int").repartition(7)
    got = {r.column_name: r.median for r in profile._medians(df, df.columns).collect()}
    for i, name in enumerate(df.columns):
        values = sorted((float(r[i]) for r in rows if r[i] is not None), key=lambda v: (v != v, v))
        if not values:
            assert got[name] is None
            continue
        want = (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
        assert got[name] == want or (want != want and got[name] != got[name])
    keys = profile.order_keys(np.array([-np.inf, -2.0, -5e-324, 0.0, 5e-324, 1.0, np.inf, np.nan]))
    assert (np.diff(keys.astype(object)) > 0).all() and profile.order_keys(np.array([-0.0])) == profile.order_keys(np.array([0.0]))


def plain_top(rows, k):
    counts = Counter(rows)
    return sorted(counts.items(), key=lambda e: (-e[1], e[0] is None, e[0] or ""))[:k]


@pytest.mark.parametrize("counters", [3, 20, 1024])
def test_frequent_values_are_exact_at_any_number_of_counters(spark, counters):
    """Skewed, flat, unique, long, missing and empty values; ties at the k-th place."""
    rnd = random.Random(5)
    long_a, long_b, edge = "x" * 70 + "a", "x" * 70 + "b", "y" * 64
    columns = {
        "skewed": [f"v{int(rnd.paretovariate(1.1))}" for _ in range(3000)],
        "flat": [f"v{i % 300}" for i in range(3000)],
        "unique": [f"v{i}" for i in range(3000)],
        "long": [rnd.choice([long_a, long_b, long_b, edge, "", None, f"u{i}"]) for i in range(3000)],
        "missing": [None] * 3000,
        "few": [rnd.choice("abc") for _ in range(3000)],
        "tied": [f"t{i % 12}" if i < 1200 else f"u{i}" for i in range(3000)],
    }
    schema = ", ".join(f"{c} string" for c in columns)
    df = spark.createDataFrame(list(zip(*columns.values())), schema).repartition(5)
    made = profile.top_values(df, 5, counters).collect()
    for name, values in columns.items():
        got = sorted((r.rank, r.value, r.n) for r in made if r.column_name == name)
        assert [(v, n) for _, v, n in got] == plain_top(values, 5), name


def test_frequent_values_shuffle_no_whole_column(spark):
    """Skewed columns are proven from the summaries, ids are counted in full."""
    rows = [(f"v{i % 7}" if i % 3 else f"r{i}", f"id{i}") for i in range(20_000)]
    texts = spark.createDataFrame(rows, "skewed string, id string").repartition(4)
    made, left = frequent.proven(texts, 5, 50)
    assert left == ["id"] and {r.n for r in made.where("column_name = 'skewed'").collect()} <= {1904, 1905}
    assert "hashpartitioning" not in made._jdf.queryExecution().toString()


def test_summary_counts_miss_at_most_the_cut(spark):
    rnd = random.Random(3)
    values = [f"v{int(rnd.paretovariate(0.7))}" for _ in range(40_000)]
    summary = frequent.Summary(16)
    for at in range(0, len(values), 500):
        summary.add(pa.array(values[at : at + 500]))
    table, counts = summary.shrink(), Counter(values)
    kept = dict(zip(table.column("value").to_pylist(), table.column("n").to_pylist()))
    assert len(kept) <= 16
    assert all(kept.get(v, 0) <= n <= kept.get(v, 0) + summary.cut for v, n in counts.items())
    assert summary.cut <= len(values) / 17


def test_distinct_values_and_repeated_rows_by_hashes(spark):
    rows = [(None, "a", [1, None], 0.0), ("a", None, [None, 1], -0.0), ("a", None, [None, 1], 0.0), ("ab", "c", [1], 1.0), ("a", "bc", None, None)]
    df = spark.createDataFrame(rows, "s string, t string, v array<int>, x double")
    unique = {r.column_name: r.unique_count for r in profile.column_profile(df).collect()}
    assert unique == {"s": 2, "t": 3, "v": 3, "x": 2}
    over = profile.table_overview(df).first()
    assert (over.row_count, over.column_count, over.missing_cells, over.duplicate_rows) == (5, 4, 5, 1)
    assert profile.top_values(df.select()).collect() == []
