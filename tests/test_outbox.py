"""One JSON object over many files and splits; runs that resume."""

import json
import random

import pytest
from pyspark.sql import functions as F

from basketmill.config import CandidateParams, RunParams
from basketmill.operators import outbox
from basketmill.plans import monthly
from basketmill.sources import tables

ODD = ["a]b", '"', "\\", "\\\\]", '],"x":["y', "[", "é]", "", "]]]", '\\"]', "plain"]


def read_back(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r.user, r.position or 0)):
        got.setdefault(r.user, [])
        got[r.user] += [r.item_id] if r.item_id is not None else []
    return got


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_brackets_in_ids_at_any_split(spark, tmp_path, split):
    """Splits begin inside ids, between a backslash and a quote, and inside long ids."""
    rnd = random.Random(9)
    truth = {f"u]{n}" if n % 3 else str(n): [rnd.choice(ODD) for _ in range(rnd.randrange(4))] for n in range(40)}
    truth["long"] = ["]" * 90 + '"', "x" * 200]
    for name, indent in (("line", None), ("pretty", 1)):
        (tmp_path / f"{name}.json").write_text(json.dumps(truth, indent=indent, ensure_ascii=name == "line"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        for name in ("line", "pretty"):
            rows = tables.lists_from_json(spark, str(tmp_path / f"{name}.json"), brackets_in_ids=True).collect()
            assert read_back(rows) == truth, name
        both = tables.lists_from_json(spark, str(tmp_path / "*.json"), brackets_in_ids=True)
        assert both.where("item_id IS NOT NULL").count() == 2 * sum(map(len, truth.values()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_object_in_part_files(spark, tmp_path):
    truth = {str(n): [f"i{n}", ODD[n % len(ODD)]][: n % 3] for n in range(200)}
    lists = spark.createDataFrame(list(truth.items()), "u string, items array<string>").repartition(3)
    outbox.write_object(lists, str(tmp_path / "o"), "u", files=4)
    files = sorted((tmp_path / "o").glob("part-*"))
    assert len(files) > 1
    assert json.loads("".join(f.read_text() for f in files)) == truth
    assert read_back(tables.lists_from_json(spark, str(tmp_path / "o"), brackets_in_ids=True).collect()) == truth
    outbox.write_object(lists.where("false"), str(tmp_path / "none"), "u")
    assert "".join(f.read_text() for f in (tmp_path / "none").glob("part-*")).strip() == "{}"
    assert tables.lists_from_json(spark, str(tmp_path / "none")).collect() == []
    outbox.write_object(lists.limit(1), str(tmp_path / "one"), "u")
    assert len(json.loads("".join(f.read_text() for f in (tmp_path / "one").glob("part-*")))) == 1


def test_a_killed_write_resumes_without_loss_or_repeats(spark, tmp_path):
    users = spark.range(100).select(F.col("id").alias("customer_id"))
    path, made = str(tmp_path / "lists"), []

    def lists_of(part):
        ids = [r.customer_id for r in part.collect()]
        made.append(set(ids))
        return part.select("customer_id", F.array(F.concat(F.lit("i"), "customer_id")).alias("items"))

    def dies(part):
        if len(made) == 3:
            boom = F.when(F.col("customer_id") >= 0, F.raise_error(F.lit("lost"))).cast("string")
            return part.select("customer_id", F.array(boom).alias("items"))
        return lists_of(part)

    with pytest.raises(Exception, match="lost"):
        outbox.write_in_parts(users, dies, path, parts=8, tag="t")
    assert 0 < outbox.read_parts(spark, path).count() < 100
    # What a dead part left behind is written over.
    left = outbox._finished(spark, path)
    torn = next(p for p in range(8) if p not in left)
    spark.createDataFrame([(7, ["torn"])], "customer_id bigint, items array<string>").write.mode("overwrite").json(f"{path}/lists/part={torn}")
    assert outbox.write_in_parts(users, lists_of, path, parts=8, tag="t", at_most=2) == 3
    assert outbox.write_in_parts(users, lists_of, path, parts=8, tag="t") == 0
    assert sorted(i for part in made for i in part) == list(range(100))  # no part made twice
    rows = outbox.read_parts(spark, path).collect()
    assert sorted((r.customer_id, r.item_id, r.rank) for r in rows) == sorted((n, f"i{n}", 1) for n in range(100))
    assert outbox.write_in_parts(users, dies, path, parts=8, tag="t") == 0
    for other in (dict(parts=4, tag="t"), dict(parts=8, tag="other")):
        with pytest.raises(ValueError, match="another run"):
            outbox.write_in_parts(users, lists_of, path, **other)
    with pytest.raises(ValueError, match="another run"):
        outbox.write_in_parts(users.limit(5), lists_of, path, parts=8, tag="t")
    assert outbox.read_parts(spark, str(tmp_path / "nothing")).count() == 0


class Often:
    """The score is how often the user bought the item."""

    def score(self, rows):
        return rows.withColumn("score", F.col("ui_tx_count").cast("double"))


def test_recommendations_by_parts_equal_those_of_one_run(spark, log, catalogue, tmp_path):
    rnd = random.Random(6)
    rows = [(rnd.randrange(80), rnd.randrange(12), f"i{rnd.randrange(9)}", f"2025-0{rnd.randrange(1, 6)}-1{rnd.randrange(9)}", 2.0, 0.0, 1.0, rnd.randrange(3)) for _ in range(300)]
    tx = log(rows)
    items = catalogue([(f"i{n}", 1.0, 1, 3, "a", "b", "c", f"k{n % 2}", f"m{n % 3}") for n in range(9)])
    params = RunParams(candidates=CandidateParams(personal_top=3, global_top=4, cobuy_top=3), k=4)
    path = str(tmp_path / "lists")
    whole = monthly.recommend(Often(), tx, "2025-06", items, params).collect()
    for at_most, left in ((1, 1), (None, 0)):
        assert monthly.recommend_in_parts(Often(), tx, "2025-06", path, items, params, parts=2, at_most=at_most) == left
    rows = outbox.read_parts(spark, path).collect()
    assert sorted((r.customer_id, r.rank, r.item_id) for r in rows) == sorted((r.customer_id, n, i) for r in whole for n, i in enumerate(r["items"], 1))
    assert len(whole) == 12
