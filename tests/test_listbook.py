"""Lists kept from run to run: reused for the same input only, and never half written."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from basketmill.columns import ITEM
from basketmill.config import CandidateParams
from basketmill.operators import candidates as C
from basketmill.operators.ledger import open_audience, open_ledger
from basketmill.operators.listbook import ListBook, content_digest, input_digest

CUTOFF = datetime(2025, 7, 1)
PARAMS = CandidateParams(personal_days=120, recent_days=60, personal_top=3, global_top=3, recent_global_top=2, location_top=2,
                         recent_location_top=2, cobuy_top=2, category_top=2, brand_top=2)
ITEMS = [(f"i{n}", 1.0, n % 3, n, "a", "b", "c", f"c{n % 4}", f"b{n % 3}") for n in range(12)]
LISTS = {"popular", "by-place", "by-category", "by-brand", "cobuy"}


def rows(n=200, seed=4):
    rnd = random.Random(seed)
    return [(rnd.randrange(30), rnd.randrange(9), f"i{rnd.randrange(12)}", CUTOFF - timedelta(days=rnd.randrange(1, 150)), 2.0, None, 1.0,
             rnd.choice([None, 1, 2])) for _ in range(n)]


@pytest.fixture
def stored_log(spark, log, tmp_path):
    log(rows()).write.parquet(f"{tmp_path}/log")
    return spark.read.parquet(f"{tmp_path}/log")


def built(spark, tx, items, root, params=PARAMS, cutoff=CUTOFF, **kwargs):
    book = ListBook(spark, root, **kwargs)
    users = tx.select("customer_id").distinct()
    made = C.build_candidates(tx, users, cutoff, items, params, book)
    return sorted(map(tuple, made.collect())), book.built


def test_a_second_run_builds_no_list(spark, stored_log, catalogue, tmp_path):
    items, root = catalogue(ITEMS), f"{tmp_path}/book"
    plain = sorted(map(tuple, C.build_candidates(stored_log, stored_log.select("customer_id").distinct(), CUTOFF, items, PARAMS).collect()))
    first, names = built(spark, stored_log, items, root)
    assert first == plain and set(names) == LISTS and len(names) == 7
    again, names = built(spark, stored_log, items, root)
    assert again == plain and names == []
    book = ListBook(spark, root)
    ledger = open_ledger(stored_log, CUTOFF, items, PARAMS, book=book)
    kept = C.place_items(ledger, "n_all", PARAMS.location_top)
    assert all(f.startswith("file:") and "/book/lists/" in f for f in kept.inputFiles()) and not book.built
    refreshed, names = built(spark, stored_log, items, root, refresh=True)
    assert refreshed == plain and len(names) == 7


def test_whatever_changes_a_list_makes_a_new_one(spark, log, stored_log, catalogue, tmp_path):
    items, root = catalogue(ITEMS), f"{tmp_path}/book"
    built(spark, stored_log, items, root)
    # Another cutoff, other sizes, another catalogue.
    assert len(built(spark, stored_log, items, root, cutoff=CUTOFF - timedelta(days=1))[1]) == 7
    smaller = CandidateParams(**{**PARAMS.__dict__, "location_top": 1})
    assert built(spark, stored_log, items, root, smaller)[1] == ["by-place"]
    assert len(built(spark, stored_log, catalogue(ITEMS[:5]), root)[1]) == 7
    # One more file of the same log: no list of the old one is used.
    extra = [(99, 1, "i11", CUTOFF - timedelta(days=2), 2.0, None, 1.0, 1)] * 40
    log(extra).write.mode("append").parquet(f"{tmp_path}/log")
    grown = spark.read.parquet(f"{tmp_path}/log")
    made, names = built(spark, grown, items, root)
    assert len(names) == 7
    users = grown.select("customer_id").distinct()
    assert made == sorted(map(tuple, C.build_candidates(grown, users, CUTOFF, items, PARAMS).collect()))
    # A filter on the same files, too.
    assert len(built(spark, grown.where("customer_id <> 3"), items, root)[1]) == 7


def test_a_run_that_dies_leaves_no_list(spark, stored_log, catalogue, tmp_path):
    root = f"{tmp_path}/book"
    book = ListBook(spark, root)

    def dies():
        return stored_log.select(F.raise_error(F.lit("lost")).alias("x"))

    with pytest.raises(Exception, match="lost"):
        book.keep("popular", {"top": 1}, dies)
    assert book.entries() == [] and book.built == []
    kept = book.keep("popular", {"top": 1}, lambda: stored_log.select(ITEM).limit(1))
    assert kept.count() == 1 and [e["name"] for e in book.entries()] == ["popular"]
    assert os.path.isdir(f"{root}/lists")


def test_digests(spark, log, stored_log):
    assert input_digest(stored_log) == input_digest(stored_log.select("*"))
    assert input_digest(stored_log) != input_digest(stored_log.where("quantity > 0"))
    # Rows in memory are compared by what they hold, whatever their order and number of partitions.
    mixed = rows()
    random.Random(1).shuffle(mixed)
    assert input_digest(log(rows())) == input_digest(log(mixed).repartition(5)) == content_digest(stored_log)
    assert input_digest(log(rows())) != input_digest(log(rows()[:-1]))
    assert input_digest(log(rows())) != input_digest(log([*rows()[:-1], rows()[0]]))
    changed = rows()
    changed[5] = (*changed[5][:4], None, *changed[5][5:])
    assert input_digest(log(rows())) != input_digest(log(changed))
