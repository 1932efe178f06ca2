"""Candidates and features against plain Python over every row."""

import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from basketmill.columns import FEATURES, SOURCES
from basketmill.config import CandidateParams
from basketmill.operators import candidates as C
from basketmill.operators import features as Fe
from basketmill.operators.cobuy import shared_bill_counts
from basketmill.operators import training as D
from basketmill.functions.time import month_window
from basketmill.operators.ledger import open_audience, open_ledger
from basketmill.session import run_scope
from pyspark.sql import functions as F

CUTOFF = datetime(2025, 7, 1)
PARAMS = CandidateParams(
    personal_days=120, recent_days=60, personal_top=3, global_top=3, recent_global_top=2,
    location_top=2, recent_location_top=2, cobuy_top=2, category_top=2, brand_top=2,
    user_categories=2, user_brands=1, max_anchors=2, pairs_per_chunk=6,
)
ITEMS = [(f"i{n}", 1.0 + n, n % 3, n, f"l{n % 2}", f"m{n % 3}", f"n{n}", f"c{n % 4}",
          None if n == 5 else f"b{n % 3}") for n in range(12)]


def random_rows(seed=3, n=400):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        # Bill 0 takes a third of the rows, user 1 a third, and dates repeat.
        bill = rnd.choice([0, rnd.randrange(1, 40), rnd.randrange(1, 40), None])
        user = rnd.choice([1, rnd.randrange(2, 9), rnd.randrange(2, 9)])
        day = CUTOFF - timedelta(days=rnd.randrange(-20, 200), hours=rnd.choice([0, 12]))
        rows.append((bill, user, f"i{rnd.randrange(12)}", day, rnd.choice([None, 2.0, 3.5]),
                     rnd.choice([None, 0.5]), float(rnd.randrange(1, 4)), rnd.choice([None, 1, 2])))
    return rows


def brute_force(rows, users):
    hist = [r for r in rows if r[3] < CUTOFF]
    recent = [r for r in hist if r[3] >= CUTOFF - timedelta(days=PARAMS.recent_days)]
    long = [r for r in hist if r[3] >= CUTOFF - timedelta(days=PARAMS.personal_days)]
    meta = {i[0]: i for i in ITEMS}

    def best(rows, key, k, latest=True):
        count, last = Counter(key(r) for r in rows), {}
        for r in rows:
            last[key(r)] = max(last.get(key(r), r[3]), r[3])
        order = sorted(count, key=lambda x: (-count[x], -last[x].timestamp() if latest else 0, x))
        return order[:k]

    def item(r):
        return r[2]

    flags = defaultdict(set)
    pool = [r for r in recent]
    anchors = {u: best([r for r in recent if r[1] == u], item, PARAMS.anchors) for u in users}
    baskets = defaultdict(set)
    for r in long:
        if r[0] is not None:
            baskets[r[0]].add(r[2])
    pairs = defaultdict(Counter)
    for b in baskets.values():
        for x in b:
            for y in b - {x}:
                pairs[x][y] += 1
    partners = {
        a: sorted(c.items(), key=lambda p: (-p[1], p[0]))[: PARAMS.cobuy_top] for a, c in pairs.items()
    }
    for u in users:
        own = [r for r in hist if r[1] == u]
        own_recent = [r for r in recent if r[1] == u]
        for i in best([r for r in long if r[1] == u], item, PARAMS.personal_top):
            flags[u, i].add("candidate_personal")
        for i in best(own, item, PARAMS.personal_top):
            flags[u, i].add("candidate_repeat_all")
        for i in best(hist, item, PARAMS.global_top, False):
            flags[u, i].add("candidate_global")
        for i in best(recent, item, PARAMS.recent_global_top, False):
            flags[u, i].add("candidate_recent_global")
        if own:
            place = max(own, key=lambda r: (r[3], r[7] is not None, r[7] or 0))[7]
            if place is not None:
                for name, rows_, k in (("location", hist, PARAMS.location_top),
                                       ("recent_location", recent, PARAMS.recent_location_top)):
                    for i in best([r for r in rows_ if r[7] == place], item, k, False):
                        flags[u, i].add(f"candidate_{name}")
        for name, col, mine, k in (("category", 7, PARAMS.user_categories, PARAMS.category_top),
                                   ("brand", 8, PARAMS.user_brands, PARAMS.brand_top)):
            def value(r):
                return meta[r[2]][col]
            known = [r for r in own_recent if value(r) is not None]
            for v in best(known, value, mine):
                for i in best([r for r in pool if value(r) == v], item, k):
                    flags[u, i].add(f"candidate_recent_{name}")
        score = Counter()
        for a in anchors[u]:
            for co, n in partners.get(a, []):
                score[co] += n
        for i, _ in sorted(score.items(), key=lambda p: (-p[1], p[0]))[: PARAMS.personal_top]:
            flags[u, i].add("candidate_cobuy")
    return flags


@pytest.mark.parametrize("chunk", [6, 1_000_000])
def test_all_sources_match_brute_force(spark, log, catalogue, chunk):
    from dataclasses import replace

    rows, users = random_rows(), [1, 2, 3, 4, 99]
    got = C.build_candidates(
        log(rows), spark.createDataFrame([(u,) for u in users], "customer_id bigint"), CUTOFF,
        catalogue(ITEMS), replace(PARAMS, pairs_per_chunk=chunk),
    ).collect()
    mine = {(r.customer_id, r.item_id): {s for s in SOURCES if r[s]} for r in got}
    assert len(got) == len(mine)
    assert mine == dict(brute_force(rows, users))
    assert all(r.candidate_source_count == len(mine[r.customer_id, r.item_id]) for r in got)
    # A user without history gets popular items only.
    cold = {s for (u, _), flags in mine.items() if u == 99 for s in flags}
    assert cold == {"candidate_global", "candidate_recent_global"}


def test_split_bills_count_like_pairs(spark):
    rnd = random.Random(5)
    baskets = {(b, f"i{rnd.randrange(30):02d}") for b in range(25) for _ in range(rnd.choice([1, 2, 3, 20]))}
    anchors = [f"i{n:02d}" for n in range(0, 30, 2)]
    lines = spark.createDataFrame(sorted(baskets), "bill_id bigint, item_id string")
    chosen = spark.createDataFrame([(a,) for a in anchors], "item_id string")
    want = {}
    for a in anchors:
        count = Counter()
        for b in {b for b, i in baskets if i == a}:
            count.update(i for x, i in baskets if x == b and i != a)
        want[a] = sorted(count.items(), key=lambda p: (-p[1], p[0]))[:4]
    for limit in (1, 7, 40, 10_000):
        got = defaultdict(list)
        for r in shared_bill_counts(lines, chosen, 4, limit).collect():
            got[r.anchor_item].append((r.co_item, r.cobuy_count))
        assert {a: sorted(v, key=lambda p: (-p[1], p[0])) for a, v in got.items()} == {
            a: v for a, v in want.items() if v
        }, limit


def test_bills_of_many_pairs_are_counted_by_parts(spark, monkeypatch):
    """Large bills send their lines to the parts of their anchors; no pair is a row."""
    from basketmill.operators import cobuy

    rnd = random.Random(6)
    baskets = {(f"b{b}", f"i{rnd.randrange(300):03d}") for b in range(12) for _ in range(rnd.choice([2, 90, 200]))}
    baskets |= {(f"b{b}", "i007") for b in range(12)}
    lines = spark.createDataFrame(sorted(baskets), "bill_id string, item_id string")
    for anchors in ([f"i{n:03d}" for n in range(300)], [f"i{n:03d}" for n in range(0, 310, 3)] + ["i007"]):
        chosen = spark.createDataFrame([(a,) for a in anchors], "item_id string")
        of = {b: {i for x, i in baskets if x == b} for b, _ in baskets}
        shared = {a: Counter(i for items in of.values() if a in items for i in items if i != a) for a in anchors}
        want = {(a, i, n) for a, c in shared.items() for i, n in sorted(c.items(), key=lambda p: (-p[1], p[0]))[:5]}
        # As given, and with many parts, small batches and anchors that are counted in pieces.
        for per_part, per_piece, chunk in ((10**6, 4 * 10**6, 500), (5000, 700, 40)):
            monkeypatch.setattr(cobuy, "PAIRS_PER_PART", per_part)
            monkeypatch.setattr(cobuy, "PAIRS_PER_PIECE", per_piece)
            got = shared_bill_counts(lines, chosen, 5, chunk)
            plan = got._jdf.queryExecution().toString()
            assert "CoGroupsInArrow" in plan
            rows = [tuple(r) for r in got.collect()]
            assert len(rows) == len(want) and set(rows) == want


def test_every_item_of_large_bills_is_an_anchor(spark, log, monkeypatch):
    from workload import queries as Q

    rnd = random.Random(8)
    rows = [(rnd.choice([None, *range(30)]), 1, f"i{rnd.randrange(60)}", Q.CUTOFF - timedelta(days=rnd.randrange(1, 9)),
             1.0, 0.0, 1.0, 1) for _ in range(1500)]
    monkeypatch.setattr(Q, "purchase_log", lambda *_: log(rows))
    bills = defaultdict(set)
    for bill, _, item, day, *_ in rows:
        if bill is not None:
            bills[day.date(), bill % 7].add(item)
    shared = Counter((a, b) for items in bills.values() for a in items for b in items if a != b)
    want = defaultdict(list)
    for (a, b), n in shared.items():
        want[a].append((-n, b))
    want = {(a, b, -n) for a, best in want.items() for n, b in sorted(best)[: Q.SMALL.cobuy_top]}
    made = Q.QUERIES["c13_cobuy_all_anchors"](spark, "").collect()
    assert {tuple(r) for r in made} == want and len(made) == len(want)
    assert len({a for a, _, _ in want}) == 60


def test_window_edges(spark, log):
    def ago(**kw):
        return CUTOFF - timedelta(**kw)

    instant = timedelta(microseconds=1)
    rows = [(1, 1, "a", d, 1.0, 0.0, 1.0, 1) for d in (
        CUTOFF, ago(microseconds=1), ago(days=7), ago(days=7) - instant, ago(days=30),
        ago(days=30) - instant, ago(days=90), ago(days=90) - instant)]
    ledger = open_ledger(log(rows), CUTOFF)
    users = spark.createDataFrame([(1,)], "customer_id bigint")
    row = Fe.pair_features(ledger, open_audience(ledger, users)).first()
    assert (row.ui_tx_count, row.ui_tx_7d, row.ui_tx_30d, row.ui_tx_90d) == (7, 2, 4, 6)
    # An elapsed time just short of a day is no day; just over 90 days is 90.
    assert (row.ui_last_days, row.ui_first_days) == (0, 90)


def test_unknown_last_place_stays_unknown(spark, log):
    rows = [
        (1, 1, "a", "2025-06-01", 1.0, 0.0, 1.0, 5), (2, 1, "a", "2025-06-02", 1.0, 0.0, 1.0, None),
        (3, 2, "a", "2025-06-01", 1.0, 0.0, 1.0, 5), (3, 2, "a", "2025-06-01", 1.0, 0.0, 1.0, None),
        (3, 2, "b", "2025-06-01", 1.0, 0.0, 1.0, 4),
    ]
    ledger = open_ledger(log(rows), CUTOFF)
    places = {r.customer_id: (r.location, r.place_rows) for r in ledger.user_location().collect()}
    assert places == {1: (None, None), 2: (5, 1)}


def test_refunds_and_missing_values(spark, log):
    rows = [
        (None, 1, "a", "2025-06-01", 1.0, 0.5, -1.0, 1),
        (None, 1, "b", "2025-06-01", None, None, None, 1),
        (7, 1, "b", "2025-06-02", None, None, None, 1),
    ]
    ledger = open_ledger(log(rows), CUTOFF)
    audience = open_audience(ledger, spark.createDataFrame([(1,)], "customer_id bigint"))
    pairs = {r.item_id: r for r in Fe.pair_features(ledger, audience).collect()}
    assert pairs["a"].ui_spend_sum == -1 and pairs["a"].ui_discount_rate is None
    assert pairs["b"].ui_avg_price is None and pairs["b"].ui_qty_sum is None
    user = Fe.user_features(ledger, audience).first()
    assert user.u_bill_nunique == 2  # no bill counts as one


def _features(spark, log_rows, log, items, partitions=4):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    users = spark.createDataFrame([(u,) for u in (1, 2, 3, 99)], "customer_id bigint")
    tx = log(log_rows)
    ledger = open_ledger(tx, CUTOFF, items, PARAMS, stored=True)
    audience = open_audience(ledger, users, stored=True)
    pairs = C.candidates_from(ledger, audience)
    out = Fe.features_from(ledger, audience, pairs)
    rows = {(r.customer_id, r.item_id): tuple(round(float(v), 9) for v in r[2:]) for r in out.collect()}
    assert out.columns == ["customer_id", "item_id", *FEATURES]
    assert len(rows) == pairs.count() == out.count()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return rows


def test_features_do_not_look_ahead(spark, log, catalogue):
    rows = random_rows()
    full = _features(spark, rows, log, catalogue(ITEMS))
    past = _features(spark, [r for r in rows if r[3] < CUTOFF], log, catalogue(ITEMS), partitions=3)
    assert full == past
    cold = [v for (u, _), v in full.items() if u == 99]
    at = FEATURES.index("u_tx_count")
    assert cold and all(v[at] == 0 for v in cold)


def test_features_without_a_catalogue(spark, log):
    rows = _features(spark, random_rows(), log, None)
    empty = [FEATURES.index(f) for f in ("u_brand_share", "item_catalog_price", "category_tx_30d",
                                         "loc_category_tx_90d", "candidate_recent_brand")]
    assert rows and all(v[i] == 0 for v in rows.values() for i in empty)


def test_plans_have_no_python_and_no_product(spark, log, catalogue):
    ledger = open_ledger(log(random_rows(n=50)), CUTOFF, catalogue(ITEMS), PARAMS)
    users = spark.createDataFrame([(1,)], "customer_id bigint")
    audience = open_audience(ledger, users)
    sources = (
        C.personal, C.repeat_all, C.popular_everywhere, C.recently_popular, C.popular_at_place,
        C.recently_popular_at_place, C.popular_in_categories, C.popular_in_brands, C.bought_together,
    )
    pairs = C.candidates_from(ledger, audience)
    labelled = D.add_labels(log(random_rows(n=50)), pairs, month_window("2025-07")).withColumn("label_month", F.substring("item_id", 1, 1))
    plans = [source(ledger, audience) for source in sources]
    plans += [Fe.features_from(ledger, audience, pairs), D.downsample_negatives(labelled, 2.0, 1)]
    for df in plans:
        plan = df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert "Python" not in plan and "Arrow" not in plan
    limited = C.personal(ledger, audience)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in limited


def test_a_hot_item_is_split_by_the_join_and_not_copied(spark, log, catalogue):
    """Half of all rows are of one item: the skewed partition is split at run time."""
    rows = [(n, n % 97 + 1, "i0" if n % 2 else f"i{n % 12}", CUTOFF - timedelta(days=n % 80), 1.0, 0.0, 1.0, 1)
            for n in range(20_000)]
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        from basketmill.operators.ledger import with_attributes

        tx = log(rows).repartition(8)
        joined = with_attributes(tx, catalogue(ITEMS))
        assert joined.count() == 20_000
        out = joined.groupBy("item_id").count()
        assert {r.item_id: r["count"] for r in out.collect()} == Counter(r[2] for r in rows)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan and "explode(sequence" not in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_run_stores_six_tables_and_deletes_them(spark, log, catalogue):
    import os

    users = spark.createDataFrame([(1,), (2,)], "customer_id bigint")
    with run_scope(spark) as path:
        ledger = open_ledger(log(random_rows()), CUTOFF, catalogue(ITEMS), PARAMS, stored=True)
        audience = open_audience(ledger, users, stored=True)
        features = Fe.features_from(ledger, audience, C.candidates_from(ledger, audience))
        assert features.count() > 0
        assert len(os.listdir(path)) <= 6
    assert not os.path.exists(path)


def test_a_run_reads_the_log_once(spark, log, catalogue):
    from workload.queries import CountScorer

    from basketmill.config import RunParams, SplitMonths
    from basketmill.plans import monthly

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = random_rows()
    tx = log(rows)
    tx = tx.mapInArrow(counted, tx.schema)
    months = SplitMonths(("2025-03", "2025-04"), "2025-05", "2025-06")
    with run_scope(spark):
        result = monthly.run(tx, months, CountScorer(), catalogue(ITEMS), RunParams(candidates=PARAMS))
        assert result.lists.count() > 4 and result.validation_report.count() == 1
    assert read.value == len(rows)


def test_a_train_cap_leaves_recommendations_whole(spark, log, catalogue):
    from workload.queries import CountScorer

    from basketmill.config import RunParams, SplitMonths
    from basketmill.plans import monthly

    tx, items = log(random_rows()), catalogue(ITEMS)
    months = SplitMonths(("2025-04",), "2025-05", "2025-06")
    capped = RunParams(candidates=PARAMS, max_train_users=1, max_validation_users=1)
    free, cut = (
        monthly.run(tx, months, CountScorer(), items, p).lists for p in (RunParams(candidates=PARAMS), capped)
    )
    lists = [{r.customer_id: tuple(r["items"]) for r in df.collect()} for df in (free, cut)]
    assert lists[0] == lists[1] and len(lists[0]) > 4
    few = monthly.run(tx, months, CountScorer(), items, RunParams(candidates=PARAMS, max_test_users=2)).lists
    assert few.count() == 2


def test_wide_rows_move_once_for_all_attributes(spark, log, catalogue):
    """They are 200 bytes a row packed, and moved five times by customer and attribute before."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in small}
    users = spark.createDataFrame([(1,), (2,)], "customer_id bigint")
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        with run_scope(spark):
            ledger = open_ledger(log(random_rows()), CUTOFF, catalogue(ITEMS), PARAMS, stored=True)
            audience = open_audience(ledger, users, stored=True)
            made = Fe.features_from(ledger, audience, C.candidates_from(ledger, audience))
            plan = made._jdf.queryExecution().executedPlan().toString()
        for attribute in ("category_l1", "category_l2", "category_l3", "category", "brand"):
            # Only the totals are dealt so, when they are summed.
            assert len(re.findall(rf"Exchange hashpartitioning\(customer_id#\d+L, {attribute}#", plan)) == 1
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
