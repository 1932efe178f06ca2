"""SimHash, embeddings, piecewise hashing and components against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash
import pytest
from llm_cases import SCHEMA, TEXTS, plain_fingerprint, rows_of, smallest_reachable

from llm import ctph, embeddings, simhash
from llm.common import components
from llm.queries import op1_simhash, op5_embeddings, op8_ctph


def near_texts(rng, copies=40):
    words = [f"w{i}" for i in range(500)]
    base = [rng.choices(words, k=300) for _ in range(10)]
    out = []
    for _ in range(copies * 10):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(300)] = rng.choice(words)
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("limit", [1, 3, 256])
def test_op1_at_any_cell_limit(spark, save, monkeypatch, limit):
    """Crowded cells take the way without pairs; links are the same at every limit."""
    monkeypatch.setattr(simhash, "CELL_LIMIT", limit)
    texts = TEXTS + near_texts(random.Random(4))
    docs = spark.createDataFrame(rows_of(texts, 100), SCHEMA)
    rows = op1_simhash(spark, save(documents=docs)).collect()
    fps = {100 + i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == fps
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in rows)
    expected = smallest_reachable(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert {r.doc_id: r.component_id for r in rows} == expected
    assert len(set(expected.values())) < len(texts) - 100


def test_fingerprints_two_bits_apart_are_linked_and_three_are_not(spark):
    rng = random.Random(9)
    fps = []
    for _ in range(30):
        base = rng.getrandbits(64)
        fps += [base, base ^ 1 << rng.randrange(64), base ^ (1 << 63 | 1), base ^ (7 << rng.randrange(61))]
    fps += [0, 3, (1 << 64) - 1, (1 << 64) - 1 ^ (1 << 63 | 1)]
    nodes = list(enumerate(dict.fromkeys(fps)))
    signed = [(fp - (1 << 64) if fp >> 63 else fp, i) for i, fp in nodes]
    links = simhash.links(spark.createDataFrame(signed, "fp bigint, node bigint"))
    made = {r.node: r.component for r in components(links, "test").collect()}
    value = dict(nodes)
    expected = smallest_reachable(list(value), lambda a, b: (value[a] ^ value[b]).bit_count() <= 2)
    assert {n: made.get(n, n) for n in value} == expected


def test_simhash_of_repeated_rows_null_ids_and_no_rows(spark, no_docs, save):
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (3, "z"), (None, "only here")]
    made = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r.id, r.component) for r in made), key=str) == sorted(
        [(None, 7), (7, 7), (7, 7), (3, 3), (None, None)], key=str
    )
    assert op1_simhash(spark, save(documents=no_docs)).count() == 0


def test_components_of_paths_stars_and_cliques(spark):
    rng = random.Random(6)
    path = [(i, i + 1) for i in range(1000, 1100)]
    star = [(5000, i) for i in range(5001, 5200)]
    loose = [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(250)]
    edges = [*path, *star, *loose, (9, 9)]
    rng.shuffle(edges)
    made = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "test").collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    expected = smallest_reachable(list(near), lambda a, b: b in near[a])
    expected = {n: c for n, c in expected.items() if near[n] != {n}}
    assert made == expected


def vector_rows(rng):
    rows = []
    for _ in range(60):
        base = rng.normal(size=64)
        rows.append(base)
        for _ in range(rng.integers(0, 6)):
            rows.append(base + rng.normal(size=64) * rng.choice([0.05, 0.2, 0.3, 0.4]))
        rows += [base * 2.5, base.copy()]
    rows = [[float(x) for x in r] for r in rows]
    short = [r[:63] for r in rows[::3]] + [r[:3] for r in rows[::9]] + [[2.0], [-3.0], [5.0]]
    odd = [None, [], [0.0] * 64, [0.0] * 63, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63]
    return rows + short + odd + odd


def brute_links(rows):
    unit = {}
    for i, r in enumerate(rows):
        if r and None not in r and np.isfinite(r).all() and any(r):
            unit[i] = np.array(r) / np.linalg.norm(r)
    return {i: {j for j in unit if j != i and len(rows[j]) == len(rows[i]) and unit[i] @ unit[j] >= 0.95} if i in unit else set() for i in range(len(rows))}


@pytest.mark.parametrize("block", [4, 512])
def test_op5_at_any_block_size(spark, save, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = vector_rows(np.random.default_rng(8))
    table = spark.createDataFrame(
        [(i, r, 0, 5) for i, r in enumerate(rows)], "vec_id bigint, embedding array<double>, label int, node int"
    )
    made = {r.vec_id: r for r in op5_embeddings(spark, save(embeddings=table)).collect()}
    links = brute_links(rows)
    assert {i: r.n_links for i, r in made.items()} == {i: len(x) for i, x in links.items()}
    expected = smallest_reachable(list(links), lambda a, b: b in links[a])
    assert {i: r.component_id for i, r in made.items()} == expected
    assert all(r.kept == (r.component_id == i) for i, r in made.items())
    assert max(map(len, links.values())) > 3


@pytest.mark.parametrize("dim, hashes", [(16, 4), (64, 2), (64, 3), (64, 4), (256, 3), (768, 2), (768, 3)])
def test_bucket_recall_at_the_threshold(dim, hashes):
    """Pairs at a cosine of exactly 0.95 share a bucket in at least 99 of 100 cases, however
    many axes the number of vectors asks for."""
    rng = np.random.default_rng(1)
    n = 2000 if dim < 256 else 500
    a, r = rng.normal(size=(2, n, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    r -= (r * a).sum(1)[:, None] * a
    r /= np.linalg.norm(r, axis=1)[:, None]
    width = 1 << (dim - 1).bit_length()
    buckets = embeddings.Buckets(dim, embeddings.IN_BUCKET * (2 * width) ** (hashes - 1) + 1)
    assert buckets.hashes == hashes
    one = buckets.of(a).reshape(n, -1)
    two = buckets.of(0.95 * a + np.sqrt(1 - 0.95**2) * r).reshape(n, -1)
    assert (one[:, :, None] == two[:, None, :]).any((1, 2)).mean() >= 0.99


def test_bucket_numbers_beyond_64_bits_wrap_and_still_part_the_tables():
    buckets = embeddings.Buckets(4096, 1 << 62)
    numbers = buckets.of(np.eye(4096)[:3])
    assert (numbers[:, :, 0] % buckets.tables == np.arange(buckets.tables)).all()


def test_op5_with_many_axes_gives_the_same_links(spark, save, monkeypatch):
    """Axes and tables as for a table of many vectors of few components."""
    monkeypatch.setattr(embeddings, "IN_BUCKET", 1e-4)
    rng = np.random.default_rng(4)
    rows = [[float(x) for x in r] for base in rng.normal(size=(80, 8)) for r in (base, base + rng.normal(size=8) * 0.1)]
    assert embeddings.shape(8, len(rows))[0] > 3
    schema = "vec_id bigint, embedding array<double>, dim int, bucket string"
    table = spark.createDataFrame([(i, r, 1, "x") for i, r in enumerate(rows)], schema)
    made = {r.vec_id: r.n_links for r in op5_embeddings(spark, save(embeddings=table)).collect()}
    assert made == {i: len(x) for i, x in brute_links(rows).items()}


def test_op5_without_rows_or_usable_vectors(spark, save):
    schema = "vec_id bigint, embedding array<float>, label int"
    assert op5_embeddings(spark, save(embeddings=spark.createDataFrame([], schema))).count() == 0
    rows = op5_embeddings(spark, save(embeddings=spark.createDataFrame([(4, None, 1), (5, [0.0], 1)], schema))).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rows) == [(4, 0, 4, True), (5, 0, 5, True)]


def test_hadamard_equals_its_matrix():
    x = np.random.default_rng(2).normal(size=(3, 8))
    matrix = np.array([[(-1) ** (i & j).bit_count() for j in range(8)] for i in range(8)]) / np.sqrt(8)
    assert np.allclose(embeddings.hadamard(x), x @ matrix)


# ---- piecewise hashing ------------------------------------------------------------------


def plain_rolling(data):
    """Ends of chunks by the definition: a hash of the last seven bytes at every place."""
    out = []
    for i in range(len(data)):
        h = sum((data[i - k] + 1) * pow(0x01000193, k, 1 << 32) for k in range(min(7, i + 1))) & 0xFFFFFFFF
        h = (h ^ h >> 15) * 0x85EBCA6B & 0xFFFFFFFF
        out.append(h ^ h >> 13)
    return out


def plain_signature(data, block):
    ends = [i + 1 for i, h in enumerate(plain_rolling(data)) if h % block == 0]
    if not ends or ends[-1] != len(data):
        ends.append(len(data))
    out, start = "", 0
    for end in ends:
        h = sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(data[start:end])) % (1 << 64)
        h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64)
        out += chr(ctph.ALPHABET[h >> 58])
        start = end
    return out


def test_fingerprint_equals_its_definition():
    hasher = ctph.Hasher()
    rng = random.Random(11)
    for n in (1, 5, 40, 300, 3000):
        text = "".join(rng.choices("abcde fghij é", k=n))
        block, one, two = hasher.fingerprint(text).split(":")
        data = text.encode()
        assert one == plain_signature(data, int(block))
        assert two == plain_signature(data, 2 * int(block))
    assert hasher.fingerprint("") == "3::"


def test_likeness_is_one_minus_indels():
    def indels(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(12)
    for _ in range(200):
        a = "".join(rng.choices("abcd", k=rng.randint(1, 90)))
        b = "".join(rng.choices("abcd", k=rng.randint(1, 90)))
        expected = 1 - indels(a, b) / (len(a) + len(b)) if ctph.share_run(a, b) else 0.0
        assert ctph.likeness(f"6:{a}:", f"6:{b}:") == pytest.approx(expected if a != b else 1.0)
        assert ctph.likeness(f"12:{a}:", f"6::{b}") == pytest.approx(expected)
        assert ctph.likeness(f"24:{a}:", f"6::{b}") == 0.0
    assert ctph.likeness("3::", "3::") == 1.0


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_op8(spark, partitions, odd_docs):
    texts = {i: t or "" for i, t in enumerate(TEXTS)}
    rows = {r.id: r for r in ctph.against_next(odd_docs, partitions=partitions).collect()}
    hasher, order = ctph.Hasher(), sorted(texts, reverse=True)
    for at, i in enumerate(order):
        text, after = texts[i], texts[order[(at + 1) % len(order)]]
        moved = len(text) // 3
        edited = text[: len(text) - moved] + after[:moved]
        own, mark = hasher.fingerprint(text), hasher.fingerprint(edited)
        assert tuple(rows[i])[1:] == (
            len(text),
            hashlib.sha256(edited.encode()).hexdigest(),
            own,
            mark,
            ctph.likeness(own, mark),
            ctph.likeness(own, hasher.fingerprint(after)),
        )


def test_op8_with_one_id_on_most_rows(spark):
    """Rows of one id, with texts of their own or equal ones, go to many ranges."""
    rng = random.Random(15)
    rows = [(7, "w" * rng.randint(1, 40) + str(i) if i % 3 else "same text here") for i in range(600)]
    rows += [(i, f"text {i} of its own") for i in range(200)] + [(None, f"nobody {i % 5}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    signed = lambda t: np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    want = []
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        moved = len(text) // 3
        want.append((i, len(text), hashlib.sha256((text[: len(text) - moved] + after[:moved]).encode()).hexdigest()))
    made = ctph.against_next(docs, partitions=12)
    assert sorted((tuple(r)[:3] for r in made.collect()), key=str) == sorted(want, key=str)
    stored_at = re.search(r"ctph-ranges-[0-9a-f]+", " ".join(made.inputFiles()))[0]
    folder = next(f for f in made.inputFiles() if stored_at in f).rsplit("/", 1)[0]
    sizes = [r["count"] for r in spark.read.parquet(folder).where("place <> 1").groupBy("part").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 300


def test_op8_query_and_small_tables(spark, odd_docs, no_docs, save):
    rows = op8_ctph(spark, save(documents=odd_docs)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(TEXTS)))
    assert op8_ctph(spark, save(documents=no_docs)).count() == 0
    one = spark.createDataFrame([(5, "alone here with some words")], "doc_id bigint, text string")
    (row,) = op8_ctph(spark, save(documents=one)).collect()
    assert row.near_next == 1.0 and row.n_chars == 26
    twice = spark.createDataFrame([(5, "b b"), (5, "a a"), (None, "c")], "doc_id bigint, text string")
    assert op8_ctph(spark, save(documents=twice)).count() == 3


def test_edits_keep_texts_alike_and_others_apart():
    rng = random.Random(13)
    hasher = ctph.Hasher()
    texts = ["".join(rng.choices("etaoin shrdlu", k=4000)) for _ in range(50)]
    alike = [ctph.likeness(hasher.fingerprint(t), hasher.fingerprint(t[:2600] + texts[0][2600:])) for t in texts]
    apart = [ctph.likeness(hasher.fingerprint(a), hasher.fingerprint(b)) for a, b in zip(texts, texts[1:])]
    assert np.median(alike) > 0.6 and np.median(apart) == 0.0


def test_periodic_text_has_a_bounded_fingerprint():
    hasher = ctph.Hasher()
    for unit in ("a", "ab", "abc", "0123456789"):
        assert len(hasher.fingerprint(unit * 50000)) < 3 * ctph.LONGEST


def test_simhash_plan_has_no_product(spark, odd_docs):
    plan = simhash.near_duplicates(odd_docs)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_simhash_copies_no_exploded_table_to_the_driver(spark, monkeypatch):
    """300,000 fingerprints, estimated at 7 MB, are listed 9 million times: 805 MB as a broadcast."""
    plans, keep = [], simhash.stored

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, label)

    monkeypatch.setattr(simhash, "stored", seen)
    texts = near_texts(random.Random(5), copies=2)
    made = simhash.near_duplicates(spark.createDataFrame(rows_of(texts, 100), SCHEMA))
    plans.append(made._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in plan for plan in plans) and not any("Broadcast" in plan for plan in plans)
