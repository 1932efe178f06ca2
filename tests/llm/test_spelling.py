"""Spelling variants against all pairs, compared one by one."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_cases import SCHEMA, TEXTS, rows_of
from pyspark.sql import functions as F

from llm import spelling
from llm.queries import op11_spelling

ROW = "doc_id bigint, text string, word string, n int"


def plain_words(rows):
    """Occurrences of words by the contract's definition."""
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def plain_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    words = plain_words(rows)
    near = {a: [b for b in words if b != a and abs(len(a) - len(b)) < 2 and plain_near(a, b)] for a in words}
    form = {}
    for a, others in near.items():
        best = min(others, key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= 10 * words[a] else None
    out = set()
    for a, n in words.items():
        root = a
        while form[root] is not None:
            root = form[root]
        out.add((a, n, len(near[a]), form[a], words.get(form[a]), root))
    return out


def got(df):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def texts(seed, alphabet, words, size):
    """Words of few letters, so that many are anagrams or near, some much more often than others."""
    rng = random.Random(seed)
    pool = ["".join(rng.choices(alphabet, k=rng.randint(7, 9))) for _ in range(words)]
    pool += ["".join(rng.sample(w, len(w))) for w in pool]
    pool += [w[:i] + rng.choice(alphabet) + w[i + rng.randint(0, 1) :] for w in pool for i in [rng.randrange(len(w))]]
    weights = [rng.choice([1, 1, 2, 30, 400]) for _ in pool]
    return [(i, " ".join(rng.choices(pool, weights, k=size))) for i in range(60)]


@pytest.mark.parametrize(("alphabet", "sample", "leaf"), [("abéÉz", 1 << 15, 4000), ("abc", 300, 5), ("abcdefghi", 200, 3), ("ab", 100, 2)])
def test_variants_equal_all_pairs(spark, alphabet, sample, leaf):
    rows = texts(len(alphabet), alphabet, 120, 400)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], ROW)
    want = plain_variants(rows)
    assert got(spelling.variants(docs, sample=sample, leaf_words=leaf)) == want
    assert sum(w[3] is not None for w in want) > 10


def test_roots_follow_forms_to_the_last(spark):
    chain = ["aaaaaaa", "baaaaaa", "bbaaaaa", "bbbaaaa"]
    rows = [(None, " ".join(w for k, c in enumerate(chain) for w in [c] * (2 * 10**k)))]
    want = plain_variants(rows)
    assert {(w[0], w[5]) for w in want} == {(c, chain[-1]) for c in chain}
    assert got(spelling.variants(spark.createDataFrame([(None, rows[0][1], "", 0)], ROW))) == want


def test_ties_take_the_first_form(spark):
    rows = [(1, "kkkkkkk kkkkkkk " + "kkkkkkz " * 30 + "kkkkkkb " * 30 + "kkkkkkké " * 29)]
    made = got(spelling.variants(spark.createDataFrame([(*rows[0], "", 0)], ROW)))
    assert made == plain_variants(rows)
    assert {w: form for w, _, _, form, _, _ in made} == {"kkkkkkk": "kkkkkkb", "kkkkkkz": None, "kkkkkkb": None, "kkkkkkké": None}


def test_very_long_words(spark):
    """Counts above 255, where points are clipped."""
    rng = random.Random(3)
    base = "".join(rng.choices("ab", k=200_000))
    words = [base, base[:500] + "c" + base[501:], base[:-1], base[::-1], base + "a"]
    rows = [(None, " ".join(words * 2 + [base] * 30))]
    assert got(spelling.variants(spark.createDataFrame([(None, rows[0][1], "", 0)], ROW))) == plain_variants(rows)


def test_leaves_reach_every_near_pair():
    """Of each near pair one word's look reaches the home of the other."""
    rng = random.Random(9)
    words = sorted({"".join(rng.choices("abcd", k=7)) for _ in range(400)})
    points = spelling.counts_of(spelling.letters_of(words))
    tree = spelling.Tree()
    tree.grow(points, 4)
    home = tree.homes(points)
    reached = {(i, leaf) for leaf, rows in tree.reached(points, 1) for i in rows.tolist()}
    near = [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if plain_near(a, b)]
    assert near and all((i, home[j]) in reached for i, j in near)
    assert len(reached) < len(words) * len(tree.crowded) / 2


def test_letters_put_in():
    rng = random.Random(4)
    pairs = []
    for _ in range(2000):
        a = "".join(rng.choices("ab", k=7))
        b = "".join(rng.choices("ab", k=8))
        if rng.random() < 0.5:
            i = rng.randrange(8)
            b = a[:i] + rng.choice("ab") + a[i:]
        pairs.append((a, b))
    made = spelling.inserted(*(spelling.letters_of(list(side)) for side in zip(*pairs)))
    assert made.tolist() == [plain_near(a, b) for a, b in pairs]
    assert np.any(made) and not np.all(made)


def test_odd_rows(spark, save, odd_docs, no_docs):
    """Nulls, repeated rows, long texts, clashing columns, no rows; a query on a whole folder."""
    odd = odd_docs.unionByName(odd_docs).unionByName(
        odd_docs.withColumns({c: F.lit(None).cast(t) for c, t in odd_docs.dtypes}).limit(2)
    ).unionByName(odd_docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("bigint")))
    rows = [(r[0], r[1]) for r in rows_of(TEXTS)] * 2 + [(None, None)] * 2 + [(None, TEXTS[5])]
    assert got(spelling.variants(odd)) == plain_variants(rows)
    assert spelling.variants(no_docs).count() == 0
    docs = spark.createDataFrame(rows_of(["missing words", "missing Words MISSING", "missin"]), SCHEMA)
    made = op11_spelling(spark, save(documents=docs))
    assert made.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert {r.word for r in made.collect()} == {"missing"}
