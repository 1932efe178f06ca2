"""The manifest and its proofs against trees built and walked in plain Python."""

import hashlib
import random
import zlib

import duckdb
import pytest
from llm_cases import SCHEMA, TEXTS, rows_of
from pyspark.sql import functions as F

from llm import merkle
from llm.queries import ORACLE, manifest_leaves, op13_merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    """The digests of all levels."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_path(levels, i):
    """Left and right siblings from the leaf up."""
    for level in levels[:-1]:
        first = i // 8 * 8
        yield "".join(level[first:i]), "".join(level[i + 1 : first + 8])
        i //= 8


def plain_proofs(rows):
    """``doc_id, leaf, subroot, root, proof, folded root, verified`` of rows
    ``(doc_id, source, lang, n_chars, text)``."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    by_lang = {
        lang: sorted(((r[0], plain_leaf(r), r) for r in rows if r[2] == lang), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        for lang in langs
    }
    trees = {lang: plain_tree([leaf for _, leaf, _ in by_lang[lang]]) for lang in langs}
    above = plain_tree([trees[lang][-1][0] for lang in langs])
    out = []
    for j, lang in enumerate(langs):
        for i, (doc_id, leaf, row) in enumerate(by_lang[lang]):
            path = [*plain_path(trees[lang], i), *plain_path(above, j)]
            shown = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and row[4] is not None:
                shown = plain_leaf((*row[:4], "".join(c.lower() if c.isascii() else c for c in row[4])))
            for left, right in path:
                shown = h(left, shown, right)
            proof = h(*(a + b for a, b in path))
            out.append((doc_id, leaf, trees[lang][-1][0], above[-1][0], proof, shown, shown == above[-1][0]))
    return sorted(out, key=str)


DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def check(spark, save, rows):
    docs = spark.createDataFrame(rows, DOCS)
    made = op13_merkle(spark, save(documents=docs.repartition(5)))
    assert made.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in made.collect()), key=str) == plain_proofs(rows)


def sample_rows(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for lang, n in sizes.items():
        rows += [(rng.randrange(10**6) - 1000, rng.choice(["s", None, "é"]), lang, rng.randrange(9), rng.choice(["Ab", "É x", None, ""])) for _ in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9, None: 1, "": 2}, {"en": 70, "é": 8, "z": 65, None: 3, **{f"l{i}": 1 for i in range(9)}}])
def test_proofs_equal_plain_trees(spark, save, sizes):
    check(spark, save, sample_rows(len(sizes), sizes))


def test_nulls_repeats_ties_and_long_texts(spark, save):
    """Equal rows, one id with many texts, no id, no language, every odd text."""
    rows = [(r[0], r[3], "en", r[4], r[1]) for r in rows_of(TEXTS)]
    rows += [(7, "s", "de", 1, "Same")] * 40 + [(7, "s", "de", 1, f"Text {i % 6}") for i in range(30)]
    rows += [(None, None, None, None, None)] * 10 + [(None, "s", "en", 2, "X")] * 2 + [(3, "s", None, 2, "X")]
    check(spark, save, rows)


def test_no_rows(spark, save, no_docs):
    assert op13_merkle(spark, save(documents=no_docs)).count() == 0
    assert merkle.manifest(manifest_leaves(no_docs, F.lit(True))).root is None


def test_requests_descend_alone(spark):
    """Proofs of some leaves equal those found for all; no other node is visited."""
    rows = sample_rows(5, {"en": 600, "de": 70, "fr": 1, None: 9})
    made = merkle.manifest(manifest_leaves(spark.createDataFrame(rows, DOCS), F.lit(False)))
    everything = {(r.id, r.leaf): (r.subroot, [tuple(s) for s in r.path]) for r in made.proofs().collect()}
    assert len(everything) == len(set((r[0], plain_leaf(r)) for r in rows))
    sought = [("=en", 3), ("=en", 511), ("=de", 69), ("=fr", 0), ("", 8), ("=en", 10_000), ("=xx", 0)]
    found = made.proofs(spark.createDataFrame(sought, "key string, rank bigint")).collect()
    assert len(found) == 5
    for r in found:
        assert everything[r.id, r.leaf] == (r.subroot, [tuple(s) for s in r.path])
        folded = r.leaf
        for left, right in r.path:
            folded = h(left, folded, right)
        assert folded == r.root == made.root


def test_columns_with_clashing_names(spark, save, odd_docs):
    """Extra columns named like the operator's own."""
    names = {"lang": "key", "source": "digest", "id": "path"}
    clash = odd_docs.withColumns({new: F.col(old) for old, new in names.items()})
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in rows_of(TEXTS)]
    made = op13_merkle(spark, save(documents=clash))
    assert sorted((tuple(r) for r in made.collect()), key=str) == plain_proofs(rows)


def test_sql_counts_the_checksum_like_the_library():
    sql = ORACLE["op13_merkle"]
    start = sql.index("xor(list_reduce(")
    ids = [0, 7, 10, 123456789, -5]
    crc = sql[start : sql.index(" % 3 = 0")]
    rows = duckdb.sql(f"SELECT {crc} FROM (VALUES {', '.join(f'({i}::BIGINT)' for i in ids)}) t(doc_id)").fetchall()
    assert [r[0] for r in rows] == [zlib.crc32(str(i).encode()) for i in ids]
