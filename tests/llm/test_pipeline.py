"""The pipeline's stages against brute force, and that the rest works without this part."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_cases import SCHEMA, TEXTS, plain_fingerprint, sentence, smallest_reachable
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from llm import language, secret_scan, simhash
from llm.queries import QUERIES, language_model, toxicity_model

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def raw():
    rng = random.Random(41)
    texts = [sentence(rng, ["aa", "bb", "cc"][i % 3], 80) for i in range(150)]
    toxic = set(rng.sample(range(150), 40))
    for i in toxic:
        texts[i] += " you scumbag idiot scumbag"
    texts += texts[:30] + [texts[50] + " ", "1234 5678", "token = 0123456789abcdefX tail words of it"] + TEXTS
    rows = [(i, t, "aa bb cc".split()[i % 3] if i < 150 else None, "s", len(t or ""), "x", 1, 2, 3) for i, t in enumerate(texts)]
    return rows, [(i, 1, int(i in toxic)) for i in range(150)]


@pytest.fixture(scope="module")
def folder(spark, raw, save):
    rows, labels = raw
    return save(documents=spark.createDataFrame(rows, SCHEMA), labels=spark.createDataFrame(labels, LABELS))


def test_stages_one_after_the_other(spark, raw, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "toxicity", "near_dedup", "secrets", "packing"]

    texts = {r.doc_id: r.text for r in docs.collect()}
    after = stages["language"](spark, docs, folder)
    assert after.columns == columns
    learned = language_model(docs)
    names, scores = learned.classify(list(texts.values()))
    expected = {i for i, n, x in zip(texts, names, scores) if n != "und" and x >= 1.3 / len(learned.languages)}
    assert {r.doc_id for r in after.collect()} == expected
    assert expected.issuperset(range(150)) and len(expected) < sum(any(c.isalpha() for c in t or "") for t in texts.values())

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity_model(after, labels)
    clean = stages["toxicity"](spark, after, folder)
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == columns
    assert set(kept) == {i for i in expected if model.score([texts[i]])[0] < 0.3}
    assert not any("scumbag" in t for t in kept.values()) and len(kept) > 100

    single = stages["near_dedup"](spark, clean, folder)
    fps = {i: plain_fingerprint(t) for i, t in kept.items()}
    groups = smallest_reachable(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert single.columns == columns
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(groups.values()))

    masked = stages["secrets"](spark, single, folder)
    rows = masked.collect()
    assert masked.columns == columns and masked.count() == single.count()
    for r in rows:
        assert r.text == secret_scan.masked(texts[r.doc_id]) and r.n_chars == len(r.text)
    assert any("[SECRET]" in r.text for r in rows)

    pieces = defaultdict(list)
    for r in stages["packing"](spark, masked, folder).collect():
        pieces[r.doc_id].append((r.start, list(r.ids)))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows:
        ids = [i for _, part in sorted(pieces[r.doc_id]) for i in part]
        assert ids == [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0]


def test_run_writes_every_stage(spark, folder):
    made = corpus_pipeline.run(spark, folder)
    assert made.count() > 100
    assert zlib.crc32(np.array(made.first().ids, "<u4").tobytes()) == made.first().ids_crc32


def test_stages_on_nulls_repeats_and_no_rows(spark, save, odd_docs, no_docs):
    odd = odd_docs.unionByName(odd_docs).unionByName(
        odd_docs.withColumns({c: F.lit(None).cast(t) for c, t in odd_docs.dtypes}).limit(2)
    )
    labels = spark.createDataFrame([(5, 1, 0), (None, None, None)], LABELS)
    for docs, least in ((odd, 1), (no_docs, 0)):
        made = corpus_pipeline.run(spark, save(documents=docs, labels=labels))
        assert made.count() >= least
    for name, stage in corpus_pipeline.STAGES[2:4]:
        made = stage(spark, odd, save(labels=labels))
        assert made.columns == odd.columns
        ids = [r.doc_id for r in made.collect()]
        # Rows without an id or a text are near the empty text, which has an id.
        assert ids.count(None) == (0 if name == "near_dedup" else 2)
        if name == "near_dedup":
            assert len(ids) == len(set(ids))
    assert simhash.near_duplicates(no_docs).count() == 0


def test_language_stage_where_nothing_can_be_learned(spark):
    """No language at all, and languages in the held-out fold only."""
    held_out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0)
    for own in (None, held_out):
        rows = [(i, t, "en" if i == own else None, "s", 1, "x", 1, 2, 3) for i, t in enumerate([*TEXTS, *["text"] * 100])]
        docs = spark.createDataFrame(rows, SCHEMA)
        assert not language_model(docs).languages
        made = {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()}
        assert made == {r[0] for r in rows if any(c.isalpha() for c in r[1] or "")}


def edited(rng, words, changes):
    words = list(words)
    for i in rng.sample(range(len(words)), changes):
        words[i] = f"new{rng.randrange(10**9)}"
    return words


def test_near_dedup_keeps_one_of_each_component(spark):
    """Copies, copies of a changed word, a large group, and texts of their own."""
    rng = random.Random(43)
    bases = [[f"w{rng.randrange(5000)}" for _ in range(n)] for n in (60, 200, 1500) for _ in range(12)]
    texts = [w for b in bases for w in (b, b, edited(rng, b, 1))] + [edited(rng, bases[30], 1) for _ in range(80)]
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)], "doc_id int, text string, extra string")
    fps = [plain_fingerprint(t) for t in texts]
    groups = smallest_reachable(range(len(texts)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(groups.values()))
    assert len(bases) <= len(kept) < len(texts) - len(bases)


def test_near_dedup_decides_by_row(spark):
    """A repeated id is kept with the text that no other document has; a row without an id goes
    where another has its text, and stays where none has."""
    rng = random.Random(45)
    a, b, c, d = (sentence(rng, "aa", 40) for _ in range(4))
    rows = [(5, a, "x"), (5, b, "y"), (2, a, "z"), (7, c, "q"), (7, c, "p"), (9, c, "a"), (-3, d, "m"), (None, d, "n"), (None, a + b, "o"), (None, a + b, "o")]
    want = [(-3, d, "m"), (2, a, "z"), (5, b, "y"), (7, c, "p"), (None, a + b, "o")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id int, text string, extra string")
        made = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
        assert sorted(made, key=lambda r: (r[0] is None, r[0] or 0)) == want


def test_language_stage_rejects_what_the_model_rejects(spark):
    """Texts of no learned language go, and those of languages that are not asked for."""
    rng = random.Random(46)
    rows = [(i, sentence(rng, "aa bb cc".split()[i % 3], 60), "aa bb cc".split()[i % 3]) for i in range(240)]
    strange = ["".join(rng.choices("абвгдежзийклмнопрст ", k=400)) for _ in range(10)] + ["", "12 34", None]
    rows += [(1000 + i, t, None) for i, t in enumerate(strange)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()} == set(range(240))
    only = corpus_pipeline.language(spark, docs, "", keep={"bb"}).collect()
    assert {r.doc_id for r in only} == set(range(1, 240, 3))
    model = language_model(docs)
    assert model.accepts([None, rows[0][1]], sure=len(model.languages) * 2.0) == [False, False] or language.SURE > 1


def test_every_operator_is_registered_once():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    for n in range(1, 14):
        assert len([x for x in names if re.match(rf"op{n}_", x)]) == 1
    assert "pipeline" in names and set(QUERIES) <= set(names)
