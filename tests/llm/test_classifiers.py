"""Toxicity and language: held-out accuracy, scoring against the definition, odd tables."""

import random
import zlib

import numpy as np
import pytest
from llm_cases import SCHEMA, SYLLABLES, TEXTS, sentence

from llm import language, toxicity
from llm.queries import op9_toxicity, op10_language

LABELS = "doc_id bigint, quality int, toxic int, text string"

@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(31)
    rows, labels = [], []
    for i in range(600):
        lang = rng.choice("aa bb cc".split())
        text, toxic = sentence(rng, lang, rng.randint(20, 100)).split(), int(rng.random() < 0.3)
        if toxic:
            for _ in range(4):
                text[rng.randrange(len(text))] = rng.choice(["scumbag", "IDIOT,", "trash!", "loser"])
        rows.append((i, " ".join(text), lang if rng.random() < 0.9 else None, "s", 0, "x", 1, 2, 3))
        if rng.random() < 0.8:
            labels.append((i, 1, toxic, "clash"))
    return rows, labels


def test_op9_on_held_out_rows(spark, save, corpus):
    rows, labels = corpus
    path = save(documents=spark.createDataFrame(rows, SCHEMA), labels=spark.createDataFrame(labels, LABELS))
    made = {r.doc_id: r for r in op9_toxicity(spark, path).collect()}
    assert len(made) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in made.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in made.values())
    held = [(made[i].predicted, toxic) for i, _, toxic, _ in labels if made[i].held_out]
    assert len(held) > 50 and np.mean([p == t for p, t in held]) > 0.95


def test_scores_equal_the_definition_and_do_not_depend_on_the_block(corpus):
    rows, labels = corpus
    toxic = {i: t for i, _, t, _ in labels}
    texts = [r[1] for r in rows] + [t or "" for t in TEXTS]
    sets = toxicity.feature_sets(texts)
    model = toxicity.fit([(s, toxic[i]) for i, s in enumerate(sets[:600]) if i in toxic])
    weight = dict(zip(model.places.tolist(), model.weights.tolist()))
    expected = [1 / (1 + np.exp(-(model.bias + sum(weight.get(p, 0.0) for p in s.tolist())))) for s in sets]
    assert np.allclose(model.score(texts), expected)
    assert np.allclose([model.score([t])[0] for t in texts], expected)
    assert 0 < len(model.places) < 0.2 * len(np.unique(np.concatenate(sets)))


def test_features_are_words_stems_and_skip_grams():
    one = toxicity.feature_sets(["Alpha beta gamma delta"])[0]
    same = toxicity.feature_sets(["alpha, beta... GAMMA! delta"])[0]
    assert one.tolist() == same.tolist()
    assert len(one) == 4 + 4 + 3 + 2 + 1  # words, stems, pairs at distance 1, 2 and 3
    parts = toxicity.feature_sets(["alpha beta", "gamma delta"])
    assert [len(p) for p in parts] == [5, 5]  # no pair crosses texts


def test_op9_odd_tables(spark, save, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1, 1, None), (5, 1, 0, None), (6, 1, None, None), (None, 1, 1, None), (99, 0, 1, None)], LABELS)
    rows = op9_toxicity(spark, save(documents=odd_docs, labels=labels)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(TEXTS)))
    none = spark.createDataFrame([], LABELS)
    rows = op9_toxicity(spark, save(documents=odd_docs, labels=none)).collect()
    assert {r.score for r in rows} == {0.0} and {r.predicted for r in rows} == {0}
    assert op9_toxicity(spark, save(documents=no_docs, labels=labels)).count() == 0


def test_op10_on_held_out_rows(spark, save, corpus):
    rows, _ = corpus
    made = {r.doc_id: r for r in op10_language(spark, save(documents=spark.createDataFrame(rows, SCHEMA))).collect()}
    assert len(made) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in made.items())
    assert all(0 <= r.score <= 1 and r.lang_pred in SYLLABLES for r in made.values())
    held = [(made[r[0]].lang_pred, r[2]) for r in rows if made[r[0]].held_out and r[2]]
    assert len(held) > 50 and np.mean([p == t for p, t in held]) > 0.98


def test_op10_odd_tables(spark, save, odd_docs, no_docs, corpus):
    rows = op10_language(spark, save(documents=odd_docs)).collect()
    made = {r.doc_id: r for r in rows}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        letters = any(c.isalpha() for c in text or "")
        assert made[i].lang_pred == ("en" if letters else "und")
        assert (made[i].score == 0) == (not letters)
    unknown = spark.createDataFrame([(i, "some text", None, None, 1, "x", 1, 2, 3) for i in range(9)], SCHEMA)
    assert {(r.lang_pred, r.score) for r in op10_language(spark, save(documents=unknown)).collect()} == {("und", 0.0)}
    assert op10_language(spark, save(documents=no_docs)).count() == 0


def plain_grams(text):
    """n-grams of the lower-cased text with runs of other characters as one space."""
    shown = "".join(c if c.isalpha() else " " for c in text.lower())
    shown = "".join(c for i, c in enumerate(shown) if c != " " or i == 0 or shown[i - 1] != " ")
    return {shown[i : i + n] for n in range(1, language.LONGEST + 1) for i in range(len(shown) - n + 1)}


def test_presence_is_that_of_the_distinct_n_grams():
    rng = random.Random(33)
    places = {}
    for _ in range(200):
        text = "".join(rng.choices("abcÀéß .,1-日", k=rng.randint(1, 30)))
        row = np.zeros(language.PLACES, dtype=np.uint8)
        assert language.presence(text, row) == any(c.isalpha() for c in text)
        if not any(c.isalpha() for c in text):
            continue
        grams = plain_grams(text)
        assert 0 < row.sum() <= len(grams)
        for gram in grams:
            own = np.zeros(language.PLACES, dtype=np.uint8)
            if any(c.isalpha() for c in gram) and gram == "".join(gram.split()):
                language.presence(gram, own)
                places[gram] = own
                assert (row >= own).all()
    assert len(places) > 100


def test_batches_score_like_single_texts(corpus):
    rows, _ = corpus
    marked = []
    for r in rows[:200]:
        row = np.zeros(language.PLACES, dtype=np.uint8)
        language.presence(r[1], row)
        marked.append((r[2] or "aa", np.packbits(row).tobytes()))
    model = language.fit(marked)
    texts = [r[1] for r in rows[200:300]] + TEXTS
    names, scores = model.classify(texts)
    singles = [model.classify([t]) for t in texts]
    assert names == [s[0][0] for s in singles]
    assert np.allclose(scores, [s[1][0] for s in singles], atol=1e-4)


def test_training_is_bounded_by_its_parameters(spark, corpus):
    rows, _ = corpus
    docs = spark.createDataFrame(rows, SCHEMA)
    small = language.train(docs, rows=5)
    assert small.languages == ["aa", "bb", "cc"] and len(small.landmarks) == 15


def test_every_language_is_learned(spark):
    rng = random.Random(36)
    rows = []
    for k in range(70):
        parts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(6)]
        for _ in range(8 if k < 66 else 4):
            text = " ".join("".join(rng.choices(parts, k=3)) for _ in range(40))
            rows.append((len(rows), text, f"l{k:02d}", "s", 0, "x", 1, 2, 3))
    model = language.train(spark.createDataFrame(rows, SCHEMA))
    assert len(model.languages) == 70
    names, _ = model.classify([r[1] for r in rows])
    assert np.mean([n == r[2] for n, r in zip(names, rows)]) > 0.98
    assert {n for n, r in zip(names, rows) if r[2] >= "l66"} == {"l66", "l67", "l68", "l69"}


def test_shared_bounds_leave_every_language_a_text(spark, corpus, monkeypatch):
    monkeypatch.setattr(language, "ALL_ROWS", 7)
    monkeypatch.setattr(language, "ALL_LANDMARKS", 2)
    model = language.train(spark.createDataFrame(corpus[0], SCHEMA))
    assert model.languages == ["aa", "bb", "cc"] and len(model.landmarks) == 3


def test_only_the_most_frequent_languages_are_learned(spark, corpus, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    rows, _ = corpus
    often = sorted({r[2] for r in rows if r[2]}, key=lambda x: (-sum(r[2] == x for r in rows), x))
    assert language.train(spark.createDataFrame(rows, SCHEMA)).languages == sorted(often[:2])


def plain_ftrl(examples, epochs, alpha=1.0, beta=1.0, l1=3.0, l2=1.0):
    """FTRL-proximal one coordinate at a time, as published; the bias has no L1."""
    z, n = {}, {}

    def weight(i):
        own = 0.0 if i == "bias" else l1
        if abs(z.get(i, 0.0)) <= own:
            return 0.0
        sign = 1.0 if z[i] > 0 else -1.0
        return -(z[i] - sign * own) / ((beta + n.get(i, 0.0) ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for places, label in examples:
            active = [*places.tolist(), "bias"]
            p = 1 / (1 + np.exp(-sum(weight(i) for i in active)))
            g = p - label
            for i in active:
                w, before = weight(i), n.get(i, 0.0)
                sigma = ((before + g * g) ** 0.5 - before**0.5) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w
                n[i] = before + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_training_equals_plain_ftrl(corpus):
    rows, labels = corpus
    toxic = {i: t for i, _, t, _ in labels}
    sets = toxicity.feature_sets([r[1] for r in rows[:150]])
    examples = [(s, toxic[i]) for i, s in enumerate(sets) if i in toxic]
    model = toxicity.fit(examples, epochs=2)
    want = plain_ftrl(examples, 2)
    assert model.bias == pytest.approx(want.pop("bias", 0.0))
    assert dict(zip(model.places.tolist(), model.weights.tolist())) == pytest.approx(want)


def test_scores_equal_a_plain_kernel_ridge(corpus):
    """Kernel values counted over sets of places, whitened by an eigenbasis of the landmarks'
    kernel, and one weighted ridge regression per language solved from its normal equations."""
    rows, _ = corpus
    known = [(r[2], r[1]) for r in rows if r[2]][:160]
    marks = []
    for lang, text in known:
        row = np.zeros(language.PLACES, dtype=np.uint8)
        language.presence(text, row)
        marks.append((lang, row))
    model = language.fit([(lang, np.packbits(row).tobytes()) for lang, row in marks])
    sets = [set(np.flatnonzero(row).tolist()) for _, row in marks]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    langs = sorted({lang for lang, _ in marks})
    chosen = [i for want in langs for i in [j for j, (lang, _) in enumerate(marks) if lang == want][: language.LANDMARKS]]
    k = np.array([[kernel(sets[i], sets[j]) for j in chosen] for i in chosen])
    values, vectors = np.linalg.eigh(k)
    good = values > 1e-6 * values[-1]
    points = np.array([[kernel(s, sets[j]) for j in chosen] for s in sets]) @ (vectors[:, good] / values[good] ** 0.5)
    weight = np.array([1 / sum(x == lang for x, _ in marks) for lang, _ in marks])
    left = points.T @ (weight[:, None] * points) + language.RIDGE * np.eye(points.shape[1])
    target = np.array([[1.0 if x == lang else -1.0 for x in langs] for lang, _ in marks])
    raw = points @ np.linalg.solve(left, points.T @ (weight[:, None] * target))
    share = np.exp(language.SHARPNESS * raw)
    share /= share.sum(axis=1, keepdims=True)
    names, scores = model.classify([text for _, text in known])
    assert names == [langs[b] for b in raw.argmax(axis=1)]
    assert np.allclose(scores, share.max(axis=1), atol=1e-3)


def test_samples_are_bounded_by_rows(spark, monkeypatch):
    """An id on a third of all rows is one example; what reaches the driver keeps the bounds."""
    rng = random.Random(47)
    rows = [(7 if i % 3 == 0 else i, sentence(rng, "aa bb".split()[i % 2], 12), "aa bb".split()[i % 2]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(12)
    labels = spark.createDataFrame([(i, i % 2) for i in range(6000)] + [(7, 1)] * 2000, "doc_id bigint, toxic int")
    seen = {}
    fit_language, fit_toxicity = language.fit, toxicity.fit
    monkeypatch.setattr(language, "fit", lambda x: seen.update(language=len(x)) or fit_language(x))
    monkeypatch.setattr(toxicity, "fit", lambda x: seen.update(toxicity=len(x)) or fit_toxicity(x[:50]))
    assert len(language.train(docs, rows=100).languages) == 2
    toxicity.train(docs, labels, rows=500)
    assert seen["language"] == 200 and seen["toxicity"] <= 500
    toxicity.train(docs, labels, rows=9000)
    assert seen["toxicity"] == len({r[0] for r in rows})
