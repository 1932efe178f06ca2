"""BPE replay, token counts and packing against the libraries themselves."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import TEXTS
from tokenizers import Tokenizer

from llm import bpe, packing, token_counts
from llm.queries import op3_bpe, op4_token_counts, op6_packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(RANKS, PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=encoder.ranks.ids, special_tokens={})


def ids_of(encoder, texts):
    rows, ids, counts = encoder.block(texts)
    starts = np.cumsum(counts) - counts
    return [bpe.gather(r, ids, counts, starts).tolist() for r in rows]


def test_replay_equals_the_library_on_odd_and_random_texts(encoder, library):
    rng = random.Random(3)
    letters = "abcdeht aeiou  '\n.,9é—ß日\x1c\u0085"
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(letters, k=rng.randint(0, 200))) for _ in range(2000)]
    made = ids_of(encoder, texts)
    assert made == [library.encode_ordinary(t) for t in texts]
    assert [bpe.decode_ids(ids, encoder.ranks).decode() for ids in made] == texts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
def test_replay_equals_the_library_on_any_text(texts):
    encoder = bpe.Encoder(RANKS, PATTERN)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=encoder.ranks.ids, special_tokens={})
    assert ids_of(encoder, texts) == [library.encode_ordinary(t) for t in texts]


def test_merges_that_an_earlier_rank_interrupts():
    """With "ab" after "abc" and "ca" in rank, merging one "ab" makes an earlier merge due."""
    vocab = {bytes([b]): b for b in range(256)}
    for word in (b"bc", b"abc", b"ca", b"cab", b"ab", b"aba", b"aa", b"aaa"):
        vocab[word] = len(vocab)
    ranks = bpe.Ranks(vocab)
    library = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=vocab, special_tokens={})
    rng = random.Random(5)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 30))) for _ in range(3000)]
    ids, counts = bpe.replay([w.encode() for w in words], ranks)
    made = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    whole = [[vocab[w.encode()]] if w.encode() in vocab else m for w, m in zip(words, made)]
    assert whole == [library.encode_ordinary(w) for w in words]


def test_encode_and_decode_tables(spark, odd_docs, no_docs, library):
    ids = bpe.encode(odd_docs, RANKS, PATTERN)
    assert {r.id: list(r.ids) for r in ids.collect()} == {i: library.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    back = {r.id: bytes(r.bytes).decode() for r in bpe.decode(ids, RANKS).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.encode(no_docs, RANKS, PATTERN).count() == 0


def test_op3(spark, odd_docs, no_docs, save, library):
    rows = {r.doc_id: r for r in op3_bpe(spark, save(documents=odd_docs)).collect()}
    for i, text in enumerate(TEXTS):
        ids = library.encode_ordinary(text or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert op3_bpe(spark, save(documents=no_docs)).count() == 0


def test_op4(spark, odd_docs, no_docs, save):
    tokenizer = Tokenizer.from_file(WORDS)
    rows = {r.doc_id: r for r in op4_token_counts(spark, save(documents=odd_docs)).collect()}
    for i, text in enumerate(TEXTS):
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((text or "").encode()), n, n > 2048)
    assert op4_token_counts(spark, save(documents=no_docs)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=80), min_size=1, max_size=5))
def test_pieces_count_like_whole_texts(texts):
    import pyarrow as pa

    tokenizer = Tokenizer.from_file(WORDS)
    whole = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_counts.count_block(pa.array(texts, pa.string()), WORDS).tolist() == whole


def test_counts_of_a_piece_model(spark, odd_docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = {r.id: r.n_tokens for r in token_counts.token_counts(odd_docs, path).collect()}
    assert rows == {i: len(model.encode(t or "")) for i, t in enumerate(TEXTS)}


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
def test_packing_ids_equal_tokenizers(text):
    own = packing.byte_level(JSON, PATTERN).encode(text, allowed_special="all")
    assert own == Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids


def check_pieces(rows, texts, window):
    tokenizer = Tokenizer.from_file(JSON)
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(own.tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    for i, own in ids.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at and length > 0
            at += length
        assert at == len(own)
    fills = []
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        fills.append(at)
    return fills


def test_op6(spark, odd_docs, no_docs, save):
    fills = check_pieces(op6_packing(spark, save(documents=odd_docs)).collect(), TEXTS, 1024)
    assert sum(f < 1024 for f in fills) <= odd_docs.rdd.getNumPartitions()
    assert op6_packing(spark, save(documents=no_docs)).count() == 0


def test_packing_leaves_one_gap_at_most_and_returns_ids(spark):
    rng = random.Random(1)
    texts = ["w " * rng.randint(0, 90) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    made = packing.pack(docs, JSON, PATTERN, window=64)
    rows = made.withColumnRenamed("id", "doc_id").collect()
    fills = check_pieces(rows, texts, 64)
    assert sum(f < 64 for f in fills) <= 1
    assert all(len(r.ids) == r.length for r in rows)


def test_level_choice_equals_brute_force():
    rng = random.Random(2)
    levels, size = packing.Levels(20), 20
    for window in range(2000):
        length = rng.randint(1, 20)

        def squares(level):
            count = levels.count.copy()
            if level:
                count[level] -= 1
            if level + length < size:
                count[level + length] += 1
            return int((count[:size] ** 2).sum())

        options = [h for h in range(1, size - length + 1) if levels.count[h]] + [0]
        best = min(squares(h) for h in options)
        chosen = levels.choose(length)
        assert squares(chosen) == best
        assert chosen == max(h for h in options if squares(h) == best)
        levels.put(chosen + length, levels.take(chosen) if chosen else window)
