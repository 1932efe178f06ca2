"""Token counts from a tokenizer file, returning lengths only.

Texts are cut at safe boundaries, ASCII white space: the tokenizers meant here (``.json``
files that drop white space) never join or normalise across it, so a text has as many
tokens as its pieces together. Each distinct piece of a block is encoded once, in batches
of about equal bytes. ``.model`` files keep white space as part of a token; their texts are
encoded whole, in batches of about equal bytes.

A null text is empty and has 0 bytes and 0 tokens. Rows are counted one by one, also those that
repeat an id or have none. Other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from llm.common import blocks, map_batches

BLOCK_BYTES = 24 << 20
ENCODE_BYTES = 128 << 10


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts the tokens of each text of a list."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def balanced(count: Callable[[list[str]], list[int]], texts: pa.Array) -> np.ndarray:
    """``count`` over slices of about ``ENCODE_BYTES``."""
    if not len(texts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    cuts = np.unique(np.searchsorted(ends, np.arange(ENCODE_BYTES, ends[-1] + ENCODE_BYTES, ENCODE_BYTES)) + 1)
    out, at = [], 0
    for cut in [*cuts.tolist(), len(texts)]:
        if cut > at:
            out += count(texts.slice(at, cut - at).to_pylist())
            at = min(cut, len(texts))
    return np.asarray(out, dtype=np.int64)


def count_block(texts: pa.Array, path: str) -> np.ndarray:
    """Tokens of each text of an array without nulls."""
    count = counter(path)
    if path.endswith(".model"):
        return balanced(count, texts)
    pieces = pc.ascii_split_whitespace(texts)
    flat = pieces.flatten().dictionary_encode()
    per_piece = balanced(count, flat.dictionary)
    total = np.r_[0, np.cumsum(per_piece[flat.indices.to_numpy()])]
    sizes = pc.list_value_length(pieces).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_tokens`` of every text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            texts = pc.fill_null(block.column("text"), "")
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("id"),
                    pc.cast(pc.binary_length(texts), pa.int64()),
                    pa.array(count_block(texts, path), pa.int64()),
                ],
                ["id", "n_bytes", "n_tokens"],
            )

    return map_batches(
        df.selectExpr(f"`{id_col}` id", f"`{text_col}` text"), run, f"id {kind}, n_bytes bigint, n_tokens bigint"
    )
