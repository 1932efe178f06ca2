"""From raw documents to packed training sequences: five stages, each one operator of ``llm``.

``STAGES`` lists ``(name, function)``. A function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame; ``run`` writes each result as Parquet to the shared folder and reads it back as the
next stage's ``docs``. All stages but the last return the columns of ``docs``, extra ones included.

* ``language`` keeps the documents that the language model accepts: those whose language is to be
  kept (by default any learned one) with a score that is surer than chance. Texts that are null
  or without a letter always go; where no language can be learned only they do.
* ``toxicity`` keeps the documents that score below the threshold.
* ``near_dedup`` keeps one row of each component of SimHash fingerprints within two bits: that with
  the smallest id, then the smallest digest of its text, then the smallest text and other columns.
  Rows count one by one, also those that repeat an id; rows without an id come after all others.
* ``secrets`` keeps all documents and replaces every secret in their texts by a label; ``n_chars``
  follows where a text changes. Null texts stay null.
* ``packing`` returns pieces in sequences of 1,024 tokens with their ids.

An empty table passes through as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm import packing, secret_scan, simhash
from llm.common import blocks, documents, map_batches, stored
from llm.language import SURE
from llm.queries import TOXIC, language_model, toxicity_model
from llm.toxicity import BLOCK_BYTES

#: Columns that near_dedup adds for a while.
ROW, PLACE = "_near_dedup_row", "_near_dedup_place"


def language(
    spark: SparkSession, docs: DataFrame, sf_dir: str, keep: set[str] | None = None, sure: float = SURE
) -> DataFrame:
    """Documents that a model learned from ``docs`` accepts as one of the languages to ``keep``
    (None: of all learned), with a score of at least ``sure`` times what chance gives."""
    model = language_model(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = model.accepts(batch.column("text").to_pylist(), keep, sure)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return map_batches(docs, run, docs.schema)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, by a model learned from their labels."""
    model = toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            scores = model.score([t or "" for t in block.column("text").to_pylist()])
            yield block.filter(pa.array(scores < TOXIC, pa.bool_()))

    return map_batches(docs, run, docs.schema)


def row_key() -> Column:
    """Sorts rows by id, null last, and then by a digest of the text; equal only where both are."""
    place = F.lpad(F.hex(F.col("doc_id").cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    text = F.coalesce(F.concat(F.lit("="), "text"), F.lit(""))
    return F.concat(F.coalesce(place, F.lit("~")), F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicate fingerprints: that with the smallest key."""
    keyed = docs.withColumn(ROW, row_key())
    found = simhash.near_duplicates(keyed, ROW)
    kept = found.where(F.col("id") == F.col("component")).select(F.col("id").alias(ROW)).distinct()
    # Rows of one id and text differ in other columns at most; a task passes on one of each.
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = Window.partitionBy(ROW).orderBy(F.to_json(F.struct(*others)) if others else ROW)
    rows = keyed.withColumn(PLACE, F.row_number().over(order)).where(F.col(PLACE) == 1)
    return rows.join(kept, ROW, "left_semi").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            texts = column.to_pylist()
            masked = [t if t is None else secret_scan.masked(t) for t in texts]
            changed = [i for i, (old, new) in enumerate(zip(texts, masked)) if old != new]
            if changed:
                made = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(masked, column.type))
                if "n_chars" in batch.schema.names:
                    sizes = batch.column("n_chars").to_pylist()
                    for i in changed:
                        sizes[i] = len(masked[i])
                    at = batch.schema.get_field_index("n_chars")
                    made = made.set_column(at, "n_chars", pa.array(sizes, batch.column("n_chars").type))
                batch = made
            yield batch

    return map_batches(docs, run, docs.schema)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences, with their token ids."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(docs, path, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", language),
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("packing", pack),
]

#: Tokenizers, trained models and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the last one's rows."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
