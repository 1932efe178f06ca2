"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import (
    bpe,
    ctph,
    embeddings,
    language,
    licenses,
    merkle,
    packing,
    pii,
    secret_scan,
    simhash,
    spelling,
    token_counts,
    toxicity,
)
from llm.common import documents

TOKEN_LIMIT = 2048
TOXIC = 0.3


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and their components of near-duplicates."""
    made = simhash.near_duplicates(documents(spark, sf_dir))
    return made.select(
        F.col("id").alias("doc_id"),
        simhash.hex_digits(F.col("fp")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts of the base kinds and all spans."""
    return secret_scan.scan(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id").drop("found")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and their decoding, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    made = bpe.round_trip(documents(spark, sf_dir), path, public_tokenizers.PATTERN)
    return made.withColumnRenamed("id", "doc_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is over the limit."""
    made = token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return made.withColumnRenamed("id", "doc_id").withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.95 or more."""
    made = embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return made.select(
        F.col("id").alias("vec_id"),
        "n_links",
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 1,024 tokens, one row per piece."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    made = packing.pack(documents(spark, sf_dir), path, public_tokenizers.PATTERN, with_ids=False)
    return made.withColumnRenamed("id", "doc_id")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts of the base kinds and all spans."""
    return pii.detect(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id").drop("found")


def op8_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piecewise-hash fingerprints of every document beside an edited text and the next one."""
    return ctph.against_next(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def in_fold(doc_id: str, folds: int, fold: int) -> Column:
    """Whether a document is in a fold by the CRC-32 of its id as text; a null id is in none."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learned from the labels of documents that are not held out."""
    return toxicity.train(docs, labels.where(~in_fold("doc_id", 4, 2)))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document."""
    docs = documents(spark, sf_dir)
    model = toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model).select(
        F.col("id").alias("doc_id"),
        in_fold("id", 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )


def language_model(docs: DataFrame) -> language.Model:
    """Learned from documents with a language that are not held out."""
    return language.train(docs.where(~in_fold("doc_id", 5, 0)))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = documents(spark, sf_dir)
    return language.classified(docs, language_model(docs)).select(
        F.col("id").alias("doc_id"), in_fold("id", 5, 0).alias("held_out"), "lang_pred", "score"
    )


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, with those at one edit counted, their forms and roots."""
    return spelling.variants(documents(spark, sf_dir))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices and expressions in every document."""
    places = F.transform("base", lambda b: b["word"])
    return licenses.scan(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        "base_labels",
        "labels",
        "score",
    )


def manifest_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """A leaf per document, and where ``tampered`` the one that its text in lower case gives."""
    columns = ["doc_id", "source", "lang", "n_chars"]
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("grouping"),
        merkle.leaf_digest([*map(F.col, columns), F.col("text")]).alias("digest"),
        F.when(tampered, merkle.leaf_digest([*map(F.col, columns), lower])).alias("other"),
    )


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proof for every document, and whether its text still gives the root."""
    made = merkle.manifest(manifest_leaves(documents(spark, sf_dir), in_fold("doc_id", 3, 0)))
    shown = merkle.folded(F.coalesce("other", "leaf"), F.col("path"))
    return (
        made.proofs()
        .select(
            F.col("id").alias("doc_id"),
            "leaf",
            "subroot",
            "root",
            merkle.siblings_digest(F.col("path")).alias("proof_sha256"),
            shown.alias("folded_root"),
        )
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_simhash,
        op2_secret_scan,
        op3_bpe,
        op4_token_counts,
        op5_embeddings,
        op6_packing,
        op7_pii,
        op8_ctph,
        op9_toxicity,
        op10_language,
        op11_spelling,
        op12_licenses,
        op13_merkle,
    )
}

# CRC-32 of the decimal id, bit by bit; lists start with the value they are folded from.
_CRC = """xor(list_reduce(
    list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
    lambda crc, byte: list_reduce(
        list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
        lambda x, zero: xor(x >> 1, (x & 1) * 3988292384 + zero))), 4294967295::UBIGINT)"""
_LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def _leaf_sql(text: str) -> str:
    parts = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({p})::VARCHAR || ':' || {p}, '-')" for p in parts) + "))"


ORACLE: dict[str, str] = {
    "op13_merkle": f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
        CASE WHEN {_CRC} % 3 = 0 THEN {_leaf_sql(_LOWER)} ELSE {_leaf_sql("text")} END AS shown
    FROM documents
), placed AS (
    SELECT *, row_number() OVER () AS row,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
        count(*) OVER (PARTITION BY lang) AS n
    FROM leaves
), up AS (
    SELECT 0 AS h, lang, i, n, leaf AS d FROM placed
    UNION ALL
    SELECT h + 1, lang, i // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY i))
    FROM up WHERE n > 1 GROUP BY h, lang, i // 8, n
), tops AS (
    SELECT lang, h AS height, d AS subroot, count(*) OVER () AS n,
        row_number() OVER (ORDER BY coalesce('=' || lang, '')) - 1 AS i
    FROM up WHERE n = 1
), above AS (
    SELECT 0 AS h, i, n, subroot AS d FROM tops
    UNION ALL
    SELECT h + 1, i // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM above WHERE n > 1 GROUP BY h, i // 8, n
), around AS (
    SELECT p.row, s.h, string_agg(s.d, '' ORDER BY s.i) FILTER (s.i < p.i >> (3 * s.h)) AS l,
        string_agg(s.d, '' ORDER BY s.i) FILTER (s.i > p.i >> (3 * s.h)) AS r
    FROM placed p JOIN up s ON s.lang IS NOT DISTINCT FROM p.lang AND s.n > 1 AND s.i // 8 = p.i >> (3 * (s.h + 1))
    GROUP BY p.row, s.h
    UNION ALL
    SELECT p.row, t.height + s.h, string_agg(s.d, '' ORDER BY s.i) FILTER (s.i < t.i >> (3 * s.h)),
        string_agg(s.d, '' ORDER BY s.i) FILTER (s.i > t.i >> (3 * s.h))
    FROM placed p JOIN tops t ON t.lang IS NOT DISTINCT FROM p.lang
    JOIN above s ON s.n > 1 AND s.i // 8 = t.i >> (3 * (s.h + 1))
    GROUP BY p.row, t.height + s.h
), path AS (
    SELECT row, h, coalesce(l, '') AS l, coalesce(r, '') AS r FROM around
), fold AS (
    SELECT row, 0 AS h, shown AS d FROM placed
    UNION ALL
    SELECT row, h + 1, sha256(l || d || r) FROM fold JOIN path USING (row, h)
)
SELECT doc_id, leaf, subroot, (SELECT d FROM above WHERE n = 1) AS root,
    sha256(coalesce((SELECT string_agg(l || r, '' ORDER BY h) FROM path WHERE path.row = placed.row), '')) AS proof_sha256,
    folded.d AS folded_root, folded.d = (SELECT d FROM above WHERE n = 1) AS verified
FROM placed JOIN tops ON tops.lang IS NOT DISTINCT FROM placed.lang
JOIN (SELECT row, max_by(d, h) AS d FROM fold GROUP BY row) folded USING (row)
""",
}
