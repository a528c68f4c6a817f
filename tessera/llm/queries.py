"""The queries ``opN_<name>`` of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import decontaminate
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.licenses import license_scan, license_scan_sql
from tessera.llm.repeats import remove_repeats, remove_repeats_sql
from tessera.llm.secrets import secret_scan
from tessera.llm.secrets_sql import secret_scan_sql
from tessera.llm.sentencepiece_codec import round_trips
from tessera.llm.simhash import simhash_components
from tessera.llm.token_counts import token_counts
from tessera.llm.toxicity import held_out, toxicity, train_on
from tessera.llm.warc import derivatives, derivatives_sql, page_responses

PIECE_MODEL = "piece_bpe_32k.model"
TOXIC_FROM = 0.7


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark passage: ``doc_id, item_id, score, first_word, last_word, n_seeds``."""
    return decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_clauses`` of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(spark, docs, train_on(spark, docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "n_clauses")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark, table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, fingerprint, component_id``: four-word shingles, links at up to four differing bits."""
    found = simhash_components(spark, table(spark, sf_dir, "documents"), shingle=4, most_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


#: ``documents`` has no paths: its rows are laid out in directories of their source, 32 a directory and 32
#: directories above each other, where every 32nd row stands for the directory's licence file.
PATH_SQL = "source || '/' || (doc_id {div} 1024) || '/' || (doc_id {div} 32) || '/' || CASE WHEN doc_id % 32 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END"


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, path, license, score, basis, from_path`` of every document."""
    return license_scan(spark, table(spark, sf_dir, "documents"), path=F.expr(PATH_SQL.format(div="div")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, table(spark, sf_dir, "documents"), piece_model_path())


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip`` of every document."""
    return round_trips(spark, table(spark, sf_dir, "documents"), piece_model_path())


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linked records of every page, with digests in place of blocks and records."""
    found = derivatives(spark, page_responses(table(spark, sf_dir, "pages")))
    return found.select("record_id", "warc_type", "refers_to", "target_uri", "content_type", "content_length", "block_digest", "source_digest", F.sha2(F.encode("record", "utf-8"), 256).alias("record_sha256"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    return remove_repeats(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_toxicity": op2_toxicity,
    "op3_secrets": op3_secrets,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_simhash": op5_simhash,
    "op6_licenses": op6_licenses,
    "op7_token_counts": op7_token_counts,
    "op8_warc": op8_warc,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_repeats": op10_repeats,
}

ORACLE_SQL: dict[str, str] = {
    "op3_secrets": secret_scan_sql(),
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op6_licenses": license_scan_sql(PATH_SQL.format(div="//")),
    "op8_warc": derivatives_sql(),
    "op10_repeats": remove_repeats_sql(),
}
