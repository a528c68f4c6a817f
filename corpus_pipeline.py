"""A corpus pipeline of five operators; each stage's documents are written and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import queries
from tessera.llm.common import Scratch, numbered, unique_ids, unique_name
from tessera.llm.decontaminate import without_items
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.sentencepiece_codec import encode
from tessera.llm.simhash import bits_for, simhash_components
from tessera.llm.toxicity import train_on, under

WORDS = 4


def _stays(spark: SparkSession, docs: DataFrame, gone: Callable[[DataFrame, str], DataFrame], *, nulls_first: bool) -> DataFrame:
    """The rows of ``docs`` without those whose id ``gone(docs, id column)`` gives. Where ids are null or
    repeat, rows are numbered in the order of their ids first, so that each is decided on its own."""
    name = "doc_id"
    if not unique_ids(docs, name):
        name = unique_name(docs, "row")
        rows = numbered(Scratch(spark), docs, "doc_id", name, nulls_first=nulls_first)
    else:
        rows = docs
    return rows.join(gone(rows, name).select(F.col("doc_id").alias(name)), name, "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold. Null and empty texts score as clean; every row
    is scored on its own, whatever its id."""
    model = train_on(spark, docs, queries.table(spark, sf_dir, "labels"))
    return under(docs, model, queries.TOXIC_FROM)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id (a null id is less than any;
    of rows that repeat an id one stays). Null texts are empty ones."""
    return _stays(spark, docs, lambda rows, name: exact_dedup(spark, rows, id_col=name).filter("NOT kept"), nulls_first=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts: five-word shingles, an estimated similarity of 0.8 or
    more; the one with the least id (null ids last). Texts without words are alike."""

    def gone(rows: DataFrame, name: str) -> DataFrame:
        found = simhash_components(spark, rows, id_col=name, shingle=5, words=WORDS, most_bits=bits_for(0.8, WORDS), free_bits=5)
        return found.filter("component_id <> doc_id")

    return _stays(spark, docs, gone, nulls_first=False)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; null and empty texts hold none, and every row is decided on
    its own, whatever its id."""
    return without_items(spark, docs, queries.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of the documents that are left; a null or empty text has no ids."""
    return encode(spark, docs, queries.piece_model_path()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("sentencepiece", tokens),
]

#: Toxicity, SimHash, alignment and the codec can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; an empty table gives an empty one, and columns other than ``doc_id`` and
    ``text`` are carried through the filtering stages unread."""
    docs, scratch = queries.table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
