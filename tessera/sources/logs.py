"""Append-only JSON-lines logs, read as tables and written by appending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAILURES = "ts string, kind string, tool string, op string, reason string, spec string, context string"
OUTCOMES = "ts string, fingerprint string, outcome string"
JOURNAL = "id string, timestamp string, files array<string>"
SWEEP = "model string, mode string, pass boolean, prompt_tok bigint, compl_tok bigint, wall_ms bigint"
LINE_CAP = 4 << 20


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S-7: records in file order (column ``position``); malformed lines and lines over 4 MiB are skipped, and
    absent fields have their type's zero value, not null."""
    lines = spark.read.text(path).select(F.col("value"), F.monotonically_increasing_id().alias("position"), F.col("_metadata.file_path").alias("log_file"))
    lines = lines.filter(F.octet_length("value") <= LINE_CAP).filter(F.trim("value") != "")
    fields = spark.createDataFrame([], schema).schema
    parsed = lines.select("log_file", "position", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    zero = {"string": "''", "bigint": "0L", "int": "0", "boolean": "false", "double": "0.0D"}
    good = parsed.filter("r IS NOT NULL AND r._bad IS NULL")
    return good.select("log_file", "position", *(F.coalesce(F.col(f"r.{f.name}"), F.expr(zero[f.dataType.simpleString()])).alias(f.name) if f.dataType.simpleString() in zero else F.col(f"r.{f.name}").alias(f.name) for f in fields))


def tail(df: DataFrame, n: int = 2000) -> DataFrame:
    """S-7b: the last ``n`` records, a bounded reading of the log."""
    return df.orderBy(F.desc("log_file"), F.desc("position")).limit(n)


def append(df: DataFrame, path: str) -> None:
    """S-14."""
    df.write.mode("append").json(path)


def history(df: DataFrame) -> DataFrame:
    """Journal entries by time."""
    return df.orderBy("timestamp", "id")
