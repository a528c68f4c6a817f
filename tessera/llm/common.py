"""Shared plumbing of the training-data operators: scratch tables, Arrow maps, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from tessera.functions.shipping import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``. Where it is unset, a temporary folder does on
    one machine; a cluster's executors would each write to their own, so there the setting is asked for."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: While a scratch table is written: it replaces its shuffle files, and workers get batches of a few megabytes.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


class Scratch:
    """Tables in the shared folder that cut lineage, so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> tuple[DataFrame, str]:
        """Write ``df`` and return it reread, with its path."""
        self.count += 1
        path = f"{self.root}/t{self.count}"
        before = {k: self.spark.conf.get(k) for k in WRITING}
        for k, v in WRITING.items():
            self.spark.conf.set(k, v)
        try:
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path), path

    def table(self, df: DataFrame) -> DataFrame:
        return self.keep(df)[0]

    def drop(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: What operators keep in a worker process between tasks, by operator.
kept: dict[str, dict] = {}


def keeping(operator: str) -> dict:
    """The operator's own store in this worker process; it lives until another operator's task runs here."""
    return kept.setdefault(operator, {})


def release(operator: str | None) -> None:
    """Empty the stores of all other operators, so that a worker holds the memos of one at a time."""
    for name, store in kept.items():
        if name != operator:
            store.clear()


def arrow_map(df: DataFrame, make: Callable[[], Callable[..., dict]], schema: str, operator: str | None = None, *, arrays: bool = False) -> DataFrame:
    """``mapInArrow`` over lists: ``make()`` runs once a task and returns ``f(*columns) -> columns``.
    ``operator`` names whose store stays in the worker; with ``arrays`` columns are passed as Arrow arrays.

    Batches are cut to about BATCH_BYTES of input, so that a run of very long texts needs no more
    memory than a run of short ones.
    """
    ship(df.sparkSession)
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(operator)
        work = None
        for batch in batches:
            rows = max(1, int(batch.num_rows * min(1.0, BATCH_BYTES / max(1, batch.nbytes))))
            for start in range(0, batch.num_rows, rows):
                work = work or make()
                got = work(*(c if arrays else c.to_pylist() for c in batch.slice(start, rows).columns))
                yield pa.RecordBatch.from_arrays([got[f.name].cast(f.type) if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, _parse_datatype_string(schema))


def arrow_filter(df: DataFrame, text_col: str, make: Callable[[], Callable[[list[str]], list[bool]]], operator: str | None = None) -> DataFrame:
    """The rows of ``df``, with all their columns, whose text ``make()`` accepts; nulls count as empty texts.
    Rows stay where they are. The text is passed beside the row, so no column name can clash."""
    ship(df.sparkSession)
    name = unique_name(df, "accepted text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(operator)
        work = None
        for batch in batches:
            rows = max(1, int(batch.num_rows * min(1.0, BATCH_BYTES / max(1, batch.nbytes))))
            for start in range(0, batch.num_rows, rows):
                work = work or make()
                part = batch.slice(start, rows)
                keep = pa.array(work(part.column(part.num_columns - 1).to_pylist()), pa.bool_())
                yield pa.RecordBatch.from_arrays(part.columns[:-1], names=part.schema.names[:-1]).filter(keep)

    return df.withColumn(name, text_or_empty(text_col)).mapInArrow(run, df.schema)


BATCH_BYTES = 4 << 20


def unique_ids(df: DataFrame, id_col: str) -> bool:
    """Whether no id is null and none repeats."""
    n = df.agg(F.count("*"), F.count(F.col(id_col))).first()
    return n[0] == n[1] and df.groupBy(id_col).agg(F.count("*").alias("times")).filter("times > 1").isEmpty()


def numbered(scratch: Scratch, df: DataFrame, id_col: str, name: str, *, nulls_first: bool) -> DataFrame:
    """``df`` with a number for each row, in a written table, rising with the id; null ids come first or last."""
    order = F.col(id_col).asc_nulls_first() if nulls_first else F.col(id_col).asc_nulls_last()
    return scratch.table(df.orderBy(order).withColumn(name, F.monotonically_increasing_id()))


def unique_name(df: DataFrame | StructType, stem: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df.fieldNames())}
    while stem.lower() in taken:
        stem += "_"
    return stem


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Connected components by alternating large and small stars; ``edges`` has longs ``a``, ``b``.

    Returns ``(node, component)`` for nodes with an edge; ``component`` is the smallest node reachable.
    Each round is a written table, so rounds neither lengthen the lineage nor rest on one executor.
    The minimum per node is partially aggregated and joined back, so a star's hot centre is split by
    the engine's skew-join handling instead of being gathered into one task.
    """
    scratch = scratch or Scratch(spark)
    now, path = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        after, made = scratch.keep(small)
        scratch.drop(path)
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now, path = after, made
        if state == before:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
