"""Unified diffs as tables of hunks, runs and classified changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import hunk_header, identifiers


def parse_diff(lines: DataFrame) -> DataFrame:
    """S-9, W-2b: lines ``diff_id, pos, line`` with the file and hunk they belong to, their mark and their old
    and new line numbers. Lines before a hunk, and those that begin with a backslash, are left out."""
    line = F.col("line")
    d = lines.withColumn("h", hunk_header(line))
    so_far = Window.partitionBy("diff_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    header = line.rlike(r"^(diff --git |index |--- |\+\+\+ |new file|deleted file|similarity|rename )")
    d = d.withColumn("file", F.last(F.when(line.rlike(r"^\+\+\+ "), F.regexp_replace(line, r"^\+\+\+ (b/)?", "")), ignorenulls=True).over(so_far))
    d = d.withColumn("hunk", F.last(F.when(F.col("h").isNotNull(), F.struct("pos", "h")), ignorenulls=True).over(so_far))
    fresh = F.last(F.when(line.startswith("diff --git ") | F.col("h").isNotNull(), F.col("h").isNotNull()), ignorenulls=True).over(so_far)
    d = d.withColumn("inside", F.coalesce(fresh, F.lit(False))).filter("hunk IS NOT NULL AND inside AND h IS NULL").filter(~line.startswith("\\"))
    d = d.filter(~(header & line.rlike(r"^(diff|index|new file|deleted file|similarity|rename) ")))
    d = d.withColumn("mark", F.when(line.startswith("+"), "+").when(line.startswith("-"), "-").otherwise(" "))
    within = Window.partitionBy("diff_id", "hunk.pos").orderBy("pos")
    count = lambda marks: F.sum(F.col("mark").isin(*marks).cast("int")).over(within.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("old_line", F.col("hunk.h.old_start") + F.coalesce(count([" ", "-"]), F.lit(0)))
    d = d.withColumn("new_line", F.col("hunk.h.new_start") + F.coalesce(count([" ", "+"]), F.lit(0)))
    return d.select("diff_id", "pos", "file", F.col("hunk.pos").alias("hunk"), "mark", F.substring(line, F.lit(2), F.length(line)).alias("text"), "old_line", "new_line")


def runs(parsed: DataFrame) -> DataFrame:
    """W-2: consecutive changed lines: the old and new text and where they start; context ends a run."""
    within = Window.partitionBy("diff_id", "hunk").orderBy("pos")
    changed = F.col("mark") != " "
    start = (changed & (~F.coalesce(F.lag("mark").over(within) != " ", F.lit(False)))).cast("int")
    d = parsed.withColumn("s", start).withColumn("run", F.sum("s").over(within.rowsBetween(Window.unboundedPreceding, 0))).filter(changed)
    side = lambda mark: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("pos", "mark", "text"))), lambda x: x["mark"] == mark), lambda x: x["text"]), "\n")
    return d.groupBy("diff_id", "file", "hunk", "run").agg(F.min("old_line").alias("old_line"), F.min("new_line").alias("new_line"), side("-").alias("old"), side("+").alias("new"))


def classify(old: Column, new: Column) -> Column:
    """F-8: (kind, confidence) of a change: methods before functions before interfaces before structs."""
    has = lambda c, p: c.rlike(p)
    out = F
    as_ = lambda kind, sure: F.struct(F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"))
    for kind, p in (("method", r"(?m)^\s*func\s*\("), ("function", r"(?m)^\s*func\s+\w"), ("interface", r"(?m)^\s*type\s+\w+\s+interface\b"), ("struct", r"(?m)^\s*type\s+\w+\s+struct\b"), ("import", r'(?m)^\s*(import\b|"[\w./-]+"$)')):
        both, only_new, only_old = has(old, p) & has(new, p), has(new, p) & ~has(old, p), has(old, p) & ~has(new, p)
        out = out.when(both, as_(f"{kind}_modified", 0.8))
        out = out.when(only_new, as_(f"{kind}_added", 0.9))
        out = out.when(only_old, as_(f"{kind}_removed", 0.9))
    gone, came = F.array_except(identifiers(old), identifiers(new)), F.array_except(identifiers(new), identifiers(old))
    renamed = (F.size(gone) == 1) & (F.size(came) == 1) & (F.regexp_replace(old, F.concat(F.lit(r"\b"), gone[0], F.lit(r"\b")), came[0]) == new)
    return out.when(renamed, as_("rename", 0.7)).otherwise(as_("modification", 0.6))


def names_of(text: Column) -> Column:
    """F-8b: the declared name."""
    p = (r"func\s*\([^)]*\)\s*(\w+)", r"func\s+(\w+)", r"type\s+(\w+)")
    return F.coalesce(*(F.nullif(F.regexp_extract(text, x, 1), F.lit("")) for x in p))


def changes(parsed: DataFrame) -> DataFrame:
    r = runs(parsed).withColumn("c", classify(F.col("old"), F.col("new")))
    return r.select("diff_id", "file", "hunk", "run", "old_line", "new_line", "old", "new", "c.kind", "c.confidence", F.coalesce(names_of(F.col("new")), names_of(F.col("old"))).alias("name"))


def summary(changed: DataFrame) -> DataFrame:
    """AG-15."""
    return changed.groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind")


def consolidated_rename(changed: DataFrame) -> DataFrame:
    """AG-16: if all renames of a diff are one rename: its lines and occurrences; else no row."""
    gone = F.array_except(identifiers(F.col("old")), identifiers(F.col("new")))[0]
    came = F.array_except(identifiers(F.col("new")), identifiers(F.col("old")))[0]
    r = changed.filter("kind = 'rename'").select("diff_id", gone.alias("old_name"), came.alias("new_name"), "old_line")
    g = r.groupBy("diff_id").agg(F.countDistinct("old_name", "new_name").alias("kinds"), F.min("old_name").alias("old_name"), F.min("new_name").alias("new_name"), F.min("old_line").alias("first_line"), F.max("old_line").alias("last_line"), F.count("*").alias("occurrences"))
    return g.filter("kinds = 1").drop("kinds")
