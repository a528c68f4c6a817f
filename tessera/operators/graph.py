"""Graph operators over edge tables: closure, bounded paths, cycles, longest chains, blast radius."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Rounds:
    """Tables of an iteration in ``spark.checkpoint.dir``, the folder that all executors share."""

    def __init__(self, spark: SparkSession):
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
            spark.conf.set("spark.checkpoint.dir", folder)
        self.spark, self.root, self.n = spark, f"{folder}/rounds-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/r{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def reachable(spark: SparkSession, edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """GR-3, GR-4: ``src, dst, depth`` for every node ``dst`` reachable from ``src`` by one edge or more,
    with the least number of edges; a node on a cycle reaches itself.

    Semi-naive: each round extends only what the last one found and is written before the next; the loop
    ends when a round finds nothing. ``seeds`` (column ``src``) limits the sources.
    """
    rounds = Rounds(spark)
    e = rounds.keep(edges.select("src", "dst").distinct())
    new = e if seeds is None else e.join(seeds.select("src").distinct(), "src", "left_semi")
    new = rounds.keep(new.withColumn("depth", F.lit(1)))
    found = [new]
    step = e.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    depth = 1
    while not new.isEmpty():
        depth += 1
        far = new.join(step, "dst").select("src", F.col("next").alias("dst")).distinct()
        known = found[0]
        for f in found[1:]:
            known = known.union(f)
        new = rounds.keep(far.join(known, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        found.append(new)
        if len(found) > 8:  # keeps the plan of a round short
            found = [rounds.keep(known.union(new))]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def cycle_nodes(closure: DataFrame) -> DataFrame:
    """GR-5c: nodes on a cycle."""
    return closure.filter("src = dst").select(F.col("src").alias("node")).distinct()


def path_tree(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """GR-2: ``root, path, depth, is_cycle`` of all paths of up to ``depth`` edges from the roots; a path
    that comes back to one of its nodes ends there, marked as a cycle."""
    e = edges.select("src", "dst").distinct()
    level = roots.select(F.col("root"), F.array("root").alias("path"), F.lit(0).alias("depth"), F.lit(False).alias("is_cycle"))
    out = level
    for d in range(1, depth + 1):
        open_ = level.filter("NOT is_cycle").withColumn("src", F.element_at("path", -1))
        level = open_.join(e, "src").select("root", F.concat("path", F.array("dst")).alias("path"), F.lit(d).alias("depth"), F.array_contains("path", F.col("dst")).alias("is_cycle"))
        out = out.union(level)
    return out


def shortest_path(spark: SparkSession, edges: DataFrame, start: str, goal: str) -> list[str] | None:
    """GR-5b: a shortest path (the first in alphabetical order of equals), or None.

    The frontier keeps one path a node, so it never holds more rows than there are nodes."""
    rounds = Rounds(spark)
    e = rounds.keep(edges.select("src", "dst").distinct())
    front = spark.createDataFrame([(start, [start])], "node string, path array<string>")
    seen = front.select("node")
    while True:
        hit = front.filter(F.col("node") == goal).select("path").first()
        if hit:
            return list(hit.path)
        step = front.join(e, front.node == e.src).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        step = step.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
        front = rounds.keep(step)
        if front.isEmpty():
            return None
        seen = rounds.keep(seen.union(front.select("node")))


def longest_chain(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """GR-6: ``node, length`` of the longest path without repeats from each node. Each round's open paths are
    written; the rounds end when none is open, after as many as the longest path has edges."""
    rounds = Rounds(spark)
    e = rounds.keep(edges.select("src", "dst").distinct())
    level = rounds.keep(e.select(F.col("src").alias("root"), F.array("src", "dst").alias("path")).filter("src <> dst"))
    out = e.select(F.col("src").alias("node"), F.lit(0).alias("length"))
    length = 0
    while not level.isEmpty():
        length += 1
        out = out.union(level.select("root", F.lit(length)).distinct())
        longer = level.withColumn("src", F.element_at("path", -1)).join(e, "src").filter(~F.array_contains("path", F.col("dst")))
        level = rounds.keep(longer.select("root", F.concat("path", F.array("dst")).alias("path")))
    return out.groupBy("node").agg(F.max("length").alias("length"))


def blast_level(score: Column) -> Column:
    """F-10."""
    return F.when(score >= 25, "high").when(score >= 8, "medium").otherwise("low")


def blast_radius(closure: DataFrame, nodes: DataFrame) -> DataFrame:
    """GR-3b: over the closure of caller -> callee, for each called node: how many others reach it, from
    how many files and packages, the score 2 * reach + files + packages + 5 if exported, and its level.

    ``nodes`` has ``node, file, package, exported``."""
    who = nodes.select(F.col("node").alias("src"), "file", "package")
    reach = closure.filter("src <> dst").select("src", "dst").distinct().join(who, "src")
    out = reach.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("reach"), F.countDistinct("file").alias("files"), F.countDistinct("package").alias("packages"))
    out = out.join(nodes.select("node", "exported"), "node")
    score = 2 * F.col("reach") + F.col("files") + F.col("packages") + F.when(F.col("exported"), 5).otherwise(0)
    return out.withColumn("score", score).withColumn("level", blast_level(F.col("score")))


def resolve_calls(raw: DataFrame, defs: DataFrame) -> DataFrame:
    """J-1c, GR-1: distinct ``src, dst`` edges of raw calls (caller_key, callee_name, is_selector).

    A plain call goes to the plain function of that name; a selector call to that and to every method of
    the name. ``defs`` has ``key, name, receiver``. Two equality joins, never one with an OR."""
    plain = defs.filter("receiver = ''").select(F.col("key").alias("dst"), F.col("name").alias("callee_name"))
    methods = defs.filter("receiver <> ''").select(F.col("key").alias("dst"), F.col("name").alias("callee_name"))
    calls = raw.select(F.col("caller_key").alias("src"), "callee_name", "is_selector").distinct()
    a = calls.join(plain, "callee_name").select("src", "dst")
    b = calls.filter("is_selector").join(methods, "callee_name").select("src", "dst")
    return a.union(b).distinct()
