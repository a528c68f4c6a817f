"""Findings: tiers, policy, gates, order, display, baselines and the health score.

A finding has ``file, line, rule, severity, category, message, value, threshold``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fingerprint
from tessera.operators import kernels

COLUMNS = ("file", "line", "rule", "severity", "category", "message", "value", "threshold")
SCHEMA = "file string, line int, rule string, severity string, category string, message string, value bigint, threshold bigint"


def fails(severity: Column, gate: str) -> Column:
    """P-1: an error gate fails on errors, a warning gate on warnings too; info never fails."""
    return severity.isin(*{"error": ["error"], "warning": ["warning", "error"]}.get(gate, []))


def gate(df: DataFrame, level: str) -> DataFrame:
    """P-1b."""
    return df.withColumn("fails", fails(F.col("severity"), level))


def override(df: DataFrame, tiers: Mapping[str, str]) -> DataFrame:
    """P-3b: a rule's tier takes the place of its severity; rules that are off go."""
    if not tiers:
        return df
    table = F.create_map(*(F.lit(x) for pair in tiers.items() for x in pair))
    return df.withColumn("severity", F.coalesce(F.try_element_at(table, F.col("rule")), F.col("severity"))).filter("severity <> 'off'")


def selected(rules: Sequence[str], only: Sequence[str] = (), skip: Sequence[str] = (), tiers: Mapping[str, str] | None = None) -> list[str]:
    """P-3: the rules to run, in their order; known before anything is read."""
    off = {r for r, t in (tiers or {}).items() if t == "off"}
    return [r for r in rules if (not only or r in only) and r not in skip and r not in off]


def exclude(df: DataFrame, policy: DataFrame) -> DataFrame:
    """P-3c: without the findings whose (rule, package) the policy leaves out; a package '*' is any, and a
    package 'tests' is every test file."""
    package = F.regexp_replace("file", "/?[^/]*$", "")
    p = policy.select(F.col("rule").alias("_r"), F.col("package").alias("_p"))
    tagged = df.withColumn("_keys", F.array_compact(F.array(package, F.lit("*"), F.when(F.col("file").endswith("_test.go"), F.lit("tests")))))
    out = tagged.join(p, (F.col("rule") == F.col("_r")) & F.array_contains("_keys", F.col("_p")), "left_anti")
    return out.drop("_keys")


def merged(df: DataFrame, root: str, generated: DataFrame | None = None) -> DataFrame:
    """P-3d: without generated files (column ``file``), and without the root's prefix in messages."""
    out = df.withColumn("message", F.replace("message", F.lit(root.rstrip("/") + "/"), F.lit("")))
    return out if generated is None else out.join(generated.select("file").distinct(), "file", "left_anti")


def display(df: DataFrame) -> DataFrame:
    """P-2: without info; the blast-radius findings of a file become one count."""
    many = df.filter("rule = 'high-blast-radius'").groupBy("file").agg(F.count("*").alias("value"))
    many = many.select("file", F.lit(0).alias("line"), F.lit("high-blast-radius").alias("rule"), F.lit("info").alias("severity"), F.concat(F.col("value").cast("string"), F.lit(" functions with a high blast radius")).alias("message"))
    return df.filter("severity <> 'info' AND rule <> 'high-blast-radius'").select("file", "line", "rule", "severity", "message").unionByName(many)


def ordered(df: DataFrame) -> DataFrame:
    """T-1, T-1b."""
    return df.orderBy("file", "line", "rule", "severity", "message")


def fingerprinted(df: DataFrame) -> DataFrame:
    """F-3b."""
    return df.withColumn("fingerprint", fingerprint(F.col("file"), F.col("rule"), F.col("message")))


def write_baseline(df: DataFrame, path: str) -> None:
    """S-13: the counted fingerprints, sorted."""
    kernels.baseline_of(fingerprinted(df), "fingerprint", "severity").orderBy("fingerprint").write.mode("overwrite").json(path)


def surfaced(df: DataFrame, baseline: DataFrame) -> DataFrame:
    """W-1: findings beyond the baseline."""
    return kernels.ratchet(fingerprinted(df), baseline, "fingerprint", ["file", "line", "rule", "message"])


# The health score's weights by severity; rules that only rank; proxies; one weight of its own.
SEVERITY_WEIGHTS = {"error": 3.0, "warning": 1.0, "info": 0.25}
EXEMPT = "high-blast-radius low-tool-adherence untested-function extract-candidate linear-search-in-loop naked-goroutine pass-through-param premature-abstraction test-only-live funcorder-constructor funcorder-struct-method funcorder-function".split()
PROXIES = "file-size long-function complexity deep-nesting hard-to-maintain god-object god-package large-class fat-interface excessive-params excessive-returns data-clumps type-switch high-coupling".split()
OWN_WEIGHTS = {"untested-package": 1.0}


def health(df: DataFrame, functions: int) -> DataFrame:
    """AG-9: one row, ``score`` from 0 to 100: 100 / (1 + weight / 50).

    Rules that only rank weigh nothing. A proxy weighs by how far its value is beyond the threshold (0.15
    to 1 of its severity, half where it has none), and all proxies are divided by max(1, functions /
    1000)."""
    lookup = lambda d, c: F.try_element_at(F.create_map(*(x for k, v in d.items() for x in (F.lit(k), F.lit(v)))), F.col(c))
    severity = F.coalesce(lookup(SEVERITY_WEIGHTS, "severity"), F.lit(0.0))
    over = F.when(F.col("threshold") > 0, F.greatest(F.lit(0.15), F.least(F.lit(1.0), (F.col("value") - F.col("threshold")) / F.col("threshold"))))
    proxy = severity * F.coalesce(over, F.lit(0.5)) / max(1.0, functions / 1000)
    weight = F.coalesce(lookup(OWN_WEIGHTS, "rule"), F.when(F.col("rule").isin(*EXEMPT), 0.0).when(F.col("rule").isin(*PROXIES), proxy).otherwise(severity))
    return df.agg(F.coalesce(F.sum(weight), F.lit(0.0)).alias("weight")).select(F.round(100 / (1 + F.col("weight") / 50), 6).alias("score"))


def severity_counts(df: DataFrame) -> DataFrame:
    """AG-9c."""
    return df.groupBy("severity").agg(F.count("*").alias("n"))


def verdict(new: DataFrame, substrates: DataFrame) -> DataFrame:
    """One row: green if no new error and no gating substrate that didn't run (``name, gating, state``)."""
    errors = new.agg(F.count_if(F.col("severity") == "error").alias("errors"))
    dark = substrates.agg(F.count_if(F.col("gating") & (F.col("state") != "ran")).alias("dark"))
    both = errors.select("errors", F.lit(0).alias("dark")).union(dark.select(F.lit(0), "dark"))
    return both.agg(F.sum("errors").alias("errors"), F.sum("dark").alias("dark")).withColumn("green", F.expr("errors = 0 AND dark = 0"))
