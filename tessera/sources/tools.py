"""Outputs of external tools as findings (S-10, S-11), and configuration (S-8)."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.findings import COLUMNS


def _findings(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def _with(df: DataFrame, rule, severity: str, category: str) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return _findings(df.withColumns({"rule": rule, "severity": F.lit(severity), "category": F.lit(category), "value": zero, "threshold": zero}))


def golangci(reports: DataFrame) -> DataFrame:
    """``data``: a linter report with Issues."""
    schema = "Issues array<struct<FromLinter:string,Text:string,Pos:struct<Filename:string,Line:int>>>"
    i = reports.select(F.inline(F.from_json("data", schema)["Issues"]))
    return _with(i.select(F.col("Pos.Filename").alias("file"), F.col("Pos.Line").alias("line"), F.col("Text").alias("message"), "FromLinter"), F.concat(F.lit("golangci/"), "FromLinter"), "warning", "maintainability")


def deadcode(reports: DataFrame) -> DataFrame:
    """``data``: packages with their unreachable functions."""
    schema = "array<struct<Name:string,Path:string,Funcs:array<struct<Name:string,Position:struct<File:string,Line:int>>>>>"
    p = reports.select(F.inline(F.from_json("data", schema))).select(F.inline("Funcs"))
    return _with(p.select(F.col("Position.File").alias("file"), F.col("Position.Line").alias("line"), F.concat(F.lit("unreachable function "), "Name").alias("message")), F.lit("deadcode"), "info", "dead-code")


def govulncheck(records: DataFrame) -> DataFrame:
    """``data``: one JSON object a row, osv entries and findings; findings take the summary of their entry,
    once each."""
    r = records.select(F.from_json("data", "osv struct<id:string,summary:string>, finding struct<osv:string,trace:array<struct<module:string,function:string,position:struct<filename:string,line:int>>>>").alias("r"))
    osv = r.filter("r.osv IS NOT NULL").select("r.osv.id", "r.osv.summary").dropDuplicates(["id"])
    f = r.filter("r.finding IS NOT NULL").select(F.col("r.finding.osv").alias("id"), F.col("r.finding.trace")[0].alias("t"))
    f = f.groupBy("id").agg(F.max(F.struct(F.col("t.function").isNotNull().alias("called"), F.col("t.module").alias("module"), F.col("t.position.filename").alias("file"), F.col("t.position.line").alias("line"))).alias("t"))
    j = f.join(osv, "id", "left").select(F.coalesce("t.file", F.lit("go.mod")).alias("file"), F.coalesce("t.line", F.lit(0)).alias("line"), F.concat_ws(" ", "id", "summary").alias("message"), "t.called")
    out = _with(j, F.lit("govulncheck"), "warning", "security").withColumn("m", F.col("message"))
    called = j.filter("called").select(F.col("message").alias("m"), F.lit("error").alias("s"))
    return _findings(out.join(called, "m", "left").withColumn("severity", F.coalesce("s", "severity")))


def modtidy(lines: DataFrame) -> DataFrame:
    """``value``: the diff that tidying would make."""
    x = lines.filter(F.col("value").rlike(r"^[+-]\s*[^+-]")).filter(~F.col("value").rlike(r"^(\+\+\+|---)"))
    return _with(x.select(F.lit("go.mod").alias("file"), F.lit(0).alias("line"), F.concat(F.lit("not tidy: "), "value").alias("message")), F.lit("modtidy"), "warning", "dependency")


def workflowcheck(lines: DataFrame) -> DataFrame:
    """``value``: ``file:line:col: message``."""
    p = r"^([^:]+):(\d+)(?::\d+)?: (.*)$"
    x = lines.filter(F.col("value").rlike(p)).select(F.regexp_extract("value", p, 1).alias("file"), F.regexp_extract("value", p, 2).cast("int").alias("line"), F.regexp_extract("value", p, 3).alias("message"))
    return _with(x, F.lit("workflowcheck"), "error", "correctness")


def temporal(calls: DataFrame, decls: DataFrame) -> DataFrame:
    """Calls that aren't deterministic in functions with a workflow context."""
    flows = decls.filter(F.exists("params", lambda p: p["type"] == "workflow.Context")).select("path", F.col("key").alias("caller_key"))
    bad = calls.join(flows, ["path", "caller_key"], "left_semi").filter(F.col("callee_text").rlike(r"^(time\.(Now|Sleep|After)|rand\.\w+|os\.Getenv|http\.\w+)$"))
    return _with(bad.select(F.col("path").alias("file"), "line", F.concat("caller_key", F.lit(" calls "), "callee_text").alias("message")), F.lit("temporal"), "error", "correctness")


TIERS = ("error", "warning", "info", "off")


def load_config(source: str) -> dict[str, Any]:
    """S-8: JSON configuration: ``rules`` (rule to tier), ``skip`` (paths), ``policy`` (rule, package pairs).

    Unknown keys and tiers are errors."""
    got = json.loads(source) if source.strip() else {}
    unknown = set(got) - {"rules", "skip", "policy", "baseline", "extensions"}
    bad = {r: t for r, t in got.get("rules", {}).items() if t not in TIERS}
    if unknown or bad:
        raise ValueError(f"unknown keys {sorted(unknown)} or tiers {bad}")
    return {"rules": {}, "skip": [], "policy": [], "baseline": "", "extensions": [".go"]} | got
