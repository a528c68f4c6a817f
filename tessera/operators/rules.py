"""The rule library: each rule is a function from fact tables to findings.

Severities and thresholds are the defaults; tests are held to looser ones where the rule says so. Rules
that need something from outside the sources (changed files, coverage text, tracked files, plans) read it
from an extra table and find nothing without it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import findings, graph, kernels


RULES: dict[str, Callable[[dict[str, DataFrame]], DataFrame | None]] = {}


def rule(name: str):
    def add(f):
        RULES[name] = f
        return f

    return add


def found(df: DataFrame, name: str, severity: str | Column, message: Column, line="line", value="0", threshold="0", category: str = "maintainability", file: str = "path") -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(F.col(file).alias("file"), F.expr(line).cast("int").alias("line"), F.lit(name).alias("rule"), sev.alias("severity"), F.lit(category).alias("category"), message.alias("message"), F.expr(value).cast("bigint").alias("value"), F.expr(threshold).cast("bigint").alias("threshold"))


def say(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in (x.cast("string") if isinstance(x, Column) else x for x in parts)))


C = F.col


def sites(f: dict[str, DataFrame], kind: str) -> DataFrame:
    return f["sites"].filter(C("kind") == kind)


def library(df: DataFrame) -> DataFrame:
    return df.filter("NOT is_test AND package <> 'main'")


@rule("file-size")
def file_size(f):
    t = f["files"].withColumn("most", F.when(C("is_test"), 1000).otherwise(500)).filter("n_lines > most")
    return found(t, "file-size", "warning", say("file has ", C("n_lines"), " lines, over ", C("most")), "1", "n_lines", "most")


def extraction_priority(lines: Column, complexity: Column) -> Column:
    """AG-1b."""
    size = F.when(lines > 100, 10).when(lines > 75, 8).when(lines > 50, 6).when(lines > 30, 4).when(lines >= 20, 2).otherwise(0)
    return F.least(size + F.when(complexity > 15, 3).when(complexity > 10, 2).when(complexity > 5, 1).otherwise(0), F.lit(10))


@rule("extract-candidate")
def extract_candidate(f):
    """AG-1: only in files that are too long."""
    long = f["files"].filter("n_lines > 500").select("path")
    m = f["fn_metrics"].join(long, "path", "left_semi").withColumn("p", extraction_priority(C("lines"), C("complexity"))).filter("lines > 20 AND p >= 8")
    return found(m, "extract-candidate", "info", say(C("key"), " could be extracted, priority ", C("p")), value="p", threshold="8")


@rule("complexity")
def complexity(f):
    m = f["fn_metrics"].withColumn("most", F.when(C("is_test"), 30).otherwise(15)).filter("complexity > most")
    eased = C("dispatch").isNotNull() & (C("dispatch.normalized") <= C("most"))
    return found(m, "complexity", F.when(eased, "info").otherwise("warning"), say(C("key"), " has complexity ", C("complexity")), value="complexity", threshold="most")


def logic_lines() -> Column:
    return C("lines") - C("literal_lines") - F.coalesce(C("dispatch.line_discount"), F.lit(0))


@rule("long-function")
def long_function(f):
    m = f["fn_metrics"].withColumn("n", logic_lines()).withColumn("most", F.when(C("is_test"), 150).otherwise(75)).filter("n >= most")
    return found(m, "long-function", "info", say(C("key"), " has ", C("n"), " lines of logic"), value="n", threshold="most")


@rule("deep-nesting")
def deep_nesting(f):
    m = f["fn_metrics"].withColumn("most", F.when(C("is_test"), 6).otherwise(5)).filter("max_nesting > most")
    return found(m, "deep-nesting", "info", say(C("key"), " nests ", C("max_nesting"), " deep"), value="max_nesting", threshold="most")


@rule("hard-to-maintain")
def hard_to_maintain(f):
    k = F.when(C("is_test"), 2).otherwise(1)
    m = f["fn_metrics"].withColumn("n", logic_lines()).withColumn("cx", F.least("complexity", F.coalesce(C("dispatch.normalized"), C("complexity"))))
    m = m.withColumn("floor", k * 75).withColumn("bar", k * 15).withColumn("deep", F.when(C("is_test"), 6).otherwise(5)).withColumn("paths", k * 8)
    m = m.filter("n >= floor AND (cx > bar OR max_nesting > deep OR error_paths > paths)")
    severity = F.when(F.expr("n >= 2 * floor AND (cx > 2 * bar OR max_nesting > deep + 2)"), "error").otherwise("warning")
    return found(m, "hard-to-maintain", severity, say(C("key"), " has ", C("n"), " lines, complexity ", C("cx"), ", nesting ", C("max_nesting"), ", ", C("error_paths"), " early returns"), value="n", threshold="floor")


@rule("redundant-nil-guard")
def redundant_nil_guard(f):
    """An entry guard of an unexported function whose calls in the package all pass an address."""
    guards = sites(f, "entry-nil-guard").filter(~text.is_exported(F.element_at(F.split("func_key", ":"), -1))).withColumn("name_", F.element_at(F.split("func_key", ":"), -1)).withColumn("at", C("detail").cast("int"))

    m = f["raw_calls"].select("dir", C("callee_name").alias("name_"), C("args"), C("path").alias("cp"), C("line").alias("cl"))
    proven = f["stmts"].filter(C("text").rlike(r"^\w+:?=&\w")).select(C("path").alias("sp"), C("func_key").alias("sk"), F.regexp_extract("text", r"^(\w+)", 1).alias("var")).distinct()
    m = m.join(f["raw_calls"].select(C("path").alias("cp"), C("line").alias("cl"), C("callee_name").alias("name_"), C("caller_key").alias("ck")).distinct(), ["cp", "cl", "name_"])
    args = guards.select("path", "dir", "line", "name", "name_", "at").join(m, ["dir", "name_"]).withColumn("arg", F.get("args", C("at")))
    args = args.join(proven, (C("cp") == C("sp")) & (C("ck") == C("sk")) & (C("arg") == C("var")), "left")
    good = args.groupBy("path", "line", "name", "name_").agg(F.bool_and(C("var").isNotNull()).alias("all_proven")).filter("all_proven")

    return found(good, "redundant-nil-guard", "info", say(C("name_"), ": every caller passes a ", C("name"), " that can't be nil"))


@rule("unnecessary-nil-check")
def unnecessary_nil_check(f):
    return found(sites(f, "unnecessary-nil-check"), "unnecessary-nil-check", "info", say(C("func_key"), ": ", C("name"), " can't be nil here"))


@rule("error-not-wrapped")
def error_not_wrapped(f):
    return found(sites(f, "error-not-wrapped").filter("NOT is_test"), "error-not-wrapped", "info", say(C("name"), " returns ", C("detail"), " without context"))


def import_edges(f: dict[str, DataFrame]) -> DataFrame:
    """GR-5, J-5: distinct edges between the directories of the tree."""
    dirs = f["files"].select(C("dir").alias("dst")).distinct()
    paths = f["imports"].select(C("dir").alias("src"), "import_path").distinct()
    return kernels.suffix_owner(paths, "import_path", dirs, "dst").select("src", "dst").filter("src <> dst").distinct()


@rule("high-coupling")
def high_coupling(f):
    d = kernels.degrees(import_edges(f), "src", "dst")
    out = found(d.filter("fan_out > 10"), "high-coupling", "warning", say("package imports ", C("fan_out"), " packages of this tree"), "0", "fan_out", "10", file="node")
    return out.union(found(d.filter("fan_in > 8"), "high-coupling", "info", say(C("fan_in"), " packages import this one"), "0", "fan_in", "8", file="node"))


def call_edges(f: dict[str, DataFrame]) -> DataFrame:
    return graph.resolve_calls(f["raw_calls"], f["decls"].filter("kind IN ('func', 'method')"))


def definitions(f: dict[str, DataFrame]) -> DataFrame:
    """GR-1: one definition a key, the first by path."""
    d = f["decls"].filter("kind IN ('func', 'method')")
    return kernels.first_of_each(d, ["key"], ["path", "start"])


@rule("high-blast-radius")
def high_blast_radius(f):
    edges = call_edges(f).filter("src <> dst")
    closure = graph.reachable(edges.sparkSession, edges)
    d = definitions(f)
    r = graph.blast_radius(closure, d.select(C("key").alias("node"), C("path").alias("file"), C("dir").alias("package"), "exported"))
    r = r.join(d.select(C("key").alias("node"), "path", C("start").alias("line")), "node").filter("reach >= 20")
    r = kernels.top(r, [F.desc("score"), "path", "node"], 10)
    return found(r, "high-blast-radius", "info", say(C("node"), " is reached from ", C("reach"), " functions, score ", C("score")), value="reach", threshold="20")


def implementations(f: dict[str, DataFrame]) -> DataFrame:
    """J-4: types against the interfaces of the tree by method names."""
    have = f["decls"].filter("kind = 'method'").select(C("receiver").alias("type"), C("name").alias("member"))
    need = f["types"].filter("kind = 'interface'").select(C("name").alias("iface"), F.explode("methods").alias("member"))
    return kernels.division(have, need, "type", "iface", "member")


@rule("premature-abstraction")
def premature_abstraction(f):
    one = kernels.sole_implementations(implementations(f), "iface", "type")
    r = f["decls"].filter("kind IN ('func', 'method') AND NOT is_test").withColumn("iface", F.get("results.type", F.lit(0)))
    return found(r.join(one, "iface"), "premature-abstraction", "info", say(C("key"), " returns ", C("iface"), ", which only ", C("type"), " implements"), "start")


@rule("generated-name")
def generated_name(f):
    d = f["decls"].filter("kind IN ('func', 'method')").filter(C("name").rlike("^extractBlockL[0-9]+$"))
    return found(d, "generated-name", "warning", say(C("name"), " is a generated name"), "start")


@rule("byvalue-buffer")
def byvalue_buffer(f):
    bad = F.filter("params", lambda p: p["type"].isin("bytes.Buffer", "strings.Builder"))
    d = f["decls"].filter("kind IN ('func', 'method')").select("*", F.explode(bad).alias("p"))
    return found(d, "byvalue-buffer", "warning", say(C("key"), " takes ", C("p.name"), " ", C("p.type"), " by value"), "start", category="correctness")


@rule("stranded-comment")
def stranded_comment(f):
    names = f["decls"].filter("kind IN ('func', 'method')").select("path", "name").union(f["types"].select("path", "name")).distinct()
    c = f["comments"].filter("next_name <> '' AND word <> next_name").join(names.withColumnRenamed("name", "word"), ["path", "word"])
    return found(c, "stranded-comment", "warning", say("the comment is about ", C("word"), " but stands before ", C("next_name")))


@rule("orphaned-config-path")
def orphaned_config_path(f):
    """J-13. ``config_paths``: pattern. The patterns of a configuration are few."""
    if "config_paths" not in f:
        return None
    p = f["config_paths"].join(f["files"].select("path"), F.expr("path rlike pattern"), "left_anti")
    return found(p, "orphaned-config-path", "warning", say("no file matches ", C("pattern")), "0", category="config", file="pattern")


@rule("tracked-artifact")
def tracked_artifact(f):
    """S-12. ``tracked``: path, content."""
    if "tracked" not in f:
        return None
    t = f["tracked"].filter(F.contains(F.left("content", F.lit(8192)), F.lit(b"\x00")) | C("path").rlike(r"(^|/)(coverage|cover)[^/]*\.(out|html|txt)$|\.coverprofile$"))
    return found(t, "tracked-artifact", "warning", say(C("path"), " looks like a build or coverage artifact"), "0", category="hygiene")


# The operations that a plan may name.
PLAN_OPERATIONS = ("move_method", "insert_code", "create_file", "remove_code_block", "replace_code", "delete_declaration", "rename_declaration")


@rule("advertised-but-unwired")
def advertised(f):
    """``plans``: path, text (JSON with ``operations``)."""
    if "plans" not in f:
        return None
    ops = f["plans"].select("path", F.explode(F.from_json("text", "operations array<struct<type:string>>")["operations"]["type"]).alias("op"))
    bad = ops.filter(~C("op").isin(*PLAN_OPERATIONS)).distinct()
    return found(bad, "advertised-but-unwired", "error", say("operation ", C("op"), " isn't known"), "0", category="correctness")


def frequencies(f: dict[str, DataFrame]) -> DataFrame:
    return f["idents"].groupBy("name").agg(F.coalesce(F.sum(F.when(~C("is_test"), C("n"))), F.lit(0)).alias("prod"), F.coalesce(F.sum(F.when(C("is_test"), C("n"))), F.lit(0)).alias("test"))


@rule("test-only-live")
def test_only_live(f):
    """AG-4d."""
    d = f["decls"].filter("kind IN ('func', 'method') AND exported AND NOT is_test").select("path", "name", C("start").alias("line"))
    d = d.union(f["types"].filter("exported AND NOT is_test").select("path", "name", "start"))
    n = d.groupBy("name").agg(F.count("*").alias("declared"))
    live = d.join(n, "name").join(frequencies(f), "name").filter("prod <= declared AND test > 0")
    return found(live, "test-only-live", "info", say(C("name"), " is used by tests only"), category="dead-code")


@rule("if-err-log-return")
def if_err_log_return(f):
    return found(sites(f, "if-err-log-return").filter("NOT is_test"), "if-err-log-return", "warning", say(C("func_key"), " logs an error and returns it"))


@rule("wrap-log-return")
def wrap_log_return(f):
    return found(sites(f, "wrap-log-return").filter("NOT is_test"), "wrap-log-return", "warning", say(C("func_key"), " wraps, logs and returns ", C("detail")))


@rule("wrap-bridge-log-return")
def wrap_bridge_log_return(f):
    return found(sites(f, "wrap-bridge-log-return").filter("NOT is_test"), "wrap-bridge-log-return", "warning", say(C("func_key"), " wraps, assigns, logs and returns ", C("detail")))


@rule("duplicate-bare-sentinel")
def duplicate_bare_sentinel(f):
    """AG-19."""
    s = sites(f, "bare-sentinel").filter("NOT is_test").withColumn("n", F.count("*").over(Window.partitionBy("dir", "name"))).filter("n >= 2")
    return found(s, "duplicate-bare-sentinel", "info", say(C("name"), " is returned bare at ", C("n"), " places of the package"), value="n", threshold="2")


def method_order(f: dict[str, DataFrame]) -> DataFrame:
    structs = f["types"].filter("kind = 'struct'").select("path", C("name").alias("receiver"), C("index").alias("struct_at"), C("start").alias("line"))
    m = f["decls"].filter("kind = 'method'").groupBy("path", "receiver").agg(F.min("index").alias("first_method"), F.min(F.when(~C("exported"), C("index"))).alias("first_hidden"), F.max(F.when(C("exported"), C("index"))).alias("last_shown"))
    return structs.join(m, ["path", "receiver"], "left")


@rule("funcorder-constructor")
def funcorder_constructor(f):
    """W-7."""
    c = f["decls"].filter("kind = 'func'").filter(C("name").rlike("^New[A-Z]|^New$|^new[A-Z]")).select("path", "name", "start", C("index").alias("at"), F.regexp_replace(F.get("results.type", F.lit(0)), r"^\*", "").alias("receiver"))
    bad = c.join(method_order(f), ["path", "receiver"]).filter("at < struct_at OR at > first_method")
    return found(bad, "funcorder-constructor", "info", say(C("name"), " should stand between ", C("receiver"), " and its methods"), "start")


@rule("funcorder-struct-method")
def funcorder_struct_method(f):
    bad = method_order(f).filter("first_hidden < last_shown")
    return found(bad, "funcorder-struct-method", "info", say("an unexported method of ", C("receiver"), " stands before an exported one"))


@rule("funcorder-function")
def funcorder_function(f):
    d = f["decls"].filter("kind = 'func' AND name NOT IN ('main', 'init')")
    last = d.groupBy("path").agg(F.max(F.when(C("exported"), C("index"))).alias("last_shown"))
    bad = kernels.first_of_each(d.filter("NOT exported").join(last, "path").filter("index < last_shown"), ["path"], ["index"])
    return found(bad, "funcorder-function", "info", say(C("name"), " stands before an exported function"), "start")


@rule("god-object")
def god_object(f):
    m = f["decls"].filter("kind = 'method'").groupBy("path", C("receiver").alias("name")).agg(F.count("*").alias("methods"))
    bad = f["types"].filter("kind = 'struct' AND n_field_groups > 25").join(m, ["path", "name"])
    return found(bad, "god-object", "warning", say(C("name"), " has ", C("n_field_groups"), " fields"), "start", "n_field_groups", "25")


@rule("excessive-params")
def excessive_params(f):
    bad = f["decls"].filter("n_param_fields > 7")
    return found(bad, "excessive-params", "info", say(C("key"), " has ", C("n_param_fields"), " parameters"), "start", "n_param_fields", "7")


@rule("excessive-returns")
def excessive_returns(f):
    bad = f["decls"].filter("n_result_fields > 3")
    return found(bad, "excessive-returns", "info", say(C("key"), " returns ", C("n_result_fields"), " values"), "start", "n_result_fields", "3")


@rule("fat-interface")
def fat_interface(f):
    bad = f["types"].filter("kind = 'interface'").withColumn("n", F.size("methods")).filter("n > 5")
    return found(bad, "fat-interface", "warning", say(C("name"), " has ", C("n"), " methods"), "start", "n", "5")


@rule("large-class")
def large_class(f):
    m = f["decls"].filter("kind = 'method'").groupBy("path", C("receiver").alias("name")).agg(F.count("*").alias("n_methods"))
    t = f["types"].filter("kind = 'struct'").join(m, ["path", "name"]).withColumn("members", C("n_methods") + C("n_field_groups")).filter("n_methods > 20 OR members > 30")
    return found(t, "large-class", "warning", say(C("name"), " has ", C("n_methods"), " methods and ", C("n_field_groups"), " fields"), "start", "members", "30")


# Fixed pattern: types that carry context rather than data, behind a slice or pointer mark.
CARRIER = r"^(\[\])?\*?(context\.Context$|testing\.|token\.|ast\.|packages\.|parser\.)"


@rule("data-clumps")
def data_clumps(f):
    """AG-6b."""
    own = F.array_sort(F.filter("params", lambda p: ~p["type"].rlike(CARRIER) & ~p["name"].isin("", "_")))
    d = f["decls"].filter("kind IN ('func', 'method')").withColumn("clump", own).filter("size(clump) >= 3")
    g = d.groupBy("path", "clump").agg(F.count("*").alias("n"), F.min_by("key", "start").alias("first"), F.min("start").alias("line")).filter("n >= 2")
    return found(g, "data-clumps", "info", say(F.array_join("clump.name", ", "), " go together in ", C("n"), " functions, first in ", C("first")), value="n", threshold="2")


@rule("type-switch")
def type_switch(f):
    d = f["decls"].filter("type_switches > 0").withColumn("n", F.count("*").over(Window.partitionBy("path"))).filter("n >= 3 AND type_switches > 1")
    return found(d, "type-switch", F.when(C("type_switches") > 2, "warning").otherwise("info"), say(C("key"), " switches on types ", C("type_switches"), " times"), "start", "type_switches", "1")


@rule("god-package")
def god_package(f):
    """AG-5."""
    decls = f["decls"].select("dir", "name").union(f["types"].select("dir", "name")).groupBy("dir").agg(F.count("*").alias("decls"))
    files = f["files"].filter("NOT is_test").groupBy("dir").agg(F.count("*").alias("files"))
    out = import_edges(f).groupBy(C("src").alias("dir")).agg(F.countDistinct("dst").alias("imports"))
    g = decls.filter("decls > 300").join(files, "dir", "left").join(out, "dir", "left").filter("files > 40 OR imports > 12")
    why = F.array_join(F.array_compact(F.array(F.when(C("files") > 40, say(C("files"), " files")), F.when(C("imports") > 12, say(C("imports"), " imports")))), ", ")
    return found(g, "god-package", "warning", say(C("decls"), " declarations, ", why), "0", "decls", "300", file="dir")


@rule("duplicate-block")
def duplicate_block(f):
    """AG-3, F-1: function bodies, and blocks of three statements or more that aren't an idiom; configured
    idioms are the rows of ``ignored_blocks`` (pattern), a few substrings."""
    extra = tuple(r.pattern for r in f["ignored_blocks"].collect()) if "ignored_blocks" in f else ()
    b = f["blocks"].withColumn("norm", text.normalise_code(C("text"))).filter(C("is_fn_body") | ((C("n_stmts") >= 3) & ~text.is_idiom(C("norm"), extra)))
    g = b.groupBy(F.md5(F.encode("norm", "utf-8")).alias("hash")).agg(F.count("*").alias("n"), F.max("n_stmts").alias("stmts"), F.max("n_control").alias("control"), F.bool_and("is_test").alias("all_tests"), F.min(F.struct("path", "start")).alias("at"))
    g = g.filter("n >= 2 AND NOT all_tests").withColumn("impact", kernels.impact(C("n"), C("stmts"), C("control"))).filter("impact >= 5")
    return found(g.select("*", "at.path", C("at.start").alias("line")), "duplicate-block", "warning", say(C("n"), " equal blocks of ", C("stmts"), " statements, impact ", C("impact")), value="impact", threshold="5")


@rule("dead-code")
def dead_code(f):
    """AG-4b: unexported functions whose name occurs once in their directory; at the aggressive level (the
    tree's option ``aggressive_dead_code``, a table with any row) AG-4c too."""
    hidden = dead_hidden(f)
    return hidden.unionByName(dead_exported(f)) if "aggressive_dead_code" in f and not f["aggressive_dead_code"].isEmpty() else hidden


def dead_hidden(f: dict[str, DataFrame]) -> DataFrame:
    n = f["idents"].groupBy("dir", "name").agg(F.sum("n").alias("n"))
    d = f["decls"].filter("kind = 'func' AND NOT exported AND NOT is_test AND name NOT IN ('main', 'init', '_')").filter(~C("name").rlike("^(Test|Benchmark|Example)"))
    return found(d.join(n, ["dir", "name"]).filter("n <= 1"), "dead-code", "warning", say(C("name"), " is never used"), "start", category="dead-code")


def dead_exported(f: dict[str, DataFrame]) -> DataFrame:
    """AG-4c: exported functions whose name occurs once in the whole tree."""
    n = f["idents"].groupBy("name").agg(F.sum("n").alias("n"))
    d = f["decls"].filter("kind = 'func' AND exported AND NOT is_test").filter(~C("name").rlike("^(Test|Benchmark|Example)"))
    return found(d.join(n, "name").filter("n <= 1"), "dead-code", "warning", say(C("name"), " is never used"), "start", category="dead-code")


@rule("untested-package")
def untested_package(f):
    tested = f["files"].filter("is_test").select("dir").distinct()
    d = f["files"].filter("NOT is_test").select("dir").distinct().join(tested, "dir", "left_anti")
    return found(d, "untested-package", "info", say("no tests in ", C("dir")), "0", category="tests", file="dir")


@rule("untested-function")
def untested_function(f):
    """S-10. ``coverage``: value (lines of a coverage listing: position, name, percentage)."""
    if "coverage" not in f:
        return None
    p = F.split(F.trim("value"), r"[ \t]+")
    c = f["coverage"].select(text.strip_position(F.regexp_replace(p[0], ":$", "")).alias("path"), F.regexp_extract(p[0], r":(\d+):?$", 1).cast("int").alias("line"), p[1].alias("name"), F.element_at(p, -1).alias("pct"))
    return found(c.filter("pct = '0.0%'").filter(text.is_exported(C("name"))), "untested-function", "info", say(C("name"), " isn't covered"), category="tests")


@rule("vacuous-test")
def vacuous_test(f):
    return found(sites(f, "vacuous-test").filter("is_test"), "vacuous-test", "warning", say(C("name"), " can't fail"), category="tests")


@rule("sleep-in-test")
def sleep_in_test(f):
    c = f["raw_calls"].filter("is_test AND callee_text = 'time.Sleep'")
    return found(c, "sleep-in-test", "warning", say(C("caller_key"), " sleeps"), category="tests")


@rule("fatal-in-library")
def fatal_in_library(f):
    c = library(f["raw_calls"]).filter(C("callee_text").rlike(r"^(log\.Fatal(f|ln)?|os\.Exit|panic)$"))
    return found(c, "fatal-in-library", F.when(C("callee_text") == "panic", "info").otherwise("warning"), say(C("caller_key"), " calls ", C("callee_text")), category="correctness")


@rule("string-concat-in-loop")
def string_concat_in_loop(f):
    return found(sites(f, "string-concat-in-loop").filter("NOT is_test"), "string-concat-in-loop", "warning", say(C("func_key"), " appends to the string ", C("name"), " in a loop"), category="performance")


@rule("linear-search-in-loop")
def linear_search_in_loop(f):
    return found(sites(f, "linear-search-in-loop").filter("NOT is_test"), "linear-search-in-loop", "info", say(C("func_key"), " searches a list in a loop"), category="performance")


@rule("unstopped-ticker")
def unstopped_ticker(f):
    return found(sites(f, "unstopped-ticker").filter("NOT is_test"), "unstopped-ticker", "warning", say(C("func_key"), ": the ticker ", C("name"), " is never stopped"), category="correctness")


@rule("naked-goroutine")
def naked_goroutine(f):
    return found(sites(f, "naked-goroutine").filter("NOT is_test"), "naked-goroutine", "info", say(C("func_key"), " starts a goroutine that nothing ends"), category="correctness")


@rule("pass-through-param")
def pass_through_param(f):
    """GR-6: parameters that are only handed on, through three functions or more."""
    s = sites(f, "forwarded-param").filter("NOT is_test").select("path", "line", "dir", F.element_at(F.split("func_key", ":"), -1).alias("func"), "name", F.from_json("detail", "place int, callee string, at int").alias("d"))
    node = lambda fn, at: F.concat_ws("#", "dir", fn, at.cast("string"))
    edges = s.select(node(C("func"), C("d.place")).alias("src"), node(C("d.callee"), C("d.at")).alias("dst"), "path", "line", "func", "name")
    chains = graph.longest_chain(s.sparkSession, edges).filter("length >= 3")
    return found(edges.join(chains, edges.src == chains.node), "pass-through-param", "info", say(C("func"), " only hands ", C("name"), " on, through ", C("length"), " calls"), value="length", threshold="3")


@rule("regexp-compile-in-func")
def regexp_compile_in_func(f):
    return found(sites(f, "regexp-compile-in-func").filter("NOT is_test"), "regexp-compile-in-func", "info", say(C("func_key"), " compiles a constant pattern at each call"), category="performance")


@rule("low-tool-adherence")
def low_adherence(f):
    """J-12. ``changed``: path; ``journal``: path, time; ``since``: one row with ``time``."""
    if not {"changed", "journal", "since"} <= f.keys():
        return None
    since = f["since"].agg(F.max("time").alias("t")).first().t
    done = f["journal"].filter(C("time") >= F.lit(since)).select("path").distinct().withColumn("by_tool", F.lit(1))
    r = adherence(f["changed"].select("path").distinct(), done).filter("n >= 3 AND ratio < 0.5")
    return found(r, "low-tool-adherence", "info", say(C("by_tool"), " of ", C("n"), " changed files went through the tool"), "0", "by_tool", "0", "process", file="where")


def adherence(changed: DataFrame, done: DataFrame) -> DataFrame:
    """J-12: one row; the ratio is null when nothing changed."""
    return changed.join(done, "path", "left").agg(F.count("*").alias("n"), F.count("by_tool").alias("by_tool")).withColumn("ratio", F.try_divide("by_tool", "n")).withColumn("where", F.lit("."))


def run_rules(facts: dict[str, DataFrame], only: tuple[str, ...] = (), skip: tuple[str, ...] = (), tiers: dict[str, str] | None = None) -> DataFrame:
    """SO-1, T-1: the findings of the selected rules, tiers applied, in order."""
    names = findings.selected(list(RULES), only, skip, tiers)
    parts = [x for n in names if (x := RULES[n](facts)) is not None]
    if not parts:
        return facts["files"].sparkSession.createDataFrame([], findings.SCHEMA)
    return findings.ordered(findings.override(kernels.union_all(parts), tiers or {}))
