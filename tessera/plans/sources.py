"""Queries over a small Go tree, a diff and reports of tools that are written down here, with the rows they give."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.operators import code, graph, kernels, rules
from tessera.plans.registry import query
from tessera.sources import diffs, gofacts, tools

C = F.col

STORE = """package shop

import (
	"fmt"
	log "log"
	"regexp"
	"time"
	"example.com/x/util"
)

// Store keeps things.
type Store struct {
	a, b int
	name string
}

type Keeper interface {
	Get(k string) (int, error)
	Put(k string, v int) error
}

func (s *Store) Get(k string) (int, error) {
	v, err := util.Load(k)
	if err != nil {
		log.Printf("load: %v", err)
		return 0, err
	}
	return v, nil
}

func NewStore() *Store { return &Store{} }

func (s *Store) Put(k string, v int) error {
	for i := range 3 {
		if v > i {
			switch {
			case v == 1:
				return nil
			default:
				k += "x"
			}
		}
	}
	return helper(k)
}

func helper(k string) error {
	err := fmt.Errorf("wrap %s", k)
	log.Println(err)
	return err
}

func Unused(a, b, c, d, e, f, g, h int) Keeper { return nil }

func onlyHere() {
	t := time.NewTicker(1)
	go func() { fmt.Println(t) }()
	re := regexp.MustCompile("a+")
	fmt.Println(re)
	panic("no")
}

func deep(n int) int {
	for i := 0; i < n; i++ {
		for j := 0; j < n; j++ {
			if i > j {
				for k := 0; k < n; k++ {
					if k > 1 {
						if k > 2 {
							return k
						}
					}
				}
			}
		}
	}
	return 0
}

var table = []func(string) error{helper}
"""
TEST = """package shop

import ("testing"; "time")

func TestGet(t *testing.T) {
	s := NewStore()
	s.Get("x")
	time.Sleep(1)
	Unused(1, 2, 3, 4, 5, 6, 7, 8)
}
"""
UTIL = "package util\n\nfunc Load(k string) (int, error) { return 0, nil }\n\nfunc Spare(v any) string {\n\tswitch v.(type) {\n\tcase int:\n\t\treturn \"i\"\n\t}\n\treturn \"\"\n}\n"
MADE = "// Code generated by x. DO NOT EDIT.\npackage made\n\nfunc Made() {}\n"
TREE = [("shop/a.go", STORE), ("shop/a_test.go", TEST), ("util/u.go", UTIL), ("made/m.go", MADE), ("vendor/v/v.go", MADE), (".x/h.go", MADE), ("shop/z.gen.go", MADE), ("README.md", "no code")]


def tree(spark):
    return gofacts.fact_tables(spark, gofacts.pruned(spark.createDataFrame(TREE, "path string, text string")))


def rows(columns: str, values: list[tuple]) -> str:
    """SQL of written-down rows."""

    def one(x) -> str:
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else f"CAST({x} AS BIGINT)" if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    listed = ", ".join("(" + ", ".join(map(one, v)) + ")" for v in values)
    return f"SELECT * FROM (VALUES {listed}) v({columns})"


def wide(df):
    """Whole numbers as longs, as the SQL has them."""
    return df.select(*(C(c).cast("long").alias(c) if kind in ("int", "tinyint", "smallint") else C(c) for c, kind in df.dtypes))


@query(rows("path, dir, package, is_test, is_generated, n_lines", [
    ("made/m.go", "made", "made", False, True, 4), ("shop/a.go", "shop", "shop", False, False, 80),
    ("shop/a_test.go", "shop", "shop", True, False, 10), ("util/u.go", "util", "util", False, False, 11),
]))
def go_files(spark, sf_dir):
    """S-1a to S-1d: pruned folders and generated names go, a generated header is told."""
    return wide(tree(spark)["files"].select("path", "dir", "package", "is_test", "is_generated", "n_lines"))


@query(rows("path, key, kind, exported, start, stop, n_params, signature", [
    ("made/m.go", "Made", "func", True, 4, 4, 0, "func() ()"), ("shop/a.go", "NewStore", "func", True, 31, 31, 0, "func() (*Store)"),
    ("shop/a.go", "Store:Get", "method", True, 22, 29, 1, "func(k string) (int, error)"), ("shop/a.go", "Store:Put", "method", True, 33, 45, 2, "func(k string, v int) (error)"),
    ("shop/a.go", "Unused", "func", True, 53, 53, 8, "func(a int, b int, c int, d int, e int, f int, g int, h int) (Keeper)"), ("shop/a.go", "deep", "func", False, 63, 78, 1, None),
    ("shop/a.go", "helper", "func", False, 47, 51, 1, None), ("shop/a.go", "onlyHere", "func", False, 55, 61, 0, None), ("shop/a.go", "table", "var", False, 80, 80, 0, None),
    ("shop/a_test.go", "TestGet", "func", True, 5, 10, 1, None), ("util/u.go", "Load", "func", True, 3, 3, 1, "func(k string) (int, error)"), ("util/u.go", "Spare", "func", True, 5, 11, 1, "func(v any) (string)"),
]))
def go_declarations(spark, sf_dir):
    """S-2, S-2b, and the surface of what is exported (J-3)."""
    f = tree(spark)
    api = code.api_surface(f).withColumn("place", C("symbol"))
    d = f["decls"].withColumn("place", F.when(~C("is_test"), F.concat_ws(".", "dir", "key"))).join(api, "place", "left")
    return wide(d.select("path", "key", "kind", "exported", "start", C("end").alias("stop"), "n_params", "signature"))


@query(rows("path, name, kind, n_fields, methods", [("shop/a.go", "Keeper", "interface", 0, "Get,Put"), ("shop/a.go", "Store", "struct", 3, "")]))
def go_types(spark, sf_dir):
    """S-2."""
    return wide(tree(spark)["types"].select("path", "name", "kind", "n_fields", F.array_join("methods", ",").alias("methods")))


@query(rows("path, key, lines, complexity, max_nesting", [
    ("made/m.go", "Made", 1, 1, 0), ("shop/a.go", "NewStore", 1, 1, 0), ("shop/a.go", "Store:Get", 8, 2, 1), ("shop/a.go", "Store:Put", 13, 5, 3), ("shop/a.go", "Unused", 1, 1, 0),
    ("shop/a.go", "deep", 16, 7, 6), ("shop/a.go", "helper", 5, 1, 0), ("shop/a.go", "onlyHere", 7, 1, 0), ("shop/a_test.go", "TestGet", 6, 1, 0), ("util/u.go", "Load", 1, 1, 0), ("util/u.go", "Spare", 7, 3, 1),
]))
def go_metrics(spark, sf_dir):
    """AG-2, AG-2b."""
    return wide(tree(spark)["fn_metrics"].select("path", "key", "lines", "complexity", "max_nesting"))


@query(rows("target, path, line, caller_key, category", [
    ("helper", "shop/a.go", 44, "Store:Put", "direct"), ("Get", "shop/a_test.go", 7, "TestGet", "test"), ("NewStore", "shop/a_test.go", 6, "TestGet", "test"),
    ("t", "shop/a.go", 57, "onlyHere", "indirect"),
]))
def go_callers(spark, sf_dir):
    """J-1, J-1b: direct callers and those in tests; names that are handed on count as indirect."""
    f = tree(spark)
    one = lambda name, **more: code.callers(f["raw_calls"], name, **more).select(F.lit(name).alias("target"), "path", "line", "caller_key", "category")
    return wide(one("helper").union(one("Get")).union(one("NewStore")).union(one("t", uses=f["uses"].filter("path = 'shop/a.go'"))))


@query(rows("path, line, context, func_key", [
    ("shop/a.go", 23, "assign_lhs", "Store:Get"), ("shop/a.go", 24, "other", "Store:Get"), ("shop/a.go", 25, "other", "Store:Get"), ("shop/a.go", 26, "return", "Store:Get"),
    ("shop/a.go", 48, "assign_lhs", "helper"), ("shop/a.go", 49, "other", "helper"), ("shop/a.go", 50, "return", "helper"),
]))
def go_uses(spark, sf_dir):
    """J-2, J-2b, P-6."""
    return wide(code.uses(tree(spark)["uses"], "err").select("path", "line", "context", "func_key"))


@query(rows("src, dst", [("Store:Get", "Load"), ("Store:Put", "helper"), ("TestGet", "NewStore"), ("TestGet", "Store:Get"), ("TestGet", "Unused")]))
def go_call_edges(spark, sf_dir):
    """GR-1, J-1c."""
    f = tree(spark)
    return graph.resolve_calls(f["raw_calls"].select("caller_key", "callee_name", "is_selector"), f["decls"].select("key", "name", "receiver"))


@query(rows("dir, files, functions, types, imports", [("made", 1, 1, 0, None), ("shop", 2, 8, 2, "util"), ("util", 1, 2, 0, None)]))
def go_packages(spark, sf_dir):
    """GR-5, GR-5d, AG-18, J-5."""
    return wide(code.package_graph(tree(spark)).select("dir", "files", "functions", "types", F.array_join("imports", ",").alias("imports")))


@query(rows("type, iface, n_have, needed, complete", [("Store", "Keeper", 2, 2, True)]))
def go_implementations(spark, sf_dir):
    """J-4, J-4b: one type against one interface."""
    return wide(code.implements(rules.implementations(tree(spark)), "Store", "Keeper").select("type", "iface", "n_have", "needed", "complete"))


@query(rows("budget, kind, path, text", [
    (60, "definition", "shop/a.go", "\tv, err := util.Load(k)\n\tif err != nil\n… [cut to the budget]"),
    (120, "definition", "shop/a.go", "\tv, err := util.Load(k)\n\tif err != nil {\n\t\tlog.Printf(\"load: %v\", err)\n\t\treturn 0, err\n\t}\n\treturn v, nil"),
    (120, "test", "shop/a_test.go", "TestGet"),
]))
def go_context(spark, sf_dir):
    """J-6, W-4: within a small budget the definition is cut, within a larger one all stands."""
    f = tree(spark)
    one = lambda n: code.context_pack(f, "Store:Get", n).select(F.lit(n).cast("long").alias("budget"), "kind", "path", "text")
    return one(60).union(one(120))


@query(rows("n_stmts, n_control, n_calls, complexity, reads, writes", [(6, 3, 1, 4, "helper,i,k,nil,v", "i")]))
def go_block(spark, sf_dir):
    """AG-7."""
    b = code.block_metrics(tree(spark), "shop/a.go", 33, 45)
    return wide(b.select("n_stmts", "n_control", "n_calls", "complexity", F.array_join("reads", ",").alias("reads"), F.array_join("writes", ",").alias("writes")))


@query(rows("functions", [(10,)]))
def go_scored(spark, sf_dir):
    """AG-9b."""
    return code.scored_functions(tree(spark))


@query(rows("position, met", [(0, True), (1, True), (2, True), (3, False), (4, None)]))
def go_conditions(spark, sf_dir):
    """P-5d."""
    asked = [("complexity", "Store:Put", "lte", 10), ("function_exists", "helper", "eq", 1), ("function_exists", "gone", "eq", 0), ("file_exists", "shop/b.go", "eq", 1), ("complexity", "gone", "gt", 1)]
    return wide(code.conditions_met(spark, tree(spark), [dict(zip(("kind", "of", "op", "value"), x, strict=True)) for x in asked]))


@query(rows("path, func_key, line", [("shop/a.go", "helper", 48)]))
def go_search(spark, sf_dir):
    """SQ-1: an assigned call, a call, anything."""
    return wide(code.search_runs(tree(spark)["stmts"], ("$:=$.$(#,$)", "$.$($)", None)))


@query(rows("in_tests, internal, reasons", [(1, 0, "exported: other modules may use it")]))
def go_rename_advice(spark, sf_dir):
    """AG-10."""
    return code.rename_advice(tree(spark), "NewStore").select("in_tests", "internal", F.array_join("reasons", ";").alias("reasons"))


FOUND = [
    ("made", 0, "untested-package", "info"), ("made/m.go", 4, "dead-code", "warning"), ("shop/a.go", 24, "if-err-log-return", "warning"), ("shop/a.go", 26, "error-not-wrapped", "info"),
    ("shop/a.go", 31, "funcorder-constructor", "info"), ("shop/a.go", 31, "test-only-live", "info"), ("shop/a.go", 40, "string-concat-in-loop", "warning"), ("shop/a.go", 47, "funcorder-function", "info"),
    ("shop/a.go", 48, "wrap-log-return", "warning"), ("shop/a.go", 53, "premature-abstraction", "info"), ("shop/a.go", 53, "test-only-live", "info"), ("shop/a.go", 55, "dead-code", "warning"),
    ("shop/a.go", 56, "unstopped-ticker", "warning"), ("shop/a.go", 57, "naked-goroutine", "info"), ("shop/a.go", 58, "regexp-compile-in-func", "info"), ("shop/a.go", 60, "fatal-in-library", "info"),
    ("shop/a.go", 63, "dead-code", "warning"), ("shop/a.go", 63, "deep-nesting", "info"), ("shop/a_test.go", 5, "vacuous-test", "warning"), ("shop/a_test.go", 8, "sleep-in-test", "warning"),
    ("util", 0, "untested-package", "info"), ("util/u.go", 5, "dead-code", "warning"),
]


@query(rows("file, line, rule, severity", FOUND))
def go_rules(spark, sf_dir):
    """All rules that need no outside input, dead code at the aggressive level."""
    return wide(rules.run_rules(tree(spark) | {"aggressive_dead_code": spark.range(1)}).select("file", "line", "rule", "severity"))


DIFF = """diff --git a/x.go b/x.go
--- a/x.go
+++ b/x.go
@@ -1,6 +1,7 @@
 package x
-func Old() {}
+func New() {}
 
-a := foo(1)
+a := bar(1)
+b := 2
\\ No newline at end of file
"""


@query(rows("old_line, new_line, old_text, new_text, kind", [(2, 2, "func Old() {}", "func New() {}", "function_modified"), (4, 4, "a := foo(1)", "a := bar(1)\nb := 2", "modification")]))
def diff_changes(spark, sf_dir):
    """S-9, F-7, F-8, W-2, W-2b."""
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(DIFF.split("\n")[:-1])], "diff_id string, pos int, line string")
    return wide(diffs.changes(diffs.parse_diff(lines)).select("old_line", "new_line", C("old").alias("old_text"), C("new").alias("new_text"), "kind"))


@query(rows("tool, file, line, rule", [("golangci", "a.go", 3, "golangci/x"), ("vuln", "a.go", 2, "govulncheck"), ("workflow", "a.go", 3, "workflowcheck")]))
def tool_reports(spark, sf_dir):
    """S-11: reports of other tools as findings."""
    one = lambda x, c="data": spark.createDataFrame([(y,) for y in x], f"{c} string")
    lint = tools.golangci(one([json.dumps({"Issues": [{"FromLinter": "x", "Text": "t", "Pos": {"Filename": "a.go", "Line": 3}}]})]))
    vuln = tools.govulncheck(one([json.dumps({"osv": {"id": "V1", "summary": "s"}}), json.dumps({"finding": {"osv": "V1", "trace": [{"module": "m", "function": "f", "position": {"filename": "a.go", "line": 2}}]}})]))
    work = tools.workflowcheck(one(["a.go:3:4: bad", "noise"], "value"))
    pick = lambda df, name: df.select(F.lit(name).alias("tool"), "file", "line", "rule")
    return wide(kernels.union_all([pick(lint, "golangci"), pick(vuln, "vuln"), pick(work, "workflow")]))
