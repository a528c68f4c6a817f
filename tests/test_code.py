import json

import pytest
from pyspark.sql import functions as F

from tessera.functions.golang import complexity, nesting, parse
from tessera.operators import code, rules
from tessera.sources import diffs, gofacts, logs, tools
from tessera.streaming import clusters

A = """package shop

import (
	"fmt"
	log "log"
	"time"
	"example.com/x/util"
)

// Store keeps things.
type Store struct {
	a, b int
	name string `json:"n"`
}

type Keeper interface {
	Get(k string) (int, error)
	Put(k string, v int) error
}

func NewStore() *Store { return &Store{} }

func (s *Store) Get(k string) (int, error) {
	v, err := util.Load(k)
	if err != nil {
		log.Printf("load: %v", err)
		return 0, err
	}
	return v, nil
}

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
	panic("no")
}
"""
T = """package shop

import ("testing"; "time")

func TestGet(t *testing.T) {
	s := NewStore()
	s.Get("x")
	time.Sleep(1)
	Unused(1, 2, 3, 4, 5, 6, 7, 8)
}
"""
G = "// Code generated by x. DO NOT EDIT.\npackage util\n\nfunc Load(k string) (int, error) { return 0, nil }\n"


@pytest.fixture(scope="module")
def facts(spark):
    files = spark.createDataFrame([("shop/a.go", A), ("shop/a_test.go", T), ("util/u.go", G), ("vendor/v/v.go", G), (".x/h.go", G), ("shop/z.gen.go", G)], "path string, text string")
    return gofacts.fact_tables(spark, gofacts.pruned(files))


def test_parser():
    f = parse(A)
    put = next(x for x in f.funcs if x.name == "Put")
    assert (put.receiver, 1 + complexity(put.body), nesting(put.body)) == ("*Store", 5, 3)
    assert [(t.name, t.kind, t.field_groups, t.methods) for t in f.types] == [("Store", "struct", 2, []), ("Keeper", "interface", 0, ["Get", "Put"])]
    u = next(x for x in f.funcs if x.name == "Unused")
    assert (u.param_fields, len(u.params), u.results) == (1, 8, [("", "Keeper")])
    assert parse("").package == "" and parse("func (").funcs[0].name == ""


def test_files_and_pruning(facts):
    got = {r.path: (r.is_test, r.is_generated, r.package) for r in facts["files"].collect()}
    assert got == {"shop/a.go": (False, False, "shop"), "shop/a_test.go": (True, False, "shop"), "util/u.go": (False, True, "util")}


def fired(facts, name):
    return rules.RULES[name](facts).collect()


def test_every_rule_runs(facts):
    assert len(rules.RULES) == 48
    for name, f in rules.RULES.items():
        out = f(facts)
        assert out is None or {r.rule for r in out.collect()} <= {name}


def test_rules_fire(facts):
    assert [r.message for r in fired(facts, "if-err-log-return")] == ["Store:Get logs an error and returns it"]
    assert len(fired(facts, "wrap-log-return")) == 1
    assert [r.line for r in fired(facts, "sleep-in-test")] == [8]
    assert [r.severity for r in fired(facts, "fatal-in-library")] == ["info"]
    assert len(fired(facts, "unstopped-ticker")) == 1 and len(fired(facts, "naked-goroutine")) == 1
    assert {r.message.split(" ")[0] for r in fired(facts, "test-only-live")} >= {"Unused"}
    assert [r.message for r in fired(facts, "dead-code")] == ["onlyHere is never used"]
    assert len(fired(facts, "vacuous-test")) == 1
    assert [r.file for r in fired(facts, "untested-package")] == ["util"]
    assert len(fired(facts, "premature-abstraction")) == 1
    assert fired(facts, "excessive-params") == []


def test_rules_with_outside_input(spark, facts):
    more = facts | {
        "plans": spark.createDataFrame([("p.json", json.dumps({"operations": [{"type": "rename_declaration"}, {"type": "fly"}]}))], "path string, text string"),
        "coverage": spark.createDataFrame([("shop/a.go:10:\tNewStore\t0.0%",), ("shop/a.go:40:\thelper\t0.0%",)], "value string"),
        "tracked": spark.createDataFrame([("bin/x", bytearray(b"a\x00")), ("a.txt", bytearray(b"a")), ("coverage.out", bytearray(b"m"))], "path string, content binary"),
        "config_paths": spark.createDataFrame([("^shop/",), ("^gone/",)], "pattern string"),
        "changed": spark.createDataFrame([(p,) for p in "abc"], "path string"),
        "journal": spark.createDataFrame([("a", 5), ("b", 1)], "path string, time int"),
        "since": spark.createDataFrame([(3,)], "time int"),
    }
    assert [r.message for r in fired(more, "advertised-but-unwired")] == ["operation fly isn't known"]
    assert [r.message for r in fired(more, "untested-function")] == ["NewStore isn't covered"]
    assert sorted(r.file for r in fired(more, "tracked-artifact")) == ["bin/x", "coverage.out"]
    assert [r.file for r in fired(more, "orphaned-config-path")] == ["^gone/"]
    assert [r.value for r in fired(more, "low-tool-adherence")] == [1]


def test_run_rules_with_tiers(facts):
    out = rules.run_rules(facts, only=("dead-code", "sleep-in-test"), tiers={"dead-code": "error", "sleep-in-test": "off"}).collect()
    assert [(r.rule, r.severity) for r in out] == [("dead-code", "error")]


def test_code_queries(spark, facts):
    assert [(r.category, r.n) for r in code.grouped_callers(code.callers(facts["raw_calls"], "NewStore")).collect()] == [("test", 1)]
    assert code.callers(facts["raw_calls"], "helper").count() == 1
    api = code.api_surface(facts)
    assert {r.symbol for r in api.collect()} >= {"shop.NewStore", "shop.Store", "shop.Store:Get", "util.Load"}
    assert {r.type for r in rules.implementations(facts).filter("complete").collect()} == {"Store"}
    edges = rules.import_edges(facts)
    assert [tuple(r) for r in edges.collect()] == [("shop", "util")]
    changed = spark.createDataFrame([("util",)], "dir string")
    assert sorted(tuple(r) for r in code.affected_packages(spark, edges, changed).collect()) == [("shop", False), ("util", True)]
    assert sorted(r.dir for r in code.scope(facts["files"].select("dir").distinct(), edges, changed).collect()) == ["shop", "util"]
    assert {r.kind for r in code.context_pack(facts, "helper", 10_000).collect()} == {"definition", "caller"}
    assert code.rename_advice(facts, "NewStore").first().in_tests == 1
    assert code.uses(facts["uses"], "Load", "*util").first().context == "call"
    grown = code.review(facts["fn_metrics"].withColumn("lines", F.lit(1)), facts["fn_metrics"].withColumn("lines", F.lit(30)))
    assert {r.rule for r in grown.collect()} == {"grew-longer"}
    assert code.inspect(facts, "shop/a.go").count() > 8 and code.skeleton(facts).count() == 8
    assert code.package_graph(facts).filter("dir = 'shop'").first().imports == ["util"]


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


def test_diff(spark):
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(DIFF.split("\n")[:-1])], "diff_id string, pos int, line string")
    got = sorted((r.old_line, r.new_line, r.old, r.new, r.kind) for r in diffs.changes(diffs.parse_diff(lines)).collect())
    assert got == [(2, 2, "func Old() {}", "func New() {}", "function_modified"), (4, 4, "a := foo(1)", "a := bar(1)\nb := 2", "modification")]
    assert [tuple(r) for r in diffs.summary(diffs.changes(diffs.parse_diff(lines))).collect()] == [("function_modified", 1), ("modification", 1)]


def test_logs(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"kind":"k","reason":"r"}\nnot json\n{"kind":"q","tool":"t"}\n')
    got = logs.read_log(spark, str(tmp_path / "a.jsonl"), logs.FAILURES)
    assert sorted((r.kind, r.tool, r.reason) for r in got.collect()) == [("k", "", "r"), ("q", "t", "")]
    assert logs.tail(got, 1).first().kind == "q"


def test_tools(spark):
    one = lambda x, c="data": spark.createDataFrame([(y,) for y in x], f"{c} string")
    g = tools.golangci(one([json.dumps({"Issues": [{"FromLinter": "x", "Text": "t", "Pos": {"Filename": "a.go", "Line": 3}}]})])).first()
    assert (g.file, g.line, g.rule) == ("a.go", 3, "golangci/x")
    v = tools.govulncheck(one([json.dumps({"osv": {"id": "V1", "summary": "s"}}), json.dumps({"finding": {"osv": "V1", "trace": [{"module": "m", "function": "f", "position": {"filename": "a.go", "line": 2}}]}})])).collect()
    assert [(r.severity, r.message) for r in v] == [("error", "V1 s")]
    assert tools.workflowcheck(one(["a.go:3:4: bad", "noise"], "value")).first().line == 3
    assert tools.modtidy(one(["--- go.mod", "+require x v1"], "value")).count() == 1
    assert tools.load_config('{"rules": {"x": "off"}}')["rules"] == {"x": "off"}
    with pytest.raises(ValueError):
        tools.load_config('{"rules": {"x": "loud"}}')


def test_sweep(spark):
    cells = spark.createDataFrame([("claude-x", "m", True, 10**6, 0, 5), ("claude-x", "m", False, 10**6, 0, 6), ("odd", "m", True, 1, 1, 1)], logs.SWEEP)
    prices = spark.createDataFrame([("claude", (3.0, 15.0))], "prefix string, rate struct<in_per_1m:double,out_per_1m:double>")
    got = {r.model: (r.provider, r.usd, r.cost_of_pass, r.avg_ms) for r in code.sweep(cells, prices).collect()}
    assert got == {"claude-x": ("anthropic", 6.0, 12.0, 5), "odd": ("local", None, None, 1)}


def test_streaming_clusters(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rec = lambda ts, r: json.dumps({"ts": ts, "kind": "k", "tool": "t", "op": "", "reason": r, "spec": "s", "context": ""})
    (src / "a.json").write_text("\n".join([rec("2024-01-01T00:10:00Z", "no 'a'"), rec("2024-01-01T00:20:00Z", "no 'b'"), rec("2024-01-01T00:20:00Z", "no 'b'")]))
    q = clusters.windowed_clusters(clusters.read_failures(spark, str(src))).writeStream.format("memory").queryName("fc").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.reason, r.n) for r in spark.table("fc").collect()] == [("no <q>", 2)]
