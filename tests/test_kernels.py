import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import findings, graph, kernels


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_ratchet_counts_occurrences(spark):
    base = spark.createDataFrame([("f1", 1), ("f2", 2)], "fp string, count int")
    now = spark.createDataFrame([("f1", 10), ("f2", 1), ("f2", 2), ("f2", 3), ("f3", 1)], "fp string, line int")
    assert rows(kernels.ratchet(now, base, "fp", ["line"])) == [("f2", 3), ("f3", 1)]


def test_ratchet_on_empty_tables(spark):
    base = spark.createDataFrame([], "fp string, count int")
    now = spark.createDataFrame([], "fp string, line int")
    assert rows(kernels.ratchet(now, base, "fp", ["line"])) == []


def test_keyed_diff_and_breaking(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "s string, sig string")
    new = spark.createDataFrame([("b", "3"), ("c", None), ("d", "4")], "s string, sig string")
    diff = kernels.keyed_diff(old, new, "s", "sig")
    assert rows(diff, "s", "change") == [("a", "removed"), ("b", "changed"), ("d", "added")]
    assert kernels.is_breaking(diff).first().breaking
    assert not kernels.is_breaking(diff.filter("change = 'added'")).first().breaking
    assert not kernels.is_breaking(diff.limit(0)).first().breaking


def test_division(spark):
    have = spark.createDataFrame([("t1", "a"), ("t1", "b"), ("t2", "a"), ("t3", "z")], "type string, m string")
    need = spark.createDataFrame([("i", "a"), ("i", "b"), ("j", "a")], "iface string, m string")
    d = kernels.division(have, need, "type", "iface", "m")
    assert rows(d, "type", "iface", "missing", "complete") == [("t1", "i", [], True), ("t1", "j", [], True), ("t2", "i", ["b"], False), ("t2", "j", [], True)]
    assert rows(kernels.sole_implementations(d, "iface", "type")) == [("i", "t1")]


def test_islands_and_sequences(spark):
    e = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a"), (2, 5, None), (2, 6, None)], "u int, t int, k string")
    assert rows(kernels.islands(e, ["u"], ["t"], "k"), "u", "k", "n", "first", "last") == [(1, "a", 1, 4, 4), (1, "a", 2, 1, 2), (1, "b", 1, 3, 3), (2, None, 2, 5, 6)]
    assert rows(kernels.sequences(e, ["u"], ["t"], "k", ["a", None, "a"]), "t") == [(2,)]


def test_longest_prefix(spark):
    p = spark.createDataFrame([("gpt-4", 1.0), ("gpt-4o", 2.0)], "prefix string, rate double")
    m = spark.createDataFrame([("gpt-4o-mini",), ("gpt-4",), ("other",)], "model string")
    assert rows(kernels.longest_prefix(m, "model", p, "prefix", "rate"), "model", "rate") == [("gpt-4", 1.0), ("gpt-4o-mini", 2.0), ("other", None)]


def test_best_targets_mark_ties(spark):
    t = spark.createDataFrame([("g", 1, 5), ("g", 2, 5), ("h", 3, 7), ("h", 4, 1), ("k", 5, 0)], "g string, id int, s int")
    assert rows(kernels.best_targets(t, ["g"], F.col("s"), "id"), "id", "ambiguous") == [(1, True), (2, True), (3, False)]


def test_roll_up_is_null_without_a_pass(spark):
    r = spark.createDataFrame([("a", False, 4.0, 3), ("b", True, 2.0, 5), ("b", False, 2.0, 4)], "m string, ok boolean, usd double, ms int")
    assert rows(kernels.roll_up(r, ["m"], "ok", "usd", "ms"), "m", "cost_of_pass", "avg_wall") == [("a", None, 3), ("b", 8.0, 4)]


def test_clusters_keep_first_seen_order(spark):
    r = spark.createDataFrame([(1, "k", "cannot find 'x'", "s2"), (2, "k", "cannot find 'y'", "s1"), (3, "k", "cannot find 'z'", "s2"), (4, "q", "boom", "s1")], "p int, kind string, reason string, spec string")
    got = kernels.clusters(r, ["kind"], text.shaped_reason(F.col("reason")), "spec", "p").orderBy(F.desc("n")).collect()
    assert [(x.kind, x.n, x.specs) for x in got] == [("k", 3, ["s2", "s1"]), ("q", 1, ["s1"])]


def test_greedy_prefix_and_budget(spark):
    b = spark.createDataFrame([("f", 5), ("f", 9), ("f", 2)], "k string, c int")
    assert rows(kernels.greedy_prefix(b, ["k"], "c", 7, [F.desc("c")]), "c") == [(9,)]
    assert rows(kernels.budget_trim(b, ["k"], F.col("c"), 14, [F.desc("c")]), "c") == [(5,), (9,)]


def test_closest(spark):
    w = spark.createDataFrame([("renam",), ("qqqqqq",)], "w string")
    n = spark.createDataFrame([("rename",), ("remove",), ("parse",)], "n string")
    assert rows(kernels.closest(w, "w", n, "n")) == [("renam", "rename")]


def test_unique_lookup(spark):
    d = spark.createDataFrame([("T:Run", "Run"), ("U:Run", "Run"), ("T:Stop", "Stop")], "key string, name string")
    ask = lambda x: rows(kernels.unique_lookup(d, F.col("key") == x, F.col("name") == x), "key")
    assert ask("Stop") == [("T:Stop",)] and ask("Run") == [] and ask("U:Run") == [("U:Run",)]


def test_rename_pair(spark):
    d = spark.createDataFrame([(["a", "b", "a"], ["c", "b", "c"]), (["a", "b"], ["c", "d"])], "o array<string>, n array<string>")
    assert sorted(r[0] for r in d.select(kernels.rename_pair(F.col("o"), F.col("n"))[0]).collect()) == [False, True]


EDGES = [("A", "B"), ("B", "C"), ("C", "A"), ("D", "A")]


def test_closure_equals_naive(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string")
    want, new = set(EDGES), set(EDGES)
    while new:
        new = {(a, d) for a, b in want for c, d in EDGES if b == c} - want
        want |= new
    c = graph.reachable(spark, e)
    assert set(rows(c, "src", "dst")) == want
    assert rows(graph.cycle_nodes(c)) == [("A",), ("B",), ("C",)]
    assert graph.reachable(spark, e.limit(0)).count() == 0


def test_paths(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string")
    t = graph.path_tree(e, spark.createDataFrame([("D",)], "root string"), 4).collect()
    assert ("D>A>B>C>A", True) in {(">".join(r.path), r.is_cycle) for r in t}
    assert graph.shortest_path(spark, e, "D", "C") == ["D", "A", "B", "C"]
    assert graph.shortest_path(spark, e, "A", "D") is None
    assert dict(rows(graph.longest_chain(spark, e)))["D"] == 3


def test_call_resolution_and_blast(spark):
    defs = spark.createDataFrame([("f", "f", ""), ("T:f", "f", "T"), ("g", "g", "")], "key string, name string, receiver string")
    raw = spark.createDataFrame([("g", "f", False), ("h", "f", True)], "caller_key string, callee_name string, is_selector boolean")
    assert rows(graph.resolve_calls(raw, defs)) == [("g", "f"), ("h", "T:f"), ("h", "f")]
    hub = spark.createDataFrame([(f"c{i}", "hub") for i in range(25)], "src string, dst string")
    nodes = spark.createDataFrame([(f"c{i}", f"f{i % 5}", "p", False) for i in range(25)] + [("hub", "h", "p", True)], "node string, file string, package string, exported boolean")
    got = graph.blast_radius(graph.reachable(spark, hub), nodes).collect()
    assert [(r.node, r.score, r.level) for r in got] == [("hub", 2 * 25 + 5 + 1 + 5, "high")]


def test_findings_flow(spark):
    f = spark.createDataFrame([("a.go", 3, "r1", "warning", "m", "line 3 bad", 0, 0), ("a.go", 9, "r1", "warning", "m", "line 9 bad", 0, 0), ("b_test.go", 1, "r2", "info", "m", "x", 0, 0)], findings.SCHEMA)
    base = kernels.baseline_of(findings.fingerprinted(f.limit(1)), "fingerprint")
    assert [r.line for r in findings.surfaced(f.filter("rule = 'r1'"), base).collect()] == [9]
    assert rows(findings.override(f, {"r1": "error", "r2": "off"}), "severity") == [("error",), ("error",)]
    assert rows(findings.exclude(f, spark.createDataFrame([("r2", "tests")], "rule string, package string")), "rule") == [("r1",), ("r1",)]
    assert findings.health(f.limit(0), 10).first().score == 100
    assert 0 < findings.health(f, 10).first().score < 100
    assert findings.health(f.withColumn("rule", F.lit("high-blast-radius")), 10).first().score == 100
    v = findings.verdict(f, spark.createDataFrame([("x", True, "failed")], "name string, gating boolean, state string")).first()
    assert (v.errors, v.dark, v.green) == (0, 1, False)


@pytest.mark.parametrize(
    ("f", "arg", "want"),
    [
        (text.collapse_digits, "a12b3", "a#b#"),
        (text.shaped_reason, "Cannot open 'x.go' at src/a/b.go:12 on 7", "cannot open <q> at <path> on <n>"),
        (text.normalise_code, "foo(a, // c\n return err", "VAR return VAR"),
        (text.normalise_code, "if err != nil { /* x */ return nil }", "if VAR != nil { return nil }"),
        (text.strip_position, "a/b.go:12:3", "a/b.go"),
        (text.camel_words, "parseHTTPHeader", "parse http header"),
        (text.receiver_type, "*T[K]", "T"),
        (text.language_of, "x/y.go", "go"),
        (text.provider_of, "claude-x", "anthropic"),
        (lambda c: text.triage(c)["new_name"], "Please rename the function foo to bar", "bar"),
        (lambda c: text.split_key(c)[1], "T:m:x", "m:x"),
        (lambda c: text.ellipsis(c, 3), "abcd", "abc…"),
        (lambda c: text.marked_json(c, "<<", ">>"), "x <<{1}>> y", "{1}"),
        (lambda c: text.relative_path(c, "/r"), "/r/a.go", "a.go"),
    ],
)
def test_text(spark, f, arg, want):
    assert spark.createDataFrame([(arg,)], "x string").select(f(F.col("x"))).first()[0] == want


def test_hunk_header_and_conditions(spark):
    h = spark.createDataFrame([("@@ -3 +4,2 @@ f",)], "x string").select(text.hunk_header(F.col("x"))).first()[0]
    assert tuple(h) == (3, 1, 4, 2)
    with pytest.raises(ValueError):
        text.compare("regex", F.col("x"), 3)
    with pytest.raises(Exception, match="can't be evaluated"):
        spark.createDataFrame([(None,)], "x int").select(text.all_conditions([F.col("x") > 1])).collect()
