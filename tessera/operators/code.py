"""Questions about code, over fact tables: callers, uses, interfaces, packages, reviews, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import graph, kernels

C = F.col


def callers(calls: DataFrame, name: str, receiver: str = "", uses: DataFrame | None = None) -> DataFrame:
    """J-1, J-1b: calls of a function, or of ``x.name`` for any x, as test or direct. With ``uses`` also the
    places that hand the function on without calling it, as indirect (or test)."""
    hit = C("callee_text") == (f"{receiver}.{name}" if receiver else name)
    if not receiver:
        hit = hit | ((F.size(F.split("callee_text", r"\.")) == 2) & (C("callee_name") == name))
    kind = F.when(C("is_test"), "test").otherwise("direct")
    found = calls.filter(hit).select("path", "line", "caller_key", "callee_text", kind.alias("category"))
    if uses is None:
        return found
    handed = uses.filter((C("name") == name) & C("context").isin("other", "assign_rhs", "return") & (F.ltrim("receiver", F.lit("*")) == receiver.lstrip("*")))
    handed = handed.join(found.select("path", "line"), ["path", "line"], "left_anti")
    indirect = F.when(C("is_test"), "test").otherwise("indirect")
    return found.union(handed.select("path", "line", C("func_key").alias("caller_key"), C("name").alias("callee_text"), indirect.alias("category")).distinct())


def grouped_callers(found: DataFrame) -> DataFrame:
    return found.groupBy("category").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("path", "line", "caller_key"))).alias("sites"))


def uses(facts: DataFrame, name: str, receiver: str | None = None, contexts: tuple[str, ...] = ()) -> DataFrame:
    """J-2, P-6: uses of a name, by receiver (with or without a star) and context; one for each place, the
    first context in alphabetical order."""
    u = facts.filter(C("name") == name)
    if receiver is not None:
        u = u.filter(F.ltrim(C("receiver"), F.lit("*")) == receiver.lstrip("*"))
    if contexts:
        u = u.filter(C("context").isin(*contexts))
    return kernels.first_of_each(u, ["path", "line", "col"], ["context"])


def find_definition(defs: DataFrame, wanted: str) -> DataFrame:
    """P-7: by key; else the only method of that name; else nothing."""
    return kernels.unique_lookup(defs, C("key") == wanted, C("name") == wanted)


def suggestions(defs: DataFrame, n: int = 30) -> DataFrame:
    """P-7b."""
    return kernels.top(defs.select("key").distinct(), ["key"], n)


def api_surface(facts: dict[str, DataFrame]) -> DataFrame:
    """``symbol, signature`` of what is exported outside tests."""
    d = facts["decls"].filter("exported AND NOT is_test")
    part = lambda xs: F.array_join(F.transform(xs, lambda p: F.trim(F.concat_ws(" ", p["name"], p["type"]))), ", ")
    sig = F.when(C("kind").isin("func", "method"), F.concat(F.lit("func("), part("params"), F.lit(") ("), part("results"), F.lit(")"))).otherwise(C("kind"))
    a = d.select(F.concat_ws(".", "dir", "key").alias("symbol"), sig.alias("signature"))
    t = facts["types"].filter("exported AND NOT is_test").select(F.concat_ws(".", "dir", "name").alias("symbol"), F.concat("kind", F.lit("{"), part("fields"), F.lit(";"), F.array_join("methods", ","), F.lit("}")).alias("signature"))
    return a.union(t).groupBy("symbol").agg(F.min("signature").alias("signature"))


def review(old: DataFrame, new: DataFrame) -> DataFrame:
    """J-3b: functions that grew by 20 lines or 5 of complexity, or are new and that large."""
    before = old.select("path", "key", C("lines").alias("l0"), C("complexity").alias("c0"))
    j = new.join(before, ["path", "key"], "left")
    row = lambda rule, gap, least: j.withColumn("growth", gap).filter(C("growth") >= least).select("path", "key", F.lit(rule).alias("rule"), "growth")
    lines = row("grew-longer", C("lines") - F.coalesce("l0", F.lit(0)), 20)
    return lines.union(row("grew-more-complex", C("complexity") - F.coalesce("c0", F.lit(1)), 5))


def demoted(api: DataFrame, intents: DataFrame) -> DataFrame:
    """J-9: API findings whose symbol an intent covers become info; the first intent in the log counts."""
    owned = kernels.prefix_owner(api.select("symbol").distinct(), "symbol", intents, "scope")
    first = owned.join(intents, "scope").groupBy("symbol").agg(F.min_by("reason", "position").alias("intent"))
    return api.join(first, "symbol", "left").withColumn("severity", F.when(C("intent").isNotNull(), "info").otherwise(C("severity")))


CUT_MARK = "\n… [cut to the budget]"


def context_pack(facts: dict[str, DataFrame], key: str, budget: int) -> DataFrame:
    """J-6, W-4: a definition, its callers, the types of its signature and its tests: ``kind, path, text``.

    Over ``budget`` characters types go first, the last one before the others, then callers and tests in the
    same way; a definition that is still too long is cut, with a mark at its end."""
    d = facts["decls"].filter(C("key") == key)
    name = key.split(":")[-1]
    names = d.select(F.explode(F.concat("params.type", "results.type")).alias("t")).select(F.regexp_extract("t", r"([A-Za-z_]\w*)$", 1).alias("name")).distinct()
    row = lambda x, kind, worth, what: x.select(F.lit(kind).alias("kind"), F.lit(worth).alias("worth"), "path", what.alias("text"))
    calls = callers(facts["raw_calls"], name)
    parts = row(facts["blocks"].filter((C("func_key") == key) & C("is_fn_body")), "definition", 0, C("text"))
    parts = parts.union(row(calls.filter("category = 'direct'"), "caller", 1, F.concat_ws(":", "caller_key", C("line").cast("string"))))
    parts = parts.union(row(calls.filter("category = 'test'"), "test", 2, C("caller_key")))
    parts = parts.union(row(facts["types"].join(names, "name", "left_semi"), "type", 3, F.concat_ws(" ", "name", "kind")))
    return trimmed(parts.distinct(), budget)


def trimmed(parts: DataFrame, budget: int) -> DataFrame:
    """W-4: ``kind, path, text`` of parts (with ``worth``, 0 for what is cut instead of dropped) within a budget."""
    w = Window.partitionBy(F.lit(1)).orderBy("worth", "path", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.withColumn("before", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)))
    room = F.lit(budget) - C("before")
    cut = F.concat(F.left("text", F.greatest(room - len(CUT_MARK), F.lit(0))), F.lit(CUT_MARK))
    kept = before.filter((C("worth") == 0) | (F.length("text") <= room))
    return kept.select("kind", "path", F.when((C("worth") == 0) & (F.length("text") > room), cut).otherwise(C("text")).alias("text"))


def implements(divided: DataFrame, type_name: str, interface: str) -> DataFrame:
    """J-4b: one type against one interface, from the division: how many methods it has and which are missing."""
    return divided.filter((C("type") == type_name) & (C("iface") == interface))


def block_metrics(facts: dict[str, DataFrame], path: str, first: int, last: int) -> DataFrame:
    """AG-7: one row about a range of lines: statements, control statements, calls, names that are read and
    written in it, and the complexity (1 and the control statements)."""
    inside = lambda t, line="line": facts[t].filter((C("path") == path) & C(line).between(first, last))
    stmts = inside("stmts").agg(F.count("*").alias("n_stmts"), F.count_if(C("kind").isin("if", "for", "range", "switch", "select")).alias("n_control"))
    calls = inside("raw_calls").agg(F.count("*").alias("n_calls"))
    written = C("context") == "assign_lhs"
    used = inside("uses").agg(F.array_sort(F.collect_set(F.when(~written, C("name")))).alias("reads"), F.array_sort(F.collect_set(F.when(written, C("name")))).alias("writes"))
    one = lambda x: x.withColumn("one", F.lit(1))
    return one(stmts).join(one(calls), "one").join(one(used), "one").drop("one").withColumn("complexity", 1 + C("n_control"))


def scored_functions(facts: dict[str, DataFrame]) -> DataFrame:
    """AG-9b: how many functions and methods stand outside tests."""
    return facts["decls"].agg(F.count_if(C("kind").isin("func", "method") & ~C("is_test")).alias("functions"))


def conditions_met(spark: SparkSession, facts: dict[str, DataFrame], conditions: list[dict]) -> DataFrame:
    """P-5d: ``position, met`` of conditions of the kinds ``complexity`` (of a key, compared), ``function_exists``
    and ``file_exists`` (as wanted or not). Another kind is an error; a key that isn't there is null."""
    rows = [(n, c["kind"], c["of"], c.get("op", "eq"), int(c["value"])) for n, c in enumerate(conditions)]
    if bad := {r[1] for r in rows} - {"complexity", "function_exists", "file_exists"}:
        raise ValueError(f"unknown kinds of conditions: {sorted(bad)}")
    want = spark.createDataFrame(rows, "position int, kind string, of string, op string, value int")
    known = facts["fn_metrics"].groupBy(C("key").alias("of")).agg(F.max("complexity").alias("n")).withColumn("kind", F.lit("complexity"))
    known = known.unionByName(facts["decls"].select(C("key").alias("of"), F.lit(1).alias("n"), F.lit("function_exists").alias("kind")).distinct())
    known = known.unionByName(facts["files"].select(C("path").alias("of"), F.lit(1).alias("n"), F.lit("file_exists").alias("kind")))
    j = want.join(known, ["kind", "of"], "left").withColumn("n", F.when(C("kind") != "complexity", F.coalesce("n", F.lit(0))).otherwise(C("n")))
    met = F.lit(None).cast("boolean")
    for op in ("gt", "gte", "lt", "lte", "eq", "ne"):
        met = F.when(C("op") == op, {"gt": C("n") > C("value"), "gte": C("n") >= C("value"), "lt": C("n") < C("value"), "lte": C("n") <= C("value"), "eq": C("n") == C("value"), "ne": C("n") != C("value")}[op]).otherwise(met)
    return j.select("position", met.alias("met"))


def move_cycles(edges: DataFrame, moved_imports: DataFrame, source: str, target: str) -> DataFrame:
    """GR-8: packages that would close an import cycle if a declaration moved from ``source`` to ``target``:
    of what the moved code imports, and the source itself where it still calls it, those that reach the
    target already. ``edges`` is the closure of imports (src, dst); ``moved_imports`` has ``dir``."""
    needs = moved_imports.select("dir").distinct().filter(C("dir") != target)
    back = edges.filter(C("dst") == target).select(C("src").alias("dir")).distinct()
    return needs.join(back, "dir", "left_semi").withColumn("from", F.lit(source))


def package_graph(facts: dict[str, DataFrame]) -> DataFrame:
    """GR-5, GR-5d, AG-18: packages with files, functions, types and the packages of this tree they import."""
    from tessera.operators.rules import import_edges

    n = lambda t, name: facts[t].groupBy("dir").agg(F.count("*").alias(name))
    out = import_edges(facts).groupBy(C("src").alias("dir")).agg(F.array_sort(F.collect_set("dst")).alias("imports"))
    return n("files", "files").join(n("fn_metrics", "functions"), "dir", "left").join(n("types", "types"), "dir", "left").join(out, "dir", "left").na.fill(0)


def affected_packages(spark: SparkSession, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """GR-4: the changed directories (direct) and all that import them, near or far."""
    back = edges.select(C("dst").alias("src"), C("src").alias("dst"))
    far = graph.reachable(spark, back, changed.select(C("dir").alias("src"))).select(C("dst").alias("dir")).distinct()
    direct = changed.select("dir").distinct()
    return direct.withColumn("direct", F.lit(True)).union(far.join(direct, "dir", "left_anti").withColumn("direct", F.lit(False)))


def scope(packages: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """J-7: the changed packages and their direct importers."""
    importers = edges.join(changed.select(C("dir").alias("dst")), "dst", "left_semi").select(C("src").alias("dir"))
    return packages.select("dir").join(importers.union(changed.select("dir")).distinct(), "dir", "left_semi")


def single_use(required: DataFrame, imports: DataFrame) -> DataFrame:
    """J-10: requirements that exactly one file imports from."""
    owned = kernels.prefix_owner(imports.select("path", "import_path"), "import_path", required, "module")
    return owned.groupBy("module").agg(F.countDistinct("path").alias("n"), F.min("path").alias("path")).filter("n = 1").drop("n")


def extractable(blocks: DataFrame) -> DataFrame:
    """P-4: blocks within the ranges of complexity, reads, writes and statements; parameters are the reads
    that aren't written. ``blocks``: complexity, reads, writes (arrays), n_stmts."""
    ok = C("complexity").between(1, 10) & (F.size("reads") <= 20) & (F.size("writes") <= 10) & C("n_stmts").between(3, 50)
    return blocks.filter(ok).withColumn("parameters", F.array_except("reads", "writes"))


def reduction(blocks: DataFrame, threshold: int) -> DataFrame:
    """W-3: the blocks of each function, largest contribution first, until the rest is within the threshold."""
    return kernels.greedy_prefix(blocks, ["path", "key"], "contribution", threshold, [F.desc("contribution"), "start"])


def plan_suggestions(facts: dict[str, DataFrame]) -> DataFrame:
    """AG-8: extract what is complex, rename what isn't named in camel case, reorganise long files."""
    m = facts["fn_metrics"]
    a = m.filter("complexity >= 10").select("path", C("key").alias("target"), F.lit("extract_method").alias("kind"))
    b = facts["decls"].filter(C("kind").isin("func", "method") & ~C("is_test") & C("name").contains("_") & (C("name") != "_")).select("path", C("key").alias("target"), F.lit("rename_declaration").alias("kind"))
    c = facts["files"].filter("n_lines > 500").select("path", C("path").alias("target"), F.lit("reorganise").alias("kind"))
    return a.union(b).union(c)


def rename_advice(facts: dict[str, DataFrame], name: str) -> DataFrame:
    """AG-10: references inside and in tests, and what speaks against a rename."""
    u = facts["uses"].filter(C("name") == name).agg(F.count_if("is_test").alias("in_tests"), F.count_if(~C("is_test")).alias("internal"))
    why = F.array_compact(F.array(F.when(text.is_exported(F.lit(name)), "exported: other modules may use it"), F.when(text.is_builtin(F.lit(name)), "a builtin"), F.when(~text.is_identifier(F.lit(name)), "not an identifier")))
    return u.withColumn("reasons", why)


def target_score(wanted_name: str | None = None, wanted_kind: str | None = None, pattern: str | None = None, substring: str | None = None, identifiers: tuple[str, ...] = (), calls: tuple[str, ...] = (), receiver: str | None = None) -> Column:
    """T-4b: the additive score of a declaration (name, kind, receiver, text, idents, callees); a receiver
    that doesn't match rules it out."""
    s = F.lit(0)
    if wanted_name:
        s = s + F.when(C("name") == wanted_name, 10).otherwise(0)
    if wanted_kind:
        s = s + F.when(C("kind") == wanted_kind, 10).otherwise(0)
    if pattern:
        s = s + F.when(C("text").rlike(pattern), 5).otherwise(0)
    if substring:
        s = s + F.when(F.contains("text", F.lit(substring)), 3).otherwise(0)
    for i in identifiers:
        s = s + F.when(F.array_contains("idents", i), 2).otherwise(0)
    for c in calls:
        s = s + F.when(F.array_contains("callees", c), 3).otherwise(0)
    if receiver:
        s = F.when(text.receiver_type(C("receiver")) == receiver, s + 10).otherwise(0)
    return s


def plan_statistics(results: DataFrame) -> DataFrame:
    """AG-17: ``success, fallback, changes`` a row."""
    return results.agg(F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~C("success")).alias("failed"), F.count_if("fallback").alias("fallbacks"), F.coalesce(F.sum("changes"), F.lit(0)).alias("changes"))


def search_runs(stmts: DataFrame, pattern: tuple[str | None, ...]) -> DataFrame:
    """SQ-1: places where a run of statements has these shapes; None stands for any statement."""
    return kernels.sequences(stmts, ["path", "block_id"], ["idx"], "shape", pattern).select("path", "func_key", "line")


def skeleton(facts: dict[str, DataFrame]) -> DataFrame:
    d = facts["decls"].filter("kind IN ('func', 'method')")
    return d.select("path", "key", "start", "end", (C("end") - C("start") + 1).alias("lines")).orderBy("path", "start")


def inspect(facts: dict[str, DataFrame], path: str) -> DataFrame:
    """A file's declarations, types and imports as one list."""
    row = lambda t, kind, name, line: facts[t].filter(C("path") == path).select(F.lit(kind).alias("kind"), C(name).alias("name"), C(line).alias("line"))
    return row("decls", "declaration", "key", "start").union(row("types", "type", "name", "start")).union(row("imports", "import", "import_path", "line")).orderBy("line", "name")


def sweep(cells: DataFrame, prices: DataFrame) -> DataFrame:
    """AG-13, J-11, F-13: runs by provider, model and mode, with their cost where the model has a price."""
    priced = kernels.longest_prefix(cells, "model", prices, "prefix", "rate").withColumn("provider", text.provider_of(C("model")))
    usd = kernels.cost_usd(C("prompt_tok"), C("compl_tok"), C("rate.in_per_1m"), C("rate.out_per_1m"))
    g = priced.withColumn("usd", usd).groupBy("provider", "model", "mode").agg(F.count("*").alias("n"), F.count_if("pass").alias("passed"), F.sum("prompt_tok").alias("prompt_tok"), F.sum("compl_tok").alias("compl_tok"), F.when(F.count("usd") == F.count("*"), F.sum("usd")).alias("usd"), F.floor(F.sum("wall_ms") / F.count("*")).cast("long").alias("avg_ms"))
    rate = C("passed") / C("n")
    return g.withColumn("pass_rate", rate).withColumn("cost_of_pass", F.try_divide("usd", rate))
