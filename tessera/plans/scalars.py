"""Queries of the scalar functions and of the operators on findings, over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import code, findings, kernels, rules
from tessera.plans.registry import query, table

C = F.col
_KEEP = "[" + ", ".join(f"'{w}'" for w in (*text.KEYWORDS, *text.BUILTINS)) + "]"
_COLLAPSED = "regexp_replace({}, '[ \\t\\r\\n\\f]+', ' ', 'g')"


@query(f"""
    WITH a AS (SELECT conv_id, turn, trim({_COLLAPSED.format("regexp_replace(regexp_replace('x := 1 // c' || chr(10) || coalesce(text, '') || ' /* d' || chr(10) || ' */ return err', '//[^' || chr(10) || ']*', '', 'g'), '(?s)/[*].*?[*]/', '', 'g')")}, ' ') AS t FROM conversations)
    SELECT conv_id, turn, md5(array_to_string(list_transform(list_filter(string_split(t, ' '), lambda w: w <> ''), lambda w: CASE WHEN regexp_matches(w, '^[A-Za-z_]') AND NOT list_contains({_KEEP}, w) THEN 'VAR' ELSE w END), ' ')) AS norm FROM a
""")
def normalised_code(spark, sf_dir):
    """F-1, F-2."""
    raw = F.concat(F.lit("x := 1 // c\n"), F.coalesce("text", F.lit("")), F.lit(" /* d\n */ return err"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.encode(text.normalise_code(raw), "utf-8")).alias("norm"))


@query("""
    SELECT p_partkey, 'if VAR != nil { return ' || CASE WHEN p_size % 3 = 0 THEN '{' || p_name || '}' ELSE p_name END || ' }' AS norm,
           p_size % 3 <> 0 OR contains(p_name, 'red') AS idiom FROM part
""")
def idioms(spark, sf_dir):
    """F-1b, with a configured substring."""
    norm = F.concat(F.lit("if VAR != nil { return "), F.when(C("p_size") % 3 == 0, F.concat(F.lit("{"), "p_name", F.lit("}"))).otherwise(C("p_name")), F.lit(" }"))
    return table(spark, sf_dir, "part").select("p_partkey", norm.alias("norm")).withColumn("idiom", text.is_idiom(C("norm"), ("red",)))


_FINDINGS = """
    f AS (SELECT 'pkg' || (o_custkey % 7) || '/' || CASE WHEN o_custkey % 5 = 0 THEN 'a_test.go' ELSE 'a.go' END AS file, CAST(o_custkey % 90 AS INTEGER) AS line,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'high-blast-radius' WHEN '2-HIGH' THEN 'complexity' WHEN '3-MEDIUM' THEN 'dead-code' WHEN '4-NOT SPECIFIED' THEN 'untested-package' ELSE 'file-size' END AS rule,
          CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'warning' ELSE 'info' END AS severity, '/r/x: ' || o_orderkey || ' of /r/y' AS message, o_custkey % 40 AS value, 10 AS threshold FROM orders)
"""


def _findings(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rule = F.when(C("o_orderpriority") == "1-URGENT", "high-blast-radius").when(C("o_orderpriority") == "2-HIGH", "complexity").when(C("o_orderpriority") == "3-MEDIUM", "dead-code").when(C("o_orderpriority") == "4-NOT SPECIFIED", "untested-package").otherwise("file-size")
    file = F.concat(F.lit("pkg"), (C("o_custkey") % 7).cast("string"), F.lit("/"), F.when(C("o_custkey") % 5 == 0, "a_test.go").otherwise("a.go"))
    severity = F.when(C("o_orderstatus") == "F", "error").when(C("o_orderstatus") == "O", "warning").otherwise("info")
    return o.select(file.alias("file"), (C("o_custkey") % 90).cast("int").alias("line"), rule.alias("rule"), severity.alias("severity"), F.lit("c").alias("category"), F.concat(F.lit("/r/x: "), C("o_orderkey").cast("string"), F.lit(" of /r/y")).alias("message"), (C("o_custkey") % 40).alias("value"), F.lit(10).cast("bigint").alias("threshold"))


@query(f"WITH {_FINDINGS} SELECT md5(file || chr(0) || rule || chr(0) || regexp_replace(message, '[0-9]+', '#', 'g')) AS fp, count(*) AS count, min(severity) AS severity FROM f GROUP BY 1")
def baseline_sink(spark, sf_dir):
    """F-3, F-3b, S-13: the counted multiset that a baseline holds."""
    f = findings.fingerprinted(_findings(spark, sf_dir)).withColumn("fp", F.md5(F.encode("fingerprint", "utf-8")))
    return kernels.baseline_of(f, "fp", "severity")


@query(f"""
    WITH {_FINDINGS} SELECT file, 0 AS line, rule, 'info' AS severity, count(*) || ' functions with a high blast radius' AS message, count(*) AS value FROM f WHERE rule = 'high-blast-radius' GROUP BY file, rule
    UNION ALL SELECT file, line, rule, severity, message, NULL FROM f WHERE severity <> 'info' AND rule <> 'high-blast-radius'
""")
def displayed(spark, sf_dir):
    """P-2."""
    f = _findings(spark, sf_dir)
    out = findings.display(f)
    return out.withColumn("value", F.when(C("rule") == "high-blast-radius", F.regexp_extract("message", "^[0-9]+", 0).cast("long"))) if "value" not in out.columns else out


@query(f"""
    WITH {_FINDINGS} SELECT file, rule, count(*) AS n FROM f
    WHERE NOT (rule = 'dead-code' AND file LIKE '%_test.go') AND NOT (rule = 'complexity' AND file LIKE 'pkg3/%') AND rule <> 'file-size' GROUP BY file, rule
""")
def policy_excluded(spark, sf_dir):
    """P-3c: a rule for tests, a rule for a package, a rule everywhere."""
    policy = spark.createDataFrame([("dead-code", "tests"), ("complexity", "pkg3"), ("file-size", "*")], "rule string, package string")
    return findings.exclude(_findings(spark, sf_dir), policy).groupBy("file", "rule").agg(F.count("*").alias("n"))


@query(f"WITH {_FINDINGS} SELECT file, line, rule, replace(message, '/r/', '') AS message FROM f WHERE file <> 'pkg2/a.go'")
def merge_layer(spark, sf_dir):
    """P-3d: without generated files and the root's prefix."""
    generated = spark.createDataFrame([("pkg2/a.go",)], "file string")
    return findings.merged(_findings(spark, sf_dir), "/r", generated).select("file", "line", "rule", "message")


@query(f"WITH {_FINDINGS} SELECT file, line, rule, severity, message, row_number() OVER (ORDER BY file, line, rule, severity, message) AS n FROM f QUALIFY n <= 50")
def first_findings(spark, sf_dir):
    """T-1, T-1b: the first 50 in the total order (a report's length)."""
    f = findings.ordered(_findings(spark, sf_dir)).limit(50)
    return kernels.numbered(f.withColumn("one", F.lit(1)), ["one"], ["file", "line", "rule", "severity", "message"]).select("file", "line", "rule", "severity", "message", C("n").cast("long").alias("n"))


@query(f"WITH {_FINDINGS} SELECT count(*) FILTER (severity = 'error') AS errors, CAST(1 AS BIGINT) AS dark, FALSE AS green FROM f")
def gate_verdict(spark, sf_dir):
    """The verdict: new errors, and gating tools that didn't run."""
    tools = spark.createDataFrame([("a", True, "ran"), ("b", True, "absent"), ("c", False, "absent")], "name string, gating boolean, state string")
    return findings.verdict(_findings(spark, sf_dir), tools).select("errors", "dark", "green")


@query("""
    SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower('A "q x" ''z'' pkg/a.go:12 7 ' || coalesce(text, '')), '"[^"]*"|''[^'']*''|`[^`]*`', '<q>', 'g'), '[A-Za-z0-9_./-]+[.]go(:[0-9]+)?', '<path>', 'g'), '\\b[0-9]+\\b', '<n>', 'g'), '[ \\t\\r\\n\\f]+', ' ', 'g'), ' ')) AS reason FROM conversations
""")
def shaped_reasons(spark, sf_dir):
    """F-3d."""
    raw = F.concat(F.lit("A \"q x\" 'z' pkg/a.go:12 7 "), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.encode(text.shaped_reason(raw), "utf-8")).alias("reason"))


@query("SELECT conv_id, turn, coalesce(regexp_matches(text, '^\\p{Lu}'), FALSE) AS exported FROM conversations")
def exported_names(spark, sf_dir):
    """F-4."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(text.is_exported(C("text")), F.lit(False)).alias("exported"))


@query("""
    WITH k AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand || ':' || p_type ELSE p_type END AS key FROM part)
    SELECT p_partkey, key, CASE WHEN contains(key, ':') THEN split_part(key, ':', 1) ELSE '' END AS receiver, CASE WHEN contains(key, ':') THEN split_part(key, ':', 2) ELSE key END AS name FROM k
""")
def method_keys(spark, sf_dir):
    """F-5: built and split again."""
    key = text.make_key(F.when(C("p_size") > 25, C("p_brand")).otherwise(""), C("p_type"))
    receiver, name = text.split_key(C("key"))
    return table(spark, sf_dir, "part").select("p_partkey", key.alias("key")).select("p_partkey", "key", receiver.alias("receiver"), name.alias("name"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '*' WHEN 1 THEN '(s *' WHEN 2 THEN '' ELSE '(s ' END || split_part(p_name, ' ', 2) || CASE WHEN p_size % 3 = 0 THEN '[K, V]' ELSE '' END AS receiver, split_part(p_name, ' ', 2) AS type FROM part")
def receiver_types(spark, sf_dir):
    """F-6."""
    lead = F.when(C("p_size") % 4 == 0, "*").when(C("p_size") % 4 == 1, "(s *").when(C("p_size") % 4 == 2, "").otherwise("(s ")
    receiver = F.concat(lead, F.split_part("p_name", F.lit(" "), F.lit(2)), F.when(C("p_size") % 3 == 0, "[K, V]").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", receiver.alias("receiver")).withColumn("type", text.receiver_type(C("receiver")))


@query("""
    SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS INTEGER) AS old_start, CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber ELSE 1 END AS INTEGER) AS old_count, CAST(l_partkey AS INTEGER) AS new_start, CAST(CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey ELSE 1 END AS INTEGER) AS new_count FROM lineitem
""")
def hunk_headers(spark, sf_dir):
    """F-7: a missing count is 1."""
    some = lambda c, n, k: F.when(C("l_linenumber") % k == 0, F.concat(F.lit(","), C(n).cast("string"))).otherwise("")
    line = F.concat(F.lit("@@ -"), C("l_orderkey").cast("string"), some("", "l_linenumber", 2), F.lit(" +"), C("l_partkey").cast("string"), some("", "l_suppkey", 3), F.lit(" @@ func"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.hunk_header(line).alias("h")).select("l_orderkey", "l_linenumber", "h.*")


@query("""
    WITH l AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]*') AS w FROM conversations)
    SELECT conv_id, turn, md5(array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ')) AS names FROM l
""")
def identifiers_seen(spark, sf_dir):
    """F-8c: distinct identifiers in the order first seen."""
    names = text.identifiers(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.encode(F.array_join(names, " "), "utf-8")).alias("names"))


_ENDS = "CASE p_size % 6 WHEN 0 THEN '.go' WHEN 1 THEN '.ts' WHEN 2 THEN '.py' WHEN 3 THEN '.java' WHEN 4 THEN '.js' ELSE '.txt' END"


@query(f"SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'go' WHEN 1 THEN 'javascript' WHEN 2 THEN 'python' WHEN 3 THEN 'java' WHEN 4 THEN 'javascript' ELSE 'unknown' END AS language, 'src/' || p_name || {_ENDS} AS path, '/repo/src/' || p_name || {_ENDS} || ':' || p_size || CASE WHEN p_size > 20 THEN ':' || p_partkey ELSE '' END AS location FROM part")
def paths_and_languages(spark, sf_dir):
    """F-9, F-18, F-19."""
    p = table(spark, sf_dir, "part").withColumn("location", F.concat(F.lit("/repo/src/"), "p_name", F.expr(_ENDS), F.lit(":"), C("p_size").cast("string"), F.when(C("p_size") > 20, F.concat(F.lit(":"), C("p_partkey").cast("string"))).otherwise("")))
    path = text.relative_path(text.strip_position(C("location")), "/repo/")
    return p.select("p_partkey", text.language_of(path).alias("language"), path.alias("path"), "location")


@query("""
    WITH w AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS w FROM part), s AS (SELECT *, array_to_string(list_transform(w, lambda x, i: CASE WHEN i = 1 THEN lower(x) ELSE upper(x[1]) || lower(x[2:]) END), '') AS slug FROM w)
    SELECT p_partkey, slug, lower(p_name) AS words, CASE WHEN length(p_name) > 10 THEN left(p_name, 10) || '…' ELSE p_name END AS short, regexp_full_match(slug, '[A-Za-z_][A-Za-z0-9_]*') AS valid, slug IN ('len', 'cap', 'true') AS builtin, '.' || lower(w[1]) AS ext FROM s
""")
def names(spark, sf_dir):
    """F-11, F-12, F-14, F-18."""
    p = table(spark, sf_dir, "part").withColumn("slug", text.camel_slug(C("p_name")))
    first = F.concat(F.lit(".."), F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))))
    return p.select("p_partkey", "slug", text.camel_words(C("slug")).alias("words"), text.ellipsis(C("p_name"), 10).alias("short"), text.is_identifier(C("slug")).alias("valid"), text.is_builtin(C("slug")).alias("builtin"), text.extension(first).alias("ext"))


@query("""
    SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' WHEN 2 THEN 'openai' ELSE 'local' END AS provider, round(c_custkey / 1e6 * 3.0 + c_nationkey / 1e6 * 15.0, 12) AS usd,
           CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'error' ELSE 'warning' END AS severity FROM customer
""")
def providers_and_costs(spark, sf_dir):
    """F-13, F-13b, F-15."""
    model = F.concat(F.when(C("c_nationkey") % 4 == 0, "Claude-").when(C("c_nationkey") % 4 == 1, "gpt-").when(C("c_nationkey") % 4 == 2, "o3-").otherwise("my-gpt-"), C("c_custkey").cast("string"))
    category = F.when(C("c_mktsegment") == "BUILDING", "sec").when(C("c_mktsegment") == "MACHINERY", "api").otherwise("style")
    usd = kernels.cost_usd(C("c_custkey"), C("c_nationkey"), F.lit(3.0), F.lit(15.0))
    return table(spark, sf_dir, "customer").select("c_custkey", text.provider_of(model).alias("provider"), F.round(usd, 12).alias("usd"), text.default_severity(category).alias("severity"))


@query("SELECT conv_id, turn, md5(nullif(coalesce(text, ''), '')) AS inner_hash FROM conversations")
def marked_blocks(spark, sf_dir):
    """F-16: what stands between two markers."""
    raw = F.concat(F.lit("said <<[A.B "), F.lit("BEGIN*"), F.coalesce("text", F.lit("")), F.lit("END*"), F.lit(" and END* more"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.encode(text.marked_json(raw, "BEGIN*", "END*"), "utf-8")).alias("inner_hash"))


@query("""
    SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN CASE WHEN split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2) THEN 'other' ELSE 'rename' END WHEN 1 THEN 'callers' WHEN 2 THEN 'infeasible' WHEN 3 THEN 'negative constraint' ELSE 'other' END AS kind,
           CASE p_size % 5 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN split_part(p_name, ' ', 2) END AS name, CASE WHEN p_size % 5 = 0 THEN split_part(p_name, ' ', 2) END AS new_name FROM part
""")
def triaged(spark, sf_dir):
    """F-17."""
    one, two = (F.split_part("p_name", F.lit(" "), F.lit(k)) for k in (1, 2))
    spec = F.when(C("p_size") % 5 == 0, F.concat(F.lit("please rename the thing "), one, F.lit(" to "), two)).when(C("p_size") % 5 == 1, F.concat(F.lit("List callers of "), two))
    spec = spec.when(C("p_size") % 5 == 2, F.lit("this is infeasible")).when(C("p_size") % 5 == 3, F.lit("do not touch it")).otherwise("tidy up")
    return table(spark, sf_dir, "part").select("p_partkey", text.triage(spec).alias("t")).select("p_partkey", "t.*")


@query("""
    SELECT p_partkey, p_size > 20 AS gt, p_size >= 20 AS gte, p_size < 20 AS lt, p_size <= 20 AS lte, p_size = 20 AS eq, p_size <> 20 AS ne, contains(p_name, 'red') AS has, regexp_matches(p_name, '^[a-m]') AS fits, p_size > 20 AND contains(p_name, 'a') AS both FROM part
""")
def conditions(spark, sf_dir):
    """P-5, P-5b, P-5c."""
    size, name = C("p_size"), C("p_name")
    one = [text.compare(op, size, 20).alias(op) for op in ("gt", "gte", "lt", "lte", "eq", "ne")]
    both = text.all_conditions([text.compare("gt", size, 20), text.compare("contains", name, "a")])
    return table(spark, sf_dir, "part").select("p_partkey", *one, text.compare("contains", name, "red").alias("has"), text.compare("regex", name, "^[a-m]").alias("fits"), both.alias("both"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events")
def carried_headers(spark, sf_dir):
    """W-2b."""
    header = F.when(C("event_type") == "purchase", C("event_id"))
    return table(spark, sf_dir, "events").select("event_id", kernels.carried(None, ["user_id"], ["ts", "event_id"], header).alias("last_purchase"))


@query("""
    SELECT p_partkey, CAST(least(CASE WHEN 3 * p_size > 100 THEN 10 WHEN 3 * p_size > 75 THEN 8 WHEN 3 * p_size > 50 THEN 6 WHEN 3 * p_size > 30 THEN 4 WHEN 3 * p_size >= 20 THEN 2 ELSE 0 END + CASE WHEN p_partkey % 20 > 15 THEN 3 WHEN p_partkey % 20 > 10 THEN 2 WHEN p_partkey % 20 > 5 THEN 1 ELSE 0 END, 10) AS INTEGER) AS priority FROM part
""")
def extraction_priorities(spark, sf_dir):
    """AG-1b."""
    return table(spark, sf_dir, "part").select("p_partkey", rules.extraction_priority(3 * C("p_size"), C("p_partkey") % 20).cast("int").alias("priority"))


@query("""
    WITH b AS (SELECT l_orderkey, count(*) AS n, sum(l_linenumber) AS complexity, list_sort(list_distinct(list(l_returnflag))) AS reads, list_sort(list_distinct(list(l_returnflag) FILTER (l_linenumber > 2))) AS writes FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, array_to_string(list_filter(reads, lambda x: NOT list_contains(coalesce(writes, []), x)), ',') AS parameters FROM b WHERE complexity BETWEEN 1 AND 10 AND n BETWEEN 3 AND 50
""")
def extractable_blocks(spark, sf_dir):
    """P-4."""
    b = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_stmts"), F.sum("l_linenumber").alias("complexity"), F.array_sort(F.collect_set("l_returnflag")).alias("reads"), F.collect_set(F.when(C("l_linenumber") > 2, C("l_returnflag"))).alias("writes"))
    return code.extractable(b).select("l_orderkey", F.array_join("parameters", ",").alias("parameters"))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS succeeded, count(*) FILTER (o_orderstatus <> 'F') AS failed, count(*) FILTER (o_orderpriority = '5-LOW') AS fallbacks, CAST(sum(o_custkey) AS BIGINT) AS changes FROM orders")
def plan_totals(spark, sf_dir):
    """AG-17."""
    o = table(spark, sf_dir, "orders").select((C("o_orderstatus") == "F").alias("success"), (C("o_orderpriority") == "5-LOW").alias("fallback"), C("o_custkey").alias("changes"))
    return code.plan_statistics(o)


@query("SELECT DISTINCT p_type AS key FROM part ORDER BY key LIMIT 30")
def key_suggestions(spark, sf_dir):
    """P-7b: the first 30 keys (the report's length)."""
    return code.suggestions(table(spark, sf_dir, "part").select(C("p_type").alias("key")))


@query("""
    WITH t AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 10 ELSE 0 END + CASE WHEN c_nationkey = 3 THEN 10 ELSE 0 END + CASE WHEN regexp_matches(c_name, '7$') THEN 5 ELSE 0 END + CASE WHEN contains(c_name, '42') THEN 3 ELSE 0 END AS score FROM customer)
    SELECT c_custkey, CAST(score AS INTEGER) AS score FROM t WHERE score > 0
""")
def target_scores(spark, sf_dir):
    """T-4b."""
    c = table(spark, sf_dir, "customer").select("c_custkey", C("c_mktsegment").alias("name"), C("c_nationkey").cast("string").alias("kind"), C("c_name").alias("text"))
    return c.select("c_custkey", code.target_score("BUILDING", "3", "7$", "42").cast("int").alias("score")).filter("score > 0")


@query("""
    WITH r AS (SELECT * FROM (VALUES ('STANDARD', 1.5, 2.0), ('SMALL', 3.0, 1.0), ('ECON', 9.0, 4.0)) v(prefix, a, b)),
    c AS (SELECT p_type, p_brand, p_size > 20 AS pass, CAST(p_size AS BIGINT) AS i, CAST(p_partkey AS BIGINT) AS o, p_size / 1e6 * a + p_partkey / 1e6 * b AS usd FROM part LEFT JOIN r ON starts_with(p_type, prefix))
    SELECT p_type AS model, p_brand AS mode, count(*) AS n, count(*) FILTER (pass) AS passed, CAST(sum(i) AS BIGINT) AS prompt_tok, CAST(sum(o) AS BIGINT) AS compl_tok, round(CASE WHEN count(usd) = count(*) THEN sum(usd) END, 9) AS usd, CAST(sum(o) // count(*) AS BIGINT) AS avg_ms, round(count(*) FILTER (pass) / count(*), 9) AS pass_rate FROM c GROUP BY 1, 2
""")
def sweep_costs(spark, sf_dir):
    """AG-13, J-11, F-13b."""
    cells = table(spark, sf_dir, "part").select(C("p_type").alias("model"), C("p_brand").alias("mode"), (C("p_size") > 20).alias("pass"), C("p_size").cast("long").alias("prompt_tok"), C("p_partkey").alias("compl_tok"), C("p_partkey").alias("wall_ms"))
    prices = spark.createDataFrame([("STANDARD", (1.5, 2.0)), ("SMALL", (3.0, 1.0)), ("ECON", (9.0, 4.0))], "prefix string, rate struct<in_per_1m:double,out_per_1m:double>")
    return code.sweep(cells, prices).select("model", "mode", "n", "passed", "prompt_tok", "compl_tok", F.round("usd", 9).alias("usd"), "avg_ms", F.round("pass_rate", 9).alias("pass_rate"))


@query("SELECT 'a' AS src, r_name AS name, CAST(NULL AS BIGINT) AS extra FROM region UNION ALL SELECT 'b', n_name, CAST(n_nationkey AS BIGINT) FROM nation")
def unioned(spark, sf_dir):
    """SO-1, SO-2: absent columns are null."""
    a = table(spark, sf_dir, "region").select(F.lit("a").alias("src"), C("r_name").alias("name"))
    b = table(spark, sf_dir, "nation").select(F.lit("b").alias("src"), C("n_name").alias("name"), C("n_nationkey").cast("long").alias("extra"))
    return kernels.union_all([a, b])


@query("SELECT p_partkey, CASE WHEN p_size >= 25 THEN 'high' WHEN p_size >= 8 THEN 'medium' ELSE 'low' END AS level FROM part")
def blast_levels(spark, sf_dir):
    """F-10."""
    from tessera.operators import graph

    return table(spark, sf_dir, "part").select("p_partkey", graph.blast_level(C("p_size")).alias("level"))


@query("SELECT severity, n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM orders GROUP BY 1)")
def severities_counted(spark, sf_dir):
    """AG-9c."""
    return findings.severity_counts(_findings(spark, sf_dir))
