"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import findings, graph, kernels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
    WITH e AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
         b AS (SELECT event_type, count(*) // 3 AS allowed FROM events GROUP BY event_type)
    SELECT event_id, event_type, n, allowed FROM e JOIN b USING (event_type) WHERE n > allowed
""")
def baseline_ratchet(spark, sf_dir):
    """The n-th row of a type is new if n exceeds the type's baseline count."""
    e = kernels.numbered(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), ["event_type"], ["ts", "event_id"])
    count = e.groupBy("event_type").agg(F.floor(F.count("*") / 3).cast("long").alias("count"))
    new = kernels.ratchet(e, count, "event_type", ["ts", "event_id"]).join(count, "event_type")
    return new.select("event_id", "event_type", F.col("n").cast("long").alias("n"), F.col("count").alias("allowed"))


K = kernels


@query("""
    WITH n AS (SELECT event_type, count(*) AS c FROM events WHERE event_id % 3 <> 0 GROUP BY event_type),
         o AS (SELECT event_type, count(*) AS c FROM events WHERE event_id % 2 = 0 GROUP BY event_type)
    SELECT event_type, greatest(coalesce(n.c, 0) - coalesce(o.c, 0), 0) AS n_new, greatest(coalesce(o.c, 0) - coalesce(n.c, 0), 0) AS n_fixed
    FROM n FULL JOIN o USING (event_type)
""")
def new_fixed_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = K.baseline_of(e.filter("event_id % 3 <> 0"), "event_type").withColumn("key", F.col("event_type"))
    old = K.baseline_of(e.filter("event_id % 2 = 0"), "event_type").withColumn("key", F.col("event_type"))
    return K.new_and_fixed(now, old, "event_type", "key")


@query("""
    WITH n AS (SELECT event_type || ':' || (user_id % 7) AS fp, count(*) AS count FROM events WHERE event_id % 3 <> 0 GROUP BY 1),
         o AS (SELECT event_type || ':' || (user_id % 7) AS fp, count(*) AS before FROM events WHERE event_id % 2 = 0 AND user_id % 7 <> 3 GROUP BY 1)
    SELECT fp, count, before FROM n LEFT JOIN o USING (fp) WHERE before IS NULL OR count > before
""")
def baseline_growth(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("fp", F.concat_ws(":", "event_type", (F.col("user_id") % 7).cast("string")))
    old = K.baseline_of(e.filter("event_id % 2 = 0 AND user_id % 7 <> 3"), "fp")
    return K.baseline_growth(K.baseline_of(e.filter("event_id % 3 <> 0"), "fp"), old, "fp")


@query("""
    WITH a AS (SELECT o_orderkey, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0),
         b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 5 <> 0)
    SELECT * FROM (SELECT o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.v IS DISTINCT FROM b.v THEN 'changed' END AS change, a.v AS old_value, b.v AS new_value
    FROM a FULL JOIN b USING (o_orderkey)) WHERE change IS NOT NULL
""")
def snapshot_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("v"))
    new = o.filter("o_orderkey % 5 <> 0").withColumn("v", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("v")))
    return K.keyed_diff(o.filter("o_orderkey % 3 <> 0"), new, "o_orderkey", "v")


@query("""
    WITH n AS (SELECT l_suppkey, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY l_suppkey),
         o AS (SELECT l_suppkey, sum(CAST(l_quantity AS BIGINT)) AS before FROM lineitem WHERE l_orderkey % 2 = 0 AND l_suppkey % 5 <> 0 GROUP BY l_suppkey)
    SELECT l_suppkey, CAST(q AS BIGINT) AS q, CAST(before AS BIGINT) AS before, CAST(q - coalesce(before, 0) AS BIGINT) AS growth FROM n LEFT JOIN o USING (l_suppkey) WHERE q - coalesce(before, 0) >= 20
""")
def growth_review(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    q = F.sum(F.col("l_quantity").cast("long")).alias("q")
    old = li.filter("l_orderkey % 2 = 0 AND l_suppkey % 5 <> 0").groupBy("l_suppkey").agg(q)
    return K.growth(old, li.filter("l_orderkey % 2 = 1").groupBy("l_suppkey").agg(q), ["l_suppkey"], "q", 20)


_DIVISION = """
    WITH have AS (SELECT DISTINCT o_custkey, o_orderpriority AS member FROM orders),
         need AS (SELECT DISTINCT o_orderstatus AS grp, o_orderpriority AS member FROM orders),
         met AS (SELECT o_custkey, grp, count(*) AS n_have, list(member) AS have FROM have JOIN need USING (member) GROUP BY ALL),
         size AS (SELECT grp, count(*) AS needed, list(member) AS everything FROM need GROUP BY grp)
"""


def _divided(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("member"), F.col("o_orderstatus").alias("grp"))
    return K.division(o, o, "o_custkey", "grp", "member")


@query(_DIVISION + "SELECT o_custkey, grp, n_have, needed FROM met JOIN size USING (grp) WHERE n_have = needed")
def relational_division(spark, sf_dir):
    return _divided(spark, sf_dir).filter("complete").select("o_custkey", "grp", "n_have", "needed")


@query(_DIVISION + "SELECT o_custkey, grp, n_have, needed, array_to_string(list_sort(list_filter(everything, lambda x: NOT list_contains(have, x))), ',') AS missing FROM met JOIN size USING (grp) WHERE n_have < needed")
def partial_division(spark, sf_dir):
    return _divided(spark, sf_dir).filter("NOT complete").select("o_custkey", "grp", "n_have", "needed", F.array_join("missing", ",").alias("missing"))


@query("""
    WITH m AS (SELECT DISTINCT p_brand AS brand, p_name AS name FROM part), need AS (SELECT DISTINCT p_type || '/' || p_size AS grp, p_name AS name FROM part),
         size AS (SELECT grp, count(*) AS needed FROM need GROUP BY grp), met AS (SELECT brand, grp, count(*) AS n FROM m JOIN need USING (name) GROUP BY brand, grp)
    SELECT grp, min(brand) AS brand FROM met JOIN size USING (grp) WHERE n = needed GROUP BY grp HAVING count(*) = 1
""")
def sole_implementation(spark, sf_dir):
    """Sizes of a type all of whose names one brand alone offers."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.concat_ws("/", "p_type", F.col("p_size").cast("string")).alias("grp"))
    return K.sole_implementations(K.division(p, p, "brand", "grp", "name"), "grp", "brand")


@query("""
    SELECT md5(norm) AS hash, count(*) AS n, CAST(min(doc_id) AS BIGINT) AS first_id, array_to_string(list_sort(list(doc_id)), ',') AS ids
    FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[0-9]+', '#', 'g') AS norm FROM documents) GROUP BY norm HAVING count(*) >= 2
""")
def dup_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    found = K.duplicates(d, F.md5(F.encode(text.collapse_digits(F.coalesce("text", F.lit(""))), "utf-8")), ["doc_id"])
    ids = F.transform("locations", lambda x: x["doc_id"].cast("string"))
    return found.select("hash", "n", F.col("locations")[0]["doc_id"].alias("first_id"), F.array_join(ids, ",").alias("ids"))


@query("""
    WITH g AS (SELECT md5(text) AS hash, count(*) AS n, any_value(len(string_split(text, chr(10)))) AS lines, any_value(len(string_split(text, '. '))) AS sentences FROM documents GROUP BY text HAVING count(*) >= 2)
    SELECT hash, n, least(1000, (n - 1) * lines * (1 + sentences)) AS impact, (n - 1) * lines AS saved FROM g
""")
def dup_impact(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    d = d.select("text", F.size(F.split("text", "\n", -1)).alias("lines"), F.size(F.split("text", r"\. ", -1)).alias("sentences"))
    g = K.duplicates(d, F.md5(F.encode("text", "utf-8")), ["lines", "sentences"]).withColumn("one", F.col("locations")[0])
    return g.select("hash", "n", K.impact(F.col("n"), F.col("one.lines"), F.col("one.sentences")).cast("long").alias("impact"), K.savings(F.col("n"), F.col("one.lines")).cast("long").alias("saved"))


@query("""
    WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS token FROM documents),
         f AS (SELECT token, count(*) AS n, min(doc_id) AS doc_id FROM t GROUP BY token)
    SELECT token, doc_id FROM f WHERE n = 1
""")
def token_freq_dead(spark, sf_dir):
    tokens = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))
    by_doc = K.token_counts(table(spark, sf_dir, "documents"), tokens, "doc_id")
    return by_doc.groupBy("token").agg(F.sum("n").alias("n"), F.min("doc_id").alias("doc_id")).filter("n = 1").select("token", "doc_id")


@query("""
    WITH t AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS token, coalesce(toxic, 0) = 1 AS inside FROM documents JOIN labels USING (doc_id))
    SELECT token, count(*) FILTER (inside) AS n_in, count(*) FILTER (NOT inside) AS n_out FROM t GROUP BY token HAVING count(*) FILTER (inside) > 0 AND count(*) FILTER (NOT inside) = 0
""")
def split_only_live(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return K.only_in(d, F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)), F.coalesce("toxic", F.lit(0)) == 1)


@query("""
    WITH c AS (SELECT event_id, user_id, event_type, trim(lower(regexp_replace(props, '[0-9]+', '#', 'g')), ' ') || ' of ' || (user_id % 10) AS reason FROM events),
         f AS (SELECT event_type, reason, user_id, count(*) AS n, min(event_id) AS pos FROM c GROUP BY ALL)
    SELECT event_type, reason, CAST(sum(n) AS BIGINT) AS n, min(pos) AS first_at, array_to_string(list(user_id ORDER BY pos, user_id), ',') AS specs FROM f GROUP BY event_type, reason HAVING sum(n) >= 2
""")
def name_clusters(spark, sf_dir):
    """AG-11, over whole reasons."""
    reason = F.concat(text.plain_reason(F.col("props")), F.lit(" of "), (F.col("user_id") % 10).cast("string"))
    found = K.clusters(table(spark, sf_dir, "events"), ["event_type"], reason, "user_id", "event_id", least=2)
    return found.withColumn("specs", F.array_join(F.col("specs").cast("array<string>"), ","))


@query("""
    WITH c AS (SELECT event_type, props, count(*) AS c FROM events GROUP BY ALL)
    SELECT event_type, CAST(sum(c) AS BIGINT) AS n, first(props ORDER BY c DESC, props) AS top, first(c ORDER BY c DESC, props) AS top_n FROM c GROUP BY event_type
""")
def top_reason(spark, sf_dir):
    return K.most_common(table(spark, sf_dir, "events"), ["event_type"], "props")


@query("SELECT user_id, last(event_type ORDER BY ts, event_id) AS event_type FROM events GROUP BY user_id")
def latest_outcome(spark, sf_dir):
    return K.latest(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["ts", "event_id"])


@query("""
    SELECT event_id, user_id FROM (SELECT event_id, user_id, event_type, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE event_type = 'view' AND b = 'click' AND c IS NOT NULL
""")
def sequence3(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return K.sequences(e, ["user_id"], ["ts", "event_id"], "event_type", ["view", "click", None]).select("event_id", "user_id")


@query("""
    WITH s AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
         r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM s)
    SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS n, min(ts) AS first, max(ts) AS last FROM r GROUP BY user_id, run
""")
def islands(spark, sf_dir):
    return K.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("""
    WITH l AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem),
         g AS (SELECT *, sum(cents) OVER (PARTITION BY l_orderkey) - coalesce(sum(cents) OVER (PARTITION BY l_orderkey ORDER BY cents DESC, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_before FROM l)
    SELECT l_orderkey, l_linenumber, cents, CAST(left_before AS BIGINT) AS left_before FROM g WHERE left_before > 5000000
""")
def greedy_prefix(spark, sf_dir):
    cents = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    return K.greedy_prefix(cents, ["l_orderkey"], "cents", 5_000_000, [F.desc("cents"), "l_linenumber"])


@query("""
    SELECT * FROM (SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations) WHERE used <= 600
""")
def budget_trim(spark, sf_dir):
    return K.budget_trim(table(spark, sf_dir, "conversations"), ["conv_id"], F.length("text"), 600, ["turn"]).select("conv_id", "turn", "used")


@query("""
    SELECT conv_id, turn, array_to_string(list(md5(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), '|') AS context FROM conversations
""")
def context_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("h", F.md5(F.encode("text", "utf-8")))
    return K.context(c, ["conv_id"], "turn", "h", 1).select("conv_id", "turn", F.array_join("context", "|").alias("context"))


@query("""
    WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem),
         b AS (SELECT 'p' || src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT 's' || dst, 0, 1 FROM e)
    SELECT node, CAST(sum(o) AS BIGINT) AS fan_out, CAST(sum(i) AS BIGINT) AS fan_in FROM b GROUP BY node HAVING sum(o) > 10 OR sum(i) > 8
""")
def fan_in_out(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    return K.degrees(e, "src", "dst").filter("fan_out > 10 OR fan_in > 8")


# Parts make a graph of names: brand to type, and on to the words of a name; what users do one after another
# gives a graph with cycles.
_EDGES = """edges AS (
    SELECT DISTINCT p_brand AS src, p_type AS dst FROM part UNION SELECT p_type, split_part(p_name, ' ', 1) FROM part UNION SELECT split_part(p_name, ' ', 1), split_part(p_name, ' ', 2) FROM part
    UNION SELECT a, b FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL)"""
_REACH = f"WITH RECURSIVE {_EDGES}, reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src)"


def _names(spark, sf_dir):
    word = lambda k: F.split_part("p_name", F.lit(" "), F.lit(k))
    steps = [F.col("p_brand"), F.col("p_type"), word(1), word(2)]
    pairs = F.explode(F.array(*(F.struct(a.alias("src"), b.alias("dst")) for a, b in zip(steps, steps[1:], strict=False))))
    return table(spark, sf_dir, "part").select(pairs.alias("e")).select("e.*").distinct()


def _edges(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _names(spark, sf_dir).union(e.select(F.col("event_type").alias("src"), after.alias("dst")).filter("dst IS NOT NULL")).distinct()


@query(_REACH + " SELECT src, dst FROM reach")
def closure(spark, sf_dir):
    return graph.reachable(spark, _edges(spark, sf_dir)).select("src", "dst")


@query(_REACH + " SELECT DISTINCT dst FROM reach WHERE src IN ('PROMO', 'click')")
def affected(spark, sf_dir):
    seeds = spark.createDataFrame([("PROMO",), ("click",)], "src string")
    return graph.reachable(spark, _edges(spark, sf_dir), seeds).select("dst").distinct()


@query(f"""
    WITH {_EDGES}, r AS (SELECT DISTINCT src AS root FROM edges),
    p1 AS (SELECT root, dst AS a, dst = root AS cyc FROM r JOIN edges ON src = root),
    p2 AS (SELECT root, a, dst AS b, dst = root OR dst = a AS cyc FROM p1 JOIN edges ON src = a WHERE NOT cyc)
    SELECT root, CAST(root AS VARCHAR) AS path, 0 AS depth, FALSE AS is_cycle FROM r
    UNION ALL SELECT root, root || '>' || a, 1, cyc FROM p1
    UNION ALL SELECT root, root || '>' || a || '>' || b, 2, cyc FROM p2
""")
def bounded_paths(spark, sf_dir):
    e = _edges(spark, sf_dir)
    found = graph.path_tree(e, e.select(F.col("src").alias("root")).distinct(), 2)
    return found.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query(_REACH + """,
    n AS (SELECT DISTINCT x AS node, x[1:2] AS file, x[1] AS package, length(x) % 3 = 0 AS exported FROM (SELECT src AS x FROM edges UNION SELECT dst FROM edges)),
    s AS (SELECT r.dst AS node, count(*) AS reach, count(DISTINCT c.file) AS files, count(DISTINCT c.package) AS packages FROM (SELECT DISTINCT src, dst FROM reach WHERE src <> dst) r JOIN n c ON c.node = r.src GROUP BY r.dst),
    b AS (SELECT node, reach, files, packages, exported, 2 * reach + files + packages + CASE WHEN exported THEN 5 ELSE 0 END AS score FROM s JOIN n USING (node))
    SELECT node, reach, files, packages, exported, score, CASE WHEN score >= 25 THEN 'high' WHEN score >= 8 THEN 'medium' ELSE 'low' END AS level FROM b ORDER BY score DESC, file_order(node) LIMIT 10
""".replace("file_order(node)", "node"))
def blast_score(spark, sf_dir):
    e = _edges(spark, sf_dir)
    x = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    nodes = x.select("node", F.left("node", F.lit(2)).alias("file"), F.left("node", F.lit(1)).alias("package"), (F.length("node") % 3 == 0).alias("exported"))
    found = graph.blast_radius(graph.reachable(spark, e), nodes)
    return K.top(found, [F.desc("score"), "node"], 10).select("node", "reach", "files", "packages", "exported", "score", "level")


@query(_REACH + " SELECT DISTINCT src AS node FROM reach WHERE src = dst")
def cycles(spark, sf_dir):
    return graph.cycle_nodes(graph.reachable(spark, _edges(spark, sf_dir)))


@query("""
    SELECT DISTINCT p_brand AS node, 3 AS length FROM part UNION SELECT p_type, 2 FROM part UNION SELECT split_part(p_name, ' ', 1), 1 FROM part
""")
def longest_chain(spark, sf_dir):
    """GR-6 over the graph of names, which has levels."""
    return graph.longest_chain(spark, _names(spark, sf_dir))


@query("""
    WITH r AS (SELECT * FROM (VALUES ('STANDARD', 1.5), ('STANDARD ANODIZED', 2.5), ('SMALL', 3.0), ('ECONOMY', 0.5), ('ECON', 9.0), ('PROMO B', 4.0)) v(prefix, rate)),
         b AS (SELECT p_partkey, p_type, prefix, CAST(rate AS DOUBLE) AS rate, row_number() OVER (PARTITION BY p_partkey ORDER BY length(prefix) DESC) AS k FROM part LEFT JOIN r ON starts_with(p_type, prefix))
    SELECT p_partkey, p_type, prefix, rate FROM b WHERE k = 1
""")
def prefix_price(spark, sf_dir):
    rates = spark.createDataFrame([("STANDARD", 1.5), ("STANDARD ANODIZED", 2.5), ("SMALL", 3.0), ("ECONOMY", 0.5), ("ECON", 9.0), ("PROMO B", 4.0)], "prefix string, rate double")
    return K.longest_prefix(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", rates, "prefix", "rate").select("p_partkey", "p_type", "prefix", "rate")


@query("""
    WITH o AS (SELECT o_orderpriority, o_orderstatus, o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' AS ok, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
         g AS (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (ok) AS n_passed, CAST(sum(cents) AS BIGINT) AS cost FROM o GROUP BY o_orderpriority)
    SELECT o_orderpriority, n, n_passed, round(n_passed / n, 9) AS pass_rate, cost, round(CASE WHEN n_passed > 0 THEN cost / (n_passed / n) END, 3) AS cost_of_pass, CAST(cost // n AS BIGINT) AS avg_wall FROM g
""")
def cost_of_pass(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("ok", F.expr("o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'")).withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return K.roll_up(o, ["o_orderpriority"], "ok", "cents", "cents").withColumns({"pass_rate": F.round("pass_rate", 9), "cost_of_pass": F.round("cost_of_pass", 3)})


@query("""
    WITH f AS (SELECT CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS severity, CASE user_id % 4 WHEN 0 THEN 'complexity' WHEN 1 THEN 'untested-package' WHEN 2 THEN 'test-only-live' ELSE 'dead-code' END AS rule, event_id % 50 AS value FROM events),
         s AS (SELECT *, CASE severity WHEN 'error' THEN 3.0 WHEN 'warning' THEN 1.0 ELSE 0.25 END AS base FROM f),
         w AS (SELECT sum(CAST(CASE rule WHEN 'complexity' THEN base * greatest(0.15, least(1.0, (value - 10) / 10)) / greatest(1.0, 2500 / 1000) WHEN 'untested-package' THEN 1.0 WHEN 'test-only-live' THEN 0.0 ELSE base END AS DOUBLE)) AS w FROM s)
    SELECT CAST(round(100 / (1 + w / 50), 6) AS DOUBLE) AS score FROM w
""")
def health_score(spark, sf_dir):
    """AG-9 over findings made of events; 2,500 functions."""
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warning").otherwise("info")
    rule = F.when(F.col("user_id") % 4 == 0, "complexity").when(F.col("user_id") % 4 == 1, "untested-package").when(F.col("user_id") % 4 == 2, "test-only-live").otherwise("dead-code")
    e = table(spark, sf_dir, "events").select(severity.alias("severity"), rule.alias("rule"), (F.col("event_id") % 50).alias("value"), F.lit(10).cast("bigint").alias("threshold"))
    return findings.health(e, 2500)


@query("""
    WITH s AS (SELECT p_partkey, p_brand, CASE WHEN p_type LIKE '%TIN%' THEN 10 ELSE 0 END + CASE WHEN p_size > 40 THEN 5 ELSE 0 END + CASE WHEN contains(p_name, 'a') THEN 3 ELSE 0 END AS score FROM part),
         r AS (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY score DESC) AS r FROM s WHERE score > 0)
    SELECT p_partkey, p_brand, score, count(*) OVER (PARTITION BY p_brand) > 1 AS ambiguous FROM r WHERE r = 1
""")
def scored_target(spark, sf_dir):
    score = F.expr("CASE WHEN p_type LIKE '%TIN%' THEN 10 ELSE 0 END + CASE WHEN p_size > 40 THEN 5 ELSE 0 END + CASE WHEN contains(p_name, 'a') THEN 3 ELSE 0 END")
    return K.best_targets(table(spark, sf_dir, "part"), ["p_brand"], score, "p_partkey").select("p_partkey", "p_brand", "score", "ambiguous")


@query("""
    WITH g AS (SELECT l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey)
    SELECT l_suppkey, qty, n, parts, array_to_string(list_filter([CASE WHEN n > 550 THEN 'rows' END, CASE WHEN parts > 480 THEN 'parts' END], lambda x: x IS NOT NULL), ',') AS reasons FROM g WHERE qty > 10000 AND (n > 550 OR parts > 480)
""")
def god_group(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("qty"), F.count("*").alias("n"), F.countDistinct("l_partkey").alias("parts"))
    reasons = F.filter(F.array(F.when(F.col("n") > 550, "rows"), F.when(F.col("parts") > 480, "parts")), lambda x: x.isNotNull())
    return g.filter("qty > 10000 AND (n > 550 OR parts > 480)").withColumn("reasons", F.array_join(reasons, ","))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')")
def anti_untested(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def semi_importers(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000")
    return table(spark, sf_dir, "customer").join(s, F.col("c_nationkey") == F.col("s_nationkey"), "left_semi").select("c_custkey")


@query("""
    WITH t AS (SELECT o_orderkey, coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 'error' WHEN '5-LOW' THEN 'off' END, CASE o_orderstatus WHEN 'F' THEN 'warning' ELSE 'info' END) AS severity FROM orders)
    SELECT o_orderkey, severity, severity IN ('warning', 'error') AS fails FROM t WHERE severity <> 'off'
""")
def tier_override(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("rule"), F.when(F.col("o_orderstatus") == "F", "warning").otherwise("info").alias("severity"))
    return findings.gate(findings.override(o, {"1-URGENT": "error", "5-LOW": "off"}), "warning").select("o_orderkey", "severity", "fails")


@query("""
    WITH w AS (SELECT * FROM (VALUES ('steal'), ('STANDARD'), ('smal'), ('economi'), ('zzzzzz')) v(wanted)), n AS (SELECT DISTINCT string_split(p_type, ' ')[1] AS name FROM part),
         d AS (SELECT wanted, name, levenshtein(lower(wanted), lower(name)) AS d FROM w, n)
    SELECT wanted, first(name ORDER BY d, name) AS suggestion FROM d WHERE d <= greatest(2, length(wanted) // 3) GROUP BY wanted
""")
def closest_name(spark, sf_dir):
    wanted = spark.createDataFrame([("steal",), ("STANDARD",), ("smal",), ("economi",), ("zzzzzz",)], "wanted string")
    names = table(spark, sf_dir, "part").select(F.element_at(F.split("p_type", " "), 1).alias("name"))
    return K.closest(wanted, "wanted", names, "name")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first_wins(spark, sf_dir):
    return K.first_of_each(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT event_type, user_id % 5 AS k FROM events EXCEPT ALL SELECT event_type, user_id % 5 FROM events WHERE event_id % 4 <> 0")
def multiset_difference(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    shape = lambda x: x.select("event_type", (F.col("user_id") % 5).alias("k"))
    return shape(e).exceptAll(shape(e.filter("event_id % 4 <> 0")))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def changed_union(spark, sf_dir):
    a = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    return a.union(table(spark, sf_dir, "supplier").filter("s_acctbal > 9000").select("s_nationkey")).distinct()


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def unjournaled(spark, sf_dir):
    done = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct().join(done, "k", "left_anti")


@query("SELECT r_name, n_name FROM region, (SELECT n_name FROM nation WHERE n_nationkey < 4)")
def model_mode_grid(spark, sf_dir):
    """SO-7: every region with every one of four nations, a small grid; the four are listed beside each
    region and exploded, so no join is needed."""
    names = table(spark, sf_dir, "nation").filter("n_nationkey < 4").agg(F.array_sort(F.collect_list("n_name")).alias("names")).first().names
    return table(spark, sf_dir, "region").select("r_name", F.explode(F.array(*map(F.lit, names))).alias("n_name"))


@query("""
    WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(replace(p_name, 'green', 'blue'), ' ') AS b FROM part)
    SELECT p_partkey, a <> b AND len(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))) = 1 AND len(list_filter(list_distinct(b), lambda x: NOT list_contains(a, x))) = 1 AS renamed FROM p
""")
def rename_pairs(spark, sf_dir):
    old = F.split("p_name", " ")
    new = F.split(F.replace("p_name", F.lit("green"), F.lit("blue")), " ")
    return table(spark, sf_dir, "part").select("p_partkey", K.rename_pair(old, new)[0].alias("renamed"))


@query("""
    WITH p AS (SELECT p_partkey, replace(p_brand, '#', '/') || '/' || p_type AS path FROM part), o AS (SELECT * FROM (VALUES ('SMALL'), ('11/SMALL'), ('PROMO'), ('MALL')) v(owner)),
         m AS (SELECT p_partkey, path, owner, row_number() OVER (PARTITION BY p_partkey ORDER BY length(owner) DESC) AS k FROM p JOIN o ON path = owner OR ends_with(path, '/' || owner))
    SELECT p_partkey, path, owner FROM m WHERE k = 1
""")
def suffix_coupling(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.replace("p_brand", F.lit("#"), F.lit("/")), F.lit("/"), "p_type").alias("path"))
    owners = spark.createDataFrame([("SMALL",), ("11/SMALL",), ("PROMO",), ("MALL",)], "owner string")
    return K.suffix_owner(p, "path", owners, "owner").select("p_partkey", "path", "owner")


@query("""
    WITH p AS (SELECT p_partkey, replace(p_brand, '#', '/') || '/' || p_type AS path FROM part), o AS (SELECT * FROM (VALUES ('Brand/1'), ('Brand/11'), ('Brand/12/PROMO'), ('Brand/12')) v(owner)),
         m AS (SELECT p_partkey, path, owner, row_number() OVER (PARTITION BY p_partkey ORDER BY length(owner) DESC) AS k FROM p JOIN o ON path = owner OR starts_with(path, owner || '/'))
    SELECT p_partkey, path, owner FROM m WHERE k = 1
""")
def prefix_dependency(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.replace("p_brand", F.lit("#"), F.lit("/")), F.lit("/"), "p_type").alias("path"))
    owners = spark.createDataFrame([("Brand/1",), ("Brand/11",), ("Brand/12/PROMO",), ("Brand/12",)], "owner string")
    return K.prefix_owner(p, "path", owners, "owner").select("p_partkey", "path", "owner")


@query("""
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL AND CAST(json_extract(props, '$.k') AS BIGINT) > 90
""")
def dynamic_field(spark, sf_dir):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).filter("k > 90")


from tessera.plans import scalars, sources  # noqa: E402, F401  (they register their queries here)
