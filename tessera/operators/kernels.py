"""Generic operators over DataFrames, parameterised by column names.

Each is a composition of built-in DataFrame operations; orders are total, so results don't depend on the
order of input rows. Nulls in keys are values of their own unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence, name: str = "n") -> DataFrame:
    """Rows of a key counted from 1 in ``order``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def ratchet(found: DataFrame, baseline: DataFrame, key: str, order: Sequence, count: str = "count") -> DataFrame:
    """W-1, SO-4: rows beyond the baseline's count of their key; a key without baseline is all new.

    Rows that agree on ``order`` are interchangeable."""
    n = numbered(found, [key], order, "_n")
    known = baseline.groupBy(key).agg(F.sum(count).alias("_allowed"))
    return n.join(known, key, "left").filter(F.col("_n") > F.coalesce("_allowed", F.lit(0))).drop("_n", "_allowed")


def baseline_of(found: DataFrame, key: str, severity: str | None = None) -> DataFrame:
    """S-13: the counted multiset of keys, with the least severity of each."""
    extra = [F.min(severity).alias("severity")] if severity else []
    return found.groupBy(key).agg(F.count("*").alias("count"), *extra)


def baseline_growth(now: DataFrame, before: DataFrame, key: str, count: str = "count") -> DataFrame:
    """J-3c: keys that are new or whose count went up."""
    old = before.select(key, F.col(count).alias("before"))
    return now.join(old, key, "left").filter(F.col("before").isNull() | (F.col(count) > F.col("before")))


def new_and_fixed(now: DataFrame, before: DataFrame, by: str, key: str, count: str = "count") -> DataFrame:
    """AG-9c: per ``by``, how many rows are new and how many are gone against the baseline."""
    a = now.groupBy(by, key).agg(F.sum(count).alias("a"))
    b = before.groupBy(by, key).agg(F.sum(count).alias("b"))
    both = a.join(b, [by, key], "full")
    gap = F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))
    return both.groupBy(by).agg(F.sum(F.greatest(gap, F.lit(0))).alias("n_new"), F.sum(F.greatest(-gap, F.lit(0))).alias("n_fixed"))


def keyed_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """J-3: ``key, change, old_value, new_value`` of keys that were added, removed or changed (null-safe)."""
    a = old.select(key, F.col(value).alias("old_value"), F.lit(True).alias("_a"))
    b = new.select(key, F.col(value).alias("new_value"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed")
    return a.join(b, key, "full").withColumn("change", change).filter("change IS NOT NULL").select(key, "change", "old_value", "new_value")


def is_breaking(diff: DataFrame) -> DataFrame:
    """J-3: one row: whether anything was removed or changed."""
    return diff.agg(F.coalesce(F.bool_or(F.col("change") != "added"), F.lit(False)).alias("breaking"))


def growth(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str, least: float) -> DataFrame:
    """J-3b: keys whose value grew by ``least`` or more; a key that wasn't there counts from nothing."""
    before = old.select(*keys, F.col(value).alias("before"))
    gap = F.col(value) - F.coalesce("before", F.lit(0))
    return new.join(before, list(keys), "left").withColumn("growth", gap).filter(F.col("growth") >= least)


def division(have: DataFrame, need: DataFrame, owner: str, group: str, member: str) -> DataFrame:
    """J-4: for each owner and group with a common member: how many of the group's members the owner has,
    which are missing, and whether none is."""
    h = have.select(owner, member).distinct()
    n = need.select(group, member).distinct()
    size = n.groupBy(group).agg(F.count("*").alias("needed"), F.collect_set(member).alias("_all"))
    met = h.join(n, member).groupBy(owner, group).agg(F.count("*").alias("n_have"), F.collect_set(member).alias("_have"))
    missing = F.array_sort(F.array_except("_all", "_have"))
    return met.join(size, group).select(owner, group, "n_have", "needed", missing.alias("missing"), (F.col("n_have") == F.col("needed")).alias("complete"))


def sole_implementations(divided: DataFrame, group: str, owner: str) -> DataFrame:
    """J-4c: groups that exactly one owner completes."""
    return divided.filter("complete").groupBy(group).agg(F.count("*").alias("n"), F.min(owner).alias(owner)).filter("n = 1").drop("n")


def duplicates(df: DataFrame, key: Column, locations: Sequence[str], least: int = 2) -> DataFrame:
    """AG-3: groups of rows of one key with ``least`` rows or more and their sorted locations."""
    return df.groupBy(key.alias("hash")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(*locations))).alias("locations")).filter(F.col("n") >= least)


def impact(n: Column, statements: Column, complexity: Column) -> Column:
    """AG-3b: min(1000, (n - 1) * statements * (1 + complexity))."""
    return F.least(F.lit(1000), (n - 1) * statements * (F.lit(1) + complexity))


def savings(n: Column, statements: Column) -> Column:
    """AG-3c: what a group of copies would save: (n - 1) * statements."""
    return (n - 1) * statements


def duplicate_totals(groups: DataFrame) -> DataFrame:
    """AG-3c: one row over groups (n, statements, kind): groups, savings, and copies of functions and methods."""
    kinds = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"{k}s") for k in ("function", "method")]
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum(savings(F.col("n"), F.col("statements"))), F.lit(0)).alias("savings"), *kinds)


def diagnosed(clusters: DataFrame, cases: Sequence[tuple[str, str]], otherwise: str = "unknown") -> DataFrame:
    """AG-11b: ``diagnosis`` of a cluster's reason by the first pattern that it matches."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(cases):
        out = F.when(F.col("reason").rlike(pattern), name).otherwise(out)
    return clusters.withColumn("diagnosis", F.coalesce(out, F.lit(otherwise)))


def by_size(clusters: DataFrame, keys: Sequence[str], position: str = "first_at") -> DataFrame:
    """T-5: largest first, then by the keys, then as first seen."""
    return clusters.orderBy(F.desc("n"), *keys, position)


def unique_names(df: DataFrame, name: str, order: Sequence) -> DataFrame:
    """W-8: the first row of a name keeps it, the others get 2, 3, ... behind it, in ``order``."""
    n = numbered(df, [name], order, "_n")
    return n.withColumn(name, F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(name, F.col("_n").cast("string")))).drop("_n")


def token_counts(df: DataFrame, tokens: Column, *by: str) -> DataFrame:
    """AG-4: how often each token occurs."""
    return df.select(*by, F.explode(tokens).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("n"))


def only_in(df: DataFrame, tokens: Column, inside: Column) -> DataFrame:
    """AG-4d: tokens with their counts in and outside a subset, where they occur only inside."""
    t = df.select(F.explode(tokens).alias("token"), inside.alias("_in"))
    return t.groupBy("token").agg(F.count_if(F.col("_in")).alias("n_in"), F.count_if(~F.col("_in")).alias("n_out")).filter("n_in > 0 AND n_out = 0")


def clusters(df: DataFrame, keys: Sequence[str], reason: Column, spec: str, position: str, least: int = 1) -> DataFrame:
    """AG-11: rows by keys and normalised reason: count, first position, specs in the order first seen, and
    the reason as first written."""
    shaped = df.withColumn("_reason", reason)
    first = shaped.groupBy(*keys, "_reason", spec).agg(F.min(position).alias("_at"), F.count("*").alias("_n"))
    out = first.groupBy(*keys, "_reason").agg(F.sum("_n").alias("n"), F.min("_at").alias("first_at"), F.array_sort(F.collect_list(F.struct("_at", spec))).alias("_s"))
    return out.filter(F.col("n") >= least).select(*keys, F.col("_reason").alias("reason"), "n", "first_at", F.transform("_s", lambda s: s[spec]).alias("specs"))


def most_common(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """AG-12: each group's rows and its most common value (the smallest of equals)."""
    counted = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    best = F.min_by(F.struct(F.col(value).alias("v"), F.col("_n").alias("c")), F.struct(-F.col("_n"), F.col(value)))
    return counted.groupBy(*by).agg(F.sum("_n").alias("n"), best.alias("_b")).select(*by, "n", F.col("_b.v").alias("top"), F.col("_b.c").alias("top_n"))


def latest(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """AG-14: the value of each key's last row."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def roll_up(df: DataFrame, keys: Sequence[str], passed: str, cost: str, wall: str) -> DataFrame:
    """AG-13: runs, passes, pass rate, total cost, cost of a pass (total over rate; null when nothing
    passed) and the truncated mean time."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(passed)).alias("n_passed"), F.sum(cost).alias("cost"), F.sum(wall).alias("_wall"))
    rate = F.col("n_passed") / F.col("n")
    return out.select(*keys, "n", "n_passed", rate.alias("pass_rate"), "cost", F.try_divide(F.col("cost"), rate).alias("cost_of_pass"), F.floor(F.col("_wall") / F.col("n")).cast("long").alias("avg_wall"))


def longest_prefix(df: DataFrame, text: str, prefixes: DataFrame, prefix: str, value: str) -> DataFrame:
    """J-11: the value of the longest prefix that ``text`` starts with, else null.

    Texts are exploded into their own prefixes and joined by equality, so no pair is tried in vain."""
    texts = df.select(text).distinct()
    own = texts.select(text, F.explode(F.sequence(F.lit(1), F.length(text))).alias("_k")).select(text, F.col(text).substr(F.lit(1), F.col("_k")).alias(prefix))
    best = own.join(prefixes, prefix).groupBy(text).agg(F.max_by(F.struct(prefix, value), F.length(prefix)).alias("_b")).select(text, "_b.*")
    return df.join(best, text, "left")


def best_targets(df: DataFrame, by: Sequence[str], score: Column, identity: str) -> DataFrame:
    """T-4: rows with their group's greatest score above 0, and whether several of them tie."""
    scored = df.withColumn("score", score).filter("score > 0")
    top = scored.withColumn("_r", F.rank().over(Window.partitionBy(*by).orderBy(F.desc("score")))).filter("_r = 1").drop("_r")
    tied = Window.partitionBy(*by)
    return top.withColumn("ambiguous", F.size(F.collect_set(identity).over(tied)) > 1)


def unique_lookup(df: DataFrame, exact: Column, loose: Column) -> DataFrame:
    """P-7: the exact match if there is one, else the loose match if it is the only one, else nothing."""
    tagged = df.withColumn("_e", exact).filter(F.col("_e") | loose)
    n = tagged.agg(F.count_if("_e").alias("exact"), F.count("*").alias("all")).first()  # two numbers
    return tagged.filter(F.col("_e") | F.lit(n.exact == 0 and n.all == 1)).drop("_e")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """W-2: runs of equal consecutive values: ``keys, run, value, n, first, last`` (the order's first column)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    starts = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    runs = df.withColumn("_s", starts).withColumn("run", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], header: Column) -> Column:
    """W-2b: the last header seen up to a row."""
    return F.last(header, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def greedy_prefix(df: DataFrame, keys: Sequence[str], amount: str, threshold: float, order: Sequence) -> DataFrame:
    """W-3: rows in ``order`` taken until what is left of their key's total is ``threshold`` or less."""
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum(amount).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("left_before", F.sum(amount).over(w) - before).filter(F.col("left_before") > threshold)


def budget_trim(df: DataFrame, keys: Sequence[str], size: Column, budget: int, order: Sequence) -> DataFrame:
    """W-4: rows in ``order`` while their sizes together stay within ``budget``."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= budget)


def context(df: DataFrame, keys: Sequence[str], order: str, text: str, around: int) -> DataFrame:
    """W-5: each row with the texts of the rows ``around`` it, in order."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-around, around)
    return df.withColumn("context", F.collect_list(text).over(w))


def sequences(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, pattern: Sequence[str | None]) -> DataFrame:
    """SQ-1 to SQ-3: rows at which a run of consecutive values matches ``pattern``; None matches any value
    (there must be a row)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    here = F.row_number().over(w) + len(pattern) - 1 <= F.count("*").over(Window.partitionBy(*keys))
    for k, want in enumerate(pattern):
        if want is not None:
            here = here & (F.lead(value, k).over(w) == want if k else F.col(value) == want)
    return df.withColumn("_m", here).filter("_m").drop("_m")


def top(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """T-2, T-3: the first ``n`` rows in a total order."""
    return df.orderBy(*order).limit(n)


def closest(df: DataFrame, wanted: str, names: DataFrame, name: str) -> DataFrame:
    """T-6: the name of least case-folded edit distance, if at most max(2, length / 3); the first in
    alphabetical order of equals. ``names`` is the query's own vocabulary, a bounded command set."""
    d = F.levenshtein(F.lower(wanted), F.lower(name))
    near = df.select(wanted).distinct().join(names.select(name).distinct(), d <= F.greatest(F.lit(2), F.floor(F.length(wanted) / 3)))
    return near.groupBy(wanted).agg(F.min_by(name, F.struct(d, F.col(name))).alias("suggestion"))


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """SO-8: the first row of each key in ``order``."""
    return numbered(df, keys, order, "_n").filter("_n = 1").drop("_n")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """SO-1, SO-2: all rows of frames with the same column names; absent columns are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def degrees(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """GR-7: ``node, fan_out, fan_in`` over distinct edges."""
    e = edges.select(src, dst).distinct()
    both = e.select(F.col(src).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select(F.col(dst), F.lit(0), F.lit(1)))
    return both.groupBy("node").agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"))


def cost_usd(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """F-13b: dollars at rates a million tokens."""
    return tokens_in / 1e6 * rate_in + tokens_out / 1e6 * rate_out


def rename_pair(old: Column, new: Column) -> tuple[Column, Column]:
    """SO-6: (is_rename, from -> to): two lists of identifiers that differ in one each, and whether putting
    one for the other turns the old list into the new one."""
    gone, came = F.array_except(old, new), F.array_except(new, old)
    one = (F.size(gone) == 1) & (F.size(came) == 1)
    swapped = F.transform(old, lambda x: F.when(x == gone[0], came[0]).otherwise(x))
    return one & (swapped == new), F.when(one, F.struct(gone[0].alias("from"), came[0].alias("to")))


def suffix_owner(df: DataFrame, path: str, owners: DataFrame, owner: str) -> DataFrame:
    """J-5: the owner that a path equals or ends with after a slash; the longest, where several do."""
    own = df.select(path).distinct()
    parts = F.split(path, "/")
    tails = own.select(path, F.explode(F.sequence(F.lit(1), F.size(parts))).alias("_k")).select(path, F.array_join(F.slice(parts, F.col("_k"), F.size(parts)), "/").alias(owner))
    best = tails.join(owners.select(owner).distinct(), owner).groupBy(path).agg(F.max_by(owner, F.length(owner)).alias(owner))
    return df.join(best, path)


def prefix_owner(df: DataFrame, path: str, owners: DataFrame, owner: str) -> DataFrame:
    """J-9, J-10: the owner that a path equals or begins with before a slash or a point; the longest."""
    own = df.select(path).distinct()
    cuts = F.filter(F.sequence(F.lit(1), F.length(path)), lambda k: (k == F.length(path)) | F.substring(F.col(path), k + 1, F.lit(1)).isin("/", "."))
    heads = own.select(path, F.explode(cuts).alias("_k")).select(path, F.col(path).substr(F.lit(1), F.col("_k")).alias(owner))
    best = heads.join(owners.select(owner).distinct(), owner).groupBy(path).agg(F.max_by(owner, F.length(owner)).alias(owner))
    return df.join(best, path)
