"""Secret scan with multipart credential linking, in DataFrame functions only.

Regular expressions find three base kinds of secrets and three kinds of weak parts: identifiers,
secret-like tokens and endpoints. Parts are dealt into all cells of a scope's width that they touch and
joined with the parts of these and the next cells that lie within the scope; a weak part is reported only when a
complementary part is there: identifiers and endpoints need a secret, secrets need an identifier.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, text_or_empty


def either_case(word: str) -> str:
    """The pattern of a word in either case, of ASCII letters only in every regex engine."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# Fixed patterns of the base kinds.
KEYS = "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + either_case("api") + "_?" + either_case("key")
ASSIGN = rf"""({KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"  # 18 characters or more: a shorter run holds no other match
HEX = "[0-9a-f]{16,}"  # likewise

# Weak parts.
NAMES = "|".join(map(either_case, ("user", "username", "login", "account", "client_id", "access_key_id")))
IDENTIFIER = rf"""({NAMES})["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{{4,}}"""
SECRETLIKE = "[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"(https?://[A-Za-z0-9._:/?&=%#-]{4,}|[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})"

#: Kinds in their order, each with its role in a credential.
KINDS = (("assign", ASSIGN, "secret"), ("access", ACCESS, "id"), ("hex", HEX, "secret"), ("identifier", IDENTIFIER, "id"), ("secretlike", SECRETLIKE, "secret"), ("endpoint", ENDPOINT, "endpoint"))
BASE = 3
SPAN = "array<struct<start:int,kind:int,stop:int>>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once a row: a lambda's variable is a value, not an expression."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """Sums up to each element, in n log n steps: each round adds what stands 1, 2, 4, ... places before."""
    rounds = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.size(numbers), F.lit(1)))).cast("int"))
    add = lambda acc, k: let(F.pow(F.lit(2), k).cast("int"), lambda back: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - back), F.lit(0))))
    return F.aggregate(rounds, numbers, add)


#: What a text must hold to have a match at all, found faster than by the pattern.
HINTS = {
    0: lambda t: t.contains(":") | t.contains("="),
    1: lambda t: t.contains("AKIA"),
    3: lambda t: t.contains(":") | t.contains("="),
    4: lambda t: t.rlike("(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}"),
    5: lambda t: t.contains("://") | t.contains("@") | t.rlike(r"[0-9]\.[0-9]"),
}


def spans_of(text: Column, number: int, pattern: str) -> Column:
    """Spans of all matches: the text between them gives where they start, in code points. The matches and
    the text between them are each found once."""
    regex = F.lit(pattern)

    def spans(found: Column) -> Column:
        def placed(widths: Column, stops: Column) -> Column:
            span = lambda stop, i: F.struct((stop - F.get(widths, i)["m"]).alias("start"), F.lit(number).alias("kind"), stop.alias("stop"))
            if number == 0:  # a match whose value has under 12 characters is dropped, yet takes its place
                values = F.regexp_extract_all(text, regex, F.lit(2))
                return let(values, lambda v: _some(F.transform(stops, lambda stop, i: F.when(F.length(F.get(v, i)) >= 12, span(stop, i)))))
            if number == 4:
                mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (m.rlike("[A-Z]") | m.rlike("[+/_-]") | (F.length(m) >= 32))
                return _some(F.transform(stops, lambda stop, i: F.when(mixed(F.get(found, i)), span(stop, i))))
            return F.transform(stops, span)

        widths = let(F.split(text, pattern, -1), lambda between: F.transform(found, lambda m, i: F.struct((F.length(m) + F.length(F.get(between, i))).alias("w"), F.length(m).alias("m"))))
        return let(widths, lambda w: let(running_sums(w["w"]), lambda stops: placed(w, stops)))

    hint = HINTS.get(number, lambda t: F.lit(True))(text)
    return F.when(hint & text.rlike(pattern), let(F.regexp_extract_all(text, regex, F.lit(0)), spans)).otherwise(F.array().cast(SPAN)).cast(SPAN)


def _some(items: Column) -> Column:
    return F.filter(items, lambda s: s.isNotNull())


def listed(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k, _, _ in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_scan(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked``.

    ``spans`` lists ``kind:start:end`` of the base spans and of the weak parts that were linked, by start,
    then kind; ``base_sha256`` is over the base spans alone. Weak parts that overlap a base span are part
    of it. A null text is empty. Null ids are carried; repeated rows each give their own result; other
    columns are not read. A scope's cell holds a bounded number of parts, for parts don't overlap within
    a kind, so the join grows with the parts and not with the square of a text's length.
    """
    scratch = Scratch(spark)
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    scanned = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("mark"), *(spans_of(text, n, p).alias(k) for n, (k, p, _) in enumerate(KINDS)))
    found = scratch.table(scanned)
    names = [k for k, _, _ in KINDS]
    base = F.array_sort(F.concat(*names[:BASE]))
    roles = F.array(*(F.lit(r) for _, _, r in KINDS))
    every = found.filter(" OR ".join(f"size({k}) > 0" for k in names[BASE:])).select("doc_id", "mark", F.explode(F.concat(*names)).alias("s"))
    every = every.select("doc_id", "mark", "s.start", "s.stop", "s.kind", F.get(roles, F.col("s.kind")).alias("role")).distinct()
    cells = lambda more: F.explode(F.sequence(F.floor(F.col("start") / scope) - more, F.floor((F.col("stop") - 1) / scope) + more))
    aside = lambda rows, more: rows.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.col("start").alias("b"), F.col("stop").alias("e"), F.col("kind").alias("k"), F.col("role").alias("r"), cells(more).alias("c"))
    weak, sure = every.filter(F.col("kind") >= BASE).withColumn("cell", cells(0)), aside(every.filter(F.col("kind") < BASE), 0)
    met = lambda one, two: one.doc_id.eqNullSafe(two.d) & (one.mark == two.m) & (one.cell == two.c)
    within = scratch.table(weak.join(sure, met(weak, sure) & (sure.b < weak.stop) & (weak.start < sure.e), "left_semi").select("doc_id", "mark", "start", "kind").distinct())
    parts = every.join(within.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.col("start").alias("b"), F.col("kind").alias("k")), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")) & (F.col("start") == F.col("b")) & (F.col("kind") == F.col("k")), "left_anti")
    parts = scratch.table(parts)
    weak, other = parts.filter(F.col("kind") >= BASE).withColumn("cell", cells(0)), aside(parts, 1)
    fits = F.when(weak.role == "secret", other.r == "id").otherwise(other.r == "secret")
    close = (other.b < weak.stop + scope) & (weak.start < other.e + scope)
    linked = weak.join(other, met(weak, other) & fits & close, "left_semi")
    linked = linked.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "kind", "stop")).alias("more"))
    linked = linked.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "more")
    out = found.select("doc_id", "mark", *(F.size(k).cast("long").alias(f"n_{k}") for k in names[:BASE]), base.alias("base"))
    out = out.join(linked, out.doc_id.eqNullSafe(linked.d) & (out.mark == linked.m), "left")
    more = F.coalesce("more", F.array().cast(SPAN))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", more))).alias("spans"), F.size(more).cast("long").alias("n_linked"))
