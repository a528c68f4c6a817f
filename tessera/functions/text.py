"""Scalar functions of the code-facts engine, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the code normaliser leaves as they are.
KEYWORDS = "if else for range switch case default break continue return var const func defer go select chan interface struct map error nil true false iota".split()
BUILTINS = "make len cap new append copy close delete complex real imag panic recover print println int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr float32 float64 complex64 complex128 bool string byte rune".split()
# Predeclared names that a rename must not take.
PREDECLARED = "bool byte complex64 complex128 error float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr true false iota nil len cap make new append copy delete complex real imag panic recover print println".split()


def normalise_code(text: Column) -> Column:
    """F-1: comments go, white space collapses, words that start like an identifier become VAR unless they
    are keywords or builtins. A word is what stands between spaces, and only its first byte counts."""
    t = F.regexp_replace(text, r"(?d)//.*", "")
    t = F.regexp_replace(t, r"(?s)/\*.*?\*/", "")
    t = F.trim(F.regexp_replace(t, r"[ \t\r\n\f]+", " "))
    keep = F.array(*(F.lit(w) for w in (*KEYWORDS, *BUILTINS)))
    words = F.filter(F.split(t, " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike("^[A-Za-z_]") & ~F.array_contains(keep, w), F.lit("VAR")).otherwise(w)), " ")


def is_idiom(norm: Column, extra: tuple[str, ...] = ()) -> Column:
    """F-1b: the plain error-return idiom, or a configured substring."""
    out = norm.rlike(r"^if VAR != nil \{ return [^{}]*\}$")
    for x in extra:
        out = out | F.contains(norm, F.lit(x))
    return out


def collapse_digits(text: Column) -> Column:
    """F-3: runs of digits become #; case stays."""
    return F.regexp_replace(text, "[0-9]+", "#")


def fingerprint(file: Column, rule: Column, message: Column) -> Column:
    """F-3b: file, rule and message without digits, joined by NUL."""
    return F.concat_ws("\u0000", file, rule, collapse_digits(message))


def plain_reason(text: Column) -> Column:
    """F-3c: digits collapsed, lower case, trimmed."""
    return F.trim(F.lower(collapse_digits(text)))


def shaped_reason(text: Column) -> Column:
    """F-3d: lower case; quoted text, paths and numbers become marks, white space single spaces."""
    t = F.regexp_replace(F.lower(text), "\"[^\"]*\"|'[^']*'|`[^`]*`", "<q>")
    t = F.regexp_replace(t, r"[A-Za-z0-9_./-]+\.go(:[0-9]+)?", "<path>")
    t = F.regexp_replace(t, r"\b[0-9]+\b", "<n>")
    return F.trim(F.regexp_replace(t, r"[ \t\r\n\f]+", " "))


def is_exported(name: Column) -> Column:
    """F-4."""
    return name.rlike(r"^\p{Lu}")


def make_key(receiver: Column, name: Column) -> Column:
    """F-5: ``Recv:Name``, or the name alone."""
    return F.concat_ws(":", F.nullif(receiver, F.lit("")), name)


def split_key(key: Column) -> tuple[Column, Column]:
    """F-5: (receiver, name), cut at the first colon."""
    at = F.instr(key, ":")
    return F.when(at > 0, F.substring(key, F.lit(1), at - 1)).otherwise(""), F.when(at > 0, F.substring(key, at + 1, F.length(key))).otherwise(key)


def receiver_type(receiver: Column) -> Column:
    """F-6: without pointer and type parameters."""
    return F.regexp_extract(receiver, r"^\(?(?:[A-Za-z_]\w*\s+)?\*?([A-Za-z_]\w*)", 1)


def hunk_header(line: Column) -> Column:
    """F-7: old and new start and count of a hunk header; a missing count is 1."""
    p = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    part = lambda k: F.nullif(F.regexp_extract(line, p, k), F.lit("")).cast("int")
    return F.when(line.rlike(p), F.struct(part(1).alias("old_start"), F.coalesce(part(2), F.lit(1)).alias("old_count"), part(3).alias("new_start"), F.coalesce(part(4), F.lit(1)).alias("new_count")))


def identifiers(text: Column) -> Column:
    """F-8c: distinct identifiers in the order first seen."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))


def language_of(path: Column) -> Column:
    """F-9: by the path's end, in this order."""
    out = F.when(path.endswith(".go"), "go").when(path.endswith(".js") | path.endswith(".ts"), "javascript")
    return out.when(path.endswith(".py"), "python").when(path.endswith(".java"), "java").otherwise("unknown")


def camel_words(name: Column) -> Column:
    """F-11: a camel-case name as lower-case words."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")))


def camel_slug(text: Column) -> Column:
    """F-11: words as one camelCase name."""
    words = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), F.lit(1)), lambda w, i: F.when(i == 0, F.lower(w)).otherwise(F.initcap(w))), "")
    return words


def ellipsis(text: Column, most: int) -> Column:
    """F-12: cut by characters."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def provider_of(model: Column, fallback: str = "local") -> Column:
    """F-13: by the name's beginning."""
    m = F.lower(model)
    return F.when(m.startswith("claude"), "anthropic").when(m.rlike("^(gpt|o1|o3|o4)"), "openai").otherwise(fallback)


def is_identifier(name: Column) -> Column:
    """F-14."""
    return name.rlike("^[A-Za-z_][A-Za-z0-9_]*$")


def is_builtin(name: Column) -> Column:
    """F-14."""
    return name.isin(*PREDECLARED)


def default_severity(category: Column) -> Column:
    """F-15: concurrency, security, API and workflow findings are errors."""
    return F.when(category.isin("conc", "sec", "api", "temporal"), "error").otherwise("warning")


def marked_json(text: Column, begin: str, end: str) -> Column:
    """F-16: what stands between two markers."""
    q = lambda s: r"\Q" + s + r"\E"
    return F.nullif(F.regexp_extract(text, f"(?s){q(begin)}(.*?){q(end)}", 1), F.lit(""))


RENAME = r"(?i)\brename\b[^.\n]*?\b([A-Za-z_][A-Za-z0-9_]*)\s+to\s+([A-Za-z_][A-Za-z0-9_]*)\b"
CALLERS = r"(?i)\b(?:callers?\s+of|who\s+calls)\b\s+(?:the\s+)?(?:function\s+|method\s+)?([A-Za-z_][A-Za-z0-9_]*)\b"


def triage(spec: Column) -> Column:
    """F-17: what a request asks for, by ordered patterns, with the names it gives."""
    part = lambda p, k: F.nullif(F.regexp_extract(spec, p, k), F.lit(""))
    kind = F.when(part(RENAME, 1).isNotNull() & (part(RENAME, 1) != part(RENAME, 2)), "rename").when(part(CALLERS, 1).isNotNull(), "callers")
    kind = kind.when(spec.rlike(r"(?i)\b(impossible|cannot be done|infeasible)\b"), "infeasible").when(spec.rlike(r"(?i)\b(do not|don't|without|never)\b"), "negative constraint").otherwise("other")
    return F.struct(kind.alias("kind"), F.coalesce(part(RENAME, 1), part(CALLERS, 1)).alias("name"), part(RENAME, 2).alias("new_name"))


def relative_path(path: Column, root: str) -> Column:
    """F-18."""
    q = r"^\Q" + root.rstrip("/") + r"\E/?"
    return F.regexp_replace(path, q, "")


def extension(ext: Column) -> Column:
    """F-18: lower case with one point before it."""
    return F.concat(F.lit("."), F.regexp_replace(F.lower(ext), r"^\.+", ""))


def strip_position(location: Column) -> Column:
    """F-19: without a ``:line`` or ``:line:col`` at the end."""
    return F.regexp_replace(location, r"(:\d+){1,2}$", "")


def compare(op: str, value: Column, want) -> Column:
    """P-5, P-5b: a named comparison; an operator that doesn't suit the value's kind is an error."""
    want_c = F.lit(want)
    table = {"eq": value == want_c, "ne": value != want_c}
    if isinstance(want, bool):
        pass
    elif isinstance(want, int | float):
        table |= {"gt": value > want_c, "gte": value >= want_c, "lt": value < want_c, "lte": value <= want_c}
    else:
        table |= {"contains": F.contains(value, want_c), "regex": value.rlike(str(want))}
    if op not in table:
        raise ValueError(f"{op} doesn't compare {type(want).__name__}")
    return table[op]


def all_conditions(conditions: list[Column]) -> Column:
    """P-5c: AND; a condition that can't be told (null) is an error, not a pass."""
    out = F.lit(True)
    for c in conditions:
        out = out & F.when(c.isNull(), F.raise_error(F.lit("a condition can't be evaluated")).cast("boolean")).otherwise(c)
    return out
