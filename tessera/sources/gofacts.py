"""Go source files as fact tables: one table function parses each file once, and typed tables are read
from what it yields (S-1, S-2, S-3)."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tessera.functions.golang import CONTROL, File, Func, Stmt, calls, complexity, dispatch, error_paths, every, joined, literal_lines, nesting, parse, walk
from tessera.functions.shipping import ship
from tessera.operators.graph import Rounds

PRUNED = ("vendor", "node_modules", ".git")
SCHEMAS = {
    "decls": "kind string, name string, receiver string, key string, exported boolean, start int, end int, index int, n_params int, n_param_fields int, n_result_fields int, params array<struct<name:string,type:string>>, results array<struct<name:string,type:string>>, type_switches int",
    "types": "name string, kind string, exported boolean, start int, end int, index int, n_fields int, n_field_groups int, methods array<string>, fields array<struct<name:string,type:string>>",
    "fn_metrics": "key string, name string, receiver string, line int, end_line int, lines int, literal_lines int, complexity int, max_nesting int, error_paths int, dispatch struct<cases:int,worst_complexity:int,worst_lines:int,normalized:int,line_discount:int>",
    "raw_calls": "line int, col int, caller_key string, callee_text string, callee_name string, is_selector boolean, args array<string>",
    "uses": "name string, line int, col int, context string, receiver string, func_key string",
    "idents": "name string, n int",
    "imports": "alias string, import_path string, line int",
    "blocks": "start int, end int, n_stmts int, n_control int, text string, is_fn_body boolean, func_key string",
    "stmts": "func_key string, block_id int, idx int, kind string, shape string, text string, line int",
    "comments": "line int, end_line int, word string, next_name string",
    "sites": "kind string, func_key string, name string, line int, detail string",
}
ROW = "fact string, data string"


def exported(name: str) -> bool:
    return name[:1].isupper()


def base_type(text: str) -> str:
    m = re.match(r"\*?([A-Za-z_]\w*)", text)
    return m.group(1) if m else ""


def key_of(f: Func) -> str:
    r = base_type(f.receiver)
    return f"{r}:{f.name}" if r else f.name


def shape(s: Stmt) -> str:
    """A statement with its identifiers taken out: what sequence patterns match on."""
    if s.kind in CONTROL:
        return s.kind
    out = "".join("#" if t.kind in ("number", "string", "char") else "$" if t.kind == "ident" else t.text for t in s.head if t.text != ";")
    return f"{s.kind}:{out}" if s.kind in ("return", "go", "defer") else out


_LOG = re.compile(r"^(log|logger|slog|l|lg|zap|logging)\b.*\.(Print|Printf|Println|Error|Errorf|Warn|Warnf|Info|Infof|Debug|Debugf)\(", re.I)
# Fixed pattern: identifiers that tell a goroutine's lifecycle.
_LIFE = re.compile(r"(ctx|context|done|quit|stop|cancel|wg|waitgroup|group|g|eg|errgroup|sem|ch)", re.I)
_WRAP = re.compile(r"^(\w+)(?::=|=)(?:fmt\.Errorf|errors\.Wrap\w*)\(")


def sites(file: File, f: Func) -> Iterator[tuple[str, str, int, str]]:
    """Statement-level findings of one function: (kind, name, line, detail)."""
    body = f.body or []
    result_types = [t for _, t in f.results]
    strings = {n for n, t in f.params if t == "string"}
    text_of = lambda s: joined(s.head)
    flat = list(every(body))
    for s in flat:
        if s.kind == "simple" and (m := re.match(r"^(?:var )?(\w+)(?: string=|:=|=)\"", text_of(s))):
            strings.add(m.group(1))
        if s.kind == "simple" and (m := re.match(r"^var (\w+) string$", text_of(s))):
            strings.add(m.group(1))
    if exported(f.name) and result_types and result_types[-1] == "error":
        for s in flat:
            if s.kind == "return" and len(s.head) > 1 and s.head[-1].kind == "ident" and re.fullmatch(r"\w*[eE]rr", s.head[-1].text) and s.head[-2].text in ("return", ","):
                yield "error-not-wrapped", f.name, s.line, s.head[-1].text
    for block in [body, *(s.body for s in flat if s.body)]:
        yield from sequences(block, f)
    logged = {"n": 0}
    for s in flat:
        if s.kind == "if" and re.fullmatch(r"(?:.*;)?(\w*err)!=nil", text_of(s).replace(" ", "")) and logs_then_returns(s.body):
            yield "if-err-log-return", f.name, s.line, ""
            logged["n"] += 1
    loops = [s for s in flat if s.kind == "for"]
    for loop in loops:
        inside = {m.group(1) for x in every(loop.body) if (m := re.match(r"^(?:var )?(\w+)(?::=| string)", text_of(x)))}
        for x in every(loop.body):
            if x.kind == "simple" and (m := re.match(r"^(\w+)\+=", text_of(x))) and m.group(1) in strings - inside:
                yield "string-concat-in-loop", m.group(1), x.line, ""
            if x.kind == "for" and any(t.text == "range" for t in x.head) and any(y.kind == "if" and "==" in {t.text for t in y.head} and any(z.kind == "return" or z.head[:1] and z.head[0].text == "break" for z in y.body) for y in x.body):
                yield "linear-search-in-loop", f.name, x.line, ""
    tickers = {}
    for s in flat:
        if m := re.match(r"^(\w+)(?::=|=)time\.NewTicker\(", text_of(s)):
            tickers[m.group(1)] = s.line
    whole = joined(f.tokens)
    for name, line in tickers.items():
        returned = any(s.kind == "return" and any(t.text == name for t in s.head) for s in flat)
        if f"{name}.Stop(" not in whole and not returned:
            yield "unstopped-ticker", name, line, ""
    for s in flat:
        if s.kind == "go" and not any(t.kind == "ident" and _LIFE.fullmatch(t.text) for t in s.head):
            yield "naked-goroutine", f.name, s.line, ""
    if f.name != "init":
        for line, _, callee, _, _, _ in calls(f.tokens):
            if callee in ("regexp.MustCompile", "regexp.Compile"):
                at = next(k for k, t in enumerate(f.tokens) if t.line == line and t.text in ("MustCompile", "Compile"))
                if len(f.tokens) > at + 3 and f.tokens[at + 2].kind == "string" and f.tokens[at + 3].text == ")":
                    yield "regexp-compile-in-func", f.name, line, f.tokens[at + 2].text
    seen: dict[str, int] = {}
    for s in body:
        if s.kind == "if" and (m := re.fullmatch(r"(\w+)==nil", text_of(s))) and s.body and s.body[-1].kind == "return":
            if m.group(1) in seen:
                yield "unnecessary-nil-check", m.group(1), s.line, "checked before"
            seen[m.group(1)] = s.line
        elif s.kind == "if" and (m := re.fullmatch(r"(\w+)[!=]=nil", text_of(s))) and m.group(1) in seen:
            yield "unnecessary-nil-check", m.group(1), s.line, "checked before"
        elif s.kind == "simple" and (m := re.match(r"^(\w+)(?::=|=)&\w", text_of(s))):
            seen[m.group(1)] = s.line
        elif s.kind == "simple" and (m := re.match(r"^(\w+)(?:,\w+)*(?::=|=)", text_of(s))):
            seen.pop(m.group(1), None)
    if body and body[0].kind == "if" and (m := re.fullmatch(r"(\w+)==nil", text_of(body[0]))) and m.group(1) in [n for n, _ in f.params] and body[0].body and body[0].body[0].kind == "return":
        yield "entry-nil-guard", m.group(1), body[0].line, str([n for n, _ in f.params].index(m.group(1)))
    for s in flat:
        if s.kind == "return" and len(s.head) == 2 and re.fullmatch(r"Err[A-Z]\w*", s.head[1].text):
            yield "bare-sentinel", s.head[1].text, s.line, ""
    if f.name.startswith("Test") and f.name != "TestMain" and len(f.params) == 1 and f.params[0][1] == "*testing.T":
        t = f.params[0][0]
        can = any((sel and name in TEST_FAILS) or callee == "panic" or t in args for _, _, callee, name, sel, args in calls(f.tokens))
        if not can:
            yield "vacuous-test", f.name, f.line, ""
    names = [n for n, _ in f.params if n and n != "_"]
    for place, n in enumerate(names):
        spots = [k for k, x in enumerate(f.tokens) if x.kind == "ident" and x.text == n and not (k and f.tokens[k - 1].text == ".")]
        forwards = [(callee, args.index(n)) for _, _, callee, _, _, args in calls(f.tokens) if n in args]
        if len(spots) == 1 and len(forwards) == 1:
            yield "forwarded-param", n, f.line, json.dumps({"place": place, "callee": forwards[0][0].rsplit(".", 1)[-1], "at": forwards[0][1]})


# Methods by which a test fails or skips.
TEST_FAILS = set("Error Errorf Fatal Fatalf Fail FailNow Skip Skipf SkipNow".split())


def logs_then_returns(block: list[Stmt]) -> bool:
    """W-6: a log call somewhere before an error is returned; what a branch logs counts after it."""
    seen = False
    for s in block:
        if s.kind == "return" and seen and any(re.fullmatch(r"\w*[eE]rr", t.text) for t in s.head[1:]):
            return True
        if any(_LOG.match(joined(x.head)) for x in walk([s])):
            seen = True
        if s.body and logs_then_returns(s.body):
            return True
    return False


def sequences(block: list[Stmt], f: Func) -> Iterator[tuple[str, str, int, str]]:
    """SQ-2, SQ-3: wrap, log, return; and with an assignment of the wrapped error between."""
    texts = [joined(s.head) for s in block]
    for k, first in enumerate(texts):
        if not (m := _WRAP.match(first)):
            continue
        name = m.group(1)
        rest = list(zip(block[k + 1 : k + 4], texts[k + 1 : k + 4], strict=True))
        if len(rest) >= 2 and _LOG.match(rest[0][1]) and rest[1][0].kind == "return" and re.search(rf"\b{name}\b", rest[1][1]):
            yield "wrap-log-return", f.name, block[k].line, name
        if len(rest) >= 3 and (b := re.fullmatch(rf"(\w+)(?::=|=){name}", rest[0][1])) and _LOG.match(rest[1][1]) and rest[2][0].kind == "return" and re.search(rf"\b{b.group(1)}\b", rest[2][1]):
            yield "wrap-bridge-log-return", f.name, block[k].line, name


def uses_of(tokens, key: str) -> Iterator[dict]:
    """J-2, J-2b: uses of names with their context."""
    for k, t in enumerate(tokens):
        if t.kind != "ident":
            continue
        nxt, prev = tokens[k + 1].text if k + 1 < len(tokens) else "", tokens[k - 1].text if k else ""
        receiver = tokens[k - 2].text if prev == "." and k > 1 and tokens[k - 2].kind == "ident" else ""
        start = k
        while start and tokens[start - 1].text not in (";", "{", "}"):
            start -= 1
        lead = tokens[start].text
        assign = next((j for j in range(start, min(k + 40, len(tokens))) if tokens[j].text in (":=", "=", ";", "{")), None)
        if nxt == "(":
            context = "call"
        elif lead == "return":
            context = "return"
        elif lead == "defer":
            context = "defer"
        elif prev == "(" and k > 1 and tokens[k - 2].text == ".":
            context = "type_assertion"
        elif prev == ".":
            context = "field"
        elif assign is not None and tokens[assign].text in (":=", "="):
            context = "assign_lhs" if k < assign else "assign_rhs"
        else:
            context = "other"
        yield {"name": t.text, "line": t.line, "col": t.col, "context": context, "receiver": receiver, "func_key": key}


def file_facts(text: str) -> Iterator[tuple[str, dict]]:
    file = parse(text)
    pairs = lambda xs: [{"name": n, "type": t} for n, t in xs]
    yield "package", {"package": file.package}
    for alias, path, line in file.imports:
        yield "imports", {"alias": alias, "import_path": path, "line": line}
    lines = text.split("\n")
    block_id = 0
    for f in file.funcs:
        key, receiver = key_of(f), base_type(f.receiver)
        switches = sum(s.kind == "switch" and any(a.text == "." and b.text == "(" and c.text == "type" for a, b, c in zip(s.head, s.head[1:], s.head[2:], strict=False)) for s in every(f.body or []))
        yield "decls", {"kind": "method" if receiver else "func", "name": f.name, "receiver": receiver, "key": key, "exported": exported(f.name), "start": f.line, "end": f.end_line, "index": f.index, "n_params": len(f.params), "n_param_fields": f.param_fields, "n_result_fields": f.result_fields, "params": pairs(f.params), "results": pairs(f.results), "type_switches": switches}
        if f.body is None:
            continue
        yield "fn_metrics", {"key": key, "name": f.name, "receiver": receiver, "line": f.line, "end_line": f.end_line, "lines": f.end_line - f.line + 1, "literal_lines": literal_lines(f.body), "complexity": 1 + complexity(f.body), "max_nesting": nesting(f.body), "error_paths": error_paths(f.body), "dispatch": dispatch(f)}
        for line, col, callee, name, selector, args in calls(f.tokens):
            yield "raw_calls", {"line": line, "col": col, "caller_key": key, "callee_text": callee, "callee_name": name, "is_selector": selector, "args": args}
        for u in uses_of(f.tokens, key):
            yield "uses", u
        for kind, name, line, detail in sites(file, f):
            yield "sites", {"kind": kind, "func_key": key, "name": name, "line": line, "detail": detail}
        for n, block in enumerate([f.body, *(s.body for s in every(f.body) if s.body and s.kind != "switch")]):
            if not block:
                continue
            start, end = block[0].line, block[-1].end_line
            yield "blocks", {"start": start, "end": end, "n_stmts": len(block), "n_control": sum(s.kind in CONTROL for s in walk(block)), "text": "\n".join(lines[start - 1 : end]), "is_fn_body": n == 0, "func_key": key}
            for i, s in enumerate(block):
                yield "stmts", {"func_key": key, "block_id": block_id, "idx": i, "kind": s.kind, "shape": shape(s), "text": joined(s.head), "line": s.line}
            block_id += 1
    for t in file.types:
        yield "types", {"name": t.name, "kind": t.kind, "exported": exported(t.name), "start": t.line, "end": t.end_line, "index": t.index, "n_fields": len(t.fields), "n_field_groups": t.field_groups, "methods": t.methods, "fields": pairs(t.fields)}
    for kind, name, line, index in file.values:
        yield "decls", {"kind": kind, "name": name, "receiver": "", "key": name, "exported": exported(name), "start": line, "end": line, "index": index, "n_params": 0, "n_param_fields": 0, "n_result_fields": 0, "params": [], "results": [], "type_switches": 0}
    for name, n in Counter(t.text for t in file.tokens if t.kind == "ident").items():
        yield "idents", {"name": name, "n": n}
    starts = sorted([(f.line, f.name) for f in file.funcs] + [(t.line, t.name) for t in file.types])
    for line, end, body in file.comments:
        if (m := re.match(r"//\s*([A-Za-z_]\w*)", body)) and not (line > 1 and lines[line - 2].lstrip().startswith("//")):
            last = end
            while last < len(lines) and lines[last].lstrip().startswith("//"):
                last += 1
            follows = next((n for at, n in starts if at == last + 1), "")
            yield "comments", {"line": line, "end_line": last, "word": m.group(1), "next_name": follows}


@udtf(returnType=ROW)
class GoFacts:
    """Facts of one file's text as (name, JSON)."""

    def eval(self, text: str):
        for fact, data in file_facts(text or ""):
            yield fact, json.dumps(data)


def read_go(spark: SparkSession, root: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """S-1: ``path, text`` of the Go files under a folder, without pruned folders and generated names."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.go").load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^file:/+", "/")
    return pruned(files.select(F.replace(path, F.lit(base), F.lit("")).alias("path"), F.col("value").alias("text")), skip)


def pruned(files: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """S-1a, S-1b: by folders on the way (dot folders, vendor and the like) and by name."""
    folders = F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    bad = F.exists(folders, lambda d: (d.startswith(".") & (d != ".")) | d.isin(*PRUNED, *skip))
    return files.filter(~bad & F.col("path").endswith(".go") & ~F.col("path").rlike(r"(\.gen|_gen)\.go$"))


def is_generated(text) -> F.Column:
    """S-1d: the generated-code mark among the first 50 lines before the package clause."""
    head = F.slice(F.split(text, "\n"), 1, 50)
    cut = F.array_position(F.transform(head, lambda x: x.startswith("package ")), True)
    before = F.when(cut > 0, F.slice(head, F.lit(1), cut.cast("int"))).otherwise(head)
    return F.exists(before, lambda x: x.rlike("^// Code generated .* DO NOT EDIT\\.$"))


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """S-3: files that weren't read before in this state (path, mtime, size)."""
    return files.join(known, ["path", "mtime", "size"], "left_anti")


def fact_tables(spark: SparkSession, files: DataFrame) -> dict[str, DataFrame]:
    """All fact tables of ``path, text``; each file is parsed once and its facts are written before use.

    Null texts have no facts. Every table has ``path, dir, package, is_test`` beside its own columns."""
    ship(spark)
    spark.udtf.register("tessera_go_facts", GoFacts)
    view = "tessera_go_files"
    files.select("path", "text").createOrReplaceTempView(view)
    made = spark.sql(f"SELECT f.path, g.fact, g.data FROM {view} f, LATERAL tessera_go_facts(f.text) g")
    rows = Rounds(spark).keep(made)
    where = files.select("path", F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(".").alias("dir"), F.col("path").endswith("_test.go").alias("is_test"), is_generated(F.col("text")).alias("is_generated"), F.size(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("n_lines"))
    package = rows.filter("fact = 'package'").select("path", F.get_json_object("data", "$.package").alias("package"))
    out = {"files": where.join(package, "path", "left")}
    at = out["files"].select("path", "dir", "package", "is_test")
    for name, schema in SCHEMAS.items():
        out[name] = rows.filter(F.col("fact") == name).select("path", F.from_json("data", schema).alias("d")).select("path", "d.*").join(at, "path")
    return out
