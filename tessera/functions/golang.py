"""A lexer and declaration parser for Go source, in plain Python, for use inside a table function.

Statements are parsed as far as facts need it: control structures with their blocks, and everything else
as a run of tokens. Types are kept as text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

KEYWORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_TOKEN = re.compile(
    r"""(?P<space>[ \t\r]+)|(?P<newline>\n)|(?P<line>//[^\n]*)|(?P<block>/\*.*?\*/)|(?P<raw>`[^`]*`)|(?P<string>"(?:\\.|[^"\\\n])*")|(?P<char>'(?:\\.|[^'\\\n])+')
    |(?P<number>(?:0[xX][0-9a-fA-F_]+|0[bBoO][0-7_]+|(?:[0-9][0-9_]*)?\.?[0-9][0-9_]*(?:[eE][+-]?[0-9]+)?\.?)i?)|(?P<ident>[^\W\d]\w*)
    |(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|.)""",
    re.S | re.X,
)
_ENDS = {"break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}
CONTROL = ("if", "for", "switch", "select")
PAIRS = {"(": ")", "[": "]", "{": "}"}


@dataclass(slots=True)
class Token:
    kind: str  # ident, keyword, number, string, char, op
    text: str
    line: int
    col: int
    end_line: int


def lex(source: str) -> tuple[list[Token], list[tuple[int, int, str]]]:
    """Tokens, with the semicolons that line ends stand for, and comments as (line, end line, text)."""
    tokens: list[Token] = []
    comments: list[tuple[int, int, str]] = []
    line, begin = 1, 0

    def end_line() -> None:
        if tokens and (last := tokens[-1]).end_line and (last.kind in ("ident", "number", "string", "char") or last.text in _ENDS) and last.text != ";":
            tokens.append(Token("op", ";", line, 0, line))

    for m in _TOKEN.finditer(source):
        kind, text = m.lastgroup, m.group()
        if kind == "newline":
            end_line()
        elif kind in ("line", "block"):
            comments.append((line, line + text.count("\n"), text))
            if "\n" in text:
                end_line()
        elif kind != "space":
            kind = {"raw": "string", "ident": "keyword" if text in KEYWORDS else "ident"}.get(kind, kind)
            tokens.append(Token(kind, text, line, m.start() - begin + 1, line + text.count("\n")))
        if n := text.count("\n"):
            line += n
            begin = m.start() + text.rfind("\n") + 1
    end_line()
    return tokens, comments


@dataclass(slots=True)
class Stmt:
    """A statement: its kind (a control word, ``return``, ``go``, ``defer``, ``block``, ``case`` or ``simple``), its
    own tokens without those of its blocks, and its blocks."""

    kind: str
    line: int
    end_line: int
    head: list[Token]
    body: list[Stmt] = field(default_factory=list)
    other: list[Stmt] = field(default_factory=list)  # of an if: what else holds


@dataclass(slots=True)
class Func:
    name: str
    receiver: str
    line: int
    end_line: int
    params: list[tuple[str, str]]
    param_fields: int
    results: list[tuple[str, str]]
    result_fields: int
    body: list[Stmt] | None
    tokens: list[Token]  # of the body
    index: int


@dataclass(slots=True)
class Type:
    name: str
    kind: str
    line: int
    end_line: int
    fields: list[tuple[str, str]]
    field_groups: int
    methods: list[str]
    index: int


@dataclass(slots=True)
class File:
    package: str = ""
    imports: list[tuple[str, str, int]] = field(default_factory=list)
    funcs: list[Func] = field(default_factory=list)
    types: list[Type] = field(default_factory=list)
    values: list[tuple[str, str, int, int]] = field(default_factory=list)  # kind, name, line, index
    tokens: list[Token] = field(default_factory=list)
    comments: list[tuple[int, int, str]] = field(default_factory=list)


def joined(tokens: list[Token]) -> str:
    """Tokens as text: no spaces but between words."""
    out = ""
    for t in tokens:
        if t.text == ";":
            continue
        if out and (out[-1].isalnum() or out[-1] == "_") and (t.text[0].isalnum() or t.text[0] == "_"):
            out += " "
        out += t.text
    return out


class Parser:
    def __init__(self, source: str):
        self.t, comments = lex(source)
        self.i = 0
        self.file = File(tokens=self.t, comments=comments)

    def text(self, ahead: int = 0) -> str:
        k = self.i + ahead
        return self.t[k].text if k < len(self.t) else ""

    def close(self, at: int) -> int:
        """The place of the bracket that closes the one at ``at`` (the last token if none does)."""
        depth = 0
        for k in range(at, len(self.t)):
            x = self.t[k]
            if x.kind != "op":
                continue
            if x.text in PAIRS:
                depth += 1
            elif x.text in (")", "]", "}"):
                depth -= 1
                if depth == 0:
                    return k
        return len(self.t) - 1

    def until(self, *stops: str) -> list[Token]:
        """Tokens up to a stop outside brackets, which is not taken."""
        start = self.i
        while self.i < len(self.t):
            x = self.t[self.i]
            if x.text in stops and x.kind in ("op", "keyword"):
                break
            if x.kind == "op" and x.text in PAIRS:
                self.i = self.close(self.i)
            elif x.kind == "op" and x.text in (")", "]", "}"):
                break
            self.i += 1
        return self.t[start : self.i]

    def parse(self) -> File:
        f = self.file
        index = 0
        while self.i < len(self.t):
            word = self.text()
            before = self.i
            if word == "package":
                f.package = self.text(1)
                self.until(";")
            elif word in ("import", "const", "var", "type"):
                self.i += 1
                if self.text() == "(":
                    stop = self.close(self.i)
                    self.i += 1
                    while self.i < stop:
                        if self.text() != ";":
                            self.spec(word, index)
                            index += 1
                        self.i = max(self.i, before) + (self.text() == ";")
                        if self.i == before:
                            self.i += 1
                        before = self.i
                    self.i = stop + 1
                else:
                    self.spec(word, index)
                    index += 1
            elif word == "func":
                self.func(index)
                index += 1
            if self.i == before:
                self.i += 1
        return f

    def spec(self, word: str, index: int) -> None:
        line = self.t[self.i].line
        if word == "import":
            parts = self.until(";")
            if parts:
                alias = parts[0].text if len(parts) > 1 else ""
                self.file.imports.append((alias, parts[-1].text.strip('"`'), line))
            return
        name = self.text()
        if word != "type":
            parts = self.until(";")
            names = [name]
            k = 1
            while k + 1 < len(parts) and parts[k].text == ",":
                names.append(parts[k + 1].text)
                k += 2
            self.file.values += [(word, n, line, index) for n in names]
            return
        self.i += 1
        if self.text() == "[" and self.text(1) not in ("]", "") and self.t[self.i + 1].kind == "ident" and self.text(2) != "]":
            self.i = self.close(self.i) + 1
        if self.text() == "=":
            self.i += 1
        kind, fields, groups, methods = self.text(), [], 0, []
        start = self.i
        if kind in ("struct", "interface"):
            while self.i < len(self.t) and self.text() != "{":
                self.i += 1
            stop = self.close(self.i)
            self.i += 1
            while self.i < stop:
                entry = self.until(";")
                if entry:
                    if kind == "struct":
                        groups += 1
                        if entry[-1].kind == "string":
                            entry = entry[:-1]
                        names, k = [entry[0].text], 1
                        while k + 1 < len(entry) and entry[k].text == ",":
                            names.append(entry[k + 1].text)
                            k += 2
                        kind_text = joined(entry[k:])
                        fields += [(n, kind_text) for n in names] if kind_text and entry[0].kind == "ident" and entry[k].text != "." else [("", joined(entry))]
                    elif len(entry) > 1 and entry[0].kind == "ident" and entry[1].text == "(":
                        methods.append(entry[0].text)
                    else:
                        fields.append(("", joined(entry)))
                self.i += 1
            self.i = stop + 1
        else:
            kind = "type"
            self.until(";")
        end = self.t[min(max(self.i - 1, start), len(self.t) - 1)].end_line
        self.file.types.append(Type(name, kind, line, end, fields, groups, methods, index))

    def parameters(self) -> tuple[list[tuple[str, str]], int]:
        """Parameters at an opening parenthesis, and the number of their groups."""
        stop = self.close(self.i)
        self.i += 1
        entries = []
        while self.i < stop:
            entry = self.until(",")
            if entry := [t for t in entry if t.text != ";"]:
                entries.append(entry)
            if self.i < stop:
                self.i += 1
        self.i = stop + 1
        named = any(len(e) > 1 and e[0].kind == "ident" and e[1].text != "." and not (e[1].text == "[" and len(e) > 2 and e[2].text != "]" and e[-1].text == "]") for e in entries)
        if not named:
            return [("", joined(e)) for e in entries], len(entries)
        out: list[tuple[str, str]] = []
        waiting: list[str] = []
        groups = 0
        for e in entries:
            waiting.append(e[0].text)
            if len(e) > 1:
                out += [(n, joined(e[1:])) for n in waiting]
                waiting = []
                groups += 1
        return out, groups

    def func(self, index: int) -> None:
        start = self.t[self.i]
        self.i += 1
        receiver = ""
        if self.text() == "(":
            got, _ = self.parameters()
            receiver = got[0][1] if got else ""
        name = self.text()
        self.i += 1
        if self.text() == "[":
            self.i = self.close(self.i) + 1
        params, groups = self.parameters() if self.text() == "(" else ([], 0)
        results: list[tuple[str, str]] = []
        count = 0
        if self.text() == "(":
            results, count = self.parameters()
        elif self.text() not in ("{", ";", ""):
            begin = self.i
            while self.i < len(self.t) and self.text() not in ("{", ";"):
                if self.text() in ("interface", "struct") and self.text(1) == "{":
                    self.i += 1
                if self.text() in PAIRS:
                    self.i = self.close(self.i)
                self.i += 1
            results, count = [("", joined(self.t[begin : self.i]))], 1
        body, tokens, end = None, [], start.line
        if self.text() == "{":
            stop = self.close(self.i)
            tokens = self.t[self.i + 1 : stop]
            body = self.block()
            end = self.t[stop].line
            self.i = stop + 1
        self.file.funcs.append(Func(name, receiver, start.line, end, params, groups, results, count, body, tokens, index))

    def block(self) -> list[Stmt]:
        """Statements of the block that opens here."""
        stop = self.close(self.i)
        self.i += 1
        out = self.statements(stop)
        self.i = stop + 1
        return out

    def statements(self, stop: int) -> list[Stmt]:
        out = []
        while self.i < stop:
            if self.text() == ";":
                self.i += 1
                continue
            before = self.i
            out.append(self.statement(stop))
            if self.i == before:
                self.i += 1
        return out

    def head(self) -> list[Token]:
        """Tokens up to the brace that opens a control structure's block."""
        start, depth = self.i, 0
        while self.i < len(self.t):
            x = self.t[self.i]
            if x.text == "func" and x.kind == "keyword":
                while self.i < len(self.t) and self.text() != "{":
                    self.i += 1
                self.i = self.close(self.i)
            elif x.kind == "op" and x.text in "([":
                depth += 1
            elif x.kind == "op" and x.text in ")]":
                depth -= 1
            elif x.text == "{" and x.kind == "op":
                if depth == 0 and not (self.i > start and self.t[self.i - 1].text in ("interface", "struct")):
                    break
                self.i = self.close(self.i)
            self.i += 1
        return self.t[start : self.i]

    def statement(self, stop: int) -> Stmt:
        first = self.t[self.i]
        word = first.text if first.kind in ("keyword", "op") else ""
        if word == "{":
            body = self.block()
            return Stmt("block", first.line, self.t[self.i - 1].line, [], body)
        if first.kind == "ident" and self.text(1) == ":" and self.text(2) not in ("=",):
            self.i += 2
            return self.statement(stop) if self.i < stop and self.text() not in ("}", ";") else Stmt("simple", first.line, first.line, [first])
        if word in ("if", "for", "switch", "select"):
            self.i += 1
            head = self.head()
            if word in ("switch", "select"):
                body = self.cases()
            else:
                body = self.block()
            node = Stmt(word, first.line, self.t[min(self.i, len(self.t)) - 1].line, head, body)
            if word == "if" and self.text() == "else":
                self.i += 1
                node.other = [self.statement(stop)]
                node.end_line = node.other[0].end_line
            return node
        start = self.i
        self.until(";")
        self.i = min(max(self.i, start + 1), stop)
        tokens = self.t[start : self.i]
        return Stmt(word if word in ("return", "go", "defer") else "simple", first.line, tokens[-1].end_line, tokens)

    def cases(self) -> list[Stmt]:
        stop = self.close(self.i)
        self.i += 1
        out = []
        while self.i < stop:
            x = self.t[self.i]
            if x.text in ("case", "default"):
                self.i += 1
                head = self.until(":")
                self.i += 1
                begin = self.i
                body = []
                while self.i < stop and self.text() not in ("case", "default"):
                    if self.text() == ";":
                        self.i += 1
                        continue
                    at = self.i
                    body.append(self.statement(stop))
                    if self.i == at:
                        self.i += 1
                last = self.t[max(begin, self.i) - 1]
                out.append(Stmt("case", x.line, last.end_line, head, body))
            else:
                self.i += 1
        self.i = stop + 1
        return out


def parse(source: str) -> File:
    return Parser(source).parse()


def walk(stmts: list[Stmt]):
    for s in stmts:
        yield s
        yield from walk(s.body)
        yield from walk(s.other)


def complexity(stmts: list[Stmt]) -> int:
    """AG-2 without the 1: if and for count 1, switch and select 2; function literals aren't entered."""
    return sum({"if": 1, "for": 1, "switch": 2, "select": 2}.get(s.kind, 0) for s in walk(stmts))


def literals(tokens: list[Token]) -> list[list[Stmt]]:
    """The bodies of the function literals among tokens (of each, parsed on its own)."""
    out, k = [], 0
    while k < len(tokens):
        if tokens[k].text == "func" and tokens[k].kind == "keyword":
            p = Parser("")
            p.t = tokens
            p.i = k + 1
            while p.i < len(tokens) and p.text() != "{":
                if p.text() in ("(", "["):
                    p.i = p.close(p.i)
                elif p.text() in ("struct", "interface") and p.text(1) == "{":
                    p.i = p.close(p.i + 1)
                p.i += 1
            if p.i < len(tokens):
                out.append(p.block())
                k = p.i
                continue
        k += 1
    return out


def nesting(stmts: list[Stmt]) -> int:
    """AG-2b: the deepest nest of control structures, function literals included; an else-if is one deeper."""
    most = 0
    for s in stmts:
        own = 1 if s.kind in CONTROL else 0
        inner = max([nesting(s.body), nesting(s.other), *(nesting(b) for b in literals(s.head))])
        most = max(most, own + inner)
    return most


def every(stmts: list[Stmt]):
    """All statements, those in function literals too."""
    for s in walk(stmts):
        yield s
        for b in literals(s.head):
            yield from every(b)


def error_paths(stmts: list[Stmt]) -> int:
    """AG-2b: ifs whose first statement returns."""
    return sum(s.kind == "if" and bool(s.body) and s.body[0].kind == "return" for s in every(stmts))


def literal_lines(stmts: list[Stmt]) -> int:
    """AG-2b: distinct lines of composite literals and multi-line strings. A brace among a statement's own
    tokens opens a literal unless it is a type's or a function literal's."""
    lines: set[int] = set()
    for s in every(stmts):
        p = Parser("")
        p.t = s.head
        k = 0
        while k < len(s.head):
            t = s.head[k]
            if t.kind == "string" and t.end_line > t.line:
                lines.update(range(t.line, t.end_line + 1))
            if t.kind == "keyword" and t.text == "func":
                while k < len(s.head) and s.head[k].text != "{":
                    k = p.close(k) if s.head[k].text in ("(", "[") else k
                    k += 1
                k = p.close(k) if k < len(s.head) else k
            elif t.text == "{" and t.kind == "op" and k and s.head[k - 1].text not in ("struct", "interface"):
                lines.update(range(t.line, s.head[p.close(k)].line + 1))
            k += 1
    return len(lines)


def dispatch(func: Func) -> dict | None:
    """AG-2c: a function's top-level switches scored by their worst case alone."""
    found = [s for s in func.body or () if s.kind == "switch" and s.body and not any(any(t.text == "fallthrough" for t in x.head) for c in s.body for x in walk(c.body))]
    if not found:
        return None
    out = {"cases": 0, "worst_complexity": 0, "worst_lines": 0, "normalized": 1 + complexity(func.body), "line_discount": 0}
    for s in found:
        worst = max((complexity(c.body) for c in s.body), default=0)
        lines = max((c.body[-1].end_line - c.body[0].line + 1 if c.body else 0 for c in s.body), default=0)
        out["cases"] += len(s.body)
        out["worst_complexity"] = max(out["worst_complexity"], worst)
        out["worst_lines"] = max(out["worst_lines"], lines)
        out["normalized"] += 2 + worst - complexity([s])
        out["line_discount"] += max(0, s.end_line - s.line + 1 - 2 - lines)
    return out


def calls(tokens: list[Token]) -> list[tuple[int, int, str, str, bool, list[str]]]:
    """Calls among tokens: line, column, callee text, its last name, whether it is a selector, and the
    arguments that are plain identifiers."""
    out = []
    for k in range(1, len(tokens)):
        if tokens[k].text != "(" or tokens[k].kind != "op" or tokens[k - 1].kind != "ident":
            continue
        j = k - 1
        while j >= 2 and tokens[j - 1].text == "." and (tokens[j - 2].kind == "ident" or tokens[j - 2].text in (")", "]")):
            j -= 2
            if tokens[j].kind != "ident":
                break
        if j >= 1 and tokens[j - 1].text == "func":
            continue
        args, depth, m, piece = [], 0, k + 1, []
        while m < len(tokens):
            x = tokens[m]
            if x.kind == "op" and x.text in PAIRS:
                depth += 1
            elif x.kind == "op" and x.text in (")", "]", "}"):
                if depth == 0:
                    break
                depth -= 1
            if depth == 0 and x.text == "," and x.kind == "op":
                args.append(piece)
                piece = []
            elif x.text != ";":
                piece.append(x)
            m += 1
        args.append(piece)
        plain = [a[0].text if len(a) == 1 and a[0].kind == "ident" else "" for a in args if a]
        out.append((tokens[j].line, tokens[j].col, joined(tokens[j:k]), tokens[k - 1].text, j < k - 1, plain))
    return out
