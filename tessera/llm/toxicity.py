"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become the symbols insult, threat, target, negator, report or other; insults are accepted by a
prefix tree whose weights come from labelled documents. Five transducers read a clause's symbols one after
another: *insult* writes an event for an insulting word, *threat* for a threatening verb that a person
follows, *target* marks events near a person, *negation* those that follow a negator closely, *report*
those that follow a verb of speech. A sixth keeps the strongest event of a clause and writes it at the
clause's end. Their composition is one deterministic machine with weights on its outputs: a document is
scored on the clauses it matched and the weights of their paths, never on words alone.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, arrow_filter, arrow_map, text_or_empty

# Small closed word lists of English, German, French and Spanish.
INSULTS = "idiot stupid moron scum loser worthless pathetic disgusting trash clown".split()
THREATS = "kill murder hurt destroy shoot stab beat töten umbringen tuer frapper matar golpear".split()
TARGETS = "you your yours u he she they him her them people du dich dir ihr euch sie tu toi vous te usted ustedes ellos".split()
NEGATORS = "not no never isn aren don nicht kein keine nie pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says wrote claimed quoted reported called sagte schrieb behauptete dit écrit dijo escribió".split()

OTHER, INSULT, THREAT, TARGET, NEGATOR, REPORT, END = range(7)
CLASSES = ("insult", "targeted_insult", "negated_insult", "reported_insult", "threat", "targeted_threat", "negated_threat", "reported_threat")
#: Of two events of a clause the one that stands first here is the clause's class.
STRENGTH = ("targeted_insult", "insult", "targeted_threat", "threat", "negated_insult", "reported_insult", "negated_threat", "reported_threat")
#: Prior weights of the clause classes, by any and by logarithm of their number, of the logarithm of the insults'
#: weights together, and of no clause at all.
PRIOR_ANY = np.array([3.0, 4.0, 1.0, 0.5, 0.3, 2.0, 0.0, 0.0])
PRIOR_MANY = np.array([1.5, 1.5, 0.5, 0.3, 0.1, 1.0, 0.0, 0.0])
PRIOR_WEIGHT = 0.5
PRIOR_NONE = -3.0
_token = re.compile(r"\w+|[.!?;\n]")


class Transducer:
    """Deterministic: ``step(state, symbol) -> (state, symbol)``. A symbol is (kind, event, marks); an event is
    "insult", "threat" or, where nothing was found, "". After a clause's end the state is the start again."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def __matmul__(self, then: Transducer) -> Transducer:
        """Composition: what this one writes, ``then`` reads."""

        def step(state, symbol):
            a, symbol = self.step(state[0], symbol)
            b, symbol = then.step(state[1], symbol)
            return (a, b), symbol

        return Transducer((self.start, then.start), step)


def insult() -> Transducer:
    """An insulting word is an event."""
    return Transducer(0, lambda state, symbol: (0, (symbol[0], "insult", symbol[2]) if symbol[0] == INSULT else symbol))


def threat(reach: int) -> Transducer:
    """A threatening verb and a person within ``reach`` symbols after it are an event, at the person."""

    def step(state, symbol):
        kind, event, marks = symbol
        if kind == THREAT:
            return reach, symbol
        if kind == TARGET and state:
            return 0, (kind, "threat", marks)
        return (0 if kind == END else max(0, state - 1)), symbol

    return Transducer(0, step)


def near(trigger: int, mark: str, reach: int) -> Transducer:
    """Marks events within ``reach`` symbols after a trigger. A threat's own person is no trigger for it."""

    def step(state, symbol):
        kind, event, marks = symbol
        marked = (kind, event, marks | {mark}) if event and state else symbol
        return (0 if kind == END else reach if kind == trigger else max(0, state - 1)), marked

    return Transducer(0, step)


def rest_of_clause(trigger: int, mark: str) -> Transducer:
    """Marks events after a trigger up to the clause's end."""

    def step(state, symbol):
        kind, event, marks = symbol
        marked = (kind, event, marks | {mark}) if event and state else symbol
        return (0 if kind == END else 1 if kind == trigger else state), marked

    return Transducer(0, step)


def strongest() -> Transducer:
    """Keeps a clause's strongest event and writes it, as the only mark, at the clause's end."""

    def step(state, symbol):
        kind, event, marks = symbol
        if kind == END:
            return "", (kind, "clause" if state else "", frozenset({state} if state else ()))
        if event:
            mark = next((m for m in ("reported", "negated", "targeted") if m in marks), "")
            name = (mark + "_" if mark else "") + event
            state = min((x for x in (state, name) if x), key=STRENGTH.index)
        return state, (kind, "", frozenset())

    return Transducer("", step)


def grammar() -> Transducer:
    return insult() @ threat(3) @ near(TARGET, "targeted", 4) @ near(NEGATOR, "negated", 3) @ rest_of_clause(REPORT, "reported") @ strongest()


@functools.cache
def machine() -> list[list[tuple[int, int]]]:
    """The composed grammar as a table: by state and symbol the next state, and the class of a clause that ends
    there, or -1."""
    whole = grammar()
    numbers, states, table = {whole.start: 0}, [whole.start], []
    for state in states:
        row = []
        for kind in range(7):
            then, (_, event, marks) = whole.step(state, (kind, "", frozenset()))
            if then not in numbers:
                numbers[then] = len(states)
                states.append(then)
            row.append((numbers[then], CLASSES.index(*marks) if event == "clause" else -1))
        table.append(row)
    return table


class Lexicon:
    """Symbols of words. ``insults`` maps beginnings, or whole words after ``=``, to positive weights; they are
    held as a prefix tree of characters."""

    def __init__(self, insults: dict[str, float]):
        self.tree: dict = {}
        for key, weight in insults.items():
            node = self.tree
            for c in key.removeprefix("="):
                node = node.setdefault(c, {})
            which = "whole" if key[0] == "=" else "begins"
            node[which] = max(weight, node.get(which, 0.0))
        fixed = ((TARGETS, TARGET), (NEGATORS, NEGATOR), (REPORTS, REPORT), (THREATS, THREAT))
        self.fixed = {w: kind for words, kind in fixed for w in words} | dict.fromkeys(".!?;\n", END)
        self.memo: dict[str, tuple[int, float]] = {}

    def weight(self, word: str) -> float:
        """The greatest weight of what the tree accepts of a word; 0 if nothing."""
        node, best = self.tree, 0.0
        for c in word:
            node = node.get(c)
            if node is None:
                return best
            best = max(best, node.get("begins", 0.0))
        return max(best, node.get("whole", 0.0))

    def symbol(self, word: str) -> tuple[int, float]:
        got = self.memo.get(word)
        if got is None:
            weight = self.weight(word)
            got = (INSULT, weight) if weight else (self.fixed.get(word, OTHER), 0.0)
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[word] = got
        return got

    def features(self, text: str) -> np.ndarray:
        """Clauses of each class: whether there are any, and the logarithm of 1 + their number; the logarithm of
        1 + the weights of clauses that are neither negated nor reported, a clause's weight being the sum over
        its path. A clause whose strongest insult weighs under STRONG counts by its weight only."""
        counts, total = np.zeros(len(CLASSES)), 0.0
        symbol, known = self.symbol, self.memo.get
        read = [known(w) or symbol(w) for w in _token.findall(text.lower())]
        if any(kind in (INSULT, THREAT) for kind, _ in read):
            table, state, best, path = machine(), 0, 0.0, 0.0
            for kind, weight in (*read, (END, 0.0)):
                state, out = table[state][kind]
                best, path = max(best, weight), path + weight
                if out >= 0:
                    counts[out] += out > 3 or best >= STRONG
                    if out < 2:
                        total += path
                if kind == END:
                    best = path = 0.0
        return np.concatenate((counts > 0, np.log1p(counts), [np.log1p(total)]))


MEMO_WORDS = 200_000
#: The weight from which one insult tells by itself: nine in ten rows that hold it are toxic.
STRONG = math.log(9)


def prefixes(text: str) -> set[str]:
    words = set(re.findall(r"\w+", text.lower()))
    return {w[:n] for w in words for n in range(4, 9) if n < len(w)} | {"=" + w for w in words}


def sketch(text: str) -> int:
    """The least hash of a text's three-word shingles: equal for most near copies."""
    import xxhash

    words = text.lower().split()
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 7) for i in range(max(1, len(words) - 2))), default=0) >> 1


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton's method, drawn towards ``prior``."""
    x = np.column_stack((x, np.ones(len(x))))
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * (w - prior)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


PRIOR = np.concatenate((PRIOR_ANY, PRIOR_MANY, [PRIOR_WEIGHT, PRIOR_NONE]))


def train(spark: SparkSession, labelled: DataFrame, *, sample_rows: int = 20_000, least_share: float = 0.02, least_rows: float = 5.0, purity: float = 0.7) -> tuple[dict[str, float], np.ndarray]:
    """(insult weights, class weights) from ``doc_id, text, label``.

    A sample of about ``sample_rows`` labelled rows, chosen by hash of the id, bounds what is learned
    from; with no labelled rows of both kinds the built-in lists and prior weights stay. Near copies
    (rows of one sketch) count as one row together. A prefix or word becomes an insult if toxic rows of
    the weight of ``least_rows`` and ``least_share`` of all toxic rows hold it, and ``purity`` of the rows
    that hold it are toxic; its weight is the logarithm of the odds. Of prefixes that the same rows hold the
    longest is taken.
    """
    insults, weights = {"=" + w: 3.0 for w in INSULTS}, PRIOR
    total = labelled.count()
    if not total:
        return insults, weights
    cut = int((1 << 30) * min(1.0, sample_rows / total))
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < cut)
    marked = arrow_map(sample.select("label", "text"), lambda: lambda label, text: {"label": label, "sketch": [sketch(t) for t in text]}, "label int, sketch bigint").collect()  # two numbers a sampled row
    copies = Counter((r.label, r.sketch) for r in marked)
    shared = spark.sparkContext.broadcast(copies)
    toxic = sum(1 / copies[(r.label, r.sketch)] for r in marked if r.label == 1)
    if not toxic or toxic == len(copies):
        return insults, weights

    def held(label: int, among: frozenset | None):
        def make():
            def work(texts):
                out: dict[str, float] = defaultdict(float)
                for t in texts:
                    share = 1 / shared.value[(label, sketch(t))]
                    for p in prefixes(t) if among is None else among.intersection(prefixes(t)):
                        out[p] += share
                return {"prefix": list(out), "n": list(out.values())}

            return work

        return arrow_map(sample.filter(F.col("label") == label).select("text"), make, "prefix string, n double").groupBy("prefix").agg(F.sum("n").alias("n"))

    least = max(least_rows, least_share * toxic) - 1e-9
    good = {r.prefix: r.n for r in held(1, None).filter(F.col("n") >= least).collect()}  # at most 40 a word of a typical text
    bad = {r.prefix: r.n for r in held(0, frozenset(good)).collect()}
    pure = {p: n for p, n in good.items() if n >= purity * (n + bad.get(p, 0.0))}
    chosen = {}
    for p, n in pure.items():
        plain = p.lstrip("=")
        longer = [q for q in pure if q != p and p[0] != "=" and q.lstrip("=").startswith(plain) and pure[q] >= 0.97 * n]
        wider = [q for q in pure if q != p and q[0] != "=" and plain.startswith(q) and pure[p] < 0.97 * pure[q]]
        if not longer and not wider:
            chosen[p] = math.log((n + 0.5) / (bad.get(p, 0.0) + 0.5))
    if chosen:
        insults = insults | chosen
    lexicon = spark.sparkContext.broadcast(insults)

    def measured():
        words = Lexicon(lexicon.value)
        return lambda label, texts: {"label": label, "sketch": [sketch(t) for t in texts], "x": [words.features(t).tolist() for t in texts]}

    rows = arrow_map(sample.select("label", "text"), measured, "label int, sketch bigint, x array<double>").groupBy("label", "x").agg(F.collect_set("sketch").alias("sketches")).collect()
    x, y, weight = [], [], []
    for r in rows:
        x.append(r.x)
        y.append(r.label)
        weight.append(float(len(r.sketches)))
    return insults, fit(np.array(x), np.array(y, float), np.array(weight), PRIOR)


def toxicity(spark: SparkSession, docs: DataFrame, model: tuple[dict[str, float], np.ndarray], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, n_clauses`` of each row: score 0 to 1, and how many clauses of each class matched.

    A null or empty text has the score of a text without any clause. Null and repeated ids are carried;
    other columns, whatever their names, are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    shared = spark.sparkContext.broadcast(model)

    def make():
        insults, weights = shared.value
        words = Lexicon(insults)

        def work(ids, texts):
            x = np.array([words.features(t) for t in texts])
            n = np.expm1(x[:, len(CLASSES) : 2 * len(CLASSES)]).round().astype(np.int64)
            return {"doc_id": ids, "score": score(x, weights).tolist(), "n_clauses": n.sum(axis=1).tolist()}

        return work

    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), make, f"doc_id {kind}, score double, n_clauses bigint")


def under(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], threshold: float, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is under ``threshold``; rows stay where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        insults, weights = shared.value
        words = Lexicon(insults)
        return lambda texts: [bool(score(words.features(t), weights) < threshold) for t in texts]

    return arrow_filter(docs, text_col, make)


def score(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id's text modulo 3 is 1."""
    return F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 3 == 1


def train_on(spark: SparkSession, docs: DataFrame, labels: DataFrame, **options) -> tuple[dict[str, float], np.ndarray]:
    """``train`` on the documents that ``labels`` (doc_id, toxic) marks and that aren't held out.

    The labels of the sample are broadcast (two numbers a row, bounded by ``sample_rows``) so that the
    texts of all other documents stay where they are. Null labels and ids are skipped; an id with both
    labels counts as toxic.
    """
    rows = options.get("sample_rows", 20_000)
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    total = max(1, known.count())
    picked = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("pick")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, rows / total)))
    texts = docs.select("doc_id", text_or_empty("text").alias("text")).join(F.broadcast(picked), "doc_id")
    return train(spark, Scratch(spark).table(texts), **options)
