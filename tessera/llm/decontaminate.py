"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

All n-grams of the test items are the seeds. A document that holds a seed of an item is aligned with the
item word by word around the seeds, so a copy with changed, dropped or added words still scores. Common
n-grams are seeds too: an edited copy may share no others. Where a passage has too few of an item's words
to reach the score, the alignment is left out.
"""

from __future__ import annotations

import re
from collections import defaultdict
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_filter, arrow_map, text_or_empty

_word = re.compile(r"\w+")
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0


def words_of(text: str) -> list[str]:
    return _word.findall(text.lower())


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of two arrays of word numbers: (score, start, stop) in ``passage``.

    Match 2, mismatch -1, gap -1. Rows are vectors; a gap along a row is a running maximum. Ties go to
    the alignment that ends first.
    """
    n = len(passage)
    row, origin = np.zeros(n + 1), np.arange(n + 1)
    steps = np.arange(n + 1) * -GAP
    best, stop, start = 0.0, 0, 0
    for word in item:
        diagonal = row[:-1] + np.where(passage == word, MATCH, MISMATCH)
        up = row[1:] + GAP
        cell = np.concatenate(([0.0], np.maximum(np.maximum(diagonal, up), 0.0)))
        came = np.concatenate(([0], np.where(diagonal >= up, origin[:-1], origin[1:])))
        fresh = cell <= 0
        came[fresh] = np.flatnonzero(fresh)
        lifted = cell + steps
        top = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted >= top, np.arange(n + 1), 0))
        row, origin = top - steps, came[at]
        k = int(row.argmax())
        if row[k] > best:
            best, stop, start = float(row[k]), k, int(origin[k])
    return best, start, stop


def most_matches(words: np.ndarray, counts: np.ndarray, passage: np.ndarray) -> int:
    """At most so many words of an item can match in a passage; an item's distinct words are sorted."""
    at = np.minimum(np.searchsorted(words, passage), len(words) - 1)
    return int(np.minimum(np.bincount(at[words[at] == passage], minlength=len(words)), counts).sum())


def decontaminate(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    gram: int = 4,
    least_score: float = 0.5,
    least_words: int = 8,
    block_words: int = 500_000,
) -> DataFrame:
    """``doc_id, item_id, score, first_word, last_word, n_seeds`` of each document that holds an item.

    ``score`` is the alignment's score over the score of the whole item, from ``least_score`` to 1;
    words are runs of letters, digits and underscores in lower case, numbered from 0. Items of under
    ``least_words`` words count only where they stand word for word (score 1); items without any word
    are nowhere. Repeated rows give repeated results; null ids are carried, and null and empty texts hold
    nothing. Ties between places go to the first. Other columns are not read.

    Items are a query set that is read in blocks of ``block_words`` words, each block against all
    documents, so what a task holds of the items is bounded however many there are.
    """
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = None
    for block in _blocks(benchmark, item_col, item_text_col, block_words):
        one = _block(texts, spark.sparkContext.broadcast(block), kind, item_kind, Limits(gram, least_score, least_words))
        found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], f"doc_id {kind}, item_id {item_kind}, score double, first_word bigint, last_word bigint, n_seeds bigint")
    return found


def without_items(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    gram: int = 4,
    least_score: float = 0.5,
    least_words: int = 8,
    block_words: int = 500_000,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item; rows stay where they are."""
    for block in _blocks(benchmark, item_col, item_text_col, block_words):
        shared, limits = spark.sparkContext.broadcast(block), Limits(gram, least_score, least_words)

        def make(shared=shared, limits=limits):
            items = Items([words for _, words in shared.value], limits)
            return lambda texts: [not items.found(words_of(t)) for t in texts]

        docs = arrow_filter(docs, text_col, make)
    return docs


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int):
    """Blocks of (item, words), one in memory at a time."""
    block: list[tuple] = []
    size = 0
    for row in benchmark.select(F.col(item_col).alias("item"), text_or_empty(text_col).alias("text")).toLocalIterator(prefetchPartitions=False):
        words = words_of(row.text)
        if not words:
            continue
        if block and size + len(words) > most:
            yield block
            block, size = [], 0
        block.append((row.item, words))
        size += len(words)
    if block:
        yield block


class Limits(NamedTuple):
    gram: int
    least_score: float
    least_words: int


class Items:
    """A block of test items, sought in documents."""

    def __init__(self, items: list[list[str]], limits: Limits):
        self.limits = limits
        self.number: dict[str, int] = {}
        self.coded = [np.array([self.number.setdefault(w, len(self.number)) for w in words]) for words in items]
        self.sought = [np.unique(c, return_counts=True) for c in self.coded]
        #: By length of a seed: the items that hold it and where; an item shorter than a gram is one seed.
        self.seeds: dict[int, dict[tuple, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, words in enumerate(items):
            n = min(limits.gram, len(words))
            for at, g in enumerate(zip(*(words[j:] for j in range(n)), strict=False)):
                self.seeds[n][g].append((k, at))
        self.keys = {n: set(seeds) for n, seeds in self.seeds.items()}
        self.memo: dict[tuple, tuple] = {}

    def found(self, words: list[str]) -> list[tuple[int, float, int, int, int]]:
        """(item, score, first word, last word, seeds) of the items that these words hold."""
        hits = defaultdict(list)
        for n, keys in self.keys.items():
            if keys.isdisjoint(zip(*(words[j:] for j in range(n)), strict=False)):
                continue
            for at, g in enumerate(zip(*(words[j:] for j in range(n)), strict=False)):
                for k, place in self.seeds[n].get(g, ()):
                    hits[k].append(at - place)
        if not hits:
            return []
        passage = np.array([self.number.get(w, -1) for w in words])
        out = []
        for k, starts in hits.items():
            n, best = len(self.coded[k]), self.aligned(k, passage, sorted(starts))
            share = best[0] / (MATCH * n)
            if share >= (self.limits.least_score if n >= self.limits.least_words else 1.0):
                out.append((k, share, best[1], best[2], len(starts)))
        return out

    def aligned(self, k: int, passage: np.ndarray, starts: list[int]) -> tuple[float, int, int]:
        """The best alignment of an item around its seeds; seeds whose windows overlap share one."""
        item = self.coded[k]
        slack = len(item) // 2 + 4
        best, at = (0.0, 0, 0), 0
        while at < len(starts):
            low = high = starts[at]
            while at < len(starts) and starts[at] <= high + slack:
                high = starts[at]
                at += 1
            low, high = max(0, low - slack), min(len(passage), high + len(item) + slack)
            if most_matches(*self.sought[k], passage[low:high]) < self.limits.least_score * len(item):
                continue
            key = (k, passage[low:high].tobytes())
            if key not in self.memo:
                if len(self.memo) > 20_000:
                    self.memo.clear()
                self.memo[key] = smith_waterman(item, passage[low:high])
            score, first, last = self.memo[key]
            if score > best[0]:
                best = (score, low + first, low + last - 1)
        return best


def _block(texts: DataFrame, shared, kind: str, item_kind: str, limits: Limits) -> DataFrame:
    names = ("doc_id", "item_id", "score", "first_word", "last_word", "n_seeds")

    def align():
        items = Items([words for _, words in shared.value], limits)

        def work(ids, texts):
            out = [(doc, shared.value[k][0], *rest) for doc, text in zip(ids, texts, strict=True) for k, *rest in items.found(words_of(text))]
            return dict(zip(names, zip(*out, strict=True) if out else [[]] * 6, strict=True))

        return work

    return arrow_map(texts, align, f"doc_id {kind}, item_id {item_kind}, score double, first_word bigint, last_word bigint, n_seeds bigint")
