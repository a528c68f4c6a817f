"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, keeping, text_or_empty
from tessera.llm.pieces import BPE, Memo, Pieces, load


def count_segment(segment: str, pieces: Pieces) -> int:
    """Tokens of one segment: its symbols minus the merges made.

    Symbols are characters in a doubly linked list; the heap holds adjacent pairs by rank, then
    position, as one integer that also tells the pair's length.
    The pair of lowest rank is popped and merged, then the pairs it forms with its neighbours are
    pushed; a popped pair whose symbols have changed since is stale and skipped. A character outside
    the vocabulary never merges and counts its UTF-8 bytes. No ids are made.
    """
    size = count = len(segment)
    if not pieces.chars.issuperset(segment):
        count = sum(1 if c in pieces.chars else len(c.encode()) for c in segment)
    rank_of, long = pieces.ranks.get, pieces.longest + 1
    heap = [(rank * size + i) * long + 2 for i, rank in enumerate(map(rank_of, map(add, segment, segment[1:]))) if rank is not None]
    if not heap:
        return count
    heapify(heap)
    end = list(range(1, size + 1))  # end[i]: where the symbol that starts at i ends; 0 once merged away
    before = list(range(-1, size))  # start of the symbol before the one at i
    while heap:
        key, length = divmod(heappop(heap), long)
        i = key % size
        stop = i + length
        mid = end[i]
        if not mid or mid >= stop or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        count -= 1
        if stop < size:
            before[stop] = i
            wide = end[stop]
            rank = rank_of(segment[i:wide])
            if rank is not None:
                heappush(heap, (rank * size + i) * long + wide - i)
        if i:
            left = before[i]
            rank = rank_of(segment[left:stop])
            if rank is not None:
                heappush(heap, (rank * size + left) * long + stop - left)
    return count


#: Counts take little beside their words, and working one out takes long.
MEMO_BYTES = 224 << 20


def counter(model: bytes) -> Memo:
    store = keeping("token counts")
    if model not in store:
        pieces = load(model)
        if pieces.kind != BPE:
            raise ValueError("merging needs a byte-pair model")
        store[model] = Memo(pieces, lambda new: [count_segment(s, pieces) for s in new], sum, MEMO_BYTES)
    return store[model]


def token_counts(spark: SparkSession, docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit``.

    Counts are those of the sentencepiece library without begin or end tokens; special strings in a
    text are ordinary text. A null text is empty, and an empty text has 0 tokens. Null or repeated ids
    are carried as they are, one result each. Other columns, whatever their names, are not read.
    The model file is read by the driver and broadcast (its size is that of the vocabulary).
    """
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    kind = dict(docs.dtypes)[id_col]

    def make():
        counts = counter(model.value).results

        def work(ids, texts):
            values, index, starts = counts(texts)
            sums = np.concatenate(([0], np.cumsum(np.array(values, np.int64)[index])))
            n = np.diff(sums[starts])
            return {"doc_id": ids, "n_bytes": pc.binary_length(texts), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)}

        return work

    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), make, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean", "token counts", arrays=True)
