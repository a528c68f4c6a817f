"""SimHash near-duplicates by anchor-point covering.

Fingerprints are compared only where they meet at an anchor. Anchors are the words of a covering code:
each block of, say, 32 bits is a word of the binary Golay code of length 23 (every 23-bit word lies
within distance 3 of exactly one code word) beside 9 free bits, so every block lies within the covering
radius R = 3 of an anchor.

No link is lost: two 64-bit fingerprints that differ in at most 4 bits differ in at most 2 bits of one
of their two blocks. Half way between these two blocks lies a word within 1 bit of both, whose anchor is
within R + 1 of both. So each fingerprint goes to every anchor within the covering radius plus half the
block's threshold, about 14 a block, and any linked pair shares one of them.

Wide fingerprints (``words`` of 64 bits) let the distance estimate a similarity: of texts whose shingles
have cosine c, each bit differs with chance acos(c) / pi. ``bits_for`` gives the threshold for a Jaccard
similarity. There the covering guarantee holds for up to 3 * blocks - 1 differing bits; farther pairs
meet with high chance, and a group is joined by any of its pairs.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.shipping import ship
from tessera.llm.common import Scratch, arrow_map, components, text_or_empty

GOLAY = 23
#: Generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
_words = re.compile(r"[^\x20\x09-\x0D]+")
_lower = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def shingles(text: str, size: int) -> list[bytes]:
    """Word shingles of ``text`` with A-Z lower-cased, repeats included; one of all words if they are fewer."""
    words = [w.encode() for w in _words.findall(text.translate(_lower))]
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = (starts + lengths)[size - 1 :].tolist()
    return [line[a:b] for a, b in zip(starts.tolist(), ends, strict=False)]


def shingle_hashes(text: str, size: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in shingles(text, size)), np.uint64)


def bit_majority(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 if it is set in over half the hashes; 0 without hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).astype(np.float32).sum(axis=0).astype(np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">u8")[0])


def widened(hashes: np.ndarray, words: int) -> list[int]:
    """``words`` fingerprints of 64 bits from independent mixes of the same hashes, for wide fingerprints."""
    out = [bit_majority(hashes)]
    for k in range(1, words):
        x = hashes + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(bit_majority(x ^ (x >> np.uint64(31))))
    return out


@functools.cache
def golay_cosets() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error words of weight up to 4, padded with -1, and their weights."""
    bits = np.arange(GOLAY)

    def syndrome(word: int) -> int:
        for at in range(GOLAY - 1, 10, -1):
            if word >> at & 1:
                word ^= GENERATOR << (at - 11)
        return word

    unit = [syndrome(1 << int(b)) for b in bits]
    rows: list[list[tuple[int, int]]] = [[] for _ in range(2048)]
    stack = [(0, 0, 0, 0)]
    while stack:
        word, syn, weight, start = stack.pop()
        rows[syn].append((word, weight))
        if weight < 4:
            stack += [(word | 1 << b, syn ^ unit[b], weight + 1, b + 1) for b in range(start, GOLAY)]
    width = max(map(len, rows))
    table = np.full((2048, width), -1, np.int64)
    weights = np.full((2048, width), 9, np.int64)
    for s, row in enumerate(rows):
        for k, (word, weight) in enumerate(sorted(row, key=lambda x: x[1])):
            table[s, k], weights[s, k] = word, weight
    return table, weights


@functools.cache
def golay_syndromes() -> np.ndarray:
    """The syndrome of each 23-bit word, by halves of 12 and 11 bits."""
    unit = []
    for b in range(GOLAY):
        word = 1 << b
        for at in range(GOLAY - 1, 10, -1):
            if word >> at & 1:
                word ^= GENERATOR << (at - 11)
        unit.append(word)
    low, high = np.zeros(4096, np.int64), np.zeros(2048, np.int64)
    for b in range(12):
        low ^= np.where(np.arange(4096) >> b & 1, unit[b], 0)
    for b in range(11):
        high ^= np.where(np.arange(2048) >> b & 1, unit[b + 12], 0)
    return np.concatenate((low, high))


def anchors(blocks: np.ndarray, place: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of words of 23 + ``free`` bits: every anchor within the covering radius plus 1.

    ``place`` numbers the block, so that blocks at different places never meet.
    """
    errors, weights = golay_cosets()
    syn = golay_syndromes()
    head, tail, tag = blocks >> free, blocks & ((1 << free) - 1), place.astype(np.int64) << (GOLAY + free)
    s = syn[head & 4095] ^ syn[4096 + (head >> 12)]
    rows = np.arange(len(blocks))
    found_rows, found = [], []
    for k in range(errors.shape[1]):
        ok = errors[s, k] >= 0
        found_rows.append(rows[ok])
        found.append((head[ok] ^ errors[s[ok], k]) << free | tail[ok] | tag[ok])
        near = ok & (weights[s, k] <= 3)
        word = (head[near] ^ errors[s[near], k]) << free | tail[near] | tag[near]
        for b in range(free):
            found_rows.append(rows[near])
            found.append(word ^ (1 << b))
    return np.concatenate(found_rows), np.concatenate(found)


def bits_for(jaccard: float, words: int) -> int:
    """The most differing bits, of 64 * ``words``, at which texts count as of this Jaccard similarity: what
    is expected of two texts of equal size, and one standard deviation, as the bits only estimate it."""
    bits, chance = 64 * words, math.acos(2 * jaccard / (1 + jaccard)) / math.pi
    return int(bits * chance + math.sqrt(bits * chance * (1 - chance)))


def forest(values: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges that connect what links at ``most`` differing bits connect: a breadth-first spanning forest.

    ``values`` has a row for each fingerprint and a column for each 64-bit word of it. A fingerprint is
    compared once with those not reached yet, so a tight group costs about its size, not its square.
    """
    edges = []
    values = np.ascontiguousarray(values).view(np.uint64)  # bits of signed numbers are counted by absolute value
    left = np.arange(len(values))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(values[left] ^ values[at]).sum(axis=1, dtype=np.int64) <= most
            if near.any():
                got = left[near].tolist()
                edges += [(at, x) for x in got]
                queue += got
                left = left[~near]
    return edges


def linked(rows: DataFrame, most: int, words: int, free: int) -> DataFrame:
    """Edges ``a, b`` between ids of rows ``id, fp array<bigint>`` that meet at an anchor and differ in
    at most ``most`` bits; within an anchor only a spanning forest, which joins the same components."""
    ship(rows.sparkSession)
    kinds = pa.schema([("anchor", pa.int64()), ("id", pa.int64()), *((f"w{k}", pa.int64()) for k in range(words))])
    fields = ", ".join(f"w{k} bigint" for k in range(words))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                fp = np.stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(words)], axis=1)
                bits = np.unpackbits(fp.astype(">i8").view(np.uint8), axis=1)
                n = bits.shape[1] // (GOLAY + free)
                blocks = bits[:, : n * (GOLAY + free)].reshape(len(ids), n, GOLAY + free) @ (1 << np.arange(GOLAY + free))
                place = np.broadcast_to(np.arange(n), blocks.shape)
                row, anchor = anchors(blocks.reshape(-1), place.reshape(-1), free)
                row = row // n
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(ids[row]), *(pa.array(fp[row, k]) for k in range(words))], schema=kinds)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def close(block: np.ndarray) -> pa.RecordBatch:
            edges = []
            cuts = np.flatnonzero(np.diff(block[:, 0])) + 1
            starts, stops = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(block)]))
            sizes = stops - starts
            few = int(min(16, sizes.max(initial=1)))
            small = np.repeat(sizes <= few, sizes)
            for step in range(1, few):
                one, two = block[:-step], block[step:]
                ok = (one[:, 0] == two[:, 0]) & small[:-step]
                i = np.flatnonzero(ok)
                near = np.bitwise_count((one[i, 2:] ^ two[i, 2:]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= most
                edges.append(np.stack((one[i[near], 1], two[i[near], 1]), axis=1))
            for s, e in zip(starts[sizes > few].tolist(), stops[sizes > few].tolist(), strict=True):
                pairs = np.array(forest(block[s:e, 2:], most), np.int64).reshape(-1, 2)
                edges.append(block[s:e, 1][pairs])
            found = np.unique(np.sort(np.concatenate(edges), axis=1), axis=0) if edges else np.empty((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        for batch in batches:
            part = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            if not len(part):
                continue
            held.append(part)
            if sum(map(len, held)) >= 1 << 17 and part[0, 0] != part[-1, 0]:
                block = np.concatenate(held)
                cut = int(np.searchsorted(block[:, 0], block[-1, 0]))
                yield close(block[:cut])
                held = [block[cut:]]
        if held:
            yield close(np.concatenate(held))

    words_out = [F.col("fp")[k].alias(f"w{k}") for k in range(words)]
    met = rows.select("id", *words_out).mapInArrow(spread, f"anchor bigint, id bigint, {fields}")
    met = met.repartition("anchor").sortWithinPartitions("anchor")
    return met.mapInArrow(compare, "a bigint, b bigint").distinct()


def fingerprints(docs: DataFrame, kind: str, shingle: int, words: int) -> DataFrame:
    def make():
        def work(ids, texts):
            signed = lambda x: x - (1 << 64) if x >> 63 else x
            return {"doc_id": ids, "fp": [[signed(x) for x in widened(shingle_hashes(t, shingle), words)] for t in texts]}

        return work

    return arrow_map(docs, make, f"doc_id {kind}, fp array<bigint>")


def simhash_components(
    spark: SparkSession,
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    most_bits: int = 4,
    words: int = 1,
    free_bits: int = 9,
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, fp array<bigint>, component_id``.

    ``component_id`` is the smallest id reachable over links of at most ``most_bits`` differing bits, null
    where only null ids are. A null text is empty, and empty texts have fingerprint 0 and link like others.
    Ids are integers; null and repeated ones are rows like others. Other columns are not read. Equal
    fingerprints are one row from the first shuffle on, however many documents have them.
    """
    scratch = Scratch(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    fps = scratch.table(fingerprints(texts, dict(docs.dtypes)[id_col], shingle, words))
    distinct = scratch.table(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("id", F.monotonically_increasing_id()))
    label = components(spark, linked(distinct, most_bits, words, free_bits), scratch)
    named = scratch.table(distinct.join(label, distinct.id == label.node, "left").select("fp", "least", F.coalesce("component", "id").alias("part")))
    least = scratch.table(named.groupBy("part").agg(F.min("least").alias("component_id")))
    named = scratch.table(named.join(least, "part").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
