"""Removal of repeated passages with suffix arrays built by induced sorting.

A byte goes when a string of ``length`` bytes that covers it also starts in a document with a smaller id.
Every such string holds an anchor, the gram of least hash in it, so equal strings have equal anchors; the
strings of a document that share an anchor lie in one segment of 50 to 88 bytes. Segments are dealt by
anchor. Of segments that are equal as a whole one document's go on: within a batch equality is settled on
the bytes, beyond it by the segments' own 64-bit hash beside the anchor's 48 bits (two texts around one
anchor that differ have equal hashes with a chance of 2**-64: of all pairs of different segments that share
an anchor, some 10**15 at 100 TB, less than one in ten thousand such corpora has any). What is left are
segments whose anchors agree while their texts differ: the ends of repeated passages. Their bytes are
gathered into shards, and each shard's suffix array and permuted common prefixes show which strings it
holds more than once.

Within a batch of documents, segments that are equal are settled at once and only those of the least
document are sent, so a passage that a third of all documents share is one document's records a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.shipping import ship
from tessera.llm.common import Scratch, text_or_empty
from tessera.llm.suffixes import permuted_prefixes, suffix_array

GRAM = 12
SLICE_BYTES = 1 << 18
BATCH_BYTES = 4 << 20
CELL_RECORDS = 1 << 18
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_BASE = 0xD6E8FEB86659FD93


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done, power = 1, base
    while done < n:
        m = min(done, n - done)
        out[done : done + m] = out[:m] * np.uint64(power)
        power = power * power % 2**64
        done *= 2
    return out


_LOW48 = np.uint64((1 << 48) - 1)
_LETTERS = _mix(np.arange(256, dtype=np.uint64) * _A + np.uint64(7))

_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        _tables["up"] = _powers(_BASE, n)
        _tables["down"] = _powers(pow(_BASE, -1, 2**64), n)
    return _tables["up"], _tables["down"]


def cases(length: int) -> list[tuple[int, int, int, int]]:
    """A string has some bytes left of its anchor and the others right of it. By range of the number on the
    left: (least, most, and the bytes left and right of the anchor that all strings of that range hold)."""
    rest = length - GRAM
    cuts = [0, rest // 4, rest // 2, rest * 3 // 4, rest + 1]
    return [(a, b - 1, a, rest - b + 1) for a, b in zip(cuts, cuts[1:], strict=False)]


RECORD = (("anchor", "<u8"), ("whole", "<u8"), *((f"flank{k}", "<u2") for k in range(4)), ("doc", "<i8"), ("start", "<u8"), ("size", "u1"), ("before", "u1"))


def segments(data: bytes, starts: np.ndarray, stops: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Segments of the texts ``data[start:stop]``: 48 bits of the anchor's hash, the segment's hash, hashes of
    what the strings of each of ``cases`` share (0 where the segment has none of the case), the text's
    number, first byte, byte after the last, how many bytes stand before the anchor, and the first byte's
    place in ``data``."""
    n = len(data)
    raw = np.frombuffer(data, np.uint8)
    grams = n - GRAM + 1
    window = np.empty(0, np.int64)
    if n >= length:
        eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view("<u8").reshape(-1)
        four = eight[8 : 8 + grams] if GRAM == 16 else eight[GRAM - 8 : GRAM - 8 + grams]
        hashes = value = _mix(eight[:grams] * _A + _mix(four))
        place = np.arange(grams, dtype=np.int32)
        size, wide = 1, length - GRAM + 1
        while size < wide:  # the leftmost least hash of each window, by doubling
            step = min(size, wide - size)
            take = value[step:] < value[:-step]
            place = np.where(take, place[step:], place[:-step])
            value = np.where(take, value[step:], value[:-step])
            size += step
        doc = np.repeat(np.arange(len(starts), dtype=np.int32), stops - starts)[: len(place)]
        window = np.flatnonzero(np.arange(len(place)) + length <= stops[doc])
    if not len(window):
        return {k: np.empty(0, t) for k, t in (*RECORD, ("stop", np.int64), ("at", np.int64))}
    place, doc = place[window], doc[window]
    fresh = np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])))
    first = np.flatnonzero(fresh)
    last = np.concatenate((first[1:], [len(window)])) - 1
    anchor, start, stop, doc = place[first].astype(np.int64), window[first], window[last] + length, doc[first].astype(np.int64)
    up, down = _power_tables(n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTERS[raw] * up[:n])))

    def part(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((sums[b] - sums[a]) * down[a])

    out = {"anchor": hashes[anchor] & _LOW48, "whole": part(start, stop) + _mix((anchor - start).astype(np.uint64) * _C + (stop - start).astype(np.uint64))}
    for k, (_, _, left, right) in enumerate(cases(length)):
        a, b = anchor - left, anchor + GRAM + right
        inside = (a >= start) & (b <= stop)
        out[f"flank{k}"] = np.where(inside, (part(np.maximum(a, 0), np.minimum(b, n)) >> np.uint64(48)).astype(np.uint16) | np.uint16(1), np.uint16(0))
    return out | {"doc": doc, "start": start - starts[doc], "stop": stop - starts[doc], "before": (anchor - start).astype(np.uint8), "at": start}


def _planes(x: np.ndarray) -> bytes:
    """Bytes by significance, which compresses far better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplanes(data: memoryview, kind: str, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, n).T).view(kind).reshape(-1)


def _runs(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals by document."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    shift = (int(stop.max()) + 1) * (np.unique(doc, return_inverse=True)[1])
    reach = np.maximum.accumulate(stop + shift)
    fresh = np.concatenate(([True], start[1:] + shift[1:] > reach[:-1]))
    first = np.flatnonzero(fresh)
    last = np.concatenate((first[1:], [len(doc)])) - 1
    return doc[first], start[first], (reach - shift)[last]


def _equal_runs(anchor: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal (anchor, whole) stand together, and where in it a new one begins."""
    order = np.argsort(whole ^ _mix(anchor))
    anchor, whole = anchor[order], whole[order]
    fresh = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])))
    return order, fresh


def _sketch(length: int, cells: int):
    """Batches of (doc, data, base) to rows (cell, records, doc, start, stop): records of a cell's segments
    (doc: their number), or an interval that is settled within the batch (null records). ``base`` is added
    to a text's positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int]] = []
        size = 0
        for batch in batches:
            for doc, text, base in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                if len(data) >= length:
                    held.append((doc, data, base))
                    size += len(data)
                if size >= BATCH_BYTES:
                    yield from close(held)
                    held, size = [], 0
        if held:
            yield from close(held)

    def sliced(held: list[tuple[int, bytes, int]]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
        parts, ids, bases, used = [], [], [], 0
        for doc, data, base in held:
            for at in range(0, max(1, len(data) - length + 1), SLICE_BYTES):  # a long text in slices that overlap by a string less one byte
                piece = data if len(data) <= SLICE_BYTES else data[at : at + SLICE_BYTES + length - 1]
                if parts and used + len(piece) > SLICE_BYTES:
                    yield b"".join(parts), np.array([len(x) for x in parts]), np.array(ids), np.array(bases)
                    parts, ids, bases, used = [], [], [], 0
                parts.append(piece)
                ids.append(doc)
                bases.append(base + at)
                used += len(piece)
        yield b"".join(parts), np.array([len(x) for x in parts]), np.array(ids), np.array(bases)

    def close(held: list[tuple[int, bytes, int]]) -> Iterator[pa.RecordBatch]:
        found, texts, shift = [], [], 0
        for data, lengths, ids, bases in sliced(held):
            stops = np.cumsum(lengths)
            got = segments(data, stops - lengths, stops, length)
            base = bases[got["doc"]]
            found.append(got | {"start": got["start"] + base, "stop": got["stop"] + base, "doc": ids[got["doc"]], "at": got["at"] + shift})
            texts.append(data)
            shift += len(data)
        s = {k: np.concatenate([p[k] for p in found]) for k in found[0]}
        if not len(s["doc"]):
            return
        raw = np.frombuffer(b"".join(texts), np.uint8)
        order, fresh = _equal_runs(s["anchor"], s["whole"])
        fresh = _confirmed(raw, s["at"][order], (s["stop"] - s["start"])[order], fresh)
        doc = s["doc"][order]
        least = np.minimum.reduceat(doc, np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
        gone = order[doc > least]
        a, b, c = _runs(s["doc"][gone], s["start"][gone], s["stop"][gone])
        yield _rows(a % cells, pa.nulls(len(a), pa.binary()), a, b, c)
        keep = order[doc == least]  # all occurrences in the least document: a document of another batch may hold the segment too
        cell = s["anchor"][keep] % np.uint64(cells)
        by = np.argsort(cell, kind="stable")
        keep, cell = keep[by], cell[by].astype(np.int64)
        s["size"] = (s["stop"] - s["start"]).astype(np.uint8)
        columns = [s[k][keep].astype(t) for k, t in RECORD]
        lead = np.flatnonzero(np.diff(cell, prepend=-1))
        stop = np.append(lead[1:], len(cell))
        none = np.zeros(len(lead), np.int64)
        blobs = pa.array([b"".join(_planes(x[i:j]) for x in columns) for i, j in zip(lead.tolist(), stop.tolist(), strict=True)], pa.binary())
        yield _rows(cell[lead], blobs, stop - lead, none, none)

    return run


def _confirmed(raw: np.ndarray, at: np.ndarray, size: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """``fresh`` with a new run also where a segment's bytes differ from those of the one before it."""
    same = np.flatnonzero(~fresh)
    for low in range(0, len(same), 1 << 12):
        k = same[low : low + (1 << 12)]
        wide = int(size[k].max())
        reach = np.arange(wide)
        inside = reach < size[k][:, None]
        one, two = (raw[np.minimum(at[x][:, None] + reach, len(raw) - 1)] for x in (k, k - 1))
        fresh[k] |= (size[k] != size[k - 1]) | ((one != two) & inside).any(axis=1)
    return fresh


ROW = pa.schema([("cell", pa.int64()), ("records", pa.binary()), ("doc", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def _rows(cell: np.ndarray, records: pa.Array, doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), records, *(pa.array(x, pa.int64()) for x in (doc, start, stop))], schema=ROW)


FOUND = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("anchor", pa.int64()), ("crowd", pa.int64()), ("places", pa.list_(pa.int64()))])


def _intervals(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(doc), pa.int64())
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (doc, start, stop)), none, none, pa.nulls(len(doc), FOUND.field("places").type)], schema=FOUND)


def _settle(length: int):
    """Rows sorted by cell to intervals (null anchor) and segments that need their bytes, each once with all
    the places where its document has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        now, size, most = None, 0, CELL_RECORDS
        for batch in batches:
            cell, records = batch.column(0).to_numpy(), batch.column(1)
            plain = records.is_null().to_numpy(zero_copy_only=False)
            if plain.any():
                yield _intervals(*(c.to_numpy() for c in batch.filter(pa.array(plain)).columns[2:]))
            for k in np.flatnonzero(~plain).tolist():
                if cell[k] != now:
                    if held:
                        yield from _settled(_joined(held), length)
                    held, now, size, most = [], cell[k], 0, CELL_RECORDS
                data, at, n = memoryview(records[k].as_buffer()), 0, batch.column(2)[k].as_py()
                one = {}
                for name, kind in RECORD:
                    width = np.dtype(kind).itemsize * n
                    one[name] = _unplanes(data[at : at + width], kind, n)
                    at += width
                held.append(one)
                size += n
                if size >= most:  # a hot anchor: of equal segments only one document's stay in memory
                    s, gone = _lighter(_joined(held))
                    yield _intervals(*gone)
                    held, size = [s], len(s["doc"])
                    most = max(CELL_RECORDS, 2 * size)
        if held:
            yield from _settled(_joined(held), length)

    return run


def _joined(held: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    s = {k: np.concatenate([h[k] for h in held]) for k, _ in RECORD}
    return s | {"start": s["start"].astype(np.int64), "size": s["size"].astype(np.int64)}


def _lighter(s: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of equal segments those of the least document, and the intervals of the others."""
    order, fresh = _equal_runs(s["anchor"], s["whole"])
    doc = s["doc"][order]
    least = np.minimum.reduceat(doc, np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
    gone, keep = order[doc > least], order[doc == least]
    return {k: v[keep] for k, v in s.items()}, _runs(s["doc"][gone], s["start"][gone], s["start"][gone] + s["size"][gone])


def _settled(s: dict[str, np.ndarray], length: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(s["anchor"])
    anchor = s["anchor"][order]
    alone = np.concatenate(([True], anchor[1:] != anchor[:-1])) & np.concatenate((anchor[1:] != anchor[:-1], [True]))
    order = order[~alone]  # an anchor that stands once repeats nothing
    if not len(order):
        return
    s, gone = _lighter({k: v[order] for k, v in s.items()})
    yield _intervals(*gone)
    order = np.lexsort((s["whole"], s["anchor"]))
    s = {k: v[order] for k, v in s.items()}
    group = np.concatenate(([True], s["anchor"][1:] != s["anchor"][:-1]))
    fresh = group | np.concatenate(([True], s["whole"][1:] != s["whole"][:-1]))
    number = np.cumsum(group)[fresh] - 1
    # Strings of a case can only stand in another segment too where what they all hold agrees. All
    # occurrences in the least document go on, cut to the strings of the cases that agree.
    rest, lead, tail = length - GRAM, np.full(len(number), -1), np.zeros(len(number), np.int64)
    for k, (least, most, _, _) in enumerate(cases(length)):
        flank = s[f"flank{k}"][fresh]
        by = np.argsort((number << 16) + flank, kind="stable")
        a, b, c = number[by], flank[by], np.zeros(len(by), bool)
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (b[1:] != 0)
        c[1:] |= same
        c[:-1] |= same
        agrees = np.zeros(len(by), bool)
        agrees[by] = c
        tail = np.where(agrees & (lead < 0), rest - least, tail)
        lead = np.where(agrees, most, lead)
    equal = np.cumsum(fresh) - 1
    place = s["start"] + s["before"]
    first = np.maximum(s["start"], place - lead[equal])
    last = np.minimum(s["start"] + s["size"], place + GRAM + tail[equal])
    need = (lead[equal] >= 0) & (last - first >= length)
    if not need.any():
        return
    begins = np.flatnonzero(np.diff(equal[need], prepend=-1))
    places = pa.ListArray.from_arrays(pa.array(np.append(begins, int(need.sum())), pa.int32()), pa.array(first[need]))
    first, last, at = first[need][begins], last[need][begins], np.flatnonzero(need)[begins]
    crowd = np.unique(number[equal[at]], return_inverse=True, return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.array(s["doc"][at]), pa.array(first), pa.array(last), pa.array(s["anchor"][at].view(np.int64)), pa.array(crowd[2][crowd[1]]), places], schema=FOUND)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(data, base, [(start, stop, anchor, crowd, places)], doc) to rows with the segments' bytes, some
    thousand at a time. Segments of another text of the same document (another base) are passed over."""
    rows: list[tuple] = []
    for batch in batches:
        for text, base, wanted, doc in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            data = memoryview(text.as_buffer())
            for x in wanted.as_py():
                a, b = x["start"] - base, x["stop"] - base
                if a >= 0 and b <= len(data):
                    rows.append((x["anchor"], x["crowd"], doc, x["places"], bytes(data[a:b])))
                if len(rows) >= 1 << 13:
                    yield _cut_rows(rows)
                    rows = []
    if rows:
        yield _cut_rows(rows)


def _cut_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), CUT.types, strict=True)], schema=CUT)


CUT = pa.schema([("anchor", pa.int64()), ("crowd", pa.int64()), ("doc", pa.int64()), ("places", pa.list_(pa.int64())), ("data", pa.binary())])


def _repeated(parts: list[bytes], docs: np.ndarray, places: list[list[int]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals, at each of a part's places, of the strings that another part with a smaller id holds too, by
    the shard's suffix array."""
    sizes = np.array([len(p) for p in parts])
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    begins = np.cumsum(sizes + 1) - sizes - 1
    array = suffix_array(text, 256)
    common = permuted_prefixes(text, array, length)
    part = np.repeat(np.arange(len(parts)), sizes + 1)
    room = np.repeat(begins + sizes, sizes + 1) - np.arange(len(text))  # bytes up to the part's end
    enough = room >= length
    # Strings that are equal stand together; each run's smallest id decides. Suffixes too near a part's
    # end break no run: they take no part in it.
    usable = array[enough[array]]
    position = np.flatnonzero(enough[array])
    if not len(usable):
        return docs[:0], docs[:0], docs[:0]
    # What two neighbours among them have in common is the least over the suffixes up to the latter; those
    # behind the last one are no part of it.
    low = np.minimum.reduceat(common[array[: position[-1] + 1]], np.concatenate(([0], position[:-1] + 1)))
    fresh = np.concatenate(([True], low[1:] < length))
    owner = docs[part[usable]]
    least = np.minimum.reduceat(owner, np.flatnonzero(fresh))
    gone = usable[owner > least[np.cumsum(fresh) - 1]]
    offset = gone - begins[part[gone]]
    owner, a, b = _runs(part[gone], offset, offset + length)
    many = np.array([len(x) for x in places])[owner]
    base = np.array([x for k in owner.tolist() for x in places[k]], np.int64)
    return _runs(np.repeat(docs[owner], many), base + np.repeat(a, many), base + np.repeat(b, many))


def _shard(length: int, most: int):
    """Rows (anchor, doc, places, data) of one shard after another, ``most`` bytes at a time at an anchor's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        docs: list[int] = []
        places: list[list[int]] = []
        size, now = 0, None

        def close() -> pa.RecordBatch:
            doc, a, b = _repeated(parts, np.array(docs), places, length)
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["doc", "start", "stop"])

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                for anchor, doc, place, data in zip(*(c.to_pylist() for c in batch.slice(at, 4096).columns), strict=True):
                    if anchor != now and size >= most:
                        yield close()
                        parts, docs, places, size = [], [], [], 0
                    now = anchor
                    parts.append(data)
                    docs.append(doc)
                    places.append(place)
                    size += len(data)
        if parts:
            yield close()

    return run


def _finish(kept: bool):
    """(doc_id, data, base, gone) to results, some megabytes of kept bytes at a time."""
    kinds = DONE if kept else pa.schema(list(DONE)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for doc, text, base, gone in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                data = memoryview(text.as_buffer())
                spans: list[list[int]] = []
                if gone.is_valid:
                    for a, b in sorted(zip(gone.values.field(0).to_pylist(), gone.values.field(1).to_pylist(), strict=True)):
                        a, b = a - base, b - base
                        if a < 0 or b > len(data):  # of another text of this document
                            continue
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], b)
                        else:
                            spans.append([a, b])
                digest, at, left = hashlib.sha256(), 0, []
                for a, b in [*spans, [len(data), len(data)]]:
                    digest.update(data[at:a])
                    if kept:
                        left.append(data[at:a])
                    at = b
                rows.append((doc, len(data), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), *((b"".join(left),) if kept else ())))
                size += len(data) if kept else 0
                if size >= BATCH_BYTES:
                    yield done(rows)
                    rows, size = [], 0
            if rows:
                yield done(rows)

    def done(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    return run


DONE = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
#: Texts of one document stand so far apart that no position is in two of them.
APART = 1 << 32


def remove_repeats(
    spark: SparkSession,
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 50,
    shard_bytes: int = 1 << 18,
    cell_bytes: int = 2 << 20,
    crowded: int = 4096,
    kept: bool = False,
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, and with
    ``kept`` the bytes that stay in a column of that name.

    Ids are integers. A null text is empty. Rows of one id are texts of one document: they don't remove
    each other's bytes, and each has its own result. A null id is smaller than none and greater than none,
    so nothing is removed from or because of such rows. Other columns are not read. ``length`` is 40 to 130.

    Cells of about ``cell_bytes`` of text are settled one at a time, so that a task's memory doesn't grow
    with the input. An anchor that over ``crowded`` different segments share would be too much for one
    shard; its segments are settled exactly as well, string by string: each string's hash goes to the
    smallest id that has it, with partial minima before the shuffle.
    """
    if not 40 <= length <= 130:
        raise ValueError("length must be 40 to 130")
    ship(spark)
    scratch = Scratch(spark)
    every = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.encode(text_or_empty(text_col), "utf-8").alias("data"))
    texts = every.filter("doc_id IS NOT NULL").withColumn("base", F.lit(0).cast("bigint"))
    again = scratch.table(texts.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if not again.isEmpty():
        told = texts.join(again, "doc_id", "left_semi").select("doc_id", F.sha2("data", 256).alias("sha")).distinct()
        told = scratch.table(told.withColumn("base", (F.row_number().over(Window.partitionBy("doc_id").orderBy("sha")) * APART).cast("bigint")))
        texts = texts.drop("base").withColumn("sha", F.sha2("data", 256)).join(told, ["doc_id", "sha"], "left").select("doc_id", "data", F.coalesce("base", F.lit(0)).alias("base"))
    size = every.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = max(tasks, size // cell_bytes + 1)
    row = "cell bigint, records binary, doc bigint, start bigint, stop bigint"
    found = texts.mapInArrow(_sketch(length, cells), row).repartition(max(tasks, size >> 30), "cell").sortWithinPartitions("cell")
    found = scratch.table(found.mapInArrow(_settle(length), "doc bigint, start bigint, stop bigint, anchor bigint, crowd bigint, places array<bigint>"))
    wanted = found.filter("anchor IS NOT NULL").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("start", "stop", "anchor", "crowd", "places")).alias("wanted"))
    cut = scratch.table(texts.join(wanted, "doc_id").select("data", "base", "wanted", "doc_id").mapInArrow(_cut, "anchor bigint, crowd bigint, doc bigint, places array<bigint>, data binary"))
    shards = cut.filter(F.col("crowd") <= crowded).select("anchor", "doc", "places", "data").repartition(max(tasks, size >> 30), "anchor").sortWithinPartitions("anchor")
    ends = shards.mapInArrow(_shard(length, shard_bytes), "doc bigint, start bigint, stop bigint")
    strings = cut.filter(F.col("crowd") > crowded).select("doc", "places", F.explode(F.sequence(F.lit(0), F.length("data") - length)).alias("at"), "data")
    strings = strings.select("doc", "places", "at", F.sha2(F.substring("data", F.col("at") + 1, F.lit(length)), 256).alias("string"))
    least = strings.groupBy("string").agg(F.min("doc").alias("least"))
    crowds = strings.join(least, "string").filter("doc > least").select("doc", F.explode(F.transform("places", lambda x: x + F.col("at"))).alias("start")).select("doc", "start", (F.col("start") + length).alias("stop"))
    gone = found.filter("anchor IS NULL").select("doc", "start", "stop").union(ends).union(crowds)
    gone = gone.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("start", "stop")).alias("gone"))
    unknown = every.filter("doc_id IS NULL").select("doc_id", "data", F.lit(0).cast("bigint").alias("base"), F.lit(None).cast("array<struct<start:bigint,stop:bigint>>").alias("gone"))
    joined = texts.join(gone, "doc_id", "left").select("doc_id", "data", "base", "gone").union(unknown)
    return joined.mapInArrow(_finish(kept), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * kept)


def remove_repeats_sql(length: int = 50) -> str:
    """The same over ``documents`` as DuckDB SQL: every string of every text, then runs of what goes."""
    return f"""
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    s AS (SELECT doc_id, i, substring(h, 2 * i + 1, {2 * length}) AS g FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - {length - 1}, 0))) AS i FROM d)),
    least AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
    hit AS (SELECT doc_id, i FROM s JOIN least USING (g) WHERE doc_id > least),
    fresh AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {length} THEN 0 ELSE 1 END AS f FROM hit),
    run AS (SELECT doc_id, i, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM fresh),
    gone AS (SELECT doc_id, k, min(i) AS a, max(i) + {length} AS b FROM run GROUP BY doc_id, k),
    part AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, a AS q FROM gone UNION ALL SELECT doc_id, max(b), 1000000000000 FROM gone GROUP BY doc_id),
    kept AS (SELECT doc_id, string_agg(substring(h, 2 * p + 1, 2 * (least(q, length(h) // 2) - p)), '' ORDER BY p) AS h FROM part JOIN d USING (doc_id) GROUP BY doc_id),
    sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM gone GROUP BY doc_id)
    SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
    """
