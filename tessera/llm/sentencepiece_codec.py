"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search walks a text once and keeps, for each boundary within one maximum piece length, the piece
that ends there on the best path. Ids are committed as soon as the paths to all those boundaries pass
through one earlier boundary, so a text without any space needs no more memory than its window.

For a unigram model the best path has the greatest sum of scores. For a byte-pair model a path is
admissible when merging any two neighbouring pieces' text by rank gives just these two pieces; then
exactly one admissible piece ends at each boundary, and the path is what rank-ordered merging of the
whole text gives. Both so agree with the library.
"""

from __future__ import annotations

import codecs
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, keeping, text_or_empty
from tessera.llm.pieces import BPE, CONTROL, SPACE, UNKNOWN, Memo, Pieces, gathered, load


def splits_at(text: str, at: int, ranks: dict[str, int]) -> bool:
    """Whether merging ``text`` by rank leaves exactly the pieces ``text[:at]`` and ``text[at:]``."""
    size = len(text)
    after = list(range(1, size + 1))
    before = list(range(-1, size))
    heap = [(r, i, i + 2) for i in range(size - 1) if (r := ranks.get(text[i : i + 2])) is not None]
    heapify(heap)
    left = size
    while heap:
        _, i, stop = heappop(heap)
        mid = after[i]
        if not mid or mid >= stop or after[mid] != stop:
            continue
        if i < at < stop:
            return False
        after[i], after[mid], left = stop, 0, left - 1
        if stop < size:
            before[stop] = i
            wide = after[stop]
            if (r := ranks.get(text[i:wide])) is not None:
                heappush(heap, (r, i, wide))
        if i:
            j = before[i]
            if (r := ranks.get(text[j:stop])) is not None:
                heappush(heap, (r, j, stop))
    return left == (2 if 0 < at < size else 1)


def last_merge(text: str, ranks: dict[str, int]) -> tuple[str, ...]:
    """The two parts whose merge ends the merging of ``text`` into one piece; () if it stays in parts."""
    parts = list(text)
    while len(parts) > 2:
        rank, i = min(((r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None), default=(0, -1))
        if i < 0:
            return ()
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return tuple(parts) if len(parts) == 2 and text in ranks else ()


ONE = (1,)
PAIRS = 200_000


class Encoder:
    """Ids of texts under one model; ``ids(text)`` is exact for the whole text.

    Besides the vocabulary an encoder keeps, between texts and in bounded number, ids of words (``memo``)
    and whether pairs of pieces stay apart (``pairs``).
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.pairs: dict[int, bool] = {}
        # The last merge of each piece; pieces that their own text doesn't merge into are left out.
        self.halves: dict[str, tuple[str, ...]] = {c: (c, c) for c in pieces.chars}
        if pieces.kind == BPE:
            self.halves |= {t: parts for t in pieces.ranks if (parts := last_merge(t, pieces.ranks))}
        self.whole = {t: pieces.ids[t] for t in self.halves}
        # Lengths of the pieces that can end a text, by its last four, else two characters, longest first.
        admitted = self.halves if pieces.kind == BPE else pieces.ids
        self.tails: dict[str, tuple[int, ...]] = {}
        for t in admitted:
            for k in (2, 4):
                if len(t) >= k and t[-k:] not in self.tails:
                    self.tails[t[-k:]] = tuple(n for n in range(pieces.longest, 0, -1) if n == 1 or n <= k and t[-n:] in admitted)
        for t in admitted:
            if len(t) > 4:
                self.tails[t[-4:]] += (len(t),)
            elif len(t) == 3:
                self.tails[t[-2:]] += (3,)
        self.tails = {t: tuple(sorted({*n}, reverse=True)) for t, n in self.tails.items()}
        self.unknown = min(pieces.scores, default=0.0) - 10.0
        self.ends = self.merging()
        self.memo = Memo(pieces, self.many, b"".join)

    def follows(self, last: str, piece: str) -> bool:
        """Whether two pieces stay two when their text is merged.

        Their merges are undone from the last one back; whenever the two parts that then face each other
        form a piece that would have merged before the merge just undone, the pieces can't stay apart.
        """
        if SPACE * 2 in piece or SPACE * 2 in last:  # equal ranks within runs of spaces: merge them out
            return splits_at(last + piece, len(last), self.pieces.ranks)
        ranks, halves = self.pieces.ranks.get, self.halves
        a, b = last, piece
        if ranks(a + b) is not None:
            return False
        ra, rb = ranks(a, -1), ranks(b, -1)
        while True:
            if ra > rb:
                a = halves[a][1]
                met = ranks(a + b)
                if met is not None and met < ra:
                    return False
                ra = ranks(a, -1)
            elif rb >= 0:
                b = halves[b][0]
                met = ranks(a + b)
                if met is not None and met <= rb:
                    return False
                rb = ranks(b, -1)
            else:
                return True

    def many(self, segments: list[str]) -> list[bytes]:
        """Ids, as 32-bit integers, of sorted segments. What ends at a boundary depends on the text before it
        alone, so each search goes on from the boundary at which a segment leaves the one before it."""
        out, prior, state = [], "", ([-1], [0], [0.0])
        for text in segments:
            same, most = 0, min(len(prior), len(text), len(state[0]) - 1)
            while same < most and prior[same] == text[same]:
                same += 1
            for x in state:
                del x[same + 1 :]
            out.append(array("i", self.stream(text, *state)).tobytes())
            prior = text
        return out

    def stream(self, text: str, last: list[int], back: list[int], sums: list[float]) -> Iterator[int]:
        """The ids of a segment, already escaped, committed as soon as paths converge.

        By boundary since the last commit: ``last`` has the id of the piece that ends there on the best path
        (-1 for a character outside the vocabulary), ``back`` where that piece starts, ``sums`` the path's
        score (unigram models). The lists may hold a beginning of the search, and are extended.
        """
        longest, texts, size, merging = self.pieces.longest, self.pieces.texts, len(text), self.pieces.kind == BPE
        base = 0
        for i in range(len(last), size + 1):
            if merging:
                got = self.ends(text, i, base, last)
            else:
                got, score = self.best(text, i, base, sums)
                sums.append(score)
            last.append(got)
            back.append(i - len(texts[got]) if got >= 0 else i - 1)
            if i - base >= 4 * longest and i % longest == 0:
                meet = self.converged(back, base, i, longest)
                if meet > base:
                    yield from self.path(text, back, last, base, meet)
                    k = meet - base
                    back, last, sums, base = back[k:], last[k:], sums[k:], meet
        yield from self.path(text, back, last, base, size)

    def merging(self):
        """A function that gives the one admissible piece that ends at a boundary in byte-pair merging; -1
        outside the vocabulary."""
        tails, whole, pairs, texts, chars = self.tails.get, self.whole.get, self.pairs, self.pieces.texts, self.pieces.chars
        many, known, follows = len(texts), self.pairs.get, self.follows

        def ends(text: str, i: int, base: int, last: list[int]) -> int:
            for length in tails(text[i - 4 : i]) or tails(text[i - 2 : i], ONE) if i > 3 else tails(text[i - 2 : i] if i > 2 else text[:i], ONE):
                j = i - length
                piece = whole(text[j:i]) if j >= base else None
                if piece is None:
                    continue
                before = last[j - base]
                if before < 0:
                    return piece
                key = before * many + piece
                apart = known(key)
                if apart is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    apart = pairs[key] = follows(texts[before], texts[piece])
                if apart:
                    return piece
            if text[i - 1] not in chars:
                return -1
            raise ValueError(f"no path ends at {text[max(0, i - 20):i]!r}")

        return ends

    def best(self, text: str, i: int, base: int, sums: list[float]) -> tuple[int, float]:
        """The piece that ends at ``i`` on the path of the greatest score of a unigram model, and that score."""
        tails, found, score, scores = self.tails.get, -1, sums[i - 1 - base] + self.unknown, self.pieces.scores
        for length in tails(text[i - 4 : i]) or tails(text[i - 2 : i], ONE) if i > 3 else tails(text[i - 2 : i] if i > 2 else text[:i], ONE):
            j = i - length
            piece = self.pieces.ids.get(text[j:i]) if j >= base else None
            if piece is not None and (s := sums[j - base] + scores[piece]) > score:
                found, score = piece, s
        return found, score

    @staticmethod
    def converged(back: list[int], base: int, i: int, longest: int) -> int:
        """The last boundary on the paths to all of the boundaries at which a later piece may start."""
        alive = set(range(max(base, i - longest + 1), i + 1))
        while len(alive) > 1:
            top = max(alive)
            alive.discard(top)
            alive.add(back[top - base] if top > base else base)
        return alive.pop()

    def path(self, text: str, back: list[int], last: list[int], base: int, stop: int) -> list[int]:
        out: list[int] = []
        while stop > base:
            piece = last[stop - base]
            if piece >= 0:
                out.append(piece)
            else:
                out += self.pieces.fallback(text[stop - 1])[::-1]
            stop = back[stop - base]
        return out[::-1]

    def packed(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one text after another, and where each text's begin (and the last one's end)."""
        values, index, starts = self.memo.results(texts)
        stops = np.cumsum([len(v) // 4 for v in values], dtype=np.int64)
        ids, sizes = gathered(np.frombuffer(b"".join(values), np.int32), stops, index)
        return ids, np.concatenate(([0], np.cumsum(sizes)))[starts]

    def ids(self, text: str) -> list[int]:
        return self.packed(pa.array([text]))[0].tolist()


codecs.register_error("tessera-each", lambda e: ("�" * (e.end - e.start), e.end))


class Decoder:
    """Texts of ids: marks become spaces, the dummy space goes, runs of byte pieces are read as UTF-8
    (U+FFFD for each byte that is not); control pieces vanish, the unknown piece is `` ⁇ ``."""

    def __init__(self, pieces: Pieces):
        special = {CONTROL: "", UNKNOWN: " ⁇ "}
        self.plain = [special.get(kind, text.replace(SPACE, " ")) for text, kind in zip(pieces.texts, pieces.types, strict=True)]
        for i, value in pieces.byte_values.items():
            self.plain[i] = chr(value) if value < 128 else chr(0xDC00 + value)
        self.dummy_prefix = pieces.dummy_prefix
        self.marked = {i for i, t in enumerate(pieces.texts) if t.startswith(SPACE)}
        self.silent = {i for i, kind in enumerate(pieces.types) if kind == CONTROL}
        each = [bytes([pieces.byte_values[i]]) if i in pieces.byte_values else t.encode() for i, t in enumerate(self.plain)]
        self.flat, self.stops = np.frombuffer(b"".join(each), np.uint8), np.cumsum([len(x) for x in each])

    def texts(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[bytes]:
        """UTF-8 of the texts of ids that stand one text after another."""
        data, sizes = gathered(self.flat, self.stops, ids)
        at = np.concatenate(([0], np.cumsum(sizes)))[starts].tolist()
        quiet = not np.isin(ids, list(self.silent)).any()
        whole = memoryview(np.ascontiguousarray(data))
        for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            mine = ids[starts[k] : starts[k + 1]]
            text = bytes(whole[a + (1 if len(mine) and self.dummy_prefix and int(mine[0]) in self.marked else 0) : b])
            try:
                if not quiet:
                    raise ValueError
                text.decode()
            except ValueError:  # control pieces, or bytes that are not UTF-8
                text = self.text(mine.tolist()).encode()
            yield text

    def text(self, ids: list[int]) -> str:
        if not self.silent.isdisjoint(ids):  # a control piece ends a run of bytes
            cuts = [-1, *(k for k, i in enumerate(ids) if i in self.silent), len(ids)]
            parts = [list(ids[a + 1 : b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            first = next((p for p in parts if p), None)
            return "".join(self.text(p) if p is first else self.joined(p) for p in parts)
        out = self.joined(ids)
        if self.dummy_prefix and len(ids) and ids[0] in self.marked:
            out = out[1:]
        return out

    def joined(self, ids: list[int]) -> str:
        out = "".join(map(self.plain.__getitem__, ids))
        try:
            out.encode()
        except UnicodeEncodeError:
            out = out.encode("utf-8", "surrogateescape").decode("utf-8", "tessera-each")
        return out


def encoder(model: bytes) -> Encoder:
    store = keeping("sentencepiece")
    if ("encoder", model) not in store:
        store["encoder", model] = Encoder(load(model))
    return store["encoder", model]


def decoder(model: bytes) -> Decoder:
    store = keeping("sentencepiece")
    if ("decoder", model) not in store:
        store["decoder", model] = Decoder(load(model))
    return store["decoder", model]


def _model(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(spark: SparkSession, docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>``, a row for each row of ``docs``.

    No begin or end ids; special strings are ordinary text. A null or empty text has no ids. Null and
    repeated document ids are carried as they are. Other columns, whatever their names, are not read.
    """
    model, kind = _model(spark, model_path), dict(docs.dtypes)[id_col]

    def make():
        one = encoder(model.value)

        def work(doc_ids, texts):
            ids, starts = one.packed(texts)
            return {"doc_id": doc_ids, "ids": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids))}

        return work

    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), make, f"doc_id {kind}, ids array<int>", "sentencepiece", arrays=True)


def decode(spark: SparkSession, encoded: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of rows with arrays of ids; a null array gives a null text, an empty one ''.
    An id outside the vocabulary fails the job."""
    model, kind = _model(spark, model_path), dict(encoded.dtypes)[id_col]

    def make():
        one = decoder(model.value)
        return lambda doc_ids, ids: {"doc_id": doc_ids, "text": [None if x is None else one.text(x) for x in ids]}

    return arrow_map(encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")), make, f"doc_id {kind}, text string", "sentencepiece")


def round_trips(spark: SparkSession, docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip``.

    ``ids_sha256`` is over the ids as little-endian 32-bit integers. ``round_trip`` tells whether the
    decoded text is the text; it can't be where a text itself holds the space mark U+2581.
    """
    model, kind = _model(spark, model_path), dict(docs.dtypes)[id_col]

    def make():
        one, back = encoder(model.value), decoder(model.value)

        def work(doc_ids, texts):
            ids, starts = one.packed(texts)
            bounds = list(zip(starts.tolist(), starts[1:].tolist(), strict=False))
            sha = [hashlib.sha256(ids[a:b]).hexdigest() for a, b in bounds]
            again = list(back.texts(ids, starts))
            same = [a == t.as_buffer().to_pybytes() for a, t in zip(again, texts, strict=True)]
            return {"doc_id": doc_ids, "n_tokens": pa.array(np.diff(starts)), "ids_sha256": sha, "decoded_sha256": [hashlib.sha256(a).hexdigest() for a in again], "round_trip": same}

        return work

    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), make, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean", "sentencepiece", arrays=True)
