"""The pieces of a sentencepiece model file, read straight from its protocol buffer."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class Pieces:
    """Piece strings, scores and types of one model.

    ``ranks`` maps the text of a piece that a pair may form to its rank; a lower rank goes first.
    ``joins`` holds the pairs of neighbouring characters that some piece contains: no piece and no merge
    spans any other pair, so text is cut there without a change to its ids.
    """

    def __init__(self, model: bytes):
        self.texts: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.byte_fallback = UNIGRAM, False
        self.dummy_prefix, self.squeeze, self.charsmap = True, True, b""
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                self.texts.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
                self.kind, self.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            elif field == 3:
                norm = dict(_fields(value))
                self.dummy_prefix, self.squeeze, self.charsmap = bool(norm.get(3, 1)), bool(norm.get(4, 1)), norm.get(2, b"")
        if self.squeeze or self.charsmap or not self.byte_fallback or USER in self.types:
            raise ValueError("only models with identity normalisation, kept spaces, byte fallback and no user symbols are supported")
        self.ids = {t: i for i, t in enumerate(self.texts) if self.types[i] == NORMAL}
        self.bytes = {int(t[3:5], 16): i for i, t in enumerate(self.texts) if self.types[i] == BYTE}
        self.byte_values = {i: b for b, i in self.bytes.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.chars = {t for t in self.ids if len(t) == 1}
        levels = {score: n for n, score in enumerate(sorted({-self.scores[i] for i in self.ids.values()}))}
        self.ranks = {t: levels[-self.scores[i]] for t, i in self.ids.items() if len(t) > 1}
        self.joins = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        # No piece has a space mark after another character: then a mark starts a segment of its own.
        self.cut_at_spaces = not any(SPACE in t.lstrip(SPACE) for t in self.ids)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if self.cut_at_spaces else "(?s:.+)")

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()]


_kept: dict[bytes, Pieces] = {}


def load(model: bytes) -> Pieces:
    """One copy a worker process."""
    if model not in _kept:
        _kept[model] = Pieces(model)
    return _kept[model]


def segments(text: str, pieces: Pieces) -> list[str]:
    """Cut ``text``, escaped as the model wants it, between neighbours that no piece holds side by side.
    Within runs of letters that would hardly ever be, so it isn't looked for."""
    if text.isalpha() or text[0] == SPACE and text[1:].isalpha():
        return [text]
    joins = pieces.joins
    cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in joins]
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)] if cuts else [text]


#: What a kept entry takes besides its characters: two objects and a slot.
ENTRY_BYTES = 180


class Kept(dict):
    """Results by key. Over its bound it keeps only those that the last batch asked for."""

    def __init__(self, most_bytes: int):
        super().__init__()
        self.most, self.size = most_bytes, 0

    def add(self, keys: list[str], values: list) -> None:
        self.update(zip(keys, values, strict=True))
        self.size += sum(map(len, keys)) + sum(len(v) if type(v) is bytes else 0 for v in values) + ENTRY_BYTES * len(keys)

    def trim(self, asked: Iterable[str]) -> None:
        if self.size > self.most:
            held = {k: self[k] for k in asked if len(k) <= 64}
            self.clear()
            self.size = 0
            self.add(list(held), list(held.values()))


class Memo:
    """Results of texts from those of their words.

    A batch is split into words and its distinct words are found by Arrow. New words are cut into segments;
    those not seen before go to ``compute`` at once, sorted; ``join`` puts a word's results together. Words
    and other segments are kept between batches in bounded memory. ``results`` gives the distinct results,
    which of them each text has, one after another, and where each text's begin.
    """

    def __init__(self, pieces: Pieces, compute, join, most_bytes: int = 96 << 20):
        self.pieces, self.compute, self.join = pieces, compute, join
        self.words = Kept(most_bytes // 4 * 3)  # of SPACE + word, by word
        self.parts = Kept(most_bytes // 4)  # of other segments, as they stand

    def results(self, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_string())
        pieces, plain = self.pieces, np.zeros(len(texts), bool)
        if pieces.cut_at_spaces and pieces.dummy_prefix:  # else, and where spaces stand otherwise than singly, runs are found below
            odd = [pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE), pc.starts_with(texts, " "), pc.ends_with(texts, " "), pc.equal(texts, "")]
            plain = ~np.logical_or.reduce([x.to_numpy(zero_copy_only=False) for x in odd])
        split = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        coded = split.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        values = self.of_words(names)
        index = coded.indices.to_numpy()
        sizes = np.zeros(len(texts), np.int64)
        sizes[plain] = np.diff(split.offsets.to_numpy())
        if not plain.all():
            runs = [self.runs(t) for t in texts.filter(pa.array(~plain)).to_pylist()]
            sizes[~plain] = [len(x) for x in runs]
            number: dict = {}
            extra = np.array([number.setdefault(v, len(values) + len(number)) for x in runs for v in x], np.int64)
            values = [*values, *number]
            place = np.repeat(plain, sizes)
            whole = np.empty(len(place), np.int64)
            whole[place], whole[~place] = index, extra
            index = whole
        self.words.trim(names)
        self.parts.trim(())
        return values, index, np.concatenate(([0], np.cumsum(sizes)))

    def of_words(self, words: list[str]) -> list:
        """Results of ``SPACE + word`` for distinct words."""
        kept, parts, pieces = self.words, self.parts, self.pieces
        new = [w for w in words if w not in kept]
        cut = {w: segments(SPACE + w, pieces) for w in new if not w.isalpha()}
        first = {w for w in new if w.isalpha()}
        first.update(h for x in cut.values() if x[0][0] == SPACE and (h := x[0][1:]) not in kept)
        ordered = sorted(first)
        kept.add(ordered, self.compute([SPACE + w for w in ordered]))
        rest = sorted({s for x in cut.values() for s in x[1:]} - parts.keys())
        parts.add(rest, self.compute(rest))
        whole = [w for w, x in cut.items() if len(x) > 1]
        kept.add(whole, [self.join((kept[cut[w][0][1:]], *map(parts.__getitem__, cut[w][1:]))) for w in whole])
        return [kept[w] for w in words]

    def runs(self, text: str) -> list:
        """Results of a text's segments, however its spaces stand."""
        if not text:
            return []
        found = [s for run in self.pieces.cut.findall((SPACE if self.pieces.dummy_prefix else "") + text.replace(" ", SPACE)) for s in segments(run, self.pieces)]
        new = sorted(set(found) - self.parts.keys())
        self.parts.add(new, self.compute(new))
        out = [self.parts[s] for s in found]
        self.parts.trim(found)
        return out


def gathered(flat: np.ndarray, stops: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of ``flat`` that ``index`` names (part k ends at ``stops[k]``) one after another, and their sizes."""
    sizes = np.diff(stops, prepend=0)
    wide = sizes[index]
    ends = np.cumsum(wide)
    total = int(ends[-1]) if len(ends) else 0
    steps = np.ones(total, np.int64)
    some = np.flatnonzero(wide)
    begin = (stops - sizes)[index[some]]
    at = (ends - wide)[some]
    if len(some):
        steps[at[0]] = begin[0]
        steps[at[1:]] = begin[1:] - (begin[:-1] + wide[some][:-1]) + 1
    return flat[np.cumsum(steps)], wide
