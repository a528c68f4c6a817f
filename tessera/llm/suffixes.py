"""Suffix arrays by induced sorting, and permuted common prefixes, over shards of bytes.

The text is classified into S and L suffixes, the leftmost S suffixes (LMS) are sorted by inducing, their
substrings named, the string of names sorted recursively, and the whole array induced from it; each step
is linear. Over bytes the induction runs a bucket at a time on vectors; over the recursion's large
alphabets it is the plain sequential scan.
"""

from __future__ import annotations

import numpy as np

VECTOR_ALPHABET = 1024


def classify(t: np.ndarray) -> np.ndarray:
    """True for S suffixes: smaller than the suffix after them. The last one is S (the empty one is smallest)."""
    n = len(t)
    up = np.empty(n, bool)
    up[-1] = True
    differs = np.flatnonzero(t[1:] != t[:-1])
    rises = t[1:][differs] > t[:-1][differs]
    at = np.searchsorted(differs, np.arange(n - 1))
    inside = at < len(differs)
    up[:-1][inside] = rises[at[inside]]
    up[:-1][~inside] = False  # a run up to the end: longer is greater, as the end is smallest
    return up


def suffix_array(t: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of ``t`` with values in [0, size); a shorter suffix sorts before those it begins."""
    n = len(t)
    if n == 0:
        return np.empty(0, np.int64)
    # A sentinel below all values ends the string.
    s = np.concatenate((t.astype(np.int64) + 1, [0]))
    return _sorted(s, size + 1)[1:]


def _sorted(t: np.ndarray, size: int) -> np.ndarray:
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    up = classify(t)
    lms = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    induce = _induce_vector if size <= VECTOR_ALPHABET else _induce_scan
    rough = induce(t, up, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = rough[is_lms[rough]]
    names = _names(t, up, lms, order)
    count = int(names.max()) + 1 if len(names) else 0
    if count < len(lms):
        ranked = _sorted(names, count)
    else:
        ranked = np.empty(len(lms), np.int64)
        ranked[names] = np.arange(len(lms))
    return induce(t, up, lms[ranked], size)


def _names(t: np.ndarray, up: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings in text order; equal substrings have one name, names sort as substrings."""
    place = np.empty(len(t), np.int64)
    place[lms] = np.arange(len(lms))
    length = np.diff(np.concatenate((lms, [len(t) - 1]))) + 1
    width = length[place[order]]
    same = width[1:] == width[:-1]
    a, b, w = order[:-1][same], order[1:][same], width[1:][same]
    index = np.flatnonzero(same)
    fresh = np.ones(len(order), bool)
    step = 0
    while len(a):
        equal = (t[a + step] == t[b + step]) & (up[a + step] == up[b + step])
        done = equal & (w == step + 1)
        fresh[index[done] + 1] = False
        keep = equal & ~done
        a, b, w, index = a[keep], b[keep], w[keep], index[keep]
        step += 1
    names = np.empty(len(lms), np.int64)
    names[place[order]] = np.cumsum(fresh) - 1
    return names


def _deal(arrivals: list[list[np.ndarray]], where: np.ndarray, what: np.ndarray) -> None:
    order = np.argsort(what, kind="stable")
    where, what = where[order], what[order]
    cuts = np.flatnonzero(np.diff(what)) + 1
    for part, value in zip(np.split(where, cuts), what[np.concatenate(([0], cuts))].tolist(), strict=True):
        arrivals[value].append(part)


def _induce_vector(t: np.ndarray, up: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    none = np.empty(0, np.int64)
    seeds: list[list[np.ndarray]] = [[] for _ in range(size)]
    if len(lms):
        _deal(seeds, lms, t[lms])
    low: list[list[np.ndarray]] = [[] for _ in range(size)]  # L suffixes of each bucket, in order
    for c in range(size):
        done = 0
        while done < len(low[c]):
            batch = low[c][done] if done == len(low[c]) - 1 else np.concatenate(low[c][done:])
            low[c][done:] = [batch]
            done += 1
            _push(low, t, batch, ~up)
        if seeds[c]:
            _push(low, t, np.concatenate(seeds[c]), ~up)
    high: list[list[np.ndarray]] = [[] for _ in range(size)]  # S suffixes, from the bucket's end
    high[0].append(np.array([len(t) - 1]))
    for c in range(size - 1, -1, -1):
        done = 0
        while done < len(high[c]):
            batch = high[c][done] if done == len(high[c]) - 1 else np.concatenate(high[c][done:])
            high[c][done:] = [batch]
            done += 1
            _push(high, t, batch, up)
        if low[c]:
            _push(high, t, np.concatenate(low[c])[::-1], up)
    out = []
    for c in range(size):
        out.append(np.concatenate(low[c]) if low[c] else none)
        out.append(np.concatenate(high[c])[::-1] if high[c] else none)
    return np.concatenate(out)


def _push(arrivals: list[list[np.ndarray]], t: np.ndarray, batch: np.ndarray, kind: np.ndarray) -> None:
    before = batch[batch > 0] - 1
    before = before[kind[before]]
    if len(before):
        _deal(arrivals, before, t[before])


def _induce_scan(t: np.ndarray, up: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    counts = np.bincount(t, minlength=size)
    stops = np.cumsum(counts)
    text, kinds = t.tolist(), up.tolist()
    out = [-1] * len(text)
    tail = stops.tolist()
    for i in lms[::-1].tolist():
        c = text[i]
        tail[c] -= 1
        out[tail[c]] = i
    head = (stops - counts).tolist()
    for i in out:
        if i > 0 and not kinds[i - 1]:
            c = text[i - 1]
            out[head[c]] = i - 1
            head[c] += 1
    # Only the L suffixes stay; the S suffixes, the sentinel among them, are induced anew from the right.
    tail = stops.tolist()
    for at, i in enumerate(out):
        if i >= 0 and kinds[i]:
            out[at] = -1
    tail[0] -= 1
    out[0] = len(text) - 1
    for at in range(len(out) - 1, -1, -1):
        i = out[at]
        if i > 0 and kinds[i - 1]:
            c = text[i - 1]
            tail[c] -= 1
            out[tail[c]] = i - 1
    return np.array(out, np.int64)


def permuted_prefixes(t: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """PLCP, in text order: how long each suffix agrees with the one before it in ``array``, up to ``most``.

    ``phi`` gives that suffix by text position; all positions are compared at once and drop out where
    they differ. The first suffix of the array has 0.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[array[1:]] = array[:-1]
    out = np.zeros(n, np.int64)
    here = np.flatnonzero(phi >= 0)
    there = phi[here]
    padded = np.concatenate((t.astype(np.int64), np.full(most, -1)))
    padded[n:] = -1 - np.arange(most)
    live = np.arange(len(here))
    for step in range(most):
        a, b = here[live] + step, there[live] + step
        live = live[(padded[a] == padded[b]) & (a < n) & (b < n)]
        if not len(live):
            break
        out[here[live]] = step + 1
    return out
