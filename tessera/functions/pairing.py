"""Pairing two sequences by whole-row bit operations: longest common subsequences, edits, and the span of one that is most like the other."""

from __future__ import annotations

from math import gcd

import numpy as np


def _places(b: list) -> dict:
    """For each item the positions it has, as bits."""
    out: dict = {}
    for j, x in enumerate(b):
        out[x] = out.get(x, 0) | 1 << j
    return out


def common_length(a: list, b: list) -> int:
    """Length of a longest common subsequence."""
    places, full = _places(b), (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def common_pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Positions (in a, in b) of a longest common subsequence, in order; equal ends are paired first.

    A row of the table is an integer with a bit for each item of b, so the table of two 20,000-word texts takes 50 MB.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    places, full = _places(y), (1 << len(y)) - 1
    v, rows = full, []
    for item in x:
        u = v & places.get(item, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    i, j, middle = len(x), len(y), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:  # no gain by this column
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:  # the gain is there without this row
            i -= 1
        else:
            i, j = i - 1, j - 1
            middle.append((head + i, head + j))
    ends = [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]
    return [(k, k) for k in range(head)] + middle[::-1] + ends


def blocks(pairs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of runs of pairs that follow one another on both sides."""
    out: list[list[int]] = []
    for i, j in pairs:
        if out and i == out[-1][0] + out[-1][2] and j == out[-1][1] + out[-1][2]:
            out[-1][2] += 1
        else:
            out.append([i, j, 1])
    return [tuple(x) for x in out]


def ratio(a: list, b: list, least: float = 0.0) -> float:
    """2 * common / total; 0 where lengths, or counts of items, already fall short of ``least``. Two empty sequences are alike."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    if 2 * min(len(a), len(b)) < least * total:
        return 0.0
    if least:
        left: dict = {}
        for x in a:
            left[x] = left.get(x, 0) + 1
        shared = 0
        for x in b:
            if left.get(x, 0):
                left[x] -= 1
                shared += 1
        if 2 * shared < least * total:
            return 0.0
    return 2 * common_length(a, b) / total


def edits(a, b) -> int:
    """Number of substitutions, deletions and insertions of a shortest edit, a column of the table of edits as bits (Myers, in Hyyrö's form)."""
    if not a or not b:
        return len(a) + len(b)
    places, full, top, found = _places(a), (1 << len(a)) - 1, len(a) - 1, len(a)
    up, down = full, 0
    for item in b:
        at = places.get(item, 0)
        level = ((at & up) + up ^ up) | at | down
        rise, fall = down | full & ~(level | up), up & level
        found += (rise >> top & 1) - (fall >> top & 1)
        rise, fall = rise << 1 | 1, fall << 1
        up, down = (fall | ~(level | rise)) & full, rise & level & full
    return found


def edit_counts(a: list, b: list) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) of a shortest edit from a to b; of equally short ones, that with most substitutions.

    A cell holds edits and substitutions in one number, a row of cells is one array: what a row gains by insertions is a running minimum.
    """
    codes = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
    x, y = (np.array([codes[w] for w in side], np.int64) for side in (a, b))
    one = len(a) + len(b) + 1  # an edit; a substitution counts one less
    steps = one * np.arange(len(b) + 1)
    row = steps.copy()
    for i, item in enumerate(x, 1):
        new = np.empty_like(row)
        new[0] = one * i
        new[1:] = np.minimum(row[1:] + one, row[:-1] + np.where(y == item, 0, one - 1))
        row = np.minimum.accumulate(new - steps) + steps
    edits = -(-int(row[-1]) // one)
    changed = edits * one - int(row[-1])
    gone = (edits - changed + len(a) - len(b)) // 2
    return changed, gone, edits - changed - gone


def _on_diagonal(c: np.ndarray, s: np.ndarray, d: int) -> tuple[int, int]:
    """2 * matches and total length (of c and the span) of the span of s between the first and the last match on a diagonal."""
    lo, hi = max(0, -d), min(len(c), len(s) - d)
    at = np.flatnonzero(c[lo:hi] == s[lo + d : hi + d])
    return (2 * len(at), len(c) + int(at[-1] - at[0]) + 1) if len(at) else (0, 1)


def _best_on_band(c: np.ndarray, s: np.ndarray, p: int, q: int, low: int, high: int) -> tuple[int, int, int]:
    """(2q * matches - p * (c's length + span's), start, end) of the best span with matches on the diagonals ``low`` to ``high``.

    Of equal ones, that with the smallest start, then end. ``best[j]`` is the best of a span that ends before j, its score and start in
    one number.
    """
    base = len(s) + 2
    none = -(1 << 62)
    best = np.full(len(s) + 1, none, np.int64)
    steps = np.arange(len(s) + 1, dtype=np.int64)
    for i in range(len(c)):
        lo, hi = max(0, i + low), min(len(s), i + high + 1)
        if lo >= hi:
            continue
        at = np.flatnonzero(s[lo:hi] == c[i])
        if not len(at):
            continue
        at += lo
        grown = np.maximum(best[at], -at) + (2 * q - p) * base
        now = best[lo + 1 : hi + 1].copy()
        now[at - lo] = np.maximum(now[at - lo], grown)
        fall = p * base * steps[: hi - lo]
        best[lo + 1 : hi + 1] = np.maximum(np.maximum.accumulate(now + fall) - fall, none)
    end = int(np.argmax(best))
    if best[end] <= none // 2:
        return none, 0, 0
    score = -(-int(best[end]) // base)
    return score - p * len(c), score * base - int(best[end]), end


def best_span(c: np.ndarray, s: np.ndarray, diagonals: np.ndarray, limit: tuple[int, int]) -> tuple[int, int, int] | None:
    """(start, end, matches) of the span of s most like c, by 2 * common / (c's length + the span's); None under ``limit`` (p, q).

    ``common`` is the length of a longest common subsequence. Of equal spans that with the smallest start, then end. ``diagonals`` has
    the place in s less that in c of matches, such that every span good enough has one of them in its best pairing. A span as good
    as p/q has all its matches within (1 - p/q) of the lengths from any of its diagonals, so the table is a band about them. The limit
    rises to what has been found, until nothing is better.
    """
    n, (p, q), found = len(c), limit, None
    for d in np.unique(diagonals):
        have = _on_diagonal(c, s, int(d))
        if have[0] * q > p * have[1]:
            p, q = have
    order = np.unique(diagonals)
    while True:
        g = gcd(p, q)
        p, q = p // g, q // g
        longest = n * (2 * q - p) // p
        width = (q - p) * (n + longest) // q + 1
        groups = np.split(order, np.flatnonzero(np.diff(order) > 2 * width) + 1)
        tried = [_best_on_band(c, s, p, q, int(x[0]) - width, int(x[-1]) + width) for x in groups]
        score, start, end = min(tried, key=lambda x: (-x[0], x[1], x[2]))
        if score < 0:
            return found
        length = end - start
        matches = (score + p * (n + length)) // (2 * q)
        found = (start, end, matches)
        if score == 0:
            return found
        p, q = 2 * matches, n + length
