"""The cheapest way through a lattice of edits between two word lists, in which words may run together, come apart or be numbers."""

from __future__ import annotations

from array import array
from heapq import heappop, heappush

from .numerals import VALUES
from .pairing import blocks, common_pairs

SKIP = 1.0
NEAR = 1e-6  # costs this close are weighed up in the end
KINDS = ["equal", "close", "joined", "split", "pairs", "number", "skip_a", "skip_b"]


SEEN: dict = {}  # what a task has compared; a function of a module that goes to workers by value can't have a cache of the library's


def likeness(x: str, y: str) -> float:
    """1 - edits / length of the longer."""
    if x == y:
        return 1.0
    if min(len(x), len(y)) * 2 < max(len(x), len(y)):
        return 0.0
    if (x, y) in SEEN:
        return SEEN[x, y]
    if len(SEEN) > 200_000:
        SEEN.clear()
    places: dict = {}
    for i, u in enumerate(x):
        places[u] = places.get(u, 0) | 1 << i
    # a column of the table of edits as bits: where it rises and where it falls (Myers, in Hyyrö's form)
    full, top, edits = (1 << len(x)) - 1, 1 << len(x) - 1, len(x)
    up, down = full, 0
    for v in y:
        at = places.get(v, 0)
        level = ((at & up) + up ^ up) | at | down
        rise, fall = down | full & ~(level | up), up & level
        edits += bool(rise & top) - bool(fall & top)
        rise, fall = rise << 1 | 1, fall << 1
        up, down = (fall | ~(level | rise)) & full, rise & level & full
    SEEN[x, y] = 1 - edits / max(len(x), len(y))
    return SEEN[x, y]


LETTERS: dict = {}


def letters(x: str) -> frozenset:
    found = LETTERS.get(x)
    if found is None:
        if len(LETTERS) > 200_000:
            LETTERS.clear()
        found = LETTERS[x] = frozenset(x)
    return found


def alike(x: str, y: str, least: float) -> float:
    """``likeness``; 0 where it is under ``least`` as too many letters of one aren't in the other."""
    most = (1 - least) * max(len(x), len(y)) + 1e-6
    u, v = letters(x), letters(y)
    return 0.0 if len(u - v) > most or len(v - u) > most else likeness(x, y)


def spelled(words: list[str]) -> int | None:
    """The number that words spell, 0 to 9999, or None: values add up, a hundred or a thousand multiplies what is before it."""
    total = current = 0
    seen = False
    for w in words:
        for part in w.split("-"):
            if part == "hundred":
                current = max(current, 1) * 100
            elif part == "thousand":
                total, current = total + max(current, 1) * 1000, 0
            elif part in VALUES:
                current += VALUES[part]
            elif part != "and" or not seen:
                return None
            seen = True
    return total + current if seen and total + current <= 9999 else None


def number(words: list[str]) -> int | None:
    """The value of one numeral in digits, or of spelled words."""
    if len(words) == 1 and words[0].isdigit() and len(words[0]) <= 4:
        return int(words[0])
    return spelled(words)


def edges(a: list[str], b: list[str], i: int, j: int, most: int, least: float):
    """(words of a, words of b, cost, kind) of the steps from a cell, in the order in which equal costs are preferred."""
    n, m = len(a) - i, len(b) - j
    if n and m:
        u, v = a[i], b[j]
        lu, lv = len(u), len(v)
        far = lambda p, q: (p if p < q else q) < least * (p if p > q else q) - 1e-9  # too different in length to be alike
        if u == v:
            yield 1, 1, 0.0, "equal"
        elif not far(lu, lv) and (x := alike(u, v, least)) >= least:
            yield 1, 1, 1 - x, "close"
        wide, tall, run_a, run_b = lu, lv, u, v
        for k in range(2, most + 1):
            if k <= n:
                run_a, wide = run_a + a[i + k - 1], wide + len(a[i + k - 1])
                if not far(wide, lv) and (x := alike(run_a, v, least)) >= least:
                    yield k, 1, 1 - x, "split"
            if k <= m:
                run_b, tall = run_b + b[j + k - 1], tall + len(b[j + k - 1])
                if not far(lu, tall) and (x := alike(u, run_b, least)) >= least:
                    yield 1, k, 1 - x, "joined"
        if n > 1 and m > 1 and u != v and not far(lu + len(a[i + 1]), lv + len(b[j + 1])) and (x := alike(u + a[i + 1], v + b[j + 1], least)) >= least:
            yield 2, 2, 1 - x, "pairs"
        digits_a, digits_b = u.isdigit(), v.isdigit()
        for k in range(1, min(n, 6) + 1) if digits_b and not digits_a else ():
            if number(a[i : i + k]) == number([v]) is not None:
                yield k, 1, 0.0, "number"
        for k in range(1, min(m, 6) + 1) if digits_a and not digits_b else ():
            if number(b[j : j + k]) == number([u]) is not None:
                yield 1, k, 0.0, "number"
    if n:
        yield 1, 0, SKIP, "skip_a"
    if m:
        yield 0, 1, SKIP, "skip_b"


def path(a: list[str], b: list[str], most: int = 4, least: float = 0.7) -> list[tuple[int, int, int, int, str]]:
    """(place in a, words of a, place in b, words of b, kind) of the steps of the cheapest way; of equal ones the one whose first step comes first."""
    return _sought(a, b, most, least, float("inf"))[0]


def _sought(a: list[str], b: list[str], most: int, least: float, cells: float) -> tuple[list[tuple[int, int, int, int, str]] | None, float]:
    """(``path``, or None if more than ``cells`` cells would be looked at; what the last of them cost)."""
    # from the start to the end, cells in the order of their cost: those that cost more than the whole way aren't on it, and aren't looked at
    end, whole = (len(a), len(b)), float("inf")
    least_cost, heap, onward = {(0, 0): 0.0}, [(0.0, 0, 0)], {}
    while heap:
        so_far, i, j = heappop(heap)
        if so_far > whole + NEAR:
            break
        if (i, j) in onward:
            continue
        if (i, j) == end:
            whole = min(whole, so_far)
        if len(onward) >= cells:
            return None, so_far
        onward[i, j] = steps = list(edges(a, b, i, j, most, least))
        for di, dj, c, _ in steps:
            to, now = (i + di, j + dj), so_far + c
            if now < least_cost.get(to, float("inf")) and now <= whole + NEAR:
                least_cost[to] = now
                heappush(heap, (now, *to))
    cost: dict = {end: 0.0}
    step: dict = {}
    for i, j in sorted(onward, reverse=True):
        best = None
        for di, dj, c, kind in onward[i, j]:
            if (i + di, j + dj) in cost:
                total = c + cost[i + di, j + dj]
                if best is None or total < best[0] - 1e-9:
                    best = total, di, dj, kind
        if best:
            cost[i, j], step[i, j] = best[0], best[1:]
    out, i, j = [], 0, 0
    while (i, j) in step:
        di, dj, kind = step[i, j]
        out.append((i, di, j, dj, kind))
        i, j = i + di, j + dj
    return out, whole


def long_path(a: list[str], b: list[str], cells: int = 60_000, most: int = 4, least: float = 0.7, held: int = 1 << 24) -> list[tuple[int, int, int, int, str]]:
    """``path`` in bounded memory: where it would look at over ``cells`` cells, the lattice is gone through row by row, which gives the same steps.

    Rows go from the end to the start, of each the cells from which the rest costs no more than a bound: what a way between the runs of equal
    words costs, or less, doubled until the start is among them. Steps of about ``held`` cells are kept; later rows' are made again from
    the costs that were kept where they begin.
    """
    found, bound = _sought(a, b, most, least, cells)
    known = None
    while found is None:
        known = known or _between_runs(a, b, most, least)
        bound = known if known <= 4 * bound + SKIP else 2 * bound + SKIP
        found = _swept(a, b, bound, most, least, held)
    return found


def _between_runs(a: list[str], b: list[str], most: int, least: float, cells: int = 2_000) -> float:
    """What a way costs that goes through the runs of four equal words or more of a longest common subsequence; large gaps are skipped."""
    cost, i, j = 2 * NEAR, 0, 0
    runs = [x for x in blocks(common_pairs(a, b)) if x[2] >= 4]
    for x, y, n in [*runs, (len(a), len(b), 0)]:
        found, whole = _sought(a[i:x], b[j:y], most, least, cells)
        cost += (x - i + y - j) * SKIP if found is None else whole
        i, j = x + n, y + n
    return cost


def _swept(a: list[str], b: list[str], bound: float, most: int, least: float, held: int) -> list[tuple[int, int, int, int, str]] | None:
    """The cheapest way, if it costs ``bound`` at most."""
    reach, numbers = max(6, most), {}
    after: list = []  # (first place in b, costs) of the rows that come next
    parts, steps, size = [], {}, 0  # (last row, rows after it) of each block of rows; the steps of the one at hand
    last = len(a)
    for i in range(len(a), -1, -1):
        if size > held:
            parts.append((last, start))
            steps, size, last = {}, 0, i
        if i == last:
            start = [(lo, array("d", costs)) for lo, costs in after]
        lo, costs, steps[i] = _row(a, b, i, after, bound + NEAR, most, least, numbers)
        after, size = [(lo, costs), *after[: reach - 1]], size + len(costs)
        if not any(costs for _, costs in after):
            return None
    if lo > 0 or not costs or costs[0] > bound:
        return None
    kinds = list(numbers)
    out, i, j = [], 0, 0
    while (i, j) != (len(a), len(b)):
        while i not in steps:  # the next block, or one after it if a step goes beyond
            last, after = parts.pop()
            steps = {}
            for k in range(last, i - 1, -1):
                lo, costs, steps[k] = _row(a, b, k, after, bound + NEAR, most, least, numbers)
                after = [(lo, costs), *after[: reach - 1]]
        lo, row = steps[i]
        di, dj, kind = kinds[row[j - lo]]
        out.append((i, di, j, dj, kind))
        i, j = i + di, j + dj
    return out


def _row(a: list[str], b: list[str], i: int, after: list, limit: float, most: int, least: float, numbers: dict) -> tuple[int, list, tuple[int, bytes]]:
    """(first place in b, costs of the way to the end, (first place, numbers of best steps)) of a row's cells that cost ``limit`` at most; others between them cost inf."""
    none, own = float("inf"), [(lo, lo + len(costs)) for lo, costs in after if len(costs)]
    top = max([hi - 1 for _, hi in own], default=len(b))
    low = min([lo for lo, _ in own], default=len(b)) - max(6, most)
    costs, steps, j, beside = [], bytearray(), top, none
    while j >= 0 and (j >= low or beside <= limit):
        if i == len(a) and j == len(b):
            total, number = 0.0, 0
        else:
            total, number = none, 0
            for di, dj, c, kind in edges(a, b, i, j, most, least):
                if di > len(after):
                    continue
                if di:
                    lo, x = after[di - 1]
                    at = j + dj - lo
                    cell = x[at] if 0 <= at < len(x) else none
                else:
                    cell = beside
                if c + cell < total - 1e-9 or total == none > cell:
                    total, number = c + cell, numbers.setdefault((di, dj, kind), len(numbers))
        beside = total if total <= limit else none
        costs.append(beside)
        steps.append(number)
        j -= 1
    while costs and costs[-1] == none:
        costs.pop()
        steps.pop()
        j += 1
    costs.reverse()
    steps.reverse()
    return j + 1, costs, (j + 1, bytes(steps))
