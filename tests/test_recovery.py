"""Alignment, fuzzy names, greedy picks, chunks, forward locating and damaged JSON against plain computations."""

import json
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import pairing, stats
from tessera.operators import alignment, colophons, greedy, names, passages, resampling
from tessera.sources import loose_json


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_pairs_and_edits():
    rng = random.Random(0)
    for _ in range(800):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = pairing.common_pairs(a, b)
        assert pairing.common_length(a, b) == common(a, b) == len(pairs)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        changed, gone, new = pairing.edit_counts(a, b)
        assert changed + gone + new == distance(a, b) and len(a) - gone + new == len(b)
        least = rng.choice([0.3, 0.6, 0.9])
        want = 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0
        assert pairing.ratio(a, b, least) == (want if want >= least else pairing.ratio(a, b, least)) and pairing.ratio(a, b) == want
    assert pairing.blocks([(0, 1), (1, 2), (3, 3)]) == [(0, 1, 2), (3, 3, 1)]


def best_by_trying(c, s, limit):
    found = None
    for i in range(len(s)):
        for j in range(i + 1, len(s) + 1):
            m = common(c, s[i:j])
            r = Fraction(2 * m, len(c) + j - i)
            if m and r >= limit and (found is None or (-r, i, j) < found[:3]):
                found = (-r, i, j, m)
    return found


def test_best_spans_against_all_windows(spark):
    rng = random.Random(1)
    words = lambda n, k: [rng.choice("abcdefghijklmnop"[:k]) for _ in range(n)]
    chunks = [(i, words(rng.randrange(1, 12), rng.choice([3, 16]))) for i in range(25)] + [(90, []), (91, words(30, 16))]
    sources = [(i, words(rng.randrange(1, 40), rng.choice([4, 16]))) for i in range(12)] + [(50, chunks[0][1] * 2), (51, words(20, 16) + chunks[-1][1][:12] + ["z"] + chunks[-1][1][14:] + words(20, 16)), (52, [])]
    frame = lambda rows, name: spark.createDataFrame([(i, " ".join(w).upper() if w else None) for i, w in rows], f"{name} long, text string")
    for limit in (Fraction(45, 100), Fraction(6, 10), Fraction(85, 100)):
        got = {(r.c, r.s): (r.start, r.end, r.matched, r.n_words) for r in alignment.best_matches(frame(chunks, "c"), frame(sources, "s"), "c", "s", limit=limit).collect()}
        want = {(i, j): (*found[1:], len(c)) for i, c in chunks for j, s in sources if c and (found := best_by_trying(c, s, limit))}
        assert got == want
    matches = alignment.best_matches(frame(chunks, "c"), frame(sources, "s"), "c", "s")
    best = {r.c: (r.s, r.start) for r in alignment.anchors(matches, "c", "s").collect()}
    every = {}
    for i, c in chunks:
        for j, s in sources:
            if c and (found := best_by_trying(c, s, Fraction(6, 10))):
                every.setdefault(i, []).append((found[0], j, found[1]))
    assert best == {i: min(x)[1:] for i, x in every.items()}
    assert "Cartesian" not in matches._jdf.queryExecution().toString() and "NestedLoop" not in matches._jdf.queryExecution().toString()


def test_long_texts_align_in_seconds():
    rng = random.Random(2)
    a = [rng.randrange(5000) for _ in range(20_000)]
    b = [rng.randrange(5000) if rng.random() < 0.1 else x for x in a]
    s = np.array([rng.randrange(5000) for _ in range(3000)] + b + [rng.randrange(5000) for _ in range(3000)])
    start, end, matched = pairing.best_span(np.array(a), s, np.array([3000]), (6, 10))
    assert abs(start - 3000) < 30 and abs(end - 23_000) < 30 and matched >= 17_500


def test_like_texts_against_all_pairs(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghij") for _ in range(rng.randrange(1, 15))] for _ in range(12)]
    texts = [[w for w in rng.choice(base) if rng.random() > 0.15] for _ in range(60)] + base + base[:3]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in rows] + [(999, None)], "i long, text string")
    got = {(r.a, r.b) for r in alignment.like_texts(frame, "i", "text").collect()}
    heads = {}
    for i, t in rows:
        heads.setdefault(tuple(t), i)
    want = {(heads[tuple(t)], i) for i, t in rows if t and heads[tuple(t)] != i}
    distinct = sorted((i, t) for t, i in heads.items() if t)
    want |= {(i, j) for i, a in distinct for j, b in distinct if i < j and 20 * common(a, b) >= 7 * (len(a) + len(b))}
    assert got == want


def some_names(rng, n):
    out = {"".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 12))).strip() for _ in range(n)} - {""}
    return sorted({" ".join(x.split()) for x in out})


@pytest.mark.parametrize("limit", [0.6, 0.7, 0.8, 0.9])
def test_similar_names_against_all_pairs(spark, limit):
    rng = random.Random(int(limit * 10))
    a, b = some_names(rng, 80), some_names(rng, 80)
    frame = lambda x, c: spark.createDataFrame([(v,) for v in [*x, x[0], None, ""]], f"{c} string")
    pairs = names.similar_pairs(frame(a, "a"), frame(b, "b"), "a", "b", limit)
    want = {(x, y) for x in a for y in b if 1 - distance(x, y) / max(len(x), len(y)) >= limit - 1e-9}
    assert {(r.a, r.b) for r in pairs.collect()} == want
    plan = pairs._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_best_names_first_candidate_wins(spark):
    rng = random.Random(9)
    a, b = some_names(rng, 60), some_names(rng, 60)
    rng.shuffle(b)

    def score(x, y):
        tx, ty = set(x.split()), set(y.split())
        return round(max(1 - distance(x, y) / max(len(x), len(y)), len(tx & ty) / len(tx | ty), 0.9 * (tx <= ty or ty <= tx)), 9)

    want = {}
    for x in a:
        best = min(((-score(x, y), i, y) for i, y in enumerate(b)), key=lambda z: z[:2])
        if -best[0] >= 0.6:
            want[x] = (best[2], -best[0])
    pool = spark.createDataFrame([(y, i) for i, y in enumerate(b)], "candidate string, place int")
    got = {r.name: (r.candidate, r.score) for r in names.best_names(spark.createDataFrame([(x,) for x in a], "name string"), pool, "name", "candidate", "place").collect()}
    assert got == want


def test_variants_and_roster(spark):
    who = [("Kenji",), ("Kenji Sato",), ("Kenji's mother",), ("Kenji 2",), ("KENJI SATO!",), ("Mr. Daryy",), ("Mr. Darcy",), ("Long Haired Girl",), ("Long Hailed Girl",)]
    canon = spark.createDataFrame(who, "canonical string")
    got = {(r.name, r.canonical) for r in names.uncertain_variants(spark.createDataFrame(who, "name string"), canon, "name", "canonical").collect()}
    assert ("Kenji", "Kenji Sato") in got and ("Kenji Sato", "Kenji") in got and ("Long Haired Girl", "Long Hailed Girl") in got and ("Kenji Sato", "KENJI SATO!") in got
    assert not any("mother" in a + b or "2" in a + b for a, b in got)
    answers = spark.createDataFrame([("Mr. Daryy",), ("Emma",), ("Mr. Darcy",), ("Bingley",)], "answer string")
    roster = spark.createDataFrame([("Mr. Darcy",), ("Emma",), ("Mr. Darcx",)], "member string")
    near = {r.answer: r.repaired for r in names.repaired_to_roster(answers, roster, "answer", "member").collect()}
    assert near["Emma"] == "Emma" and near["Bingley"] == "Bingley" and near["Mr. Daryy"] == min(("Mr. Darcy", "Mr. Darcx"), key=lambda m: (distance("Mr. Daryy", m), m))


def test_first_independent_and_colours_as_one_by_one(spark):
    rng = random.Random(4)
    nodes = list(range(60))
    use = {n: rng.randrange(6) for n in nodes}
    order = sorted(nodes, key=lambda n: (-use[n], n))
    place = {n: i for i, n in enumerate(order)}
    edges = {tuple(sorted(rng.sample(nodes, 2))) for _ in range(110)}
    near = {n: {a + b - n for a, b in edges if n in (a, b)} for n in nodes}
    accepted, colour = set(), {}
    for n in order:
        if not near[n] & accepted:
            accepted.add(n)
        taken = {colour[m] for m in near[n] if m in colour}
        colour[n] = next(c for c in range(99) if c not in taken)
    table = spark.createDataFrame(list(use.items()), "n long, used long")
    directed = greedy.ordered_edges(spark.createDataFrame([*edges, (3, 3)], "a long, b long"), "a", "b", table, "n", [-F.col("used")])
    assert {(r.late, r.early) for r in directed.collect()} == {tuple(sorted(e, key=lambda n: -place[n])) for e in edges}
    assert {r.late for r in greedy.first_independent(directed).collect()} == set(nodes) - accepted
    assert {r.n: r.colour for r in greedy.colours(table, "n", directed).collect()} == colour
    assert greedy.first_independent(directed.limit(0)).count() == 0


ANSWERS = {
    "two arrays": ('[{"text": "one"}]\n[{"text": "two"}]', [(1, 0, "whole"), (2, 0, "whole")], "joined"),
    "overlap": ('[{"text": "before the repeated words here"}]\n[{"text": "repeated words here after"}]', [(1, 0, "whole"), (2, 0, "whole")], "overlap"),
    "two words are no overlap": ('[{"text": "before repeated words"}]\n[{"text": "repeated words after"}]', [(1, 0, "whole"), (2, 0, "whole")], "joined"),
    "text between": ('[{"text": "one"}] malformed [{"text": "two"}]', [(1, 0, "whole"), (2, 0, "whole")], "ambiguous"),
    "bracketed prose": ('[{"text": "one"}]\nNote: preserve [speaker] labels.', [(1, 0, "whole")], "one"),
    "broken entry": ('[{"text": "one"}]\n[{"text":}]', [(1, 0, "whole"), (2, 0, "broken")], "rejected"),
    "cut off": ('[{"text": "one"}, {"text": "two"}, {"te', [(1, 0, "salvaged"), (1, 1, "salvaged")], "salvaged"),
    "cut in a string": ('[{"text": "one"}, {"text": "tw', [(1, 0, "salvaged")], "salvaged"),
    "missing commas": ('[{"text": "one"} {"text": "two"}]', [(1, 0, "whole"), (1, 1, "whole")], "one"),
    "commas too many": ('[{"text": "one",}, {"text": "a, }", "l": [1, 2,],},]', [(1, 0, "mended"), (1, 1, "mended")], "one"),
    "line feed in a string": ('[{"text": "one\ntwo"}]', [(1, 0, "mended")], "one"),
    "thinking": ('<think>[{"text": "no"}]</think>[{"text": "one"}]<thinking>[{"text": "never closed"}', [(1, 0, "whole")], "one"),
    "fence": ('Use {this}, "now:\n```json\n[{"text": "]}\\"["}]\n``` and [{"text": "two"}]', [(1, 0, "whole")], "one"),
    "nested": ('[{"text": "one", "more": [{"text": "in"}]}, [{"text": "two"}]]', [(1, 0, "whole"), (1, 1, "whole")], "one"),
    "inside a broken object": ('[{"a": , "b": {"text": "in"}}]', [(1, 0, "whole")], "one"),
    "wrapped": ('Here: {"entries": [{"text": "one"}]}', [(0, 0, "whole")], None),
    "brackets that don't match": ('[{"text": "one"}}, {"text": "two"}]', [(1, 0, "whole"), (1, 1, "whole")], "one"),
    "nothing": ("no json here", [], None),
    "empty": ("", [], None),
    "null": (None, [], None),
}


def test_objects_of_damaged_answers(spark):
    rows = spark.createDataFrame([(name, text) for name, (text, _, _) in ANSWERS.items()], "name string, answer string")
    found = loose_json.objects(rows, "answer", ["name"])
    got = {}
    for r in found.collect():
        got.setdefault(r.name, []).append((r.array, r["item"], r.state))
        if r.state == "whole":
            assert json.loads(ANSWERS[r.name][0][r.start : r.end]) == json.loads(r.value)
        assert (r.value is None) == (r.state == "broken")
    states = {r.name: r.state for r in loose_json.one_answer(found, ["name"]).collect()}
    for name, (_, want, state) in ANSWERS.items():
        assert sorted(got.get(name, [])) == want, name
        assert states.get(name) == state, name


def test_deeply_nested_text_is_one_pass():
    text = '[{"a": ' * 3000 + "1"
    assert list(loose_json.Scan(text).rows()) == []
    text = "[" + ", ".join('{"a": {"b": [%d]}}' % i for i in range(3000)) + "]"
    assert len(list(loose_json.Scan(text).rows())) == 3000


def test_chunks_keep_quotes_and_chapters_whole(spark):
    rng = random.Random(5)
    piece = lambda: rng.choice(["He went on.", "“Stay here", "she said.”", '"Now?" he asked.', "「はい。", "そう」と言った。", "word " * rng.randrange(1, 60)])
    texts = ["\n\n".join(rng.choice(["Chapter %d" % rng.randrange(9), *(" ".join(piece() for _ in range(rng.randrange(1, 6))) for _ in range(4))]) for _ in range(rng.randrange(1, 25))) for _ in range(30)]
    texts += [None, "", "   \n\n ", "x" * 1000, "“" + "a. " * 400 + "”", "Chapter 1\n\n" + "A. " * 300]
    most, slack = 200, 1.5
    parts = passages.paragraphs(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text")
    rows = {}
    for r in parts.collect():
        rows.setdefault(r.id, []).append(r)
    chunks = {}
    for r in passages.structural_chunks(parts, "id", most, slack).collect():
        chunks.setdefault(r.id, []).append(r)
    squeeze = lambda x: "".join(x.split())
    assert set(chunks) == set(rows) == {i for i, t in enumerate(texts) if t and t.strip()}
    for i, cs in chunks.items():
        cs.sort(key=lambda r: r.chunk)
        ps = sorted(rows[i], key=lambda r: r.pos)
        assert [c.chunk for c in cs] == list(range(len(cs)))
        assert squeeze("".join(c.text for c in cs)) == squeeze("".join(p.text for p in ps))  # nothing is lost or moved
        for chapter in {p.chapter for p in ps}:
            assert squeeze("".join(c.text for c in cs if c.chapter == chapter)) == squeeze("".join(p.text for p in ps if p.chapter == chapter))
        for c, after in zip(cs, cs[1:]):
            overlong = {p.pos for p in ps if len(p.text) > most}
            if c.depth and c.chapter == after.chapter and not overlong & {c.first, after.first}:  # it ends in a quote only where more would be too long
                assert len(c.text) + 2 + len(after.text) > most * slack
        assert all(len(c.text) <= max(2 * most, most * slack) for c in cs)


def test_overlong_quotes_have_a_defined_cut():
    assert passages.legal_cut("One. Two. " + "x" * 50, 20, 0) == len("One. Two. ")
    assert passages.legal_cut("“" + "a" * 30 + "” b", 20, 0) == 32  # where the quote closes
    assert passages.legal_cut("“" + "a" * 90, 20, 0) == 20  # it doesn't close in time
    assert passages.legal_cut("“a. " + "b " * 30, 20, 0) == len("“a. ")
    assert passages.depth_after("「a『b』", 0) == 1 and passages.depth_after('"a" "b', 0) == 1 and passages.depth_after("”", 0) == 0


def test_entries_are_located_forward(spark):
    source = 'Oh. “Yes,” he said. Oh. Then   more. Oh. The end.'
    entries = ["Oh.", "Yes,", "Oh.", "Then more.", "never there", "Oh.", "Oh.", "", "The end."]
    rows = [(1, i, t) for i, t in enumerate(entries)] + [(2, 0, "Oh.")]
    got = {(r.k, r.i): (r.start, r.end, r.how) for r in passages.located_forward(spark.createDataFrame(rows, "k long, i long, t string"), spark.createDataFrame([(1, source), (3, "x")], "k long, t string"), "k", "i", "t").collect()}
    text, cursor, want = "Oh. Yes, he said. Oh. Then more. Oh. The end.", 0, {(2, 0): (None, None, "not_found")}
    for i, t in enumerate(entries):
        at = text.find(t, cursor) if t else -1
        how = "forward" if at >= 0 else "anywhere"
        at = text.find(t) if at < 0 and t else at
        if at >= 0:
            cursor = at + len(t)
        want[1, i] = (at, at + len(t), how) if at >= 0 else (None, None, "not_found" if t else "empty")
    assert got == want and want[1, 6][2] == "anywhere" and want[1, 2][0] > want[1, 1][0]


def direct_run(kinds):
    run, last = 0, -1
    for step, k in enumerate(kinds):
        if k == "s":
            run, last = step + 1, step
        elif k == "p" or k == "o" and step - last > 4:
            break
    return run


def test_colophons_go_from_both_ends(spark):
    rng = random.Random(6)
    sign = ["All rights reserved.", "ISBN 123", "© 2019 by N.", "Title: A", "Contents", "chapter 1 chapter 2 chapter iii"]
    other, prose = ["A street 5", "The book"], ["The river ran on. " * 40]
    books = [["© 1"] * 2 + prose * 9 + ["ISBN 1"], ["x"] * 7, ["All rights reserved."] * 20, prose * 10, ["x"] * 6 + ["ISBN 1"] + prose * 9, ["x"] * 5 + ["ISBN 1"] + prose * 9]
    books += [[rng.choice(rng.choice([sign, sign, other, other, prose, [""]])) for _ in range(rng.randrange(3, 130))] for _ in range(60)]
    rows = spark.createDataFrame([(i, "\n\n".join(b)) for i, b in enumerate(books)] + [(999, None)], "i long, t string")
    kind = lambda x: "b" if not x.strip() else "s" if x in sign or x.startswith(("©", "ISBN")) else "p" if len(x) > 400 else "o"
    for r in colophons.without_colophon(rows, "t").collect():
        if r.i == 999:
            assert (r.t, r.front, r.back) == (None, 0, 0)
            continue
        p = "\n\n".join(books[r.i]).split("\n\n")
        limit = min(len(p) // 2, max(40, int(len(p) * 0.1)))
        front, back = direct_run([kind(x) for x in p[:limit]]), direct_run([kind(x) for x in p[::-1][:limit]])
        if len(p) < 8 or front + back > 0.8 * len(p):
            front = back = 0
        assert (r.front, r.back) == (front, back) and r.t == "\n\n".join(p[front : len(p) - back])


def test_bootstrap_without_copies(spark):
    rng = np.random.default_rng(7)
    a, b = rng.lognormal(3, 1, 900), rng.lognormal(2.5, 1, 700)
    rows = spark.createDataFrame([(1, "a", float(x)) for x in a] + [(1, "b", float(x)) for x in b] + [(2, "a", 1.0), (1, "b", None), (1, "c", 5.0)], "g int, arm string, x double")
    r = resampling.median_ratio(rows, ["g"], "arm", "x", "a", "b", draws=3000).collect()
    assert [x.g for x in r] == [1] and abs(r[0].ratio / (np.median(a) / np.median(b)) - 1) < 0.003
    drawn = [np.median(rng.choice(a, len(a))) / np.median(rng.choice(b, len(b))) for _ in range(3000)]
    low, high = np.quantile(drawn, [0.025, 0.975])
    assert abs(r[0].low / low - 1) < 0.03 and abs(r[0].high / high - 1) < 0.03  # the tolerance
    again = resampling.median_ratio(rows.repartition(5), ["g"], "arm", "x", "a", "b", draws=3000).first()
    assert (again.low, again.high) == (r[0].low, r[0].high)


def test_incomplete_beta():
    import math

    for n, k, p in ((10, 3, 0.2), (50, 50, 0.9), (400, 100, 0.3), (7, 1, 0.01), (5, 0, 0.5)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert abs(stats.binomial_upper(k, n, p) - want) < 1e-12
    for a, b, share in ((2, 3, 0.1), (40, 2, 0.975), (1, 1, 0.5)):
        assert abs(stats.incomplete_beta(a, b, stats.beta_quantile(share, a, b)) - share) < 1e-10


def cheapest(a, b, most, least):
    """The cost of the cheapest way, by relaxing all steps forward until nothing changes."""
    from tessera.functions import lattice

    cost = {(0, 0): 0.0}
    for _ in range(len(a) + len(b) + 1):
        for (i, j), c in list(cost.items()):
            for di, dj, more, _ in lattice.edges(a, b, i, j, most, least):
                cost[i + di, j + dj] = min(cost.get((i + di, j + dj), 1e9), c + more)
    return cost[len(a), len(b)]


def test_lattice_against_a_plain_search():
    from tessera.functions import lattice

    rng = random.Random(8)
    words = ["lab", "coat", "labcoat", "should", "have", "shouldhave", "2008", "two", "thousand", "eight", "and", "a", "right", "aright", "eyed", "bairoth", "id", "beroth"]
    for _ in range(120):
        a, b = ([rng.choice(words) for _ in range(rng.randrange(0, 8))] for _ in range(2))
        steps = lattice.path(a, b)
        assert [i for i, di, *_ in steps for i in range(i, i + di)] == list(range(len(a))) and [j for _, _, j, dj, _ in steps for j in range(j, j + dj)] == list(range(len(b)))
        cost = 0.0
        for i, di, j, dj, kind in steps:
            cost += next(c for x, y, c, k in lattice.edges(a, b, i, j, 4, 0.7) if (x, y, k) == (di, dj, kind))
        assert abs(cost - cheapest(a, b, 4, 0.7)) < 1e-9
    kinds = lambda a, b: [k for *_, k in lattice.path(a.split(), b.split())]
    assert kinds("the lapcoat is", "the lab coat is") == ["equal", "joined", "equal"]
    assert kinds("should have gone", "shouldhave gone") == ["split", "equal"]
    assert kinds("in two thousand eight we", "in 2008 we") == ["equal", "number", "equal"]
    assert kinds("in 2008 we", "in two thousand and eight we") == ["equal", "number", "equal"]
    assert "skip_a" in kinds("um the end", "the end") and lattice.path([], []) == []
    long = [f"w{i}" for i in range(600)]
    assert lattice.long_path(long, long[:300] + ["lab", "coat"] + long[300:], cells=1000).count((300, 0, 300, 1, "skip_b")) == 1


def test_boundaries_and_marks(spark):
    rows = spark.createDataFrame([(1, "um the lapcoat is [pause] white", "So: the lab coat is white. Yes"), (2, None, "x"), (3, "", None)], "i int, heard string, source string")
    r = {x.i: x for x in alignment.boundaries(rows, "heard", "source").collect()}
    assert (r[1].start, r[1].end, r[1].joined, r[1].equal) == (1, 6, 1, 3) and r[2].start is None and r[3].skip_b == 0
    texts = {x.i: x.merged for x in alignment.with_marks(rows, "heard", "source", "merged").collect()}
    assert texts == {1: "So: the lab coat is [pause] white. Yes", 2: "x", 3: ""}


@pytest.mark.parametrize("seed,top,tolerance", [(1, 30, 0.25), (2, 400, 0.25), (3, 60, 0.1), (4, 12, 1.0)])
def test_matching_as_one_by_one(spark, seed, top, tolerance):
    rng = random.Random(seed)
    probes = [(i, rng.choice("ab"), rng.randrange(1, top)) for i in rng.sample(range(500), 40)] + [(900, "a", None), (901, "c", 5)]
    others = [(i, rng.choice("ab"), rng.randrange(1, top)) for i in rng.sample(range(500), 35)] + [(902, "a", None)]
    edges = sorted((abs(n - m), p, c) for p, x, n in probes for c, y, m in others if x == y and n is not None and m is not None and abs(n - m) <= tolerance * n)
    used_p, used_c, want = set(), set(), {p: (None, None) for p, _, _ in probes}
    for cost, p, c in edges:
        if p not in used_p and c not in used_c:
            used_p.add(p)
            used_c.add(c)
            want[p] = (c, float(cost))
    frame = lambda rows: spark.createDataFrame(rows, "id long, cell string, n long")
    got = {r.id: (r.candidate, r.cost) for r in greedy.matched_pairs(frame(probes), frame(others), "id", "n", ["cell"], tolerance).collect()}
    assert got == want
