"""Steps that grew faster than their input, held against plain forms and against time."""

import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from tessera.functions import pairing
from tessera.functions.text import ended_by_stops
from tessera.operators import aggregations as A
from tessera.operators import evidence as V
from tessera.operators import gates as G
from tessera.operators import greedy


def test_a_text_without_stops_is_split_once(spark):
    texts = ["a. b.. c", "", None, "..", ". x .", "no stop", "x" * 400_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    start = time.monotonic()
    got = {r.i: r.s for r in frame.select("i", ended_by_stops(F.col("t")).alias("s")).collect()}
    assert time.monotonic() - start < 30
    assert all(got[i] == re.findall(r"[^.]+\.", t or "") for i, t in enumerate(texts[:6])) and got[6] == []


def test_regions_of_a_text_of_one_paragraph_take_linear_time(spark):
    text = "he said “go “there and then.” Well. " * 20_000 + "“a “b” c”\n\n“d “e”\n\n“f"
    start = time.monotonic()
    found, repairs = G.regions_of(text)
    assert time.monotonic() - start < 10
    n = spark.createDataFrame([(1, text)], "k int, t string")
    r = G.quote_regions(n, "k", "t", listed=False).agg(F.count("*").alias("n"), F.max("n_repairs").alias("m")).first()
    assert (r.n, r.m) == (len(found), len(repairs))


def test_repairs_and_gates_of_a_long_source(spark):
    lines = [f"Line number {i} of the long text." for i in range(20_000)]
    source = spark.createDataFrame([(1, " ".join(lines))], "id int, source string")
    given = [(1, 10 * i, x.replace("a", "а") if i % 7 == 3 else x) for i, x in enumerate(lines)] + [(1, 10 * i + 12, lines[i]) for i in range(0, 20_000, 9)] + [(1, 10 * i + 11, lines[i - 1]) for i in range(9, 20_000, 9)]
    start = time.monotonic()
    out = G.repaired(spark.createDataFrame(given, "id int, pos int, t string"), source, "id", "pos", "t", "source").agg(F.count("*").alias("n")).first()
    assert time.monotonic() - start < 60 and 20_000 <= out.n <= len(given)


def test_edits_by_bits():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in "ab")
        assert pairing.edits(a, b) == sum(pairing.edit_counts(a, b))
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(4_000)) for _ in "ab")
    start = time.monotonic()
    pairing.edits(a, b)
    assert time.monotonic() - start < 1


def test_grams_are_not_shuffled(spark):
    texts = [(1, "a b c d a", "a b c"), (1, "x a", "a a"), (2, "", "y"), (3, "p  q", ""), (None, "a", "b"), (4, None, None)]
    frame = spark.createDataFrame(texts, "k int, s string, o string")
    found = V.chunk_gate(frame, ["k"], "s", "o")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    got = {r.k: (r.recall, r.trigrams, r.ratio) for r in found.collect()}
    s, o = Counter("a b c d a x a".split()), Counter("a b c a a".split())
    assert got == {1: (round((s & o).total() / 7 + 1e-9, 6), round(1 / 3 + 1e-9, 6), round(5 / 7 + 1e-9, 6)), 2: (1.0, 1.0, 1.0), 3: (0.0, 1.0, 0.0), None: (1.0, 1.0, 1.0), 4: (1.0, 1.0, 1.0)}


def test_colours_of_cells_are_those_of_their_pairs(spark):
    rng = random.Random(5)
    members = [(rng.randrange(60), rng.choice([1, 2, 3, None]), rng.choice("abcdef")) for _ in range(200)]
    nodes = [(n, rng.randrange(5)) for n in range(60)]
    cells: dict = {}
    for n, a, b in members:
        if a is not None:
            cells.setdefault((a, b), set()).add(n)
    want: dict = {}
    for n, _ in sorted(nodes, key=lambda x: (-x[1], x[0])):
        taken = {want[m] for c in cells.values() if n in c for m in c if m in want}
        want[n] = next(k for k in range(99) if k not in taken)
    rows, order = spark.createDataFrame(members, "n int, a int, b string"), spark.createDataFrame(nodes, "n int, use int")
    for block in (1 << 20, 70):
        got = greedy.clique_colours(rows, "n", ["a", "b"], order, [-F.col("use")], block)
        assert {r.n: r.colour for r in got.collect()} == want


def test_coverage_shuffles_texts_not_tokens(spark):
    frame = spark.createDataFrame([(1, "A b b c", "b B x"), (2, "", "y"), (3, None, None), (None, "a", "a"), (1, "x", None)], "k int, s string, o string")
    found = A.shared_words(frame, ["k"], "s", "o")
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.k: (r.n_source, r.n_output, r.met) for r in found.collect()} == {1: (5, 3, 3), 2: (0, 1, 0), None: (1, 1, 1)}
