"""Steps of queries that took too long, too much disk or too much of one task, held against plain forms."""

import random
from fractions import Fraction

import numpy as np

from pyspark.sql import functions as F

from tessera.functions.pairing import common_length
from tessera.operators import aggregations as A
from tessera.operators import alignment as L
from tessera.operators import cascades, scripts


def test_windows_are_tested_side_by_side_as_one_by_one():
    rng = random.Random(7)
    p, q = limit = (9, 20)
    chunks = [np.array([rng.randrange(9) for _ in range(n)], np.int64) for n in (1, 5, 8, 63)]
    texts = [np.array([rng.randrange(12) for _ in range(rng.randrange(1, 30))], np.int64) for _ in range(20)]
    places = np.zeros((13, len(chunks)), np.uint64)
    for k, c in enumerate(chunks):
        for i, w in enumerate(c):
            places[w, k] |= np.uint64(1) << np.uint64(i)
    codes = np.concatenate(texts)
    lengths = np.array([len(x) for x in texts])
    begin, size = np.repeat(np.cumsum(lengths) - lengths, len(chunks)), np.repeat(lengths, len(chunks))
    column = np.tile(np.arange(len(chunks)), len(texts))
    n = np.array([len(c) for c in chunks])[column]
    pairs = [(chunks[k].tolist(), x.tolist()) for x in texts for k in range(len(chunks))]
    assert L._in_order(places, codes, begin, size, column, n).tolist() == [common_length(c, x) for c, x in pairs]
    best = [max(2 * q * m - p * (len(c) + b - a) if (m := common_length(c, x[a:b])) else -1 for a in range(len(x)) for b in range(a + 1, len(x) + 1)) for c, x in pairs]
    for some in (7, 1 << 10):
        got = L._span_scores(places, codes, begin, size, column, n, limit, some)
        assert [x >= 0 for x in got] == [x >= 0 for x in best] and all(x == y for x, y in zip(got, best) if y >= 0)
    dense = L._dense_scores(places, codes, begin, size, column, limit)
    assert [d >= p * len(c) for d, (c, _) in zip(dense, pairs)] == [L._dense(np.isin(x, c), len(c), limit) for c, x in pairs]


def test_best_matches_of_short_and_long_chunks(spark):
    rng = random.Random(8)
    words = lambda n: [rng.choice("abcdefghijklmnopqrst") for _ in range(n)]
    chunks = {i: words(n) for i, n in enumerate((3, 12, 63, 64, 90))}
    sources = {j: words(30) + [w for w in chunks[j % 5] if rng.random() < 0.8] + words(25) for j in range(10)}
    frame = lambda x: spark.createDataFrame([(k, " ".join(v)) for k, v in x.items()], "id int, text string")
    found = L.best_matches(frame(chunks).withColumnRenamed("id", "c"), frame(sources).withColumnRenamed("id", "s"), "c", "s", limit=Fraction(1, 2))
    got = {(r.c, r.s): (r.start, r.end, r.matched) for r in found.collect()}
    want = {}
    for i, c in chunks.items():
        for j, s in sources.items():
            spans = []
            for a in range(len(s)):
                for b in range(a + 1, min(len(s), a + 3 * len(c)) + 1):
                    if s[a] in c and s[b - 1] in c:
                        m = common_length(c, s[a:b])
                        if 4 * m >= len(c) + b - a:
                            spans.append((Fraction(-2 * m, len(c) + b - a), a, b, m))
            if spans:
                want[i, j] = min(spans)[1:]
    assert got == want


def test_like_texts_meet_in_blocks(spark):
    rng = random.Random(9)
    texts: dict = {}
    for i in range(90):
        near = [w if rng.random() < 0.85 else rng.choice("abcdefgh") for w in texts.get(rng.randrange(90), "").split()]
        texts[i] = " ".join(near or [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([1, 2, 5, 9, 10, 30]))])
    texts |= {200: texts[3], 201: texts[3], 202: "", 203: None}
    frame = spark.createDataFrame(list(texts.items()), "i int, text string").repartition(3)
    lists = {i: (t or "").split() for i, t in texts.items() if t}
    first = {tuple(w): i for i, w in sorted(lists.items(), reverse=True)}
    heads = sorted(first.values())
    alike = lambda a, b: 10 * 2 * common_length(a, b) >= 7 * (len(a) + len(b))
    want = {(a, b) for a in heads for b in heads if a < b and alike(lists[a], lists[b])} | {(first[tuple(w)], i) for i, w in lists.items() if first[tuple(w)] != i}
    assert len(want) > 20
    for block in (40, 300, 1 << 20):  # one block, or many of few words
        got = [(r.a, r.b) for r in L.like_texts(frame, "i", "text", block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_hits_of_blocks_are_taken_some_at_a_time():
    rng = random.Random(10)
    n = 40
    sizes = np.array(sorted(rng.randrange(1, 12) for _ in range(n)))
    words = np.array([rng.randrange(6) for _ in range(int(sizes.sum()))], np.int64)

    class Often:
        value = np.zeros(L.CLASSES, np.int64)

    import pyarrow as pa

    ends = np.r_[0, np.cumsum(sizes)]
    lists = [words[a:b].tolist() for a, b in zip(ends, ends[1:])]
    batch = pa.record_batch([pa.array(range(n)), pa.array(lists, pa.list_(pa.int64()))], names=["a", "w"])
    L_blocks = L._blocks(Often, 1 << 20, (7, 10))
    import pyspark

    context, pyspark.TaskContext.get = pyspark.TaskContext.get, lambda: type("C", (), {"partitionId": lambda self: 0})()
    try:
        (made,) = L_blocks([batch])
    finally:
        pyspark.TaskContext.get = context
    side = {c: made.column(c)[0].values.to_numpy() for c in ("words", "feature", "size", "owner", "place")}
    want = [(i, j) for i in range(n) for j in range(i + 1, n) if 20 * common_length(lists[i], lists[j]) >= 7 * (len(lists[i]) + len(lists[j]))]
    for some in (1, 50, 1 << 22):
        assert sorted(L._alike(side, side, True, (7, 10), some)) == want


def test_shared_tokens_meet_where_rows_are_read(spark):
    rng = random.Random(11)
    sets = lambda n: {i: rng.sample("abcdefghijkl", rng.randrange(0, 7)) for i in range(n)}
    a, b = sets(30), sets(60)
    frame = lambda x, i, t: spark.createDataFrame(list(x.items()), f"{i} int, {t} array<string>")
    good = lambda na, nb, shared: (2 * shared >= na) | (shared == nb)
    want = {(i, j, len(x), len(y), n) for i, x in a.items() for j, y in b.items() if (n := len(set(x) & set(y))) and (2 * n >= len(x) or n == len(y))}
    for block in (20, 1 << 18):
        found = cascades.shared_tokens(frame(a, "l", "ta"), frame(b, "r", "tb"), "ta", "tb", good, block)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        got = [(r.l, r.r, r.na, r.nb, r.shared) for r in found.collect()]
        assert len(got) == len(want) and set(got) == want


def test_cascade_against_all_pairs(spark):
    rng = random.Random(12)
    text = lambda: " ".join(rng.choice(["ab", "abc", "abcd", "b", "cde", "f g"]) for _ in range(rng.choice([1, 5, 6])))
    raws, names = {i: text() for i in range(40)}, {i: text() for i in range(12)}
    want = {}
    for i, x in raws.items():
        found = []
        for j, y in names.items():
            short, long = sorted((x, y), key=len)
            wx, wy = set(x.split()), set(y.split())
            inside = f" {x} " in f" {y} " or f" {y} " in f" {x} " or (len(short) >= 3 and len(long) - len(short) <= 2 and long.startswith(short))
            score = len(wx & wy) / len(wx | wy)
            if tier := 1 if x == y else 2 if inside else 3 if score >= 0.4 else 0:
                found.append((tier, -score if tier == 3 else -1.0, j))
        if found:
            tier, score, j = min(found)
            want[i] = (j, tier, round(-score, 9))
    frame = lambda x, i: spark.createDataFrame(list(x.items()), f"{i} int, text string")
    got = {r.raw: (r.name, r.tier, round(r.score, 9)) for r in cascades.fuzzy_cascade(frame(raws, "raw"), frame(names, "name"), "raw", "name", "text").collect()}
    assert got == want and {x[1] for x in want.values()} == {1, 2, 3}


def test_percentiles_are_those_of_spark_and_no_task_has_a_key(spark):
    rng = random.Random(13)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.5, rng.random() * 9])) for _ in range(400)] + [("none", None), ("one", 2.0)]
    frame = spark.createDataFrame(rows, "k string, v double")
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    found = A.percentiles(frame, ["k"], "v", shares)
    want = frame.groupBy("k").agg(*(F.percentile("v", F.lit(p)).alias(f"p{round(100 * p)}") for p in shares))
    near = lambda df: {r[0]: [x if x is None else round(x, 9) for x in r[1:]] for r in df.collect()}
    assert near(found) == near(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan


def test_rows_are_dealt_out_by_their_number(spark):
    frame = spark.range(1000).withColumn("k", F.col("id") % 50)
    found = A.dealt(frame, "k", rows=10)
    assert found.rdd.getNumPartitions() == 100 and found.select("id").distinct().count() == 1000
    ranked = A.average_rank(found, ["k"], "id", "r")
    assert "ENSURE_REQUIREMENTS" not in ranked._jdf.queryExecution().executedPlan().toString()


def test_words_of_a_batch_become_strings_a_few_rows_at_a_time(spark):
    import tracemalloc

    import pyarrow as pa

    batch = pa.record_batch([pa.array([["word"] * 300] * 2000)] * 2, names=["a", "b"])
    tracemalloc.start()
    n = sum(len(a) + len(b) for a, b in scripts.each_row(batch, "a", "b"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1_200_000 and peak < 8 << 20
    frame = spark.createDataFrame([(i, "a b c d e f g", "a g") for i in range(150)], "i int, x string, y string")
    got = {(r.i, r["rank"], r.start, r.length) for r in scripts.missing_spans(frame, "i", "x", "y", 5, 3).collect()}
    assert got == {(i, 1, 1, 5) for i in range(150)}
