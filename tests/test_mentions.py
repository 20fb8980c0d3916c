"""Numbers in words, lost characters, support, spread, published stores and annotation files, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import numerals as N
from tessera.operators import mentions as M
from tessera.sources import files
from tessera.sources.published import StaleOutput, Store, fingerprint


def test_numbers(spark):
    cases = {"forty-seven": 47, "two thousand and eight": 2008, "sixteen hundred eleven": 1611, "2008": 2008, "and": None, "twelve apples": None, "Hundred": 100, "": None, "ten thousand": None, "five-": None, "20081": None}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "s string, want long")
    for r in rows.withColumn("got", N.number(F.split("s", " "))).collect():
        assert r.got == r.want, r.s
    said = {"0": "zero", "007": "seven", "25": "twenty five", "310": "three hundred ten", "2016": "twenty sixteen", "2005": "two thousand five", "1900": "nineteen hundred", "1805": "eighteen oh five", "1042": "one zero four two", "12345678901234567890123": None, "x1": None, "": None}
    for r in spark.createDataFrame([(k, v) for k, v in said.items()], "s string, want string").withColumn("got", N.said(F.col("s"))).collect():
        assert r.got == (r.want or (" ".join(N.ONES[int(d)] for d in r.s) if r.s.isdigit() else None)), r.s


X = N.LOST

#: (a text, what it was): marks before years, quotes at words' edges and after full stops, apostrophes, dashes, and runs of lost characters.
LOST_AND_FOUND = [
    (f"{X} 1999 x", "© 1999 x"),
    (f"a{X}2011", "a©2011"),
    (f"{X}Hello", "“Hello"),
    (f"so: {X}yes", "so: “yes"),
    (f"Stop.{X} He went", "Stop.” He went"),
    (f"well,{X}\nshe", "well,”\nshe"),
    (f"don{X}t", "don’t"),
    (f"word{X}Next", "word—Next"),
    (f"1914{X}x", "1914–x"),
    (f"page 3{X}", "page 3–"),
    (f"yes{X} and", f"yes{X} and"),
    (X, X),
    (f"a{X}{X}b", f"a…{X}b"),
    (f"end{X}{X} x", "end…” x"),
    (f"x {X}{X}y", f"x “{X}y"),
    (f"a{X}{X}{X} z", "a……” z"),
    (f"{X}{X} 2001", "“© 2001"),
    ("plain", "plain"),
    ("", ""),
    (None, None),
]


def test_lost_characters(spark):
    rows = spark.createDataFrame([(i, s, want) for i, (s, want) in enumerate(LOST_AND_FOUND)], "i int, s string, want string")
    for r in rows.withColumn("got", N.restored(F.col("s"))).collect():
        assert r.got == r.want, r.s


def test_only_lost_characters_change(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(X * 6 + "aZé1 .,\n?;-") for _ in range(rng.randrange(30))) for _ in range(300)]
    for r in spark.createDataFrame([(s,) for s in texts], "s string").withColumn("got", N.restored(F.col("s"))).collect():
        assert len(r.got) == len(r.s) and all(a == b for a, b in zip(r.s, r.got) if a != X)


def test_longest_support(spark):
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, some(rng.randrange(12))) for i in range(12)] + [(90, None), (91, "x y z x y z")]
    docs = [(i, some(rng.randrange(25))) for i in range(12)] + [(90, None), (91, "")]
    got = {r.item: (r.longest, r.times) for r in M.longest_support(spark.createDataFrame(items, "item int, text string"), spark.createDataFrame(docs, "doc int, text string"), "item", "doc", 3).collect()}
    held = [(d or "").split() for _, d in docs]
    for i, text in items:
        words, want = (text or "").split(), (0, 0)
        for size in range(len(words), 2, -1):
            times = lambda g: sum(d[p : p + size] == g for d in held for p in range(len(d) - size + 1))  # noqa: E731,B023
            best = max(times(words[s : s + size]) for s in range(len(words) - size + 1))
            if best:
                want = (size, best)
                break
        assert got[i] == want, text


def test_spread(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, 10.0), (4, 5.0), (5, None), (6, 2.0)], "k int, v double")
    assert [(r.k, r["rank"]) for r in M.spread(rows, "k", "v", 9).orderBy("rank").collect()] == [(2, 1), (1, 2), (4, 3), (6, 4)]
    assert M.spread(rows.limit(0), "k", "v", 3).count() == 0


def test_co_mentions(spark):
    p = spark.createDataFrame([(1, "Anna met Bert"), (2, "Anna met Bert"), (3, "Anna"), (4, None), (5, "Bert, Carl and Anna")], "k long, text string")
    got = {r.name: (r.passages, r["first"]) for r in M.co_mentions(p, spark.createDataFrame([("Anna",), ("Bert",), ("Carl",), ("Carl",)], "name string"), "k", "text", "name", 1).collect()}
    assert got == {"Anna": (2, "1"), "Bert": (2, "1"), "Carl": (1, "5")}


def test_published_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "x int")
    assert store.manifest() == {}
    store.publish({"a": one(1), "b": one(2)}, fmt="json")
    old = {p.name for p in (tmp_path / "store").iterdir() if p.is_dir()}
    (tmp_path / "store" / "a-orphan").mkdir()
    bad = one(1).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception):
        store.publish({"a": one(9), "b": bad})
    assert [store.read(n).first().x for n in "ab"] == [1, 2]  # neither is in force
    store.publish({"b": one(3)}, fmt="csv", mark="m", header=True)
    assert [store.read(n).first().x for n in "ab"] == [1, 3] and store.read("b", "m").count() == 1
    with pytest.raises(StaleOutput):
        store.read("b", "other")
    left = {p.name for p in (tmp_path / "store").iterdir() if p.is_dir()}
    assert len(left) == 2 and len(left & old) == 1


def test_stages_resume(spark, tmp_path):
    ran = []

    def add(n):
        def stage(df):
            ran.append(n)
            return df.withColumn("x", F.col("x") + n)

        return stage

    stages = [("one", add(1)), ("two", add(10))]
    start = spark.createDataFrame([(0,)], "x int")
    store = Store(spark, str(tmp_path / "s"))
    assert store.resumed(stages[:1], start, fingerprint("v1")).first().x == 1
    assert store.resumed(stages, start, fingerprint("v1")).first().x == 11 and ran == [1, 10]
    assert store.resumed(stages, start, fingerprint("v2")).first().x == 11 and ran == [1, 10, 1, 10]


def test_annotations(spark, tmp_path):
    (tmp_path / "a.ann").write_text("T1\tQuote 3 9;12 20\tsaid so\nT2\tCue\nR1\tSpeaker Arg1:T2 Arg2:T1\nbroken\n#1\tnote\n")
    spans, related = files.read_annotations(spark, str(tmp_path))
    assert [tuple(r)[1:] for r in spans.collect()] == [("T1", "Quote", 3, 20, "said so")]
    assert [tuple(r)[1:] for r in related.collect()] == [("Speaker", "T2", "T1")]
