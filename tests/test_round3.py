"""Queries on tables where forms that looked right gave other rows than their SQL, and steps that grew faster than their input."""

import random
import time
from datetime import datetime

import duckdb
from pyspark.sql import functions as F

from tessera.functions import lattice
from tessera.functions import numerals as N
from tessera.operators import alignment
from tessera.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def same_as_sql(spark, folder, name, **tables):
    """Rows of a query over tables (rows, schema), held against its SQL's."""
    duck = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    want, got = sorted(map(str, found.fetchall())), sorted(str(tuple(r[c] for c in names)) for r in df.collect())
    assert got == want
    return got


def test_large_part_keys_outweigh_a_hundredth(spark, tmp_path):
    part = [(900_000, "B1", 15, 1000.0), (3, "B1", 15, 1001.0), (7, "B2", None, 5.0), (8, "B2", 15, None), (9, "B2", 40, 5.0)]
    assert same_as_sql(spark, tmp_path, "i02_composite_score", part=(part, "p_partkey long, p_brand string, p_size int, p_retailprice double"))[0].startswith("('B1', 3,")


def test_empty_and_backward_intervals_overlap(spark, tmp_path):
    at = lambda h, m=0: datetime(2024, 1, 2, h, m)
    # a long one of user 1 about an empty and a backward one; empty ones at its ends; backward ones over midnight
    events = [(3, at(1), 1, 30.0), (5, at(2), 1, 0.0), (9, at(3), 1, -1.0), (13, at(1), 1, 0.0), (17, at(6), 1, 0.0), (21, at(9), 1, -3.0), (25, at(0, 5), 2, -2.0), (7, datetime(2024, 1, 1, 22), 2, 30.0), (29, at(1), 3, 1.0), (11, at(1, 5), 3, 0.0), (33, at(1), 4, None), (15, at(1), 4, 2.0)]
    got = same_as_sql(spark, tmp_path, "g12_overlap_semi", events=([(e, t, u, v) for e, t, u, v in events], "event_id long, ts timestamp_ntz, user_id long, value double"))
    assert {"(5,)", "(9,)", "(25,)", "(29,)"} <= set(got) and "(13,)" not in got


def test_names_end_before_letters_beyond_ascii(spark, tmp_path):
    benchmark = [(1, "Chgeß Adojaó Maria, Peters_ éPaul Anna"), (2, None)]
    conversations = [(1, 1, "Chge und Maria"), (1, 2, "Adoja Anna"), (2, 0, "Peters Anna"), (3, 1, "Paul Chge"), (3, 2, None)]
    assert len(same_as_sql(spark, tmp_path, "h13_co_mentions", benchmark=(benchmark, "item_id long, text string"), conversations=(conversations, "conv_id long, turn long, text string"))) == 5


def test_lost_characters_of_a_long_text(spark):
    n = 20_000
    rows = spark.createDataFrame([(f"don{N.LOST}t " * n,)], "s string").withColumn("got", N.restored(F.col("s")))
    start = time.monotonic()
    assert rows.first().got == "don’t " * n
    assert time.monotonic() - start < 30


def test_the_way_through_a_lattice_looks_at_few_cells(monkeypatch):
    rng = random.Random(1)
    b = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(200)]
    a = [w[:-1] if i % 7 == 6 and len(w) > 4 else w for i, w in enumerate(b)]
    a[50:52] = [a[50] + a[51]]
    seen, edges = [], lattice.edges
    monkeypatch.setattr(lattice, "edges", lambda *x: seen.append(x[2:4]) or edges(*x))
    steps = lattice.path(a, b)
    assert (50, 1, 50, 2, "joined") in steps and sum(s[1] for s in steps) == len(a) and sum(s[3] for s in steps) == len(b)
    assert len(seen) < len(a) * len(b) / 10


def test_sources_meet_chunks_where_they_are_read(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("the of a cat sat on mat and dog ran far off".split()) for _ in range(rng.randrange(120))) for _ in range(30)]
    chunks = spark.createDataFrame([(i, " ".join(t.split()[3:20]) if t else None) for i, t in enumerate(texts[:12])] + [(3, "the cat of dogs and mats")], "c long, text string")
    sources = spark.createDataFrame([*enumerate(texts), (4, texts[4]), (99, None)], "s long, text string")
    found = alignment.best_matches(chunks, sources, "c", "s")
    want = sorted(map(tuple, found.collect()))
    assert len(want) >= 12 and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(alignment, "BLOCK", 40)  # several blocks of chunks
    assert sorted(map(tuple, alignment.best_matches(chunks, sources, "c", "s").collect())) == want


def test_parts_meet_by_the_names_they_share(spark, tmp_path):
    part = [(50 * i, *x) for i, x in enumerate([("A", "B"), ("A", "B"), ("B", "C"), ("A", None), (None, None), (None, "B"), ("B", "B"), ("B", "A"), ("C", "A")])] + [(1, "A", "B")]
    same_as_sql(spark, tmp_path, "g06_alias_groups", part=(part, "p_partkey long, p_brand string, p_type string"))
    plan = QUERIES["g06_alias_groups"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_overlap" not in plan
