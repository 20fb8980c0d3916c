"""Queries that did less than their whole job, or took too much of one machine, held against plain forms."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from test_round3 import same_as_sql

from tessera.functions import lattice
from tessera.llm import common
from tessera.operators import alignment
from tessera.operators import gates as G
from tessera.operators import matching as M
from tessera.plans import catalogue


def test_parts_of_all_keys_meet_by_their_names(spark, tmp_path):
    part = [(k, *x) for k, x in zip((1, 2, 51, 60, 75, 99, 100), [("A", "B"), ("B", "C"), ("A", "B"), ("A", None), (None, None), ("B", "A"), ("D", "D")])]
    got = same_as_sql(spark, tmp_path, "g06_alias_groups", part=(part, "p_partkey long, p_brand string, p_type string"))
    assert len(got) == 9 and "(1, 2)" in got  # keys that differ by other than fifties


def test_pairs_that_share_names_are_not_shuffled(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(60)]), *(rng.choice([None, "x", "y", "z", f"n{rng.randrange(9)}"]) for _ in "ab")) for _ in range(150)]
    names = lambda r: {r[1], r[2]} - {None}
    want = sorted((r[0], s[0]) for r in rows for s in rows if None not in (r[0], s[0]) and r[0] < s[0] and names(r) & names(s))
    table = spark.createDataFrame(rows, "k int, one string, two string")
    for block in (1 << 18, 20):
        found = M.sharing_pairs(table, "k", ("one", "two"), block)
        assert sorted(map(tuple, found.collect())) == want and found.dtypes == [("a", "int"), ("b", "int")]
    plan = M.sharing_pairs(table.repartition(8), "k", ("one", "two"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Join" not in plan


def test_long_lists_go_the_cheapest_way_too():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(250)]
    steps = lattice.long_path([w + "r" for w in words], [w + "s" for w in words])
    assert {s[4] for s in steps} == {"pairs"} and len(steps) == 125  # none is skipped, though no two words are equal
    some = ["one", "two", "hundred", "and", "21", "100", "the", "then", "a", "lab", "coat", "labcoat", "some", "thing", "something"]
    for k in range(60):
        a, b = ([rng.choice(some) for _ in range(rng.randrange(25))] for _ in "ab")
        b = b if k % 2 else [w for i, w in enumerate(a) if i % 6]
        want = lattice.path(a, b)
        assert all(lattice.long_path(a, b, cells=cells, held=held) == want for cells, held in ((0, 1 << 24), (5, 25), (20, 1)))


def test_stored_tables_that_grow_are_not_broadcast(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "_LOCAL", {"dir": str(tmp_path)})
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "false")
    numbers = own.range(200_000).selectExpr("id AS node", "xxhash64(id) AS comp")
    table = common.stored(numbers, "numbers")  # 2 MB
    plan = lambda: table.join(table.select("node", F.col("comp").alias("other")), "node")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan() and table.join(F.broadcast(table), "node").count() == 200_000
    explicit = spark.newSession()
    explicit.conf.set("spark.sql.autoBroadcastJoinThreshold", "3m")
    common.small_batches(explicit)
    assert explicit.conf.get("spark.sql.autoBroadcastJoinThreshold") == "3m"


def test_segment_gate_goes_by_words_and_tells_what_it_skips(spark):
    entries = [(1, 0, "NARRATOR", "He we"), (1, 1, "SPOKEN", "come here NOW"), (1, 2, None, "He went home."), (2, 0, "NARRATOR", "No marks."), (3, 0, "SPOKEN", "went")]
    sources = [(1, "He went home. “Come here, now.”"), (2, "No marks."), (3, "He went home. “Go.”")]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    out = G.segment_gate(frame(entries, "id int, pos int, kind string, text string"), frame(sources, "id int, s string"), "id", "pos", "kind", "text", "s", frame([], "id int, defects string"))
    got = {r.id: (r.n_entries, r.findings, r.quote_gate) for r in out.collect()}
    assert got[1] == (3, "crosses_quote_boundary=1,invalid_type=1,missing_fields=1", "ran")  # half a word is in no region
    assert got[2] == (1, "", "skipped") and got[3] == (1, "crosses_quote_boundary=1", "ran")  # one word isn't a region


def test_segments_are_not_cut_by_the_gate(spark, tmp_path):
    text = "The old man went home, come here now and stay. The night was cold and long.\nAgain the bell rang twice, the door was open"
    spark.createDataFrame([(i, text) for i in range(41)] + [(50, None)], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in catalogue.queries()["j04_segment_gate"](spark, str(tmp_path)).collect()}
    codes = {x.split("=")[0] for r in rows.values() for x in r.findings.split(",")}
    assert {"crosses_quote_boundary", "empty_text", "introduced_cyrillic", "invalid_type", "missing_fields", "mixed_quote_region", "quote_region_misclassified", "unsupported_duplicate", "missing_entries"} <= codes
    assert rows[20].findings == "" and rows[20].n_entries == 5 and rows[5].n_entries == 7 and rows[50].findings == "missing_entries=1"


def test_blocks_of_texts_meet_without_a_product_of_partitions(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    frame = spark.createDataFrame(rows, "i int, text string")
    one = sorted(map(tuple, alignment.like_texts(frame, "i", "text").collect()))
    for held, met in ((4, 4), (1, 3), (3, 1)):
        monkeypatch.setattr(alignment, "HELD", held)
        monkeypatch.setattr(alignment, "MET", met)
        found = alignment.like_texts(frame, "i", "text", block=50)
        assert sorted(map(tuple, found.collect())) == one and one
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    assert not list(Path(folder).glob("blocks-*"))
