"""The best partners by shared tokens: equal to SQL and to plain Python, and pairs stay in their tasks."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from test_round3 import same_as_sql

from tessera.operators import cascades
from tessera.plans import catalogue

WORDS = "the and of é x1 x2 alpha beta gamma delta".split()


def texts(n, seed, least=0):
    draw = random.Random(seed)
    return [" ".join(draw.choices(WORDS, k=draw.randrange(least, 8))) for _ in range(n)]


def tables():
    benchmark = [(i, x) for i, x in enumerate(texts(12, 1))] + [(50, None), (51, ""), (51, "alpha beta"), (None, "the and of")]
    documents = [(i % 60, x) for i, x in enumerate(texts(80, 2))] + [(70, None), (None, "alpha beta gamma the and of x1")]
    turns = [(i // 5, i % 5, x) for i, x in enumerate(texts(70, 3))] + [(40, None, "alpha beta"), (41, 1, None)]
    pages = [(i, "https://" + x.replace(" ", "/")) for i, x in enumerate(texts(60, 4))] + [(90, None), (None, "https://the/and")]
    return {
        "benchmark": (benchmark, "item_id long, text string"),
        "documents": (documents, "doc_id long, text string"),
        "conversations": (turns, "conv_id long, turn long, text string"),
        "pages": (pages, "page_id long, url string"),
    }


@pytest.mark.parametrize("name", ["n13_token_overlap_topk", "g14_fuzzy_cascade", "g15_token_f1"])
def test_best_partners_equal_sql(spark, tmp_path, name):
    assert same_as_sql(spark, tmp_path, name, **tables())
    plan = catalogue.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan  # no row of tokens, or of pairs that aren't among a task's best, is shuffled


def best(a, b, per_left, k, least):
    """All pairs in plain Python."""
    words = lambda x: set(re.findall("[a-z0-9]+", x.lower()))
    found = {}
    for i, x in a:
        for j, y in b:
            n = len(words(x) & words(y))
            if n >= least:
                found.setdefault(i if per_left else j, []).append((-n / (len(words(x)) + len(words(y))), j if per_left else i))
    return {(p, other) if per_left else (other, p) for p, x in found.items() for _, other in sorted(x)[:k]}


@pytest.mark.parametrize("per", ["l", "r"])
@pytest.mark.parametrize("k", [1, 3, 5])
def test_best_partners_of_either_side_in_blocks(spark, per, k):
    a, b = list(enumerate(texts(15, 5))), list(enumerate(texts(40, 6)))
    frame = lambda x, i: spark.createDataFrame(x, f"{i} int, text string").repartition(3)
    for block in (30, 1 << 18):
        got = cascades.best_sharing(frame(a, "l"), frame(b, "r"), "l", "r", "text", per, lambda na, nb, n: n / (na + nb), k, 2, block=block).collect()
        assert {(r.l, r.r) for r in got} == best(a, b, per == "l", k, 2) and len(got) == len({(r.l, r.r) for r in got})


@pytest.mark.parametrize("carried", [True, False])
def test_a_task_keeps_some_pairs_of_a_row(carried):
    draw = np.random.default_rng(7)
    sets = lambda n: [sorted(set(draw.integers(0, 12, 6).tolist())) for _ in range(n)]
    batch = lambda i, x: pa.record_batch([pa.array(range(len(x)), pa.int64()), pa.array(x, pa.list_(pa.int64()))], names=[i, "_w"])
    a, b = sets(10), sets(200)
    held = type("Broadcast", (), {"value": pa.Table.from_batches([batch("l", a)])})
    streamed = batch("r", b)
    for k in (1, 3, 250):
        for some in (1, 40, 1 << 22):
            made = cascades._sharing(held, ["l"], ["r"], lambda na, nb, n: n >= 2, (carried, "r" if carried else "l", lambda na, nb, n: n, k), some)([streamed.slice(0, 70), streamed.slice(70, 0), streamed.slice(70)])
            got = sorted((x["l"], x["r"], x["shared"]) for part in made for x in part.to_pylist())
            pairs = [(i, j, n) for i, x in enumerate(a) for j, y in enumerate(b) if (n := len({*x} & {*y})) >= 2]
            side = 0 if carried else 1
            want = sorted(x for p in {x[side] for x in pairs} for x in sorted((x for x in pairs if x[side] == p), key=lambda x: (-x[2], x[1 - side]))[:k])
            assert got == want
