"""Every stage of the pipeline on a small table, against what it must keep and drop."""

import re

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm.common import shared_dir


@pytest.fixture(scope="module")
def stages(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    passage = text(70)
    rows = [(i, text(int(rng.integers(100, 300))), "en", f"s{i % 3}") for i in range(40)]
    rows += [(100 + i, text(100) + " " + passage + " " + text(100), "en", "s1") for i in range(5)]
    rows += [(200, rows[3][1], "en", "s0"), (201, rows[4][1] + " and a tail", "en", "s0"), (300, None, "en", "s1"), (301, "12 34 !!", None, None), (302, "", "en", "s2")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = shared_dir(spark, f"test-{name}")
        stage(spark, out[-1], "").write.parquet(path)
        out.append(spark.read.parquet(path))
    return rows, passage, out


def test_language_stage_drops_only_what_has_no_language(stages):
    rows, _, out = stages
    assert {r.doc_id for r in out[1].collect()} == {r[0] for r in rows} - {300, 301, 302}
    assert out[1].columns == corpus_pipeline.COLUMNS


def test_near_duplicates_leave_one_of_each_class(stages):
    _, _, out = stages
    assert {r.doc_id for r in out[1].collect()} - {r.doc_id for r in out[2].collect()} == {200, 201}


def test_repeated_passages_go(stages):
    _, passage, out = stages
    before, after = {r.doc_id: r.text for r in out[2].collect()}, {r.doc_id: r.text for r in out[3].collect()}
    assert before.keys() == after.keys()
    for i, text in after.items():
        assert (passage not in text) if i >= 100 else text == before[i]


def test_mix_and_packing(stages):
    _, _, out = stages
    words = lambda t: len(re.findall(r"\S+", t))
    before, after = sum(words(r.text) for r in out[3].collect()), sum(words(r.text) for r in out[4].collect())
    assert abs(after / before - 1.5) < 0.1 and out[4].columns == corpus_pipeline.COLUMNS
    assert out[5].groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_empty_table(spark, stages):
    empty = stages[2][0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
