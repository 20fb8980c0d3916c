"""Queries without SQL against plain Python: text clean-ups on texts made for them, samples on the smallest tables."""

import re
import struct

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.plans import catalogue

DATA = "/root/testdata/sf0.001"


def applied(spark, function, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("t"))).collect()]


def test_spoken_words(spark):
    cases = {
        "*Oh*... “Mr. O’Neil & I” went—Dr Who!": ["oh", "mister", "o'neil", "and", "i", "went", "doctor", "who"],
        "Mrs. Ms. Jr Sr.": ["missus", "miss", "junior", "senior"],
        "x.mr y mr.z": ["x", "mr", "y", "mr", "z"],
        "a_b 7…8 'tis": ["a_b", "7", "8", "'tis"],
        "": [],
        " — ": [],
    }
    assert applied(spark, X.spoken_words, list(cases)) == list(cases.values())


def test_scanning_glitches(spark):
    cases = {"he1lo w0rld 1a a1 B2b": "helo wrld 1a a1 Bb", "caf é, na ï ve": "café, na ï ve", "caf é ok": "café ok", "é t x": "ét x", "é tu": "é tu", "a1b2c": "abc", "": ""}
    got = applied(spark, X.without_ocr_glitches, list(cases))

    def direct(x):
        x = "".join(c for i, c in enumerate(x) if not (c in "0123456789" and 0 < i < len(x) - 1 and re.match("[A-Za-z]", x[i - 1]) and re.match("[A-Za-z]", x[i + 1])))
        x = re.sub(r"([A-Za-z])\s+([À-ɏ])(?!\w)", r"\1\2", x)
        return re.sub(r"([À-ɏ])\s+([a-z])(?!\w)", r"\1\2", x)

    assert got == [direct(x) for x in cases]
    assert got[0] == cases["he1lo w0rld 1a a1 B2b"] and got[2] == "café ok" and got[5] == "abc"


def test_chain_of_clean_ups(spark):
    texts = ["a​b\n\n\n\nc", "itâ€™s w0rn", "say it " * 30 + "end", "plain text.", "", "x﻿" + "â€œyesâ€\x9d"]
    got = applied(spark, lambda x: X.without_phrase_loops(X.without_mojibake(X.without_ocr_glitches(X.extracted(x)))), texts)
    assert got == ["ab\n\nc", "it’s wrn", "say it " * 3 + "… end", "plain text.", "", "x“yes”"]


def order(doc_id):
    """The rank of a row in the seeded order: the engine's 64-bit hash of the id and the number 7, signed."""
    h = xxhash.xxh64(struct.pack("<i", 7), seed=xxhash.xxh64(struct.pack("<q", doc_id), seed=42).intdigest()).intdigest()
    return (h - (1 << 64) if h >> 63 else h), doc_id


@pytest.mark.parametrize("name,most", [("i07_stratified_sample", 20), ("i08_seeded_sample", 50)])
def test_seeded_samples(spark, name, most):
    rows = duckdb.sql(f"SELECT doc_id, n_chars FROM '{DATA}/documents.parquet'").fetchall()
    got = catalogue.queries()[name](spark, DATA).collect()
    if name == "i08_seeded_sample":
        assert {r.doc_id for r in got} == {i for i in sorted((d for d, _ in rows), key=order)[:most]}
        return
    bands = {}
    for d, n in rows:
        bands.setdefault("short" if n < 500 else "medium" if n < 2000 else "long", []).append(d)
    assert {(r.band, r.doc_id) for r in got} == {(b, d) for b, ids in bands.items() for d in sorted(ids, key=order)[:most]}
