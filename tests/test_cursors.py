"""Entries located forward on a stream: as on whole tables, across a restart, and with state that expires."""

import random
from datetime import datetime

import pytest

from tessera.operators.passages import located_forward
from tessera.streaming.cursors import located_stream

SCHEMA = "doc long, pos long, text string, source boolean, at timestamp"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture()
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield spark
    spark.conf.unset(PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_stream_agrees_with_batch_across_a_restart(rocks, tmp_path):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    sources = {d: " ".join(rng.choice(words) for _ in range(60)) for d in range(6)}
    entries = [(d, i, " ".join(sources[d].split()[k : k + 2]) if rng.random() < 0.8 else "not there") for d in sources for i, k in enumerate(sorted(rng.sample(range(58), 9)))]
    entries += [(77, 0, "no source")]
    rows = [(d, -1, s, True) for d, s in sources.items()] + [(d, i, t, False) for d, i, t in entries]
    rows = [(*r, datetime(2024, 1, 1)) for r in rows]
    rng.shuffle(rows)  # entries come before their turn, and before their source
    folder, out, place = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def run():
        stream = rocks.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        query = located_stream(stream, "doc", "pos", "text", "source", "at").writeStream.format("parquet").option("path", out).option("checkpointLocation", place).trigger(availableNow=True).start()
        assert query.awaitTermination(60)

    quarter = len(rows) // 4 + 1
    for n in range(4):
        rocks.createDataFrame(rows[n * quarter : (n + 1) * quarter], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        if n in (1, 3):
            run()  # the second run takes up where the first one ended
    got = {(r.key, r.pos): (r.start, r.end, r.how) for r in rocks.read.parquet(out).collect()}
    whole = located_forward(rocks.createDataFrame(entries, "doc long, pos long, text string"), rocks.createDataFrame(list(sources.items()), "doc long, text string"), "doc", "pos", "text")
    want = {(r.doc, r.pos): (r.start, r.end, r.how) for r in whole.collect() if r.doc != 77}
    assert got == want and {h for _, _, h in want.values()} >= {"forward", "not_found"}


def test_state_expires(rocks, tmp_path):
    folder, out, place = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def run(rows, minute):
        rocks.createDataFrame([(*r, datetime(2024, 1, 1, 0, minute)) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = rocks.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        query = located_stream(stream, "doc", "pos", "text", "source", "at", idle=1000, lateness="0 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", place).trigger(availableNow=True).start()
        assert query.awaitTermination(60)

    run([(1, -1, "a b c", True), (1, 0, "a", False), (1, 2, "c", False)], 0)
    run([(2, -1, "x", True)], 10)  # the watermark passes the timer of 1
    run([(1, 1, "b", False)], 20)  # its source is gone: it waits anew
    got = {(r.key, r.pos): (r.start, r.how) for r in rocks.read.parquet(out).collect()}
    assert got == {(1, 0): (0, "forward"), (1, 2): (None, "expired")}
