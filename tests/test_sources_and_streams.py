"""Sources on small files written here, and streams against the same work done as a batch."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import files
from tessera.streaming import state


def test_json_lines_keep_the_valid_prefix(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"i": 0, "x": "a"}\n{"i": 1, "x": "b"}\n{"i": 2, "x\n{"i": 3, "x": "d"}\n')
    rows = files.read_json_lines(spark, f"file://{tmp_path}/a.jsonl", "i int, x string").withColumn("pos", F.monotonically_increasing_id()).withColumn("file", F.lit("a")).cache()
    assert [r[files.CORRUPT] is None for r in rows.orderBy("pos").collect()] == [True, True, False, True]
    assert [r.x for r in files.valid_prefix(rows, ["file"], "pos").orderBy("pos").collect()] == ["a", "b"]


def test_documents_runs_and_tables(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/good.json").write_text(json.dumps({"n": 1}, indent=1))
    (tmp_path / "d/bad.json").write_text("{nope")
    rows = {r.file.rpartition("/")[2]: r for r in files.read_documents(spark, f"file://{tmp_path}/d", "n int").collect()}
    assert rows["good.json"].n == 1 and rows["good.json"].warning is None and rows["bad.json"].warning
    place = tmp_path / "runs/rocm/small/rep1"
    place.mkdir(parents=True)
    (place / "result.json").write_text('{"s": 2.5}')
    r = files.read_runs(spark, f"file://{tmp_path}/runs", "s double").first()
    assert (r.s, r.backend, r.model, r.rep) == (2.5, "rocm", "small", "rep1")
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx y\n")
    assert files.read_tsv(spark, f"file://{tmp_path}/t.tsv").first().b == "x y"


def test_text_encodings(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("naïve “é”".encode())
    (tmp_path / "w.txt").write_bytes("naïve “é”".encode("cp1252"))
    out = {r.path.rpartition("/")[2]: r for r in files.read_text(spark, f"file://{tmp_path}/*.txt").collect()}
    assert {k: (r.text, r.encoding) for k, r in out.items()} == {"u.txt": ("naïve “é”", "utf-8"), "w.txt": ("naïve “é”", "cp1252")}


def test_archives_and_books(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "v.zip", "w") as z:
        z.writestr("train/b.wav", b"22")
        z.writestr("train/a.wav", b"1")
        z.writestr("other.wav", b"333")
    got = files.zip_members(spark, f"file://{tmp_path}/v.zip", ".wav", "train/").collect()
    assert [(r.member, r.size) for r in got] == [("train/a.wav", 1), ("train/b.wav", 2)]
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr("o/c.opf", '<package xmlns="urn:y"><manifest><item id="1" href="one.xhtml"/><item id="2" href="two.xhtml"/></manifest><spine><itemref idref="2"/><itemref idref="1"/></spine></package>')
        z.writestr("o/one.xhtml", "<html><style>p{}</style><p>A<br/>b</p><p>c &amp; d</p></html>")
        z.writestr("o/two.xhtml", "<html><body><h1>Two</h1></body></html>")
    (tmp_path / "broken.epub").write_bytes(b"not a book")
    rows = files.read_books(spark, f"file://{tmp_path}/*.epub").orderBy("path", "chapter").collect()
    assert [(r.chapter, r.text) for r in rows if r.warning is None] == [(1, "Two"), (2, "A\nb\n\nc & d")]
    assert [r.path.rpartition("/")[2] for r in rows if r.warning] == ["broken.epub"]


def test_mined_lines(spark):
    lines = spark.createDataFrame([("eval 12.5 tok/s",), ("nothing",), ("loss=0.25",)], "line string")
    out = files.mined(lines, "line", {"rate": r"([\d.]+) tok/s", "loss": r"loss=([\d.]+)"}).collect()
    assert [(r.rate, r.loss) for r in out] == [(12.5, None), (None, 0.25)]


@pytest.fixture()
def events(spark, tmp_path):
    rows = [(i, f"2024-01-01 {h:02}:{m:02}:00", u, float(v)) for i, (h, m, u, v) in enumerate([(1, 0, 1, 5), (1, 20, 1, 7), (3, 0, 1, 1), (1, 5, 2, 2), (1, 6, 2, 9)])]
    df = spark.createDataFrame(rows, "id long, at string, user int, value double").withColumn("at", F.col("at").cast("timestamp"))
    df.union(df.limit(2)).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    return df, spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")


def drained(stream, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.table(name).collect()


def test_streams_agree_with_batches(spark, events, tmp_path):
    batch, stream = events
    seen = drained(state.first_seen(stream, ["id"], "at"), "append", "seen")
    assert sorted(r.id for r in seen) == sorted(r.id for r in state.first_seen(batch, ["id"], "at").collect()) == [0, 1, 2, 3, 4]
    peaks = drained(state.peaks(stream, ["user"], "value"), "complete", "peaks")
    assert {r.user: r.peak for r in peaks} == {r.user: r.peak for r in state.peaks(batch, ["user"], "value").collect()} == {1: 7.0, 2: 9.0}
    assert sorted((r.user, r.n) for r in state.sessions(batch, ["user"], "at", "30 minutes").collect()) == [(1, 1), (1, 2), (2, 2)]


def test_append_new_is_idempotent(spark, events, tmp_path):
    _, stream = events
    for k in range(2):  # the second run has lost its checkpoint and sees all rows again
        state.append_new(stream, f"file://{tmp_path}/out", ["id"], f"file://{tmp_path}/ck{k}").awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [0, 1, 2, 3, 4]
