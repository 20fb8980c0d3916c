"""The registered queries themselves: on awkward tables, with workers that have no copy of the package, and against direct computations."""

import os
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, ctph, langid, mixing, ngrams, quality, queries, suffixes

REPO = str(Path(__file__).resolve().parents[2])
CLASHES = ["rid", "row", "keys", "extra", "set1", "ztext", "size", "n", "epoch", "spans", "mix_row", "place", "begin", "bucket", "n_shingles", "comp", "lang_pred", "n_bytes"]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(12)
    prose = lambda n, letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))
    long = prose(150_000, "abcdefgh")  # 900 kB: two stretches
    base = prose(120, "abcdefgh")
    out = [None, "", " \n", "7", "x" * 700_000, long, long + " tail", base, base, base + " and", base[:300] + prose(60, "ijklmno")]
    return out + [prose(int(n), "abcdefgh" if n % 2 else "ijklmnop") for n in rng.integers(1, 200, 40)]


@pytest.fixture(scope="module")
def sf(spark, texts, tmp_path_factory):
    """A folder with the tables that the queries read, null and repeated ids among the rows."""
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(None if i in (3, 9) else i, t, ["aa", "bb", None][i % 3], ["s", None][i % 2], 0) for i, t in enumerate(texts)]
    rows += [rows[12], (None, None, None, None, None)]
    write = lambda name, data, schema: spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    write("documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    write("labels", [(i, i % 2, 0) for i in range(10, 50)] + [(None, 1, 0), (11, None, None)], "doc_id long, quality int, toxic int")
    write("embeddings", [(i, [float(i % 7), 1.0, float(i)], 0) for i in range(120)] + [(None, [1.0, 0.0, 0.0], 0), (200, None, 0), (250, [0.0, 0.0, 0.0], 0)], "vec_id long, embedding array<float>, label int")
    write("pages", [(i, "u", "<p>" + "z" * 200 * (i % 3)) for i in range(12)] + [(None, None, "<p>" + "z" * 200), (None, None, None)], "page_id long, url string, html string")
    write("conversations", [(i % 7, i % 3, "u", t) for i, t in enumerate(texts)] + [(None, None, None, None), (3, None, None, None)], "conv_id long, turn long, role string, text string")
    return folder, rows


COLUMNS = {
    "op1_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op2_suffixes": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op3_ctph": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op4_records": "doc_id start n_tokens ids_crc32",
    "op5_neighbours": "query_id rank vec_id score", "op6_mixing": "doc_id size source_size target taken", "op7_ngram_jaccard": "doc_id n_shingles component_id",
    "op8_warc": "page_id payload_bytes payload_digest record_type refers_to", "op9_quality": "doc_id held_out score predicted", "op10_langid": "doc_id held_out lang_pred score",
    "op11_fim": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256", "op12_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op13_superminhash": "doc_id n_shingles component_id kept",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_on_awkward_rows(spark, sf, name):
    folder, rows = sf
    out = queries.queries()[name](spark, folder)
    assert out.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    found = out.collect()
    if name not in ("op1_packing", "op5_neighbours", "op8_warc", "op12_trie"):
        key = lambda x: (x is None, x or 0)
        assert sorted((r.doc_id for r in found), key=key) == sorted((r[0] for r in rows), key=key)
    if name in ("op9_quality", "op10_langid"):
        n, hit = (5, 0) if name == "op9_quality" else (4, 2)
        for r in found:
            assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % n == hit) and 0 <= r.score <= 1
            assert name != "op9_quality" or r.predicted == int(r.score >= 0.3)
            assert name != "op10_langid" or r.doc_id is None or (r.lang_pred == "und") == (r.doc_id in (0, 1, 2))


def test_clashing_columns_keep_their_values(spark, texts):
    data = [(i, t, ["aa", "bb", None][i % 3], "s", i, *[100 + i] * len(CLASHES)) for i, t in enumerate(texts) if i not in (4, 5, 6)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in CLASHES))
    for out, replaced in ((ngrams.with_classes(docs), {"n_shingles", "comp"}), (ngrams.keep_one(docs), set()), (suffixes.remove_repeats(docs), {"n_bytes"}), (mixing.mixed_texts(docs), set()), (langid.identify(docs, langid.fit(docs, bits=12)), {"lang_pred"})):
        stay = [c for c in CLASHES if c not in replaced]
        for r in out.collect():
            assert all(r[c] == 100 + r.doc_id for c in stay)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_workers_need_no_copy_of_the_package(tmp_path):
    script = tmp_path / "driver.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
seen = spark.range(1).mapInPandas(lambda batches: ((lambda: __import__("pandas").DataFrame({{"x": [__import__("importlib.util").util.find_spec("tessera") is not None]}}))() for _ in batches), "x boolean").first().x
assert not seen
import __spark_entry__
for name, query in __spark_entry__.queries().items():
    if name.startswith("op") or name == "pipeline":
        print(name, query(spark, "/root/testdata/sf0.001").count())
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != Path(REPO))}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.split("\n")) == 15


def test_shared_folder_names():
    assert common.arrow_uri("s3a://bucket/a b") == "s3://bucket/a b" and common.arrow_uri("/x") == "file:///x"
    assert common.arrow_uri("file:/x/y") == "file:///x/y" and common.arrow_uri("abfss://c@a/x") == "abfss://c@a/x" and common.arrow_uri("hdfs://h:1/x") == "hdfs://h:1/x"


def direct_fingerprint(data):
    """By its definition: one byte at a time, all levels tried in turn."""
    if not data:
        return "0::"
    ends = []
    for i in range(len(data)):
        h = sum((data[i - j] + 1) * pow(0x01000193, j + 1, 1 << 32) for j in range(min(7, i + 1))) % (1 << 32)
        h ^= h >> 15
        h = h * 0x2C1B3C6D % (1 << 32)
        h ^= h >> 12
        ends.append((h & -h).bit_length() - 1 if h else 32)
    level = next(k for k in range(1, 40) if sum(z >= k for z in ends) <= 63)
    out = [str(level)]
    for k in (level, level + 1):
        cuts = [i + 1 for i, z in enumerate(ends) if z >= k]
        cuts += [len(data)] if not cuts or cuts[-1] != len(data) else []
        chunks = [__import__("hashlib").blake2b(data[i:j], digest_size=2).digest() for i, j in zip([0, *cuts], cuts)]
        out.append("".join(ctph.ALPHABET[c[0] % 64] + ctph.ALPHABET[c[1] % 64] for c in chunks))
    return ":".join(out)


def direct_likeness(a, b):
    """1 - distance / length by dynamic programming over chunk characters, with insertions and deletions."""
    if a == b:
        return 1.0
    (i, a0, a1), (j, b0, b1) = a.split(":"), b.split(":")
    best = 0.0
    for x, y in {0: [(a0, b0), (a1, b1)], 1: [(a1, b0)], -1: [(a0, b1)]}.get(int(j) - int(i), []):
        x, y = ([s[k : k + 2] for k in range(0, len(s), 2)] for s in (x, y))
        row = list(range(len(y) + 1))
        for n, u in enumerate(x, 1):
            last, row[0] = row[0], n
            for m, v in enumerate(y, 1):
                last, row[m] = row[m], last if u == v else 1 + min(row[m], row[m - 1])
        if x and y:
            best = max(best, 1 - row[-1] / (len(x) + len(y)))
    return best


def test_fingerprints_by_definition():
    rng = np.random.default_rng(3)
    datas = [b"", b"a", b"abcdefg" * 30, bytes(rng.integers(97, 105, 5000, np.uint8)), b"q" * 3000]
    datas += [datas[3][:2000] + b"changed" + datas[3][2100:], bytes(rng.integers(97, 105, 9000, np.uint8))]
    marks = [ctph.fingerprint(d) for d in datas]
    assert marks == [direct_fingerprint(d) for d in datas]
    for a in marks:
        for b in marks:
            assert abs(ctph.likeness(a, b) - direct_likeness(a, b)) < 1e-12
    long = bytes(rng.integers(97, 105, 700_000, np.uint8))
    held, common_stretch = ctph.fingerprint(long), ctph.STRETCH
    ctph.STRETCH = 10_007
    try:
        assert ctph.fingerprint(long) == held
    finally:
        ctph.STRETCH = common_stretch


def test_filters_against_plain_sets(spark):
    rng = np.random.default_rng(5)
    make = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(40))
    train = [(make("abcde"), "xx") if i % 2 else (make("cdefg"), "yy") for i in range(40)]
    filters = langid.fit(spark.createDataFrame(train, "text string, lang string"), bits=20, least_rate=0.0, near_top=0.0)
    sets = {}
    for text, lang in train:
        for g in set(langid.grams(langid.letters_of(text)).tolist()):
            sets.setdefault((lang, g), set()).add(text)
    held = {lang: {g for (x, g), who in sets.items() if x == lang and len(who) > 1} for lang in ("xx", "yy")}
    for text in [make("abcde"), make("cdefg"), "fade bead", "é"]:
        g = langid.grams(langid.letters_of(text))
        want = [sum(x in held[lang] for x in g.tolist()) for lang in ("xx", "yy")]
        got = filters.raw(g)
        assert all(w <= n <= w + max(3, 0.01 * len(g)) for n, w in zip(got, want))  # false positives only


def test_normal_equations_and_calibration(spark):
    rng = np.random.default_rng(6)
    stats = rng.standard_normal((300, quality.N_STATS))
    y = (stats[:, 0] + 0.3 * rng.standard_normal(300) > 0).astype(float)
    rows = spark.createDataFrame([(s.tolist(), float(v)) for s, v in zip(stats, y)], "stats array<double>, y double").repartition(7)
    model = quality.fit(rows, features=32, ridge=0.1, fan_in=2)
    assert np.allclose(model.mean, stats.mean(0)) and np.allclose(model.scale, stats.std(0))
    z = model.lift(stats)
    a = z.T @ z + 0.1 * 300 / 32 * np.diag([*np.ones(32), 0]) + 1e-9 * np.eye(33)
    assert np.allclose(model.beta, np.linalg.solve(a, z.T @ (y - y.mean())), atol=1e-8)
    raw, score = model.raw(stats), model.score(stats)
    assert np.allclose(raw, z @ model.beta + y.mean()) and (np.diff(model.levels) > 0).all()
    assert (np.diff(score[np.argsort(raw)]) >= -1e-12).all() and ((score > y.mean()) == (y > 0.5)).mean() > 0.6


def test_added_tokens_have_their_own_id():
    from tokenizers import Tokenizer

    fresh, end = Tokenizer.from_file(common.vocabulary()), "<|endoftext|>"
    texts = [f"{end} x", f"a{end}", f"a {end}b", f"a  {end}", f"a\n {end}  b", f"a\n\n{end}\n\nb", f"é {end}{end} .", "no token", f"{end[:-1]} >"]
    want = [np.array(fresh.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert common.Encoder(common.vocabulary())(texts) == want
    assert want[0][:4] == (50256).to_bytes(4, "little")


def test_mixed_rows_lie_by_shard_and_slot(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(rng.randrange(1, 200))), f"s{i % 3}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    first = {}
    for p in mixing.mix(docs, shard_slots=64)[1].collect():
        at = first.get((p.doc_id, p.epoch))
        first[p.doc_id, p.epoch] = min(at, (p.word, p.shard, p.slot)) if at else (p.word, p.shard, p.slot)
    want = sorted((shard, slot, i) for (i, _), (_, shard, slot) in first.items())
    assert len({x[0] for x in want}) > 5
    parts = mixing.mixed_texts(docs, shard_slots=64).select("doc_id", F.spark_partition_id().alias("p")).collect()
    found = {}
    for r in parts:
        found.setdefault(r.p, []).append(r.doc_id)
    assert sorted(i for x in found.values() for i in x) == sorted(i for *_, i in want)
    shards = {}
    for shard, _, i in want:
        shards.setdefault(shard, []).append(i)
    # each partition is a sequence of whole shards, in order
    for ids in found.values():
        at, last = 0, -1
        while at < len(ids):
            shard = next(s for s in shards if s > last and ids[at : at + len(shards[s])] == shards[s])
            at, last = at + len(shards[shard]), shard


def test_a_text_does_not_vouch_for_itself(spark):
    rng = random.Random(12)
    pool = ["".join(rng.choice("abcde") for _ in range(6)) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(80)), "en") for i in range(30)]
    noise = "".join(rng.choice("qwxzjkvy") for _ in range(300))
    rows += [(100, noise, "en"), (101, noise, "en"), (102, "12 !!", "en")]
    docs = spark.createDataFrame([(i, t, l, "s", len(t)) for i, t, l in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()} == set(range(30))
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").collect()} == {*range(30), 100, 101}


def test_more_files_than_tasks_lose_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stages = lambda: (suffixes.remove_repeats(docs.select("doc_id", "text")), ngrams.with_classes(docs.select("doc_id", "text")).drop("comp"), ngrams.keep_one(docs), corpus_pipeline.mixed(spark, docs, ""))
    want = [sorted(map(str, df.collect())) for df in stages()]
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 20)
    try:
        assert [sorted(map(str, df.collect())) for df in stages()] == want
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert len(want[0]) == docs.count()


def test_filed_reads_all_files_of_a_number_and_misses_none(spark):
    rows = spark.range(0, 100, 1, 1).select(F.col("id").alias("rid"), F.concat(F.lit("x"), "id").alias("x"))
    have = common.Filed(rows, "several")
    common.dropped(spark, [have.path])
    rows.write.option("maxRecordsPerFile", 7).parquet(have.path)  # as another writer might leave them
    read = have.reader(["x"])

    def run(batches):
        for _, part in read(batches):
            yield part

    some = spark.createDataFrame([(i,) for i in (3, 50, 51, 99)], "rid long")
    got = lambda df: sorted(r.x for r in have.tasks(df).mapInArrow(run, "rid long, x string").collect())
    assert got(some) == ["x3", "x50", "x51", "x99"]
    with pytest.raises(Exception, match="1 rows of file 0 .* are gone"):
        got(some.union(spark.createDataFrame([(100,)], "rid long")))
