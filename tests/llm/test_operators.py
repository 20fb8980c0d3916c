"""The training-data operators against brute force on a small table with the awkward cases in it."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import common, ctph, langid, mixing, neighbours, ngrams, packing, quality, records, suffixes, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid int, offset string"


def words(rng, n, top=400):
    return " ".join(f"w{rng.integers(top)}x{rng.integers(9)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Texts null, empty, of spaces, long, equal, nearly equal, sharing a passage; null and repeated ids; columns with clashing names."""
    rng = np.random.default_rng(3)
    base, passage = words(rng, 300), words(rng, 60, 10_000)
    texts = [None, "", "   \n\t", "a", "éß 日本\nx", base, base, base + " one more word", base.replace(" w1x1 ", " "), words(rng, 30_000, 50_000)]
    texts += [words(rng, 80) + " " + passage + " " + words(rng, 80) for _ in range(6)]
    texts += ["ab" * 400, "Don't  stop.\n\nNow", "<|endoftext|> x", base.upper(), "one two", "One Two"]
    texts += [words(rng, int(n)) for n in rng.integers(1, 400, 60)]
    out = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "S"][i % 4], 0, 7, "x") for i, t in enumerate(texts)]
    return [*out, (None, "without an id " * 20, None, None, 0, 7, "x"), (None, None, None, None, 0, 7, "x"), out[30], out[30]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def ids():
    tokenizer = common.Encoder(common.vocabulary()).tokenizer
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_encoder_gives_the_librarys_ids(rows, ids):
    texts = [r[1] for r in rows] + ["a  b", " a ", "\n\n b\tc", "x\n y", "it's. 'S ¿qué?", "é\ń", "5 Ⅷ ª.", "a\x1c b 　c"]
    assert common.Encoder(common.vocabulary())(texts) == [ids(t).tobytes() for t in texts]


def test_packing_cuts_every_document_into_gapless_pieces(docs, rows, ids):
    out = packing.pack(docs, common.vocabulary(), length=256, windows=3, fan_in=2).collect()
    want = Counter((r[0], ids(r[1]).tobytes() + b"\x01\0\0\0") for r in rows)
    sequences = defaultdict(list)
    for p in out:
        sequences[p.sequence_id].append(p)
        assert len(p.ids) == 4 * p.length > 0
    lengths = []
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256
        lengths.append(at)
    assert sum(lengths) == sum(len(i) // 4 * n for (_, i), n in want.items())
    assert sum(lengths) / (256 * len(lengths)) > 0.97
    whole = Counter()
    for (doc_id, data), n in want.items():
        pieces = [p for p in out if p.doc_id == doc_id and p.doc_tokens == len(data) // 4 and data[4 * p.start : 4 * (p.start + p.length)] == bytes(p.ids)]
        whole[doc_id, data] = sum(p.length for p in pieces) * 4 // len(data)
        assert whole[doc_id, data] >= n


def test_packing_empty(empty):
    assert packing.pack(empty, common.vocabulary()).count() == 0


def brute_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i : i + length] = True
        kept = bytes(b for b, h in zip(t, hit) if not h)
        out.append((len(t), int(hit.sum()), int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("bucket_rows,hot,hash_bits", [(200_000, 20_000, 64), (40, 1, 64), (100, 20_000, 3)])
def test_repeats_against_brute_force(spark, docs, rows, bucket_rows, hot, hash_bits):
    """Whole, in many buckets with every shared class a hot one, and with hashes that nearly all collide."""
    out = suffixes.remove_repeats(docs, bucket_rows=bucket_rows, hot=hot, hash_bits=hash_bits)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "rid", "offset", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect())
    want = brute_repeats([(r[1] or "").encode() for r in rows], 200)
    assert got == Counter((r[0], *w) for r, w in zip(rows, want))


def test_repeats_in_one_document_overlap(spark):
    text = "abcdefghij" * 30 + "x" * 500
    out = suffixes.remove_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (out.n_bytes, out.n_removed, out.n_spans, out.kept_sha256) == brute_repeats([text.encode()], 200)[0]


def test_repeats_empty(empty):
    assert suffixes.remove_repeats(empty).count() == 0


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, (9000, 5)).astype(np.uint64)
    x[:4000] = x[0]
    by = suffixes.multikey_quicksort(x)
    assert [tuple(r) for r in x[by]] == sorted(tuple(r) for r in x)


def test_fingerprints_of_edited_texts(spark, docs, rows):
    unique = [r for r in {r[0]: r for r in rows}.values() if r[0] is not None]
    out = {r.doc_id: r for r in ctph.edited_fingerprints(spark.createDataFrame(unique, SCHEMA), buckets=5).collect()}
    order = sorted(unique, key=lambda r: -r[0])
    marks = {}
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        o = out[r[0]]
        assert (o.n_chars, o.edited_sha256, o.fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), ctph.fingerprint(text.encode()))
        assert o.near_edited == ctph.likeness(ctph.fingerprint(text.encode()), ctph.fingerprint(edited.encode()))
        assert marks.setdefault(text, o.fingerprint) == o.fingerprint and 0 <= o.near_next <= 1
    long = [o for o in out.values() if o.n_chars > 500]
    assert np.mean([o.near_edited for o in long]) > 0.4 > 0.2 > np.mean([o.near_next for o in long])
    assert ctph.edited_fingerprints(docs).count() == len(rows)


def test_fingerprints_sole_and_empty(spark, empty):
    assert ctph.edited_fingerprints(empty).count() == 0
    assert ctph.edited_fingerprints(spark.createDataFrame([(4, "abcd")], "doc_id long, text string")).first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def crc32c(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_masked_checksum():
    parts = [b"12345678", b"abcd", bytes(range(256)) * 3]
    got = records.masked_crc32c(np.frombuffer(b"".join(parts), "<u4"), np.array([len(p) // 4 for p in parts]))
    assert crc32c(b"123456789") == 0xE3069283
    assert [int(x) for x in got] == [((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF for c in map(crc32c, parts)]


def test_records_round_trip(spark, docs, rows, ids):
    path = common.shared_dir(spark, "test-records")
    manifest = records.write_records(docs, path, common.vocabulary(), shards=3).orderBy("shard").collect()
    out = sorted(records.read_records(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted([r[0] for r in rows], key=lambda d: (d is None, d or 0))
    assert Counter((r.doc_id, bytes(r.ids)) for r in out) == Counter((r[0], ids(r[1]).tobytes() + b"\x02\0\0\0") for r in rows)
    at = 0
    for r in out:
        assert r.start == at
        at += len(r.ids) // 4
    again = records.read_some(path, manifest[0].shard, [2, 0])
    assert [(d, x) for d, x in again] == [(out[2].doc_id, bytes(out[2].ids)), (out[0].doc_id, bytes(out[0].ids))]


def test_records_notice_damage_and_wide_ids():
    data, lengths = records.framed([5, None], [np.array([1, 70_000], "<u4").tobytes(), np.array([3], "<u4").tobytes()])
    assert records.parsed(data, lengths) == [(5, np.array([1, 70_000], "<u4").tobytes()), (None, np.array([3], "<u4").tobytes())]
    with pytest.raises(ValueError):
        records.parsed(data[:20] + b"!" + data[21:], lengths)


def test_records_empty(spark, empty):
    path = common.shared_dir(spark, "test-records")
    records.write_records(empty, path, common.vocabulary())
    assert records.read_records(spark, path).count() == 0


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((600, 8)).astype(np.float32)
    v[100:300] = v[7]
    table = [(int(i), [float(x) for x in r], "a") for i, r in enumerate(v)] + [(9000, None, "a"), (9001, [0.0] * 8, "a"), (9002, [float("nan")] * 8, "a"), (9003, [None] + [1.0] * 7, "a"), (None, [1.0] * 8, "a"), (9004, [1.0, 2.0], "a"), (9005, [2.0, 1.0], "a")]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, rank string")
    out = defaultdict(list)
    for r in sorted(neighbours.nearest(df, df.filter("vec_id % 50 = 0"), shard_rows=150, block=4, factor=1.0).collect(), key=lambda r: (r.query_id, r.rank)):
        out[r.query_id].append((r.vec_id, r.score))
    d = v.astype(float)
    for q in range(0, 600, 50):
        score = (d[q] * d).sum(1) / (np.sqrt(np.einsum("j,j->", d[q], d[q])) * np.sqrt(np.einsum("ij,ij->i", d, d)))
        want = sorted((i for i in range(600) if i != q), key=lambda i: (-score[i], i))[:5]
        assert [i for i, _ in out[q]] == want and np.allclose([s for _, s in out[q]], score[want], atol=1e-15)
    few = neighbours.nearest(df, df.filter("vec_id = 9004")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(9004, 1, 9005)]
    relaxed = neighbours.nearest(df, df.filter("vec_id % 50 = 0 AND vec_id < 9000"), shard_rows=150, factor=1.3).collect()
    exact = {(q, i) for q, x in out.items() for i, _ in x}
    assert sum((r.query_id, r.vec_id) in exact for r in relaxed) >= 0.9 * len([1 for q in out if q < 9000 for _ in out[q]])
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_mixing_meets_targets(docs, rows, empty):
    documents, pieces = mixing.mix(docs, block_words=8, shard_slots=100)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows_out = documents.collect()
    assert Counter((r.doc_id, r.size, r.source) for r in rows_out) == Counter((r[0], size(r[1]), r[3]) for r in rows)
    totals = Counter()
    for r in rows:
        totals[r[3]] += size(r[1])
    taken = pieces.groupBy("source_no", "doc_start").sum("words").collect()
    by = {(r.source_no, r.doc_start): r[2] for r in taken}
    got = Counter()
    for r in rows_out:
        n = by.get((r.source_no, r.start), 0) if r.size else 0
        assert n <= 2 * r.size and r.source_size == totals[r.source]
        got[r.source] += n
    assert abs(sum({r.source: r.target for r in rows_out}.values()) - 1.5 * sum(totals.values())) < 1e-6
    for r in rows_out:
        assert abs(got[r.source] - r.target) <= 16
    again = mixing.mix(docs, block_words=8, shard_slots=100)[1]
    assert again.exceptAll(pieces).count() == 0
    assert mixing.mix(empty)[0].count() == 0 and mixing.mix(empty)[1].count() == 0 and mixing.mixed_texts(empty).count() == 0
    text = mixing.mixed_texts(docs)
    assert text.columns == docs.columns
    assert sum(size(r.text) for r in text.collect()) == mixing.mix(docs)[1].groupBy().sum("words").first()[0]


def test_targets_and_permutation():
    out = mixing.targets(np.array([100, 10, 100, 0]), np.array([3.0, 1, 2, 3]), 1.5, 2.0)
    assert math.isclose(out.sum(), 315) and (out <= 2 * np.array([100, 10, 100, 0]) + 1e-9).all() and out[3] == 0
    for n in (1, 2, 5, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5)) == list(range(n))
    counts = mixing.drawn(np.array([50, 0, 7, 300]), 9, 1)
    assert counts.sum(0).tolist() == [50, 0, 7, 300] and counts.min() >= 0


def brute_components(rows, threshold, k):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(lower))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and n >= threshold * len(sets[i] | sets[j]) - 1e-9:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sets, [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("threshold,k,block", [(0.9, 3, 1024), (0.8, 5, 4)])
def test_jaccard_components(spark, threshold, k, block):
    rng = np.random.default_rng(9)
    rows = [(0, None), (1, ""), (2, "x"), (3, "X"), (4, "x y"), (None, "x y"), (None, None), (5, " \n")]
    for n in (12, 40, 150, 400):
        base = words(rng, n, 3000).split()
        for _ in range(25):
            w = list(base)
            for i in rng.integers(0, n, rng.integers(0, max(2, n // 25))):
                w[i] = "changed" + str(rng.integers(50))
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, comp int").repartition(3)
    counts: dict = {}
    out = ngrams.with_classes(df, threshold=threshold, words=k, bucket_rows=200, block=block, counts=counts)
    assert out.columns == ["doc_id", "n_shingles", "comp", "component_id"]
    assert counts["from_trees"] >= counts["linked"] > 0
    got = defaultdict(list)
    for r in out.collect():
        got[r.comp].append((r.doc_id, r.n_shingles))
    sets, comps = brute_components(rows, threshold, k)
    want = defaultdict(list)
    for r, s, c in zip(rows, sets, comps):
        want[c].append((r[0], len(s)))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted((sorted(x, key=key) for x in got.values()), key=str) == sorted((sorted(x, key=key) for x in want.values()), key=str)
    kept = ngrams.keep_one(df.drop("comp"), threshold=threshold, words=k).collect()
    assert len(kept) == len(want)
    assert ngrams.with_classes(df.limit(0)).count() == 0 and ngrams.keep_one(df.drop("comp").limit(0)).count() == 0


def test_tree_bound_loses_nothing():
    rng = np.random.default_rng(1)
    points = rng.poisson(4, (500, ngrams.COORDINATES)).astype(np.int64)
    points[100:200] = np.maximum(points[:100] + rng.integers(-1, 2, (100, ngrams.COORDINATES)), 0)
    label = rng.integers(0, 40, len(points))
    got = {(min(a, b), max(a, b)) for x, y, _ in ngrams.RTree(points).pairs(0.9, label) for a, b in zip(x.tolist(), y.tolist())}
    overlap = np.minimum(points[:, None], points[None]).sum(2)
    good = (overlap >= 0.9 / 1.9 * (points.sum(1)[:, None] + points.sum(1)) - 1e-9) & (label[:, None] != label)
    assert got == {(a, b) for a, b in np.argwhere(good).tolist() if a < b}


def test_points_bound_the_overlap():
    rng = np.random.default_rng(6)
    for n, m in ((1, 1), (50, 900), (3000, 2500), (70_000, 60_000)):
        pool = np.unique(rng.integers(0, 1 << 64, n + m, np.uint64))
        a, b = np.sort(pool[:n]), np.sort(rng.choice(pool, m, replace=False))
        x, y = (ngrams.coordinates(ngrams.point(h)) for h in (a, b))
        assert (x.sum(), y.sum()) == (n, m) and ngrams.overlap_bound(x, y) >= len(np.intersect1d(a, b))
    same = np.arange(5000, dtype=np.uint64) << np.uint64(32)  # all in one group
    assert ngrams.coordinates(ngrams.point(same)).max() == 5000


def raw_records_are_valid(path, want):
    """Parse the raw files by the standard alone: frames, header lines, an HTTP message, mandatory and unique headers."""
    import email
    import glob
    import http.client
    import io

    import zstandard

    ids, kinds, seen = [], Counter(), Counter()
    for name in glob.glob(path.removeprefix("file://") + "/*.warc.zst"):
        data = open(name, "rb").read()
        assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
        n = int.from_bytes(data[4:8], "little")
        unpack, rest = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n])), data[8 + n :]
        while rest:
            one = unpack.decompressobj()
            block = one.decompress(rest)
            rest = one.unused_data
            first, _, after = block.partition(b"\r\n")
            head, _, body = after.partition(b"\r\n\r\n")
            fields = email.message_from_bytes(head + b"\r\n\r\n")
            assert first == b"WARC/1.1" and len(body) == int(fields["Content-Length"]) + 4 and body.endswith(b"\r\n\r\n")
            assert all(len(fields.get_all(k, [])) == 1 for k in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "Content-Length"))
            assert __import__("re").fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", fields["WARC-Record-ID"])
            ids.append(fields["WARC-Record-ID"])
            kinds[fields["WARC-Type"]] += 1
            assert fields["Content-Type"] == "application/http;msgtype=response"

            class Socket:
                def makefile(self, *_):
                    return io.BytesIO(body[:-4])

            message = http.client.HTTPResponse(Socket())
            message.begin()
            assert message.status == 200 and message.getheader("Content-Type").startswith("text/html")
            if fields["WARC-Type"] == "response":
                payload = message.read()
                assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
                seen[payload] += 1
            else:
                assert fields["WARC-Profile"].endswith("identical-payload-digest") and fields["WARC-Refers-To-Date"]
    assert len(ids) == len(set(ids)) == sum(want.values())
    assert kinds == Counter(k[3] for k in want.elements())


def test_warc_round_trip(spark):
    page = "<p>" + "x" * 200
    pages = [(3, "http://a", page), (1, "http://b\r\nX: y", page), (None, None, page), (4, None, None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", "é" * 60), (9, "u", "é" * 60), (9, "u", "é" * 60)]
    path = common.shared_dir(spark, "test-warc")
    warc.write_warc(spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, payload string"), path)
    out = warc.read_warc(spark, path).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = Counter()
    for i, _, html in pages:
        first = {sha(page): 1, sha("é" * 60): 8}.get(sha(html))
        refers = None if first is None or first == i else first
        want[i, len((html or "").encode()), sha(html), "revisit" if refers else "response", refers] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == want
    assert {r.page_id: bytes(r.payload).decode() for r in out if r.record_type == "response"}[8] == "é" * 60
    assert {r.page_id: r.url for r in out}[4] is None and {r.page_id: r.url for r in out}[1] == "http://b%0D%0AX: y"
    raw_records_are_valid(path, want)
    path = common.shared_dir(spark, "test-warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


def test_language_filters(spark, docs, rows, empty):
    rng = np.random.default_rng(2)
    make = lambda a: " ".join("".join(rng.choice(list(a), 5)) for _ in range(60))
    train = [(make("abcde"), "xx") if i % 2 else (make("defgh"), "yy") for i in range(60)] + [("noise", None), (None, "xx"), ("", "zz")]
    filters = langid.fit(spark.createDataFrame(train, "text string, lang string"), bits=16)
    assert filters.languages == ["xx", "yy"]
    test = [(make("abcde"), "xx") if i % 2 else (make("defgh"), "yy") for i in range(40)] + [(None, "und"), ("", "und"), ("12 3!", "und")]
    out = langid.identify(spark.createDataFrame(test, "text string, score string"), filters).collect()
    assert all(r.lang_pred == want for r, (_, want) in zip(sorted(out, key=lambda r: str(r.text)), sorted(test, key=lambda t: str(t[0]))))
    assert all(0 <= r.score <= 1 for r in out)
    nothing = langid.fit(empty)
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_filters_of_many_languages():
    rows = np.zeros((2, 1 << 10), np.uint64)
    g = langid.grams(langid.letters_of("abcdefgh"))
    for i in range(4):
        rows[1, langid.slots(g, i, 10)] |= np.uint64(1 << 5)
    f = langid.Filters([f"l{i:02}" for i in range(70)], rows, 4)
    assert f.decide("abcdefgh")[0] == "l69"


def test_quality_learns_and_calibrates(spark, docs, rows, empty):
    rng = np.random.default_rng(4)
    data = [((words(rng, 50) if i % 4 else "BUY!! NOW!! ### $$$ " * 12), float(i % 4 > 0)) for i in range(240)]
    stats = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(data)], "doc_id long, text string")
    y = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(data)], "doc_id long, y double")
    with_stats = quality.with_statistics(stats)
    model = quality.fit(with_stats.join(y, "doc_id").select("stats", "y"), features=64)
    out = {r.doc_id: r.score for r in quality.score(with_stats, model).collect()}
    assert min(out[i] for i in range(240) if i % 4) > max(out[i] for i in range(240) if i % 4 == 0)
    assert quality.score(quality.with_statistics(docs), model).count() == len(rows)
    assert all(0 <= r.score <= 1 for r in quality.score(quality.with_statistics(docs), model).collect())
    none = quality.fit(quality.with_statistics(empty).selectExpr("stats", "1.0D as y"))
    assert all(r.score == pytest.approx(0.4995, abs=1e-2) for r in quality.score(quality.with_statistics(docs), none).collect())


def test_pooled_is_isotonic():
    x, y = quality.pooled(np.arange(6.0), np.ones(6), np.array([0, 1, 0, 0, 1, 1.0]))
    assert (np.diff(y) > 0).all() and math.isclose(y[1], 1 / 3)
