"""Exact removal of repeated byte strings by a sparse, range-partitioned suffix array.

Suffixes are taken at anchors: the anchor of a 200-byte window is the position, among its first 150, whose 32-byte string has the
smallest hash (the leftmost, if equal). Equal windows have their anchor at the same place, so only suffixes that start at anchors need
comparing, one for about 75 windows. An anchor owns a run of windows; its *context* is all their bytes. Suffixes are ordered by
their leading 32 bytes, four characters of 8 bytes; what begins alike is a *class*. In a class, contexts are told apart by a
cryptographic digest of 128 bits, and windows by their bytes.

Hashes choose anchors and bring candidates together; no hash of theirs decides what is removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STRETCH, Filed, dealt_join, gathered, lean, prefix_hash, slices, span_hash, stored, table

#: A suffix: its text stretch, its place (first window << 16 | distance to the anchor << 8 | windows), 32 leading bytes, digest of its context.
WORDS = [f"w{i}" for i in range(4)] + ["digest0", "digest1"]
SUFFIX = "bucket int, rid long, place long, " + ", ".join(f"{w} long" for w in WORDS)
MET = "bucket int, rid long, place long, state int, edge binary"
CONTEXT = "rid long, place long, weight int, lead binary, context binary"
SPAN = "rid long, start long, end long"
_PA = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
TWICE, ASK, HOT, FIRST, LAST, HEAD, TAIL = (1 << i for i in range(7))  # bits of a state


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    names = [c.split() for c in schema.split(", ")]
    return pa.record_batch([pa.array(x, _PA[kind]) for x, (_, kind) in zip(columns, names)], names=[n for n, _ in names])


def _signed(words: np.ndarray) -> np.ndarray:
    """Unsigned words as signed ones of the same order."""
    return (words.astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def anchors(text: bytes, length: int, window: int, gram: int, hash_bits: int = 64):
    """(places, words, digests) of a stretch's suffixes; ``hash_bits`` under 64 makes hashes collide, for tests."""
    b = np.frombuffer(text, np.uint8)
    last = len(b) - length
    if last < 0:
        return np.zeros(0, np.int64), np.zeros((0, 4), np.int64), np.zeros((0, 2), np.int64)
    at = np.arange(last + window)
    key = _cut(span_hash(prefix_hash(b), at, at + gram), hash_bits) & np.uint64(0xFFFFFFFF00000000) | at.astype(np.uint64)
    width = 1
    while 2 * width <= window:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < window:
        key = np.minimum(key[: last + 1], key[window - width :][: last + 1])
    p = (key[: last + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    p, n = p[first], np.diff(np.append(first, last + 1))
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(b, 32)[p]).view(">u8").reshape(-1, 4)
    ends = first + n - 1 + length
    blake, size = hashlib.blake2b, 16
    digests = b"".join([blake(text[i:j], digest_size=size).digest() for i, j in zip(first.tolist(), ends.tolist())])
    return first << 16 | (p - first) << 8 | n, _signed(words), np.frombuffer(digests, "<i8").reshape(-1, 2)


def _cut(h: np.ndarray, bits: int) -> np.ndarray:
    return h if bits >= 64 else h >> np.uint64(64 - bits) << np.uint64(64 - bits)


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of rows of ``words`` (a column is a character of 8 bytes): three-way partition, then the next character for the equal ones."""
    order = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        lo, hi, k = todo.pop()
        if hi - lo < 2 or k == words.shape[1]:
            continue
        own = order[lo:hi]
        if hi - lo <= 2048:
            order[lo:hi] = own[np.lexsort(words[own, k:].T[::-1])]
            continue
        x = words[own, k]
        few = np.sort(x[:: max(1, len(x) // 1024)])
        pivot = few[len(few) // 2]
        less, same = x < pivot, x == pivot
        i, j = lo + int(less.sum()), lo + int(less.sum()) + int(same.sum())
        order[lo:hi] = np.concatenate([own[less], own[same], own[~less & ~same]])
        todo += [(lo, i, k), (i, j, k + 1), (j, hi, k)]
    return order


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Number of the run of equal values that each row is in."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def sorted_bucket(batches, hot: int):
    """Sort a bucket's suffixes and compare neighbours: MET rows of those that matter, and the bucket's two edges for its neighbours.

    TWICE: the context stands elsewhere too. ASK: one row for each context of a class that has several, some of them not
    repeated (HOT: of over ``hot`` contexts). The bucket's first and last class may go on next door: their rows are FIRST or LAST
    instead (one row for each context), HEAD or TAIL if of an outermost context met once, and what they are is settled when edges
    are exchanged.
    """
    rows = gathered(batches)
    if rows is None:
        return
    c = {x: rows.column(x).to_numpy() for x in rows.column_names}
    for bucket in np.unique(c["bucket"]):  # one, but where fewer tasks take several
        own = c["bucket"] == bucket
        yield _one_bucket(int(bucket), {k: v[own] for k, v in c.items()}, hot)


def _one_bucket(bucket: int, c: dict, hot: int) -> pa.RecordBatch:
    by = multikey_quicksort(np.stack([*(c[w] for w in WORDS), c["rid"], c["place"]], 1))
    c = {k: v[by] for k, v in c.items()}
    cls = _runs(*(c[w] for w in WORDS[:4]))
    full = _runs(*(c[w] for w in WORDS))
    times = np.bincount(full)
    twice = times[full] > 1
    first = np.concatenate([[True], full[1:] != full[:-1]])
    kinds, alone = np.bincount(cls[first]), np.bincount(cls, ~twice).astype(np.int64)
    asked = (kinds > 1) & (alone > 0)
    state = np.where(twice, TWICE, 0) | np.where(first & asked[cls], ASK, 0) | np.where(first & asked[cls] & (kinds[cls] > hot), HOT, 0)
    edges = []
    for end, flag, tip in ((0, FIRST, HEAD), (len(cls) - 1, LAST, TAIL)):
        own = cls == cls[end]
        outer = np.flatnonzero(own)[[0, -1]]
        state[own] &= ~(ASK | HOT)
        whole = bool(own.all())
        state[own & first] |= flag if not whole else FIRST
        if not twice[end]:
            state[end] |= tip
        low, high = ((np.stack([c[w][i] for w in WORDS[4:]]).astype("<i8").tobytes(), int(times[full[i]])) for i in outer)
        edges.append(_edge(np.stack([c[w][end] for w in WORDS[:4]]).astype("<i8").tobytes(), low, high, int(kinds[cls[end]]), int(alone[cls[end]]), whole))
    keep = np.flatnonzero(state & (TWICE | ASK | FIRST | LAST))
    blank = np.zeros(2, np.int64)
    columns = [np.full(len(keep) + 2, bucket, np.int32), np.append(c["rid"][keep], blank - 1), np.append(c["place"][keep], [0, 1]), np.append(state[keep], blank).astype(np.int32), [None] * len(keep) + edges]
    return _batch(MET, columns)


def _edge(words: bytes, low: tuple, high: tuple, kinds: int, alone: int, whole: bool) -> bytes:
    return words + low[0] + high[0] + np.array([low[1], high[1], kinds, alone, whole], "<i8").tobytes()


def exchanged(edges: list[tuple[int, int, bytes]], hot: int) -> list[tuple]:
    """What each bucket's first and last class are, seen with its neighbours': (bucket, flag, asked, hot, low context twice, high context twice, first bucket of the class).

    Edges are (bucket, 0 or 1, bytes), in order; a class that takes a whole bucket has one entry.
    """
    chain, out = [], []

    def done():
        if not chain:
            return
        # contexts in order: those at the buckets' ends may be the same one
        counts: list[list] = []
        inner_kinds = inner_alone = 0
        for m in chain:
            ends = [(m["low"], m["n_low"])] if m["kinds"] == 1 else [(m["low"], m["n_low"]), (m["high"], m["n_high"])]
            inner_kinds += m["kinds"] - len(ends)
            inner_alone += m["alone"] - sum(n == 1 for _, n in ends)
            for digest, n in ends:
                if counts and counts[-1][0] == digest:
                    counts[-1][1] += n
                else:
                    counts.append([digest, n])
        total = {d: n for d, n in counts}
        kinds, alone = inner_kinds + len(counts), inner_alone + sum(n == 1 for _, n in counts)
        asked = kinds > 1 and alone > 0
        for m in chain:
            for flag in m["flags"]:
                out.append((m["bucket"], flag, asked, asked and kinds > hot, total[m["low"]] > 1, total[m["high"]] > 1, chain[0]["bucket"]))
        chain.clear()

    for bucket, end, data in sorted(edges):
        n_low, n_high, kinds, alone, whole = (int(x) for x in np.frombuffer(data, "<i8", 5, 64))
        if whole and end:
            continue
        m = {"bucket": bucket, "flags": (FIRST, LAST) if whole else (LAST,) if end else (FIRST,), "words": data[:32], "low": data[32:48], "high": data[48:64], "n_low": n_low, "n_high": n_high, "kinds": kinds, "alone": alone}
        if chain and chain[-1]["words"] != m["words"]:
            done()
        chain.append(m)
    done()
    return out


def repeated_windows(contexts: list[bytes], weight: np.ndarray, length: int, hash_bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of contexts stand in them more than once (a context of weight 2 does as a whole), and each context's number of windows.

    Hashes bring windows together, their bytes decide, 8 at a time.
    """
    size = np.array([len(x) for x in contexts])
    n, begin = size - length + 1, np.cumsum(size) - size
    b = np.frombuffer(b"".join(contexts) + bytes(8), np.uint8)
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    h = _cut(span_hash(prefix_hash(b), at, at + length), hash_bits)
    words = np.zeros(len(b) - 7, np.uint64)
    for i in range(8):
        words |= b[i : len(b) - 7 + i].astype(np.uint64) << np.uint64(8 * i)
    offsets = [*range(0, length - 7, 8), length - 8]
    count = np.repeat(weight, n).astype(np.int64)
    hit = np.zeros(len(at), bool)
    order = np.argsort(h, kind="stable")
    run = _runs(h[order])
    more = np.bincount(run)[run] > 1
    order, run = order[more], run[more]
    while len(order):
        head = np.concatenate([[True], run[1:] != run[:-1]])
        leader = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
        same = np.ones(len(order), bool)
        for k in offsets:
            same &= words[at[order] + k] == words[at[leader] + k]
        total = np.bincount(np.cumsum(head) - 1, np.where(same, count[order], 0))[np.cumsum(head) - 1]
        hit[order[same & (total > 1)]] = True
        order, run = order[~same], run[~same]
    return hit, n


def _spans(rid, a, n, hit, length: int) -> pa.RecordBatch:
    """SPAN rows of the maximal runs of hit windows in each context."""
    row, at = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    row, at = row[hit], at[hit]
    if not len(row):
        return _batch(SPAN, [[], [], []])
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)]))
    end = np.append(new[1:], len(row)) - 1
    return _batch(SPAN, [rid[row[new]], a[row[new]] + at[new], a[row[new]] + at[end] + length])


def remove_repeats(docs: DataFrame, length: int = 200, window: int = 150, gram: int = 32, bucket_rows: int = 200_000, hot: int = 20_000, text_out: bool = False, hash_bits: int = 64) -> DataFrame:
    """Find each byte covered by a ``length``-byte string that also starts anywhere else in the corpus, and remove it.

    Returns the rows of ``docs``, without text, and n_bytes, n_removed, n_spans, kept_sha256; with ``text_out`` the text without the
    removed bytes (and without halves of characters that they leave) comes instead. Null texts count as empty; texts under ``length``
    bytes have no such string; repeated rows are documents of their own, so each loses all bytes from ``length`` on; an empty table
    gives no rows; other columns come back as they are, but for names of the new ones. Long texts are taken in stretches of half a
    megabyte of windows, so that a text needs no more memory than its own bytes.

    1. Documents are stored compressed; a row's number holds its file's number, so texts are never shuffled.
    2. Splitters are sampled, and suffixes are range-partitioned by leading bytes, ties broken by digests and place, so that no common
       string fills a bucket. Buckets sort them by multikey quicksort and compare neighbours. A context met twice is repeated as a whole.
    3. Buckets' first and last classes are compared across the boundaries: the driver gets two short rows a bucket.
    4. Of classes with several contexts, each distinct one's bytes are fetched and dealt out by class, and compared window by window.
       Classes with over ``hot`` contexts don't go to one task: their windows are counted by digest, in partial sums.
    5. Spans go to the files of their documents, where they are merged and cut out.
    """
    spark = docs.sparkSession
    added = [("text", T.StringType())] if text_out else [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType())]
    names = [c for c in docs.columns if c not in ("text", *(n for n, _ in added))]
    if not names:
        docs, names = docs.select("text", F.lit(0).alias("no_column")), ["no_column"]
    kept = T.StructType([docs.schema[c] for c in names])
    plain = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(*names).alias("row"))
    more = length - 1

    def first(batches):
        import zstandard
        from pyspark import TaskContext

        rid, pack = TaskContext.get().partitionId() << 33, zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for some in slices(batch):
                of, begins, packed = [], [], []
                for i, t in enumerate(some.column("text").to_pylist()):
                    data = t.encode()
                    for lo in range(0, max(1, len(data) - more), STRETCH):
                        of.append(i)
                        begins.append(lo)
                        packed.append(pack.compress(data[lo : lo + STRETCH + more]))
                yield pa.record_batch([pa.array(np.arange(rid, rid + len(of))), some.column("row").take(pa.array(of)), pa.array(begins, pa.int64()), pa.array(packed, pa.binary())], names=["rid", "row", "begin", "ztext"])
                rid += len(of)

    schema = T.StructType([T.StructField("rid", T.LongType()), plain.schema["row"], T.StructField("begin", T.LongType()), T.StructField("ztext", T.BinaryType())])
    have = Filed(plain.mapInArrow(lean(first), schema), "texts")

    def found(batches):
        """All suffixes of the stretches, ``bucket`` not yet set."""
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for some in slices(batch, "ztext", 100, 200_000):
                parts = [anchors(unpack.decompress(z), length, window, gram, hash_bits) for z in some.column("ztext").to_pylist()]
                rid = np.repeat(some.column("rid").to_numpy(), [len(p) for p, _, _ in parts])
                place, words, digests = (np.concatenate(x) for x in zip(*parts))
                yield rid, place, np.hstack([words, digests])

    rows = have.rows.count()
    few = have.rows.sample(min(1.0, 2000 / max(rows, 1)), seed=1).select("rid", "ztext")

    def sizes(batches):
        n = sum(len(place) for _, place, _ in found(batches))
        yield pa.record_batch([pa.array([n])], names=["n"])

    counted = few.mapInArrow(lean(sizes), "n long").agg(F.sum("n").alias("n")).first().n or 0
    asked_for = max(1, few.count())
    buckets = int(max(1, -(-counted * rows // asked_for // bucket_rows)))

    def sample(batches):
        rng = np.random.default_rng(1)
        for rid, place, words in found(batches):
            pick = rng.random(len(place)) < wanted
            yield _batch("rid long, place long, " + ", ".join(f"{w} long" for w in WORDS), [rid[pick], place[pick], *words[pick].T])

    splitters = np.zeros((0, 8), np.int64)
    if buckets > 1:
        share = min(1.0, max(2000, 8 * buckets) / rows)
        wanted = min(1.0, 32 * buckets / max(1, counted / asked_for * rows * share))
        picked = have.rows.sample(share, seed=2).select("rid", "ztext").mapInArrow(lean(sample), "rid long, place long, " + ", ".join(f"{w} long" for w in WORDS)).toArrow()
        keys = np.stack([picked.column(x).to_numpy() for x in (*WORDS, "rid", "place")], 1)
        keys = keys[multikey_quicksort(keys)]
        splitters = keys[np.linspace(0, len(keys), buckets + 1)[1:-1].astype(int)] if len(keys) else splitters
    limits = spark.sparkContext.broadcast([tuple(x) for x in splitters.tolist()])  # eight numbers a bucket

    def dealt(batches):
        split = limits.value
        lead = np.array([s[0] for s in split], np.int64)
        for rid, place, words in found(batches):
            lo, hi = np.searchsorted(lead, words[:, 0], "left"), np.searchsorted(lead, words[:, 0], "right")
            bucket = hi.astype(np.int32)
            for i in np.flatnonzero(lo != hi):  # its first 8 bytes are those of a splitter
                key, k = (*words[i].tolist(), int(rid[i]), int(place[i])), int(lo[i])
                while k < hi[i] and split[k] <= key:
                    k += 1
                bucket[i] = k
            yield _batch(SUFFIX, [bucket, rid, place, *words.T])

    suffixes = have.rows.select("rid", "ztext").mapInArrow(lean(dealt), SUFFIX).repartitionById(buckets, "bucket")
    met = stored(suffixes.mapInArrow(lean(lambda batches: sorted_bucket(batches, hot)), MET), "suffixes")
    edges = [(r.bucket, r.place, bytes(r.edge)) for r in met.filter("edge is not null").select("bucket", "place", "edge").collect()]
    settled = spark.createDataFrame(exchanged(edges, hot), "bucket int, flag int, asked boolean, very boolean, low boolean, high boolean, home int")
    met = met.filter("edge is null")
    inner = met.filter(f"state & {FIRST | LAST | HEAD | TAIL} = 0").select("rid", "place", (F.expr(f"state & {TWICE}") > 0).alias("twice"), (F.expr(f"state & {ASK}") > 0).alias("ask"), (F.expr(f"state & {HOT}") > 0).alias("hot"))
    outer = met.filter(f"state & {FIRST | LAST | HEAD | TAIL} > 0").withColumn("flag", F.expr(f"if(state & {FIRST | HEAD} > 0, {FIRST}, {LAST})"))
    outer = outer.join(settled, ["bucket", "flag"]).select(
        "rid", "place", F.expr(f"state & {TWICE} > 0 or state & {HEAD} > 0 and low or state & {TAIL} > 0 and high").alias("twice"), F.expr(f"state & {FIRST | LAST} > 0 and asked").alias("ask"), F.col("very").alias("hot")
    )
    met = inner.unionByName(outer)
    place = {"a": "shiftright(place, 16)", "d": "shiftright(place, 8) & 255", "n": "place & 255"}
    whole = met.filter("twice").select("rid", F.expr(place["a"]).alias("start"), F.expr(f"{place['a']} + ({place['n']}) - 1 + {length}").alias("end"))
    asked = met.filter("ask").select("rid", "place", F.expr("if(twice, 2, 1)").alias("weight"), "hot")
    read = have.reader(["ztext"])

    def fetch(hot_ones: bool):
        def run(batches):
            import zstandard

            unpack = zstandard.ZstdDecompressor()
            for c, part in read(batches):
                rids = part.column("rid").to_numpy()
                lo, hi = np.searchsorted(c["rid"], rids), np.searchsorted(c["rid"], rids, "right")
                for z, i, j in zip(part.column("ztext").to_pylist(), lo, hi):
                    text, out = unpack.decompress(z), []
                    for k in c["place"][i:j].tolist():
                        a, d, n = k >> 16, k >> 8 & 255, k & 255
                        out.append((text[a + d : a + d + 32], text[a : a + n - 1 + length]))
                    yield _batch(CONTEXT, [c["rid"][i:j], c["place"][i:j], c["weight"][i:j], [x for x, _ in out], [x for _, x in out]])

        return have.tasks(asked.filter("hot" if hot_ones else "not hot").drop("hot")).mapInArrow(lean(run), CONTEXT)

    def compare(batches):
        """Contexts come sorted by class; as many classes at a time as make a few thousand contexts."""
        held, lead, size = [], None, 0

        def done():
            some = pa.Table.from_batches(held)
            hit, n = repeated_windows(some.column("context").to_pylist(), some.column("weight").to_numpy(), length, hash_bits)
            return _spans(some.column("rid").to_numpy(), some.column("place").to_numpy() >> 16, n, hit, length)

        for batch in batches:
            leads = batch.column("lead").to_pylist()
            begin = 0
            for i, x in enumerate(leads):
                if x != lead and size + i - begin > 2000:
                    held.append(batch.slice(begin, i - begin))
                    yield done()
                    held, begin, size = [], i, 0
                lead = x
            held.append(batch.slice(begin))
            size += len(leads) - begin
        if size:
            yield done()

    def windows(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                contexts = some.column("context").to_pylist()
                n = np.array([len(x) - more for x in contexts])
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                each = lambda x: np.repeat(x, n)
                digest = [hashlib.blake2b(x[i : i + length], digest_size=16).digest() for x in contexts for i in range(len(x) - more)]
                yield _batch("rid long, start long, weight int, digest binary", [each(some.column("rid").to_numpy()), each(some.column("place").to_numpy() >> 16) + at, each(some.column("weight").to_numpy()), digest])

    spans, n_asked = whole, asked.groupBy("hot").count().collect()
    n_asked = {r.hot: r["count"] for r in n_asked}
    if n_asked.get(False):
        cold = fetch(False).repartition(buckets, "lead").sortWithinPartitions("lead")  # by class, whatever bucket it was in
        spans = spans.unionByName(cold.mapInArrow(lean(compare), SPAN))
    if n_asked.get(True):
        each = stored(fetch(True).mapInArrow(lean(windows), "rid long, start long, weight int, digest binary"), "windows")
        twice = stored(each.groupBy("digest").agg(F.sum("weight").alias("w"), F.count("*").alias("times")).filter("w > 1").select("digest", "times"), "window-counts")
        spans = spans.unionByName(dealt_join(each, twice, ["digest"], "times", each.count()).select("rid", "start", F.expr(f"start + {length}").alias("end")))

    out = T.StructType([*kept, *[T.StructField(n, t) for n, t in added]])
    read_all = have.reader(["row", "begin", "ztext"], every=True)

    def cut(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        held, beside, results, users = [], None, [], []

        def done():
            """Of a document whose stretches are ``held``: (rid, begin, text)."""
            spans = []
            for rid, begin, _ in held:
                lo, hi = np.searchsorted(beside["rid"], [rid, rid + 1])
                spans.append(np.stack([beside["start"][lo:hi], beside["end"][lo:hi]]).astype(np.int64) + begin)
            s, e = np.concatenate(spans, 1)
            by = np.argsort(s, kind="stable")
            s, e = s[by], np.maximum.accumulate(e[by])
            new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]])) if len(s) else np.zeros(0, int)
            s, e = s[new], e[np.append(new[1:], len(e)) - 1] if len(new) else e
            text = held[0][2] if len(held) == 1 else b"".join([t[:STRETCH] for _, _, t in held[:-1]] + [held[-1][2]])
            left = b"".join([text[x:y] for x, y in zip([0, *e], [*s, len(text)])])
            return (left.decode(errors="ignore"),) if text_out else (len(text), len(text) - len(left), len(s), hashlib.sha256(left).hexdigest())

        def batch():
            rows = pa.concat_arrays(users)
            columns = [pa.array(x, pa.string() if isinstance(t, T.StringType) else pa.int64()) for x, (_, t) in zip(zip(*results), added)]
            return pa.record_batch([*(rows.field(k) for k in range(len(names))), *columns], names=[*names, *(n for n, _ in added)])

        size = 0
        for now, part in read_all(batches):
            rows = part.column("row")
            for i, (rid, begin, z) in enumerate(zip(*(part.column(c).to_pylist() for c in ("rid", "begin", "ztext")))):
                if begin == 0:
                    if held:
                        results.append(done())
                        held = []
                    if size > 1 << 20 or len(results) > 200:
                        yield batch()
                        results, users, size = [], [], 0
                    users.append(rows.slice(i, 1))
                beside = now
                held.append((rid, begin, unpack.decompress(z)))
                size += len(held[-1][2]) if text_out else 0
        if held:
            results.append(done())
            yield batch()

    return have.tasks(spans, all_files=True).mapInArrow(lean(cut), out)


def op2_suffixes(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
