"""Context-triggered piecewise hashes of documents and their likeness."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STRETCH, lean, slices, table

# The characters of a signature; bytes in the rolling window; most chunks in a signature.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW = 7
MOST = 64


def boundaries(data: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """(level, ends, levels): the smallest level with at most ``MOST`` chunks, the ends of its chunks before the last, and each end's own level.

    A byte ends a chunk of level k if the hash of the 7 bytes up to it has k trailing zero bits. Long texts are hashed in stretches; as
    the number of ends only grows, the level never falls, and what lies under it can go at once.
    """
    level, ends, zeros = 1, np.zeros(0, np.int64), np.zeros(0, np.uint32)
    for at in range(0, len(data), STRETCH):
        b = np.frombuffer(data, np.uint8)[max(0, at - WINDOW + 1) : at + STRETCH]
        roll = np.zeros(len(b), np.uint32)
        for j in range(min(WINDOW, len(b))):
            roll[j:] += (b[: len(b) - j].astype(np.uint32) + np.uint32(1)) * np.uint32(pow(0x01000193, j + 1, 1 << 32))
        roll ^= roll >> np.uint32(15)
        roll *= np.uint32(0x2C1B3C6D)
        roll ^= roll >> np.uint32(12)
        roll = roll[at - max(0, at - WINDOW + 1) :]
        mine = np.flatnonzero((roll & np.uint32((1 << min(level, 32)) - 1)) == 0)
        ends, zeros = np.concatenate([ends, mine + at + 1]), np.concatenate([zeros, roll[mine]])
        while len(ends) + 1 > MOST and level < 32:
            level += 1
            more = (zeros & np.uint32((1 << level) - 1)) == 0
            ends, zeros = ends[more], zeros[more]
        ends, zeros = ends[: MOST - 1], zeros[: MOST - 1]  # only if hashes are all 0: what follows is the last chunk
    return level, ends, zeros


def fingerprint(data: bytes) -> str:
    """``level:signature:signature`` of a whole byte string.

    Level k's boundaries are among level k-1's, and its chunks have 2**k bytes on average. The level is the smallest with at most 64
    chunks; the two signatures hold two characters (12 bits of the chunk's digest) for each chunk at that level and the next.
    """
    if not data:
        return "0::"
    level, ends, zeros = boundaries(data)
    out = [str(level)]
    for k in (level, level + 1):
        cut = ends[(zeros & np.uint32((1 << min(k, 32)) - 1)) == 0].tolist()
        if not cut or cut[-1] != len(data):
            cut.append(len(data))
        chunks = [hashlib.blake2b(data[i:j], digest_size=2).digest() for i, j in zip([0, *cut], cut)]
        out.append("".join([ALPHABET[c[0] & 63] + ALPHABET[c[1] & 63] for c in chunks]))
    return ":".join(out)


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit for each symbol of ``a``."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def likeness(a: str, b: str) -> float:
    """1 - edit distance / length of both (insertions and deletions), of signatures at the same level; 0 if levels differ by over 1."""
    if a == b:
        return 1.0
    (i, a0, a1), (j, b0, b1) = a.split(":"), b.split(":")
    pairs = {0: [(a0, b0), (a1, b1)], 1: [(a1, b0)], -1: [(a0, b1)]}.get(int(j) - int(i), [])
    best = 0.0
    for x, y in pairs:
        x, y = ([s[k : k + 2] for k in range(0, len(s), 2)] for s in (x, y))
        if x and y:
            best = max(best, 2 * _common(x, y) / (len(x) + len(y)))
    return best


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint: doc_id, fingerprint. Null texts count as empty; repeated rows and other columns do no harm."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.record_batch([batch.column("doc_id"), pa.array([fingerprint((t or "").encode()) for t in texts])], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, fingerprint string")


def in_sequence(docs: DataFrame, buckets: int) -> DataFrame:
    """Deal documents out so that each task sees a run of them in descending doc_id order and also the document after the run.

    Bucket limits are quantiles of doc_id, a fixed number for the driver. The highest document of each bucket goes to the bucket
    before it as well, marked ``after`` (that of the first bucket to the last one). Columns: bucket, after, doc_id, text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    limits = docs.select("doc_id").approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.1 / buckets) if buckets > 1 else []
    limits = sorted({int(x) for x in limits}, reverse=True)
    above = F.size(F.filter(F.lit(limits), lambda x: x >= F.col("doc_id"))) if limits else F.lit(0)
    docs = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(len(limits) + 1)).otherwise(above))
    heads = {r.bucket: r.top for r in docs.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()}
    full = sorted(heads)
    if not full:
        return docs.select("bucket", F.lit(False).alias("after"), "doc_id", "text")
    before = {b: full[i - 1] for i, b in enumerate(full)}
    numbers = range(len(limits) + 2)
    of = lambda values, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("bucket") + 1)
    head = F.col("doc_id").eqNullSafe(of([heads.get(b) for b in numbers], "long"))
    own = F.struct("bucket", F.lit(False).alias("after"))
    also = F.struct(of([before.get(b) for b in numbers], "int").alias("bucket"), F.lit(True).alias("after"))
    places = F.when(head, F.array(own, also)).otherwise(F.array(own))
    dealt = docs.withColumn("place", F.explode(places)).select("place.bucket", "place.after", "doc_id", "text")
    return dealt.repartitionByRange(max(1, len(full)), "bucket").sortWithinPartitions("bucket", "after", F.col("doc_id").desc_nulls_last(), "text")


def edited_fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprint each document, the same with its second half replaced by the start of the next one, and compare.

    The next document has the next smaller doc_id (after the last: the first; equal doc_ids by text; null doc_ids last). Null texts
    count as empty; a sole document is its own next one; an empty table gives no rows; other columns are ignored. Each task streams
    through a range of doc_ids and holds two texts and an Arrow batch; each text is shuffled once.
    """
    buckets = buckets or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        held, rows = None, []

        def done(one, after):
            doc_id, text, mark = one
            n = len(text)
            edited = text[: n - n // 2] + after[1][: n // 2]
            other = mark if edited == text else fingerprint(edited.encode())
            return (doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), mark, other, likeness(mark, other), likeness(mark, after[2]))

        bucket = None
        for batch in batches:
            for some in slices(batch):
                for b, after, doc_id, text in zip(*(some.column(c).to_pylist() for c in ("bucket", "after", "doc_id", "text"))):
                    if b != bucket:
                        bucket, held = b, None
                    elif after and held is None:
                        continue
                    one = (doc_id, text, fingerprint(text.encode()))
                    if held is not None:
                        rows.append(done(held, one))
                    held = None if after else one
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=[c.split()[0] for c in OUT.split(", ")])
                    rows = []

    return in_sequence(docs, buckets).mapInArrow(lean(run), OUT)


def op3_ctph(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))
