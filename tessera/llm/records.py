"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A record is: length (uint64), masked CRC-32C of those 8 bytes (uint32), payload, masked CRC-32C of the payload (uint32), all little-endian.
A payload is: doc_id (int64), flags (uint32; 1: doc_id is null; 2: ids take two bytes each; 4: an odd number of those, two zero bytes
follow), then the ids (uint16 where all of a document's ids are below 65536, else uint32).
A shard's index holds 24 bytes a record: offset (uint64), payload length (uint64), doc_id (int64).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encoder, file_system, kept, lean, shared_dir, slices, table, vocabulary

# The reflected CRC-32C polynomial and the constant that masks a checksum.
CASTAGNOLI = 0x82F63B78
MASK = 0xA282EAD8

MANIFEST = "shard int, path string, n_records long, n_ids long, n_bytes long"
HEAD = 12


def _shift_tables(n_levels: int = 29) -> np.ndarray:
    """tables[k][j][x]: what half j (16 bits) of a CRC state becomes after 4 * 2**k zero bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CASTAGNOLI), table >> 1)
    out = np.zeros((n_levels, 2, 65536), np.uint32)
    for j in range(2):
        x = np.arange(65536, dtype=np.uint32) << np.uint32(16 * j)
        for _ in range(4):
            x = table[x & 0xFF] ^ (x >> np.uint32(8))  # one zero byte
        out[0, j] = x
    for k in range(1, n_levels):
        for j in range(2):
            out[k, j] = _shift(out[k - 1], out[k - 1, j])
    return out


def _shift(t: np.ndarray, x: np.ndarray) -> np.ndarray:
    return t[0].take(x & np.uint32(0xFFFF)) ^ t[1].take(x >> np.uint32(16))


def masked_crc32c(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Masked CRC-32C of consecutive messages of ``lengths`` (each over 0) uint32 words, all at once.

    A CRC is linear, so neighbouring words are folded pairwise: level k shifts the left one by 2**k words.
    """
    shift = kept("crc32c", _shift_tables)
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    out = np.zeros(len(lengths), np.uint32)
    width = 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64)
    for w in np.unique(width):
        of = np.flatnonzero(width == w)
        for some in np.array_split(of, max(1, len(of) * int(w) >> 20)):
            n = lengths[some]
            x = np.zeros((len(some), w), np.uint32)  # zeros in front change nothing
            right = np.arange(w)[None, :] >= (w - n)[:, None]
            x[right] = words[np.repeat(start[some] + n - np.cumsum(n), n) + np.arange(n.sum())]
            k = 0
            while x.shape[1] > 1:
                x = _shift(shift[k], x[:, 0::2]) ^ x[:, 1::2]
                k += 1
            x = _shift(shift[0], x[:, 0])
            begin = np.full(len(some), 0xFFFFFFFF, np.uint32)
            for k in range(int(n.max()).bit_length()):
                begin = np.where(n >> k & 1, _shift(shift[k], begin), begin)
            out[some] = ~(x ^ begin)
    return ((out >> np.uint32(15)) | (out << np.uint32(17))) + np.uint32(MASK)


def framed(doc_ids: list, ids: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The records of a batch as bytes, and their payloads' lengths."""
    payload = []
    for d, x in zip(doc_ids, ids):
        wide = np.frombuffer(x, "<u4")
        short = not len(wide) or bool(wide.max() < 65536)
        flags = int(d is None) | int(short) << 1 | (len(wide) & 1 if short else 0) << 2
        body = wide.astype("<u2").tobytes() + b"\0\0" * (len(wide) & 1) if short else x
        payload.append((d or 0).to_bytes(8, "little", signed=True) + flags.to_bytes(4, "little") + body)
    lengths = np.array([len(x) for x in payload], np.int64)
    heads = lengths.astype("<u8")
    head_crc = masked_crc32c(heads.view("<u4"), np.full(len(payload), 2))
    crc = masked_crc32c(np.frombuffer(b"".join(payload), "<u4"), lengths // 4)
    head_bytes, head_crc, crc = heads.tobytes(), head_crc.astype("<u4").tobytes(), crc.astype("<u4").tobytes()
    return b"".join([y for i, x in enumerate(payload) for y in (head_bytes[8 * i : 8 * i + 8], head_crc[4 * i : 4 * i + 4], x, crc[4 * i : 4 * i + 4])]), lengths


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Write the ids of all documents, ``end_id`` after each, in ascending doc_id order (nulls last; equal doc_ids in no fixed order).

    Shards are ranges of doc_ids; each is a file of records and a file of offsets in the folder ``path`` on the shared store, written
    under a name of the attempt's own and then renamed, so a lost or repeated task leaves no half file. Returns the manifest, also
    written there: shard, path, n_records, n_ids, n_bytes. An empty table has an empty manifest. Other columns are ignored. A record may
    take 2 GiB, as one value of a row may; a long text is encoded in one task.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = F.col("doc_id").asc_nulls_last()
    dealt = docs.repartitionByRange(shards, order) if shards else docs.repartitionByRange(order)

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = file_system(path)
        encode, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        name, own = f"{root}/shard-{task.partitionId():06d}", f"{root}/.attempt-{task.taskAttemptId()}"
        fs.create_dir(root, recursive=True)
        n = ids_in = at = 0
        with fs.open_output_stream(f"{own}.rec") as out, fs.open_output_stream(f"{own}.idx") as index:
            for batch in batches:
                for part in slices(batch):
                    some = part.column("doc_id").to_pylist()
                    encoded = [x + end for x in encode(part.column("text").to_pylist())]
                    data, lengths = framed(some, encoded)
                    out.write(data)
                    offsets = at + np.concatenate([[0], np.cumsum(lengths + 16)[:-1]])
                    index.write(np.stack([offsets, lengths, [d or 0 for d in some]], 1).astype("<i8").tobytes())
                    n, ids_in, at = n + len(some), ids_in + sum(map(len, encoded)) // 4, at + len(data)
        if not n:
            for kind in ("rec", "idx"):
                fs.delete_file(f"{own}.{kind}")
            return
        for kind in ("idx", "rec"):
            fs.move(f"{own}.{kind}", f"{name}.{kind}")
        row = [[task.partitionId()], [f"{path}/shard-{task.partitionId():06d}"], [n], [ids_in], [at]]
        yield pa.record_batch([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=[x.split()[0] for x in MANIFEST.split(", ")])

    dealt.sortWithinPartitions(order).mapInArrow(lean(write), MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def parsed(data: bytes, want: np.ndarray) -> list[tuple]:
    """(doc_id, ids) of the records in ``data``, whose payload lengths the index gives; every length and checksum is verified."""
    at = np.concatenate([[0], np.cumsum(want + 16)])
    payload = [data[a + 12 : a + 12 + n] for a, n in zip(at, want)]
    heads = b"".join([data[a : a + 12] for a in at[:-1]])
    heads = np.frombuffer(heads, "<u4").reshape(-1, 3)
    crc = np.frombuffer(b"".join([data[b - 4 : b] for b in at[1:]]), "<u4")
    words = np.ascontiguousarray(heads[:, :2])
    good = (words.view("<u8")[:, 0] == want.astype(np.uint64)) & (masked_crc32c(words.ravel(), np.full(len(want), 2)) == heads[:, 2])
    good &= masked_crc32c(np.frombuffer(b"".join(payload), "<u4"), want // 4) == crc
    if not good.all():
        raise ValueError(f"{int((~good).sum())} damaged records")
    return [(None if x[8] & 1 else int.from_bytes(x[:8], "little", signed=True), _wide(x)) for x in payload]


def _wide(payload: bytes) -> bytes:
    """The ids of a payload as uint32."""
    if not payload[8] & 2:
        return payload[HEAD:]
    return np.frombuffer(payload, "<u2", (len(payload) - HEAD) // 2 - (payload[8] >> 2 & 1), HEAD).astype("<u4").tobytes()


def read_records(spark: SparkSession, path: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """Read the files of ``write_records``: doc_id, start (ids of all documents before it), ids (little-endian uint32).

    The ids before each shard come from the manifest, a row a shard. A task reads whole shards, some megabytes at a time.
    """
    counts = spark.read.parquet(f"{path}/manifest").orderBy("shard").collect()
    if not counts:
        return spark.createDataFrame([], "doc_id long, start long, ids binary")
    before, rows = 0, []
    for x in counts:
        rows.append((x.path, before))
        before += x.n_ids
    shards = spark.createDataFrame(rows, "path string, before long").repartition(len(rows), "path")

    def read(batches):
        for batch in batches:
            for shard, start in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                fs, name = file_system(shard)
                with fs.open_input_stream(f"{name}.idx") as f:
                    index = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
                with fs.open_input_stream(f"{name}.rec") as f:
                    for some in np.split(index, np.flatnonzero(np.diff(index[:, 0] // batch_bytes)) + 1):
                        got = parsed(f.read(int((some[:, 1] + 16).sum())), some[:, 1])
                        n = np.array([len(x) // 4 for _, x in got], np.int64)
                        starts = start + np.concatenate([[0], np.cumsum(n)[:-1]])
                        yield pa.record_batch([pa.array([x for x, _ in got], pa.int64()), pa.array(starts, pa.int64()), pa.array([x for _, x in got], pa.binary())], names=["doc_id", "start", "ids"])
                        start += int(n.sum())

    return shards.mapInArrow(lean(read), "doc_id long, start long, ids binary")


def read_some(path: str, shard: int, places: list[int]) -> list[tuple]:
    """(doc_id, ids) of single records of a shard by their place in its index, in any order: what a shuffled reader does."""
    fs, root = file_system(path)
    name = f"{root}/shard-{shard:06d}"
    with fs.open_input_file(f"{name}.idx") as index, fs.open_input_file(f"{name}.rec") as f:
        out = []
        for i in places:
            offset, n, _ = np.frombuffer(index.read_at(24, 24 * i), "<i8")
            out += parsed(f.read_at(int(n) + 16, int(offset)), np.array([n]))
        return out


def op4_records(spark, sf_dir: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    path = shared_dir(spark, "records")
    write_records(table(spark, sf_dir, "documents"), path, vocabulary())
    return read_records(spark, path).select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
