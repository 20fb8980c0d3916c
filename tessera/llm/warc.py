"""WARC archives of individually compressed records with a Zstandard dictionary in a leading skippable frame."""

from __future__ import annotations

import datetime
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_join, file_system, lean, shared_dir, slices, stored, table

# The magic number of the skippable frame that holds a dictionary, and of a Zstandard frame.
DICTIONARY_FRAME = 0x184D2A5D
MANIFEST = "path string, n_records long, n_bytes long"
READ = "page_id long, record_type string, refers_to long, url string, payload binary, payload_bytes long, payload_digest string"


def record(page_id, url, payload: bytes, digest: str, refers_to, refers_url, date: str, place: str) -> bytes:
    """A WARC/1.1 response (an HTTP message with the payload) or revisit record (without it); its id is a UUID of its ``place``.

    The standard's record id, target and HTTP head say nothing of pages, so page ids, the payload's length and a missing url have headers
    of their own. A record without url has its own id for a target.
    """
    own = f"<{uuid.uuid5(uuid.NAMESPACE_URL, place).urn}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}", f"WARC-Target-URI: {own[1:-1] if url is None else plain_uri(url)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", f"X-Has-URI: {int(url is not None)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {refers_to}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {plain_uri(refers_url)}")
        payload = b""
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def plain_uri(url: str) -> str:
    """A url without line ends, so that it stays in its header."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


def parse(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if lines[0] != "WARC/1.1" or len(rest) != n + 4:
        raise ValueError("a damaged record")
    number = lambda name: int(fields[name]) if name in fields else None
    kind, digest, size, payload = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"]), rest[:n].partition(b"\r\n\r\n")[2]
    if kind == "response":
        got = hashlib.sha256(payload).hexdigest()
        if (got, len(payload)) != (digest, size):
            raise ValueError("a payload that isn't what its header says")
    url = fields["WARC-Target-URI"] if fields["X-Has-URI"] == "1" else None
    return {"page_id": number("X-Page-ID"), "record_type": kind, "refers_to": number("X-Refers-To-Page-ID"), "url": url, "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest}


def with_originals(pages: DataFrame, least: int = 100) -> DataFrame:
    """Adds payload (UTF-8; null html: empty), payload_digest, refers_to and refers_url.

    Of rows with equal payloads of at least ``least`` bytes, the one with the smallest page_id is the original (refers_to null); the
    others refer to it. Of repeated rows with the smallest page_id, each is an original; where no page_id is known, all are.
    Smallest ids are pre-aggregated by digest, and only digests that come twice are joined; those with many rows are broadcast, a few
    hundred at most, so pages with one payload are never dealt to one task.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("payload_digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= least
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")  # min leaves nulls out
    groups = pages.filter(large).groupBy("payload_digest").agg(first, F.count("*").alias("n")).filter("n > 1")
    groups = stored(groups.select("payload_digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("refers_url"), "n"), "originals")
    met = dealt_join(pages, groups, ["payload_digest"], "n", pages.count(), "left")
    return met.withColumn("refers_to", F.expr("if(first_id is null or page_id <=> first_id, null, first_id)")).drop("first_id")


def write_warc(pages: DataFrame, path: str, least: int = 100, dictionary_bytes: int = 112_640, samples: int = 2_000, sample_bytes: int = 8 << 20, level: int = 3) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); each task writes one archive. Returns the manifest.

    The dictionary of an archive is built from the archive's own first records (``samples`` at most, ``sample_bytes`` at most); with
    too little to build one, the first records themselves are the dictionary. It stands in a skippable frame at the file's start;
    every record is a Zstandard frame of its own. An index beside the archive has a line for each record: offset, length, page_id.
    Null or empty html has an empty payload, a null page_id no header, a null url the record's id for a target; repeated rows are records of their own; other columns
    are ignored; an empty table has no archives. A long payload is one record, in one task.
    """
    spark = pages.sparkSession
    date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches):
        import zstandard
        from pyspark import TaskContext

        task = TaskContext.get()

        name = f"part-{task.partitionId():06d}"

        def records():
            number = 0
            for batch in batches:
                for some in slices(batch, "payload"):
                    for x in some.to_pylist():
                        yield x["page_id"], record(*(x[c] for c in ("page_id", "url", "payload", "payload_digest", "refers_to", "refers_url")), date, f"{path}/{name}#{number}")
                        number += 1

        rows, first, n = records(), [], 0
        for row in rows:
            first.append(row)
            n += len(row[1])
            if len(first) >= samples or n >= sample_bytes:
                break
        if not first:
            return
        fs, root = file_system(path)
        fs.create_dir(root, recursive=True)
        texts = [r[:65_536] for _, r in first]
        try:
            words = zstandard.train_dictionary(min(dictionary_bytes, max(256, n // 10)), texts)
        except zstandard.ZstdError:
            words = zstandard.ZstdCompressionDict(b"".join(texts)[:dictionary_bytes], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packer, raw = zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=True), words.as_bytes()
        own = f"{root}/.attempt-{task.taskAttemptId()}"
        count = 0
        with fs.open_output_stream(f"{own}.warc.zst", compression=None) as out, fs.open_output_stream(f"{own}.idx") as index:
            out.write(DICTIONARY_FRAME.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw)
            at = 8 + len(raw)
            for some in (first, rows):
                for page_id, r in some:
                    data = packer.compress(r)
                    out.write(data)
                    index.write(f"{at} {len(data)} {'' if page_id is None else page_id}\n".encode())
                    at, count = at + len(data), count + 1
                first = None
        for kind in ("idx", "warc.zst"):
            fs.move(f"{own}.{kind}", f"{root}/{name}.{kind}")
        yield pa.record_batch([pa.array([f"{path}/{name}"]), pa.array([count]), pa.array([at])], names=["path", "n_records", "n_bytes"])

    with_originals(pages, least).select("page_id", "url", "payload", "payload_digest", "refers_to", "refers_url").mapInArrow(lean(write), MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Read the archives of ``write_warc``: a row a record; responses' payloads are held against their digests."""
    files = spark.read.parquet(f"{path}/manifest").select("path")
    n = max(1, files.count())
    files = files.repartitionById(n, (F.substring("path", -6, 6).cast("int") % n).cast("int"))  # by their numbers, a few to a task at most

    def read(batches):
        import zstandard

        schema = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in READ.split(", ")])
        for batch in batches:
            for name in batch.column("path").to_pylist():
                fs, at = file_system(name)
                with fs.open_input_stream(f"{at}.idx") as f:
                    index = [x.split(b" ") for x in f.read().splitlines()]
                with fs.open_input_stream(f"{at}.warc.zst", compression=None) as f:
                    head = f.read(8)
                    if int.from_bytes(head[:4], "little") != DICTIONARY_FRAME:
                        raise ValueError("no dictionary frame")
                    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(f.read(int.from_bytes(head[4:], "little"))))
                    rows, held = [], 0
                    for _, n, _ in index:
                        rows.append(parse(unpack.decompress(f.read(int(n)))))
                        held += rows[-1]["payload_bytes"]
                        if held > 8 << 20 or len(rows) >= 2_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(lean(read), READ)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Per page, from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = shared_dir(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha256(payload) AS digest FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first_id FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN first_id IS NULL OR first_id IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM f
"""
