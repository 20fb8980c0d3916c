"""File sources: tolerant JSON, valid prefixes of logs, separated values, archives, e-books, run folders.

Spark lists and splits the files; what a file holds is parsed where it is read. A damaged file or line gives a row that says so, never
a failed job.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CORRUPT = "_corrupt"


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; a line that isn't has nulls, and its text in ``_corrupt``."""
    return spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def valid_prefix(lines: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Rows before the first corrupt one of each file: what an interrupted writer left whole."""
    first = F.min(F.when(F.col(CORRUPT).isNotNull(), F.col(pos))).over(Window.partitionBy(*keys))
    return lines.withColumn("_first", first).filter(F.col("_first").isNull() | (F.col(pos) < F.col("_first"))).drop("_first", CORRUPT)


def read_tsv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("header", header)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON documents with the file's name; a damaged file is a row with ``warning``."""
    rows = spark.read.schema(f"{schema}, {CORRUPT} string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return rows.withColumn("file", F.col("_metadata.file_path")).withColumn("warning", F.when(F.col(CORRUPT).isNotNull(), "not valid JSON")).drop(CORRUPT)


def read_runs(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """JSON results under root/backend/model/rep, the folders as columns."""
    part = lambda i: F.element_at(F.split(F.col("_metadata.file_path"), "/"), -i - 1)
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(root)
    return rows.select("*", part(3).alias("backend"), part(2).alias("model"), part(1).alias("rep"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text, encoding: UTF-8 where the bytes are valid, else Windows-1252."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    text, encoding = data.as_py().decode("utf-8-sig"), "utf-8"
                except UnicodeDecodeError:
                    text, encoding = data.as_py().decode("cp1252", "replace"), "cp1252"
                yield pa.record_batch([pa.array([name]), pa.array([text]), pa.array([encoding])], names=["path", "text", "encoding"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, text string, encoding string")


def mined(lines: DataFrame, column: str, patterns: dict[str, str]) -> DataFrame:
    """Measures in log lines: each pattern's first group as a double, null where it doesn't match; lines that hold none are dropped."""
    found = {name: F.regexp_extract(column, p, 1).try_cast("double") for name, p in patterns.items()}
    return lines.select("*", *[x.alias(name) for name, x in found.items()]).filter(F.coalesce(*[F.col(n) for n in patterns]).isNotNull())


def zip_members(spark: SparkSession, path: str, suffix: str = "", prefer: str = "") -> DataFrame:
    """path, member, size, content of archives' members by name; where some lie in the folder ``prefer``, only those."""

    def run(batches):
        import io
        import zipfile

        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(data.as_py()))
                except zipfile.BadZipFile:
                    continue
                members = sorted(m for m in archive.namelist() if m.endswith(suffix) and not m.endswith("/"))
                members = [m for m in members if m.startswith(prefer)] or members
                for m in members:
                    content = archive.read(m)
                    yield pa.record_batch([pa.array([name]), pa.array([m]), pa.array([len(content)], pa.int64()), pa.array([content])], names=["path", "member", "size", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, member string, size long, content binary")


def book_chapters(data: bytes) -> list[tuple[str, str]]:
    """(file, text) of an e-book's documents in reading order."""
    import io
    import posixpath
    import re
    import zipfile
    from xml.etree import ElementTree

    archive = zipfile.ZipFile(io.BytesIO(data))
    local = lambda node: node.tag.rpartition("}")[2]
    every = lambda root, name: [n for n in root.iter() if local(n) == name]
    package = every(ElementTree.fromstring(archive.read("META-INF/container.xml")), "rootfile")[0].get("full-path")
    root, base = ElementTree.fromstring(archive.read(package)), posixpath.dirname(package)
    items = {n.get("id"): n.get("href") for n in every(root, "item")}
    names = [posixpath.normpath(posixpath.join(base, items[n.get("idref")])) for n in every(root, "itemref") if n.get("idref") in items]
    have, out = set(archive.namelist()), []
    for name in names:
        if name in have:
            out.append((name, re.sub(r"\n{3,}", "\n\n", html_to_text(archive.read(name).decode("utf-8", "replace")).strip())))
    return out


def html_to_text(html: str) -> str:
    """Text of a page: scripts and styles gone, a blank line between blocks, a line feed for a break."""
    from html.parser import HTMLParser

    blocks = set("p div h1 h2 h3 h4 h5 h6 li blockquote hr tr section article".split())

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.gap, self.hidden = [], 0, 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style")
            self.gap = max(self.gap, 2 if tag in blocks else 1 if tag == "br" else 0)

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style") and self.hidden > 0

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(("\n" * self.gap if self.out else "") + data)
                self.gap = 0

    reader = Reader()
    reader.feed(html)
    reader.close()
    return "".join(reader.out)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """path, chapter (from 1), file, text of e-books; a damaged book is one row with ``warning``."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    rows = [(name, i, f, t, None) for i, (f, t) in enumerate(book_chapters(data.as_py()), 1)]
                except Exception as error:  # whatever is wrong with the file, the others are read
                    rows = [(name, 0, None, None, f"{type(error).__name__}: {error}"[:200])]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))], names=["path", "chapter", "file", "text", "warning"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, chapter int, file string, text string, warning string")


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Stand-off annotation files: (spans: file, id, type, start, end, text; relations: file, type, arg1, arg2).

    A span in several pieces is given from its first to its last offset; lines of other kinds, or without offsets, are left out.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\t").alias("p")).filter(F.size("p") >= 2)
    offsets = F.transform(F.regexp_extract_all(F.col("p")[1], F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    spans = rows.filter(F.col("p")[0].startswith("T")).withColumn("o", offsets).filter(F.size("o") > 0)
    spans = spans.select("file", F.col("p")[0].alias("id"), F.split(F.col("p")[1], " ")[0].alias("type"), F.array_min("o").alias("start"), F.array_max("o").alias("end"), F.coalesce(F.get("p", F.lit(2)), F.lit("")).alias("text"))
    shape = r"^(\w+) Arg1:(\w+) Arg2:(\w+)"
    related = rows.filter(F.col("p")[0].startswith("R") & F.col("p")[1].rlike(shape))
    return spans, related.select("file", *[F.regexp_extract(F.col("p")[1], shape, i).alias(n) for i, n in enumerate(("type", "arg1", "arg2"), 1)])
