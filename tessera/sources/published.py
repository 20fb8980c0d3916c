"""Sinks that readers see whole or not at all: folders of a generation, and one small manifest that names those in force.

A generation is written beside those in use; the manifest is then replaced by one rename. A writer that dies leaves folders that no manifest
names, which the next publication removes, once its own outputs are in force. One writer a root at a time.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MANIFEST, VERSION = "manifest.json", 1


class StaleOutput(ValueError):
    """What is stored has another schema version or fingerprint."""


def fingerprint(*parts) -> str:
    """SHA-256 of whatever a result depends on: parameters, versions, file names with sizes."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


class Store:
    """Named tables under ``root``, on any file system Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.fs.Path(name)

    def manifest(self) -> dict:
        """{} where nothing is published or the file is damaged."""
        at = f"{self.root}/{MANIFEST}"
        if not self._fs.exists(self._path(at)):
            return {}
        try:
            found = json.loads("\n".join(r[0] for r in self.spark.read.text(at, wholetext=True).collect()))
        except ValueError:
            return {}
        return found if isinstance(found, dict) and isinstance(found.get("tables"), dict) else {}

    def publish(self, tables: dict[str, DataFrame], fmt: str = "parquet", mark: str | None = None, **options) -> None:
        """Write all tables, then put all in force at once; tables not named stay. Old and orphaned folders go last."""
        new = {}
        for name, df in tables.items():
            folder = f"{name}-{uuid.uuid4().hex}"
            df.write.format(fmt).options(**options).save(f"{self.root}/{folder}")
            new[name] = {"folder": folder, "format": fmt, "options": options, "schema": df.schema.json(), "mark": mark}
        now = self.manifest()
        self._replace({"version": VERSION, "tables": now.get("tables", {}) | new})
        self._sweep()

    def _replace(self, content: dict) -> None:
        self._fs.mkdirs(self._path(self.root))
        temporary = self._path(f"{self.root}/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(temporary, True)
        try:
            out.write(json.dumps(content, sort_keys=True).encode())
        finally:
            out.close()
        context = self._hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        rename[0] = getattr(self._hadoop.fs, "Options$Rename").OVERWRITE
        context.rename(self._fs.makeQualified(temporary), self._fs.makeQualified(self._path(f"{self.root}/{MANIFEST}")), rename)

    def _sweep(self) -> None:
        used = {t["folder"] for t in self.manifest().get("tables", {}).values()}
        for status in self._fs.listStatus(self._path(self.root)):
            name = status.getPath().getName()
            if status.isDirectory() and name not in used:
                self._fs.delete(status.getPath(), True)

    def read(self, name: str, mark: str | None = None) -> DataFrame:
        """The table in force; with ``mark``, only if it was published under that fingerprint and this version."""
        from pyspark.sql.types import StructType

        content = self.manifest()
        entry = content.get("tables", {}).get(name)
        if entry is None:
            raise KeyError(name)
        if mark is not None and (content.get("version") != VERSION or entry["mark"] != mark):
            raise StaleOutput(name)
        schema = StructType.fromJson(json.loads(entry["schema"]))
        return self.spark.read.schema(schema).format(entry["format"]).options(**entry["options"]).load(f"{self.root}/{entry['folder']}")

    def resumed(self, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], start: DataFrame, mark: str) -> DataFrame:
        """Run stages one after the other, each published; those already there under the same fingerprint, from the first on, are read back instead."""
        df, going = start, True
        for i, (name, stage) in enumerate(stages):
            key = fingerprint(mark, [n for n, _ in stages[: i + 1]])
            try:
                done = self.read(name, key) if going else None
            except (KeyError, StaleOutput):
                done = None
            if done is None:
                going = False
                self.publish({name: stage(df)}, mark=key)
                done = self.read(name, key)
            df = done
        return df
