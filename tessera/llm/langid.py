"""Language identification by bit-sliced Bloom filters of n-grams: one lookup returns the mask of languages that hold the n-gram."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, mix64, slices, stored, table

OTHER = re.compile(r"[\W\d_]+")
GRAM = 4
CHUNK = 4096
PART = 1 << 19


def letters_of(text: str | None) -> bytes:
    """The text in lower case and UTF-8, a space for each run of other characters than letters, and one at both ends; empty if it has no letter."""
    letters = OTHER.sub(" ", (text or "").lower()).strip()
    return f" {letters} ".encode() if any(map(str.isalpha, letters)) else b""


def grams(data: bytes) -> np.ndarray:
    """The 4-byte windows of what ``letters_of`` gives; what is shorter is filled up with spaces."""
    b = np.frombuffer(data.ljust(GRAM) if data else b"", np.uint8).astype(np.uint32)
    if not len(b):
        return b
    return b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)


def stretches(text: str | None):
    """The n-grams of a text, half a million at a time."""
    data = letters_of(text)
    for at in range(0, max(1, len(data) - GRAM + 1) if data else 0, PART):
        yield grams(data[at : at + PART + GRAM - 1])


def slots(g: np.ndarray, i: int, bits: int) -> np.ndarray:
    """Where hash function ``i`` puts n-grams in a filter of 2**bits rows: double hashing of one 64-bit mix."""
    h = mix64(g.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return ((h + np.uint64(i) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64((1 << bits) - 1)).astype(np.int64)


@dataclass
class Filters:
    """``rows[w]`` holds, for each slot, bits of languages 64w .. 64w+63 (fewer bits for few languages)."""

    languages: list[str]
    rows: np.ndarray
    hashes: int
    wrong: np.ndarray = field(init=False)

    def __post_init__(self):
        n = self.rows.shape[1]
        full = np.array([((self.rows[i >> 6] >> self.rows.dtype.type(i & 63)) & self.rows.dtype.type(1)).sum() / n for i in range(len(self.languages))])
        self.wrong = full**self.hashes

    def raw(self, g: np.ndarray) -> np.ndarray:
        """For each language, the number of n-grams that its filter has, false positives among them."""
        bits = self.rows.shape[1].bit_length() - 1
        at = [slots(g, i, bits) for i in range(self.hashes)]
        raw = []
        for row in self.rows:
            mask = row[at[0]]
            for a in at[1:]:
                mask = mask & row[a]
            if row.dtype == np.uint8:
                counts = np.bincount(mask, minlength=256)
                raw += [int(counts[(np.arange(256) >> i & 1) == 1].sum()) for i in range(8)]
            else:
                raw += [int(((mask >> row.dtype.type(i)) & row.dtype.type(1)).sum()) for i in range(row.dtype.itemsize * 8)]
        return np.array(raw[: len(self.languages)], float)

    def decide(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, share of the text's n-grams that the language is known to hold), by numbers of n-grams less what false positives are expected to add."""
        n, raw = 0, np.zeros(len(self.languages))
        for g in stretches(text):
            n, raw = n + len(g), raw + self.raw(g)
        if not n or not self.languages:
            return "und", 0.0, 0.0
        hits = np.maximum(raw - n * self.wrong, 0) / (1 - np.minimum(self.wrong, 0.999))
        best = int(np.argmax(hits))
        return self.languages[best], float(hits[best] / hits.sum()) if hits.sum() else 0.0, float(min(1.0, hits[best] / n))


def fit(docs: DataFrame, bits: int = 21, hashes: int = 4, least_rate: float = 2e-6, near_top: float = 0.5) -> Filters:
    """Learn from docs (text, lang; rows with a null lang don't count): n-gram counts of all texts, by language.

    A language holds an n-gram that makes up at least ``least_rate`` of its n-grams (so 1 / least_rate of them at most, however
    much text there is) and ``near_top`` of the rate where it is most frequent, if two different texts of the language have it: a text
    and its copies don't vouch for themselves. The driver gets the filter alone, 2**bits rows.

    Null, empty and letterless texts add nothing; repeated rows count again; long texts are taken in stretches; other columns are
    ignored. Of a table without labelled texts, filters hold no language, and every text is ``und``.
    """
    docs = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null")
    docs = docs.withColumn("mark", F.xxhash64("text"))

    def count(batches):
        sums: dict[str, list] = {}
        held = 0

        def flush():
            for lang, parts in sums.items():
                g, n, lo, hi = added(*(np.concatenate(x) for x in zip(*parts)))
                yield pa.record_batch([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n), pa.array(lo), pa.array(hi)], names=["lang", "gram", "n", "lo", "hi"])

        def added(g, n, lo, hi):
            order = np.argsort(g, kind="stable")
            g = g[order]
            at = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            return g[at], np.add.reduceat(n[order], at), np.minimum.reduceat(lo[order], at), np.maximum.reduceat(hi[order], at)

        for batch in batches:
            for some in slices(batch):
                by: dict[str, list] = {}
                for lang, text, mark in zip(*(some.column(c).to_pylist() for c in ("lang", "text", "mark"))):
                    for g in stretches(text):
                        by.setdefault(lang, []).append((g, np.full(len(g), mark, np.int64)))
                for lang, found in by.items():
                    g, marks = (np.concatenate(x) for x in zip(*found))
                    if len(g):
                        g, n, first, last = added(g, np.ones(len(g), np.int64), marks, marks)
                        parts = sums.setdefault(lang, [])
                        parts.append((g, n, first, last))
                        held += len(g)
                        if len(parts) >= 16:
                            held -= sum(len(p[0]) for p in parts)
                            sums[lang] = [added(*(np.concatenate(x) for x in zip(*parts)))]
                            held += len(sums[lang][0][0])
                if held > 1_000_000:
                    yield from flush()
                    sums, held = {}, 0
        yield from flush()

    counts = stored(docs.mapInArrow(lean(count), "lang string, gram long, n long, lo long, hi long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")), "grams")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    kind = next(t for t, most in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 1 << 30)) if len(languages) <= most)
    rows = np.zeros((max(1, -(-len(languages) // 64)), 1 << bits), kind)
    if languages:
        numbered = counts.sparkSession.createDataFrame([(x, i, float(totals[x])) for i, x in enumerate(languages)], "lang string, number int, total double")
        rates = counts.filter("lo < hi").join(numbered, "lang").withColumn("rate", F.col("n") / F.col("total"))
        top = rates.groupBy("gram").agg(F.max("rate").alias("top"))
        own = rates.filter(F.col("rate") >= least_rate).join(top, "gram").filter(F.col("rate") >= near_top * F.col("top")).select("gram", "number")

        def place(batches):
            for batch in batches:
                g, number = batch.column("gram").to_numpy(), batch.column("number").to_numpy()
                at = np.concatenate([slots(g, i, bits) for i in range(hashes)])
                yield pa.record_batch([pa.array(at // CHUNK), pa.array((at % CHUNK).astype(np.int32)), pa.array(np.tile(number, hashes).astype(np.int32))], names=["chunk", "slot", "number"])

        bit = own.mapInArrow(place, "chunk long, slot int, number int").withColumn("word", F.expr("number div 64"))
        masks = bit.groupBy("chunk", "slot", "word").agg(F.bit_or(F.expr("shiftleft(1L, cast(number % 64 as int))")).alias("mask"))
        chunks = masks.groupBy("chunk", "word").agg(F.collect_list(F.struct("slot", "mask")).alias("cells"))  # CHUNK cells at most

        def pack(batches):
            for batch in batches:
                for chunk, word, cells in zip(batch.column("chunk").to_pylist(), batch.column("word").to_pylist(), batch.column("cells")):
                    part = np.zeros(CHUNK, np.uint64)
                    part[cells.values.field("slot").to_numpy()] = cells.values.field("mask").to_numpy().astype(np.uint64)
                    yield pa.record_batch([pa.array([chunk]), pa.array([word], pa.int64()), pa.array([part.astype(kind).tobytes()])], names=["chunk", "word", "part"])

        for r in chunks.mapInArrow(pack, "chunk long, word long, part binary").toLocalIterator():
            rows[r.word, r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.part, kind)
    return Filters(languages, rows, hashes)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """Adds lang_pred, score and known to ``docs``, in place of columns of these names.

    Null texts and texts without a letter are ``und`` (score 0), as is everything if no language is known; of languages with equally
    many n-grams, the first by code point is taken. Each row is judged for itself; long texts are taken in stretches; an empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.rows, filters.hashes))  # 2**bits rows, whatever the corpus
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "known")]
    docs = docs.select(*names)

    def run(batches):
        own = Filters(*shared.value)
        for batch in batches:
            for some in slices(batch):
                lang, score, known = zip(*[own.decide(t) for t in some.column("text").to_pylist()])
                yield pa.record_batch([*some.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.float64())], names=[*some.schema.names, "lang_pred", "score", "known"])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.DoubleType())]))


def remainder(n: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op10_langid(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents")
    filters = fit(docs.filter(remainder(4) != 2))
    out = identify(docs.select("doc_id", "text"), filters)
    return out.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "known")
