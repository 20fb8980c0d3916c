"""Paragraphs packed into chunks that don't end in a quote or cross a chapter, and entries located forward through their source.

Both run over sorted rows: a task holds the chunk it is at, or a source and a place in it, however many rows there are.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPENING, CLOSING = "「『“", "」』”"
QUOTES = re.compile(f'[{OPENING}{CLOSING}"]')
SENTENCE_END = re.compile(r"[.!?…。！？][\"”」』')]*(?:\s|$)|[。！？][”」』]*")


def depth_after(text: str, depth: int = 0) -> int:
    """How many quotes are open at a text's end: paired marks nest, a straight one opens where none is open and else closes all."""
    for m in QUOTES.finditer(text):
        if m[0] in OPENING:
            depth += 1
        elif m[0] in CLOSING:
            depth = max(0, depth - 1)
        else:
            depth = 0 if depth else 1
    return depth


def legal_cut(text: str, most: int, depth: int) -> int:
    """Where to cut an overlong text: after the last sentence end outside of quotes within ``most`` characters; else where the quote that is
    open there closes, within as many again; else after the last sentence end; else after the last blank; else at ``most``."""
    outside, any_end, at, now = 0, 0, 0, depth
    for m in SENTENCE_END.finditer(text, 0, most):
        now, at = depth_after(text[at : m.end()], now), m.end()
        any_end = at
        outside = at if now == 0 else outside
    if outside:
        return outside
    now = depth_after(text[at:most], now)
    if now:
        for m in QUOTES.finditer(text, most, 2 * most):
            now = depth_after(m[0], now)
            if not now:
                return m.end()
    return any_end or text.rfind(" ", 0, most) + 1 or most


class Chunker:
    """An automaton over a document's paragraphs: (chapter, first paragraph, text, open quotes at its end) of each chunk.

    A chunk is closed before a paragraph that would make it longer than ``most``, if no quote is open or it would be longer than ``slack``
    times that. A new chapter closes it too. Paragraphs over ``most`` are cut by ``legal_cut``, each piece a chunk.
    """

    def __init__(self, most: int, slack: float):
        self.most, self.slack = most, slack
        self.chapter, self.first, self.parts, self.size, self.depth = None, 0, [], 0, 0

    def done(self):
        if self.parts:
            yield self.chapter, self.first, "\n\n".join(self.parts), self.depth
        self.parts, self.size, self.depth = [], 0, 0

    def feed(self, chapter: int, pos: int, text: str):
        if chapter != self.chapter:
            yield from self.done()
            self.chapter = chapter
        if len(text) > self.most:
            yield from self.done()
            depth = 0
            while len(text) > self.most:
                cut = legal_cut(text, self.most, depth)
                depth = depth_after(text[:cut], depth)
                yield chapter, pos, text[:cut].rstrip(), depth
                text = text[cut:].lstrip()
            if text:
                yield chapter, pos, text, depth_after(text, depth)
            return
        longer = self.size + 2 + len(text)
        if self.parts and longer > self.most and (self.depth == 0 or longer > self.most * self.slack):
            yield from self.done()
        if not self.parts:
            self.first, self.size = pos, -2
        self.parts.append(text)
        self.size += 2 + len(text)
        self.depth = depth_after(text, self.depth)


def paragraphs(docs: DataFrame, key: str, text: str, heading: str = r"(?i)^(chapter|part|prologue|epilogue)\b.{0,60}$", sep: str = r"\n\s*\n") -> DataFrame:
    """key, pos, chapter, text of paragraphs that aren't blank; a chapter begins with each one that matches ``heading`` (before it: 0)."""
    rows = docs.select(key, F.split(F.coalesce(text, F.lit("")), sep).alias("p"))
    opens = F.transform("p", lambda x: F.trim(x).rlike(heading).cast("int"))
    counted = F.aggregate(opens, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x)))
    found = rows.select(key, F.posexplode(F.arrays_zip(F.col("p").alias("t"), counted.alias("c"))).alias("pos", "x"))
    return found.select(key, "pos", F.col("x.c").alias("chapter"), F.regexp_replace("x.t", r"^\s+|\s+$", "").alias("text")).filter("text <> ''")


def structural_chunks(parts: DataFrame, key: str, most: int = 3000, slack: float = 1.5) -> DataFrame:
    """key, chunk, chapter, first (paragraph), text, depth (open quotes at its end) by ``Chunker`` over rows key, pos, chapter, text.

    Documents are dealt out by key and their paragraphs sorted, so a long document is streamed, not held.
    """

    def run(batches):
        import pyarrow as pa

        now, chunker, n = None, None, 0
        for batch in batches:
            out = []

            def add(found):
                nonlocal n
                for chapter, first, text, depth in found:
                    out.append((now, n, chapter, first, text, depth))
                    n += 1

            for k, pos, chapter, text in zip(*(batch.column(c).to_pylist() for c in (key, "pos", "chapter", "text"))):
                if chunker is None or k != now:
                    if chunker:
                        add(chunker.done())
                    now, chunker, n = k, Chunker(most, slack), 0
                add(chunker.feed(chapter, pos, text))
            yield batch_of(out)
        if chunker:
            out = [(now, n, *x) for x in chunker.done()]
            yield batch_of(out)

    def batch_of(out):
        import pyarrow as pa

        columns = list(zip(*out)) or [()] * 6
        return pa.record_batch([pa.array(x, kind) for x, kind in zip(columns, kinds)], names=[key, "chunk", "chapter", "first", "text", "depth"])

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(parts.schema[key].dataType), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
    schema = T.StructType([parts.schema[key]]).add("chunk", "integer").add("chapter", "integer").add("first", "integer").add("text", "string").add("depth", "integer")
    return parts.select(key, "pos", "chapter", "text").repartition(key).sortWithinPartitions(key, "pos").mapInArrow(run, schema)


def plain(x):
    """A text as entries and sources are compared: without quotation marks, white space runs as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), f'[{OPENING}{CLOSING}"]', ""), r"\s+", " "))


def step(source: str, needle: str, cursor: int) -> tuple[int, str, int]:
    """(place, how, cursor) of one entry: the first place from the cursor on, else the first anywhere; the cursor goes behind it."""
    if not needle:
        return -1, "empty", cursor
    at, how = source.find(needle, cursor), "forward"
    if at < 0:
        at, how = source.find(needle), "anywhere"
    return (at, how, at + len(needle)) if at >= 0 else (-1, "not_found", cursor)


def located_forward(entries: DataFrame, sources: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """key, pos, start, end, how of entries in the plain text of their source (see ``plain`` and ``step``); start and end null if not found.

    Entries are taken in order of ``pos``: one that occurs often is the next occurrence after the entry before it. A source's row is
    sorted before its entries, which are streamed; entries without a source aren't found.
    """
    s = sources.select(key, F.lit(None).cast(entries.schema[pos].dataType).alias(pos), plain(F.col(text)).alias("t"), F.lit(0).alias("kind"))
    rows = s.unionByName(entries.select(key, pos, plain(F.col(text)).alias("t"), F.lit(1).alias("kind"))).repartition(key).sortWithinPartitions(key, "kind", pos)

    def run(batches):
        import pyarrow as pa

        now, source, cursor = None, "", 0
        for batch in batches:
            take, start, end, hows = [], [], [], []
            for i, (k, t, kind) in enumerate(zip(*(batch.column(c).to_pylist() for c in (key, "t", "kind")))):
                if kind == 0 or k != now:
                    now, source, cursor = k, t if kind == 0 else "", 0
                if kind:
                    at, how, cursor = step(source, t, cursor)
                    take.append(i)
                    start.append(at if at >= 0 else None)
                    end.append(at + len(t) if at >= 0 else None)
                    hows.append(how)
            at = pa.array(take, pa.int64())
            yield pa.record_batch([batch.column(key).take(at), batch.column(pos).take(at), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(hows, pa.string())], names=[key, pos, "start", "end", "how"])

    schema = entries.select(key, pos).schema.add("start", "long").add("end", "long").add("how", "string")
    return rows.mapInArrow(run, schema)
