"""Packing by bounded-space online best fit."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoder, lean, slices, stored, table, vocabulary

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, leftover boolean, part long"
FIELDS = [x.split()[0] for x in PIECES.split(", ")]


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    types = {"binary": pa.binary(), "boolean": pa.bool_(), "long": pa.int64()}
    columns = list(zip(*rows)) or [()] * len(FIELDS)
    return pa.record_batch([pa.array(c, types[x.split()[1]]) for c, x in zip(columns, PIECES.split(", "))], names=FIELDS)


class Windows:
    """A fixed number of open windows of ``room`` ids; a window is a list of pieces (doc_id, start, ids, doc_tokens)."""

    def __init__(self, room: int, most: int, least: int):
        self.room, self.most, self.least = room, most, least
        self.order: list[tuple[int, int]] = []  # (free ids, key), ascending
        self.open: dict[int, list] = {}
        self.made = 0

    def add(self, doc_id, start, ids: bytes, doc_tokens):
        """Place a piece in the window that it fits best; yields the windows that close."""
        while ids:
            n = len(ids) // 4
            if n >= self.room:
                yield [(doc_id, start, ids[: 4 * self.room], doc_tokens)]
                start, ids = start + self.room, ids[4 * self.room :]
                continue
            at = bisect_left(self.order, (n, -1))
            if at == len(self.order) and len(self.order) == self.most:  # none fits: the fullest goes, topped up with the head of the piece
                free, key = self.order.pop(0)
                window = self.open.pop(key)
                if free >= self.least:
                    window.append((doc_id, start, ids[: 4 * free], doc_tokens))
                    start, ids = start + free, ids[4 * free :]
                yield window
                continue
            if at == len(self.order):
                free, key = self.room, self.made
                self.made += 1
                self.open[key] = []
            else:
                free, key = self.order.pop(at)
            self.open[key].append((doc_id, start, ids, doc_tokens))
            if free == n:
                yield self.open.pop(key)
            else:
                insort(self.order, (free - n, key))
            return

    def rest(self):
        return [self.open[key] for _, key in self.order]


class Numbered:
    """Turns windows into rows; ids of sequences are unique over (round, part)."""

    def __init__(self, number: int, part: int):
        self.next, self.part, self.rows, self.held = number, part, [], 0

    def put(self, window: list, leftover: bool) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in window:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, ids, doc_tokens, self.next, offset, leftover, self.part))
            offset, self.held = offset + n, self.held + len(ids)
        self.next += 1

    def take(self, least: int):
        if self.held >= least and self.rows:
            yield _arrow(self.rows)
            self.rows, self.held = [], 0


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, windows: int = 16, least: int = 8, fan_in: int = 32) -> DataFrame:
    """Pack all documents into sequences of at most ``length`` ids.

    Each partition keeps ``windows`` open windows. A piece goes where it leaves least room; if it fits nowhere and all windows are
    open, the fullest is emitted, topped up by the piece's head if at least ``least`` ids are free in it. Windows still open at
    the end of a partition are leftovers: ``fan_in`` partitions' leftovers are packed together in the same way, and so on until one
    set of open windows is left, which is filled up window by window (a task never gets more than ``fan_in * windows`` windows).

    Returns a row for each piece: doc_id, start (ids of its document before it), length, ids (little-endian uint32), doc_tokens,
    sequence_id, offset. Null or empty texts are the end id alone; a null doc_id stays null; repeated rows are packed each for
    itself; other columns are ignored; an empty table gives no rows. A long text is encoded in one task; its ids are cut as any others.
    """

    def first(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        space, out = Windows(length, windows, least), Numbered(part << 32, part)
        for batch in batches:
            for some in slices(batch):
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), encode(some.column("text").to_pylist())):
                    ids += end
                    for window in space.add(doc_id, 0, ids, len(ids) // 4):
                        out.put(window, False)
                yield from out.take(1 << 20)
        for window in space.rest():
            out.put(window, True)
        yield from out.take(0)

    def merge(level: int, last: bool, key: tuple, group: pa.Table) -> pa.Table:
        part = key[0].as_py()
        space, out = Windows(length, windows, least), Numbered((level << 56) | (part << 32), part)
        group = group.sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        for row in group.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist():
            for window in space.add(*row.values()):
                out.put(window, False)
        rest = Windows(length, 1, 1) if last else None
        for window in space.rest():
            for piece in window if last else ():
                for full in rest.add(*piece):
                    out.put(full, False)
            if not last:
                out.put(window, True)
        for window in rest.rest() if last else ():
            out.put(window, False)
        return pa.Table.from_batches([_arrow(out.rows)])

    def rounds(level: int, last: bool):
        return lambda key, group: merge(level, last, key, group)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = stored(docs.mapInArrow(lean(first), PIECES), "packed")
    done, left = [made.filter("not leftover")], made.filter("leftover")
    parts, level = (made.agg(F.max("part")).first()[0] or 0) + 1, 1
    while True:
        parts = -(-parts // fan_in)
        last = parts == 1
        group = left.withColumn("group", F.expr(f"part div {fan_in}"))
        made = group.groupBy("group").applyInArrow(rounds(level, last), PIECES)
        made = stored(made, "leftovers")
        done.append(made.filter("not leftover"))
        if last:
            break
        left, level = made.filter("leftover"), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("leftover", "part")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = pack(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
