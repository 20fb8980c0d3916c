"""Fill-in-the-middle by a sparse index of checkpoints.

One pass over a text's bytes counts its units and records, every so many units, the byte and the code point where the last of them
ends. A cut after any number of units is found by binary search among the checkpoints and a short scan from there, so a text needs
no list of its units, whatever their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STRETCH, lean, slices, table, utf8

MARKS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def unit_ends(b: np.ndarray, follows: int, unit: str) -> np.ndarray:
    """Where units end in some bytes of a text; ``follows`` is the byte after them, -1 at the end of the text.

    ``char``: units are code points. ``token``: a run of other bytes than space and 9 to 13, with the blanks before it; blanks that end
    the text are a unit of their own.
    """
    after = np.empty(len(b), np.int16)
    after[:-1], after[-1] = b[1:], follows
    if unit == "char":
        return np.flatnonzero((after & 0xC0) != 0x80) + 1
    blank, last = _BLANK[b], after < 0
    return np.flatnonzero((~blank & (last | _BLANK[after])) | last) + 1


class Checkpoints:
    """Counts of a text in UTF-8, and where it can be cut: ``n`` units, ``chars`` code points, a checkpoint every ``every`` units."""

    def __init__(self, data: bytes, unit: str = "token", every: int = 256, stretch: int = STRETCH):
        self.data, self.unit, self.every = data, unit, every
        self.n = self.chars = 0
        units, places, chars = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        for at in range(0, len(data), stretch):
            ends, starts = self._scan(at, stretch)
            first = (-self.n - 1) % every  # units of this stretch before the next checkpoint
            marked = ends[first::every]
            units.append(self.n + 1 + first + every * np.arange(len(marked)))
            places.append(at + marked)
            chars.append(self.chars + starts[marked - 1])
            self.n += len(ends)
            self.chars += int(starts[-1])
        self.units, self.places, self.code_points = (np.concatenate(x) for x in (units, places, chars))

    def _scan(self, at: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Unit ends in the ``size`` bytes from ``at``, and for each byte the code points begun so far."""
        b = np.frombuffer(self.data, np.uint8, min(size, len(self.data) - at), at)
        follows = self.data[at + size] if at + size < len(self.data) else -1
        return unit_ends(b, follows, self.unit), np.cumsum((b & 0xC0) != 0x80)

    def cut(self, unit: int, reach: int = 4096) -> tuple[int, int]:
        """(byte, code point) at which the first ``unit`` units end."""
        i = int(np.searchsorted(self.units, unit, "right")) - 1
        more, at, char = unit - int(self.units[i]), int(self.places[i]), int(self.code_points[i])
        while more:
            ends, starts = self._scan(at, reach)
            if len(ends) >= more:
                end = int(ends[more - 1])
                return at + end, char + int(starts[end - 1])
            more, at, char = more - len(ends), at + len(starts), char + int(starts[-1])
        return at, char


def fill_in_middle(docs: DataFrame, key: str = "doc_id", seed: int = 42, rate: int = 50, spm: int = 80, unit: str = "token", every: int = 256) -> DataFrame:
    """The rows of ``docs`` with ``output`` in place of text, and n, form, prefix_chars, middle_chars (in place of columns of these names).

    A text of n units is cut in three after the smaller and the larger of two numbers of units. h1 to h4 are the first four groups of
    8 digits of the hexadecimal sha256 of ``seed:key``; the numbers are h1 and h2 modulo n + 1. A text is plain, and output is the
    text, if it is empty, holds one of the marks <P>, <S>, <M>, or h3 % 100 >= ``rate``. Else it is spm, <S>suffix<P>prefix<M>middle,
    if h4 % 100 < ``spm``, or psm, <P>prefix<S>suffix<M>middle.

    Null texts count as empty; a null key hashes as ``seed:``; equal keys are cut alike; repeated rows come out as often; an
    empty table gives no rows; of a long text, no more than its bytes and a checkpoint for ``every`` units is held.
    """
    added = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.BinaryType())]
    names = [c for c in docs.columns if c != "text" and c not in {x for x, _ in added}]
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.struct(*names, F.lit(0).alias("no_column")).alias("row"), draw.alias("draw"), utf8().alias("data"))
    schema = T.StructType([rows.schema["row"], *(T.StructField(c, t) for c, t in added)])
    marks = [m.encode() for m in MARKS]

    def one(data: bytes, draw: str) -> tuple:
        h = [int(draw[i : i + 8], 16) for i in range(0, 32, 8)]
        index = Checkpoints(data, unit, every)
        if not data or h[2] % 100 >= rate or any(m in data for m in marks):
            return index.n, "plain", None, None, data
        first, last = sorted((h[0] % (index.n + 1), h[1] % (index.n + 1)))
        (i, before), (j, upto) = index.cut(first), index.cut(last)
        prefix, middle, suffix = data[:i], data[i:j], data[j:]
        form = "spm" if h[3] % 100 < spm else "psm"
        parts = (marks[1], suffix, marks[0], prefix) if form == "spm" else (marks[0], prefix, marks[1], suffix)
        return index.n, form, before, upto - before, b"".join((*parts, marks[2], middle))

    def run(batches):
        for batch in batches:
            for some in slices(batch, "data"):
                found = [one(d, h) for d, h in zip(some.column("data").to_pylist(), some.column("draw").to_pylist())]
                columns = [pa.array(x, kind) for x, kind in zip(zip(*found), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.record_batch([some.column("row"), *columns], names=["row", *(c for c, _ in added)])

    out = rows.mapInArrow(lean(run), schema)
    return out.select(*(F.col("row")[c].alias(c) for c in names), *(c for c, _ in added[:-1]), F.col("output").cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No mark stands in the text of a form that isn't plain, and none can begin in a part of it."""
    parts = F.split(output, "|".join(MARKS), -1)
    of = lambda *at: F.concat(*(F.get(parts, F.lit(i)) for i in at))
    return F.when(form == "psm", of(1, 3, 2)).when(form == "spm", of(2, 3, 1)).otherwise(output)


def op11_fim(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    columns = [digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *columns)


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS h FROM d),
c AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS i, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS j,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:i], '') AS prefix, array_to_string(u[i + 1:j], '') AS middle, array_to_string(u[j + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""
