"""Publisher's matter at the ends of a book, found as a run of paragraphs from each end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases, marks, field labels and headings of publisher's pages; limits in characters and paragraphs.
PHRASES = ["all rights reserved", "first published in", "english translation rights", "english translation copyright", "this book is a work of fiction", "uploading and distribution", "uploading, and distribution", "ebook edition", "printed in the united states", "library of congress", "cataloging-in-publication", "translation by ", "cover art by ", "illustration by "]
MARKS = ["isbn", "lccn", "lcgft", "cyac"]
LABELS = ["subjects", "identifiers", "classification", "description", "names", "title"]
HEADINGS = ["contents", "table of contents", "copyright", "cover page", "landmarks", "color illustrations", "front matter", "back matter"]
LONGEST, SHARE, WINDOW, GAP, FEWEST, MARKERS = 400, 0.10, 40, 4, 8, 3


def is_contents(x: Column) -> Column:
    """A table of contents run into one paragraph: it names chapters, or has bullets, three times."""
    return F.regexp_count(x, F.lit(r"(?i)\bchapter\s+[0-9ivxlc]+|•|■\s*[0-9]")) >= MARKERS


def is_signature(x: Column) -> Column:
    """A short paragraph with a mark of a publisher's page, or a table of contents."""
    low = F.lower(x)
    held = F.contains(low, F.lit("©")) | low.rlike(r"\(c\)\s*[0-9]{4}")
    for phrase in PHRASES:
        held = held | F.contains(low, F.lit(phrase))
    held = held | low.rlike(rf"\b(?:{'|'.join(MARKS)})\b") | low.rlike(rf"(?m)^\s*(?:{'|'.join(LABELS)})\s*:") | low.rlike(rf"(?m)^\s*(?:{'|'.join(HEADINGS)})\b")
    return is_contents(x) | ((F.length(x) <= LONGEST) & held)


def run_length(kinds: Column) -> Column:
    """How many of the paragraphs belong to the run that begins with the first; kinds: b(lank), s(ignature), p(rose, too long), o(ther).

    The run ends with its last signature. It goes on over other paragraphs as long as a signature comes within ``GAP`` of the last one (or of
    the start); prose ends it.
    """
    start = F.struct(F.lit(0).alias("run"), F.lit(-1).alias("last"), F.lit(0).alias("step"), F.lit(True).alias("on"))

    def go(s, k):
        hit, stop = s["on"] & (k == "s"), (k == "p") | ((k == "o") & (s["step"] - s["last"] > GAP))
        return F.struct(F.when(hit, s["step"] + 1).otherwise(s["run"]).alias("run"), F.when(hit, s["step"]).otherwise(s["last"]).alias("last"), (s["step"] + 1).alias("step"), (s["on"] & ~stop).alias("on"))

    return F.aggregate(kinds, start, go, lambda s: s["run"])


def without_colophon(docs: DataFrame, text: str, sep: str = "\n\n") -> DataFrame:
    """The rows with ``text`` less the publisher's matter at both ends, and front and back (paragraphs taken off).

    Only the first and last paragraphs are looked at: a tenth of them, ``WINDOW`` at least, half at most. Texts of under ``FEWEST``
    paragraphs, and those of which over four fifths would go, stay as they are; a null text stays null, with 0 and 0.
    """
    p = F.split(F.coalesce(F.col(text), F.lit("")), sep)
    n = F.size("_p")
    limit = F.least(F.floor(n / 2), F.greatest(F.lit(WINDOW), F.floor(n * SHARE))).cast("int")
    kind = lambda x: F.when(F.trim(F.regexp_replace(x, r"\s+", " ")) == "", "b").when(is_signature(F.trim(x)), "s").when(F.length(F.trim(x)) > LONGEST, "p").otherwise("o")
    ends = docs.withColumn("_p", p).withColumn("_n", limit)
    ends = ends.withColumn("_head", F.transform(F.slice("_p", F.lit(1), F.greatest("_n", F.lit(1))), kind)).withColumn("_tail", F.transform(F.reverse(F.slice("_p", n - F.greatest("_n", F.lit(1)) + 1, F.greatest("_n", F.lit(1)))), kind))
    ends = ends.withColumns({"front": run_length(F.col("_head")), "back": run_length(F.col("_tail"))})
    keep = (n < FEWEST) | (F.col("front") + F.col("back") > n * 0.8)
    ends = ends.withColumns({c: F.when(keep, 0).otherwise(F.col(c)).cast("int") for c in ("front", "back")})
    left = F.array_join(F.slice("_p", F.col("front") + 1, n - F.col("front") - F.col("back")), sep)
    return ends.withColumn(text, F.when(F.col("front") + F.col("back") == 0, F.col(text)).otherwise(left)).drop("_p", "_n", "_head", "_tail")
