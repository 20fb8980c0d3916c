"""Written result artifacts as rows, and front matter known by its template."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARTIFACT = "meta struct<experiment: string>, summary string, rows array<struct<arm: string, id: bigint, correct: boolean>>"

# How the one known template opens, the lines one of which ends it, and how the line after them begins.
OPENING = "Manifesto."
LAST_LINES = ["Original Web Novel Chapter — Complete.", "Original Web Novel Chapter — Incomplete.", "Original Light Novel Chapter — Complete.", "Original Light Novel Chapter — Incomplete."]
CREDIT = "Original Translation by"


def tolerant(line: str) -> str:
    """A pattern for a line whatever its case, with any blanks or none about a dash, and any dash, the hyphen too."""
    words = [re.escape(w) for w in line.split()]
    return "[ \\t]+".join(words).replace("[ \\t]+—[ \\t]+", "[ \\t]*[-‐‑‒–—―][ \\t]*")


#: What ends the template: one of the last lines, blank lines or none, the credit with a name and a full stop, and the line ends after it.
ANCHOR = "(?i:" + "|".join(tolerant(x) for x in LAST_LINES) + r")\s*\n" + tolerant(CREDIT) + r"[ \t][^\n]*\.\s*\n"


def arm_results(artifacts: DataFrame, name: str, body: str, books: list[str]) -> DataFrame:
    """family, book, arm, id, correct: a row for each id that an arm of an experiment answered for a book.

    ``body`` is JSON. Artifacts that don't parse, or without rows or a summary, or whose name holds none of ``books``, are skipped, as are
    rows without arm or id; a missing mark is false. The family is the experiment's name, else the artifact's up to two underscores. Of
    several answers the last counts, by name of the artifact and place in it: one aggregation, whatever the number of artifacts.
    """
    book = F.coalesce(*[F.when(F.contains(F.col(name), F.lit(b)), b) for b in books])
    read = artifacts.select(F.col(name).alias("name"), book.alias("book"), F.from_json(body, ARTIFACT).alias("a")).filter("book IS NOT NULL AND a.summary IS NOT NULL")
    family = F.coalesce("a.meta.experiment", F.substring_index("name", "__", 1))
    rows = read.select(family.alias("family"), "book", "name", F.posexplode("a.rows").alias("pos", "r")).filter("r.arm IS NOT NULL AND r.id IS NOT NULL")
    last = F.max_by(F.coalesce("r.correct", F.lit(False)), F.struct("name", "pos"))
    return rows.groupBy("family", "book", F.col("r.arm").alias("arm"), F.col("r.id").alias("id")).agg(last.alias("correct"))


def front_matter(text: Column) -> Column:
    """What stands up to the end of the template's last lines; empty where a text doesn't open as the template does or never ends it.

    A null text gives null. Spaces, line ends and a byte order mark may go before the opening.
    """
    opens = text.rlike(r"^[﻿ \t\r\n]*" + OPENING.replace(".", r"\."))
    return F.when(opens, F.regexp_extract(text, f"(?s)^(.*?{ANCHOR})", 1)).when(text.isNotNull(), "")


def without_front_matter(docs: DataFrame, text: str) -> DataFrame:
    """The rows with ``text`` after its front matter, and removed_chars and removed_lines (0 where nothing goes)."""
    head = docs.withColumn("_head", front_matter(F.col(text)))
    size = F.length("_head")
    return head.withColumns({"removed_chars": size, "removed_lines": F.regexp_count("_head", F.lit("\n")), text: F.substring(F.col(text), size + 1, F.length(text))}).drop("_head")
