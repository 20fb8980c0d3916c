"""Quoted regions of documents, entries held against them, and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import ended_by_stops
from ..operators import gates as G
from ..operators.evidence import chunk_gate
from .registry import query


def quoted(t):
    """Documents in which what follows a comma is said: it opens a quote, and every full stop closes one."""
    said = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(", "), F.lit(" “")), F.lit("."), F.lit(".”"))
    return t.documents.select("doc_id", said.alias("source"))


def segments(t):
    """Entries cut from the text itself, not from the regions that the gate finds: a sentence up to its first comma is narrated, the rest is said.

    Some sentences in 41 are damaged: the wrong kind, no text, a Cyrillic letter, a mark inside, another kind, both entries given again,
    both in one entry, no kind.
    """
    pieces = F.split(F.coalesce("text", F.lit("")), r"\.", -1)
    ended = F.transform(pieces, lambda x, i: F.concat(x, F.when(i < F.size(pieces) - 1, ".").otherwise("")))
    each = t.documents.select("doc_id", F.posexplode(ended).alias("i", "x")).withColumn("how", F.pmod(F.col("doc_id") + F.col("i") * 3, F.lit(41)))
    comma = F.instr("x", ", ")
    told = F.when(comma > 0, F.substr("x", F.lit(1), comma - 1)).otherwise(F.col("x"))
    said = F.when(comma > 0, F.replace(F.substr("x", comma + 2), F.lit(", "), F.lit(" ")))
    entry = lambda pos, kind, text: F.struct((F.col("i") * 4 + pos).alias("pos"), F.lit(kind).alias("kind"), text.alias("text"))
    both = [entry(0, "NARRATOR", told), entry(1, "SPOKEN", said)]
    again = F.array(*both, entry(2, "NARRATOR", told), entry(3, "SPOKEN", said))
    in_one = F.array(entry(0, "NARRATOR", F.concat_ws(" ", told, said)))
    found = each.select("doc_id", "how", F.explode(F.when(F.col("how") == 5, again).when(F.col("how") == 6, in_one).otherwise(F.array(*both))).alias("e"))
    found = found.select("doc_id", "how", "e.*").withColumn("text", F.trim(F.replace("text", F.lit("\n"), F.lit(" ")))).filter("text <> ''")
    how, other = F.col("how"), F.when(F.col("kind") == "SPOKEN", "NARRATOR").otherwise("SPOKEN")
    return found.select(
        "doc_id", "pos", F.when(how == 0, other).when(how == 4, "THOUGHT").when(how == 7, F.lit(None)).otherwise(F.col("kind")).alias("kind"),
        F.when(how == 1, " ").when(how == 2, F.concat("text", F.lit(" Ж"))).when(how == 3, F.concat(F.lit("“"), "text")).otherwise(F.col("text")).alias("text"),
    )


@query("f18_regions")
def f18_regions(t):
    regions = G.quote_regions(quoted(t), "doc_id", "source", listed=False)
    return regions.groupBy("doc_id").agg(F.count_if(F.col("kind") == "SPOKEN").alias("spoken"), F.count_if(F.col("kind") == "NARRATOR").alias("narrated"), F.sum(F.when(F.col("kind") == "SPOKEN", F.col("end") - F.col("start")).otherwise(0)).alias("spoken_chars"), F.max("n_repairs").alias("repairs"), F.md5(F.concat_ws("\n", F.sort_array(F.collect_list("text"))).cast("binary")).alias("digest"))


@query("j04_segment_gate")
def j04(t):
    sources, entries = quoted(t), segments(t)
    spoken = entries.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("output"))
    both = sources.join(spoken, "doc_id", "left").select("doc_id", F.regexp_replace("source", rf"{G.MARKS}|\n", " ").alias("source"), F.coalesce("output", F.lit("")).alias("output"))
    return G.segment_gate(entries, sources, "doc_id", "pos", "kind", "text", "source", chunk_gate(both, ["doc_id"], "source", "output"))


def damaged_entries(t):
    """Sentences as entries: two of nine are given again, an empty one stands after each sixth, every seventh has Cyrillic letters."""
    said = F.transform(ended_by_stops(F.replace("text", F.lit("\n"), F.lit(" "))), F.trim)
    each = t.documents.select("doc_id", F.posexplode(said).alias("i", "text"))
    shown = F.when(F.col("i") % 7 == 3, F.translate("text", "aeo", "аео")).otherwise(F.col("text"))
    first = each.select("doc_id", (F.col("i") * 10).alias("pos"), shown.alias("text"))
    again = each.filter("i % 9 IN (4, 5)").select("doc_id", (F.col("i") * 10 + F.when(F.col("i") % 9 == 4, 11).otherwise(2)).alias("pos"), shown.alias("text"))
    empty = each.filter("i % 6 = 2").select("doc_id", (F.col("i") * 10 + 5).alias("pos"), F.lit("").alias("text"))
    return first.unionByName(again).unionByName(empty)


@query("j09_repaired")
def j09(t):
    source = t.documents.select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")).alias("source"))
    out = G.repaired(damaged_entries(t), source, "doc_id", "pos", "text", "source")
    return out.select("doc_id", "pos", "pause_after", "change", F.md5(F.col("text").cast("binary")).alias("digest"))
