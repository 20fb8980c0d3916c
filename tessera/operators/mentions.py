"""Passages that name several things, evidence by longest shared runs of words, and picks that lie far apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def co_mentions(passages: DataFrame, names: DataFrame, key: str, text: str, name: str, most: int) -> DataFrame:
    """For each name, the passages (distinct texts, ``key`` the smallest) that hold it and another name: their number, and the first ``most`` keys.

    Names are single words. Words meet names by an equi join on distinct words of a text, so no passage is held against every name.
    """
    once = passages.filter(F.col(text).isNotNull()).groupBy(text).agg(F.min(key).alias(key))
    words = once.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\p{L}]+"), F.lit(0)))).alias(name))
    found = words.join(names.select(name).distinct(), name)
    many = found.groupBy(key).agg(F.count("*").alias("_n")).filter("_n >= 2")
    held = found.join(many, key, "left_semi")
    counts = held.groupBy(name).agg(F.count("*").alias("passages"))
    ranked = held.withColumn("_r", F.row_number().over(Window.partitionBy(name).orderBy(key))).filter(F.col("_r") <= most)
    kept = ranked.groupBy(name).agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",").alias("first"))
    return counts.join(kept, name)


def longest_support(items: DataFrame, texts: DataFrame, item: str, doc: str, least: int = 5) -> DataFrame:
    """The longest run of an item's words (``least`` or more) that any text holds, and how often its most frequent run of that length occurs.

    Shared windows of ``least`` words meet by an equi join; those that follow each other on a diagonal (equal difference of places) are one
    longer run. Items without such a run have 0 and 0; null and short texts hold none.
    """

    def windows(rows, key, pos):
        w = rows.select(key, F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}_]+", " "), " "), lambda x: x != "").alias("_w"))
        at = w.filter(F.size("_w") >= least).select(key, "_w", F.explode(F.sequence(F.lit(1), F.size("_w") - (least - 1))).alias(pos))
        return at.select(key, pos, F.array_join(F.slice("_w", F.col(pos), least), " ").alias("_g"))

    hits = windows(items, item, "_i").join(windows(texts, doc, "_p"), "_g").select(item, doc, "_i", "_p")
    line = Window.partitionBy(item, doc, F.col("_p") - F.col("_i")).orderBy("_i")
    runs = hits.withColumn("_run", F.col("_i") - F.row_number().over(line)).withColumn("_line", F.col("_p") - F.col("_i"))
    runs = runs.groupBy(item, doc, "_line", "_run").agg(F.min("_i").alias("_start"), (F.count("*") + (least - 1)).alias("longest"))
    counted = runs.groupBy(item, "longest", "_start").agg(F.count("*").alias("times"))
    best = counted.groupBy(item).agg(F.max(F.struct("longest", "times")).alias("_b")).select(item, "_b.longest", "_b.times")
    return items.select(item).join(best, item, "left").select(item, F.coalesce("longest", F.lit(0)).alias("longest"), F.coalesce("times", F.lit(0)).alias("times"))


def spread(rows: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """``k`` rows picked one by one, each farthest in ``value`` from the nearest one picked before, the largest first; ties to the smaller key.

    Each pick is one aggregation; only the picked row reaches the driver. Rows without a value, and values already picked, are not picked.
    """
    pool = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(key, value)
    picked: list = []
    while len(picked) < k:
        far = F.least(*[F.abs(F.col(value) - p[1]) for p in picked], F.lit(float("inf"))) if picked else F.col(value)
        best = pool.select(key, value, far.alias("_d")).filter("_d > 0" if picked else "true").orderBy(F.desc("_d"), key).limit(1).collect()
        if not best:
            break
        picked.append((best[0][key], best[0][value]))
    schema = rows.select(key, value).schema
    ranked = [(a, b, i) for i, (a, b) in enumerate(picked, 1)]
    return rows.sparkSession.createDataFrame(ranked, schema.add("rank", T.IntegerType()))
