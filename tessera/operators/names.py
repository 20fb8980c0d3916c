"""Fuzzy names: a similarity join by edit ratio with length bands and rarest grams, and what resolves names with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that tell a relative from the person.
RELATIVES = ["mother", "father", "sister", "brother", "daughter", "son"]


def edit_ratio(a: str, b: str) -> Column:
    """1 - edits / length of the longer name."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def grams(name: str, q: int) -> Column:
    """The ``q``-grams of a name padded at both ends; a gram's second occurrence is told from its first."""
    padded = f"concat(repeat(chr(1), {q - 1}), {name}, repeat(chr(2), {q - 1}))"
    plain = f"transform(sequence(1, length({padded}) - {q - 1}), i -> substring({padded}, i, {q}))"
    return F.expr(f"transform({plain}, (g, i) -> concat(g, '#', size(filter(slice({plain}, 1, i), h -> h = g))))")


def similar_pairs(a: DataFrame, b: DataFrame, left: str, right: str, limit: float) -> DataFrame:
    """Pairs of names (left, right) with ``ratio`` (see ``edit_ratio``) of ``limit`` or more; ``limit`` is over 0.5.

    Every name counts once; null and empty ones match nothing. A name of n letters lies within d = n (1 - limit) / limit edits of any partner,
    and an edit takes at most q of its q-grams, so of its q d + 1 rarest grams the partner has one among its own. Names meet by those,
    within the lengths that the limit leaves, and no others are compared.
    """
    if limit <= 0.5:
        raise ValueError("a limit over 0.5 is needed: below, names need not share a letter")
    q = 2 if limit > 2 / 3 else 1
    side = lambda df, c: df.select(F.col(c).alias("name")).filter("name IS NOT NULL AND name <> ''").distinct()
    names = side(a, left).withColumn("side", F.lit(0)).unionByName(side(b, right).withColumn("side", F.lit(1)))
    each = names.select("side", "name", F.explode(grams("name", q)).alias("gram"))
    rare = each.groupBy("gram").agg(F.count("*").alias("times"))
    order = Window.partitionBy("side", "name").orderBy("times", "gram")
    edits = F.floor(F.length("name") * ((1 - limit) / limit) + 1e-9)
    first = each.join(rare, "gram").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= q * edits + 1)
    x = first.filter("side = 0").select("gram", F.col("name").alias("_a"))
    y = first.filter("side = 1").select("gram", F.col("name").alias("_b"))
    near = x.join(y, "gram").filter(F.least(F.length("_a"), F.length("_b")) >= F.greatest(F.length("_a"), F.length("_b")) * limit - 1e-9)
    return near.select("_a", "_b").distinct().withColumn("ratio", edit_ratio("_a", "_b")).filter(F.col("ratio") >= limit - 1e-9).withColumnsRenamed({"_a": left, "_b": right})


def token_pairs(a: DataFrame, b: DataFrame, left: str, right: str, limit: float) -> DataFrame:
    """Pairs of names with jaccard and contained (one's words are all the other's) where either makes a score of ``limit``.

    A name meets others by its rarest words only, as many as a partner with that Jaccard similarity can't all lack.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    side = lambda df, c, name: df.select(F.col(c).alias(name)).filter(f"{name} IS NOT NULL").distinct().withColumn("words", words(name)).filter(F.size("words") > 0)
    x, y = side(a, left, "_a"), side(b, right, "_b")
    each = x.select(F.col("_a").alias("name"), F.lit(0).alias("side"), F.size("words").alias("n"), F.explode("words").alias("word")).unionByName(y.select(F.col("_b").alias("name"), F.lit(1).alias("side"), F.size("words").alias("n"), F.explode("words").alias("word")))
    rare = each.groupBy("word").agg(F.count("*").alias("times"))
    ranked = each.join(rare, "word").withColumn("place", F.row_number().over(Window.partitionBy("side", "name").orderBy("times", "word")))
    start = F.col("place") <= F.col("n") - F.ceil(F.col("n") * limit - 1e-9) + 1
    one = lambda side, name, only: ranked.filter((F.col("side") == side) & only).select("word", F.col("name").alias(name))
    any_word = F.lit(True)
    met = one(0, "_a", start).join(one(1, "_b", any_word), "word").select("_a", "_b").union(one(0, "_a", any_word).join(one(1, "_b", F.col("place") == 1), "word").select("_a", "_b")).distinct()
    both, either = F.size(F.array_intersect(words("_a"), words("_b"))), F.size(F.array_union(words("_a"), words("_b")))
    scored = met.withColumns({"jaccard": both / either, "contained": both == F.least(F.size(words("_a")), F.size(words("_b")))})
    return scored.filter((F.col("jaccard") >= limit - 1e-9) | F.col("contained")).withColumnsRenamed({"_a": left, "_b": right})


def best_names(names: DataFrame, pool: DataFrame, name: str, candidate: str, place: str, limit: float = 0.6) -> DataFrame:
    """name, candidate, score: the candidate with the highest score, ``limit`` at least; of equal ones that of the smallest ``place``.

    The score of two names (normalised ones, words apart by a space) is the largest of edit ratio, Jaccard similarity of words, and 0.9 where
    one's words are all the other's. Names without a candidate have no row.
    """
    by_edits = similar_pairs(names, pool, name, candidate, limit).select(name, candidate, F.col("ratio").alias("score"))
    by_words = token_pairs(names, pool, name, candidate, limit).select(name, candidate, F.greatest("jaccard", F.when(F.col("contained"), 0.9).otherwise(0.0)).alias("score"))
    scored = by_edits.unionByName(by_words).groupBy(name, candidate).agg(F.round(F.max("score"), 9).alias("score"))
    placed = scored.join(pool.groupBy(candidate).agg(F.min(place).alias("_place")), candidate)
    best = F.min(F.struct((-F.col("score")).alias("less"), F.col("_place"), F.col(candidate))).alias("b")
    return placed.groupBy(name).agg(best).select(name, F.col(f"b.{candidate}").alias(candidate), (-F.col("b.less")).alias("score"))


def uncertain_variants(names: DataFrame, canon: DataFrame, name: str, canonical: str, limit: float = 0.9) -> DataFrame:
    """name, canonical, similarity of other names that may be the same person's: edit ratio of keys of ``limit`` or more, or one name extends the other.

    Keys are the names' letters and digits in lower case. A name of one word is extended by one of two that begins with it, unless a
    word is a number or a relative's.
    """
    key = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]", "")
    x = names.select(name).distinct().withColumn("_ka", key(name))
    y = canon.select(canonical).distinct().withColumn("_kb", key(canonical))
    near = similar_pairs(x, y, "_ka", "_kb", limit).drop("ratio").join(x, "_ka").join(y, "_kb").select(name, canonical)
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    wx, wy = x.withColumn("_wa", words(name)), y.withColumn("_wb", words(canonical))
    plain = lambda c: ~F.exists(c, lambda w: w.rlike(r"^\d+$") | w.isin(RELATIVES))
    size = lambda df, c, n: df.filter((F.size(c) == n) & plain(F.col(c))).withColumn("_first", F.element_at(c, 1))
    longer = size(wx, "_wa", 1).join(size(wy, "_wb", 2), "_first").select(name, canonical)
    shorter = size(wx, "_wa", 2).join(size(wy, "_wb", 1), "_first").select(name, canonical)
    found = near.unionByName(longer).unionByName(shorter).distinct().filter(F.col(name) != F.col(canonical))
    return found.withColumns({"_ka": key(name), "_kb": key(canonical)}).withColumn("similarity", F.round(edit_ratio("_ka", "_kb"), 4)).drop("_ka", "_kb")


def repaired_to_roster(answers: DataFrame, roster: DataFrame, answer: str, member: str, limit: float = 0.8) -> DataFrame:
    """answer, repaired: an answer of the roster stays; another becomes the member of highest edit ratio, ``limit`` at least (ties: the smallest name), or stays."""
    asked, members = answers.select(answer).distinct(), roster.select(F.col(member).alias("_m")).distinct()
    off = asked.join(members.withColumn("_known", F.lit(True)), asked[answer] == F.col("_m"), "left").filter("_known IS NULL").select(answer)
    near = similar_pairs(off, members, answer, "_m", limit).withColumn("ratio", F.round("ratio", 9))
    best = near.groupBy(answer).agg(F.min(F.struct((-F.col("ratio")).alias("less"), F.col("_m"))).alias("b")).select(answer, F.col("b._m").alias("_to"))
    return asked.join(best, answer, "left").select(answer, F.coalesce("_to", answer).alias("repaired"))
