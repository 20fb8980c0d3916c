"""Vectors, groups of equal or similar rows, and graphs of co-occurring names."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where a vector is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def first_of_equal(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each group of equal keys, by pre-aggregated minimum rather than a sort of each group."""
    return df.groupBy(key.alias("_k")).agg(F.min(F.struct(*order, F.struct(*[c for c in df.columns if c not in order]).alias("_rest"))).alias("_m"), F.count("*").alias("copies")).select(*[F.col(f"_m.{c}") for c in order], "_m._rest.*", "copies")


def group_similarity(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean cosine of all cross pairs of any two groups: the dot product of the groups' mean unit vectors, so no pair is formed.

    Each group's mean vector is a row of sums, pre-aggregated by component.
    """
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    unit = df.withColumn("_n", norm).filter("_n > 0").select(group, F.posexplode(vector).alias("i", "x"), "_n")
    mean = unit.groupBy(group, "i").agg(F.avg(F.col("x").cast("double") / F.col("_n")).alias("m"))
    a, b = mean.select(F.col(group).alias("a"), "i", F.col("m").alias("x")), mean.select(F.col(group).alias("b"), "i", F.col("m").alias("y"))
    return a.join(b, "i").filter("a <= b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("similarity"))


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the session names; one of our own only where none is named and the master is local (tests)."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()


def complete_link(similarities: DataFrame, threshold: float, must: list | None = None, cannot: list | None = None) -> DataFrame:
    """Complete-link clusters of labels from rows (a, b, similarity), a pair once: label, cluster (its smallest label).

    The pair of clusters whose least similarity is largest merges while that exceeds ``threshold``, ties to the smaller labels. Must-link
    pairs merge first, cannot-link pairs never. Clusters that are each other's best partner merge in one round, since no other merge
    can come between them; a round is a few joins over the pairs above the threshold, so nothing goes to one task.
    """
    spark = similarities.sparkSession
    kind = dict(similarities.dtypes)["a"]
    labels = similarities.select(F.col("a").alias("label")).unionByName(similarities.select(F.col("b").alias("label"))).distinct()
    first: dict = {}

    def root(x):
        while x in first:
            x = first[x]
        return x

    for a, b in must or []:
        x, y = sorted((root(a), root(b)))
        if x != y:
            first[y] = x
    named = spark.createDataFrame([(x, root(x)) for x in first], f"label {kind}, cluster {kind}")
    members = cut(labels.join(F.broadcast(named), "label", "left").select("label", F.coalesce("cluster", "label").alias("cluster")))
    pairs = similarities.filter((F.col("similarity") > threshold) & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity", F.lit(1).cast("long").alias("n"))
    if cannot:
        pairs = pairs.join(F.broadcast(spark.createDataFrame([tuple(sorted(x)) for x in cannot], f"a {kind}, b {kind}")), ["a", "b"], "left_anti")

    def between(pairs: DataFrame, members: DataFrame, moved: DataFrame) -> DataFrame:
        """Pairs of clusters all of whose cross pairs are there, by where their labels have ``moved`` (old, cluster)."""
        to = lambda c: moved.select(F.col("old").alias(c), F.col("cluster").alias(f"new_{c}"))
        now = pairs.join(to("a"), "a", "left").join(to("b"), "b", "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in ("a", "b")})
        now = now.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("similarity").alias("similarity"), F.sum("n").alias("n"))
        sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
        of = lambda c: sizes.select(F.col("cluster").alias(c), F.col("size").alias(f"size_{c}"))
        return now.join(of("a"), "a").join(of("b"), "b").filter("n = size_a * size_b").select("a", "b", "similarity", "n")

    pairs = cut(between(pairs, members, members.select(F.col("label").alias("old"), "cluster")))
    while True:
        sides = pairs.select(F.col("a").alias("x"), "a", "b", "similarity").unionByName(pairs.select(F.col("b").alias("x"), "a", "b", "similarity"))
        best = sides.groupBy("x").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "a", "b")).alias("best"))
        merged = best.groupBy("best.a", "best.b").agg(F.count("*").alias("n")).filter("n = 2").select(F.col("b").alias("old"), F.col("a").alias("cluster"))
        merged = cut(merged)
        if merged.isEmpty():
            return members
        moved = merged.withColumnRenamed("cluster", "to")
        members = cut(members.join(moved, members["cluster"] == moved["old"], "left").select("label", F.coalesce("to", "cluster").alias("cluster")))
        pairs = cut(between(pairs, members, merged))


def cooccurrence(df: DataFrame, keys: list[str], pos: str, name: str, window: int) -> DataFrame:
    """Unordered pairs of different names less than ``window`` rows apart, each once; rows look ahead, so no self-join is needed."""
    ahead = F.collect_set(name).over(Window.partitionBy(*keys).orderBy(pos).rowsBetween(1, window - 1))
    pairs = df.withColumn("_ahead", ahead).withColumn("_b", F.explode("_ahead")).filter(F.col(name) != F.col("_b"))
    return pairs.select(F.least(name, "_b").alias("a"), F.greatest(name, "_b").alias("b")).distinct()


def earth_movers(df: DataFrame, group: str, value: str) -> DataFrame:
    """Earth mover's distance between each pair of groups' samples: the area between their distribution functions."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    total = counts.groupBy(group).agg(F.sum("n").alias("t"))
    share = counts.join(total, group).select(group, value, (F.col("n") / F.col("t")).alias("p"))
    groups = total.select(group)
    pairs = groups.select(F.col(group).alias("a")).join(groups.select(F.col(group).alias("b"))).filter("a < b")
    plus = pairs.join(share, F.col("a") == F.col(group)).select("a", "b", value, "p")
    minus = pairs.join(share, F.col("b") == F.col(group)).select("a", "b", value, (-F.col("p")).alias("p"))
    step = plus.unionByName(minus).groupBy("a", "b", value).agg(F.sum("p").alias("p"))
    w = Window.partitionBy("a", "b").orderBy(value)
    area = F.abs(F.sum("p").over(w)) * (F.lead(value).over(w) - F.col(value))
    return step.withColumn("area", area).groupBy("a", "b").agg(F.sum("area").alias("distance"))
