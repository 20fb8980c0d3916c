"""Counts, votes, rates, percentiles and paired tests over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tasks import lean
from .similarity import cut

# Recall bands, lower limit inclusive.
BANDS = [("<0.30", 0.0), ("0.30-0.60", 0.30), ("0.60-0.75", 0.60), ("0.75-0.90", 0.75), (">=0.90", 0.90)]


def band(x: Column) -> Column:
    """The label of the band that x is in."""
    out = F.when(x >= BANDS[-1][1], BANDS[-1][0])
    for label, low in reversed(BANDS[:-1]):
        out = out.when(x >= low, label)
    return out.when(x.isNotNull(), BANDS[0][0])


def word_counts(df: DataFrame, keys: list[str], text: str, pattern: str = r"[\p{L}\p{N}_]+") -> DataFrame:
    """Multiset of lower-case tokens: keys, token, n."""
    tokens = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), F.lit(0)))
    return df.select(*keys, tokens.alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("n"))


def multiset_recall(source: DataFrame, output: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the source's tokens that the output has too, counted with repeats; for keys that the source has.

    Both sides hold keys, token, n. Keys without source tokens aren't in the result: callers give them 1.0 (recall) or 0.0 (coverage).
    """
    both = source.alias("s").join(output.select(*keys, "token", F.col("n").alias("m")), [*keys, "token"], "left")
    return both.groupBy(*keys).agg((F.sum(F.least("n", F.coalesce("m", F.lit(0)))) / F.sum("n")).alias("recall"), F.sum("n").alias("n_source"))


def shared_words(rows: DataFrame, keys: list[str], source: str, output: str, pattern: str = r"[\p{L}\p{N}_]+") -> DataFrame:
    """keys, n_source, n_output, met: lower-case tokens of both texts, and those that they share, counted with repeats.

    Keys without a token are not in the result. Rows of equal keys count together: texts are shuffled rather than tokens, and a task counts
    one key's tokens at a time.
    """
    tokens = lambda c: F.regexp_extract_all(F.lower(F.col(c)), F.lit(pattern), F.lit(0)).alias(c)
    dealt = rows.select(*keys, F.col(source).alias("_a"), F.col(output).alias("_b")).repartition(*keys).sortWithinPartitions(*keys).select(*keys, tokens("_a"), tokens("_b"))
    measures = ["n_source", "n_output", "met"]

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        now, held, kinds, done = None, None, [], []

        def counted():
            x, y = held
            if x or y:
                done.append((*now, x.total(), y.total(), (x & y).total()))

        def made():
            columns = list(zip(*done)) or [()] * (len(keys) + len(measures))
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [*kinds, *[pa.int64()] * len(measures)])], names=[*keys, *measures])

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            for *key, a, b in zip(*(batch.column(k).to_pylist() for k in keys), batch.column("_a"), batch.column("_b")):
                if key != now:
                    if held:
                        counted()
                    now, held = key, (Counter(), Counter())
                for value, side in zip((a, b), held):
                    side.update(value.as_py() or [])
            yield made()
            done.clear()
        if held:
            counted()
            yield made()

    schema = T.StructType([*(rows.schema[k] for k in keys), *(T.StructField(c, T.LongType()) for c in measures)])
    return dealt.mapInArrow(lean(run), schema)


def majority_vote(votes: DataFrame, keys: list[str], vote: str, pos: str) -> DataFrame:
    """The most frequent vote; of equally frequent ones the first cast. Null votes abstain; confidence is the share of votes cast."""
    counts = votes.filter(F.col(vote).isNotNull()).groupBy(*keys, vote).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    best = F.max_by(F.struct(F.col(vote), "n"), F.struct("n", (-F.col("first")).alias("at"))).alias("best")
    total = counts.groupBy(*keys).agg(best, F.sum("n").alias("cast"))
    return total.select(*keys, F.col(f"best.{vote}").alias("winner"), F.col("best.n").alias("votes"), (F.col("best.n") / F.col("cast")).alias("confidence"))


def zero_filled(counts: DataFrame, labels: list[str], key: str, n: str) -> DataFrame:
    """A row for every label, 0 where ``counts`` has none."""
    bins = counts.sparkSession.createDataFrame([(x,) for x in labels], f"{key} string")
    return bins.join(counts, key, "left").select(key, F.coalesce(n, F.lit(0)).cast("long").alias(n))


def binomial_tail(b: Column, c: Column) -> Column:
    """Two-sided exact McNemar p for b and c discordant pairs; 1 where there are none. One fold carries the logarithm of the term and the sum."""
    n, k = (b + c).cast("int"), F.least(b, c).cast("int")
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.lit(0.0).alias("total"))
    # after term i comes term i + 1: times (n - i) / (i + 1)
    step = lambda s, i: F.struct((s["term"] + F.coalesce(F.log((n - i) / (i + 1)), F.lit(0.0))).alias("term"), (s["total"] + F.exp(s["term"])).alias("total"))
    tail = F.aggregate(F.sequence(F.lit(0), k), start, step)["total"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def paired_counts(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Discordant counts of two boolean columns of the same rows: fixed (b only), broke (a only)."""
    x, y = F.col(a), F.col(b)
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~x & y).alias("fixed"), F.count_if(x & ~y).alias("broke"))


def percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys, and p10 for 0.1 and so on: exact percentiles, linear between two ranks; null where a key has no values.

    Values are counted, their counts dealt out by ranges of keys and values and added up within a range, after the sums of the ranges before: no
    task gets a key's values whole.
    """
    counts = df.groupBy(F.struct(*keys).alias("_k"), F.col(value).alias("_v")).agg(F.count(value).alias("_n"))
    n_tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(counts.repartitionByRange(n_tasks, "_k", "_v").withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_k")
    sums = ranged.groupBy("_k", "_p").agg(F.sum("_n").alias("_s")).withColumn("_total", F.sum("_s").over(w)).withColumn("_before", F.sum("_s").over(w.orderBy("_p")) - F.col("_s"))
    rows = ranged.join(F.broadcast(sums), ["_k", "_p"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy("_k", "_p").orderBy("_v")))
    at = {f"p{round(100 * p)}": (F.col("_total") - 1) * F.lit(float(p)) for p in shares}
    ends = [F.min(F.when(F.col("_upto") > f(x), F.col("_v"))).alias(f"{name}_{side}") for name, x in at.items() for side, f in (("low", F.floor), ("high", F.ceil))]
    found = rows.groupBy("_k").agg(F.max("_total").alias("_total"), *ends)
    between = lambda name, x: F.when(F.col(f"{name}_low") == F.col(f"{name}_high"), F.col(f"{name}_low")).otherwise((F.ceil(x) - x) * F.col(f"{name}_low") + (x - F.floor(x)) * F.col(f"{name}_high"))
    return found.select("_k.*", *(between(name, x).alias(name) for name, x in at.items()))


def dealt(df: DataFrame, *keys: str, rows: int = 1 << 20) -> DataFrame:
    """The rows dealt out by keys over as many tasks as shuffles have, or more: about ``rows`` a task at most, however well they compress."""
    n_tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n_tasks, -(-df.count() // rows)), *keys)


def average_rank(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Rank within keys, equal values sharing their average rank."""
    w = Window.partitionBy(*keys)
    return df.withColumn(name, F.rank().over(w.orderBy(column)) + (F.count("*").over(Window.partitionBy(*keys, column)) - 1) / 2)


def quartile_means(df: DataFrame, keys: list[str], by: str, value: str, tie: str, least: int = 8) -> DataFrame:
    """Means of ``value`` in four equal runs ordered by ``by``; rows beyond four equal runs are left out; groups under ``least`` rows too."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("rn", F.row_number().over(w.orderBy(by, tie)) - 1).withColumn("n", F.count("*").over(w))
    rows = rows.filter(F.col("n") >= least).withColumn("quartile", F.expr("rn div (n div 4)")).filter("quartile < 4")
    return rows.groupBy(*keys, F.col("quartile").cast("int").alias("quartile")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def f_ratio(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way ANOVA F over groups with two values or more, from group sums alone: one pass over the rows."""
    g = df.filter(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("ss")).filter("n >= 2")
    total = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum("ss").alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("squares"))
    between = F.col("squares") - F.col("n") * F.col("grand") * F.col("grand")
    return total.select((between / (F.col("k") - 1) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f"), F.col("k").alias("n_groups"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, from the contingency table."""
    two = lambda n: n * (n - 1) / 2
    cell = df.groupBy(a, b).agg(F.count("*").alias("n"))
    index = cell.agg(F.sum(two(F.col("n"))).alias("both"), F.sum("n").alias("n"))
    rows = cell.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("x"))
    columns = cell.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("y"))
    expected = F.col("x") * F.col("y") / two(F.col("n"))
    return index.join(rows).join(columns).select(((F.col("both") - expected) / ((F.col("x") + F.col("y")) / 2 - expected)).alias("ari"))


def risk_coverage(df: DataFrame, confidence: str, correct: str, keys: list[str]) -> DataFrame:
    """Coverage and accuracy of answering wherever confidence is at least each value that occurs; one row a value.

    Counts by value come first, so the running sums are over distinct confidences, not rows.
    """
    by = df.groupBy(*keys, confidence).agg(F.count("*").alias("n"), F.count_if(F.col(correct)).alias("right"))
    w = Window.partitionBy(*keys).orderBy(F.col(confidence).desc())
    total = Window.partitionBy(*keys)
    answered = F.sum("n").over(w)
    return by.select(*keys, confidence, answered.alias("answered"), (answered / F.sum("n").over(total)).alias("coverage"), (F.sum("right").over(w) / answered).alias("accuracy"))
