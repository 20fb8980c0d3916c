"""Evidence for and against texts: replacements with counts, error rates, gates, exact intervals, label models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pairing import edit_counts, edits
from ..functions.tasks import lean
from ..functions.stats import beta_quantile, exact_interval, incomplete_beta

ASCII = "[A-Za-z0-9_]"


def with_case(x: Column, words: dict[str, str]) -> Column:
    """Replace whole words; a word with a capital gets its replacement with a capital."""
    for bad, good in words.items():
        for a, b in ((bad, good), (bad.capitalize(), good.capitalize())):
            x = F.regexp_replace(x, rf"(?<!{ASCII}){a}(?!{ASCII})", b)
    return x


def word_count(text: str, words: list[str]) -> Column:
    """How often any of the words stands in a text, whatever its case, between other characters than ASCII letters, digits and underscores."""
    return F.regexp_count(F.lower(text), F.lit(rf"(?<!{ASCII})({'|'.join(words)})(?!{ASCII})"))


def homoglyph_words(df: DataFrame, text: str, looks: str, means: str, most: float = 0.005) -> DataFrame:
    """Words of letters that look like others, every one of them known: their number and what they mean, space-separated.

    Only in texts where the foreign script is a rare exception (under ``most`` of the characters).
    """
    foreign = "[Ѐ-ӿ]"
    rare = F.regexp_count(text, F.lit(foreign)) < most * F.length(text)
    words = F.filter(F.regexp_extract_all(text, F.lit(r"[^\s]+"), F.lit(0)), lambda w: w.rlike(foreign) & ~F.translate(w, looks, means).rlike(foreign))
    plain = F.transform(F.when(rare, words).otherwise(F.array().cast("array<string>")), lambda w: F.translate(w, looks, means))
    return df.withColumn("_w", plain).withColumn("n_words", F.size("_w")).withColumn("words", F.array_join("_w", " ")).drop("_w")


def spoken_date(x: Column) -> Column:
    return F.concat(F.date_format(x, "MMMM"), F.lit(" "), F.dayofmonth(x), F.lit(", "), F.year(x))


def spoken_id(x: Column) -> Column:
    """Letters and digits of an identifier apart."""
    return F.regexp_replace(F.regexp_replace(x, "([A-Za-z])([0-9])", "$1 $2"), "([0-9])([A-Za-z])", "$1 $2")


def from_lexicon(words: Column, lexicon: dict[str, str]) -> tuple[Column, Column]:
    """(words with those of the lexicon replaced, each once; number of replacements)."""
    known = F.create_map(*[F.lit(x) for pair in lexicon.items() for x in pair])
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w)), F.size(F.filter(words, lambda w: F.try_element_at(known, w).isNotNull()))


def log_choose(n: Column, k: Column) -> Column:
    """log of n over k: the sum of log((n - j + 1) / j) for j up to min(k, n - k)."""
    least = F.least(k, n - k)
    return F.when(least <= 0, 0.0).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(least, F.lit(1))), F.lit(0.0), lambda s, j: s + F.log((n - j + 1) / j)))


def hidden(fields: Column, names: str) -> Column:
    """A map's values, [REDACTED] where the key matches ``names``."""
    return F.transform_values(fields, lambda k, v: F.when(k.rlike(names), "[REDACTED]").otherwise(v))


def flat(fields: Column) -> Column:
    """A map as text, keys in order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


def clopper_pearson(counts: DataFrame, k: str, n: str, alpha: float = 0.05) -> DataFrame:
    """Adds low and high of the exact interval; rows are counts already aggregated, and each distinct (k, n) is solved once."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [exact_interval(a, b, alpha) for a, b in zip(batch.column(k).to_pylist(), batch.column(n).to_pylist())]
            yield pa.record_batch([*batch.columns, pa.array([x for x, _ in found], pa.float64()), pa.array([y for _, y in found], pa.float64())], names=[*batch.schema.names, "low", "high"])

    kinds = counts.select(k, n).distinct()
    solved = kinds.mapInArrow(run, T.StructType([*kinds.schema, T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
    return counts.join(solved, [k, n])


def beta_shares(rows: DataFrame, a: str, b: str, x: str, share: float) -> DataFrame:
    """Adds below, the share of a beta(a, b) variable at or below x, and quantile, where ``share`` of it lies below; each (a, b, x) is solved once."""
    kinds = rows.select(a, b, x).distinct()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            each = list(zip(*(batch.column(c).to_pylist() for c in (a, b, x))))
            below, quantile = [incomplete_beta(*e) for e in each], [beta_quantile(share, e[0], e[1]) for e in each]
            yield pa.record_batch([*batch.columns, pa.array(below, pa.float64()), pa.array(quantile, pa.float64())], names=[*batch.schema.names, "below", "quantile"])

    solved = kinds.mapInArrow(run, T.StructType([*kinds.schema, T.StructField("below", T.DoubleType()), T.StructField("quantile", T.DoubleType())]))
    return rows.join(solved, [a, b, x])


def half_splits(rows: DataFrame, keys: list[str], ids: list[str], value: str, trials: int) -> DataFrame:
    """Ratios of the means of random halves, ``trials`` times: how many, the lowest, the highest, and those outside 0.8 to 1.25.

    A row's half in a trial is a bit of a digest of its id and the trial; sums are pre-aggregated for all trials at once.
    """
    every = rows.select(*keys, *ids, value, F.explode(F.array(*[F.lit(i) for i in range(trials)])).alias("trial"))
    half = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in (*ids, "trial")]).cast("binary")) < "8"
    means = every.groupBy(*keys, "trial").agg((F.avg(F.when(half, F.col(value))) / F.avg(F.when(~half, F.col(value)))).alias("ratio"))
    outside = ~F.col("ratio").between(0.8, 1.25)
    return means.groupBy(*keys).agg(F.count("ratio").alias("trials"), F.round(F.min("ratio") + 1e-9, 6).alias("lowest"), F.round(F.max("ratio") + 1e-9, 6).alias("highest"), F.count_if(outside).alias("outside"))


def label_model(votes: DataFrame, key: str, voters: list[str], rounds: int = 60) -> DataFrame:
    """Probability of label 1 by an accuracy-weighted vote, accuracies and probabilities fitted in turn; null votes abstain.

    The rounds run over distinct patterns of votes, three to the power of the voters at most, which the driver holds; rows get the
    probability of their pattern by a broadcast of the same size.
    """
    patterns = votes.groupBy(*voters).agg(F.count("*").alias("n")).collect()
    ballots = np.array([[np.nan if r[v] is None else float(r[v]) for v in voters] for r in patterns]).reshape(len(patterns), len(voters))
    n, p = np.array([r["n"] for r in patterns], float), fitted_patterns(ballots, np.array([r["n"] for r in patterns], float), rounds)
    schema = ", ".join(f"{v} int" for v in voters) + ", p double"
    known = votes.sparkSession.createDataFrame([(*[r[v] for v in voters], float(x)) for r, x in zip(patterns, p)], schema)
    renamed = known.select(*[F.col(v).alias(f"_{v}") for v in voters], "p")
    on = [F.col(v).eqNullSafe(F.col(f"_{v}")) for v in voters]
    return votes.join(F.broadcast(renamed), on).select(key, "p")


def fitted_patterns(ballots: np.ndarray, n: np.ndarray, rounds: int) -> np.ndarray:
    given = ~np.isnan(ballots)
    accuracy, p = np.full(ballots.shape[1], 0.7), np.full(len(ballots), 0.5)
    for _ in range(rounds):
        odds = np.log(accuracy / (1 - accuracy))
        p = 1 / (1 + np.exp(-np.where(given, np.where(ballots == 1, odds, -odds), 0).sum(1)))
        right = np.where(ballots == 1, p[:, None], 1 - p[:, None])
        cast = np.maximum((given * n[:, None]).sum(0), 1e-12)
        accuracy = np.clip((np.where(given, right, 0) * n[:, None]).sum(0) / cast, 0.05, 0.95)
    return p


def majority(a: Column, b: Column, least: int, share: float) -> Column:
    """a or b if it has ``share`` of at least ``least`` pieces of evidence; unknown with fewer, else mixed."""
    return F.when(a + b < least, "unknown").when(a >= share * (a + b), "a").when(b >= share * (a + b), "b").otherwise("mixed")


def word_errors(pairs: DataFrame, said: str, heard: str) -> DataFrame:
    """Adds n_words, substitutions, deletions, insertions, errors, rate (errors per word said), n_chars, char_errors and char_rate.

    Words are lower-case runs of letters, digits and apostrophes; characters are those of the words joined by spaces. Rates are null
    where nothing was said. Equal ends cost nothing and are cut off first; a null text has no words.
    """
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(r"[\p{L}\p{N}']+"), F.lit(0))
    rows, names = pairs.withColumn("_a", words(said)).withColumn("_b", words(heard)), pairs.columns
    added = ["n_words", "substitutions", "deletions", "insertions", "n_chars", "char_errors"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for a, b in zip(batch.column("_a").to_pylist(), batch.column("_b").to_pylist()):
                x, y = " ".join(a), " ".join(b)
                found.append((len(a), *trimmed(edit_counts, a, b), len(x), trimmed(edits, x, y)))
            columns = [pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 6
            yield pa.record_batch([*(batch.column(c) for c in names), *columns], names=[*names, *added])

    schema = T.StructType([*pairs.schema, *[T.StructField(c, T.LongType()) for c in added]])
    out = rows.mapInArrow(run, schema).withColumn("errors", F.col("substitutions") + F.col("deletions") + F.col("insertions"))
    out = out.withColumn("rate", F.when(F.col("n_words") > 0, F.round(F.col("errors") / F.col("n_words"), 6)))
    return out.withColumn("char_rate", F.when(F.col("n_chars") > 0, F.round(F.col("char_errors") / F.col("n_chars"), 6)))


def trimmed(count, a, b):
    """``count`` of what is left between equal ends."""
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return count(a[head:], b[head:])


def word_error_gate(rows: DataFrame, share: float = 0.2) -> DataFrame:
    """Adds limit (errors allowed: one for short texts, else a share of the words) and passed."""
    limit = F.when(F.col("n_words") <= 5, F.lit(1)).otherwise(F.ceil(F.col("n_words") * share)).cast("long")
    return rows.withColumn("limit", limit).withColumn("passed", F.col("errors") <= F.col("limit"))


def chunk_gate(rows: DataFrame, keys: list[str], source: str, output: str, least: float = 0.9) -> DataFrame:
    """Multiset recall of words and of trigrams, ratio of lengths, and the defects among them; 1.0 where the source has none.

    Rows of equal keys are counted together: their texts are shuffled, and a task counts one key's grams at a time.
    """
    words = lambda c: F.filter(F.split(F.lower(c), " "), lambda x: x != "")
    known = rows.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    sorted_rows = known.select(*keys, F.col(source).alias("_a"), F.col(output).alias("_b")).repartition(*keys).sortWithinPartitions(*keys).select(*keys, words("_a").alias("_a"), words("_b").alias("_b"))
    measures = ["met0", "a0", "b0", "met1", "a1"]

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        now, held, done = None, None, []
        kinds: list = []

        def counted():
            (x, u), (y, v) = held
            return (*now, (x & y).total(), x.total(), y.total(), (u & v).total(), u.total())

        def made():
            columns = list(zip(*done)) or [()] * (len(keys) + len(measures))
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [*kinds, *[pa.int64()] * len(measures)])], names=[*keys, *measures])

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            for *key, a, b in zip(*(batch.column(k).to_pylist() for k in keys), batch.column("_a"), batch.column("_b")):
                if key != now:
                    if held:
                        done.append(counted())
                    now, held = key, [(Counter(), Counter()), (Counter(), Counter())]
                for value, (one, three) in zip((a, b), held):
                    w = value.as_py() or []
                    one.update(w)
                    three.update(zip(w, w[1:], w[2:]))
            yield made()
            done = []
        if held:
            done.append(counted())
            yield made()

    schema = T.StructType([*(known.schema[k] for k in keys), *(T.StructField(c, T.LongType()) for c in measures)])
    ratio = lambda x, y: F.coalesce(F.col(x) / F.when(F.col(y) > 0, F.col(y)), F.lit(1.0))
    found = sorted_rows.mapInArrow(lean(run), schema).select(*keys, ratio("met0", "a0").alias("recall"), ratio("met1", "a1").alias("trigrams"), ratio("b0", "a0").alias("ratio"))
    defect = lambda name, bad: F.when(bad, name)
    full = rows.select(*keys).join(found, keys, "left").withColumns({c: F.coalesce(c, F.lit(1.0)) for c in ("recall", "trigrams", "ratio")})
    defects = F.concat_ws(",", defect("recall", F.col("recall") < least), defect("trigrams", F.col("trigrams") < least), defect("ratio", ~F.col("ratio").between(0.9, 1.1)))
    return full.withColumn("defects", defects).withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("recall", "trigrams", "ratio")})
