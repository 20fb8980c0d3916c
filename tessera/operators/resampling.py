"""Bootstrap intervals from counts: rows are read once, and draws weigh bins instead of copying rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINENESS = 1024  # bins by which a value doubles


def binned(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, bin, n, mean: values by their logarithm, so a bin is 0.07 % wide; bins are in order of the values. Nulls and NaN are left out."""
    v = F.col(value).cast("double")
    size = F.floor(F.log2(F.abs(v)) * FINENESS).cast("long") + (1 << 21)
    place = F.when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("long") * size)
    return rows.filter(v.isNotNull() & ~F.isnan(v)).withColumn("bin", place).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(v).alias("mean"))


def medians(mean: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted median of each column of ``weight``; the mean of the two middle ones where the weights' sum is even; NaN without weight."""
    upto = np.cumsum(weight, 0)
    total = upto[-1]
    pick = lambda k: mean[np.minimum((upto <= k).sum(0), len(mean) - 1)]
    return np.where(total > 0, (pick((total - 1) // 2) + pick(total // 2)) / 2, np.nan)


def median_ratio(rows: DataFrame, keys: list[str], arm: str, value: str, over: str, under: str, draws: int = 10_000, block: int = 250, seed: int = 42, share: float = 0.95) -> DataFrame:
    """keys, ratio of the medians of ``value`` of the arms ``over`` and ``under``, and low and high of its bootstrap interval.

    In a draw a row has a Poisson(1) weight, so a bin of n rows has a Poisson(n) weight: that is what is drawn, seeded by the block of
    draws, and no row is copied. Blocks of draws go to tasks with the histogram, whose bins are as many as the values' range asks for
    (1,024 for a factor of two), whatever the number of rows. Groups without one of the arms have no row.
    """
    counted = binned(rows.filter(F.col(arm).isin(over, under)), [*keys, arm], value)
    blocks = -(-draws // block)
    each = counted.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind = rows.select(*keys).schema

    def one(group, pdf):
        import pandas as pd

        pdf = pdf.sort_values([arm, "bin"])
        a, b = pdf[pdf[arm] == over], pdf[pdf[arm] == under]
        head = {k: pdf[k].iloc[0] for k in keys}
        if a.empty or b.empty:
            return pd.DataFrame({**{k: [] for k in keys}, "drawn": [], "point": []})
        number = int(pdf["block"].iloc[0])
        rng = np.random.Generator(np.random.Philox(key=[seed, number]))
        found = []
        for lo in range(0, min(block, draws - number * block), 50):  # some draws at a time bound the weights held
            m = min(50, min(block, draws - number * block) - lo)
            found.append(medians(a["mean"].to_numpy(), rng.poisson(a["n"].to_numpy()[:, None], (len(a), m))) / medians(b["mean"].to_numpy(), rng.poisson(b["n"].to_numpy()[:, None], (len(b), m))))
        ratios = np.concatenate(found)
        point = medians(a["mean"].to_numpy(), a["n"].to_numpy()[:, None])[0] / medians(b["mean"].to_numpy(), b["n"].to_numpy()[:, None])[0]
        return pd.DataFrame({**{k: [v] * len(ratios) for k, v in head.items()}, "drawn": ratios, "point": point})

    drawn = each.groupBy(*keys, "block").applyInPandas(one, kind.add("drawn", "double").add("point", "double"))
    ranked = drawn.filter(~F.isnan("drawn")).groupBy(*keys).agg(F.sort_array(F.collect_list("drawn")).alias("r"), F.first("point").alias("ratio"))  # as many as draws
    at = lambda p: F.element_at("r", (F.floor(F.size("r") * p) + 1).cast("int"))
    return ranked.select(*keys, "ratio", at((1 - share) / 2).alias("low"), at(1 - (1 - share) / 2).alias("high"))
