"""Distributions, percentiles, significance and resampling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distribution_columns(value: str, kind: str, prefix: str = "") -> list[Column]:
    """count, min, nearest-rank p50/p95/p99, max, mean of an integer column's non-null values."""
    disc = lambda p: F.expr(f"percentile_disc({p}) within group (order by {value})").cast(kind)
    columns = {"count": F.count(value), "min": F.min(value), "p50": disc(0.5), "p95": disc(0.95), "p99": disc(0.99), "max": F.max(value), "mean": F.round(F.avg(value), 6)}
    return [c.alias(prefix + n) for n, c in columns.items()]


def integer_distribution(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """The distribution of an integer column per group; nulls do not count."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(*distribution_columns(value, dict(rows.dtypes)[value]))


def percentiles(rows: DataFrame, value: str, points: list[float], *by: str, extremes: bool = False) -> DataFrame:
    """Linearly interpolated percentiles, one column p<percent> each, and min and max on request."""
    ends = [F.min(value).alias("min"), F.max(value).alias("max")] if extremes else []
    return rows.groupBy(*by).agg(*[F.round(F.percentile(value, F.lit(p)), 6).alias(f"p{round(p * 100):02d}") for p in points], *ends)


def truncation_sweep(lengths: DataFrame, value: str, caps: list[int]) -> DataFrame:
    """Per cap: how many lengths exceed it, the percentage, and the kept share of those."""
    one = lambda cap: (F.when(F.col(value) > cap, cap / F.col(value)))
    agg = lengths.where(F.col(value).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(value) > c).alias(f"t{c}") for c in caps],
        *[F.avg(one(c)).alias(f"k{c}") for c in caps],
    )
    stack = ", ".join(f"{c}L, t{c}, k{c}" for c in caps)
    return agg.select("n", F.expr(f"stack({len(caps)}, {stack}) as (cap, truncated, kept)")).select(
        "cap", "truncated", F.round(F.coalesce(F.try_divide(F.col("truncated") * 100.0, F.col("n")), F.lit(0.0)), 1).alias("percent"), F.round(F.coalesce("kept", F.lit(1.0)), 6).alias("kept_share")
    )


def mcnemar_p(improved: Column, regressed: Column) -> Column:
    """Exact two-sided p of the discordant pairs, in log space; 1 without discordant pairs."""
    n, k = improved + regressed, F.least(improved, regressed)
    # log C(n, i) as a running sum, so large counts neither overflow nor underflow
    walk = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), k.cast("bigint")),
        F.struct((-n.cast("double") * math.log(2)).alias("term"), F.lit(0.0).alias("total")),
        lambda s, i: F.struct((s["term"] + F.log((n - i).cast("double") / (i + 1))).alias("term"), (s["total"] + F.exp(s["term"])).alias("total")),
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * walk["total"]))


def token_weighted_mean(rows: DataFrame, loss: str, tokens: str, *by: str) -> DataFrame:
    """Mean over tokens next to the mean of record means."""
    return rows.groupBy(*by).agg(
        F.round(F.try_divide(F.sum(loss), F.sum(tokens)), 6).alias("weighted_mean"), F.round(F.avg(F.try_divide(F.col(loss), F.col(tokens))), 6).alias("mean_of_means"), F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("records")
    )


def bootstrap_counts(improved: int, regressed: int, unchanged: int, draws: int = 20_000, seed: int = 20260913) -> dict:
    """Percentile interval of the mean of +1/-1/0, resampled on the three counts.

    Resampling a vector of three values depends on the counts alone, hence the multinomial.
    """
    n = improved + regressed + unchanged
    if n <= 0:
        raise ValueError("bootstrap needs at least one pair")
    rng = np.random.Generator(np.random.PCG64(seed))
    draw = rng.multinomial(n, [improved / n, regressed / n, unchanged / n], size=draws)
    means = (draw[:, 0] - draw[:, 1]) / n
    low, high = np.quantile(means, [0.025, 0.975])
    return {"mean": (improved - regressed) / n, "low": float(low), "high": float(high), "draws": draws}


def bootstrap_deltas(improved: int, regressed: int, unchanged: int, draws: int = 20_000, seed: int = 20260913) -> dict:
    """bootstrap_counts() with the draws of the vector itself (improved, regressed, unchanged in this order), for parity.

    The vector is one value per pair; use it for the sizes of published evaluations.
    """
    values = np.repeat([1.0, -1.0, 0.0], [improved, regressed, unchanged])
    if not len(values):
        raise ValueError("bootstrap needs at least one pair")
    rng = np.random.default_rng(seed)
    means = np.concatenate([rng.choice(values, (min(1000, draws - at), len(values)), replace=True).mean(1) for at in range(0, draws, 1000)])
    low, high = np.quantile(means, [0.025, 0.975])
    return {"mean": float(values.mean()), "low": float(low), "high": float(high), "draws": draws}


def bootstrap_spread(rows: DataFrame, value: str, order: str, group: str, draws: int = 1000, seed: int = 1234, shards: int = 256) -> DataFrame:
    """group, mean, low, high: percentile interval of the mean per group, for groups of any size.

    Resampling n values of a group picks each a multinomial number of times. How many of the n
    picks fall on a shard of the group is itself multinomial in the shards' sizes, so these
    shares are drawn once per group (shards * draws numbers), and every shard draws its picks
    alone: the distribution is that of resampling the whole vector. A shard is a hash class of
    the order column; the result does not depend on partitioning. Per shard and draw one sum
    goes on.
    """
    kind = dict(rows.dtypes)[group]
    shard = F.pmod(F.xxhash64(order), F.lit(shards)).cast("int").alias("shard")
    placed = rows.select(group, shard, order, value).where(F.col(value).isNotNull())
    sizes = placed.groupBy(group, "shard").agg(F.count(F.lit(1)).alias("n"))
    of_group = sizes.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("sizes"))  # at most shards entries

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        name, s, sizes = pdf[group].iloc[0], int(pdf["shard"].iloc[0]), pdf["sizes"].iloc[0]
        n = np.array([x["n"] for x in sizes])
        picks = np.random.default_rng([seed, 0]).multinomial(n.sum(), n / n.sum(), size=draws)[:, [x["shard"] for x in sizes].index(s)]
        values = pdf.sort_values(order, kind="stable")[value].to_numpy(np.float64)
        rng = np.random.default_rng([seed, 1, s])
        ends = np.cumsum(picks)
        sums = np.zeros(draws)
        for at in range(0, draws, 50):  # a bounded number of picks at once
            part = picks[at : at + 50]
            taken = values[rng.integers(0, len(values), int(part.sum()))]
            sums[at : at + len(part)] = np.diff(np.concatenate([[0], np.cumsum(taken)])[np.concatenate([[0], ends[at : at + 50] - (ends[at - 1] if at else 0)])])
        return pd.DataFrame({group: name, "draw": np.arange(draws), "s": sums, "total": values.sum(), "n": len(values)})

    sums = placed.join(of_group, group).groupBy(group, "shard").applyInPandas(draw, f"{group} {kind}, draw int, s double, total double, n bigint")
    means = sums.groupBy(group, "draw").agg((F.sum("s") / F.sum("n")).alias("m"), (F.sum("total") / F.sum("n")).alias("mean"))
    return means.groupBy(group).agg(F.first("mean").alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def bootstrap_mean(rows: DataFrame, value: str, order: str, group: str, draws: int = 10_000, seed: int = 1234, block: int = 1000) -> DataFrame:
    """group, mean, low, high: percentile interval of the mean per group, with the published draws.

    Values are ordered by key first, so the result depends on neither partitioning nor order.
    A group is one evaluation run's records and is resampled in one task, since one generator
    draws for all of it; bootstrap_spread() is the form for large groups.
    """

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values(order, kind="stable")[value].to_numpy(np.float64)
        rng = np.random.default_rng(seed)
        parts = [values[rng.integers(0, len(values), size=(min(block, draws - at), len(values)))].mean(1) for at in range(0, draws, block)]
        low, high = np.quantile(np.concatenate(parts), [0.025, 0.975])
        return pd.DataFrame({group: [pdf[group].iloc[0]], "mean": [values.mean()], "low": [low], "high": [high]})

    kind = dict(rows.dtypes)[group]
    return rows.select(group, order, value).where(F.col(value).isNotNull()).groupBy(group).applyInPandas(resample, f"{group} {kind}, mean double, low double, high double")


def regression_verdict(delta: Column, low: Column, high: Column) -> Column:
    """regression: drop of at least 1 point, interval below 0; warning: drop of 2 points, interval spanning 0."""
    return F.when((delta <= -0.01) & (high < 0), "regression").when((delta <= -0.02) & (low <= 0) & (high >= 0), "warning").otherwise("pass")


def proportion_error(rows: DataFrame, flag: str, *by: str) -> DataFrame:
    """Rate with its standard error."""
    x = F.col(flag).cast("double")
    return rows.groupBy(*by).agg(F.count(x).alias("n"), F.round(F.avg(x), 6).alias("rate"), F.round(F.try_divide(F.stddev_samp(x), F.sqrt(F.count(x))), 6).alias("standard_error"))
