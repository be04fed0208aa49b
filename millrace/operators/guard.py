"""Metric-stream guard in batch form: rolling-median spikes and their streaks.

Runs are independent: every window is partitioned by run, so runs spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WINDOW, LOSS_FACTOR, GRAD_FACTOR, STREAK = 20, 5.0, 10.0, 3


def rolling_medians(events: DataFrame, run: str, order: list[str], values: list[str], window: int = WINDOW) -> DataFrame:
    """Adds median_<value>: the median of the preceding window values, null until it is full."""
    w = Window.partitionBy(run).orderBy(*order).rowsBetween(-window, -1)
    out = events
    for v in values:
        out = out.withColumn(f"median_{v}", F.when(F.count(v).over(w) == window, F.percentile(v, F.lit(0.5)).over(w)))
    return out


def spike_streaks(events: DataFrame, run: str, order: list[str], value: str, factor: float, window: int = WINDOW, streak: int = STREAK) -> DataFrame:
    """Adds hit, streak (hits in a row so far) and trips (the streak is long enough)."""
    rolled = rolling_medians(events, run, order, [value], window)
    hit = F.coalesce(F.col(value) > factor * F.col(f"median_{value}"), F.lit(False))
    running = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rolled = rolled.withColumn("hit", hit).withColumn("island", F.sum((~F.col("hit")).cast("bigint")).over(running))
    within = Window.partitionBy(run, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rolled.withColumn("streak", F.sum(F.col("hit").cast("bigint")).over(within)).withColumn("trips", F.col("streak") >= streak).drop("island")


def guard(events: DataFrame, run: str = "run", order: str = "optimizer_step", window: int = WINDOW, streak: int = STREAK) -> DataFrame:
    """run, step, reason of the first trip per run; loss is reported before gradient norm."""
    train = events.where(F.col("event") == "train")
    loss = spike_streaks(train, run, [order], "mean_loss", LOSS_FACTOR, window, streak).where("trips").select(run, order, F.lit(0).alias("p"), F.lit("loss_spike").alias("reason"))
    grad = spike_streaks(train, run, [order], "grad_norm", GRAD_FACTOR, window, streak).where("trips").select(run, order, F.lit(1).alias("p"), F.lit("grad_norm_spike").alias("reason"))
    return loss.unionByName(grad).groupBy(run).agg(F.min(F.struct(order, "p", "reason")).alias("first")).select(run, f"first.{order}", "first.reason")
