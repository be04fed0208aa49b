"""Paired evaluation: positional and keyed joins of two runs, deltas, outcomes, review samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: fields of a run's manifest that two compared runs must share.
FROZEN_FIELDS = ("contract_sha256", "contract_version", "lighteval_commit", "math_verify", "suite", "tasks", "use_chat_template", "model_args")
INVARIANTS = ("example", "instruction", "full_prompt", "num_effective_few_shots", "num_asked_few_shots", "input_tokens", "gold", "choices", "gold_index")
OUTCOMES = ("improved", "regressed", "both_wrong", "both_correct")


class PairingError(ValueError):
    """Two runs do not pair up."""


def positional_pairs(baseline: DataFrame, trained: DataFrame, keys: tuple[str, ...] = ("task", "row_index")) -> DataFrame:
    """Both rows side by side as structs b and t; one null struct where a run lacks the row."""
    b = baseline.select(*keys, F.struct(*[c for c in baseline.columns if c not in keys]).alias("b"))
    t = trained.select(*keys, F.struct(*[c for c in trained.columns if c not in keys]).alias("t"))
    return b.join(t, list(keys), "full_outer")


def checked_pairs(pairs: DataFrame, invariants: tuple[str, ...] = INVARIANTS) -> DataFrame:
    """Pairs whose counts, invariant fields and metric names agree; raises otherwise.

    One aggregate over all pairs finds the violations before anything is returned.
    """
    sorted_keys = lambda s: F.sort_array(F.map_keys(F.col(f"{s}.metrics")))
    bad = {"missing_row": F.col("b").isNull() | F.col("t").isNull()}
    bad |= {f: ~F.col(f"b.{f}").eqNullSafe(F.col(f"t.{f}")) for f in invariants}
    bad["metrics"] = ~sorted_keys("b").eqNullSafe(sorted_keys("t"))
    counts = pairs.agg(*[F.count_if(c).alias(n) for n, c in bad.items()]).first().asDict()
    wrong = sorted(n for n, c in counts.items() if c)
    if wrong:
        raise PairingError(f"paired runs differ in: {', '.join(wrong)}")
    return pairs


def metric_rows(pairs: DataFrame, keys: tuple[str, ...] = ("task", "row_index")) -> DataFrame:
    """One row per pair and metric: keys, metric, baseline, trained, delta."""
    out = pairs.select(*keys, "t.metrics", F.explode("b.metrics").alias("metric", "baseline"))
    out = out.withColumn("trained", F.try_element_at("metrics", "metric")).drop("metrics")
    return out.withColumn("delta", F.col("trained") - F.col("baseline"))


def direction(delta: Column, lower_is_better: bool = False) -> Column:
    better, worse = (delta < 0, delta > 0) if lower_is_better else (delta > 0, delta < 0)
    return F.when(better, "improved").when(worse, "regressed").otherwise("unchanged")


def metric_summary(rows: DataFrame, by: tuple[str, ...] = ("task", "metric")) -> DataFrame:
    d = F.col("delta")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.avg("baseline"), 6).alias("baseline_mean"), F.round(F.avg("trained"), 6).alias("trained_mean"), F.round(F.avg("trained") - F.avg("baseline"), 6).alias("delta"),
        F.count_if(d > 0).alias("improved"), F.count_if(d < 0).alias("regressed"), F.count_if(d == 0).alias("unchanged"),
    )


def changed_rows(pairs: DataFrame, prediction: str = "predictions") -> DataFrame:
    """Pairs whose prediction differs or that moved in any metric."""
    deltas = F.map_zip_with("b.metrics", "t.metrics", lambda k, x, y: y - x)
    moved = F.exists(F.map_values(deltas), lambda d: d != 0)
    return pairs.where(~F.col(f"b.{prediction}").eqNullSafe(F.col(f"t.{prediction}")) | moved).withColumn("deltas", deltas)


def outcome(baseline: Column, trained: Column) -> Column:
    """Outcome of binary scores; other values raise."""
    known = F.when((baseline == 0) & (trained == 1), "improved").when((baseline == 1) & (trained == 0), "regressed").when((baseline == 0) & (trained == 0), "both_wrong").when((baseline == 1) & (trained == 1), "both_correct")
    return F.coalesce(known, F.raise_error(F.concat(F.lit("scores must be 0 or 1: "), F.coalesce(baseline.cast("string"), F.lit("null")), F.lit(", "), F.coalesce(trained.cast("string"), F.lit("null")))).cast("string"))


def annotate(rows: DataFrame, baseline_text: str, trained_text: str, marker: str = "####") -> DataFrame:
    """Adds marker_transition, delta_chars, length_bucket to rows with an outcome."""
    has = lambda c: F.when(F.contains(F.col(c), F.lit(marker)), "present").otherwise("missing")
    delta = F.length(trained_text) - F.length(baseline_text)
    return rows.withColumns(
        {
            "marker_transition": F.concat(has(baseline_text), F.lit("_to_"), has(trained_text)),
            "delta_chars": delta,
            "length_bucket": F.when(delta <= -50, "shorter_by_50_or_more").when(delta >= 50, "longer_by_50_or_more").otherwise("within_50"),
        }
    )


def outcome_summary(rows: DataFrame, baseline_text: str, trained_text: str, marker: str = "####") -> DataFrame:
    """One row for each of the four outcomes; rates and medians are null for empty ones."""
    has = lambda c: F.contains(F.col(c), F.lit(marker)).cast("double")
    spark = rows.sparkSession
    labels = spark.createDataFrame([(o,) for o in OUTCOMES], "outcome string")
    agg = rows.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(has(baseline_text)), 6).alias("baseline_marker_rate"), F.round(F.avg(has(trained_text)), 6).alias("trained_marker_rate"),
        F.percentile(F.length(baseline_text), F.lit(0.5)).alias("baseline_median_chars"), F.percentile(F.length(trained_text), F.lit(0.5)).alias("trained_median_chars"),
        F.percentile(F.length(trained_text) - F.length(baseline_text), F.lit(0.5)).alias("median_delta_chars"),
    )
    return labels.join(agg, "outcome", "left").fillna(0, ["n"])


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """side, key: keys that only one relation has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(F.lit("missing").alias("side"), key).unionByName(b.join(a, key, "left_anti").select(F.lit("extra").alias("side"), key))


def reconstruct_pairs(trained: DataFrame, changed: DataFrame, key: str, column: str) -> DataFrame:
    """Baseline value of every trained row: the changed row's, or else the trained one itself."""
    c = changed.select(key, F.col(column).alias("_baseline"), F.lit(True).alias("_changed"))
    out = trained.join(c, key, "left")
    return out.select(
        *trained.columns, F.when(F.col("_changed"), F.col("_baseline")).otherwise(F.col(column)).alias(f"baseline_{column}"), F.when(F.col("_changed"), "changed").otherwise("identical").alias("pair_source")
    )


def manifest_mismatches(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field: frozen fields that differ between two manifests, and suites of one side only."""
    b, t = left.select(key, F.struct(*fields).alias("b")), right.select(key, F.struct(*fields).alias("t"))
    joined = b.join(t, key, "full_outer")
    wrong = [F.when(F.col("b").isNotNull() & F.col("t").isNotNull() & ~F.col(f"b.{f}").eqNullSafe(F.col(f"t.{f}")), F.lit(f)) for f in fields]
    return joined.select(key, F.explode(F.array_compact(F.array(F.when(F.col("b").isNull() | F.col("t").isNull(), F.lit("missing")), *wrong))).alias("field"))


def stratified_sample(rows: DataFrame, group: str, strata: list[str], quota: int, order_key: Column, tie: str) -> DataFrame:
    """Coverage first: the best row of every stratum of a group, then the group's best rows up to the quota.

    If a group has more strata than the quota, all strata stay covered and the quota is exceeded,
    as the strata are taken first.
    """
    keyed = rows.withColumn("priority", order_key)
    record = F.struct("priority", tie, F.struct(*rows.columns).alias("row"))
    # One row per stratum by an aggregate, and the quota's first rows per group behind a group
    # limit in every task; only these few rows meet in the final ranking.
    covers = keyed.groupBy(group, *strata).agg(F.min_by(record, F.struct("priority", tie)).alias("r")).select("r.*", F.lit(True).alias("covers"))
    best = F.row_number().over(Window.partitionBy(group).orderBy("priority", tie))
    first = keyed.withColumn("_n", best).where(F.col("_n") <= quota).select("priority", F.col(tie), F.struct(*rows.columns).alias("row"), F.lit(False).alias("covers"))
    few = covers.unionByName(first).groupBy("priority", tie).agg(F.first("row").alias("row"), F.bool_or("covers").alias("covers")).select("row.*", "priority", "covers")
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col("covers").desc(), "priority", tie))
    return few.withColumn("place", place).where((F.col("place") <= quota) | F.col("covers"))


def stratum_counts(rows: DataFrame, strata: list[str]) -> DataFrame:
    return rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))


def prediction_text(predictions: Column) -> Column:
    """The only element of a prediction list; any other size raises."""
    return F.when(F.size(predictions) == 1, F.get(predictions, F.lit(0))).otherwise(F.raise_error("a prediction must be a list of one string").cast("string"))


def generated_length(nested: Column) -> Column:
    """Length of the only non-empty token list of a nested list; several or none raise."""
    leaves = F.filter(nested, lambda x: F.size(x) > 0)
    return F.when(F.size(leaves) == 1, F.size(F.get(leaves, F.lit(0)))).otherwise(F.raise_error("exactly one token list is expected").cast("int"))


def leaf_lengths(rows: DataFrame, nested: str, *keep: str) -> DataFrame:
    """One row per non-empty token list of a nested list."""
    return rows.select(*keep, F.explode(nested).alias("_leaf")).select(*keep, F.size("_leaf").alias("length")).where("length > 0")


def trained_details(rows: DataFrame, length: str, cap: int, correct: str, marker: str, truncated: str, padded: str, *by: str) -> DataFrame:
    """Generated lengths, cap hits, their agreement with missing markers, and truncation or padding."""
    n, hit = F.col(length), F.col(length) >= cap
    some = lambda c: F.exists(F.coalesce(F.col(c), F.array().cast("array<boolean>")), lambda x: F.coalesce(x, F.lit(False)))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.min(n).alias("min"), F.round(F.avg(n), 6).alias("mean"), F.percentile(length, F.lit(0.5)).alias("median"), F.max(n).alias("max"), F.count_if(hit).alias("cap_hits"),
        F.count_if(hit & ~F.col(correct)).alias("cap_hits_wrong"), F.count_if(~F.col(marker)).alias("missing_marker"), F.bool_and(hit == ~F.col(marker)).alias("cap_hit_is_missing_marker"),
        F.count_if(some(truncated)).alias("any_truncated"), F.count_if(some(padded)).alias("any_padded"),
    )


def outcome_details(rows: DataFrame, outcome: str, length: str, cap: int, *by: str) -> DataFrame:
    """outcome, rows, cap_hits: how often each paired outcome ran into the cap."""
    return rows.groupBy(*by, outcome).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(length) >= cap).alias("cap_hits"))


def masked_loss(rows: DataFrame, logprobs: str, labels: str, *by: str) -> DataFrame:
    """Loss sum, counted tokens and mean over shifted labels that are not ignored.

    logprobs[i] is the log probability of labels[i + 1]; a group without a counted token raises.
    """
    pairs = F.arrays_zip(F.col(logprobs).alias("lp"), F.slice(labels, 2, F.greatest(F.size(labels), F.lit(1))).alias("y"))
    kept = F.filter(pairs, lambda p: p["y"].isNotNull() & (p["y"] != -100))
    each = rows.select(*by, F.aggregate(kept, F.lit(0.0), lambda a, p: a - p["lp"]).alias("_s"), F.size(kept).alias("_n"))
    agg = each.groupBy(*by).agg(F.sum("_s").alias("loss_sum"), F.sum("_n").alias("valid_tokens"))
    return agg.withColumn("mean_loss", F.when(F.col("valid_tokens") > 0, F.col("loss_sum") / F.col("valid_tokens")).otherwise(F.raise_error("no supervised token").cast("double")))
