"""Budget, health and review gates: aggregates that become named checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BudgetLimits:
    min_samples: int = 200
    min_stop_rate: float = 0.90
    max_truncation_rate: float = 0.10
    safety: float = 1.25
    max_hours: float = 3.0
    price_per_hour: float = 9.0
    max_cost: float = 30.0


def generation_budget(rows: DataFrame, length: str, cap: int, seconds_per_token: float, planned: int, limits: BudgetLimits = BudgetLimits(), any_probe_size: bool = False) -> DataFrame:
    """One row: length distribution, projected hours and cost, five checks and passed.

    An empty probe, a length that is null or not positive, and a plan smaller than the probe
    raise when the row is read; limits that make no sense raise at once. With any_probe_size the
    probe may exceed the plan, for a log that keeps growing.
    """
    if cap <= 0 or seconds_per_token <= 0 or planned <= 0 or limits.min_samples <= 0 or min(limits.safety, limits.max_hours, limits.price_per_hour, limits.max_cost) <= 0:
        raise ValueError("caps, times, counts, prices and limits must be positive")
    if not (0 <= limits.min_stop_rate <= 1 and 0 <= limits.max_truncation_rate <= 1):
        raise ValueError("rates must lie in [0, 1]")
    n = F.col(length)
    pct = lambda p: F.percentile(length, F.lit(p))
    agg = rows.agg(
        F.count_if(n.isNull() | (n <= 0)).alias("wrong"), F.count(F.lit(1)).alias("samples"), F.min(n).alias("min"), F.avg(n).alias("mean"), pct(0.5).alias("p50"), pct(0.9).alias("p90"), pct(0.95).alias("p95"), F.max(n).alias("max"),
        F.try_divide(F.count_if(n >= cap), F.count(F.lit(1))).alias("truncation_rate"),
    )
    fails = F.when((F.col("samples") == 0) | (F.col("wrong") > 0), "generation lengths must be positive, in at least one row")
    if not any_probe_size:
        fails = fails.when(F.col("samples") > planned, "fewer generations are planned than probed")
    agg = agg.where(F.when(fails.isNotNull(), F.raise_error(fails).cast("boolean")).otherwise(True))
    hours = F.col("mean") * planned * seconds_per_token * limits.safety / 3600
    out = agg.withColumn("hours", hours).withColumn("cost", F.col("hours") * limits.price_per_hour)
    checks = {
        "enough_samples": F.col("samples") >= limits.min_samples,
        "stop_rate": 1 - F.col("truncation_rate") >= limits.min_stop_rate,
        "truncation_rate_ok": F.col("truncation_rate") <= limits.max_truncation_rate,
        "hours_ok": F.col("hours") <= limits.max_hours,
        "cost_ok": F.col("cost") <= limits.max_cost,
    }
    out = out.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in checks.items()})
    passed = F.lit(True)
    for name in checks:
        passed = passed & F.col(name)
    rounded = [F.round(c, 6).alias(c) for c in ("mean", "p50", "p90", "p95", "truncation_rate", "hours", "cost")]
    return out.select("samples", "min", "max", *rounded, *checks, passed.alias("passed"))


def generation_health(rows: DataFrame, tokens: str, eos: str, error: str, min_eos_rate: float, *by: str) -> DataFrame:
    """Runtime errors, empty generations and the end-of-sequence rate against a threshold."""
    if not 0 <= min_eos_rate <= 1:
        raise ValueError("min_eos_rate must lie in [0, 1]")
    agg = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col(error).isNotNull()).alias("runtime_errors"), F.count_if(F.coalesce(F.col(tokens), F.lit(0)) <= 0).alias("empty"),
        F.try_divide(F.count_if(F.col(eos).eqNullSafe(F.lit(True))), F.count(F.lit(1))).alias("eos_rate"),
    )
    passed = (F.col("runtime_errors") == 0) & (F.col("empty") == 0) & (F.coalesce(F.col("eos_rate"), F.lit(0.0)) >= min_eos_rate)
    return agg.select(*by, "records", "runtime_errors", "empty", F.round("eos_rate", 6).alias("eos_rate"), passed.alias("passed"))


def generation_labels(error: Column, parsed: Column, verified: Column, eos: Column, finish: Column) -> Column:
    """Outcome labels of a generation; several may hold."""
    yes = lambda c: c.eqNullSafe(F.lit(True))
    main = F.when(error.isNotNull(), "runtime_error").when(parsed.isNull(), "unparseable").when(yes(verified), "correct").otherwise("wrong_answer")
    done = error.isNull()
    return F.array_compact(F.array(main, F.when(done & ~yes(eos), "no_eos"), F.when(done & finish.eqNullSafe(F.lit("length")), "length_truncated")))


def stop_match(completion: Column, configured: list[int]) -> Column:
    """The first configured stop id that occurs anywhere in the completion, or null."""
    return F.get(F.filter(F.array(*map(F.lit, configured)), lambda s: F.array_contains(completion, s)), F.lit(0))


def verdict_status(decisions: DataFrame, total: str, verdict: str, *by: str) -> DataFrame:
    """incomplete while verdicts are missing, needs_resolution if any flags or disagrees, else passed."""
    allowed = ("keep", "flag", "agree", "disagree")
    counts = [F.count_if(F.col(verdict) == v).alias(v) for v in allowed]
    agg = decisions.groupBy(*by).agg(F.count(F.lit(1)).alias(total), F.count(verdict).alias("decided"), *counts)
    status = F.when(F.col("decided") < F.col(total), "incomplete").when(F.col("flag") + F.col("disagree") > 0, "needs_resolution").otherwise("passed")
    return agg.withColumn("status", status)


def allowed_verdict(status: Column, verdict: Column) -> Column:
    return F.coalesce(F.when(status == "accepted", verdict.isin("keep", "flag")).when(status == "rejected", verdict.isin("agree", "disagree")), F.lit(False))


def arg_extreme(rows: DataFrame, value: Column, order: str, longest: bool = True) -> DataFrame:
    """The record with the extreme value; among equals the one first in order."""
    key = F.struct(value.alias("v"), (-F.col(order)).alias("o")) if longest else F.struct((-value).alias("v"), (-F.col(order)).alias("o"))
    return rows.agg(F.max_by(F.struct(*rows.columns), key).alias("r")).where("r is not null").select("r.*")


def validated_extreme(rows: DataFrame, order: str, longest: bool = True, ids: str = "input_ids", labels: str = "labels", key: str = "sample_id", stored: str = "metadata.token_count") -> DataFrame:
    """The longest or shortest tokenized record, first in order among equals; a winner that is malformed raises.

    The length is the stored token count, or else the number of ids. The winner needs an id,
    labels as long as its ids, and a stored count that is right.
    """
    length = F.coalesce(F.col(stored), F.size(ids))
    best = arg_extreme(rows.where(length.isNotNull()), length, order, longest)
    size = F.size(ids)
    ok = F.coalesce(F.col(key).isNotNull() & (size > 0) & (size == F.size(labels)) & (F.col(stored).isNull() | (F.col(stored) == size)), F.lit(False))
    return best.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("invalid tokenized record: "), F.coalesce(F.col(key), F.lit("null")))).cast("boolean")))


def field_difference(left: dict, right: dict, fields: list[str]) -> list[str]:
    """Fields in which two manifests differ."""
    missing = object()
    return sorted(f for f in fields if left.get(f, missing) != right.get(f, missing))


def preflight(events: DataFrame) -> DataFrame:
    """One row: train steps are 1, 2; validations at 0, 1, 2; each once in the whole log; all metrics finite; passed.

    Metrics are mean_loss and, where the log has it, grad_norm; train rows must have them.
    """
    metrics = [F.col(c) for c in ("mean_loss", "grad_norm") if c in events.columns]
    optional = ~F.col("event").eqNullSafe(F.lit("train"))
    finite = F.lit(True)
    for m in metrics:
        finite = finite & F.coalesce(~F.isnan(m) & (F.abs(m) < float("inf")), optional)
    step, expected = F.col("optimizer_step"), {"train": (1, 2), "validation": (0, 1, 2)}
    of = {kind: F.col("event") == kind for kind in expected}
    out = events.agg(
        *[F.count_if(of[k]).alias(f"{k}_rows") for k in expected],
        *[F.count_if(of[k] & ~F.coalesce(step.isin(*steps), F.lit(False))).alias(f"{k}_unexpected") for k, steps in expected.items()],
        *[F.count_if(of[k] & (step == x)).alias(f"{k}_{x}") for k, steps in expected.items() for x in steps],
        F.bool_and(finite).alias("finite"),
    )
    ok = F.col("finite")
    for k, steps in expected.items():
        ok = ok & (F.col(f"{k}_unexpected") == 0)
        for x in steps:
            ok = ok & (F.col(f"{k}_{x}") == 1)
    return out.withColumn("passed", F.coalesce(ok, F.lit(False)))


def gate_report(checks: dict[str, tuple[bool, object]]) -> dict:
    """Named checks with their evidence; passed only if all passed."""
    listed = [{"name": n, "passed": bool(ok), "evidence": evidence} for n, (ok, evidence) in checks.items()]
    return {"checks": listed, "passed": all(c["passed"] for c in listed)}


def reproducible(first: dict, second: dict, fields: list[str], expected_rows: int | None = None) -> dict:
    """Two audit manifests must agree in the deterministic fields, over the full frozen scan."""
    wrong = field_difference(first, second, fields)
    full = expected_rows is None or first.get("rows") == expected_rows
    return gate_report({"same_manifest": (not wrong, wrong), "full_scan": (full, first.get("rows"))})
