"""Queries of paired evaluation, statistics and gates.

Generation records play two runs: even record ids are the baseline, odd ones the trained run,
paired by record_id div 2. events plays the metric log with user_id as the run.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import runtime
from millrace.operators import gates, guard, paired, sampling, stats
from millrace.plans.registry import query
from millrace.runtime import table

_G = "generation_health_2048_records"


def _runs(spark, d):
    g = table(spark, d, _G)
    metrics = F.create_map(F.lit("boxed"), F.coalesce(F.contains("output", F.lit("boxed")), F.lit(False)).cast("double"), F.lit("eos"), F.coalesce("generated_eos", F.lit(False)).cast("double"))
    rows = g.select(F.floor(F.col("record_id") / 2).alias("row_index"), (F.col("record_id") % 2).alias("side"), F.lit("health").alias("task"), metrics.alias("metrics"), F.col("output").alias("predictions"))
    return rows.where("side = 0").drop("side"), rows.where("side = 1").drop("side")


def _pairs(spark, d):
    return paired.positional_pairs(*_runs(spark, d)).where("b is not null and t is not null")


_RUNS = """
WITH rows AS (SELECT record_id // 2 AS row_index, record_id % 2 AS side, output, CAST(coalesce(contains(output, 'boxed'), false) AS DOUBLE) AS boxed, CAST(coalesce(generated_eos, false) AS DOUBLE) AS eos FROM generation_health_2048_records),
pairs AS (SELECT b.row_index, b.output AS bo, t.output AS o, b.boxed AS bb, t.boxed AS tb, b.eos AS be, t.eos AS te FROM (SELECT * FROM rows WHERE side = 0) b JOIN (SELECT * FROM rows WHERE side = 1) t USING (row_index)),
m AS (SELECT row_index, 'boxed' AS metric, bb AS b, tb AS t FROM pairs UNION ALL SELECT row_index, 'eos', be, te FROM pairs)
"""
_OUTCOME = "CASE WHEN bb = 0 AND tb = 1 THEN 'improved' WHEN bb = 1 AND tb = 0 THEN 'regressed' WHEN bb = 0 THEN 'both_wrong' ELSE 'both_correct' END"


@query(_RUNS + "SELECT 'health' AS task, metric, count(*) AS pairs, round(avg(b), 6) AS baseline_mean, round(avg(t), 6) AS trained_mean, round(avg(t) - avg(b), 6) AS delta, count(*) FILTER (t > b) AS improved, count(*) FILTER (t < b) AS regressed, count(*) FILTER (t = b) AS unchanged FROM m GROUP BY metric")
def paired_metrics(spark, d):
    return paired.metric_summary(paired.metric_rows(_pairs(spark, d)))


@query(_RUNS + "SELECT row_index, tb - bb AS delta_boxed, te - be AS delta_eos FROM pairs WHERE bo IS DISTINCT FROM o OR tb <> bb OR te <> be")
def paired_changed_rows(spark, d):
    out = paired.changed_rows(_pairs(spark, d))
    return out.select("row_index", F.col("deltas")["boxed"].alias("delta_boxed"), F.col("deltas")["eos"].alias("delta_eos"))


def _outcomes(spark, d):
    p = _pairs(spark, d)
    text = lambda s: F.coalesce(F.col(f"{s}.predictions"), F.lit(""))
    rows = p.select("row_index", paired.outcome(F.col("b.metrics")["boxed"], F.col("t.metrics")["boxed"]).alias("outcome"), text("b").alias("baseline_text"), text("t").alias("trained_text"))
    return paired.annotate(rows, "baseline_text", "trained_text", "boxed")


@query(_RUNS + f"SELECT {_OUTCOME} AS outcome, count(*) AS n FROM pairs GROUP BY 1")
def paired_outcomes(spark, d):
    return paired.stratum_counts(_outcomes(spark, d), ["outcome"])


_ANN = (
    _RUNS
    + f""", ann AS (SELECT row_index, {_OUTCOME} AS outcome, coalesce(bo, '') AS bo, coalesce(o, '') AS o,
    CASE WHEN bb = 1 THEN 'present' ELSE 'missing' END || '_to_' || CASE WHEN tb = 1 THEN 'present' ELSE 'missing' END AS marker_transition,
    length(coalesce(o, '')) - length(coalesce(bo, '')) AS delta_chars FROM pairs),
    ann2 AS (SELECT *, CASE WHEN delta_chars <= -50 THEN 'shorter_by_50_or_more' WHEN delta_chars >= 50 THEN 'longer_by_50_or_more' ELSE 'within_50' END AS length_bucket FROM ann)
"""
)


@query(
    _ANN
    + """SELECT o.outcome, coalesce(n, 0) AS n, bm AS baseline_marker_rate, tm AS trained_marker_rate, bc AS baseline_median_chars, tc AS trained_median_chars, dc AS median_delta_chars
    FROM (SELECT unnest(['improved', 'regressed', 'both_wrong', 'both_correct']) AS outcome) o LEFT JOIN (
    SELECT outcome, count(*) AS n, round(avg(CAST(contains(bo, 'boxed') AS DOUBLE)), 6) AS bm, round(avg(CAST(contains(o, 'boxed') AS DOUBLE)), 6) AS tm,
    quantile_cont(length(bo), 0.5) AS bc, quantile_cont(length(o), 0.5) AS tc, quantile_cont(delta_chars, 0.5) AS dc FROM ann2 GROUP BY outcome) a USING (outcome)"""
)
def paired_outcome_summary(spark, d):
    return paired.outcome_summary(_outcomes(spark, d), "baseline_text", "trained_text", "boxed")


@query(
    _ANN
    + """, keyed AS (SELECT *, sha256('20260913|' || CAST(row_index AS VARCHAR)) AS priority FROM ann2),
    c AS (SELECT *, row_number() OVER (PARTITION BY outcome, marker_transition, length_bucket ORDER BY priority, row_index) = 1 AS covers FROM keyed),
    p AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY covers DESC, priority, row_index) AS place FROM c)
    SELECT outcome, CAST(place AS INT) AS place, row_index, covers FROM p WHERE place <= 18 OR covers"""
)
def stratified_sample(spark, d):
    key = sampling.hash_priority(F.lit("20260913"), F.col("row_index").cast("string"))
    out = paired.stratified_sample(_outcomes(spark, d), "outcome", ["marker_transition", "length_bucket"], 18, key, "row_index")
    return out.select("outcome", "place", "row_index", "covers")


@query(_RUNS + ", c AS (SELECT count(*) FILTER (t > b) AS i, count(*) FILTER (t < b) AS r, metric FROM m GROUP BY metric) SELECT metric, i AS improved, r AS regressed, round(CASE WHEN i + r = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(i + r + 1) - lgamma(k + 1) - lgamma(i + r - k + 1) - (i + r) * ln(2))) FROM (SELECT unnest(generate_series(0, least(i, r))) AS k))) END, 6) AS p FROM c")
def mcnemar_p(spark, d):
    s = paired.metric_summary(paired.metric_rows(_pairs(spark, d)))
    return s.select("metric", "improved", "regressed", F.round(stats.mcnemar_p(F.col("improved"), F.col("regressed")), 6).alias("p"))


@query(_RUNS + ", s AS (SELECT metric, avg(t - b) AS delta, 1.96 * stddev_samp(t - b) / sqrt(count(*)) AS e FROM m GROUP BY metric) SELECT metric, round(delta, 6) AS delta, CASE WHEN delta <= -0.01 AND delta + e < 0 THEN 'regression' WHEN delta <= -0.02 AND delta - e <= 0 AND delta + e >= 0 THEN 'warning' ELSE 'pass' END AS verdict FROM s")
def regression_rule(spark, d):
    s = paired.metric_rows(_pairs(spark, d)).groupBy("metric").agg(F.avg("delta").alias("delta"), (1.96 * F.stddev_samp("delta") / F.sqrt(F.count(F.lit(1)))).alias("e"))
    return s.select("metric", F.round("delta", 6).alias("delta"), stats.regression_verdict(F.col("delta"), F.col("delta") - F.col("e"), F.col("delta") + F.col("e")).alias("verdict"))


@query()
def bootstrap_ci_counts(spark, d):
    s = paired.metric_summary(paired.metric_rows(_pairs(spark, d)))
    rows = [(r.metric, *stats.bootstrap_counts(r.improved, r.regressed, r.unchanged).values()) for r in s.toLocalIterator()]  # one row per metric
    return spark.createDataFrame(rows, "metric string, mean double, low double, high double, draws int")


@query()
def bootstrap_ci_vector(spark, d):
    return stats.bootstrap_mean(paired.metric_rows(_pairs(spark, d)), "delta", "row_index", "metric")


@query()
def bootstrap_ci_spread(spark, d):
    """The interval of bootstrap_ci_vector, drawn in shards, so that no group is one task."""
    return stats.bootstrap_spread(paired.metric_rows(_pairs(spark, d)), "delta", "row_index", "metric")


@query("WITH t AS (SELECT record_id, output, sample_index FROM generation_health_2048_records), c AS (SELECT record_id, prompt FROM generation_health_2048_records WHERE record_id % 3 = 0) SELECT t.record_id, CASE WHEN c.record_id IS NOT NULL THEN c.prompt ELSE t.output END AS baseline_output, CASE WHEN c.record_id IS NOT NULL THEN 'changed' ELSE 'identical' END AS pair_source FROM t LEFT JOIN c USING (record_id)")
def reconstruct_pairs(spark, d):
    g = table(spark, d, _G)
    changed = g.where("record_id % 3 = 0").select("record_id", F.col("prompt").alias("output"))
    return paired.reconstruct_pairs(g.select("record_id", "output"), changed, "record_id", "output").select("record_id", "baseline_output", "pair_source")


@query("SELECT 'missing' AS side, sample_id FROM (SELECT DISTINCT sample_id FROM validation WHERE sample_id IS NOT NULL) WHERE sample_id NOT IN (SELECT sample_id FROM train WHERE sample_id IS NOT NULL) UNION ALL SELECT 'extra', sample_id FROM (SELECT DISTINCT sample_id FROM train WHERE sample_id IS NOT NULL) WHERE sample_id NOT IN (SELECT sample_id FROM validation WHERE sample_id IS NOT NULL)")
def keyset_difference(spark, d):
    return paired.key_difference(table(spark, d, "validation").where("sample_id is not null"), table(spark, d, "train").where("sample_id is not null"), "sample_id")


_NLL = "one AS (SELECT metadata.source AS source, sample_id, avg(CAST(metadata.token_count AS DOUBLE)) AS a, avg(CAST(len(input_ids) AS DOUBLE)) AS b FROM train WHERE sample_id IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {_NLL} SELECT source, count(*) AS pairs, round(avg(a), 6) AS baseline_mean, round(avg(b), 6) AS trained_mean, round(avg(b - a), 6) AS delta, count(*) FILTER (b < a) AS improved, count(*) FILTER (b > a) AS worsened, count(*) FILTER (b = a) AS unchanged FROM one WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY source")
def paired_loss(spark, d):
    """Keyed 1:1 pairs where lower is better; stored against counted tokens play the losses."""
    t = table(spark, d, "train").where("sample_id is not null").groupBy(F.col("metadata.source").alias("source"), "sample_id").agg(F.avg("metadata.token_count").alias("a"), F.avg(F.size("input_ids")).alias("b")).where("a is not null and b is not null")
    way = paired.direction(F.col("b") - F.col("a"), lower_is_better=True)
    return t.groupBy("source").agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.avg("a"), 6).alias("baseline_mean"), F.round(F.avg("b"), 6).alias("trained_mean"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("delta"),
        F.count_if(way == "improved").alias("improved"), F.count_if(way == "regressed").alias("worsened"), F.count_if(way == "unchanged").alias("unchanged"),
    )


@query("SELECT event_type, round(sum(value) / sum(event_id % 97 + 1), 6) AS weighted_mean, round(avg(value / (event_id % 97 + 1)), 6) AS mean_of_means, CAST(sum(event_id % 97 + 1) AS BIGINT) AS tokens, count(*) AS records FROM events GROUP BY event_type")
def token_weighted_mean(spark, d):
    e = table(spark, d, "events").withColumn("tokens", F.col("event_id") % 97 + 1)
    return stats.token_weighted_mean(e, "value", "tokens", "event_type")


@query("SELECT metadata.source AS source, count(*) AS count, min(n) AS min, quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.95) AS p95, quantile_disc(n, 0.99) AS p99, max(n) AS max, round(avg(n), 6) AS mean FROM (SELECT metadata, CAST(len(input_ids) AS INT) AS n FROM train) GROUP BY 1")
def length_distribution_disc(spark, d):
    t = table(spark, d, "train").select(F.col("metadata.source").alias("source"), F.size("input_ids").alias("n"))
    return stats.integer_distribution(t, "n", "source")


@query("SELECT " + ", ".join(f"round(quantile_cont(n, {p}), 6) AS p{round(p * 100):02d}" for p in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + ", CAST(min(n) AS INT) AS min, CAST(max(n) AS INT) AS max FROM (SELECT len(input_ids) AS n FROM train)")
def length_percentiles_cont(spark, d):
    t = table(spark, d, "train").select(F.size("input_ids").alias("n"))
    return stats.percentiles(t, "n", [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99], extremes=True)


_CAPS = [64, 128, 256, 512, 1024, 2048]


@query("WITH n AS (SELECT len(input_ids) AS n FROM train), c AS (SELECT unnest([64, 128, 256, 512, 1024, 2048]) AS cap) SELECT CAST(cap AS BIGINT) AS cap, count(*) FILTER (n > cap) AS truncated, round(count(*) FILTER (n > cap) * 100.0 / count(*), 1) AS percent, round(coalesce(avg(CASE WHEN n > cap THEN cap / n END), 1.0), 6) AS kept_share FROM n, c GROUP BY cap")
def truncation_sweep(spark, d):
    return stats.truncation_sweep(table(spark, d, "train").select(F.size("input_ids").alias("n")), "n", _CAPS)


@query("SELECT round(avg(generated_tokens), 6) AS mean, round(stddev_pop(generated_tokens), 6) AS std, round(avg(CAST(generated_eos AS DOUBLE)), 6) AS eos_rate, round(avg(CAST(contains(output, '</think>') AS DOUBLE)), 6) AS think_rate FROM generation_health_2048_records")
def mean_std_rates(spark, d):
    g = table(spark, d, _G)
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return g.agg(F.round(F.avg("generated_tokens"), 6).alias("mean"), F.round(F.stddev_pop("generated_tokens"), 6).alias("std"), rate(F.col("generated_eos")).alias("eos_rate"), rate(F.contains("output", F.lit("</think>"))).alias("think_rate"))


@query("SELECT source, count(generated_eos) AS n, round(avg(CAST(generated_eos AS DOUBLE)), 6) AS rate, round(stddev_samp(CAST(generated_eos AS DOUBLE)) / sqrt(count(generated_eos)), 6) AS standard_error FROM generation_health_2048_records GROUP BY source")
def proportion_error(spark, d):
    return stats.proportion_error(table(spark, d, _G), "generated_eos", "source")


@query(
    """WITH a AS (SELECT count(*) AS samples, min(generated_tokens) AS min, max(generated_tokens) AS max, avg(generated_tokens) AS mean, quantile_cont(generated_tokens, 0.5) AS p50, quantile_cont(generated_tokens, 0.9) AS p90, quantile_cont(generated_tokens, 0.95) AS p95,
    count(*) FILTER (generated_tokens >= 2048) / count(*) AS tr FROM generation_health_2048_records WHERE generated_tokens > 0), b AS (SELECT *, mean * 10000 * 0.002 * 1.25 / 3600 AS h FROM a), c AS (SELECT *, h * 9.0 AS cost FROM b)
    SELECT samples, min, max, round(mean, 6) AS mean, round(p50, 6) AS p50, round(p90, 6) AS p90, round(p95, 6) AS p95, round(tr, 6) AS truncation_rate, round(h, 6) AS hours, round(cost, 6) AS cost,
    samples >= 200 AS enough_samples, 1 - tr >= 0.9 AS stop_rate, tr <= 0.1 AS truncation_rate_ok, h <= 3.0 AS hours_ok, cost <= 30.0 AS cost_ok, samples >= 200 AND 1 - tr >= 0.9 AND tr <= 0.1 AND h <= 3.0 AND cost <= 30.0 AS passed FROM c"""
)
def generation_budget_gate(spark, d):
    """Over the records that have a positive length, however many; others are counted by generation_health_gate."""
    return gates.generation_budget(table(spark, d, _G).where("generated_tokens > 0"), "generated_tokens", 2048, 0.002, 10_000, any_probe_size=True)


@query("WITH a AS (SELECT source, count(*) AS records, count(error) AS runtime_errors, count(*) FILTER (coalesce(generated_tokens, 0) <= 0) AS empty, count(*) FILTER (coalesce(generated_eos, false)) / count(*) AS r FROM generation_health_2048_records GROUP BY source) SELECT source, records, runtime_errors, empty, round(r, 6) AS eos_rate, runtime_errors = 0 AND empty = 0 AND r >= 0.9 AS passed FROM a")
def generation_health_gate(spark, d):
    return gates.generation_health(table(spark, d, _G), "generated_tokens", "generated_eos", "error", 0.9, "source")


@query(
    r"""WITH p AS (SELECT record_id, error, generated_eos, stop_reason, nullif(regexp_extract(output, 'boxed\{(-?\d+)\}', 1), '') AS parsed, sample_index FROM generation_health_2048_records)
    SELECT record_id, concat_ws(',', CASE WHEN error IS NOT NULL THEN 'runtime_error' WHEN parsed IS NULL THEN 'unparseable' WHEN CAST(parsed AS BIGINT) % 2 = 0 THEN 'correct' ELSE 'wrong_answer' END,
    CASE WHEN error IS NULL AND NOT coalesce(generated_eos, false) THEN 'no_eos' END, CASE WHEN error IS NULL AND coalesce(stop_reason = 'length', false) THEN 'length_truncated' END) AS labels FROM p"""
)
def classify_generation(spark, d):
    """Boxed integers play parsed answers; even ones play verified answers."""
    found = F.regexp_extract("output", r"boxed\{(-?\d+)\}", 1)
    parsed = F.when(found != "", found)
    labels = gates.generation_labels(F.col("error"), parsed, parsed.cast("bigint") % 2 == 0, F.col("generated_eos"), F.col("stop_reason"))
    return table(spark, d, _G).select("record_id", F.array_join(labels, ",").alias("labels"))


@query("SELECT record_id, CASE WHEN list_contains(completion_ids, 50001) THEN 50001 WHEN list_contains(completion_ids, 50000) THEN 50000 WHEN list_contains(completion_ids, 3) THEN 3 END AS stop_id FROM generation_health_2048_records")
def stop_match(spark, d):
    return table(spark, d, _G).select("record_id", gates.stop_match(F.col("completion_ids"), [50001, 50000, 3]).alias("stop_id"))


@query("SELECT record_id, generated_tokens FROM generation_health_2048_records WHERE generated_tokens IS NOT NULL ORDER BY generated_tokens DESC, record_id LIMIT 1")
def arg_extreme_record(spark, d):
    g = table(spark, d, _G).where("generated_tokens is not null").select("record_id", "generated_tokens")
    return gates.arg_extreme(g, F.col("generated_tokens"), "record_id")


@query("SELECT max_by(event_type, value) AS peak_event, max(value) AS peak, max_by(value, struct_pack(a := ts, b := event_id)) AS last FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def telemetry_summary(spark, d):
    e = table(spark, d, "events")
    first = e.agg(F.min("event_type").alias("event_type"))
    e = e.join(F.broadcast(first), "event_type", "left_semi")  # one row
    return e.agg(F.max_by("event_type", "value").alias("peak_event"), F.max("value").alias("peak"), F.max_by("value", F.struct("ts", "event_id")).alias("last"))


@query(
    "SELECT (SELECT event_type FROM events WHERE value IS NOT NULL ORDER BY value DESC, ts, event_id LIMIT 1) AS peak_event, (SELECT max(value) FROM events) AS peak, (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1) AS last"
)
def telemetry_summary_all(spark, d):
    """Over all events, as the reference's summary; of equal peaks the first in order."""
    peak = F.struct("value", -F.unix_micros("ts"), -F.col("event_id"))
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.agg(F.max_by("event_type", peak).alias("peak_event"), F.max("value").alias("peak"), F.max_by("value", F.struct("ts", "event_id")).alias("last"))


_EV = "e AS (SELECT user_id AS run, ts, event_id, value FROM events WHERE event_type = (SELECT min(event_type) FROM events))"
_ROLL = "r AS (SELECT *, CASE WHEN count(value) OVER w = 20 THEN quantile_cont(value, 0.5) OVER w END AS med FROM e WINDOW w AS (PARTITION BY run ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"


def _events(spark, d):
    e = table(spark, d, "events")
    e = e.join(F.broadcast(e.agg(F.min("event_type").alias("event_type"))), "event_type", "left_semi")  # one row
    return e.select(F.col("user_id").alias("run"), "ts", "event_id", "value")


@query(f"WITH {_EV}, {_ROLL} SELECT event_id, round(med, 6) AS median FROM r")
def rolling_median_guard(spark, d):
    return guard.rolling_medians(_events(spark, d), "run", ["ts", "event_id"], ["value"]).select("event_id", F.round("median_value", 6).alias("median"))


@query(
    f"WITH {_EV}, {_ROLL}, h AS (SELECT *, coalesce(value > 1.5 * med, false) AS hit FROM r), i AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM h) "
    "SELECT event_id, hit, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY run, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM i"
)
def spike_streak(spark, d):
    return guard.spike_streaks(_events(spark, d), "run", ["ts", "event_id"], "value", 1.5).select("event_id", "hit", "streak")


_EV_ALL = "e AS (SELECT (user_id, event_type) AS run, ts, event_id, value FROM events)"


def _all_events(spark, d):
    return table(spark, d, "events").select(F.struct("user_id", "event_type").alias("run"), "ts", "event_id", "value")


@query(f"WITH {_EV_ALL}, {_ROLL} SELECT event_id, round(med, 6) AS median FROM r")
def rolling_median_guard_all(spark, d):
    """All events; the events of one type of one user are a run."""
    return guard.rolling_medians(_all_events(spark, d), "run", ["ts", "event_id"], ["value"]).select("event_id", F.round("median_value", 6).alias("median"))


@query(
    f"WITH {_EV_ALL}, {_ROLL}, h AS (SELECT *, coalesce(value > 1.5 * med, false) AS hit FROM r), i AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM h) "
    "SELECT event_id, hit, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY run, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM i"
)
def spike_streak_all(spark, d):
    """All events; the events of one type of one user are a run."""
    return guard.spike_streaks(_all_events(spark, d), "run", ["ts", "event_id"], "value", 1.5).select("event_id", "hit", "streak")


@query("WITH a AS (SELECT source, count(*) AS rows, count(stop_reason) AS decided, count(*) FILTER (stop_reason = 'length') AS flagged FROM generation_health_2048_records GROUP BY source) SELECT source, rows, decided, CASE WHEN decided < rows THEN 'incomplete' WHEN flagged > 0 THEN 'needs_resolution' ELSE 'passed' END AS status FROM a")
def verdict_status(spark, d):
    """Stop reasons play verdicts: length is a flag, anything else a keep, null is undecided."""
    g = table(spark, d, _G).select("source", F.when(F.col("stop_reason") == "length", "flag").when(F.col("stop_reason").isNotNull(), "keep").alias("verdict"))
    return gates.verdict_status(g, "rows", "verdict", "source").select("source", "rows", "decided", "status")


@query("SELECT suite, count(*) AS items, round(avg(CASE WHEN gold IS NULL THEN 0.0 ELSE 1.0 END), 6) AS gold_rate FROM eval_suites GROUP BY suite")
def suite_summary(spark, d):
    return table(spark, d, "eval_suites").groupBy("suite").agg(F.count(F.lit(1)).alias("items"), F.round(F.avg(F.col("gold").isNotNull().cast("double")), 6).alias("gold_rate"))


@query(
    f"WITH e AS (SELECT user_id AS run, event_id AS ts, event_id, value FROM events), {_ROLL}, h AS (SELECT *, coalesce(value > 5.0 * med, false) AS hit FROM r), i AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM h), "
    "s AS (SELECT run, event_id, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY run, island ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS streak FROM i) "
    "SELECT CAST(run AS VARCHAR) AS run, min(event_id) AS optimizer_step, 'loss_spike' AS reason FROM s WHERE streak >= 3 GROUP BY run"
)
def guard_streaming(spark, d):
    """The stateful guard over the event log as a stream."""
    import uuid

    from millrace.streaming.guard import EVENT_SCHEMA, guard_stream

    e = table(spark, d, "events")
    folder = f"{runtime.shared_folder(spark)}/metric-log-{uuid.uuid4().hex}"
    log = e.select(F.col("user_id").cast("string").alias("run"), F.lit("train").alias("event"), F.col("event_id").alias("optimizer_step"), F.col("value").alias("mean_loss"), F.lit(1.0).alias("grad_norm"))
    log.write.parquet(folder)
    runtime.register(folder)
    out = f"{runtime.shared_folder(spark)}/trips-{uuid.uuid4().hex}"
    stream = guard_stream(spark.readStream.schema(EVENT_SCHEMA).parquet(folder))
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    runtime.register(out)
    runtime.register(out + "-state")
    return spark.read.schema("run string, optimizer_step bigint, reason string").parquet(out)


@query(
    """WITH g AS (SELECT source, generated_tokens AS n, coalesce(contains(output, 'boxed'), false) AS boxed, coalesce(generated_eos, false) AS eos FROM generation_health_2048_records WHERE generated_tokens IS NOT NULL)
    SELECT source, count(*) AS rows, min(n) AS min, round(avg(n), 6) AS mean, quantile_cont(n, 0.5) AS median, max(n) AS max, count(*) FILTER (n >= 2048) AS cap_hits, count(*) FILTER (n >= 2048 AND NOT eos) AS cap_hits_wrong,
    count(*) FILTER (NOT boxed) AS missing_marker, bool_and((n >= 2048) = (NOT boxed)) AS cap_hit_is_missing_marker, count(*) FILTER (NOT eos) AS any_truncated, count(*) FILTER (eos) AS any_padded FROM g GROUP BY source"""
)
def trained_details(spark, d):
    yes = lambda c: F.coalesce(c, F.lit(False))
    eos = yes(F.col("generated_eos"))
    g = table(spark, d, _G).where("generated_tokens is not null").select("source", F.col("generated_tokens").alias("n"), yes(F.contains("output", F.lit("boxed"))).alias("boxed"), eos.alias("eos"), F.array(~eos).alias("cut"), F.array(eos).alias("padded"))
    return paired.trained_details(g, "n", 2048, "eos", "boxed", "cut", "padded", "source")


@query("SELECT row_number() OVER (ORDER BY record_id) AS position, record_id FROM generation_health_2048_records")
def sample_order(spark, d):
    """Order export: the position of every record."""
    from millrace.operators import shaping

    return shaping.global_positions(table(spark, d, _G).select("record_id"), [F.col("record_id")]).select((F.col("position") + 1).alias("position"), "record_id")
