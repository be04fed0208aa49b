import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import gates, guard, paired, shaping, stats

DETAIL = "task string, row_index bigint, example string, instruction string, full_prompt string, num_effective_few_shots int, num_asked_few_shots int, input_tokens array<int>, gold array<string>, choices array<string>, gold_index array<int>, metrics map<string,double>, predictions array<string>"


def detail(spark, scores, predictions, prompt="p", metric="qem"):
    rows = [("t", i, f"e{i}", "", prompt, 0, 0, [1], ["g"], [], [0], {metric: float(s)}, [p]) for i, (s, p) in enumerate(zip(scores, predictions))]
    return spark.createDataFrame(rows, DETAIL)


def test_paired_runs(spark):
    pairs = paired.checked_pairs(paired.positional_pairs(detail(spark, [0, 1, 0], "abc"), detail(spark, [1, 0, 0], "abd")))
    s = paired.metric_summary(paired.metric_rows(pairs)).first()
    assert (s.pairs, s.baseline_mean, s.trained_mean, s.improved, s.regressed, s.unchanged) == (3, 0.333333, 0.333333, 1, 1, 1)
    assert sorted(r.row_index for r in paired.changed_rows(pairs).collect()) == [0, 1, 2]


def test_pairing_errors(spark):
    base = detail(spark, [0, 1], "ab")
    for other, what in ((detail(spark, [0], "a"), "missing_row"), (detail(spark, [0, 1], "ab", prompt="q"), "full_prompt"), (detail(spark, [0, 1], "ab", metric="em"), "metrics")):
        with pytest.raises(paired.PairingError, match=what):
            paired.checked_pairs(paired.positional_pairs(base, other))


def test_outcomes(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 0.0), (0.0, 0.0), (1.0, 1.0)], "b double, t double")
    assert [r[0] for r in df.select(paired.outcome(F.col("b"), F.col("t"))).collect()] == list(paired.OUTCOMES)
    with pytest.raises(Exception, match="scores must be 0 or 1"):
        spark.createDataFrame([(0.5, 1.0)], "b double, t double").select(paired.outcome(F.col("b"), F.col("t"))).collect()


def test_annotations_and_summary(spark):
    rows = [(1, "improved", "no mark", "now #### 4" + "x" * 60), (2, "regressed", "#### 1", "#### 2")]
    df = paired.annotate(spark.createDataFrame(rows, "row_index int, outcome string, b string, t string"), "b", "t")
    got = {r.row_index: (r.marker_transition, r.length_bucket) for r in df.collect()}
    assert got == {1: ("missing_to_present", "longer_by_50_or_more"), 2: ("present_to_present", "within_50")}
    s = {r.outcome: (r.n, r.trained_marker_rate) for r in paired.outcome_summary(df, "b", "t").collect()}
    assert s == {"improved": (1, 1.0), "regressed": (1, 1.0), "both_wrong": (0, None), "both_correct": (0, None)}


def test_stratified_sample_covers_all_strata(spark):
    rows = [(i, "g", "abc"[i % 3] if i < 30 else "rare") for i in range(31)]
    df = spark.createDataFrame(rows, "row_index int, outcome string, stratum string")
    pick = lambda d, q: sorted(r.row_index for r in paired.stratified_sample(d, "outcome", ["stratum"], q, F.sha2(F.col("row_index").cast("string"), 256), "row_index").collect())
    assert 30 in pick(df, 6) and len(pick(df, 6)) == 6 and pick(df, 6) == pick(df.repartition(4), 6)
    assert len(pick(df, 2)) == 4


def test_keys_and_reconstruction(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "k string") for s in ("abc", "bcd"))
    assert {tuple(r) for r in paired.key_difference(a, b, "k").collect()} == {("missing", "a"), ("extra", "d")}
    t = spark.createDataFrame([(1, "x"), (2, "y")], "row_index int, p string")
    c = spark.createDataFrame([(2, None)], "row_index int, p string")
    assert {tuple(r) for r in paired.reconstruct_pairs(t, c, "row_index", "p").collect()} == {(1, "x", "x", "identical"), (2, "y", None, "changed")}
    m = lambda rows: spark.createDataFrame(rows, "suite string, seed int, model string")
    got = paired.manifest_mismatches(m([("a", 1, "x"), ("b", 1, "x"), ("c", None, "x")]), m([("a", 2, "x"), ("c", None, "x"), ("d", 1, "x")]), "suite", ["seed", "model"])
    assert {tuple(r) for r in got.collect()} == {("a", "seed"), ("b", "missing"), ("d", "missing")}


def test_mcnemar(spark):
    cases = [(0, 0), (10, 0), (0, 10), (199, 148), (5, 5), (3000, 2900)]
    df = spark.createDataFrame(cases, "i bigint, r bigint").select(stats.mcnemar_p(F.col("i"), F.col("r")).alias("p"))
    for (i, r), got in zip(cases, df.collect()):
        n, k = i + r, min(i, r)
        want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, x) for x in range(k + 1)) / 2**n)
        assert math.isclose(got.p, want, rel_tol=1e-9)


def test_distributions(spark):
    df = spark.createDataFrame([(x,) for x in [1, 2, 3, 4, 100]], "n int")
    d = stats.integer_distribution(df, "n").first()
    assert (d["count"], d["min"], d.p50, d.p95, d.p99, d["max"], d["mean"]) == (5, 1, 3, 100, 100, 100, 22.0)
    assert stats.percentiles(df, "n", [0.5, 0.9]).first() == (3.0, 61.6)
    sweep = {r["cap"]: (r.truncated, r.percent, r.kept_share) for r in stats.truncation_sweep(df, "n", [2, 50, 200]).collect()}
    assert sweep[50] == (1, 20.0, 0.5) and sweep[200] == (0, 0.0, 1.0) and sweep[2][0] == 3
    assert stats.truncation_sweep(df.limit(0), "n", [2]).first().percent == 0.0


def test_bootstrap(spark):
    r = stats.bootstrap_counts(199, 148, 972)
    assert r["low"] < r["mean"] < r["high"] and math.isclose(r["mean"], 51 / 1319) and stats.bootstrap_counts(199, 148, 972) == r
    df = spark.createDataFrame([("g", f"k{i}", float(i % 5)) for i in range(100)], "g string, k string, v double")
    a, b = (stats.bootstrap_mean(x, "v", "k", "g", draws=500).first() for x in (df, df.repartition(7)))
    assert a == b and a.low < a["mean"] == 2.0 < a.high
    with pytest.raises(ValueError):
        stats.bootstrap_counts(0, 0, 0)


def test_regression_verdict(spark):
    df = spark.createDataFrame([(-0.02, -0.03, -0.01), (-0.03, -0.07, 0.01), (0.01, 0.0, 0.02), (-0.005, -0.006, -0.004)], "d double, l double, h double")
    assert [r[0] for r in df.select(stats.regression_verdict(*map(F.col, "dlh"))).collect()] == ["regression", "warning", "pass", "pass"]


def test_losses(spark):
    df = spark.createDataFrame([(2.0, 1), (1.0, 9)], "loss double, n int")
    r = stats.token_weighted_mean(df, "loss", "n").first()
    assert r.weighted_mean == 0.3 and r.mean_of_means == 1.055556
    ways = spark.createDataFrame([(-1.0,), (0.5,), (0.0,)], "d double").select(paired.direction(F.col("d"), lower_is_better=True))
    assert [x[0] for x in ways.collect()] == ["improved", "regressed", "unchanged"]


def test_budget(spark):
    df = spark.createDataFrame([(400,)] * 190 + [(2048,)] * 10, "n int")
    r = gates.generation_budget(df, "n", 2048, 1e-5 * 1.25, 10_000_000 // 1000).first()
    assert r.samples == 200 and r.truncation_rate == 0.05 and r.passed
    bad = gates.generation_budget(spark.createDataFrame([(2048,)] * 200, "n int"), "n", 2048, 1.0, 100_000).first()
    assert not bad.passed and not (bad.stop_rate or bad.truncation_rate_ok or bad.hours_ok or bad.cost_ok) and bad.enough_samples
    for wrong, planned, why in ((df.limit(0), 1, "at least one row"), (df.unionByName(spark.createDataFrame([(0,)], "n int")), 300, "positive"), (df.unionByName(spark.createDataFrame([(None,)], "n int")), 300, "positive"), (df, 10, "fewer")):
        with pytest.raises(Exception, match=why):
            gates.generation_budget(wrong, "n", 2048, 1.0, planned).collect()
    for cap, limits in ((0, gates.BudgetLimits()), (2048, gates.BudgetLimits(min_stop_rate=1.5)), (2048, gates.BudgetLimits(safety=0))):
        with pytest.raises(ValueError):
            gates.generation_budget(df, "n", cap, 1.0, 300, limits)


def test_health_and_labels(spark):
    df = spark.createDataFrame([(5, True, None), (0, None, "boom")], "n int, eos boolean, error string")
    r = gates.generation_health(df, "n", "eos", "error", 0.4).first()
    assert (r.runtime_errors, r.empty, r.eos_rate, r.passed) == (1, 1, 0.5, False)
    with pytest.raises(ValueError):
        gates.generation_health(df, "n", "eos", "error", 1.5)
    rows = [("e", None, None, None, None), (None, "4", True, True, "eos"), (None, None, None, True, "eos"), (None, "4", False, False, "length"), (None, "4", None, None, None)]
    got = spark.createDataFrame(rows, "error string, parsed string, ok boolean, eos boolean, fin string").select(gates.generation_labels(*map(F.col, ("error", "parsed", "ok", "eos", "fin"))))
    assert [r[0] for r in got.collect()] == [["runtime_error"], ["correct"], ["unparseable"], ["wrong_answer", "no_eos", "length_truncated"], ["wrong_answer", "no_eos"]]


def test_verdicts_and_extremes(spark):
    df = spark.createDataFrame([("a", "keep"), ("a", None), ("b", "keep"), ("b", "flag"), ("c", "agree")], "g string, v string")
    assert {r.g: r.status for r in gates.verdict_status(df, "n", "v", "g").collect()} == {"a": "incomplete", "b": "needs_resolution", "c": "passed"}
    x = spark.createDataFrame([(1, 5), (2, 9), (3, 9), (4, 1), (5, 1)], "o int, n int")
    assert gates.arg_extreme(x, F.col("n"), "o").first().o == 2 and gates.arg_extreme(x, F.col("n"), "o", longest=False).first().o == 4
    assert gates.arg_extreme(x.limit(0), F.col("n"), "o").count() == 0
    assert spark.createDataFrame([([9, 3, 7],)], "c array<int>").select(gates.stop_match(F.col("c"), [7, 3])).first()[0] == 7


def events(spark, losses, run="r", grads=None):
    return spark.createDataFrame([(run, "train", i, float(x), 1.0 if grads is None else float(grads[i])) for i, x in enumerate(losses, 1)], "run string, event string, optimizer_step bigint, mean_loss double, grad_norm double")


def test_guard_trips_on_the_third_spike(spark):
    e = events(spark, [1.0] * 20 + [9.0] * 3).unionByName(events(spark, [1.0] * 20 + [9.0, 9.0, 1.0, 9.0], run="calm"))
    assert [tuple(r) for r in guard.guard(e).collect()] == [("r", 23, "loss_spike")]


def test_streaming_guard_equals_batch(spark, tmp_path):
    import random

    from millrace.streaming.guard import guard_stream, metric_log

    rng = random.Random(6)
    parts = [events(spark, [rng.choice([1.0, 1.1, 0.9, 40.0 if i > 25 and rng.random() < 0.5 else 1.0]) * (30 if i in (40, 41, 42, 43) else 1) for i in range(60)], run=f"r{k}") for k in range(5)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    for low in range(0, 60, 20):
        whole.where((F.col("optimizer_step") > low) & (F.col("optimizer_step") <= low + 20)).coalesce(1).write.mode("append").json(str(tmp_path / "log"))
    q = guard_stream(metric_log(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName("trips").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.sql("select run, optimizer_step, reason from trips").collect()}
    assert got == {tuple(r) for r in guard.guard(whole).collect()} and len(got) == 5


def test_shaping(spark):
    df = spark.createDataFrame([([10, 11, 12, 20, 21, 99, 30], [10, 11, 12])], "full array<int>, prompt array<int>")
    assert df.select(shaping.assistant_labels(F.col("full"), F.col("prompt"), 99)).first()[0] == [-100, -100, -100, 20, 21, 99, -100]
    for full, prompt, why in (([1, 2, 99], [2], "prefix"), ([1, 2], [1], "end token")):
        with pytest.raises(Exception, match=why):
            spark.createDataFrame([(full, prompt)], "full array<int>, prompt array<int>").select(shaping.assistant_labels(F.col("full"), F.col("prompt"), 99)).collect()
    rows = [(0, "a", [1, 2, 3], [1, 2, 3]), (0, "b", [4], [4]), (1, "c", [5, 6], [5, 6])]
    got = {r.sample_id: (r.input_ids, r.labels, r.attention_mask) for r in shaping.collate(spark.createDataFrame(rows, "batch int, sample_id string, input_ids array<int>, labels array<int>"), "batch").collect()}
    assert got["b"] == ([4, 0, 0], [4, -100, -100], [1, 0, 0]) and got["c"] == ([5, 6], [5, 6], [1, 1])
    assert shaping.step_plan(61_224, 128, 0.03) == (479, 15)
    m = spark.createDataFrame([([("user", "hi"), ("assistant", "yo")],)], "m array<struct<role:string,content:string>>")
    assert m.select(shaping.chatml(F.col("m"), True)).first()[0] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>assistant\n"


def test_positions_do_not_depend_on_partitioning(spark):
    df = spark.createDataFrame([(f"k{i % 90}", i) for i in range(100)], "k string, v int")
    order = [shaping.epoch_order(F.col("k"), 1, 0), F.col("v")]
    a, b = ({r.v: r.position for r in shaping.global_positions(x, order, partitions=p).collect()} for x, p in ((df, 3), (df.repartition(6), 8)))
    assert a == b and sorted(a.values()) == list(range(100))


def test_predictions_and_nested_tokens(spark):
    df = spark.createDataFrame([(["a"], [[], [1, 2, 3]], [False, True], None)], "p array<string>, t array<array<int>>, cut array<boolean>, padded array<boolean>")
    assert df.select(paired.prediction_text(F.col("p")), paired.generated_length(F.col("t"))).first() == ("a", 3)
    assert [r.length for r in paired.leaf_lengths(df, "t").collect()] == [3]
    for p, t in ((["a", "b"], [[1]]), ([], [[1]])):
        with pytest.raises(Exception, match="list of one string"):
            spark.createDataFrame([(p, t)], "p array<string>, t array<array<int>>").select(paired.prediction_text(F.col("p"))).collect()
    with pytest.raises(Exception, match="exactly one"):
        spark.createDataFrame([([[1], [2]],)], "t array<array<int>>").select(paired.generated_length(F.col("t"))).collect()
    rows = df.select(paired.generated_length(F.col("t")).alias("n"), F.lit(False).alias("ok"), F.lit(False).alias("marker"), "cut", "padded")
    r = paired.trained_details(rows, "n", 3, "ok", "marker", "cut", "padded").first()
    assert (r.cap_hits, r.cap_hits_wrong, r.missing_marker, r.cap_hit_is_missing_marker, r.any_truncated, r.any_padded) == (1, 1, 1, True, 1, 0)


def test_masked_loss(spark):
    df = spark.createDataFrame([("a", [-1.0, -2.0, -4.0], [-100, -100, 5, 6])], "k string, lp array<double>, y array<int>")
    r = paired.masked_loss(df, "lp", "y", "k").first()
    assert (r.loss_sum, r.valid_tokens, r.mean_loss) == (6.0, 2, 3.0)
    with pytest.raises(Exception, match="no supervised token"):
        paired.masked_loss(df.withColumn("y", F.transform("y", lambda x: F.lit(-100))), "lp", "y", "k").collect()


def test_gate_reports():
    assert gates.reproducible({"rows": 3, "a": 1}, {"rows": 3, "a": 1}, ["rows", "a"], 3)["passed"]
    bad = gates.reproducible({"rows": 3, "a": 1}, {"rows": 3, "a": 2}, ["rows", "a"], 4)
    assert not bad["passed"] and [c["passed"] for c in bad["checks"]] == [False, False]


def test_preflight(spark):
    rows = [("train", 1, 2.0), ("train", 2, 1.0), ("validation", 0, 2.0), ("validation", 1, 2.0), ("validation", 2, 1.0)]
    df = spark.createDataFrame(rows, "event string, optimizer_step bigint, mean_loss double")
    assert gates.preflight(df).first().passed and not gates.preflight(df.where("optimizer_step < 2")).first().passed
    assert not gates.preflight(df.withColumn("mean_loss", F.lit(float("nan")))).first().passed


def test_validated_extreme(spark):
    schema = "o int, sample_id string, input_ids array<int>, labels array<int>, metadata struct<token_count:int>"
    rows = [(1, "a", [1, 2], [1, 2], (2,)), (2, "b", [1, 2, 3], [1, 2, 3], None), (3, "c", [4, 5, 6], [4, 5, 6], (3,)), (4, "d", [1], [1], (None,))]
    df = spark.createDataFrame(rows, schema)
    assert gates.validated_extreme(df, "o").first().sample_id == "b" and gates.validated_extreme(df, "o", longest=False).first().sample_id == "d"
    for bad in ((5, "e", [1], [1], (9,)), (5, "e", [1, 2, 3, 4], [1], None), (5, None, [1, 2, 3, 4], [1, 2, 3, 4], None)):
        with pytest.raises(Exception, match="invalid tokenized record"):
            gates.validated_extreme(df.unionByName(spark.createDataFrame([bad], schema)), "o").collect()


def test_labels_check_their_lists(spark):
    run = lambda ids, mask: spark.createDataFrame([(ids, mask)], "i array<int>, m array<boolean>").select(shaping.masked_labels(F.col("i"), F.col("m"))).first()[0]
    assert run([5, 6], [False, True]) == [-100, 6]
    for ids, mask, why in (([1], [True, True], "equally long"), ([], [], "empty"), ([1], [False], "somewhere")):
        with pytest.raises(Exception, match=why):
            run(ids, mask)
    batch = lambda *rows: spark.createDataFrame(list(rows), "batch int, sample_id string, input_ids array<int>, labels array<int>")
    for df, why in ((batch((0, "a", [1], [1, 2])), "equally long"), (batch((0, "a", [1], [1]), (0, None, [1], [1])), "all or no")):
        with pytest.raises(Exception, match=why):
            shaping.collate(df, "batch", key="sample_id").collect()
    assert shaping.collate(batch((0, None, [1], [1]), (1, "a", [1], [1])), "batch", key="sample_id").count() == 2
    assert spark.createDataFrame([([1, 2],)], "i array<int>").select(shaping.full_labels(F.col("i"))).first()[0] == [1, 2]


def test_sft_sample_tells_what_is_wrong(spark):
    m = lambda *turns: [list(turns)]
    rows = [m(("user", "hi"), ("assistant", "yo<|im_end|>more")), m(("user", "hi"), ("assistant", None)), m(("user", "hi"), ("other", "yo"))]
    out = shaping.sft_sample(spark.createDataFrame(rows, "m array<struct<role:string,content:string>>"), "m").collect()
    assert [r.token_error for r in out] == [None, "the conversation cannot be rendered", "the prompt is not a prefix of the conversation"]
    assert [x for x in out[0].labels if x != -100] == [*b"yo", 257] and out[1].labels is None


def test_bootstraps_agree(spark):
    """The published counts, by the vector's own draws, by counts and in shards."""
    one = stats.bootstrap_deltas(199, 148, 972, 2000)
    two = stats.bootstrap_counts(199, 148, 972)
    values = [1.0] * 199 + [-1.0] * 148 + [0.0] * 972
    rows = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, i int, v double")
    three, four = (stats.bootstrap_spread(x, "v", "i", "g", 2000, shards=20).first() for x in (rows, rows.repartition(5, "v")))
    assert three == four and abs(three["mean"] - one["mean"]) < 1e-12
    for low, high in ((two["low"], two["high"]), (three.low, three.high)):
        assert abs(low - one["low"]) < 0.003 and abs(high - one["high"]) < 0.003


def test_deltas_are_drawn_one_after_the_other():
    import numpy as np

    values, rng = np.repeat([1.0, -1.0, 0.0], [3, 2, 4]), np.random.default_rng(20260913)
    means = [rng.choice(values, size=9, replace=True).mean() for _ in range(1500)]
    got = stats.bootstrap_deltas(3, 2, 4, 1500)
    assert (got["low"], got["high"]) == tuple(np.quantile(means, [0.025, 0.975]))
