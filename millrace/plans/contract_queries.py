"""Queries of readers, writers, checks and reviews: what is written is read back and must be the table's rows.

Artifacts lie in the shared folder until runtime.release(). What the driver writes itself (manifests,
task lists) is small by nature; tables are written and read by Spark.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import runtime
from millrace.operators import audit, gates, paired, provenance, shaping
from millrace.plans import audit_queries as aq
from millrace.plans.registry import query
from millrace.runtime import table
from millrace.sources import files

_G = "generation_health_2048_records"


def _names(spark, d) -> list[str]:
    """The suites' names: a short list."""
    return [r.suite for r in table(spark, d, "eval_suites").select("suite").where("suite is not null").distinct().sort("suite").collect()]


@query("SELECT eval_split, sample_id, CAST(len(input_ids) AS BIGINT) AS n FROM validation WHERE sample_id IS NOT NULL")
def strict_jsonl_scan(spark, d):
    v = table(spark, d, "validation").where("sample_id is not null").select("eval_split", "sample_id", F.size("input_ids").cast("bigint").alias("n"))
    path = runtime.scratch(spark, "jsonl")
    files.write_json_lines(v, path)
    return files.json_lines_strict(spark, path, "eval_split string, sample_id string, n bigint", ["sample_id"])


@query("SELECT line_id, json_extract_string(line, '$.source') AS source FROM raw_lines WHERE CASE WHEN json_valid(line) THEN json_type(line) = 'OBJECT' ELSE false END")
def lenient_jsonl_scan(spark, d):
    """Lines that do not parse are left out, as by the non-strict reader."""
    r = table(spark, d, "raw_lines").where("line is not null").select("line_id", "line").withColumn("v", F.try_parse_json("line"))
    return r.where(F.schema_of_variant("v").startswith("OBJECT")).select("line_id", F.try_variant_get("v", "$.source", "string").alias("source"))


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT CAST(i AS BIGINT) AS row_index, CAST(n - 1 - i AS BIGINT) AS position, o_orderkey FROM r")
def ordinal_scan(spark, d):
    """Row numbers over several files in path order, and the rows by a list of indices: here, backwards."""
    path = runtime.scratch(spark, "ordinals")
    table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").write.parquet(path)
    rows = files.with_row_index(spark, [path])
    last = rows.count() - 1
    order = rows.select("row_index", (F.lit(last) - F.col("row_index")).alias("position"))
    return files.reordered(rows, order).select("row_index", "position", "o_orderkey")


@query("SELECT CAST(i AS BIGINT) AS row_index, o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i < 1000")
def ordinal_limit(spark, d):
    """The first thousand ordinals: a filter on the row number, no unordered limit."""
    path = runtime.scratch(spark, "ordinals")
    table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").write.parquet(path)
    return files.first_rows(files.with_row_index(spark, [path]), 1000).select("row_index", "o_orderkey")


@query("SELECT CAST(i AS BIGINT) AS row_index, o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i IN (SELECT item_id FROM eval_suites)")
def ordinal_lookup(spark, d):
    """Point lookups of a list of ordinals, as a join."""
    path = runtime.scratch(spark, "ordinals")
    table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").write.parquet(path)
    wanted = table(spark, d, "eval_suites").select(F.col("item_id").alias("row_index"))
    return files.rows_at(files.with_row_index(spark, [path]), wanted).select("row_index", "o_orderkey")


@query("SELECT sample_id, round(avg(metadata.token_count), 6) AS mean_nll FROM train WHERE sample_id IS NOT NULL AND metadata.token_count IS NOT NULL GROUP BY sample_id")
def loss_record_scan(spark, d):
    t = table(spark, d, "train").where("sample_id is not null and metadata.token_count is not null")
    path = runtime.scratch(spark, "losses")
    files.write_json_lines(t.groupBy("sample_id").agg(F.round(F.avg("metadata.token_count"), 6).alias("mean_nll")), path)
    return files.loss_records(spark, path).select("sample_id", "mean_nll")


@query("SELECT suite AS task, '2026-01-02T03-04-05' AS date, count(*) AS items, count(DISTINCT item_id) AS rows FROM eval_suites WHERE suite IS NOT NULL GROUP BY suite")
def detail_scan(spark, d):
    """One detail file per suite, found by name and read in one scan."""
    folder = runtime.scratch(spark, "details")
    for name in _names(spark, d):
        table(spark, d, "eval_suites").where(F.col("suite") == name).select("item_id").coalesce(1).write.parquet(f"{folder}/run/details_{name}_2026-01-02T03-04-05.parquet")
    found = files.details(spark, runtime.local(folder), ["item_id"])
    return found.groupBy("task", "date").agg(F.count("item_id").alias("items"), F.countDistinct("row_index").alias("rows"))


@query("SELECT suite, 'model_args' AS field FROM (SELECT DISTINCT suite FROM eval_suites WHERE suite IS NOT NULL) WHERE length(suite) % 2 = 0 UNION ALL SELECT suite, 'use_chat_template' FROM (SELECT DISTINCT suite FROM eval_suites WHERE suite IS NOT NULL) WHERE length(suite) % 2 = 1")
def frozen_manifest_fields(spark, d):
    """Two runs' manifests, per suite one file, compared in the eight frozen fields."""
    schema, sides = dict.fromkeys(paired.FROZEN_FIELDS, "string"), []
    for side in "bt":
        folder = runtime.local(runtime.scratch(spark, "runs"))
        for name in _names(spark, d):
            changed = {"model_args" if len(name) % 2 == 0 else "use_chat_template": "changed"} if side == "t" else {}
            manifest = dict.fromkeys(paired.FROZEN_FIELDS, "same") | changed | {"suite": name, "status": "completed", "returncode": 0}
            files.write_json_atomic(f"{folder}/{name}/invocation_manifest.json", manifest)
        sides.append(files.run_manifests(spark, folder, schema))
    return paired.manifest_mismatches(*sides, "suite", [f for f in paired.FROZEN_FIELDS if f != "suite"])


@query("SELECT 'gold' AS suite, count(*) AS items, count(gold) AS given FROM eval_suites UNION ALL SELECT 'problem', count(*), count(problem) FROM eval_suites")
def suite_scan(spark, d):
    """Suites from tables, each with the field that holds its text."""
    e = table(spark, d, "eval_suites")
    return files.suite_problems({"gold": (e, "gold"), "problem": (e, "problem")}).groupBy("suite").agg(F.count(F.lit(1)).alias("items"), F.count("problem").alias("given"))


@query("SELECT CAST(record_id AS VARCHAR) AS id, length(prompt) AS chars FROM generation_health_2048_records WHERE trim(prompt) <> ''")
def prompt_scan(spark, d):
    path = runtime.scratch(spark, "prompts")
    files.write_json_lines(table(spark, d, _G).where("trim(prompt) <> ''").select(F.col("record_id").cast("string").alias("id"), "prompt"), path)
    return files.prompts(spark, path).select("id", F.length("prompt").cast("bigint").alias("chars"))


@query("SELECT DISTINCT suite AS task FROM eval_suites WHERE suite IS NOT NULL")
def task_list_scan(spark, d):
    path = runtime.scratch(spark, "tasks")
    lines = [x for name in _names(spark, d) for x in ("# " + name, "  " + name + " ", "")]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return spark.createDataFrame([(x,) for x in files.task_list(spark, path)], "task string")


@query("SELECT CAST(user_id AS VARCHAR) AS run, count(*) AS events, max(event_id) AS last_step, round(sum(value), 4) AS total FROM events WHERE value IS NOT NULL GROUP BY user_id")
def metric_log_replay(spark, d):
    """Events appended to a log in two parts and replayed; other kinds of events are left out."""
    e = table(spark, d, "events").where("value is not null").select(F.col("user_id").cast("string").alias("run"), F.lit("train").alias("event"), F.col("event_id").alias("optimizer_step"), F.col("value").cast("double").alias("mean_loss"))
    path = runtime.scratch(spark, "metric-log")
    files.append_metrics(e, path)
    files.append_metrics(e.withColumn("event", F.lit("validation")), path)
    return files.metric_events(spark, runtime.local(path)).groupBy("run").agg(F.count(F.lit(1)).alias("events"), F.max("optimizer_step").alias("last_step"), F.round(F.sum("mean_loss"), 4).alias("total"))


_VALID = "sample_id IS NOT NULL AND len(input_ids) > 0 AND len(input_ids) = len(labels)"


@query(f"SELECT count(*) AS records, CAST(sum(coalesce(metadata.token_count, len(input_ids))) AS BIGINT) AS tokens, CAST(max(coalesce(metadata.token_count, len(input_ids))) AS INT) AS longest FROM train WHERE {_VALID}")
def token_count_scan(spark, d):
    """Counts by pattern; records without a stored count are parsed."""
    t = table(spark, d, "train").where("sample_id is not null and size(input_ids) > 0 and size(input_ids) = size(labels)")
    path = runtime.scratch(spark, "records")
    t.select("sample_id", "input_ids", "labels", F.struct("metadata.token_count").alias("metadata")).write.json(path)
    return files.token_counts(spark, path).agg(F.count(F.lit(1)).alias("records"), F.sum("token_count").alias("tokens"), F.max("token_count").alias("longest"))


@query(f"SELECT sample_id, CAST(len(input_ids) AS INT) AS n FROM train WHERE {_VALID} AND metadata.row_index IS NOT NULL AND (metadata.token_count IS NULL OR metadata.token_count = len(input_ids)) ORDER BY len(input_ids) DESC, metadata.row_index, sample_id LIMIT 1")
def longest_record(spark, d):
    """The longest well-formed record; a winner that is malformed would raise."""
    t = table(spark, d, "train").where("sample_id is not null and size(input_ids) > 0 and size(input_ids) = size(labels) and metadata.row_index is not null and (metadata.token_count is null or metadata.token_count = size(input_ids))")
    t = t.select("sample_id", "input_ids", "labels", "metadata", F.col("metadata.row_index").alias("row_index"))
    return gates.validated_extreme(t, "row_index").select("sample_id", F.size("input_ids").alias("n"))


_PAIR = "replace(coalesce(problem, ''), ' ', '') <> '' AND replace(coalesce(generation, ''), ' ', '') <> '' AND coalesce(status = 'accepted' OR list_contains(issues, review_reason), false)"
_VERDICT = "CASE WHEN status = 'accepted' THEN CASE WHEN length(generation) % 2 = 0 THEN 'keep' ELSE 'flag' END ELSE CASE WHEN length(generation) % 2 = 0 THEN 'agree' ELSE 'disagree' END END"


@query(f"SELECT status, {_VERDICT} AS verdict, count(*) AS n FROM review_samples WHERE {_PAIR} GROUP BY 1, 2")
def review_decisions(spark, d):
    """A bundle's rows with decisions that name artifact, reviewer and record hash; misfits would raise."""
    r = table(spark, d, "review_samples").where("replace(coalesce(problem, ''), ' ', '') <> '' and replace(coalesce(generation, ''), ' ', '') <> '' and coalesce(status = 'accepted' or array_contains(issues, review_reason), false)")
    bundle = r.select("review_index", "status", "problem", "generation", "issues", "review_reason")
    bundle = files.review_bundle(bundle, bundle.count()).withColumn("record_sha256", provenance.record_hash(["review_index", "status", "problem", "generation"]))
    even = F.length("generation") % 2 == 0
    verdict = F.when(F.col("status") == "accepted", F.when(even, "keep").otherwise("flag")).otherwise(F.when(even, "agree").otherwise("disagree"))
    decided = bundle.select("review_index", F.lit("a").alias("artifact_sha256"), F.lit("r").alias("reviewer"), "record_sha256", verdict.alias("verdict"))
    return provenance.checked_decisions(bundle, decided, "a", "r").groupBy("status", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH old AS (SELECT review_index, source AS record_sha256, 'keep' AS verdict FROM review_samples WHERE source IS NOT NULL), one AS (SELECT record_sha256, min(review_index) AS review_index, 'keep' AS verdict FROM old GROUP BY 1), "
    "new AS (SELECT record_sha256, review_index, 'flag' AS verdict FROM one WHERE length(record_sha256) % 2 = 0) SELECT record_sha256, review_index, verdict FROM new UNION ALL SELECT record_sha256, review_index, verdict FROM one WHERE record_sha256 NOT IN (SELECT record_sha256 FROM new)"
)
def decision_upsert(spark, d):
    """New decisions replace old ones of the same artifact, record and reviewer."""
    r = table(spark, d, "review_samples").where("source is not null").groupBy(F.col("source").alias("record_sha256")).agg(F.min("review_index").alias("review_index"))
    old = r.select(F.lit("a").alias("artifact_sha256"), "record_sha256", F.lit("r").alias("reviewer"), "review_index", F.lit("keep").alias("verdict"))
    new = old.where("length(record_sha256) % 2 = 0").withColumn("verdict", F.lit("flag"))
    return provenance.upsert_decisions(old, new).select("record_sha256", "review_index", "verdict")


@query(
    aq._AUDIT
    + """, keyed AS (SELECT *, sha256(concat_ws(':', 'independent-sft-v1', 'review', coalesce(sample_id, 'missing'), CAST(row_index AS VARCHAR))) AS review_key FROM audited),
    picked AS (SELECT 'accepted' AS reason, row_index, review_key FROM keyed WHERE issues = '' UNION ALL SELECT unnest(string_split(issues, ',')), row_index, review_key FROM keyed WHERE issues <> ''),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY review_key, row_index) AS rank FROM picked)
    SELECT reason, ranked.row_index, sha256(problem) AS problem_sha256, sha256(generation) AS generation_sha256 FROM ranked JOIN review_samples ON ranked.row_index = review_index WHERE rank <= CASE WHEN reason = 'accepted' THEN 20 ELSE 3 END"""
)
def review_sample_texts(spark, d):
    """The review sample with its texts, which only the winners fetch."""
    winners = audit.review_sample(aq.audited(spark, d), aq.SETTINGS).select("reason", "row_index")
    texts = audit.with_texts(winners, table(spark, d, "review_samples").select(F.col("review_index").alias("row_index"), "problem", "generation"), "row_index", ["problem", "generation"])
    return texts.select("reason", "row_index", F.sha2("problem", 256).alias("problem_sha256"), F.sha2("generation", 256).alias("generation_sha256"))


_SEVERAL = (
    aq._AUDIT.replace("NOT coalesce(list_contains(issues, 'math_verify_failed'), false) AS verified", "review_index % 6 AS kind, length(problem) % 3 <> 0 AS verified")
    .replace("NOT coalesce(list_contains(issues, 'incomplete_reasoning'), false) AS complete", "length(generation) % 5 <> 0 AS complete")
    .replace("CASE WHEN " + aq._BLANK.format("g") + " THEN 'invalid_messages' END", "CASE WHEN kind = 5 OR " + aq._BLANK.format("g") + " THEN 'invalid_messages' END")
    .replace("CASE WHEN NOT verified THEN", "CASE WHEN kind = 2 THEN 'invalid_generation_fields' WHEN kind = 3 THEN 'generation_field_length_mismatch' WHEN kind = 4 THEN 'assistant_not_in_generations' WHEN NOT coalesce(verified, false) THEN")
    .replace("WHEN NOT complete THEN", "WHEN NOT coalesce(complete, false) THEN")
    .replace("reasons IS NULL AND token_count <= 200 AS ok", "reasons IS NULL AND length(g) % 7 <> 0 AND token_count <= 200 AS ok")
    .replace("WHEN reasons IS NOT NULL THEN reasons", "WHEN reasons IS NOT NULL THEN reasons WHEN length(placed.g) % 7 = 0 THEN 'tokenization_error:no end token'")
)


@query(_SEVERAL + "SELECT row_index, issues FROM audited")
def audit_generations(spark, d):
    """The audit over several generations per row with flags of their own, malformed ones and failed renderings.

    Kinds by row: one generation; a wrong one first; none; lists of unequal length; none that is the answer; messages in the wrong roles.
    """
    r = table(spark, d, "review_samples")
    kind, g = F.col("review_index") % 6, F.col("generation")
    by_kind = lambda one, second, uneven: F.when(kind == 1, second).when(kind == 3, uneven).otherwise(one)
    verified, complete = F.length("problem") % 3 != 0, F.length(g) % 5 != 0
    message = lambda role, c: F.struct(role.alias("role"), F.col(c).alias("content"))
    generations = F.when(kind == 4, F.array(F.lit("another"))).when(kind == 1, F.array(F.lit("another"), g)).when(kind != 2, F.array(g))
    rows = r.select(
        F.col("review_index").alias("row_index"), "problem", F.array(message(F.when(kind == 5, "assistant").otherwise("user"), "problem"), message(F.lit("assistant"), "generation")).alias("messages"), generations.alias("generations"),
        by_kind(F.array(verified), F.array(F.lit(False), verified), F.array(verified, verified)).alias("correctness_math_verify"), by_kind(F.array(complete), F.array(F.lit(False), complete), F.array(complete)).alias("is_reasoning_complete"), "source",
    )
    answer = F.get(F.col("messages"), F.lit(1))["content"]
    from millrace.functions import text as tx

    out = audit.audit(rows, table(spark, d, "eval_suites"), aq.SETTINGS, F.size(tx.split_words(tx.normalized_portable(answer))), token_error=F.when(F.length(answer) % 7 == 0, "no end token"))
    return out.select("row_index", F.array_join("issues", ",").alias("issues"))


_INVARIANT = {"example": "problem", "instruction": "source", "full_prompt": "problem", "gold": "generation", "gold_index": "review_index"}


@query("SELECT metric, count(*) AS pairs, round(avg(b), 6) AS baseline_mean, round(avg(t), 6) AS trained_mean FROM (SELECT 'boxed' AS metric, CAST(coalesce(contains(generation, 'boxed'), false) AS DOUBLE) AS b, CAST(coalesce(length(generation) > 400, false) AS DOUBLE) AS t FROM review_samples UNION ALL SELECT 'short', CAST(coalesce(length(generation) < 100, false) AS DOUBLE), CAST(coalesce(length(generation) < 200, false) AS DOUBLE) FROM review_samples) GROUP BY metric")
def paired_invariants(spark, d):
    """Two runs over the same rows that agree in all nine invariant fields; a difference would raise."""
    r = table(spark, d, "review_samples")
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    n = F.length("generation")
    fields = [F.col(_INVARIANT[f]).alias(f) if f in _INVARIANT else F.lit(None).cast("string").alias(f) for f in paired.INVARIANTS]
    run = lambda boxed, short: r.select(F.lit("t").alias("task"), F.col("review_index").alias("row_index"), *fields, F.create_map(F.lit("boxed"), yes(boxed), F.lit("short"), yes(short)).alias("metrics"))
    pairs = paired.checked_pairs(paired.positional_pairs(run(F.contains("generation", F.lit("boxed")), n < 100), run(n > 400, n < 200)))
    return paired.metric_summary(paired.metric_rows(pairs), ("metric",)).select("metric", "pairs", "baseline_mean", "trained_mean")


_FULL = "'<|im_start|>user\n' || problem || '<|im_end|>\n<|im_start|>assistant\n' || generation || '<|im_end|>\n'"


@query(
    f"WITH f AS (SELECT review_index, generation, {_FULL} AS t, coalesce(source, 'unknown') AS source FROM review_samples WHERE problem IS NOT NULL AND generation IS NOT NULL) "
    "SELECT review_index, source, 'user,assistant' AS roles, CAST(strlen(t) - 11 * ((strlen(t) - strlen(replace(t, '<|im_start|>', ''))) // 12) - 9 * ((strlen(t) - strlen(replace(t, '<|im_end|>', ''))) // 10) AS INT) AS tokens, "
    "CAST(strlen(split_part(replace(generation, '<|im_start|>', '#') || '<|im_end|>', '<|im_end|>', 1)) + 1 AS INT) AS supervised, CAST(NULL AS VARCHAR) AS error FROM f"
)
def sft_samples(spark, d):
    """Conversations rendered in ChatML, tokenized by bytes and labelled through the answer's end token."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    r = table(spark, d, "review_samples").where("problem is not null and generation is not null")
    r = r.select("review_index", F.coalesce("source", F.lit("unknown")).alias("source"), F.array(message("user", "problem"), message("assistant", "generation")).alias("messages"))
    s = shaping.sft_sample(r, "messages")
    supervised = F.size(F.filter("labels", lambda x: x != shaping.IGNORED))
    return s.select("review_index", "source", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.size("input_ids").alias("tokens"), supervised.alias("supervised"), F.col("token_error").alias("error"))


_POSITION = "o AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS position FROM (SELECT DISTINCT sample_id FROM train WHERE sample_id IS NOT NULL))"


def _positions(spark, d):
    ids = table(spark, d, "train").select("sample_id").where("sample_id is not null").distinct()
    return shaping.global_positions(ids, [F.col("sample_id")])


@query(f"WITH {_POSITION} SELECT CAST(position // 32 AS BIGINT) AS optimizer_step, count(*) AS records, sha256(string_agg(sample_id, ',' ORDER BY position)) AS identity FROM o GROUP BY 1")
def step_identity(spark, d):
    """The ids of every optimizer step, in order."""
    rows = _positions(spark, d).withColumn("optimizer_step", F.floor(F.col("position") / 32))
    steps = shaping.step_identity(rows, "optimizer_step", "position", "sample_id")
    return steps.select("optimizer_step", F.size("sample_ids").cast("bigint").alias("records"), F.sha2(F.array_join("sample_ids", ","), 256).alias("identity"))


@query(f"WITH {_POSITION}, b AS (SELECT position // 1000 AS b, sha256(string_agg(sample_id, chr(10) ORDER BY position) || chr(10)) AS h, count(*) AS n FROM o GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(h, chr(10) ORDER BY b)) AS digest FROM b")
def order_digest(spark, d):
    """Digest of the sample order, by blocks."""
    return provenance.block_digest(_positions(spark, d), "sample_id", "position", 1000)


@query("SELECT CAST(ceil(count(*) / 128) AS BIGINT) AS steps, CAST(ceil(ceil(count(*) / 128) * 0.03) AS BIGINT) AS warmup FROM train")
def warmup_plan(spark, d):
    return spark.createDataFrame([shaping.step_plan(max(table(spark, d, "train").count(), 1), 128, 0.03)], "steps bigint, warmup bigint")


@query("WITH p AS (SELECT t.record_id, CASE WHEN coalesce(contains(b.output, 'boxed'), false) THEN CASE WHEN coalesce(contains(t.output, 'boxed'), false) THEN 'both_correct' ELSE 'regressed' END ELSE CASE WHEN coalesce(contains(t.output, 'boxed'), false) THEN 'improved' ELSE 'both_wrong' END END AS outcome, t.generated_tokens AS n FROM generation_health_2048_records t JOIN generation_health_2048_records b ON t.record_id % 2 = 1 AND b.record_id = t.record_id - 1) SELECT outcome, count(*) AS rows, count(*) FILTER (n >= 2048) AS cap_hits FROM p GROUP BY outcome")
def outcome_cap_hits(spark, d):
    """Paired outcomes and how often each ran into the token limit; records pair as in the paired queries."""
    g = table(spark, d, _G)
    score = F.coalesce(F.contains("output", F.lit("boxed")), F.lit(False)).cast("double")
    t = g.where("record_id % 2 = 1").select((F.col("record_id") - 1).alias("k"), score.alias("t"), F.col("generated_tokens").alias("n"))
    rows = t.join(g.select(F.col("record_id").alias("k"), score.alias("b")), "k").select(paired.outcome(F.col("b"), F.col("t")).alias("outcome"), "n")
    return paired.outcome_details(rows, "outcome", "n", 2048)


@query("SELECT eval_split, round(sum(s), 4) AS loss_sum, CAST(sum(k) AS BIGINT) AS valid_tokens FROM (SELECT eval_split, list_sum(list_transform(generate_series(2, len(labels)), lambda i: CASE WHEN labels[i] <> -100 THEN (input_ids[i] % 7) / 10.0 ELSE 0.0 END)) AS s, len(list_filter(labels[2:], lambda x: x <> -100)) AS k FROM validation WHERE len(labels) = len(input_ids) AND len(labels) > 1) GROUP BY eval_split")
def masked_loss(spark, d):
    """Ids play log probabilities: each id's is minus a tenth of its remainder by 7."""
    v = table(spark, d, "validation").where("size(labels) = size(input_ids) and size(labels) > 1")
    v = v.select("eval_split", "labels", F.transform(F.slice("input_ids", 2, F.size("input_ids")), lambda x: -(x % 7) / F.lit(10.0)).alias("lp"))
    out = paired.masked_loss(v, "lp", "labels", "eval_split")
    return out.select("eval_split", F.round("loss_sum", 4).alias("loss_sum"), F.col("valid_tokens").cast("bigint").alias("valid_tokens"))


@query("SELECT record_id, coalesce(output, '') AS prediction, CAST(len(completion_ids) AS INT) AS generated FROM generation_health_2048_records WHERE len(completion_ids) > 0")
def nested_predictions(spark, d):
    """The only prediction of a list and the length of the only filled token list."""
    g = table(spark, d, _G).where(F.size("completion_ids") > 0)
    empty = F.array().cast("array<int>")
    return g.select("record_id", paired.prediction_text(F.array(F.coalesce("output", F.lit("")))).alias("prediction"), paired.generated_length(F.array(empty, F.col("completion_ids"), empty)).alias("generated"))


@query("SELECT source, CAST(len(completion_ids) AS INT) AS length, count(*) AS lists FROM generation_health_2048_records WHERE len(completion_ids) > 0 GROUP BY 1, 2")
def leaf_lengths(spark, d):
    g = table(spark, d, _G).select("source", F.array(F.array().cast("array<int>"), F.col("completion_ids")).alias("nested"))
    return paired.leaf_lengths(g, "nested", "source").groupBy("source", "length").agg(F.count(F.lit(1)).alias("lists"))


@query("WITH k AS (SELECT sample_id, row_number() OVER (ORDER BY sha256('independent-sft-v1:' || sample_id), sample_id) <= 200 AS held FROM (SELECT DISTINCT sample_id FROM train WHERE sample_id IS NOT NULL)) SELECT sample_id, CASE WHEN held THEN 'validation' ELSE 'train' END AS split FROM k")
def written_splits(spark, d):
    """Splits written in order, one folder each, and read back."""
    ids = table(spark, d, "train").select("sample_id").where("sample_id is not null").distinct()
    path = runtime.scratch(spark, "splits")
    files.write_splits(audit.hash_split(ids, "sample_id", aq.SETTINGS.salt, 200), path, ["split_key", "sample_id"])
    return spark.read.schema("sample_id string, split_key string, split string").json(path).select("sample_id", "split")


@query("SELECT count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS ids, count(DISTINCT event_id) AS different FROM events")
def consumed_once(spark, d):
    """A stream of several micro-batches consumed into batch folders: every event once."""
    from millrace.streaming.exactly_once import consume

    source, out, state = (runtime.scratch(spark, n) for n in ("stream", "consumed", "consumed-state"))
    e = table(spark, d, "events").select("event_id")
    e.repartition(4).write.parquet(source)
    stream = spark.readStream.schema("event_id bigint").option("maxFilesPerTrigger", 1).parquet(source)
    consume(stream, out, state).awaitTermination()
    return spark.read.schema("event_id bigint, batch int").parquet(out).agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("ids"), F.countDistinct("event_id").alias("different"))


@query("SELECT count(*) FILTER (value IS NOT NULL) > 0 AS finite, CAST(2 AS BIGINT) AS train_rows, CAST(3 AS BIGINT) AS validation_rows, count(*) FILTER (value IS NOT NULL) > 0 AS passed FROM events")
def preflight_gate(spark, d):
    """A log of two training steps and three validations whose losses are the table's mean value."""
    e = table(spark, d, "events").agg(F.avg("value").cast("double").alias("mean_loss"))
    steps = [("train", 1), ("train", 2), ("validation", 0), ("validation", 1), ("validation", 2)]
    log = e.select("mean_loss", F.explode(F.array(*[F.struct(F.lit(k).alias("event"), F.lit(s).alias("optimizer_step")) for k, s in steps])).alias("x")).select("mean_loss", "x.*")
    return gates.preflight(log).select("finite", "train_rows", "validation_rows", "passed")


@query("SELECT unnest(['max_steps must be positive where given', 'run_name must not be empty', 'warmup_ratio must lie in [0, 1)']) AS problem")
def config_problems(spark, d):
    """Every fault of a configuration at once."""
    values = {"run_name": " ", "max_steps": 0, "warmup_ratio": 1, "seed": 3, "dtype": "float32"}
    return spark.createDataFrame([(x,) for x in provenance.config_errors(values)], "problem string")
