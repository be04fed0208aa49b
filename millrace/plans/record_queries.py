"""Queries over tokenized records, raw lines and conversations, and the star schema's scans."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators import audit, paired, provenance, sampling, shaping
from millrace.plans.registry import query
from millrace.runtime import table

_KEY = "sample_id, CAST(metadata.row_index AS BIGINT) AS row_index"


def _records(spark, d):
    return table(spark, d, "train").select("sample_id", F.col("metadata.row_index").alias("row_index"), "input_ids", "labels", "metadata")


@query(
    """SELECT error, count(*) AS n FROM (SELECT CASE WHEN sample_id IS NULL OR trim(sample_id) = '' THEN 'sample_id must be a non-empty string' WHEN input_ids IS NULL OR len(input_ids) = 0 THEN 'input_ids must not be empty'
    WHEN labels IS NULL OR len(labels) <> len(input_ids) THEN 'labels must match input_ids' WHEN len(list_filter(input_ids, lambda x: x IS NULL)) > 0 THEN 'input_ids must hold integers' WHEN len(list_filter(labels, lambda x: x IS NULL)) > 0 THEN 'labels must hold integers'
    WHEN len(list_filter(labels[2:], lambda x: x <> -100)) = 0 THEN 'no supervised label' ELSE 'valid' END AS error FROM train) GROUP BY error"""
)
def record_validation(spark, d):
    return _records(spark, d).select(F.coalesce(audit.validation_error(), F.lit("valid")).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {_KEY}, CAST(len(list_filter(labels[2:], lambda x: x <> -100)) AS INT) AS supervised, metadata.supervised_tokens AS stored FROM train WHERE labels IS NOT NULL AND metadata IS NOT NULL")
def supervised_token_count(spark, d):
    r = _records(spark, d).where("labels is not null and metadata is not null")
    return r.select("sample_id", "row_index", shaping.supervised_tokens(F.col("labels")).alias("supervised"), F.col("metadata.supervised_tokens").alias("stored"))


@query(f"SELECT {_KEY}, CAST(list_sum(list_transform(labels, lambda x: CASE WHEN x <> -100 THEN 1 ELSE 0 END)) AS BIGINT) AS ones FROM train WHERE len(labels) > 0")
def completion_mask(spark, d):
    ones = F.aggregate(shaping.completion_mask(F.col("labels")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return _records(spark, d).where(F.size("labels") > 0).select("sample_id", "row_index", ones.alias("ones"))


@query(f"SELECT {_KEY}, array_to_string(list_transform(generate_series(1, len(input_ids)), lambda i: CASE WHEN labels[i] <> -100 THEN input_ids[i] ELSE -100 END), ',') AS labels FROM train WHERE len(input_ids) = len(labels) AND len(list_filter(labels, lambda x: x <> -100)) > 0")
def masked_labels(spark, d):
    """Records with an assistant token; the operator raises for others."""
    r = _records(spark, d).where((F.size("input_ids") == F.size("labels")) & F.exists("labels", lambda x: x != -100))
    made = shaping.masked_labels(F.col("input_ids"), F.transform("labels", lambda x: x != -100))
    return r.select("sample_id", "row_index", F.array_join(made.cast("array<string>"), ",").alias("labels"))


@query(
    """WITH g AS (SELECT record_id, prompt, output, string_split(trim(regexp_replace(lower(output), '[ \\t\\n\\r\\f]+', ' ', 'g')), ' ') AS w FROM generation_health_2048_records WHERE output IS NOT NULL AND trim(regexp_replace(output, '[ \\t\\n\\r\\f]+', ' ', 'g')) <> ''),
    s AS (SELECT record_id, len(w) AS n, len(w) // 3 AS p FROM g)
    SELECT record_id, CAST(n + 1 - p AS INT) AS supervised, CAST(p AS INT) AS ignored FROM s""".replace("\\\\", "\\")
)
def assistant_labels(spark, d):
    """Word lengths play ids: a third is the prompt, an end token follows the answer."""
    from millrace.functions import text as tx

    g = table(spark, d, "generation_health_2048_records").where("output is not null")
    ids = F.transform(tx.split_words(tx.normalized_portable(F.col("output"))), lambda w: F.length(w) + 10)
    r = g.select("record_id", ids.alias("ids")).where(F.size("ids") > 0)
    prompt = F.slice("ids", 1, F.floor(F.size("ids") / 3).cast("int"))
    labels = shaping.assistant_labels(F.concat("ids", F.array(F.lit(1))), prompt, 1)
    r = r.select("record_id", labels.alias("labels"))
    return r.select("record_id", F.size(F.filter("labels", lambda x: x != -100)).alias("supervised"), F.size(F.filter("labels", lambda x: x == -100)).alias("ignored"))


@query(
    """WITH b AS (SELECT record_id, record_id // 16 AS batch, completion_ids AS ids FROM generation_health_2048_records WHERE len(completion_ids) > 0), w AS (SELECT batch, max(len(ids)) AS width FROM b GROUP BY batch)
    SELECT record_id, batch, CAST(width AS INT) AS width, CAST(len(ids) AS INT) AS attended, array_to_string(list_concat(ids, list_transform(generate_series(1, width - len(ids)), lambda i: 0)), ',') AS input_ids FROM b JOIN w USING (batch)"""
)
def collate_pad(spark, d):
    g = table(spark, d, "generation_health_2048_records").where(F.size("completion_ids") > 0)
    rows = g.select("record_id", F.floor(F.col("record_id") / 16).alias("batch"), F.col("completion_ids").alias("input_ids"), F.col("completion_ids").alias("labels"))
    out = shaping.collate(rows, "batch")
    attended = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return out.select("record_id", "batch", F.size("input_ids").alias("width"), attended.alias("attended"), F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"))


_ORDER = "o AS (SELECT sample_id, row_number() OVER (ORDER BY sha256('8:' || sample_id), sample_id) - 1 AS position FROM (SELECT DISTINCT sample_id FROM train WHERE sample_id IS NOT NULL))"


def _epoch(spark, d):
    ids = table(spark, d, "train").select("sample_id").where("sample_id is not null").distinct()
    return shaping.global_positions(ids, [shaping.epoch_order(F.col("sample_id"), 7, 1), F.col("sample_id")])


@query(f"WITH {_ORDER} SELECT sample_id, CAST(position AS BIGINT) AS position, CAST(position // 4 AS BIGINT) AS micro_batch, CAST(position // 32 AS BIGINT) AS optimizer_step FROM o")
def optimizer_step_batches(spark, d):
    micro, step = shaping.steps(F.col("position"), 4, 8)
    return _epoch(spark, d).select("sample_id", "position", micro.alias("micro_batch"), step.alias("optimizer_step"))


@query(f"WITH {_ORDER} SELECT sample_id, CAST(position AS BIGINT) AS position FROM o WHERE position >= 500")
def hash_shuffle_resume(spark, d):
    return _epoch(spark, d).where("position >= 500").select("sample_id", "position")


@query("SELECT row_index // 64 AS optimizer_step, CAST(sum(len(list_filter(labels[2:], lambda x: x <> -100))) AS BIGINT) AS supervised FROM (SELECT CAST(metadata.row_index AS BIGINT) AS row_index, labels FROM train) WHERE labels IS NOT NULL AND row_index IS NOT NULL GROUP BY 1")
def supervised_per_step(spark, d):
    """Labels that count after the shift, per optimizer step of 64 records."""
    r = _records(spark, d).where("labels is not null and row_index is not null")
    return r.groupBy(F.floor(F.col("row_index") / 64).alias("optimizer_step")).agg(F.sum(shaping.supervised_tokens(F.col("labels"))).alias("supervised"))


@query("SELECT record_id, CAST(i - 1 AS INT) AS position, CASE WHEN id = 50001 THEN 'eos' ELSE 'pad' END AS name, label FROM (SELECT record_id, unnest(completion_ids) AS id, unnest(completion_ids) AS label, unnest(generate_series(1, len(completion_ids))) AS i FROM generation_health_2048_records) WHERE id IN (50001, 50000)")
def special_positions(spark, d):
    g = table(spark, d, "generation_health_2048_records")
    return shaping.special_positions(g, "record_id", "completion_ids", "completion_ids", {"eos": 50001, "pad": 50000})


@query("SELECT sample_id, region, count(*) AS n FROM (SELECT sample_id, CASE WHEN i - 1 < p THEN 'prompt' WHEN i - 1 <= 40 THEN 'assistant' ELSE 'trailing' END AS region FROM (SELECT sample_id, len(list_filter(labels, lambda x: x = -100)) AS p, unnest(generate_series(1, len(input_ids))) AS i FROM validation)) GROUP BY 1, 2")
def token_regions(spark, d):
    v = table(spark, d, "validation").select("sample_id", "input_ids", F.size(F.filter("labels", lambda x: x == -100)).alias("p"), F.lit(40).alias("e"))
    return shaping.token_regions(v, "sample_id", "input_ids", "p", "e").groupBy("sample_id", "region").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, count(*) AS messages, string_agg(event_type || ':' || CAST(event_id AS VARCHAR), ' ' ORDER BY ts, event_id) AS rendered FROM events GROUP BY user_id")
def messages_assembly(spark, d):
    """Events of a user play the turns of a conversation."""
    e = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("order"), F.col("event_type").alias("role"), F.col("event_id").cast("string").alias("text"))
    out = shaping.assemble_messages(e, "user_id", "order", "role", "text")
    rendered = F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), " ")
    return out.select("user_id", F.size("messages").cast("bigint").alias("messages"), rendered.alias("rendered"))


@query("SELECT review_index, sha256('<|im_start|>user\n' || problem || '<|im_end|>\n<|im_start|>assistant\n' || generation || '<|im_end|>\n') AS rendered_sha256 FROM review_samples WHERE problem IS NOT NULL AND generation IS NOT NULL")
def chatml_render(spark, d):
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    r = table(spark, d, "review_samples").where("problem is not null and generation is not null")
    return r.select("review_index", F.sha2(shaping.chatml(F.array(message("user", "problem"), message("assistant", "generation"))), 256).alias("rendered_sha256"))


@query("SELECT 'checkpoint-' || CAST(o_orderkey AS VARCHAR) AS name, o_orderkey AS step FROM orders ORDER BY o_orderkey DESC LIMIT 5")
def checkpoint_retention(spark, d):
    names = table(spark, d, "orders").select(F.concat(F.lit("checkpoint-"), F.col("o_orderkey").cast("string")).alias("name"))
    return provenance.retained_checkpoints(names, 5)


@query("SELECT event_id, round((value - avg(value) OVER w) / (coalesce(stddev_samp(value) OVER w, 0.0) + 1e-4), 6) AS advantage, coalesce(stddev_samp(value) OVER w, 0.0) = 0 AS zero_std FROM events WINDOW w AS (PARTITION BY user_id)")
def group_advantage(spark, d):
    value, flat = shaping.advantage("value", "user_id")
    return table(spark, d, "events").select("event_id", F.round(value, 6).alias("advantage"), flat.alias("zero_std"))


@query("SELECT count(*) AS lines, count(*) FILTER (trim(line) = '') AS blank, count(*) FILTER (CASE WHEN json_valid(line) THEN json_type(line) = 'OBJECT' ELSE false END) AS objects, count(*) FILTER (CASE WHEN json_valid(line) THEN json_extract_string(line, '$.answer') IS NULL ELSE false END) AS no_answer FROM raw_lines WHERE line IS NOT NULL")
def raw_line_scan(spark, d):
    r = table(spark, d, "raw_lines").where("line is not null").withColumn("r", F.try_parse_json("line"))
    is_object = F.coalesce(F.schema_of_variant("r").startswith("OBJECT"), F.lit(False))
    answer = F.try_variant_get("r", "$.answer", "string")
    return r.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.trim("line") == "").alias("blank"), F.count_if(is_object).alias("objects"), F.count_if(F.col("r").isNotNull() & answer.isNull()).alias("no_answer"))


@query("SELECT source, count(*) AS n, count(*) FILTER (m IS NULL) AS no_metadata, count(DISTINCT sample_id) AS ids FROM (SELECT sample_id, metadata AS m, coalesce(metadata.source, 'unknown') AS source FROM train) GROUP BY source")
def manifest_rows(spark, d):
    t = table(spark, d, "train").select("sample_id", "metadata", F.coalesce("metadata.source", F.lit("unknown")).alias("source"))
    return t.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("metadata").isNull()).alias("no_metadata"), F.countDistinct("sample_id").alias("ids"))


@query("SELECT a.sample_id, 'token_count' AS field FROM (SELECT sample_id, max(metadata.token_count) AS x FROM train WHERE sample_id IS NOT NULL GROUP BY 1) a JOIN (SELECT sample_id, max(metadata.token_count) AS y FROM validation WHERE sample_id IS NOT NULL GROUP BY 1) b USING (sample_id) WHERE x IS DISTINCT FROM y")
def manifest_mismatch(spark, d):
    """Frozen fields of records that both splits hold."""
    side = lambda t: table(spark, d, t).where("sample_id is not null").groupBy("sample_id").agg(F.max("metadata.token_count").alias("token_count"))
    return paired.manifest_mismatches(side("train"), side("validation"), "sample_id", ["token_count"]).where("field != 'missing'")


@query("SELECT sample_id FROM (SELECT DISTINCT sample_id FROM validation WHERE sample_id IS NOT NULL) ORDER BY sha256('42|' || sample_id), sample_id LIMIT 50")
def hash_priority_subset(spark, d):
    ids = table(spark, d, "validation").select("sample_id").where("sample_id is not null").distinct()
    ids = ids.withColumn("priority", sampling.hash_priority(F.lit("42"), F.col("sample_id")))
    return sampling.lowest(ids, 50, tie="sample_id").select("sample_id")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def scan_aggregate(spark, d):
    x = table(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def star_join(spark, d):
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.countDistinct("o_orderkey").alias("orders"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("SELECT o_custkey, o_orderkey, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def top_per_group(spark, d):
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, d, "orders").withColumn("rank", rank).where("rank <= 3").select("o_custkey", "o_orderkey", "rank")
