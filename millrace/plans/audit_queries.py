"""Queries of the dataset audit.

The review table plays the source rows: its problem and generation are the messages, and its
issues say whether verification and reasoning passed. eval_suites plays the evaluation suites.
Token counts are blank-separated words of the generation.

Queries ending in _strict do the whole job with the reference's normal form (NFKC, case folding,
Unicode blanks), which SQL cannot express. Those of the same name without the ending run on the
portable form, so that SQL can check the plan; they miss what only the strict form makes equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import audit, provenance
from millrace.plans.registry import query
from millrace.runtime import table

SETTINGS = audit.AuditSettings(validation_size=100, max_tokens=200)
_NORM = "trim(regexp_replace(lower({0}), '[ \\t\\n\\r\\f]+', ' ', 'g'))"
_BLANK = "({0} IS NULL OR regexp_replace({0}, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+', '', 'g') = '')"


def source_rows(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "review_samples")
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    lacks = lambda issue: ~F.coalesce(F.array_contains("issues", issue), F.lit(False))
    return r.select(
        F.col("review_index").alias("row_index"), "problem", F.array(message("user", "problem"), message("assistant", "generation")).alias("messages"), F.array("generation").alias("generations"),
        F.array(lacks("math_verify_failed")).alias("correctness_math_verify"), F.array(lacks("incomplete_reasoning")).alias("is_reasoning_complete"), "source", "uuid",
    )


def audited(spark: SparkSession, d: str, strict: bool = False) -> DataFrame:
    generation = F.get(F.col("generations"), F.lit(0))
    tokens = tx.blank_separated(generation) if strict else F.size(tx.split_words(tx.normalized_portable(generation)))
    return audit.audit(source_rows(spark, d), table(spark, d, "eval_suites"), SETTINGS, tokens, strict)


_SUITE = f"suite AS (SELECT DISTINCT suite, {_NORM.format('problem')} AS norm FROM eval_suites WHERE problem IS NOT NULL)"
_GRAMS = "SELECT DISTINCT {key}, array_to_string(w[i:i+7], ' ') AS gram FROM (SELECT {key}, string_split(norm, ' ') AS w FROM {rel} WHERE norm <> ''), LATERAL (SELECT unnest(generate_series(1, len(w) - 7)) AS i) WHERE len(w) >= 8"
_AUDIT = rf"""
WITH src AS (
    SELECT review_index AS row_index, problem, generation AS g, coalesce(source, 'unknown') AS source,
        NOT coalesce(list_contains(issues, 'math_verify_failed'), false) AS verified,
        NOT coalesce(list_contains(issues, 'incomplete_reasoning'), false) AS complete
    FROM review_samples),
tags AS (
    SELECT row_index, bool_and(run >= 0) AND max(last_run) = 0 AS balanced FROM (
        SELECT row_index, run, CASE WHEN i = n THEN run ELSE 0 END AS last_run FROM (
            SELECT row_index, i, n, sum(CASE WHEN tag = '<think>' THEN 1 ELSE -1 END) OVER (PARTITION BY row_index ORDER BY i) AS run FROM (
                SELECT row_index, unnest(t) AS tag, unnest(generate_series(1, len(t))) AS i, len(t) AS n
                FROM (SELECT row_index, regexp_extract_all(g, '</?think>') AS t FROM src WHERE g IS NOT NULL))))
    GROUP BY row_index),
shaped AS (
    SELECT src.*, {_NORM.format('problem')} AS norm,
        concat_ws(',', CASE WHEN {_BLANK.format('problem')} THEN 'empty_problem' END, CASE WHEN {_BLANK.format('g')} THEN 'invalid_messages' END) AS shape,
        CASE WHEN NOT verified THEN 'math_verify_failed' WHEN NOT complete THEN 'incomplete_reasoning'
             WHEN NOT coalesce(tags.balanced, false) THEN 'unclosed_think_tags'
             WHEN NOT contains(g, '\boxed{{') THEN 'missing_boxed_answer' END AS issue
    FROM src LEFT JOIN tags USING (row_index)),
elig AS (SELECT *, sha256(norm) AS sample_id, CASE WHEN {_NORM.format('g')} = '' THEN 0 ELSE len(string_split({_NORM.format('g')}, ' ')) END AS token_count FROM shaped WHERE shape = '' AND issue IS NULL),
{_SUITE},
exact AS (SELECT row_index, string_agg(DISTINCT 'evaluation_exact_match:' || suite, ',' ORDER BY 'evaluation_exact_match:' || suite) AS reasons FROM elig JOIN suite USING (norm) GROUP BY row_index),
rest AS (SELECT row_index, norm FROM elig WHERE row_index NOT IN (SELECT row_index FROM exact)),
rg AS ({_GRAMS.format(key='row_index', rel='rest')}),
sg AS ({_GRAMS.format(key='suite', rel='suite')}),
overlap AS (SELECT row_index, string_agg(DISTINCT 'evaluation_8gram_overlap:' || suite, ',' ORDER BY 'evaluation_8gram_overlap:' || suite) AS reasons FROM rg JOIN sg USING (gram) GROUP BY row_index),
cont AS (SELECT * FROM exact UNION ALL SELECT * FROM overlap),
joined AS (SELECT elig.*, reasons, reasons IS NULL AND token_count <= 200 AS ok FROM elig LEFT JOIN cont USING (row_index)),
placed AS (SELECT *, min(CASE WHEN ok THEN row_index END) OVER (PARTITION BY sample_id) AS first_ok FROM joined),
audited AS (
    SELECT shaped.row_index, placed.sample_id, shaped.source, placed.token_count,
        CASE WHEN shaped.shape <> '' THEN shaped.shape WHEN shaped.issue IS NOT NULL THEN shaped.issue
             WHEN shaped.row_index > first_ok THEN 'duplicate_problem' WHEN reasons IS NOT NULL THEN reasons
             WHEN NOT (placed.token_count <= 200) THEN 'over_max_length' ELSE '' END AS issues
    FROM shaped LEFT JOIN placed USING (row_index))
"""


@query(_AUDIT + "SELECT row_index, sample_id, source, CAST(token_count AS BIGINT) AS token_count, issues FROM audited")
def audit_rows(spark, d):
    """Every source row with its issues."""
    return _audit_rows(audited(spark, d))


@query()
def audit_rows_strict(spark, d):
    return _audit_rows(audited(spark, d, strict=True))


def _audit_rows(rows):
    return rows.select("row_index", "sample_id", "source", F.col("token_count").cast("bigint").alias("token_count"), F.array_join("issues", ",").alias("issues"))


@query(_AUDIT + "SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(issues, ',')) AS reason FROM audited WHERE issues <> '') GROUP BY reason")
def reason_counts(spark, d):
    return audit.reason_counts(audited(spark, d))


@query()
def reason_counts_strict(spark, d):
    return audit.reason_counts(audited(spark, d, strict=True))


@query(_AUDIT + "SELECT source, count(*) AS n, count(*) FILTER (issues = '') AS accepted FROM audited GROUP BY source")
def audit_by_source(spark, d):
    return _by_source(audited(spark, d))


@query()
def audit_by_source_strict(spark, d):
    return _by_source(audited(spark, d, strict=True))


def _by_source(rows):
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("accepted"))


@query(
    _AUDIT
    + """SELECT count(*) AS rows, count(*) FILTER (issues = '') AS accepted, count(*) FILTER (issues <> '') AS rejected,
    count(*) FILTER (issues = '') AS tokens_count, CAST(min(token_count) FILTER (issues = '') AS INT) AS tokens_min, CAST(quantile_disc(token_count, 0.5) FILTER (issues = '') AS INT) AS tokens_p50,
    CAST(quantile_disc(token_count, 0.95) FILTER (issues = '') AS INT) AS tokens_p95, CAST(quantile_disc(token_count, 0.99) FILTER (issues = '') AS INT) AS tokens_p99,
    CAST(max(token_count) FILTER (issues = '') AS INT) AS tokens_max, round(avg(token_count) FILTER (issues = ''), 6) AS tokens_mean FROM audited"""
)
def audit_manifest(spark, d):
    return provenance.audit_manifest(audited(spark, d))


@query()
def audit_manifest_strict(spark, d):
    return provenance.audit_manifest(audited(spark, d, strict=True))


@query(
    _AUDIT
    + """, keyed AS (SELECT *, sha256(concat_ws(':', 'independent-sft-v1', 'review', coalesce(sample_id, 'missing'), CAST(row_index AS VARCHAR))) AS review_key FROM audited),
    picked AS (SELECT 'accepted' AS section, 'accepted' AS reason, row_index, review_key FROM keyed WHERE issues = ''
        UNION ALL SELECT 'rejected', unnest(string_split(issues, ',')), row_index, review_key FROM keyed WHERE issues <> ''),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY section, reason ORDER BY review_key, row_index) AS rank FROM picked)
    SELECT section, reason, CAST(rank AS INT) AS rank, row_index FROM ranked WHERE rank <= CASE WHEN section = 'accepted' THEN 20 ELSE 3 END"""
)
def review_topk_per_reason(spark, d):
    return audit.review_sample(audited(spark, d), SETTINGS).select("section", "reason", "rank", "row_index")


@query()
def review_topk_per_reason_strict(spark, d):
    return audit.review_sample(audited(spark, d, strict=True), SETTINGS).select("section", "reason", "rank", "row_index")


@query(
    _AUDIT
    + """, keyed AS (SELECT sample_id, sha256('independent-sft-v1:' || sample_id) AS split_key FROM audited WHERE issues = '')
    SELECT sample_id, CASE WHEN row_number() OVER (ORDER BY split_key, sample_id) <= 100 THEN 'validation' ELSE 'train' END AS split FROM keyed"""
)
def audit_split(spark, d):
    return _split(audited(spark, d))


@query()
def audit_split_strict(spark, d):
    return _split(audited(spark, d, strict=True))


def _split(rows):
    accepted = rows.where("accepted").select("sample_id")
    return audit.hash_split(accepted, "sample_id", SETTINGS.salt, SETTINGS.validation_size).select("sample_id", "split")


@query(f"SELECT review_index, sha256({_NORM.format('problem')}) AS problem_hash FROM review_samples WHERE problem IS NOT NULL")
def normalize_hash(spark, d):
    return table(spark, d, "review_samples").where("problem is not null").select("review_index", audit.problem_hash(F.col("problem")).alias("problem_hash"))


@query()
def normalize_strict(spark, d):
    """The strict form (NFKC, case folding) against the stored hashes of accepted and rejected rows; as_stored is null where none is stored."""
    stored = F.coalesce("sample_id", "problem_hash")
    r = table(spark, d, "review_samples").where("problem is not null").select("review_index", audit.problem_hash(F.col("problem"), strict=True).alias("strict_hash"), stored.alias("stored"))
    return r.select("review_index", "strict_hash", (F.col("strict_hash") == F.col("stored")).alias("as_stored"))


@query()
def content_hash_strict(spark, d):
    """Hash of problem and generation in canonical JSON."""
    r = table(spark, d, "review_samples").where("problem is not null and generation is not null")
    return r.select("review_index", F.sha2(tx.canonical_pair_json("problem", "generation"), 256).alias("content_sha256"))


_DOCS = f"docs AS (SELECT doc_id, sha256({_NORM.format('text')}) AS h FROM documents WHERE text IS NOT NULL)"


@query(f"WITH {_DOCS} SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS first_id, doc_id > min(doc_id) OVER (PARTITION BY h) AS duplicate FROM docs")
def dedup_first_wins(spark, d):
    return _dedup(spark, d)


@query()
def dedup_first_wins_strict(spark, d):
    return _dedup(spark, d, strict=True)


def _dedup(spark, d, strict=False):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", audit.problem_hash(F.col("text"), strict).alias("h"))
    return audit.first_wins(docs, "h", "doc_id", F.lit(True), nullable=False).select("doc_id", F.col("first_ok").alias("first_id"), (F.col("doc_id") > F.col("first_ok")).alias("duplicate"))


@query(f"WITH {_DOCS} SELECT h AS problem_hash, count(*) AS n FROM docs GROUP BY h HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return _groups(spark, d)


@query()
def duplicate_groups_strict(spark, d):
    return _groups(spark, d, strict=True)


def _groups(spark, d, strict=False):
    docs = table(spark, d, "documents").where("text is not null").select(audit.problem_hash(F.col("text"), strict).alias("problem_hash"))
    return docs.groupBy("problem_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


_ROWS = f"rel AS (SELECT review_index, {_NORM.format('problem')} AS norm FROM review_samples WHERE problem IS NOT NULL)"


def _exact(spark, d, strict=False):
    """Exact matches alone: no n-gram is made."""
    form = tx.normalized_strict if strict else tx.normalized_portable
    base = table(spark, d, "review_samples").select(F.col("review_index").alias("k"), form(F.col("problem")).alias("norm")).where("norm is not null")
    suite = table(spark, d, "eval_suites").select("suite", form(F.col("problem")).alias("norm")).where("norm is not null" + (" and norm != ''" if strict else ""))
    return audit.exact_matches(base, suite).select(F.col("k").alias("review_index"), F.explode("reasons").alias("reason"))


def _contamination(spark, d, kind="", strict=False):
    found = audit.contamination(table(spark, d, "review_samples"), table(spark, d, "eval_suites"), "review_index", "problem", strict=strict)
    return found.select("review_index", F.explode("reasons").alias("reason")).where(F.col("reason").startswith(f"evaluation_{kind}"))


@query(f"WITH {_ROWS}, {_SUITE} SELECT DISTINCT review_index, 'evaluation_exact_match:' || suite AS reason FROM rel JOIN suite USING (norm)")
def decontaminate_exact(spark, d):
    return _exact(spark, d)


@query()
def decontaminate_exact_strict(spark, d):
    return _exact(spark, d, strict=True)


@query(
    f"WITH {_ROWS}, {_SUITE}, rg AS ({_GRAMS.format(key='review_index', rel='rel')}), sg AS ({_GRAMS.format(key='suite', rel='suite')}) "
    "SELECT DISTINCT review_index, 'evaluation_8gram_overlap:' || suite AS reason FROM rg JOIN sg USING (gram) WHERE review_index NOT IN (SELECT review_index FROM rel JOIN suite USING (norm))"
)
def decontaminate_8gram(spark, d):
    return _contamination(spark, d, "8gram")


@query()
def decontaminate_8gram_strict(spark, d):
    return _contamination(spark, d, "8gram", strict=True)


@query(
    f"WITH {_ROWS}, {_SUITE}, rg AS ({_GRAMS.format(key='review_index', rel='rel')}), sg AS ({_GRAMS.format(key='suite', rel='suite')}), "
    "exact AS (SELECT DISTINCT review_index, suite FROM rel JOIN suite USING (norm)), "
    "near AS (SELECT DISTINCT review_index, suite FROM rg JOIN sg USING (gram) WHERE review_index NOT IN (SELECT review_index FROM exact)) "
    "SELECT suite, count(*) FILTER (exact) AS exact_rows, count(*) FILTER (NOT exact) AS overlap_rows FROM (SELECT *, true AS exact FROM exact UNION ALL SELECT *, false FROM near) GROUP BY suite"
)
def contamination_by_suite(spark, d):
    return _by_suite(_contamination(spark, d))


@query()
def contamination_by_suite_strict(spark, d):
    return _by_suite(_contamination(spark, d, strict=True))


def _by_suite(r):
    exact = F.col("reason").startswith("evaluation_exact_match:")
    return r.groupBy(F.substring_index("reason", ":", -1).alias("suite")).agg(F.count_if(exact).alias("exact_rows"), F.count_if(~exact).alias("overlap_rows"))


@query(f"WITH rel AS (SELECT doc_id, {_NORM.format('text')} AS norm FROM documents), g AS ({_GRAMS.format(key='doc_id', rel='rel')}) SELECT doc_id, count(*) AS grams FROM g GROUP BY doc_id")
def word_ngrams_count(spark, d):
    grams = F.size(tx.ngrams(tx.split_words(tx.normalized_portable(F.col("text"))), 8))
    return table(spark, d, "documents").where("text is not null").select("doc_id", grams.cast("bigint").alias("grams")).where("grams > 0")


@query("SELECT sample_id, CASE WHEN row_number() OVER (ORDER BY sha256('independent-sft-v1:' || sample_id), sample_id) <= 200 THEN 'validation' ELSE 'train' END AS split FROM (SELECT DISTINCT sample_id FROM train WHERE sample_id IS NOT NULL)")
def hash_split(spark, d):
    ids = table(spark, d, "train").select("sample_id").where("sample_id is not null").distinct()
    return audit.hash_split(ids, "sample_id", SETTINGS.salt, 200).select("sample_id", "split")


@query("SELECT sample_id, CAST(metadata.row_index AS BIGINT) AS row_index FROM train WHERE sample_id NOT IN (SELECT sample_id FROM validation WHERE sample_id IS NOT NULL)")
def manual_exclusion_anti(spark, d):
    """validation plays the exclusion list."""
    kept = audit.manual_exclusion(table(spark, d, "train").select("sample_id", F.col("metadata.row_index").alias("row_index")), table(spark, d, "validation"))
    return kept.select("sample_id", "row_index").where("sample_id is not null")


@query("SELECT metadata.source AS source, count(*) FILTER (len(input_ids) <= 256) AS kept, count(*) FILTER (len(input_ids) > 256) AS dropped FROM train GROUP BY 1")
def length_filter(spark, d):
    n = F.size("input_ids")
    return table(spark, d, "train").groupBy(F.col("metadata.source").alias("source")).agg(F.count_if(n <= 256).alias("kept"), F.count_if(n > 256).alias("dropped"))


@query("SELECT review_index, coalesce(bool_and(run >= 0) AND max(CASE WHEN i = n THEN run ELSE 0 END) = 0, false) AS balanced FROM (SELECT review_index, i, n, sum(CASE WHEN tag = '<think>' THEN 1 ELSE -1 END) OVER (PARTITION BY review_index ORDER BY i) AS run FROM (SELECT review_index, unnest(t) AS tag, unnest(generate_series(1, len(t))) AS i, len(t) AS n FROM (SELECT review_index, regexp_extract_all(generation, '</?think>') AS t FROM review_samples WHERE generation IS NOT NULL))) GROUP BY review_index")
def think_balance(spark, d):
    r = table(spark, d, "review_samples").where("generation is not null and generation rlike '</?think>'")
    return r.select("review_index", audit.think_balanced(F.col("generation")).alias("balanced"))


@query("SELECT reject_id, source, token_count FROM rejected WHERE list_contains(issues, 'over_max_length')")
def rejected_over_length(spark, d):
    """Pruned scan of rejected rows: three columns."""
    return table(spark, d, "rejected").where(F.array_contains("issues", "over_max_length")).select("reject_id", "source", "token_count")


@query("SELECT issue AS reason, coalesce(source, 'unknown') AS source, count(*) AS n FROM (SELECT unnest(issues) AS issue, source FROM rejected) GROUP BY 1, 2")
def rejected_by_reason(spark, d):
    r = table(spark, d, "rejected").select(F.explode("issues").alias("reason"), F.coalesce("source", F.lit("unknown")).alias("source"))
    return r.groupBy("reason", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT status, coalesce(review_reason, 'none') AS reason, count(*) AS n, count(*) FILTER (NOT coalesce(status = 'accepted' OR list_contains(issues, review_reason), false)) AS bad_reason FROM review_samples GROUP BY 1, 2")
def review_bundle_check(spark, d):
    r = table(spark, d, "review_samples")
    ok = F.coalesce((F.col("status") == "accepted") | F.array_contains("issues", F.col("review_reason")), F.lit(False))
    return r.groupBy("status", F.coalesce("review_reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("bad_reason"))
