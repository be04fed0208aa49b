"""The queries of the training-data operators, by name, and SQL for those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import runtime
from millrace.llm import crosssplit, encoding, formatting, leakage, ledger, lookalike, mixing, packing, pairdefects, truncation
from millrace.runtime import table


def _formatted_tables(spark: SparkSession, d: str) -> list[tuple]:
    return [
        ("review_samples", table(spark, d, "review_samples"), "review_index", "problem", "text"),
        ("rejected", table(spark, d, "rejected"), "reject_id", "problem_hash", "text"),
        ("raw_lines", table(spark, d, "raw_lines"), "line_id", "line", "json"),
    ]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting.table_copies(_formatted_tables(spark, d))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return formatting.table_groups(_formatted_tables(spark, d))


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.split_overlaps(table(spark, d, "train"), table(spark, d, "validation"), table(spark, d, "review_samples"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.unordered_pairs(_overlaps(spark, d))


def p2_overlap_counts(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.overlap_counts(_overlaps(spark, d), table(spark, d, "validation"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    tables = [
        ("review_samples", table(spark, d, "review_samples"), "review_index", "problem", "generation"),
        ("generation_health_2048_records", table(spark, d, "generation_health_2048_records"), "record_id", "prompt", "output"),
    ]
    return pairdefects.defects(pairdefects.pair_rows(tables))


def _leak_tables(spark: SparkSession, d: str) -> tuple:
    return table(spark, d, "review_samples"), "review_index", ["problem", "generation"], table(spark, d, "eval_suites"), "item_id", "problem"


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(leakage.leaks(*_leak_tables(spark, d))).select("item_id", F.col("row_id").alias("review_index"))


def p4_covered(spark: SparkSession, d: str) -> DataFrame:
    """Items whose tiles cover four fifths of their words, in whatever order they stand."""
    found = leakage.covered_items(*_leak_tables(spark, d))
    return found.select("item_id", F.col("row_id").alias("review_index"), "field", "item_words", "covered", "tiles")


def p4_leak_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(leakage.leaks(*_leak_tables(spark, d)))


LEDGER_RATE = 0.1


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    """The ledger kept from earlier calls, grown to the quota of all rows, and kept again.

    Where none is kept, two rounds: the first on an earlier snapshot, the second on all rows.
    """
    train, path = table(spark, d, "train"), f"{d}/train.parquet"
    earlier = ledger.load(train, "p5_sample", path)
    if earlier is None:
        earlier = runtime.written(ledger.grow(ledger.two_deliveries(train, "recorded_at"), None, LEDGER_RATE), "ledger")
    kept = ledger.save(ledger.grow(train, earlier, LEDGER_RATE), "p5_sample", path)
    return kept.select(F.col("key").alias("sample_id"), F.col("priority"), F.col("round").cast("bigint").alias("round"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.scores(table(spark, d, "generation_health_2048_records")).where("truncated").select(F.col("id").alias("record_id"))


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(truncation.scores(table(spark, d, "generation_health_2048_records"), source_col="source"))


def p7_sequences(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "train"))


def p7_training_sequences(spark: SparkSession, d: str) -> DataFrame:
    """The packed sequences with their ids, labels and segment numbers."""
    train = table(spark, d, "train")
    return packing.materialize(train, packing.pack(train))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    train = table(spark, d, "train")
    return packing.pack_report(train, packing.pack(train))


def p7_invalid(spark: SparkSession, d: str) -> DataFrame:
    """Records that are in no sequence, by reason."""
    train = table(spark, d, "train").select(packing.reason().alias("reason"))
    return train.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "ids")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    chosen, _ = mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return chosen.select(F.col("id").alias("doc_id"), "source", "tokens", "repeats")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(lookalike.one_form(table(spark, d, "documents"), "doc_id", "text"))


def p10_groups(spark: SparkSession, d: str) -> DataFrame:
    """p10_found in compact form: each affected document with the least id of its form."""
    return lookalike.lookalike_groups(lookalike.one_form(table(spark, d, "documents"), "doc_id", "text"))


def p10_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """How many tokens the vocabulary decides."""
    return lookalike.vocabulary_report(table(spark, d, "documents"), "doc_id", "text")


def p10_text(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.one_form(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), F.col("canonical").alias("text"))


QUERIES = {name: f for name, f in list(globals().items()) if name[0] == "p" and name[1].isdigit() and callable(f)}

_CANON = r"upper(replace(lower(regexp_replace({0}, '[\p{{P}}\s\p{{Z}}\x0b\x1c-\x1f\x85]+', '', 'g')), 'ß', 'ss'))"
_FORMS = rf"""
    WITH fields AS (SELECT line_id, line, unnest(json_keys(line)) AS k FROM raw_lines WHERE CASE WHEN json_valid(line) THEN json_type(line) = 'OBJECT' ELSE false END),
    shown AS (SELECT line_id, k, CASE json_type(line -> k) WHEN 'NULL' THEN 'n' WHEN 'VARCHAR' THEN 's' || {_CANON.format('(line ->> k)')} ELSE 'j' || CAST(line -> k AS VARCHAR) END AS v FROM fields),
    forms AS (
        SELECT 'review_samples' AS table_name, review_index AS id, {_CANON.format('problem')} AS form FROM review_samples
        UNION ALL SELECT 'rejected', reject_id, {_CANON.format('problem_hash')} FROM rejected
        UNION ALL SELECT 'raw_lines', line_id, CASE WHEN bool_or(v NOT IN ('s', 'n')) THEN string_agg(k || chr(31) || v, chr(30) ORDER BY k) END FROM shown GROUP BY line_id),
    firsts AS (SELECT table_name, form, min(id) AS first_id, count(*) AS copies FROM forms WHERE form <> '' GROUP BY table_name, form)
"""
_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_WINDOWS = "{0}, i AS {1}, array_to_string(w[i:i+7], ' ') AS gram FROM {2}, LATERAL (SELECT unnest(generate_series(1, len(w) - 7)) AS i) WHERE len(w) >= 8"

ORACLES = {
    "p1_found": _FORMS + "SELECT table_name, first_id, id AS copy_id FROM forms JOIN firsts USING (table_name, form) WHERE id <> first_id",
    "p1_groups": _FORMS + "SELECT table_name, first_id, copies FROM firsts",
    "p4_found": f"""
        WITH t AS (SELECT review_index, f, {_WORDS.format('x')} AS w FROM (SELECT review_index, 'p' AS f, problem AS x FROM review_samples UNION ALL SELECT review_index, 'g', generation FROM review_samples) WHERE x IS NOT NULL),
        e AS (SELECT item_id, {_WORDS.format('problem')} AS w FROM eval_suites WHERE problem IS NOT NULL),
        g AS (SELECT {_WINDOWS.format('review_index, f', 'p', 't')}), ig AS (SELECT {_WINDOWS.format('item_id', 'q', 'e')}),
        m AS (SELECT review_index, f, item_id, p - q AS d, p FROM g JOIN ig USING (gram)),
        r AS (SELECT *, p - row_number() OVER (PARTITION BY review_index, f, item_id, d ORDER BY p) AS island FROM m),
        runs AS (SELECT review_index, f, item_id, min(p) AS s, max(p) + 7 AS e FROM r GROUP BY review_index, f, item_id, d, island)
        SELECT DISTINCT item_id, review_index FROM runs a WHERE NOT EXISTS (SELECT 1 FROM runs b WHERE b.review_index = a.review_index AND b.f = a.f AND b.item_id <> a.item_id AND b.s <= a.s AND b.e >= a.e)
    """,
    "p5_sample": """
        WITH span AS (SELECT min(recorded_at) AS a, max(recorded_at) AS b FROM train),
        cut AS (SELECT a + to_microseconds(CAST(round((epoch_us(b) - epoch_us(a)) * 0.8) AS BIGINT)) AS at FROM span),
        k1 AS (SELECT DISTINCT sample_id FROM train, cut WHERE sample_id IS NOT NULL AND recorded_at <= cut.at),
        r1 AS (SELECT sample_id, row_number() OVER (ORDER BY sha256('ledger-v1:' || sample_id), sample_id) AS rn FROM k1),
        s1 AS (SELECT sample_id FROM r1 WHERE rn <= (SELECT ceil(round(count(*) * 0.1, 9)) FROM k1)),
        k2 AS (SELECT DISTINCT sample_id FROM train WHERE sample_id IS NOT NULL),
        r2 AS (SELECT sample_id, row_number() OVER (ORDER BY sha256('ledger-v1:' || sample_id), sample_id) AS rn FROM k2 WHERE sample_id NOT IN (SELECT sample_id FROM s1)),
        s2 AS (SELECT sample_id FROM r2 WHERE rn <= (SELECT ceil(round(count(*) * 0.1, 9)) FROM k2) - (SELECT count(*) FROM s1))
        SELECT sample_id, sha256('ledger-v1:' || sample_id) AS priority, CAST(1 AS BIGINT) AS round FROM s1
        UNION ALL SELECT sample_id, sha256('ledger-v1:' || sample_id), CAST(2 AS BIGINT) FROM s2
    """,
    "p7_invalid": """
        SELECT reason, count(*) AS records FROM (
            SELECT CASE WHEN sample_id IS NULL OR trim(sample_id) = '' THEN 'missing_id'
                        WHEN input_ids IS NULL OR labels IS NULL THEN 'null_list'
                        WHEN len(input_ids) = 0 THEN 'empty_ids'
                        WHEN len(input_ids) <> len(labels) THEN 'length_mismatch'
                        WHEN len(list_filter(input_ids, lambda x: x IS NULL)) + len(list_filter(labels, lambda x: x IS NULL)) > 0 THEN 'null_element'
                        WHEN len(list_filter(labels[2:], lambda x: x <> -100)) = 0 THEN 'no_supervision' END AS reason
            FROM train) WHERE reason IS NOT NULL GROUP BY reason
    """,
}
