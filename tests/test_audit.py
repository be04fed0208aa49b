import pytest
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import audit, provenance

SCHEMA = "row_index bigint, problem string, messages array<struct<role:string,content:string>>, generations array<string>, correctness_math_verify array<boolean>, is_reasoning_complete array<boolean>, source string, uuid string"
GOOD = "<think>steps</think> The answer is \\boxed{4}."


def row(i, problem, generation=GOOD, verified=True, complete=True, messages=None, generations=None, correct=None, source="s"):
    m = messages if messages is not None else [("user", problem), ("assistant", generation)]
    g = generations if generations is not None else [generation]
    return (i, problem, m, g, [verified] * len(g) if correct is None else correct, [complete] * len(g), source, None)


def run(spark, rows, suites=(), tokens=None, **settings):
    df = spark.createDataFrame(rows, SCHEMA)
    s = spark.createDataFrame(list(suites), "suite string, problem string")
    cfg = audit.AuditSettings(**{"validation_size": 1, "ngram": 4} | settings)
    return audit.audit(df, s, cfg, F.lit(10) if tokens is None else tokens)


def issues(df):
    return {r.row_index: r.issues for r in df.collect()}


def test_six_rows(spark):
    suites = [("math500", "What is two plus two exactly")]
    rows = [row(0, "First problem here"), row(1, "Second problem here"), row(2, "  first   PROBLEM here "), row(3, "what is two plus two exactly"), row(4, "Third problem", verified=False), row(5, "Fourth problem")]
    df = run(spark, rows, suites)
    assert issues(df) == {0: [], 1: [], 2: ["duplicate_problem"], 3: ["evaluation_exact_match:math500"], 4: ["math_verify_failed"], 5: []}
    assert {r.reason: r.n for r in audit.reason_counts(df).collect()} == {"duplicate_problem": 1, "evaluation_exact_match:math500": 1, "math_verify_failed": 1}
    split = audit.hash_split(df.where("accepted"), "sample_id", "salt", 1)
    assert sorted(r["split"] for r in split.collect()) == ["train", "train", "validation"]
    sections = [r.section for r in audit.review_sample(df, audit.AuditSettings(validation_size=1)).collect()]
    assert sorted(sections) == ["accepted"] * 3 + ["rejected"] * 3
    again = run(spark, rows[::-1], suites).repartition(3)
    assert issues(again) == issues(df)


def test_reasons_in_order(spark):
    rows = [
        row(0, None), row(1, "  "), row(2, "p2", messages=[("user", "p2")]), row(3, "p3", messages=[("user", "p3"), ("assistant", " ")]), row(4, " ", messages=[]),
        (5, "p5", [("user", "p5"), ("assistant", GOOD)], None, [True], [True], "s", None), row(6, "p6", correct=[True, True]), row(7, "p7", generations=["other"]), row(8, "p8", correct=[None]), row(9, "p9", complete=False),
        row(10, "p10", "</think><think> \\boxed{1}"), row(11, "p11", "<think>a</think> no box"), row(12, "p12", source=None), row(13, "p13", "\\boxed{1}"),
    ]
    got = run(spark, rows)
    assert issues(got) == {
        0: ["empty_problem"], 1: ["empty_problem"], 2: ["invalid_messages"], 3: ["invalid_messages"], 4: ["empty_problem", "invalid_messages"], 5: ["invalid_generation_fields"], 6: ["generation_field_length_mismatch"],
        7: ["assistant_not_in_generations"], 8: ["math_verify_failed"], 9: ["incomplete_reasoning"], 10: ["unclosed_think_tags"], 11: ["missing_boxed_answer"], 12: [], 13: ["unclosed_think_tags"],
    }
    assert got.where("row_index = 12").first().source == "unknown"


def test_first_matching_generation_counts(spark):
    rows = [row(0, "p", generations=[GOOD, GOOD], correct=[True, False]), row(1, "q", generations=["x", GOOD], correct=[True, False])]
    assert issues(run(spark, rows)) == {0: [], 1: ["math_verify_failed"]}


def test_long_rows_do_not_claim_the_key(spark):
    rows = [row(0, "same problem"), row(1, "same problem"), row(2, "same problem")]
    tokens = F.when(F.col("row_index") == 0, 99).otherwise(5)
    assert issues(run(spark, rows, tokens=tokens, max_tokens=50)) == {0: ["over_max_length"], 1: [], 2: ["duplicate_problem"]}


def test_tokenization_errors_do_not_claim_the_key(spark):
    rows = [row(0, "same problem"), row(1, "same problem")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = audit.audit(df, spark.createDataFrame([], "suite string, problem string"), audit.AuditSettings(), F.lit(5), token_error=F.when(F.col("row_index") == 0, "prompt is no prefix"))
    assert issues(got) == {0: ["tokenization_error:prompt is no prefix"], 1: []}


def test_dedup_against_a_sequential_loop(spark):
    import random

    rng = random.Random(2)
    rows, ok, want, seen = [], {}, {}, set()
    for i in range(300):
        p, good, size = f"problem {rng.randrange(40)}", rng.random() < 0.7, rng.choice([5, 99])
        rows.append(row(i, p, verified=good))
        ok[i] = size
        want[i] = ["math_verify_failed"] if not good else ["duplicate_problem"] if p in seen else ["over_max_length"] if size > 50 else []
        if not want[i]:
            seen.add(p)
    tokens = F.element_at(F.create_map(*[x for i, s in ok.items() for x in (F.lit(i).cast("bigint"), F.lit(s))]), F.col("row_index"))
    assert issues(run(spark, rows, tokens=tokens, max_tokens=50)) == want


def test_contamination(spark):
    suites = [("a", "one two three four five"), ("b", "zero one two three four"), ("c", None), ("a", "unrelated text of its own")]
    rows = [row(0, "say one two three four now"), row(1, "one, two three four"), row(2, "one two three"), row(3, "ONE two  three four five")]
    assert issues(run(spark, rows, suites)) == {0: ["evaluation_4gram_overlap:a", "evaluation_4gram_overlap:b"], 1: [], 2: [], 3: ["evaluation_exact_match:a"]}
    assert issues(run(spark, rows[:1], [])) == {0: []}
    assert run(spark, [], suites).count() == 0


@pytest.mark.parametrize("text,ok", [("<think>a</think>", True), ("", False), ("<think>", False), ("</think>", False), ("<think></think></think>", False), ("<think><think></think></think>", True), ("</think><think>", False)])
def test_think_balance(spark, text, ok):
    assert spark.createDataFrame([(text,)], "t string").select(audit.think_balanced(F.col("t"))).first()[0] is ok


def test_text_forms(spark):
    assert tx.normalize_text("  What　IS  2 + 2? ") == "what is 2 + 2?"
    df = spark.createDataFrame([("ﬁne  STRASSE ß",), (None,), ("",), (" \t ",)], "t string")
    assert [r[0] for r in df.select(tx.normalized_strict("t")).collect()] == ["fine strasse ss", None, "", ""]
    grams = df.select(tx.ngrams(tx.split_words(tx.normalized_portable(F.col("t"))), 2)).collect()
    assert [r[0] for r in grams] == [["ﬁne strasse", "strasse ß"], None, [], []] or [r[0] for r in grams][2:] == [[], []]


def test_hash_split_ties_and_sizes(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(50)], "sample_id string")
    for n in (1, 7, 49, 50, 80):
        got = audit.hash_split(df.repartition(5), "sample_id", "s", n)
        assert got.where("split = 'validation'").count() == min(n, 50)
    assert audit.hash_split(df.limit(0), "sample_id", "s", 3).count() == 0


def test_recovery_equals_a_fresh_run(spark, tmp_path):
    df = run(spark, [row(0, "a"), row(1, "a"), row(2, "b", verified=False)])
    scanned = spark.createDataFrame([(0, "h", "s", 5, [], None, None, None, True, True), (1, "h", "s", 5, [], None, None, None, True, True), (2, None, "s", None, [], "math_verify_failed", None, None, None, False)], "row_index bigint, sample_id string, source string, token_count int, shape array<string>, issue string, reasons array<string>, token_error string, fits boolean, ok boolean")
    assert issues(audit.finish(scanned)) == issues(df)


def test_settings_are_validated():
    with pytest.raises(ValueError):
        audit.AuditSettings(ngram=0)
    with pytest.raises(ValueError):
        audit.AuditSettings(salt="")


def test_failure_evidence(spark, tmp_path):
    df = run(spark, [row(0, "a", verified=False)])
    with pytest.raises(ValueError, match="0 rows accepted"):
        provenance.failure_evidence(df, str(tmp_path / "out"), 1)
    assert (tmp_path / "out" / "manifest.json").exists() and (tmp_path / "out" / "rejected").exists()


def test_record_validation(spark):
    rows = [("a", [1, 2], [-100, 2]), ("", [1], [1]), ("b", [], []), ("c", [1, 2], [1]), ("d", [1, None], [1, 2]), ("e", [1, 2], [5, -100]), (None, [1], [1]), ("f", None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "sample_id string, input_ids array<int>, labels array<int>").select(audit.validation_error()).collect()]
    assert got == [None, "sample_id must be a non-empty string", "input_ids must not be empty", "labels must match input_ids", "input_ids must hold integers", "no supervised label", "sample_id must be a non-empty string", "input_ids must not be empty"]
