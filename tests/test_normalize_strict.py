import __spark_entry__ as entry
from millrace.functions.text import normalize_text
from tests.test_strict import sha


def test_rejected_rows_are_compared(spark, tmp_path):
    h = lambda t: sha(normalize_text(t))
    rows = [(1, "\ufb01ne A", h("fine a"), None), (2, "\ufb01ne B", None, h("fine b")), (3, "C", None, "0"), (4, "D", None, None), (5, None, None, h("e")), (6, "F", "0", None)]
    spark.createDataFrame(rows, "review_index bigint, problem string, sample_id string, problem_hash string").write.parquet(f"{tmp_path}/review_samples.parquet")
    got = {r.review_index: (r.strict_hash, r.as_stored) for r in entry.queries()["normalize_strict"](spark, str(tmp_path)).collect()}
    assert got == {1: (h("fine a"), True), 2: (h("fine b"), True), 3: (h("c"), False), 4: (h("d"), None), 6: (h("f"), False)}
