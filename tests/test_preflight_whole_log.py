import pytest

from millrace.operators import gates

ROWS = [("train", 1, 2.0, 1.0), ("train", 2, 1.0, 1.0), ("validation", 0, 2.0, None), ("validation", 1, 2.0, None), ("validation", 2, 1.0, None)]


@pytest.mark.parametrize(
    "more,passed",
    [([], True), ([("checkpoint", 1500, None, None)], True), ([("train", 1500, 1.0, 1.0)], False), ([("validation", 1500, 1.0, None)], False), ([("train", None, 1.0, 1.0)], False), ([("validation", None, 1.0, None)], False), ([("checkpoint", 1500, float("inf"), None)], False), ([("checkpoint", None, float("nan"), None)], False), ([("train", 2, 1.0, 1.0)], False)],
)
def test_every_row_counts(spark, more, passed):
    df = spark.createDataFrame(ROWS + more, "event string, optimizer_step bigint, mean_loss double, grad_norm double")
    assert gates.preflight(df).first().passed is passed


def test_train_rows_need_their_metrics(spark):
    schema = "event string, optimizer_step bigint, mean_loss double, grad_norm double"
    assert not gates.preflight(spark.createDataFrame([("train", 1, None, 1.0), *ROWS[1:]], schema)).first().passed
    assert not gates.preflight(spark.createDataFrame([("train", 1, 2.0, float("inf")), *ROWS[1:]], schema)).first().passed
    assert not gates.preflight(spark.createDataFrame([], schema)).first().passed
