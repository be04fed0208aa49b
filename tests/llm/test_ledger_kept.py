"""The registered sample keeps its ledger between runs."""

import datetime
import random

import __spark_entry__ as entry


def _rows(n):
    rng = random.Random(5)
    return [(f"kept-{i}", datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i - 24 * rng.randrange(20) * (rng.random() < 0.02))) for i in range(n)]


def _train(spark, folder, rows):
    spark.createDataFrame(rows, "sample_id string, recorded_at timestamp").write.mode("overwrite").parquet(f"{folder}/train.parquet")
    return str(folder)


def _sample(spark, folder):
    out = [(r.sample_id, r["round"]) for r in entry.queries()["p5_sample"](spark, folder).collect()]
    assert len(out) == len(dict(out))
    return dict(out)


def test_no_id_drops_out_as_train_grows(spark, tmp_path):
    rows, before = _rows(2000), {}
    for n in (1000, 1100, 1300, 1600, 1900, 1990, 2000):
        now = _sample(spark, _train(spark, tmp_path / "one", rows[:n]))
        assert len(now) == n // 10 and before.items() <= now.items()
        before = now
    assert _sample(spark, str(tmp_path / "one")) == before


def test_a_superset_at_another_place_continues_the_ledger(spark, tmp_path):
    rows = [("x" + i, t) for i, t in _rows(3000)]
    first = _sample(spark, _train(spark, tmp_path / "a", rows[:900]))
    second = _sample(spark, _train(spark, tmp_path / "b", rows[900:1900]))
    assert len(second) == 100 and not first.keys() & second.keys()
    both = _sample(spark, _train(spark, tmp_path / "c", rows))
    assert len(both) == 300 and first.keys() | second.keys() <= both.keys()


def test_rows_that_left_stay_and_other_tables_start_anew(spark, tmp_path):
    rows = [("y" + i, t) for i, t in _rows(1000)]
    first = _sample(spark, _train(spark, tmp_path / "a", rows))
    assert first.items() <= _sample(spark, _train(spark, tmp_path / "a", rows[500:])).items()
    other = _sample(spark, _train(spark, tmp_path / "b", rows[500:]))
    assert len(other) == 50 and other.keys() <= {i for i, _ in rows[500:]}
