"""The budget gate over more records than generations are planned."""

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.operators import gates


@pytest.mark.parametrize("capped", [0, 3000])
def test_more_records_than_planned(spark, tmp_path, capped):
    name = "generation_health_2048_records"
    n = f"CASE WHEN id < {capped} THEN 2048 WHEN id % 50 = 7 THEN 0 WHEN id % 50 <> 8 THEN 1 + id * 7919 % 1500 END"
    spark.range(12_000).selectExpr(f"CAST({n} AS INT) AS generated_tokens").write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    cursor = con.execute(entry.oracle_sql()["generation_budget_gate"])
    want = dict(zip([c[0] for c in cursor.description], cursor.fetchone(), strict=True))
    got = entry.queries()["generation_budget_gate"](spark, str(tmp_path)).collect()
    assert [r.asDict() for r in got] == [want] and want["samples"] > 10_000 and want["truncation_rate_ok"] is (capped == 0)


def test_other_faults_still_raise(spark):
    for lengths in ([], [5, 0], [5, None]):
        df = spark.createDataFrame([(n,) for n in lengths], "n int")
        with pytest.raises(Exception, match="must be positive"):
            gates.generation_budget(df, "n", 2048, 1.0, 1, any_probe_size=True).collect()
