import datetime

from millrace.llm import queries


def test_numeral_letters_are_no_digits(spark, tmp_path):
    words = "甲 乙 丙 丁 戊 己 庚 辛"
    at = datetime.datetime(2024, 1, 1)
    ids = "sample_id string, metadata struct<source:string>, recorded_at timestamp"
    spark.createDataFrame([("a", ("s",), at), ("c", ("s",), at), ("e", ("s",), at)], ids).write.parquet(f"{tmp_path}/train.parquet")
    spark.createDataFrame([("b", ("s",), at, "test"), ("d", ("s",), at, "test"), ("f", ("s",), at, "test")], ids + ", eval_split string").write.parquet(f"{tmp_path}/validation.parquet")
    problems = [("a", f"{words} 十天"), ("b", f"{words} 零天"), ("c", f"x {words} 3天"), ("d", f"x {words} 4天"), ("e", f"x y {words} Ⅳ"), ("f", f"x y {words} Ⅲ")]
    spark.createDataFrame([(i, p, s) for i, (s, p) in enumerate(problems)], "review_index bigint, problem string, sample_id string").write.parquet(f"{tmp_path}/review_samples.parquet")
    assert {tuple(r) for r in queries.p2_found(spark, str(tmp_path)).collect()} == {("a", "b")}
