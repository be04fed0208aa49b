import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import provenance
from millrace.sources import files


def lines(path, *rows):
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def test_strict_json_lines(spark, tmp_path):
    schema = "a bigint, b string"
    good = files.json_lines_strict(spark, lines(tmp_path / "g.jsonl", '{"a": 1, "b": "x"}', '{"b": "y", "a": 2}'), schema, ["a"])
    assert sorted(tuple(r) for r in good.collect()) == [(1, "x"), (2, "y")]
    for k, (bad, why) in enumerate([("", "blank line"), ("{oops", "bad JSON"), ("[1]", "not an object"), ('{"b": "x"}', "missing field")]):
        with pytest.raises(files.SourceError, match=rf"{k}.jsonl, line 2: {why}"):
            files.json_lines_strict(spark, lines(tmp_path / f"{k}.jsonl", '{"a": 1}', bad, '{"a": 2}'), schema, ["a"])
    assert files.json_lines(spark, lines(tmp_path / "l.jsonl", '{"a": 1}', "", "{oops"), schema).count() == 1


def test_row_index_runs_over_files(spark, tmp_path):
    for n, (a, b) in {"p": (0, 5), "q": (5, 9)}.items():
        spark.range(a, b).coalesce(1).write.parquet(str(tmp_path / n))
    df = files.with_row_index(spark, [str(tmp_path / "p"), str(tmp_path / "q")])
    assert all(r.id == r.row_index for r in df.collect())
    assert files.first_rows(df, 3).count() == 3
    assert sorted(r.id for r in files.rows_at(df, spark.createDataFrame([(2,), (7,), (7,)], "row_index bigint")).collect()) == [2, 7]
    order = spark.createDataFrame([(0, 8), (1, 2), (2, 8)], "position int, row_index bigint")
    assert [r.id for r in files.reordered(df, order).orderBy("position").collect()] == [8, 2, 8]
    with pytest.raises(ValueError):
        files.first_rows(df, 0)


def test_details(spark, tmp_path):
    one = spark.createDataFrame([("x", 1.0)], "example string, score double")
    for name in ("details_gsm|5_2026-01-02T03-04-05.6.parquet", "sub/details_math_2026-01-02T03-04-05.parquet"):
        one.coalesce(1).write.parquet(str(tmp_path / name))
    assert {r.task for r in files.details(spark, str(tmp_path), ["score"]).collect()} == {"gsm|5", "math"}
    one.write.parquet(str(tmp_path / "details_odd.parquet"))
    with pytest.raises(files.SourceError, match="unexpected"):
        files.detail_files(spark, str(tmp_path))
    with pytest.raises(files.SourceError, match="no detail files"):
        files.detail_files(spark, str(tmp_path / "none"))
    (tmp_path / "twice").mkdir()
    for name in ("details_a_2026-01-02T030405.parquet", "sub/details_a_2026-01-03Tlate.parquet"):  # whatever follows the T
        one.coalesce(1).write.parquet(str(tmp_path / "twice" / name))
    with pytest.raises(files.SourceError, match="two detail files"):
        files.detail_files(spark, str(tmp_path / "twice"))
    assert [(r.task, r.date) for r in files.details(spark, str(tmp_path / "twice/sub"), ["score"]).collect()] == [("a", "2026-01-03Tlate")]


def test_manifests_lists_and_counts(spark, tmp_path):
    (tmp_path / "a").mkdir()
    files.write_json_atomic(tmp_path / "a/invocation_manifest.json", {"suite": "s", "status": "completed", "returncode": 0})
    assert [tuple(r) for r in files.run_manifests(spark, str(tmp_path), {"contract_version": "string"}).collect()] == [("s", None)]
    files.update_status(tmp_path / "a/invocation_manifest.json", "failed", returncode=1)
    with pytest.raises(files.SourceError):
        files.run_manifests(spark, str(tmp_path))
    assert files.task_list(spark, lines(tmp_path / "t.txt", "# c", " one ", "", "two")) == ["one", "two"]
    with pytest.raises(files.SourceError):
        files.task_list(spark, lines(tmp_path / "e.txt", "# c"))
    path = lines(tmp_path / "m.jsonl", '{"metadata": {"token_count": 12}}', "", '{"metadata":{"token_count" :7}}', '{"sample_id": "a", "input_ids": [1, 2], "labels": [1, 2]}')
    assert sorted(r.token_count for r in files.token_counts(spark, path).collect()) == [2, 7, 12]
    for bad in ('{"sample_id": 5, "input_ids": [], "labels": []}', '{"sample_id": "a", "input_ids": [1], "labels": [1, 2]}', '{"input_ids": [1], "labels": [1]}', "{oops"):
        with pytest.raises(Exception, match="invalid tokenized record"):
            files.token_counts(spark, lines(tmp_path / "bad.jsonl", bad)).collect()


def test_checks(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "k string")
    assert files.unique_keys(ids("a", "b"), "k").count() == 2
    for bad in (ids("a", "a"), ids("a", ""), ids("a", None), ids("a").limit(0)):
        with pytest.raises(files.SourceError):
            files.unique_keys(bad, "k")
    row = lambda *r: spark.createDataFrame([r], "status string, problem string, generation string, issues array<string>, review_reason string")
    assert files.review_bundle(row("rejected", "p", "g", ["x"], "x"), 1).count() == 1
    for bad, n in ((row("other", "p", "g", None, None), 1), (row("accepted", " ", "g", None, None), 1), (row("rejected", "p", "g", ["y"], "x"), 1), (row("accepted", "p", "g", None, None), 2)):
        with pytest.raises(files.SourceError):
            files.review_bundle(bad, n)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "n int, a string")
    files.write_json_lines(df, str(tmp_path / "o"), ["n"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*")))
    assert [json.loads(x) for x in text.split("\n") if x] == [{"a": "a", "n": 1}, {"a": "b", "n": 2}]
    with pytest.raises(Exception, match="already exists"):
        files.write_json_lines(df, str(tmp_path / "o"))
    with pytest.raises(FileExistsError):
        files.refuse_overwrite(tmp_path)
    files.append_metrics(spark.createDataFrame([(1.0,)], "x double"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).first().recorded_at
    with pytest.raises(Exception, match="not finite"):
        files.append_metrics(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "log"))
    try:
        raise ValueError("boom")
    except ValueError as e:
        files.failure_snapshot(tmp_path / "f.json", e, {"step": 3})
    assert files.json_object(tmp_path / "f.json")["message"] == "boom"
    assert [files.render_value(x) for x in (True, {"b": 1, "a": [1]}, 3, "s")] == ["true", '{"a":[1],"b":1}', "3", "s"]


@dataclasses.dataclass
class Config:
    seed: int = 1
    resume_from: str | None = None


def test_provenance(spark, tmp_path):
    c = provenance.from_mapping(Config, {"seed": 3})
    assert provenance.config_hash(c) == provenance.config_hash(provenance.resumed(c, resume_from="x"))
    with pytest.raises(ValueError, match="must not change"):
        provenance.resumed(c, seed=4)
    with pytest.raises(ValueError, match="unknown"):
        provenance.from_mapping(Config, {"sed": 3})
    (tmp_path / "a.txt").write_text("x")
    before = provenance.tree_digest(tmp_path)
    h = provenance.file_sha256(tmp_path / "a.txt")
    assert provenance.file_hashes(spark, str(tmp_path)).first().sha256 == h
    assert provenance.bundle_manifest({"a": str(tmp_path / "a.txt")}, {"a": h}, "passed")["artifacts"] == {"a": h}
    for expected, status in (({"a": "0"}, "passed"), ({"a": h}, "incomplete")):
        with pytest.raises(ValueError):
            provenance.bundle_manifest({"a": str(tmp_path / "a.txt")}, expected, status)
    (tmp_path / "a.txt").write_text("y")
    assert provenance.tree_digest(tmp_path) != before
    names = spark.createDataFrame([(n,) for n in ("checkpoint-9", "checkpoint-10", "other", "checkpoint-2")], "name string")
    assert [r.step for r in provenance.retained_checkpoints(names, 2).collect()] == [10, 9]
    import hashlib

    df = spark.createDataFrame([("b", 1), ("a", 0)], "k string, position int")
    assert provenance.ordered_digest(df, "k", "position") == hashlib.sha256(b"a\nb\n").hexdigest()


def test_decisions(spark):
    bundle = spark.createDataFrame([(0, "accepted", "h0"), (1, "rejected", "h1")], "review_index int, status string, record_sha256 string")
    d = lambda *r: spark.createDataFrame(list(r), "review_index int, artifact_sha256 string, reviewer string, record_sha256 string, verdict string")
    got = provenance.checked_decisions(bundle, d((0, "A", "me", "h0", "keep")), "A", "me")
    assert {r.review_index: r.verdict for r in got.collect()} == {0: "keep", 1: None}
    for bad in ((0, "B", "me", "h0", "keep"), (0, "A", "you", "h0", "keep"), (0, "A", "me", "hx", "keep"), (1, "A", "me", "h1", "keep"), (7, "A", "me", "h0", "keep")):
        with pytest.raises(files.SourceError):
            provenance.checked_decisions(bundle, d(bad), "A", "me")
    with pytest.raises(files.SourceError):
        provenance.checked_decisions(bundle, d((0, "A", "me", "h0", "keep"), (0, "A", "me", "h0", "flag")), "A", "me")
    merged = provenance.upsert_decisions(d((0, "A", "me", "h0", "flag"), (1, "A", "me", "h1", "agree")), d((0, "A", "me", "h0", "keep")))
    assert {r.review_index: r.verdict for r in merged.collect()} == {0: "keep", 1: "agree"}
    assert bundle.select(F.length(provenance.record_hash(bundle.columns))).first()[0] == 64


def test_record_sources(spark, tmp_path):
    good = lines(tmp_path / "n.jsonl", '{"sample_id": "a", "mean_nll": 1.5}', '{"sample_id": "b", "mean_nll": 0.5}')
    assert files.loss_records(spark, good).count() == 2
    for bad in ('{"sample_id": "a"}', '{"sample_id": "a", "mean_nll": "x"}'):
        with pytest.raises(files.SourceError):
            files.loss_records(spark, lines(tmp_path / f"n{len(bad)}.jsonl", bad))
    assert files.prompts(spark, lines(tmp_path / "p.jsonl", '{"id": "1", "prompt": "q"}')).count() == 1
    with pytest.raises(files.SourceError, match="blank"):
        files.prompts(spark, lines(tmp_path / "q.jsonl", '{"id": "1", "prompt": " "}'))
    df = spark.createDataFrame([("x", 1)], "question string, n int")
    assert {tuple(r) for r in files.suite_problems({"a": (df, "question"), "b": (df, "n")}).collect()} == {("a", "x"), ("b", "1")}
    assert files.metric_events(spark, str(tmp_path / "none")).count() == 0
    log = lines(tmp_path / "log.jsonl", '{"event": "train", "optimizer_step": 1}', '{"event": "validation", "optimizer_step": 1}')
    assert files.metric_events(spark, log).count() == 1


def test_split_and_change_exports(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i}", "train" if i % 4 else "validation", i) for i in range(20)], "split_key string, split string, n int")
    files.write_splits(df, str(tmp_path / "s"), ["split_key"])
    back = spark.read.json(str(tmp_path / "s"))
    assert back.where("split = 'validation'").count() == 5 and back.count() == 20
    files.export_changes(df.where("n = 1"), {"changed": 1}, str(tmp_path / "c"))
    assert files.json_object(tmp_path / "c/summary.json") == {"changed": 1}


def test_run_identity(tmp_path):
    (tmp_path / "a").write_text("x")
    m = provenance.start_run(str(tmp_path / "run"), Config(), {"a": str(tmp_path / "a")})
    provenance.same_identity(m, Config(resume_from="x"), {"a": str(tmp_path / "a")})
    (tmp_path / "a").write_text("y")
    with pytest.raises(ValueError, match="artifacts"):
        provenance.same_identity(m, Config(), {"a": str(tmp_path / "a")})


def test_exactly_once(spark, tmp_path):
    from millrace.streaming.exactly_once import consume

    for _ in range(2):
        spark.range(5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
        consume(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_review_artifact(spark, tmp_path):
    path = lines(tmp_path / "review.jsonl", '{"review_index": 1, "status": "rejected", "problem": "p", "generation": "g", "issues": ["x"], "review_reason": "x"}')
    told = {"review": {"sha256": provenance.file_sha256(path), "count": 1}}
    assert files.review_artifact(spark, path, told).count() == 1
    for wrong in ({}, {"review": {"sha256": "0", "count": 1}}, {"review": told["review"] | {"count": 2}}):
        with pytest.raises(files.SourceError):
            files.review_artifact(spark, path, wrong)


def test_configurations_and_environment(spark):
    @dataclasses.dataclass
    class Run:
        run_name: str = "a"
        learning_rate: float = 1e-5
        warmup_ratio: float = 0.1
        max_steps: int | None = None
        dtype: str = "float32"

    assert provenance.checked_config(Run, {"max_steps": 3}).max_steps == 3
    for bad, why in (({"run_name": "a/b"}, "separators"), ({"learning_rate": 0}, "positive"), ({"warmup_ratio": 1}, "lie in"), ({"dtype": "int8"}, "one of"), ({"max_steps": 0}, "where given"), ({"learning_rate": None}, "positive")):
        with pytest.raises(ValueError, match=why):
            provenance.checked_config(Run, bad)
    found = provenance.environment(spark)
    assert found["packages"]["pyspark"] == spark.version and set(found["git"]) == {"commit", "dirty"}
    assert provenance.seeded(5).integers(100) == provenance.seeded(5).integers(100)


def test_block_digest_does_not_depend_on_partitioning(spark):
    rows = spark.range(250).selectExpr("id as position", "concat('k', id) as k")
    digests = {provenance.block_digest(x, "k", "position", 100).first() for x in (rows, rows.repartition(7))}
    assert len(digests) == 1 and digests.pop().rows == 250
    assert provenance.block_digest(rows.where("position < 249"), "k", "position", 100).first().digest != provenance.block_digest(rows, "k", "position", 100).first().digest
