"""Strict and lenient readers, discovery by file name, atomic writers."""

from __future__ import annotations

import json
import math
import os
import re
import traceback
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


class SourceError(ValueError):
    """A source does not meet its contract."""


def json_lines_strict(spark: SparkSession, path: str, schema: T.StructType | str, required: list[str] | None = None) -> DataFrame:
    """JSON objects, one per line; a blank line, bad JSON or a non-object raises with its line number.

    Spark's reader skips blank lines, so lines are read as text and parsed in the plan; one
    aggregate looks for violations before rows are returned. The number of a wrong line is
    counted in its file only once there is one.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.withColumn("r", F.from_json("value", wide, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    problem = (
        F.when(F.trim("value") == "", "blank line")
        .when(~F.trim("value").startswith("{"), "not an object")
        .when(F.col("r._bad").isNotNull() | F.col("r").isNull(), "bad JSON")
        .when(F.exists(F.array(*[F.col(f"r.{c}").isNull() for c in required or []], F.lit(False)), lambda x: x), "missing field")
    )
    bad = parsed.select("file", "at", "value", problem.alias("problem")).where("problem is not null").agg(F.min(F.struct("file", "at", "problem", "value")).alias("first")).first().first
    if bad is not None:
        before = lines.where((F.col("file") == bad["file"]) & (F.col("at") < bad["at"])).count()
        raise SourceError(f"{bad['file'].rsplit('/', 1)[-1]}, line {before + 1}: {bad['problem']}: {bad['value'][:80]!r}")
    return parsed.select("r.*").drop("_bad")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Non-strict read: lines that do not parse are dropped, blank lines skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def with_row_index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet files with row_index running over all of them, sorted by path.

    Row numbers come from the files' metadata; one count per file gives the offsets.
    """
    read = spark.read.parquet(*paths).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = read.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per file
    return read.join(sizes.withColumn("_before", before).drop("_n"), "_file").withColumn("row_index", F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def first_rows(rows: DataFrame, n: int, order: str = "row_index") -> DataFrame:
    """The rows below ordinal n: a filter, not an unordered limit."""
    if n < 1:
        raise ValueError("limit must be positive")
    return rows.where(F.col(order) < n)


def rows_at(rows: DataFrame, positions: DataFrame, order: str = "row_index") -> DataFrame:
    """Point lookups: the rows at the given ordinals."""
    return rows.join(positions.select(order).distinct(), order, "left_semi")


def reordered(rows: DataFrame, order: DataFrame, index: str = "row_index", position: str = "position") -> DataFrame:
    """Rows by a list of indices: order holds position and index; an index may repeat."""
    return order.select(index, position).join(rows, index)


#: Fixed value: the naming of evaluation detail files.
DETAIL_NAME = r"details_([^/]+)_(\d{4}-\d{2}-\d{2}T[^/]+)\.parquet"


def _decoded(path: Column) -> Column:
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def detail_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """task -> path of all detail files below a folder; bad names, repeats and none raise.

    The listing is a recursive scan of paths alone; one row per detail file comes back.
    """
    if not Path(folder.removeprefix("file://")).is_dir() and "://" not in folder:
        raise SourceError(f"no detail files below {folder}")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    units = listed.select(F.regexp_extract("path", r"^(.*?/details_[^/]*\.parquet)(?:/|$)", 1).alias("path")).where("path != ''").distinct()
    named = units.select("path", F.regexp_extract("path", rf"/{DETAIL_NAME}$", 1).alias("task"))
    seen = named.agg(F.count(F.lit(1)).alias("files"), F.min(F.when(F.col("task") == "", F.col("path"))).alias("bad"), F.countDistinct("task").alias("tasks")).first()
    if seen.bad is not None:
        raise SourceError(f"unexpected detail file name {seen.bad}")
    if seen.files != seen.tasks:
        raise SourceError("two detail files for one task")
    if not seen.files:
        raise SourceError(f"no detail files below {folder}")
    return {r.task: r.path for r in named.sort("task").collect()}


def details(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """All detail files in one scan, with task, date and row_index; only the named columns are read."""
    paths = detail_files(spark, folder)
    path = _decoded(F.col("_metadata.file_path"))
    of = lambda group: F.regexp_extract(path, rf"/{DETAIL_NAME}(?:/[^/]*)?$", group)
    read = spark.read.option("mergeSchema", True).parquet(*paths.values())
    return read.select(of(1).alias("task"), of(2).alias("date"), F.col("_metadata.row_index").alias("row_index"), *(columns or read.columns))


def run_manifests(spark: SparkSession, folder: str, fields: dict[str, str] | None = None) -> DataFrame:
    """suite and the named fields of all completed runs below a folder; one aggregate finds what is wrong."""
    schema = {"suite": "string", "status": "string", "returncode": "bigint"} | (fields or {})
    reader = spark.read.schema(", ".join(f"`{n}` {k}" for n, k in schema.items())).option("multiLine", True)
    found = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "invocation_manifest.json").json(folder)
    ok = F.coalesce((F.col("suite") != "") & (F.col("status") == "completed") & (F.col("returncode") == 0), F.lit(False))
    seen = found.agg(F.count(F.lit(1)).alias("runs"), F.count_if(~ok).alias("bad"), F.countDistinct("suite").alias("suites")).first()
    if not seen.runs or seen.bad or seen.runs != seen.suites:
        raise SourceError(f"{folder}: not one completed run per suite ({seen.runs} runs, {seen.suites} suites, {seen.bad} incomplete)")
    return found.select("suite", *[f for f in fields or () if f != "suite"])


def json_object(path: str | Path) -> dict:
    value = json.loads(Path(path).read_text("utf-8"))
    if not isinstance(value, dict):
        raise SourceError(f"{path} holds no JSON object")
    return value


def task_list(spark: SparkSession, path: str) -> list[str]:
    """Trimmed lines without blanks and comments; an empty list raises. A task list is small."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v != '' and not startswith(v, '#')")
    out = [r.v for r in lines.limit(100_001).collect()]
    if not out or len(out) > 100_000:
        raise SourceError(f"{path} must list between one and 100,000 tasks")
    return out


def token_counts(spark: SparkSession, path: str) -> DataFrame:
    """token_count per line by pattern, without parsing; where it fails, the number of input_ids.

    A line without the pattern that is no record (a string id, ids and labels of one length) raises.
    """
    lines = spark.read.text(path).where("trim(value) != ''")
    fast = F.regexp_extract("value", r'"token_count"\s*:\s*(\d+)', 1)
    r = F.from_json("value", "sample_id string, input_ids array<int>, labels array<int>")
    whole = F.coalesce(r["sample_id"].isNotNull() & (F.size(r["input_ids"]) > 0) & (F.size(r["input_ids"]) == F.size(r["labels"])), F.lit(False))
    counted = F.when(whole, F.size(r["input_ids"])).otherwise(F.raise_error(F.concat(F.lit("invalid tokenized record: "), F.left("value", F.lit(80)))).cast("int"))
    return lines.select(F.when(fast != "", fast.cast("int")).otherwise(counted).alias("token_count"))


def unique_keys(rows: DataFrame, key: str) -> DataFrame:
    """The rows, after checking that the key is non-empty and unique and that rows exist."""
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("d"), F.count_if(F.coalesce(F.col(key).cast("string"), F.lit("")) == "").alias("e")).first()
    if not r.n or r.e or r.n != r.d:
        raise SourceError(f"{key} must be non-empty and unique, in at least one row")
    return rows


def review_artifact(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    """Review records of a file whose hash and count must be those of the data manifest."""
    told = manifest.get("review")
    if not isinstance(told, dict):
        raise SourceError("the manifest names no review artifact")
    actual = spark.read.format("binaryFile").load(path).agg(F.min(F.sha2("content", 256)).alias("h"), F.count(F.lit(1)).alias("n")).first()
    if actual.n != 1 or actual.h != told.get("sha256"):
        raise SourceError("the review artifact is not the manifest's")
    schema = "review_index bigint, status string, problem string, generation string, issues array<string>, review_reason string"
    return review_bundle(json_lines_strict(spark, path, schema, ["status", "problem", "generation"]), told.get("count"))


def review_bundle(rows: DataFrame, expected: int) -> DataFrame:
    """Review records, after checking statuses, text pairs, reasons and the count."""
    text = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
    reason_ok = (F.col("status") == "accepted") | F.array_contains("issues", F.col("review_reason"))
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("status").isin("accepted", "rejected")).alias("status"), F.count_if(~(text("problem") & text("generation"))).alias("text"), F.count_if(~F.coalesce(reason_ok, F.lit(False))).alias("reason")).first()
    wrong = [k for k in ("status", "text", "reason") if r[k]] + (["count"] if r.n != expected else [])
    if wrong:
        raise SourceError(f"review bundle fails: {', '.join(wrong)}")
    return rows


def write_json_atomic(path: str | Path, value) -> None:
    """Sorted keys, indent 2, ASCII; written beside and renamed."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_name(path.name + ".tmp")
    with beside.open("w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True, ensure_ascii=True)
        f.write("\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(beside, path)


def write_json_lines(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A directory of JSON lines with columns in name order; an existing path is refused."""
    out = rows.select(*sorted(rows.columns))
    (out.orderBy(*order) if order else out).write.mode("errorifexists").json(path)


def refuse_overwrite(folder: str | Path) -> None:
    folder = Path(folder)
    if folder.exists() and any(folder.iterdir()):
        raise FileExistsError(f"{folder} is not empty")


def finite(rows: DataFrame) -> DataFrame:
    """Rows whose floating-point columns are all finite or null; others raise when read."""
    checks = [F.isnan(c) | (F.abs(c) == float("inf")) for c, k in rows.dtypes if k in ("double", "float")]
    out = rows
    for c in checks:
        out = out.where(F.when(F.coalesce(c, F.lit(False)), F.raise_error("metric is not finite").cast("boolean")).otherwise(True))
    return out


def append_metrics(rows: DataFrame, path: str) -> None:
    """Append events; recorded_at is added where the caller gives none."""
    if "recorded_at" not in rows.columns:
        rows = rows.withColumn("recorded_at", F.current_timestamp())
    finite(rows).write.mode("append").json(path)


def failure_snapshot(path: str | Path, error: BaseException, context: dict) -> None:
    write_json_atomic(path, {"type": type(error).__name__, "message": str(error), "notes": list(getattr(error, "__notes__", [])), "traceback": traceback.format_exception(error), "context": context})


def update_status(path: str | Path, status: str, **fields) -> None:
    """Read-modify-write of a run manifest."""
    write_json_atomic(path, json_object(path) | {"status": status} | fields)


def render_value(value) -> str:
    """Command-line form of a configuration value."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (dict, list)):
        return json.dumps(value, sort_keys=True, separators=(",", ":"))
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("values must be finite")
    return str(value)


def write_splits(rows: DataFrame, folder: str, order: list[str], split: str = "split") -> None:
    """One directory per split; rows of a file are in order, and files are ranges of it."""
    rows.repartitionByRange(split, *order).sortWithinPartitions(split, *order).write.partitionBy(split).mode("errorifexists").json(folder)


def export_changes(rows: DataFrame, summary: dict, folder: str) -> None:
    """Changed rows as JSON lines and their summary beside them; a filled folder is refused."""
    refuse_overwrite(folder)
    write_json_lines(rows, f"{folder}/changed_rows")
    write_json_atomic(f"{folder}/summary.json", summary)


def loss_records(spark: SparkSession, path: str) -> DataFrame:
    """Per-record losses: unique non-empty sample ids with a numeric mean_nll, in at least one row."""
    rows = json_lines_strict(spark, path, "sample_id string, mean_nll double, loss_sum double, valid_tokens bigint", ["sample_id", "mean_nll"])
    return unique_keys(rows, "sample_id")


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompts with an id and a non-blank text; anything else raises."""
    rows = json_lines_strict(spark, path, "id string, prompt string", ["id", "prompt"])
    if rows.where("trim(id) = '' or trim(prompt) = ''").limit(1).count():
        raise SourceError(f"{path}: blank id or prompt")
    return unique_keys(rows, "id")


def suite_problems(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """suite, problem over evaluation tables, each with the field that holds its question."""
    out = None
    for suite, (df, field) in sorted(tables.items()):
        part = df.select(F.lit(suite).alias("suite"), F.col(field).cast("string").alias("problem"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise SourceError("no evaluation suites")
    return out


def metric_events(spark: SparkSession, path: str, event: str = "train") -> DataFrame:
    """Replay of a metric log: the events of one kind; a missing log has none."""
    schema = "run string, event string, optimizer_step bigint, mean_loss double, valid_tokens bigint, grad_norm double, learning_rate double, recorded_at timestamp"
    if not Path(path).exists():
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path).where(F.col("event") == event)
