"""Hashes, manifests, configuration identity, review decisions and checkpoint retention."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import random
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.stats import distribution_columns
from millrace.sources import files


def file_sha256(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def tree_digest(folder: str | Path) -> str:
    """SHA-256 over the sorted relative paths and their file hashes."""
    folder = Path(folder)
    lines = sorted((p.relative_to(folder).as_posix(), file_sha256(p)) for p in folder.rglob("*") if p.is_file())
    return hashlib.sha256("".join(f"{p}\0{h}\n" for p, h in lines).encode()).hexdigest()


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """path, sha256 of all files below a folder, hashed where they are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.sha2("content", 256).alias("sha256"))


def ordered_digest(rows: DataFrame, key: str, position: str) -> str:
    """SHA-256 of 'key\\n' in order, as the published order files have it.

    One digest over all keys has to see them one after the other: they stream through the
    driver, one partition at a time. block_digest() is the form for large tables.
    """
    digest = hashlib.sha256()
    for r in rows.select(key, position).orderBy(position).select(key).toLocalIterator():
        digest.update(f"{r[0]}\n".encode())
    return digest.hexdigest()


def block_digest(rows: DataFrame, key: str, position: str, block: int = 100_000) -> DataFrame:
    """One row: rows, digest. Blocks of consecutive positions are hashed in tasks, then their hashes in order.

    Positions count from 0 without gaps. The last step sees 64 characters per block, a
    hundred-thousandth of the rows.
    """
    packed = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(key).cast("string").alias("k"))))
    text = F.concat(F.array_join(F.transform(packed, lambda x: F.coalesce(x["k"], F.lit(""))), "\n"), F.lit("\n"))
    blocks = rows.groupBy(F.floor(F.col(position) / block).alias("b")).agg(F.sha2(text, 256).alias("h"), F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("b", "h")))
    return blocks.agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["h"]), "\n"), 256).alias("digest"))


def canonical_hash(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def from_mapping(kind, values: dict):
    """A configuration dataclass from a mapping; unknown fields raise."""
    known = {f.name for f in dataclasses.fields(kind)}
    unknown = sorted(set(values) - known)
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    return kind(**values)


#: What the fields of an experiment must satisfy: test and message, by field name.
def _checks() -> dict:
    text = (lambda v: isinstance(v, str) and v.strip() != "", "must not be empty")
    positive = (lambda v: v > 0, "must be positive")
    optional = (lambda v: v is None or v > 0, "must be positive where given")
    share = (lambda v: 0 <= v < 1, "must lie in [0, 1)")
    natural = (lambda v: v >= 0, "must not be negative")
    one_of = lambda *allowed: (lambda v: v in allowed, f"must be one of {', '.join(allowed)}")
    groups = {
        text: "run_name model_name_or_path model_revision",
        positive: "per_device_train_batch_size gradient_accumulation_steps num_train_epochs log_every_steps eval_every_steps save_every_steps save_total_limit learning_rate adam_epsilon max_grad_norm",
        optional: "max_steps train_sample_limit validation_sample_limit",
        share: "adam_beta1 adam_beta2 warmup_ratio min_lr_ratio",
        natural: "dataloader_num_workers pad_token_id weight_decay",
        one_of("float32", "bfloat16"): "dtype parameter_dtype",
        one_of("eager", "sdpa", "flash_attention_2"): "attn_implementation",
        one_of("cosine_with_min_lr"): "scheduler_type",
    }
    return {name: check for check, names in groups.items() for name in names.split()}


def config_errors(values: dict) -> list[str]:
    """What is wrong with the named fields of an experiment, sorted; empty if nothing is."""
    checks, wrong = _checks(), []
    for name in sorted(set(values) & set(checks)):
        test, message = checks[name]
        try:
            ok = test(values[name])
        except TypeError:
            ok = False
        if not ok:
            wrong.append(f"{name} {message}")
    if any(c in str(values.get("run_name", "")) for c in "/\\"):
        wrong.append("run_name must not hold path separators")
    return wrong


def checked_config(kind, values: dict):
    """from_mapping() after all field checks; every fault is named at once."""
    config = from_mapping(kind, values)
    wrong = config_errors(dataclasses.asdict(config))
    if wrong:
        raise ValueError("; ".join(wrong))
    return config


def environment(spark: SparkSession | None = None, packages: tuple[str, ...] = ("pyspark", "pyarrow", "numpy", "pandas")) -> dict:
    """What a run's manifest says of where it ran."""
    import platform
    import subprocess
    import sys
    from importlib import metadata

    def version(name: str) -> str | None:
        try:
            return metadata.version(name)
        except metadata.PackageNotFoundError:
            return None

    def git(*args: str) -> str | None:
        try:
            done = subprocess.run(["git", *args], cwd=Path(__file__).parent, capture_output=True, text=True, timeout=10, check=False)
        except (OSError, subprocess.SubprocessError):
            return None
        return done.stdout.strip() if done.returncode == 0 else None

    dirty = git("status", "--porcelain")
    out = {"captured_at": utc_now(), "platform": platform.platform(), "python": sys.version, "packages": {p: version(p) for p in packages}}
    out["git"] = {"commit": git("rev-parse", "HEAD"), "dirty": None if dirty is None else bool(dirty)}
    return out | ({"spark": {"version": spark.version, "master": spark.sparkContext.master}} if spark else {})


def seeded(seed: int) -> np.random.Generator:
    """Seeds the driver's generators and gives one of its own; tasks take their seeds as arguments."""
    random.seed(seed)
    np.random.seed(seed % (1 << 32))
    return np.random.default_rng(seed)


def config_hash(config, ignored: tuple[str, ...] = ("resume_from",)) -> str:
    """Hash of a configuration's meaning: the fields about resuming do not count."""
    return canonical_hash({k: v for k, v in dataclasses.asdict(config).items() if k not in ignored})


def resumed(config, **changes):
    """A copy for resuming; a change of meaning raises."""
    out = dataclasses.replace(config, **changes)
    if config_hash(out) != config_hash(config):
        raise ValueError("resuming must not change the experiment")
    return out


def bundle_manifest(artifacts: dict[str, str], expected: dict[str, str], review_status: str) -> dict:
    """Hashes of a bundle's artifacts, after checking them and a passed review."""
    if review_status != "passed":
        raise ValueError(f"review is {review_status}")
    hashes = {n: file_sha256(p) for n, p in sorted(artifacts.items())}
    wrong = sorted(n for n, h in expected.items() if hashes.get(n) != h)
    if wrong:
        raise ValueError(f"artifacts changed: {', '.join(wrong)}")
    return {"artifacts": hashes, "review": review_status, "bundle_sha256": canonical_hash(hashes)}


def audit_manifest(audited: DataFrame) -> DataFrame:
    """One row: rows, accepted, rejected and the length distribution of accepted rows."""
    kept = audited.withColumn("_kept", F.when(F.col("accepted"), F.col("token_count")))
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected")]
    return kept.agg(*counts, *distribution_columns("_kept", "int", "tokens_"))


def failure_evidence(audited: DataFrame, folder: str, needed: int) -> None:
    """Too few accepted rows: the rejected rows and a failed manifest are written, then it raises."""
    accepted = audited.where("accepted").count()
    if accepted >= needed:
        return
    audited.where("not accepted").write.mode("errorifexists").json(f"{folder}/rejected")
    files.write_json_atomic(f"{folder}/manifest.json", {"status": "failed", "accepted": accepted, "needed": needed})
    raise ValueError(f"{accepted} rows accepted, {needed} needed")


def record_hash(columns: list[str]) -> Column:
    """Hash of a record's canonical JSON."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def checked_decisions(bundle: DataFrame, decisions: DataFrame, artifact: str, reviewer: str) -> DataFrame:
    """Bundle rows with their verdicts; decisions that fit no row raise.

    A decision must name an existing index once, this artifact, this reviewer and the record's hash.
    """
    d = decisions.select(F.col("review_index"), F.col("artifact_sha256").alias("_a"), F.col("reviewer").alias("_r"), F.col("record_sha256").alias("_h"), F.col("verdict"))
    joined = bundle.join(d, "review_index", "full_outer")
    status, verdict = F.col("status"), F.col("verdict")
    allowed = (status.eqNullSafe(F.lit("accepted")) & verdict.isin("keep", "flag")) | (status.eqNullSafe(F.lit("rejected")) & verdict.isin("agree", "disagree"))
    bad = verdict.isNotNull() & ~F.coalesce((F.col("_a") == artifact) & (F.col("_r") == reviewer) & (F.col("_h") == F.col("record_sha256")) & allowed, F.lit(False))
    n = joined.agg(F.count_if(bad).alias("bad"), F.countDistinct(F.when(verdict.isNotNull(), F.col("review_index"))).alias("d"), F.count("verdict").alias("n")).first()
    if n.bad or n.d != n.n:
        raise files.SourceError("a decision does not fit the review bundle")
    return joined.drop("_a", "_r", "_h")


def upsert_decisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """New decisions replace old ones of the same artifact, record and reviewer."""
    key = ["artifact_sha256", "record_sha256", "reviewer"]
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def retained_checkpoints(names: DataFrame, keep: int, name: str = "name") -> DataFrame:
    """name, step of the newest checkpoints; other names are ignored. The list is one folder's."""
    if keep < 1:
        raise ValueError("keep must be positive")
    step = F.regexp_extract(name, r"^checkpoint-(\d+)$", 1)
    found = names.where(step != "").select(F.col(name), step.cast("bigint").alias("step"))
    return found.orderBy(F.desc("step"), name).limit(keep)


def utc_now() -> str:
    from datetime import UTC, datetime

    return datetime.now(UTC).isoformat()


def start_run(folder: str, config, artifacts: dict[str, str]) -> dict:
    """A new run's manifest: configuration, its hash, the inputs' hashes; a filled folder is refused."""
    files.refuse_overwrite(folder)
    manifest = {"status": "running", "started_at": utc_now(), "config": dataclasses.asdict(config), "config_sha256": config_hash(config), "artifacts": {n: file_sha256(p) for n, p in sorted(artifacts.items())}, "environment": environment()}
    files.write_json_atomic(f"{folder}/run_manifest.json", manifest)
    return manifest


def same_identity(manifest: dict, config, artifacts: dict[str, str]) -> None:
    """A run resumes only with its own configuration and unchanged inputs."""
    now = {"config_sha256": config_hash(config), "artifacts": {n: file_sha256(p) for n, p in sorted(artifacts.items())}}
    wrong = [k for k, v in now.items() if manifest.get(k) != v]
    if wrong:
        raise ValueError(f"the run changed in: {', '.join(wrong)}")
