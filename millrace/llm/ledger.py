"""Reproducible sample that stays stable as data grows: a persisted selection ledger.

The ledger holds every key ever selected. A round keeps all earlier keys by join and fills
the growth of the quota from unseen keys with the lowest salted hash. The k lowest hashes
are found without a global sort: a histogram over the first 16 bits of the hash (a fixed
65,536 buckets) gives the boundary bucket; whole buckets below it are taken, and only the
boundary bucket is ranked.

Between runs the ledger is kept in the shared folder under a stable name, as batches of the
rows that a run added: <shared>/ledger-<name>/table=<t + hash of the table's path>/batch=<id>.
A batch is written aside and renamed, so a broken run leaves nothing behind that is read. A
table continues the ledger kept for its path and every kept ledger whose keys all lie in it
(the same rows at another place, a later snapshot, two tables put together). Runs on one
table at the same time may add more than the quota; no key is lost.

Defined results for odd input: null keys are never selected; repeated rows of a key count
once; equal hashes are ordered by key; an empty table gives an empty ledger; a quota beyond
the number of keys selects all; keys that left the table stay in the ledger.
"""

from __future__ import annotations

import hashlib
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import runtime
from millrace.operators.sampling import lowest


def distinct_keys(rows: DataFrame, key_col: str, salt: str) -> DataFrame:
    """key, priority (hex hash): one row per non-null key."""
    keys = rows.select(F.col(key_col).cast("string").alias("key")).where("key is not null").distinct()
    return keys.select("key", F.sha2(F.concat(F.lit(salt + ":"), "key"), 256).alias("priority"))


def grow(rows: DataFrame, ledger: DataFrame | None, rate: float, key_col: str = "sample_id", salt: str = "ledger-v1") -> DataFrame:
    """The ledger after one more round: key, priority, round.

    The quota is ceil(rate * distinct keys of rows); earlier keys are all kept.
    """
    if not 0 <= rate <= 1:
        raise ValueError("rate must lie in [0, 1]")
    keys = runtime.written(distinct_keys(rows, key_col, salt), "ledger-keys")
    quota = math.ceil(round(rate * keys.count(), 9))
    if ledger is None:
        return lowest(keys, quota).withColumn("round", F.lit(1))
    earlier = ledger.agg(F.count(F.lit(1)).alias("n"), F.max("round").alias("r")).first()
    unseen = keys.join(ledger.select("key"), "key", "left_anti")
    added = lowest(unseen, quota - earlier.n).withColumn("round", F.lit((earlier.r or 0) + 1))
    return ledger.select("key", "priority", "round").unionByName(added)


def empty_ledger(spark) -> DataFrame:
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("priority", T.StringType()), T.StructField("round", T.IntegerType())])
    return spark.createDataFrame([], schema)


_KEPT = "key string, priority string, round int, table string, batch string"


def _place(spark: SparkSession, name: str, table: str = ""):
    """File system, path of the kept ledgers, and the mark of the table with this path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = path(f"{runtime.shared_folder(spark)}/ledger-{name}")
    qualified = path(table or "/").getFileSystem(conf).makeQualified(path(table or "/")).toString()
    return root.getFileSystem(conf), root, "t" + hashlib.sha256(qualified.encode()).hexdigest()[:32]


def _kept(spark: SparkSession, name: str) -> DataFrame | None:
    fs, root, _ = _place(spark, name)
    return spark.read.schema(_KEPT).option("basePath", root.toString()).parquet(root.toString()) if fs.exists(root) else None


def _once(kept: DataFrame) -> DataFrame:
    return kept.groupBy("key", "priority").agg(F.min("round").alias("round"))


def load(rows: DataFrame, name: str, table: str, key_col: str = "sample_id") -> DataFrame | None:
    """The kept ledger that rows, read from the path table, continue; None if there is none."""
    kept = _kept(rows.sparkSession, name)
    if kept is None:
        return None
    own = _place(rows.sparkSession, name, table)[2]
    present = rows.select(F.col(key_col).cast("string").alias("key")).where("key is not null")
    size = lambda df, n: df.groupBy("table").agg(F.countDistinct("key").alias(n))
    others = kept.where(F.col("table") != own)
    inside = size(others, "n").join(size(others.join(present, "key", "left_semi"), "here"), "table").where("n = here")
    tables = [own, *(r["table"] for r in inside.select("table").collect())]  # a name per kept table
    found = _once(kept.where(F.col("table").isin(tables)))
    return None if found.isEmpty() else found


def save(grown: DataFrame, name: str, table: str) -> DataFrame:
    """Keep the rows that the table's ledger lacks; gives the ledger as kept."""
    spark = grown.sparkSession
    fs, root, own = _place(spark, name, table)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    before, kept = _kept(spark, name), empty_ledger(spark)
    if before is not None:
        kept = _once(before.where(F.col("table") == own))
        grown = grown.join(kept.select("key"), "key", "left_anti")
    batch = uuid.uuid4().hex
    aside, final = path(root, f"_{batch}"), path(root, f"table={own}/batch={batch}")
    grown.select("key", "priority", F.col("round").cast("int").alias("round")).write.option("compression", "zstd").parquet(aside.toString())
    added = spark.read.schema(kept.schema).parquet(aside.toString())
    if added.isEmpty():
        fs.delete(aside, True)
        return kept
    fs.mkdirs(final.getParent())
    if not fs.rename(aside, final):
        raise OSError(f"{aside} could not be renamed to {final}")
    return kept.unionByName(spark.read.schema(kept.schema).parquet(final.toString()))


def two_deliveries(rows: DataFrame, time_col: str, share: float = 0.8) -> DataFrame:
    """The part of rows delivered in the first share of the time span: an earlier snapshot."""
    span = rows.agg(F.min(time_col).alias("a"), F.max(time_col).alias("b")).first()
    if span.a is None:
        return rows.limit(0)
    cut = span.a + (span.b - span.a) * share
    return rows.where(F.col(time_col) <= F.lit(cut))
