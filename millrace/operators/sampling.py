"""Deterministic samples by hash, at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_BITS = 16


def lowest(keys: DataFrame, count: int, priority: str = "priority", tie: str = "key") -> DataFrame:
    """The count rows with the lowest (priority, tie); priority is a hex digest.

    No global sort and no top-k merge in one task: a histogram over the first 16 bits (a fixed
    65,536 buckets) finds the boundary bucket, whole buckets below it are taken and only the
    boundary bucket is ranked. Reads keys three times; write it first if it is costly.
    """
    if count <= 0:
        return keys.limit(0)
    bucket = F.conv(F.substring(priority, 1, _BITS // 4), 16, 10).cast("int")
    sizes = {r["_b"]: r["n"] for r in keys.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2**16 rows
    taken, boundary = 0, 1 << _BITS
    for b in sorted(sizes):
        if taken + sizes[b] > count:
            boundary = b
            break
        taken += sizes[b]
    keyed = keys.withColumn("_b", bucket)
    whole = keyed.where(F.col("_b") < boundary).drop("_b")
    if boundary == 1 << _BITS or taken == count:
        return whole
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(priority, tie))
    return whole.unionByName(keyed.where(F.col("_b") == boundary).withColumn("_r", rank).where(F.col("_r") <= count - taken).drop("_b", "_r"))


def bounded(rows: DataFrame, key: list[str], count: int) -> DataFrame:
    """At most count rows: those with the lowest 64-bit hash of key.

    Rows are counted first and cut to about twice the wanted number by hash, so the final
    top-k receives a bounded number of rows however many partitions there are.
    """
    total = rows.count()
    h = F.xxhash64(*key)
    if total > 4 * count:
        rows = rows.where(h < -(1 << 63) + int((1 << 64) * 2 * count / total))
    return rows.orderBy(h, *key).limit(count)


def hash_priority(*parts: Column, separator: str = "|") -> Column:
    return F.sha2(F.concat_ws(separator, *parts), 256)
