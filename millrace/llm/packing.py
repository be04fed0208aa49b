"""Filling fixed-capacity sequences with records: bound-certified repacking.

Records are spread by hash over partitions of a stated size; each partition packs its lengths
by best-fit decreasing and compares its sequence count with the largest of several lower
bounds from dual feasible functions. Partitions that meet their bound are certified and done.
The others give the records of their loosely filled sequences to an exchange: they are hashed
together anew and best-fit decreasing runs again, for a stated number of rounds. Only lengths
and keys travel; no partition grows with the data.

A record longer than the capacity is cut into full pieces and a rest; all others stay whole.

Defined results for odd input: records with a null or empty id, null, empty or unequally long
lists, null elements, or no supervised label after the first position are invalid: they are in
no sequence and are counted by reason. Records delivered twice are packed each: variant is the
hash of the delivered record, copy tells equal ones apart (1, 2, ...). Ties in length are ordered by key. An empty table gives no sequences. Only
the named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import runtime

IGNORED = -100


def reason(ids: str = "input_ids", labels: str = "labels", key: str = "sample_id"):
    """Why a record is invalid, null for valid ones."""
    supervised = F.exists(F.slice(labels, 2, F.greatest(F.size(labels), F.lit(1))), lambda x: x != IGNORED)
    return (
        F.when(F.coalesce(F.length(F.trim(F.col(key))), F.lit(0)) == 0, "missing_id")
        .when(F.col(ids).isNull() | F.col(labels).isNull(), "null_list")
        .when(F.size(ids) == 0, "empty_ids")
        .when(F.size(ids) != F.size(labels), "length_mismatch")
        .when(F.exists(ids, lambda x: x.isNull()) | F.exists(labels, lambda x: x.isNull()), "null_element")
        .when(~F.coalesce(supervised, F.lit(False)), "no_supervision")
    )


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Least number of sequences for a histogram of lengths (index = length), certified.

    The largest of: total length over capacity; the bound that pairs pieces over half the
    capacity with those too long to join them, for every threshold; and the stepped dual
    feasible functions u(k).
    """
    lengths = np.arange(capacity + 1, dtype=np.int64)
    total = int((counts * lengths).sum())
    if not total:
        return 0
    best = -(-total // capacity)
    number, amount = np.cumsum(counts), np.cumsum(counts * lengths)
    half = capacity // 2
    for a in np.flatnonzero(counts[: half + 1]).tolist() + [max(half, 1)]:
        alone = int(number[capacity] - number[capacity - a]) if a else 0
        top = capacity - a if a else capacity
        middle, middle_sum = (int(number[top] - number[half]), int(amount[top] - amount[half])) if top > half else (0, 0)
        small = int(amount[half] - (amount[a - 1] if a else 0)) if a <= half else 0
        best = max(best, alone + middle + max(0, -(-(small - (middle * capacity - middle_sum)) // capacity)))
    for k in range(1, 21):
        scaled = (k + 1) * lengths
        exact = scaled % capacity == 0
        value = np.where(exact, lengths * k, (scaled // capacity) * capacity)  # u(k) times capacity * k
        best = max(best, -(-int((counts * value).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin of each item, offset of each item, free space of each bin); lengths sorted descending."""
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    present = 0
    free: list[int] = []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        fits = present >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_at[room].pop()
            if not open_at[room]:
                present ^= 1 << room
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        where[i], offset[i] = b, capacity - room
        room -= size
        free[b] = room
        if room:
            open_at[room].append(b)
            present |= 1 << room
    return where, offset, free


_KEYS = ["sample_id", "variant", "copy", "piece_start"]
_ITEM = "sample_id string, variant bigint, copy bigint, piece_start int, piece_length int"
_PLACED = _ITEM + ", round int, part bigint, bin bigint, position int, done boolean, bound bigint"


def _packer(capacity: int, round_no: int, last: bool):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        pdf = pdf.sort_values(["piece_length", *_KEYS], ascending=[False, True, True, True, True], ignore_index=True)
        lengths = pdf["piece_length"].to_numpy(np.int64)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        where, offset, free = best_fit_decreasing(lengths, capacity)
        loose = np.array(free, np.int64)
        if last or len(free) <= bound:
            open_bin = np.zeros(len(free), bool)
        else:  # the gap: sequences with the most free space, enough of them to remix
            open_bin = loose >= np.sort(loose)[::-1][min(len(free), 4 * (len(free) - bound) + 4) - 1]
            open_bin &= loose > 0
        return pd.DataFrame(
            {
                "sample_id": pdf["sample_id"], "variant": pdf["variant"], "copy": pdf["copy"], "piece_start": pdf["piece_start"], "piece_length": pdf["piece_length"],
                "round": np.int32(round_no), "part": part, "bin": where, "position": offset.astype(np.int32), "done": ~open_bin[where], "bound": bound,
            }
        )

    return pack


def items(rows: DataFrame, capacity: int, block: int = 10_000) -> DataFrame:
    """sample_id, variant, copy, piece_start, piece_length of all valid records.

    Equal records are counted with map-side combine, so a record delivered very often is one
    row in the shuffle; its copies are laid out again in blocks that spread over the tasks.
    """
    valid = rows.select("sample_id", F.size("input_ids").alias("n"), F.xxhash64("recorded_at", "input_ids", "labels").alias("variant"), reason().alias("why")).where("why is null")
    counted = valid.groupBy("sample_id", "variant", "n").agg(F.count(F.lit(1)).alias("m"))
    few = counted.where(F.col("m") <= block).withColumn("first", F.lit(0).cast("bigint"))
    many = counted.where(F.col("m") > block).select("sample_id", "variant", "n", "m", F.explode(F.expr(f"sequence(0L, m - 1, {block}L)")).alias("first")).repartition("sample_id", "first")
    last = F.least(F.col("m"), F.col("first") + block)
    laid = few.unionByName(many).select("sample_id", "variant", "n", F.explode(F.sequence(F.col("first") + 1, last)).alias("copy"))
    cut = laid.select("sample_id", "variant", "copy", "n", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {capacity}").cast("int"))).alias("k"))
    return cut.select("sample_id", "variant", "copy", (F.col("k") * capacity).alias("piece_start"), F.least(F.lit(capacity), F.col("n") - F.col("k") * capacity).alias("piece_length"))


def pack(rows: DataFrame, capacity: int = 1024, part_items: int = 20_000, rounds: int = 3) -> DataFrame:
    """sequence_id, position, sample_id, variant, copy, piece_start, piece_length: every valid piece once."""
    if capacity < 1 or part_items < 1 or rounds < 1:
        raise ValueError("capacity, part_items and rounds must be positive")
    waiting = runtime.written(items(rows, capacity), "pack-items")
    finished = []
    for r in range(1, rounds + 1):
        count = waiting.count()
        if not count and r > 1:
            break
        parts = max(1, math.ceil(count / part_items))
        spread = waiting.select(*_KEYS, "piece_length", F.pmod(F.xxhash64(F.lit(r), *_KEYS), F.lit(parts)).alias("part"))
        placed = runtime.written(spread.groupBy("part").applyInPandas(_packer(capacity, r, r == rounds), _PLACED), f"pack-round-{r}")
        finished.append(placed.where("done"))
        waiting = placed.where("not done")
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    sequence = F.concat_ws("-", "round", "part", "bin")
    return out.select(sequence.alias("sequence_id"), "position", *_KEYS, "piece_length")


def materialize(rows: DataFrame, placed: DataFrame, capacity: int = 1024, pad: int = 0) -> DataFrame:
    """sequence_id, input_ids, labels, segments: the sequences themselves, padded to the capacity.

    segments numbers the pieces of a sequence from 1; padding has 0. The first position of every
    piece is ignored in the labels, since no piece predicts the next one's start.
    """
    content = rows.where(reason().isNull()).select("sample_id", F.xxhash64("recorded_at", "input_ids", "labels").alias("variant"), "input_ids", "labels")
    content = content.groupBy("sample_id", "variant").agg(F.any_value("input_ids").alias("ids"), F.any_value("labels").alias("labels"))
    start, size = F.col("piece_start") + 1, F.col("piece_length")
    masked = F.transform(F.slice("labels", start, size), lambda x, i: F.when(i == 0, IGNORED).otherwise(x))
    pieces = placed.join(content, ["sample_id", "variant"]).select("sequence_id", F.struct("position", F.slice("ids", start, size).alias("ids"), masked.alias("labels")).alias("piece"))
    grouped = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list("piece")).alias("p"))  # at most capacity ids
    fill = lambda c, x: F.concat(c, F.array_repeat(F.lit(x), F.lit(capacity) - F.size(c)))
    numbered = F.flatten(F.transform("p", lambda x, i: F.array_repeat(i + 1, F.size(x["ids"]))))
    return grouped.select("sequence_id", fill(F.flatten("p.ids"), pad).alias("input_ids"), fill(F.flatten("p.labels"), IGNORED).alias("labels"), fill(numbered, 0).alias("segments"))


def pack_report(rows: DataFrame, placed: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row: pieces, sequences, certified lower bound, unused share."""
    lengths = placed.groupBy("piece_length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity rows
    counts = np.zeros(capacity + 1, np.int64)
    for x in lengths:
        counts[x.piece_length] = x.n
    total = int((counts * np.arange(capacity + 1)).sum())
    agg = placed.agg(F.countDistinct("sequence_id").alias("sequences"), F.count(F.lit(1)).alias("pieces"), F.sum("piece_length").cast("bigint").alias("ids"))
    free = F.when(F.col("sequences") > 0, F.round(1 - F.col("ids") / (F.col("sequences") * capacity), 6))
    return agg.select("pieces", "ids", "sequences", F.lit(lower_bound(counts, capacity)).cast("bigint").alias("lower_bound"), free.alias("unused_share"))
