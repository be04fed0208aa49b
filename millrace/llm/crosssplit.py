"""Same or near-same records across splits: a weighted cosine join.

Each distinct problem text is a vector of its words, weighted by the square root of the
word's frequency, so that its squared norm is its word count n. Two texts whose word edit
distance is at most a fifth of the longer one share at least 0.8 * max(n) words with
multiplicity, hence by Cauchy-Schwarz their dot product is at least 0.8 * max(n): the join
threshold loses no pair. Words holding a digit must agree in order, so inverted lists are
kept per digit-word sequence; inside a list these words contribute a constant and form one
block at the end of the term order.

Only a prefix of each vector enters the inverted lists: rarest terms first, up to the point
where neither the maximum weight of the remaining terms in the other split nor their residual
norm can still reach the threshold. Candidates are cut again by length and by the product of
residual norms, then exact dot products and the exact word edit distance decide.

Term frequencies and maximum weights are histograms over a fixed number of hash buckets, so
what is broadcast does not grow with the data; collisions only affect the term order.

Defined results for odd input: null ids and null problems take no part in the text join;
texts without words match only texts without words (distance 0 of 0 is no near-copy, so they
give no pair); repeated rows count once; empty tables give empty results; only the named
columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from unicodedata import category
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import runtime
from millrace.functions.text import words

BUCKETS = 1 << 18


def _bucket(term: str) -> int:
    return crc32(term.encode()) & (BUCKETS - 1)


def _has_digit(term: str) -> bool:
    return any(category(c)[0] == "N" for c in term)  # str.isnumeric also holds for letters such as U+5341


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket the number of texts with the term and the largest term frequency."""
    texts = np.zeros(BUCKETS, np.int64)
    most = np.zeros(BUCKETS, np.int32)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for term, tf in Counter(text.split(" ")).items():
                b = _bucket(term)
                texts[b] += 1
                if tf > most[b]:
                    most[b] = tf
    used = np.flatnonzero(texts)
    for start in range(0, len(used), 50_000):
        part = used[start : start + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(texts[part]), pa.array(most[part])], names=["bucket", "texts", "most"])


def prefix_terms(text: str, counts: np.ndarray, most: np.ndarray, threshold: float) -> tuple[str, int, list[tuple[str, float]]]:
    """(digit sequence, n, [(term, residual squared norm from that term on)]) of one text.

    The digit-word block is the pseudo-term '' at the end of the order.
    """
    split = text.split(" ")
    digits = [w for w in split if _has_digit(w)]
    tf = Counter(w for w in split if not _has_digit(w))
    n, block = len(split), float(len(digits))
    order = sorted(((counts[b := _bucket(w)], w, c, most[b]) for w, c in tf.items()), key=lambda x: (x[0], x[1]))
    residual = float(n)
    reachable = block + sum(math.sqrt(c * float(m)) for _, _, c, m in order)  # by the other side's maximum weights
    need = threshold * n - 1e-9
    out = []
    # dot <= ||suffix|| * ||other|| and dot >= threshold * max(n) give residual >= threshold^2 * n
    least = threshold * threshold * n - 1e-9
    for _, w, c, m in order:
        if residual < least or reachable < need:
            return " ".join(digits), n, out
        out.append((w, residual))
        residual -= c
        reachable -= math.sqrt(c * float(m))
    if block and residual >= least and reachable >= need:
        out.append(("", residual))
    return " ".join(digits), n, out


def _prefixes(counts_bc, most_bc, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, most = counts_bc.value, most_bc.value
        for batch in batches:
            keys, terms, sizes, residuals = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                digits, n, out = prefix_terms(text, counts, most, threshold)
                for term, residual in out:
                    keys.append(key)
                    terms.append(digits + "\x1f" + term)
                    sizes.append(n)
                    residuals.append(residual)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(terms, pa.string()), pa.array(sizes, pa.int32()), pa.array(residuals, pa.float64())], names=["doc", "term", "n", "residual"])

    return run


def word_distance(a: list, b: list, most: int) -> int:
    """Least number of words to insert, delete or replace; most + 1 if it is more than most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    end_a, end_b = len(a), len(b)
    while end_a > start and end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    a, b = a[start:end_a], b[start:end_b]
    if not a or not b:
        return len(a) + len(b)
    far = most + 1
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        new = [far] * (len(b) + 1)
        if i <= most:
            new[0] = i
        for j in range(low, high + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1, far)
        row = new
        if min(row) > most:
            return far
    return min(row[-1], far)


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, dots = [], []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = ta.split(" "), tb.split(" ")
                ca, cb = Counter(a), Counter(b)
                dot = sum(math.sqrt(c * cb[w]) for w, c in ca.items() if w in cb)
                longest = max(len(a), len(b))
                near = dot >= threshold * longest - 1e-9
                if near:
                    most = int((1 - threshold) * longest + 1e-9)
                    near = word_distance(a, b, most) <= most and [w for w in a if _has_digit(w)] == [w for w in b if _has_digit(w)]
                keep.append(near)
                dots.append(dot / math.sqrt(len(a) * len(b)))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), pa.array(dots, pa.float64()).filter(mask)], names=["doc_a", "doc_b", "cosine"])

    return run


def near_texts(left: DataFrame, right: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_a, doc_b, cosine: near-same texts between two relations of (doc BINARY, text STRING).

    text holds the blank-joined words; docs are distinct per side. All pairs come out.
    """
    spark = left.sparkSession
    both = left.select("text", "doc").unionByName(right.select("text", "doc")).dropDuplicates(["doc"]).select("text")
    histogram = both.mapInArrow(_histogram, "bucket int, texts bigint, most int").groupBy("bucket").agg(F.sum("texts").alias("texts"), F.max("most").alias("most"))
    counts, most = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int32)
    table = histogram.toArrow()  # at most BUCKETS rows
    at = table.column("bucket").to_numpy()
    counts[at], most[at] = table.column("texts").to_numpy(), table.column("most").to_numpy()
    counts_bc, most_bc = spark.sparkContext.broadcast(counts), spark.sparkContext.broadcast(most)

    def lists(side: DataFrame, s: str) -> DataFrame:
        schema = "doc binary, term string, n int, residual double"
        out = side.select("doc", "text").mapInArrow(_prefixes(counts_bc, most_bc, threshold), schema)
        return out.select(F.col("doc").alias(f"doc_{s}"), F.xxhash64("term").alias("term"), F.col("n").alias(f"n_{s}"), F.col("residual").alias(f"r_{s}"))

    longest = F.greatest("n_a", "n_b")
    candidates = (
        lists(left, "a")
        .join(lists(right, "b"), "term")
        .where((F.least("n_a", "n_b") >= threshold * longest - 1e-9) & (F.sqrt(F.col("r_a") * F.col("r_b")) >= threshold * longest - 1e-9))
        .select("doc_a", "doc_b")
        .distinct()
    )
    texts = candidates.join(left.select(F.col("doc").alias("doc_a"), F.col("text").alias("text_a")), "doc_a").join(right.select(F.col("doc").alias("doc_b"), F.col("text").alias("text_b")), "doc_b")
    return texts.select("doc_a", "doc_b", "text_a", "text_b").mapInArrow(_verified(threshold), "doc_a binary, doc_b binary, cosine double")


def split_overlaps(train: DataFrame, evaluation: DataFrame, problems: DataFrame, id_col: str = "sample_id", text_col: str = "problem", threshold: float = 0.8) -> DataFrame:
    """train_id, eval_id: the same id in both splits, or ids whose problems are nearly the same."""
    train_ids = train.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    eval_ids = evaluation.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    same = train_ids.join(eval_ids, "id", "left_semi").select(F.col("id").alias("train_id"), F.col("id").alias("eval_id"))
    texts = (
        problems.select(F.col(id_col).alias("id"), F.array_join(words(F.col(text_col)), " ").alias("text"))
        .where("id is not null and text != ''")
        .select("id", "text", F.unhex(F.md5("text")).alias("doc"))
    )
    placed = texts.join(train_ids, "id", "left_semi").withColumn("side", F.lit("a")).unionByName(texts.join(eval_ids, "id", "left_semi").withColumn("side", F.lit("b")))
    placed = runtime.written(placed.dropDuplicates(["id", "doc", "side"]), "split-texts")
    left, right = placed.where("side = 'a'"), placed.where("side = 'b'")
    sides = [x.dropDuplicates(["doc"]).select("doc", "text") for x in (left, right)]
    pairs = near_texts(*sides, threshold=threshold).select("doc_a", "doc_b")
    members = [x.select(F.col("doc").alias(f"doc_{s}"), F.col("id").alias(name)).distinct() for x, s, name in ((left, "a", "train_id"), (right, "b", "eval_id"))]
    near = pairs.join(members[0], "doc_a").join(members[1], "doc_b").select("train_id", "eval_id")
    return same.unionByName(near).distinct()


def unordered_pairs(overlaps: DataFrame) -> DataFrame:
    """sample_id_a <= sample_id_b, each pair once."""
    return overlaps.select(F.least("train_id", "eval_id").alias("sample_id_a"), F.greatest("train_id", "eval_id").alias("sample_id_b")).distinct()


def overlap_counts(overlaps: DataFrame, evaluation: DataFrame, split_col: str = "eval_split") -> DataFrame:
    """eval_split, source, overlapping: evaluation ids with an overlap, per split and source."""
    hit = overlaps.select(F.col("eval_id").alias("sample_id")).distinct()
    rows = evaluation.select("sample_id", F.col(split_col).alias("eval_split"), F.col("metadata.source").alias("source")).distinct()
    return rows.join(hit, "sample_id", "left_semi").groupBy("eval_split", "source").agg(F.countDistinct("sample_id").alias("overlapping"))
