"""Evaluation texts leaking into training text: greedy string tiling over shared seeds.

Seeds are windows of min_words words. The test items' seeds form an index that is broadcast
in blocks of a stated number of words, whatever the number of items: the items are the stated
query set and every block meets all rows. In each row the rolling Karp-Rabin hash of every
window is looked up; hits are extended to maximal common runs on the words themselves, so
hash collisions cannot produce a match. Per row and item the longest non-overlapping runs are
then marked repeatedly (tiles), which catches reordered passages; their words against the
item's are its coverage, and covered_items() gives the texts above a threshold of it.

leaks() asks for one run alone, which tells which item leaked only if it stands in no other
item. Every run is judged at its maximal length; a run that another item shares wholly is
dropped, also across blocks.

Defined results for odd input: null, empty and short texts have no windows and no matches;
items with null or short text match nothing; items with equal texts leak ambiguously and give
no row; repeated rows each count; empty tables give empty results; only named columns are read.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import WORD_PY

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MATCH = "row_id bigint, field string, start int, length int, item_id bigint, item_words int, covered int, tiles int"


def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2**64) of all windows of n ids."""
    size = len(ids) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(size, np.uint64)
    for k in range(n):
        h = h * _BASE + ids[k : k + size]
    return h


class SeedIndex:
    """Word ids and seed positions of a block of items."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n = n
        self.ids = [i for i, _ in items]
        split = [re.findall(WORD_PY, (t or "").lower()) for _, t in items]
        self.vocabulary: dict[str, int] = {}
        for ws in split:
            for w in ws:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 2)
        self.words = [np.array([self.vocabulary[w] for w in ws], np.uint64) for ws in split]
        hashes, where = [], []
        for k, ws in enumerate(self.words):
            h = _rolling(ws, n)
            hashes.append(h)
            where.append(np.stack([np.full(len(h), k, np.int64), np.arange(len(h))], 1))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        at = np.concatenate(where) if where else np.zeros((0, 2), np.int64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.at = h[order], at[order]

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window positions whose hash is a seed, with the range of seeds."""
        h = _rolling(ids, self.n)
        if not len(h) or not len(self.hashes):
            z = np.zeros(0, np.int64)
            return z, z, z
        known = ids > 0
        run = np.cumsum(~known)
        whole = np.concatenate([[0], run])
        clean = whole[self.n :] == whole[: len(whole) - self.n]
        at = np.flatnonzero(clean)
        low = np.searchsorted(self.hashes, h[at], "left")
        hit = (low < len(self.hashes)) & (self.hashes[np.minimum(low, len(self.hashes) - 1)] == h[at])
        at, low = at[hit], low[hit]
        return at, low, np.searchsorted(self.hashes, h[at], "right")

    def runs(self, ids: np.ndarray, at, low, high) -> dict[int, list[tuple[int, int, int]]]:
        """Maximal common runs of one text: item -> [(start, item start, length)]."""
        n, out = self.n, defaultdict(list)
        reached: dict[tuple[int, int], int] = {}
        for p, a, b in zip(at.tolist(), low.tolist(), high.tolist()):
            for k, q in self.at[a:b].tolist():
                if reached.get((k, p - q), -1) >= p + n:
                    continue  # inside the run before it
                item = self.words[k]
                if not np.array_equal(ids[p : p + n], item[q : q + n]):
                    continue
                end = n
                most = min(len(ids) - p, len(item) - q)
                while end < most and ids[p + end] == item[q + end]:
                    end += 1
                reached[(k, p - q)] = p + end
                out[k].append((p, q, end))
        return out


def tiling(runs: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: mark the longest unmarked run, trim the others, repeat.

    Runs wait in a heap; what is marked meanwhile is cut out of a run when its turn comes, so
    every run is trimmed a few times, not once per tile.
    """
    heap = [(-m, p, q) for p, q, m in set(runs)]
    heapq.heapify(heap)
    in_text, in_item, tiles = _Marked(), _Marked(), []
    while heap:
        m, p, q = heapq.heappop(heap)
        parts = [(a + x, q + a + x - p, y - x) for a, b in in_text.free(p, p - m) for x, y in in_item.free(q + a - p, q + b - p, shift=True) if y - x >= least]
        if parts == [(p, q, -m)]:
            tiles.append((p, q, -m))
            in_text.mark(p, p - m)
            in_item.mark(q, q - m)
        else:
            for part in parts:
                heapq.heappush(heap, (-part[2], part[0], part[1]))
    return tiles


class _Marked:
    """Disjoint marked intervals."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def mark(self, start: int, end: int) -> None:
        at = bisect.bisect(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)

    def free(self, start: int, end: int, shift: bool = False) -> list[tuple[int, int]]:
        """The unmarked parts of an interval, relative to its start on request."""
        out, at = [], start
        k = bisect.bisect_right(self.ends, start)
        while k < len(self.starts) and self.starts[k] < end:
            if self.starts[k] > at:
                out.append((at, self.starts[k]))
            at = max(at, self.ends[k])
            k += 1
        if at < end:
            out.append((at, end))
        return [(x - start, y - start) for x, y in out] if shift else out


def owned_runs(runs: dict[int, list[tuple[int, int, int]]]) -> list[tuple[int, int, int | None]]:
    """(start, length, item or None) of each span once; None where another item explains all of it.

    One sweep over the spans by start keeps the furthest end of two different items, so a span
    is compared with none of the others.
    """
    spans = defaultdict(set)
    for k, found in runs.items():
        for p, _, size in found:
            spans[(p, -p - size)].add(k)
    out: list[tuple[int, int, int | None]] = []
    first, second = (-1, -1), (-1, -1)  # (end, item), of different items
    for (start, end), owners in sorted(spans.items()):  # equal starts: the longest first
        end = -end
        for k in owners:
            if k == first[1] or end > first[0]:
                first, second = (max(first[0], end), k), (second if k == first[1] else first)
            elif end > second[0]:
                second = (end, k)
        k = next(iter(owners)) if len(owners) == 1 else None
        if k is not None and (first if first[1] != k else second)[0] >= end:
            k = None
        out.append((start, end - start, k))
    return out


def text_matches(index: SeedIndex, ids: np.ndarray, at, low, high) -> list[tuple]:
    """(start, length, item or None, item words, covered, tiles) of one text.

    Item is None for a span that another item of the block explains as well. Each item is tiled
    once; its coverage stands in a row of its own, with length 0.
    """
    runs = index.runs(ids, at, low, high)
    out = [(start, size, None if k is None else index.ids[k], None, None, None) for start, size, k in owned_runs(runs)]
    for k, found in runs.items():
        tiles = tiling(found, index.n)
        out.append((0, 0, index.ids[k], len(index.words[k]), sum(t[2] for t in tiles), len(tiles)))
    return out


def _scan(index_bc, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: SeedIndex = index_bc.value
        find_words, get, n = re.compile(WORD_PY).findall, index.vocabulary.get, index.n
        for batch in batches:
            out: list[tuple] = []
            for f, field in enumerate(fields, 1):
                rows = batch.column(0).to_pylist()
                ids: list[int] = []
                starts = []
                for text in batch.column(f).to_pylist():
                    starts.append(len(ids))
                    if text:
                        ids += [get(w, 0) for w in find_words(text.lower())]
                    ids.append(0)  # an unknown word ends every text
                flat = np.array(ids, np.uint64)
                at, low, high = index.find(flat)
                if not len(at):
                    continue
                starts = np.array(starts + [len(ids)])
                owner = np.searchsorted(starts, at, "right") - 1
                for t in np.unique(owner).tolist():
                    m = owner == t if len(at) < 64 else slice(*np.searchsorted(owner, [t, t + 1]))
                    base = int(starts[t])
                    text_ids = flat[base : int(starts[t + 1])]
                    for s, size, item, item_words, covered, tiles in text_matches(index, text_ids, at[m] - base, low[m], high[m]):
                        out.append((rows[t], field, s, size, item, item_words, covered, tiles))
            columns = list(zip(*out)) if out else [()] * 8
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            names = ["row_id", "field", "start", "length", "item_id", "item_words", "covered", "tiles"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def matches(rows: DataFrame, id_col: str, text_cols: list[str], items: DataFrame, item_id: str, item_text: str, min_words: int = 8, block_words: int = 1_000_000) -> list[DataFrame]:
    """Per block of items: runs (length > 0) and tilings (length 0) of all rows."""
    spark = rows.sparkSession
    items = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = -(-total // block_words) or 1
    rows = rows.select(F.col(id_col).cast("bigint").alias("row_id"), *[F.col(c).alias(f"text_{k}") for k, c in enumerate(text_cols)]).where("row_id is not null")
    parts = []
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else items
        index = spark.sparkContext.broadcast(SeedIndex([(r.item_id, r.text) for r in block.sort("item_id").toLocalIterator()], min_words))
        parts.append(rows.mapInArrow(_scan(index, text_cols), _MATCH))
    return parts


def leaks(rows: DataFrame, id_col: str, text_cols: list[str], items: DataFrame, item_id: str, item_text: str, min_words: int = 8, block_words: int = 1_000_000) -> DataFrame:
    """row_id, field, start, length, item_id: runs of at least min_words words that one item alone explains."""
    parts = matches(rows, id_col, text_cols, items, item_id, item_text, min_words, block_words)
    found = reduce(DataFrame.unionByName, parts).where("length > 0").select("row_id", "field", "start", "length", "item_id")
    if len(parts) == 1:
        return found.where("item_id is not null")
    spans = found.select(F.col("row_id").alias("r"), F.col("field").alias("f"), F.col("start").alias("s"), F.col("length").alias("l"), F.col("item_id").alias("i")).distinct()
    shared = (F.col("row_id") == F.col("r")) & (F.col("field") == F.col("f")) & (F.col("s") <= F.col("start")) & (F.col("s") + F.col("l") >= F.col("start") + F.col("length")) & (F.col("i").isNull() | (F.col("i") != F.col("item_id")))
    return found.where("item_id is not null").join(spans, shared, "left_anti")


def leaked_items(found: DataFrame) -> DataFrame:
    """item_id, row_id: each affected pair once."""
    return found.select("item_id", "row_id").distinct()


def covered_items(rows: DataFrame, id_col: str, text_cols: list[str], items: DataFrame, item_id: str, item_text: str, min_words: int = 5, min_coverage: float = 0.8) -> DataFrame:
    """item_id, row_id, field, item_words, covered, tiles: texts whose tiles cover at least min_coverage of an item.

    Tiles are at least min_words words and may stand in any order, so a text that holds an
    item's passages reordered or apart is found; an item shorter than min_words cannot be.
    """
    parts = matches(rows, id_col, text_cols, items, item_id, item_text, min_words)
    tiled = reduce(DataFrame.unionByName, parts).where("length = 0")
    return tiled.where(F.col("covered") >= F.col("item_words") * min_coverage - 1e-9).select("item_id", "row_id", "field", "item_words", "covered", "tiles")


def leak_report(found: DataFrame) -> DataFrame:
    """item_id, rows, longest_run."""
    per = found.groupBy("item_id", "row_id").agg(F.max("length").alias("longest"))
    return per.groupBy("item_id").agg(F.count(F.lit(1)).alias("rows"), F.max("longest").alias("longest_run"))
