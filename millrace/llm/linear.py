"""Linear classifiers on hashed features, trained on the driver with numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

WIDTH = 1 << 18
HALF = WIDTH // 2


class _Indices(dict):
    """Feature name -> hashed index, remembered."""

    def __missing__(self, name: str) -> int:
        if len(self) > 400_000:
            self.clear()
        at = self[name] = crc32(name.encode("utf-8", "surrogatepass")) & (HALF - 1)
        return at


_INDICES = _Indices()


def hashed(names: Iterable[str], upper: bool = False) -> np.ndarray:
    """Sorted distinct feature indices of feature names, in the lower or the upper half."""
    found = set(map(_INDICES.__getitem__, names))
    out = np.fromiter(found, np.int32, len(found))
    out.sort()
    return out + HALF if upper else out


class Rows:
    """Feature indices of many examples, one after the other."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat, sizes
        self.starts = np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Rows:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        return cls(np.concatenate(rows) if len(rows) else np.zeros(0, np.int32), sizes)

    def __len__(self) -> int:
        return len(self.sizes)

    def take(self, index: np.ndarray) -> Rows:
        sizes = self.sizes[index]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[index] - (ends - sizes), sizes)
        return Rows(self.flat[at], sizes)

    def lower(self) -> Rows:
        """Without the features of the upper half."""
        keep = self.flat < HALF
        owner = np.repeat(np.arange(len(self)), self.sizes)
        return Rows(self.flat[keep], np.bincount(owner[keep], minlength=len(self)))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per example the sum of values over its features."""
        out = np.zeros((len(self), values.shape[1]))
        filled = self.sizes > 0
        if len(self.flat):
            out[filled] = np.add.reduceat(values[self.flat], self.starts[filled], axis=0)
        return out


class Linear:
    """One logistic model per label over the same features, with a threshold each."""

    def __init__(self, labels: list[str], weights: np.ndarray, bias: np.ndarray, thresholds: np.ndarray):
        self.labels, self.weights, self.bias, self.thresholds = labels, weights, bias, thresholds

    @classmethod
    def blank(cls, labels: list[str], threshold: float = 0.5) -> Linear:
        return cls(labels, np.zeros((WIDTH, len(labels)), np.float32), np.zeros(len(labels)), np.full(len(labels), threshold))

    def scores(self, rows: Rows | list[np.ndarray]) -> np.ndarray:
        """Probabilities, one row per example and one column per label."""
        rows = rows if isinstance(rows, Rows) else Rows.of(rows)
        return 1 / (1 + np.exp(-np.clip(rows.sums(self.weights) + self.bias, -40, 40)))


def _examples(sample_bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, d, f) for k in batch.column(0).to_pylist() for d, f in sample_bc.value.examples(k)]
            origin, label, index = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(origin, pa.int32()), pa.array(label, pa.int32()), pa.array(index, pa.list_(pa.int32()))], names=["origin", "label", "features"])

    return run


def gathered(spark: SparkSession, sample, count: int) -> tuple[np.ndarray, np.ndarray, Rows]:
    """(origin, label, rows) of sample.examples(k) for k below count, computed on the cluster.

    sample is bounded, as the training samples are, so broadcast and result are too.
    """
    tasks = max(1, min(count // 50, 4 * spark.sparkContext.defaultParallelism))
    found = spark.range(0, count, 1, tasks).mapInArrow(_examples(spark.sparkContext.broadcast(sample)), "origin int, label int, features array<int>").toArrow()
    lists = found.column("features").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    origin, label = found.column("origin").to_numpy(), found.column("label").to_numpy()
    order = np.argsort(origin, kind="stable")
    return origin[order], label[order], Rows(lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)).take(order)


def train(labels: list[str], rows: Rows, truth: np.ndarray, epochs: int = 12, rate: float = 0.15, decay: float = 1e-6, seed: int = 7, lower_only: tuple[int, ...] = ()) -> Linear:
    """Adaptive-step stochastic gradient descent on the logistic loss; deterministic.

    Examples are dealt into batches once and the batches are shuffled. The labels in
    lower_only learn from features of the lower half alone.
    """
    rng = np.random.default_rng(seed)
    k = truth.shape[1]
    model = Linear.blank(labels)
    squares, bias_squares = np.full((WIDTH, k), 1e-3, np.float32), np.full(k, 1e-3)
    order, batches = rng.permutation(len(rows)), []
    for start in range(0, len(rows), 256):
        index = order[start : start + 256]
        part = rows.take(index)
        used, at = np.unique(part.flat, return_inverse=True)
        batches.append((Rows(at, part.sizes), used, np.repeat(np.arange(len(index)), part.sizes), truth[index], np.ix_(used >= HALF, lower_only)))
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            part, used, owner, want, fixed = batches[b]
            weights = model.weights[used]
            p = 1 / (1 + np.exp(-np.clip(part.sums(weights) + model.bias, -40, 40)))
            error = (p - want) / len(want)
            slope = np.stack([np.bincount(part.flat, error[owner, c], len(used)) for c in range(k)], 1) + decay * weights
            slope[fixed] = 0
            squares[used] += slope**2
            model.weights[used] = weights - rate * slope / np.sqrt(squares[used])
            total = error.sum(0)
            bias_squares += total**2
            model.bias -= rate * total / np.sqrt(bias_squares)
    return model


def calibrate(model: Linear, rows: Rows, truth: np.ndarray, weight: np.ndarray) -> None:
    """Per label the threshold with the best weighted F1 on held-out examples.

    Among equally good thresholds the middle of the gap is taken.
    """
    scores = model.scores(rows)
    for c in range(truth.shape[1]):
        order = np.argsort(-scores[:, c], kind="stable")
        s, t, w = scores[order, c], truth[order, c], weight[order]
        hit, all_of = np.cumsum(w * t), np.cumsum(w)
        f1 = 2 * hit / np.maximum(all_of + (w * truth[:, c][order]).sum(), 1e-9)
        distinct = np.append(s[1:] != s[:-1], True)
        f1 = np.where(distinct, f1, 0)
        best = int(f1.argmax())
        below = s[best + 1] if best + 1 < len(s) else 0.0
        model.thresholds[c] = np.clip((s[best] + below) / 2, 0.05, 0.95)
