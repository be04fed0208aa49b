"""The metric-stream guard on Structured Streaming, with state per run.

State is recovered from the query's checkpoint, and every input row is consumed once. Events
of a micro-batch are ordered by step within a run; the batch form of the guard is the oracle.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.guard import GRAD_FACTOR, LOSS_FACTOR, STREAK, WINDOW

EVENT_SCHEMA = "run string, event string, optimizer_step bigint, mean_loss double, grad_norm double"
_OUT = "run string, optimizer_step bigint, reason string"
_STATE = "losses array<double>, grads array<double>, loss_streak int, grad_streak int, tripped boolean"


class Guard:
    """Two windows of past values and two streaks."""

    def __init__(self, state=None, window: int = WINDOW, streak: int = STREAK):
        self.window, self.streak = window, streak
        self.losses, self.grads, self.loss_streak, self.grad_streak, self.tripped = state or ([], [], 0, 0, False)
        self.losses, self.grads = list(self.losses), list(self.grads)

    def observe(self, loss: float | None, grad: float | None) -> str | None:
        """The reason if this observation completes a streak."""
        self.loss_streak = self.loss_streak + 1 if self._spike(self.losses, loss, LOSS_FACTOR) else 0
        self.grad_streak = self.grad_streak + 1 if self._spike(self.grads, grad, GRAD_FACTOR) else 0
        for past, value in ((self.losses, loss), (self.grads, grad)):
            past.append(value)
            del past[: -self.window]
        return "loss_spike" if self.loss_streak >= self.streak else "grad_norm_spike" if self.grad_streak >= self.streak else None

    def _spike(self, past: list, value, factor: float) -> bool:
        return value is not None and len(past) == self.window and None not in past and value > factor * median(past)

    def state(self) -> tuple:
        return (self.losses, self.grads, self.loss_streak, self.grad_streak, self.tripped)


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    guard = Guard(state.get if state.exists else None)
    rows = pd.concat(list(batches)).sort_values("optimizer_step", kind="stable")  # one run's part of a micro-batch
    out = []
    none = lambda x: None if pd.isna(x) else float(x)
    for step, loss, grad in zip(rows["optimizer_step"], rows["mean_loss"], rows["grad_norm"]):
        reason = guard.observe(none(loss), none(grad))
        if reason and not guard.tripped:
            guard.tripped = True
            out.append((key[0], int(step), reason))
    state.update(guard.state())
    yield pd.DataFrame(out, columns=["run", "optimizer_step", "reason"])


def guard_stream(events: DataFrame) -> DataFrame:
    """run, optimizer_step, reason of each run's first trip, from a stream of EVENT_SCHEMA."""
    train = events.where("event = 'train'").select("run", "optimizer_step", "mean_loss", "grad_norm")
    return train.groupBy("run").applyInPandasWithState(_step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def metric_log(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of appended JSON lines as a stream."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)
