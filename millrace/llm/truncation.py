"""Text cut off by field limits: hashed logistic regression on artificial cuts.

Intact values of a bounded, documented sample are cut at random places to make positives; the
values as they are, are the negatives. A first model finds the values of the sample that were
cut already and takes them out of the negatives; the third model is the result. Features are
the closing characters, words and punctuation, open delimiters and reasoning over the whole
text, and how near the record's token count is to its limit; an artificial cut keeps the count
of the uncut record, so that the model learns not to rely on it. Other stop fields are not
read, since they often disagree with the text. The threshold is calibrated on held-out values.
Every record is scored.

Defined results for odd input: null and blank values and stand-ins for no answer are not cut; records without
a token count are judged by their text; very long texts are scored whole; repeated
records are scored each; an empty table gives an empty result; only named columns are read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import linear
from millrace.llm.ending import cut, ending_features, says_nothing, without_markers
from millrace.llm.pairdefects import bare, refusal
from millrace.operators import sampling

#: Fixed value: most tokens that were generated in the records of the default table.
LIMIT = 2048


def _limit_features(tokens: int | None, limit: int) -> list[str]:
    near = "null" if tokens is None else "at" if tokens >= limit else "near" if tokens >= 0.95 * limit else "below"
    return [f"limit={near}"]


def features(text: str, tokens: int | None, limit: int = LIMIT) -> np.ndarray:
    return linear.hashed(ending_features(text) + _limit_features(tokens, limit))


class Sample:
    """Intact values of (output, prompt, tokens) and how to cut them.

    Prompts and declining answers are intact texts too: they end otherwise than solutions do;
    so are bare closings, alone or behind other text.
    """

    def __init__(self, rows: list[tuple[str | None, str | None, int | None]], seed: int, limit: int):
        rng = random.Random(seed)
        self.seed, self.limit = seed, limit
        self.values = [(t, n) for t, _, n in rows if not says_nothing(t)]
        self.values += [(p, n) for _, p, n in rows[::4] if not says_nothing(p)]
        self.values += [(refusal(rng.choice(("en", "en", "en", "fr", "es", "de", "ru", "zh")), rng), n) for _, _, n in rows[::40]]

    def examples(self, k: int) -> list[tuple[int, np.ndarray]]:
        """(label, features): -2 as it is, 1 cut, -1 its closing alone."""
        rng = random.Random(f"{self.seed}:{k}")
        text, tokens = self.values[k]
        out = [(-2, text)] + [(1, c) for _ in range(2) if (c := cut(text, rng))]
        if rng.random() < 0.3 and (closing := bare(text, rng)):
            lead = re.match(r"[^.!?。！？\n]{10,}[.。]", without_markers(self.values[rng.randrange(len(self.values))][0]))
            out.append((-1, f"{lead.group()}\n\n{closing}" if lead and rng.random() < 0.6 else closing))
        return [(label, features(t, tokens, self.limit)) for label, t in out]


def fit(origin: np.ndarray, label: np.ndarray, rows: linear.Rows, values: int) -> linear.Linear:
    """The model of intact against cut values; a first one finds what was cut already."""
    natural = np.flatnonzero(label == -2)
    at = np.empty(values, np.int64)
    at[origin[natural]] = natural
    keep, cut_already, model = np.ones(values, bool), np.zeros(values, bool), linear.Linear.blank(["truncated"], 1.0)
    for epochs in (6, 6, 12):
        used = np.flatnonzero(np.where(label == -2, (keep | cut_already)[origin], (label == 1) | keep[origin]))
        truth = np.where(label[used] == -2, cut_already[origin[used]], label[used] == 1).astype(float)[:, None]
        held = origin[used] % 5 == 0
        part = ~held if (~held).any() else np.ones(len(used), bool)
        model = linear.train(["truncated"], rows.take(used[part]), truth[part], epochs)
        if held.any():
            linear.calibrate(model, rows.take(used[held]), truth[held], np.where(truth[held, 0] > 0, 0.2, 1.0))
        found = model.scores(rows.take(at))[:, 0]
        keep, cut_already = found < 0.5, found > 0.97
        if not keep.any():
            break
    return model


def train(spark: SparkSession, rows: list[tuple[str | None, str | None, int | None]], seed: int = 11, limit: int = LIMIT) -> linear.Linear:
    """The model of a bounded sample; its features are computed on the cluster."""
    sample = Sample(rows, seed, limit)
    if not sample.values:
        return linear.Linear.blank(["truncated"], 1.0)
    return fit(*linear.gathered(spark, sample, len(sample.values)), len(sample.values))


def _scored(model_bc, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: linear.Linear = model_bc.value
        for batch in batches:
            texts, tokens = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            blank = np.array([says_nothing(t) for t in texts], bool)
            rows = [np.zeros(0, np.int32) if b else features(t, n, limit) for t, n, b in zip(texts, tokens, blank)]
            scores = model.scores(rows)[:, 0]
            scores[blank] = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(scores), pa.array((scores > model.thresholds[0]) & ~blank)], names=["id", "source", "score", "truncated"])

    return run


def scores(rows: DataFrame, id_col: str = "record_id", text_col: str = "output", prompt_col: str = "prompt", tokens_col: str = "generated_tokens", source_col: str | None = None, limit: int = LIMIT, sample_rows: int = 6000) -> DataFrame:
    """id, source (null if no column is named), score, truncated for every row; at most sample_rows rows are used for training."""
    spark = rows.sparkSession
    base = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(tokens_col).cast("int").alias("tokens"), (F.col(source_col) if source_col else F.lit(None)).cast("string").alias("source"))
    sample = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(prompt_col).alias("prompt"), F.col(tokens_col).cast("int").alias("tokens"))
    sample = sampling.bounded(sample, ["id"], sample_rows).select("text", "prompt", "tokens").toArrow()
    model = train(spark, list(zip(*(sample.column(i).to_pylist() for i in range(3)))), limit=limit)
    model_bc = spark.sparkContext.broadcast(model)  # fixed size
    return base.mapInArrow(_scored(model_bc, limit), "id bigint, source string, score double, truncated boolean")


def rates(scored: DataFrame) -> DataFrame:
    """source, records, truncated, rate."""
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.count_if("truncated").alias("truncated"), F.round(F.avg(F.col("truncated").cast("int")), 6).alias("rate"))
