"""Training records: conversations, labels, padding, batches and epoch order."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import let

IGNORED = -100


def assemble_messages(turns: DataFrame, conversation: str, order: str, role: str, text: str) -> DataFrame:
    """One row per conversation with its messages in order."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("order"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return turns.groupBy(conversation).agg(F.transform(packed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def chatml(messages: Column, generation_prompt: bool = False) -> Column:
    """ChatML text of an array of role/content structs."""
    parts = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n")))
    text = F.array_join(parts, "")
    return F.concat(text, F.lit("<|im_start|>assistant\n")) if generation_prompt else text


#: Ids of the byte tokenizer's special tokens, after the 256 bytes.
BYTE_SPECIALS = {"<|im_start|>": 256, "<|im_end|>": 257}


def byte_tokens(texts: list[str]) -> list[list[int]]:
    """A tokenizer without a vocabulary: one id per byte and per special token."""
    parts = re.compile("(" + "|".join(map(re.escape, BYTE_SPECIALS)) + ")").split
    return [[i for part in parts(t) for i in ((BYTE_SPECIALS[part],) if part in BYTE_SPECIALS else part.encode("utf-8", "surrogatepass"))] for t in texts]


def tokenized(text: Column, tokenizer: Callable[[list[str]], list[list[int]]] = byte_tokens) -> Column:
    """Ids of a text by a tokenizer, in Arrow batches; null stays null. Each worker loads it once."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            given = texts.notna().to_numpy()
            ids = iter(tokenizer(texts[given].tolist()))
            yield pd.Series([next(ids) if ok else None for ok in given], dtype=object)

    return run(text)


def sft_sample(rows: DataFrame, messages: str, tokenizer: Callable[[list[str]], list[list[int]]] = byte_tokens, end_token: int = BYTE_SPECIALS["<|im_end|>"]) -> DataFrame:
    """Adds input_ids, labels and token_error of one user and one assistant message in ChatML.

    A conversation that cannot be labelled has null labels and the reason in token_error.
    """
    prompt = F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0)))
    out = rows.withColumns({"input_ids": tokenized(chatml(F.col(messages)), tokenizer), "_prompt": tokenized(chatml(prompt, generation_prompt=True), tokenizer)})
    n = F.size("_prompt")
    answer = F.slice("input_ids", n + 1, F.greatest(F.size("input_ids") - n, F.lit(0)))
    error = (
        F.when(F.coalesce(F.exists(messages, lambda m: m["role"].isNull() | m["content"].isNull()), F.lit(True)), "the conversation cannot be rendered")
        .when(F.slice("input_ids", 1, n) != F.col("_prompt"), "the prompt is not a prefix of the conversation")
        .when(F.array_position(answer, F.lit(end_token)) == 0, "no end token after the prompt")
    )
    out = out.withColumn("token_error", error)
    return out.withColumn("labels", F.when(F.col("token_error").isNull(), assistant_labels(F.col("input_ids"), F.col("_prompt"), end_token))).drop("_prompt")


def assistant_labels(full: Column, prompt: Column, end_token: int) -> Column:
    """Labels of a rendered conversation: ids after the prompt through the first end token.

    Raises where the prompt is no prefix or no end token follows it.
    """
    wrong = lambda why: F.raise_error(why).cast("array<int>")

    def labels(r: Column) -> Column:
        ids, n = r["ids"], r["n"]
        end = F.array_position(F.slice(ids, n + 1, F.greatest(F.size(ids) - n, F.lit(0))), F.lit(end_token)).cast("int")
        kept = let(F.struct(ids.alias("ids"), n.alias("n"), end.alias("end")), lambda s: F.transform(s["ids"], lambda x, i: F.when((i >= s["n"]) & (i < s["n"] + s["end"]), x).otherwise(IGNORED)))
        return F.when(F.slice(ids, 1, n) != r["prompt"], wrong("the prompt is not a prefix of the conversation")).when(end == 0, wrong("no end token after the prompt")).otherwise(kept)

    return let(F.struct(full.alias("ids"), prompt.alias("prompt"), F.size(prompt).alias("n")), labels)


def masked_labels(ids: Column, mask: Column) -> Column:
    """ids where the mask holds, else the ignored label; lists of unequal length, empty ones and masks that hold nowhere raise."""
    wrong = lambda why: F.raise_error(why).cast("array<int>")
    made = lambda r: F.zip_with(r["ids"], r["mask"], lambda x, m: F.when(m, x).otherwise(IGNORED))
    checked = lambda r: (
        F.when(F.size(r["ids"]) != F.size(r["mask"]), wrong("ids and mask must be equally long")).when(F.size(r["ids"]) == 0, wrong("ids must not be empty")).when(~F.exists(r["mask"], lambda m: m), wrong("the mask must hold somewhere")).otherwise(made(r))
    )
    return let(F.struct(ids.alias("ids"), mask.alias("mask")), checked)


def full_labels(ids: Column) -> Column:
    """Every id is its own label."""
    return F.transform(ids, lambda x: x)


def supervised_tokens(labels: Column) -> Column:
    """Labels that count after the causal shift."""
    return F.size(F.filter(F.slice(labels, 2, F.greatest(F.size(labels), F.lit(1))), lambda x: x != IGNORED))


def completion_mask(labels: Column) -> Column:
    return F.transform(labels, lambda x: (x != IGNORED).cast("int"))


def special_positions(rows: DataFrame, key: str, ids: str, labels: str, names: dict[str, int]) -> DataFrame:
    """key, position, name, label of every special token; the first name listed wins."""
    name = F.coalesce(*[F.when(F.col("id") == i, F.lit(n)) for n, i in names.items()])
    out = rows.select(key, F.col(labels).alias("_labels"), F.posexplode(ids).alias("position", "id"))
    return out.withColumn("name", name).where("name is not null").select(key, "position", "name", F.get("_labels", F.col("position")).alias("label"))


def token_regions(rows: DataFrame, key: str, ids: str, prompt_size: str, end: str) -> DataFrame:
    """key, position, id, region (prompt, assistant, trailing) of every token."""
    out = rows.select(key, F.col(prompt_size).alias("_p"), F.col(end).alias("_e"), F.posexplode(ids).alias("position", "id"))
    return out.select(key, "position", "id", F.when(F.col("position") < F.col("_p"), "prompt").when(F.col("position") <= F.col("_e"), "assistant").otherwise("trailing").alias("region"))


def step_identity(rows: DataFrame, step: str, position: str, key: str) -> DataFrame:
    """step, sample_ids: the ids of each optimizer step in order; a step is a bounded number of records."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(key).alias("k"))))
    return rows.groupBy(step).agg(F.transform(packed, lambda x: x["k"]).alias("sample_ids"))


def collate(rows: DataFrame, batch: str, ids: str = "input_ids", labels: str = "labels", pad: int = 0, key: str | None = None) -> DataFrame:
    """Right-padded ids and labels and the attention mask, per record, padded to its batch's longest.

    Lists of unequal length raise; so does a batch in which some records have a key and some none.
    """
    some = F.lit(False) if key is None else (F.count(F.col(key)) > 0) & (F.count(F.col(key)) < F.count(F.lit(1)))
    longest = rows.groupBy(batch).agg(F.max(F.size(ids)).alias("_width"), F.count_if(F.coalesce(F.size(ids) != F.size(labels), F.lit(True))).alias("_uneven"), some.alias("_mixed"))
    fails = F.when(F.col("_uneven") > 0, "ids and labels must be equally long").when(F.col("_mixed"), "all or no records of a batch must have a key")
    longest = longest.where(F.when(fails.isNotNull(), F.raise_error(fails).cast("boolean")).otherwise(True)).drop("_uneven", "_mixed")
    out = rows.join(longest, batch)
    gap = F.col("_width") - F.size(ids)
    fill = lambda x: F.array_repeat(F.lit(x), gap)
    return out.withColumns(
        {
            ids: F.concat(F.col(ids), fill(pad)),
            labels: F.concat(F.col(labels), fill(IGNORED)),
            "attention_mask": F.concat(F.transform(F.col(ids), lambda x: F.lit(1)), fill(0)),
        }
    ).drop("_width")


def global_positions(rows: DataFrame, order: list[Column], name: str = "position", partitions: int | None = None) -> DataFrame:
    """Zero-based position in a total order, without a single-task window.

    Rows are range-partitioned by the order; each partition is ranked by itself and the counts
    of the partitions before it (one row per partition) are added.
    """
    keys = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    names = [f"_o{i}" for i in range(len(order))]
    wide = rows.select("*", *keys)
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = wide.repartitionByRange(n, *names).withColumn("_part", F.spark_partition_id())
    # The sample behind the range bounds is deterministic for one plan; the written table fixes it for both uses.
    from millrace import runtime

    ranged = runtime.written(ranged, "positions")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*names)) - 1
    return ranged.withColumn("_local", local).join(F.broadcast(before), "_part").withColumn(name, (F.col("_local") + F.col("_before")).cast("bigint")).drop("_part", "_local", "_before", *names)


def epoch_order(key: Column, seed: int, epoch: int) -> Column:
    """Hash priority of a record in an epoch: a reproducible permutation."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed + epoch)), key), 256)


def steps(position: Column, micro_batch: int, accumulation: int) -> tuple[Column, Column]:
    """(micro batch number, optimizer step) of a zero-based position; the last window may be short."""
    micro = F.floor(position / micro_batch)
    return micro, F.floor(micro / accumulation)


def step_plan(rows: int, accumulation: int, warmup_ratio: float, epochs: int = 1) -> tuple[int, int]:
    """(optimizer steps, warm-up steps)."""
    from math import ceil

    if rows < 1 or accumulation < 1 or not 0 <= warmup_ratio <= 1:
        raise ValueError("rows and accumulation must be positive and the ratio in [0, 1]")
    total = ceil(rows / accumulation) * epochs
    return total, ceil(total * warmup_ratio)


def advantage(reward: str, group: str) -> tuple[Column, Column]:
    """(group-normalised advantage, whether the group's rewards are all equal)."""
    w = Window.partitionBy(group)
    std = F.stddev_samp(reward).over(w)
    return (F.col(reward) - F.avg(reward).over(w)) / (F.coalesce(std, F.lit(0.0)) + 1e-4), F.coalesce(std, F.lit(0.0)) == 0
