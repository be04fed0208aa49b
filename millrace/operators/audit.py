"""Dataset audit: validate, deduplicate, decontaminate, filter by length, split, sample for review.

Every stage is a DataFrame plan. Order is semantic: shape problems accumulate together; a
well-shaped row gets at most one generation problem; then duplicates, contamination, length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace import runtime
from millrace.functions import text as tx
from millrace.operators.sampling import lowest


@dataclass(frozen=True)
class AuditSettings:
    """Defaults of the audit; every value is validated."""

    validation_size: int = 2000
    max_tokens: int = 32768
    salt: str = "independent-sft-v1"
    ngram: int = 8
    review_accepted: int = 20
    review_per_reason: int = 3

    def __post_init__(self):
        if min(self.validation_size, self.max_tokens, self.ngram) < 1 or min(self.review_accepted, self.review_per_reason) < 0 or not self.salt:
            raise ValueError("audit settings must be positive and the salt non-empty")


def is_true(c: Column) -> Column:
    return c.eqNullSafe(F.lit(True))


def blank(c: Column) -> Column:
    """Null or nothing but white space (Unicode)."""
    return c.isNull() | (F.length(F.regexp_replace(c, r"[\p{IsWhite_Space}\x1c-\x1f]+", "")) == 0)


def shape_issues() -> Column:
    """empty_problem and invalid_messages, both if both hold."""
    role = lambda i: F.get(F.col("messages"), F.lit(i))["role"]
    content = F.get(F.col("messages"), F.lit(1))["content"]
    pair = F.coalesce((F.size("messages") == 2) & role(0).eqNullSafe(F.lit("user")) & role(1).eqNullSafe(F.lit("assistant")), F.lit(False)) & ~blank(content)
    return F.array_compact(F.array(F.when(blank(F.col("problem")), F.lit("empty_problem")), F.when(~pair, F.lit("invalid_messages"))))


def think_balanced(c: Column) -> Column:
    """At least one reasoning tag, never closed before opened, all closed."""
    step = lambda s, t: F.struct((s["open"] + F.when(t == "<think>", 1).otherwise(-1)).alias("open"), (s["ok"] & ((s["open"] > 0) | (t == "<think>"))).alias("ok"))
    start = F.struct(F.lit(0).alias("open"), F.lit(True).alias("ok"))
    tags = F.regexp_extract_all(c, F.lit(r"(</?think>)"), F.lit(1))
    return F.aggregate(tags, start, step, lambda s: s["ok"] & (s["open"] == 0)) & F.contains(c, F.lit("<think>"))


def generation_index() -> Column:
    """Zero-based index of the first generation equal to the assistant's message; -1 if none."""
    return F.coalesce(F.array_position("generations", F.get(F.col("messages"), F.lit(1))["content"]), F.lit(0)).cast("int") - 1


def generation_issue() -> Column:
    """The first problem of a well-shaped row's chosen generation, or null."""
    at = generation_index()
    arrays = ("generations", "correctness_math_verify", "is_reasoning_complete")
    missing = F.col(arrays[0]).isNull() | F.col(arrays[1]).isNull() | F.col(arrays[2]).isNull()
    chosen = F.get(F.col("generations"), at)
    return (
        F.when(missing, "invalid_generation_fields")
        .when((F.size(arrays[0]) != F.size(arrays[1])) | (F.size(arrays[0]) != F.size(arrays[2])), "generation_field_length_mismatch")
        .when(at < 0, "assistant_not_in_generations")
        .when(~is_true(F.get(F.col(arrays[1]), at)), "math_verify_failed")
        .when(~is_true(F.get(F.col(arrays[2]), at)), "incomplete_reasoning")
        .when(~think_balanced(chosen), "unclosed_think_tags")
        .when(~F.contains(chosen, F.lit("\\boxed{")), "missing_boxed_answer")
    )


def problem_hash(c: Column, strict: bool = False) -> Column:
    return F.sha2(tx.normalized_strict(c) if strict else tx.normalized_portable(c), 256)


#: 64-bit words of the bitmap that filters n-grams.
_BITMAP_WORDS = 1 << 14


def contamination(rows: DataFrame, suites: DataFrame, key: str, text: str, ngram: int = 8, strict: bool = False) -> DataFrame:
    """key, reasons: exact-match reasons per suite, or else n-gram overlap reasons per suite.

    The row side is never collected, and no text is shuffled. Spark broadcasts the suite side
    only while its size is under the session's threshold.
    """
    norm = tx.normalized_strict if strict else tx.normalized_portable
    base = rows.select(F.col(key).alias("k"), norm(F.col(text)).alias("norm")).where("norm is not null")
    suite = suites.select("suite", norm(F.col("problem")).alias("norm")).where("norm is not null")
    if strict:  # the reference leaves out blank items
        suite = suite.where("norm != ''")
    exact = exact_matches(base, suite)
    overlap = overlaps(base, suite, exact, ngram)
    return exact.unionByName(overlap).select(F.col("k").alias(key), "reasons")


def exact_matches(base: DataFrame, suite: DataFrame) -> DataFrame:
    """k, reasons of rows (k, norm) whose normalised text is an item's; texts meet as 128-bit digests."""
    digest = lambda df, *keep: df.select(*keep, F.unhex(F.md5("norm")).alias("d"))
    found = digest(base, "k").join(digest(suite, "suite").distinct(), "d")
    return found.groupBy("k").agg(F.sort_array(F.collect_set(F.concat(F.lit("evaluation_exact_match:"), "suite"))).alias("reasons"))


def overlaps(base: DataFrame, suite: DataFrame, exact: DataFrame, ngram: int) -> DataFrame:
    """k, reasons of rows that share an n-gram with an item and are no exact match.

    N-grams are 64-bit hashes with their text. A bitmap of the suites' hashes (2**20 bits in
    _BITMAP_WORDS rows, whatever the suites' size) is broadcast and goes over the rows' n-grams
    where they are made, so that only n-grams whose bit a suite sets are shuffled. What is left
    joins by hash and by the n-gram itself, so a collision makes no reason.
    """
    reason = F.concat(F.lit(f"evaluation_{ngram}gram_overlap:"), F.col("suite"))
    gram = lambda df, *keep: df.select(*keep, F.explode(tx.ngrams(tx.split_words(F.col("norm")), ngram)).alias("gram")).withColumn("h", F.xxhash64("gram"))
    listed = gram(suite, "suite").distinct()
    word, bit = F.pmod(F.shiftright("h", 6), F.lit(_BITMAP_WORDS)).cast("int"), F.pmod("h", F.lit(64)).cast("int")
    bitmap = F.broadcast(listed.groupBy(word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits")))  # at most _BITMAP_WORDS rows
    known = gram(base, "k").withColumn("w", word).join(bitmap, "w").where(F.getbit("bits", bit) == 1).select("k", "h", "gram")
    found = known.join(listed, ["h", "gram"]).groupBy("k").agg(F.sort_array(F.collect_set(reason)).alias("reasons"))
    return found.join(exact.select("k"), "k", "left_anti")


def first_wins(rows: DataFrame, key: str, order: str, ok: Column, nullable: bool = True) -> DataFrame:
    """Adds first_ok: the least order value among acceptable rows of the key.

    A row is kept iff its order equals first_ok; eligible later rows are duplicates. Rows that
    are not acceptable never claim the key. The minimum is an aggregate with map-side combine
    and a join back, so a hot key is no single task. nullable=False says that no key is null.
    """
    firsts = rows.where(ok & F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first_ok"))
    if not nullable:
        return rows.join(firsts, key, "left")
    # rows without a key match nothing; kept out of the join they are no hot null partition
    placed = rows.where(F.col(key).isNotNull()).join(firsts, key, "left")
    return placed.unionByName(rows.where(F.col(key).isNull()).withColumn("first_ok", F.lit(None).cast(dict(firsts.dtypes)["first_ok"])))


def audit(rows: DataFrame, suites: DataFrame, settings: AuditSettings, tokens: Column, strict: bool = False, token_error: Column | None = None) -> DataFrame:
    """row_index, sample_id, source, token_count, issues, accepted: one row per input row.

    tokens gives the length of the row's rendered conversation, token_error the message of a
    failed rendering or null; both are evaluated for eligible rows only.
    """
    issue = generation_issue()
    shaped = rows.withColumn("shape", shape_issues()).withColumn("issue", F.when(F.size("shape") == 0, issue))
    shaped = shaped.withColumn("eligible", (F.size("shape") == 0) & F.col("issue").isNull())
    keyed = shaped.withColumn("sample_id", F.when(F.col("eligible"), problem_hash(F.col("problem"), strict))).withColumn("token_count", F.when(F.col("eligible"), tokens)).withColumn("token_error", F.when(F.col("eligible"), F.lit(None).cast("string") if token_error is None else token_error))
    reasons = contamination(keyed.where("eligible"), suites, "row_index", "problem", settings.ngram, strict)
    joined = keyed.join(reasons, "row_index", "left")
    fits = F.col("token_count") <= settings.max_tokens
    ok = F.col("eligible") & F.col("reasons").isNull() & F.col("token_error").isNull() & fits
    scanned = joined.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("fits", fits)
    # The scan stage is written: what follows is a pure function of it and can be resumed from it.
    scanned = runtime.written(scanned.select("row_index", "sample_id", "source", "token_count", "shape", "issue", "reasons", "token_error", "fits", "ok"), "audit-scan")
    return finish(scanned)


def finish(scanned: DataFrame) -> DataFrame:
    """The audit's result from its written scan stage; used for a first run and for recovery alike."""
    placed = first_wins(scanned, "sample_id", "row_index", F.col("ok"))
    issues = (
        F.when(F.size("shape") > 0, F.col("shape"))
        .when(F.col("issue").isNotNull(), F.array("issue"))
        .when(F.col("row_index") > F.col("first_ok"), F.array(F.lit("duplicate_problem")))
        .when(F.col("reasons").isNotNull(), F.col("reasons"))
        .when(F.col("token_error").isNotNull(), F.array(F.concat(F.lit("tokenization_error:"), "token_error")))
        .when(~F.col("fits"), F.array(F.lit("over_max_length")))
        .otherwise(F.array().cast("array<string>"))
    )
    out = placed.select("row_index", "sample_id", F.coalesce("source", F.lit("unknown")).alias("source"), "token_count", issues.alias("issues"))
    return out.withColumn("accepted", F.size("issues") == 0)


def reason_counts(audited: DataFrame) -> DataFrame:
    """reason, n: occurrences, several per row possible."""
    return audited.select(F.explode("issues").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def split_key(c: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt + ":"), c), 256)


def hash_split(rows: DataFrame, key: str, salt: str, validation_size: int) -> DataFrame:
    """Adds split_key and split: the validation_size lowest keys, the rest is train.

    The cut is the highest selected (split_key, key), found from a histogram of the keys; no
    global sort and no broadcast of keys.
    """
    keyed = rows.withColumn("split_key", split_key(F.col(key), salt))
    if len(rows.columns) == 1:  # keys alone, which may come from a costly distinct: they are read several times
        keyed = runtime.written(keyed, "split-keys")
    cut = lowest(keyed.select("split_key", key), validation_size, "split_key", key).agg(F.max(F.struct("split_key", key)).alias("cut")).first().cut
    inside = F.lit(False) if cut is None else F.struct("split_key", key) <= F.struct(F.lit(cut[0]), F.lit(cut[1]))
    return keyed.withColumn("split", F.when(inside, "validation").otherwise("train"))


def manual_exclusion(rows: DataFrame, exclusions: DataFrame, key: str = "sample_id") -> DataFrame:
    return rows.join(exclusions.select(key).distinct(), key, "left_anti")


def review_key(sample_id: Column, row_index: Column, salt: str) -> Column:
    shown = F.coalesce(F.when(F.length(sample_id) > 0, sample_id), F.lit("missing"))
    return F.sha2(F.concat_ws(":", F.lit(salt), F.lit("review"), shown, row_index.cast("string")), 256)


def top_per_group(rows: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The k first rows per group with their rank; a window group limit prunes before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def review_sample(audited: DataFrame, settings: AuditSettings) -> DataFrame:
    """section, reason, rank, row_index: accepted rows, then k rows per reject reason."""
    keyed = audited.withColumn("review_key", review_key(F.col("sample_id"), F.col("row_index"), settings.salt))
    taken = top_per_group(keyed.where("accepted").withColumn("reason", F.lit("accepted")), "reason", ["review_key", "row_index"], settings.review_accepted)
    refused = top_per_group(keyed.select("row_index", "review_key", F.explode("issues").alias("reason")), "reason", ["review_key", "row_index"], settings.review_per_reason)
    cols = ["reason", "rank", "row_index", "review_key"]
    return taken.select(F.lit("accepted").alias("section"), *cols).unionByName(refused.select(F.lit("rejected").alias("section"), *cols))


def validation_error(capacity: int | None = None) -> Column:
    """First structural problem of a tokenized record, or null."""
    supervised = F.exists(F.slice("labels", 2, F.greatest(F.size("labels"), F.lit(1))), lambda x: x != -100)
    return (
        F.when(blank(F.col("sample_id")), "sample_id must be a non-empty string")
        .when(F.col("input_ids").isNull() | (F.size("input_ids") == 0), "input_ids must not be empty")
        .when(F.col("labels").isNull() | (F.size("labels") != F.size("input_ids")), "labels must match input_ids")
        .when(F.exists("input_ids", lambda x: x.isNull()), "input_ids must hold integers")
        .when(F.exists("labels", lambda x: x.isNull()), "labels must hold integers")
        .when(~supervised, "no supervised label")
    )


def with_texts(winners: DataFrame, rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The winners of a bounded selection with columns of their rows, which are read for them alone.

    The winners' keys go to the rows' scan (Spark broadcasts them while they are small), so no text is shuffled.
    """
    return rows.select(key, *columns).join(winners, key).select(*winners.columns, *columns)
