"""Mixing sources to target weights: soft membership and distributed projected-gradient rates.

A table classifier (multinomial, hashed token ids) learns from the documents whose source is
known. Every document gets a posterior over the target sources and the rest: the source of a
document is certain evidence, so a labelled one belongs to its source wholly; all others get
the classifier's posterior and count towards every source, and the rest, by it. None is left
out of the fit.

The largest possible mix follows from each source's expected tokens times the allowed repeats.
The rates of the documents are fitted by projected-gradient least squares so that the expected
token totals meet target share times mix size, and 0 for the rest, with 0 <= rate <= repeats:
a document that is likely of none of the sources gets a low rate or none. A step is one
aggregation on the cluster: every task replays its documents' rates from the steps so far and
sums their expected tokens per source; one row of totals per task and nothing else goes to the
driver. Steps start at what is allowed and are scaled per source by the expected tokens that can
still move its way (the row sums of the quadratic form over the free rates), which makes them
stable for any membership. Labelled documents of one source have equal
steps throughout, so they take part as one row with their token total, which is exact.

Rates become whole repeats by hash order. Labelled documents of a source get the whole part, and
those with the lowest hashes one more, up to the exact token total; the cut is found with a
histogram of 4,096 hash buckets per source and a ranking inside the boundary bucket only. A
document without source gets the fraction of its rate by its own hash.

Defined results for odd input: null and empty texts have no tokens and are never chosen;
documents of a known source outside the targets are never chosen; a document without source
keeps the least of the targets' max_repeats, since it may belong to any; a target source
without documents makes the largest mix empty; documents repeated under other ids are documents
of their own; null shares or repeats count as 0; an empty table gives an empty mix; only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace import runtime
from millrace.llm import encoding

WIDTH = 1 << 14
_BUCKETS = 4096
_SIZED = "id bigint, source string, tokens int, hashed array<int>, class int, bucket int, n bigint"


def _sized(place, vocabulary: str, classes: dict[str, int]):
    """Token counts of all documents, and the classifier's table from those with a source.

    Documents without a source carry their hashed token ids along. Table rows hold class, bucket
    and count; bucket -1 counts documents, the last class is the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding.Encoder(place, vocabulary)
        counts, docs = np.zeros((len(classes) + 1, WIDTH), np.int64), np.zeros(len(classes) + 1, np.int64)
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64()]
        names = ["id", "source", "tokens", "hashed", "class", "bucket", "n"]

        def rows(count, **columns):
            return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(count, k) for c, k in zip(names, kinds)], names=names)

        for batch in batches:
            sources = batch.column(1).to_pylist()
            flat, offsets = encoder.encode(batch.column(2).to_pylist())
            ids, sizes = flat & (WIDTH - 1), np.diff(offsets)
            of = np.array([-1 if s is None else classes.get(s, len(classes)) for s in sources], np.int64)
            for k in np.unique(of[(of >= 0) & (sizes > 0)]).tolist():
                counts[k] += np.bincount(ids[np.repeat(of == k, sizes)], minlength=WIDTH)
                docs[k] += int(((of == k) & (sizes > 0)).sum())
            hashed = [ids[a:b] if k < 0 and b > a else None for k, a, b in zip(of.tolist(), offsets, offsets[1:])]
            yield rows(len(sources), id=batch.column(0), source=batch.column(1), tokens=sizes.astype(np.int32), hashed=hashed)
        k, b = np.nonzero(counts)
        d = np.flatnonzero(docs)
        if len(d):
            yield rows(len(k) + len(d), **{"class": np.concatenate([k, d]).astype(np.int32), "bucket": np.concatenate([b, np.full(len(d), -1)]).astype(np.int32), "n": np.concatenate([counts[k, b], docs[d]])})

    return run


def table_weights(table: DataFrame, classes: int) -> np.ndarray:
    """Log weights [classes + 1, WIDTH + 1] (last column: prior) from class, bucket, n rows."""
    found = table.groupBy("class", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most (classes + 1) * (WIDTH + 1) rows
    counts, docs = np.ones((classes + 1, WIDTH)), np.full(classes + 1, 0.5)
    k, b, n = (found.column(c).to_numpy() for c in ("class", "bucket", "n"))
    np.add.at(counts, (k[b >= 0], b[b >= 0]), n[b >= 0])
    np.add.at(docs, k[b < 0], n[b < 0])
    return np.concatenate([np.log(counts / counts.sum(1, keepdims=True)), np.log(docs / docs.sum())[:, None]], 1)


def posterior(weights: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Class probabilities of a document's hashed token ids; the last class is the rest."""
    score = weights[:, -1] + weights[:, ids].sum(1)
    p = np.exp(score - score.max())
    return p / p.sum()


_UNIT = "id bigint, tokens double, cap double, membership array<double>"


def _guessed(weights_bc, cap: float):
    """Documents without a source: tokens, cap and posterior over the target sources and the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
            found = [posterior(weights_bc.value, flat[a:b]) for a, b in zip([0, *ends], ends)]
            sizes = np.diff(ends, prepend=0).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(np.full(len(found), cap)), pa.array(found, pa.list_(pa.float64()))], names=["id", "tokens", "cap", "membership"])

    return run


def replay(members: np.ndarray, caps: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the projected steps so far, from what is allowed."""
    rates = caps
    for g in steps:
        rates = np.clip(rates - members @ g, 0, caps)
    return rates


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _totals(steps: list[np.ndarray], width: int):
    """Per task one row: expected tokens per source at the rates so far, and those whose rates can still rise, and fall."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, width))
        for batch in batches:
            members, tokens, caps = _matrix(batch.column(2), width), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rates = replay(members, caps, steps)
            sums += np.stack([rates * tokens, (rates < caps) * tokens, (rates > 0) * tokens]) @ members
        yield pa.RecordBatch.from_arrays([pa.array([sums.ravel()], pa.list_(pa.float64()))], names=["sums"])

    return run


def expected(units: DataFrame, steps: list[np.ndarray], width: int) -> np.ndarray:
    """[at the rates, free to rise, free to fall] x source: one aggregation, 3 * width numbers."""
    rows = units.select("tokens", "cap", "membership").mapInArrow(_totals(steps, width), "sums array<double>")
    summed = rows.agg(*[F.sum(F.get("sums", F.lit(i))) for i in range(3 * width)]).first() if width else ()
    return np.array([x or 0.0 for x in summed]).reshape(3, width)


def fit_rates(units: DataFrame, share: np.ndarray, most_steps: int = 50, tolerance: float = 1e-4) -> tuple[list[np.ndarray], np.ndarray]:
    """(steps of the projected gradient, for replay(); target tokens of the largest mix).

    It ends when no source is further off than the tolerance, as a share of the largest target
    (whole documents and repeats leave more than the default), or when ten steps gain under a tenth.
    """
    steps: list[np.ndarray] = []
    now, rise, fall = expected(units, steps, len(share))
    used = share > 0
    targets = share * (float((now[used] / share[used]).min()) if used.any() else 0.0)
    off = [np.inf] * 10
    while len(steps) < most_steps:
        residual = now - targets
        off.append(float(np.abs(residual).max(initial=0.0)))
        if off[-1] <= tolerance * float(targets.max(initial=0.0)) or off[-1] > 0.9 * off[-11]:
            break
        free = np.where(residual < 0, rise, fall)
        steps.append(np.divide(residual, free, out=np.zeros_like(residual), where=free > 0))
        now, rise, fall = expected(units, steps, len(share))
    return steps, targets


def _repeated(steps: list[np.ndarray], sources: list[str]):
    """Repeats of documents without a source: the rate's whole part, and its fraction by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, caps = _matrix(batch.column(3), len(sources) + 1), batch.column(2).to_numpy()
            rates = replay(members, caps, steps)
            repeats = np.floor(rates + batch.column(4).to_numpy()).astype(np.int32)
            names = pa.array([sources[k] for k in members[:, :-1].argmax(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), names, batch.column(1), pa.array(repeats), batch.column(3)], names=["id", "source", "tokens", "repeats", "membership"])

    return run


def mix(documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", salt: str = "mix-v1", tokenizers: str = encoding.TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """(chosen documents: id, source, tokens, repeats; report: one row per target source).

    source is the document's own, or the likeliest one where it has none; the report counts the
    latter towards all sources by membership; what is likely of the rest counts to none. targets is a list that fits the driver.
    """
    spark = documents.sparkSession
    wanted = [(r[0], r[1] or 0.0, r[2] or 0) for r in targets.select("source", "target_share", "max_repeats").where("source is not null").sort("source").toLocalIterator()]
    if len(wanted) > 1000:
        raise ValueError("at most 1000 target sources")
    sources, width = [w[0] for w in wanted], len(wanted)
    share, cap = np.array([w[1] for w in wanted]), np.array([w[2] for w in wanted], float)
    docs = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    place = encoding.published(docs, "text", tokenizers)
    sized = runtime.written(docs.mapInArrow(_sized(*place, {s: k for k, s in enumerate(sources)}), _SIZED), "mix-sized")
    weights = spark.sparkContext.broadcast(table_weights(sized.where("class is not null"), width))  # fixed width per target source
    one = lambda k: [float(k == j) for j in range(width + 1)]
    plan_schema = "source string, cap double, membership array<double>"
    own = F.broadcast(spark.createDataFrame([(s, float(c), one(k)) for k, (s, c) in enumerate(zip(sources, cap))], plan_schema))  # one row per target source
    known = sized.where("class is null and source is not null and id is not null and tokens > 0").select("id", "source", "tokens")
    strictest = float(cap[share > 0].min()) if (share > 0).any() else 0.0
    guessed = sized.where("hashed is not null and id is not null").select("id", "hashed").mapInArrow(_guessed(weights, strictest), _UNIT)
    totals = known.groupBy("source").agg(F.sum("tokens").cast("double").alias("tokens")).join(own, "source")
    units = runtime.written(totals.select(F.lit(None).cast("bigint").alias("id"), "tokens", "cap", "membership").unionByName(guessed), "mix-units")
    steps, target_tokens = fit_rates(units, np.append(share, 0.0))
    # labelled documents: whole repeats, and one more up to the cut
    rates = replay(np.eye(width, width + 1), cap, steps)
    whole = np.floor(rates + 1e-9)
    plan = F.broadcast(spark.createDataFrame([(s, int(w), float(r)) for s, w, r in zip(sources, whole, np.maximum(rates - whole, 0))], "source string, whole int, part double"))  # one row per target source
    bucket = F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(_BUCKETS)).cast("int")
    keyed = known.join(plan, "source").withColumn("bucket", bucket)
    sums = keyed.groupBy("source", "part", "bucket").agg(F.sum("tokens").alias("n"))  # 4,096 rows per source
    of = Window.partitionBy("source")
    cuts = sums.withColumn("before", F.sum("n").over(of.orderBy("bucket")) - F.col("n")).withColumn("rest", F.sum("n").over(of) * F.col("part"))
    cuts = cuts.where("before <= rest and rest < before + n and rest >= 1").select("source", F.col("bucket").alias("cut"), (F.col("rest") - F.col("before")).alias("rest"))
    keyed = keyed.join(F.broadcast(cuts), "source", "left").withColumn("cut", F.coalesce("cut", F.lit(0) - 1))  # at most one row per target source
    run = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("priority", "id"))
    edge = keyed.where("bucket = cut").withColumn("priority", F.sha2(F.concat(F.lit(salt + ":"), F.col("id").cast("string")), 256)).withColumn("extra", (run <= F.col("rest") + F.col("tokens") / 2).cast("int"))
    inner = keyed.where("bucket != cut").withColumn("extra", (F.col("bucket") < F.col("cut")).cast("int"))
    columns = ["id", "source", "tokens", (F.col("whole") + F.col("extra")).cast("int").alias("repeats")]
    labelled = inner.select(*columns).unionByName(edge.select(*columns))
    uniform = F.pmod(F.xxhash64(F.lit(salt), F.lit("part"), "id"), F.lit(1 << 30)) / float(1 << 30)
    soft = units.where("id is not null").select("id", F.col("tokens").cast("int").alias("tokens"), "cap", "membership", uniform.alias("u"))
    soft = soft.mapInArrow(_repeated(steps, sources), "id bigint, source string, tokens int, repeats int, membership array<double>") if sources else soft.select("id", F.lit("").alias("source"), "tokens", F.lit(0).alias("repeats"), "membership")
    chosen = runtime.written(labelled.withColumn("membership", F.lit(None).cast("array<double>")).unionByName(soft).where("repeats > 0"), "mix-chosen")
    # the report: labelled documents count to their source, the others by membership
    amount = F.col("tokens") * F.col("repeats")
    sums = chosen.groupBy("source").agg(
        F.sum(F.when(F.col("membership").isNull(), amount).otherwise(0)).alias("sure"), F.count(F.lit(1)).alias("documents"), F.count("membership").alias("unlabelled"), F.max("repeats").alias("most_repeats")
    )
    by_part = chosen.where("membership is not null").select(F.posexplode("membership").alias("k", "m"), amount.alias("a")).groupBy("k").agg(F.sum(F.col("m") * F.col("a")).alias("likely"))
    wanted_df = spark.createDataFrame([(k, s, float(a), float(b)) for k, (s, a, b) in enumerate(zip(sources, share, target_tokens))], "k int, source string, target_share double, target_tokens double")
    report = wanted_df.join(sums, "source", "left").join(by_part, "k", "left").fillna(0, ["sure", "documents", "unlabelled", "most_repeats"]).fillna(0.0, ["likely"])
    report = report.withColumn("tokens", F.col("sure") + F.col("likely"))
    total = F.sum("tokens").over(Window.partitionBy())  # one row per target source
    report = report.select("source", "target_share", F.round(F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0)), 6).alias("actual_share"), F.round("target_tokens").cast("bigint").alias("target_tokens"), F.round("tokens").cast("bigint").alias("tokens"), "documents", "unlabelled", "most_repeats")
    return chosen.select("id", "source", "tokens", "repeats"), report
