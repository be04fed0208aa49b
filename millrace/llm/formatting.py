"""Duplicates hidden by formatting differences.

Byte-identical rows are collapsed first, with counts; only the distinct survivors are
canonicalised; the survivors are then grouped again on the full canonical text and their
counts are summed. Row-level results come from joining 32-byte digests back, so no text
is shuffled after the second grouping. Hot texts are pre-aggregated before every shuffle
by the hash aggregates; the joins that follow are inner equi-joins, whose hot keys
adaptive execution splits.

Defined results for odd input: null texts, texts of which nothing is left and lines that
are not JSON objects belong to no group and come out in no result; ties cannot arise (ids
are unique; a repeated id counts as one more copy); empty tables give empty results;
columns other than the two named are never read.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import runtime

#: White space and punctuation (Unicode categories P*), including the ASCII separators.
_LEFT_OUT = r"[\p{P}\p{IsWhite_Space}\x1c-\x1f]+"
_FIELD, _VALUE = "\x1e", "\x1f"


def canonical_text(text: Column) -> Column:
    """Text without blanks and punctuation, in one case; JVM-side.

    Lower then upper case makes expanding letters (sharp s, final sigma, ligatures) agree.
    """
    return F.upper(F.lower(F.regexp_replace(text, _LEFT_OUT, "")))


def _no_constant(name: str):
    raise ValueError(name)


def _fields(line: str | None) -> list[dict] | None:
    """Sorted fields of a JSON object; None if the line does not parse or is no object."""
    if line is None:
        return None
    try:
        parsed = json.loads(line, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    if not isinstance(parsed, dict):
        return None
    out = []
    for name in sorted(parsed):
        value = parsed[name]
        if value is None:
            out.append({"name": name, "text": None, "exact": None})
        elif isinstance(value, str):
            out.append({"name": name, "text": value.encode("utf-8", "replace").decode("utf-8"), "exact": None})
        else:
            out.append({"name": name, "text": None, "exact": json.dumps(value, sort_keys=True, separators=(",", ":"))})
    return out


_FIELDS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("name", "text", "exact")]))


@F.pandas_udf(_FIELDS)
def json_fields(line: pd.Series) -> pd.Series:
    return pd.Series([_fields(x) for x in line], dtype=object)


def canonical_json(line: Column) -> Column:
    """Canonical text of a JSON object: fields by name, string values canonicalised.

    Null equals only null; numbers, booleans and nested values compare exactly, by type.
    """
    fields = F.transform(
        json_fields(line),
        lambda f: F.struct(
            f["name"].alias("name"),
            F.when(f["text"].isNotNull(), F.concat(F.lit("s"), canonical_text(f["text"])))
            .when(f["exact"].isNotNull(), F.concat(F.lit("j"), f["exact"]))
            .otherwise(F.lit("n"))
            .alias("value"),
        ),
    )
    nothing = F.forall(fields, lambda f: f["value"].isin("s", "n"))
    joined = F.array_join(F.transform(fields, lambda f: F.concat(f["name"], F.lit(_VALUE), f["value"])), _FIELD)
    return F.when(~nothing, joined)


def _rows(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("raw")).where(F.col("raw").isNotNull())


def survivors(rows: DataFrame, id_col: str, text_col: str, kind: str = "text") -> DataFrame:
    """raw_key, first, n, canon: one row per byte-identical text of which something is left.

    kind: 'text' or 'json' (each text is one JSON object).
    """
    distinct = _rows(rows, id_col, text_col).groupBy("raw").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    canonical = canonical_json(F.col("raw")) if kind == "json" else canonical_text(F.col("raw"))
    return distinct.select(F.unhex(F.sha2("raw", 256)).alias("raw_key"), "first", "n", canonical.alias("canon")).where(F.col("canon") != "")


def groups(distinct: DataFrame) -> DataFrame:
    """first_id, copies, key (digest of the canonical text), one row per canonical text."""
    found = distinct.groupBy("canon").agg(F.min("first").alias("first_id"), F.sum("n").alias("copies"))
    return found.select("first_id", "copies", F.unhex(F.sha2("canon", 256)).alias("key"))


def members(rows: DataFrame, id_col: str, text_col: str, kind: str = "text") -> DataFrame:
    """first_id, copy_id for every row of a group but the one with the smallest id.

    The survivors are canonicalised once and written; grouping and membership read them.
    """
    distinct = runtime.written(survivors(rows, id_col, text_col, kind), "survivors")
    repeated = groups(distinct).where("copies > 1").select("key", "first_id")
    variants = distinct.select("raw_key", F.unhex(F.sha2("canon", 256)).alias("key")).join(repeated, "key").select("raw_key", "first_id")
    keyed = _rows(rows, id_col, text_col).select("id", F.unhex(F.sha2("raw", 256)).alias("raw_key"))
    return keyed.join(variants, "raw_key").where(F.col("id") != F.col("first_id")).select("first_id", F.col("id").alias("copy_id"))


def table_copies(tables: list[tuple[str, DataFrame, str, str, str]]) -> DataFrame:
    """table_name, first_id, copy_id over several tables, each compared by itself."""
    parts = [members(df, i, t, kind).select(F.lit(name).alias("table_name"), "first_id", "copy_id") for name, df, i, t, kind in tables]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def table_groups(tables: list[tuple[str, DataFrame, str, str, str]]) -> DataFrame:
    """table_name, first_id, copies: one row per distinct canonical value."""
    parts = [groups(survivors(df, i, t, kind)).select(F.lit(name).alias("table_name"), "first_id", "copies") for name, df, i, t, kind in tables]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
