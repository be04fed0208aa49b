"""Text normal forms and word functions."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word: a longest run of letters and digits (Python form and Java form).
WORD_PY = r"[^\W_]+"
WORD_JAVA = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case words of a text; null stays null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_JAVA), F.lit(0))


def normalized_portable(text: Column) -> Column:
    """Lower case, blanks collapsed to one space, trimmed: the form SQL engines agree on."""
    return F.trim(F.regexp_replace(F.lower(text), "[ \\t\\n\\r\\f]+", " "))


def normalize_text(text: str) -> str:
    """The strict normal form: NFKC, case folding, blanks collapsed."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


@F.pandas_udf(T.StringType())
def normalized_strict(text: pd.Series) -> pd.Series:
    return text.map(normalize_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def canonical_pair_json(problem: pd.Series, generation: pd.Series) -> pd.Series:
    """Compact JSON with sorted keys of a problem and its generation, non-ASCII kept."""
    return pd.Series(
        [
            None if p is None or g is None else json.dumps({"generation": g, "problem": p}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            for p, g in zip(problem, generation)
        ],
        dtype=object,
    )


def split_words(text: Column) -> Column:
    """Blank-separated words of a normalised text; blank gives an empty array."""
    return F.when(F.length(text) > 0, F.split(text, " ")).otherwise(F.array().cast("array<string>"))


def blank_separated(text: Column) -> Column:
    """Number of words between blanks, all of Unicode's as in Python's split."""
    return F.size(F.filter(F.split(text, r"[\p{IsWhite_Space}\x1c-\x1f]+"), lambda w: w != ""))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(word_array: Column, n: int) -> Column:
    """Distinct n-word strings; an array shorter than n words has none."""
    windows = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
    return let(word_array, lambda w: F.when(F.size(w) >= n, F.array_distinct(windows(w))).otherwise(F.array().cast("array<string>")))
