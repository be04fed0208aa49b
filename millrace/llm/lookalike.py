"""Visually identical text with different characters: script-aware repair.

Characters first: composed accents, one width, ligatures spelt out, one blank, one hyphen,
invisible characters removed; letter case, raised digits and the number of blanks stay.
Then letters of another script: a token's dominant script is that of most of its letters that
have no look-alike elsewhere; a token without such letters takes the script that dominates the
text. A token that holds look-alikes of other scripts is respelt in its dominant script only
when the result exists in the corpus vocabulary (the tokens of all texts that need no repair),
which is looked up by a distributed join. Where it does not, nothing says how the token is
written; it is spelt by shape, each look-alike as its Latin letter, so that all tokens of that
look are equal all the same.

All decisions depend on visible shape and the whole corpus alone, so texts that look the same
come out equal. Letters of the same shape are a fixed list for Cyrillic, Greek and Armenian;
those of Cherokee, Coptic and Lisu are read from the confusables data of Spark's ICU library.

Defined results for odd input: null text stays null; an empty text stays empty; very long
texts are processed whole; repeated rows are processed each; empty tables give empty results;
only the named columns are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import runtime

# Letters of the same shape, Latin against Cyrillic, Greek and Armenian.
_CYRILLIC = dict(zip("ABEKMHOPCTXSIJYaeopcyxsijhvdqw", "АВЕКМНОРСТХЅІЈУаеорсухѕіјһѵԁԛԝ", strict=True))
_GREEK = dict(zip("ABEZHIKMNOPTYXovcj", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", strict=True))
_ARMENIAN = dict(zip("Oo", "Օօ", strict=True))
# Hyphens of the shape of '-', and invisible characters that are not in category Cf.
_HYPHENS = "".join(map(chr, (0x2010, 0x2011, 0x2043, 0x2D7, 0xFE63, 0xFF0D, 0x2212)))
_INVISIBLE = "".join(map(chr, (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10))))

SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian")
#: Further scripts, whose table is read from the confusables data of Spark's ICU library.
MORE_SCRIPTS = ("CHEROKEE", "COPTIC", "LISU")
_MORE_RANGES = ((0x13A0, 0x13FF), (0xAB70, 0xABBF), (0x2C80, 0x2CFF), (0xA4D0, 0xA4FF))
_TOKEN = regex.compile(r"(?:\p{L}\p{M}*)+")
_FOREIGN_RANGES = ((0x370, 0x52F), (0x530, 0x58F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F), *_MORE_RANGES)
_FOREIGN = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _FOREIGN_RANGES) + "]")


class Shapes:
    """Per script, its letter for each shape (named by the Latin letter), and the reverse."""

    def __init__(self, more: tuple[dict[str, str], ...] = ()):
        tables = (_CYRILLIC, _GREEK, _ARMENIAN, *more)
        latin = {c: c for t in tables for c in t}
        self.letters = (latin, *tables)
        self.shape = {letter: shape for table in self.letters for shape, letter in table.items()}
        self.scripts: dict[str, int] = {}

    def script(self, c: str) -> int:
        """Index of the script of a letter with no look-alike, -1 for all others."""
        k = self.scripts.get(c)
        if k is None:
            k = self.scripts[c] = -1 if c in self.shape else self._alone(c)
        return k

    def _alone(self, c: str) -> int:
        code = ord(c)
        if code < 0x250 or 0x1E00 <= code < 0x1F00:
            return 0 if c.isalpha() else -1
        if 0x400 <= code < 0x530:
            return 1
        if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
            return 2
        if 0x530 <= code < 0x590:
            return 3
        first = unicodedata.name(c, "").partition(" ")[0] if any(a <= code <= b for a, b in _MORE_RANGES) else ""
        return len(SCRIPTS) + MORE_SCRIPTS.index(first) if first in MORE_SCRIPTS and len(self.letters) > len(SCRIPTS) else -1

    def spelt(self, token: str, target: int) -> str:
        """Look-alikes replaced by the letters of the target script, where it has the shape."""
        shape, letters = self.shape, self.letters[target]
        return "".join(letters.get(shape[c], shape[c]) if c in shape else c for c in token)


_SHAPES = Shapes()


def confusable_shapes(spark: SparkSession) -> Shapes:
    """Shapes with the further scripts: letters whose confusables skeleton is one Latin letter of their case."""
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    more: tuple[dict[str, str], ...] = tuple({} for _ in MORE_SCRIPTS)
    for c in (chr(code) for a, b in _MORE_RANGES for code in range(a, b + 1)):
        name = unicodedata.name(c, "").partition(" ")[0]
        if name in MORE_SCRIPTS and unicodedata.category(c) in ("Lu", "Ll", "Lo"):
            shape = checker.getSkeleton(0, c)
            shape = "I" if shape == "l" and not c.islower() else shape  # the data has one form for both
            if len(shape) == 1 and shape.isascii() and shape.isalpha() and shape.islower() == c.islower():
                more[MORE_SCRIPTS.index(name)].setdefault(shape, c)
    return Shapes(more)


class _Characters(dict):
    """Translation table, filled as characters appear."""

    def __missing__(self, code: int):
        c = chr(code)
        kind = unicodedata.category(c)
        if c in _HYPHENS:
            out = "-"
        elif kind == "Cf" or c in _INVISIBLE or 0xE0100 <= code <= 0xE01EF:
            out = ""
        elif kind == "Zs":
            out = " "
        else:
            tag, _, rest = unicodedata.decomposition(c).partition(" ")
            narrow = tag in ("<wide>", "<narrow>")
            ligature = tag == "<compat>" and kind[0] == "L" and len(rest.split()) > 1 and all(unicodedata.category(chr(int(x, 16)))[0] == "L" for x in rest.split())
            out = unicodedata.normalize("NFKC", c) if narrow or ligature else c
        self[code] = out
        return out


_CHARACTERS = _Characters()


def one_character_form(text: str) -> str:
    """Width, blanks, hyphens, ligatures, invisible characters and accents in one form."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", text.translate(_CHARACTERS))


def repair(text: str | None, shapes: Shapes = _SHAPES) -> tuple[str | None, list[tuple[str, str]], list[str]]:
    """(text, tokens in shape spelling with their candidates, tokens left as they are that may be candidates).

    A token with letters of another script than its dominant one is spelt by shape, each
    look-alike as its Latin letter; the vocabulary decides whether it becomes its candidate.
    """
    if text is None:
        return None, [], []
    text = one_character_form(text)
    if not _FOREIGN.search(text):
        return text, [], []
    text = unicodedata.normalize("NFD", text)
    script, scripts = shapes.script, len(shapes.letters)
    totals = [0] * scripts
    parts: list[tuple[int, int, int]] = []  # start, end, dominant script or -1
    known: dict[str, int] = {}
    for m in _TOKEN.finditer(text):
        token = m.group()
        target = known.get(token)
        if target is None:
            certain = [0] * scripts
            for c in token:
                if (k := script(c)) >= 0:
                    certain[k] += 1
            most = max(certain)
            target = certain.index(most) if most else -1
            known[token] = target if sum(map(bool, certain)) < 2 else target + scripts
            target = known[token]
        if 0 <= target < scripts:  # one script alone is certain
            totals[target] += 1
        parts.append((m.start(), m.end(), target % scripts if target >= 0 else -1))
    most = max(range(scripts), key=lambda k: (totals[k], -k))
    out, end, pending, kept = [], 0, {}, set()
    done: dict[tuple[str, int], str] = {}
    for start, stop, target in parts:
        token = text[start:stop]
        target = most if target < 0 else target
        spelling = done.get((token, target))
        if spelling is None:
            fixed, by_shape = shapes.spelt(token, target), shapes.spelt(token, 0)
            if fixed == token:
                spelling = token
                if by_shape != token:
                    kept.add(unicodedata.normalize("NFC", token))
            else:
                spelling = by_shape
                if fixed != by_shape:
                    pending[unicodedata.normalize("NFC", by_shape)] = unicodedata.normalize("NFC", fixed)
            done[(token, target)] = spelling
        out += (text[end:start], spelling)
        end = stop
    out.append(text[end:])
    return unicodedata.normalize("NFC", "".join(out)), list(pending.items()), list(kept)


_REPAIRED = "id bigint, raw_key binary, canonical string, undecided array<struct<token:string,candidate:string>>, spelt array<string>"


def _repaired(shapes: Shapes):
    kind = pa.list_(pa.struct([("token", pa.string()), ("candidate", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [repair(t, shapes) for t in batch.column(2).to_pylist()]
            texts = pa.array([t for t, _, _ in done], pa.string())
            undecided = pa.array([[{"token": a, "candidate": b} for a, b in u] for _, u, _ in done], kind)
            spelt = pa.array([k for _, _, k in done], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts, undecided, spelt], names=["id", "raw_key", "canonical", "undecided", "spelt"])

    return run


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, pairs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            table = {p["token"]: p["candidate"] for p in pairs or ()}
            out.append(_TOKEN.sub(lambda m: table.get(m.group(), m.group()), text) if table else text)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["id", "raw_key", "canonical"])


def _decided(rows: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows after all repairs that need no vocabulary, undecided tokens, those whose candidate is in the vocabulary)."""
    base = rows.select(F.col(id_col).cast("bigint").alias("id"), F.unhex(F.sha2(text_col, 256)).alias("raw_key"), F.col(text_col).alias("text"))
    done = runtime.written(base.mapInArrow(_repaired(confusable_shapes(rows.sparkSession)), _REPAIRED), "one-form")
    pending = done.where(F.size("undecided") > 0).select("id", F.explode("undecided").alias("u")).select("id", "u.token", "u.candidate")
    # The vocabulary: tokens of all texts that need no repair, looked up by join; distinct before the shuffle.
    vocabulary = done.select(F.explode("spelt").alias("candidate")).distinct()
    present = pending.select("candidate").distinct().join(vocabulary, "candidate", "left_semi")
    return done, pending, pending.join(present, "candidate")


def one_form(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, raw_key (digest of the text as given), canonical: every row once.

    The repaired texts are written once, and those that the vocabulary decides once more.
    """
    done, _, found = _decided(rows, id_col, text_col)
    found = found.groupBy("id").agg(F.collect_set(F.struct("token", "candidate")).alias("pairs"))  # at most the tokens of a text
    undecided = done.where(F.size("undecided") > 0)
    fixed = undecided.join(found, "id", "left").select("id", "raw_key", "canonical", "pairs").mapInArrow(_replaced, "id bigint, raw_key binary, canonical string")
    return done.where(F.size("undecided") == 0).select("id", "raw_key", "canonical").unionByName(runtime.written(fixed, "one-form-decided"))


def vocabulary_report(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row: texts with undecided tokens, distinct undecided tokens, those that the vocabulary decides."""
    _, pending, found = _decided(rows, id_col, text_col)
    all_of = pending.agg(F.countDistinct("id").alias("texts"), F.countDistinct("token", "candidate").alias("undecided_tokens"))
    return all_of.withColumn("decided_tokens", F.lit(found.select(F.countDistinct("token", "candidate")).first()[0]).cast("bigint"))


def lookalike_pairs(forms: DataFrame) -> DataFrame:
    """doc_id_a < doc_id_b: texts that differ in characters but have one canonical form.

    Different texts of one form are paired first, copies collapsed; each pair of texts then
    meets its documents. Copies of one text are never compared with each other.
    """
    keyed = forms.where(F.col("canonical").rlike(r"[^\p{IsWhite_Space}]")).select("id", "raw_key", F.unhex(F.sha2("canonical", 256)).alias("key"))
    texts = keyed.select("key", "raw_key").distinct()
    several = texts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    texts = texts.join(several, "key", "left_semi")
    pairs = texts.withColumnRenamed("raw_key", "raw_a").join(texts.withColumnRenamed("raw_key", "raw_b"), "key").where("raw_a < raw_b").select("raw_a", "raw_b")
    member = keyed.select("id", "raw_key")
    both = pairs.join(member.select(F.col("id").alias("a"), F.col("raw_key").alias("raw_a")), "raw_a").join(member.select(F.col("id").alias("b"), F.col("raw_key").alias("raw_b")), "raw_b")
    return both.where("a != b").select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))


def lookalike_groups(forms: DataFrame) -> DataFrame:
    """doc_id, form_id, texts: documents whose form has several different texts, with the least id of the form.

    The compact form of lookalike_pairs: one row per document, whatever the number of copies.
    """
    keyed = forms.where(F.col("canonical").rlike(r"[^\p{IsWhite_Space}]")).select("id", "raw_key", F.unhex(F.sha2("canonical", 256)).alias("key"))
    texts = keyed.groupBy("key", "raw_key").agg(F.min("id").alias("least"))
    classes = texts.groupBy("key").agg(F.min("least").alias("form_id"), F.count(F.lit(1)).alias("texts")).where("texts > 1")
    return keyed.join(classes, "key").select(F.col("id").alias("doc_id"), "form_id", "texts")
