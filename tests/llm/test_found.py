"""The pN_found queries against brute force on small tables."""

import json
import re
import unicodedata
from collections import Counter, defaultdict

import pandas as pd
import pytest

from millrace.llm import crosssplit, queries

WORD = re.compile(r"[^\W_]+")


@pytest.fixture(scope="module")
def data():
    d = "/root/testdata/sf0.01"
    return d, {t: pd.read_parquet(f"{d}/{t}.parquet") for t in ("review_samples", "rejected", "raw_lines", "train", "validation", "eval_suites", "documents")}


def canon(text):
    return "".join(c for c in text if not (c.isspace() or unicodedata.category(c)[0] == "P")).casefold()


def test_p1_found(spark, data):
    d, t = data
    want = set()

    def groups(name, rows):
        by = defaultdict(list)
        for i, key in rows:
            if key:
                by[key].append(i)
        for ids in by.values():
            want.update((name, min(ids), i) for i in ids if i != min(ids))

    groups("review_samples", [(i, canon(x)) for i, x in zip(t["review_samples"].review_index, t["review_samples"].problem) if x is not None])
    groups("rejected", [(i, canon(x)) for i, x in zip(t["rejected"].reject_id, t["rejected"].problem_hash) if x is not None])
    lines = []
    for i, line in zip(t["raw_lines"].line_id, t["raw_lines"].line):
        try:
            o = json.loads(line)
        except ValueError:
            continue
        lines.append((i, tuple(sorted((k, None if v is None else canon(v)) for k, v in o.items()))))
    groups("raw_lines", lines)
    got = [tuple(r) for r in queries.p1_found(spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def test_p2_found(spark, data):
    d, t = data
    train, val = set(t["train"].sample_id.dropna()), set(t["validation"].sample_id.dropna())
    texts = {(s, tuple(WORD.findall(p.lower()))) for s, p in zip(t["review_samples"].sample_id, t["review_samples"].problem) if s is not None and p is not None}
    want = {(s, s) for s in train & val}
    by = defaultdict(list)
    for s, w in texts:
        by[tuple(x for x in w if any(c.isnumeric() for c in x))].append((s, w))
    for group in by.values():
        for sa, a in group:
            for sb, b in group:
                if sa in train and sb in val and a and b and distance(a, b) * 5 <= max(len(a), len(b)):
                    want.add((min(sa, sb), max(sa, sb)))
    got = [tuple(r) for r in queries.p2_found(spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > len(train & val)


def test_p4_found(spark, data):
    d, t = data
    items = {i: WORD.findall(x.lower()) for i, x in zip(t["eval_suites"].item_id, t["eval_suites"].problem) if x is not None}
    joined = {i: " " + " ".join(w) + " " for i, w in items.items()}
    grams = defaultdict(set)
    for i, w in items.items():
        for k in range(len(w) - 7):
            grams[tuple(w[k : k + 8])].add(i)
    want = set()
    for r, *texts in zip(t["review_samples"].review_index, t["review_samples"].problem, t["review_samples"].generation):
        for text in texts:
            w = WORD.findall((text or "").lower())
            for k in range(len(w) - 7):
                for i in grams.get(tuple(w[k : k + 8]), ()):
                    n = 8
                    while k + n < len(w) and " " + " ".join(w[k : k + n + 1]) + " " in joined[i]:
                        n += 1
                    run = " " + " ".join(w[k : k + n]) + " "
                    if not any(run in x for j, x in joined.items() if j != i):
                        want.add((i, r))
    got = [tuple(r) for r in queries.p4_found(spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10


def test_p4_blocks_agree(spark, data):
    from millrace.llm import leakage

    d, _ = data
    args = (spark.read.parquet(f"{d}/review_samples.parquet"), "review_index", ["problem", "generation"], spark.read.parquet(f"{d}/eval_suites.parquet"), "item_id", "problem")
    one = {tuple(r) for r in leakage.leaked_items(leakage.leaks(*args)).collect()}
    many = {tuple(r) for r in leakage.leaked_items(leakage.leaks(*args, block_words=9000)).collect()}
    assert one == many


LOOK = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "У": "Y", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o"}


def skeleton(text):
    out = []
    for c in unicodedata.normalize("NFC", text):
        if unicodedata.category(c) == "Cf":
            continue
        if unicodedata.category(c) == "Zs":
            c = " "
        elif ord(c) in (0x2010, 0x2011):
            c = "-"
        elif 0xFF01 <= ord(c) <= 0xFF5E or 0xFB00 <= ord(c) <= 0xFB06:
            c = unicodedata.normalize("NFKC", c)
        out.append(c)
    text = unicodedata.normalize("NFD", "".join(out))
    return unicodedata.normalize("NFC", "".join(LOOK.get(c, c) for c in text))


def test_p10_found(spark, data):
    d, t = data
    by = defaultdict(list)
    for i, x in zip(t["documents"].doc_id, t["documents"].text):
        if x is not None and x.strip():
            by[skeleton(x)].append((i, x))
    want = {(min(a, b), max(a, b)) for g in by.values() for a, x in g for b, y in g if x != y}
    got = [tuple(r) for r in queries.p10_found(spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10


def test_p8_ids_match_the_tokenizer(spark, data):
    from tokenizers import Tokenizer

    d, t = data
    tok = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    tok.encode_special_tokens = True
    got = {r.doc_id: list(r.ids) for r in queries.p8_ids(spark, d).collect()}
    docs = t["documents"]
    assert set(got) == set(docs.doc_id)
    for i, x in zip(docs.doc_id, docs.text):
        assert got[i] == (tok.encode(x, add_special_tokens=False).ids if x else [])


def test_word_distance_is_exact():
    import random

    rng = random.Random(3)
    for _ in range(3000):
        a = [rng.choice("abc") for _ in range(rng.randrange(9))]
        b = [rng.choice("abc") for _ in range(rng.randrange(9))]
        most = rng.randrange(6)
        assert crosssplit.word_distance(a, b, most) == min(distance(a, b), most + 1)


def test_prefix_join_loses_no_pair(spark):
    """Random near-copies, with digits, repeated words and hot sequences."""
    import random

    rng = random.Random(8)
    base = [[rng.choice(["the", "of", "and", "cat", "dog", "7", "12", "99", "fox", "sun"]) for _ in range(rng.randrange(1, 30))] for _ in range(60)]
    left, right = [], []
    for w in base:
        for side in (left, right):
            for _ in range(2):
                v = list(w)
                for _ in range(rng.randrange(0, 1 + len(v) // 4)):
                    at = rng.randrange(len(v))
                    if not v[at].isdigit():
                        v[at] = rng.choice(["the", "sky", "sea", "cat"])
                side.append(" ".join(v))
    left, right = sorted(set(left)), sorted(set(right))
    frames = [spark.createDataFrame([(bytes(x.encode()), x) for x in side], "doc binary, text string") for side in (left, right)]
    got = {(bytes(r.doc_a).decode(), bytes(r.doc_b).decode()) for r in crosssplit.near_texts(*frames).collect()}
    want = set()
    for x in left:
        for y in right:
            a, b = x.split(), y.split()
            if [w for w in a if w.isdigit()] == [w for w in b if w.isdigit()] and distance(a, b) * 5 <= max(len(a), len(b)):
                want.add((x, y))
    assert got == want and len(want) > 60
    assert Counter(got).most_common(1)[0][1] == 1
