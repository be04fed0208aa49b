"""The queries on the reference's normal form against plain Python, on texts that only this form makes equal."""

import hashlib
import unicodedata
from collections import Counter

import pytest

import __spark_entry__ as entry
from millrace.plans.audit_queries import SETTINGS

BASE = "Find the first of all nine straße numbers below fifty"
FORMS = [BASE, BASE.upper(), BASE.replace("fi", "\ufb01"), BASE.replace(" ", "\u00a0"), BASE.replace(" ", "\u3000 "), "".join(chr(ord(c) + 0xFEE0) if c.isalpha() and ord(c) < 127 else c for c in BASE), "Σίσυφος", "ΣΊΣΥΦΟΣ", "Another problem of its own", None, "", " \u2003 ", "Say: " + BASE.replace(" ", "\u00a0"), "\u00e9 one", "e\u0301 one"]
SUITES = [("a", BASE), ("b", "note " + BASE.replace("nine", "\uff4e\uff49\uff4e\uff45") + " end"), ("c", None), ("d", "\u3000"), ("e", "ANOTHER problem of its own")]
GOOD = "<think>s</think> \\boxed{4}"


def norm(text):
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def grams(text):
    w = norm(text).split()
    return {tuple(w[i : i + 8]) for i in range(len(w) - 7)}


def matches(text):
    items = [(s, p) for s, p in SUITES if p is not None and norm(p)]
    exact = {s for s, p in items if norm(p) == norm(text)}
    near = {s for s, p in items if grams(p) & grams(text)}
    return [f"evaluation_exact_match:{s}" for s in sorted(exact)] or [f"evaluation_8gram_overlap:{s}" for s in sorted(near)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("strict"))
    spark.createDataFrame(list(enumerate(FORMS)), "doc_id bigint, text string").write.parquet(f"{d}/documents.parquet")
    long = GOOD + " word word" * 101
    reviews = [(i, p, GOOD, [], "s", None) for i, p in enumerate(FORMS)] + [(50, "Third One", long, [], None, None), (51, "third one", GOOD, [], "s", None), (52, "ＴＨＩＲＤ one", GOOD, [], "s", None), (53, "third one", GOOD, ["math_verify_failed"], "s", None)]
    spark.createDataFrame(reviews, "review_index bigint, problem string, generation string, issues array<string>, source string, uuid string").write.parquet(f"{d}/review_samples.parquet")
    spark.createDataFrame(SUITES, "suite string, problem string").write.parquet(f"{d}/eval_suites.parquet")
    want, taken = {}, set()
    for i, p, g, issues, _, _ in reviews:
        if p is None or not p.strip():
            want[i] = ["empty_problem"]
        elif issues:
            want[i] = issues
        else:
            want[i] = ["duplicate_problem"] if norm(p) in taken else matches(p) or (["over_max_length"] if len(g.split()) > 200 else [])
            taken |= set() if want[i] else {norm(p)}
    return d, reviews, want


def run(spark, folder, name):
    return [tuple(r) for r in entry.queries()[name](spark, folder[0]).collect()]


def test_dedup(spark, folder):
    first, want = {}, set()
    for i, t in enumerate(FORMS):
        if t is not None:
            f = first.setdefault(norm(t), i)
            want.add((i, f, i > f))
    assert set(run(spark, folder, "dedup_first_wins_strict")) == want
    counts = Counter(sha(norm(t)) for t in FORMS if t is not None)
    assert dict(run(spark, folder, "duplicate_groups_strict")) == {h: n for h, n in counts.items() if n > 1}


def test_contamination(spark, folder):
    want = {(i, r) for i, p, *_ in folder[1] if p is not None for r in matches(p)}
    exact = set(run(spark, folder, "decontaminate_exact_strict"))
    near = set(run(spark, folder, "decontaminate_8gram_strict"))
    assert exact == {x for x in want if "exact" in x[1]} and near == {x for x in want if "8gram" in x[1]} and exact and near
    by = {(s, sum(r == f"evaluation_exact_match:{s}" for _, r in want), sum(r == f"evaluation_8gram_overlap:{s}" for _, r in want)) for s in "abe"}
    assert set(run(spark, folder, "contamination_by_suite_strict")) == by


def test_audit(spark, folder):
    _, reviews, want = folder
    rows = entry.queries()["audit_rows_strict"](spark, folder[0]).collect()
    assert {r.row_index: [x for x in r.issues.split(",") if x] for r in rows} == want and len(rows) == len(want)
    problem = {r[0]: r[1] for r in reviews}
    accepted = {i for i, w in want.items() if not w}
    assert {r.sample_id for r in rows if r.row_index in accepted} == {sha(norm(problem[i])) for i in accepted}
    assert dict(run(spark, folder, "reason_counts_strict")) == Counter(x for w in want.values() for x in w)
    source = {r[0]: r[4] or "unknown" for r in reviews}
    total, ok = Counter(source.values()), Counter(source[i] for i in accepted)
    assert set(run(spark, folder, "audit_by_source_strict")) == {(s, n, ok[s]) for s, n in total.items()}
    manifest = entry.queries()["audit_manifest_strict"](spark, folder[0]).first()
    assert (manifest["rows"], manifest.accepted, manifest.rejected) == (len(want), len(accepted), len(want) - len(accepted))
    assert {r[0] for r in run(spark, folder, "audit_split_strict")} == {sha(norm(problem[i])) for i in accepted} and SETTINGS.validation_size >= len(accepted)
    picked = {r[3] for r in run(spark, folder, "review_topk_per_reason_strict") if r[0] == "accepted"}
    assert picked == accepted
