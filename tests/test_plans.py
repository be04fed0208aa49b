"""Plans: pruned scans, pushed filters, no cross joins; results do not depend on partitioning."""

import pytest

from millrace.plans import registry

QUIET = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_cross_join(spark, sf_dir, name):
    text = plan(registry.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_are_pruned_and_filters_pushed(spark, sf_dir):
    text = plan(registry.QUERIES["rejected_over_length"](spark, sf_dir))
    assert "ReadSchema: struct<reject_id:bigint,issues:array<string>,source:string,token_count:int>" in text
    text = plan(registry.QUERIES["scan_aggregate"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in text and "l_comment" not in text
    text = plan(registry.QUERIES["hash_split"](spark, sf_dir))
    assert "ReadSchema: struct<sample_id:string,split_key:string>" in text  # the keys, written once
    text = plan(registry.QUERIES["keyset_difference"](spark, sf_dir))
    assert "ReadSchema: struct<sample_id:string>" in text and "input_ids" not in text.split("== Physical Plan ==")[1]


@pytest.mark.parametrize("name", ["reason_counts", "review_topk_per_reason", "stratified_sample", "optimizer_step_batches", "hash_split", "spike_streak"])
def test_partitioning_does_not_matter(spark, sf_dir, name):
    before = spark.conf.get(QUIET[0])
    results = []
    try:
        for n in ("1", "13"):
            spark.conf.set(QUIET[0], n)
            results.append(sorted(map(str, registry.QUERIES[name](spark, sf_dir).collect())))
    finally:
        spark.conf.set(QUIET[0], before)
    assert results[0] == results[1]


def test_ngrams_meet_a_bounded_bitmap_first(spark, sf_dir):
    """The rows' n-grams are joined with the broadcast bitmap before they are shuffled by hash."""
    text = plan(registry.QUERIES["decontaminate_8gram"](spark, sf_dir))
    physical = text[text.index("== Physical Plan ==") :]
    assert "getbit" in physical and "BroadcastHashJoin" in physical


def test_first_wins_joins_no_null_keys(spark):
    from pyspark.sql import functions as F

    from millrace.operators import audit

    rows = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), (None, 4)], "k string, o int")
    out = audit.first_wins(rows, "k", "o", F.lit(True))
    assert sorted((r.o, r.first_ok) for r in out.collect()) == [(1, 1), (2, 1), (3, None), (4, None)]
    assert "isnotnull(k" in plan(out).lower()


def test_contamination_has_no_false_reason(spark):
    """Random n-grams: exactly the shared ones give reasons, whatever bits they hit."""
    import random

    from millrace.operators import audit

    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(40)}"
    suites = [(f"s{i % 3}", " ".join(word() for _ in range(rng.randrange(2, 12)))) for i in range(60)]
    rows = [(i, " ".join(word() for _ in range(rng.randrange(2, 40)))) for i in range(300)]
    grams = lambda t: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)}
    want = {i: sorted({f"evaluation_3gram_overlap:{s}" for s, p in suites if grams(p) & grams(t)}) for i, t in rows if t not in {p for _, p in suites}}
    got = audit.contamination(spark.createDataFrame(rows, "i int, t string"), spark.createDataFrame(suites, "suite string, problem string"), "i", "t", 3)
    assert {r.i: r.reasons for r in got.collect() if "exact" not in r.reasons[0]} == {i: r for i, r in want.items() if r}
