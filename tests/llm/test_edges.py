"""Odd input for every training-data operator: nulls, empty and very long texts, repeats, empty tables, clashing columns."""

import random
import time

import numpy as np
import pytest

from millrace.llm import crosssplit, encoding, formatting, leakage, ledger, linear, lookalike, mixing, packing, pairdefects, truncation
from millrace.llm.ending import says_nothing

LONG = "word " * 60_000


def _collapsed(*args):
    return formatting.groups(formatting.survivors(*args)), formatting.members(*args)


def test_formatting(spark):
    rows = [(1, "A b."), (2, "a B"), (3, None), (4, ""), (5, " ?! "), (6, "...  "), (7, "a B"), (8, LONG), (9, LONG.upper()), (None, "ab"), (10, "Straße"), (11, "STRASSE")]
    df = spark.createDataFrame(rows, "id bigint, raw string").selectExpr("id", "raw", "1 as n", "2 as first", "3 as canon", "4 as key")
    groups, members = _collapsed(df, "id", "raw")
    assert {tuple(r) for r in members.collect()} == {(1, 2), (1, 7), (8, 9), (10, 11)}
    assert sorted(r.copies for r in groups.collect()) == [2, 2, 4]
    empty = spark.createDataFrame([], "id bigint, raw string")
    assert [x.count() for x in _collapsed(empty, "id", "raw")] == [0, 0]


def test_formatting_json(spark):
    lines = [
        (1, '{"a": "X y", "b": null}'), (2, '{"b":null,\n"a":"xy."}'), (3, '{"a": "xy", "b": "null"}'), (4, '{"a": "xy"}'), (5, "{bad"), (6, "[1]"), (7, None), (8, '{"a": 1.5, "b": -1}'),
        (9, '{"b": -1, "a": 1.5}'), (10, '{"a": 15, "b": 1}'), (11, '{"a": null}'), (12, '{"a": null}'), (13, "{}"), (14, "{}"), (15, '{"a": "?"}'), (16, '{"a": "\\ud800"}'),
    ]
    df = spark.createDataFrame(lines, "id bigint, line string")
    assert {tuple(r) for r in _collapsed(df, "id", "line", "json")[1].collect()} == {(1, 2), (8, 9)}


def test_split_overlaps(spark):
    ids = lambda *x: spark.createDataFrame([(i, 1) for i in x], "sample_id string, term int")
    text = "the quick brown fox jumps over the lazy dog 7 times"
    problems = spark.createDataFrame(
        [("a", text), ("b", text.upper() + "!"), ("c", text.replace("fox", "cat")), ("d", text.replace("7", "8")), ("e", None), ("f", ""), ("g", LONG), ("h", LONG + "end"), (None, text), ("a", text), ("i", "7"), ("j", "7.")],
        "sample_id string, problem string",
    )
    out = crosssplit.split_overlaps(ids("a", "a", "c", "e", "f", "g", "i", "x", None), ids("b", "d", "f", "h", "j", "x", None), problems)
    assert {tuple(r) for r in out.collect()} == {("x", "x"), ("f", "f"), ("a", "b"), ("c", "b"), ("g", "h"), ("i", "j")}
    empty = spark.createDataFrame([], "sample_id string, problem string")
    assert crosssplit.split_overlaps(ids("a"), ids("b"), empty).count() == 0
    assert crosssplit.split_overlaps(ids(), ids(), problems).count() == 0


def test_leaks(spark):
    words = [f"w{i}" for i in range(40)]
    item = " ".join(words[:20])
    other = " ".join(["x"] * 3 + words[20:29] + ["y"])
    twin = " ".join(["z"] + words[20:29])
    items = spark.createDataFrame([(1, item), (2, other), (3, twin), (4, None), (5, "short"), (None, item)], "item_id bigint, problem string").selectExpr("*", "1 as row_id")
    rows = spark.createDataFrame(
        [(1, " ".join(words[12:20] + ["q"] + words[2:11]), None), (2, " ".join(words[20:29]), ""), (3, None, "x " + " ".join(words[20:29])), (4, " ".join(words[:7]), None), (5, LONG + item.upper() + " " + LONG, None), (None, item, None)],
        "r bigint, a string, b string",
    )
    found = leakage.leaks(rows, "r", ["a", "b"], items, "item_id", "problem")
    assert {tuple(r) for r in leakage.leaked_items(found).collect()} == {(1, 1), (2, 3), (1, 5)}
    reordered = leakage.covered_items(rows, "r", ["a", "b"], items, "item_id", "problem", min_words=8).where("row_id = 1").first()
    assert reordered.covered == 17 and reordered.tiles == 2
    covered = leakage.covered_items(rows, "r", ["a", "b"], items, "item_id", "problem", min_coverage=0.9)
    assert covered.where("row_id = 1").count() == 0
    assert leakage.leaks(rows, "r", ["a"], items.limit(0), "item_id", "problem").count() == 0
    assert leakage.leaks(rows.limit(0), "r", ["a"], items, "item_id", "problem").count() == 0


def test_covered_items_reordered(spark):
    """Passages of an item in another order cover it, though no long run does."""
    item = [f"w{k}" for k in range(30)]
    pieces = [item[20:27], item[0:6], item[12:20], item[6:12]]
    text = " filler ".join(" ".join(x) for x in pieces)
    rows = spark.createDataFrame([(1, text, None), (2, " ".join(item[:20]), ""), (3, None, " ".join(item) + " " + " ".join(item))], "r bigint, a string, b string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "a b c")], "item_id bigint, problem string")
    got = {(r.row_id, r.item_id, r.field, r.covered, r.tiles) for r in leakage.covered_items(rows, "r", ["a", "b"], items, "item_id", "problem").collect()}
    assert got == {(1, 7, "a", 27, 4), (3, 7, "b", 30, 1)}
    assert leakage.leaks(rows, "r", ["a"], items, "item_id", "problem", min_words=9).where("row_id = 1").count() == 0
    assert leakage.covered_items(rows.limit(0), "r", ["a"], items, "item_id", "problem").count() == 0


def test_tiling_and_owners_like_the_plain_way():
    """Heap and sweep against marking and comparing in the plain way, on random runs."""
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.randrange(4) for _ in range(40)]
        item = [rng.randrange(4) for _ in range(14)]
        runs = [(p, q, n) for p in range(40) for q in range(14) for n in range(3, 15) if words[p : p + n] == item[q : q + n] and len(words[p : p + n]) == n and q + n <= 14]
        marked_p, marked_q, want = set(), set(), []
        while True:
            free = [(-n, p, q) for p0, q0, n0 in runs for x in range(n0) for n in range(3, n0 - x + 1) for p, q in [(p0 + x, q0 + x)] if not marked_p & set(range(p, p + n)) and not marked_q & set(range(q, q + n))]
            if not free:
                break
            n, p, q = min(free)
            want.append((p, q, -n))
            marked_p |= set(range(p, p - n))
            marked_q |= set(range(q, q - n))
        assert leakage.tiling(runs, 3) == want
        spans = {k: [(rng.randrange(10), 0, rng.randrange(1, 8)) for _ in range(rng.randrange(4))] for k in range(3)}
        flat = {(p, p + n, k) for k, found in spans.items() for p, _, n in found}
        for start, size, k in leakage.owned_runs(spans):
            owners = {o for a, b, o in flat if a <= start and b >= start + size}
            assert (k is None) == (len(owners) > 1) and (k is None or owners == {k})


def test_many_repeats_of_an_item_are_quick():
    words = [f"w{k}" for k in range(20)]
    index = leakage.SeedIndex([(1, " ".join(words))], 8)
    ids = np.array([index.vocabulary[w] for w in words] * 20_000, np.uint64)
    began = time.perf_counter()
    out = leakage.text_matches(index, ids, *index.find(ids))
    assert sum(r[1] > 0 for r in out) == 20_000 and out[-1][2:] == (1, 20, 20, 1) and time.perf_counter() - began < 20


def test_tiling_marks_longest_first():
    assert leakage.tiling([(0, 0, 10), (5, 20, 12)], 3) == [(5, 20, 12), (0, 0, 5)]
    assert leakage.tiling([(0, 0, 10), (20, 5, 8)], 3) == [(0, 0, 10), (25, 10, 3)]


def test_ledger_is_stable(spark):
    keys = [f"k{i}" for i in range(500)]
    frame = lambda k, p: spark.createDataFrame([(x, 1) for x in k], "sample_id string, priority int").repartition(p)
    first = ledger.grow(frame(keys[:300] + [None, keys[0]], 3), None, 0.1)
    again = ledger.grow(frame(keys[:300][::-1], 7), None, 0.1)
    assert {r.key for r in first.collect()} == {r.key for r in again.collect()} and first.count() == 30
    second = ledger.grow(frame(keys, 5), first, 0.1)
    kept = {r.key: r.round for r in second.collect()}
    assert len(kept) == 50 and {r.key for r in first.collect()} == {k for k, n in kept.items() if n == 1}
    assert ledger.grow(frame([], 1), None, 0.5).count() == 0
    assert ledger.grow(frame(keys, 2), ledger.empty_ledger(spark), 1.0).count() == 500
    gone = ledger.grow(frame(keys[300:], 2), first, 0.1)
    assert {r.key for r in first.collect()} <= {r.key for r in gone.collect()}
    with pytest.raises(ValueError):
        ledger.grow(frame(keys, 2), None, 1.5)


def test_lower_bound_and_best_fit():
    rng = np.random.default_rng(0)
    for capacity in (10, 17, 64):
        for _ in range(60):
            lengths = np.sort(rng.integers(1, capacity + 1, rng.integers(1, 40)))[::-1]
            where, offset, free = packing.best_fit_decreasing(lengths, capacity)
            used = np.zeros(len(free), int)
            np.add.at(used, where, lengths)
            assert (used <= capacity).all() and (capacity - used == np.array(free)).all()
            bound = packing.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
            assert bound <= len(free) <= max(bound + 2, int(1.3 * bound) + 1)
    exact = lambda lengths, c: packing.lower_bound(np.bincount(lengths, minlength=c + 1), c)
    assert exact([6, 6, 6], 10) == 3 and exact([5, 5, 5, 5], 10) == 2 and exact([4, 4, 4], 10) == 2 and exact([], 10) == 0


def _records(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, input_ids array<int>, labels array<int>, recorded_at timestamp, part int, bin int")


def test_packing(spark):
    rec = lambda i, n: (i, list(range(n)), [-100] + [5] * (n - 1), None, 1, 2)
    rows = [rec("a", 6), rec("b", 4), rec("a", 6), rec("a", 6), rec("c", 25), (None, [1, 2], [1, 2], None, 1, 2), ("d", [], [], None, 1, 2), ("e", [1, 2], [1], None, 1, 2), ("f", [1, 2], [-100, -100], None, 1, 2), ("g", None, None, None, 1, 2), ("h", [1, None], [1, 2], None, 1, 2), rec("i", 10)]
    out = packing.pack(_records(spark, rows), capacity=10, part_items=3).collect()
    assert len(out) == len({(r.sample_id, r.variant, r.copy, r.piece_start) for r in out})
    assert sorted((r.sample_id, r.copy, r.piece_start, r.piece_length) for r in out) == [("a", 1, 0, 6), ("a", 2, 0, 6), ("a", 3, 0, 6), ("b", 1, 0, 4), ("c", 1, 0, 10), ("c", 1, 10, 10), ("c", 1, 20, 5), ("i", 1, 0, 10)]
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.position, r.piece_length))
    for pieces in by.values():
        pieces.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and pieces[0][0] == 0 and sum(n for _, n in pieces) <= 10
    assert packing.pack(_records(spark, [])).count() == 0
    hot = packing.items(_records(spark, [rec("a", 3)] * 25), 10, block=4).collect()
    assert sorted(r.copy for r in hot) == list(range(1, 26))


def test_materialized_sequences(spark):
    rng = random.Random(3)
    rows = [(f"k{i}", [i * 100 + j for j in range(n)], [-100] + [j for j in range(1, n)], None, 1, 2) for i, n in enumerate(rng.choice([2, 3, 5, 8, 23]) for _ in range(40))]
    df = _records(spark, [*rows, rows[0]])
    placed = packing.pack(df, capacity=10, part_items=15)
    out = packing.materialize(df, placed, capacity=10, pad=-1).collect()
    assert all(len(r.input_ids) == len(r.labels) == len(r.segments) == 10 for r in out)
    assert sorted(x for r in out for x in r.input_ids if x != -1) == sorted([x for r in rows for x in r[1]] + rows[0][1])
    for r in out:
        for x, y, s in zip(r.input_ids, r.labels, r.segments):
            assert (s == 0) == (x == -1) and (y == -100 or y == x % 100)


def test_automaton_is_exact_and_minimal(tmp_path):
    rng = random.Random(4)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 8))) for _ in range(400)} | {b"ing", b"king", b"sing", b"a", b""[:0] or b"b"}
    entries = {w: [len(w), *w] for w in words}
    a = encoding.Automaton.build(entries)
    path = tmp_path / "a.bin"
    path.write_bytes(a.to_bytes())
    a = encoding.Automaton.mapped(str(path))
    for w, n in zip([*words, b"zzz", b"ab" * 9, b""], a.numbers([*words, b"zzz", b"ab" * 9, b""]).tolist()):
        assert (list(a.outputs(n)) == entries[w]) if w in entries else n == -1
    few = encoding.Automaton.build({w: [1] for w in (b"sing", b"king", b"ring")})
    assert len(few.final) == 5  # the suffix is shared
    assert encoding.Automaton.build({}).numbers([b"x"]).tolist() == [-1]


def test_encoding_round_trip(spark):
    import tiktoken

    merges = encoding.Merges.at("/opt/tokenizers/byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=merges.ranks, special_tokens={})
    texts = [None, "", "  ", "Hello world", "<|endoftext|> ok", "né 中文　x", LONG, "x" * 2000, "Hello world"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").selectExpr("*", "1 as ids", "2 as word")
    got = {r.id: list(r.ids) for r in encoding.encode(df, "id", "text", lexicon_words=5).collect()}
    for i, t in enumerate(texts):
        assert got[i] == own.encode_ordinary(t or "") and own.decode(got[i]) == (t or "")
    assert encoding.encode(df.limit(0), "id", "text").count() == 0


def test_mixing(spark):
    docs = [(i, f"{'alpha' if i % 3 else 'beta'} words number {i} " * (1 + i % 4), "A" if i % 3 else "B") for i in range(300)]
    docs += [(1000, None, "A"), (1001, "", "B"), (1002, "other text", "C"), (1003, "no source here", None), (None, "alpha", "A")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").selectExpr("*", "1 as tokens", "2 as membership")
    goal = lambda rows: spark.createDataFrame(rows, "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(df, goal([("A", 0.5, 1), ("B", 0.5, 3)]))
    shares = {r.source: r for r in report.collect()}
    assert abs(shares["A"].actual_share - 0.5) < 0.01 and abs(shares["B"].actual_share - 0.5) < 0.01
    rows = chosen.collect()
    assert {r.source for r in rows} == {"A", "B"} and max(r.repeats for r in rows if r.source == "A") == 1 and max(r.repeats for r in rows) <= 3
    # no text, other sources and null ids stay out; a document without source takes part by its posterior
    assert len({r.id for r in rows}) == len(rows) and all(r.id < 1000 or r.id == 1003 and r.repeats == 1 for r in rows)
    assert sum(r.unlabelled for r in shares.values()) == sum(r.id == 1003 for r in rows)
    # as large as allowed: one source is used up
    sums = {s: sum(r.tokens * r.repeats for r in rows if r.source == s) for s in "AB"}
    all_a = sum(r.tokens for r in mixing.mix(df, goal([("A", 1.0, 1)]))[0].collect())
    assert sums["A"] >= 0.99 * all_a or sums["B"] >= 2.97 * sum(r.tokens for r in mixing.mix(df, goal([("B", 1.0, 1)]))[0].collect())
    assert mixing.mix(df, goal([("A", 0.5, 1), ("Z", 0.5, 1)]))[0].count() == 0
    assert mixing.mix(df.limit(0), goal([("A", 1.0, 1)]))[0].count() == 0
    assert mixing.mix(df, goal([]))[0].count() == 0


def test_pretokens_are_those_of_the_pattern():
    rng = random.Random(8)
    pool = [chr(c) for c in (*range(32, 127), 9, 10, 13, 0x1C, 0x85, 0xA0, 0x2003, 0x3000, 0x200B, 0xB2, 0xBD, 0x2167, 0x663, 0x3007, 0x4E00, 0x301, 0x1D400, 0x1F600, 0x1D7D8)]
    pool += [chr(c) for c in rng.sample([c for c in range(0x10000) if not 0xD800 <= c < 0xE000], 3000)]
    for _ in range(3000):
        text = "".join(rng.choice(pool[:140] if rng.random() < 0.8 else pool) for _ in range(rng.randrange(60)))
        assert encoding.pretokens(text) == encoding._SPLIT.findall(text)


def _units(spark, tokens, members, caps):
    return spark.createDataFrame([(float(t), float(c), [float(x) for x in m]) for t, m, c in zip(tokens, members, caps)], "tokens double, cap double, membership array<double>").repartition(3)


def test_rates_meet_targets(spark):
    members = np.array([[1, 0], [0, 1], [0.5, 0.5], [0.1, 0.3]])
    tokens, caps, share = np.array([100.0, 300.0, 50.0, 80.0]), np.array([2.0, 1.0, 1.0, 1.0]), np.array([0.3, 0.7])
    steps, targets = mixing.fit_rates(_units(spark, tokens, members, caps), share, tolerance=1e-6)
    rates = mixing.replay(members, caps, steps)
    most = (members.T @ (tokens * caps) / share).min()
    assert np.allclose(targets, share * most) and np.allclose(members.T @ (rates * tokens), targets, rtol=1e-5) and (rates >= 0).all() and (rates <= caps).all()


def test_rates_are_the_least_squares(spark):
    """Against a plain projected gradient of many small steps, where the targets cannot be met."""
    rng = np.random.default_rng(4)
    members = np.concatenate([np.eye(3), rng.dirichlet(np.ones(4), 40)[:, :3]])
    tokens, caps, share = np.concatenate([[400.0, 900.0, 60.0], rng.uniform(5, 60, 40)]), np.concatenate([[2.0, 1.0, 3.0], np.ones(40)]), np.array([0.5, 0.3, 0.2])
    steps, targets = mixing.fit_rates(_units(spark, tokens, members, caps), share, tolerance=1e-6)
    got = members.T @ (mixing.replay(members, caps, steps) * tokens) - targets
    rates = caps.copy()
    for _ in range(200_000):
        rates = np.clip(rates - 1e-4 * members @ (members.T @ (rates * tokens) - targets), 0, caps)
    want = members.T @ (rates * tokens) - targets
    assert np.abs(got).max() <= np.abs(want).max() + 1e-3 * targets.max()


def test_lookalike(spark):
    same = ["The cat ﬁnds café-X", "Тhe сat finds café‐X", "Ｔhe cat fi​nds café‑X"]
    apart = ["the cat finds café-X", "The cat finds cafe-X", "The  cat finds café-X", "The cat finds café–X", "x2", "x²"]
    russian = ["Торговец из Loukeburg покупает 9 с а", "Topговец из Loukeburg покупает 9 с a"]
    texts = [*same, *apart, *russian, None, "", "   ", same[0], LONG, "\n\t", "\n" + chr(0x200B) + "\t"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").selectExpr("*", "1 as canonical", "2 as raw_key")
    forms = lookalike.one_form(df, "id", "text")
    form = {r.id: r.canonical for r in forms.collect()}
    assert form[0] == form[1] == form[2] == "The cat finds café-X" and len({form[i] for i in range(3, 9)}) == 6
    assert form[9] == form[10] == russian[0] and form[11] is None and form[12] == "" and form[15] == LONG
    assert {tuple(r) for r in lookalike.lookalike_pairs(forms).collect()} == {(0, 1), (0, 2), (1, 2), (1, 14), (2, 14), (9, 10)}
    assert lookalike.one_form(df.limit(0), "id", "text").count() == 0


def test_lookalike_vocabulary_decides(spark):
    """A token with certain letters of two scripts is replaced only by a word of the corpus."""
    token = "ж" + "bbb" + "а"  # Cyrillic zhe, Latin b, Cyrillic a
    rows = [(1, token + " end"), (2, "ж" + "bbb" + "a end")]
    out = {r.id: r.canonical for r in lookalike.one_form(spark.createDataFrame(rows, "id bigint, text string"), "id", "text").collect()}
    assert out[1] == out[2] == "ж" + "bbb" + "a end"


@pytest.mark.parametrize("text,empty", [(None, True), ("", True), (" \n", True), ("<think>\n</think>\n<|im_end|>", True), ("N/A", True), ("...", True), ("7", False), ("<think>a</think>", False), ("none of them", False)])
def test_says_nothing(text, empty):
    assert says_nothing(text) is empty


def test_truncation(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/generation_health_2048_records.parquet")
    odd = spark.createDataFrame([(1, None, None, None), (2, "", "", 5), (3, "Thus, the answer is $\\boxed{86", "q", 2048), (4, "<think>\nWe see that. So it", None, None), (5, "The sum is 12. The final answer is \\boxed{12}.", "q", 2048), (5, "= 12", "q", None)], "record_id bigint, output string, prompt string, generated_tokens int")
    both = d.select(*odd.columns).unionByName(odd)
    found = {r.id for r in truncation.scores(both).where("truncated and id < 10").collect()}
    assert found == {3, 4}
    assert truncation.scores(odd.limit(0)).count() == 0


def test_truncation_finds_held_out_cuts(spark):
    """Cuts of texts the model never saw."""
    import pandas as pd

    from millrace.llm.ending import clearly_cut, cut

    d = pd.read_parquet("/root/testdata/sf0.1/generation_health_2048_records.parquet")
    rows = list(zip(d.output, d.prompt, d.generated_tokens))
    model = truncation.train(spark, rows[:3000])
    rng = random.Random(1)
    whole = [t for t, _, _ in rows[3000:5000] if t and not clearly_cut(t) and t.rstrip().endswith((".", "}", "$", "。"))]
    cuts = [c for t in whole if (c := cut(t, rng))]
    flag = lambda ts: (model.scores([truncation.features(t, 100) for t in ts])[:, 0] > model.thresholds[0]).mean()
    assert flag(cuts) > 0.95 and flag(whole) < 0.03


def test_pair_defects(spark):
    q = "On Monday the baker counts 12 plates, which is 3 more than the miller counted. How many plates does the miller have in the end?"
    good = "We subtract 3 from 12 and keep the rest in mind. The final answer is \\boxed{9}."
    rows = [
        ("t", 1, q, None), ("t", 2, q, "<think>\n</think>"), ("t", 3, q, q), ("t", 4, q, "I'm sorry, but I cannot answer this question."), ("t", 5, q, "Wir beginnen mit den 12 Tellern und ziehen dann 3 davon ab. Die endgültige Antwort ist \\boxed{9}."),
        ("t", 6, q, "We subtract 3 from 12 and keep the rest in m"), ("t", 7, q, good), ("t", 8, q + " Answer this one in German.", "Wir beginnen mit den 12 Tellern und ziehen dann 3 davon ab. Die endgültige Antwort ist \\boxed{9}."),
        ("t", 9, None, good), ("t", 10, "", "9"), ("t", 11, q, LONG + good),
    ]
    odd = spark.createDataFrame(rows, "table_name string, row_id bigint, question string, answer string")
    r = spark.read.parquet("/root/testdata/sf0.01/review_samples.parquet")
    pairs = pairdefects.pair_rows([("r", r, "review_index", "problem", "generation")]).unionByName(odd)
    found = {x.row_id: x.defect for x in pairdefects.defects(pairs).where("table_name = 't'").collect()}
    assert found == {1: "empty", 2: "empty", 3: "copy", 4: "refusal", 5: "other_language", 6: "truncated"}
    assert pairdefects.defects(odd.limit(0)).count() == 0


def test_linear_learns_and_is_deterministic():
    rows = [linear.hashed([f"x{i % 2}", f"n{i}"]) for i in range(200)]
    truth = np.array([[i % 2] for i in range(200)], float)
    a, b = linear.train(["y"], linear.Rows.of(rows), truth), linear.train(["y"], linear.Rows.of(rows), truth)
    assert (a.weights == b.weights).all() and ((a.scores(rows)[:, 0] > 0.5) == truth[:, 0]).all()
