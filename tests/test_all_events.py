"""Guards and telemetry over all event types."""

import datetime
from statistics import median

import __spark_entry__ as entry


def test_all_event_types_count(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(100):
        value = 9.0 if i in (60, 62, 64) or i == 97 else 1.0 + i % 4 / 10
        rows.append((i, at + datetime.timedelta(minutes=i // 2), 1, "ab"[i % 2], value))
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    past, want = {"a": [], "b": []}, {}
    streak = {"a": 0, "b": 0}
    for i, _, _, kind, value in rows:
        m = median(past[kind][-20:]) if len(past[kind]) >= 20 else None
        hit = m is not None and value > 1.5 * m
        streak[kind] = streak[kind] + 1 if hit else 0
        want[i] = (m if m is None else round(m, 6), hit, streak[kind])
        past[kind].append(value)
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    assert {r.event_id: r.median for r in run("rolling_median_guard_all")} == {i: w[0] for i, w in want.items()}
    assert {r.event_id: (r.hit, r.streak) for r in run("spike_streak_all")} == {i: w[1:] for i, w in want.items()}
    assert want[64][2] == 3 and want[97][1]
    assert [tuple(r) for r in run("telemetry_summary_all")] == [("a", 9.0, rows[-1][4])]
