"""Streams over several micro-batches: late rows, expiring state, batches that do not show in the result."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.streaming import jobs

START = datetime(2026, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def state_rows(seen):
    """Rows held in state after each micro-batch."""
    return [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in seen]


def dropped(seen):
    return sum(op["numRowsDroppedByWatermark"] for p in seen for op in p["stateOperators"])


def test_dedup_ends_its_state(spark):
    schema = "ts timestamp, tenant string, checksum string, n int"
    first = [(at(0), "t", "a", 1), (at(1), "t", "a", 2), (at(2), "u", "a", 3), (at(3), "t", "b", 4)]
    second = [(at(30), "t", "a", 5), (at(400), "t", "c", 6)]  # a duplicate inside the hour; then time goes on
    third = [(at(401), "t", "a", 7), (at(5), "t", "z", 8)]  # an equal row after expiry; a late one
    seen = []
    got = jobs.drained(jobs.stream_dedup, [spark.createDataFrame(b, schema).coalesce(1) for b in (first, second, third)], seen=seen).collect()
    assert sorted(r.n for r in got) == [1, 3, 4, 6, 7]
    assert dropped(seen) == 1
    held = state_rows(seen)
    assert max(held) >= 4 and held[-1] <= 2


def test_metrics_drop_late_rows_and_end_windows(spark):
    schema = "ts timestamp, operation string, duration_ms long, failed boolean"
    batches = [[(at(1), "a", 10, False), (at(2), "a", 3000, True), (at(6), "a", 5, False)], [(at(60), "a", 7, False)], [(at(3), "a", 99, False), (at(61), "a", 9, False), (at(200), "b", 1, False)]]
    seen = []
    got = jobs.drained(jobs.stream_metrics, [spark.createDataFrame(b, schema).coalesce(1) for b in batches], ["start", "operation"], seen).collect()
    assert {((r.start - START).seconds // 60, r.operation): (r.runs, r.failures, r.total_ms, r.max_ms, r.slow) for r in got} == {
        (0, "a"): (2, 1, 3010, 3000, 1), (5, "a"): (1, 0, 5, 5, 0), (60, "a"): (2, 0, 16, 9, 0), (200 // 5 * 5, "b"): (1, 0, 1, 1, 0),
    }
    assert dropped(seen) == 1 and state_rows(seen)[-1] < max(state_rows(seen)) + 1 and state_rows(seen)[-1] <= 1


def test_alerts_end_their_state(spark):
    schema = "ts timestamp, vendor string, amount_usd long, employee_id long, item_id long"
    day = 24 * 60
    batches = [[(at(0), "v", 5, 1, 1), (at(10), "v", 5, 2, 2)], [(at(day - 1), "v", 5, 3, 3), (at(5 * day), "v", 9, 1, 4)], [(at(5 * day + 1), "v", 5, 4, 5), (at(5 * day + 2), "v", 9, 2, 6)]]
    seen = []
    frames = [spark.createDataFrame(b, schema).coalesce(1) for b in batches]
    got = {(r.item_id, r.other_id) for r in jobs.drained(lambda s: jobs.stream_cross_employee(s, s, "1 hour"), frames, seen=seen).collect()}
    assert got == {(2, 1), (3, 1), (3, 2), (6, 4)}
    assert state_rows(seen)[-1] < max(state_rows(seen))


MOVES = "claim_id long, event_id long, to_status string, ts timestamp"


def moves():
    """Claim 1 goes on and rests, claim 2 rests for long, claim 3 is one move."""
    return [
        (1, 1, "Submitted", at(0)), (1, 2, "Approved", at(1)), (1, 3, "Processing", at(2)), (2, 4, "Processing", at(3)), (2, 5, "Submitted", at(4)), (3, 6, "Submitted", at(5)),
        (1, 7, "Manager_Review", at(50)), (2, 8, "Processing", at(500)), (2, 9, "Submitted", at(501)), (1, 10, "Approved", at(505)), (3, 11, "Submitted", at(2000)),
    ]


def brute(rows, idle):
    last, out = {}, set()
    for claim, event, to, ts in sorted(rows, key=lambda r: (r[3], r[1])):
        status, before = last.get(claim, ("Draft", ts))
        status = "Draft" if ts - before > timedelta(minutes=idle) else status
        ok = to in jobs.EDGES.get(status, ())
        out.add((claim, event, status, to, ok))
        last[claim] = (to if ok else status, ts)
    return out


@pytest.mark.parametrize("cuts", [[], [3], [3, 7], [1, 2, 4, 6, 9, 10]])
def test_transitions_do_not_show_their_batches(spark, cuts):
    rows, seen = moves(), []
    frames = [spark.createDataFrame(rows[a:b], MOVES) for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    got = jobs.drained(lambda s: jobs.stream_transitions(s, "10 minutes", 60 * 60_000), frames, seen=seen).collect()
    assert {tuple(r) for r in got} == brute(rows, 60) and len(got) == len(rows)
    assert len(brute(rows, 60) - brute(rows, 10**6)) > 0  # idleness matters here
    if len(cuts) > 3:
        held = state_rows(seen)
        assert held[-1] < max(held)  # idle claims' state has gone


def test_late_moves_are_dropped(spark):
    frames = [spark.createDataFrame(x, MOVES) for x in ([(1, 1, "Submitted", at(0)), (2, 2, "Submitted", at(300))], [(2, 3, "Processing", at(301))], [(1, 4, "Processing", at(5)), (2, 5, "Manager_Review", at(302))])]
    seen = []
    got = {r.event_id for r in jobs.drained(lambda s: jobs.stream_transitions(s, "10 minutes"), frames, seen=seen).collect()}
    assert got == {1, 2, 3, 5} and dropped(seen) == 1


def test_totals_replace_earlier_ones(spark):
    frames = [spark.createDataFrame(x, "claim_id long, amount_usd long") for x in ([(1, 5), (2, 1)], [(1, 7)], [(3, 2)])]
    got = jobs.drained(jobs.stream_totals, frames, ["claim_id"]).collect()
    assert {(r.claim_id, float(r.total_usd), r.item_count) for r in got} == {(1, 12.0, 2), (2, 1.0, 1), (3, 2.0, 1)}


def test_by_time_keeps_all_rows(spark):
    rows = [(at(k % 17), k) for k in range(100)] + [(None, 100)]
    parts = jobs.by_time(spark.createDataFrame(rows, "ts timestamp, k long"), 4)
    held = [[r.k for r in p.collect()] for p in parts]
    assert sorted(k for p in held for k in p) == list(range(101)) and 100 in held[-1] and all(held)
    edges = [p.agg(F.min("ts"), F.max("ts")).first() for p in parts]
    assert all(a[1] < b[0] for a, b in zip(edges, edges[1:]))


def test_alerts_have_a_row_for_an_item(spark):
    """The earliest partner and their number against brute force, over batches with late rows; copies of one receipt do not multiply rows."""
    rng = np.random.default_rng(2)
    rows = [(START + timedelta(minutes=int(rng.integers(5 * 24 * 60))), "v" if k % 3 else "w", k % 2, int(rng.integers(4)), k) for k in range(300)]
    rows += [(START + timedelta(days=2), "v", 9, k % 7, 1000 + k) for k in range(200)]  # of one time
    rows.sort()
    late = rows[100:120]  # less than the delay of a day late
    batches = [rows[:100] + rows[120:150], late + rows[150:400], rows[400:] + [(None, "v", 1, 1, 5000), (rows[-1][0], "v", 1, None, 5001)]]
    want = {}
    for a in rows:
        met = [b for b in rows if b[1:3] == a[1:3] and b[3] != a[3] and a[0] - timedelta(days=1) <= b[0] <= a[0]]
        if met:
            want[a[4]] = (min(met, key=lambda b: (b[0], b[4]))[4], len(met))
    schema, seen = "ts timestamp, vendor string, amount_usd long, employee_id long, item_id long", []
    frames = [spark.createDataFrame(b, schema).coalesce(2) for b in batches]
    got = jobs.drained(lambda s: jobs.stream_alerts(s, "2 days"), frames, ["item_id"], seen).collect()
    assert {r.item_id: (r.first_id, r.links) for r in got} == want and len(got) == len(want) > 400
    assert dropped(seen) == 0
