"""All pairs of equal receipts within a day, over batches and late rows."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from quillet.plans import registry
from quillet.streaming import jobs

START = datetime(2026, 1, 1)
SCHEMA = "ts timestamp, vendor string, amount_usd long, employee_id long, item_id long"


def test_every_pair_is_told_once(spark, monkeypatch):
    """alerts told an item's first partner only; late receipts meet those before and after them."""
    monkeypatch.setattr(jobs, "_PAIRS", 50)
    rng = np.random.default_rng(2)
    rows = [(START + timedelta(minutes=int(rng.integers(5 * 24 * 60))), "v" if k % 3 else "w", k % 2, int(rng.integers(4)), k) for k in range(300)]
    rows += [(START + timedelta(days=2), "v", 9, k % 7, 1000 + k) for k in range(100)]  # of one time
    rows.sort()
    late = rows[100:120]  # less than the delay of two days late
    batches = [rows[:100] + rows[120:150], late + rows[150:300], rows[300:] + [(None, "v", 1, 1, 5000), (rows[-1][0], "v", 1, None, 5001)]]
    want = sorted((a[4], b[4]) for a in rows for b in rows if b[1:3] == a[1:3] and b[3] != a[3] and a[0] - timedelta(days=1) <= b[0] <= a[0])
    seen: list[dict] = []
    frames = [spark.createDataFrame(b, SCHEMA).coalesce(2) for b in batches]
    got = jobs.drained(lambda s: jobs.stream_alert_pairs(s, "2 days"), frames, seen=seen).collect()
    assert sorted((r.item_id, r.other_id) for r in got) == want and len(want) > 5000
    assert sum(o["numRowsDroppedByWatermark"] for p in seen for o in p["stateOperators"]) == 0


def test_alerts_query_lists_pairs(spark):
    """a row for each pair, not for each event."""
    found = registry.queries()["str_05_alerts"](spark, "/root/testdata/sf0.01")
    assert set(found.columns) == {"item_id", "other_id"}
    assert found.groupBy("item_id").count().filter(F.col("count") > 1).count() > 0 and found.count() == found.distinct().count()
