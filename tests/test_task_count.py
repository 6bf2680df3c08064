"""Large tables are dealt to more tasks, with the same rows."""

from quillet.plans import registry
from quillet.sources import tables

FOLDER = "/root/testdata/sf0.001"


def test_tasks_grow_with_the_tables(spark, monkeypatch):
    queries = (registry.lif_02_hold_reasons, registry.lif_03_claims_audit, registry.dup_16_same_file_hash)
    plain = [sorted(map(str, q(spark, FOLDER).collect())) for q in queries]
    assert tables.task_count(spark, FOLDER) is None
    monkeypatch.setattr(tables, "TASK_LINES", 1000)
    n = tables.task_count(spark, FOLDER)
    assert n == -(-tables.load(spark, FOLDER, "lineitem").count() // 1000) > 4
    assert tables.expense_items(spark, FOLDER).rdd.getNumPartitions() == n
    assert [sorted(map(str, q(spark, FOLDER).collect())) for q in queries] == plain
