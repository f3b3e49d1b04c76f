from datetime import datetime

from metaloom.operators.snapshots import snapshot_changes, snapshot_states

SCHEMA = "snapshot_no int, snapshot_at timestamp, delivery_no int, loaded_at timestamp, asset_id string, storage_path string, schema_hash string, change_kind string, n int"


def row(no, asset, path="p", h="h", delivery=1, at=1):
    return (no, None, delivery, None if at is None else datetime(2025, 1, at), asset, path, h, "extra", 7)


def changes(spark, rows):
    return sorted(map(tuple, snapshot_changes(spark.createDataFrame(rows, SCHEMA)).collect()))


def test_kinds(spark):
    rows = [row(1, "a"), row(1, "b"), row(1, "c"), row(2, " A "), row(2, "b", "P/"), row(2, "d"), row(3, "a", h="x"), row(3, "c"), row(3, "d")]
    assert changes(spark, rows) == [(2, "c", "removed"), (2, "d", "added"), (3, "a", "changed"), (3, "b", "removed"), (3, "c", "added")]


def test_spelling_nulls_and_blanks(spark):
    rows = [row(1, "a", "/X/", None), row(2, "a", "x", "  "), row(1, None), row(2, "  "), row(None, "q")]
    assert changes(spark, rows) == []


def test_last_delivery_and_latest_row(spark):
    rows = [row(1, "a", delivery=1), row(1, "b", delivery=2), row(2, "b", "old", at=1), row(2, "b", "p", at=2), row(2, "b", "p", at=2), row(2, "b", "zz", at=None)]
    assert changes(spark, rows) == []
    assert snapshot_states(spark.createDataFrame(rows, SCHEMA)).count() == 2


def test_no_predecessor(spark):
    assert changes(spark, [row(1, "a"), row(3, "b"), row(4, "b"), row(4, "c")]) == [(4, "c", "added")]


def test_predecessor_without_ids(spark):
    assert changes(spark, [row(1, None), row(2, "b")]) == [(2, "b", "added")]


def test_empty(spark):
    assert changes(spark, []) == []
