import pytest
from pyspark.sql import functions as F

from tripscope.sources import state
from tripscope.streaming.state_feed import upsert_stream

SCHEMA = "k string, v int, at int"


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def test_put_replaces_by_key_and_keeps_the_rest(spark, tmp_path):
    path = str(tmp_path / "s")
    assert state.current(spark, path) is None
    state.upsert(rows(spark, ("a", 1, 1), ("b", 1, 1)), path, "k")
    state.upsert(rows(spark, ("b", 2, 2), ("c", None, 2)), path, "k")
    assert state.upsert(rows(spark), path, "k") == []
    assert {tuple(r) for r in state.current(spark, path).collect()} == {("a", 1, 1), ("b", 2, 2), ("c", None, 2)}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = tmp_path / "s"
    state.upsert(rows(spark, *[(f"k{i}", i, 1) for i in range(300)]), str(path), "k")
    before = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    touched = state.upsert(rows(spark, ("k7", 70, 2), ("k8", 80, 2)), str(path), "k")
    after = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    assert 1 <= len(touched) <= 2
    names = {f"key_bucket={b}" for b in touched}
    assert {f.parent.name for f in set(before) - set(after)} == names == {f.parent.name for f in set(after) - set(before)}
    assert all(after[f] == t for f, t in before.items() if f in after)
    got = {r.k: r.v for r in state.current(spark, str(path)).collect()}
    assert got == {f"k{i}": {7: 70, 8: 80}.get(i, i) for i in range(300)}


def test_late_rows_lose_and_a_repeated_put_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    state.upsert(rows(spark, ("a", 1, 5), ("b", 1, None)), path, "k", "at")
    for _ in range(2):
        state.upsert(rows(spark, ("a", 2, 4), ("b", 2, 1), ("b", 3, 2)), path, "k", "at")
    assert {tuple(r) for r in state.current(spark, path).collect()} == {("a", 1, 5), ("b", 3, 2)}


def test_audit_is_append_only(spark, tmp_path):
    path = str(tmp_path / "audit")
    e = lambda *d: spark.createDataFrame([(i, r, "scan", f"2026-06-0{i}", "x") for i, r in d], state.AUDIT_SCHEMA)
    state.append_audit(e((1, "r1"), (2, "r2")), path)
    state.append_audit(e((3, "r1"), (4, "r2")), path)
    assert {r.seq for r in state.audit_for_run(spark, path, "r1").collect()} == {1, 3}
    assert [r.seq for r in state.audit_tail(spark, path, 2).collect()] == [4, 3]


def test_stream_upsert_keeps_the_newest_row(spark, tmp_path):
    src = str(tmp_path / "in")
    path = str(tmp_path / "s")
    # The last batch is late: what it says is older than what is stored.
    for batch in ([("a", 1, 1), ("a", 2, 2), ("b", 1, 1), ("c", 7, None)], [("a", 3, 3)], [("a", 9, 2), ("b", None, None)]):
        rows(spark, *batch).coalesce(1).write.mode("append").parquet(src)
        q = upsert_stream(spark.readStream.schema(SCHEMA).parquet(src), path, "k", "at", str(tmp_path / "cp"))
        assert q.awaitTermination(120)
    assert {tuple(r) for r in state.current(spark, path).collect()} == {("a", 3, 3), ("b", 1, 1), ("c", 7, None)}
