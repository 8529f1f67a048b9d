"""Tables of a stream: read and measured once per version, and never from an old one."""

import datetime as dt

import pytest

from stmtwatch.schemas import ENDPOINT, POLICY
from stmtwatch.sources import sinks, storage, tables
from stmtwatch.sources.tables import as_query_log
from stmtwatch.streaming import scoring, snapshots
from stmtwatch.streaming.scoring import Tables, score_batch

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def paths(spark, tmp_path):
    where = Tables(**{name: f"{tmp_path}/{name}" for name in ("policies", "endpoints", "allowlist", "alerts", "alert_groups", "commits")})
    sinks.write_policy(spark.createDataFrame([(1, 1, "shop", 0, 0, 0, "user_db", START)], POLICY), where.policies)
    spark.createDataFrame([(1, "a", "mysql", 1)], ENDPOINT).write.parquet(where.endpoints)
    return where


def _batch(spark, n, text="drop table a"):
    rows = [(n, START + dt.timedelta(seconds=n), "c1", 1, "mysql", "shop", "ann", "query", text)]
    return as_query_log(spark.createDataFrame(
        rows, "seq long, event_time timestamp, conn_id string, proxy_id int, db_type string, db_name string, "
        "db_user string, command string, query string",
    ))


@pytest.fixture
def seen(monkeypatch):
    """Which tables were read, and how many sizes measured."""
    calls = []
    for name in ("read_policies", "read_endpoints", "read_allowlist"):
        known = getattr(scoring, name)
        monkeypatch.setattr(scoring, name, lambda *a, known=known, name=name: calls.append(name) or known(*a))
    measured = snapshots.measured_bytes
    monkeypatch.setattr(snapshots, "measured_bytes", lambda df: calls.append("measured") or measured(df))
    return calls


def test_unchanged_tables_are_not_read_again(spark, rules, paths, seen):
    listed = spark.createDataFrame([(1, "shop", "select ?")], "proxy_id int, db_name string, query string")
    sinks.upsert_allowlist(listed, paths.allowlist)
    run = score_batch(rules, paths)
    run(_batch(spark, 0), 0)
    assert sorted(set(seen)) == ["measured", "read_allowlist", "read_endpoints", "read_policies"]
    seen.clear()
    for n in (1, 2):
        run(_batch(spark, n), n)
    assert seen == []
    assert tables.read_alerts(spark, paths.alerts, paths.commits).count() == 3


def test_a_new_version_holds_from_the_next_micro_batch_on(spark, rules, paths, seen):
    run = score_batch(rules, paths)
    run(_batch(spark, 0), 0)
    seen.clear()
    # Another mode: all that is new is blocked.
    sinks.write_policy(spark.createDataFrame([(1, 1, "shop", 0, 0, 4, "user_db", START)], POLICY), paths.policies)
    run(_batch(spark, 1, "select 1"), 1)
    assert "read_policies" in seen and "read_endpoints" not in seen
    assert [r.block for r in tables.read_alerts(spark, paths.alerts, paths.commits).orderBy("event_time").collect()][1:] == [1]
    # What another job lists is known to the next micro-batch.
    listed = spark.createDataFrame([(1, "shop", "select ?")], "proxy_id int, db_name string, query string")
    sinks.upsert_allowlist(listed, paths.allowlist, storage.new_part())
    run(_batch(spark, 2, "select 2"), 2)
    assert tables.read_alerts(spark, paths.alerts, paths.commits).count() == 2


def test_contents_tell_versions_apart(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert storage.contents(spark, path) == ()
    storage.write_part(spark.range(3), path, "a")
    first = storage.contents(spark, path)
    assert first and storage.contents(spark, path) == first
    storage.write_part(spark.range(3), path, "a")
    assert storage.contents(spark, path) != first
    assert snapshots.parts_version(spark, path, "a", None) == ()
    own = snapshots.parts_version(spark, path, "b", None)
    storage.write_part(spark.range(1), path, "b")
    assert snapshots.parts_version(spark, path, "b", None) == own != snapshots.parts_version(spark, path, "c", None)
