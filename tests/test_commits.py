"""What counts of a table: commits of micro-batches, compaction beside readers, repeats with less."""

import datetime as dt

import pytest

from stmtwatch.schemas import ENDPOINT, POLICY
from stmtwatch.sources import sinks, storage, tables
from stmtwatch.sources.tables import as_query_log
from stmtwatch.streaming import scoring
from stmtwatch.streaming.scoring import Tables, score_batch

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def paths(spark, tmp_path):
    names = ("policies", "endpoints", "allowlist", "alerts", "alert_groups", "commits")
    where = Tables(**{name: f"{tmp_path}/{name}" for name in names})
    policies = [(1, 1, "lab", 0, 0, 10, "user_db", START), (2, 1, "shop", 0, 0, 0, "user_db", START)]
    sinks.write_policy(spark.createDataFrame(policies, POLICY), where.policies)
    spark.createDataFrame([(1, "a", "mysql", 1)], ENDPOINT).write.parquet(where.endpoints)
    return where


def _batch(spark, start, *statements):
    rows = [(start + i, START + dt.timedelta(seconds=start + i), "c1", 1, "mysql", db, "ann", "query", text) for i, (db, text) in enumerate(statements)]
    return as_query_log(spark.createDataFrame(
        rows, "seq long, event_time timestamp, conn_id string, proxy_id int, db_type string, db_name string, db_user string, command string, query string"
    ))


def _state(spark, paths):
    return (
        sorted(r.query for r in tables.read_alerts(spark, paths.alerts, paths.commits).collect()),
        sorted((r.db_name, r.pattern) for r in tables.read_alert_groups(spark, paths.alert_groups, paths.commits).collect()),
        sorted(r.query for r in tables.read_allowlist(spark, paths.allowlist, commits=paths.commits).collect()),
    )


@pytest.mark.parametrize("killed_in", ["upsert_alert_groups", "upsert_allowlist", "commit"])
def test_a_killed_micro_batch_shows_nothing(spark, rules, paths, monkeypatch, killed_in):
    run = score_batch(rules, paths, stream="s")
    run(_batch(spark, 0, ("lab", "drop table a")), 0)
    before = _state(spark, paths)
    assert before == (["drop table a"], [("lab", "drop table a")], ["drop table a"])

    def killed(*args, **options):
        raise KeyboardInterrupt

    second = _batch(spark, 10, ("lab", "drop table b"), ("shop", "drop table a"))
    with monkeypatch.context() as patch:
        patch.setattr(scoring, killed_in, killed)
        with pytest.raises(KeyboardInterrupt):
            run(second, 1)
    assert _state(spark, paths) == before
    run(second, 1)
    assert _state(spark, paths) == (
        ["drop table a", "drop table a", "drop table b"],
        [("lab", "drop table a"), ("lab", "drop table b"), ("shop", "drop table a")], ["drop table a", "drop table b"],
    )


def test_compaction_beside_a_reader(spark, rules, paths):
    run = score_batch(rules, paths, stream="s")
    for number in range(3):
        run(_batch(spark, 10 * number, ("lab", f"drop table t{number} x"), ("shop", "drop table y")), number)
    before = _state(spark, paths)
    reader = tables.read_alerts(spark, paths.alerts, paths.commits)  # has listed the parts
    for name, kind in (("alerts", "alerts"), ("alert_groups", "alert_groups"), ("allowlist", "allowlist")):
        assert sinks.compact_committed(spark, getattr(paths, name), kind, paths.commits)
        assert len(storage.live_parts(spark, getattr(paths, name), paths.commits)) == 1
    assert _state(spark, paths) == before
    assert sorted(r.query for r in reader.collect()) == before[0]
    assert storage.vacuum(spark, paths.alerts) == []  # too young
    assert len(storage.vacuum(spark, paths.alerts, keep_ms=-1000)) == 3
    run(_batch(spark, 90, ("shop", "drop table z")), 3)
    assert _state(spark, paths)[0] == sorted([*before[0], "drop table z"])


def test_a_compaction_without_manifest_does_not_count(spark, rules, paths, monkeypatch):
    run = score_batch(rules, paths, stream="s")
    for number in range(2):
        run(_batch(spark, 10 * number, ("shop", f"drop table t{number}")), number)
    before = _state(spark, paths)
    storage.write_part(tables.read_alerts(spark, paths.alerts, paths.commits).drop("part"), paths.alerts, "compact-half", ("event_date",))
    assert _state(spark, paths) == before
    assert storage.vacuum(spark, paths.alerts, keep_ms=-1000) == ["compact-half"]


def test_a_repeat_with_less_to_write_leaves_nothing_old(spark, rules, paths):
    run = score_batch(rules, paths, stream="s")
    run(_batch(spark, 0, ("shop", "drop table a")), 0)
    run(_batch(spark, 0, ("shop", "select 1")), 0)
    assert _state(spark, paths) == ([], [], [])
