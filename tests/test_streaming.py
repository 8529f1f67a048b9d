"""Streams: learning takes effect with the next micro-batch, and repeated ones change nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stmtwatch.sources import sinks, storage, tables
from stmtwatch.sources.tables import as_query_log, conform
from stmtwatch.schemas import ALERTS, ALLOWLIST, ENDPOINT, POLICY
from stmtwatch.streaming.scoring import Tables, score_batch

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def paths(spark, tmp_path):
    names = ("policies", "endpoints", "allowlist", "alerts", "alert_groups", "sessions")
    where = Tables(**{name: f"{tmp_path}/{name}" for name in names})
    policies = [(1, 1, "lab", 0, 0, 10, "user_db", START), (2, 1, "shop", 0, 0, 0, "user_db", START)]
    sinks.write_policy(spark.createDataFrame(policies, POLICY), where.policies)
    spark.createDataFrame([(1, "a", "mysql", 1)], ENDPOINT).write.parquet(where.endpoints)
    return where


def _batch(spark, start, *statements):
    rows = [
        (start + i, START + dt.timedelta(seconds=start + i), "c1", 1, "mysql", db, user, command, text)
        for i, (command, user, db, text) in enumerate(statements)
    ]
    return as_query_log(spark.createDataFrame(
        rows,
        "seq long, event_time timestamp, conn_id string, proxy_id int, db_type string, db_name string, "
        "db_user string, command string, query string",
    ))


def _levels(spark, paths):
    rows = tables.read_alerts(spark, paths.alerts).orderBy("event_time").collect()
    return [(r.dbuser, r.block, r.query) for r in rows]


def test_what_is_learned_holds_from_the_next_batch_on(spark, rules, paths):
    run = score_batch(rules, paths)
    first = _batch(
        spark, 0, ("login", "ann", "lab", ""), ("query", "", "", "drop table a"), ("query", "", "", "drop table a")
    )
    run(first, 0)
    drop = ("ann", 2, "drop table a")
    assert _levels(spark, paths) == [drop, drop]
    assert [r.query for r in tables.read_allowlist(spark, paths.allowlist).collect()] == ["drop table a"]

    # The connection is still ann's in lab; its statement is known by now. In shop it is not.
    second = _batch(
        spark, 10, ("query", "", "", "DROP TABLE a"), ("use_db", "", "shop", ""), ("query", "", "", "drop table a")
    )
    run(second, 1)
    assert _levels(spark, paths) == [drop, drop, ("ann", 1, "drop table a")]

    # The same again, as after a crash: nothing is doubled or lost.
    before = [tables.read_alert_groups(spark, paths.alert_groups), tables.read_allowlist(spark, paths.allowlist)]
    counts = [sorted(map(tuple, df.collect())) for df in before]
    run(second, 1)
    run(second, 1)
    assert len(_levels(spark, paths)) == 3
    after = [tables.read_alert_groups(spark, paths.alert_groups), tables.read_allowlist(spark, paths.allowlist)]
    assert [sorted(map(tuple, df.collect())) for df in after] == counts
    groups = {(r.db_name, r.pattern): r.status for r in after[0].collect()}
    assert groups == {("lab", "drop table a"): 1, ("shop", "drop table a"): 0}


def test_compaction_keeps_the_content(spark, paths):
    pattern = conform(spark.createDataFrame([(1, 1, "shop", "x")], "proxy_id int, perm int, db_name string, query string"), ALLOWLIST)
    new = pattern.select("proxy_id", "db_name", "query")
    for query in ("x", "y", "x"):
        sinks.upsert_allowlist(new.withColumn("query", F.lit(query)), paths.allowlist)
    rows = sorted(r.query for r in tables.read_allowlist(spark, paths.allowlist).collect())
    assert rows == ["x", "y"]
    sinks.compact_allowlist(spark, paths.allowlist)
    assert sorted(r.query for r in tables.read_allowlist(spark, paths.allowlist).collect()) == rows


def test_a_row_without_permission_is_neither_used_nor_added_again(spark, paths):
    stored = spark.createDataFrame([(1, 0, "shop", "x")], "proxy_id int, perm int, db_name string, query string")
    storage.write_part(conform(stored, ALLOWLIST), paths.allowlist, "job-first")
    sinks.upsert_allowlist(stored.select("proxy_id", "db_name", "query"), paths.allowlist)
    assert tables.read_allowlist(spark, paths.allowlist).count() == 0
    assert tables.stored_allowlist(spark, paths.allowlist).count() == 1


def test_alerts_have_their_schema_and_days(spark, rules, paths):
    score_batch(rules, paths)(_batch(spark, 0, ("login", "ann", "shop", ""), ("query", "", "", "drop table a")), 0)
    stored = tables.read_alerts(spark, paths.alerts)
    assert stored.columns[: len(ALERTS)] == ALERTS.fieldNames()
    assert [str(r.event_date) for r in stored.collect()] == ["2024-01-01"]


def test_messages_become_a_log(spark):
    text = '{"seq": 5, "conn_id": "c", "db_type": "mysql", "query": "select 1"}'
    log = tables.query_log_from_json(spark.createDataFrame([(text,)], "value string"))
    row = log.first()
    assert (row.seq, row.command, row.db_name, row.query) == (5, "query", "", "select 1")


def test_streams_do_not_share_parts(spark, rules, paths):
    statements = (("login", "ann", "lab", ""), ("query", "", "", "drop table a"))
    score_batch(rules, paths, stream="one")(_batch(spark, 0, *statements), 0)
    score_batch(rules, paths, stream="two")(_batch(spark, 10, ("query", "", "", "drop table b")), 0)
    # The second stream goes on with ann's session and adds to what the first one stored.
    assert _levels(spark, paths) == [("ann", 2, "drop table a"), ("ann", 2, "drop table b")]
    assert {r.query for r in tables.read_allowlist(spark, paths.allowlist).collect()} == {"drop table a", "drop table b"}


def test_a_checkpoint_names_its_stream(spark, tmp_path):
    first = storage.stream_name(spark, f"{tmp_path}/one")
    assert storage.stream_name(spark, f"{tmp_path}/one") == first != storage.stream_name(spark, f"{tmp_path}/two")


def test_many_batches_leave_few_folders(spark, rules, paths):
    run = score_batch(rules, paths)
    for number in range(6):
        run(_batch(spark, 10 * number, ("login", "ann", "lab", ""), ("query", "", "", "drop table a")), number)
    assert len(storage._folders(spark, paths.allowlist, "part=")) == 1
    assert len(storage._folders(spark, paths.alerts, "part=")) == 1
    assert len(storage._folders(spark, f"{paths.sessions}/stream=direct", "version=")) <= 2


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    class Nameless:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError):
        storage.scratch_folder(Nameless())


def test_a_table_without_its_columns_is_refused(spark):
    with pytest.raises(ValueError):
        conform(spark.range(1), POLICY, ("proxy_id",))


def test_versions_of_a_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert storage.latest_version(spark, path) is None
    assert storage.write_version(spark.range(1), path) == 1
    assert storage.write_version(spark.range(2), path) == 2
    assert storage.latest_version(spark, path) == 2
