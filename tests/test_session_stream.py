"""Keyed sessions: reordered, repeated and late rows, silences and wild clocks, against a plain loop."""

import datetime as dt
import random

import pytest

from stmtwatch.operators.session import session_state, with_session_context
from stmtwatch.sources import tables
from stmtwatch.streaming.sessions import shaped_stream

START = dt.datetime(2024, 1, 1)
COLUMNS = "seq long, event_time timestamp, conn_id string, command string, db_user string, db_name string, ok boolean, db_type string, query string"


def _log(count=400, wild=(37, 180), seed=3):
    """Rows a second apart, with silences of two hours and two rows of the year 2099."""
    rng, rows, clock = random.Random(seed), [], START
    for seq in range(count):
        clock += dt.timedelta(hours=2) if seq % 97 == 96 else dt.timedelta(seconds=1)
        command = rng.choices(["query", "login", "use_db", "quit"], [70, 10, 12, 8])[0]
        time = dt.datetime(2099, 1, 1) if seq in wild else None if seq % 50 == 3 else clock
        rows.append((seq, time, rng.choice(["hot", "hot", "c1", "c2", "c3"]), command, f"u{rng.randrange(5)}",
                     rng.choice(["a", "b", None]), rng.choice([True, False, None]), "mysql", f"q{seq}"))
    return rows


def _walk(rows, idle):
    state, out = {}, {}
    for seq, time, conn, command, user, db, ok, *_ in rows:
        now_user, now_db, last = state.get(conn, ("", "", None))
        if time is not None and time.year < 2099:
            if last is not None and time - last > idle:
                now_user, now_db = "", ""
            last = time
        if command == "login":
            now_user, now_db = user, db or ""
        elif command == "quit":
            now_user, now_db = "", ""
        elif command == "use_db" and ok is not False:
            now_db = db or ""
        state[conn] = (now_user, now_db, last)
        out[seq] = (now_user, now_db)
    return out


@pytest.mark.parametrize("block", [7, 10**6])
def test_batch_ends_silent_sessions(spark, block):
    rows = _log()
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), COLUMNS)
    got = {r.seq: (r.db_user, r.db_name) for r in with_session_context(df, block=block, idle="1 hour").collect()}
    assert got == _walk(rows, dt.timedelta(hours=1)) and got != _walk(rows, dt.timedelta(days=9))


@pytest.mark.parametrize("cut", [1, 38, 97, 200])
def test_every_cut_gives_the_same_sessions(spark, cut):
    rows = _log()
    want = _walk(rows, dt.timedelta(hours=1))
    state = session_state(spark.createDataFrame(rows[:cut], COLUMNS), idle="1 hour")
    second = with_session_context(spark.createDataFrame(rows[cut:], COLUMNS), state, block=50, idle="1 hour")
    got = {r.seq: (r.db_user, r.db_name) for r in second.collect()}
    assert got == {seq: value for seq, value in want.items() if seq >= cut}


def _stream(spark, tmp_path, batches, **options):
    """The rows that each micro-batch puts out, in order; the last micro-batch only moves the time on."""
    source = str(tmp_path / "log")
    far = (10**6, START + dt.timedelta(days=30), "closing", "query", "", "", None, "mysql", "")
    for rows in [*batches, [far]]:
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(source)
    shaped = shaped_stream(tables.stream_query_log(spark, source, max_files=1), **options)
    out = []
    query = shaped.writeStream.foreachBatch(lambda df, n: out.append(df.collect())).option(
        "checkpointLocation", str(tmp_path / "state")
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    return [[r for r in rows if r.conn_id != "closing"] for rows in out]


def test_stream_equals_the_batch(spark, tmp_path):
    """Rows shuffled within the delay and sent twice, the second time in a later micro-batch."""
    rows = _log()
    rng = random.Random(8)
    late = sorted(rows, key=lambda r: r[0] + rng.uniform(0, 20))
    batches = [late[:150] + late[:10], late[150:280] + late[100:150], late[280:] + late[270:280]]
    found = _stream(spark, tmp_path, batches, delay="1 minute", idle="1 hour")
    got = [(r.seq, (r.db_user, r.db_name)) for rows in found for r in rows]
    assert len(got) == len(rows) and dict(got) == _walk(rows, dt.timedelta(hours=1))
    for conn in ("hot", "c1", "c2", "c3"):
        order = [r.seq for rows in found for r in sorted(rows, key=lambda r: r.seq) if r.conn_id == conn]
        assert order == sorted(order)
    kept = {r.seq: (r.event_time, r.query, r.command, r.ok) for rows in found for r in rows}
    assert kept == {r[0]: (r[1], r[8], r[3], r[6]) for r in rows}


def test_late_rows_are_not_lost(spark, tmp_path):
    rows = [(i, START + dt.timedelta(minutes=10 * i), "c", "login" if i == 0 else "query", "u", "d", None, "mysql", "") for i in range(6)]
    odd = [(None, START, "c", "query", "x", "y", None, "mysql", "p"), (9, START, None, "login", "v", "w", None, "mysql", "p")]
    found = _stream(spark, tmp_path, [rows[:2] + rows[3:5], rows[5:] + odd, rows[2:3] + rows[2:3]], delay="1 minute", idle=None)
    got = sorted((r.seq or 0, r.conn_id or "", r.db_user) for rows in found for r in rows)
    assert got == [(0, "c", ""), (0, "c", "u"), (1, "c", "u"), (2, "c", "u"), (3, "c", "u"), (4, "c", "u"), (5, "c", "u"), (9, "", "v")]


def test_repeats_are_met_once(spark, tmp_path):
    rows, source = _log(60, wild=(5,)), str(tmp_path / "log")
    for batch in (rows[:40], rows[20:] + rows[:20]):
        spark.createDataFrame(batch, COLUMNS).coalesce(1).write.mode("append").parquet(source)
    once = tables.without_repeats(tables.stream_query_log(spark, source, max_files=1), "1 hour")
    seen = []
    once.writeStream.foreachBatch(lambda df, n: seen.extend(r.seq for r in df.collect())).option(
        "checkpointLocation", str(tmp_path / "state")
    ).trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == list(range(60))


def test_malformed_messages(spark):
    good = '{"seq": 5, "conn_id": "c", "db_type": "mysql", "query": "select 1"}'
    sent = spark.createDataFrame([(good,), ('{"seq": 6, "conn',), ("",), (None,), ('{"seq": "x"}',), ("[1]",)], "value string")
    with pytest.raises(Exception, match="malformed message"):
        tables.query_log_from_json(sent).collect()
    assert [r.seq for r in tables.query_log_from_json(sent, malformed="aside").collect()] == [5]
    assert tables.rejected_messages(sent).count() == 5
