"""Session context against a plain loop, and shaping of commands."""

import random

import pytest
from pyspark.sql import functions as F

from stmtwatch.operators.session import command_to_sql, inspectable, session_state, with_session_context

COLUMNS = "seq long, conn_id string, command string, db_user string, db_name string, ok boolean"


def _log(count=3000, connections=6):
    rng = random.Random(5)
    rows = []
    for seq in range(count):
        conn = "hot" if rng.random() < 0.5 else f"c{rng.randrange(connections)}"
        command = rng.choices(["query", "login", "use_db", "change_user", "quit"], [80, 4, 8, 4, 4])[0]
        db = rng.choice(["a", "b", None])
        rows.append((seq, conn, command, f"u{rng.randrange(5)}", db, rng.choice([True, False, None])))
    return rows


def _walk(rows):
    state, out = {}, {}
    for seq, conn, command, user, db, ok in rows:
        now = state.get(conn, ("", ""))
        if command in ("login", "change_user"):
            now = (user, db or "")
        elif command == "quit":
            now = ("", "")
        elif command == "use_db" and ok is not False:
            now = (now[0], db or "")
        state[conn] = now
        out[seq] = now
    return out, state


@pytest.mark.parametrize("block", [1, 7, 500, 10**6])
def test_context_equals_a_loop(spark, block):
    rows = _log()
    want, _ = _walk(rows)
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), COLUMNS)
    got = {r.seq: (r.db_user, r.db_name) for r in with_session_context(df, block=block).collect()}
    assert got == want


@pytest.mark.parametrize("cut", [1, 500, 1000, 2999])
def test_context_over_two_logs(spark, cut):
    rows = _log()
    want, _ = _walk(rows)
    first = spark.createDataFrame(rows[:cut], COLUMNS)
    second = spark.createDataFrame(rows[cut:], COLUMNS)
    shaped = with_session_context(second, session_state(first), block=300)
    got = {r.seq: (r.db_user, r.db_name) for r in shaped.collect()}
    assert got == {seq: value for seq, value in want.items() if seq in got} and len(got) == len(rows) - cut


def test_quit_ends_a_session(spark):
    rows = [(1, "a", "login", "u", "d", None), (2, "b", "login", "v", "e", None), (3, "a", "quit", None, None, None)]
    log = spark.createDataFrame(rows + [(4, "a", "query", None, None, None)], COLUMNS)
    state = session_state(log).collect()
    assert [(r.conn_id, r.carried_user, r.carried_db) for r in state] == [("b", "v", "e")]
    shaped = {r.seq: (r.db_user, r.db_name) for r in with_session_context(log).collect()}
    assert shaped == {1: ("u", "d"), 2: ("v", "e"), 3: ("", ""), 4: ("", "")}


def test_rows_without_place_are_no_session(spark):
    rows = [
        (None, "a", "login", "u", "d", None), (None, "a", "query", "x", "y", None), (1, None, "login", "v", "e", None),
        (2, None, "query", "x", "y", None), (3, "a", "query", "x", "y", None),
    ]
    log = spark.createDataFrame(rows, COLUMNS)
    shaped = sorted((r.seq or 0, r.conn_id or "", r.command, r.db_user) for r in with_session_context(log).collect())
    assert shaped == [(0, "a", "login", "u"), (0, "a", "query", ""), (1, "", "login", "v"), (2, "", "query", ""), (3, "a", "query", "")]
    assert session_state(log).count() == 0


def test_silent_sessions_are_forgotten(spark):
    rows = [(1, "a", "login", "u", "d", None, 0), (2, "b", "login", "v", "e", None, 6000), (3, "b", "query", None, None, None, 9000)]
    log = spark.createDataFrame(rows, COLUMNS + ", at long").withColumn("event_time", F.timestamp_seconds("at"))
    assert {r.conn_id for r in session_state(log, idle="1 hour").collect()} == {"b"}
    assert {r.conn_id for r in session_state(log, idle="3 hours").collect()} == {"a", "b"}


def test_commands(spark):
    rows = [
        ("mysql", "create_db", "x", "create database 'x'"), ("mysql", "drop_db", "x", "drop database 'x'"),
        ("mysql", "field_list", "x", "show fields from 'x'"), ("mysql", "process_info", "", "show processlist"),
        ("mysql", "process_info", None, "show processlist"), ("mysql", "query", "select 1", "select 1"),
        ("mysql", "prepare", "select ?", "select ?"), ("pgsql", "parse", "select 1", "select 1"),
        ("mysql", "create_db", "", None), ("mysql", "query", "", None), ("mysql", "ping", "x", None),
        ("mysql", "kill", "5", None), ("pgsql", "create_db", "x", None), ("pgsql", "prepare", "x", None),
        ("mysql", "parse", "x", None), ("pgsql", "bind", "x", None), ("mysql", "execute", "x", None),
        ("other", "query", "x", None),
    ]
    df = spark.createDataFrame(rows, "db_type string, command string, query string, want string")
    kept = inspectable(command_to_sql(df)).collect()
    assert all(r.query == r.want for r in kept)
    assert len(kept) == sum(want is not None for *_, want in rows)
