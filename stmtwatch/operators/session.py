"""Shaping of raw log rows into statements to inspect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The commands whose text is inspected, by dialect.
INSPECTED = {
    "mysql": ("query", "prepare", "create_db", "drop_db", "field_list", "process_info"),
    "pgsql": ("query", "parse"),
}
# Commands without statement text, and the statement they stand for.
_SYNTHESISED = {
    "create_db": "create database '",
    "drop_db": "drop database '",
    "field_list": "show fields from '",
}
_PROCESS_INFO = "show processlist"


def sql_text(command: Column, text: Column) -> Column:
    """The statement that a command stands for; empty when it lacks its argument."""
    text = F.coalesce(text, F.lit(""))
    result = F.when(command == "process_info", _PROCESS_INFO)
    for name, prefix in _SYNTHESISED.items():
        quoted = F.concat(F.lit(prefix), text, F.lit("'"))
        result = result.when(command == name, F.when(F.length(text) > 0, quoted).otherwise(""))
    return result.otherwise(text)


def command_to_sql(log: DataFrame) -> DataFrame:
    """Replace the text of metadata commands by the statement they stand for."""
    return log.withColumn("query", sql_text(F.col("command"), F.col("query")))


def inspectable(log: DataFrame) -> DataFrame:
    """Keep the commands that carry a statement in their dialect, without empty texts."""
    wanted = F.lit(False)
    for dialect, commands in INSPECTED.items():
        wanted = wanted | ((F.col("db_type") == dialect) & F.col("command").isin(*commands))
    return log.filter(wanted & (F.length("query") > 0))


def sane_time(time: str = "event_time") -> Column:
    """The time of a row; null if its clock is more than an hour ahead of this machine's."""
    return F.when(F.col(time) <= F.current_timestamp() + F.expr("interval 1 hour"), F.col(time))


def session_events(log: DataFrame) -> DataFrame:
    """What each row sets: `_user` and `_db`, null where it leaves the session as it is.

    A login or change_user sets both. A use_db sets the database unless it failed (`ok` false). A
    quit clears both.
    """
    sets_both = F.col("command").isin("login", "change_user")
    quits = F.col("command") == "quit"
    ok = F.coalesce(F.col("ok"), F.lit(True)) if "ok" in log.columns else F.lit(True)
    user = F.when(quits, "").when(sets_both, F.coalesce("db_user", F.lit("")))
    db = F.when(quits, "").when(
        sets_both | ((F.col("command") == "use_db") & ok), F.coalesce("db_name", F.lit(""))
    )
    return log.withColumns({"_user": user, "_db": db})


def _last_set(events: DataFrame, keys: list[str]) -> DataFrame:
    """The last user and database set per key; partial aggregates, so a busy key is no group."""
    time = [F.max("_time").alias("_seen")] if "_time" in events.columns else []
    return events.groupBy(*keys).agg(
        *time,
        F.max_by("_user", F.when(F.col("_user").isNotNull(), F.col("seq"))).alias("_last_user"),
        F.max_by("_db", F.when(F.col("_db").isNotNull(), F.col("seq"))).alias("_last_db"),
    )


def _ended_by_silence(events: DataFrame, placed: Column, carried: DataFrame | None, idle: str) -> DataFrame:
    """`events` in which the first row of a connection after a silence longer than `idle` clears what
    it does not set. Silence is measured between neighbours in `seq` order, per connection, so that
    one connection's clock does not touch another's. Rows without a sane time are passed over."""
    events = events.withColumn("_at", sane_time())
    timed = events.filter(placed & F.col("_at").isNotNull())
    last = timed.groupBy("conn_id", "_block").agg(F.max_by("_at", "seq").alias("_last_time"))
    blocks = events.filter(placed).select("conn_id", "_block").distinct().join(last, ["conn_id", "_block"], "left")
    earlier = W.partitionBy("conn_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("conn_id", "_block", F.last("_last_time", ignorenulls=True).over(earlier).alias("_start_time"))
    if carried is not None and "carried_time" in carried.columns:
        starts = starts.join(carried.select("conn_id", "carried_time"), "conn_id", "left").select(
            "conn_id", "_block", F.coalesce("_start_time", "carried_time").alias("_start_time")
        )
    before = W.partitionBy("conn_id", "_block").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    since = F.coalesce(F.last("_at", ignorenulls=True).over(before), F.col("_start_time"))
    silent = placed & F.coalesce(F.col("_at") > since + F.expr(f"interval {idle}"), F.lit(False))
    joined = events.join(starts.hint("merge"), ["conn_id", "_block"], "left").withColumn("_silent", silent)
    cleared = {c: F.when(F.col("_silent"), F.coalesce(c, F.lit(""))).otherwise(F.col(c)) for c in ("_user", "_db")}
    return joined.withColumns(cleared).drop("_silent", "_start_time", "_at")


def with_session_context(
    log: DataFrame, carried: DataFrame | None = None, block: int = 1_000_000, idle: str | None = None
) -> DataFrame:
    """Carry user and current database forward per connection, in `seq` order.

    A connection may hold a third of the log, so it is never sorted as one group. Rows are cut
    into blocks of `block` sequence numbers. The last value set in each block is found by a
    partial aggregate, carried over the (few) blocks of the connection, and then used as the start
    value inside the next block. The log is shuffled once, on connection and block.

    Rows without connection or sequence number have no place in a session: they have only what they
    set themselves, and are spread over blocks of their own.

    `carried(conn_id, carried_user, carried_db, carried_time)` holds the values from before the log,
    if any. With `idle` (an interval such as "8 hours") a session ends when its connection was silent
    for longer than that.
    """
    placed = F.col("conn_id").isNotNull() & F.col("seq").isNotNull()
    spread = -1 - F.pmod(F.xxhash64("conn_id", "seq", "command", "db_user", "db_name"), F.lit(1024))
    events = session_events(log).withColumn(
        "_block", F.when(placed, F.floor(F.col("seq") / block)).otherwise(spread)
    )
    if idle is not None:
        events = _ended_by_silence(events, placed, carried, idle)
    # Only the few rows that set something are sorted for the last value of a block.
    setting = events.filter(placed & (F.col("_user").isNotNull() | F.col("_db").isNotNull()))
    last = _last_set(setting, ["conn_id", "_block"])
    blocks = events.filter(placed).select("conn_id", "_block").distinct().join(last, ["conn_id", "_block"], "left")
    earlier = W.partitionBy("conn_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select(
        "conn_id",
        "_block",
        F.last("_last_user", ignorenulls=True).over(earlier).alias("_start_user"),
        F.last("_last_db", ignorenulls=True).over(earlier).alias("_start_db"),
    )
    if carried is not None:
        starts = starts.join(carried, "conn_id", "left").select(
            "conn_id",
            "_block",
            F.coalesce("_start_user", "carried_user").alias("_start_user"),
            F.coalesce("_start_db", "carried_db").alias("_start_db"),
        )
    inside = W.partitionBy("conn_id", "_block").orderBy("seq").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )

    def value(event: str, start: str) -> Column:
        known = F.coalesce(F.last(event, ignorenulls=True).over(inside), F.col(start), F.lit(""))
        return F.when(placed, known).otherwise(F.coalesce(F.col(event), F.lit("")))

    joined = events.join(starts.hint("merge"), ["conn_id", "_block"], "left")
    return (
        joined.withColumns({
            "session_user": value("_user", "_start_user"),
            "session_db": value("_db", "_start_db"),
        })
        .drop("db_user", "db_name", "_user", "_db", "_block", "_start_user", "_start_db")
        .withColumnsRenamed({"session_user": "db_user", "session_db": "db_name"})
        .select(*log.columns)
    )


def session_state(log: DataFrame, carried: DataFrame | None = None, idle: str | None = None) -> DataFrame:
    """What is carried on from a log: user, database and last time of each connection that has
    either. A connection that quit has none.

    With `idle` a connection's state is that of its last row, after the silences within the log. One
    that was silent for longer goes, counted from the last sane time in this log, so that one wild
    clock forgets nobody's session.
    """
    time = sane_time() if "event_time" in log.columns else F.lit(None).cast("timestamp")
    placed = F.col("conn_id").isNotNull() & F.col("seq").isNotNull()
    events = session_events(log).withColumn("_time", time).filter(placed)
    if idle is None:
        state = _last_set(events, ["conn_id"])
    else:
        shaped = with_session_context(log, carried, idle=idle).withColumn("_time", time).filter(placed)
        state = shaped.groupBy("conn_id").agg(
            F.max_by("_time", F.when(F.col("_time").isNotNull(), F.col("seq"))).alias("_seen"),
            F.max_by("db_user", "seq").alias("_last_user"), F.max_by("db_name", "seq").alias("_last_db"),
        )
    if carried is not None:
        before = carried if "carried_time" in carried.columns else carried.withColumn(
            "carried_time", F.lit(None).cast("timestamp")
        )
        state = state.join(before, "conn_id", "full")
        user, db = F.coalesce("_last_user", "carried_user"), F.coalesce("_last_db", "carried_db")
        seen = F.coalesce("_seen", "carried_time")
    else:
        user, db, seen = F.col("_last_user"), F.col("_last_db"), F.col("_seen")
    state = state.select(
        "conn_id", user.alias("carried_user"), db.alias("carried_db"), seen.alias("carried_time")
    ).filter((F.coalesce("carried_user", F.lit("")) != "") | (F.coalesce("carried_db", F.lit("")) != ""))
    if idle is not None:
        now = events.agg(F.max("_time").alias("now")).first().now  # one row
        if now is not None:
            still = F.col("carried_time") >= F.lit(now) - F.expr(f"interval {idle}")
            state = state.filter(F.coalesce(still, F.lit(True)))
    return state
