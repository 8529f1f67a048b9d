"""Sessions of a live log by keyed state: rows are put back in order, met once, and given their
session; timers end what is silent.

The state of a connection is its session (user, database, last time), the rows that wait for earlier
ones, and the sequence numbers released lately. Rows wait until the stream's time, the watermark, is
past theirs, and are then released in the order of `seq`. Nothing is rewritten but the connections of
a micro-batch.

- A row that is delivered again within the delay is dropped.
- A row that comes after its successors were released is not lost: it is given the session as it
  stands, and changes nothing.
- A connection silent for longer than `idle` has its session ended before its next row, measured
  between neighbours in `seq` order. A timer frees its state when the stream's time is past that.
- A clock more than an hour ahead of this machine's does not move the stream's time.
- Rows without connection or sequence number have no place in a session; they pass at once.

The rows of one connection are worked on in order by one task, a micro-batch at a time. For a log in
which one connection has a large share of all rows `scoring.session_stream` splits it over many tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stmtwatch.operators.session import sane_time, session_events

# Executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The state store that keyed state with timers needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Pieces that rows without a place are dealt into.
PIECES = 1024
_WAITING = "seq long, at long, until long, user string, db string, payload string"
_OUT = "seq long, db_user string, db_name string, payload string"
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _frame(rows: list[tuple]) -> pd.DataFrame:
    seq, user, db, payload = zip(*rows)
    return pd.DataFrame({
        "seq": pd.array(seq, dtype="Int64"), "db_user": list(user), "db_name": list(db), "payload": list(payload),
    })


def _rows(frames: Iterator[pd.DataFrame]) -> list[tuple]:
    """(seq, at, user, db, payload), with None for null."""
    found = []
    for frame in frames:
        columns = [frame[c].astype(object).where(frame[c].notna(), None) for c in ("seq", "at", "user", "db", "payload")]
        found += list(zip(*columns))
    return found


class Sessions(StatefulProcessor):
    """Times are milliseconds; -1 stands for none."""

    def __init__(self, delay: int, idle: int | None):
        self.delay, self.idle = delay, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # `due` is when the one timer of the connection fires.
        self.session = handle.getValueState("session", "user string, db string, last long, released long, seen long, due long")
        self.waiting = handle.getListState("waiting", _WAITING)
        self.recent = handle.getListState("recent", "seq long, at long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _rows(rows)
        if key[0].startswith("n"):
            yield _frame([(seq, user or "", db or "", payload) for seq, _, user, db, payload in new])
        else:
            yield from self._release(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release([], timerValues.getCurrentWatermarkInMs())

    def _release(self, new: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        user, db, last, released, seen, due = self.session.get() or ("", "", -1, -1, -1, -1)
        waiting = {row[0]: tuple(row) for row in self.waiting.get()}
        recent = {seq: at for seq, at in self.recent.get()}
        out = []
        for seq, at, set_user, set_db, payload in new:
            seq, at = int(seq), int(at)
            seen = max(seen, watermark)
            if seq in waiting or seq in recent:
                continue
            if seq < released:  # its successors are gone already
                out.append((seq, user if set_user is None else set_user, db if set_db is None else set_db, payload))
                recent[seq] = watermark
            else:
                # Without a sane clock a row counts as of the stream's latest time.
                waiting[seq] = (seq, at, at if at >= 0 else watermark + self.delay, set_user, set_db, payload)
        ready = max((seq for seq, row in waiting.items() if row[2] <= watermark), default=-1)
        for seq in sorted(s for s in waiting if s <= ready):
            _, at, _, set_user, set_db, payload = waiting.pop(seq)
            if self.idle is not None and at >= 0 and last >= 0 and at - last > self.idle:
                user, db = "", ""
            user = user if set_user is None else set_user
            db = db if set_db is None else set_db
            last = at if at >= 0 else last
            released, recent[seq] = seq, watermark
            out.append((seq, user, db, payload))
        recent = {seq: at for seq, at in recent.items() if at + 2 * self.delay >= watermark}

        if due >= 0:
            self.handle.deleteTimer(due)
        silent = max(last, seen) + max(self.idle or 0, 2 * self.delay) + 1
        lasting = self.idle is None and (user or db)
        if not waiting and not lasting and silent <= watermark:
            for state in (self.session, self.waiting, self.recent):
                state.clear()
        else:
            due = -1 if lasting and not waiting else max(min((r[2] for r in waiting.values()), default=silent), watermark + 1)
            if due >= 0:
                self.handle.registerTimer(due)
            self.session.update((user, db, last, released, seen, due))
            for state, values in ((self.waiting, list(waiting.values())), (self.recent, list(recent.items()))):
                state.put(values) if values else state.clear()
        if out:
            yield _frame(out)


def _milliseconds(spark: SparkSession, interval: str) -> int:
    return spark.sql(f"select unix_millis(timestamp_seconds(0) + interval {interval}) as ms").first().ms


def shaped_stream(log: DataFrame, delay: str = "1 minute", idle: str | None = "8 hours") -> DataFrame:
    """A log stream with the user and database of each row's session, every row once and, within a
    connection, in the order of `seq`. Rows wait for `delay` of the stream's time.

    The same as `with_session_context(log, idle=idle)` for rows that come within the delay.
    """
    spark = log.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    placed = F.col("conn_id").isNotNull() & F.col("seq").isNotNull()
    kept = [f for f in log.schema.fields if f.name not in ("seq", "db_user", "db_name")]
    spread = F.concat(F.lit("n"), F.pmod(F.xxhash64(*log.columns), F.lit(PIECES)).cast("string"))
    # The watermark's own column goes: Spark would drop late rows by it.
    keyed = session_events(log).withColumn("_clock", sane_time()).withWatermark("_clock", delay).select(
        F.when(placed, F.concat(F.lit("c"), "conn_id")).otherwise(spread).alias("key"), "seq",
        F.coalesce(F.unix_millis("_clock"), F.lit(-1).cast("long")).alias("at"), F.col("_user").alias("user"),
        F.col("_db").alias("db"), F.to_json(F.struct(*[f.name for f in kept]), _EXACT).alias("payload"),
    )
    shaped = keyed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Sessions(_milliseconds(spark, delay), None if idle is None else _milliseconds(spark, idle)),
        outputStructType=_OUT, outputMode="append", timeMode="EventTime",
    )
    back = F.from_json("payload", T.StructType(kept), _EXACT).alias("rest")
    return shaped.select("seq", "db_user", "db_name", back).select("seq", "db_user", "db_name", "rest.*").select(*log.columns)
