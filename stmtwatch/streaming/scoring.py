"""Scoring of a live query log with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stmtwatch import schemas
from stmtwatch.config import RiskWeights
from stmtwatch.operators.alerts import GROUP_KEYS, alerts
from stmtwatch.operators.learning import learned
from stmtwatch.operators.policy import expire_learning
from stmtwatch.operators.session import session_state, with_session_context
from stmtwatch.plans.scoring import ScoringContext, score_log
from stmtwatch.sources.rules import CompiledRules
from stmtwatch.sources.sinks import upsert_alert_groups, upsert_allowlist, write_alerts
from stmtwatch.sources.storage import (
    commit,
    contents,
    drop_folder,
    drop_part,
    drop_versions_before,
    latest_version,
    scratch_folder,
    stream_name,
    stream_part,
    streams_of,
    write_part,
    write_version,
)
from stmtwatch.sources.tables import conform, read_allowlist, read_endpoints, read_policies
from stmtwatch.streaming.snapshots import Snapshots, parts_version

# Fixed value: how often policies and allowlist are looked at again.
REFRESH = "5 seconds"


@dataclass(frozen=True)
class Tables:
    """Where the tables live. `sessions` is only set if the log must be given its session; alerts
    are stored in folders of one `alert_period` each. Connections that are silent for longer than
    `session_idle` are forgotten."""

    policies: str
    endpoints: str
    allowlist: str
    alerts: str
    alert_groups: str
    sessions: str | None = None
    alert_period: str = "day"
    session_idle: str | None = "8 hours"
    # Where streams say which micro-batches count. Without it each part counts once it is written.
    commits: str | None = None


def score_stream(log: DataFrame, context: ScoringContext) -> DataFrame:
    """Score each statement on arrival: stateless, joined with static tables. Of a streaming log alike
    statements of an Arrow batch are scored as one."""
    return score_log(log, context)


def group_stream(alert_stream: DataFrame) -> DataFrame:
    """Alert groups kept up to date, for the update mode: each micro-batch emits the groups it
    moved on. The state is one row per group, as many as the alert_groups table has."""
    return alert_stream.groupBy(*GROUP_KEYS).agg(
        F.max("event_time").alias("update_time"), F.max("status").cast("int").alias("status")
    )


def run_groups(alert_stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Start keeping the groups table of an alert stream. Readers fold the parts."""
    stream = stream_name(alert_stream.sparkSession, checkpoint)

    def store(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if not kept.isEmpty():
                write_part(conform(kept, schemas.ALERT_GROUPS), path, stream_part(batch_id, stream))
        finally:
            kept.unpersist()

    writer = group_stream(alert_stream).writeStream.outputMode("update").foreachBatch(store)
    trigger = {"availableNow": True} if available_now else {"processingTime": REFRESH}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _carried_sessions(batch: DataFrame, path: str, batch_id: int, stream: str) -> DataFrame | None:
    """The sessions before a micro-batch: those that this stream carried on from the last one, or,
    at its first one, the newest of all other streams over these tables."""
    spark = batch.sparkSession
    own = latest_version(spark, f"{path}/stream={stream}")
    # A micro-batch that is being repeated has written its own version already.
    if own is not None and min(own, batch_id) > 0:
        return spark.read.parquet(f"{path}/stream={stream}/version={min(own, batch_id)}")
    carried = None
    for other in streams_of(spark, path):
        newest = latest_version(spark, f"{path}/stream={other}")
        if other != stream and newest is not None:
            state = spark.read.parquet(f"{path}/stream={other}/version={newest}")
            carried = state if carried is None else carried.unionByName(state)
    if carried is None:
        return None
    newest = F.max_by(F.struct("carried_user", "carried_db", "carried_time"), F.coalesce("carried_time", F.lit(0).cast("timestamp")))
    return carried.groupBy("conn_id").agg(newest.alias("s")).select("conn_id", "s.*")


def session_stream(
    batch: DataFrame, batch_id: int, path: str, stream: str = "direct", idle: str | None = None
) -> DataFrame:
    """The rows of a micro-batch with their session's user and database.

    Micro-batches come in the order of `seq`. The state, one row per connection that has a user or
    a database, is a versioned table per stream: version n + 1 is written by micro-batch n. A
    connection's row goes when it quits or is silent for longer than `idle`. Unlike a keyed state
    operator this splits the rows of a busy connection over many tasks.
    """
    carried = _carried_sessions(batch, path, batch_id, stream)
    shaped = with_session_context(batch, carried, idle=idle)
    own = f"{path}/stream={stream}"
    write_version(session_state(batch, carried, idle), own, batch_id + 1)
    # This micro-batch may be repeated, an earlier one may not.
    drop_versions_before(batch.sparkSession, own, batch_id)
    return shaped


def score_batch(
    rules: CompiledRules, tables: Tables, weights: RiskWeights = RiskWeights(), now: Column | None = None,
    stream: str = "direct",
) -> Callable[[DataFrame, int], None]:
    """The work of one micro-batch, for `foreachBatch`.

    Policies and allowlist are read anew if they have changed, so what one micro-batch learns holds
    from the next one on. All it writes goes to parts named after the stream and its number: a repeated micro-batch
    overwrites them, another stream over the same tables does not. Empty parts are not written. With
    `tables.commits` nothing of a micro-batch counts before all of it is written. Statements of one
    shape are analysed once; the table of their flags lasts as long as the micro-batch.
    """

    snapshots = Snapshots()

    def known(spark: SparkSession, own: str) -> ScoringContext:
        at = lambda path: contents(spark, path)
        policies = snapshots.read(
            "policies", at(tables.policies), lambda: read_policies(spark, tables.policies)
        )
        endpoints = snapshots.read(
            "endpoints", at(tables.endpoints), lambda: read_endpoints(spark, tables.endpoints)
        )
        listed = snapshots.read(
            "allowlist", parts_version(spark, tables.allowlist, own, tables.commits),
            lambda: read_allowlist(spark, tables.allowlist, own, tables.commits),
        )
        return ScoringContext(
            policies=expire_learning(policies.table, now),
            endpoints=endpoints.table,
            allowlist=listed.table,
            rules=rules,
            weights=weights,
            policy_bytes=policies.bytes,
            allowlist_bytes=listed.bytes,
        )

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        context = known(spark, stream_part(batch_id, stream))
        if tables.sessions is not None:
            batch = session_stream(batch, batch_id, tables.sessions, stream, tables.session_idle)
        # Statements that neither alert nor teach are dropped before anything is kept.
        flags = scratch_folder(spark)
        scored = score_log(batch, context, deduplicate=True, folder=flags).filter("alert or learn")
        scored.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            part, raised = stream_part(batch_id, stream), alerts(scored)
            # A repeated micro-batch may have less to write than it had the first time.
            for path in (tables.alerts, tables.alert_groups, tables.allowlist):
                drop_part(spark, path, part)
            if not raised.isEmpty():
                write_alerts(raised, tables.alerts, part, tables.alert_period)
                upsert_alert_groups(raised, tables.alert_groups, part)
            if not scored.filter("learn").isEmpty():
                upsert_allowlist(learned(scored), tables.allowlist, part, tables.commits)
            if tables.commits is not None:
                commit(spark, tables.commits, stream, batch_id)
        finally:
            scored.unpersist()
            drop_folder(spark, flags)

    return run


def run_scoring(
    log: DataFrame,
    rules: CompiledRules,
    tables: Tables,
    checkpoint: str,
    weights: RiskWeights = RiskWeights(),
    available_now: bool = False,
    now: Column | None = None,
) -> StreamingQuery:
    """Start the scoring of a log stream. With `available_now` it ends when the log is read. `now`
    is the time at which learning periods are looked at, by default the current one."""
    stream = stream_name(log.sparkSession, checkpoint)
    writer = log.writeStream.foreachBatch(score_batch(rules, tables, weights, now, stream)).option(
        "checkpointLocation", checkpoint
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": REFRESH}
    return writer.trigger(**trigger).start()
