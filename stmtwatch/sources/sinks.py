"""Writers. Each owns one part of its table, named by the job or the micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtwatch import schemas
from stmtwatch.operators.alerts import alert_groups
from stmtwatch.operators.learning import LIST_KEYS, learn_anti
from stmtwatch.sources.storage import new_part, write_part, write_version
from stmtwatch.sources.tables import _parts, conform, read_alert_groups, read_alerts, stored_allowlist
from stmtwatch.sources import storage


def write_alerts(
    alert_rows: DataFrame, path: str, part: str | None = None, period: str = "day"
) -> None:
    """Store alerts in folders by day, or by a longer period for a thin log.

    The rows are rebalanced first: few files for a quiet day, many for a busy one.
    """
    dated = alert_rows.select(
        *schemas.ALERTS.fieldNames(), F.to_date(F.date_trunc(period, "event_time")).alias("event_date")
    )
    write_part(dated.hint("rebalance", "event_date"), path, part or new_part(), ("event_date",))


def upsert_alert_groups(alert_rows: DataFrame, path: str, part: str | None = None) -> None:
    """Insert the groups of these alerts, or move their time and status on.

    Only the groups met now are written. Readers fold the parts, so a group that exists already is
    neither looked up nor rewritten.
    """
    write_part(alert_groups(alert_rows), path, part or new_part())


def upsert_allowlist(new: DataFrame, path: str, part: str | None = None, commits: str | None = None) -> None:
    """Add the learned patterns that are not stored yet, with permission 1."""
    part = part or new_part()
    stored = stored_allowlist(new.sparkSession, path, part, commits)
    added = learn_anti(new.select(*LIST_KEYS), stored).withColumn("perm", F.lit(1))
    if not added.isEmpty():
        write_part(conform(added, schemas.ALLOWLIST), path, part)


def write_policy(policies: DataFrame, path: str, version: int | None = None) -> int:
    """Store the policies as a new version, e.g. after learning periods have ended."""
    return write_version(conform(policies, schemas.POLICY), path, version)


def compact_alert_groups(spark, path: str, keep: tuple[str, ...] = ()) -> None:
    storage.compact(read_alert_groups(spark, path), path, keep)


def compact_allowlist(spark, path: str, keep: tuple[str, ...] = ()) -> None:
    stored = stored_allowlist(spark, path).groupBy(*LIST_KEYS).agg(F.max("perm").alias("perm"))
    storage.compact(conform(stored, schemas.ALLOWLIST), path, keep)


def compact_committed(spark, path: str, kind: str, commits: str, keep: tuple[str, ...] = ()) -> str | None:
    """Replace the parts that count by one, beside readers and running streams. `kind` is alerts,
    alert_groups or allowlist. `keep` names parts that stay, e.g. of a micro-batch that may be repeated.

    What a stream has not committed is left alone. Old files go with `storage.vacuum`.
    """
    parts = [part for part in storage.live_parts(spark, path, commits) if part not in keep]
    if len(parts) < 2:
        return None
    if kind == "alerts":
        content, folders = read_alerts(spark, path, commits), ("event_date",)
    elif kind == "alert_groups":
        content, folders = _parts(spark, path, schemas.ALERT_GROUPS, commits), ()
    else:
        content, folders = _parts(spark, path, schemas.ALLOWLIST, commits), ()
    content = content.filter(F.col("part").isin(*parts)).drop("part")
    if kind == "alerts":
        content = content.hint("rebalance", "event_date")
    elif kind == "alert_groups":
        content = alert_groups(content.withColumnRenamed("update_time", "event_time"))
    else:
        content = conform(content.groupBy(*LIST_KEYS).agg(F.max("perm").alias("perm")), schemas.ALLOWLIST)
    return storage.compact_parts(content, path, parts, folders)
