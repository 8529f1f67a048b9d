"""Alerts and their groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtwatch.operators.lookup import lookup_join

GROUP_KEYS = ["proxy_id", "db_name", "pattern"]


def group_id() -> Column:
    """A group id that depends on nothing but the group's key: no counter, no global sort."""
    return F.xxhash64(*GROUP_KEYS)


def assign_group_id(df: DataFrame) -> DataFrame:
    return df.withColumn("agroupid", group_id())


def alerts(scored: DataFrame) -> DataFrame:
    """One row per statement with an alert level. The group key is that of the connection, not of
    the policy."""
    return scored.filter("alert").select(
        F.xxhash64("proxy_id", "conn_id", "seq", "event_time").alias("alertid"),
        group_id().alias("agroupid"),
        "event_time",
        "risk",
        F.col("alert_level").alias("block"),
        F.coalesce("db_user", F.lit("")).alias("dbuser"),
        F.coalesce("user_ip", F.lit("")).alias("userip"),
        "query",
        "reason",
        *GROUP_KEYS,
        F.col("group_status").alias("status"),
    )


def _fold_groups(df: DataFrame, time: str) -> DataFrame:
    return assign_group_id(
        df.groupBy(*GROUP_KEYS).agg(
            F.max(time).alias("update_time"), F.max("status").cast("int").alias("status")
        )
    ).select("agroupid", "proxy_id", "db_name", "update_time", "status", "pattern")


def alert_groups(alert_rows: DataFrame) -> DataFrame:
    """One row per endpoint, database and pattern: time of the latest alert, and status 1 once a
    learning policy has met it. A partial aggregate, so a hot group shrinks before the shuffle."""
    return _fold_groups(alert_rows, "event_time")


def merge_groups(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fold new groups into old ones. Associative and idempotent."""
    return _fold_groups(old.unionByName(new), "update_time")


def match_alert_group(alert_rows: DataFrame, groups: DataFrame, **join_options) -> DataFrame:
    """Add `known_group`: did the group of the alert exist already?"""
    known = groups.select(*GROUP_KEYS).distinct().withColumn("_known", F.lit(True))
    joined = lookup_join(alert_rows, known, GROUP_KEYS, **join_options)
    return joined.select(*alert_rows.columns, F.coalesce("_known", F.lit(False)).alias("known_group"))
