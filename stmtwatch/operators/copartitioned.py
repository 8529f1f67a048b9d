"""Look-ups of stored logs in stored lists, in buckets of the same keys: neither side moves.

For lists beyond a broadcast. `in_allowlist` and `match_alert_group` shuffle whole statements then,
each time; these shuffle them once, when the log is stored. A resolved log holds the policies of the
time it was stored; after a change of policies it is stored again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtwatch.operators.alerts import GROUP_KEYS
from stmtwatch.operators.policy import LIST_KEYS, allowlist_keys, with_list_keys
from stmtwatch.sources.buckets import Bucketed, bucketed_lookup, store_bucketed


def store_resolved(resolved: DataFrame, path: str, buckets: int, **options) -> Bucketed:
    """A log with patterns and policies, by the keys of the allowlist."""
    return store_bucketed(with_list_keys(resolved), LIST_KEYS, path, buckets, **options)


def store_allowlist(allowlist: DataFrame, path: str, buckets: int) -> Bucketed:
    return store_bucketed(allowlist_keys(allowlist), LIST_KEYS, path, buckets)


def in_stored_allowlist(log: Bucketed, allowlist: Bucketed) -> DataFrame:
    """The rows of the log with `listed`, as from `in_allowlist`."""
    joined = bucketed_lookup(log, _marked(allowlist, "_listed"))
    return joined.withColumn("listed", F.coalesce("_listed", F.lit(False))).drop("_listed", *LIST_KEYS)


def store_alerts(alert_rows: DataFrame, path: str, buckets: int, **options) -> Bucketed:
    return store_bucketed(alert_rows, GROUP_KEYS, path, buckets, **options)


def store_groups(groups: DataFrame, path: str, buckets: int) -> Bucketed:
    return store_bucketed(groups.select(*GROUP_KEYS).distinct(), GROUP_KEYS, path, buckets)


def match_stored_groups(alert_rows: Bucketed, groups: Bucketed) -> DataFrame:
    """The alerts with `known_group`, as from `match_alert_group`."""
    joined = bucketed_lookup(alert_rows, _marked(groups, "_known"))
    return joined.withColumn("known_group", F.coalesce("_known", F.lit(False))).drop("_known")


def _marked(table: Bucketed, name: str) -> Bucketed:
    flag = F.lit(True)
    return Bucketed(
        table.keys, table.buckets, table.rows.withColumn(name, flag), table.apart.withColumn(name, flag), table.hot
    )
