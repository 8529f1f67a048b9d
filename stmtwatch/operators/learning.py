"""Learning mode: patterns that enter the allowlist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIST_KEYS = ["proxy_id", "db_name", "query"]


def learned(scored: DataFrame) -> DataFrame:
    """The distinct patterns to learn, under the key of the policy that governs them."""
    return (
        scored.filter("learn")
        .select(
            F.col("policy_proxy_id").alias("proxy_id"),
            F.col("policy_db_name").alias("db_name"),
            F.col("pattern").alias("query"),
        )
        .distinct()
    )


def learn_anti(new: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Of the learned patterns those that are not stored yet. Both sides are distinct keys, so no
    key is hot."""
    return new.join(allowlist.select(*LIST_KEYS), LIST_KEYS, "left_anti")


def merge_allowlist(allowlist: DataFrame, new: DataFrame) -> DataFrame:
    """The allowlist plus the patterns it lacks, with permission 1."""
    added = learn_anti(new, allowlist).withColumn("perm", F.lit(1).cast("short"))
    return allowlist.select("proxy_id", "perm", "db_name", "query").unionByName(
        added.select("proxy_id", "perm", "db_name", "query")
    )
