"""Policies, their resolution per statement, and the allowlist lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtwatch.config import (
    MODE_ALWAYS_BLOCK_NEW,
    MODE_LEARNING_3DAYS,
    MODE_LEARNING_7DAYS,
    MODE_RISK_BLOCK,
    PERM_BITS,
)
from stmtwatch.operators.lookup import lookup_join

# The system policies, by the database type they are the fallback for.
EMPTY_MYSQL, DEFAULT_MYSQL, DEFAULT_PGSQL = "empty_mysql", "default_mysql", "default_pgsql"
SYSTEM_POLICIES = (EMPTY_MYSQL, DEFAULT_MYSQL, DEFAULT_PGSQL)
# The policy that holds where not even a system policy is stored.
BUILTIN_DB, BUILTIN_PROXY, BUILTIN_PERMS = "default", 0, 0

_SETTINGS = ("dbpid", "perms", "status")


def policy_catalog(policies: DataFrame, endpoints: DataFrame) -> DataFrame:
    """User policies with the dialect of their endpoint."""
    dialects = endpoints.select("proxy_id", F.col("dbtype").alias("db_type"))
    return policies.join(dialects, "proxy_id")


def _latest(policies: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key; of several stored rows the last one holds."""
    newest = F.max_by(F.struct(*_SETTINGS), "dbpid").alias("p")
    return policies.groupBy(*keys).agg(newest).select(*keys, *[f"p.{c}" for c in _SETTINGS])


def user_policies(catalog: DataFrame) -> DataFrame:
    return _latest(catalog, ["proxy_id", "db_name"])


def system_policies(policies: DataFrame) -> DataFrame:
    """The fallback policies, at most one per system name."""
    own = policies.filter((F.col("proxy_id") == 0) & F.col("sysdbtype").isin(*SYSTEM_POLICIES))
    return _latest(own, ["sysdbtype"])


def fallback_name(db_type: Column, db_name: Column) -> Column:
    return (
        F.when((db_type == "mysql") & (db_name == ""), EMPTY_MYSQL)
        .when(db_type == "mysql", DEFAULT_MYSQL)
        .when(db_type == "pgsql", DEFAULT_PGSQL)
    )


def resolve_policy(
    log: DataFrame, policies: DataFrame, endpoints: DataFrame, known_bytes: int | None = None
) -> DataFrame:
    """Add the policy that governs each row: `policy_kind`, `policy_proxy_id`, `policy_db_name`,
    `perms` and `status`.

    The policy of exactly this endpoint and database holds; else the system policy of the dialect;
    else the built-in one. `known_bytes` is the size of `policies`, where it is known.
    """
    exact = user_policies(policy_catalog(policies, endpoints)).select(
        "proxy_id", "db_name", F.col("perms").alias("_perms"), F.col("status").alias("_status"),
        F.lit(True).alias("_exact"),
    )
    fallback = system_policies(policies).select(
        F.col("sysdbtype").alias("_system"),
        F.col("perms").alias("_system_perms"),
        F.col("status").alias("_system_status"),
        F.lit(True).alias("_is_system"),
    )
    rows = log.withColumns({
        "db_name": F.coalesce("db_name", F.lit("")),
        "_system": fallback_name(F.col("db_type"), F.coalesce("db_name", F.lit(""))),
    })
    # `fallback` has at most one row per system policy, three in all.
    joined = lookup_join(rows, exact, ["proxy_id", "db_name"], known_bytes=known_bytes).join(
        F.broadcast(fallback), "_system", "left"
    )
    is_exact = F.col("_exact").isNotNull()
    is_system = F.col("_is_system").isNotNull()

    def pick(exact_value, system_value, builtin_value) -> Column:
        return F.when(is_exact, exact_value).when(is_system, system_value).otherwise(builtin_value)

    system_db = F.when(F.col("_system") == EMPTY_MYSQL, "").otherwise(F.col("_system"))
    return joined.select(
        *log.columns,
        pick(F.lit("user"), F.lit("system"), F.lit("builtin")).alias("policy_kind"),
        pick(F.col("proxy_id"), F.lit(0), F.lit(BUILTIN_PROXY)).alias("policy_proxy_id"),
        pick(F.col("db_name"), system_db, F.lit(BUILTIN_DB)).alias("policy_db_name"),
        # Stored without a value, both are 0.
        F.coalesce(
            pick(F.col("_perms"), F.col("_system_perms"), F.lit(BUILTIN_PERMS)), F.lit(0)
        ).cast("long").alias("perms"),
        F.coalesce(
            pick(F.col("_status"), F.col("_system_status"), F.lit(MODE_RISK_BLOCK)), F.lit(0)
        ).cast("int").alias("status"),
    )


def can(perms: Column, name: str) -> Column:
    return perms.bitwiseAND(PERM_BITS[name]) != 0


def decode_perms(df: DataFrame, col: str = "perms") -> DataFrame:
    """Add one boolean `can_<name>` per permission bit."""
    return df.withColumns({f"can_{name}": can(F.col(col), name) for name in PERM_BITS})


LIST_KEYS = ["_list_proxy", "_list_db", "_list_pattern"]


def allowlist_keys(allowlist: DataFrame) -> DataFrame:
    return allowlist.select(
        F.col("proxy_id").cast("int").alias("_list_proxy"),
        F.col("db_name").alias("_list_db"),
        F.col("query").alias("_list_pattern"),
    ).distinct()


def with_list_keys(resolved: DataFrame) -> DataFrame:
    """Add the keys by which a row is looked up in the allowlist. The built-in policy has no list."""
    stored = F.col("policy_kind") != "builtin"
    return resolved.withColumns({
        "_list_proxy": F.when(stored, F.col("policy_proxy_id")).cast("int"),
        "_list_db": F.when(stored, F.col("policy_db_name")),
        "_list_pattern": F.col("pattern"),
    })


def in_allowlist(resolved: DataFrame, allowlist: DataFrame, **join_options) -> DataFrame:
    """Add `listed`: is the pattern on the list of the policy that governs the row?"""
    marked = allowlist_keys(allowlist).withColumn("_listed", F.lit(True))
    joined = lookup_join(with_list_keys(resolved), marked, LIST_KEYS, **join_options)
    return joined.select(
        *[c for c in resolved.columns if c != "listed"],
        F.coalesce("_listed", F.lit(False)).alias("listed"),
    )


def allowlist_hits(flagged: DataFrame) -> DataFrame:
    return flagged.filter("listed")


def allowlist_misses(flagged: DataFrame) -> DataFrame:
    return flagged.filter("not listed")


def expire_learning(policies: DataFrame, now: Column | None = None) -> DataFrame:
    """Timed learning policies start to block new statements once their days are over."""
    now = F.current_timestamp() if now is None else now

    def over(mode: int, days: int) -> Column:
        end = F.col("status_changed") + F.expr(f"INTERVAL {days} DAYS")
        return (F.col("status") == mode) & (now > end)

    expired = over(MODE_LEARNING_3DAYS, 3) | over(MODE_LEARNING_7DAYS, 7)
    return policies.withColumn(
        "status",
        F.when(expired, F.lit(MODE_ALWAYS_BLOCK_NEW)).otherwise(F.col("status")).cast("int"),
    )
