"""Schemas of the log and of the five small tables around it."""

from pyspark.sql import types as T

QUERY_LOG = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("conn_id", T.StringType()),
    T.StructField("proxy_id", T.IntegerType()),
    T.StructField("db_type", T.StringType()),
    T.StructField("db_name", T.StringType()),
    T.StructField("db_user", T.StringType()),
    T.StructField("user_ip", T.StringType()),
    T.StructField("command", T.StringType()),
    T.StructField("query", T.StringType()),
    # Did the command succeed? Unknown counts as yes.
    T.StructField("ok", T.BooleanType()),
])

POLICY = T.StructType([
    T.StructField("dbpid", T.IntegerType()),
    T.StructField("proxy_id", T.IntegerType()),
    T.StructField("db_name", T.StringType()),
    T.StructField("perms", T.LongType()),
    T.StructField("perms2", T.LongType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("sysdbtype", T.StringType()),
    T.StructField("status_changed", T.TimestampType()),
])

ENDPOINT = T.StructType([
    T.StructField("proxy_id", T.IntegerType()),
    T.StructField("proxyname", T.StringType()),
    T.StructField("dbtype", T.StringType()),
    T.StructField("status", T.IntegerType()),
])

ALLOWLIST = T.StructType([
    T.StructField("proxy_id", T.IntegerType()),
    T.StructField("perm", T.ShortType()),
    T.StructField("db_name", T.StringType()),
    T.StructField("query", T.StringType()),
])

ALERTS = T.StructType([
    T.StructField("alertid", T.LongType()),
    T.StructField("agroupid", T.LongType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("risk", T.IntegerType()),
    T.StructField("block", T.IntegerType()),
    T.StructField("dbuser", T.StringType()),
    T.StructField("userip", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("reason", T.StringType()),
])

ALERT_GROUPS = T.StructType([
    T.StructField("agroupid", T.LongType()),
    T.StructField("proxy_id", T.IntegerType()),
    T.StructField("db_name", T.StringType()),
    T.StructField("update_time", T.TimestampType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("pattern", T.StringType()),
])

RULES = T.StructType([
    T.StructField("dialect", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("pattern", T.StringType()),
])

# Columns that a stored table must have; others may be missing and are null then.
REQUIRED = {
    "query_log": ("db_type", "query"),
    "policy": ("proxy_id", "db_name", "perms", "status", "sysdbtype"),
    "endpoint": ("proxy_id", "dbtype", "status"),
    "allowlist": ("proxy_id", "perm", "db_name", "query"),
}
