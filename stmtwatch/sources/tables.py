"""Readers: the query log, batch or stream, and the small tables around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stmtwatch import schemas
from stmtwatch.config import ENDPOINT_DISABLED
from stmtwatch.operators.alerts import alert_groups
from stmtwatch.operators.policy import policy_catalog
from stmtwatch.operators.session import sane_time
from stmtwatch.sources.storage import latest_version, live_parts, part_exists

_STORED = {"policy": schemas.POLICY, "endpoint": schemas.ENDPOINT, "allowlist": schemas.ALLOWLIST}
_DEFAULTS = {"db_name": "", "db_user": "", "user_ip": "", "command": "query", "query": ""}


def conform(df: DataFrame, schema: T.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """The columns of the schema, cast; columns that are missing become null, but for required
    ones, without which the table is refused."""
    present = set(df.columns)
    missing = [c for c in required if c not in present]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")

    def column(f: T.StructField) -> Column:
        return (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in schema.fields])


def as_query_log(df: DataFrame) -> DataFrame:
    """Any frame with log columns as a query log: typed, and without nulls in the text columns.

    Timestamps without a zone are read in the session's zone, once, here.
    """
    log = conform(df, schemas.QUERY_LOG, schemas.REQUIRED["query_log"])
    return log.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in _DEFAULTS.items()})


def read_query_log(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A query log from files. Text formats are read with the fixed schema, never inferred; a
    malformed line fails the job unless the option `mode` says otherwise."""
    if fmt in ("parquet", "orc"):
        reader = spark.read.format(fmt).options(**options)
    else:
        reader = spark.read.format(fmt).options(**{"mode": "FAILFAST", **options}).schema(schemas.QUERY_LOG)
    return as_query_log(reader.load(path))


def stream_query_log(
    spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None, **options
) -> DataFrame:
    """The same as a stream over a folder that files are added to."""
    if fmt not in ("parquet", "orc"):
        options = {"mode": "FAILFAST", **options}
    reader = spark.readStream.format(fmt).schema(schemas.QUERY_LOG).options(**options)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return as_query_log(reader.load(path))


def _parsed(messages: DataFrame, col: str) -> DataFrame:
    """`m`, a message's fields, with `_malformed`, its text if that is no JSON object of the log."""
    schema = T.StructType([*schemas.QUERY_LOG.fields, T.StructField("_malformed", T.StringType())])
    text = F.col(col).cast("string")
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"})
    # Empty and null messages parse to null.
    return messages.select("*", parsed.alias("m")).withColumn(
        "_malformed", F.when(F.col("m").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.col("m._malformed"))
    )


def query_log_from_json(messages: DataFrame, col: str = "value", malformed: str = "fail") -> DataFrame:
    """A query log from JSON messages, as a message bus delivers them.

    A malformed message fails the job or, with `malformed="aside"`, is left to `rejected_messages`.
    """
    if malformed not in ("fail", "aside"):
        raise ValueError("malformed is either fail or aside")
    parsed, broken = _parsed(messages, col), F.col("_malformed").isNotNull()
    if malformed == "fail":
        refused = F.raise_error(F.concat(F.lit("malformed message: "), F.left("_malformed", F.lit(200))))
        parsed = parsed.filter(F.when(broken, refused.cast("boolean")).otherwise(True))
    else:
        parsed = parsed.filter(~broken)
    return as_query_log(parsed.select("m.*").drop("_malformed"))


def rejected_messages(messages: DataFrame, col: str = "value") -> DataFrame:
    """The messages that are no log rows, with all their columns: batch or stream, to be kept aside."""
    return _parsed(messages, col).filter(F.col("_malformed").isNotNull()).select(*messages.columns)


def without_repeats(log: DataFrame, delay: str) -> DataFrame:
    """A log stream in which a row that is delivered again within `delay` is met once.

    Rows are known by connection and sequence number, those without either by all their columns.
    The keys are state of the stream, dropped `delay` behind its latest time. Rows that come later
    than that are refused by Spark; clocks over an hour ahead of this machine's do not move the time.
    """
    placed = F.col("conn_id").isNotNull() & F.col("seq").isNotNull()
    keyed = log.withColumns({
        "_clock": sane_time(), "_whole": F.when(placed, 0).otherwise(F.xxhash64(*log.columns)),
    })
    once = keyed.withWatermark("_clock", delay).dropDuplicatesWithinWatermark(["conn_id", "seq", "_whole"])
    return once.drop("_clock", "_whole")


def read_table(
    spark: SparkSession, schema: T.StructType, path: str | None = None, fmt: str = "parquet", **options
) -> DataFrame:
    """A small table from files or, with `fmt="jdbc"`, from a database."""
    reader = spark.read.format(fmt).options(**options)
    if fmt not in ("parquet", "orc", "jdbc"):
        reader = reader.schema(schema)
    required = next((schemas.REQUIRED[n] for n, s in _STORED.items() if s == schema), ())
    return conform(reader.load(path) if path is not None else reader.load(), schema, required)


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of the stored policies. Status and permissions default to 0."""
    version = latest_version(spark, path)
    stored = read_table(spark, schemas.POLICY, path if version is None else f"{path}/version={version}")
    return stored.withColumns({
        "status": F.coalesce("status", F.lit(0)), "perms": F.coalesce("perms", F.lit(0).cast("long")),
    })


def read_policy(policies: DataFrame, endpoints: DataFrame) -> DataFrame:
    """User policies, each with its endpoint's dialect, and the system policies of endpoint 0."""
    user = policy_catalog(policies, endpoints)
    system = policies.filter(F.col("proxy_id") == 0).withColumn("db_type", F.lit(None).cast("string"))
    return user.unionByName(system)


def active_endpoints(endpoints: DataFrame) -> DataFrame:
    return endpoints.filter(F.col("status") != ENDPOINT_DISABLED)


def read_endpoints(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Endpoints that are not disabled."""
    return active_endpoints(read_table(spark, schemas.ENDPOINT, path, fmt, **options))


def usable_allowlist(stored: DataFrame) -> DataFrame:
    return stored.filter((F.col("perm") > 0) & (F.length("query") > 0))


def _parts(spark: SparkSession, path: str, schema: T.StructType, commits: str, besides: str | None = None) -> DataFrame:
    """The rows of the parts that count, with their part."""
    live = [part for part in live_parts(spark, path, commits) if part != besides]
    if not live:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("part", T.StringType())]))
    reader = spark.read.schema(T.StructType([*schema.fields, T.StructField("part", T.StringType())]))
    return reader.option("basePath", path).parquet(*[f"{path}/part={part}" for part in live])


def stored_allowlist(
    spark: SparkSession, path: str, besides: str | None = None, commits: str | None = None
) -> DataFrame:
    """All stored rows, also those without permission. `besides` names one part of the table to
    leave out. With `commits` only parts that count are read."""
    if not part_exists(spark, path):
        return spark.createDataFrame([], schemas.ALLOWLIST)
    if commits is not None:
        return conform(_parts(spark, path, schemas.ALLOWLIST, commits, besides), schemas.ALLOWLIST)
    stored = spark.read.parquet(path)
    if besides is not None and "part" in stored.columns:
        stored = stored.filter(F.col("part").cast("string") != besides)
    return conform(stored, schemas.ALLOWLIST)


def read_allowlist(
    spark: SparkSession, path: str, besides: str | None = None, commits: str | None = None
) -> DataFrame:
    """Allowlist rows that count: with a permission and a pattern."""
    return usable_allowlist(stored_allowlist(spark, path, besides, commits))


def read_alerts(spark: SparkSession, path: str, commits: str | None = None) -> DataFrame:
    """Stored alerts; filters on `event_date` skip whole folders. With `commits` only parts that count."""
    if commits is not None:
        dated = T.StructType([*schemas.ALERTS.fields, T.StructField("event_date", T.DateType())])
        return _parts(spark, path, dated, commits)
    folders = [T.StructField("part", T.StringType()), T.StructField("event_date", T.DateType())]
    return spark.read.schema(T.StructType(schemas.ALERTS.fields + folders)).parquet(path)


def read_alert_groups(spark: SparkSession, path: str, commits: str | None = None) -> DataFrame:
    """Stored alert groups, the parts of the table folded into one row per group."""
    if not part_exists(spark, path):
        return spark.createDataFrame([], schemas.ALERT_GROUPS)
    parts = spark.read.parquet(path) if commits is None else _parts(spark, path, schemas.ALERT_GROUPS, commits)
    stored = conform(parts, schemas.ALERT_GROUPS)
    return alert_groups(stored.withColumnRenamed("update_time", "event_time"))
