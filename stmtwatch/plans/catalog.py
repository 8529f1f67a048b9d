"""One query per operator over the test tables, for checks and benchmarks."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtwatch.config import RiskWeights
from stmtwatch.functions import fingerprint as fp
from stmtwatch.functions import signals as S
from stmtwatch.operators import alerts as al
from stmtwatch.operators import copartitioned as co
from stmtwatch.operators import learning as le
from stmtwatch.operators import policy as po
from stmtwatch.operators import privileged as pr
from stmtwatch.operators import risk as rk
from stmtwatch.operators import rule_index as ri
from stmtwatch.operators import session as se
from stmtwatch.plans import demo
from stmtwatch.plans.scoring import ScoringContext, prepare, score_log
from stmtwatch.sources import rawlog
from stmtwatch.sources import rules as ru
from stmtwatch.sources import sinks, storage, tables
from stmtwatch.streaming import scoring as st
from stmtwatch.streaming import sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
# Of the stored logs in the queries here. For a log of 10 TB it is 65,536: see `buckets_for`.
BUCKETS = 8


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def naive(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as the test tables have them."""
    return df.withColumns({
        f.name: F.col(f.name).cast("timestamp_ntz")
        for f in df.schema.fields if f.dataType.typeName() == "timestamp"
    })


def context(spark: SparkSession, **changes) -> ScoringContext:
    values = {
        "policies": tables.conform(spark.sql(demo.POLICY_SQL), tables.schemas.POLICY),
        "endpoints": spark.sql(demo.ENDPOINT_SQL),
        "allowlist": tables.usable_allowlist(spark.sql(demo.ALLOWLIST_SQL)),
        "rules": ru.compile_rules(ru.read_rules(spark)),
    }
    return ScoringContext(**{**values, **changes})


def scored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored log. Its statements are analysed once by shape; `verdicts` analyses them row by row."""
    scratch(spark)  # names the shared folder of a local session
    return score_log(demo.query_log(spark, sf_dir), context(spark), deduplicate=True)


def raised_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What groups are made of, of all alerts: scored once, however often it is read."""
    raised = al.alerts(scored_log(spark, sf_dir))
    return spark.read.parquet(_stored(raised.select(*al.GROUP_KEYS, "event_time", "risk", "status")))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.inspectable(se.command_to_sql(demo.query_log(spark, sf_dir)))


def resolved_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = context(spark)
    return po.resolve_policy(
        fp.with_pattern(statements(spark, sf_dir)), known.policies, known.endpoints
    )


def scratch(spark: SparkSession) -> str:
    """A new scratch folder. A local session without a shared folder is given one."""
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stmtwatch-"))
    return storage.scratch_folder(spark)


def _stored(df: DataFrame) -> str:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return path


# --- sources ------------------------------------------------------------------------------------


@query
def read_query_log(spark, sf_dir):
    """The log written as JSON and read back with the fixed schema."""
    path = scratch(spark)
    demo.query_log(spark, sf_dir).write.json(path)
    return naive(tables.read_query_log(spark, path, "json"))


@query
def stream_query_log(spark, sf_dir):
    """The log read as a stream of files, counted by command."""
    path = _stored(demo.query_log(spark, sf_dir).repartition(4))
    out = scratch(spark)
    log = tables.stream_query_log(spark, path, max_files=2)
    log.writeStream.format("parquet").option("checkpointLocation", out + "-state").trigger(
        availableNow=True
    ).start(out).awaitTermination()
    return spark.read.parquet(out).groupBy("db_type", "command").agg(F.count(F.lit(1)).alias("n"))


@query
def messages(spark, sf_dir):
    """The log of sessions as JSON messages."""
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    sent = demo.session_log(spark, sf_dir).select(F.to_json(F.struct("*"), exact).alias("value"))
    return naive(tables.query_log_from_json(sent))


@query
def added_rules(spark, sf_dir):
    """Rows that extend the rule set, here by a category of their own."""
    more = spark.createDataFrame(
        [(d, "added", p) for d in ru.DIALECTS for p in ("^insert into", "^select.*union")], ru.RULES
    )
    rules = ru.compile_rules(ru.read_rules(spark).unionByName(more))
    log = fp.with_pattern(statements(spark, sf_dir))
    hit = ru.matches(rules, "added", F.col("db_type"), F.col("pattern"))
    return log.select("db_type", hit.alias("added")).groupBy("db_type", "added").agg(F.count(F.lit(1)).alias("n"))


@query
def read_policy(spark, sf_dir):
    path = scratch(spark)
    policies = demo.derived(spark, sf_dir, demo.CUSTOMER_POLICY_SQL, "customer")
    system = policies.filter("sysdbtype <> 'user_db'").withColumn("proxy_id", F.lit(0))
    sinks.write_policy(policies.unionByName(system), path)
    endpoints = demo.derived(spark, sf_dir, demo.SUPPLIER_ENDPOINT_SQL, "supplier")
    return tables.read_policy(tables.read_policies(spark, path), endpoints).select(
        "dbpid", "proxy_id", "db_name", "perms", "status", "sysdbtype", "db_type"
    )


@query
def read_allowlist(spark, sf_dir):
    """Patterns of the log as a stored list, some without permission or text."""
    patterns = fp.with_pattern(demo.query_log(spark, sf_dir)).select(
        "proxy_id",
        F.when(F.col("seq") % 3 == 0, 0).otherwise(1).alias("perm"),
        "db_name",
        F.when(F.col("seq") % 12 == 7, "").otherwise(F.col("pattern")).alias("query"),
    )
    return tables.read_allowlist(spark, _stored(patterns.distinct()))


@query
def read_endpoints(spark, sf_dir):
    path = _stored(demo.derived(spark, sf_dir, demo.SUPPLIER_ENDPOINT_SQL, "supplier"))
    return tables.read_endpoints(spark, path)


@query
def read_alert_groups(spark, sf_dir):
    return _upserted_groups(spark, sf_dir).select("proxy_id", "db_name", "status", "pattern")


@query
def rule_matches(spark, sf_dir):
    """Statements of the log per dialect and rule category."""
    rules = ru.compile_rules(ru.read_rules(spark))
    log = fp.with_pattern(statements(spark, sf_dir))
    categories = ("alter", "block", "create", "drop", "info")
    hits = [F.when(ru.matches(rules, c, F.col("db_type"), F.col("pattern")), c) for c in categories]
    return (
        log.select("db_type", F.explode(F.array_compact(F.array(*hits))).alias("category"))
        .groupBy("db_type", "category")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def indexed_rules(spark, sf_dir):
    """Statements that name the key of a customer, by market segment: one rule per customer."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    rules = customers.select(
        F.when(F.col("c_custkey") % 2 == 0, "mysql").otherwise("pgsql").alias("dialect"),
        F.col("c_mktsegment").alias("category"),
        F.format_string(r"[=(,] *%s\b", F.col("c_custkey").cast("string")).alias("pattern"),
    )
    hits = ri.with_rule_hits(statements(spark, sf_dir), rules, text="query")
    return hits.filter(F.size("rule_hits") > 0).select("seq", F.array_join("rule_hits", ",").alias("segments"))


# --- sinks --------------------------------------------------------------------------------------


@query
def write_alerts(spark, sf_dir):
    path = scratch(spark)
    sinks.write_alerts(al.alerts(scored_log(spark, sf_dir)), path, period="year")
    return naive(tables.read_alerts(spark, path).select(
        "event_time", "risk", "block", "dbuser", "userip", "query", "reason"
    ))


def _upserted_groups(spark, sf_dir) -> DataFrame:
    """Two upserts, of the even and of all alerts."""
    path = scratch(spark)
    raised = al.alerts(scored_log(spark, sf_dir))
    sinks.upsert_alert_groups(raised.filter("proxy_id = 1"), path)
    sinks.upsert_alert_groups(raised, path)
    sinks.compact_alert_groups(spark, path)
    return tables.read_alert_groups(spark, path)


@query
def upsert_alert_groups(spark, sf_dir):
    return naive(_upserted_groups(spark, sf_dir).drop("agroupid"))


@query
def upsert_allowlist(spark, sf_dir):
    path = scratch(spark)
    first = tables.conform(spark.sql(demo.ALLOWLIST_SQL), tables.schemas.ALLOWLIST)
    storage.write_part(first, path, "job-first")
    new = le.learned(scored_log(spark, sf_dir))
    sinks.upsert_allowlist(new, path)
    sinks.upsert_allowlist(new, path)
    return tables.read_allowlist(spark, path)


@query
def write_policy(spark, sf_dir):
    """Two versions of the policies; the newest one is read."""
    path = scratch(spark)
    policies = demo.derived(spark, sf_dir, demo.CUSTOMER_POLICY_SQL, "customer")
    sinks.write_policy(policies, path)
    sinks.write_policy(_expired(tables.read_policies(spark, path)), path)
    return tables.read_policies(spark, path).select("dbpid", "status")


# --- session and statement shaping --------------------------------------------------------------


@query
def session_context(spark, sf_dir):
    """Sessions of a log from JSON, with quits, new logins and failed changes of the database."""
    path = scratch(spark)
    demo.session_log(spark, sf_dir).write.json(path)
    shaped = se.with_session_context(tables.read_query_log(spark, path, "json"), block=1000)
    return shaped.select("seq", "conn_id", "command", "db_user", "db_name")


@query
def session_state(spark, sf_dir):
    return naive(se.session_state(demo.session_log(spark, sf_dir)))


@query
def command_to_sql(spark, sf_dir):
    return se.command_to_sql(demo.query_log(spark, sf_dir)).select("seq", "command", "query")


@query
def inspectable_commands(spark, sf_dir):
    return statements(spark, sf_dir).groupBy("db_type", "command").agg(F.count(F.lit(1)).alias("n"))


# --- fingerprint --------------------------------------------------------------------------------


@query
def ascii_lower(spark, sf_dir):
    docs = demo.derived(spark, sf_dir, "select doc_id, text from documents", "documents")
    return docs.select("doc_id", fp.ascii_lower(F.col("text")).alias("text"))


@query
def mask_quoted(spark, sf_dir):
    log = demo.query_log(spark, sf_dir)
    return log.select("seq", fp.mask_quoted(F.col("query")).alias("query"))


@query
def reduce_block_comments(spark, sf_dir):
    docs = demo.derived(spark, sf_dir, "select doc_id, text from documents", "documents")
    text = F.concat(F.lit("select /* "), "text", F.lit(" */ 1 /**/ from t /* open "), "text")
    return docs.select("doc_id", fp.reduce_block_comments(text).alias("text"))


@query
def reduce_hash_comments(spark, sf_dir):
    pages = demo.derived(spark, sf_dir, "select page_id, html from pages", "pages")
    return pages.select("page_id", fp.reduce_hash_comments(F.col("html")).alias("html"))


@query
def reduce_dash_comments(spark, sf_dir):
    pages = demo.derived(spark, sf_dir, "select page_id, html from pages", "pages")
    return pages.select("page_id", fp.reduce_dash_comments(F.col("html")).alias("html"))


@query
def mask_numbers(spark, sf_dir):
    docs = demo.derived(spark, sf_dir, "select doc_id, text from documents", "documents")
    return docs.select("doc_id", fp.mask_numbers(F.col("text")).alias("text"))


@query
def squeeze_blanks(spark, sf_dir):
    pages = demo.derived(spark, sf_dir, "select page_id, html from pages", "pages")
    return pages.select("page_id", fp.squeeze_blanks(F.col("html")).alias("html"))


@query
def drop_unary_minus(spark, sf_dir):
    parts = demo.derived(spark, sf_dir, "select p_partkey, p_name from part", "part")
    text = F.concat(F.lit("select -?,- ?, a from t where -?=x and b = -? and "), "p_name", F.lit("(-?)"))
    return parts.select("p_partkey", fp.drop_unary_minus(text).alias("pattern"))


@query
def fingerprint_counts(spark, sf_dir):
    return (
        fp.with_pattern(statements(spark, sf_dir))
        .groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    )


@query
def fingerprint_probes(spark, sf_dir):
    """Every probe statement against the pattern that was traced by hand."""
    return fp.with_pattern(demo.probe_log(spark, sf_dir)).select("seq", "pattern")


# --- privileged commands ------------------------------------------------------------------------


@query
def privileged_classes(spark, sf_dir):
    classed = pr.privileged(resolved_log(spark, sf_dir), context(spark).rules)
    return classed.select("seq", "is_alter", "is_drop", "is_create", "is_info", "privileged")


@query
def blocked_commands(spark, sf_dir):
    """The block category, which is enforced on request only."""
    classed = pr.privileged(resolved_log(spark, sf_dir), context(spark).rules, enforce_block=True)
    return classed.groupBy("db_type", "is_block").agg(F.count(F.lit(1)).alias("n"))


@query
def decode_perms(spark, sf_dir):
    policies = demo.derived(spark, sf_dir, demo.CUSTOMER_POLICY_SQL, "customer")
    return po.decode_perms(policies).select("dbpid", *[f"can_{name}" for name in po.PERM_BITS])


# --- signals, score, verdict --------------------------------------------------------------------


@query
def statement_words(spark, sf_dir):
    """First word of each statement, and whether all of it is looked at."""
    toks = rk.with_tokens(statements(spark, sf_dir))
    return toks.select("seq", "verb", (F.trim("counted") == F.trim("outline")).alias("whole"))


@query
def signal_flags(spark, sf_dir):
    return rk.with_signals(statements(spark, sf_dir), context(spark).rules).select("seq", *S.FLAGS)


@query
def signal_probes(spark, sf_dir):
    """Every probe statement against the flags that were traced by hand."""
    log = demo.probe_log(spark, sf_dir)
    return rk.with_signals(log, context(spark).rules).select("seq", *S.FLAGS)


@query
def signal_probes_by_outline(spark, sf_dir):
    """The same flags, with statements of one shape analysed once."""
    log = demo.probe_log(spark, sf_dir)
    return rk.with_signals_by_outline(log, context(spark).rules).select("seq", *S.FLAGS)


@query
def risk_scores(spark, sf_dir):
    flagged = rk.with_signals(statements(spark, sf_dir), context(spark).rules)
    scored = rk.with_risk(flagged)
    return scored.select("seq", "risk", rk.risk_band(F.col("risk")).alias("band"))


@query
def weighted_scores(spark, sf_dir):
    """Other weights; a weight of zero switches its signal off."""
    weights = RiskWeights.from_mapping({"comments": 0, "union": 7, "warn_level": 5})
    flagged = rk.with_signals(demo.probe_log(spark, sf_dir), context(spark).rules)
    return rk.with_risk(flagged, weights).groupBy("risk").agg(F.count(F.lit(1)).alias("n"))


def _rendered(log: DataFrame, dialect: str) -> str:
    """The statements of a dialect, over several lines, in files as its server writes them."""
    path = scratch(log.sparkSession)
    lines = log.filter(F.col("db_type") == dialect).withColumns({
        "conn_id": F.substring("conn_id", 2, 20), "query": F.replace("query", F.lit(" WHERE "), F.lit("\nWHERE\n\n")),
    })
    lines.repartition(3, "conn_id").sortWithinPartitions("seq").select(
        rawlog.render(lines, dialect).alias("value")
    ).write.text(path)
    return path


@query
def raw_general_log(spark, sf_dir):
    """The log of the first dialect as a general log, read back in small ranges of bytes."""
    path = _rendered(demo.query_log(spark, sf_dir), "mysql")
    log = rawlog.read_raw_log(spark, path, "mysql", proxy_id=1, splitbytes=1 << 16)
    return naive(log.select("event_time", "conn_id", "proxy_id", "db_type", "command", "query"))


@query
def raw_csv_log(spark, sf_dir):
    """The statements of the second dialect as a csvlog, read as a stream of complete files."""
    path = _rendered(demo.query_log(spark, sf_dir).filter("command = 'query'"), "pgsql")
    log = rawlog.stream_raw_log(spark, path, "pgsql", proxy_id=2, splitbytes=1 << 16, complete=True)
    out = scratch(spark)
    log.writeStream.format("parquet").option("checkpointLocation", out + "-state").trigger(
        availableNow=True
    ).start(out).awaitTermination()
    return naive(spark.read.parquet(out).drop("seq", "ok"))


@query
def rejected_messages(spark, sf_dir):
    """Messages of which some break off: the broken ones, beside the log of the others."""
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    whole = F.to_json(F.struct("*"), exact)
    broken = F.concat(F.lit('{"seq": '), F.col("seq").cast("string"), F.lit(', "conn_id": '))
    sent = demo.session_log(spark, sf_dir).select(F.when(F.col("seq") % 9 == 4, broken).otherwise(whole).alias("value"))
    met = tables.query_log_from_json(sent, malformed="aside").select(F.lit("row").alias("kind"), F.col("seq").cast("string").alias("value"))
    return tables.rejected_messages(sent).select(F.lit("rejected").alias("kind"), "value").unionByName(met)


@query
def reasons(spark, sf_dir):
    return scored_log(spark, sf_dir).select("seq", "reason")


@query
def verdicts(spark, sf_dir):
    return score_log(demo.query_log(spark, sf_dir), context(spark)).select(
        "seq", "listed", "privileged", "risk", "allowed", "alert", "alert_level", "learn", "group_status"
    )


@query
def verdicts_deduplicated(spark, sf_dir):
    """The same verdicts, with statements of one shape analysed once."""
    scored = score_log(demo.query_log(spark, sf_dir), context(spark), deduplicate=True)
    return scored.select("seq", "risk", "allowed", "alert_level", "learn")


# --- joins --------------------------------------------------------------------------------------


@query
def policy_catalog(spark, sf_dir):
    policies = demo.derived(spark, sf_dir, demo.CUSTOMER_POLICY_SQL, "customer")
    endpoints = demo.derived(spark, sf_dir, demo.SUPPLIER_ENDPOINT_SQL, "supplier")
    return po.policy_catalog(policies, endpoints).select("dbpid", "proxy_id", "db_name", "db_type")


@query
def policy_resolution(spark, sf_dir):
    return resolved_log(spark, sf_dir).select(
        "seq", "policy_kind", "policy_proxy_id", "policy_db_name", "perms", "status"
    )


@query
def allowlist_hits(spark, sf_dir):
    flagged = prepare(demo.query_log(spark, sf_dir), context(spark))
    return po.allowlist_hits(flagged).select("seq", "policy_db_name", "pattern")


@query
def allowlist_misses(spark, sf_dir):
    """The same split when the list is too large to broadcast and some patterns are hot."""
    flagged = po.in_allowlist(
        resolved_log(spark, sf_dir), context(spark).allowlist, max_bytes=0, hot_rows=100
    )
    return po.allowlist_misses(flagged).select("seq", "policy_db_name", "pattern")


@query
def allowlist_copartitioned(spark, sf_dir):
    """Log and allowlist stored in buckets of the same keys; the hottest patterns are kept apart."""
    resolved = spark.read.parquet(_stored(resolved_log(spark, sf_dir)))
    log = co.store_resolved(resolved, scratch(spark), BUCKETS, hot_rows=100)
    listed = co.store_allowlist(context(spark).allowlist, scratch(spark), BUCKETS)
    return co.in_stored_allowlist(log, listed).select("seq", "policy_db_name", "pattern", "listed")


@query
def alert_group_copartitioned(spark, sf_dir):
    """Alerts and known groups stored in buckets of the same keys."""
    raised = spark.read.parquet(_stored(al.alerts(scored_log(spark, sf_dir))))
    alerts = co.store_alerts(raised, scratch(spark), BUCKETS, hot_rows=100)
    known = co.store_groups(al.alert_groups(raised.filter("risk >= 45")), scratch(spark), BUCKETS)
    return co.match_stored_groups(alerts, known).select("proxy_id", "db_name", "query", "risk", "known_group")


@query
def match_alert_group(spark, sf_dir):
    raised = raised_groups(spark, sf_dir)
    old = al.alert_groups(raised.filter("risk >= 45"))
    matched = al.match_alert_group(raised, old)
    return matched.groupBy("proxy_id", "db_name", "pattern", "known_group").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def learn_anti(spark, sf_dir):
    return le.learn_anti(le.learned(scored_log(spark, sf_dir)), spark.sql(demo.ALLOWLIST_SQL))


# --- alerts and learning ------------------------------------------------------------------------


@query
def alerts(spark, sf_dir):
    return naive(al.alerts(scored_log(spark, sf_dir)).drop("alertid", "agroupid"))


@query
def alert_groups(spark, sf_dir):
    return naive(al.alert_groups(al.alerts(scored_log(spark, sf_dir))).drop("agroupid"))


@query
def merge_groups(spark, sf_dir):
    raised = raised_groups(spark, sf_dir)
    old = al.alert_groups(raised.filter("risk >= 45"))
    new = al.alert_groups(raised.filter("risk < 45"))
    return naive(al.merge_groups(old, new).drop("agroupid"))


@query
def assign_group_id(spark, sf_dir):
    """Alerts joined with their groups by id."""
    raised = al.alerts(scored_log(spark, sf_dir))
    groups = al.alert_groups(raised).select("agroupid", F.col("status").alias("group_status"))
    return raised.join(groups, "agroupid").groupBy("pattern", "group_status").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def learned_patterns(spark, sf_dir):
    return le.learned(scored_log(spark, sf_dir))


@query
def merge_allowlist(spark, sf_dir):
    return le.merge_allowlist(spark.sql(demo.ALLOWLIST_SQL), le.learned(scored_log(spark, sf_dir)))


def _expired(policies: DataFrame) -> DataFrame:
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    return po.expire_learning(policies, now)


@query
def expire_learning(spark, sf_dir):
    policies = demo.derived(spark, sf_dir, demo.CUSTOMER_POLICY_SQL, "customer")
    return _expired(tables.conform(policies, tables.schemas.POLICY)).select("dbpid", "status")


# --- streaming ----------------------------------------------------------------------------------


BATCHES = 3
# Files, and so tasks, of a micro-batch.
FILES = 4


def _in_files(log: DataFrame, batch: Column, files: int = FILES) -> str:
    """The log as files written one after the other, so that a stream that reads `files` at a time
    has its micro-batches in this order."""
    path = scratch(log.sparkSession)
    for number in range(BATCHES):
        rows = log.filter(batch == number)
        # Every file has rows, so that no micro-batch takes one of the next.
        rows.repartitionById(files, F.pmod(F.xxhash64("seq"), F.lit(files)).cast("int")).write.mode("append").parquet(path)
    return path


def _tables(spark: SparkSession) -> st.Tables:
    root = scratch(spark)
    known = context(spark)
    paths = st.Tables(
        policies=f"{root}/policies", endpoints=f"{root}/endpoints", allowlist=f"{root}/allowlist",
        alerts=f"{root}/alerts", alert_groups=f"{root}/alert_groups", alert_period="year",
    )
    sinks.write_policy(known.policies, paths.policies)
    known.endpoints.write.parquet(paths.endpoints)
    storage.write_part(known.allowlist, paths.allowlist, "job-first")
    return paths


def _stream_into(log: DataFrame, paths: st.Tables) -> None:
    """Score a log as a stream of three micro-batches, at a time when all policies still learn."""
    spark = log.sparkSession
    stream = tables.stream_query_log(spark, _in_files(log, F.col("seq") % BATCHES), max_files=FILES)
    st.run_scoring(
        stream, context(spark).rules, paths, scratch(spark), available_now=True,
        now=F.lit("2020-01-02 00:00:00").cast("timestamp"),
    ).awaitTermination()


def _streamed(spark: SparkSession, sf_dir: str) -> st.Tables:
    paths = _tables(spark)
    _stream_into(demo.query_log(spark, sf_dir), paths)
    return paths


def _streamed_alerts(spark: SparkSession, paths: st.Tables) -> DataFrame:
    return naive(tables.read_alerts(spark, paths.alerts).select(
        "event_time", "risk", "block", "dbuser", "userip", "query", "reason"
    ))


@query
def score_stream(spark, sf_dir):
    """Alerts of a stream: those of the batch, without what was learned in earlier micro-batches."""
    return _streamed_alerts(spark, _streamed(spark, sf_dir))


@query
def two_streams(spark, sf_dir):
    """The logs of two endpoints as streams of their own, one after the other, over the same tables."""
    paths = _tables(spark)
    log = demo.query_log(spark, sf_dir)
    for proxy in (1, 2):
        _stream_into(log.filter(F.col("proxy_id") == proxy), paths)
    return _streamed_alerts(spark, paths)


@query
def refresh_stream(spark, sf_dir):
    """Alerts by micro-batch: what one of them learns is known to the next."""
    raised = tables.read_alerts(spark, _streamed(spark, sf_dir).alerts)
    return raised.groupBy(F.element_at(F.split("part", "-"), -1).cast("int").alias("batch")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def learn_stream(spark, sf_dir):
    """The allowlist after a stream: the same as after the batch."""
    return tables.read_allowlist(spark, _streamed(spark, sf_dir).allowlist)


@query
def group_stream(spark, sf_dir):
    """Alert groups kept by a streaming aggregate over scored statements."""
    path = _in_files(demo.query_log(spark, sf_dir), F.col("seq") % BATCHES)
    log = tables.stream_query_log(spark, path, max_files=FILES)
    raised = al.alerts(st.score_stream(log, context(spark)))
    out = scratch(spark)
    st.run_groups(raised, out, scratch(spark), available_now=True).awaitTermination()
    return naive(tables.read_alert_groups(spark, out).drop("agroupid"))


@query
def session_stream(spark, sf_dir):
    """Session context over micro-batches in order of sequence, carried from one to the next."""
    log = demo.session_log(spark, sf_dir)
    last = log.agg(F.max("seq").alias("last"))  # one row
    batch = F.floor(F.col("seq") * BATCHES / (F.lit(last.first().last or 0) + 1))
    stream = tables.stream_query_log(spark, _in_files(log, batch), max_files=FILES)
    root = scratch(spark)

    def shape(rows: DataFrame, number: int) -> None:
        storage.write_part(st.session_stream(rows, number, f"{root}/sessions"), f"{root}/out", storage.stream_part(number))

    stream.writeStream.foreachBatch(shape).option("checkpointLocation", f"{root}/state").trigger(
        availableNow=True
    ).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select("seq", "conn_id", "command", "db_user", "db_name")


def _timed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of sessions with clocks gone wild and rows without a time."""
    wild = F.when(F.col("seq") % 101 == 50, F.lit("2099-01-01 00:00:00").cast("timestamp"))
    return demo.session_log(spark, sf_dir).withColumn(
        "event_time", wild.when(F.col("seq") % 53 == 7, F.lit(None)).otherwise(F.col("event_time"))
    )


@query
def session_timeouts(spark, sf_dir):
    """Sessions that end when their connection is silent for three hours."""
    shaped = se.with_session_context(_timed_log(spark, sf_dir), idle="3 hours", block=500)
    return shaped.select("seq", "conn_id", "command", "db_user", "db_name")


@query
def session_timers(spark, sf_dir):
    """The same from a stream that delivers rows out of order, and some again in a later micro-batch."""
    log = _timed_log(spark, sf_dir)
    last = log.agg(F.max("seq").alias("seq"), F.max(se.sane_time()).alias("at")).first()  # one row
    late = F.col("seq") + F.pmod(F.xxhash64("seq"), F.lit(20))
    first = F.least(F.floor(late * BATCHES / (F.lit(last.seq or 0) + 1)), F.lit(BATCHES - 1))
    again = F.when(F.col("seq") % 7 == 0, F.array(first, F.least(first + 1, F.lit(BATCHES - 1)))).otherwise(F.array(first))
    path = _in_files(log.withColumn("_batch", F.explode(again)), F.col("_batch"))
    # One row of a far later time, which lets all others go.
    closing = log.limit(1).withColumns({
        "seq": F.lit(last.seq) + 1, "conn_id": F.lit("closing"), "event_time": F.lit(last.at) + F.expr("interval 30 days"),
    })
    closing.write.mode("append").parquet(path)
    shaped = sessions.shaped_stream(tables.stream_query_log(spark, path, max_files=FILES), delay="2 days", idle="3 hours")
    out = scratch(spark)
    shaped.writeStream.format("parquet").option("checkpointLocation", out + "-state").trigger(
        availableNow=True
    ).start(out).awaitTermination()
    found = spark.read.parquet(out).filter("conn_id <> 'closing'")
    return found.select("seq", "conn_id", "command", "db_user", "db_name")


@query
def repeated_rows(spark, sf_dir):
    """Alerts of a log of which every row is delivered twice, the second time in another micro-batch."""
    log = demo.query_log(spark, sf_dir).withColumn("_batch", F.explode(F.array(F.col("seq") % BATCHES, (F.col("seq") + 1) % BATCHES)))
    path = _in_files(log, F.col("_batch"))
    once = tables.without_repeats(tables.stream_query_log(spark, path, max_files=FILES), "10000 days")
    out = scratch(spark)
    al.alerts(st.score_stream(once, context(spark))).writeStream.format("parquet").option(
        "checkpointLocation", out + "-state"
    ).trigger(availableNow=True).start(out).awaitTermination()
    return naive(spark.read.parquet(out).drop("alertid", "agroupid"))
