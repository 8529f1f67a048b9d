"""Streams score a statement once per Arrow batch, with the results of a batch job."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_scored_once import _many
from test_skeleton import _texts

from stmtwatch.operators import risk
from stmtwatch.operators.gathered import gathered, spread
from stmtwatch.plans import catalog, demo
from stmtwatch.plans.scoring import score_log
from stmtwatch.sources import tables
from stmtwatch.streaming.scoring import run_groups, score_stream


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, 700)
    yield
    spark.conf.unset(key)


def _rows(df):
    return sorted(map(repr, df.collect()))


def _stream(log, tmp_path):
    log.write.parquet(f"{tmp_path}/log")
    return tables.stream_query_log(log.sparkSession, f"{tmp_path}/log")


def _run(stream, tmp_path):
    """The rows of a stream."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state")
    query.trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    return stream.sparkSession.read.parquet(f"{tmp_path}/out")


def _odd_log(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [
        (i, start + dt.timedelta(seconds=i) if i % 7 else None, f"c{i % 9}", [1, 2, None][i % 3],
         ["mysql", "pgsql", "mysql", None][i % 4], ["shop", "", None, "lab", "crm"][i % 5], None if i % 11 == 0 else f"u{i % 13}", "query", text)
        for i, text in enumerate(_texts(1500) + ["", None, "x" * 100_000])
    ]
    rows += [(len(rows) + i, start, "c", 1, "mysql", "shop", "u", command, f"d{i % 3}") for i, command in enumerate(["create_db", "drop_db", "ping", "field_list"] * 3)]
    return spark.createDataFrame(
        rows, "seq long, event_time timestamp, conn_id string, proxy_id int, db_type string, db_name string, db_user string, command string, query string"
    ).withColumn("user_ip", F.lit("10.0.0.1"))


def test_gathered_rows_come_back(spark, small_batches):
    log = _odd_log(spark)
    groups = gathered(log, ["proxy_id", "db_type", "db_name"])
    assert _rows(spread(groups, log).select(*log.columns)) == _rows(log)
    assert groups.count() < log.count() / 5


@pytest.mark.parametrize("bytes_of_tables", [None, 1 << 40])
def test_a_stream_scores_as_a_batch_does(spark, tmp_path, small_batches, bytes_of_tables):
    """Also when policies and allowlist are too large for a broadcast."""
    stream = _stream(_odd_log(spark), tmp_path)
    known = catalog.context(spark, policy_bytes=bytes_of_tables, allowlist_bytes=bytes_of_tables)
    batch = score_log(tables.read_query_log(spark, f"{tmp_path}/log"), catalog.context(spark))
    scored = score_stream(stream, known)
    assert scored.columns == batch.columns
    assert scored.dtypes == batch.dtypes
    want, got = _rows(batch), _rows(_run(scored, tmp_path).select(*batch.columns))
    assert len(want) > 2000 and got == want


def test_a_stream_analyses_alike_statements_once(spark, sf_dir, tmp_path, monkeypatch):
    whole = risk.outline_flags
    monkeypatch.setattr(risk, "outline_flags", lambda df, rules: whole(df.observe("analysed", F.count(F.lit(1)).alias("n")), rules))
    log = _stream(_many(spark, demo.query_log(spark, sf_dir)).coalesce(1), tmp_path)
    query = run_groups(catalog.al.alerts(score_stream(log, catalog.context(spark))), f"{tmp_path}/groups", f"{tmp_path}/state", available_now=True)
    query.awaitTermination()
    analysed = [p.observedMetrics["analysed"].n for p in query.recentProgress if "analysed" in p.observedMetrics]
    assert sum(p.numInputRows for p in query.recentProgress) == 3000
    assert 0 < sum(analysed) <= 3


def test_a_watermark_outlasts_the_scoring(spark, tmp_path):
    """Hours of alerts can be counted behind it, in append mode."""
    log = _stream(_odd_log(spark).filter("event_time is not null"), tmp_path).withWatermark("event_time", "1 second")
    hours = score_stream(log, catalog.context(spark)).groupBy(F.window("event_time", "1 minute")).count()
    assert 0 < _run(hours.select("window.start", "count"), tmp_path).count()
