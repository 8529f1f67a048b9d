"""Headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stmtwatch.functions import signals as S
from stmtwatch.functions.fingerprint import with_pattern
from stmtwatch.operators import alerts as al
from stmtwatch.operators import risk as rk
from stmtwatch.operators import session as se
from stmtwatch.operators.policy import resolve_policy
from stmtwatch.plans import catalog, demo
from stmtwatch.plans.scoring import score_log
from stmtwatch.sources import storage

RUNS = 3


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="stmtwatch-bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def run(df: DataFrame) -> None:
    """Compute every column of every row."""
    df.write.format("noop").mode("overwrite").save()


def stored(df: DataFrame, files: int = 16) -> DataFrame:
    path = storage.scratch_folder(df.sparkSession)
    df.repartition(files).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    fresh = catalog.context(spark)

    log = stored(demo.query_log(spark, sf_dir))
    probes = stored(demo.probe_log(spark, sf_dir))
    sessions = stored(demo.session_log(spark, sf_dir))
    resolved = resolve_policy(
        with_pattern(se.inspectable(se.command_to_sql(log))), fresh.policies, fresh.endpoints
    )
    listed = stored(resolved.select(
        F.col("policy_proxy_id").alias("proxy_id"), F.lit(1).alias("perm"),
        F.col("policy_db_name").alias("db_name"), F.col("pattern").alias("query"),
    ).distinct(), 1)
    known = catalog.context(spark, allowlist=listed)
    # Without the pattern of the fewest statements that make up one in a hundred.
    counts = with_pattern(log).groupBy("pattern").count().withColumn(
        "before", F.sum("count").over(Window.orderBy("count", "pattern").rowsBetween(Window.unboundedPreceding, 0))
    )
    rare = counts.filter(F.col("before") * 100 <= log.count()).select(F.col("pattern").alias("query"))
    nearly = catalog.context(spark, allowlist=stored(listed.join(rare, "query", "left_anti"), 1))
    raised = stored(al.alerts(score_log(log, fresh)))
    groups = stored(al.alert_groups(raised), 1)

    queries = {
        "fingerprint": lambda: with_pattern(log),
        "fingerprint_probes": lambda: with_pattern(probes),
        "fingerprint_counts": lambda: with_pattern(log).groupBy("pattern").count(),
        "signal_probes": lambda: rk.with_signals(probes, fresh.rules).select("seq", *S.FLAGS),
        "signal_probes_by_outline": lambda: rk.with_signals_by_outline(
            probes, fresh.rules
        ).select("seq", *S.FLAGS),
        "verdicts_none_listed": lambda: score_log(log, catalog.context(
            spark, allowlist=fresh.allowlist.filter("perm < 0")
        )),
        "verdicts_all_listed": lambda: score_log(log, known),
        "verdicts_99_listed": lambda: score_log(log, nearly),
        "verdicts_deduplicated": lambda: score_log(log, fresh, deduplicate=True),
        "alert_groups": lambda: al.alert_groups(raised),
        "merge_groups": lambda: al.merge_groups(groups, al.alert_groups(raised)),
        "session_context": lambda: se.with_session_context(sessions),
        "score_stream": lambda: catalog.QUERIES["score_stream"](spark, sf_dir),
    }
    times, rates = {}, {}
    sizes = {"fingerprint": log, "fingerprint_probes": probes, "signal_probes": probes,
             "signal_probes_by_outline": probes,
             "verdicts_none_listed": log, "verdicts_all_listed": log, "verdicts_99_listed": log, "verdicts_deduplicated": log}
    for name, build in queries.items():
        taken = []
        for _ in range(1 if name.endswith("stream") else RUNS + 1):  # the first run warms up
            start = time.perf_counter()
            run(build())
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:] or taken), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    for name, source in sizes.items():
        rates[name] = round(source.count() / times[name])
    print(json.dumps({
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "statements_per_sec": rates,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
