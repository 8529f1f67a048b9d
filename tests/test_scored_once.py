"""Statements of a log are scored once, and analysed once by shape."""

import os

import pytest
from pyspark.sql import functions as F

from stmtwatch.operators import risk
from stmtwatch.plans import catalog, demo
from stmtwatch.streaming import scoring


@pytest.fixture
def analysed(monkeypatch):
    """The numbers of statements that were analysed, one by one."""
    counts, whole = [], risk.outline_flags

    def counted(df, rules):
        counts.append(df.count())
        return whole(df, rules)

    monkeypatch.setattr(risk, "outline_flags", counted)
    return counts


def _many(spark, log):
    """The same statements about three thousand other numbers."""
    number = F.regexp_replace("query", r"(?<== ?)[0-9]+$", "")
    return log.filter("query like 'SELECT * FROM lineitem%'").limit(1).crossJoin(spark.range(3000)).withColumns({
        "seq": F.col("id"), "query": F.concat(number, F.col("id").cast("string")),
    }).drop("id")


def test_a_micro_batch_analyses_each_shape_once(spark, sf_dir, rules, analysed):
    paths = catalog._tables(spark)
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    scoring.score_batch(rules, paths)(_many(spark, demo.query_log(spark, sf_dir)), 0)
    assert analysed == [1]
    assert set(os.listdir(shared)) == before, "the table of flags goes with the micro-batch"


@pytest.mark.parametrize("name", ["match_alert_group", "merge_groups"])
def test_groups_are_made_of_alerts_scored_once(spark, sf_dir, name):
    files = catalog.QUERIES[name](spark, sf_dir).inputFiles()
    assert files and not [f for f in files if f.endswith("orders.parquet")]
