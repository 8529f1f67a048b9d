"""Stored look-ups: the plan moves neither side, and the rows are those of a plain left join."""

import random

import pytest
from pyspark.sql import functions as F

from stmtwatch.operators import copartitioned as co
from stmtwatch.operators import policy as po
from stmtwatch.plans import catalog, demo
from stmtwatch.sources import buckets as bu
from stmtwatch.sources.storage import scratch_folder


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _moved(plan):
    return [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]


def _two(spark, hot_rows=40):
    made = random.Random(3)
    names = ["hot", "x'y", "", None, *[f"name {i}" for i in range(60)]]
    rows = [(i, made.choice(names) if i % 3 else "hot", made.choice([1, 2, None]), "é" * (i % 7)) for i in range(900)]
    left = spark.createDataFrame(rows, "id long, name string, proxy int, `odd ``column` string")
    listed = [(n, p, i) for i, (n, p) in enumerate((n, p) for n in names for p in (1, 2, None)) if i % 2 == 0]
    right = spark.createDataFrame(listed, "name string, proxy int, mark int")
    keys = ["name", "proxy"]
    return (
        left, right, bu.store_bucketed(left, keys, scratch_folder(spark), 4, hot_rows),
        bu.store_bucketed(right, keys, scratch_folder(spark), 4, hot_rows),
    )


def _rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_bucketed_lookup_is_a_left_join_without_an_exchange(spark):
    left, right, stored, listed = _two(spark)
    found = bu.bucketed_lookup(stored, listed)
    assert _rows(found.select("id", "mark")) == _rows(
        left.join(right, ["name", "proxy"], "left").select("id", "mark")
    )
    assert set(found.columns) == {*left.columns, "mark"}
    assert not _moved(_plan(found)), _plan(found)
    assert "SortMergeJoin" in _plan(found)


def test_hot_and_null_keys_stay_out_of_the_buckets(spark):
    left, _, stored, _ = _two(spark)
    apart = stored.apart
    assert apart.filter("proxy is not null and name = 'hot'").count() == left.filter("name = 'hot' and proxy is not null").count()
    assert stored.rows.filter("name is null or proxy is null or name = 'hot'").count() == 0
    assert stored.whole().count() == left.count()


def test_a_stored_table_is_opened_again(spark):
    path = scratch_folder(spark)
    first = bu.store_bucketed(spark.range(100).withColumn("v", F.col("id") * 2), ["id"], path, 2)
    again = bu.open_bucketed(spark.newSession(), path)
    assert (again.keys, again.buckets) == (first.keys, first.buckets)
    assert _rows(again.whole()) == _rows(first.whole())


def test_unlike_and_empty_tables(spark):
    left, right, stored, listed = _two(spark)
    other = bu.store_bucketed(right, ["name", "proxy"], scratch_folder(spark), 8)
    with pytest.raises(ValueError, match="unlike"):
        bu.bucketed_lookup(stored, other)
    nothing = bu.store_bucketed(right.limit(0), ["name", "proxy"], scratch_folder(spark), 4)
    assert bu.bucketed_lookup(stored, nothing).filter("mark is null").count() == left.count()
    assert bu.bucketed_lookup(nothing, bu.store_bucketed(
        right.select("name", "proxy", F.lit(1).alias("m")), ["name", "proxy"], scratch_folder(spark), 4)).count() == 0


def test_buckets_follow_the_size():
    assert bu.buckets_for(0) == 1
    assert bu.buckets_for(10 << 40) == 65536


def test_stored_allowlist_equals_the_plain_one(spark, sf_dir):
    path = scratch_folder(spark)
    catalog.resolved_log(spark, sf_dir).write.parquet(path)
    resolved, listed = spark.read.parquet(path), catalog.context(spark).allowlist
    plain = po.in_allowlist(resolved, listed)
    stored = co.in_stored_allowlist(
        co.store_resolved(resolved, scratch_folder(spark), 4, hot_rows=50), co.store_allowlist(listed, scratch_folder(spark), 4)
    )
    assert stored.columns == plain.columns
    assert stored.exceptAll(plain).count() == 0 and plain.exceptAll(stored).count() == 0
    assert 0 < plain.filter("listed").count() < plain.count()
    assert not _moved(_plan(stored))
