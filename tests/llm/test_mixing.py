"""Targets, the splitting tree and what documents contribute."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stmtwatch.llm import mixing


def wanted_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Reshare until none is above; sources in order, None last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, rest, out = set(order), share * sum(sizes.values()), {}
    while left:
        scale = rest / sum(weight[s] for s in left)
        full = {s for s in left if scale * weight[s] >= most * sizes[s]}
        if not full:
            return out | {s: scale * weight[s] for s in left}
        for s in full:
            out[s] = most * sizes[s]
            rest -= out[s]
        left -= full
    return out


def check(rows, docs):
    sizes, targets, taken = defaultdict(int), {}, defaultdict(int)
    for d in docs:
        sizes[d["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        assert r.source_size == sizes[r.source]
        targets[r.source] = r.target
        taken[r.source] += r.taken
    want = wanted_targets(sizes)
    for s in sizes:
        assert targets[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 0.5


def taken(docs, **options):
    mixed = mixing.mix(docs.withColumn("row_id", F.monotonically_increasing_id()), **options)
    return mixed.groupBy("row.row_id").agg(
        F.first("row.source").alias("source"), F.first("row.doc_id").alias("doc_id"), F.first("size").alias("size"),
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("words").alias("taken"),
    )


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = taken(docs, block_words=100).collect()
    assert len(rows) == docs.count()
    check(rows, [r.asDict() for r in docs.collect()])
    again = taken(docs.repartition(7), block_words=100).collect()
    assert Counter((r.doc_id, r.taken) for r in rows) == Counter((r.doc_id, r.taken) for r in again)


def test_odd_tables(spark):
    rows = [(1, "a", None), (2, "a", ""), (3, None, "x y z"), (3, None, "x y z"), (None, "b", "w " * 5000), (5, "", "q\x1cq \x0b r"), (6, "c", " ")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, size int, rank int")
    check(taken(docs).collect(), [r.asDict() for r in docs.collect()])
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len((r.text or "").split())
    assert words["b"] == round(wanted_targets({"a": 0, None: 6, "b": 5000, "": 2, "c": 0})["b"])
    assert mixing.mix(docs.filter("false")).count() == 0 and mixing.mixed_documents(docs.filter("false")).count() == 0
    empty = docs.filter("doc_id in (1, 2, 6)")
    assert [r.taken for r in taken(empty).collect()] == [0, 0, 0]


def test_tree_takes_every_block_once(spark):
    quotas = spark.createDataFrame([(0, 5000), (1, 1), (2, 0), (3, 260)], "rank int, blocks long")
    blocks = mixing.drawn_blocks(quotas, 16).collect()
    assert Counter((b["rank"], b.block) for b in blocks) == Counter((r, b) for r, n in ((0, 5000), (1, 1), (3, 260)) for b in range(n))
    sizes = Counter(b.shard for b in blocks)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1


@pytest.mark.parametrize("good,bad,sample", [(7, 12, 5), (400, 600, 500), (30, 900, 200), (900, 30, 880)])
def test_draws_are_hypergeometric(spark, good, bad, sample):
    n = 4000
    values = [r.k for r in spark.range(n).select(F.expr(
        mixing.hypergeometric(f"{good}L", f"{bad}L", f"{sample}L", "id")
    ).alias("k")).collect()]
    total = good + bad
    mean = sample * good / total
    variance = mean * (bad / total) * (total - sample) / (total - 1)
    assert min(values) >= max(0, sample - bad) and max(values) <= min(good, sample)
    assert abs(np.mean(values) - mean) < 5 * (variance / n) ** 0.5
    assert abs(np.var(values) / variance - 1) < 0.15


def test_shards_are_whole_and_shuffled(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mixing.mix(docs, block_words=200, shards=8)
    rows = mixing.in_order(mixed).select("shard", "place", F.spark_partition_id().alias("task")).collect()
    assert {r.shard for r in rows} == set(range(8))
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append((r.task, r.place))
    for inside in places.values():
        assert len({t for t, _ in inside}) == 1 and inside == sorted(inside)
