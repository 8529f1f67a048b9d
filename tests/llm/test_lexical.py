"""Ranked search against plain integer scoring, with buckets small enough that all of them prune."""

import math
import re
from collections import Counter

import oracle
import pytest

from stmtwatch.llm import lexical, queries

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def plain(docs, items, top=10):
    counts = [(key, Counter(words(text))) for key, text in docs]
    held = [c for _, c in counts if c]
    n_docs, all_terms = len(held), sum(sum(c.values()) for c in held)
    df = Counter(t for c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for key, c in counts:
            n = sum(c.values())
            total = 0
            for t, times in Counter(words(text)).items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 75 + 75 * n * n_docs // all_terms
                    total += times * w * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
            if total > 0:
                scored.append((-total, key is None, key or 0))
        out += [(item, i + 1, None if none else key, -s) for i, (s, none, key) in enumerate(sorted(scored)[:top])]
    return Counter(out)


@pytest.fixture
def tables(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return read("documents"), read("benchmark")


def test_query_equals_sql(spark, sf_dir):
    name = "op12_lexical"
    assert oracle.difference(queries.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), queries.ORACLES[name]) is None


@pytest.mark.parametrize("first,bucket,focus,most", [(1, 3, 0.9, 10**6), (7, 16, 0.3, 100), (256, 4096, 0.99, 1)])
def test_small_buckets(spark, tables, monkeypatch, first, bucket, focus, most):
    docs, items = tables
    for name, value in (("FIRST", first), ("BUCKET", bucket), ("FOCUS", focus)):
        monkeypatch.setattr(lexical, name, value)
    items = items.limit(12)
    want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    got = lexical.search(docs.repartition(3), items, most_terms=most).collect()
    assert Counter(map(tuple, got)) == want


def test_bounds_skip_work(spark, monkeypatch):
    """Vectors that cannot reach the k-th best score are never scored to the end."""
    items = lexical.Items(["rare common"])
    items.weigh(1000, lexical.np.array([1, 900]))
    np = lexical.np
    impacts = np.array([900, 800, 500, 2, 1], np.int64) * 1000
    bucket = lexical.Bucket(
        np.arange(5), None, impacts.astype(float), np.array([0, 1, 0, 1, 1]), impacts, np.ones(5, np.int64), 2
    )
    best = int(items.weights[0][0] * 900_000)
    place, score = bucket.search(items, 0, best)
    assert place.tolist() == [0] and score.tolist() == [best]
    assert not len(bucket.search(items, 0, best * 10)[0])


def test_odd_tables(spark):
    rows = [
        (1, "Ünï unï ÜNÏ a-b_c 12", "x"), (2, None, "x"), (3, "", "x"), (4, "... ###", "x"), (None, "a b", "x"), (5, "a b", "x"),
        (5, "a b", "x"), (6, "a " * 20000 + "zebra", "x"), (7, "b\x00zebra\x7fa", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    items = [(10, "A b"), (10, "A b"), (11, None), (12, "zebra zebra unï"), (None, "12"), (13, "nowhere")]
    queries_ = spark.createDataFrame(items, "item_id long, text string")
    want = plain([(k, t) for k, t, _ in rows], items, top=3)
    assert Counter(map(tuple, lexical.search(docs, queries_, top=3).collect())) == want
    assert lexical.search(docs.filter("false"), queries_).count() == 0
    none = lexical.search(docs, queries_.filter("false"))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_ties_go_to_the_smallest_key(spark):
    rows = [(i, "same words") for i in range(300, 0, -1)] + [(i, "other") for i in range(301, 1000)]
    items = spark.createDataFrame([(1, "same")], "item_id int, text string")
    got = lexical.search(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), items)
    assert [r.doc_id for r in got.orderBy("rank").collect()] == list(range(1, 11))
