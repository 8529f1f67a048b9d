"""Exact and SimHash deduplication, and components, against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stmtwatch.llm import components, exact_dedup, simhash

ODD = "doc_id long, text string, row string, sha string, best int, n int, _key int"


def odd(spark):
    rows = [(1, None), (2, ""), (None, ""), (3, "a b"), (3, "a b"), (4, "a b"), (5, "x" * 100_000), (None, "only one"), (6, " ")]
    return spark.createDataFrame([(*r, "r", "s", 1, 2, 3) for r in rows], ODD)


@pytest.mark.parametrize("bits", [exact_dedup.FILTER_BITS, 1 << 13])
def test_exact_groups(spark, bits):
    rows = exact_dedup.exact_duplicates(odd(spark), filter_bits=bits).collect()
    groups = defaultdict(list)
    for r in odd(spark).collect():
        groups[hashlib.sha256((r.text or "").encode()).hexdigest()].append(r.doc_id)
    assert len(rows) == 9
    for r in rows:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    kept = [r.text_sha256 for r in rows if r.kept]
    assert sorted(kept) == sorted(groups)
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_exact_keeps_rows_and_columns(spark):
    docs = odd(spark)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.text or "", r.doc_id or 0) for r in kept.collect()) == [
        ("", 2), (" ", 6), ("a b", 4), ("only one", 0), ("x" * 100_000, 5)
    ]
    assert exact_dedup.drop_exact_duplicates(docs.filter("false")).count() == 0
    assert exact_dedup.exact_duplicates(docs.filter("false")).count() == 0


def test_only_possible_rows_shuffle(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows = docs.select("doc_id", F.sha2("text", 256).alias("sha"))
    flagged = exact_dedup.with_possible(rows, exact_dedup.repeated_filter(rows))
    assert flagged.filter("possible").count() == 0
    assert "Exchange hashpartitioning(sha" not in flagged._jdf.queryExecution().toString()


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5000, 5000)]
    edges += [(r.randrange(2000, 2600), r.randrange(2000, 2600)) for _ in range(350)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    r.shuffle(edges)
    found = components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {n.node: n.root for n in found} == {x: find(x) for x in linked}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def slow_fingerprint(text, shingle=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in lower.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    grams = [" ".join(words[i: i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark, sf_dir):
    texts = ["", "a", "A\x1cb é", "one TWO three four five", *[r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]]
    for text in texts:
        assert simhash.fingerprint(text) & (2**64 - 1) == slow_fingerprint(text)


def brute_components(fps, distance):
    fps = np.array(fps, np.int64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= distance) + i + 1:
            root[find(int(j))] = find(i)
    groups = defaultdict(set)
    for i in range(len(fps)):
        groups[find(i)].add(int(fps[i]))
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("distance", [0, 1, 3, 4, 5])
def test_links_lose_nothing(spark, distance):
    r = random.Random(distance)
    fps = [r.getrandbits(64) for _ in range(300)]
    for base in fps[:40]:  # chains and dense clusters
        for _ in range(r.choice([1, 3, 40])):
            base ^= sum(1 << b for b in {r.randrange(64) for _ in range(r.randint(1, max(1, distance)))})
            fps.append(base)
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fingerprint long"), distance)
    found = defaultdict(set)
    for n in components.connected_components(edges).collect():
        found[n.root].add(n.node)
    assert {frozenset(g) for g in found.values()} == brute_components(fps, distance)


def test_near_duplicates(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = simhash.near_duplicates(docs).collect()
    groups = brute_components([r.fingerprint for r in rows], 4)
    by = defaultdict(list)
    for r in rows:
        by[r.fingerprint].append(r.doc_id)
    want = {f: min(by[f]) for f in by}
    for g in groups:
        want |= dict.fromkeys(g, min(i for f in g for i in by[f]))
    assert len(rows) == docs.count() and all(r.component_id == want[r.fingerprint] for r in rows)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_near_duplicates_of_odd_tables(spark):
    docs = odd(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == 9
    by = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    assert by[2, 0] == 1 and by[6, 0] == 1
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "5", "None"]
    assert simhash.near_duplicates(docs.filter("false")).count() == 0
    assert simhash.drop_near_duplicates(docs.filter("false")).count() == 0
