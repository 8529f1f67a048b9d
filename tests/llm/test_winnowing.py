"""Winnowing against a plain loop over windows, and documents against their edited versions."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from stmtwatch.llm import queries, winnowing

PRIME, BASE = winnowing.PRIME, winnowing.BASE


def signed_hashes(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "w string")
    return {r.w: r.h for r in df.select("w", F.xxhash64("w").alias("h")).collect()}


def symbols(text, longest=16):
    return re.findall(r"[^\x20\x09-\x0D]{1,%d}" % longest, text or "")


def positions(hashes, k, window):
    """Positions that winnowing keeps: a rolling hash, then every window on its own."""
    if not hashes:
        return []
    if len(hashes) < k:
        return [0]
    values, value, top = [], 0, pow(BASE, k - 1, PRIME)
    for i, h in enumerate(hashes):
        if i >= k:
            value -= hashes[i - k] % PRIME * top
        value = (value * BASE + h % PRIME) % PRIME
        if i >= k - 1:
            values.append(value)
    kept = []
    for start in range(max(len(values) - window + 1, 1)):
        inside = range(start, min(start + window, len(values)))
        best = min(inside, key=lambda i: (values[i], -i))
        if best not in kept:
            kept.append(best)
    return kept


TEXTS = [
    None, "", "  \n", "one", "a b c d", "a b c d e", "a b c d e f", " ".join("abcdefghijklmnopqrstuvwxyz"),
    "x " * 50, "y" * 200, "😀 ñandú\x1cz " * 30, " ".join(str(i * i % 17) for i in range(300)),
    " ".join(str(i) for i in range(5000)),
]


@pytest.mark.parametrize("k,window", [(5, 8), (1, 1), (3, 5), (2, 7)])
def test_fingerprint_equals_a_loop(spark, k, window):
    hashes = signed_hashes(spark, {s for t in TEXTS for s in symbols(t)})
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    got = {r.i: r.fingerprint for r in winnowing.with_fingerprint(df, k=k, window=window).collect()}
    for i, text in enumerate(TEXTS):
        want = positions([hashes[s] for s in symbols(text)], k, window)
        assert [p.position for p in got[i]] == want, text
        by_gram = {}
        for p in got[i]:
            gram = tuple(symbols(text)[p.position: p.position + k])
            assert by_gram.setdefault(gram, p.hash) == p.hash
        assert len(set(by_gram.values())) == len(by_gram)


def test_match_guarantee(spark):
    """A shared run of window + k - 1 symbols is found wherever it lies."""
    run = [f"r{i}" for i in range(12)]
    rows = [(i, " ".join([f"p{i}-{j}" for j in range(i)] + run + [f"q{i}-{j}" for j in range(3 * i)])) for i in range(20)]
    prints = [
        {p.hash for p in r.fingerprint}
        for r in winnowing.with_fingerprint(spark.createDataFrame(rows, "i int, text string")).collect()
    ]
    assert all(a & b for a in prints for b in prints)


def edited(rows):
    """(key, text) -> edited text, over distinct documents; null keys last, of one key by a hash."""
    out = {}
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 3
        out[key, text] = text[: len(text) - cut] + after[:cut]
    return out


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    order = sorted(((r.doc_id, r.text or "") for r in docs), reverse=True)
    want = {key: (len(text), hashlib.sha256(e.encode()).hexdigest()) for (key, text), e in edited(order).items()}
    rows = queries.QUERIES["op11_winnowing"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == want and len(rows) == len(docs)
    text = dict(order)
    prints = {}
    following = {a: b for (a, _), (b, _) in zip(order, order[1:] + order[:1])}
    hashes = lambda s: {p.split(":")[0] for p in s.split(",") if p}
    by_key = {r.doc_id: r for r in rows}
    for r in rows:
        assert prints.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
        for near, other in ((r.near_edited, r.edited_fingerprint), (r.near_next, by_key[following[r.doc_id]].fingerprint)):
            a, b = hashes(r.fingerprint), hashes(other)
            assert near == pytest.approx(2 * len(a & b) / (len(a) + len(b)) if a or b else 1)
    long = [r for r in rows if r.n_chars > 1000]
    assert sum(r.near_edited > 0.45 for r in long) > 0.97 * len(long)
    assert sum(r.near_edited > r.near_next + 0.2 for r in long) > 0.97 * len(long)


def test_odd_tables(spark):
    rows = [(3, "abc def ghi", 1), (3, "abc def ghi", 1), (None, "nul l", 2), (None, None, 2), (5, "", 0), (7, "é" * 9, 3), (3, "zzz", 4)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_chars int").withColumn("copies", F.lit(1)).withColumn("hash", F.lit("x"))
    found = winnowing.edited_fingerprints(docs)
    got = found.collect()
    assert found.schema["doc_id"].dataType.typeName() == "integer" and len(got) == len(rows)
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == sorted((k or 0, len(t or "")) for k, t, _ in rows)
    seven = [r for r in got if r.doc_id == 7][0]
    assert seven.edited == "é" * 6  # the next one, 5, is empty
    same = [r for r in got if r.doc_id == 3 and r.n_chars == 11]
    assert len(same) == 2 and same[0] == same[1]
    last = [r for r in got if r.doc_id is None]
    assert {r.edited for r in last if r.n_chars == 5} <= {"nul é", "nul "}  # the next one is 7 or the empty one
    assert winnowing.edited_fingerprints(docs.filter("false")).count() == 0
    alone = winnowing.edited_fingerprints(docs.filter("doc_id = 7")).collect()
    assert [r.edited for r in alone] == ["é" * 9] and alone[0].near_next == 1


def test_many_copies(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "PIECE", 10)
    rows = [(1, "a b c")] * 57 + [(2, "d e f")] * 10 + [(3, "g")]
    got = winnowing.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id").count().collect()
    assert sorted(map(tuple, got)) == [(1, 57), (2, 10), (3, 1)]


def test_texts_move_once(spark, sf_dir):
    """Both joins read one exchange of the texts."""
    df = winnowing.edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    rows = df.collect()
    assert rows and "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
