"""Fitted operators: held-out accuracy, brute force on their plain parts, odd tables."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from stmtwatch.llm import fertility, importance, queries, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [(1, None), (1, None), (None, ""), (2, "a"), (2, "a"), (3, "word " * 30_000), (4, "日本 " * 60)]


def odd(spark):
    return spark.createDataFrame([(*r, 0.5, "x") for r in ODD], "doc_id long, text string, score double, label string")


@pytest.fixture(scope="module")
def large():
    return "/root/testdata/sf0.01"


def test_importance_keeps_good_documents(spark, large):
    rows = queries.op8_importance(spark, large).join(spark.read.parquet(f"{large}/labels.parquet"), "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.35


def test_importance_by_hand(spark):
    docs = [(i, "good words here" if i % 3 else "### $$$") for i in range(60)]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 60, 2)]
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    ratio = importance.fit(frame, marks)
    B = importance.BUCKETS
    raw, target = np.zeros(B), np.zeros(B)
    for i, t in docs:
        np.add.at(raw, importance.hashed_ngrams(t), 1)
        if (i, 1) in labels:
            np.add.at(target, importance.hashed_ngrams(t), 1)
    share = (raw + 1) / (raw + 1).sum()
    want = np.log((target + importance.SMOOTHING * B * share) / (target.sum() + importance.SMOOTHING * B) / share)
    assert np.allclose(ratio, want)
    out = importance.importance_sample(frame, marks, k=40).collect()
    ranked = sorted((r.noisy for r in out), reverse=True)
    assert [r.kept for r in out] == [r.noisy >= ranked[39] for r in out]


def test_kth_largest(spark):
    values = [random.Random(1).gauss(0, 1) for _ in range(5000)] + [0.25] * 3000
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 17, 4000, 8000):
        assert importance.kth_largest(frame, "v", k, few=10) == sorted(values, reverse=True)[k - 1]


def test_importance_of_odd_tables(spark):
    docs, labels = odd(spark), spark.createDataFrame([(1, 1), (None, 1), (2, None), (3, 0), (3, 1)], "doc_id long, quality int")
    assert importance.importance_sample(docs, labels).count() == len(ODD)
    kept = importance.sampled_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(ODD)
    for none in (docs.filter("false"), docs):
        assert importance.sampled_documents(none, labels.filter("false")).count() == none.count()


def test_toxicity_on_held_out(spark, large):
    rows = queries.op3_toxicity(spark, large).join(spark.read.parquet(f"{large}/labels.parquet"), "doc_id").filter("held_out").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits / max(1, sum(r.predicted for r in rows)) > 0.7 and hits / sum(r.toxic for r in rows) > 0.55
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_pools_like_a_loop():
    r = np.random.default_rng(0)
    docs = [r.integers(0, 64 ** 3, n) for n in (0, 1, 2, 3, 40)]
    model = toxicity.Model(
        r.normal(size=(3, 64, 4)).astype(np.float32), [r.normal(size=(w, 4, 3)).astype(np.float32) for w in toxicity.WIDTHS],
        r.normal(size=9).astype(np.float32), r.normal(size=9).astype(np.float32), 0.3,
    )
    for doc, got in zip(docs, model.logits(docs)):
        vectors = [model.tables[0][x // 4096] + model.tables[1][x // 64 % 64] + model.tables[2][x % 64] for x in doc] or [np.zeros(4)]
        padded = vectors + [np.zeros(4)] * 2
        pooled = np.concatenate([
            np.max([sum(padded[i + j] @ taps[j] for j in range(len(taps))) for i in range(len(vectors))], axis=0) for taps in model.filters
        ])
        assert got == pytest.approx(np.maximum(pooled + model.bias, 0) @ model.weights + 0.3, abs=1e-4)


def test_toxicity_of_odd_tables(spark):
    docs, labels = odd(spark), spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    for marks in (labels, labels.filter("toxic = 1"), labels.filter("false")):
        scored = toxicity.with_score(docs, toxicity.fit(docs, marks))
        assert scored.count() == len(ODD) and scored.filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.with_score(docs.filter("false"), toxicity.fit(docs, labels)).count() == 0


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = [tuple(words[i: i + 3]) for i in range(len(words) - 2)]
    n = Counter(triples)
    inside = {i + k for i, t in enumerate(triples) if n[t] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_base_counts(spark, sf_dir):
    texts = ["", "a b c a b c", "x\n\nx\n \n \nx\r", "a\x1cb # | é\x85c a", "a a a a a", "😀 <b>"]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for text in texts:
        assert fertility.base_counts(text) == slow_counts(text)


def test_fertility(spark, large):
    rows = queries.op7_fertility(spark, large).join(spark.read.parquet(f"{large}/labels.parquet"), "doc_id").collect()
    assert all(not r.base_failed for r in rows if r.kept)
    clean = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert np.mean([r.kept for r in clean]) > 0.995
    docs = spark.createDataFrame([(1, "the cat sat on the mat and looked at the dog " * 2 + "while others slept all day long in some quiet corner of a house where nobody lived since the old man went away to sea"),
                                  (2, " ".join(f"{chr(0x1200 + i % 300)}" for i in range(99))), (3, "qx " * 200)], "doc_id long, text string")
    got = {r.doc_id: r for r in fertility.quality_rules(docs, MODEL).collect()}
    assert got[2].script == "other" and got[2].byte_share > 0.6 and got[3].base_failed


def test_fertility_against_plain_python(spark, large):
    """Measures, quartile fences and verdicts, computed a second time without Spark."""
    import math
    from collections import Counter, defaultdict

    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet(f"{large}/documents.parquet")
    texts = {r.doc_id: r for r in docs.select("doc_id", "text", "lang").collect()}
    got = fertility.quality_rules(docs, MODEL, min_texts=20).collect()
    assert len(got) == len(texts)
    groups = defaultdict(list)
    for r in got:
        text, ids = texts[r.doc_id].text or "", pieces.encode(texts[r.doc_id].text or "")
        fallback = [i for i in ids if pieces.is_byte(i) and pieces.id_to_piece(i) not in ("<0x09>", "<0x0A>", "<0x0D>")]
        counts = Counter(ids).values()
        entropy = -sum(n / len(ids) * math.log(n / len(ids)) for n in counts)
        assert r.n_tokens == len(ids)
        if len(ids) > 1:
            assert r.chars_per_token == pytest.approx(len(text) / len(ids))
            assert r.byte_share == pytest.approx(len(fallback) / len(ids))
            assert r.entropy == pytest.approx(entropy / math.log(min(len(ids), fertility.ENTROPY_TOKENS)))
        if not r.base_failed:
            language = texts[r.doc_id].lang or r.script
            groups[language, int(math.log2(r.n_tokens))].append(r)
            groups[language].append(r)
    fences = {}
    for key, rows in groups.items():
        if len(rows) >= 20:
            for m in fertility.MEASURES:
                values = sorted(r[m] for r in rows)
                a, b = (values[math.ceil(len(values) * q) - 1] for q in (0.25, 0.75))
                fences[key, m] = a - fertility.SPREAD * (b - a), b + fertility.SPREAD * (b - a)
    for r in got:
        language = texts[r.doc_id].lang or r.script
        key = (language, int(math.log2(max(1, r.n_tokens))))
        key = key if (key, "entropy") in fences else language
        low = {m: fences.get((key, m), (-math.inf, math.inf)) for m in fertility.MEASURES}
        expected = [
            *["low_chars_per_token"] * (r.chars_per_token < low["chars_per_token"][0] - 1e-12),
            *["high_chars_per_token"] * (r.chars_per_token > low["chars_per_token"][1] + 1e-12),
            *["high_byte_share"] * (r.byte_share > low["byte_share"][1] + 1e-12),
            *["low_entropy"] * (r.entropy < low["entropy"][0] - 1e-12),
        ]
        assert [b for b in r.left_bands if "_" in b and b.split("_")[0] in ("low", "high")] == expected, (r, low)
        assert r.kept == (not r.base_failed and not r.left_bands)


def test_learned_bands_tell_bad_texts_from_good_ones(spark, large):
    rows = queries.op7_fertility(spark, large).join(spark.read.parquet(f"{large}/labels.parquet"), "doc_id").filter("not base_failed")
    share = {r.quality: r.share for r in rows.groupBy("quality").agg(F.avg((~F.col("kept")).cast("int")).alias("share")).collect()}
    assert share[1] < 0.005 and share[0] > 0.3, share


def test_fertility_of_odd_tables(spark):
    rows = fertility.quality_rules(odd(spark), MODEL).collect()
    assert len(rows) == len(ODD) and not any(r.kept for r in rows if r.n_words < 50)
    assert fertility.quality_rules(odd(spark).filter("false"), MODEL).count() == 0


def test_scripts():
    assert [fertility.script_of(t) for t in ("", "abc", "straße", "привет мир", "日本語 ok", "ሰላም ዓለም", "123 — 4")] == [
        "latin", "latin", "latin", "greek_cyrillic", "east_asian", "other", "latin"
    ]
