"""Repeated strings against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from stmtwatch.llm import suffix_dedup as sd


def brute(texts, length):
    datas = [(t or "").encode() for t in texts]
    seen = Counter(d[i: i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for d in datas:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i: i + length]] > 1:
                gone[i: i + length] = True
        runs = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(d), int(gone.sum()), runs, bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


def made_texts(seed, letters="abcdefgh é"):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    passages = [word(n) for n in (199, 200, 201, 260, 700, 1500)]
    texts = [None, "", "short", word(199), word(200)]
    texts += [word(r.randint(0, 300)) + r.choice(passages) + word(r.randint(0, 300)) for _ in range(60)]
    texts += [passages[4][:350] + word(40) + passages[4][300:], passages[5][3:900], passages[5][100:1200] + passages[3]]
    long = list(word(900))
    for _ in range(12):  # near copies
        long[r.randrange(900)] = r.choice(letters)
        texts.append("".join(long))
    texts += ["ab" * 400, "a" * 777, "a" * 200, "a" * 201 + "b", texts[10], texts[10], texts[11]]
    return texts


@pytest.mark.parametrize("options", [{}, {"most_stretches": 2}])
def test_against_brute_force(spark, options):
    texts = made_texts(1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = sd.remove_repeats(docs, **options).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows}
    assert got == dict(enumerate(brute(texts, sd.LENGTH)))


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in sd.remove_repeats(docs).collect()}
    source = docs.collect()
    for doc, want in zip(source, brute([d.text for d in source], sd.LENGTH)):
        row = rows[doc.doc_id]
        assert (row.n_bytes, row.n_removed, row.n_spans, bytes(row.kept)) == want


def test_cover_has_all_differences():
    assert {(a - b) % sd.PERIOD for a in sd.COVER for b in sd.COVER} == set(range(sd.PERIOD))


def test_cover_ranks_order_suffixes():
    data = np.frombuffer(random.Random(3).choices and bytes(random.Random(3).choices(b"ab", k=900)), np.uint8)
    ranks = sd.cover_ranks(sd._words(data), 200)
    sample = np.flatnonzero(ranks >= 0)
    raw = data.tobytes()
    assert sorted(sample, key=lambda i: ranks[i]) == sorted(sample, key=lambda i: raw[i: i + 248])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sd.remove_repeats(docs).count() == 0
