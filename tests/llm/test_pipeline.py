"""The pipeline stage by stage, each against a plain version on its own input."""

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from stmtwatch.llm import simhash


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf_dir, folder = "/root/testdata/sf0.001", tmp_path_factory.mktemp("stages")
    tables = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], sf_dir).write.parquet(f"{folder}/{i}")
        tables.append(spark.read.parquet(f"{folder}/{i}"))
    return [t.collect() for t in tables], [t.columns for t in tables]


def test_columns(stages):
    columns = stages[1]
    assert all(c == columns[0] for c in columns[:-1]) and set(columns[-1]) == {*columns[0], "ids"}


def test_quality(stages, spark):
    before, after = ({r.doc_id for r in t} for t in stages[0][:2])
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    gone = before - after
    assert after < before and not [i for i in gone if labels.get(i) == 1]


def test_exact(stages):
    before, after = stages[0][1:3]
    best = defaultdict(int)
    for r in before:
        best[r.text] = max(best[r.text], r.doc_id)
    assert Counter(map(tuple, after)) == Counter(tuple(r) for r in before if best[r.text] == r.doc_id)


def test_near(stages):
    before, after = stages[0][2:4]
    fps = [(simhash.fingerprint(r.text), r.doc_id) for r in before]
    root = {i: i for _, i in fps}
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, (f, i) in enumerate(fps):
        for g, j in fps[a + 1:]:
            if ((f ^ g) & (2**64 - 1)).bit_count() <= 4:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert sorted(r.doc_id for r in after) == sorted({find(i) for i in root})


def test_mix(stages):
    before, after = stages[0][3:5]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    text = {r.doc_id: r.text for r in before}
    assert all(text[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in after)
    assert sum(words(r.text) for r in after) == pytest.approx(1.5 * sum(words(r.text) for r in before), abs=20)
    assert max(Counter(r.doc_id for r in after).values()) <= 2


def test_encoded(stages):
    before, after = stages[0][4:6]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    digest = lambda ids: hashlib.sha256(str(list(ids)).encode()).hexdigest()
    assert Counter((r.doc_id, digest(r.ids)) for r in after) == Counter(
        (r.doc_id, digest(library.encode(r.text, add_special_tokens=False).ids)) for r in before
    )


def test_run_is_the_stages(stages, spark):
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()) == Counter(
        r.doc_id for r in stages[0][-1]
    )
