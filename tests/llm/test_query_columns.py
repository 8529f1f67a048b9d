"""The columns that the registered queries derive, against plain versions over the whole table."""

import hashlib
import re
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stmtwatch.llm import simhash
from stmtwatch.llm.queries import QUERIES


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op2(spark, sf_dir, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = QUERIES["op2_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id].text or "", add_special_tokens=False).ids
        want = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want


def test_op10(spark, sf_dir, texts):
    rows = QUERIES["op10_simhash_dedup"](spark, sf_dir).collect()
    prints = {i: simhash.fingerprint(t.text or "") & (2**64 - 1) for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{f:016x}" for i, f in prints.items()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(prints)
    for n, i in enumerate(order):
        for j in order[n + 1:]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                low, high = sorted((find(i), find(j)))
                root[high] = low
    assert {r.doc_id: r.component_id for r in rows} == {i: find(i) for i in prints}


def test_op1(spark, sf_dir, texts):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t.text or "")) for i, t in texts.items()}
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for i, t in texts.items():
        sizes[t.source] += size[i]
    rows = QUERIES["op1_mixing"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        source = texts[r.doc_id].source
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[source]) and 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
        targets[source] = r.target
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(targets[s] <= 2 * sizes[s] + 1e-6 and abs(taken[s] - targets[s]) <= 0.5 for s in sizes)


def test_op9(spark, sf_dir):
    """Base columns by the patterns as given; all spans start with the base ones."""
    from test_pii import base

    whole = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op9_pii"](spark, sf_dir).collect()
    assert len(rows) == len(whole)
    for row in rows:
        spans = base(whole[row.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [
            sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")
        ]
        assert row.spans == listed or row.spans.startswith(f"{listed}," if listed else "")
        assert row.n_spans == (len(row.spans.split(",")) if row.spans else 0)
