"""Alignment of tokenizers against plain loops over bytes, and the encoders against their library."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stmtwatch.llm import alignment, queries

FILES = {"a": public.path("byte_bpe_50k.json"), "ranks": public.path("byte_bpe_50k.tiktoken"), "b": public.path("piece_bpe_32k.model")}


@pytest.fixture(scope="module")
def library():
    a = Tokenizer.from_file(FILES["a"])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES["b"])


def token_bytes(library):
    a, b = library
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    letter = {(chr(x) if x in plain else chr(next(other))): x for x in range(256)}
    of_a = lambda i: bytes(letter[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return of_a, of_b


def groups_of(text, library):
    """Groups and links by walking over the byte offsets."""
    of_a, of_b = token_bytes(library)
    data = b" " + text.encode()
    a, b = library[0].encode(" " + text, add_special_tokens=False).ids, library[1].encode(text)
    if not text or b"".join(map(of_a, a)) != data or b"".join(map(of_b, b)) != data:
        return [], [], [], []
    ends = lambda ids, of: np.cumsum([len(of(i)) for i in ids]).tolist()
    ends_a, ends_b = ends(a, of_a), ends(b, of_b)
    both = sorted(set(ends_a) & set(ends_b))
    of_end = lambda e: bisect.bisect_left(both, e)
    groups = [([], []) for _ in both]
    for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
        for i, e in zip(ids, ends):
            groups[of_end(e)][side].append(i)
    ending = defaultdict(list)
    for j, e in zip(b, ends_b):
        ending[e].append(j)
    links = [(i, j) for i, e in zip(a, ends_a) for j in ending[e]]
    return a, b, groups, links


def expected(rows, library):
    found = [(key, *groups_of(text or "", library)) for key, text in rows]
    counts = Counter(p for *_, links in found for p in links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return Counter(
        (key, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
         ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups))
        for key, a, b, groups, links in found
    )


TEXTS = [
    None, "", " ", "hello world", "  double  spaces\n\ttabs ", "<|endoftext|> plain <s> text</s>", "naïve café 漢字 😀👩‍👩‍👧",
    "already▁there", "<0x41> and \x00 and \x7f", "a" * 2000, " " * 700, "xᲉꟋ\U00010d50", "hello world", "é" * 400 + " 1234567890",
]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_texts(spark, library, broadcast):
    docs = spark.createDataFrame([(i % 9, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id int, text string, groups string, row int")
    got = alignment.align(docs, FILES, public.PATTERN, broadcast_pairs=broadcast)
    assert got.columns == COLUMNS
    assert Counter(map(tuple, got.collect())) == expected([(i % 9, t) for i, t in enumerate(TEXTS)], library)


def test_query(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = Counter((*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in expected(map(tuple, docs.collect()), library))
    got = queries.QUERIES["op13_alignment"](spark, sf_dir)
    assert Counter(map(tuple, got.select(*COLUMNS[:-1], "groups_sha256").collect())) == want


def test_every_character_is_encoded_as_by_the_library(library):
    """Every character of the basic plane, and every 16th beyond it, beside letters, digits and blanks."""
    own = alignment.ByteLevel(FILES["a"], FILES["ranks"], public.PATTERN)
    step = 40
    odd = []
    characters = [chr(c) for c in [*range(0x10000), *range(0x10000, 0x110000, 16)] if not 0xD800 <= c < 0xE000]
    for start in range(0, len(characters), step):
        text = "".join(f"a{c} {c}{c}1{c}a 1 {c}" for c in characters[start: start + step])
        if own.encode(text) != library[0].encode(text, add_special_tokens=False).ids:
            odd.append(start)
    assert not odd


def test_pointers_end_in_their_component():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(1, 60)
        cuts = lambda: np.array(sorted({n, *(rng.randrange(1, n + 1) for _ in range(rng.randrange(n)))}))
        a, b = cuts(), cuts()
        both = sorted(set(a.tolist()) & set(b.tolist()))
        end_of = lambda e: next(x for x in both if x >= e)
        label_a, label_b = alignment.terminals(a, b)
        assert [int(b[t]) for t in label_a] == [end_of(e) for e in a.tolist()]
        assert [int(b[t]) for t in label_b] == [end_of(e) for e in b.tolist()]


def test_a_chain_takes_few_rounds():
    """Ranges that never end together until the last byte are one component."""
    n = 1 << 16
    a, b = np.append(np.arange(2, n, 2), n + 1), np.append(np.arange(1, n + 1, 2), n + 1)
    label_a, label_b = alignment.terminals(a, b)
    assert set(label_a.tolist()) == set(label_b.tolist()) == {len(b) - 1}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(docs, FILES, public.PATTERN).count() == 0


def test_long_runs_are_told_without_a_search_from_every_place():
    import re
    import sys

    blank = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
    texts = [f"{'a' * n}{b}{c * n}" for n in (150, 299, 300) for b in ("", "b", *blank) for c in ("x", "\u200b", *blank)] + ["", " "]
    assert [alignment._long_run(t) for t in texts] == [bool(re.search(r"\S{300}|\s{300}", t)) for t in texts]
