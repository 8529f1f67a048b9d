"""BPE against the tokenizers library."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stmtwatch.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", " \n\t", "Hello, World's best 123 #### don't", "<|endoftext|>a<|startoftext|>", "ÉÀß ΣΑΣ ς", "İstanbul",
    "éa b c\x1cd\x85e", "日本語テキスト", "👍🏽 ok", "a" * 700 + " " + "xyz" * 300, "#" * 500, "it'll we'Re 'S",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


def ids(vocabulary, texts):
    flat, ends = bpe.Encoder(vocabulary).encode([vocabulary.split(t) for t in texts])
    return [flat[a:b].tolist() for a, b in zip([0, *ends], ends)]


def test_ids_of_hard_texts(library, vocabulary):
    assert ids(vocabulary, TEXTS) == [library.encode(t, add_special_tokens=False).ids for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs", "Cn", "Co"], max_codepoint=0x2FFF), max_size=60), max_size=8))
def test_ids_of_random_texts(library, vocabulary, texts):
    assert ids(vocabulary, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_character(library):
    """All code points, as letters, beside letters, digits and blanks."""
    own = bpe.Vocabulary(PATH, *bpe.differences(PATH))
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c}{c} b" for c in characters[i: i + 512]) for i in range(0, len(characters), 512)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    odd = [i for i, (a, b) in enumerate(zip(ids(own, texts), want)) if a != b]
    assert not odd


def test_frame(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = bpe.encode(docs, PATH, decoded="back").collect()
    assert len(rows) == docs.count()
    for row in rows:
        want = library.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == want
        assert row.back == library.decode(want, skip_special_tokens=False)


def test_odd_tables(spark):
    odd = spark.createDataFrame([(1, None, 7), (1, None, 7), (None, "a b", 8)], "doc_id long, text string, ids int")
    rows = bpe.encode(odd, PATH).collect()
    assert sorted(len(r.ids) for r in rows) == [0, 0, 2] and rows[0].asDict().keys() == {"doc_id", "text", "ids"}
    assert bpe.encode(odd.filter("false"), PATH).count() == 0
    assert sorted(str(r.text) for r in rows) == ["None", "None", "a b"]
    numbers = bpe.encode(spark.createDataFrame([(12,)], "text int"), PATH).collect()
    assert [r.text for r in numbers] == [12] and len(numbers[0].ids) == 2
