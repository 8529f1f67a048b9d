"""Alignment of two tokenizers by pointer jumping.

Both tokenizers cut the same bytes, a space and the text. The tokens of both form one sequence of
byte ranges. Every token points to its farthest-right overlapping token: the other tokenizer's token
that holds its last byte, or itself where no range goes further. Successors are doubled for all
tokens of many texts at once until nothing changes; then each token points to the last token of its
component, which labels the group. A group ends where tokens of both end, and there the two tokens
that end together are linked.

1. One scan encodes and aligns the texts and writes, per text, its groups and the linked id pairs
   with their numbers. Texts do not move.
2. Pairs are counted by a partial aggregate over all texts.
3. Every text's pairs meet the counts. There are at most as many different pairs as both
   vocabularies allow; the counts are broadcast if their number, which is counted first, is at most
   `BROADCAST_PAIRS` (some 40 MB). Beyond it they are joined by a shuffle in which hot pairs are kept
   apart (`attach`).

Texts that are null or empty, or that a tokenizer does not give back byte by byte, have no tokens.
Strings of special tokens in a text are plain text. Very long texts are aligned whole, in memory of
some 100 bytes a token; texts with very long runs are encoded by the slower of two equal encoders.
Repeated rows are texts of their own. An empty table gives an empty result. Other columns play no
part.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stmtwatch.llm.common import Scratch, attach, whole_text

BROADCAST_PAIRS = 1_000_000
# Characters of text that are aligned together, so few that their arrays stay in a core's cache; texts
# are not cut.
TOGETHER = 1 << 18
# Ids of the second vocabulary are below 2^20.
SHIFT = 20

LONG_RUN = 300
_LONG_BLANK = re.compile(rf"\s{{{LONG_RUN}}}")


def _long_run(text: str) -> bool:
    """Is there a long run of characters without a blank, or of blanks?"""
    return max(map(len, text.split()), default=0) >= LONG_RUN or _LONG_BLANK.search(text) is not None


def _classes(of) -> np.ndarray:
    """What the pattern of the byte-level vocabulary sees of each character: letter, number or other."""
    letters = {"L": 1, "N": 2, "Z": 3}
    return np.array([letters.get(of(chr(c))[0], 4 if of(chr(c)) == "Cn" else 0) for c in range(0x10000)])


class ByteLevel:
    """Ids of a byte-level vocabulary.

    The rank file's encoder is fast, but it may know another version of Unicode than the library
    that defines the ids, and slow on very long runs. Texts with characters whose class is not the
    same since Unicode 3.2, or beyond the basic plane, and texts with long runs go to the library.
    """

    def __init__(self, path: str, ranks: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as file:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.path, self.library = path, None
        self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        self.bytes = [b""] * (max(known.values()) + 1)
        for token, number in known.items():
            self.bytes[number] = token
        old, new = _classes(unicodedata.ucd_3_2_0.category), _classes(unicodedata.category)
        odd = np.flatnonzero((old != new) | (old == 4))
        ends = np.flatnonzero(np.diff(odd) > 1)
        runs = zip(odd[np.concatenate([[0], ends + 1])], odd[np.concatenate([ends, [len(odd) - 1]])])
        self.odd = re.compile("[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs) + "\U00010000-\U0010ffff]")

    def encode(self, text: str) -> list[int]:
        if (text.isascii() or not self.odd.search(text)) and not _long_run(text):
            return self.quick.encode_ordinary(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.encode_special_tokens = True
        return self.library.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids of a vocabulary of pieces, in which U+2581 stands for a space."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, number: int) -> bytes:
        piece = self.model.id_to_piece(number)
        if self.model.is_byte(number):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every token of A and of B the token of B at which its component ends.

    `ends_a` and `ends_b` are the byte offsets at which the tokens of each end, ascending, to the
    same last offset.
    """
    n_a, n_b = len(ends_a), len(ends_b)
    holds = lambda ends: np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    # Of tokens that end together the one of B counts as farther right.
    from_a = n_a + holds(ends_b)[ends_a - 1]
    from_b = holds(ends_a)[ends_b - 1]
    from_b = np.where(ends_a[from_b] == ends_b, n_a + np.arange(n_b), from_b)
    after = np.concatenate([from_a, from_b])
    while True:
        further = after[after]
        if np.array_equal(further, after):
            return after[:n_a] - n_a, after[n_a:] - n_a
        after = further


def aligned(a: list[list[int]], b: list[list[int]], size_a: np.ndarray, size_b: np.ndarray):
    """Alignment of many texts at once, each cut into tokens `a` and `b` of the same bytes.

    Per text: number of groups, of links, groups as a string, linked pairs and their numbers.
    """
    count_a, count_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    ids_a, ids_b = (np.concatenate([np.asarray(x, np.int64) for x in y] or [np.empty(0, np.int64)]) for y in (a, b))
    ends_a, ends_b = np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b])
    if len(ids_a):
        label_a, label_b = terminals(ends_a, ends_b)
    else:
        label_a = label_b = np.empty(0, np.int64)
    last_b = np.unique(label_b)  # the token of B that ends each group
    group_a, group_b = np.searchsorted(last_b, label_a), np.searchsorted(last_b, label_b)
    ends = np.searchsorted(group_a, np.arange(len(last_b)), "right")  # tokens of A up to each group's end
    last_a = ends - 1
    # Every link is a token of A and one of B that end together: the last ones of a group.
    link_a, link_b = ids_a[last_a], ids_b[last_b]
    text_a, text_b = (np.repeat(np.arange(len(c)), c) for c in (count_a, count_b))
    of = text_b[last_b]
    groups = np.bincount(of, minlength=len(a))

    # Groups one after the other, the tokens of A before those of B.
    code = np.empty(len(ids_a) + len(ids_b), np.int64)
    before_b = np.concatenate([[0], last_b[:-1] + 1]) if len(last_b) else last_b
    ends_group_a, ends_group_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    ends_group_a[last_a], ends_group_b[last_b] = 1, 1
    code[np.arange(len(ids_a)) + before_b[group_a]] = 3 * ids_a + ends_group_a
    code[np.arange(len(ids_b)) + ends[group_b]] = 3 * ids_b + 2 * ends_group_b
    del text_a

    # Text and pair in one number: 37 bits for the pair here, the rest for the texts of a batch.
    width = SHIFT + len(size_a).bit_length()
    keys = np.sort((of << width) | (link_a << SHIFT) | link_b)
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else keys
    times = np.diff(np.concatenate([new, [len(keys)]])) if len(keys) else keys
    met = keys[new]
    return groups, code, count_a + count_b, met >> width, met & ((1 << width) - 1), times


class Texts:
    """Ids with the mark that follows them in a string of groups."""

    def __init__(self, size: int):
        self.pieces = [f"{i}{mark}" for i in range(size) for mark in (",", "|", ";")]

    def join(self, code: np.ndarray) -> str:
        return "".join(map(self.pieces.__getitem__, code.tolist()))[:-1]


def _written(docs: DataFrame, key: str, text: str, files: dict[str, str], pattern: str, digest: bool) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), whole_text(text).alias("text"))
    schema = T.StructType([
        rows.schema["row"], rows.schema["key"], *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")],
        T.StructField("groups", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType())),
        T.StructField("times", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = ByteLevel(files["a"], files["ranks"], pattern), Pieces(files["b"])
        size_a, size_b = (np.array([len(x) for x in v.bytes], np.int64) for v in (first, second))
        texts = Texts(max(len(size_a), len(size_b)))

        def ids(value: str) -> tuple[list[int], list[int]]:
            if not value:
                return [], []
            data = b" " + value.encode("utf-8", "replace")
            a, b = first.encode(" " + value), second.encode(value)
            same = b"".join(map(first.bytes.__getitem__, a)) == data == b"".join(map(second.bytes.__getitem__, b))
            return (a, b) if same else ([], [])

        def done(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
            a, b = [x for x, _ in found], [x for _, x in found]
            groups, code, lens, of, pairs, times = aligned(a, b, size_a, size_b)
            ends = np.cumsum(lens)
            strings = [texts.join(code[e - n: e]) if n else "" for e, n in zip(ends.tolist(), lens.tolist())]
            if digest:
                strings = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in strings]
            offsets = pa.array(np.searchsorted(of, np.arange(len(found) + 1)).astype(np.int32))
            return pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(x) for x in a], pa.int64()),
                pa.array([len(x) for x in b], pa.int64()), pa.array(groups), pa.array(groups), pa.array(strings, pa.string()),
                pa.ListArray.from_arrays(offsets, pa.array(pairs)), pa.ListArray.from_arrays(offsets, pa.array(times)),
            ], names=schema.fieldNames())

        for batch in batches:
            start, size, found = 0, 0, []
            for i, value in enumerate(batch.column(2)):
                value = value.as_py()
                size += len(value)
                found.append(ids(value))
                if size >= TOGETHER or i + 1 == batch.num_rows:
                    yield done(batch.slice(start, len(found)), found)
                    start, size, found = i + 1, 0, []

    return rows.mapInArrow(run, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best): how many links hold an id pair, and whether no other pair of its B id has more."""
    counts = links.groupBy("pair").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("texts"))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND((1 << SHIFT) - 1))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row per id of the second vocabulary
    return counts.join(most, "b").select("pair", "n", "texts", (F.col("n") == F.col("most")).alias("best"))


def align(
    docs: DataFrame, files: dict[str, str], pattern: str, key: str = "doc_id", text: str = "text",
    digest: bool = False, broadcast_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """One row per row of `docs`: the key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups.

    `files` has the paths of the byte-level vocabulary (`a`), of its ranks (`ranks`), cut by
    `pattern`, and of the vocabulary of pieces (`b`); executors read them at the same paths. groups is
    "a1,a2|b1;a3|b2,b3", or its SHA-256 with `digest`; it is empty for texts without tokens.
    """
    scratch = Scratch(docs.sparkSession, "aligned")
    rows = scratch.keep(_written(docs, key, text, files, pattern, digest), "rows")
    links = rows.select("row", F.expr("inline(arrays_zip(pairs, times))")).withColumnRenamed("pairs", "pair")
    counts = scratch.keep(pair_counts(links), "counts")
    if counts.count() <= broadcast_pairs:
        met = links.join(F.broadcast(counts.drop("texts")), "pair")
    else:
        met = attach(links, counts, "pair", "texts")
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    return rows.drop("pairs", "times").join(sums, "row", "left").select(
        F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups",
    )
