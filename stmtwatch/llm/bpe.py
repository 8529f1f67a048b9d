"""Byte-pair encoding and decoding with the vocabulary file of a public tokenizer.

Texts are cut into words by the file's rules (NFC, lower case, one pattern). The words that a task
has not met before are encoded together: their symbols lie in one flat array, and each round merges
the leftmost lowest-ranked pair of every word. Ranks come from a binary search over the sorted pair
keys, and only the pairs beside a merge are looked up again. A word of very many symbols would need
very many rounds, so it is merged with a heap instead, to the same result.

Nothing is shuffled. The words a task remembers are bounded; then it starts afresh.

Nulls and texts without words have no ids and decode to the empty string. Strings of special tokens
in a text become those tokens.
"""

from __future__ import annotations

import functools
import heapq
import json
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stmtwatch.llm.common import whole_text

# Words of more symbols are merged one by one.
LONG = 200
# Words that a task remembers at most.
REMEMBERED = 200_000
# Words that are encoded together, at least; documents are not cut.
TOGETHER = 200_000


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


@functools.cache
def differences(path: str) -> tuple[str, dict[str, str]]:
    """Where the library that defines the ids knows another Unicode than `regex` and Python: letters
    and digits of `regex` that it takes for neither, as ranges of a character class, and lower-case
    forms that Python lacks. Only characters that Python's unicodedata has not are looked at."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    unknown = (c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn")
    known = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, unknown)))
    other = [ord(c) for c in known if len(library.pre_tokenizer.pre_tokenize_str(f"#{c}")) == 1]
    lower = {c: small for c in known if (small := library.normalizer.normalize_str(c)) != c}
    starts = [c for c, before in zip(other, [-1, *other]) if c != before + 1]
    ends = [c for c, after in zip(other, [*other[1:], -1]) if c + 1 != after]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends)), lower


class Vocabulary:
    """Ids, merges and rules of a tokenizer file whose words end in a suffix. `newer` are characters
    (ranges of a class) that are neither letters nor digits, whatever `regex` says, `lower` are
    lower-case forms beyond Python's."""

    def __init__(self, path: str, newer: str = "", lower: dict[str, str] | None = None):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in (ids | self.special).items()}
        self.size = max(self.text_of) + 1
        letters = _byte_letters()
        self.inner = np.array([ids.get(c, -1) for c in letters], np.int64)
        self.last = np.array([ids.get(c + suffix, -1) for c in letters], np.int64)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.words = self.odd_words = regex.compile(pattern)
        self.lower = str.maketrans(lower or {})
        odd = newer + "".join(lower or {})
        self.odd = regex.compile(f"[{odd}]" if odd else r"(?!)")
        # One range is found faster than many; most texts have nothing in it.
        self.high = regex.compile(f"[{min(odd.replace('-', ''))}-{chr(sys.maxunicode)}]" if odd else r"(?!)")
        if newer:
            other = r"[^\p{White_Space}\p{L}\p{N}]"
            for known in (r"\p{L}", r"\p{N}"):
                pattern = pattern.replace(f"[{known}]", f"[{known}--[{newer}]]")
            self.odd_words = regex.compile(pattern.replace(other, f"(?:{other}|[{newer}])"), regex.VERSION1)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def split(self, text: str) -> list[str]:
        """The words of a text; special tokens are elements of their own."""
        if self.specials is not None and "<" in text:
            parts = self.specials.split(text)
            if len(parts) > 1:
                return [w for p in parts for w in ([p] if p in self.special else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            # One character at a time, without the rule for a final sigma.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if self.high.search(text) and self.odd.search(text):
                return self.odd_words.findall(text.translate(self.lower).lower())
        return self.words.findall(text.lower())

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, by binary search; the number of merges if there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys))


def _merged_with_heap(vocabulary: Vocabulary, symbols: np.ndarray) -> np.ndarray:
    """One long word: pairs wait in a heap by rank and place."""
    ids, none = symbols.tolist(), len(vocabulary.keys)
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    alive = [True] * len(ids)
    first = vocabulary.rank(symbols[:-1], symbols[1:])
    heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r < none]
    heapq.heapify(heap)

    def look(i: int, j: int) -> None:
        r = int(vocabulary.rank(np.array([ids[i]]), np.array([ids[j]]))[0])
        if r < none:
            heapq.heappush(heap, (r, i, ids[i], ids[j]))

    while heap:
        r, i, left, right = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= len(ids) or ids[i] != left or ids[j] != right:
            continue
        ids[i] = int(vocabulary.merged[r])
        alive[j] = False
        after[i] = after[j]
        if after[i] < len(ids):
            before[after[i]] = i
            look(i, after[i])
        if before[i] >= 0:
            look(before[i], i)
    return np.array([x for x, a in zip(ids, alive) if a], np.int64)


def encode_words(vocabulary: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many words in one flat array, and the number of ids of each word."""
    data = [w.encode("utf-8", "replace") for w in words]
    lens = np.fromiter(map(len, data), np.int64, len(data))
    flat = np.frombuffer(b"".join(data), np.uint8)
    ends = np.cumsum(lens)
    symbols = vocabulary.inner[flat]
    symbols[ends[lens > 0] - 1] = vocabulary.last[flat[ends[lens > 0] - 1]]
    word = np.repeat(np.arange(len(words)), lens)
    known = symbols >= 0
    symbols, word = symbols[known], word[known]

    done_word, done = [], []
    lens = np.bincount(word, minlength=len(words))
    for w in np.flatnonzero(lens > LONG).tolist():
        start = int(np.searchsorted(word, w))
        ids = _merged_with_heap(vocabulary, symbols[start: start + lens[w]])
        done.append(ids)
        done_word.append(np.full(len(ids), w))
    short = lens[word] <= LONG
    symbols, word = symbols[short], word[short]

    none = len(vocabulary.keys)
    rank = np.full(len(symbols), none, np.int64)
    inside = np.flatnonzero(word[1:] == word[:-1])
    rank[inside] = vocabulary.rank(symbols[inside], symbols[inside + 1])
    while len(symbols):
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        best = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), starts)
        open_ = (best >> 32) < none
        if not open_.all():  # words without a pair to merge are finished
            sizes = np.diff(np.append(starts, len(symbols)))
            keep = np.repeat(open_, sizes)
            done.append(symbols[~keep])
            done_word.append(word[~keep])
            at = (best[open_] & 0xFFFFFFFF) - (np.cumsum(np.where(open_, 0, sizes)) - 0)[open_]
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            if not len(symbols):
                break
        else:
            at = best & 0xFFFFFFFF
        symbols[at] = vocabulary.merged[rank[at]]
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        symbols, word, rank = symbols[stays], word[stays], rank[stays]
        at = at - np.arange(len(at))  # one symbol went before each later merge
        touched = np.concatenate([at, at[at > 0] - 1])
        rank[touched] = none
        touched = touched[touched + 1 < len(symbols)]
        touched = touched[word[touched] == word[touched + 1]]
        rank[touched] = vocabulary.rank(symbols[touched], symbols[touched + 1])
    if not done:
        return np.empty(0, np.int64), np.zeros(len(words), np.int64)
    word, ids = np.concatenate(done_word), np.concatenate(done)
    return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


class Encoder:
    """Encodes texts, remembering words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.starts, self.lens = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        for text, number in self.vocabulary.special.items():
            self._add([text], np.array([number]), np.array([1]))

    def _add(self, words: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def encode(self, texts: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (as lists of words) in one flat array, and where each text ends."""
        counts, words = [], []
        for text in texts:
            counts.append(len(text))
            words += text
        if len(self.place) > REMEMBERED:
            self.forget()
        new = list(dict.fromkeys(w for w in words if w not in self.place))
        if new:
            self._add(new, *encode_words(self.vocabulary, new))
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        lens = self.lens[at]
        ends = np.cumsum(lens)
        flat = self.ids[np.repeat(self.starts[at] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]
        return flat, np.concatenate(([0], ends))[np.cumsum(counts, dtype=np.int64)] if counts else np.empty(0, np.int64)


def decode(tokens: list[str], ids: list[int]) -> str:
    """Without a decoder in the file, tokens are joined by blanks."""
    return " ".join(map(tokens.__getitem__, ids))


def encode(docs: DataFrame, path: str, text: str = "text", decoded: str | None = None) -> DataFrame:
    """`docs` with the column `ids`, and, if named, a column with the ids decoded again.

    All columns of the input stay; a column `ids` of the input is replaced.
    """
    made = [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)]
    made += [T.StructField(decoded, T.StringType(), False)] if decoded else []
    names = {f.name for f in made}
    packed = docs.select(F.struct("*").alias("row"))
    at = docs.columns.index(text)
    if not isinstance(docs.schema[text].dataType, T.StringType):  # else the row holds it, and it is sent once
        packed = docs.select(F.struct("*").alias("row"), whole_text(text).alias("text"))
    schema = T.StructType([packed.schema["row"], *made])
    newer, lower = differences(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path, newer, lower)
        encoder = Encoder(vocabulary)
        tokens = [vocabulary.text_of.get(i, "") for i in range(vocabulary.size)]

        def encoded(row: pa.Array, texts: list[list[str]]) -> pa.RecordBatch:
            flat, ends = encoder.encode(texts)
            offsets = np.concatenate(([0], ends)).astype(np.int32)
            columns = [row, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            if decoded:
                columns.append(pa.array(
                    [decode(tokens, flat[a:b].tolist()) for a, b in zip(offsets, offsets[1:])], pa.string()
                ))
            return pa.RecordBatch.from_arrays(columns, names=["row", *[f.name for f in made]])

        for batch in batches:
            start, words, texts = 0, 0, []
            values = batch.column(1) if batch.num_columns > 1 else batch.column(0).field(at)
            for i, value in enumerate(values):
                texts.append(vocabulary.split(value.as_py() or ""))
                words += len(texts[-1])
                if words >= TOGETHER or i + 1 == batch.num_rows:
                    yield encoded(batch.column(0).slice(start, len(texts)), texts)
                    start, words, texts = i + 1, 0, []

    out = packed.mapInArrow(run, schema)
    return out.select(*[F.col(f"row.{c}").alias(c) for c in docs.columns if c not in names], *names)
