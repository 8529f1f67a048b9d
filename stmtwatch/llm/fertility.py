"""Quality rules on a tokenizer's fertility.

A public vocabulary with byte fallback encodes each whole text. Characters per token, the share of
byte tokens and the entropy of the tokens are held against bands. Wide bands by script are fixed.
Narrow ones are learned from all documents that pass the base rules: Tukey fences around the
quartiles of each measure, by language and length of the text, or by language alone where there are
few such texts. A language is what the table says; where it says nothing, the script stands for it.
Plain counts of words, symbols, repeated lines and repeated word triples come with them.

One pass over the texts; the measures, some 100 bytes a row, are kept in the shared folder. Quartiles
are partial aggregates of sketches, and the bands are joined by a look-up whose size is measured.

Nulls count as empty texts: all counts are 0 and the base rules fail. An empty table has no bands
and no rows. Very long texts are measured whole. Repeated rows give repeated results. Columns of
the input other than key, text and language are not carried, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stmtwatch.llm.common import checkpointed, whole_text
from stmtwatch.operators.lookup import lookup_join

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
ENTROPY_TOKENS = 1000
# Fences stand this many interquartile ranges outside the quartiles: Tukey's outer fences.
SPREAD = 3.0
# Quartiles of fewer texts are not trusted.
MIN_TEXTS = 200
MEASURES = ("chars_per_token", "byte_share", "entropy")


@dataclass(frozen=True)
class Band:
    """What is accepted for one script. Entropy is relative to that of as many different tokens, of
    ENTROPY_TOKENS at most: beyond that, ordinary text has hardly more."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_byte_share: float
    min_entropy: float


# By script. Wide: ordinary text lies well inside, noise and endless repetition outside.
BANDS = {
    "latin": Band(1.6, 6.5, 0.15, 0.60),
    "greek_cyrillic": Band(0.9, 5.0, 0.30, 0.40),
    "east_asian": Band(0.4, 3.0, 0.75, 0.40),
    "other": Band(0.25, 6.5, 0.95, 0.35),
}
_SCRIPT_RANGES = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek_cyrillic": [(0x370, 0x52F), (0x1F00, 0x1FFF)],
    "east_asian": [(0x2E80, 0x9FFF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}


def script_of(text: str) -> str:
    """The script of most letters; other if none is known."""
    if text.isascii():
        return "latin"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = {s: sum(int(((codes >= a) & (codes <= b)).sum()) for a, b in r) for s, r in _SCRIPT_RANGES.items()}
    letters = sum(c.isalpha() for c in set(text))
    best = max(found, key=found.get)
    return best if found[best] or not letters else "other"


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    repeated = 0
    if len(words) >= 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        triples = pairs[:-1] * len(number) + ids[2:]
        _, at, n = np.unique(triples, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(n[at] > 1)
        inside = np.zeros(len(words), bool)
        for k in range(3):
            inside[twice + k] = True
        repeated = int(inside.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def token_measures(text: str, ids: np.ndarray, is_byte: np.ndarray) -> tuple[float, float, float]:
    """Characters per token, share of byte tokens, entropy relative to the most possible."""
    if not len(ids):
        return 0.0, 0.0, 0.0
    counts = np.unique(ids, return_counts=True)[1] / len(ids)
    entropy = float(-(counts * np.log(counts)).sum())
    most = np.log(min(len(ids), ENTROPY_TOKENS))
    return len(text) / len(ids), float(is_byte[ids].mean()), entropy / most if len(ids) > 1 else 0.0


SCHEMA = T.StructType([
    *[T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    T.StructField("script", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in MEASURES],
    T.StructField("n_tokens", T.LongType()),
])


def with_measures(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """`docs` with a struct column `measures`. `model` is the path of a sentencepiece model."""

    @F.pandas_udf(SCHEMA)
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        is_byte = np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])
        is_byte[[pieces.piece_to_id(p) for p in ("<0x0A>", "<0x0D>", "<0x09>")]] = False  # blanks are no fallback
        for texts in batches:
            rows = []
            for value in texts:
                ids = np.array(pieces.encode(value), np.int64)
                rows.append((
                    *base_counts(value), script_of(value), *token_measures(value, ids, is_byte), len(ids)
                ))
            yield pd.DataFrame(rows, columns=SCHEMA.names)

    return docs.withColumn("measures", measure(whole_text(text)))


def learned_bands(measured: DataFrame, by: list[str], spread: float = SPREAD, min_texts: int = MIN_TEXTS) -> DataFrame:
    """Fences per group of `by`, as a struct `low` and `high` of each measure. Null keys have none."""
    quartiles = [F.percentile_approx(m, [0.25, 0.75], 10_000).alias(m) for m in MEASURES]
    cells = measured.dropna(subset=by).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *quartiles)
    reach = lambda m: spread * (F.col(m)[1] - F.col(m)[0])
    return cells.filter(F.col("n") >= min_texts).select(*by, F.struct(
        *[(F.col(m)[0] - reach(m)).alias(f"low_{m}") for m in MEASURES],
        *[(F.col(m)[1] + reach(m)).alias(f"high_{m}") for m in MEASURES],
    ).alias("band"))


def quality_rules(
    docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", language: str | None = "lang",
    bands: dict[str, Band] = BANDS, spread: float = SPREAD, min_texts: int = MIN_TEXTS,
) -> DataFrame:
    """One row per row of `docs`: key, measures, base_failed, the bands that were left, and kept.

    `language` may be None or missing. `low` and `high` before the name of a measure in `left_bands` tell a learned band from a fixed one.
    """
    told = F.col(language).cast("string") if language in docs.columns else F.lit(None).cast("string")
    plain = docs.select(F.col(key).alias("_key"), told.alias("_told"), F.col(text).alias("_text"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    measured = checkpointed(
        with_measures(plain, model, "_text").select("_key", "_told", "measures.*").withColumn("base_failed", base)
    ).withColumns({
        "_group": F.coalesce("_told", "script"), "_size": F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int"),
    })
    passed = measured.filter("not base_failed")
    fine = checkpointed(learned_bands(passed, ["_group", "_size"], spread, min_texts))
    coarse = checkpointed(learned_bands(passed, ["_group"], spread, min_texts))
    held = lookup_join(measured, fine.withColumnRenamed("band", "_fine"), ["_group", "_size"])
    held = lookup_join(held, coarse.withColumnRenamed("band", "_coarse"), ["_group"])
    learned = F.coalesce("_fine", "_coarse")
    limits = F.create_map(*[
        x for s, b in bands.items() for x in (F.lit(s), F.struct(
            F.lit(b.min_chars_per_token).alias("min_chars"), F.lit(b.max_chars_per_token).alias("max_chars"),
            F.lit(b.max_byte_share).alias("max_bytes"), F.lit(b.min_entropy).alias("min_entropy"),
        ))
    ])
    fixed = F.element_at(limits, F.col("script"))
    # Only what speaks against a text counts: no text is too varied, or has too few bytes to fall back on.
    failed = F.array_compact(F.array(
        F.when(~F.col("chars_per_token").between(fixed["min_chars"], fixed["max_chars"]), "chars_per_token"),
        F.when(F.col("byte_share") > fixed["max_bytes"], "byte_share"),
        F.when(F.col("entropy") < fixed["min_entropy"], "entropy"),
        F.when(F.col("chars_per_token") < learned["low_chars_per_token"], "low_chars_per_token"),
        F.when(F.col("chars_per_token") > learned["high_chars_per_token"], "high_chars_per_token"),
        F.when(F.col("byte_share") > learned["high_byte_share"], "high_byte_share"),
        F.when(F.col("entropy") < learned["low_entropy"], "low_entropy"),
    ))
    return held.withColumn("left_bands", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.size("left_bands") == 0)
    ).select(F.col("_key").alias(key), *[f.name for f in SCHEMA.fields], "base_failed", "left_bands", "kept")
