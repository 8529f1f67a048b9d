"""Exact deduplication by two passes over hashes: a Bloom filter of repeated hashes, then the rows.

Pass 1 counts the cells that the hashes of all rows fall into and keeps those that were hit twice
or more as a filter of bits. Its size is fixed by `filter_bits`, so it may be broadcast. Pass 2
probes every row: a row with a cell that was hit once cannot have an equal and passes straight
through. Only the others shuffle, by the SHA-256 of their whole text. With more rows than the
filter is made for, more rows shuffle; the result is the same.

Nulls: a null text counts as empty, so all null and empty texts are one group; a null key is less
than any other. Of repeated rows (same key, same text) one stays. Columns of the input keep their
names; none can clash, as rows travel packed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtwatch.llm.common import attach, checkpointed, whole_text

# Bits of the filter: 16 MiB at most. Good for some ten million distinct texts.
FILTER_BITS = 1 << 27
# Cells per hash.
HASHES = 2
# Words of 64 bits in one row of the filter.
SEGMENT_WORDS = 128


def _cells(sha: str, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(sha), F.lit(i)), F.lit(bits)) for i in range(hashes)]


def repeated_filter(rows: DataFrame, sha: str = "sha", bits: int = FILTER_BITS, hashes: int = HASHES) -> DataFrame:
    """Pass 1: the cells hit by two rows or more, as rows of (segment, words)."""
    cells = rows.select(F.explode(F.array_distinct(F.array(*_cells(sha, bits, hashes)))).alias("cell"))
    twice = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    words = twice.groupBy(F.shiftright("cell", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits")
    )
    at = F.pmod(F.col("word"), F.lit(SEGMENT_WORDS)).cast("int")
    return words.groupBy(F.expr(f"word div {SEGMENT_WORDS}").alias("segment")).agg(
        F.map_from_entries(F.collect_list(F.struct(at.alias("at"), "bits"))).alias("found")
    ).select("segment", F.expr(
        f"transform(sequence(0, {SEGMENT_WORDS - 1}), i -> coalesce(found[i], 0L))"
    ).alias("words"))


def with_possible(
    rows: DataFrame, repeated: DataFrame, sha: str = "sha", bits: int = FILTER_BITS, hashes: int = HASHES
) -> DataFrame:
    """Pass 2: add `possible`, false where no other row has the hash. Nothing is shuffled."""
    span = 64 * SEGMENT_WORDS
    out = rows.withColumn("possible", F.lit(True))
    for i, cell in enumerate(_cells(sha, bits, hashes)):
        side = repeated.select(F.col("segment").alias("_segment"), F.col("words").alias("_words"))
        out = (
            out.withColumn("_cell", cell).withColumn("_at", F.expr(f"_cell div {span}"))
            .join(F.broadcast(side), F.col("_at") == F.col("_segment"), "left")
            .withColumn("possible", F.col("possible") & F.expr(
                f"coalesce(getbit(_words[cast((_cell % {span}) div 64 as int)], cast(_cell & 63 as int)) = 1, false)"
            )).drop("_cell", "_at", "_segment", "_words")
        )
    return out


def exact_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", filter_bits: int = FILTER_BITS
) -> DataFrame:
    """One row per row of `docs`: the key, keep_id, group_size, kept and text_sha256."""
    rows = checkpointed(docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"),
        F.sha2(whole_text(text), 256).alias("sha"),
    ))
    flagged = with_possible(rows, repeated_filter(rows, bits=filter_bits), bits=filter_bits)
    maybe = flagged.filter("possible").drop("possible")
    groups = maybe.groupBy("sha").agg(
        F.max(F.struct("_key", "_row")).alias("best"), F.count(F.lit(1)).alias("n")
    )
    single = flagged.filter("not possible").select(
        F.col("_key").alias(key), F.col("_key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"),
    )
    grouped = attach(maybe, groups, "sha", "n", rows.count()).select(
        F.col("_key").alias(key), F.col("best._key").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("best._row") == F.col("_row")).alias("kept"), F.col("sha").alias("text_sha256"),
    )
    return single.unionByName(grouped)


def drop_exact_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", filter_bits: int = FILTER_BITS
) -> DataFrame:
    """The rows of `docs` that stay, with their columns. Equal rows are reduced before the shuffle."""
    rows = docs.select(F.struct("*").alias("row"), F.sha2(whole_text(text), 256).alias("sha"))
    repeated = repeated_filter(rows.select("sha"), bits=filter_bits)
    flagged = with_possible(rows, repeated, bits=filter_bits)
    order = F.struct(F.col("row")[key].isNotNull(), F.col("row")[key])
    kept = flagged.filter("possible").groupBy("sha").agg(F.max_by("row", order).alias("row"))
    return flagged.filter("not possible").select("row.*").unionByName(kept.select("row.*"))
