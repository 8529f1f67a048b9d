"""Left joins of the log with a keyed table, safe for hot keys and for tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only after its content has been measured to stay below this.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
# A key with more rows than this is hot.
HOT_ROWS = 1_000_000
# There are never more hot keys than this: some 30 MB.
MAX_HOT_KEYS = 1_000_000
# Pieces that a key of a stream is dealt into, and pieces for rows without a key.
STREAM_SALTS = 16
NULL_SALTS = 1024


def measured_bytes(df: DataFrame) -> int:
    """Size of the content of a table of flat columns, by one aggregate over it."""
    width = F.lit(0).cast("long")
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(F.col(field.name)), F.lit(0)) + 24
        else:
            width = width + 16
    return df.agg(F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first().bytes


def fits_broadcast(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    return measured_bytes(df) <= max_bytes


def hot_keys(left: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """(_hash, _salts) of the keys with many rows: into how many pieces their rows are dealt.

    Keys are counted by a hash, so texts do not move. A key is hot from a millionth of the rows on
    at the earliest: there are fewer than MAX_HOT_KEYS, of some 30 bytes each.
    """
    hashed = left.dropna(subset=keys).select(F.xxhash64(*keys).alias("_hash"))
    counts = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(W.partitionBy())
    limit = F.greatest(F.lit(hot_rows), F.expr(f"_total div {MAX_HOT_KEYS}"))
    # Only keys that may be hot take part in the total's window; the rest is summed before.
    large = counts.filter(F.col("_n") > hot_rows).withColumn("_total", total)
    return large.filter(F.col("_n") > limit).select("_hash", F.expr(f"cast(_n div {hot_rows} + 1 as int)").alias("_salts"))


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    max_bytes: int = MAX_BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
    known_bytes: int | None = None,
) -> DataFrame:
    """`left` joined with `right`, whose keys are unique; every row of `left` stays.

    `known_bytes` is an upper bound of the size of `right` that was measured before; without it the
    size is measured now, by a job.

    A right side measured to be small is broadcast and the log is not shuffled. Else the log is
    shuffled by key and salt: the rows of a hot key are dealt into pieces of about `hot_rows`, and
    its one right row is copied to each piece. Which keys are hot is counted once. Rows with a null
    key match nothing and are spread. A stream cannot be counted; there every key is dealt into
    STREAM_SALTS pieces.
    """
    if fits_broadcast(right, max_bytes) if known_bytes is None else known_bytes <= max_bytes:
        return left.join(F.broadcast(right), keys, "left")

    row = F.monotonically_increasing_id()
    whole = F.lit(True)
    for key in keys:
        whole = whole & F.col(key).isNotNull()
    if left.isStreaming:
        salted = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(STREAM_SALTS)).cast("int"))
        copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(STREAM_SALTS - 1))))
    else:
        hot = F.broadcast(hot_keys(left, keys, hot_rows))
        marked = left.withColumn("_hash", F.xxhash64(*keys)).join(hot, "_hash", "left")
        salt = F.when(~whole, row % NULL_SALTS).otherwise(row % F.coalesce("_salts", F.lit(1)))
        salted = marked.withColumn("_salt", salt.cast("int")).drop("_hash", "_salts")
        spread = right.withColumn("_hash", F.xxhash64(*keys)).join(hot, "_hash", "left")
        copies = spread.withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
        ).drop("_hash", "_salts")
    return salted.join(copies.hint("merge"), [*keys, "_salt"], "left").drop("_salt")


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns so that each is evaluated once per row.

    Catalyst copies the expression of a column into every filter above it. Columns that come out
    of a generator (here over a one-element array) are not copied.
    """
    values = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(values)))
