"""Tables stored in buckets of their keys, so that a later look-up moves neither side.

A log that is held against ever new versions of a list is shuffled once, when it is stored. Each
bucket is one task of every later join. A bucket cannot be dealt into pieces, so rows whose key is
hot, or null, are stored apart from the buckets and are met by a broadcast of the hot keys' rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtwatch.operators.lookup import HOT_ROWS, hot_keys, lookup_join

# Of the content of a bucket in the files: a task reads one bucket of each side.
BUCKET_BYTES = 256 * 1024 * 1024


@dataclass(frozen=True)
class Bucketed:
    """A stored table: `rows` in buckets by `keys`, `apart` the rows with a hot or null key."""

    keys: tuple[str, ...]
    buckets: int
    rows: DataFrame
    apart: DataFrame
    hot: DataFrame

    def whole(self) -> DataFrame:
        return self.rows.unionByName(self.apart)


def buckets_for(content_bytes: int) -> int:
    """A power of two, so that tables of unlike sizes can agree on one of them."""
    return 1 << max(0, (content_bytes // BUCKET_BYTES).bit_length())


def store_bucketed(
    df: DataFrame, keys: list[str], path: str, buckets: int, hot_rows: int = HOT_ROWS
) -> Bucketed:
    """Store `df` in a new folder. It is read three times, so it should be a stored table itself.

    Both sides of a look-up need the same keys, in name, type and order, and the same number of
    buckets. A folder that exists is refused; a log grows by further stores.
    """
    spark = df.sparkSession
    hot_keys(df, keys, hot_rows).select("_hash").write.parquet(f"{path}/hot")
    hot = F.broadcast(spark.read.parquet(f"{path}/hot")).withColumn("_hot", F.lit(True))
    whole = F.lit(True)
    for key in keys:
        whole = whole & F.col(key).isNotNull()
    marked = df.withColumn("_hash", F.xxhash64(*keys)).join(hot, "_hash", "left").withColumn(
        "_apart", ~whole | F.coalesce("_hot", F.lit(False))
    ).drop("_hash", "_hot")
    marked.filter("_apart").drop("_apart").write.parquet(f"{path}/apart")
    # One task per bucket writes its one file; the partitioning is that of the buckets.
    marked.filter("not _apart").drop("_apart").repartition(buckets, *keys).write.format("parquet").bucketBy(
        buckets, *keys
    ).sortBy(*keys).option("path", f"{path}/rows").saveAsTable(_table_name())
    spec = [(i, key, buckets) for i, key in enumerate(keys)]
    spark.createDataFrame(spec, "place int, key string, buckets int").coalesce(1).write.parquet(f"{path}/spec")
    return open_bucketed(spark, path)


def open_bucketed(spark: SparkSession, path: str) -> Bucketed:
    """A table stored before, in this session or another. Its layout is declared to the catalogue of
    this session under a name of its own; the files are not read for that."""
    spec = spark.read.parquet(f"{path}/spec").orderBy("place").collect()
    keys, buckets = tuple(r.key for r in spec), spec[0].buckets
    apart, name = spark.read.parquet(f"{path}/apart"), _table_name()
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in apart.schema.fields)
    by = ", ".join(map(_quoted, keys))
    location = f"{path}/rows".replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"create table {name} ({columns}) using parquet clustered by ({by}) sorted by ({by}) into {buckets} buckets "
        f"location '{location}'"
    )
    return Bucketed(keys, buckets, spark.table(name), apart, spark.read.parquet(f"{path}/hot"))


def _table_name() -> str:
    return f"stmtwatch_buckets_{uuid.uuid4().hex}"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def bucketed_lookup(left: Bucketed, right: Bucketed) -> DataFrame:
    """All rows of `left` with the columns of `right`, whose keys are unique.

    Bucket meets bucket without an exchange. Of `right`, only the rows of the hot keys of `left`
    move, a million at most; they are broadcast if they were measured to be small, else the rows of
    `left` stored apart are shuffled by key and salt. Null keys match nothing.
    """
    kinds = [[(k, side.rows.schema[k].dataType) for k in side.keys] for side in (left, right)]
    if kinds[0] != kinds[1] or left.buckets != right.buckets:
        raise ValueError(f"unlike buckets: {left.buckets} by {kinds[0]}, {right.buckets} by {kinds[1]}")
    keys = list(left.keys)
    cold = left.rows.join(right.rows.hint("merge"), keys, "left")
    wanted = right.whole().withColumn("_hash", F.xxhash64(*keys)).join(F.broadcast(left.hot), "_hash", "left_semi")
    return cold.unionByName(lookup_join(left.apart, wanted.drop("_hash"), keys))
