"""Helpers of the text operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A group is hot from this share of all rows on; there are fewer than HOT_SHARE hot groups.
HOT_SHARE = 1000
# Groups of fewer rows are never hot.
HOT_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by the cluster in spark.checkpoint.dir.

    Only a local session may go without; it gets a temporary folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="stmtwatch-llm-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of `df`, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables in a new folder below the shared one, deleted when they are no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def drop(self, name: str | None = None) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root if name is None else f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def whole_text(text: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def bind(value: str, name: str, body: str) -> str:
    """SQL: `body` in which `name` stands for `value`, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int | None = None) -> DataFrame:
    """`rows` joined with `groups` (one row per key, `size` rows of `rows` each).

    The groups that hold more than a thousandth of all rows are fewer than a thousand, whatever the
    input: they are broadcast, and their rows stay where they are. All others are joined by a
    shuffle, in which no key has more than a thousandth of the rows. Keys are never null.
    """
    total = rows.count() if total is None else total
    limit = max(HOT_ROWS, total // HOT_SHARE)
    values = [c for c in groups.columns if c != key]
    hot = groups.filter(F.col(size) > limit).select(key, F.struct(*values).alias("_hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    kept = [c for c in rows.columns if c != key]
    met = marked.filter(F.col("_hot").isNotNull()).select(key, *kept, *[F.col(f"_hot.{c}").alias(c) for c in values])
    rest = marked.filter(F.col("_hot").isNull()).drop("_hot").join(groups.filter(F.col(size) <= limit), key)
    return met.unionByName(rest.select(key, *kept, *values))
