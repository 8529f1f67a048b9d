"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtwatch.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v: long): root is the least node it can reach.

    Alternates the two star operations until nothing changes, which takes a number of rounds that
    grows with the logarithm of the input. Each round is a few aggregates and joins by node; nodes
    with very many links are reduced before the shuffle, and their join is split by AQE. A round is
    written to the shared folder, so a lost executor costs the current round at most.
    """
    rounds, n = Scratch(edges.sparkSession, "components"), 0
    tidy = lambda df: df.filter("u <> v").distinct()
    digest = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    edges = rounds.keep(tidy(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), "0")
    before = digest(edges)
    while before[0]:
        edges = rounds.keep(tidy(_small_star(tidy(_large_star(edges)))), str(n + 1))
        rounds.drop(str(n))
        n += 1
        after = digest(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()).checkpoint()
    rounds.drop()
    return out
