"""Ranked lexical search by norm buckets (LEMP).

A document is a sparse vector of term impacts, an item a sparse vector of term weights, and the
score their inner product. Exact top lists are found without scoring every pair:

1. One scan counts the terms of the items in every document. The counts are written down, narrow.
2. Each partition orders its vectors by length (norm) and cuts them into buckets. Per bucket and item:
   - Cauchy-Schwarz: if |item| |longest vector| is below the k-th best score known, this bucket and
     all later ones are skipped, and so is the bucket's end from the first vector that is too short;
   - coordinate bounds: the item's heaviest coordinates are added up exactly, the others can add at
     most |rest of the item| |rest of the vector|; vectors that stay below the k-th best score go;
   - the survivors are scored exactly, in integers.
3. A first round over the longest bucket of every partition gives the k-th best scores that the second
   round, over all other buckets, starts from.

No vectors are shuffled and no task depends on another's; k rows an item and partition meet at the
end. Items are searched in blocks of at most `MOST_TERMS` terms (or one item), which bounds what a
task and the driver hold of them; every block reads all documents.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are
lower-cased. Null and empty texts have no terms: such documents are never found, such items find
none. Very long texts are counted whole. Equal scores are ordered by key, null keys last; repeated
rows are documents of their own, and repeated items are searched as often. Without documents
nothing is found. Other columns play no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stmtwatch.llm.common import Scratch, whole_text

TOP = 10
# Terms of the items that are searched together.
MOST_TERMS = 200_000
# Vectors of a bucket; of the first one of a partition.
BUCKET = 4096
FIRST = 256
# Share of an item's squared length that its focus coordinates hold.
FOCUS = 0.7
# What rounding may take from a bound.
SLACK = 1 + 1e-9
# Bytes of text whose terms are counted together.
TOGETHER = 1 << 21

# Of lower-cased UTF-8: every byte of a character beyond ASCII belongs to a term.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms(text: str) -> list[bytes]:
    return _TERM.findall(text.encode("utf-8", "replace").lower())


class Items:
    """Items as sparse vectors over the terms they hold."""

    def __init__(self, texts: list[str]):
        counts = [Counter(terms(t)) for t in texts]
        self.vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for c in counts for t in c))}
        self.terms = [np.fromiter((self.vocabulary[t] for t in c), np.int64, len(c)) for c in counts]
        self.times = [np.fromiter(c.values(), np.int64, len(c)) for c in counts]

    def weigh(self, documents: int, holding: np.ndarray) -> None:
        """Give every item its weights, heaviest first, and the number of its focus coordinates."""
        weight = np.array([
            math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in holding.tolist()
        ], np.int64)
        self.coordinates, self.weights, self.focus, self.norm, self.rest = [], [], [], [], []
        for term, times in zip(self.terms, self.times):
            w = times * weight[term]
            order = np.argsort(-w, kind="stable")
            order = order[w[order] > 0]
            w, term = w[order], term[order]
            squares = np.cumsum(w.astype(float) ** 2)
            total = squares[-1] if len(w) else 0.0
            focus = int(np.searchsorted(squares, FOCUS * total)) + 1 if len(w) else 0
            self.coordinates.append(term)
            self.weights.append(w)
            self.focus.append(focus)
            self.norm.append(math.sqrt(total))
            self.rest.append(math.sqrt(max(total - squares[focus - 1], 0.0)) if focus else 0.0)


def _counted(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(row, key, n, terms, times): the number of terms and the counts of those in the vocabulary."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), whole_text(text).alias("text"))
    schema = T.StructType([
        rows.schema["row"], rows.schema["key"], T.StructField("n", T.LongType()),
        T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.LongType())),
    ])
    width = max(len(vocabulary), 1)

    def counted(batch: pa.RecordBatch, found: list[list[bytes]]) -> pa.RecordBatch:
        lens = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(
            (i for words in found for i in map(vocabulary.get, words, repeat(-1))), np.int64, int(lens.sum())
        )
        cells = (np.repeat(np.arange(len(found)), lens) * width + ids)[ids >= 0]
        cells, times = np.unique(cells, return_counts=True)
        offsets = np.searchsorted(cells, np.arange(len(found) + 1) * width).astype(np.int32)
        lists = [
            pa.ListArray.from_arrays(pa.array(offsets), pa.array((cells % width).astype(np.int32))),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(times.astype(np.int64))),
        ]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(lens), *lists], names=schema.fieldNames()
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size, found = 0, 0, []
            for i, value in enumerate(batch.column(2)):
                text = value.as_py()
                size += len(text)
                found.append(terms(text))
                if size >= TOGETHER or i + 1 == batch.num_rows:
                    yield counted(batch.slice(start, len(found)), found)
                    start, size, found = i + 1, 0, []

    return rows.mapInArrow(run, schema)


def _weighed(counted: DataFrame, documents: int, all_terms: int) -> DataFrame:
    """The counted rows with their impacts instead of counts, and their norm."""
    schema = T.StructType([
        counted.schema["row"], counted.schema["key"], T.StructField("norm", T.DoubleType()),
        T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("impacts", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, times = batch.column(3), batch.column(4).flatten().to_numpy()
            lens = lists.value_lengths().to_numpy()
            m = np.array([25 + 75 * n * documents // all_terms for n in batch.column(2).to_pylist()], np.int64)
            impacts = 1_000_000_000 * times // (1000 * times + 8 * np.repeat(m, lens))
            sums = np.concatenate([[0.0], np.cumsum(impacts.astype(float) ** 2)])
            ends = np.cumsum(lens)
            # Differences of running sums lose a little; a norm may be too large, not too small.
            norm = np.sqrt(np.maximum(sums[ends] - sums[ends - lens], 0.0) + 1e-12 * sums[ends])
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(norm),
                pa.ListArray.from_arrays(offsets, lists.flatten()), pa.ListArray.from_arrays(offsets, pa.array(impacts)),
            ], names=schema.fieldNames())

    return counted.mapInArrow(run, schema)


class Bucket:
    """Vectors in descending order of norm, by row and by coordinate."""

    def __init__(self, rows, keys, norm, terms, impacts, lens, width):
        self.rows, self.keys, self.norm = rows, keys, norm
        order = np.argsort(terms, kind="stable")
        self.at = np.repeat(np.arange(len(norm)), lens)[order]
        self.impacts = impacts[order]
        self.starts = np.searchsorted(terms[order], np.arange(width + 1))

    def search(self, items: Items, q: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, score) of the vectors that reach `least`."""
        n = int(np.searchsorted(-self.norm, -least / (items.norm[q] * SLACK), "right"))  # Cauchy-Schwarz
        none = np.empty(0, np.int64)
        if not n:
            return none, none
        score, squares = np.zeros(len(self.norm), np.int64), np.zeros(len(self.norm))
        pairs = list(zip(items.coordinates[q].tolist(), items.weights[q].tolist()))
        for i, (term, weight) in enumerate(pairs):
            low, high = self.starts[term], self.starts[term + 1]
            if low < high:
                at, impact = self.at[low:high], self.impacts[low:high]
                score[at] += weight * impact
                if i < items.focus[q]:
                    squares[at] += impact.astype(float) ** 2
            if i + 1 == items.focus[q]:
                left = np.sqrt(np.maximum(self.norm[:n] ** 2 * SLACK - squares[:n], 0.0))
                alive = np.flatnonzero((score[:n] + items.rest[q] * left) * SLACK + 1 >= least)
                if not len(alive):
                    return none, none
        found = alive[(score[alive] >= max(least, 1))]
        return found, score[found]


def _searched(weighed: DataFrame, items: Items, least: list[int], top: int, first: bool) -> DataFrame:
    """(item, key, row, score) of at least the best `top` of each partition's first bucket, or of its
    other buckets, that reach the item's least score."""
    schema = T.StructType([
        T.StructField("item", T.IntegerType()), weighed.schema["key"], T.StructField("row", T.LongType()),
        T.StructField("score", T.LongType()),
    ])
    width = len(items.vocabulary)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size, wanted = [], 0, FIRST
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, wanted - size)
                batch = batch.slice(part.num_rows)
                held.append(part)
                size += part.num_rows
                if size == wanted:
                    yield pa.Table.from_batches(held)
                    held, size, wanted = [], 0, BUCKET
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[] for _ in least]
        known, kind = list(least), None
        for number, table in enumerate(buckets(batches)):
            kind = table.schema.field("key").type
            if number == 0 and not first:
                continue
            table = table.combine_chunks()
            terms, impacts = table["terms"].combine_chunks(), table["impacts"].combine_chunks()
            bucket = Bucket(
                table["row"].to_numpy(), table["key"], table["norm"].to_numpy(), terms.flatten().to_numpy(),
                impacts.flatten().to_numpy(), terms.value_lengths().to_numpy(), width,
            )
            for q in range(len(known)):
                if not items.norm[q] or known[q] > items.norm[q] * bucket.norm[0] * SLACK:
                    continue
                place, score = bucket.search(items, q, known[q])
                if len(score) > top:  # ties of the last one stay
                    enough = score >= np.partition(score, -top)[-top]
                    place, score = place[enough], score[enough]
                if not len(score):
                    continue
                keys = bucket.keys.take(pa.array(place)).to_pylist()
                rows = bucket.rows[place].tolist()
                best[q] += [(-s, k is None, k, r) for s, k, r in zip(score.tolist(), keys, rows)]
                best[q] = sorted(best[q], key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0, x[3]))[:top]
                if len(best[q]) == top:
                    known[q] = max(known[q], -best[q][-1][0])
            if first:
                break
        out = [(q, k, r, -s) for q, found in enumerate(best) for s, _, k, r in found]
        if out:
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([
                pa.array(columns[0], pa.int32()), pa.array(columns[1], kind),
                pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()),
            ], names=schema.fieldNames())

    return weighed.sortWithinPartitions(F.col("norm").desc(), "row").mapInArrow(run, schema)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _blocks(queries: DataFrame, item: str, text: str, most: int) -> Iterator[list]:
    """The items as lists of (id, text), each of at most `most` terms or of one item."""
    block, size = [], 0
    for row in queries.select(F.col(item).alias("id"), whole_text(text).alias("text")).toLocalIterator():
        count = len(terms(row.text))
        if block and size + count > most:
            yield block
            block, size = [], 0
        block.append(row)
        size += count
    if block:
        yield block


def search(
    docs: DataFrame, queries: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", most_terms: int = MOST_TERMS,
) -> DataFrame:
    """The `top` highest-scoring documents of every item: item_id, rank, doc_id (named as `item` and
    `key`) and score; only scores above 0."""
    spark = docs.sparkSession
    kind = queries.schema[item]
    made = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("id", kind.dataType)])
    scratch = Scratch(spark, "search")
    results = []
    for number, block in enumerate(_blocks(queries, item, item_text, most_terms)):
        items = Items([row.text for row in block])
        counted = scratch.keep(_counted(docs, key, text, items.vocabulary), f"counted-{number}")
        documents, all_terms = counted.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
        holding = np.zeros(len(items.vocabulary), np.int64)
        # At most as many rows as the block has terms.
        for row in counted.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            holding[row.term] = row["count"]
        items.weigh(documents, holding)
        # Only vectors with a coordinate can be found.
        weighed = _weighed(counted.filter("size(terms) > 0"), documents, all_terms or 1)
        start = scratch.keep(_ranked(_searched(weighed, items, [1] * len(block), top, True), top), f"first-{number}")
        least = [1] * len(block)
        for row in start.filter(F.col("rank") == top).toLocalIterator():  # one row per item
            least[row["item"]] = row.score
        rest = _searched(weighed, items, least, top, False)
        ranked = _ranked(start.drop("rank").unionByName(rest), top)
        names = spark.createDataFrame([(i, row.id) for i, row in enumerate(block)], made)
        results.append(scratch.keep(ranked.join(F.broadcast(names), "item").select(
            F.col("id").alias(item), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score"
        ), f"found-{number}"))
        scratch.drop(f"counted-{number}")
        scratch.drop(f"first-{number}")
    if not results:
        empty = T.StructType([
            T.StructField(item, kind.dataType), T.StructField("rank", T.IntegerType()),
            T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.LongType()),
        ])
        return spark.createDataFrame([], empty)
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
