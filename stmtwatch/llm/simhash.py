"""Near-duplicates by SimHash fingerprints, found with deletion-variant signatures.

A fingerprint of 64 bits is cut into k // 2 + 1 segments. If two differ by at most k bits, they
differ by at most one bit in some segment. For each segment and each of its bits a variant is
indexed, in which that bit is left out; close fingerprints are equal in some variant. Equal variants
meet by a shuffle and are verified by counting the differing bits.

Equal fingerprints are one node. A bucket of more than a few fingerprints is linked by stars: those
within k bits of a pivot are linked to it, the rest goes on with the next pivot, and two stars are
compared only if their pivots are within 3k bits and they are not yet connected. That finds the
same components as all pairs, with fewer links than fingerprints.

Nulls: a null text counts as empty; a text without words has fingerprint zero and is linked like
any other; a null key is ignored when the smallest is looked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtwatch.llm.common import attach, checkpointed, whole_text
from stmtwatch.llm.components import connected_components
from stmtwatch.operators.lookup import fits_broadcast

BITS = 64
SEED = 42  # of the shingle hash
# Buckets up to this size are compared pair by pair.
FEW = 8


def fingerprint(text: str, shingle: int = 4) -> int:
    """Of the lower-cased (A-Z) words' shingles; a bit is set if over half of the hashes have it."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1:].tolist())
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at: at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 4) -> DataFrame:
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.withColumn("fingerprint", simhash(whole_text(text)))


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment."""
    n = distance // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return list(zip(cuts[:-1], [b - a for a, b in zip(cuts, cuts[1:])]))


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def variants(fp: Column, distance: int) -> Column:
    """All one-wildcard variants: number of the bit that is left out, and the rest of its segment."""
    made = []
    for first, width in segments(distance):
        value = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit(_signed((1 << width) - 1)))
        for bit in range(width):
            rest = value.bitwiseAND(F.lit(_signed(((1 << width) - 1) & ~(1 << bit))))
            made.append(F.struct(F.lit(first + bit).cast("short").alias("bit"), rest.alias("rest")))
    return F.array(*made)


def _star_links(fps: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    links, stars, left = [], [], fps
    while len(left):
        near = np.bitwise_count(left ^ left[0]) <= distance
        star = left[near]
        links.append((np.repeat(left[:1], len(star) - 1), star[1:]))
        stars.append(star)
        left = left[~near]
    parent = list(range(len(stars)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    pivots = np.array([s[0] for s in stars])
    for a in range(len(stars) - 1):
        close = np.bitwise_count(pivots[a + 1:] ^ pivots[a]) <= 3 * distance
        for b in (np.flatnonzero(close) + a + 1).tolist():
            if find(a) == find(b):
                continue
            for x in stars[a]:
                hit = np.flatnonzero(np.bitwise_count(stars[b] ^ x) <= distance)
                if len(hit):
                    links.append((np.array([x]), stars[b][hit[:1]]))
                    parent[find(a)] = find(b)
                    break
    return links


def _bucket_links(bucket: np.ndarray, fps: np.ndarray, distance: int) -> np.ndarray:
    """Links within runs of equal buckets. `bucket` is sorted."""
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    size = np.repeat(np.diff(cut), np.diff(cut))
    links = []
    few = np.flatnonzero(size <= FEW)
    for step in range(1, FEW):
        i = few[few + step < len(bucket)]
        i = i[bucket[i] == bucket[i + step]]
        i = i[np.bitwise_count(fps[i] ^ fps[i + step]) <= distance]
        links.append((fps[i], fps[i + step]))
    for start in np.unique(cut[np.searchsorted(cut, np.flatnonzero(size > FEW), "right") - 1]).tolist():
        links += _star_links(np.unique(fps[start: start + size[start]]), distance)
    u, v = (np.concatenate(x) for x in zip(*links))
    return np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)]), axis=1)


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """(u, v): links between the distinct fingerprints of `fps` that give its components."""
    indexed = fps.select("fingerprint", F.explode(variants(F.col("fingerprint"), distance)).alias("x"))
    # Bit and rest fit in one long: a segment has 64 bits at most, but then there is only one.
    keyed = indexed.select(
        F.when(F.lit(distance < 2), F.xxhash64("x.bit", "x.rest")).otherwise(
            F.shiftleft(F.col("x.bit").cast("long"), 56).bitwiseOR(F.col("x.rest"))
        ).alias("bucket"),
        "fingerprint",
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def found(b, f):
            if len(b) < 2:
                return
            u, v = _bucket_links(b, f, distance)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            bucket = np.concatenate([bucket, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False)])
            whole = int(np.searchsorted(bucket, bucket[-1], "left")) if len(bucket) else 0
            if whole >= 1 << 16:
                yield from found(bucket[:whole], fp[:whole])
                bucket, fp = bucket[whole:], fp[whole:]
        yield from found(bucket, fp)

    return keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(link, "u long, v long")


def _fingerprint_classes(rows: DataFrame, distance: int, least: Column) -> DataFrame:
    """(fingerprint, n, best): `best` is the least `least` of its component's rows, n the rows that
    have the fingerprint."""
    fps = checkpointed(rows.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("n"), F.min(least).alias("own")
    ))
    roots = connected_components(links(fps, distance))
    rooted = fps.join(roots, fps.fingerprint == roots.node, "left").select(
        "fingerprint", "n", "own", F.coalesce("root", "fingerprint").alias("root")
    )
    rooted = checkpointed(rooted)
    classes = rooted.groupBy("root").agg(F.min("own").alias("best"), F.count(F.lit(1)).alias("members"))
    return attach(rooted, classes, "root", "members").select("fingerprint", "n", "best")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4
) -> DataFrame:
    """One row per row of `docs`: the key, its fingerprint (long) and component_id, the smallest key
    that can be reached over links of at most `distance` differing bits."""
    rows = checkpointed(with_fingerprint(docs.select(key, text), text, shingle).select(key, "fingerprint"))
    classes = checkpointed(_fingerprint_classes(rows, distance, F.col(key)))
    return attach(rows, classes, "fingerprint", "n").select(
        key, "fingerprint", F.col("best").alias("component_id")
    )


def drop_near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4
) -> DataFrame:
    """The rows of `docs` with one row of each component: that of the smallest key (null last).

    Rows that stay do not move while those that go, or of which one is chosen, can be broadcast.
    """
    ident = F.xxhash64(whole_text(text))
    narrow = docs.select(F.col(key).alias("_key"), ident.alias("_hash"), text)
    rows = checkpointed(with_fingerprint(narrow, text, shingle).select("_key", "_hash", "fingerprint"))
    order = F.struct(F.col("_key").isNull(), "_key", "_hash")
    best = _fingerprint_classes(rows, distance, order).select("best._key", "best._hash").distinct()
    met = best.select(F.col("_key").alias("key"), F.col("_hash").alias("hash"))
    counted = rows.groupBy("_key", "_hash").agg(F.count(F.lit(1)).alias("n"))
    # Rows that go, and rows of which one is to be chosen: equal ones, of the same key and text.
    stays = F.col("hash").isNotNull()
    judged = counted.join(met, F.col("_key").eqNullSafe(F.col("key")) & (F.col("_hash") == F.col("hash")), "left")
    odd = checkpointed(judged.filter(~stays | (F.col("n") > 1)).select(
        F.col("_key").alias("key"), F.col("_hash").alias("hash"), stays.alias("stays")
    ))
    side = F.broadcast(odd) if fits_broadcast(odd) else odd
    packed = docs.select(F.struct("*").alias("row"), F.col(key).alias("_key"), ident.alias("_hash"))
    marked = packed.join(side, F.col("_key").eqNullSafe(F.col("key")) & (F.col("_hash") == F.col("hash")), "left")
    out = marked.filter("stays is null").select("row.*")
    if odd.filter("stays").isEmpty():
        return out
    equal = marked.filter("stays").groupBy("_key", "_hash").agg(F.first("row").alias("row"))
    return out.unionByName(equal.select("row.*"))
