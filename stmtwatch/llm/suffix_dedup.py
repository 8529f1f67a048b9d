"""Removal of repeated byte strings with block-wise suffix sorting.

A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same or
another document. Such windows are found as equal neighbours among sorted suffixes, one bucket of
suffixes at a time:

1. Buckets. Each window has an anchor: the k bytes inside it with the least hash, the leftmost of
   equals. Equal windows have equal anchors at the same offset, so the suffixes that start with
   windows of one anchor are a bucket, and only suffixes of one bucket can be equal that far.
   Consecutive windows share an anchor, so a document has few: about two per `length` bytes.
2. Buckets met once are dropped: a Bloom filter of anchors met twice, then exact counts. Where the
   whole stretch under an anchor (all its windows) is met twice, all its windows repeat. Both are
   counted before anything else moves.
3. What is left are stretches that are partly equal to another of their bucket. They are gathered by
   bucket, some megabytes at a time. In each block the positions of a difference cover get ranks
   first, by prefix doubling in steps of the cover's period. Then the suffixes of each bucket are
   sorted by the few bytes before their next cover position and by the rank there, which resolves
   long ties without looking at their bytes again. Neighbours that agree in `length` bytes repeat.
4. A bucket of very many different stretches is not gathered: its windows are counted one by one by
   a digest, combined before the shuffle.

Texts move through one shuffle, as distinct texts by their hash; copies count as repeats of each
other. Documents shorter than `length` bytes keep all. Nulls count as empty texts; repeated rows are
copies; results do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtwatch.llm.common import Scratch, checkpointed, whole_text
from stmtwatch.llm.exact_dedup import repeated_filter, with_possible

LENGTH = 200
ANCHOR = 32
# A perfect difference cover: all differences modulo PERIOD occur between two of its elements.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
# Bytes of stretches that are sorted together, at least; buckets are not cut.
BLOCK_BYTES = 4 << 20
# Buckets of more different stretches are counted window by window.
MOST_STRETCHES = 20_000
# Bytes of documents that are scanned together, at least; documents are not cut.
SCAN_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


# --- anchors --------------------------------------------------------------------------------------


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position on, by sums over powers modulo 2**64."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=sums[1:])
    out = (sums[k:] - sums[:-k]) * _powers(_INVERSE, n - k + 1)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def _sliding_minimum(keys: np.ndarray, m: int) -> np.ndarray:
    """Minimum of each run of m keys, from minima within blocks of m."""
    n = len(keys)
    padded = np.full(-(-n // m) * m, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, m)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - m + 1], ahead[m - 1: n])


def anchors(texts: list[bytes], length: int = LENGTH, k: int = ANCHOR):
    """For all texts: text number, first window, number of windows, anchor's offset, anchor's hash."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    hashes = gram_hashes(data, k)
    place = np.uint64((1 << 31) - 1)
    keys = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (_sliding_minimum(keys, length - k + 1) & place).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    window = np.flatnonzero(np.arange(len(anchor)) + length <= ends[text])
    anchor, text = anchor[window], text[window]
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))))[: len(window)]
    count = np.diff(np.append(first, len(window)))
    start = window[first]
    at = anchor[first]
    return text[first], start - (ends - sizes)[text[first]], count, at - start, hashes[at]


def _scan(length: int, k: int):
    names = ["id1", "id2", "low", "windows", "at", "anchor", "stretch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, total = [], [], 0
            for i, (id1, id2, text) in enumerate(zip(*batch.columns)):
                data = text.as_buffer().to_pybytes()
                if len(data) >= length:
                    ids.append((id1.as_py(), id2.as_py()))
                    texts.append(data)
                    total += len(data)
                if texts and (total >= SCAN_BYTES or i + 1 == batch.num_rows):
                    number, low, windows, at, anchor = anchors(texts, length, k)
                    one, two = (np.array(x, np.int64) for x in zip(*ids))
                    spans = zip(number.tolist(), low.tolist(), (low + windows - 1 + length).tolist())
                    stretch = np.fromiter((xxhash.xxh3_64_intdigest(texts[t][a:b]) for t, a, b in spans), np.uint64, len(low))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(one[number]), pa.array(two[number]), pa.array(low.astype(np.int32)),
                        pa.array(windows.astype(np.int16)), pa.array(at.astype(np.int16)),
                        pa.array(anchor.view(np.int64)), pa.array(stretch.view(np.int64)),
                    ], names=names)
                    ids, texts, total = [], [], 0

    return run, "id1 long, id2 long, low int, windows short, at short, anchor long, stretch long"


# --- sorting suffixes -----------------------------------------------------------------------------


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number in the order of bytes. Zeros follow."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j: j + len(data)]
    return out


def _ranked(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks by several keys, the first one first."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        sorted_key = key[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def cover_ranks(words: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the cover's positions by `depth` bytes or more; -1 at all others."""
    n = len(words)
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    sample = np.flatnonzero(inside[np.arange(n) % PERIOD])
    taken = -(-PERIOD // 8)
    get = lambda at: np.where(at < n, words[np.minimum(at, n - 1)], 0)
    ranks = np.full(n, -1, np.int64)
    ranks[sample] = _ranked([get(sample + 8 * j) for j in range(taken)])
    reach = PERIOD
    while reach < depth:
        ahead = sample + reach  # again a position of the cover
        later = np.where(ahead < n, ranks[np.minimum(ahead, n - 1)], -1)
        new = _ranked([ranks[sample], later])
        ranks[sample] = new
        reach *= 2
    return ranks


def repeated_windows(bucket: np.ndarray, stretches: list[bytes], at: np.ndarray, length: int) -> list[np.ndarray]:
    """For each stretch, which of its windows also occur in another one of its bucket.

    Stretches are laid out so that their anchors fall on multiples of the cover's period. Suffixes
    at one offset from their anchors then lie alike in the cover and share the next position.
    """
    sizes = np.array([len(s) for s in stretches], np.int64)
    lead = (-at) % PERIOD
    room = -(-(lead + sizes) // PERIOD) * PERIOD
    start = np.cumsum(room) - room + lead
    data = np.zeros(int(room.sum()), np.uint8)
    for a, s in zip(start.tolist(), stretches):
        data[a: a + len(s)] = np.frombuffer(s, np.uint8)
    words = _words(data)
    ranks = cover_ranks(words, length)
    step = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])

    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(stretches)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    suffix = start[owner] + offset
    before = step[suffix % PERIOD]
    group = _ranked([bucket[owner], at[owner] - offset])
    keys = [group]
    for j in range(-(-int(before.max(initial=0)) // 8)):
        bits = np.clip(before - 8 * j, 0, 8) * 8  # leading bits that count
        word = words[np.minimum(suffix + 8 * j, len(words) - 1)]
        keys.append(np.where(bits > 0, word >> np.where(bits > 0, 64 - bits, 0).astype(np.uint64), np.uint64(0)))
    keys.append(ranks[suffix + before])
    order = np.lexsort(keys[::-1])
    left, right = suffix[order[:-1]], suffix[order[1:]]
    pair = np.flatnonzero(group[order[:-1]] == group[order[1:]])
    for j in range(-(-length // 8)):
        shift = np.uint64(max(0, 8 * (8 * j + 8 - length)))
        pair = pair[(words[left[pair] + 8 * j] >> shift) == (words[right[pair] + 8 * j] >> shift)]
    hit = np.zeros(len(owner), bool)
    hit[order[pair]] = True
    hit[order[pair + 1]] = True
    return np.split(hit, np.cumsum(windows)[:-1])


def _sort_blocks(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        total = 0

        def solved(rows):
            bucket, stretch, n, at, data = zip(*rows)
            hits = repeated_windows(np.array(bucket, np.int64), list(data), np.array(at, np.int64), length)
            out = [(b, s, np.packbits(h).tobytes()) for b, s, k, h in zip(bucket, stretch, n, hits) if k == 1 and h.any()]
            if out:
                a, b, m = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(m, pa.binary())], names=["anchor", "stretch", "mask"]
                )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if total >= BLOCK_BYTES and row[0] != waiting[-1][0]:
                    yield from solved(waiting)
                    waiting, total = [], 0
                waiting.append(row)
                total += len(row[-1])
        if waiting:
            yield from solved(waiting)

    return run


def _window_digests(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, stretch, n, _, data in zip(*(c.to_pylist() for c in batch.columns)):
                count = len(data) - length + 1
                digests = [xxhash.xxh3_128_digest(data[i: i + length]) for i in range(count)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([anchor] * count, pa.int64()), pa.array([stretch] * count, pa.int64()),
                    pa.array([n] * count, pa.int64()), pa.array(range(count), pa.int32()), pa.array(digests, pa.binary()),
                ], names=["anchor", "stretch", "n", "window", "digest"])

    return run


def _counted_windows(stretches: DataFrame, length: int) -> DataFrame:
    """Masks for buckets that are not gathered: windows whose digest is met twice."""
    each = stretches.mapInArrow(
        _window_digests(length), "anchor long, stretch long, n long, window int, digest binary"
    )
    twice = each.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    met = each.filter("n = 1").join(twice, ["anchor", "digest"], "left_semi")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for windows in batch.column(2).to_pylist():
                hit = np.zeros(max(windows) + 1, bool)
                hit[windows] = True
                out.append(np.packbits(hit).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())],
                                             names=["anchor", "stretch", "mask"])

    # A stretch has length - ANCHOR + 1 windows at most.
    grouped = met.groupBy("anchor", "stretch").agg(F.collect_list("window").alias("windows"))
    return grouped.mapInArrow(mask, "anchor long, stretch long, mask binary")


# --- the operator ---------------------------------------------------------------------------------


def _cut_stretches(length: int):
    """Stretches of distinct texts, for the anchors that still have to be sorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, wanted in zip(*batch.columns):
                data = text.as_buffer()
                for w in wanted.as_py():
                    end = w["low"] + w["windows"] - 1 + length
                    rows.append((w["anchor"], w["stretch"], w["n"], w["at"], data.slice(w["low"], end - w["low"]).to_pybytes()))
                if len(rows) >= 10_000:
                    yield _stretch_batch(rows)
                    rows = []
            if rows:
                yield _stretch_batch(rows)

    return run, "anchor long, stretch long, n long, at int, data binary"


def _stretch_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["anchor", "stretch", "n", "at", "data"]
    )


def kept_bytes(data: bytes, marks: list[dict], length: int) -> tuple[bytes, int]:
    """What is left of a text, and the number of runs removed."""
    edges = np.zeros(len(data) + 1, np.int64)
    for mark in marks:
        hit = np.ones(mark["windows"], bool) if mark["mask"] is None else np.unpackbits(
            np.frombuffer(mark["mask"], np.uint8)
        )[: mark["windows"]].astype(bool)
        starts = mark["low"] + np.flatnonzero(hit)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + length, -1)
    gone = np.cumsum(edges[:-1]) > 0
    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), runs


def _remove(length: int):
    names = ["id1", "id2", "n_bytes", "n_removed", "n_spans", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, total = [], 0
            for i, (id1, id2, text, marks) in enumerate(zip(*batch.columns)):
                data = text.as_buffer().to_pybytes()
                kept, spans = kept_bytes(data, marks.as_py(), length) if marks.is_valid else (data, 0)
                out.append((id1.as_py(), id2.as_py(), len(data), len(data) - len(kept), spans, kept))
                total += len(kept)
                if total >= SCAN_BYTES or i + 1 == batch.num_rows:
                    kinds = [pa.int64()] * 5 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out, total = [], 0

    return run, "id1 long, id2 long, n_bytes long, n_removed long, n_spans long, kept binary"


def _identified(docs: DataFrame, text: str) -> DataFrame:
    """The text and two independent hashes of it."""
    value = whole_text(text)
    return docs.select(F.xxhash64(value).alias("id1"), F.xxhash64(F.lit(1), value).alias("id2"), value.alias("text"))


def distinct_results(
    docs: DataFrame, text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, most_stretches: int = MOST_STRETCHES
) -> DataFrame:
    """One row per distinct text: its hashes id1 and id2, n_bytes, n_removed, n_spans and kept."""
    texts = _identified(docs, text)
    scratch = Scratch(docs.sparkSession, "anchors")
    scan, schema = _scan(length, anchor)
    met = scratch.keep(texts.mapInArrow(scan, schema), "met")
    twice = repeated_filter(met, sha="anchor", hashes=1)
    some = checkpointed(with_possible(met, twice, sha="anchor", hashes=1).filter("possible").drop("possible"))
    scratch.drop()

    place = F.struct("id1", "id2", "low", "windows", "at")
    stretches = some.groupBy("anchor", "stretch").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place"))
    buckets = stretches.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("different"), F.count(F.when(F.col("n") == 1, 1)).alias("single")
    ).filter("different > 1 and single > 0")
    wanted = stretches.join(buckets.drop("single"), "anchor").select(
        "place.*", F.struct(
            "anchor", "stretch", "n", "place.low", F.col("place.windows").cast("int").alias("windows"),
            F.col("place.at").cast("int").alias("at"), "different",
        ).alias("w"),
    )
    asked = wanted.groupBy("id1", "id2").agg(F.collect_list("w").alias("wanted"))
    distinct = texts.groupBy("id1", "id2").agg(F.first("text").alias("text"))
    cut, schema = _cut_stretches(length)
    few = asked.select("id1", "id2", F.expr(f"filter(wanted, w -> w.different <= {most_stretches})").alias("wanted"))
    many = asked.select("id1", "id2", F.expr(f"filter(wanted, w -> w.different > {most_stretches})").alias("wanted"))
    gathered = distinct.join(few, ["id1", "id2"]).select("text", "wanted").mapInArrow(cut, schema)
    sorted_ = gathered.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        _sort_blocks(length), "anchor long, stretch long, mask binary"
    )
    masks = stretches.filter("n > 1").select("anchor", "stretch", F.lit(None).cast("binary").alias("mask")).unionByName(sorted_)
    # An exact way for buckets that are too large to be gathered; most inputs have none.
    if buckets.filter(F.col("different") > most_stretches).limit(1).count():
        loose = distinct.join(many.filter("size(wanted) > 0"), ["id1", "id2"]).select("text", "wanted").mapInArrow(cut, schema)
        masks = masks.unionByName(_counted_windows(loose, length))
    marks = some.select("id1", "id2", "low", "windows", "anchor", "stretch").distinct().join(masks, ["anchor", "stretch"])
    marks = marks.groupBy("id1", "id2").agg(F.collect_list(
        F.struct("low", F.col("windows").cast("int").alias("windows"), "mask")
    ).alias("marks"))
    remove, schema = _remove(length)
    return distinct.join(marks, ["id1", "id2"], "left").select("id1", "id2", "text", "marks").mapInArrow(remove, schema)


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False, **options
) -> DataFrame:
    """One row per row of `docs`: key, n_bytes, n_removed, n_spans, and kept, the bytes that are left
    (with `digest` their SHA-256 as kept_sha256)."""
    results = distinct_results(docs, text, **options)
    if digest:
        results = results.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
    value = whole_text(text)
    rows = docs.select(
        F.col(key).alias("_key"), F.xxhash64(value).alias("id1"), F.xxhash64(F.lit(1), value).alias("id2")
    )
    values = [c for c in results.columns if c not in ("id1", "id2")]
    return rows.join(results, ["id1", "id2"]).select(F.col("_key").alias(key), *values)
