"""Mixing of sources to target weights by a multivariate-hypergeometric splitting tree.

1. Every source gets a target in words: its share by weight, at most `most` times its size; what it
   cannot use is shared anew among the others.
2. The documents of a source lie in random order on a line of words, repeated `most` times. The
   words up to the target are cut into equal blocks: the source's block quota. The copy of a
   document belongs to the block in which it starts; the copy that crosses the target is cut there.
3. A binary tree over the output shards splits the quotas of all sources: at each node the left
   half draws its number of blocks without replacement, which is a multivariate hypergeometric draw.
4. In each source the blocks are permuted and the shards take disjoint runs of them.
5. Within a shard, copies are ordered by a hash.

All of it is expressions, joins and aggregates. All draws are hashes of `seed`, so reruns agree.
The documents of a source are put in order in buckets of some thousand rows, so a source with a
third of all rows is no single task. What is kept whole is one row per source, and in each node of
the tree one number per source.

Nulls: a null text has no words, a null source is a source of its own, which comes last; documents
without words are never taken. Repeated rows are separate documents. An empty table gives an empty
mix. Columns of the input keep their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stmtwatch.llm.common import bind, checkpointed, whole_text

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
SHARDS = 64
# A mix that is written down has more shards than that if they would have more words than these.
SHARD_WORDS = 4_000_000
MOST_SHARDS = 1 << 17
# Pieces that the documents of a source of which nothing is taken are dealt into.
PIECES = 1024
BLOCK_WORDS = 4096
# Rows of a source that are ordered in one bucket, on average.
BUCKET_ROWS = 4096
# Up to so many sources their table of some 100 bytes a row is broadcast.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than blanks and the controls 9 to 13."""
    return F.length(F.translate(
        F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), " \t\n\x0b\x0c\r", ""
    )).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """`sizes` (source, words, ...) with rank, weight and target.

    Sources that reach their cap are those with the least cap per weight, so they are a prefix in
    that order: one is capped if the rest of the total, shared by weight, gives it its cap or more.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.get(cycle, F.pmod("rank", F.lit(len(weights)))))
    ranked = ranked.withColumn("cap", F.col("words") * F.lit(float(most)))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("words").over(everything) * F.lit(share)
    rest = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    others = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    capped = ranked.withColumn("_total", total).withColumn("_capped", rest * F.col("weight") >= F.col("cap") * others)
    free = F.col("_total") - F.sum(F.when(F.col("_capped"), F.col("cap")).otherwise(0.0)).over(everything)
    weight = F.sum(F.when(F.col("_capped"), 0.0).otherwise(F.col("weight"))).over(everything)
    return capped.withColumn(
        "target", F.when(F.col("_capped"), F.col("cap")).otherwise(F.least("cap", free * F.col("weight") / F.nullif(weight, F.lit(0.0))))
    ).drop("cap", "_total", "_capped")


# --- the splitting tree ---------------------------------------------------------------------------


def _log_factorial(x: str) -> str:
    return (
        f"if({x} < 17, ln(factorial(cast(greatest({x}, 0) as int))), ({x} + 0.5D) * ln({x}) - {x} + 0.9189385332046727D"
        f" + 1 / (12D * {x}) - 1 / (360D * {x} * {x} * {x}))"
    )


def _uniform(*of: str) -> str:
    return f"((pmod(xxhash64({', '.join(of)}), 9007199254740992L) + 0.5D) / 9007199254740992D)"


def hypergeometric(good: str, bad: str, sample: str, seed: str) -> str:
    """SQL: the good ones among `sample` draws without replacement.

    Few draws are made one by one, many by ratio of uniforms (Stadlober 1989).
    """
    terms = lambda k: " + ".join(_log_factorial(f"({x})") for x in (k, f"h.least - {k}", f"h.n - {k}", f"h.most - h.n + {k}"))
    one_by_one = (
        f"aggregate(if(h.n < 1, cast(array() as array<int>), sequence(1, cast(h.n as int))), named_struct('good', {good}, 'all', h.total), (w, i) -> "
        f"named_struct('good', w.good - if({_uniform(seed, 'i')} * w.all < w.good, 1L, 0L), 'all', w.all - 1L), w -> {good} - w.good)"
    )
    tried = bind(
        f"named_struct('k', i, 'u', {_uniform(seed, '2 * i')}, 'v', {_uniform(seed, '2 * i + 1')})", "t",
        bind(
            "named_struct('u', t.u, 'x', s.a + s.h * (t.v - 0.5D) / t.u)", "p",
            "if(p.x < 0 or p.x >= s.b, named_struct('ok', false, 'k', 0L), " + bind(
                "named_struct('u', p.u, 'k', cast(floor(p.x) as bigint))", "q",
                bind(
                    f"s.g - ({terms('q.k')})", "d",
                    "named_struct('ok', q.u * (4 - q.u) - 3 <= d or (q.u * (q.u - d) < 1 and 2 * ln(q.u) <= d), 'k', q.k)",
                ),
            ) + ")",
        ),
    )
    shape = bind(
        "named_struct('mu', h.n * h.p, 'c', sqrt((h.total - h.n) * h.n * h.p * (1 - h.p) / (h.total - 1) + 0.5D), "
        "'m', cast(floor((h.n + 1D) * (h.least + 1D) / (h.total + 2D)) as bigint))", "r",
        bind(
            "named_struct('a', r.mu + 0.5D, 'h', 1.7155277699214135D * r.c + 0.8989161620588988D, 'm', r.m, "
            f"'g', {terms('r.m')}, 'b', least(least(h.n, h.least) + 1D, floor(r.mu + 0.5D + 16 * r.c)))", "s",
            f"coalesce(filter(transform(sequence(0, 63), i -> {tried}), t -> t.ok)[0].k, s.m)",
        ),
    )
    many = bind(shape, "k", f"if({good} > {bad}, h.n - k, k)")
    drawn = f"if(h.n < 10, {one_by_one}, {many})"
    return bind(
        f"named_struct('total', {good} + {bad}, 'n', least({sample}, {good} + {bad} - {sample}), "
        f"'least', least({good}, {bad}), 'most', greatest({good}, {bad}), 'p', least({good}, {bad}) / greatest({good} + {bad}, 1))", "h",
        f"if({sample} < 1 or {good} < 1, 0L, if({bad} < 1, {sample}, if({sample} >= h.total, {good}, "
        + bind(drawn, "z", f"if({sample} > h.n, {good} - z, z)") + ")))",
    )


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """(rank, shard, first, n): the run of permuted blocks that a shard takes from a source.

    `quotas` has rank (0, 1, ...) and blocks. `shards` is a power of two.
    """
    levels = shards.bit_length() - 1
    if shards != 1 << levels:
        raise ValueError("shards must be a power of two")
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("rank", "blocks"))).alias("q")).select(
        F.lit(0).cast("long").alias("node"), F.expr("transform(q, x -> x.blocks)").alias("counts"),
    ).withColumn("all", F.expr("aggregate(counts, 0L, (a, x) -> a + x)"))
    draw = bind(
        hypergeometric("x", "(a.total - x)", "a.n", f"'{seed}', level, node, size(a.left)"), "l",
        "named_struct('left', concat(a.left, array(l)), 'n', a.n - l, 'total', a.total - x)",
    )
    for level in range(levels):
        width = shards >> level
        slots = lambda shard: f"cast(floor(cast(all as decimal(20,0)) * ({shard}) / {shards}) as bigint)"
        left = F.expr(
            f"aggregate(counts, named_struct('left', cast(array() as array<bigint>), "
            f"'n', {slots(f'node * {width} + {width // 2}')} - {slots(f'node * {width}')}, "
            f"'total', aggregate(counts, 0L, (s, c) -> s + c)), (a, x) -> {draw}, a -> a.left)".replace("level", str(level))
        )
        halves = nodes.withColumn("left", left)
        if level == 4:  # many small nodes from here on
            halves = nodes.repartition("node").withColumn("left", left)
        nodes = halves.select("all", F.expr(
            "inline(array(named_struct('node', 2 * node, 'counts', left), "
            "named_struct('node', 2 * node + 1, 'counts', zip_with(counts, left, (c, l) -> c - l))))"
        ))
    leaves = nodes.select(F.col("node").alias("shard"), F.posexplode("counts").alias("rank", "n"))
    order = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.withColumn("first", F.coalesce(F.sum("n").over(order), F.lit(0)))


def permuted(place: str, size: str, seed: str) -> str:
    """SQL: a permutation of 0 .. size - 1, applied to `place`.

    A Feistel network over a grid of about sqrt(size) columns; cells outside are walked past. The
    grid has fewer cells outside than columns, so the walk is short.
    """
    def step(x: str) -> str:
        body = f"(c.r * g.b + c.s)"
        for i in reversed(range(4)):
            body = bind(
                f"named_struct('r', c.r, 's', pmod(c.s + xxhash64(c.r, {2 * i + 1}, {seed}) % g.b, g.b))", "c", body
            )
            body = bind(
                f"named_struct('r', pmod(c.r + xxhash64(c.s, {2 * i}, {seed}) % g.a, g.a), 's', c.s)", "c", body
            )
        return bind(f"named_struct('r', {x} div g.b, 's', {x} % g.b)", "c", body)

    grid = f"named_struct('a', cast(ceil(sqrt({size})) as bigint), 'b', cast(ceil({size} / ceil(sqrt({size}))) as bigint))"
    return bind(grid, "g", f"aggregate(sequence(1, 48), {step(place)}, (y, i) -> if(y < {size}, y, {step('y')}))")


def drawn_blocks(quotas: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """(rank, block, shard) for every block of every quota."""
    runs = split_quotas(quotas, shards, seed).filter("n > 0").join(quotas.select("rank", "blocks"), "rank")
    places = runs.select("rank", "shard", "blocks", F.explode(F.sequence("first", F.expr("first + n - 1"))).alias("place"))
    return places.select("rank", "shard", F.expr(permuted("place", "blocks", f"rank, '{seed}'")).alias("block"))


# --- documents ------------------------------------------------------------------------------------


def _on_lines(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """`rows` (source, size, ident, ...) with their source's figures and `start` on its line."""
    side = F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources
    placed = rows.join(side.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    placed = placed.withColumn("_at", F.xxhash64("ident", F.lit(seed))).withColumn(
        "_bucket", F.pmod("_at", F.expr(f"docs div {BUCKET_ROWS} + 1"))
    )
    return placed


def _starts(placed: DataFrame, buckets: DataFrame) -> DataFrame:
    offsets = buckets.withColumn("_offset", F.coalesce(
        F.sum("_words").over(Window.partitionBy("rank").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )).drop("_words")
    inside = Window.partitionBy("rank", "_bucket").orderBy("_at", "ident", "size").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(offsets, ["rank", "_bucket"]).withColumn(
        "start", F.col("_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    ).drop("_at", "_bucket", "_offset")


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", size: str | None = None,
    weights=WEIGHTS, share: float = SHARE, most: int = MOST, shards: int = SHARDS,
    block_words: int = BLOCK_WORDS, seed: int = 0,
) -> DataFrame:
    """One row per copy of a document that the mix takes, and one with null epoch for a document of
    which none is taken: row (the input's columns), size, source_size, target, epoch, words, shard,
    place (its order within the shard).

    `size` names a column with the number of words, where that is known; else they are counted.
    """
    counted = F.col(size).cast("long") if size else word_count(whole_text(text))
    rows = docs.select(
        F.struct("*").alias("row"), F.col(source).cast("string").alias("source"), counted.alias("size"),
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("ident"),
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
    sources = source_targets(sizes, weights, share, most).withColumn("quota", F.round("target").cast("long"))
    sources = checkpointed(sources.withColumn("blocks", F.expr(f"cast(ceil(quota / {float(block_words)}D) as bigint)")))

    placed = _on_lines(rows, sources, seed)
    buckets = placed.groupBy("rank", "_bucket").agg(F.sum("size").alias("_words"))
    lines = _starts(placed, buckets)
    copies = lines.withColumn("copy", F.explode_outer(F.expr(f"""
        filter(transform(sequence(0, {most - 1}), e -> named_struct('epoch', e, 'at', e * words + start,
            'words', greatest(0L, least(size, quota - e * words - start)))), c -> c.words > 0)""")))
    copies = copies.select(
        "row", "ident", "size", F.col("words").alias("source_size"), "target", "rank",
        F.col("copy.epoch").alias("epoch"), F.col("copy.words").alias("words"),
        F.when(F.col("copy").isNotNull(), F.expr(
            "least(blocks - 1, cast(floor(copy.at / (quota / nullif(cast(blocks as double), 0D))) as bigint))"
        )).otherwise(-1 - F.pmod(F.xxhash64("ident", "size"), F.lit(PIECES))).alias("block"),
    )
    blocks = drawn_blocks(sources, shards, seed)
    return copies.join(blocks, ["rank", "block"], "left").select(
        "row", "size", "source_size", "target", "epoch",
        F.when(F.col("shard").isNotNull(), F.col("words")).otherwise(0).alias("words"), "shard",
        F.xxhash64("ident", "epoch", F.lit(seed + 1)).alias("place"),
    )


def in_order(mixed: DataFrame, shards: int | None = None) -> DataFrame:
    """The copies shard by shard, shuffled within each. If their number is given, each shard is a
    task of its own; all have as many blocks."""
    taken = mixed.filter("shard is not null")
    if shards is None:
        dealt = taken.repartition("shard")
    else:
        dealt = taken.repartitionById(shards, F.col("shard").cast("int"))
    return dealt.sortWithinPartitions("shard", "place")


def shards_for(words: int, share: float = SHARE) -> int:
    """A power of two: so many shards that none of a mix of `words` words has much over SHARD_WORDS."""
    wanted = max(SHARDS, -(-int(words * share) // SHARD_WORDS))
    return min(1 << (wanted - 1).bit_length(), MOST_SHARDS)


def mixed_documents(docs: DataFrame, text: str = "text", length: str | None = None, **options) -> DataFrame:
    """The mix as rows of `docs`: a document once per copy; the copy that crosses the target keeps
    its leading words. `length` names a column that holds the length of the text. Without `shards`
    their number follows the size of the mix."""
    if "shards" not in options:
        words = docs.agg(F.sum(word_count(whole_text(text)))).first()[0] or 0
        options["shards"] = shards_for(words, options.get("share", SHARE))
    taken = in_order(mix(docs, text=text, **options), options["shards"])
    cut = F.expr(
        "regexp_extract(row.`" + text + "`, concat('^(?:[\\\\x20\\\\x09-\\\\x0D]*+[^\\\\x20\\\\x09-\\\\x0D]++){', words, '}+'), 0)"
    )
    whole = F.col("words") == F.col("size")
    value = F.when(whole, F.col("row")[text]).otherwise(cut)
    columns = []
    for c in docs.columns:
        column = F.col("row")[c]
        if c == text:
            column = value
        elif c == length:
            column = F.when(whole, column).otherwise(F.length(value).cast(docs.schema[c].dataType))
        columns.append(column.alias(c))
    return taken.select(*columns)
