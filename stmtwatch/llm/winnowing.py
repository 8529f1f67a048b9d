"""Document fingerprints by winnowing.

1. A text is a sequence of symbols: runs of up to `LONGEST` characters other than blanks and the
   controls 9 to 13.
2. Every run of `k` symbols has a polynomial (Rabin-Karp) hash, which rolls along the text.
3. From each window of `window` hashes in a row the least is kept, of equal ones the rightmost, with
   its position. Window minima are found for all windows at once, by doubling the width.

Two texts that share a run of at least window + k - 1 symbols therefore share a fingerprint (the
match guarantee), and no run of fewer than k symbols gives one. What is stored of a k-gram is a
64-bit hash and the number of symbols before it.

All of it is column expressions, joins and aggregates; the costs of a text grow in proportion to its
length. A text takes some 60 bytes a symbol of one task's memory while it is worked on, however long.

Nulls and texts without symbols have an empty fingerprint. A text of fewer than k symbols has that
of the whole sequence, at position 0. Equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stmtwatch.llm.common import bind, checkpointed, whole_text
from stmtwatch.operators.lookup import computed_once

K = 5
WINDOW = 8
LONGEST = 16
# The hash rolls modulo a prime below 2^31, so that products stay below 2^63.
PRIME = 2_147_483_647
BASE = 1_000_003
# Copies of one row that are written in one piece.
PIECE = 1000


def _symbols(text: str, longest: int) -> str:
    """SQL: a 64-bit hash of every symbol of a text."""
    return f"transform(regexp_extract_all({text}, '[^\\\\x20\\\\x09-\\\\x0D]{{1,{longest}}}', 0), s -> xxhash64(s))"


def _rolled(symbols: str, k: int) -> str:
    """SQL: hash and place of every k-gram in one number; of equal hashes the rightmost is least."""
    value = f"pmod(element_at({symbols}, i + 1), {PRIME}L)"
    for j in range(1, k):
        value = f"(({value}) * {BASE}L + pmod(element_at({symbols}, i + {j + 1}), {PRIME}L)) % {PRIME}L"
    return f"transform(sequence(0, size({symbols}) - {k}), i -> ({value}) * 4294967296L + 4294967295L - i)"


def _window_minima(values: str, window: int) -> str:
    """SQL: the least value of every `window` values in a row (of all, if there are fewer).

    Minima of width m give those of width up to 2 m: a window is the union of two overlapping ones.
    """
    body, width = "m", 1
    while width < window:
        step = min(width, window - width)
        body = bind(body, "m", (
            f"zip_with(slice(m, 1, size(m) - {step}), slice(m, {step + 1}, size(m) - {step}), (a, b) -> least(a, b))"
        ))
        width += step
    return bind(values, "m", f"if(size(m) <= {window}, array(array_min(m)), {body})")


def fingerprint(text: str, k: int = K, window: int = WINDOW, longest: int = LONGEST) -> Column:
    """The fingerprint of the text in column `text`: array of (hash, position), by position."""
    if k < 1 or window < 1:
        raise ValueError("k and window must be at least 1")
    whole = "array(named_struct('hash', xxhash64(s), 'position', 0L))"
    place = "4294967295L - (v & 4294967295L)"
    chosen = bind(
        f"array_distinct({_window_minima(_rolled('s', k), window)})", "c",
        f"transform(c, v -> named_struct('hash', xxhash64(slice(s, cast({place} + 1 as int), {k})), 'position', {place}))",
    )
    return F.expr(bind(
        _symbols(f"coalesce(cast(`{text}` as string), '')", longest), "s",
        "if(size(s) = 0, cast(array() as array<struct<hash: bigint, position: bigint>>), "
        f"if(size(s) < {k}, {whole}, {chosen}))",
    ))


def likeness(a: str, b: str) -> Column:
    """Dice's coefficient of the hashes of two fingerprints: 1 if they are the same, 0 if they share
    none. Two empty ones are alike."""
    return _dice(f"{a}.hash", f"{b}.hash")


def _dice(a: str, b: str) -> Column:
    x, y = f"array_distinct({a})", f"array_distinct({b})"
    return F.expr(
        f"if(size({a}) + size({b}) = 0, 1D, 2D * size(array_intersect({x}, {y})) / (size({x}) + size({y})))"
    )


def as_text(prints: str) -> Column:
    """A fingerprint as one string, hash:position joined by commas."""
    return F.expr(
        f"array_join(transform({prints}, p -> concat(lower(lpad(hex(p.hash), 16, '0')), ':', p.position)), ',')"
    )


def with_fingerprint(
    docs: DataFrame, text: str = "text", name: str = "fingerprint", k: int = K, window: int = WINDOW
) -> DataFrame:
    """`docs` with the fingerprint of each text; a column of that name is replaced."""
    return docs.withColumn(name, fingerprint(text, k, window))


def next_documents(ids: DataFrame) -> DataFrame:
    """`ids` (key, id, hash, ...) of distinct documents with next_id and next_hash, those of the next
    one in descending order of key (null last) and hash; after the last one comes the first.

    The narrow rows are dealt into ranges of that order. Each range finds its own neighbours; the
    first row of every range, as many as there are partitions, is all that meets in one task.
    """
    by = [F.col("key").desc_nulls_last(), F.col("id").desc(), F.col("hash").desc()]
    # Written down, as a range may not move once it has a number.
    ranged = checkpointed(ids.repartitionByRange(*by).withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("range").orderBy(*by)
    ident = F.struct("id", "hash")
    placed = ranged.withColumns({"at": F.row_number().over(inside), "next": F.lead(ident).over(inside)})
    firsts = placed.filter("at = 1").select("range", ident.alias("first"))
    ranges = Window.orderBy("range")  # one row per partition
    start = F.first("first").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = firsts.select("range", F.coalesce(F.lead("first").over(ranges), start).alias("after"))
    found = placed.join(F.broadcast(after), "range").withColumn("next", F.coalesce("next", "after"))
    return found.select(*ids.columns, F.col("next.id").alias("next_id"), F.col("next.hash").alias("next_hash"))


def edited_fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", share: int = 3, k: int = K, window: int = WINDOW
) -> DataFrame:
    """Each document against an edited version of itself and against the next document.

    The edited text has the last n_chars div `share` characters replaced by the first as many (or
    all) of the next document's, in descending order of the key. One row per row of `docs`: the key,
    n_chars, edited (the text), fingerprint, edited_fingerprint, near_edited and near_next.

    Null keys come last. Of one key, texts follow in the order of a hash. Repeated rows (equal key
    and text) are one document: they have the same next one and equal results. A lone document
    follows itself. An empty table gives an empty result; other columns of `docs` play no part.

    Texts move through one shuffle, which both joins read; the parts of the next documents that are
    needed, a third of the text and the hashes, through a second one. Copies are reduced before it,
    so that no document's rows meet in one task, and spread anew afterwards.
    """
    named = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), whole_text(text).alias("text")
    ).withColumn("hash", F.xxhash64("text", F.col("key").isNull()))
    ids = named.groupBy("key", "id", "hash").agg(
        F.max(F.length("text")).cast("long").alias("n_chars"), F.count(F.lit(1)).alias("copies")
    )
    links = checkpointed(next_documents(ids))

    # Both joins read the same columns of the texts, so they share the exchange. Fingerprints do not
    # compress: each side of it computes them anew.
    texts = named.groupBy("id", "hash").agg(F.first(F.struct("key", "text")).alias("doc"))

    def compared(links: DataFrame) -> DataFrame:
        wanted = links.select(
            F.col("id").alias("for_id"), F.col("hash").alias("for_hash"), "n_chars", "copies",
            F.col("next_id").alias("id"), F.col("next_hash").alias("hash"),
        )
        given = texts.join(wanted.hint("merge"), ["id", "hash"]).select("doc.text", *wanted.columns).select(
            F.col("for_id").alias("id"), F.col("for_hash").alias("hash"), "n_chars", "copies",
            F.expr(f"left(text, cast(n_chars div {share} as int))").alias("head"),
            fingerprint("text", k, window)["hash"].alias("next_hashes"),
        )
        met = texts.join(given.hint("merge"), ["id", "hash"]).select(
            "doc.*", "copies", "n_chars", "next_hashes",
            F.concat(F.expr(f"left(doc.text, cast(n_chars - n_chars div {share} as int))"), "head").alias("edited"),
        )
        both = computed_once(
            met, prints=fingerprint("text", k, window), edited_prints=fingerprint("edited", k, window)
        )
        return both.select(
            F.col("key").alias(key), "n_chars", "edited", F.col("prints").alias("fingerprint"),
            F.col("edited_prints").alias("edited_fingerprint"), likeness("prints", "edited_prints").alias("near_edited"),
            _dice("prints.hash", "next_hashes").alias("near_next"), "copies",
        )

    few = compared(links.filter(F.col("copies") <= PIECE)).withColumn("_copy", F.explode(F.expr("sequence(1, int(copies))")))
    out = few.drop("copies", "_copy")
    if not links.filter(F.col("copies") > PIECE).isEmpty():
        out = out.unionByName(_repeated(compared(links.filter(F.col("copies") > PIECE)), "copies"))
    return out


def _repeated(rows: DataFrame, times: str) -> DataFrame:
    """Every row as often as `times` says, in pieces that are spread over the tasks."""
    pieces = rows.withColumn("_piece", F.explode(F.expr(f"sequence(0L, ({times} - 1) div {PIECE})"))).repartition("_piece")
    return pieces.withColumn("_copy", F.explode(F.expr(
        f"sequence(1, int(least({PIECE}, {times} - _piece * {PIECE})))"
    ))).drop(times, "_piece", "_copy")
