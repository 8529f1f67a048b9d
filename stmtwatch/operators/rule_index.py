"""Rule sets of any size, matched through an inverted index of the letters that a rule requires.

`compile_rules` makes every rule part of a regex that each statement runs through, so its cost grows
with the rules. Here each rule that is a plain sequence is filed under a key: letters in a row that any
text it matches must hold, as rare as the rule offers. A text looks up the keys it holds, and only the
few rules found are run on it. Rules without three such letters in a row (alternations, groups, short
words) take the other way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtwatch.functions.fingerprint import ascii_lower
from stmtwatch.operators.lookup import HOT_ROWS, MAX_BROADCAST_BYTES, lookup_join
from stmtwatch.sources.rules import ANCHORED, compile_rules, matches
from stmtwatch.sources.storage import scratch_folder

GRAM = 3
# Letters of the longest key, and of the windows of a longer run that may be its key.
LONGEST = 16
_SIZES = (GRAM, 6, 12)
# The letters of keys. There are 38 of them, so 54,872 grams at most, whatever the texts and rules.
_LETTERS = "a-z0-9_ "
# Behind the letters of a key: a word must end there. No letter of a key.
_WORD_END = "\x01"
_RULE = ["dialect", "category", "pattern"]


def _windows(text: Column, size: int) -> Column:
    """All stretches of `size` characters of a text."""
    stretches = F.transform(
        F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size))
    )
    return F.when(F.length(text) >= size, stretches).otherwise(F.array().cast("array<string>"))


def _runs(rule: Column) -> Column:
    """The runs of letters that every match of a rule holds, in lower case; none if that cannot be told
    by sight. A run that must end a word is followed by the mark for it.

    Escapes, classes and what may be absent (`x*`, `x?`) cut the rule into pieces; `x+` and `.` cut it,
    too, as they are no letters. Alternations, groups, counts, quoted parts and escapes that take in
    what follows them are not looked into.
    """
    cut = F.lit("\x00")
    unescaped = F.regexp_replace(F.translate(rule, _WORD_END, "\x00"), F.lit(r"\\[^b]"), cut)
    unescaped = F.regexp_replace(unescaped, F.lit(r"\\b"), F.lit(_WORD_END))
    unclassed = F.regexp_replace(unescaped, F.lit(r"\[[^\[\]]*\]"), cut)
    certain = F.regexp_replace(unclassed, F.lit(r"[\s\S][*?]"), cut)
    plain = ~unclassed.rlike(r"[|(){}\[\]]") & ~rule.rlike(r"\\[QEcxuNpPk0-9]")
    run = rf"[{_LETTERS}]{{{GRAM},}}(?:(?<! ){_WORD_END})?"
    return F.when(plain, F.regexp_extract_all(ascii_lower(certain), F.lit(run), F.lit(0))).otherwise(
        F.array().cast("array<string>")
    )


def required_grams(rule: Column) -> Column:
    """Grams that every match of a rule holds."""
    grams = F.transform(_runs(rule), lambda run: _windows(F.rtrim(run, F.lit(_WORD_END)), GRAM))
    return F.array_distinct(F.flatten(grams))


def required_keys(rule: Column) -> Column:
    """Stretches of letters that every match of a rule holds: whole runs, and windows of each run. At
    the end of a run that must end a word they do so, too."""

    def keys(run: Column) -> Column:
        letters = F.rtrim(run, F.lit(_WORD_END))
        ends = F.length(run) > F.length(letters)
        whole = F.when(F.length(letters) <= LONGEST, F.array(letters)).otherwise(F.array().cast("array<string>"))
        stretches = F.concat(whole, *[_windows(letters, size) for size in _SIZES])
        at_end = F.transform(
            F.filter(stretches, lambda w: ends & letters.endswith(w)), lambda w: F.concat(w, F.lit(_WORD_END))
        )
        return F.concat(stretches, at_end)

    return F.array_distinct(F.flatten(F.transform(_runs(rule), keys)))


def _pieces(text: Column) -> Column:
    """The different pieces of a text, from each place on, of as many letters as a key can have and one
    more. Each key that a text holds is the beginning of a piece."""
    return F.array_distinct(F.regexp_extract_all(
        ascii_lower(text), F.lit(f"(?=([{_LETTERS}]{{{GRAM},{LONGEST + 1}}}))"), F.lit(1)
    ))


def _head(key: Column) -> Column:
    return F.substring(key, 1, GRAM)


def rule_index(rules: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """(dialect, category, pattern, key): each rule under the key that costs least, that is the one
    with the fewest rules times texts that hold its first gram; of equal ones the longest. `key` is null
    for rules that cannot be filed.

    Counts of texts by gram are broadcast: there are 54,872 grams at most.
    """
    usable = rules.select(*_RULE).filter(F.length("pattern") > 0).distinct()
    filed = usable.withColumn("key", F.explode_outer(required_keys(F.col("pattern"))))
    by_rules = filed.dropna(subset=["key"]).groupBy("key").agg(F.count(F.lit(1)).alias("_rules"))
    by_texts = (
        texts.select(F.explode(F.array_distinct(F.transform(_pieces(F.col(text)), _head))).alias("_head"))
        .groupBy("_head").agg(F.count(F.lit(1)).alias("_texts"))
    )
    costed = lookup_join(filed, by_rules, ["key"]).withColumn("_head", _head(F.col("key"))).join(
        F.broadcast(by_texts), "_head", "left"
    )
    cost = F.col("_rules") * (F.coalesce("_texts", F.lit(0)) + 1)
    order = F.struct(cost, -F.length("key"), F.col("key"))
    return costed.groupBy(*_RULE).agg(F.min_by("key", order).alias("key"))


def _held(texts: DataFrame, filed: DataFrame, text: str) -> DataFrame:
    """`texts` with each key they hold that begins and is as long as some key of the index.

    Which lengths of keys begin with a gram is broadcast: there are 54,872 grams and some 30 lengths.
    """
    key = F.col("key")
    kind = F.struct(
        F.length(F.rtrim(key, F.lit(_WORD_END))).alias("size"), key.endswith(_WORD_END).alias("ends")
    )
    kinds = filed.groupBy(_head(key).alias("_head")).agg(F.collect_set(kind).alias("_kinds"))
    pieces = texts.withColumn("_piece", F.explode(_pieces(F.col(text)))).withColumn("_head", _head(F.col("_piece")))
    looked_up = pieces.join(F.broadcast(kinds), "_head").withColumn("_kind", F.explode("_kinds"))
    piece, size, ends = F.col("_piece"), F.col("_kind.size"), F.col("_kind.ends")
    goes_on = F.substring(piece, size + 1, F.lit(1)).rlike("[a-z0-9_]")
    held = looked_up.filter((size <= F.length(piece)) & ~(ends & goes_on))
    letters = F.substring(piece, F.lit(1), size)
    return held.select(
        *texts.columns, F.concat(letters, F.when(ends, _WORD_END).otherwise("")).alias("key")
    )


def _regex() -> Column:
    whole = F.when(F.col("category").isin(*ANCHORED), F.concat(F.lit("^("), "pattern", F.lit(")$")))
    return F.concat(F.lit("(?i)"), whole.otherwise(F.col("pattern")))


def with_rule_hits(
    df: DataFrame,
    rules: DataFrame,
    text: str = "pattern",
    dialect: str = "db_type",
    out: str = "rule_hits",
    max_bytes: int = MAX_BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the categories with a rule of the row's dialect that matches its text, sorted.

    Batch only; runs jobs now. Each distinct text is looked at once. An index of up to `max_bytes` is
    broadcast; a larger one is joined by key, where the texts of a key with more than `hot_rows` of them
    are dealt into pieces. The categories found are joined back by `lookup_join`. A null text, an empty
    one and one without a hit have an empty list.
    """
    folder = scratch_folder(df.sparkSession)
    read = df.sparkSession.read.parquet
    named = df.select(F.col(dialect).alias("dialect"), F.col(text).alias("_text"))
    named.dropna().distinct().write.parquet(f"{folder}/texts")
    texts = read(f"{folder}/texts")
    rule_index(rules, texts, "_text").write.parquet(f"{folder}/index")
    index = read(f"{folder}/index")

    filed = index.filter("key is not null")
    candidates = lookup_join(
        _held(texts, filed, "_text"), filed, ["dialect", "key"], max_bytes=max_bytes, hot_rows=hot_rows
    ).filter("pattern is not null")
    found = [candidates.filter(F.rlike(F.col("_text"), _regex())).select("dialect", "_text", "category")]
    others = compile_rules(index.filter("key is null").drop("key"))
    if others:
        hits = [
            F.when(matches(others, c, F.col("dialect"), F.col("_text")), c)
            for c in sorted({category for _, category in others})
        ]
        found.append(texts.withColumn("category", F.explode(F.array_compact(F.array(*hits)))))
    union = found[0]
    for more in found[1:]:
        union = union.unionByName(more)
    listed = union.groupBy(F.col("dialect").alias(dialect), F.col("_text").alias(text)).agg(
        F.sort_array(F.collect_set("category")).alias("_hits")
    )
    listed.write.parquet(f"{folder}/hits")
    joined = lookup_join(df, read(f"{folder}/hits"), [dialect, text])
    empty = F.array().cast("array<string>")
    return joined.select(*[c for c in df.columns if c != out], F.coalesce("_hits", empty).alias(out))
