"""Signals to score, reasons and verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtwatch.config import (
    LEARNING_MODES,
    LEVEL_BLOCKED,
    LEVEL_HIGH_RISK,
    LEVEL_LOW,
    LEVEL_WARN,
    MODE_ALWAYS_BLOCK_NEW,
    MODE_PRIVILEGE_BLOCK,
    MODE_RISK_BLOCK,
    RiskWeights,
)
from stmtwatch.functions import signals as S
from stmtwatch.operators.lookup import computed_once, lookup_join
from stmtwatch.operators.privileged import privileged_reason
from stmtwatch.sources.rules import CompiledRules
from stmtwatch.sources.storage import scratch_folder

# Flag, weight and reason line, in their order.
SIGNALS = (
    ("has_comment", "comments", "Query has comments\n"),
    ("has_sensitive_table", "sensitive", "Query uses sensitive tables\n"),
    ("has_separator", "multiple", "Multiple queries found\n"),
    ("has_or", "or_token", "Query has 'or' token\n"),
    ("has_union", "union", "Query has 'union' token\n"),
    ("has_tautology", "tautology", "True expression detected (SQL tautology)\n"),
    ("has_empty_password", "empty_password", "Query has empty password expression\n"),
    ("has_bruteforce_fn", "bruteforce",
     "Query has SQL fuction that can be used to bruteforce db contents\n"),
)
NOT_LISTED_REASON = "Query blocked because it is not in whitelist.\n"


def with_tokens(df: DataFrame, col: str = "query", only: Column | None = None) -> DataFrame:
    """Add `outline`, the literal-free token string of a statement, its first word `verb`, and
    `counted`, the part of the outline that is looked at. Rows outside `only` get null."""
    source = F.col(col) if only is None else F.when(only, F.col(col))
    return (
        df.withColumn("outline", S.outline(S.tokens(source)))
        .withColumn("verb", S.verb(F.col("outline")))
        .withColumn("counted", S.window(F.col("outline"), F.col("verb")))
    )


def outline_flags(df: DataFrame, rules: CompiledRules) -> DataFrame:
    """Add the flags that follow from the outline alone: all but `has_separator`."""
    dialect = F.col("db_type")
    worded = (
        df.withColumn("_stated", S.statement(F.col("outline"), F.col("verb")))
        .withColumn("_names", S.named(F.col("_stated")))
        .withColumn("_alike", S.compared_alike(F.col("_names")))
        .withColumn("_simple", S.simplified(F.col("_alike")))
    )
    # In one piece the generated method would exceed the 8,000 bytes that the JIT compiler takes.
    worded = computed_once(worded, _names=F.col("_names"), _simple=F.col("_simple"))
    known = worded.withColumn("_reduced", S.reduced(F.col("_simple"))).withColumn(
        "_known", S.with_constants(F.col("_reduced"), dialect, rules)
    )
    staged = (
        computed_once(known, _known=F.col("_known"))
        .withColumn("_flat", S.flattened(F.col("_known")))
        .withColumn("_tables", F.concat(S.tables(F.col("_flat.selects")), S.starred_tables(F.col("_names"))))
        .withColumn("_compared", S.comparisons(F.col("_flat.selects"), F.col("_flat.cases")))
    )
    flags = {
        "has_comment": S.has_comment(F.col("counted")),
        "has_sensitive_table": S.has_sensitive_table(F.col("_tables"), dialect, rules),
        "has_or": S.has_or(F.col("counted")),
        "has_union": S.has_union(F.col("counted")),
        "has_tautology": S.has_tautology(F.col("_compared")),
        "has_empty_password": S.has_empty_password(F.col("_compared")),
        "has_bruteforce_fn": S.has_bruteforce_fn(F.col("_names"), dialect, rules),
    }
    known = {name: F.coalesce(flag, F.lit(False)) for name, flag in flags.items()}
    return computed_once(staged, **known).select(*df.columns, *flags)


def with_signals(
    df: DataFrame, rules: CompiledRules, col: str = "query", only: Column | None = None
) -> DataFrame:
    """Add the eight risk flags of each statement. Rows outside `only` are not analysed."""
    separator = F.coalesce(S.has_separator(F.col(col), F.col("counted")), F.lit(False))
    flagged = outline_flags(with_tokens(df, col, only), rules)
    return flagged.withColumn("has_separator", separator).select(*df.columns, *S.FLAGS)


def _flags_by_shape(df: DataFrame, rules: CompiledRules, col: str, path: str) -> DataFrame:
    """The flags of each statement of a small table, of which each distinct shape is analysed once.

    A shape is the part of the outline that counts, with lists of equal constants shortened: lists
    and multi-row inserts of any length share one. The analysed shapes are written to `path`, which
    runs a job now; their size is measured there before they are broadcast.
    """
    keys = ["db_type", "_shape_hash", "_shape"]
    rows = with_tokens(df, col).drop("outline", "verb")
    rows = computed_once(rows.withColumn("_shape", S.shape(F.col("counted"))), _shape=F.col("_shape"), counted=F.col("counted"))
    rows = rows.withColumn("_shape_hash", F.xxhash64("_shape"))
    distinct = rows.select(*keys).filter(F.col("_shape").isNotNull()).distinct()
    shapes = distinct.withColumn("outline", F.col("_shape")).withColumn("counted", F.col("_shape"))
    flags = [f for f in S.FLAGS if f != "has_separator"]
    worded = shapes.withColumn("verb", S.verb(F.col("outline")))
    outline_flags(worded, rules).select(*keys, *flags).write.parquet(path)
    joined = lookup_join(rows, df.sparkSession.read.parquet(path), keys)
    separator = F.coalesce(S.has_separator(F.col(col), F.col("counted")), F.lit(False))
    return computed_once(joined, has_separator=separator).select(*df.columns, *S.FLAGS)


def with_signals_by_outline(
    df: DataFrame, rules: CompiledRules, only: Column | None = None, col: str = "query", folder: str | None = None
) -> DataFrame:
    """The same flags, but each distinct statement is analysed once and its flags are joined back.

    Statements are alike first by their skeletons, which cost a row little, then by the shapes of these.
    Skeletons are found by a partial aggregate, so one that makes up a third of the log reaches the
    shuffle once per task. They and their flags are written to `folder`, by default a new one in the
    shared folder, which runs jobs now; the size of the flags is measured there before they are
    broadcast. The join has a hash in front of the text, which is compared only where it meets its like.
    """
    keys = ["_dialect", "_skeleton_hash", "_skeleton"]
    skeleton = S.skeleton(F.col(col))
    rows = computed_once(df, _skeleton=skeleton if only is None else F.when(only, skeleton)).withColumns({
        "_dialect": F.coalesce("db_type", F.lit("")), "_skeleton_hash": F.xxhash64("_skeleton"),
    })
    folder, read = folder or scratch_folder(df.sparkSession), df.sparkSession.read.parquet
    rows.select(*keys).filter(F.col("_skeleton").isNotNull()).distinct().write.parquet(f"{folder}/skeletons")
    skeletons = read(f"{folder}/skeletons").withColumn("db_type", F.col("_dialect"))
    flagged = _flags_by_shape(skeletons, rules, "_skeleton", f"{folder}/shapes")
    flagged.select(*keys, *S.FLAGS).write.parquet(f"{folder}/flags")
    joined = lookup_join(rows, read(f"{folder}/flags"), keys)
    return joined.select(*df.columns, *[F.coalesce(F.col(f), F.lit(False)).alias(f) for f in S.FLAGS])


def risk_score(weights: RiskWeights) -> Column:
    total = F.lit(0)
    for flag, key, _ in SIGNALS:
        weight = getattr(weights, key)
        if weight > 0:
            total = total + F.when(F.col(flag), weight).otherwise(0)
    return total


def with_risk(df: DataFrame, weights: RiskWeights = RiskWeights()) -> DataFrame:
    """Add `risk`, the sum of the weights of the flags that are set."""
    return df.withColumn("risk", risk_score(weights))


def reason_text(df: DataFrame, weights: RiskWeights) -> Column:
    lines = [
        F.when(F.col(flag), text).otherwise("")
        for flag, key, text in SIGNALS
        if getattr(weights, key) > 0
    ]
    blocked = F.when(F.col("status") == MODE_ALWAYS_BLOCK_NEW, NOT_LISTED_REASON).otherwise("")
    return F.concat(privileged_reason(df), *lines, blocked)


def with_reason(df: DataFrame, weights: RiskWeights = RiskWeights()) -> DataFrame:
    """Add `reason`: one line per rule class and signal that was hit."""
    return df.withColumn("reason", reason_text(df, weights))


def risk_band(risk: Column, weights: RiskWeights = RiskWeights()) -> Column:
    """`block`, `warn` or `low`."""
    return (
        F.when(risk >= weights.block_level, "block")
        .when(risk >= weights.warn_level, "warn")
        .otherwise("low")
    )


def verdict_columns(weights: RiskWeights) -> dict[str, Column]:
    """First hit wins: listed, block-all-new, privileged, learning, block level, warn level."""
    mode, risk = F.col("status"), F.col("risk")
    listed = F.col("listed")
    strict = mode == MODE_ALWAYS_BLOCK_NEW
    privileged = F.col("privileged")
    learning = mode.isin(*LEARNING_MODES)
    band = risk_band(risk, weights)
    forced = ~listed & ~strict & privileged
    level = (
        F.when(listed, None)
        .when(strict, LEVEL_BLOCKED)
        .when(privileged & mode.isin(MODE_RISK_BLOCK, MODE_PRIVILEGE_BLOCK), LEVEL_BLOCKED)
        .when(privileged, LEVEL_HIGH_RISK)
        .when(
            learning,
            F.when(band == "block", LEVEL_HIGH_RISK).when(band == "warn", LEVEL_WARN).otherwise(LEVEL_LOW),
        )
        .when((band == "block") & (mode == MODE_RISK_BLOCK), LEVEL_BLOCKED)
        .when(band == "block", LEVEL_HIGH_RISK)
        .when(band == "warn", LEVEL_WARN)
    )
    learn = ~listed & learning
    return {
        "allowed": ~F.coalesce(level == LEVEL_BLOCKED, F.lit(False)),
        "alert": level.isNotNull(),
        "alert_level": level.cast("int"),
        "learn": learn,
        "group_status": F.when(level.isNotNull(), F.when(learn, 1).otherwise(0)).cast("int"),
        "risk": F.when(forced, weights.block_level + 1).otherwise(risk),
    }


def with_verdict(df: DataFrame, weights: RiskWeights = RiskWeights()) -> DataFrame:
    """Add `allowed`, `alert`, `alert_level`, `learn` and `group_status`; a privileged command
    gets a risk just above the block level, whatever its signals."""
    return df.withColumns(verdict_columns(weights))
