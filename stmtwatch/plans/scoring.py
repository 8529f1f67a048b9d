"""The whole dataflow from statement to verdict as one logical plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtwatch.config import RiskWeights
from stmtwatch.functions import signals as S
from stmtwatch.functions.fingerprint import with_pattern
from stmtwatch.operators.gathered import gathered, spread
from stmtwatch.operators.lookup import computed_once
from stmtwatch.operators.policy import in_allowlist, resolve_policy
from stmtwatch.operators.privileged import any_privileged, privileged_columns
from stmtwatch.operators.risk import reason_text, risk_score, verdict_columns, with_signals, with_signals_by_outline
from stmtwatch.operators.session import command_to_sql, inspectable
from stmtwatch.sources.rules import CompiledRules


@dataclass(frozen=True)
class ScoringContext:
    """What the log is scored against. The tables are DataFrames, read anew by each job."""

    policies: DataFrame
    endpoints: DataFrame
    allowlist: DataFrame
    rules: CompiledRules
    weights: RiskWeights = field(default_factory=RiskWeights)
    enforce_block: bool = False
    # Sizes of the tables that were measured before; else each job measures them.
    policy_bytes: int | None = None
    allowlist_bytes: int | None = None


def prepare(log: DataFrame, context: ScoringContext) -> DataFrame:
    """Inspectable statements with pattern, policy and allowlist flag."""
    return _looked_up(inspectable(command_to_sql(log)), context)


def _looked_up(statements: DataFrame, context: ScoringContext) -> DataFrame:
    patterned = computed_once(with_pattern(statements, out="_pattern"), pattern=F.col("_pattern"))
    resolved = resolve_policy(
        patterned.drop("_pattern"), context.policies, context.endpoints, context.policy_bytes
    )
    return in_allowlist(resolved, context.allowlist, known_bytes=context.allowlist_bytes)


def judge(
    flagged: DataFrame, context: ScoringContext, deduplicate: bool = False, folder: str | None = None
) -> DataFrame:
    """Rule classes, signals, score and verdict.

    Listed statements, nearly all of them once learning is over, skip the rules and the signals:
    both sit behind a condition that is false for them.
    """
    unlisted = ~F.col("listed")
    classes = privileged_columns(context.rules, context.enforce_block)
    classed = computed_once(
        flagged, **{n: F.when(unlisted, c).otherwise(F.lit(False)) for n, c in classes.items()}
    )
    classed = classed.withColumn("privileged", any_privileged(classed))
    if deduplicate:
        signalled = with_signals_by_outline(classed, context.rules, only=unlisted, folder=folder)
    else:
        signalled = with_signals(classed, context.rules, only=unlisted)
    reason = F.when(unlisted, reason_text(signalled, context.weights)).otherwise("")
    scored = computed_once(signalled, risk=risk_score(context.weights), reason=reason)
    return computed_once(scored, **verdict_columns(context.weights))


def score_log(
    log: DataFrame, context: ScoringContext, deduplicate: bool = False, folder: str | None = None
) -> DataFrame:
    """Score every statement of a query log, batch or stream, against policies and rules.

    `deduplicate` (batch only) analyses statements of one shape once, in jobs of its own that
    run now. It reads the log twice, which costs little against the analysis of every row. What it
    finds is written to `folder`, by default a new one in the shared folder. A stream can run no
    such jobs; its statements are gathered within each task instead.
    """
    if log.isStreaming:
        return _score_gathered(log, context)
    return judge(prepare(log, context), context, deduplicate, folder)


def _score_gathered(log: DataFrame, context: ScoringContext) -> DataFrame:
    """Score a stream, alike statements once per Arrow batch.

    A score depends on endpoint, dialect, database and text alone, and on the text only as far as its
    skeleton tells. So the rows that share these are gathered, scored as one, and spread again.
    """
    statements = inspectable(command_to_sql(log))
    # The skeleton costs two regexes; it is found once, before the rows go to Python.
    rows = computed_once(statements, _skeleton=S.skeleton(F.col("query")))
    groups = gathered(rows, ["proxy_id", "db_type", "db_name", "_skeleton"])
    scored = judge(_looked_up(groups.withColumnRenamed("_skeleton", "query"), context), context)
    found = spread(scored.drop("query"), statements)
    return found.select(*statements.columns, *[c for c in found.columns if c not in statements.columns])
