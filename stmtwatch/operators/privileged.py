"""Privileged commands: rules matched against the pattern of a statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtwatch.operators.policy import can
from stmtwatch.sources.rules import PRIVILEGED_CATEGORIES, CompiledRules, matches

# The reason lines, in their order.
PRIVILEGED_REASONS = {
    "alter": "Detected attempt to change database/table structure.\n",
    "drop": "Detected attempt to drop database/table/index.\n",
    "create": "Detected attempt to create database/table/index.\n",
    "info": "Detected attempt to discover db internal information.\n",
}
_BLOCK_REASON = {"block": "Detected attempt to run a blocked command.\n"}


def privileged_class(rules: CompiledRules, category: str) -> Column:
    """Does the pattern match the category, and does the policy not permit it?"""
    hit = matches(rules, category, F.col("db_type"), F.col("pattern"))
    return F.when(can(F.col("perms"), category), False).otherwise(hit)


def is_alter(rules: CompiledRules) -> Column:
    return privileged_class(rules, "alter")


def is_drop(rules: CompiledRules) -> Column:
    return privileged_class(rules, "drop")


def is_create(rules: CompiledRules) -> Column:
    return privileged_class(rules, "create")


def is_info(rules: CompiledRules) -> Column:
    return privileged_class(rules, "info")


def is_block(rules: CompiledRules) -> Column:
    return privileged_class(rules, "block")


def privileged_columns(rules: CompiledRules, enforce_block: bool = False) -> dict[str, Column]:
    categories = PRIVILEGED_CATEGORIES + (("block",) if enforce_block else ())
    return {f"is_{c}": privileged_class(rules, c) for c in categories}


def any_privileged(df: DataFrame) -> Column:
    result = F.lit(False)
    for category in PRIVILEGED_CATEGORIES + ("block",):
        if f"is_{category}" in df.columns:
            result = result | F.col(f"is_{category}")
    return result


def privileged(df: DataFrame, rules: CompiledRules, enforce_block: bool = False) -> DataFrame:
    """Add `is_alter`, `is_drop`, `is_create`, `is_info` and their union `privileged`.

    The block category is only matched on request: its rules are defined but not enforced by
    default.
    """
    flagged = df.withColumns(privileged_columns(rules, enforce_block))
    return flagged.withColumn("privileged", any_privileged(flagged))


def privileged_reason(df: DataFrame) -> Column:
    lines = [
        F.when(F.col(f"is_{c}"), text).otherwise("")
        for c, text in {**PRIVILEGED_REASONS, **_BLOCK_REASON}.items()
        if f"is_{c}" in df.columns
    ]
    return F.concat(*lines) if lines else F.lit("")
