"""The rule set: one row per regex, folded to one literal regex per dialect and category."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stmtwatch.schemas import RULES

DIALECTS = ("mysql", "pgsql")
PRIVILEGED_CATEGORIES = ("alter", "drop", "create", "info")

# A regex takes so many rules or characters, about; a category with more of them has several.
RULES_PER_REGEX = 1000
CHARS_PER_REGEX = 50_000

CompiledRules = Mapping[tuple[str, str], tuple[str, ...]]


# The default rules, one case-insensitive regex per line.
_MYSQL = {
    "alter": """
        alter table
        rename table
        alter view
    """,
    "create": """
        create table
        create index
        create database
        create procedure
        create view
    """,
    "drop": """
        drop table
        drop index
        drop database
        drop view
        truncate
    """,
    "info": r"""
        ^desc
        ^status
        describe
        show databases
        show schemas
        show create table
        show create database
        show create procedure
        show columns
        show fields
        show processlist
        show procedure
        show table
        show grants
        show index
        show keys
        show engine
        show function
        show privileges
        show open
        show bdb
        show innodb
        show logs
        show triggers
        show global
        show session
        show variables
        show warnings
        show count
        show status
        show profiles
        show full
        information_schema
        current_user
        user\s*\(\s*\)
        database\s*\(\s*\)
        version\s*\(\s*\)
        mysql.user
        mysql.db
    """,
    "block": r"""
        ^set password
        ^grant
        ^kill
        ^handler
        ^revoke
        flush privileges
        create user
        drop user
        rename user
        backup table
        restore table
        load file
        load data
        into outfile
        into dumpfile
        benchmark\s*\(
        load_file
    """,
    "true constants": """
        current_user
        current_date
        version
    """,
    "bruteforce functions": """
        mid
        substring
        substr
    """,
    "sensitive tables": """
        customer
        member
        order
        admin
        user
        permission
        session
    """,
}
# Rules are searched unanchored, so `information_schema` also covers its qualified views.
_PGSQL = {
    "alter": """
        alter table
        alter database
        alter group
        alter trigger
        alter user
    """,
    "create": """
        create aggregate
        create cast
        create constraint trigger
        create conversion
        create database
        create domain
        create function
        create group
        create index
        create language
        create operator
        create rule
        create schema
        create sequence
        create table
        create trigger
        create type
        create user
        create view
    """,
    "drop": """
        drop aggregate
        drop cast
        drop conversion
        drop database
        drop domain
        drop function
        drop group
        drop index
        drop language
        drop operator
        drop rule
        drop schema
        drop sequence
        drop table
        drop trigger
        drop type
        drop user
        drop view
        truncate
    """,
    "info": """
        information_schema
        pg_database
        pg_class
        pg_attribute
        pg_statistic
        pg_settings
        pg_description
        pg_proc
        pg_shadow
        pg_stats
        pg_tables
        pg_user
        pg_views
        pg_roles
        ^show
    """,
    "block": """
        ^set
        ^set constraints
        ^set session authorization
        ^set transaction
        ^grant
        ^revoke
        ^reset
        create user
        drop user
        create database
        drop database
        create schema
        drop schema
        ^load
        ^lock
    """,
    "true constants": """
        current_user
        current_date
        current_time
        current_timestamp
    """,
    "bruteforce functions": """
        substring
        trim
        bit_length
        char_length
        character_length
        overlay
        octet_length
        position
    """,
    "sensitive tables": _MYSQL["sensitive tables"],
}
DEFAULT_RULES = [
    (dialect, category, pattern)
    for dialect, book in (("mysql", _MYSQL), ("pgsql", _PGSQL))
    for category, lines in book.items()
    for pattern in map(str.strip, lines.strip().splitlines())
]

ANCHORED = ("true constants", "bruteforce functions")


def default_rules(spark: SparkSession) -> DataFrame:
    """The built-in rule set as a table; add rows to extend it."""
    return spark.createDataFrame(pa.table(
        [list(column) for column in zip(*DEFAULT_RULES)], names=RULES.fieldNames()
    ))


def read_rules(spark: SparkSession, path: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Rules from a table, or the built-in set when no path is given."""
    if path is None:
        return default_rules(spark)
    return spark.read.schema(RULES).format(fmt).load(path)


def combined_rules(rules: DataFrame) -> DataFrame:
    """One alternation per dialect, category and some thousand rules, as a table."""
    joined = F.concat_ws("|", F.sort_array(F.collect_list("pattern")))
    order = W.partitionBy("dialect", "category").orderBy("pattern").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.count("pattern").over(order), F.lit(0))
    chars = F.coalesce(F.sum(F.length("pattern")).over(order), F.lit(0))
    return (
        rules.filter(F.length("pattern") > 0)
        .withColumn("piece", F.struct(
            F.floor(before / RULES_PER_REGEX).alias("n"), F.floor(chars / CHARS_PER_REGEX).alias("c")
        ))
        .groupBy("dialect", "category", "piece")
        .agg(joined.alias("alternation"))
        .select(
            "dialect",
            "category",
            "piece",
            F.when(F.col("category").isin(*ANCHORED), F.concat(F.lit("^("), "alternation", F.lit(")$")))
            .when(F.col("category") == "sensitive tables", F.concat(F.lit("("), "alternation", F.lit(")")))
            .otherwise(F.col("alternation"))
            .alias("regex"),
        )
    )


def compile_rules(rules: DataFrame) -> CompiledRules:
    """Fetch the combined rules, so that each becomes a literal in the scoring plan.

    A literal pattern compiles once per task; a join of the log with the rules would be a nested
    loop that compiles per row. A rule set is configuration; one of any size is taken, as several
    regexes per dialect and category where one would be too large.
    """
    compiled: dict[tuple[str, str], tuple[str, ...]] = {}
    for r in combined_rules(rules).orderBy("dialect", "category", "piece").collect():
        compiled[r.dialect, r.category] = (*compiled.get((r.dialect, r.category), ()), r.regex)
    return compiled


def matches(rules: CompiledRules, category: str, dialect: Column, text: Column) -> Column:
    """Does `text` match the category's regex of the row's dialect? No rules, no match."""
    result = None
    for name in sorted({d for d, c in rules if c == category}):
        hit = F.lit(False)
        for regex in rules[(name, category)]:
            hit = text.rlike("(?i)" + regex) if len(rules[(name, category)]) == 1 else hit | text.rlike("(?i)" + regex)
        result = F.when(dialect == name, hit) if result is None else result.when(dialect == name, hit)
    return F.lit(False) if result is None else result.otherwise(F.lit(False))
