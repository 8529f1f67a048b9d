"""Literal-free statement fingerprints built only from native string expressions.

Every step reads its input column once, so a whole fingerprint is one linear chain inside one
codegen stage. Loops in the patterns are chunked and possessive: the Java regex engine then neither
backtracks nor recurses, whatever the length of the statement.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SINGLE_QUOTED = r"'(?:[^'\\]++|\\[\s\S]|'')*+(?:'|\\?\z)"
DOUBLE_QUOTED = SINGLE_QUOTED.replace("'", '"')

_QUOTED = r"\G((?:[^'\"\\]++|\\[\s\S])*+)(?:" + SINGLE_QUOTED + "|" + DOUBLE_QUOTED + ")"
_CLOSED_BLOCK_COMMENT = r"/\*(?!\*/)(?:[^*]++|\*(?!/))*+\*/"
_OPEN_BLOCK_COMMENT = r"/\*(?:[^*]++|\*(?!/))*+\z"
_HASH_COMMENT = r"#[^\r\n]*[\r\n]*"
_DASH_COMMENT = r"(\G(?<=[\r\n])-|--)[^\r\n]*[\r\n]*"
_NUMBER = r"(?<=[,!(\x20\t-\r+\-*/=~<>^%|&])(?:0[xX][0-9a-f]*|[0-9]+(?:\.[0-9]*)?)"
# A run of blanks that is not one space already.
_BLANKS = r"[\t-\r][ \t-\r]*| [ \t-\r]+"
_LOOSE_BLANK = r" (?=[),])|(?<=[(,]) | \z"
_UNARY_MINUS = (
    r"(?:(?<=[(,])|(?<=(?:^|[ ,(])(?:select|where|and|or|not) ))- ?(?=\?)"
)


def ascii_lower(text: Column) -> Column:
    """Lowercase A-Z only; letters outside ASCII stay as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def mask_quoted(text: Column) -> Column:
    """Each single- or double-quoted literal becomes `?`; an unterminated one runs to the end."""
    return F.regexp_replace(text, _QUOTED, "$1?")


def reduce_block_comments(text: Column) -> Column:
    """The content of a block comment becomes one blank; its markers stay."""
    closed = F.regexp_replace(text, _CLOSED_BLOCK_COMMENT, "/* */")
    return F.regexp_replace(closed, _OPEN_BLOCK_COMMENT, "/*")


def reduce_hash_comments(text: Column) -> Column:
    """`#` up to and including the line end becomes `#`."""
    return F.regexp_replace(text, _HASH_COMMENT, "#")


def reduce_dash_comments(text: Column) -> Column:
    """`--` up to and including the line end becomes `--`."""
    return F.regexp_replace(text, _DASH_COMMENT, "$1")


def mask_numbers(text: Column) -> Column:
    """Numbers that follow a blank, an operator, a comma or an opening parenthesis become `?`."""
    return F.regexp_replace(text, _NUMBER, "?")


def squeeze_blanks(text: Column) -> Column:
    """One blank between words, none before `)` and `,`, none after `(` and `,`, none at the end."""
    return F.regexp_replace(F.regexp_replace(text, _BLANKS, " "), _LOOSE_BLANK, "")


def drop_unary_minus(text: Column) -> Column:
    """`-?` loses its sign after `(`, `,` and after select/where/and/or/not."""
    return F.regexp_replace(text, _UNARY_MINUS, "")


def fingerprint(text: Column) -> Column:
    """The pattern of a statement: all steps, in their fixed order."""
    masked = mask_quoted(ascii_lower(F.coalesce(text, F.lit(""))))
    uncommented = reduce_dash_comments(reduce_hash_comments(reduce_block_comments(masked)))
    return drop_unary_minus(squeeze_blanks(mask_numbers(uncommented)))


def with_pattern(df: DataFrame, col: str = "query", out: str = "pattern") -> DataFrame:
    """Add the fingerprint of `col`.

    The same as `fingerprint`, but steps for quotes, comments and signs are skipped for statements
    without such characters: a look for a character costs far less than a regex.
    """
    def when_any(text: Column, marks: tuple[str, ...], changed: Column) -> Column:
        found = F.lit(False)
        for mark in marks:
            found = found | F.contains(text, F.lit(mark))
        return F.when(found, changed).otherwise(text)

    text = F.col("_text")
    lowered = df.withColumn("_text", ascii_lower(F.coalesce(F.col(col), F.lit(""))))
    masked = lowered.withColumn("_text", when_any(text, ("'", '"'), mask_quoted(text)))
    uncommented = reduce_dash_comments(reduce_hash_comments(reduce_block_comments(text)))
    bare = masked.withColumn("_text", when_any(text, ("/*", "#", "--"), uncommented))
    squeezed = bare.withColumn("_text", squeeze_blanks(mask_numbers(text)))
    signed = squeezed.withColumn(out, when_any(text, ("-",), drop_unary_minus(text)))
    return signed.drop("_text")
