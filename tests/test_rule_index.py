"""Rules found by index against the same rules run one by one."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from stmtwatch.operators.rule_index import _held, required_grams, required_keys, rule_index, with_rule_hits
from stmtwatch.sources import rules as ru

SPECIAL = [
    "drop table", "^purge +logs$", r"\bgrant\b", "user_[0-9]+", "colou?r", "ab*cde", "a|b|long word", "(one|two) three",
    "x{3}", ".*secret.*", "ab", "DROP View", r"lock\s+tables?", r"\Qa.b\E longer", "[abc]def[^x]ghi", "spécial name",
    r"tab\.users", "table.name", "end of it$", "aaaa+bbb", "a+?bcde*", "[]]abcd", r"[\]]efgh", "^desc", "#note", "---",
]
TEXTS = [
    "drop table t", "DROP TABLE t", "purge  logs", "purge logs now", "regrant", "do grant it", "user_17", "user_", "color",
    "colour", "acde", "abbbcde", "long word", "two three", "xxx", "my secrets", "drop view v", "lock tables", "lock  table",
    "a.b longer", "adefyghi", "adefxghi", "spécial name", "tab.users", "tabxusers", "tablexname", "at the end of it", "aaaabbb",
    "aabbb", "abcd", "]abcd", "]efgh", "describe t", "a #note", "a --- b", "", "ab", "K", "\u212Aab drop table", None,
]


def _expected(rules, text, dialect):
    def hit(category, rule):
        rule = rule.replace(r"\Qa.b\E", r"a\.b").replace("[]]", r"[\]]")
        return re.search(f"^({rule})$" if category in ru.ANCHORED else rule, text, re.I | re.A)

    return sorted({c for d, c, r in rules if d == dialect and r and text is not None and hit(c, r)})


def _check(spark, rules, rows, **options):
    table = spark.createDataFrame(rules, ru.RULES)
    df = spark.createDataFrame(rows, "id int, db_type string, pattern string, dialect string, gram string")
    got = with_rule_hits(df, table, **options).collect()
    assert len(got) == len(rows)
    wrong = [(r.pattern, r.rule_hits) for r in got if r.rule_hits != _expected(rules, r.pattern, r.db_type)]
    assert wrong == []


@pytest.mark.parametrize("options", [{}, {"max_bytes": 300}])
def test_special_rules(spark, options):
    rules = [("mysql", f"rule {i}", p) for i, p in enumerate(SPECIAL)]
    rules += [("pgsql", "true constants", "lock tables"), ("mysql", "true constants", "drop table"), ("mysql", "none", "")]
    rows = [(i, d, t, "other", "x") for i, t in enumerate(TEXTS * 2) for d in ("mysql", "pgsql", "else", None)]
    _check(spark, rules, rows, **options)


def test_random_rules_and_texts(spark):
    r = random.Random(8)
    words = ["drop", "table", "user", "log", "a", "id_1", "x9"]
    rule = lambda: r.choice([" ", "_", " +", ".", "[ _]", "s? ", r"\s"]).join(r.sample(words, r.randint(1, 3)))
    rules = list({(r.choice(ru.DIALECTS), f"c{r.randrange(6)}", rule()) for _ in range(300)})
    text = lambda: r.choice([" ", "  ", "_", "s "]).join(r.choices(words, k=r.randint(0, 6)))
    _check(spark, rules, [(i, r.choice(ru.DIALECTS), text(), None, None) for i in range(1500)])


def test_no_rules_and_no_rows(spark):
    rows = [(1, "mysql", "drop table t", "", "")]
    _check(spark, [], rows)
    _check(spark, [("mysql", "c", "drop")], [])
    _check(spark, [("mysql", "c", "(a|b)")], rows)


def test_required_grams(spark):
    cases = [("abcd", ["abc", "bcd"]), ("abcd?", ["abc"]), ("ab|cde", []), ("AbC", ["abc"]), ("a.bcd*e", []), (r"\dabc", ["abc"])]
    rows = spark.createDataFrame(cases, "rule string, want array<string>")
    assert rows.filter(required_grams(F.col("rule")) != F.col("want")).collect() == []


def test_a_hundred_thousand_rules(spark):
    """Their number hardly matters: the texts are looked at, not the rules."""
    log = spark.range(40_000).select(
        F.lit("mysql").alias("db_type"), F.format_string("purge job %d and keep job_%d", "id", F.col("id") * 7).alias("pattern")
    ).repartition(8).persist()
    log.count()

    def seconds(n):
        rules = spark.range(n).select(
            F.lit("mysql").alias("dialect"), F.lit("purge").alias("category"), F.format_string("purge job %06d$", "id").alias("pattern")
        ).unionByName(spark.createDataFrame([("mysql", "keep", "keep job_7$")], ru.RULES))
        start = time.perf_counter()
        hits = with_rule_hits(log, rules).groupBy("rule_hits").count().collect()
        assert {tuple(r.rule_hits): r["count"] for r in hits} == {(): 39_999, ("keep",): 1}
        return time.perf_counter() - start

    seconds(100)
    few, many = seconds(100), seconds(100_000)
    print(f"{few:.1f} s with 100 rules, {many:.1f} s with 100,000")
    assert many < 4 * few + 5
    log.unpersist()


def test_texts_meet_few_rules_however_many_there_are(spark):
    """Three letters are shared by ever more rules; the rules that a text is run on do not grow."""
    texts = spark.range(3000).select(F.lit("mysql").alias("dialect"), F.format_string("get a=%d or b", F.col("id") + 1000).alias("_text"))
    for n in (1000, 9000):
        rules = spark.range(n).select(
            F.lit("mysql").alias("dialect"), F.lit("number").alias("category"), F.format_string(r"[=(] *%d\b", F.col("id") + 1000).alias("pattern")
        )
        index = rule_index(rules, texts, "_text").persist()
        assert index.filter("key is null").count() == 0
        assert _held(texts, index, "_text").join(index, ["dialect", "key"]).count() <= 3000


def test_required_keys(spark):
    cases = [
        (r"=1234\b", "1234", True), (r"=1234\b", "234\x01", True), (r"=1234\\\\b", "1234", True), (r"=1234\\\\b", "1234\x01", False),
        (r"ab1234\b?", "ab1234\x01", False), ("drop \u212Aeys here", "eys here", True), ("end \x01", "end\x01", False),
        (r"ab  \bcd", "ab  \x01", False), ("x" * 17, "x" * 17, False), ("x" * 17, "x" * 12, True),
    ]
    rows = spark.createDataFrame(cases, "rule string, key string, want boolean")
    got = rows.withColumn("got", F.array_contains(required_keys(F.col("rule")), F.col("key"))).filter("got <> want").collect()
    assert got == []


@pytest.mark.parametrize("options", [{}, {"max_bytes": 0, "hot_rows": 2}])
def test_ends_of_words(spark, options):
    rules = [("mysql", f"rule {i}", p) for i, p in enumerate([
        r"user\b", r"long_user_name_x\b", r"drop long tables", r"abcdefghijklmnopqrst\b", r"\bsome\b", "one two three four five six",
    ])]
    texts = [
        "user", "users", "user s", "user\u2014", "userk", "long_user_name_x", "long_user_name_xy", "a long_user_name_x!",
        "Drop Long Tables", "drop long table", "abcdefghijklmnopqrst", "abcdefghijklmnopqrstu", "awesome", "some", "one two three four five six",
    ]
    _check(spark, rules, [(i, "mysql", t, "", "") for i, t in enumerate(texts)], **options)
