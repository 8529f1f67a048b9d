"""The rule table: folding to regexes, extension by rows, sets of any size."""

from pyspark.sql import functions as F

from stmtwatch.sources import rules as ru


def test_one_regex_per_dialect_and_category(spark, rules):
    assert len(rules) == 16
    assert rules[("mysql", "bruteforce functions")] == ("^(mid|substr|substring)$",)
    assert len(rules[("pgsql", "sensitive tables")]) == 1 and rules[("pgsql", "sensitive tables")][0].startswith("(admin|")


def test_rows_extend_the_rules(spark):
    more = spark.createDataFrame([("mysql", "drop", "^purge\\b"), ("mysql", "sensitive tables", "salary")], ru.RULES)
    compiled = ru.compile_rules(ru.default_rules(spark).unionByName(more))
    texts = spark.createDataFrame(
        [("mysql", "purge logs", True), ("mysql", "select purge", False), ("pgsql", "purge logs", False),
         ("mysql", "DROP TABLE x", True)],
        "db_type string, pattern string, want boolean",
    )
    hit = ru.matches(compiled, "drop", F.col("db_type"), F.col("pattern"))
    assert texts.filter(hit != F.col("want")).collect() == []
    assert "salary" in compiled[("mysql", "sensitive tables")][0]


def test_rules_from_a_file(spark, tmp_path):
    path = f"{tmp_path}/rules"
    ru.default_rules(spark).write.parquet(path)
    assert ru.compile_rules(ru.read_rules(spark, path)) == ru.compile_rules(ru.read_rules(spark))


def test_a_rule_set_of_any_size_is_taken(spark):
    many = spark.range(10_001).select(
        F.lit("mysql").alias("dialect"), F.lit("drop").alias("category"), F.format_string("^purge %05d$", "id").alias("pattern")
    )
    compiled = ru.compile_rules(many)
    assert len(compiled[("mysql", "drop")]) > 5
    texts = spark.createDataFrame([("purge 00000",), ("purge 10000",), ("PURGE 04321",), ("purge 10001",)], "t string")
    hit = ru.matches(compiled, "drop", F.lit("mysql"), F.col("t"))
    assert [r.hit for r in texts.select(hit.alias("hit")).collect()] == [True, True, True, False]
