"""Statements of one skeleton have one pattern and the same flags."""

import random

from pyspark.sql import functions as F

from stmtwatch.functions import fingerprint as fp
from stmtwatch.functions import signals as S
from stmtwatch.operators import risk as rk
from stmtwatch.plans import demo

PIECES = [
    "select * from t where ", "a", "=", "1", "12", " 12 ", "1.5", "0x1F", "1e+5", "1.", ".5", "-", "--", "-- 12\n", "#", "/*", "*/", "/* 1 */",
    "'", '"', "''", '""', "'ab'", "'a 1'", "'1'", "'27'", '"x"', '"1\'2"', "b'101'", "B '10'", "b 'zz'", "`a 1`", "`", "\\", "\\'", "'O''Brien'",
    ";", "; ", ";1", "; 12", " or ", " and ", " 3=3 ", " union select ", "password=", "pwd=''", "(", ")", ",", " in (1, 22)", "@v1", "t2.c3", "é",
    "'é'", " 7é", "users", " from ", "case 1 when 12 then 3 end", "\n", "\t9", "||", "1=1", "null", "substring(a,1,2)", "%5", "!6", "+7",
]


def _texts(n):
    r = random.Random(5)
    texts = [text.replace("{k}", number) for text, _, _ in demo.PROBES for number in ("7", "1234", "5.25")]
    return texts + ["".join(r.choices(PIECES, k=r.randint(1, 9))) for _ in range(n)] + [
        "select * from t where " + "".join(r.choices(PIECES, k=r.randint(1, 6))) for _ in range(n)
    ]


def test_same_pattern_and_flags(spark, rules):
    log = spark.createDataFrame(
        [(i, d, t) for i, t in enumerate(_texts(4000)) for d in ("mysql", "pgsql")], "seq int, db_type string, query string"
    )
    found = lambda col: rk.with_signals(fp.with_pattern(log.withColumn("query", col)), rules).select("seq", "db_type", "pattern", *S.FLAGS)
    plain, reduced = found(F.col("query")), found(S.skeleton(F.col("query")))
    assert [r.seq for r in plain.exceptAll(reduced).collect()] == []


def test_numbers_and_literals_do_not_tell_statements_apart(spark):
    log = spark.range(2000).select(F.explode(F.array(
        F.format_string("select a from t where b = %d and c in (%d, 3.%d)", "id", "id", "id"), F.format_string("update t set a='name %d' where b=\"%d\"", "id", "id"),
        F.format_string("select %d -- of %d\n", "id", "id"),
    )).alias("query"))
    assert log.select(S.skeleton(F.col("query"))).distinct().count() == 3


def test_kinds_of_literals_stay_apart(spark):
    texts = ["pwd=''", "pwd='x1'", "a=b'10'", "a=b'zz'", "`a 1`=`a 2`", "`a 1`=`a 1`", "t2", "t3"]
    log = spark.createDataFrame([(t,) for t in texts], "query string")
    assert log.select(S.skeleton(F.col("query"))).distinct().count() == len(texts)


def test_rows_without_dialect_or_text(spark, rules):
    log = spark.createDataFrame([(1, None, "select 1 or 2; drop table t"), (2, "mysql", None), (3, "mysql", "")], "seq int, db_type string, query string")
    plain, joined = rk.with_signals(log, rules), rk.with_signals_by_outline(log, rules)
    assert sorted(map(tuple, plain.collect()), key=lambda r: r[0]) == sorted(map(tuple, joined.collect()), key=lambda r: r[0])
