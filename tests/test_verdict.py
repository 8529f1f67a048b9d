"""The verdict matrix, policy resolution, permissions and learning periods."""

import datetime as dt
from itertools import product

import pytest
from pyspark.sql import functions as F

from stmtwatch.config import RiskWeights
from stmtwatch.operators import policy as po
from stmtwatch.operators.risk import with_risk, with_verdict
from stmtwatch.schemas import POLICY
from stmtwatch.sources.tables import usable_allowlist

MODES = (0, 1, 2, 3, 4, 10, 11, 12, 99)


def expected(listed, privileged, mode, risk):
    """(allowed, level, learn, group status, risk)"""
    learning = mode in (10, 11, 12)
    if listed:
        return True, None, False, None, risk
    if mode == 4:
        return False, 1, False, 0, risk
    if privileged:
        if mode in (0, 1):
            return False, 1, False, 0, 31
        return True, 2, learning, int(learning), 31
    if learning:
        return True, 2 if risk >= 30 else 0 if risk >= 20 else 3, True, 1, risk
    if risk >= 30:
        return (False, 1, False, 0, risk) if mode == 0 else (True, 2, False, 0, risk)
    if risk >= 20:
        return True, 0, False, 0, risk
    return True, None, False, None, risk


def test_every_row_of_the_matrix(spark):
    rows = list(product((True, False), (True, False), MODES, (0, 19, 20, 29, 30, 75)))
    df = spark.createDataFrame(rows, "listed boolean, privileged boolean, status int, was int")
    got = with_verdict(df.withColumn("risk", F.col("was"))).collect()
    for r in got:
        want = expected(r.listed, r.privileged, r.status, r.was)
        assert (r.allowed, r.alert_level, r.learn, r.group_status, r.risk) == want, r
        assert r.alert == (want[1] is not None)


def test_weights(spark):
    flags = ("has_comment has_sensitive_table has_separator has_or has_union has_tautology "
             "has_empty_password has_bruteforce_fn").split()
    df = spark.range(1).select(*[F.lit(True).alias(f) for f in flags])
    assert with_risk(df).first().risk == 30 + 10 + 30 + 5 + 10 + 30 + 30 + 15
    assert with_risk(df, RiskWeights(comments=0, tautology=-5, union=5)).first().risk == 95
    with pytest.raises(ValueError):
        RiskWeights.from_mapping({"comment": 1})


def _policies(spark, *rows):
    start = dt.datetime(2024, 1, 1)
    full = [(i, proxy, db, perms, 0, status, kind, start) for i, proxy, db, perms, status, kind in rows]
    return spark.createDataFrame(full, POLICY)


def _resolved(spark, policies, **options):
    log = spark.createDataFrame(
        [(1, "mysql", "shop"), (1, "mysql", "SHOP"), (1, "mysql", ""), (1, "mysql", None), (2, "pgsql", "x"),
         (2, "pgsql", ""), (9, "mysql", "shop"), (1, "other", "y")],
        "proxy_id int, db_type string, db_name string",
    )
    endpoints = spark.createDataFrame([(1, "a", "mysql", 1), (2, "b", "pgsql", 3)],
                                      "proxy_id int, proxyname string, dbtype string, status int")
    rows = po.resolve_policy(log, policies, endpoints).collect()
    return [(r.policy_kind, r.policy_proxy_id, r.policy_db_name, r.status) for r in rows]


def test_policy_resolution(spark):
    policies = _policies(
        spark,
        (1, 0, "x", 0, 1, "default_mysql"), (2, 0, "y", 0, 2, "empty_mysql"), (3, 0, "z", 0, 3, "default_pgsql"),
        (4, 1, "shop", 0, 10, "user_db"), (5, 1, "shop", 0, 4, "user_db"), (6, 9, "shop", 0, 12, "user_db"),
    )
    # Of two rows for one database the later holds; a policy without an endpoint does not.
    assert sorted(_resolved(spark, policies)) == sorted([
        ("user", 1, "shop", 4), ("system", 0, "default_mysql", 1), ("system", 0, "", 2), ("system", 0, "", 2),
        ("system", 0, "default_pgsql", 3), ("system", 0, "default_pgsql", 3),
        ("system", 0, "default_mysql", 1), ("builtin", 0, "default", 0),
    ])


def test_built_in_policy(spark):
    assert set(_resolved(spark, _policies(spark))) == {("builtin", 0, "default", 0)}


@pytest.mark.parametrize("options", [{}, {"max_bytes": 0, "hot_rows": 3}, {"max_bytes": 0, "hot_rows": 10**6},
                                     {"max_bytes": 250, "hot_rows": 3}])
def test_allowlist_joins_agree(spark, options):
    """Broadcast, hot keys apart, and shuffled: every row stays, once."""
    rows = [(i, "user", 1, "shop", "hot" if i % 3 else f"p{i}") for i in range(60)]
    rows += [(100, "builtin", 0, "default", "hot"), (101, "user", 2, "shop", "hot"), (102, "user", 1, "shop", None)]
    log = spark.createDataFrame(
        rows, "seq int, policy_kind string, policy_proxy_id int, policy_db_name string, pattern string"
    )
    listed = usable_allowlist(spark.createDataFrame(
        [(1, 1, "shop", "hot"), (1, 1, "shop", "hot"), (1, 1, "shop", "p3"), (0, 1, "default", "hot"),
         (1, 0, "shop", "p6"), (1, 1, "shop", "")],
        "proxy_id int, perm int, db_name string, query string",
    ))
    got = {r.seq: r.listed for r in po.in_allowlist(log, listed, **options).collect()}
    want = {i: kind == "user" and proxy == 1 and pattern in ("hot", "p3") for i, kind, proxy, _, pattern in rows}
    assert got == want


def test_perm_bits(spark):
    df = spark.createDataFrame([(n,) for n in range(64)], "perms long")
    for r in po.decode_perms(df).collect():
        for name, bit in (("create", 1), ("drop", 2), ("alter", 4), ("info", 8), ("block", 16), ("bruteforce", 32)):
            assert r[f"can_{name}"] == bool(r.perms & bit)


def test_learning_ends_after_its_days_not_at(spark):
    policies = _policies(spark, (1, 1, "a", 0, 11, ""), (2, 1, "b", 0, 12, ""), (3, 1, "c", 0, 10, ""))

    def modes(text):
        now = F.lit(text).cast("timestamp")
        return [r.status for r in po.expire_learning(policies, now).orderBy("dbpid").collect()]

    assert modes("2024-01-04 00:00:00") == [11, 12, 10]
    assert modes("2024-01-04 00:00:01") == [4, 12, 10]
    assert modes("2024-01-08 00:00:00") == [4, 12, 10]
    assert modes("2024-01-08 00:00:01") == [4, 4, 10]
