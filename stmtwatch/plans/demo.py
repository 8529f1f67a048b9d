"""Query logs and tables derived from the TPC-H-like test tables, in SQL that Spark and DuckDB run
alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stmtwatch.sources.tables import as_query_log

# Twelve statement templates over the orders.
QUERY_LOG_SQL = """
select o_orderkey as seq, o_orderdate as event_time, concat('c', cast(o_custkey % 200 as varchar(20))) as conn_id,
 cast(case when o_custkey % 2 = 0 then 1 else 2 end as int) as proxy_id,
 case when o_custkey % 2 = 0 then 'mysql' else 'pgsql' end as db_type,
 case cast(o_custkey % 5 as int) when 0 then '' when 1 then 'shop' when 2 then 'crm' when 3 then 'lab' else 'other' end as db_name,
 concat('u', cast(o_custkey % 50 as varchar(20))) as db_user, concat('10.0.0.', cast(o_custkey % 250 as varchar(20))) as user_ip,
 case cast(o_orderkey % 12 as int) when 10 then 'create_db' when 11 then 'ping' else 'query' end as command,
 case cast(o_orderkey % 12 as int)
 when 0 then concat('SELECT * FROM lineitem WHERE l_orderkey = ', cast(o_orderkey as varchar(20)))
 when 1 then concat('select c_name from customer where c_custkey=', cast(o_custkey as varchar(20)), ' or 1=1 -- x')
 when 2 then concat('INSERT INTO t VALUES (-', cast(o_custkey as varchar(20)), ', "', o_orderpriority, '")')
 when 3 then concat('UPDATE part SET p_size = ', cast(o_custkey % 50 as varchar(20)), ' WHERE p_name = "', o_orderstatus, '"')
 when 4 then 'DROP TABLE part'
 when 5 then concat('SELECT a FROM users WHERE pwd = "" UNION SELECT ', cast(o_custkey as varchar(20)))
 when 6 then concat('SELECT p_name FROM part WHERE p_size > ', cast(o_custkey % 50 as varchar(20)), '; DELETE FROM part')
 when 7 then 'show tables'
 when 8 then concat('SELECT substring(p_name,1,', cast(o_custkey % 9 as varchar(20)), ') FROM part WHERE p_size = p_size')
 when 9 then concat('SELECT  n_name ,n_nationkey FROM nation WHERE n_nationkey IN ( ', cast(o_custkey % 25 as varchar(20)), ', 7 )')
 when 10 then concat('db', cast(o_custkey % 3 as varchar(20))) else '' end as query from orders
"""

# Probe statements: text (`{k}` is a number from the row), expected pattern, expected flags as
# letters: Comment, Sensitive table, Multiple, Or, Union, Tautology, Empty password, Bruteforce.
PROBES = (
    ("SELECT * FROM Users WHERE id = {k} AND name='O''Brien'",
     "select * from users where id = ? and name=?", "S"),
    ("select a , b from t where x in ( 1, {k} ,3 )", "select a,b from t where x in (?,?,?)", ""),
    ("select -1, - 2 from t where -{k}=x and y = -5",
     "select ?,? from t where ?=x and y = -?", ""),
    ("insert into t values (-1,'a\\'b{k}',\"c\",0xFF,1.50)", "insert into t values (?,?,?,?,?)", ""),
    ("select * from t where id={k} or 1=1 -- tail\n", "select * from t where id=? or ?=? --", "COT"),
    ("select /* hi */ {k} # c\nfrom t", "select /* */ ? #from t", "C"),
    ("select /**/{k}", "select /**/?", "C"),
    ("select {k} /* open comment", "select ? /*", "C"),
    ("select /* a*b */ {k}", "select /* */ ?", "C"),
    ("select a1, t2.c3 from t_9 where v={k}e5", "select a1,t2.c3 from t_9 where v=?e5", ""),
    ("  select\t{k} ;", " select ? ;", ""),
    ("select `a b` from `T1` where p='{k}'", "select `a b` from `t1` where p=?", ""),
    ("select 'unterminated {k}", "select ?", ""),
    ("update t set a={k}.5,b=.5 where c>=0x1F", "update t set a=?,b=.5 where c>=?", ""),
    ("select {k}--2 from t", "select ?--", "C"),
    ("select * from t where {k}={k}", "select * from t where ?=?", "T"),
    ("select * from t where a=a and b={k}", "select * from t where a=a and b=?", "T"),
    ("select * from t where {k}", "select * from t where ?", "T"),
    ("select * from t where a+{k}=a+2", "select * from t where a+?=a+?", "T"),
    ("select * from t where x={k} or 'a'='a'", "select * from t where x=? or ?=?", "OT"),
    ("select * from t where {k} in (1,2)", "select * from t where ? in (?,?)", "T"),
    ("select * from t where a=b=c and d={k}", "select * from t where a=b=c and d=?", "T"),
    ("select * from t where now()=now() and d={k}", "select * from t where now()=now() and d=?", "T"),
    ("select * from t where null is null and d={k}", "select * from t where null is null and d=?", "T"),
    ("select * from t where d={k} and current_user",
     "select * from t where d=? and current_user", "T"),
    ("select * from t join u on 1=1 where d={k}", "select * from t join u on ?=? where d=?", "T"),
    ("select * from t where a=b and c={k}", "select * from t where a=b and c=?", ""),
    ("select * from t where a=a+{k}", "select * from t where a=a+?", ""),
    ("select * from t where a between 1 and {k}", "select * from t where a between ? and ?", ""),
    ("select * from t where a={k} -- 1=1", "select * from t where a=? --", "C"),
    ("select * from t where t.x='1=1' and b={k}", "select * from t where t.x=? and b=?", ""),
    ("select 1={k} from t", "select ?=? from t", ""),
    ("select * from t where Password='' and b={k}", "select * from t where password=? and b=?", "E"),
    ("select * from t where pwd in ('','x') and b={k}", "select * from t where pwd in (?,?) and b=?", ""),
    ("select * from t where a=';xx' and b={k};", "select * from t where a=? and b=?;", ""),
    ("select * from t where b={k}; drop table u", "select * from t where b=?; drop table u", "M"),
    ("select * from a x, reorder y where x.i={k}", "select * from a x,reorder y where x.i=?", "S"),
    ("select * from (select user_id from t) x where i={k}",
     "select * from (select user_id from t) x where i=?", ""),
    ("delete from member where i={k}", "delete from member where i=?", "S"),
    ("select * from t where a in (select x from admin where 1=1) and b={k}",
     "select * from t where a in (select x from admin where ?=?) and b=?", "ST"),
    ("select * from t where exists (select 1 from u where u.x=t.y) and b={k}",
     "select * from t where exists (select ? from u where u.x=t.y) and b=?", ""),
    ("select case {k} when 1 then a end from t", "select case ? when ? then a end from t", "T"),
    ("select a from t group by a having sum(case when a=1 then 1 else 0 end) > {k}",
     "select a from t group by a having sum(case when a=? then ? else ? end) > ?", ""),
    ("select * from t where i={k} union all select * from u where 2=2",
     "select * from t where i=? union all select * from u where ?=?", "UT"),
    ("select substring(a,{k},1) from t", "select substring(a,?,?) from t", "B"),
    ("select * from t where a || {k}", "select * from t where a || ?", "OT"),
)
_LETTERS = {
    "C": "has_comment", "S": "has_sensitive_table", "M": "has_separator", "O": "has_or",
    "U": "has_union", "T": "has_tautology", "E": "has_empty_password", "B": "has_bruteforce_fn",
}
_CODED = {"'": "chr(39)", "\n": "chr(10)", "\t": "chr(9)", "\\": "chr(92)"}


def _sql_text(text: str, number: str = "''") -> str:
    """SQL for a text: quotes and control characters by code, as the engines escape them apart."""
    pieces, plain = [], ""
    rest = text.replace("{k}", "\0")
    for char in rest + "\1":
        if char in _CODED or char in "\0\1":
            if plain:
                pieces.append(f"'{plain}'")
            plain = ""
            if char != "\1":
                pieces.append(number if char == "\0" else _CODED[char])
        else:
            plain += char
    return "concat(" + ", ".join(["''", *pieces]) + ")"


def _by_probe(values: list[str]) -> str:
    cases = " ".join(f"when {i} then {value}" for i, value in enumerate(values))
    return f"case cast((l_orderkey + l_linenumber) % {len(PROBES)} as int) {cases} end"


_NUMBER = "cast(l_partkey as varchar(20))"
# One probe per line item.
PROBE_LOG_SQL = f"""
select l_orderkey * 10 + l_linenumber as seq, l_shipdate as event_time,
 concat('c', cast(l_suppkey as varchar(20))) as conn_id,
 cast(case when l_partkey % 2 = 0 then 1 else 2 end as int) as proxy_id,
 case when l_partkey % 2 = 0 then 'mysql' else 'pgsql' end as db_type,
 'shop' as db_name, 'u' as db_user, '10.0.0.1' as user_ip, 'query' as command,
 {_by_probe([_sql_text(text, _NUMBER) for text, _, _ in PROBES])} as query
from lineitem
"""
_EXPECTED_FLAGS = ", ".join(
    _by_probe([str(letter in flags).lower() for _, _, flags in PROBES]) + f" as {name}"
    for letter, name in _LETTERS.items()
)
EXPECTED_PROBES_SQL = f"""
select l_orderkey * 10 + l_linenumber as seq, l_orderkey, l_linenumber,
 {_by_probe([_sql_text(pattern) for _, pattern, _ in PROBES])} as pattern, {_EXPECTED_FLAGS}
from lineitem
"""

# Policies and endpoints for the logs above.
POLICY_SQL = """
select * from (values
 (1, 0, 'default mysql db', 0, 0, 0, 'default_mysql', timestamp '2020-01-01 00:00:00'),
 (2, 0, 'no-name mysql db', 0, 0, 0, 'empty_mysql', timestamp '2020-01-01 00:00:00'),
 (3, 0, 'default pgsql db', 0, 0, 0, 'default_pgsql', timestamp '2020-01-01 00:00:00'),
 (4, 1, 'shop', 0, 0, 0, 'user_db', timestamp '2020-01-01 00:00:00'),
 (5, 2, 'shop', 15, 0, 1, 'user_db', timestamp '2020-01-01 00:00:00'),
 (6, 1, 'crm', 0, 0, 4, 'user_db', timestamp '2020-01-01 00:00:00'),
 (7, 2, 'crm', 0, 0, 2, 'user_db', timestamp '2020-01-01 00:00:00'),
 (8, 1, 'lab', 0, 0, 10, 'user_db', timestamp '2020-01-01 00:00:00'),
 (9, 2, 'lab', 0, 0, 12, 'user_db', timestamp '2020-01-01 00:00:00')
) as t(dbpid, proxy_id, db_name, perms, perms2, status, sysdbtype, status_changed)
"""
ENDPOINT_SQL = """
select * from (values (1, 'first', 'mysql', 1), (2, 'second', 'pgsql', 1)
) as t(proxy_id, proxyname, dbtype, status)
"""
ALLOWLIST_SQL = """
select * from (values
 (1, 1, 'shop', 'select * from lineitem where l_orderkey = ?'),
 (1, 1, 'crm', 'insert into t values (?,?)'),
 (2, 1, 'lab', 'select n_name,n_nationkey from nation where n_nationkey in (?,?)'),
 (0, 1, '', 'drop table part'),
 (0, 1, 'default_mysql', 'show tables'),
 (0, 1, 'default_pgsql', 'select substring(p_name,?,?) from part where p_size = p_size'),
 (0, 1, 'default', 'select * from lineitem where l_orderkey = ?'),
 (2, 0, 'shop', 'select * from lineitem where l_orderkey = ?')
) as t(proxy_id, perm, db_name, query)
"""
# Larger tables of policies and endpoints: one per customer, one per supplier.
CUSTOMER_POLICY_SQL = """
select cast(c_custkey as int) as dbpid, cast(c_custkey % 150 as int) as proxy_id,
 concat('db', cast(c_nationkey as varchar(20))) as db_name, c_custkey % 64 as perms,
 0 as perms2, cast(case cast(c_custkey % 4 as int) when 0 then 10 when 1 then 11 when 2 then 12 else 2 end as int) as status,
 case cast(c_custkey % 5 as int) when 0 then 'default_mysql' else 'user_db' end as sysdbtype,
 case cast(c_custkey % 4 as int) when 1 then timestamp '2024-01-07 00:00:00' when 2 then timestamp '2024-01-03 00:00:00' else timestamp '2024-01-01 00:00:00' end as status_changed
from customer
"""
SUPPLIER_ENDPOINT_SQL = """
select cast(s_suppkey as int) as proxy_id, s_name as proxyname,
 case when s_suppkey % 2 = 0 then 'mysql' else 'pgsql' end as dbtype, cast(s_suppkey % 4 as int) as status
from supplier
"""
# Session commands over the events.
SESSION_LOG_SQL = """
select event_id as seq, ts as event_time, concat('c', cast(user_id % 20 as varchar(20))) as conn_id, 1 as proxy_id,
 'mysql' as db_type, concat('db', cast(event_id % 7 as varchar(20))) as db_name,
 concat('u', cast(event_id % 13 as varchar(20))) as db_user, '10.0.0.1' as user_ip,
 case when event_id % 10 = 0 then 'login' when event_id % 10 = 5 then 'use_db' when event_id % 30 = 17 then 'quit'
  else 'query' end as command,
 event_id % 15 <> 0 as ok, event_type as query
from events
"""


def derived(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """The result of one of the statements above over the test tables of a folder."""
    inputs = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in tables}
    for name in tables:
        sql = sql.replace(f"from {name}", f"from {{{name}}}")
    return spark.sql(sql, **inputs)


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_query_log(derived(spark, sf_dir, QUERY_LOG_SQL, "orders"))


def probe_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_query_log(derived(spark, sf_dir, PROBE_LOG_SQL, "lineitem"))


def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_query_log(derived(spark, sf_dir, SESSION_LOG_SQL, "events"))
