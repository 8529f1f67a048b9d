"""The expected result of each catalog query as SQL over the same tables.

The SQL takes another way than the operators wherever it can: flags and patterns come from the
number of the statement's template, not from its text.
"""

from __future__ import annotations

from stmtwatch.plans import demo
from stmtwatch.sources.rules import DEFAULT_RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _nested(text: str, *rules: tuple[str, str]) -> str:
    for pattern, replacement in rules:
        pattern = pattern.replace("'", "''")
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return text


_NUMBERS = (r"([,!( \t-\r+\-*/=~<>^%|&])(0[xX][0-9a-f]*|[0-9]+(\.[0-9]*)?)", r"\1?")
_BLANKS = ((r"[ \t-\r]+", " "), (r" ([),])", r"\1"), (r"([(,]) ", r"\1"), (r" $", ""))
_MINUS = (r"(^|[ ,(])(select |where |and |or |not )- ?\?", r"\1\2?")
_MINUS_2 = (r"([(,])- ?\?", r"\1?")
# Enough for the texts of the query log, which has neither escapes nor block comments.
_PATTERN = _nested(
    f"translate(query, '{_UPPER}', '{_LOWER}')",
    ("\"[^\"]*\"", "?"), ("'[^']*'", "?"), ("--[^\n]*", "--"), _NUMBERS, *_BLANKS, _MINUS, _MINUS_2,
)


def _rules(category: str) -> str:
    def alternation(dialect: str) -> str:
        found = [p for d, c, p in DEFAULT_RULES if (d, c) == (dialect, category)]
        return "(?i)" + "|".join(found)

    return (
        f"case db_type when 'mysql' then regexp_matches(pattern, '{alternation('mysql')}') "
        f"when 'pgsql' then regexp_matches(pattern, '{alternation('pgsql')}') else false end"
    )


def _templates(*numbers: int) -> str:
    return f"(seq % 12 in ({', '.join(map(str, numbers))}))"


_FLAGS = {
    "has_comment": _templates(1),
    "has_sensitive_table": _templates(1, 5),
    "has_separator": _templates(6),
    "has_or": _templates(1),
    "has_union": _templates(5),
    "has_tautology": _templates(1, 8),
    "has_empty_password": _templates(5),
    "has_bruteforce_fn": _templates(8),
}
_WEIGHTS = {
    "has_comment": 30, "has_sensitive_table": 10, "has_separator": 30, "has_or": 5, "has_union": 10,
    "has_tautology": 30, "has_empty_password": 30, "has_bruteforce_fn": 15,
}
_REASONS = {
    "is_alter": "Detected attempt to change database/table structure.",
    "is_drop": "Detected attempt to drop database/table/index.",
    "is_create": "Detected attempt to create database/table/index.",
    "is_info": "Detected attempt to discover db internal information.",
    "has_comment": "Query has comments",
    "has_sensitive_table": "Query uses sensitive tables",
    "has_separator": "Multiple queries found",
    "has_or": "Query has 'or' token",
    "has_union": "Query has 'union' token",
    "has_tautology": "True expression detected (SQL tautology)",
    "has_empty_password": "Query has empty password expression",
    "has_bruteforce_fn": "Query has SQL fuction that can be used to bruteforce db contents",
    "status = 4": "Query blocked because it is not in whitelist.",
}


def _weighted(weights: dict[str, int]) -> str:
    return " + ".join(f"(case when {flag} then {w} else 0 end)" for flag, w in weights.items())


def _reason() -> str:
    lines = [
        f"case when {flag} then '" + text.replace("'", "''") + "' || chr(10) else '' end"
        for flag, text in _REASONS.items()
    ]
    return " || ".join(lines)


# The whole dataflow, one step per table expression.
CHAIN = f"""
with query_log as ({demo.QUERY_LOG_SQL}),
spoken as (
 select * exclude (query), case when command = 'create_db' and query = '' then ''
  when command = 'create_db' then 'create database ''' || query || '''' else query end as query
 from query_log
),
stmts as (
 select * from spoken where length(query) > 0 and (
  (db_type = 'mysql' and command in ('query', 'prepare', 'create_db', 'drop_db', 'field_list', 'process_info'))
  or (db_type = 'pgsql' and command in ('query', 'parse')))
),
patterned as (select *, {_PATTERN} as pattern from stmts),
policy as ({demo.POLICY_SQL}),
endpoint as ({demo.ENDPOINT_SQL}),
allowlist as ({demo.ALLOWLIST_SQL}),
usable as (select distinct proxy_id, db_name, query from allowlist where perm > 0 and query <> ''),
resolved as (
 select p.*, case when u.dbpid is not null then 'user' when s.dbpid is not null then 'system' else 'builtin' end as policy_kind,
  case when u.dbpid is not null then p.proxy_id else 0 end as policy_proxy_id,
  case when u.dbpid is not null then p.db_name when s.sysdbtype = 'empty_mysql' then ''
   when s.dbpid is not null then s.sysdbtype else 'default' end as policy_db_name,
  cast(coalesce(u.perms, s.perms, 0) as bigint) as perms, coalesce(u.status, s.status, 0) as status
 from patterned p
 left join (select y.* from policy y join endpoint e on y.proxy_id = e.proxy_id) u
  on u.proxy_id = p.proxy_id and u.db_name = p.db_name
 left join (select * from policy where proxy_id = 0) s on s.sysdbtype =
  case when p.db_type = 'mysql' and p.db_name = '' then 'empty_mysql' when p.db_type = 'mysql' then 'default_mysql'
   when p.db_type = 'pgsql' then 'default_pgsql' end
),
flagged as (
 select r.*, a.query is not null as listed from resolved r left join usable a
  on a.proxy_id = r.policy_proxy_id and a.db_name = r.policy_db_name and a.query = r.pattern
  and r.policy_kind <> 'builtin'
),
classed as (
 select *, perms & 4 = 0 and {_rules("alter")} as is_alter, perms & 2 = 0 and {_rules("drop")} as is_drop,
  perms & 1 = 0 and {_rules("create")} as is_create, perms & 8 = 0 and {_rules("info")} as is_info,
  perms & 16 = 0 and {_rules("block")} as is_block
 from flagged
),
signalled as (
 select *, is_alter or is_drop or is_create or is_info as privileged,
  {', '.join(f'{sql} as {name}' for name, sql in _FLAGS.items())}
 from classed
),
points as (select *, {_weighted(_WEIGHTS)} as points, {_reason()} as full_reason from signalled),
judged as (
 select *, case when listed then null when status = 4 then 1 when privileged and status in (0, 1) then 1
  when privileged then 2 when status in (10, 11, 12) then case when points >= 30 then 2 when points >= 20 then 0 else 3 end
  when points >= 30 and status = 0 then 1 when points >= 30 then 2 when points >= 20 then 0 end as alert_level
 from points
),
verdict as (
 select *, coalesce(alert_level <> 1, true) as allowed, alert_level is not null as alert,
  not listed and status in (10, 11, 12) as learn,
  case when alert_level is null then null when status in (10, 11, 12) then 1 else 0 end as group_status,
  case when listed then 0 when status <> 4 and privileged then 31 else points end as risk,
  case when listed then '' else full_reason end as reason
 from judged
),
alert_rows as (
 select event_time, risk, alert_level as block, db_user as dbuser, user_ip as userip, query, reason,
  proxy_id, db_name, pattern, group_status as status from verdict where alert
),
groups as (
 select proxy_id, db_name, max(event_time) as update_time, max(status) as status, pattern
 from alert_rows group by proxy_id, db_name, pattern
),
learned as (
 select distinct policy_proxy_id as proxy_id, policy_db_name as db_name, pattern as query from verdict where learn
),
unlisted as (select l.* from learned l where not exists (
 select 1 from allowlist a where a.proxy_id = l.proxy_id and a.db_name = l.db_name and a.query = l.query))
"""


def _chained(sql: str) -> str:
    return f"{CHAIN} {sql}"


_ALERT_COLUMNS = "event_time, risk, block, dbuser, userip, query, reason"
_ALERTS = _chained(f"select {_ALERT_COLUMNS} from alert_rows")
# A log that comes in three micro-batches: what a learning policy has met in one of them is listed
# from the next one on.
_BY_BATCH = """, by_batch as (
 select *, seq % 3 as batch, min(case when learn then seq % 3 end)
  over (partition by policy_proxy_id, policy_db_name, pattern) as learned_in from verdict)
"""
_RAISED = "alert and not (learn and batch > learned_in)"
_REFRESHED = _chained(
    f"{_BY_BATCH} select event_time, risk, alert_level as block, db_user as dbuser, user_ip as userip, query, reason "
    f"from by_batch where {_RAISED}"
)
_GROUPS = _chained("select * from groups")
_MERGED_LIST = _chained(
    "select proxy_id, perm, db_name, query from allowlist "
    "union all select proxy_id, 1 as perm, db_name, query from unlisted"
)
_USABLE_LIST = _chained(
    "select proxy_id, perm, db_name, query from allowlist where perm > 0 "
    "union all select proxy_id, 1 as perm, db_name, query from unlisted"
)
_EXPIRED = f"""
select dbpid, case when status = 11 and timestamp '2024-01-10 00:00:00' > status_changed + interval 3 day then 4
 when status = 12 and timestamp '2024-01-10 00:00:00' > status_changed + interval 7 day then 4 else status end as status
from ({demo.CUSTOMER_POLICY_SQL})
"""
_SESSIONS = f"""
with log as ({demo.SESSION_LOG_SQL}), marked as (
 select *, case when command = 'quit' then '' when command = 'login' then db_user end as set_user,
  case when command = 'quit' then '' when command = 'login' or (command = 'use_db' and ok) then db_name end as set_db
 from log)
"""
_SESSION_CONTEXT = _SESSIONS + """
select seq, conn_id, command, coalesce(last_value(set_user ignore nulls) over w, '') as db_user,
 coalesce(last_value(set_db ignore nulls) over w, '') as db_name
from marked window w as (partition by conn_id order by seq rows between unbounded preceding and current row)
"""
_SESSION_TIMEOUTS = _SESSIONS + """, timed as (
 select *, case when event_id % 101 = 50 or event_id % 53 = 7 then null else met_at end as sane from (
  select *, seq as event_id, event_time as met_at from marked)),
gaps as (
 select *, coalesce(sane > last_value(sane ignore nulls) over (partition by conn_id order by seq
  rows between unbounded preceding and 1 preceding) + interval 3 hour, false) as silent from timed),
ended as (
 select seq, conn_id, command, case when silent then coalesce(set_user, '') else set_user end as set_user,
  case when silent then coalesce(set_db, '') else set_db end as set_db from gaps)
select seq, conn_id, command, coalesce(last_value(set_user ignore nulls) over w, '') as db_user,
 coalesce(last_value(set_db ignore nulls) over w, '') as db_name
from ended window w as (partition by conn_id order by seq rows between unbounded preceding and current row)
"""
_STARS = ", ".join(f"perms & {bit} <> 0 as can_{name}" for name, bit in (
    ("create", 1), ("drop", 2), ("alter", 4), ("info", 8), ("block", 16), ("bruteforce", 32)
))

ORACLES: dict[str, str] = {
    "read_query_log": f"select *, cast(null as boolean) as ok from ({demo.QUERY_LOG_SQL})",
    "stream_query_log": f"select db_type, command, count(*) as n from ({demo.QUERY_LOG_SQL}) group by all",
    "read_policy": f"""
with policies as ({demo.CUSTOMER_POLICY_SQL}), endpoints as ({demo.SUPPLIER_ENDPOINT_SQL}),
 stored as (select * from policies union all select * replace (0 as proxy_id) from policies where sysdbtype <> 'user_db')
select s.dbpid, s.proxy_id, s.db_name, s.perms, s.status, s.sysdbtype, e.dbtype as db_type
 from stored s join endpoints e on s.proxy_id = e.proxy_id
union all select dbpid, proxy_id, db_name, perms, status, sysdbtype, null from stored where proxy_id = 0
""",
    "read_allowlist": f"""
with query_log as ({demo.QUERY_LOG_SQL}), stored as (
 select distinct proxy_id, case when seq % 3 = 0 then 0 else 1 end as perm, db_name,
  case when seq % 12 = 7 then '' else {_PATTERN} end as query from query_log)
select proxy_id, perm, db_name, query from stored where perm > 0 and length(query) > 0
""",
    "read_endpoints": f"select * from ({demo.SUPPLIER_ENDPOINT_SQL}) where status <> 3",
    "read_alert_groups": _chained("select proxy_id, db_name, status, pattern from groups"),
    "rule_matches": _chained(", hits as (" + " union all ".join(
        f"select db_type, '{c}' as category from patterned where {_rules(c)}"
        for c in ("alter", "block", "create", "drop", "info")
    ) + ") select db_type, category, count(*) as n from hits group by all"),
    "indexed_rules": _chained(r"""
, numbers as (
 select seq, db_type, unnest(regexp_extract_all(query, '[=(,] *([0-9]+)\b', 1)) as number from spoken where query <> '')
select seq, string_agg(distinct c_mktsegment, ',' order by c_mktsegment) as segments from numbers
join customer on number = cast(c_custkey as varchar) and db_type = case when c_custkey % 2 = 0 then 'mysql' else 'pgsql' end
group by seq
"""),
    "write_alerts": _ALERTS,
    "upsert_alert_groups": _GROUPS,
    "upsert_allowlist": _USABLE_LIST,
    "write_policy": _EXPIRED,
    "session_context": _SESSION_CONTEXT,
    "session_state": _SESSIONS + """
select conn_id, arg_max(set_user, seq) filter (set_user is not null) as carried_user,
 arg_max(set_db, seq) filter (set_db is not null) as carried_db, max(event_time) as carried_time
from marked group by conn_id having carried_user <> '' or carried_db <> ''
""",
    "command_to_sql": _chained("select seq, command, query from spoken"),
    "inspectable_commands": _chained("select db_type, command, count(*) as n from stmts group by all"),
    "ascii_lower": f"select doc_id, translate(text, '{_UPPER}', '{_LOWER}') as text from documents",
    "mask_quoted": _chained("select seq, " + _nested("query", ("\"[^\"]*\"", "?")) + " as query from query_log"),
    "reduce_block_comments": (
        "select doc_id, replace(replace(" + _nested(
            "replace('select /* ' || text || ' */ 1 /**/ from t /* open ' || text, '/**/', chr(1))",
            (r"(?s)/\*.+?\*/", "\x02"), (r"(?s)/\*.*", "/*"),
        ).replace("\x02", "' || chr(2) || '") + ", chr(2), '/* */'), chr(1), '/**/') as text from documents"
    ),
    "reduce_hash_comments": (
        "select page_id, " + _nested("html", (r"#[^\r\n]*[\r\n]*", "#")) + " as html from pages"
    ),
    "reduce_dash_comments": (
        "select page_id, " + _nested("html", (r"--[^\r\n]*[\r\n]*", "--")) + " as html from pages"
    ),
    "mask_numbers": "select doc_id, " + _nested("text", _NUMBERS) + " as text from documents",
    "squeeze_blanks": "select page_id, " + _nested("html", *_BLANKS) + " as html from pages",
    "drop_unary_minus": (
        "select p_partkey, 'select ?,?, a from t where ?=x and b = -? and ' || p_name || '(?)' as pattern from part"
    ),
    "fingerprint_counts": _chained("select pattern, count(*) as n from patterned group by all"),
    "fingerprint_probes": f"select seq, pattern from ({demo.EXPECTED_PROBES_SQL})",
    "privileged_classes": _chained(
        "select seq, is_alter, is_drop, is_create, is_info, privileged from signalled"
    ),
    "blocked_commands": _chained("select db_type, is_block, count(*) as n from classed group by all"),
    "decode_perms": f"select dbpid, {_STARS} from ({demo.CUSTOMER_POLICY_SQL})",
    "statement_words": _chained(
        "select seq, lower(regexp_extract(query, '^[A-Za-z]+')) as verb, seq % 12 not in (2, 4, 6, 10) as whole from stmts"
    ),
    "signal_flags": _chained(f"select seq, {', '.join(_FLAGS)} from signalled"),
    "signal_probes": f"select seq, {', '.join(_FLAGS)} from ({demo.EXPECTED_PROBES_SQL})",
    "signal_probes_by_outline": f"select seq, {', '.join(_FLAGS)} from ({demo.EXPECTED_PROBES_SQL})",
    "risk_scores": _chained(
        "select seq, points as risk, case when points >= 30 then 'block' when points >= 20 then 'warn' else 'low' end as band from points"
    ),
    "weighted_scores": (
        f"select {_weighted({**_WEIGHTS, 'has_comment': 0, 'has_union': 7})} as risk, count(*) as n "
        f"from ({demo.EXPECTED_PROBES_SQL}) group by all"
    ),
    "reasons": _chained("select seq, reason from verdict"),
    "verdicts": _chained(
        "select seq, listed, not listed and privileged as privileged, risk, allowed, alert, alert_level, learn, group_status from verdict"
    ),
    "verdicts_deduplicated": _chained("select seq, risk, allowed, alert_level, learn from verdict"),
    "policy_catalog": (
        f"select p.dbpid, p.proxy_id, p.db_name, e.dbtype as db_type from ({demo.CUSTOMER_POLICY_SQL}) p "
        f"join ({demo.SUPPLIER_ENDPOINT_SQL}) e on p.proxy_id = e.proxy_id"
    ),
    "policy_resolution": _chained(
        "select seq, policy_kind, policy_proxy_id, policy_db_name, perms, status from resolved"
    ),
    "allowlist_hits": _chained("select seq, policy_db_name, pattern from flagged where listed"),
    "allowlist_misses": _chained("select seq, policy_db_name, pattern from flagged where not listed"),
    "allowlist_copartitioned": _chained("select seq, policy_db_name, pattern, listed from flagged"),
    "alert_group_copartitioned": _chained("""
select a.proxy_id, a.db_name, a.query, a.risk, exists (select 1 from alert_rows o where o.risk >= 45
 and o.proxy_id = a.proxy_id and o.db_name = a.db_name and o.pattern = a.pattern) as known_group
from alert_rows a
"""),
    "match_alert_group": _chained("""
select a.proxy_id, a.db_name, a.pattern, exists (select 1 from alert_rows o where o.risk >= 45
 and o.proxy_id = a.proxy_id and o.db_name = a.db_name and o.pattern = a.pattern) as known_group, count(*) as n
from alert_rows a group by all
"""),
    "learn_anti": _chained("select * from unlisted"),
    "alerts": _chained("select * from alert_rows"),
    "alert_groups": _GROUPS,
    "merge_groups": _GROUPS,
    "assign_group_id": _chained("""
select a.pattern, g.status as group_status, count(*) as n from alert_rows a join groups g
 on a.proxy_id = g.proxy_id and a.db_name = g.db_name and a.pattern = g.pattern group by all
"""),
    "learned_patterns": _chained("select * from learned"),
    "merge_allowlist": _MERGED_LIST,
    "expire_learning": _EXPIRED,
    "messages": f"select * from ({demo.SESSION_LOG_SQL})",
    "added_rules": _chained("""
select db_type, pattern like 'insert into%' or pattern like 'select%union%' as added, count(*) as n from patterned group by all
"""),
    "score_stream": _REFRESHED,
    "two_streams": _REFRESHED,
    "refresh_stream": _chained(
        f"{_BY_BATCH} select cast(batch as int) as batch, count(*) as n from by_batch where {_RAISED} group by all"
    ),
    "learn_stream": _USABLE_LIST,
    "group_stream": _GROUPS,
    "session_stream": _SESSION_CONTEXT,
    "session_timeouts": _SESSION_TIMEOUTS,
    "session_timers": _SESSION_TIMEOUTS,
    "repeated_rows": _chained("select * from alert_rows"),
    "raw_general_log": f"""
select event_time, conn_id[2:] as conn_id, 1 as proxy_id, db_type, command,
 replace(query, ' WHERE ', chr(10) || 'WHERE' || chr(10) || chr(10)) as query from ({demo.QUERY_LOG_SQL}) where db_type = 'mysql'
""",
    "raw_csv_log": f"""
select event_time, conn_id[2:] as conn_id, 2 as proxy_id, db_type, db_name, db_user, user_ip, command,
 replace(query, ' WHERE ', chr(10) || 'WHERE' || chr(10) || chr(10)) as query
from ({demo.QUERY_LOG_SQL}) where db_type = 'pgsql' and command = 'query'
""",
    "rejected_messages": """
select 'rejected' as kind, '{"seq": ' || event_id || ', "conn_id": ' as value from events where event_id % 9 = 4
union all select 'row' as kind, event_id::varchar as value from events where event_id % 9 <> 4
""",
}
