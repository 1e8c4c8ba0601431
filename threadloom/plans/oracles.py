"""The registered queries in SQL (DuckDB), over the same Parquet tables."""

from __future__ import annotations

from threadloom.constants import (
    CSV_HEADERS,
    DEFAULT_GUILD_ID,
    OTHER_THEME,
    RESPONSE_BUCKETS,
    SENTIMENT_ORDER,
    STATUS_LABELS,
    TAG_NAMES,
    THEME_RULES,
    THREAD_URL_BASE,
)
from threadloom.plans.queries import CHANNEL, NOW, VECTOR_THRESHOLD
from threadloom.schemas import ISSUE

_sql: dict[str, str] = {}


def registry() -> dict[str, str]:
    return dict(_sql)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def _iso(c: str) -> str:
    return f"coalesce(strftime({c}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z', '')"


def _half_up(x: str) -> str:
    return f"cast(floor(({x}) + 0.5) as bigint)"


def _list(c: str) -> str:
    return f"array_to_string({c}, '|')"


_CTES = {
    "threads": """select o_orderkey as okey, cast(o_orderkey as varchar) as id,
  c_mktsegment || ' ' || o_orderpriority as title, r_name as channel_id, 'guild-1' as guild_id,
  cast(o_custkey % 50 as varchar) as owner_id, 'u' || (o_custkey % 50) as owner_username,
  case when o_custkey % 3 <> 0 then 'User ' || (o_custkey % 50) end as owner_global_name,
  'a' || (o_custkey % 50) as owner_avatar,
  o_orderdate + to_minutes(cast((o_orderkey * 7919) % 1440 as bigint)) as created_at,
  o_orderstatus = 'F' as archived, o_orderstatus = 'P' as locked,
  cast(1 + o_orderkey % 7 as bigint) as member_count,
  case when o_orderkey % 10 = 0 then [o_orderpriority, 'st-' || o_orderstatus, '1006941128441999421']
       else [o_orderpriority, 'st-' || o_orderstatus] end as applied_tags,
  'm' || o_orderkey as first_message_id,
  case when o_orderkey % 9 = 0 then 'c' || (o_custkey % 200) end as duplicate_cluster_id,
  o_orderkey % 6 = 0 as has_attachment, o_orderkey % 10 <> 3 as replies_loaded,
  case when o_orderstatus = 'F'
       then o_orderdate + to_minutes(cast((o_orderkey * 7919) % 1440 as bigint)) + interval 30 day end as archived_at
from orders join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "replies": """select concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_shipdate as date)) as id,
  cast(l_orderkey as varchar) as issue_id, l_orderkey as okey,
  cast(l_suppkey % 50 as varchar) as author_id, 'u' || (l_suppkey % 50) as author_username,
  case when l_suppkey % 4 <> 0 then 'Helper ' || (l_suppkey % 50) end as author_global_name,
  p_name as content,
  o_orderdate + to_minutes(cast((case when l_linenumber <= 2 then (l_partkey * 37 + l_suppkey * 101) % 600
    else (l_partkey * 37 + l_suppkey * 101) % 20160 end) + (o_orderkey * 7919) % 1440 as bigint)) as ts,
  l_linenumber % 3 = 0 as has_attachment, cast(case when l_linenumber % 3 = 0 then 1 else 0 end as bigint) as attachment_count
from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey""",
    "pairs": """select t.id, t.created_at, t.owner_id, r.id as reply_id, r.author_id, r.ts, contains(lower(r.content), 'ring') as resolves,
  r.author_id is distinct from t.owner_id and r.id is not null as other
from threads t left join replies r on r.issue_id = t.id""",
    "response": """select id, coalesce(bool_or(other), false) as is_answered,
  cast(case when bool_or(other)
    then greatest(0, epoch_ms(min(ts) filter (where other)) - epoch_ms(any_value(created_at))) end as bigint) as response_time_ms,
  cast(count(distinct author_id) filter (where other) as bigint) as responder_count,
  case when not bool_or(other) then 'unanswered' when bool_or(resolves) then 'likely-resolved' else 'in-progress' end
    as resolution_status,
  cast(count(reply_id) as bigint) as reply_count
from pairs group by id""",
    "issues": """select t.*, r.* exclude (id), r.reply_count + 1 as message_count,
  cast(case when okey % 5 = 0 then 0 else r.reply_count + 1 + okey % 3 end as bigint) as total_message_sent
from threads t join response r on r.id = t.id""",
    "texts": """select d.doc_id, d.text, d.lang, d.source,
  case when toxic = 1 then 'frustrated' when quality = 1 then 'positive' when toxic is not null then 'neutral' end as sentiment,
  case when toxic = 1 then -0.8::double when quality = 1 then 0.6::double when toxic is not null then 0.0::double end
    as sentiment_score,
  'quality ' || quality as sentiment_summary
from documents d left join labels l on l.doc_id = d.doc_id""",
    "full_issues": """select i.*, title || ' ' || coalesce(substr(text, 1, 40), '') as name,
  coalesce(text, '') as first_message_content, sentiment, sentiment_score, sentiment_summary,
  owner_id as first_message_author_id, coalesce(owner_global_name, owner_username) as first_message_author_name,
  case when okey % 4 <> 0 then created_at end as first_message_created_at,
  created_at as fetched_at, created_at as updated_at
from issues i left join texts d on d.doc_id = i.okey % (select count(*) from documents)""",
    "event_issues": """select cast(event_id as varchar) as id, event_id, ts as created_at, cast(user_id as varchar) as owner_id,
  event_type as channel_id, cast(1 + event_id % 4 as bigint) as message_count, event_id % 3 = 0 as archived,
  event_id % 5 <> 0 as replies_loaded, event_type in ('click', 'view') as is_answered,
  case when event_type in ('click', 'view') then cast(trunc(value * 1000) as bigint) end as response_time_ms
from events""",
    "document_issues": """select doc_id, cast(doc_id as varchar) as id, source as channel_id, 'doc ' || doc_id as name,
  text as first_message_content, [lang] as applied_tags, sentiment
from texts""",
    "clusters": """select 'c' || (c_custkey % 250) as id, 'Cluster ' || (c_custkey % 250) as name,
  cast(null as varchar) as description, count(*) as issue_count from customer group by c_custkey % 250""",
}

_NEEDS = {
    "pairs": ["threads", "replies"],
    "response": ["pairs"],
    "issues": ["threads", "response"],
    "full_issues": ["issues", "texts"],
    "document_issues": ["texts"],
}


def _theme_case(name: str, text: str) -> str:
    lowered = f"lower({name} || ' ' || {text})"
    cases = " ".join(
        f"when {' or '.join(f'contains({lowered}, {_q(k)})' for k in dict.fromkeys(words))} then {i}"
        for i, (_, words, _) in enumerate(THEME_RULES)
    )
    return f"case {cases} else {len(THEME_RULES)} end"


_CTES["themed"] = (
    f"select id, doc_id, {_theme_case('name', 'first_message_content')} as theme_no from document_issues"
)
_NEEDS["themed"] = ["document_issues"]
_all_rules = [*THEME_RULES, OTHER_THEME]
_CTES["rules"] = "select * from (values " + ", ".join(
    f"({i}, {_q(t)}, [{', '.join(map(_q, k))}]::varchar[], {_q(d)})" for i, (t, k, d) in enumerate(_all_rules)
) + ") v(theme_no, theme, keywords, description)"
_CTES["themes"] = """select 'theme-' || theme_no as id, theme, description, keywords, count(*) as count,
  list(t.id order by doc_id desc)[1:5] as sample_issue_ids, 'fallback' as method, cast(null as varchar) as channel_id, theme_no
from themed t join rules using (theme_no) group by theme_no, theme, description, keywords"""
_NEEDS["themes"] = ["themed", "rules"]

_CTES["vectors"] = "select cast(vec_id as varchar) as id, vec_id, embedding::double[] as v, label from embeddings"
_CTES["scores"] = """select a.id as anchor_id, b.id as neighbour_id, list_cosine_similarity(a.v, b.v) as score,
  row_number() over (partition by a.id order by list_cosine_similarity(a.v, b.v) desc, b.id) as rn
from vectors a, vectors b"""
_CTES["neighbours"] = f"""select anchor_id, neighbour_id, score from scores
where rn <= 7 and score >= {VECTOR_THRESHOLD} and anchor_id <> neighbour_id"""
_CTES["edges"] = """select distinct least(anchor_id, neighbour_id) as src, greatest(anchor_id, neighbour_id) as dst
from neighbours"""
_CTES["links"] = "select src as a, dst as b from edges union all select dst, src from edges"
_CTES["reached"] = """select a as id, a as root from links union select l.b, r.root from reached r join links l on l.a = r.id"""
_CTES["components"] = "select id, min(root) as component from reached group by id"
_NEEDS |= {
    "scores": ["vectors"],
    "neighbours": ["scores"],
    "edges": ["neighbours"],
    "links": ["edges"],
    "reached": ["links"],
    "components": ["reached"],
}
_CTES["vector_issues"] = """select id, vec_id, case when vec_id % 4 <> 0 then 'vector ' || id end as name,
  case when vec_id % 10 = 0 then 'old' end as duplicate_cluster_id from vectors"""
_NEEDS["vector_issues"] = ["vectors"]


def _ordered(names: list[str], done: list[str] | None = None) -> list[str]:
    done = [] if done is None else done
    for name in names:
        _ordered(_NEEDS.get(name, []), done)
        if name not in done:
            done.append(name)
    return done


def _add(name: str, needs: str, body: str) -> None:
    ctes = _ordered(needs.split())
    recursive = "recursive " if any("reached" in c for c in ctes) else ""
    head = ",\n".join(f"{c} as ({_CTES[c]})" for c in ctes)
    _sql[name] = f"with {recursive}{head}\n{body}" if ctes else body


# Response analytics

_add("issue_response", "response", "select * from response")
_add(
    "first_reply",
    "pairs",
    f"""select id as issue_id, author_id, reply_id, {_ts('ts')} as timestamp from pairs where other
qualify row_number() over (partition by id order by ts, reply_id) = 1""",
)
_add(
    "response_analytics",
    "issues",
    """, w as (select *, case when is_answered and response_time_ms > 0 then response_time_ms end as wait from issues
  where replies_loaded)
select count(*) as total_with_replies, count(*) filter (where is_answered) as answered_count,
  count(*) filter (where not is_answered) as unanswered_count, round(avg(wait), 3) as avg_response_time_ms,
  count(*) filter (where wait <= 3600000) as fast_response_count,
  count(*) filter (where resolution_status = 'likely-resolved') as likely_resolved_count,
  count(*) filter (where resolution_status = 'in-progress') as in_progress_count,
  cast(sum(reply_count) as bigint) as total_replies,
  round(count(*) filter (where is_answered) / count(*), 3) as response_rate,
  (list(wait order by wait) filter (where wait is not null))[cast(floor(count(wait) / 2) as bigint) + 1] as median_response_time_ms,
  round(sum(reply_count) / count(*), 3) as avg_replies_per_issue
from w""",
)
_add(
    "upper_median_by_channel",
    "issues",
    """select channel_id, (list(response_time_ms order by response_time_ms) filter (where response_time_ms is not null))
  [cast(floor(count(response_time_ms) / 2) as bigint) + 1] as upper_median
from issues where response_time_ms is not null group by channel_id""",
)
_bucket = " ".join(
    f"when response_time_ms <= {upper} then {i}" for i, (_, upper) in enumerate(RESPONSE_BUCKETS) if upper is not None
)
_add(
    "response_time_distribution",
    "issues",
    f""", b(slot, bucket, bucket_ms) as (values {', '.join(f"({i}, {_q(n)}, {'null' if u is None else u}::bigint)" for i, (n, u) in enumerate(RESPONSE_BUCKETS))}),
c as (select case {_bucket} else {len(RESPONSE_BUCKETS) - 1} end as slot, count(*) as n from issues
  where response_time_ms is not null group by 1)
select cast(b.slot as bigint) as slot, bucket, bucket_ms, coalesce(n, 0) as count from b left join c on c.slot = b.slot""",
)
_add(
    "attach_replies",
    "issues",
    """select id, is_answered and not (message_count <= 1 or okey % 17 = 0) as is_answered,
  case when not (message_count <= 1 or okey % 17 = 0) then response_time_ms end as response_time_ms,
  case when message_count <= 1 or okey % 17 = 0 then 0 else responder_count end as responder_count,
  case when message_count <= 1 then 'unanswered' when okey % 17 = 0 then 'unknown' else resolution_status end as resolution_status,
  case when message_count <= 1 or okey % 17 = 0 then 0 else reply_count end as reply_count, true as replies_loaded
from issues""",
)

# Metrics

_CTES["metrics"] = """select channel_id, count(id) as total_issues, count(*) filter (where is_answered) as answered_issues,
  cast(sum(message_count) as bigint) as total_messages,
  count(*) filter (where resolution_status = 'likely-resolved') as resolved_issues,
  round(avg(response_time_ms), 3) as avg_response_time_ms,
  count(*) filter (where response_time_ms <= 3600000) as fast_response_count,
  count(distinct owner_id) as unique_users, count(*) filter (where archived) as archived_issues,
  percentile_cont(0.5) within group (order by response_time_ms) as median_response_time_ms
from issues group by channel_id"""
_CTES["daily"] = """select strftime(created_at, '%Y-%m-%d') as date, channel_id, count(*) as issue_count,
  cast(sum(message_count) as bigint) as total_messages, count(*) filter (where is_answered) as answered_count
from issues group by 1, 2"""
_CTES["responders"] = """select channel_id, author_id, author_username, author_global_name, count(r.id) as reply_count,
  count(distinct issue_id) as issues_helped
from replies r join threads t on t.id = r.issue_id where author_id <> owner_id group by 1, 2, 3, 4"""
_NEEDS |= {"metrics": ["issues"], "daily": ["issues"], "responders": ["threads", "replies"]}
_add("global_metrics", "metrics", "select * from metrics")
_add("daily_stats", "daily", "select * from daily")
_add("top_responders_view", "responders", "select * from responders")
_kpis = [
    "total_issues", "answered_issues", "total_messages", "resolved_issues", "avg_response_time_ms",
    "fast_response_count", "unique_users", "archived_issues", "median_response_time_ms",
]
_add(
    "metrics_bundle_long",
    "metrics daily responders",
    " union all ".join(
        [f"select 'kpis' as part, channel_id as key, '{c}' as metric, round(coalesce({c}, 0)::double, 3) as value from metrics" for c in _kpis]
        + [
            f"select 'daily_stats', date || '/' || channel_id, '{c}', {c}::double from daily"
            for c in ("issue_count", "total_messages", "answered_count")
        ]
        + [
            f"""select 'top_responders', concat_ws('/', channel_id, author_id, author_username, coalesce(author_global_name, '-')),
  '{c}', {c}::double from (select * from responders
  order by reply_count desc, channel_id, author_id, author_username, author_global_name nulls first limit 20)"""
            for c in ("reply_count", "issues_helped")
        ]
    ),
)
_add(
    "issues_by_day",
    "threads",
    "select strftime(created_at, '%Y-%m-%d') as date, count(*) as count from threads group by 1",
)
_add(
    "cumulative_issues",
    "threads",
    """, d as (select strftime(created_at, '%Y-%m-%d') as date, count(*) as count from threads group by 1)
select date, count, cast(sum(count) over (order by date) as bigint) as cumulative from d""",
)
_add(
    "cumulative_issues_by_channel",
    "daily",
    """select date, channel_id, issue_count as count,
  cast(sum(issue_count) over (partition by channel_id order by date) as bigint) as cumulative from daily""",
)


def _tag_name(c: str) -> str:
    cases = " ".join(f"when {_q(k)} then {_q(v)}" for k, v in TAG_NAMES.items())
    return f"case {c} {cases} else 'Tag ' || right({c}, 4) end"


_add(
    "issues_by_tag",
    "threads",
    f"""select tag_id, {_tag_name('tag_id')} as name, count(*) as count
from (select unnest(applied_tags) as tag_id from threads) group by 1, 2""",
)
_add(
    "distinct_tags",
    "threads",
    "select count(distinct tag) as distinct_tags from (select unnest(applied_tags) as tag from threads)",
)
_add("distinct_reporters", "", "select count(distinct user_id) as reporters from events")
_add("channel_totals", "threads", "select channel_id, count(*) as total from threads group by 1")
_add(
    "data_flags",
    "full_issues",
    """select coalesce(bool_or(sentiment <> 'unknown'), false) as has_sentiment,
  bool_or(duplicate_cluster_id is not null) as has_duplicates, bool_or(replies_loaded) as has_replies from full_issues""",
)
_add(
    "kpi_strip",
    "issues",
    f""", a as (select count(*) as issues, count(distinct owner_id) as unique_users,
  cast(sum(case when total_message_sent <> 0 then total_message_sent else message_count end) as bigint) as total_messages,
  count(*) filter (where archived) as archived, count(*) filter (where replies_loaded) as loaded,
  count(*) filter (where replies_loaded and is_answered) as answered,
  count(*) filter (where replies_loaded and not is_answered) as unanswered,
  count(*) filter (where replies_loaded and resolution_status = 'likely-resolved') as resolved from issues)
select issues, unique_users, total_messages, archived, issues - archived as active,
  {_half_up('archived / issues * 100')} as archived_pct, {_half_up('total_messages / issues')} as avg_messages_per_issue,
  answered, unanswered, resolved, {_half_up('answered / loaded * 100')} as response_rate_pct,
  {_half_up('resolved / loaded * 100')} as resolved_pct, {_half_up('unanswered / loaded * 100')} as unanswered_pct from a""",
)
for _name, _shift in (("time_of_week_heatmap", 0), ("time_of_week_heatmap_local", 330)):
    _add(
        _name,
        "",
        f"""with e as (select isodow(t) - 1 as day, hour(t) as hour, count(*) as n
  from (select ts + to_minutes({_shift}) as t from events) group by 1, 2),
g as (select d.range as day, h.range as hour, coalesce(n, 0) as count
  from range(7) d cross join range(24) h left join e on e.day = d.range and e.hour = h.range)
select day, hour, count, max(count) over () as max_count, cast(sum(count) over () as bigint) as total from g""",
    )

_counted = [
    ("issues_created", "count(*)", 1),
    ("unique_users", "count(distinct owner_id)", 1),
    ("total_messages", "sum(message_count)", 1),
    ("active_issues", "count(*) filter (where not archived)", 1),
    (
        "response_rate",
        "count(*) filter (where replies_loaded and is_answered) / count(*) filter (where replies_loaded) * 100",
        1,
    ),
    ("avg_response_time", "coalesce(avg(response_time_ms) filter (where response_time_ms > 0), 0)", -1),
    ("unanswered", "count(*) filter (where replies_loaded and not is_answered)", -1),
]
_weekly_rows = " union all ".join(
    f"""select {i} as ord, '{name}' as metric,
  (select ({expr})::double from event_issues, a where created_at >= a.m - interval 7 day) as current,
  (select ({expr})::double from event_issues, a where created_at >= a.m - interval 14 day and created_at < a.m - interval 7 day) as previous,
  {better} as better"""
    for i, (name, expr, better) in enumerate(_counted, 1)
)
_add(
    "weekly_trends",
    "event_issues",
    f""", a as (select max(epoch_ms(created_at)) as ms, to_timestamp(0) as z, max(created_at) as m from event_issues),
r as ({_weekly_rows}),
d as (select *, case when metric = 'response_rate' then current - previous else (current - previous) / previous * 100 end as delta from r)
select cast(ord as bigint) as ord, metric, round(current, 6) as current, round(previous, 6) as previous,
  case when delta > 0 then '+' when delta < 0 then '-' else '' end || cast(cast(floor(abs(delta) + 0.5) as bigint) as varchar) || '%' as value,
  case when delta > 0 then 'up' when delta < 0 then 'down' else 'neutral' end as direction,
  case when delta * better > 0 then 'success' when delta * better < 0 then 'error' else 'neutral' end as status
from d""",
)

# Rankings and listings


def _top(order: str, n: int, columns: str, source: str) -> str:
    return f"select row_number() over (order by {order}) as rank, {columns} from {source} qualify rank <= {n}"


_add("top_issues", "issues", _top("message_count desc, created_at desc, id", 10, "id, message_count", "issues"))
_waiting = "(select * from issues where replies_loaded and not is_answered)"
_add("unanswered_issues", "issues", _top("created_at desc, id", 20, f"id, {_ts('created_at')} as created_at", _waiting))
_add("unanswered_issues_oldest", "issues", _top("created_at, id", 20, f"id, {_ts('created_at')} as created_at", _waiting))
_add(
    "escalation_watchlist",
    "issues",
    f""", e as (select *, (epoch_ms(timestamp '{NOW}') - epoch_ms(created_at)) / 86400000.0 as age,
  replies_loaded and not is_answered as waiting, message_count >= 5 as busy from issues),
f as (select *, list_filter([case when busy and waiting then 'high activity, no reply' end,
  case when busy and age >= 7 then 'high activity, aging' end,
  case when age >= 14 and waiting then 'old, unanswered' end], lambda x: x is not null) as reasons from e)
"""
    + _top(
        "message_count desc, created_at desc, id",
        15,
        f"id, message_count, {_list('reasons')} as reasons",
        "(select * from f where len(reasons) > 0)",
    ),
)
_add(
    "top_contributors",
    "issues",
    """, o as (select owner_id, count(*) as issue_count, cast(sum(message_count) as bigint) as total_messages from issues group by 1),
f as (select owner_id, owner_username, owner_global_name, created_at, id from issues
  qualify row_number() over (partition by owner_id order by created_at desc, id) = 1)
select row_number() over (order by issue_count desc, created_at desc, id) as rank, o.owner_id, owner_username as username,
  owner_global_name as global_name, issue_count, total_messages from o join f using (owner_id) qualify rank <= 10""",
)
_add(
    "leaderboard_rank",
    "issues",
    _top(
        "messages desc, owner_id",
        8,
        "*",
        "(select owner_id, cast(sum(message_count) as bigint) as messages from issues group by 1)",
    ),
)
_add(
    "top_responders",
    "threads replies",
    """, x as (select r.*, t.created_at from replies r join threads t on t.id = r.issue_id where author_id <> owner_id),
c as (select author_id, count(*) as reply_count, count(distinct issue_id) as issues_helped from x group by 1),
f as (select author_id, author_username, author_global_name, created_at, issue_id, ts, id from x
  qualify row_number() over (partition by author_id order by created_at desc, issue_id, ts, id) = 1)
select row_number() over (order by reply_count desc, created_at desc, issue_id, ts, id) as rank, c.author_id,
  author_username as username, coalesce(author_global_name, author_username) as global_name, reply_count, issues_helped
from c join f using (author_id) qualify rank <= 10""",
)
_add(
    "top_responders_join",
    "threads replies",
    """select r.id, r.issue_id, channel_id, author_id, owner_id from replies r join threads t on t.id = r.issue_id
where author_id <> owner_id""",
)


def _duration(ms: str) -> str:
    sec = f"floor({ms} / 1000 + 0.5)"
    minutes = f"floor({sec} / 60 + 0.5)"
    hours = f"floor({minutes} / 60)"
    days = f"floor({hours} / 24)"

    def n(x: str, unit: str) -> str:
        return f"cast(cast({x} as bigint) as varchar) || '{unit}'"

    return f"""case when {ms} is null or {ms} < 0 then '—' when {sec} < 60 then {n(sec, 's')} when {minutes} < 60 then {n(minutes, 'm')}
  when {hours} < 24 then {n(hours, 'h')} || case when {minutes} % 60 > 0 then ' ' || {n(f'{minutes} % 60', 'm')} else '' end
  else {n(days, 'd')} || case when {hours} % 24 > 0 then ' ' || {n(f'{hours} % 24', 'h')} else '' end end"""


def _age(ts: str) -> str:
    sec = f"floor((epoch_ms(timestamp '{NOW}') - epoch_ms({ts})) / 1000 + 0.5)"
    minutes = f"floor({sec} / 60 + 0.5)"
    hours = f"floor({minutes} / 60 + 0.5)"
    days = f"floor({hours} / 24 + 0.5)"
    months = f"floor({days} / 30 + 0.5)"

    def n(x: str, unit: str) -> str:
        return f"cast(cast({x} as bigint) as varchar) || '{unit} ago'"

    return f"""case when {sec} < 60 then 'just now' when {minutes} < 60 then {n(minutes, 'm')} when {hours} < 24 then {n(hours, 'h')}
  when {days} < 30 then {n(days, 'd')} when {months} < 12 then {n(months, 'mo')} else {n(f'floor({months} / 12 + 0.5)', 'y')} end"""


_labels = " ".join(f"when {_q(k)} then {_q(v)}" for k, v in STATUS_LABELS.items())
_add(
    "issue_listing",
    "full_issues",
    f"""select id, name,
  md5(case when first_message_content = '' then '(no message body)'
    else regexp_replace(first_message_content, '```.*?```', '[code]', 'gs') end) as snippet,
  {_list(f"list_transform(applied_tags[1:2], lambda x: {_tag_name('x')})")} as tag_names,
  cast(greatest(len(applied_tags) - 2, 0) as bigint) as more_tags,
  case when replies_loaded then cast(reply_count as varchar) else '—' end as replies,
  case when response_time_ms is not null then {_duration('response_time_ms')} when replies_loaded then 'no reply' else '—' end as response,
  case resolution_status {_labels} else '—' end as status,
  coalesce(owner_global_name, owner_username) as reporter, {_age('created_at')} as created
from full_issues""",
)
_add(
    "issue_detail",
    "full_issues replies",
    f"""select 'issue' as kind, id as issue_id, null as reply_id, owner_id as author_id, name as content, null as timestamp, true as is_op
from full_issues where id = '42'
union all select 'reply', issue_id, r.id, author_id, content, {_ts('ts')}, author_id = owner_id
from replies r join threads t on t.id = r.issue_id where issue_id = '42'""",
)
_add(
    "first_n_per_group",
    "threads",
    """select owner_id, row_number() over (partition by owner_id order by created_at desc, id) as rank, id from threads
qualify rank <= 5""",
)
_add(
    "latest_by_key",
    "",
    f"""select user_id, event_id, event_type, {_ts('ts')} as ts from events
qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""",
)

# Filters

_known = "coalesce(sentiment, 'unknown')"
_filters = {
    "filter_archived": "archived",
    "filter_active": "not archived",
    "filter_tags": "list_has_any(applied_tags, ['1-URGENT', 'st-P'])",
    "filter_status": "resolution_status in ('in-progress', 'unanswered')",
    "filter_sentiment": f"{_known} in ('frustrated', 'unknown')",
    "filter_has_replies": "replies_loaded and reply_count > 0",
    "filter_no_replies": "replies_loaded and reply_count = 0",
    "filter_min_messages": "message_count >= 6",
    "filter_attachment": "has_attachment",
    "filter_duplicates": "duplicate_cluster_id is not null",
    "filter_dates": "created_at >= '1996-01-01' and created_at < '1997-07-01'",
    "filter_theme": "id in ('1', '2') or contains(lower(name || ' ' || first_message_content), 'ware')"
    " or contains(lower(name || ' ' || first_message_content), 'zzz')",
    "filter_query": "contains(lower(name || ' ' || owner_username || ' ' || coalesce(owner_global_name, '') || ' '"
    " || first_message_content), 'user 7')",
    "filter_issues": "contains(lower(name || ' ' || owner_username || ' ' || coalesce(owner_global_name, '') || ' '"
    " || first_message_content), 'building') and list_has_any(applied_tags, ['1-URGENT', '2-HIGH', 'st-O']) and not archived"
    f" and resolution_status in ('in-progress', 'likely-resolved') and {_known} in ('positive', 'neutral', 'unknown')"
    " and replies_loaded and reply_count > 0 and message_count >= 3 and not has_attachment"
    " and created_at >= '1994-01-01' and created_at < '2000-01-01'",
}
_filters["search_issues"] = _filters["filter_query"]
for _name, _condition in _filters.items():
    _add(_name, "full_issues", f"select id from full_issues where {_condition}")
_add(
    "unclustered_issues",
    "threads",
    f"select id, {_ts('created_at')} as created_at from threads where duplicate_cluster_id is null",
)

# Stored tables

_times = {"created_at", "archived_at", "first_message_created_at", "fetched_at", "updated_at"}


def _stored_column(c: str) -> str:
    if c in _times:
        return f"{_ts(c)} as {c}"
    if c == "applied_tags":
        return f"{_list(c)} as {c}"
    if c == "first_message_content":
        return f"left({c}, 250) as {c}"
    return c


_add("issues_light", "full_issues", f"select {', '.join(map(_stored_column, ISSUE.fieldNames()))} from full_issues")
_add(
    "load_issues",
    "full_issues",
    f"""select id, name, {_ts('created_at')} as created_at, message_count, left(first_message_content, 250) as first_message_content,
  total_results, bool_or(reply_count > 0) over () as has_replies
from (select *, count(*) over () as total_results from full_issues where channel_id = '{CHANNEL}'
  qualify row_number() over (order by created_at desc, id) <= 50000)""",
)
_add("issue_page", "threads", f"select id, {_ts('created_at')} as created_at from threads order by id limit 20 offset 40")

# Themes and sentiment

_add(
    "issue_themes",
    "themed",
    f"select id, {_ts('to_timestamp(doc_id * 60)::timestamp')} as created_at, cast(theme_no as bigint) as theme_no from themed",
)
_add(
    "keyword_themes",
    "themes",
    f"""select id, theme, description, {_list('keywords')} as keywords, count, {_list('sample_issue_ids')} as sample_issue_ids,
  method, channel_id from themes""",
)
_add(
    "theme_share",
    "themes",
    f"""select theme, count, {_half_up('count / (select count(*) from documents) * 100')} as pct,
  round(count / max(count) over () * 100, 6) as bar from themes""",
)
_add(
    "theme_prompt_rows",
    "document_issues",
    """select row_number() over (order by doc_id desc) - 1 as idx, id as issue_id, left(name, 140) as title,
  left(case when first_message_content = '' then name else first_message_content end, 280) as excerpt
from document_issues qualify idx < 120""",
)
# Answers that can be read are those of documents whose id leaves 0 or 1 when divided by 4.
_CTES["answers"] = """select doc_id, regexp_extract(text, '([A-Za-z]+)', 1) as word from documents where doc_id % 4 in (0, 1)"""
_CTES["prompt"] = """select row_number() over (order by doc_id desc) - 1 as idx, cast(doc_id as varchar) as issue_id from documents"""
_CTES["model_themes"] = """select cast(doc_id as varchar) as completion_id, 0 as pos, left(word, 60) as theme,
  left('about ' || word, 240) as description, [left(word, 40), 'x', 'y', 'z', 'u', 'v'] as keywords, 4 as count,
  [doc_id % 180, (doc_id + 7) % 180] as idxs from answers
union all select cast(doc_id as varchar), 1, 'second', '', ['k'], 8, [doc_id % 50 + x for x in range(5)] from answers"""
_CTES["model_rows"] = """select completion_id, pos, theme, description, keywords, count,
  coalesce((select list(p.issue_id order by u.at) from (select unnest(idxs) as idx, generate_subscripts(idxs, 1) as at) u
    join prompt p on p.idx = u.idx), []) as sample_issue_ids from model_themes m"""
_NEEDS |= {"model_themes": ["answers"], "model_rows": ["model_themes", "prompt"]}
_add(
    "themes_from_completions",
    "model_rows",
    f"""select completion_id, theme, description, {_list('keywords')} as keywords, cast(count as bigint) as count,
  {_list('sample_issue_ids')} as sample_issue_ids, 'llm' as method from model_rows""",
)
_add(
    "themes_with_fallback",
    "model_rows themes",
    f"""select completion_id, theme, cast(count as bigint) as count, {_list('sample_issue_ids')} as sample_issue_ids, 'llm' as method
from model_rows
union all select cast(doc_id as varchar), theme, count, {_list('sample_issue_ids')}, method
from documents cross join themes where doc_id % 4 in (2, 3)""",
)
_groups = ", ".join(f"({i}, {_q(s)})" for i, s in enumerate(SENTIMENT_ORDER, 1))
_add(
    "sentiment_groups",
    "document_issues",
    f""", g(ord, sentiment) as (values {_groups})
select cast(ord as bigint) as ord, g.sentiment, count(*) as count, {_list('list(id order by doc_id desc)[1:8]')} as issue_ids
from document_issues d join g on g.sentiment = coalesce(d.sentiment, 'unknown') group by 1, 2""",
)
_add(
    "merge_sentiment",
    "full_issues document_issues",
    """select f.id, case when d.id is not null then d.sentiment else f.sentiment end as sentiment,
  case when d.id is not null then 0.5 else sentiment_score end as sentiment_score,
  case when d.id is not null then 's ' || d.id else sentiment_summary end as sentiment_summary
from full_issues f left join document_issues d on d.id = f.id and d.sentiment is not null""",
)

# Source documents

_has_message = "okey % 5 <> 0"
_add(
    "read_search_dump",
    "full_issues",
    f"""select id, name, channel_id, case when okey % 8 <> 0 then owner_username else 'unknown' end as owner_username,
  case when okey % 8 <> 0 then coalesce(owner_global_name, owner_username) end as owner_global_name,
  {_ts('created_at')} as created_at, {_ts('archived_at')} as archived_at, archived, locked, message_count,
  {_list('applied_tags')} as applied_tags, case when {_has_message} then first_message_id end as first_message_id,
  md5(case when {_has_message} then first_message_content else '' end) as content,
  case when {_has_message} then {_ts('created_at')} end as first_message_created_at,
  {_has_message} and has_attachment as has_attachment,
  case when {_has_message} and has_attachment then 'log.txt' else '' end as attachment_filenames from full_issues""",
)
_add(
    "normalize_issue",
    "full_issues",
    f"""select id, name, channel_id, guild_id, owner_id, case when okey % 8 <> 0 then owner_username else 'unknown' end as owner_username,
  case when okey % 8 <> 0 then coalesce(owner_global_name, owner_username) end as owner_global_name,
  case when okey % 8 <> 0 then owner_avatar end as owner_avatar,
  {_ts('created_at')} as created_at, {_ts('archived_at')} as archived_at, archived, locked, message_count, member_count,
  total_message_sent, {_list('applied_tags')} as applied_tags,
  case when {_has_message} then first_message_id end as first_message_id,
  md5(case when {_has_message} then first_message_content else '' end) as first_message_content,
  case when {_has_message} then owner_id end as first_message_author_id,
  case when {_has_message} then first_message_author_name end as first_message_author_name,
  case when {_has_message} then {_ts('created_at')} end as first_message_created_at,
  {_has_message} and has_attachment as has_attachment,
  case when {_has_message} and has_attachment then 'log.txt' else '' end as attachment_filenames from full_issues""",
)
_add(
    "reply_rows",
    "replies",
    f"""select id, issue_id, author_id, author_username, author_global_name, content, {_ts('ts')} as timestamp, has_attachment,
  attachment_count from replies""",
)
_add(
    "read_post_data_map",
    "full_issues",
    """select id as thread_id, first_message_id as message_id, md5(first_message_content) as content from full_issues
where okey % 11 <> 0""",
)
_CTES["pages"] = """select archived, floor((row_number() over (partition by archived order by created_at desc, id) - 1) / 25)::bigint as page,
  id, created_at from threads"""
_CTES["scan"] = """select *, cast(sum(n) over (order by archived, page) - n as bigint) as before
from (select archived, page, count(*) as n, first(id order by created_at desc, id) as first_id from pages group by 1, 2)
qualify before < 500"""
_NEEDS |= {"pages": ["threads"], "scan": ["pages"]}
_add(
    "paged_thread_scan",
    "scan",
    "select archived, page * 25 as offset, before, n as threads, first_id from scan",
)
_add(
    "scan_summary",
    "scan",
    """select cast(sum(n) as bigint) as threads,
  (select count(*) from threads where archived in (select archived from scan)) as total_results,
  exists (select 1 from pages p where not exists (select 1 from scan s where s.archived = p.archived and s.page = p.page)) as has_more
from scan""",
)
_add(
    "archive_scan_before",
    "threads",
    f"""select id, {_ts('archived_at')} as archived_at from threads where archived and archived_at < '1997-01-01'
qualify row_number() over (order by archived_at desc, id) <= 50""",
)
_add(
    "thread_messages",
    "",
    f"""select cast(conv_id as varchar) as thread_id, conv_id || '-' || turn as id,
  {_ts('to_timestamp(turn * 60)::timestamp')} as timestamp, role,
  row_number() over (partition by conv_id order by turn) - 1 as position
from (select * from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 5) where turn <> 0""",
)
_add(
    "threads_first_message",
    "threads",
    f"select id, case when {_has_message} then first_message_id end as message_id from threads",
)
_add(
    "backfill_first_messages",
    "threads",
    """select id as thread_id, case when okey % 5 <> 0 or okey % 11 <> 0 then first_message_id end as message_id,
  case when okey % 5 <> 0 then 'search' when okey % 11 <> 0 then 'post_data' end as origin from threads""",
)

# Merges and maintenance

_add(
    "upsert_issues",
    "full_issues",
    f"""select id, case when okey % 3 = 0 then 'new ' || name else name end as name,
  case when okey % 3 = 0 then message_count + 1 else message_count end as message_count,
  case when okey % 2 = 0 then member_count end as member_count,
  case when okey % 2 = 0 then is_answered else false end as is_answered,
  case when okey % 2 = 0 then resolution_status else 'unanswered' end as resolution_status,
  case when okey % 2 = 0 then response_time_ms end as response_time_ms,
  case when okey % 3 = 0 then {_ts(f"timestamp '{NOW}'")} else {_ts('updated_at')} end as updated_at
from full_issues where okey % 2 = 0 or okey % 3 = 0""",
)
_add(
    "upsert_replies",
    "replies",
    """select id, issue_id, case when okey % 3 = 0 then 'new ' || content else content end as content, attachment_count
from replies where okey % 2 = 0 or okey % 3 = 0""",
)
_add(
    "replace_replies",
    "replies",
    """select id, issue_id, case when okey % 4 = 0 then 'new ' || content else content end as content
from replies where okey % 4 <> 0 or has_attachment""",
)
_change = """case when okey % 7 = 0 then 'new' when okey % 11 = 0 or okey % 13 = 0 then 'changed' else 'same' end"""
_add("changed_threads", "threads", f"select id, {_change} as change from threads")
_add(
    "caught_up_pages",
    "threads",
    f""", p as (select archived, floor((row_number() over (partition by archived order by created_at desc, id) - 1) / 25)::bigint as page,
  created_at >= '1999-06-01' and {_change} <> 'same' as changed from threads),
s as (select archived, page, count(*) as threads, count(*) filter (where changed) as changes from p group by 1, 2)
select * from s where page < coalesce((select min(page) from s q where q.archived = s.archived and changes = 0), 1000000000)""",
)
_CTES["queue"] = """select *, row_number() over (order by created_at, id) as place from issues where message_count > 1"""
_NEEDS["queue"] = ["issues"]
_add(
    "missing_replies",
    "queue",
    f"""select id, {_ts('created_at')} as fetched_at from (select * from queue where place <= 20) where okey % 5 = 0
qualify row_number() over (order by created_at, id) <= 10""",
)
_add(
    "missing_replies_bulk",
    "queue",
    f"""select id, {_ts('created_at')} as fetched_at from queue where okey % 5 = 0
qualify row_number() over (order by created_at, id) <= 200""",
)
_add(
    "rotate_queue",
    "queue",
    f""", h as (select id from queue where place <= 20 and okey % 5 <> 0
  union all select id from (select * from queue where place <= 20 and okey % 5 = 0 order by created_at, id limit 10))
select id, case when id in (select id from h) then {_ts(f"timestamp '{NOW}'")} else {_ts('created_at')} end as fetched_at from issues""",
)
_add(
    "orphan_clusters",
    "clusters threads",
    "select * from clusters where id not in (select duplicate_cluster_id from threads where duplicate_cluster_id is not null)",
)
_add(
    "clear_channel",
    "threads replies clusters",
    f""", k as (select * from threads where channel_id <> '{CHANNEL}')
select 'issues' as "table", id from k
union all select 'replies', id from replies where issue_id in (select id from k)
union all select 'clusters', id from clusters where id in (select duplicate_cluster_id from k)""",
)
_add(
    "cluster_members",
    "clusters threads",
    f"""select c.id as cluster_id, c.name as cluster_name, issue_count, t.id as issue_id, title as name,
  {_ts('created_at')} as created_at, row_number() over (partition by c.id order by t.id) as rank
from clusters c join threads t on t.duplicate_cluster_id = c.id qualify rank <= 5""",
)
_CTES["notes"] = """select user_id || '-' || event_type as id, event_type as issue_id, cast(user_id as varchar) as user_id,
  'user ' || user_id as user_name, props as content, cast(1 as bigint) as version, ts as updated_at,
  case when event_id % 2 = 1 then 'remote' else 'local' end as origin
from events qualify row_number() over (partition by user_id, event_type, event_id % 2 order by ts desc, props desc) = 1"""
_merged = f"""select id, issue_id, user_id, user_name, content, version, {_ts('updated_at')} as updated_at, cast(null as varchar) as deleted_at"""
_newest = "qualify row_number() over (partition by id order by updated_at desc, origin) = 1"
_add("note_merge_lww", "notes", f"{_merged}, origin from notes {_newest}")
_add("note_sync", "notes", f"{_merged} from notes {_newest}")
_add(
    "note_exchange",
    "notes",
    f"""select 'stored' as side, * from ({_merged} from notes {_newest})
union all select 'sent', * from ({_merged} from notes l where origin = 'local' and not exists
  (select 1 from notes r where r.origin = 'remote' and r.id = l.id and r.updated_at >= l.updated_at))""",
)
_add(
    "note_write",
    "notes",
    f""", l as (select * from notes where origin = 'local'),
e as (select * from notes where origin = 'remote' and cast(user_id as bigint) % 2 = 0)
select coalesce(l.issue_id, e.issue_id) as issue_id, coalesce(l.user_id, e.user_id) as user_id,
  case when e.id is not null then 'edited' else l.content end as content,
  case when e.id is null then l.version else coalesce(l.version, 0) + 1 end as version,
  case when e.id is null then {_ts('l.updated_at')} else {_ts(f"timestamp '{NOW}'")} end as updated_at,
  cast(null as varchar) as deleted_at
from l full join e on l.id = e.id""",
)

# Similarity and clusters

_ws = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
_add(
    "embed_text",
    "document_issues",
    f""", x as (select id, trim(concat_ws(chr(10) || chr(10), name, nullif(first_message_content, ''),
  case when doc_id % 6 <> 0 then 'Tags: ' || applied_tags[1] end), {_ws}) as text from document_issues)
select id, md5(text) as text, length(text) as n from x""",
)
_CTES["term_texts"] = f"""select id, channel_id, sentiment, trim(concat_ws(chr(10) || chr(10), name,
  nullif(first_message_content, ''), 'Tags: ' || applied_tags[1]), {_ws}) as text from document_issues"""
_CTES["term_words"] = """select id, w from (
  select id, unnest(regexp_split_to_array(lower(text), '[ \\t-\\r]+')) as w from term_texts) where w <> ''"""
_CTES["slot_counts"] = """select id, (('0x' || substr(md5(w), 1, 8))::bigint % 512)::int as slot, count(*) as tf
from term_words group by all"""
_CTES["slot_values"] = """select id, slot, round((x / sqrt(sum(x * x) over (partition by id)))::float::double, 6) as value from (
  select id, slot, tf * ln(((select count(*) from term_texts) + 1.0) / (count(*) over (partition by slot) + 1)) as x from slot_counts)
qualify x > 0"""
_CTES["term_counts"] = "select id, w, count(*) as tf, count(*) over (partition by w) as df from term_words group by id, w"
_CTES["term_weights"] = """select id, w, x / sqrt(sum(x * x) over (partition by id)) as x from (
  select id, w, tf * ln(((select count(*) from term_texts) + 1.0) / (df + 1)) as x from term_counts) where x > 0"""
_CTES["term_neighbours"] = """select anchor_id, neighbour_id, score from (
  select a.id as anchor_id, b.id as neighbour_id, round(sum(a.x * b.x), 9) as score
  from term_weights a join term_weights b using (w) group by 1, 2 having round(sum(a.x * b.x), 9) >= 0.86
  qualify row_number() over (partition by a.id order by round(sum(a.x * b.x), 9) desc, b.id) <= 7)
where anchor_id <> neighbour_id"""
_CTES["term_links"] = """select anchor_id as a, neighbour_id as b from term_neighbours
union select neighbour_id, anchor_id from term_neighbours"""
_CTES["term_reached"] = """select a as id, a as root from term_links
union select l.b, r.root from term_reached r join term_links l on l.a = r.id"""
_CTES["term_components"] = "select id, min(root) as component from term_reached group by id"
_NEEDS |= {
    "term_texts": ["document_issues"],
    "term_words": ["term_texts"],
    "slot_counts": ["term_words"],
    "slot_values": ["slot_counts"],
    "term_counts": ["term_words"],
    "term_weights": ["term_counts"],
    "term_neighbours": ["term_weights"],
    "term_links": ["term_neighbours"],
    "term_reached": ["term_links"],
    "term_components": ["term_reached"],
}
_add(
    "embed_issues",
    "slot_values",
    """select 'issue:' || id as id, channel_id as channelId, coalesce(sentiment, '') as sentiment, slot, value
from slot_values join term_texts using (id)""",
)
_add("refresh_embeddings", "slot_values", "select id, slot, value from slot_values")
_add(
    "update_terms",
    "term_words",
    """select true as is_word, df, count(*) as words from (select w, count(distinct id) as df from term_words group by w) group by df
union all select false, count(*), 1 from term_texts""",
)
_add(
    "sparse_knn_join",
    "term_neighbours",
    "select anchor_id, neighbour_id, round(score, 6) as score from term_neighbours",
)
_add(
    "duplicate_documents",
    "term_components document_issues",
    "select d.id, component as duplicate_cluster_id from document_issues d left join term_components c on c.id = d.id",
)
_add(
    "vector_upsert",
    "vectors",
    """select id, cast(case when vec_id % 3 = 0 then -1 else label end as bigint) as label, len(v) as dimension from vectors
where vec_id % 2 = 0 or vec_id % 3 = 0""",
)
_add("knn_join", "neighbours", "select anchor_id, neighbour_id, round(score, 6) as score from neighbours")
_add("similarity_edges", "edges", "select * from edges")
_add("connected_components", "components", "select * from components")
_add("grow_components", "components", "select * from components")
_add(
    "build_clusters",
    "components vector_issues",
    """select component as id, coalesce(left(any_value(name), 80), 'cluster-' || component) as name, cast(null as varchar) as description,
  count(*) as issue_count from components left join vector_issues v on v.id = component group by component""",
)
# The scheduled job looks for neighbours of unclustered issues only.
_sql["daily_clustering_vectors"] = _sql["build_clusters"].replace(
    "from neighbours)",
    """from neighbours where anchor_id in
  (select cast(vec_id as varchar) from embeddings where vec_id % 10 <> 0))""",
)
_add(
    "assign_clusters",
    "components vector_issues",
    """select v.id, name, coalesce(component, duplicate_cluster_id) as duplicate_cluster_id
from vector_issues v left join components c on c.id = v.id""",
)
_add(
    "semantic_search",
    "vectors",
    """, q as (select cast(label as varchar) as query_id, v from vectors qualify row_number() over (partition by label order by vec_id) = 1)
select query_id, id as issue_id, cast(label as varchar) as channel_id, round(list_cosine_similarity(q.v, x.v), 6) as score,
  row_number() over (partition by query_id order by list_cosine_similarity(q.v, x.v) desc, id) as rank
from q, vectors x qualify rank <= 10""",
)
_add(
    "embedding_cache_delta",
    "vectors",
    """, d as (select count(*) filter (where vec_id % 90 <> 1) as current,
  count(*) filter (where vec_id % 90 <> 1 and vec_id % 80 = 0) as missing,
  count(*) filter (where vec_id % 90 = 1 and vec_id % 80 <> 0) as extra from vectors)
select *, case when missing = 0 and extra = 0 then 'reuse' when missing <= greatest(10, current * 0.01) then 'partial' else 'stale' end
  as policy from d""",
)

# Exports


def _csv_value(header: str) -> str:
    column = {
        "createdAt": _iso("created_at"),
        "archivedAt": _iso("archived_at"),
        "appliedTags": f"array_to_string(list_transform(applied_tags, lambda x: {_tag_name('x')}), '; ')",
        "firstMessageContent": "md5(left(replace(first_message_content, chr(10), ' '), 500))",
        "firstMessageCreatedAt": _iso("first_message_created_at"),
        "sentimentScore": "sentiment_score",
        "discordUrl": f"'{THREAD_URL_BASE}/{DEFAULT_GUILD_ID}/' || id",
    }.get(header)
    if column is None:
        column = "".join("_" + ch.lower() if ch.isupper() else ch for ch in header)
    return f'coalesce(cast({column} as varchar), \'\') as "{header}"'


_add("export_csv", "full_issues", f"select {', '.join(map(_csv_value, CSV_HEADERS))} from full_issues")
_add(
    "export_json",
    "threads replies",
    f""", p as (select issue_id, id, ts, (row_number() over (partition by issue_id order by ts, id) - 1) // 4 as part from replies),
g as (select issue_id, part, list(id order by ts, id) as ids from p group by 1, 2)
select t.id, coalesce(part, 0) as part, case when replies_loaded then {_list('coalesce(ids, [])')} end as reply_ids
from threads t left join g on g.issue_id = t.id""",
)
_add(
    "backup_ndjson",
    "threads replies clusters themes",
    """select 'issues' as "table", count(*) as rows from threads union all select 'replies', count(*) from replies
union all select 'duplicate_clusters', count(*) from clusters union all select 'theme_clusters', count(*) from themes""",
)


def _line(section: int, order: str, text: str, source: str) -> str:
    return f"select {section} as section, cast({order} as bigint) as ord, {text} as line from {source}"


def _row(name: str, value: str) -> str:
    return f"'| {name} | ' || {value} || ' |'"


_report = [
    *[
        _line(1, str(i), _q(t), "a")
        for i, t in enumerate(
            ["# Forum issues: summary report", "", "**Channel ID:** ASIA", f"**Generated:** {NOW}"]
        )
    ],
    _line(1, "4", "'**Issues loaded:** ' || issues || ' of ' || format('{:,}', forum) || ' total'", "a"),
    *[
        _line(1, str(i), _q(t), "a")
        for i, t in enumerate(["", "## Key Metrics", "", "| Metric | Value |", "|---|---|"], 5)
    ],
    _line(1, "10", _row("Total Issues (loaded)", "issues"), "a"),
    _line(1, "11", _row("Total Issues (in forum)", "format('{:,}', forum)"), "a"),
    _line(1, "12", _row("Unique Reporters", "reporters"), "a"),
    _line(1, "13", _row("Total Messages", "format('{:,}', messages)"), "a"),
    _line(1, "14", _row("Response Rate", f"{_half_up('rate * 100')} || '%'"), "a"),
    _line(1, "15", _row("Avg Response Time", _duration("wait")), "a where wait is not null"),
    _line(1, "16", _row("Frustrated Issues", "frustrated"), "a where scored > 0"),
    _line(1, "17", _row("Resolved Issues", "resolved"), "a where scored > 0"),
    _line(1, "18", "''", "a"),
    *[
        _line(2, str(i), _q(t), "a")
        for i, t in enumerate(
            ["## Common Themes", "", "| Theme | Count | Description |", "|---|---|---|"]
        )
    ],
    _line(2, "rank + 10", "'| ' || theme || ' | ' || count || ' | ' || description || ' |'",
          "(select *, row_number() over (order by theme = 'Other', count desc, theme) as rank from themes) where rank <= 10"),
    _line(3, "0", "'## Duplicate Clusters (Recurring Issues)'", "a"),
    _line(3, "1", "''", "a"),
    *[
        _line(3, f"rank * 10 + {i}", text,
              "(select *, row_number() over (order by issue_count desc, id) as rank from clusters) where rank <= 8")
        for i, text in enumerate(["'### ' || name || ' (' || issue_count || ' duplicates)'", "'__'", "''"])
    ],
    _line(4, "0", "'## Top Issues by Message Count'", "a"),
    _line(4, "1", "''", "a"),
    *[
        _line(4, f"rank * 10 + {i}", text,
              "(select *, row_number() over (order by message_count desc, created_at desc, id) as rank from full_issues) where rank <= 10")
        for i, text in enumerate(
            [
                "'- **' || name || '** — ' || message_count || ' msgs, by @' || owner_username || ' (' || strftime(created_at, '%b %-d, %Y') || ')'",
                f"'  {THREAD_URL_BASE}/{DEFAULT_GUILD_ID}/' || id",
            ]
        )
    ],
    *[_line(5, str(i), _q(t), "a") for i, t in enumerate(["", "---", "_Generated from the forum tables_"])],
]
_add(
    "summary_report",
    "full_issues issues themes clusters",
    f""", a as (select count(*) as issues, (select count(*) from issues) as forum, count(distinct owner_id) as reporters,
  cast(sum(case when total_message_sent <> 0 then total_message_sent else message_count end) as bigint) as messages,
  count(*) filter (where sentiment = 'frustrated') as frustrated, count(*) filter (where sentiment = 'resolved') as resolved,
  count(sentiment) as scored,
  count(*) filter (where replies_loaded and is_answered) / count(*) filter (where replies_loaded) as rate,
  avg(response_time_ms) filter (where replies_loaded and is_answered and response_time_ms > 0) as wait from full_issues)
select cast(section as bigint) as section, ord, line from ({' union all '.join(_report)})""",
)

# Scheduled jobs

_touched = "(okey % 7 = 0 or okey % 11 = 0 or okey % 13 = 0)"
_fresh = f"({_touched} and message_count > 1)"
_add(
    "incremental_sync",
    "issues",
    f"""select id, message_count, archived, {_fresh} and is_answered as is_answered,
  case when {_fresh} then response_time_ms end as response_time_ms,
  case when {_fresh} then responder_count else 0 end as responder_count,
  case when {_fresh} then resolution_status when okey % 7 = 0 then 'unanswered' else 'unknown' end as resolution_status,
  case when {_fresh} then reply_count else 0 end as replies from issues""",
)
_add(
    "hourly_recent_sync",
    "issues",
    f""", n as (select id from issues where not archived),
s as (select i.*, n.id is not null as recent, case when okey % 7 <> 0 then created_at else timestamp '{NOW}' end as fetched
  from issues i left join n on n.id = i.id where okey % 7 <> 0 or n.id is not null),
q as (select id from s where message_count > 1)
select id, message_count, case when id in (select id from q) then {_ts(f"timestamp '{NOW}'")} else {_ts('fetched')} end as fetched_at,
  case when okey % 7 <> 0 then resolution_status else 'unknown' end as resolution_status,
  case when id in (select id from q) then reply_count else 0 end as replies from s""",
)
_add(
    "stream_daily_stats",
    "event_issues",
    """select strftime(created_at, '%Y-%m-%d') as date, channel_id, count(*) as issue_count,
  cast(sum(message_count) as bigint) as total_messages, count(*) filter (where is_answered) as answered_count
from event_issues group by 1, 2""",
)
