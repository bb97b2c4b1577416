"""DuckDB SQL for the registered queries: written apart from the engine, as an oracle for it."""

ORACLE_SQL: dict[str, str] = {
    "src_iter": """
select row_number() over (order by event_id)-1 as ts, event_id as value from events
""",
    "map_double": """
select event_id as k, event_id*2 as value from events
""",
    "filter_lt": """
select event_id as value from events where event_id < 42
""",
    "filter_map_parse": """
select event_id, try_cast(regexp_extract(props,'([0-9]+)',1) as int)*2 as value from events where try_cast(regexp_extract(props,'([0-9]+)',1) as int) < 42
""",
    "flatten_words": """
select doc_id as k, w as value from (select doc_id, unnest(string_split(text,' ')) as w from documents)
""",
    "split_flags": """
select 'even' as branch, event_id as value from events where event_id%2=0 union all select 'all', event_id from events
""",
    "cloned_two": """
select 0 as branch, event_id as value from events union all select 1, event_id from events
""",
    "union_all": """
select o_orderkey as value from orders union all select l_orderkey from lineitem
""",
    "index_select": """
select event_id, user_id % 4 as worker from events
""",
    "key_counts": """
select user_id as k, count(*) as n from events group by user_id
""",
    "running_sum": """
select event_id, user_id as k, sum(cast(value*100 as decimal(18,0))) over (partition by user_id order by seq rows unbounded preceding)::bigint as total_cents from (select *, row_number() over (order by event_id)-1 as seq from events)
""",
    "batch_n": """
select k, b, count(*) as n, sum(event_id)::bigint as id_sum, case when count(*)=3 then max(seq) end as closed_at from (select user_id as k, event_id, seq, (row_number() over (partition by user_id order by seq)-1)//3 as b from (select *, row_number() over (order by event_id)-1 as seq from events)) group by k,b
""",
    "epochs_monotonic": """
select seq, ts as epoch from (select seq, ts, max(ts) over (order by seq rows between unbounded preceding and 1 preceding) as p from (select *, row_number() over (order by event_id + case when event_id%7=0 then 20 else 0 end, event_id)-1 as seq from events)) where p is null or ts > p
""",
    "late_split_on_time": """
select event_id, ts from (select event_id, ts, max(ts - interval 1 hour) over (order by seq rows between unbounded preceding and 1 preceding) as ep from (select *, row_number() over (order by event_id + case when event_id%7=0 then 20 else 0 end, event_id)-1 as seq from events)) where not (ep is not null and ts <= ep)
""",
    "late_split_late": """
select event_id, ts from (select event_id, ts, max(ts - interval 1 hour) over (order by seq rows between unbounded preceding and 1 preceding) as ep from (select *, row_number() over (order by event_id + case when event_id%7=0 then 20 else 0 end, event_id)-1 as seq from events)) where (ep is not null and ts <= ep)
""",
    "late_orders_365d": """
select o_orderkey, coalesce(o_orderdate <= ep,false) as is_late from (select o_orderkey,o_orderdate,max(o_orderdate - interval 365 day) over (order by o_orderkey rows between unbounded preceding and 1 preceding) as ep from orders)
""",
    "daily_balance": """
with s as (select seq, ts, user_id, event_id, cast(value*100 as decimal(18,0)) as v, date_trunc('day',ts) - interval 1 microsecond as cand from (select *, row_number() over (order by event_id)-1 as seq from events)),
 p as (select *, max(cand) over (order by seq rows unbounded preceding) as e, max(cand) over (order by seq rows between unbounded preceding and 1 preceding) as pe from s),
 ep as (select seq, e from p where pe is null or e > pe),
 ok as (select seq, user_id, v, date_trunc('day',ts) as d from p where pe is null or ts > pe),
 cl as (select ok.user_id, ok.d, ok.v, min(ep.seq) as close_seq from ok left join ep on ep.seq >= ok.seq and date_trunc('day', ep.e) >= ok.d group by ok.seq, ok.user_id, ok.d, ok.v)
 select cl.user_id, cl.d as day, sum(cl.v)::bigint as cents, max(ep.e) as closed_at from cl left join ep on ep.seq = cl.close_seq group by cl.user_id, cl.d, cl.close_seq
""",
    "daily_balance_ooo": """
with s as (select seq, ts, user_id, event_id, cast(value*100 as decimal(18,0)) as v, ts - interval 2 day as cand from (select *, row_number() over (order by event_id + case when event_id%7=0 then 20 else 0 end, event_id)-1 as seq from events)),
 p as (select *, max(cand) over (order by seq rows unbounded preceding) as e, max(cand) over (order by seq rows between unbounded preceding and 1 preceding) as pe from s),
 ep as (select seq, e from p where pe is null or e > pe),
 ok as (select seq, user_id, v, date_trunc('day',ts) as d from p where pe is null or ts > pe),
 cl as (select ok.user_id, ok.d, ok.v, min(ep.seq) as close_seq from ok left join ep on ep.seq >= ok.seq and date_trunc('day', ep.e) >= ok.d group by ok.seq, ok.user_id, ok.d, ok.v)
 select cl.user_id, cl.d as day, sum(cl.v)::bigint as cents, max(ep.e) as closed_at from cl left join ep on ep.seq = cl.close_seq group by cl.user_id, cl.d, cl.close_seq
""",
    "daily_balance_late": """
with s as (select seq, ts, user_id, event_id, cast(value*100 as decimal(18,0)) as v, ts - interval 1 hour as cand from (select *, row_number() over (order by event_id + case when event_id%7=0 then 20 else 0 end, event_id)-1 as seq from events)),
 p as (select *, max(cand) over (order by seq rows unbounded preceding) as e, max(cand) over (order by seq rows between unbounded preceding and 1 preceding) as pe from s),
 ep as (select seq, e from p where pe is null or e > pe),
 ok as (select seq, user_id, v, date_trunc('day',ts) as d from p where pe is null or ts > pe),
 cl as (select ok.user_id, ok.d, ok.v, min(ep.seq) as close_seq from ok left join ep on ep.seq >= ok.seq and date_trunc('day', ep.e) >= ok.d group by ok.seq, ok.user_id, ok.d, ok.v)
 select cl.user_id, cl.d as day, sum(cl.v)::bigint as cents, max(ep.e) as closed_at from cl left join ep on ep.seq = cl.close_seq group by cl.user_id, cl.d, cl.close_seq
""",
    "ttl_count": """
with s as (select seq, ts, event_type as k, event_id, max(ts) over (order by seq rows between unbounded preceding and 1 preceding) as pe from (select *, row_number() over (order by event_id)-1 as seq from events))
 select a.event_id, count(b.event_id) as live from s a join s b on a.k=b.k and b.seq<=a.seq and b.ts >= a.ts - interval 1 day and (b.seq=a.seq or a.pe is null or b.ts + interval 6 hour > a.pe) group by a.event_id
""",
    "ttl_running_total": """
with s as (select seq, ts, user_id as k, event_id, cast(value*100 as decimal(18,0)) as v, max(ts) over (order by seq rows between unbounded preceding and 1 preceding) as pe from (select *, row_number() over (order by event_id)-1 as seq from events)),
 g as (select *, case when lag(ts) over (partition by k order by seq) + interval 2 hour > pe then 0 else 1 end as brk from s),
 i as (select *, sum(brk) over (partition by k order by seq rows unbounded preceding) as isl from g)
 select event_id, sum(v) over (partition by k, isl order by seq rows unbounded preceding)::bigint as total_cents from i
""",
    "frontier": """
select distinct e as epoch from (select max(ts - interval 1 hour) over (order by seq rows unbounded preceding) as e from (select *, row_number() over (order by event_id + case when event_id%7=0 then 20 else 0 end, event_id)-1 as seq from events))
""",
    "union_frontier": """
with u as (select ts, 0 as src, event_id as o from events where event_id%2=0 union all select ts,1,event_id from events where event_id%2=1),
 s as (select row_number() over (order by o)-1 as seq, ts, src from u),
 m as (select seq, max(case when src=0 then ts end) over w as a, max(case when src=1 then ts end) over w as b from s window w as (order by seq rows unbounded preceding))
 select distinct least(a,b) as epoch from m where a is not null and b is not null
""",
    "sink_line_numbers": """
select event_type as part, row_number() over (partition by event_type order by seq)-1 as line_no, event_id as value from (select *, row_number() over (order by event_id)-1 as seq from events)
""",
    "skew_route": """
select event_id, case when user_id=0 then 0 else 1 + user_id%3 end as worker from events
""",
    "flush_max": """
select k, count(*) as n from (select user_id as k, row_number() over (partition by user_id order by seq) as rn, count(*) over (partition by user_id) as c from (select *, row_number() over (order by event_id)-1 as seq from events)) where (rn-1)//3 = (c-1)//3 and c%3<>0 group by k
""",
    "src_lines": """
select doc_id as k, i - 1 as ts, ls[i] as value from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(text, chr(10)) as ls from documents))
""",
    "kafka_map": """
select 'events' as topic, event_type as key, props as payload, (user_id % 4)::int as "partition" from events where event_id % 5 <> 0
""",
    "map_upper": """
select event_id as k, upper(event_type) as value from events
""",
    "flatten_keyed": """
select length(event_type)::int as k, ts, unnest(string_split(event_type, '')) as value from (select event_type, row_number() over (order by event_id) - 1 as ts from events)
""",
    "custom_flatten": """
select doc_id as k, w as value from (select doc_id, unnest(string_split(text,' ')) as w from documents)
""",
    "inspect_metrics": """
select event_id as value from events
""",
    "split_even_odd": """
select case when event_id % 2 = 0 then 'even' else 'odd' end as branch, event_id as value from events
""",
    "key_local": """
select event_id, user_id % 2 = 0 as k from events
""",
    "running_sum_parity": """
select event_id, event_id % 2 = 1 as odd, sum(event_id) over (partition by event_id % 2 order by event_id rows unbounded preceding)::bigint as total from events
""",
    "running_extremes": """
select event_id, min(v) over w as least, max(v) over w as greatest, count(*) over w as nth from (select *, cast(value * 100 as decimal(18,0))::bigint as v from events)
 window w as (partition by event_type order by event_id rows unbounded preceding)
""",
    "concat_reset": """
with recursive s as (select event_id, user_id, event_type, row_number() over (partition by user_id order by event_id) as n from events),
 r as (select event_id, user_id, n, event_type as value from s where n = 1
   union all select s.event_id, s.user_id, s.n, case when length(r.value) >= 20 then '' else r.value end || s.event_type from r join s on s.user_id = r.user_id and s.n = r.n + 1)
 select event_id, value from r
""",
    "assign_ts": """
select event_id, ts from events
""",
    "monthly_orders": """
with s as (select o_orderkey as seq, o_custkey, o_orderdate as ts, o_orderdate - interval 365 day as cand from orders),
 p as (select *, max(cand) over (order by seq rows unbounded preceding) as e, max(cand) over (order by seq rows between unbounded preceding and 1 preceding) as pe from s),
 ep as (select seq, e from p where pe is null or e > pe),
 ok as (select seq, o_custkey, date_trunc('month', ts) as d from p where pe is null or ts > pe),
 cl as (select ok.seq, ok.o_custkey, ok.d, min(ep.seq) as close_seq from ok left join ep on ep.seq >= ok.seq and date_trunc('month', ep.e) >= ok.d group by ok.seq, ok.o_custkey, ok.d)
 select o_custkey as custkey, d as month, count(*) as n, max(ep.e) as closed_at from cl left join ep on ep.seq = cl.close_seq group by o_custkey, d, close_seq
""",
    "sink_stdout_fmt": """
select event_id, '{ key: NoKey, value: "' || upper(event_type) || '", timestamp: ' || (row_number() over (order by event_id) - 1) || ' }' as line from events
""",
    "stream_running_sum": """
select event_id, user_id as k, sum(cast(value*100 as decimal(18,0))) over (partition by user_id order by seq rows unbounded preceding)::bigint as total_cents from (select *, row_number() over (order by event_id)-1 as seq from events)
""",
    "stream_batch_n": """
select k, sum(event_id)::bigint as id_sum, max(event_id) as closed_at from (select user_id as k, event_id, (row_number() over (partition by user_id order by event_id) - 1) // 3 as b from events) group by k, b having count(*) = 3
""",
    "stream_late": """
select event_id from (select event_id, ts, max(ts - interval 1 hour) over (order by seq rows between unbounded preceding and 1 preceding) as ep from (select *, row_number() over (order by event_id + case when event_id%7=0 then 20 else 0 end, event_id)-1 as seq from events)) where (ep is not null and ts <= ep)
""",
    "stateless_epochs": """
select count(*) as events, count(distinct event_id) as "different", count(*)::bigint as counted from (select event_id, ts, max(ts - interval 1 hour) over (order by seq rows between unbounded preceding and 1 preceding) as ep from (select *, row_number() over (order by event_id + case when event_id%7=0 then 20 else 0 end, event_id)-1 as seq from events)) where not (ep is not null and ts <= ep)
""",
    "src_resume": """
select p.range::varchar as k, v.range as value from range(3) p, range(25) v
""",
    "src_file_lines": """
select event_type as k, row_number() over (partition by event_type order by event_id) - 1 as ts, event_id::varchar as value from events
""",
    "sink_numbered_files": """
select event_type as part, row_number() over (partition by event_type order by event_id) - 1 as line_no, event_id as value from events
""",
    # Ten transactions of a public example of event time.
    "monthly_balance": """
with s as (select seq, ts, amount, (date_trunc('month', ts) - interval 1 day)::date as cand from (values (0, date '2025-01-01', 1000), (1, date '2025-01-05', -20), (2, date '2025-01-17', -150), (3, date '2025-02-04', -300), (4, date '2025-02-16', 60), (5, date '2025-02-25', 75), (6, date '2025-03-16', -55), (7, date '2025-03-31', 200), (8, date '2025-04-05', -10), (9, date '2025-04-19', -5)) t(seq, ts, amount)),
 p as (select *, max(cand) over (order by seq rows unbounded preceding) as e, max(cand) over (order by seq rows between unbounded preceding and 1 preceding) as pe from s),
 ep as (select seq, e from p where pe is null or e > pe),
 ok as (select seq, amount, ts, date_trunc('month', ts) as d from p where pe is null or ts > pe),
 cl as (select ok.seq, ok.ts, ok.amount, ok.d, min(ep.seq) as close_seq from ok left join ep on ep.seq >= ok.seq and date_trunc('month', ep.e) >= ok.d group by ok.seq, ok.ts, ok.amount, ok.d)
 select year(cl.ts)::int as year, month(cl.ts)::int as month, sum(amount)::bigint as balance, max(ep.e)::date as closed_at from cl left join ep on ep.seq = cl.close_seq group by year(cl.ts), month(cl.ts), close_seq
""",
    "monthly_balance_ooo": """
with s as (select seq, ts, amount, (ts - interval 62 day)::date as cand from (values (0, date '2025-01-01', 1000), (1, date '2025-01-05', -20), (2, date '2025-02-04', -300), (3, date '2025-01-17', -150), (4, date '2025-02-16', 60), (5, date '2025-03-16', -55), (6, date '2025-02-25', 75), (7, date '2025-04-05', -10), (8, date '2025-03-31', 200), (9, date '2025-04-19', -5)) t(seq, ts, amount)),
 p as (select *, max(cand) over (order by seq rows unbounded preceding) as e, max(cand) over (order by seq rows between unbounded preceding and 1 preceding) as pe from s),
 ep as (select seq, e from p where pe is null or e > pe),
 ok as (select seq, amount, ts, date_trunc('month', ts) as d from p where pe is null or ts > pe),
 cl as (select ok.seq, ok.ts, ok.amount, ok.d, min(ep.seq) as close_seq from ok left join ep on ep.seq >= ok.seq and date_trunc('month', ep.e) >= ok.d group by ok.seq, ok.ts, ok.amount, ok.d)
 select year(cl.ts)::int as year, month(cl.ts)::int as month, sum(amount)::bigint as balance, max(ep.e)::date as closed_at from cl left join ep on ep.seq = cl.close_seq group by year(cl.ts), month(cl.ts), close_seq
""",
    # Five words of a public example of expiring state.
    "ttl_concat": """
with s as (select seq::bigint as seq, w, lag(seq) over (order by seq) as pe from (values (0, 'foo'), (1, 'bar'), (2, 'hello'), (3, 'world'), (4, 'baz')) t(seq, w))
 select a.seq, string_agg(b.w, '|' order by b.seq) as value from s a join s b on b.seq <= a.seq and (b.seq = a.seq or a.pe is null or b.seq + 2 > a.pe) group by a.seq
""",
}

# The same dataflows, run in another way.
ORACLE_SQL["stream_ttl_running_total"] = ORACLE_SQL["ttl_running_total"]
ORACLE_SQL["stream_daily_balance"] = ORACLE_SQL["stateful_daily_balance"] = ORACLE_SQL["daily_balance"]
ORACLE_SQL["union_epochs"] = ORACLE_SQL["union_frontier"]
