"""DuckDB SQL of the queries of ``stored``."""

from __future__ import annotations

from graphmend.functions.tokens import DIRECT, ENTITY
from graphmend.operators.baselines import SLOTS

from . import oracles as base

_SPELLED = f"""case n % 5 when 0 then 'Q' || n when 1 then '<{ENTITY}Q' || n || '>' when 2 then '{DIRECT}P' || n when 3 then 'P' || n || '$stmt-' || n
  else 'http://example.org/item/Q' || n end"""
_ENTRIES = f"""pt as (select p_partkey n, p_brand, p_size, [{', '.join(f"'{i}'" for i in base._ITEMS)}, 'Q1', ''][p_partkey % 12 + 1] type_item from part),
pa as (select *, {_SPELLED} raw_id from pt),
tried as (select n, case when n % 5 < 2 then ['{ENTITY}Q' || n, '<{ENTITY}Q' || n || '>', 'Q' || n] when n % 5 = 2 then ['{ENTITY}P' || n, '<{ENTITY}P' || n || '>', 'P' || n]
  when n % 5 = 3 then [raw_id] else [raw_id, '<' || raw_id || '>', 'Q' || n] end names from pa),
vo as (select '{ENTITY}Q' || n token, n * 10 id from pa where n % 7 = 0 union all select 'Q' || n, n * 10 + 1 from pa where n % 7 < 3
  union all select '<{ENTITY}Q' || n || '>', n * 10 + 2 from pa where n % 7 = 1 union all select '{ENTITY}P' || n, n * 10 + 3 from pa where n % 7 = 3
  union all select 'P' || n || '$stmt-' || n, n * 10 + 4 from pa where n % 7 in (4, 5) union all select 'P' || n, n * 10 + 5 from pa where n % 7 = 5),
hit as (select n, min_by(id, k) id from (select n, unnest(names) token, generate_subscripts(names, 1) k from tried) join vo using (token) where id <> 0 group by 1),
att as (select distinct l_partkey * 10 + l_linenumber - 1 id from lineitem),
en as (select pa.*, id, coalesce(d, -1) dense from pa left join hit using (n)
  left join (select type_item, row_number() over (order by type_item) - 1 d from (select distinct type_item from pa where type_item <> '')) using (type_item))"""
_CELLS = f"""with {_ENTRIES} select case when id is null then 'unresolved' when id in (select id from att) then 'both' else 'registry' end side, raw_id, id,
  case n % 5 when 2 then 'P' || n when 3 then raw_id when 4 then raw_id else 'Q' || n end constraint_key, type_item, 'family ' || p_brand family, n % 4 < 3 and n % 3 = 0 supported,
  case when n % 4 = 0 then n % 50 else dense end type_index, 'P' || (100 + n % 37) property,
  case n % 4 when 2 then '' when 3 then 'P1,' || p_size else 'P' || p_size end param_predicates, '' param_objects,
  case when n % 4 = 3 then 'constraint_family_supported=perhaps,constraint_type_index=x,param_objects=' || n end rescued from en
union all select 'records', null, id, null, null, null, null, null, null, null, null, null from att where id not in (select id from en where id is not null)"""

ORACLES: dict[str, str] = {
    "registry_cells": _CELLS,
    "stored_predictions": f"""with {base._VARIANTS} select 'p' || (violation_id // 1000) file, row_number() over (partition by violation_id // 1000 order by violation_id) - 1 line,
  {', '.join(f'p_{s}::bigint {s}' for s in SLOTS)} from pv where variant = 'normal'""",
    "filtered_view": f"""with {base._TOKENS}, ks as (
  select token from nz join v using (violation_id) where split = 'train' group by 1 having count(*) >= 5 union select unnest(range(1, 9))),
ci as (select token, row_number() over (order by token) id from ks)
select violation_id, field, count(*) n, md5(string_agg(coalesce(id, (select id from ci where token = 8))::varchar, ',' order by pos)) values_md5 from nz left join ci using (token) group by 1, 2""",
    "cache_lookup": """select o_orderkey, o_custkey + 2000000000 id, case when c_acctbal >= 0 then c_name when o_orderpriority < '3' then 'priority ' || o_orderpriority else 'unknown' end "text"
from orders left join customer on o_custkey = c_custkey""",
}
