"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from graphmend.operators.registry import TYPE_ITEMS

from .oracle_base import ADD_MIRROR, DELETE_FOCUS, RECORDS, evaluated, labels

_COVERAGE = """
select case when in_registry then family else 'missing_registry' end family, count(*) total,
  count(*) filter (where checkable_pre) checkable_pre, count(*) filter (where checkable_post) checkable_post,
  sum(satisfied_pre)::bigint satisfied_pre, sum(satisfied_post)::bigint satisfied_post,
  count(*) filter (where checkable_pre) / count(*) checkable_rate_pre, count(*) filter (where checkable_post) / count(*) checkable_rate_post,
  coalesce(sum(satisfied_pre) / nullif(count(*) filter (where checkable_pre), 0), 0) satisfied_rate_pre,
  coalesce(sum(satisfied_post) / nullif(count(*) filter (where checkable_post), 0), 0) satisfied_rate_post
from f group by 1"""

_told = lambda c: f"string_agg({c}::varchar, ',' order by constraint_id)"

_BIN = """case when n <= 0 then '0' when n <= 32 then '1-32' when n <= 64 then '33-64' when n <= 83 then '65-83' when n <= 107 then '84-107'
  when n = 108 then '108' when n <= 160 then '109-160' when n <= 267 then '161-267' else '268+' end"""
_SIZES = f"""{RECORDS},
sizes as (select violation_id, split, constraint_type, n, {_BIN} bin
  from (select violation_id, count(*) n from cl group by 1) join v using (violation_id)),
sampled as (select * from (
  select *, row_number() over (partition by split, constraint_type, bin order by md5('42-' || violation_id), violation_id) rn,
    count(*) over (partition by split, constraint_type, bin) total from sizes)
  where rn <= least(total, greatest(1, round_even(total * 0.5, 0))))"""


def _closure(name: str) -> str:
    return f"""with {RECORDS}
select violation_id, count(*) attached, md5(string_agg(constraint_id::varchar, ',' order by constraint_id)) ids_md5 from {name} group by 1"""


_SLOTS = ("add_s", "add_p", "add_o", "del_s", "del_p", "del_o")
_EDIT = ("add_subject", "add_predicate", "add_object", "del_subject", "del_predicate", "del_object")
_GOLD = ", ".join(f"{e} {s}" for e, s in zip(_EDIT, _SLOTS, strict=True))
_FOCUS = ", ".join(f"{x}::bigint {s}" for x, s in zip((0, 0, 0, 1, 2, 3), _SLOTS, strict=True))


def _majority(key: str) -> str:
    modes = ", ".join(
        f"(select arg_max({e}, (n, -{e})) from (select {e}, count(*) n from v t where t.split = 'train' and t.{key} = r.{key} group by 1)) {s}"
        for e, s in zip(_EDIT, _SLOTS, strict=True)
    )
    whole = ", ".join(
        f"(select arg_max({e}, (n, -{e})) from (select {e}, count(*) n from v t where t.split = 'train' group by 1)) g_{s}"
        for e, s in zip(_EDIT, _SLOTS, strict=True)
    )
    both = ", ".join(f"coalesce({s}, g_{s})::bigint {s}" for s in _SLOTS)
    return f"""with {RECORDS}, m as (select r.{key} mk, {modes} from (select distinct {key} from v) r), g as (select {whole})
select violation_id, {both} from v left join m on mk = {key}, g"""


_PREDICTED = f"""{RECORDS},
g as (select violation_id, constraint_type, {_GOLD} from v),
pr as (select violation_id, constraint_type, {', '.join(f"case when violation_id % 5 = 0 then {x} else {s} end {s}" for x, s in zip((0, 0, 0, 1, 2, 3), _SLOTS, strict=True))} from g),
act as (
  select violation_id, g.constraint_type, a action,
    case when a = 'add' and pr.add_s <> 0 and pr.add_p <> 0 and pr.add_o <> 0 then [pr.add_s, pr.add_p, pr.add_o]
      when a = 'del' and pr.del_s <> 0 and pr.del_p <> 0 and pr.del_o <> 0 then [pr.del_s, pr.del_p, pr.del_o] end predicted,
    case when a = 'add' and g.add_s <> 0 and g.add_p <> 0 and g.add_o <> 0 then [g.add_s, g.add_p, g.add_o]
      when a = 'del' and g.del_s <> 0 and g.del_p <> 0 and g.del_o <> 0 then [g.del_s, g.del_p, g.del_o] end gold
  from g join pr using (violation_id), (values ('add'), ('del')) t(a)),
hits as (select *, coalesce(predicted = gold, false) hit from act)"""
_PRF = """select *, coalesce(tp / nullif(tp + fp, 0), 0) "precision", coalesce(tp / nullif(tp + fn, 0), 0) recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) f1 from"""
_SUMS = """count(*) filter (where hit) tp, count(*) filter (where predicted is not null and not hit) fp,
  count(*) filter (where gold is not null and not hit) fn"""


def _fits(value: str, *roles: str) -> str:
    """Whether a triple's parts are the roles' placeholders or ids."""
    order = ("subject", "predicate", "object", "other_subject", "other_predicate", "other_object")
    return " and ".join(f"({value}[{i}] = {order.index(r) + 1} or ({r} <> 0 and {value}[{i}] = {r}))" for i, r in enumerate(roles, 1))


#: Placeholders of the roles.
_ROLE_MARK = {r: i for i, r in enumerate(("subject", "predicate", "object", "other_subject", "other_predicate", "other_object"), 1)}
_RIVAL = "other_subject <> 0 and other_object <> 0 and other_predicate = predicate and other_object = object and other_subject <> subject"
_MIXED = "constraint_type in ('conflictWith', 'single', 'oneOf') and other_subject <> 0 and other_subject = subject and other_predicate <> 0"
_PAR = lambda kind, test: f"exists (select 1 from def d where d.constraint_id = r.constraint_id and d.parameter = '{kind}' and {test})"
_OUTCOME = f"""{_PREDICTED},
fixed as (
  select violation_id, r.constraint_type, action, case
    when predicted is null then case when gold is null then 'exact' else 'missing_prediction' end when hit then 'exact'
    when action = 'del' and (({_fits('predicted', 'subject', 'predicate', 'object')})
      or (other_predicate <> 0 and {_fits('predicted', 'other_subject', 'other_predicate', 'other_object')})
      or (constraint_type = 'distinct' and {_RIVAL} and {_fits('predicted', 'other_subject', 'predicate', 'object')})
      or ({_MIXED} and other_predicate = predicate and {_fits('predicted', 'subject', 'predicate', 'other_object')})
      or ({_MIXED} and {_fits('predicted', 'subject', 'other_predicate', 'object')})
      or ({_MIXED} and {_fits('predicted', 'subject', 'other_predicate', 'other_object')})
      or (constraint_type in ('conflictWith', 'single', 'oneOf') and {_RIVAL} and {_fits('predicted', 'other_subject', 'predicate', 'object')}))
      then 'alternative_fix'
    when action = 'add' and case constraint_type
      when 'oneOf' then (predicted[1] in (1, subject)) and predicted[2] in (2, predicate) and {_PAR('P2305', 'd.value = predicted[3]')}
      when 'type' then predicted[1] in (1, subject) and predicted[2] = 106 and {_PAR('P2308', 'd.value = predicted[3]')}
      when 'valueType' then predicted[1] in (3, object) and predicted[2] = 106 and {_PAR('P2308', 'd.value = predicted[3]')}
      when 'itemRequiresStatement' then predicted[1] in (1, subject) and {_PAR('P2306', 'd.value = predicted[2]')}
      when 'valueRequiresStatement' then predicted[1] in (3, object) and {_PAR('P2306', 'd.value = predicted[2]')}
      when 'inverse' then predicted[1] in (3, object) and predicted[3] in (1, subject) and {_PAR('P1696', 'd.value = predicted[2]')}
      else false end then 'alternative_fix'
    else 'no_fix' end outcome
  from hits join v r using (violation_id, constraint_type))"""
_KINDS = ("exact", "alternative_fix", "missing_prediction", "no_fix")
_ROLE = lambda c: "case {0} when 1 then subject when 2 then predicate when 3 then object when 4 then other_subject when 5 then other_predicate when 6 then other_object else {0} end".format(c)

_EVALUATED = evaluated({0: None, 1: DELETE_FOCUS, 2: ADD_MIRROR})
_COLUMNS = """violation_id, constraint_type, idx, add_count, del_count, pre_focus, post_focus, deletes_focus, checkable_pre, satisfied_pre,
  checkable_post, satisfied_post, primary_satisfied, regressions, regressions_denom, improvements, improvements_denom, gold_regressions,
  gold_regressions_denom, pre_fraction, post_fraction, srr, sir, gold_srr, ops, focus_preserved, focus_deleted, non_vacuous_fix,
  vacuous_improvement, safe, non_vacuous_safe"""
_GLOBAL = """count(*) records, avg(post_fraction) gfr, avg(srr) srr, avg(sir) sir, avg(ops) disruption, sum(regressions)::bigint regressions,
  sum(regressions_denom)::bigint regressions_denom, sum(improvements)::bigint improvements, sum(improvements_denom)::bigint improvements_denom,
  avg(primary_satisfied) primary_satisfied_rate, avg(focus_preserved::int) focus_preserved_rate, avg(focus_deleted::int) focus_deleted_rate,
  avg(deletes_focus::int) deletes_focus_rate, avg(non_vacuous_fix::int) non_vacuous_fix_rate, avg(vacuous_improvement::int) vacuous_improvement_rate"""
_CHOICE = f"""ev as (select *, (violation_id * 7 + idx * 5) % 11 / 11 score from {_EVALUATED}),
pick as (
  select a.violation_id, oracle_idx, non_vacuous_idx, selected_idx from (
    select violation_id, idx oracle_idx from ev qualify row_number() over (partition by violation_id
      order by primary_satisfied desc, (regressions = 0) desc, post_fraction desc, ops, srr, score desc, idx) = 1) a
  join (select violation_id, idx selected_idx from ev qualify row_number() over (partition by violation_id order by score desc, idx) = 1) b using (violation_id)
  left join (select violation_id, idx non_vacuous_idx from ev where non_vacuous_safe qualify row_number() over (partition by violation_id
      order by post_fraction desc, ops, srr, score desc, idx) = 1) c using (violation_id))"""
_MEANS = ("primary_satisfied", "post_fraction", "ops", "safe", "non_vacuous_safe", "focus_preserved")
_SCORES = """slots as (select violation_id, slot, id, (violation_id * 31 + slot * 17 + id * 7) % 1000 / 1000 score
  from v, range(6) t(slot), unnest([0, 1, 2, 3, subject, predicate, object, 109]) u(id)),
top as (select *, row_number() over (partition by violation_id, slot order by score desc, id) "rank" from slots
  qualify row_number() over (partition by violation_id, slot order by score desc, id) <= 5)"""
_FACTOR_SCORES = f"""{labels()}, fs as (
  select violation_id, split, constraint_type, constraint_id, is_primary, family, 'pre' state, checkable_pre checkable, satisfied_pre label,
    (violation_id * 13 + constraint_id * 29) % 997 / 997 score from f where supported
  union all select violation_id, split, constraint_type, constraint_id, is_primary, family, 'post', checkable_post, satisfied_post,
    (violation_id * 13 + constraint_id * 29 + 1) % 997 / 997 from f where supported)"""
_CLASS = """count(*) support, count(*) filter (where label = 1) / count(*) positive_rate,
  count(*) filter (where (label = 1) = (score >= 0.5)) / count(*) accuracy,
  coalesce(count(*) filter (where label = 1 and score >= 0.5) / nullif(count(*) filter (where score >= 0.5), 0), 0) "precision",
  coalesce(count(*) filter (where label = 1 and score >= 0.5) / nullif(count(*) filter (where label = 1), 0), 0) recall,
  coalesce(2 * count(*) filter (where label = 1 and score >= 0.5) / nullif(count(*) filter (where label = 1) + count(*) filter (where score >= 0.5), 0), 0) f1"""
_DENSITY = """case when n <= 0 then '0' when n = 1 then '1' when n <= 4 then '2_4' when n <= 16 then '5_16' when n <= 64 then '17_64' else '65_plus' end"""
_VARIANTS = f"""{RECORDS}, g as (select violation_id, constraint_type, {_GOLD} from v),
pv as (select t.variant, g.*, {', '.join(f"case when variant <> 'normal' and violation_id % 3 = 0 then case variant when 'none' then {x} else 0 end when violation_id % 5 = 0 and variant = 'normal' then {x} when variant <> 'normal' and violation_id % 3 <> 0 and violation_id % 5 = 0 then {x} else {s} end p_{s}" for x, s in zip((0, 0, 0, 1, 2, 3), _SLOTS, strict=True))}
  from g, (values ('normal'), ('none'), ('primary')) t(variant)),
va as (select variant, violation_id, constraint_type, a action,
  case when a = 'add' and least(p_add_s, p_add_p, p_add_o) <> 0 then [p_add_s, p_add_p, p_add_o]
    when a = 'del' and least(p_del_s, p_del_p, p_del_o) <> 0 then [p_del_s, p_del_p, p_del_o] end predicted,
  case when a = 'add' and least(add_s, add_p, add_o) <> 0 then [add_s, add_p, add_o] when a = 'del' and least(del_s, del_p, del_o) <> 0 then [del_s, del_p, del_o] end gold
  from pv, (values ('add'), ('del')) t(a))"""
_CHANGED = " + ".join(f"(a.p_{s} <> b.p_{s})::int" for s in _SLOTS)

_GRAPH = f"""{RECORDS},
tr as (
  select violation_id, row_number() over (partition by violation_id order by src, ord) - 1 ord, case s when 0 then 8 else s end s,
    case p when 0 then 8 else p end p, case t.o when 0 then 8 else t.o end as o from (
    select violation_id, 0 src, 0 ord, subject s, predicate p, object as o from v
    union all select violation_id, 1, 0, other_subject, other_predicate, other_object from v where other_predicate <> 0
    union all select violation_id, 2, ord, subject, p, f.v from sf f join v using (violation_id)
    union all select violation_id, 3, ord, object, p, f.v from of f join v using (violation_id)
    union all select violation_id, 4, ord, case when other_subject = subject then other_object else other_subject end, p, f.v
      from xf f join v using (violation_id) where (other_subject = subject and other_object <> 0) or (other_object = object and other_subject <> 0)) t)"""
_WIRED = f"""{_GRAPH},
wf as (
  select violation_id, e.constraint_id, e.constraint_id = r.constraint_id is_primary, property, family, subject, object, other_subject, other_predicate
  from cl join entry e using (constraint_id) join v r using (violation_id) where supported),
obs as (
  select violation_id, constraint_id, property p from wf
  union select violation_id, constraint_id, value from wf join def using (constraint_id) where value between 100 and 999 and (wf.family = 'conflictWith'
    or (parameter = 'P1696' and wf.family in ('inverse', 'symmetric')) or (parameter = 'P2306' and wf.family in ('itemRequiresStatement', 'valueRequiresStatement'))
    or (parameter = 'P2309' and wf.family in ('type', 'valueType')))
  union select violation_id, constraint_id, other_predicate from wf where family = 'conflictWith' and other_predicate <> 0
  union select violation_id, constraint_id, p from wf, (values (106), (110)) t(p) where family in ('type', 'valueType')
    and constraint_id not in (select constraint_id from def where parameter = 'P2309')),
wi as (
  select violation_id, constraint_id, is_primary, 4 "type", tr.ord target, tr.ord from wf join obs using (violation_id, constraint_id) join tr using (violation_id, p)
  where case when family in ('single', 'conflictWith', 'itemRequiresStatement') then s = subject
    when family in ('valueRequiresStatement', 'valueType') then s = object when family = 'distinct' then s in (subject, other_subject) else true end
  union all select violation_id, constraint_id, is_primary, x, case x when 5 then s else tr.o end, tr.ord
  from wf join tr using (violation_id), (values (5), (6)) t(x) where tr.p = property)"""
_NAMES = ("constraint_id", "subject", "predicate", "object", "other_subject", "other_predicate", "other_object", *_EDIT)
_TOKENS = f"""{RECORDS},
tk as (
  {' union all '.join(f"select violation_id, '{c}' field, -1 pos, {c} token from v" for c in _NAMES)}
  {' '.join(f"union all select violation_id, '{r}_{n}', row_number() over (partition by violation_id order by ord), {c} from {t}" for t, r in (('sf', 'subject'), ('of', 'object'), ('xf', 'other_entity')) for n, c in (('predicates', 'p'), ('objects', 'v')))}
  union all select violation_id, 'local_constraint_ids', row_number() over (partition by violation_id order by constraint_id), constraint_id from cl
  union all select violation_id, 'local_constraint_ids_focus', row_number() over (partition by violation_id order by constraint_id), constraint_id from cf),
nz as (select * from tk where token <> 0),
ko as (select token, token <= 8 or token in (select token from nz join v using (violation_id) where split = 'train' group by 1 having count(*) >= 5) kept
  from (select distinct token from nz)),
vi as (select token, token new_id from ko where kept and token <= 8
  union all select token, 8 + row_number() over (order by md5('42-' || token), token) from ko where kept and token > 8)"""
_ITEMS = sorted(TYPE_ITEMS)
_PARTS = f"""pd as (
  select p_partkey, 'c' || p_partkey constraint_id, 'P' || (100 + p_partkey % 37) property,
    [{', '.join(f"'{i}'" for i in _ITEMS)}, 'Q1', ''][p_partkey % 12 + 1] type_item,
    'P' || p_size || case when p_partkey % 3 = 0 then ' ^P7' else '' end "P2306", case when p_partkey % 4 = 0 then 'Q' || p_partkey end "P2305" from part),
pp as (
  select constraint_id, 'P2306' parameter, 0 "position", 'P' || p_size "value" from pd join part using (p_partkey)
  union all select constraint_id, 'P2306', 1, 'P7' from pd where p_partkey % 3 = 0
  union all select constraint_id, 'P2305', 0, "P2305" from pd where p_partkey % 4 = 0),
fa as (select constraint_id, property, case type_item {' '.join(f"when '{i}' then '{TYPE_ITEMS[i]}'" for i in _ITEMS)} else 'unsupported:' || type_item end family,
  type_item in ({', '.join(f"'{i}'" for i in _ITEMS)}) supported,
  case when type_item = '' then -1 else (select count(distinct type_item) from pd b where b.type_item < pd.type_item and b.type_item <> '') end type_index from pd),
rb as (select fa.*, coalesce(n, 0) parameters from fa left join (select constraint_id, count(*) n from pp group by 1) using (constraint_id))"""

ORACLES: dict[str, str] = {
    "graph_edges": f'with {_GRAPH} select violation_id, 1::bigint "type", s, p, o, ord from tr',
    "graph_nodes": f"""with {_GRAPH} select violation_id, 'entity' kind, id, min(ord) ord
from (select violation_id, s id, ord from tr union all select violation_id, o, ord from tr) group by violation_id, id
union all select violation_id, 'predicate', p, ord from tr""",
    "role_masks": f"""with {_GRAPH}, r as (select violation_id, subject id, 1 bit from v union all select violation_id, predicate, 2 from v union all select violation_id, object, 4 from v)
select violation_id, id, sum(bit)::bigint mask from r where (violation_id, id) in (select (violation_id, s) from tr union select (violation_id, p) from tr union select (violation_id, o) from tr) group by 1, 2""",
    "factor_wiring": f'with {_WIRED} select violation_id, constraint_id, is_primary, "type"::bigint "type", target from wi',
    "parameter_edges": f"""with {RECORDS} select violation_id, constraint_id, 3::bigint "type", value target from v join def using (constraint_id) where parameter is not null and family is not null""",
    "wiring_diagnostics": f"""with {_WIRED} select family, count(*) factors, count(*) filter (where coalesce(n, 0) = 0) unwired, avg(coalesce(n, 0)) mean_edges,
  max(coalesce(n, 0)) most_edges, count(*) filter (where t) primary_on_focus
from wf left join (select violation_id, constraint_id, count(*) n, bool_or(ord = 0 and is_primary) t from wi group by 1, 2) using (violation_id, constraint_id) group by 1""",
    "pressure_overlap": f"""with {_WIRED} select violation_id, sum(e)::bigint edges, count(*) targets, avg(n) mean_factors, max(n) most_factors, count(*) filter (where n > 1) shared
from (select violation_id, "type", target, count(distinct constraint_id) n, count(*) e from wi group by all) group by 1""",
    "pressure_masks": f"""with {_WIRED} select 'normal' variant, count(*) edges, count(distinct violation_id) records from wi
union all select case when is_primary then 'primary' else 'secondary' end, count(*), count(distinct violation_id) from wi group by 1""",
    "target_vocab": f"""with {RECORDS} select split, 'entity' kind, unnest([add_subject, add_object, del_subject, del_object, 0]) id from v
union select split, 'predicate', unnest([add_predicate, del_predicate, 0]) from v""",
    "definition_pairs": f'with {_PARTS} select constraint_id, parameter, "position"::bigint "position", "value" from pp',
    "registry_build": f"with {_PARTS} select * from rb",
    "registry_validation": f"""with {_PARTS} select count(*) entries, count(distinct constraint_id) ids, 0::bigint bad_property, 0::bigint inconsistent,
  count(*) filter (where parameters = 0) without_parameters, count(*) filter (where type_index < 0) blank_type, max(type_index) + 1 types from rb""",
    "registry_family_counts": f"with {_PARTS} select family, supported, count(*) entries from rb group by all",
    "property_index": f"with {_PARTS} select property, count(*) constraints, string_agg(constraint_id, ',' order by constraint_id) ids from rb group by 1",
    "token_frequency": f"with {_TOKENS} select token, count(*) n from nz join v using (violation_id) where split = 'train' group by 1",
    "min_occurrence": f"with {_TOKENS} select token, kept from ko",
    "vocab_reindex": f"with {_TOKENS} select token, new_id from vi",
    "min_occurrence_remap": f"""with {_TOKENS} select violation_id, field, count(*) n, md5(string_agg(coalesce(new_id, 8)::varchar, ',' order by pos)) values_md5
from nz left join vi using (token) group by 1, 2""",
    "stratified_split": f"""with {RECORDS}, r as (select violation_id, constraint_type, count(*) over (partition by constraint_type) n,
  row_number() over (partition by constraint_type order by md5('42-' || violation_id), violation_id) * 100 k from v)
select violation_id, constraint_type, case when k <= n * 70 then 'train' when k <= n * 85 then 'val' else 'test' end part from r""",
    "parse_corrections": """select o_orderkey violation_id, 'c' || (o_orderkey % 9) constraint_id, 'Q' || o_orderkey subject, 'P101' predicate, 'Q9' || o_custkey object,
  case when o_orderkey % 2 = 0 then 'Q' || o_orderkey else '' end add_s, case when o_orderkey % 2 = 0 then 'P101' else '' end add_p,
  'Q' || o_orderkey del_s, 'P101' del_p, case when o_orderkey % 2 = 0 then '"' || o_orderstatus || '"' else '' end add_text, 2::bigint n_descriptions from orders""",
    "page_label_facts": """select page_id, split_part(coalesce(text, ''), ' ', 1) "label", contains(coalesce(html, ''), split_part(coalesce(text, ''), ' ', 1)) mentioned
from pages join conversations on page_id = conv_id and turn = 0""",
    "uri_normalise": """select page_id, case page_id % 4 when 0 then 'Q' || (page_id + 1) when 1 then 'P' || (page_id + 1) when 2 then 'http://www.wikidata.org/prop/statement/P' || (page_id + 1)
    else url end token, case when page_id % 4 = 1 then 'P' || (page_id + 1) end property,
  case page_id % 4 when 0 then 'Q' || (page_id + 1) when 1 then 'P' || (page_id + 1) when 2 then 'P' || (page_id + 1) end entity,
  case page_id % 4 when 0 then 'Q' || (page_id + 1) when 1 then 'P' || (page_id + 1) when 2 then 'P' || (page_id + 1) || ' (statement)' end lookup,
  case when page_id % 4 < 3 then 'uri' else 'literal' end kind from pages""",
    "cache_merge": """with w as (select distinct 'literal' kind, lang || '-' || source "key", doc_id id from documents),
c as (select lang || '-' || source "key", doc_id id, max(md5(text)) text from documents where doc_id in (select doc_id from labels) group by 1, 2)
select kind, w."key", w.id, coalesce(c.text, b.text) text, case when c.text is not null then 'hit' when b.text is not null then 'copied' else 'pending' end state
from w left join c on c."key" = w."key" and c.id = w.id left join (select "key", min(text) text from c group by 1) b on b."key" = w."key" """,
    "event_props": """select event_type, count(*) events, count(k) with_k, coalesce(sum(k), 0)::bigint sum_k
from (select event_type, try_cast(json_extract_string(props, '$.k') as bigint) k from events) group by 1""",
    "slot_topk": f"with {RECORDS}, {_SCORES} select violation_id, slot, id, score, \"rank\" from top",
    "triple_topk": f"""with {RECORDS}, {_SCORES}, grid as (
  select a.violation_id, act action, a.id s, b.id p, c.id as o, a.score + b.score + c.score score, row_number() over (
    partition by a.violation_id, act order by a.score + b.score + c.score desc, a."rank", b."rank", c."rank") "rank"
  from (values ('add', 0), ('del', 3)) t(act, k) join top a on a.slot = k join top b on b.violation_id = a.violation_id and b.slot = k + 1
    join top c on c.violation_id = a.violation_id and c.slot = k + 2)
select * from grid where "rank" <= 20""",
    "candidate_metrics": f"select {_COLUMNS} from {_EVALUATED}",
    "oracle_choice": f"with {_CHOICE} select * from pick",
    "oracle_report": f"""with {_CHOICE}, sz as (select violation_id, {_DENSITY} density from (with {RECORDS} select violation_id, count(*) n from cl group by 1)),
r as (select p.*, density, s.constraint_type, {', '.join(f"{x}.{c} {n}_{c}" for x, n in (('s', 'selected'), ('o', 'oracle')) for c in (*_MEANS, 'regressions', 'regressions_denom', 'improvements', 'improvements_denom'))}
  from pick p join ev s on s.violation_id = p.violation_id and s.idx = selected_idx join ev o on o.violation_id = p.violation_id and o.idx = oracle_idx
    join sz on sz.violation_id = p.violation_id)
select coalesce(density, 'all') density, coalesce(constraint_type, 'all') constraint_type, count(*) records,
  {', '.join(f"avg({n}_{c}::double) {n}_{c}" for n in ('selected', 'oracle') for c in _MEANS)},
  {', '.join(f"coalesce(sum({n}_{c}) / nullif(sum({n}_{c}_denom), 0), 0) {n}_pooled_{c}" for n in ('selected', 'oracle') for c in ('regressions', 'improvements'))},
  avg((selected_idx = oracle_idx)::int) agreement, avg((non_vacuous_idx is not null)::int) has_non_vacuous
from r group by grouping sets ((), (density), (constraint_type))""",
    "deletion_degeneracy": f"""with g as (with {RECORDS} select violation_id, {_GOLD} from v), ev as (select * from {evaluated({0: None, 1: DELETE_FOCUS})})
select coalesce(a.constraint_type, 'all') constraint_type, count(*) records, avg(((add_s, add_p, add_o, del_s, del_p, del_o) = (0, 0, 0, 1, 2, 3))::int) exact,
  avg((a.primary_satisfied = b.primary_satisfied and a.regressions = b.regressions and a.improvements = b.improvements and a.ops = b.ops
    and abs(a.post_fraction - b.post_fraction) <= 1e-9 and abs(a.srr - b.srr) <= 1e-9 and abs(a.sir - b.sir) <= 1e-9)::int) equivalent,
  avg(a.focus_deleted::int) focus_deleted, avg(a.vacuous_improvement::int) vacuous_improvement
from ev a join ev b on a.violation_id = b.violation_id and a.idx = 0 and b.idx = 1 join g on g.violation_id = a.violation_id group by rollup (a.constraint_type)""",
    "global_metrics": f"select coalesce(constraint_type, 'all') constraint_type, {_GLOBAL} from {evaluated({0: None})} t group by rollup (constraint_type)",
    "per_constraint_report": f"""with m as (with {_OUTCOME.replace(f"case when violation_id % 5 = 0 then", "case when true then")}
  select a.*, primary_fix_rate from (select constraint_type, "precision", recall, f1 from ({_PRF} (select constraint_type, {_SUMS} from hits group by 1))) a
  join (select constraint_type, count(*) filter (where outcome in ('exact', 'alternative_fix')) / count(*) primary_fix_rate from fixed group by 1) using (constraint_type)),
w as (select constraint_type, {_GLOBAL} from {evaluated({1: DELETE_FOCUS})} t group by 1)
select m.*, records, gfr, srr, sir, disruption, primary_fix_rate + (1 - srr) + f1 - 0.1 * disruption selection,
  primary_fix_rate + (1 - srr) + f1 - 0.1 * ln(1 + disruption) selection_log, '' missing from m join w using (constraint_type)""",
    "semantic_metrics": f"with {_FACTOR_SCORES} select state, family, {_CLASS} from fs where checkable group by all",
    "auroc_auprc": f"""with {_FACTOR_SCORES}, ok as (select * from fs where checkable),
t as (select state, family, score, count(*) filter (where label = 1) p, count(*) n from ok group by all),
k as (select *, sum(p) over w tp, sum(n) over w seen from t window w as (partition by state, family order by score desc)),
r as (select state, family, label, rank() over (partition by state, family order by score) + (count(*) over (partition by state, family, score) - 1) / 2 rk from ok),
a as (select state, family, sum(label) p, count(*) - sum(label) q, sum(rk) filter (where label = 1) s from r group by all)
select a.state, a.family, case when p > 0 and q > 0 then (s - p * (p + 1) / 2) / (p * q) end auroc,
  case when p > 0 and q > 0 then (select sum(k.p * tp / seen) from k where k.state = a.state and k.family = a.family) / p end auprc from a""",
    "ece": f"""with {_FACTOR_SCORES}, b as (select state, family, least(floor(score * 10), 9) bin, count(*) n, avg(((score >= 0.5) = (label = 1))::int) acc, avg(score) conf
  from fs where checkable group by all)
select state, family, sum(n * abs(acc - conf)) / sum(n) ece, sum(n)::bigint support from b group by all""",
    "train_exposure": f"with {RECORDS} select cl.constraint_id, count(*) exposure from cl join v r using (violation_id) where r.split = 'train' group by 1",
    "transfer_slices": f"""with {_FACTOR_SCORES}, e as (select cl.constraint_id, count(*) n from cl join v using (violation_id) where split = 'train' group by 1),
x as (select fs.*, case when n is null then 'unseen' when n <= 10 then 'low_1_10' when n <= 100 then 'medium_11_100' else 'high_gt100' end exposure,
  case when is_primary then 'primary' else 'secondary' end "role" from fs left join e using (constraint_id) where split = 'test')
select state, exposure, "role", family, {_CLASS} from x where checkable group by all""",
    "density_slices": f"""with {_FACTOR_SCORES}, d as (select violation_id, {_DENSITY} density from (select violation_id, count(*) n from cl group by 1))
select state, density, family, constraint_type, {_CLASS} from fs join d using (violation_id) where checkable group by all""",
    "variant_deltas": f"""with {_VARIANTS}, m as ({_PRF} (select variant, constraint_type, count(*) filter (where coalesce(predicted = gold, false)) tp,
  count(*) filter (where predicted is not null and not coalesce(predicted = gold, false)) fp, count(*) filter (where gold is not null and not coalesce(predicted = gold, false)) fn
  from va group by all))
select a.variant, a.constraint_type, a."precision" - b."precision" delta_precision, a.recall - b.recall delta_recall, a.f1 - b.f1 delta_f1
from m a join m b on a.constraint_type = b.constraint_type and b.variant = 'normal' where a.variant <> 'normal'""",
    "prediction_change": f"""with {_VARIANTS} select variant, count(*) records, avg((c > 0)::int) changed_share, avg(c) / 6 slot_share, avg(c) mean_changed
from (select a.variant, {_CHANGED} c from pv a join pv b using (violation_id) where b.variant = 'normal' and a.variant <> 'normal') group by 1""",
    "slot_accuracy": f"""with {_PREDICTED} select g.constraint_type, count(*) records, {', '.join(f"avg((pr.{s} = g.{s})::int) acc_{s}" for s in _SLOTS)},
  avg(({' and '.join(f"pr.{s} = g.{s}" for s in _SLOTS)})::int) acc_all from g join pr using (violation_id) group by 1""",
    "local_closure": _closure("cl"),
    "focus_closure": _closure("cf"),
    "attached_hist": f"""with {_SIZES} select split, n attached, count(*) records from sizes group by 1, 2
union all select 'all', n, count(*) from sizes group by n""",
    "attached_summary": f"""with {_SIZES} select split, min(n) least, quantile_disc(n, 0.5) median, avg(n) mean, quantile_disc(n, 0.95) p95, max(n) most
from sizes group by 1""",
    "stratified_sample": f"with {_SIZES} select violation_id, split, constraint_type, bin from sampled",
    "sampling_report": f"""with {_SIZES} select a.*, coalesce(b.sampled, 0) sampled, coalesce(b.sampled, 0) / source realised from (
  select split, constraint_type, bin, count(*) source from sizes group by all) a
  left join (select split, constraint_type, bin, count(*) sampled from sampled group by all) b using (split, constraint_type, bin)""",
    "support_by_split": f"""with {labels()}, r as (
  select split, violation_id, count(*) n, count(*) filter (where supported) good, count(*) filter (where in_registry and not supported) bad,
    count(*) filter (where not in_registry) gone, bool_or(is_primary and supported) p_good, bool_or(is_primary and not in_registry) p_gone,
    bool_or(is_primary and supported and family <> constraint_type) p_other from f group by all)
select *, supported / factors supported_rate, with_supported / records with_supported_rate from (
  select split, count(*) records, sum(n)::bigint factors, sum(good)::bigint supported, sum(bad)::bigint unsupported, sum(gone)::bigint missing,
    count(*) filter (where good > 0) with_supported, count(*) filter (where good = 0) without_supported,
    count(*) filter (where good = 0 and bad > 0) only_unsupported, count(*) filter (where p_good) primary_supported,
    count(*) filter (where p_gone) primary_missing, count(*) filter (where p_other) primary_family_mismatch from r group by 1)""",
    "family_occurrences": f"""with {labels()} select family, supported, count(*) occurrences, count(distinct violation_id) records,
  count(*) / (select count(*) from f) share from f where in_registry group by all""",
    "missing_registry_ids": f"""with {labels()} select constraint_id, count(*) occurrences, count(*) filter (where is_primary) as_primary
from f where not in_registry group by 1""",
    "support_histogram": f"""with {labels()}, r as (select violation_id, count(*) total, count(*) filter (where supported) supported,
  count(*) filter (where in_registry and not supported) unsupported from f group by 1)
select 'total' kind, total factors, count(*) records from r group by 2 union all select 'supported', supported, count(*) from r group by 2
union all select 'unsupported', unsupported, count(*) from r group by 2""",
    "baseline_delete_focus": f"with {RECORDS} select violation_id, {_FOCUS} from v",
    "baseline_add_mirror": f"""with {RECORDS} select violation_id, case constraint_type when 'inverse' then 3 else 0 end::bigint add_s,
  case constraint_type when 'inverse' then 109 else 0 end::bigint add_p, case constraint_type when 'inverse' then 1 else 0 end::bigint add_o,
  0::bigint del_s, 0::bigint del_p, 0::bigint del_o from v""",
    "baseline_majority_definition": _majority("constraint_id"),
    "baseline_majority_family": _majority("constraint_type"),
    "fidelity_micro": f"""with {_PREDICTED} {_PRF} (select case when grouping(constraint_type) = 1 then 'all' else constraint_type end constraint_type,
  case when grouping(action) = 1 then 'all' else action end action, {_SUMS} from hits group by cube (constraint_type, action))""",
    "fidelity_macro": f"""with {_PREDICTED}, per as ({_PRF} (select constraint_type, action, {_SUMS} from hits group by all)),
micro as ({_PRF} (select constraint_type, {_SUMS} from hits group by all))
select constraint_type, avg("precision") "precision", avg(recall) recall, avg(f1) f1 from per where tp + fp + fn > 0 group by 1
union all select 'all', avg("precision"), avg(recall), avg(f1) from micro where tp + fp + fn > 0""",
    "repair_outcomes": f"with {_OUTCOME} select violation_id, action, outcome from fixed",
    "repair_rates": f"""with {_OUTCOME} select *, {', '.join(f"{k} / total {k}_rate" for k in _KINDS)} from (
  select coalesce(constraint_type, 'all') constraint_type, coalesce(action, 'all') action, count(*) total,
    {', '.join(f"count(*) filter (where outcome = '{k}') {k}" for k in _KINDS)} from fixed
  group by grouping sets ((), (action), (constraint_type, action)))""",
    "primary_fix": f"""with {_OUTCOME} select *, fixed / total primary_fix_rate from (
  select constraint_type, count(*) total, count(*) filter (where outcome in ('exact', 'alternative_fix')) fixed from fixed group by 1)""",
    "policy_labels": f"""with {RECORDS}, e as (select constraint_type, subject, predicate, object, other_subject, other_predicate, other_object,
  {', '.join(f"{_ROLE(c)} {s}" for c, s in zip(_EDIT, _SLOTS, strict=True))} from v),
l as (select constraint_type, case when least(add_s, add_p, add_o) = 0 and least(del_s, del_p, del_o) = 0 then 'NOOP'
  when del_s <> 0 and (del_s, del_p, del_o) = (subject, predicate, object) then 'DELETE_FOCUS'
  when del_s <> 0 and other_predicate <> 0 and (del_s, del_p, del_o) = (other_subject, other_predicate, other_object) then 'DELETE_CONFLICT'
  when add_s <> 0 and add_p = predicate then 'ADD_TO_FOCUS_PREDICATE' when add_s <> 0 and add_s = subject then 'CHANGE_PREDICATE'
  else 'OTHER' end "policy" from e)
select constraint_type, "policy", count(*) records from l group by all""",
    "coverage_local": f"with {labels()} {_COVERAGE}",
    "coverage_focus": f"with {labels(scope='focus')} {_COVERAGE}",
    "coverage_open_world": f"with {labels(closed=False)} {_COVERAGE}",
    "factor_labels_exploded": f"with {labels()} select * from f",
    "factor_labels_arrays": f"""with {labels()}
select violation_id, {_told('constraint_id')} factor_constraint_ids, {_told('type_index')} factor_types,
  {', '.join(f"{_told(s)} factor_{s}" for s in ('checkable_pre', 'satisfied_pre', 'checkable_post', 'satisfied_post'))},
  count(*) filter (where checkable_pre) num_checkable_pre, count(*) filter (where checkable_post) num_checkable_post,
  count(*) filter (where checkable_pre) / count(*) coverage_pre, count(*) filter (where checkable_post) / count(*) coverage_post
from f where supported or is_primary group by 1""",
    "filter_stats": f"""with {labels()}
select *, (raw - retained) / raw filtered_rate from (
  select count(*) raw, count(*) filter (where supported or is_primary) retained, count(*) filter (where in_registry and not supported) unsupported,
    count(*) filter (where in_registry and not supported and not is_primary) unsupported_filtered,
    count(*) filter (where in_registry and not supported and is_primary) unsupported_primary_retained,
    count(*) filter (where not in_registry) missing, count(*) filter (where not in_registry and not is_primary) missing_filtered,
    count(*) filter (where not in_registry and is_primary) missing_primary_retained, count(*) filter (where supported) supported_retained
  from f)""",
    "filter_families": f"""with {labels()}
select family, count(*) unsupported, count(*) filter (where not is_primary) filtered from f where in_registry and not supported group by 1""",
    "label_invariants": f"""with {labels()}
select count(distinct violation_id) records, 0::bigint "unequal", 0::bigint empty, count(*) factors, 0::bigint satisfied_unchecked_pre,
  0::bigint satisfied_unchecked_post, 0::bigint type_out_of_range, 0::bigint without_primary from f""",
}
