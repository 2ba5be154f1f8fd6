"""DuckDB SQL of the queries of ``reports``."""

from __future__ import annotations

import re

from graphmend.operators.registry import TYPE_ITEMS
from graphmend.operators.reports import DELTAS, FIGURES

from . import oracles as base
from .oracle_base import _EDIT, RECORDS, evaluated, labels

_SLOTS = dict(zip(base._EDIT, (0, 0, 0, 1, 2, 3), strict=True))


def _edit_of(variant: str) -> str:
    """The six edit columns of a prediction variant; the historical ones come first, under other names."""
    gold = re.sub(r"\bend (add|del)_", r"end g_\1_", _EDIT)
    third = "false" if variant == "normal" else "violation_id % 3 = 0"
    focus = f"(case when {third} then {str(variant == 'none').lower()} else violation_id % 5 = 0 end)"
    nothing = f"({third} and {str(variant == 'primary').lower()})"
    return gold + "".join(f", case when {nothing} then 0 when {focus} then {x} else g_{c} end {c}" for c, x in _SLOTS.items())


_DENSITY = f"(select violation_id, {base._DENSITY} density from (with {RECORDS} select violation_id, count(*) n from cl group by 1))"
_FIXED = base._OUTCOME.split("fixed as (")[1].replace(
    "select violation_id, r.constraint_type, action, case", "select variant, violation_id, r.constraint_type, action, predicted, gold, hit, case"
)
_VARIANT_METRICS = f"""select a.*, support, gfr, srr, sir, disruption_add, disruption_del, disruption from (
  with {base._VARIANTS}, hits as (select *, coalesce(predicted = gold, false) hit from va), fixed as ({_FIXED},
  h as (select variant, coalesce(density, 'all') density, {base._SUMS}, count(*) filter (where outcome in ('exact', 'alternative_fix')) / count(*) primary_fix_rate
    from fixed join {_DENSITY} using (violation_id) group by grouping sets ((variant), (variant, density)))
  select variant, density, "precision", recall, f1, primary_fix_rate from ({base._PRF} h)) a
join (select ['normal', 'none', 'primary'][idx + 1] variant, coalesce(density, 'all') density, count(*) support, avg(post_fraction) gfr, avg(srr) srr, avg(sir) sir,
    avg(add_count) disruption_add, avg(del_count) disruption_del, avg(ops) disruption
  from {evaluated({i: _edit_of(v) for i, v in enumerate(("normal", "none", "primary"))})} join {_DENSITY} using (violation_id)
  group by grouping sets ((idx), (idx, density))) using (variant, density)"""

_CHOSEN = f"""{base._CHOICE}, ch as (
  select p.*, s.constraint_type, (select count(*) from ev e where e.violation_id = p.violation_id) candidates,
    {', '.join(f"{x}.{c} {n}_{c}" for x, n in (('s', 'selected'), ('o', 'oracle')) for c in FIGURES)}
  from pick p join ev s on s.violation_id = p.violation_id and s.idx = selected_idx join ev o on o.violation_id = p.violation_id and o.idx = oracle_idx)"""

_POLICY = """case when least(a_s, a_p, a_o) = 0 and least(d_s, d_p, d_o) = 0 then 'NOOP'
  when least(d_s, d_p, d_o) <> 0 and (d_s, d_p, d_o) = (subject, predicate, object) then 'DELETE_FOCUS'
  when least(d_s, d_p, d_o) <> 0 and other_predicate <> 0 and (d_s, d_p, d_o) = (other_subject, other_predicate, other_object) then 'DELETE_CONFLICT'
  when least(a_s, a_p, a_o) <> 0 and a_p = predicate then 'ADD_TO_FOCUS_PREDICATE' when least(a_s, a_p, a_o) <> 0 and a_s = subject then 'CHANGE_PREDICATE'
  else 'OTHER' end"""
_THREE = f"""{RECORDS}, c3 as (
  select violation_id, 0 idx, add_subject a_s, add_predicate a_p, add_object a_o, del_subject d_s, del_predicate d_p, del_object d_o from v
  union all select violation_id, 1, 0, 0, 0, 1, 2, 3 from v
  union all select violation_id, 2, case k when 2 then 3 else 0 end, case k when 2 then 109 else 0 end, case k when 2 then 1 else 0 end, 0, 0, 0 from v),
r3 as (select violation_id, idx, subject, predicate, object, other_subject, other_predicate, other_object,
  {', '.join(f"{base._ROLE(c)} {c}" for c in ('a_s', 'a_p', 'a_o', 'd_s', 'd_p', 'd_o'))} from c3 join v using (violation_id)),
p3 as (select violation_id, idx, {_POLICY} "policy" from r3),
m3 as (select p3.*, w."policy" wanted, w."policy" = 'OTHER' or p3."policy" = w."policy" matches from p3 join p3 w on w.violation_id = p3.violation_id and w.idx = 0)"""

_SEMANTIC = f"""select a.*, auroc, auprc, ece, case when positive_rate < 0.05 or positive_rate > 0.95 then 'true' else 'false' end imbalance
from ({base.ORACLES['semantic_metrics']}) a join ({base.ORACLES['auroc_auprc']}) b using (state, family)
join (select state, family, ece from ({base.ORACLES['ece']})) c using (state, family)"""

_ITEMS = ", ".join(f"'{i}'" for i in TYPE_ITEMS)

_E, _D = "http://www.wikidata.org/entity/", "http://www.wikidata.org/prop/direct/"
_FACT = lambda i: f"'P1=Q' || o_orderkey || ';P1=' || {i}"
_LABEL = "http://wikiba.se/history/ontology#pageContainsLabel"
_CORPUS = f"""with b as (
  select *, 'Q' || o_orderkey s, 'Q8' || o_orderkey r, o_orderkey % 3 = 0 item, o_orderkey % 4 = 0 other, 'Q9' || o_custkey thing,
    '"' || o_orderstatus || '"' txt, '^^<http://www.w3.org/2001/XMLSchema#string' kind, 'c' || (o_orderkey % 11) c
  from orders where o_orderkey % 11 < 9),
e as (select *, case when item then thing else txt || kind end obj, case when other then s else '' end oo from b),
f as (select *, case when item then {_FACT('thing')} else 'status=Ok' end of, {_FACT('s')} sf, case when other then {_FACT('r')} else '' end xf,
  not item and contains(o_orderpriority, o_orderstatus) l1, not item and other l2 from e),
n as (select *, array_to_string(list_filter([of, case when l1 then '{_LABEL}=' || s end, case when l2 then '{_LABEL}=' || r end], lambda x: x is not null), ';') o_facts from f)
select o_orderkey violation_id, c constraint_id, s subject, 'P101' predicate, obj as object, case when other then r else '' end other_subject,
  case when other then 'P102' else '' end other_predicate, oo other_object, case when item then '' else txt end object_text, '' other_object_text,
  case when o_orderkey % 5 <> 0 then '' when other then 'other_subject' else r end add_subject,
  case when o_orderkey % 5 <> 0 then '' when other then 'other_predicate' else 'P102' end add_predicate,
  case when o_orderkey % 5 <> 0 then '' else '"' || o_orderpriority || '"' || kind end add_object,
  'subject' del_subject, 'predicate' del_predicate, 'object' del_object, sf subject_facts, o_facts object_facts, xf other_entity_facts,
  'c0,c1' || case when other then ',c100' else '' end || ',c101,c2,c3,c4,c5,c6,c7,c8' local_constraint_ids,
  'c0,c1' || case when other then ',c100' else '' end || ',c2,c3,c4,c5,c6,c7,c8' local_constraint_ids_focus from n"""

_SPELLED = """select page_id, case page_id % 4 when 0 then 'http://www.wikidata.org/entity/Q' || (page_id + 1) when 1 then '<http://www.wikidata.org/prop/direct/P' || (page_id + 1) || '>'
  when 2 then 'http://www.wikidata.org/prop/statement/P' || (page_id + 1) else url end uri,
  case page_id % 4 when 0 then 'Q' || (page_id + 1) when 1 then 'P' || (page_id + 1) when 2 then 'P' || (page_id + 1) end entity from pages"""

ORACLES: dict[str, str] = {
    "variant_metrics": _VARIANT_METRICS,
    "variant_metric_deltas": f"""with m as ({_VARIANT_METRICS})
select a.variant, a.density, {', '.join(f"a.{c} - b.{c} delta_{c}" for c in DELTAS)} from m a join m b on a.density = b.density and b.variant = 'normal' where a.variant <> 'normal'""",
    "density_summary": f"""with {base._WIRED}, ws as (
  select 'normal' variant, wi.* from wi union all select case when is_primary then 'primary' else 'secondary' end, wi.* from wi),
ov as (select variant, violation_id, count(*) targets, count(*) filter (where n > 1) shared, max(n) most from (
  select variant, violation_id, "type", target, count(distinct constraint_id) n from ws group by all) group by 1, 2),
fc as (select violation_id, count(*) factors from cl join entry using (constraint_id) group by 1)
select t.variant, density, count(*) support, avg(coalesce(factors, 0)) factor_count_mean, avg(coalesce(targets, 0)) target_nodes_mean,
  avg(coalesce(shared, 0)) shared_nodes_mean, max(coalesce(most, 0)) most_factors_max
from {_DENSITY} d cross join (values ('normal'), ('primary'), ('secondary'), ('none')) t(variant) left join fc using (violation_id)
  left join ov on ov.violation_id = d.violation_id and ov.variant = t.variant group by 1, 2""",
    "semantic_summary": f"""select 'base__local' run, 'base' model, * from ({_SEMANTIC})
union all select 'base__focus', 'base', * from ({_SEMANTIC.replace(labels(), labels(scope='focus'))})""",
    "policy_filter": f"""with {_THREE} select * from m3 where matches or violation_id not in (select violation_id from m3 where matches)""",
    "worst_cases": f"""with {_CHOSEN} select * from ch where (oracle_safe and not selected_safe) or (oracle_non_vacuous_safe and not selected_non_vacuous_safe)
  or oracle_post_fraction > selected_post_fraction or oracle_primary_satisfied > selected_primary_satisfied order by violation_id limit 100""",
    "choice_averages": f"""with {_CHOSEN} {' union all '.join(f"select '{n}' choice, count(*) records, {', '.join(f'avg({n}_{c}::double) {c}' for c in FIGURES)} from ch" for n in ('selected', 'oracle'))}""",
    "primary_support": f"""with {labels()}, x as (select constraint_type, coalesce(family, 'missing_registry') family, supported from f where is_primary)
select constraint_type, family, supported, count(*) factors from x group by all union all select constraint_type, 'all', supported, count(*) from x group by all""",
    "registry_missing_items": f"""with {base._PARTS} select type_item, count(*) entries from pd where type_item <> '' and type_item not in ({_ITEMS}) group by 1""",
    "literal_texts": """select distinct '"' || o_orderstatus || '"' "text" from orders where o_orderkey % 3 <> 0""",
    "exposure_counts": f"""with {RECORDS}, e as (select cl.constraint_id, count(*) n from cl join v using (violation_id) where split = 'train' group by 1)
select case when n <= 10 then 'low_1_10' when n <= 100 then 'medium_11_100' else 'high_gt100' end bucket, count(*) constraints from e group by 1""",
    "primary_factor_index": f"""with {labels()} select violation_id, "position" primary_index from f where is_primary""",
    "type_item_frequency": f"""with {base._PARTS}, x as (select type_item, family from pd join rb using (constraint_id))
select type_item, family, count(*) entries from x group by all union all select type_item, 'all', count(*) from x group by 1""",
    "type_families": f"""with {base._PARTS} select case when type_item = '' then null else type_item end qid,
  string_split(lower(p_name), ' ')[1] || array_to_string(list_transform(string_split(lower(p_name), ' ')[2:], lambda x: upper(x[1]) || x[2:]), '') || 'Constraint' family, count(*) entries
from pd join part using (p_partkey) group by all""",
    "parameter_paths": f"""with {RECORDS}, d as (select constraint_id, substring(parameter, 2)::bigint p, value o,
  row_number() over (partition by constraint_id order by substring(parameter, 2)::bigint, value) - 1 ord from def where parameter is not null),
x as (select violation_id, d.* from cl join entry using (constraint_id) join d using (constraint_id))
select violation_id, constraint_id, ord, 2::bigint "type", constraint_id source, p target from x union all select violation_id, constraint_id, ord, 3, p, o from x""",
    "factor_wiring_both": f"""with {base._WIRED} select violation_id, constraint_id, "type"::bigint "type", constraint_id source, target from wi
union all select violation_id, constraint_id, "type" + 3, target, constraint_id from wi""",
    "node_features": f"""with n as ({base.ORACLES['graph_nodes']}), w as ({base.ORACLES['vocab_reindex']})
select violation_id, kind, id, ord, coalesce(new_id, 8) feature from n left join w on token = id""",
    "target_classes": f"""with {base._TOKENS} select violation_id, concat_ws(',', {', '.join(f"case when {c} <= 0 then 0 when {c} in (select token from vi) then {c} else 8 end" for c in base._EDIT)}) y from v""",
    "label_alignment": f"with {RECORDS} select count(*) records, 0::bigint wrong_length, 0::bigint wrong_order from v",
    "baseline_max_ids": f"with {RECORDS} select split, count(*) records, max(greatest({', '.join(base._EDIT)}))::bigint max_id from v group by 1",
    "lost_factor_tokens": f"""with {base._TOKENS.replace('count(*) >= 5', 'count(*) >= 2000')} select constraint_id token, count(*) occurrences from cl where constraint_id not in (select token from ko where kept) group by 1""",
    "registry_cache_ids": f"""with {base._PARTS}, n as (select constraint_id, property "key" from pd union select constraint_id, "value" from pp)
select "key", case when "key" in (select property from pd) then substring("key", 2)::bigint end id, count(*) occurrences from n group by 1, 2""",
    "label_fanout": f"""select s.*, p_name "label" from ({_SPELLED}) s left join part on entity = 'Q' || (p_partkey + 1)""",
    "corpus_build": _CORPUS,
}

#: Patterns of a record as rows (act, n, lists of values; a null list takes any value), and their mass under the slot scores.
_BOTH = lambda r: f"case when {r} <> 0 then [{base._ROLE_MARK[r]}, {r}] else [{base._ROLE_MARK[r]}] end"
_DELS = (
    ("true", "subject", "predicate", "object"), ("other_predicate <> 0", "other_subject", "other_predicate", "other_object"),
    (f"constraint_type = 'distinct' and {base._RIVAL}", "other_subject", "predicate", "object"),
    (f"{base._MIXED} and other_predicate = predicate", "subject", "predicate", "other_object"), (base._MIXED, "subject", "other_predicate", "object"),
    (base._MIXED, "subject", "other_predicate", "other_object"),
    (f"constraint_type in ('conflictWith', 'single', 'oneOf') and {base._RIVAL} and other_predicate <> 0", "other_subject", "predicate", "object"),
)
_ADDS = (
    ("oneOf", "P2305", _BOTH("subject"), _BOTH("predicate"), "[d.value]"), ("type", "P2308", _BOTH("subject"), "[106]", "[d.value]"),
    ("valueType", "P2308", _BOTH("object"), "[106]", "[d.value]"), ("itemRequiresStatement", "P2306", _BOTH("subject"), "[d.value]", "null"),
    ("valueRequiresStatement", "P2306", _BOTH("object"), "[d.value]", "null"), ("inverse", "P1696", _BOTH("object"), "[d.value]", _BOTH("subject")),
)
_PATTERNS = "pat as (" + " union all ".join(
    [f"select violation_id, 'del' act, {n} n, {_BOTH(s)} s, {_BOTH(p)} p, {_BOTH(o)} as o from v where {c}" for n, (c, s, p, o) in enumerate(_DELS)]
    + [f"select violation_id, 'add', row_number() over (partition by violation_id order by d.value), {s}, {p}, {o} from v join def d on d.constraint_id = v.constraint_id and parameter = '{par}' where constraint_type = '{k}'" for k, par, s, p, o in _ADDS]
) + ")"
_CANDIDATES = f"""{RECORDS}, {base._SCORES}, {_PATTERNS},
ins as (select violation_id, act, n, a s, b p, c as o, row_number() over (partition by violation_id, act order by n, a, b, c) r
  from (select violation_id, act, n, unnest(list_sort(list_filter(s, lambda x: x > 6))[:3]) a, p, o from pat where p is not null and o is not null)
    x, unnest(list_sort(list_filter(x.p, lambda x: x > 6))[:3]) t(b), unnest(list_sort(list_filter(x.o, lambda x: x > 6))[:3]) u(c)),
grid as ({base.ORACLES['triple_topk'].split('grid as (')[1].split(')\nselect * from grid')[0]}),
al as (
  select violation_id, 0 g, 0::bigint n, add_subject add_s, add_predicate add_p, add_object add_o, del_subject del_s, del_predicate del_p, del_object del_o from v
  union all select violation_id, case act when 'add' then 1 else 2 end, r, case act when 'add' then s else 0 end, case act when 'add' then p else 0 end,
    case act when 'add' then o else 0 end, case act when 'del' then s else 0 end, case act when 'del' then p else 0 end, case act when 'del' then o else 0 end from ins where r <= 30
  union all select violation_id, case "action" when 'add' then 3 else 4 end, "rank", case "action" when 'add' then s else 0 end, case "action" when 'add' then p else 0 end,
    case "action" when 'add' then o else 0 end, case "action" when 'del' then s else 0 end, case "action" when 'del' then p else 0 end,
    case "action" when 'del' then o else 0 end from grid where "rank" <= 20),
once as (select *, row_number() over (partition by violation_id order by g, n) - 1 idx from al
  qualify row_number() over (partition by violation_id, add_s, add_p, add_o, del_s, del_p, del_o order by g, n) = 1),
cs as (select violation_id, (row_number() over (partition by violation_id order by idx) - 1)::int idx, add_s, add_p, add_o, del_s, del_p, del_o, g = 0 is_gold from once
  qualify row_number() over (partition by violation_id order by idx) <= 80)"""
_HELD = lambda part, slot: f"case when {part} is null then 1 else coalesce((select sum(m) from ms where ms.violation_id = pat.violation_id and ms.slot = (case act when 'add' then 0 else 3 end) + {slot} and list_contains(pat.{part}, ms.id)), 0) end"

ORACLES |= {
    "candidates": f"with {_CANDIDATES} select * from cs",
    "candidate_counts": f"with {_CANDIDATES} select candidates, count(*) records from (select violation_id, count(*) candidates from cs group by 1) group by 1",
    "fix_probability": f"""with {RECORDS}, {base._SCORES}, {_PATTERNS},
es as (select *, exp(score - max(score) over (partition by violation_id, slot)) e from slots),
ms as (select violation_id, slot, id, e / sum(e) over (partition by violation_id, slot) m from es),
w as (select violation_id, act, least(sum({_HELD('s', 0)} * {_HELD('p', 1)} * {_HELD('o', 2)}), 1) u from pat group by 1, 2),
b as (select violation_id, coalesce(max(u) filter (where act = 'add'), 0) "add", coalesce(max(u) filter (where act = 'del'), 0) del from v left join w using (violation_id) group by 1)
select violation_id, "add", del, 1 - (1 - "add") * (1 - del) fix from b""",
}

#: Whole candidate sets: every different resolved edit of a record is a pseudo-record of its own, labelled by the same rules;
#: all constraints with a checker are judged anew for each of them.
_PARTS_OF = ("sf", "of", "xf", "pl")
_RESOLVED = ", ".join(f"case when ok_{a} then {base._ROLE(f'{a}_{x}')} else 0 end r_{a}_{x}" for a in ("add", "del") for x in "spo")
_SIX = ", ".join(f"r_{a}_{x}" for a in ("add", "del") for x in "spo")
_READY = ", ".join(f"least({', '.join(base._ROLE(f'{a}_{x}') for x in 'spo')}) <> 0 ok_{a}" for a in ("add", "del"))
_REPLACED = ", ".join(f"r_{a}_{x[0]} as {a}_{x}" for a in ("add", "del") for x in ("subject", "predicate", "object"))
_FOCUS_AT = "exists (select 1 from state t where t.violation_id = v.violation_id and t.st = '{0}' and t.e = subject and t.p = predicate and t.v = object)"
_SETS = f"""q_cs as materialized (with {_CANDIDATES} select * exclude (is_gold) from cs), q_v as materialized (with {RECORDS} select * from v),
{", ".join(f"q_{t} as materialized (with {RECORDS} select * from {t})" for t in _PARTS_OF)},
q_cl as materialized (with {RECORDS} select violation_id, constraint_id, n from (select *, count(*) over (partition by violation_id) n from cl) semi join (select * from entry where supported) using (constraint_id)),
def as (with {RECORDS} select * from def), entry as (with {RECORDS} select * from entry),
q_r as (select violation_id, idx, add_s, add_p, add_o, del_s, del_p, del_o, {_RESOLVED} from (select *, {_READY} from q_cs join q_v using (violation_id))),
q_e as materialized (select *, row_number() over () sid from (select distinct violation_id, {_SIX} from q_r)),
v as (select q_v.* exclude (violation_id, {", ".join(base._EDIT)}), sid violation_id, {_REPLACED} from q_v join q_e using (violation_id)),
{", ".join(f"{t} as (select q_{t}.* exclude (violation_id), sid violation_id from q_{t} join q_e using (violation_id))" for t in _PARTS_OF)},
cl as (select constraint_id, sid violation_id from q_cl join q_e using (violation_id)){labels()[len(RECORDS):]},
q_f as materialized (select violation_id sid, constraint_id, is_primary m, checkable_pre cp, satisfied_pre = 1 sp, checkable_post c, satisfied_post = 1 s from f),
q_g as (select r.violation_id, constraint_id, c gc, s gs from q_r r join q_e using (violation_id, {_SIX}) join q_f using (sid) where idx = 0),
q_s as (select sid, count(*) filter (cp) checkable_pre, count(*) filter (sp) satisfied_pre, count(*) filter (c) checkable_post, count(*) filter (s) satisfied_post,
    count(*) filter (m and s) primary_satisfied, count(*) filter (not m and cp and c and sp and not s) regressions, count(*) filter (not m and cp and c and sp) regressions_denom,
    count(*) filter (not m and cp and c and not sp and s) improvements, count(*) filter (not m and cp and c and not sp) improvements_denom,
    count(*) filter (not m and gc and gs and c and not s) gold_regressions, count(*) filter (not m and gc and gs and c) gold_regressions_denom
  from q_f join q_e using (sid) left join q_g using (violation_id, constraint_id) group by 1),
q_p as (select violation_id sid, {_FOCUS_AT.format('pre')} pre_focus, {_FOCUS_AT.format('post')} post_focus from v),
q_m as (select violation_id, slot, id, max(score) score from (with {RECORDS}, {base._SCORES} select * from slots) group by all),
q_n as (select violation_id, idx, round(coalesce(sum(score), 0), 9) score from (select violation_id, idx, unnest([add_s, add_p, add_o, del_s, del_p, del_o]) id, unnest(range(6)) slot from q_cs)
  left join q_m using (violation_id, slot, id) group by all),
ev as materialized (select *, focus_preserved and primary_satisfied = 1 non_vacuous_fix, focus_deleted and post_fraction > pre_fraction vacuous_improvement, safe and focus_preserved non_vacuous_safe from (
  select *, primary_satisfied = 1 and regressions = 0 and post_fraction >= pre_fraction and ops <= 2 safe from (
  select *, coalesce(satisfied_pre / nullif(checkable_pre, 0), 0) pre_fraction, coalesce(satisfied_post / nullif(checkable_post, 0), 0) post_fraction,
    coalesce(regressions / nullif(regressions_denom, 0), 0) srr, coalesce(improvements / nullif(improvements_denom, 0), 0) sir,
    pre_focus and post_focus focus_preserved, pre_focus and not post_focus focus_deleted
  from (select r.violation_id, idx, constraint_type, score, coalesce(checkable_pre, 0) checkable_pre, coalesce(satisfied_pre, 0) satisfied_pre, coalesce(checkable_post, 0) checkable_post,
      coalesce(satisfied_post, 0) satisfied_post, coalesce(primary_satisfied, 0) primary_satisfied, coalesce(regressions, 0) regressions, coalesce(regressions_denom, 0) regressions_denom,
      coalesce(improvements, 0) improvements, coalesce(improvements_denom, 0) improvements_denom, pre_focus, post_focus,
      (least(add_s, add_p, add_o) <> 0)::bigint + (least(del_s, del_p, del_o) <> 0)::bigint ops
    from q_r r join q_e using (violation_id, {_SIX}) join q_v using (violation_id) left join q_s using (sid) join q_p using (sid) join q_n using (violation_id, idx))))),
{base._CHOICE[base._CHOICE.index("pick as (") :]}"""
_WHOLE_REPORT = base.ORACLES["oracle_report"].split(", sz as", 1)[1].replace(f"(with {RECORDS} select violation_id, count(*) n from cl group by 1)", "(select distinct violation_id, n from q_cl)")
ORACLES |= {
    "best_candidates": f"with {_SETS}, sz as{_WHOLE_REPORT}",
}

ORACLES |= {
    "capped_lines": f"""with l as (select o_orderkey, case when o_orderkey % 20 < 14 then 'train' when o_orderkey % 20 < 17 then 'val' else 'test' end || '-c' || (o_orderkey % 11) file from orders),
n as (select *, row_number() over (partition by file order by o_orderkey) - 1 line from l),
c as (select *, row_number() over (order by file, line) place from n where line < 200)
select file, line, 'c' || (o_orderkey % 11) constraint_id, 'Q' || o_orderkey subject, '<{_E}Q' || o_orderkey || '>' deleted from c where place <= 2500""",
    "resumed_shards": f"""with {RECORDS}, a as (select violation_id, count(*) n from cl group by 1),
r as (select violation_id, split, (violation_id // 20 % 4)::int shard, n, greatest({", ".join(base._EDIT)}) <> 0 keep from v join a using (violation_id))
select split, shard, count(*) filter (keep) kept, count(*) filter (not keep) dropped, count(*) filter (keep) "rows", sum(violation_id) filter (keep)::bigint id_sum,
  sum(n) filter (keep)::bigint attached from r group by 1, 2""",
}

#: The nodes of a record in order of use: keys of entities repeat, all others are new at each use; a number is a key's rank.
_USES = f"""{base._WIRED.split("obs as")[0]}
fc as (select violation_id, constraint_id, row_number() over (partition by violation_id order by constraint_id) place from wf),
st as (
  select violation_id, 0 kind, ord, 0 sub, s a, p b, o c from tr
  union all select violation_id, 1, 1000 + place, 0, constraint_id, 0, 0 from fc
  union all select violation_id, 2, 1000 + place, row_number() over (partition by violation_id, constraint_id order by substring(parameter, 2)::bigint, value), constraint_id,
    substring(parameter, 2)::bigint, value from fc join def using (constraint_id) where parameter is not null),
ps as (select *, row_number() over (partition by violation_id order by ord, sub) - 1 place from st),
us as (
  select violation_id, place, 3 * place pos, 's' part, case kind when 0 then 'e' || a when 1 then 'f' || a end k from ps where kind < 2
  union all select violation_id, place, 3 * place + 1, 'p', 'p' || place from ps where kind <> 1
  union all select violation_id, place, 3 * place + 2, 'o', 'e' || c from ps where kind <> 1),
nu as (select violation_id, k, row_number() over (partition by violation_id order by min(pos)) - 1 num from us group by 1, 2)"""
_SOURCES = f"""e as (select case when vec_id % 5 <> 4 then vec_id + 2000000000 end id, case when vec_id % 5 = 4 then 'L' || vec_id end k, embedding from embeddings),
nd as (select distinct violation_id, id from ({base.ORACLES['graph_nodes']}) where kind = 'entity')"""
_ALIKE = " and ".join(
    [f"abs(a.{c} - b.{c}) <= 1e-9" for c in ("primary_satisfied", "post_fraction", "sir", "srr")] + [f"a.{c} = b.{c}" for c in ("ops", "focus_preserved", "focus_deleted", "deletes_focus")]
)
ORACLES |= {
    "dense_graph": f"""with {_USES}, tot as (select violation_id, count(*) nodes from nu group by 1)
select p.violation_id, nodes, count(*) n_paths, md5(string_agg(concat_ws(',', kind, case kind when 1 then a else b end, case when kind = 2 then f.num else s.num end,
  coalesce(q.num, -1), coalesce(o.num, -1)), ';' order by p.place)) paths_md5
from ps p join tot using (violation_id) left join nu s on s.violation_id = p.violation_id and kind < 2 and s.k = case kind when 0 then 'e' || a else 'f' || a end
  left join nu f on f.violation_id = p.violation_id and kind = 2 and f.k = 'f' || a
  left join nu q on q.violation_id = p.violation_id and kind <> 1 and q.k = 'p' || place
  left join nu o on o.violation_id = p.violation_id and kind <> 1 and o.k = 'e' || c group by all""",
    "node_vectors": f"""with {_SOURCES}
select violation_id, nd.id, case when a.embedding is not null then 'id' when b.embedding is not null then 'literal' else 'unknown' end source,
  len(coalesce(a.embedding, b.embedding, u.embedding)) dims, coalesce(a.embedding, b.embedding, u.embedding)[1]::double "first"
from nd left join e a on a.id = nd.id left join e b on b.k = 'L' || (nd.id % 100) and nd.id between 8000 and 8999
  cross join (select embedding from e where id = 2000000007) u""",
    "degeneracy_report": f"""with g as (with {RECORDS} select violation_id, {base._GOLD} from v), ev as materialized (select * from {evaluated({0: None, 1: base.DELETE_FOCUS})}),
r as (select a.*, density, (add_s, add_p, add_o, del_s, del_p, del_o) = (0, 0, 0, 1, 2, 3) exact, {_ALIKE} equivalent, {", ".join(f"b.{c} f_{c}" for c in ("focus_deleted", "deletes_focus", "vacuous_improvement", "non_vacuous_fix"))}
  from ev a join ev b on a.violation_id = b.violation_id and a.idx = 0 and b.idx = 1 join g on g.violation_id = a.violation_id join {_DENSITY} d on d.violation_id = a.violation_id)
select coalesce(density, 'all') density, coalesce(constraint_type, 'all') constraint_type, count(*) support, avg(exact::int) exact, avg(equivalent::int) equivalent,
  {", ".join(f"avg({p}{c}::int) {n}_{c}" for p, n in (("", "model"), ("f_", "focus")) for c in ("focus_deleted", "deletes_focus", "vacuous_improvement", "non_vacuous_fix"))},
  coalesce(array_to_string((list(violation_id order by violation_id) filter (not (exact and equivalent)))[1:5], ','), '') examples
from r group by grouping sets ((), (density), (constraint_type))""",
}
