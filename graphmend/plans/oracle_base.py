"""DuckDB SQL of the adapter and of factor labels, in a relational form of its own: facts as rows, rules as joins."""

from __future__ import annotations

from graphmend.sources.violations import DEFINITIONS, FAMILIES, FILLERS

_DEFS = ", ".join(
    "(" + ", ".join("null" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in DEFINITIONS
)
_FAMILY = " ".join(f"when {k} then '{f}'" for k, f in enumerate(FAMILIES))
_FILL = ", ".join(f"({j}, {n})" for j, n in enumerate(FILLERS) if n)
_EDIT = """
  case when none or k not in (2, 3, 4, 6, 7, 8) then 0 when k in (2, 7, 8) then 3 else 1 end add_subject,
  case when none or k not in (2, 3, 4, 6, 7, 8) then 0 when k in (2, 7) then 109 when k = 3 then 102 when k = 4 then 2 else 106 end add_predicate,
  case when none or k not in (2, 3, 4, 6, 7, 8) then 0 when k in (2, 7) then 1 when k = 3 then 8079 when k = 4 then 2000000000 + ck % 50
    when k = 6 then 9001 else 9002 end add_object,
  case when none or k not in (0, 1, 4, 5) then 0 when k = 0 or (k = 5 and q % 2 = 0) then 4 else 1 end del_subject,
  case when none or k not in (0, 1, 4, 5) then 0 when k = 0 or (k = 5 and q % 2 = 0) then 5 else 2 end del_predicate,
  case when none or k not in (0, 1, 4, 5) then 0 when k = 0 or (k = 5 and q % 2 = 0) then 6 else 3 end del_object"""

#: Common table expressions: v (records), sf / of / xf (raw facts with order), def, entry (registry), pl, cl, cf (closures).
RECORDS = f"""
b0 as (
  select o_orderkey violation_id, o_orderkey % 9 k, o_orderkey // 9 q, o_custkey ck, (o_orderkey // 9) % 11 = 10 as "none",
    1000000000 + o_orderkey s, 2000000000 + o_custkey o,
    1000000000 + (o_orderkey + 1) % (select count(*) from orders) s2, 2000000000 + (o_custkey + 1) % (select count(*) from customer) ob2,
    8000 + ascii(o_orderstatus) status, 8200 + cast(substr(o_orderpriority, 1, 1) as bigint) pr, 3000000000 + c_nationkey nation,
    8300 + ascii(c_mktsegment) segment, c_acctbal >= 0 good
  from orders join customer on o_custkey = c_custkey),
v as (
  select *, case when violation_id % 20 < 14 then 'train' when violation_id % 20 < 17 then 'val' else 'test' end split,
    case k {_FAMILY} end constraint_type, 501 + k constraint_id, s subject, 101 predicate, o as object,
    case when k in (0, 5) then s when k = 1 then s2 else 0 end other_subject,
    case when k = 0 then 103 when k in (1, 5) then 101 else 0 end other_predicate,
    case when k = 0 then pr when k = 1 then o when k = 5 then ob2 else 0 end other_object, {_EDIT}
  from b0),
sf as (
  select violation_id, 1 ord, 101 p, o v from v where q % 7 <> 6
  union all select violation_id, 2, 102, status from v where q % 5 <> 4
  union all select violation_id, 3, 103, pr from v where q % 6 <> 5
  union all select violation_id, 4, 106, case when q % 4 <> 0 then 9001 else 9003 end from v where q % 4 <> 0 or q % 8 = 0
  union all select violation_id, 5, 109, s2 from v where q % 6 = 2
  union all select violation_id, 6, 101, ob2 from v where k = 5),
of as (
  select violation_id, 1 ord, 104 p, nation v from v
  union all select violation_id, 2, 105, segment from v where ck % 4 <> 0
  union all select violation_id, 3, 106, case when good then 9002 else 9003 end from v where good or ck % 2 = 0
  union all select violation_id, 4, 109, case q % 3 when 0 then s else s2 end from v where q % 3 < 2
  union all select violation_id, 5, 102, 8079 from v where ck % 3 = 0
  union all select violation_id, 6, 130 + ck % 8, 7000 from v),
xf as (
  select f.* from sf f join v using (violation_id) where k in (0, 5) and q % 2 = 0
  union all select violation_id, 1, 106, 9004 from v where k = 0 and q % 2 = 1
  union all select violation_id, 1, 101, o from v where k = 1
  union all select violation_id, 2, 106, 9001 from v where k = 1
  union all select violation_id, 1, 104, 3000000000 from v where k = 5 and q % 2 = 1),
def as (
  select * from (values {_DEFS}) t(constraint_id, family, property, parameter, value)
  union all select 505, 'oneOf', 101, 'P2305', 2000000000 + i from range(50) t(i)
  union all select 1000 * (j + 1) + i, 'unsupported:QF', 130 + j, null, null from (values {_FILL}) t(j, n), range(1, 301) u(i) where i <= n),
entry as (
  select distinct constraint_id, family, property, family not like 'unsupported:%' supported,
    dense_rank() over (order by family) - 1 type_index from def where family is not null),
pl as (
  select violation_id, 101 p from v union select violation_id, other_predicate from v where other_predicate <> 0
  union select violation_id, p from sf union select violation_id, p from of union select violation_id, p from xf),
attach as (select distinct constraint_id, property from def),
cl as (
  select violation_id, constraint_id from pl join attach on property = p union select violation_id, constraint_id from v),
cf as (
  select violation_id, a.constraint_id from v join attach own on own.constraint_id = v.constraint_id
    join attach a on a.property in (v.predicate, v.other_predicate, own.property)
  union select violation_id, constraint_id from v)"""


#: Slots of candidates that need no model, as SQL for the six edit columns.
DELETE_FOCUS = " 0 add_subject, 0 add_predicate, 0 add_object, 1 del_subject, 2 del_predicate, 3 del_object"
ADD_MIRROR = """ case k when 2 then 3 else 0 end add_subject, case k when 2 then 109 else 0 end add_predicate,
  case k when 2 then 1 else 0 end add_object, 0 del_subject, 0 del_predicate, 0 del_object"""


def labels(closed: bool = True, scope: str = "local", edit: str | None = None) -> str:
    """Common table expressions up to ``f``: a row per record and attached constraint with its four flags.

    ``edit`` replaces the historical edit.
    """
    return _labels(closed, scope) if edit is None else _labels(closed, scope).replace(_EDIT, edit)


def _labels(closed: bool, scope: str) -> str:
    attached = "cl" if scope == "local" else "cf"
    role = lambda c: "case {0} when 1 then subject when 2 then predicate when 3 then object when 4 then other_subject when 5 then other_predicate when 6 then other_object else {0} end".format(c)
    edit = lambda a: f"select violation_id, '{a}' act, {role(a + '_subject')} e, {role(a + '_predicate')} p, {role(a + '_object')} v from v"
    opened = "" if closed else " and exists (select 1 from facts t where t.violation_id = d.violation_id and t.e = d.e and t.p = d.p)"
    known = lambda e, p: "true" if closed else f"exists (select 1 from present t where t.violation_id = c.violation_id and t.st = c.st and t.e = {e} and t.p = {p})"
    has = lambda e, p: f"exists (select 1 from state t where t.violation_id = c.violation_id and t.st = c.st and t.e = {e} and t.p = {p})"
    guard = lambda e, p: f"exists (select 1 from missing m where m.violation_id = c.violation_id and m.st = c.st and m.e = {e} and m.p = {p})"
    local = lambda p: f"exists (select 1 from pl where pl.violation_id = c.violation_id and pl.p = {p})"
    # For each instance and entity: how many of its properties are unusable, absent, present.
    use = lambda e: f"({local('x.p')} and not {guard(e, 'x.p')} and {known(e, 'x.p')})"
    return f"""{RECORDS},
facts as (
  select violation_id, 's' r, subject e, p, f.v from v join sf f using (violation_id) where not (other_subject = subject)
  union select violation_id, 's', subject, p, f.v from v join xf f using (violation_id) where other_subject = subject
  union select violation_id, 'o', object, p, f.v from v join of f using (violation_id)
  union select violation_id, 'x', other_subject, p, f.v from v join xf f using (violation_id) where other_subject not in (0, subject)),
edits as (select * from ({edit('del')} union all {edit('add')}) where e <> 0 and p <> 0 and v <> 0),
done as (
  select d.* from edits d join v r using (violation_id)
  where (d.e in (r.subject, r.object) or (r.other_subject <> 0 and d.e = r.other_subject))
    and exists (select 1 from pl where pl.violation_id = d.violation_id and pl.p = d.p){opened}),
missing as (
  select violation_id, 'post' st, e, p from edits
  except select d.violation_id, 'post', d.e, d.p from edits d join done g using (violation_id, act, e, p, v)),
state as (
  select violation_id, 'pre' st, e, p, v from facts
  union select violation_id, 'post', e, p, v from facts f where not exists (
    select 1 from done d where d.act = 'del' and d.violation_id = f.violation_id and d.e = f.e and d.p = f.p and d.v = f.v)
  union select violation_id, 'post', e, p, v from done where act = 'add'),
present as (
  select violation_id, st, e, p from facts, (values ('pre'), ('post')) t(st)
  union select violation_id, 'post', e, p from done where act = 'add'),
par as (
  select constraint_id, 'req' kind, value p from def where parameter = 'P2306'
  union select constraint_id, 'rel', value from def where parameter = 'P2309'
  union select constraint_id, 'rel', p from entry, (values (106), (110)) t(p)
    where constraint_id not in (select constraint_id from def where parameter = 'P2309')
  union select constraint_id, 'inv', value from def where parameter = 'P1696'
  union select constraint_id, 'inv', property from entry where constraint_id not in (select constraint_id from def where parameter = 'P1696')
  union select constraint_id, 'con', value from def where value between 100 and 999),
c as (
  select a.violation_id, a.constraint_id, st, r.subject s, r.predicate fp, r.object o, other_subject os, other_predicate op, other_object oo,
    family, property,
    exists (select 1 from state t where t.violation_id = a.violation_id and t.st = y.st and t.e = r.subject and t.p = r.predicate and t.v = r.object) focus,
    exists (select 1 from state t where t.violation_id = a.violation_id and t.st = y.st and t.e = r.subject and t.p = property) trig
  from {attached} a join entry using (constraint_id) join v r using (violation_id), (values ('pre'), ('post')) y(st) where supported),
u as (
  select c.violation_id, c.constraint_id, c.st, x.kind,
    count(*) filter (where not {use('c.s')}) bad_s, count(*) filter (where not {use('c.o')}) bad_o,
    count(*) filter (where not {has('c.s', 'x.p')}) no_s, count(*) filter (where not {has('c.o', 'x.p')}) no_o, count(*) n
  from c join par x using (constraint_id) group by all),
w as (
  select c.*, not {guard('c.s', 'c.property')} free, {local('c.property')} loc, {known('c.s', 'c.property')} comp,
    req.bad_s rq_bad_s, req.bad_o rq_bad_o, req.no_s rq_no_s, req.no_o rq_no_o, rel.bad_s rl_bad_s, rel.bad_o rl_bad_o,
    rel.n - rel.no_s rl_has_s, rel.n - rel.no_o rl_has_o, inv.bad_o iv_bad_o, con.bad_s cn_bad_s, con.n - con.no_s cn_has_s,
    req.n rq_n, con.n cn_n,
    exists (select 1 from state t join par x on x.constraint_id = c.constraint_id and x.kind = 'inv' and x.p = t.p
      where t.violation_id = c.violation_id and t.st = c.st and t.e = c.o and t.v = c.s) back,
    exists (select 1 from state t join par x on x.constraint_id = c.constraint_id and x.kind = 'rel' and x.p = t.p
      join def d on d.constraint_id = c.constraint_id and d.parameter = 'P2308' and d.value = t.v
      where t.violation_id = c.violation_id and t.st = c.st and t.e = c.s) typed_s,
    exists (select 1 from state t join par x on x.constraint_id = c.constraint_id and x.kind = 'rel' and x.p = t.p
      join def d on d.constraint_id = c.constraint_id and d.parameter = 'P2308' and d.value = t.v
      where t.violation_id = c.violation_id and t.st = c.st and t.e = c.o) typed_o,
    exists (select 1 from def d where d.constraint_id = c.constraint_id and d.parameter = 'P2305' and d.value = c.o) listed,
    (select count(*) from state t where t.violation_id = c.violation_id and t.st = c.st and t.e = c.s and t.p = c.property) vals
  from c
    left join u req on (req.violation_id, req.constraint_id, req.st, req.kind) = (c.violation_id, c.constraint_id, c.st, 'req')
    left join u rel on (rel.violation_id, rel.constraint_id, rel.st, rel.kind) = (c.violation_id, c.constraint_id, c.st, 'rel')
    left join u inv on (inv.violation_id, inv.constraint_id, inv.st, inv.kind) = (c.violation_id, c.constraint_id, c.st, 'inv')
    left join u con on (con.violation_id, con.constraint_id, con.st, con.kind) = (c.violation_id, c.constraint_id, c.st, 'con')),
j as (
  select violation_id, constraint_id, st,
    coalesce(free and case family
      when 'conflictWith' then loc and cn_n > 0 and cn_bad_s = 0 and comp
      when 'inverse' then fp = property and case when focus then iv_bad_o = 0 else comp end
      when 'symmetric' then fp = property and case when focus then iv_bad_o = 0 else comp end
      when 'itemRequiresStatement' then rq_n > 0 and loc and case when trig then rq_bad_s = 0 else comp end
      when 'valueRequiresStatement' then fp = property and case when focus then rq_n > 0 and rq_bad_o = 0 else comp end
      when 'oneOf' then fp = property and loc and (focus or comp)
      when 'single' then loc and comp
      when 'type' then loc and case when trig then rl_bad_s = 0 and rl_has_s > 0 else comp end
      when 'valueType' then loc and case when trig then rl_bad_o = 0 and rl_has_o > 0 else comp end
      when 'distinct' then loc and case when focus then os <> 0 and op = property and oo <> 0 else comp end end, false) chk,
    coalesce(case family
      when 'conflictWith' then not (trig and cn_has_s > 0)
      when 'inverse' then not focus or back
      when 'symmetric' then not focus or back
      when 'itemRequiresStatement' then not trig or rq_no_s = 0
      when 'valueRequiresStatement' then not focus or rq_no_o = 0
      when 'oneOf' then not focus or listed
      when 'single' then vals <= 1
      when 'type' then not trig or typed_s
      when 'valueType' then not trig or typed_o
      when 'distinct' then not focus or not (os <> 0 and op = property and oo = o and os <> s) end, false) sat
  from w),
f as (
  select a.violation_id, r.split, r.constraint_type, row_number() over (partition by a.violation_id order by a.constraint_id) - 1 as "position",
    a.constraint_id, a.constraint_id = r.constraint_id is_primary, family, coalesce(supported, false) supported,
    family is not null in_registry, coalesce(type_index, -1) type_index, coalesce(x.chk, false) checkable_pre,
    cast(coalesce(x.chk and x.sat, false) as integer) satisfied_pre, coalesce(y.chk, false) checkable_post,
    cast(coalesce(y.chk and y.sat, false) as integer) satisfied_post
  from {attached} a join v r using (violation_id) left join entry e on e.constraint_id = a.constraint_id
    left join j x on x.violation_id = a.violation_id and x.constraint_id = a.constraint_id and x.st = 'pre'
    left join j y on y.violation_id = a.violation_id and y.constraint_id = a.constraint_id and y.st = 'post')"""


def evaluated(edits: dict[int, str | None]) -> str:
    """A row per record and candidate, by number; each candidate's labels come from a query of their own."""
    focus = lambda st: f"exists (select 1 from state t where t.violation_id = v.violation_id and t.st = '{st}' and t.e = subject and t.p = predicate and t.v = object)"
    role = lambda c: "case {0} when 1 then subject when 2 then predicate when 3 then object when 4 then other_subject when 5 then other_predicate when 6 then other_object else {0} end".format(c)
    gold = f"(with {labels()} select violation_id, constraint_id, checkable_post gc, satisfied_post gs from f)"
    one = lambda i, e: f"""select {i} idx, z.*, c.* exclude (violation_id) from (with {labels(edit=e)}
  select violation_id, constraint_type, (least(add_subject, add_predicate, add_object) <> 0)::bigint add_count,
    (least(del_subject, del_predicate, del_object) <> 0)::bigint del_count, {focus('pre')} pre_focus, {focus('post')} post_focus,
    {role('del_subject')} = subject and {role('del_predicate')} = predicate and {role('del_object')} = object deletes_focus from v) z
  join (select violation_id, count(*) filter (where checkable_pre) checkable_pre, sum(satisfied_pre)::bigint satisfied_pre,
      count(*) filter (where checkable_post) checkable_post, sum(satisfied_post)::bigint satisfied_post,
      sum(satisfied_post) filter (where is_primary)::bigint primary_satisfied,
      count(*) filter (where b and satisfied_pre = 1 and satisfied_post = 0) regressions, count(*) filter (where b and satisfied_pre = 1) regressions_denom,
      count(*) filter (where b and satisfied_pre = 0 and satisfied_post = 1) improvements, count(*) filter (where b and satisfied_pre = 0) improvements_denom,
      count(*) filter (where t and satisfied_post = 0) gold_regressions, count(*) filter (where t) gold_regressions_denom
    from (select f.*, not is_primary and checkable_pre and checkable_post b, not is_primary and gc and gs = 1 and checkable_post t
      from (with {labels(edit=e)} select * from f) f join {gold} g using (violation_id, constraint_id))
    group by 1) c using (violation_id)"""  # noqa: E731
    rows = " union all ".join(one(i, e) for i, e in edits.items())
    return f"""(select *, focus_preserved and primary_satisfied = 1 non_vacuous_fix, focus_deleted and post_fraction > pre_fraction vacuous_improvement,
  safe and focus_preserved non_vacuous_safe from (
  select *, primary_satisfied = 1 and regressions = 0 and post_fraction >= pre_fraction and ops <= 2 safe from (
  select *, coalesce(satisfied_pre / nullif(checkable_pre, 0), 0) pre_fraction, coalesce(satisfied_post / nullif(checkable_post, 0), 0) post_fraction,
    coalesce(regressions / nullif(regressions_denom, 0), 0) srr, coalesce(improvements / nullif(improvements_denom, 0), 0) sir,
    coalesce(gold_regressions / nullif(gold_regressions_denom, 0), 0) gold_srr, add_count + del_count ops,
    pre_focus and post_focus focus_preserved, pre_focus and not post_focus focus_deleted from ({rows}))))"""
