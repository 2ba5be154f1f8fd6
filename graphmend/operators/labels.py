"""Factor labels: every attached constraint before and after the historical edit, with coverage and filter reports."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evidence import Check, flags, with_edit, with_evidence
from .registry import INSTANCE, Catalog

KEYS = ("violation_id", "split", "constraint_type", "position", "constraint_id", "is_primary", "family", "supported", "in_registry", "type_index")
STATES = ("checkable_pre", "satisfied_pre", "checkable_post", "satisfied_post")
EDIT = ("add_subject", "add_predicate", "add_object", "del_subject", "del_predicate", "del_object")


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def attached_ids(scope: str) -> Column:
    return F.col("local_constraint_ids") if scope == "local" else F.coalesce("local_constraint_ids_focus", "local_constraint_ids")


ROLES = ("subject", "predicate", "object", "other_subject", "other_predicate", "other_object")


def _struct(fields: dict[str, str]) -> str:
    return f"named_struct({', '.join(f"'{n}', {e}" for n, e in fields.items())})"


def verdicts(records: DataFrame, known: Catalog | DataFrame, scope: str = "local", closed: bool = True) -> DataFrame:
    """Adds ``p_local``, ``x_id``, ``x_raw``, the state ``pre`` and ``verdicts`` of the attached constraints with a checker.

    A verdict has position, id, the instance (``c``, or its number ``n`` in a catalog that is part of the plan), the
    predicates it depends on (``watched``) and the four flags before and after the historical edit. Everything is worked out
    in the record's row; a registry that plans can't hold is joined by id first, and records regroup once.
    """
    rows = with_edit(with_evidence(records), [F.col(c) for c in EDIT], "post", closed)
    if isinstance(known, Catalog) and known.entries:
        rows = rows.withColumn("placed", placed(known, scope)).withColumn("verdicts", F.filter("placed", lambda y: y["n"].between(0, known.supported - 1)))
        kept, entry = "n", known.entry_sql("y.n")
    else:
        instances = known.instances if isinstance(known, Catalog) else known
        each = records.select("violation_id", F.posexplode(attached_ids(scope)).alias("position", "constraint_id")).join(instances.where("supported"), "constraint_id")
        c = F.struct(*(f.strip().split(" ")[0] for f in INSTANCE.split(",")))
        lists = each.groupBy("violation_id").agg(F.array_sort(F.collect_list(F.struct("position", "constraint_id", c.alias("c")))).alias("verdicts"))
        rows = rows.join(lists, "violation_id", "left").withColumn("verdicts", F.coalesce("verdicts", F.array().cast(lists.schema["verdicts"].dataType)))
        kept, entry = "c", "y.c"
    # An edit of predicates that a verdict doesn't depend on leaves it as it was.
    watched = "array_distinct(concat(y.c.required, y.c.relations, y.c.inverses, y.c.conflicts, array(y.c.property, predicate, other_predicate)))"
    rules = {s: Check(s, closed, "y.c.").rules(f"y.checkable_{s}") for s in ("pre", "post")}
    named = {n: f"y.{n}" for n in ("position", "constraint_id", kept)}
    own = named | {"c": entry}
    first = {n: f"y.{n}" for n in own} | {"watched": watched, "checkable_pre": rules["pre"][0]}
    second = {n: f"y.{n}" for n in first} | {"satisfied_pre": rules["pre"][1], "again": "arrays_overlap(y.watched, touched)"}
    third = {n: f"y.{n}" for n in second} | {"checkable_post": f"if(y.again, {rules['post'][0]}, y.checkable_pre)"}
    last = {n: f"y.{n}" for n in (*named, "watched", "checkable_pre", "checkable_post")} | {"satisfied_pre": "cast(y.satisfied_pre as int)", "satisfied_post": f"cast(if(y.again, {rules['post'][1]}, y.satisfied_pre) as int)"}
    made = reduce(lambda items, fields: f"transform({items}, y -> {_struct(fields)})", (own, first, second, third, last), "verdicts")
    return rows.withColumn("verdicts", F.expr(made)).drop("post", "touched")


def flagged(records: DataFrame, known: Catalog, closed: bool = True) -> DataFrame:
    """Adds the states ``pre`` and ``post`` and ``flags``: for each entry with a checker, attached or not, 1 checkable and 2
    satisfied before, 4 checkable and 8 satisfied after the historical edit. Rules are written out by entry and compiled."""
    rows = with_edit(with_evidence(records), [F.col(c) for c in EDIT], "post", closed)
    both = {f"flags_{s}": F.expr(flags(known.checked(), s, closed)) for s in ("pre", "post")}
    rows = rows.withColumns(both)
    each = [F.get("flags_pre", F.lit(i)) + 4 * F.get("flags_post", F.lit(i)) for i in range(known.supported)]
    return rows.withColumn("flags", F.array(*each)).drop(*both)


def mask(known: Catalog, flags: str, bit: int) -> Column:
    """A long with a bit for each of ``known.bits()``: whether its entry has ``bit`` (0 checkable, 1 satisfied) in the array ``flags``."""
    return F.expr(" | ".join(f"shiftleft(shiftright(cast(get({flags}, {n}) as bigint), {bit}) & 1L, {i})" for i, (_, n) in enumerate(known.bits())))


def with_masks(records: DataFrame, known: Catalog, scope: str = "local", closed: bool = True) -> DataFrame:
    """Adds the state ``pre`` and, as masks over ``known.bits()``: the attached constraints ``held``, the own one ``m``, those checkable
    and satisfied before (``cp``, ``sp``) and after the historical edit (``cg``, ``sg``). ``repeated`` is null, or where ids are attached
    repeatedly a mask for each further time. Everything is compiled; lambdas see records with repeated ids alone."""
    rows = with_edit(with_evidence(records), [F.col(c) for c in EDIT], "post", closed).withColumn("ids", attached_ids(scope))
    times = " | ".join(f"if(size(filter(ids, x -> x = {c}L)) >= k, shiftleft(1L, {i}), 0L)" for i, (c, _) in enumerate(known.bits()))
    repeated = F.when(F.size(F.array_distinct("ids")) < F.size("ids"), F.expr(f"transform(sequence(2, size(ids)), k -> {times})"))
    # The lambda keeps this step out of whole-stage code, where the rules would be one method, too long to be compiled at run time.
    rows = rows.withColumns({"repeated": repeated, **{f"flags_{s}": F.expr(flags(known.checked(), s, closed)) for s in ("pre", "post")}})
    every = lambda test: F.expr(" | ".join(f"if({test(c)}, shiftleft(1L, {i}), 0L)" for i, (c, _) in enumerate(known.bits())))
    rows = rows.withColumns(
        {
            "held": every(lambda c: f"coalesce(array_contains(ids, {c}L), false)"), "m": every(lambda c: f"coalesce(constraint_id = {c}L, false)"),
            **{f"{'cs'[bit]}{'pg'[i]}": mask(known, f"flags_{s}", bit) for i, s in enumerate(("pre", "post")) for bit in (0, 1)},
        }
    )
    return rows.drop("ids", "flags_pre", "flags_post", "post", "touched")


def placed(known: Catalog, scope: str) -> Column:
    """(position, constraint_id, n): the attached constraints and the numbers of their entries."""
    return F.transform(attached_ids(scope), lambda x, i: F.struct(i.alias("position"), x.alias("constraint_id"), known.number(x).alias("n")))


def factors(records: DataFrame, instances: Catalog | DataFrame, scope: str = "local", policy: str = "all", closed: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Exploded labels (violation_id, ..., position, constraint_id, ..., checkable and satisfied, pre and post).

    With a catalog in the plan verdicts are made in the record's row, and narrow structs are exploded: constraints without a
    checker need none. Otherwise instances are joined by id, without an exchange where they are small enough to be broadcast
    (and over streams). ``supported_only`` drops secondary constraints without a checker. Constraints outside the registry
    keep type -1. Columns of the records may be carried.
    """
    if isinstance(instances, Catalog) and instances.entries:
        if policy not in ("all", "supported_only"):
            raise ValueError(f"unknown policy: {policy}")
        if instances.checked():
            return _flagged_factors(records, instances, scope, policy, closed, carry)
        rows = verdicts(records, instances, scope, closed).withColumnRenamed("constraint_id", "primary_id")
        number = instances.number(F.col("y.constraint_id"))
        judged = F.expr(f"transform(verdicts, y -> {_struct({f: f'y.{f}' for f in ('position', 'constraint_id', *STATES)})})")
        bare = F.filter("placed", lambda y: ~y["n"].between(0, instances.supported - 1) & (F.lit(policy == "all") | (y["constraint_id"] == F.col("primary_id"))))
        none = {"position": "y.position", "constraint_id": "y.constraint_id", "checkable_pre": "false", "satisfied_pre": "0", "checkable_post": "false", "satisfied_post": "0"}
        rows = rows.withColumns({"judged": judged, "bare": bare}).withColumn("bare", F.expr(f"transform(bare, y -> {_struct(none)})"))
        keys = ("violation_id", "split", "constraint_type", "primary_id", *carry)
        each = rows.select(*keys, F.explode(F.concat("judged", "bare")).alias("y")).withColumn("n", number)
        c = lambda f: instances.entry(F.col("n"))[f]
        more = {
            "is_primary": F.col("y.constraint_id") == F.col("primary_id"), "family": c("family"), "supported": F.col("n").between(0, instances.supported - 1),
            "in_registry": F.col("n") >= 0, "type_index": F.coalesce(c("type_index"), F.lit(-1).cast("long")),
        }
        return each.select(*(more[k].alias(k) if k in more else k if k in keys else F.col(f"y.{k}").alias(k) for k in (*KEYS, *STATES, *carry)))
    if policy not in ("all", "supported_only"):
        raise ValueError(f"unknown policy: {policy}")
    rows = with_edit(with_evidence(records), [F.col(c) for c in EDIT], "post", closed).withColumn("primary_id", F.col("constraint_id"))
    keep = ["violation_id", "split", "constraint_type", "primary_id", "p_local", "pre", "post", *ROLES, *carry]
    each = rows.select(*keep, F.posexplode(attached_ids(scope)).alias("position", "constraint_id"))
    joined = each.join(instances.instances if isinstance(instances, Catalog) else instances, "constraint_id", "left").withColumns(
        {
            "in_registry": F.col("family").isNotNull(),
            "supported": F.coalesce("supported", F.lit(False)),
            "type_index": F.coalesce("type_index", F.lit(-1).cast("long")),
            "is_primary": F.col("constraint_id") == F.col("primary_id"),
        }
    )
    if policy == "supported_only":
        joined = joined.where("supported or is_primary")
    rules = {s: Check(s, closed).columns(f"checkable_{s}") for s in ("pre", "post")}
    joined = joined.withColumns({f"checkable_{s}": r[0] for s, r in rules.items()})
    joined = joined.withColumns({f"satisfied_{s}": r[1].cast("int") for s, r in rules.items()})
    return joined.select(*KEYS, *STATES, *carry)


def _flagged_factors(records: DataFrame, known: Catalog, scope: str, policy: str, closed: bool, carry: tuple[str, ...]) -> DataFrame:
    """``factors`` by flags: attached ids are unfolded and look their entry's flag up."""
    rows = flagged(records, known, closed).withColumn("primary_id", F.col("constraint_id"))
    keys = ("violation_id", "split", "constraint_type", "primary_id", *carry)
    each = rows.select(*keys, "flags", F.posexplode(attached_ids(scope)).alias("position", "constraint_id")).withColumn("n", known.number(F.col("constraint_id")))
    supported, own = F.col("n").between(0, known.supported - 1), F.col("constraint_id") == F.col("primary_id")
    if policy == "supported_only":
        each = each.where(supported | own)
    flag, c = F.coalesce(F.get("flags", "n"), F.lit(0)), lambda f: known.entry(F.col("n"))[f]
    bit = lambda i: flag.bitwiseAND(F.lit(1 << i)) != 0
    more = {
        "is_primary": own, "family": c("family"), "supported": supported, "in_registry": F.col("n") >= 0, "type_index": F.coalesce(c("type_index"), F.lit(-1).cast("long")),
        **{s: bit(i).cast("int") if s.startswith("satisfied") else bit(i) for i, s in enumerate(STATES)},
    }
    return each.select(*(more[k].alias(k) if k in more else F.col(k) for k in (*KEYS, *STATES, *carry)))


def placed_kinds(records: DataFrame, known: Catalog, scope: str) -> DataFrame:
    """(violation_id, split, constraint_type, primary_id, ids, kinds): attached constraints and their kinds, in the record's row."""
    rows = records.select("violation_id", "split", "constraint_type", F.col("constraint_id").alias("primary_id"), attached_ids(scope).alias("ids"))
    return rows.withColumn("kinds", F.transform("ids", known.kind))


def tallies(records: DataFrame, known: Catalog, scope: str = "local") -> DataFrame:
    """(violation_id, split, constraint_type, family, supported, in_registry, n, primaries): a row for each kind of constraints
    that a record has, with how many it has and how many of them are its own. No constraint is judged, and those of one kind
    are counted in the record's row; with a registry that plans can't hold they are counted from labels."""
    keys = ("violation_id", "split", "constraint_type", "family", "supported", "in_registry")
    if not known.entries:
        return factors(records, known, scope).groupBy(*keys).agg(F.count("*").alias("n"), count_if(F.col("is_primary")).alias("primaries"))
    rows = placed_kinds(records, known, scope)
    rows = rows.withColumn("kinds", F.sort_array("kinds")).withColumn("first", F.transform(F.array_distinct("kinds"), lambda k: F.array_position("kinds", k)))
    after = lambda i: F.coalesce(F.get("first", i + 1), F.size("kinds").cast("long") + 1)
    each = F.transform("first", lambda at, i: F.struct(F.get("kinds", (at - 1).cast("int")).alias("kind"), (after(i) - at).alias("n")))
    primaries = F.size(F.filter("ids", lambda x: x == F.col("primary_id"))).cast("long")
    rows = rows.select(*keys[:3], known.kind(F.col("primary_id")).alias("own"), primaries.alias("primaries"), F.explode(each).alias("y"))
    own = F.when(F.col("y.kind") == F.col("own"), F.col("primaries")).otherwise(F.lit(0).cast("long"))
    return rows.select(*keys[:3], *known.told(F.col("y.kind")), "y.n", own.alias("primaries"))


def support_counts(records: DataFrame, known: Catalog, scope: str = "local") -> DataFrame:
    """A row per record, also where nothing is attached (total 0): its number of attached constraints (total), those with a checker (supported), without (unsupported) and
    outside the registry (missing), how often its own is attached (primaries), and that one's family, own_supported and
    own_in_registry. Counted in the record's row; with a registry that plans can't hold, from labels."""
    keys = ("violation_id", "split", "constraint_type")
    if not known.entries:
        p = lambda c: F.max(F.when(F.col("is_primary"), F.col(c)))
        return factors(records, known, scope).groupBy(*keys).agg(
            F.count("*").alias("total"), count_if(F.col("supported")).alias("supported"), count_if(F.col("in_registry") & ~F.col("supported")).alias("unsupported"),
            count_if(~F.col("in_registry")).alias("missing"), count_if(F.col("is_primary")).alias("primaries"),
            p("family").alias("family"), p("supported").alias("own_supported"), p("in_registry").alias("own_in_registry"),
        )
    last = sum(s for _, s in known.kinds()) - 1
    size = lambda where: F.size(F.filter("kinds", where)).cast("long")
    family, supported, in_registry = known.told(known.kind(F.col("primary_id")))
    return placed_kinds(records, known, scope).select(
        *keys, F.size("ids").cast("long").alias("total"), size(lambda k: k.between(0, last)).alias("supported"), size(lambda k: k > last).alias("unsupported"),
        size(lambda k: k < 0).alias("missing"), F.size(F.filter("ids", lambda x: x == F.col("primary_id"))).cast("long").alias("primaries"),
        family, supported.alias("own_supported"), in_registry.alias("own_in_registry"),
    )


def missing_ids(records: DataFrame, known: Catalog, scope: str = "local") -> DataFrame:
    """(constraint_id, is_primary): attached constraints outside the registry."""
    if not known.entries:
        return factors(records, known, scope).where("not in_registry").select("constraint_id", "is_primary")
    rows = records.select(F.col("constraint_id").alias("primary_id"), F.explode(F.filter(attached_ids(scope), lambda x: known.kind(x) < 0)).alias("constraint_id"))
    return rows.select("constraint_id", (F.col("constraint_id") == F.col("primary_id")).alias("is_primary"))


def primary_places(records: DataFrame, scope: str = "local") -> DataFrame:
    """(violation_id, position): where a record's own constraint stands among the attached ones."""
    places = F.transform(attached_ids(scope), lambda x, i: F.when(x == F.col("constraint_id"), i))
    return records.select("violation_id", F.explode(F.array_compact(places)).alias("position"))


def factor_arrays(found: DataFrame) -> DataFrame:
    """One row per record: six aligned arrays in attached order, and its coverage."""
    item = F.struct("position", "constraint_id", "type_index", *STATES)
    lists = found.groupBy("violation_id").agg(F.array_sort(F.collect_list(item)).alias("f"))
    names = {"constraint_id": "factor_constraint_ids", "type_index": "factor_types", **{s: f"factor_{s}" for s in STATES}}
    rows = lists.select("violation_id", *(F.col(f"f.{c}").alias(n) for c, n in names.items()))
    for state in ("pre", "post"):
        n = F.size(F.filter(f"factor_checkable_{state}", lambda x: x)).cast("long")
        rows = rows.withColumns({f"num_checkable_{state}": n, f"coverage_{state}": rate(n, F.size("factor_types"))})
    return rows


def held_arrays(records: DataFrame, known: Catalog, scope: str = "local", closed: bool = True) -> DataFrame:
    """The arrays of ``factor_arrays`` over all attached constraints in the record's row, with its columns; null where nothing is
    attached. Labels are neither unfolded nor regrouped. For catalogs whose rules can be written out."""
    types = json.dumps([e["type_index"] for e in json.loads(known.entries)])
    rows = flagged(records, known, closed).withColumn("ids", attached_ids(scope)).withColumn("numbers", F.transform("ids", known.number))
    flag = F.transform("numbers", lambda n: F.when(n.between(0, known.supported - 1), F.get("flags", n)).otherwise(F.lit(0)))
    kind = F.transform("numbers", lambda n: F.when(n >= 0, F.coalesce(F.get(F.from_json(F.lit(types), "array<bigint>"), n), F.lit(-1))).otherwise(F.lit(-1)).cast("long"))
    rows = rows.withColumns({"flag": flag, "factor_types": kind})
    bit = lambda i: F.transform("flag", lambda f: f.bitwiseAND(F.lit(1 << i)) != 0)
    made = {"factor_constraint_ids": F.col("ids"), "factor_types": F.col("factor_types")}
    made |= {f"factor_{s}": bit(i).cast("array<int>") if s.startswith("satisfied") else bit(i) for i, s in enumerate(STATES)}
    return rows.select(*records.columns, *(F.when(F.size("ids") > 0, c).alias(n) for n, c in made.items()))


def held_invariants(rows: DataFrame) -> DataFrame:
    """``invariants`` of ``held_arrays``: labels are counted in the record's row. A ``violation_id`` names one record."""
    n = F.size("factor_types")
    wrong = F.size("factor_constraint_ids") != n
    for s in STATES:
        wrong = wrong | (F.size(f"factor_{s}") != n)
    unchecked = lambda s: F.size(F.filter(F.arrays_zip(F.col(f"factor_satisfied_{s}").alias("s"), F.col(f"factor_checkable_{s}").alias("c")), lambda x: (x["s"] == 1) & ~x["c"]))
    own = F.coalesce(F.array_contains("factor_constraint_ids", F.col("constraint_id")), F.lit(False))
    told = F.struct(
        n.alias("n"), wrong.alias("wrong"), unchecked("pre").alias("pre"), unchecked("post").alias("post"), F.size(F.filter("factor_types", lambda t: t < -1)).alias("odd"), own.alias("own"),
    )
    # Unfolded, so that the condition isn't pushed down through all that the arrays are made of.
    each = rows.select(F.explode_outer(F.when(F.col("factor_types").isNotNull(), F.array(told))).alias("x")).where("x is not null").select("x.*")
    total = lambda c, name: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0).cast("long")).alias(name)
    return each.agg(
        F.count("*").alias("records"), count_if(F.col("wrong")).alias("unequal"), count_if(F.col("n") == 0).alias("empty"), total("n", "factors"), total("pre", "satisfied_unchecked_pre"),
        total("post", "satisfied_unchecked_post"), total("odd", "type_out_of_range"), count_if(~F.col("own")).alias("without_primary"),
    )


def coverage(found: DataFrame) -> DataFrame:
    """Totals and rates per family; constraints outside the registry count as ``missing_registry``."""
    family = F.when(~F.col("in_registry"), "missing_registry").otherwise(F.col("family"))
    sums = found.groupBy(family.alias("family")).agg(
        F.count("*").alias("total"), *(count_if(F.col(f"checkable_{s}")).alias(f"checkable_{s}") for s in ("pre", "post")),
        *(F.sum(F.col(f"satisfied_{s}").cast("long")).alias(f"satisfied_{s}") for s in ("pre", "post")),
    )
    rates = {f"checkable_rate_{s}": rate(F.col(f"checkable_{s}"), F.col("total")) for s in ("pre", "post")}
    rates |= {f"satisfied_rate_{s}": rate(F.col(f"satisfied_{s}"), F.col(f"checkable_{s}")) for s in ("pre", "post")}
    return sums.withColumns(rates)


def filter_stats(found: DataFrame) -> DataFrame:
    """What the policy ``supported_only`` keeps and drops, over labels made with ``all``: one row."""
    p, s, r = (F.col(c) for c in ("is_primary", "supported", "in_registry"))
    return found.agg(
        F.count("*").alias("raw"), count_if(s | p).alias("retained"), count_if(r & ~s).alias("unsupported"),
        count_if(r & ~s & ~p).alias("unsupported_filtered"), count_if(r & ~s & p).alias("unsupported_primary_retained"),
        count_if(~r).alias("missing"), count_if(~r & ~p).alias("missing_filtered"), count_if(~r & p).alias("missing_primary_retained"),
        count_if(s).alias("supported_retained"),
    ).withColumn("filtered_rate", rate(F.col("raw") - F.col("retained"), F.col("raw")))


def filter_families(found: DataFrame) -> DataFrame:
    gone = found.where("in_registry and not supported")
    return gone.groupBy("family").agg(F.count("*").alias("unsupported"), count_if(~F.col("is_primary")).alias("filtered"))


def tallied_filter_stats(found: DataFrame) -> DataFrame:
    """``filter_stats`` over tallies."""
    n, p, s, r = (F.col(c) for c in ("n", "primaries", "supported", "in_registry"))
    total = lambda number, name, where=F.lit(True): F.coalesce(F.sum(F.when(where, number)), F.lit(0).cast("long")).alias(name)
    return found.agg(
        total(n, "raw"), total(F.when(s, n).otherwise(p), "retained"), total(n, "unsupported", r & ~s), total(n - p, "unsupported_filtered", r & ~s),
        total(p, "unsupported_primary_retained", r & ~s), total(n, "missing", ~r), total(n - p, "missing_filtered", ~r), total(p, "missing_primary_retained", ~r),
        total(n, "supported_retained", s),
    ).withColumn("filtered_rate", rate(F.col("raw") - F.col("retained"), F.col("raw")))


def tallied_filter_families(found: DataFrame) -> DataFrame:
    """``filter_families`` over tallies."""
    gone = found.where("in_registry and not supported")
    return gone.groupBy("family").agg(F.sum("n").alias("unsupported"), F.sum(F.col("n") - F.col("primaries")).alias("filtered"))


def invariants(found: DataFrame) -> DataFrame:
    """Counts of labels that break a rule; all zero in sound data."""
    arrays = factor_arrays(found)
    sizes = [F.size(f"factor_{s}") for s in STATES]
    wrong = F.size("factor_constraint_ids") != F.size("factor_types")
    for n in sizes:
        wrong = wrong | (n != F.size("factor_types"))
    a = arrays.agg(F.count("*").alias("records"), count_if(wrong).alias("unequal"), count_if(F.size("factor_types") == 0).alias("empty"))
    b = found.agg(
        F.count("*").alias("factors"),
        count_if((F.col("satisfied_pre") == 1) & ~F.col("checkable_pre")).alias("satisfied_unchecked_pre"),
        count_if((F.col("satisfied_post") == 1) & ~F.col("checkable_post")).alias("satisfied_unchecked_post"),
        count_if(F.col("type_index") < -1).alias("type_out_of_range"),
        (F.count_distinct("violation_id") - F.count_distinct(F.when(F.col("is_primary"), F.col("violation_id")))).alias("without_primary"),
    )
    return a.crossJoin(b)  # one row each
