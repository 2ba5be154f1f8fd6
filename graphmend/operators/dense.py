"""Records as graphs over the numbers 0 .. n - 1: nodes are numbered in the record's row, by the place of their first use.

The first use of an entity gives it the next number; predicates, factors and parameter predicates are nodes of their own at
each use. Facts come first, then each factor in attached order with its parameters. No window and no exchange.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import LITERAL, UNKNOWN
from .labels import attached_ids
from .registry import INDEX_MOST, Catalog

#: What a step of the fold adds: a fact (subject, predicate, object), a factor, a parameter of the last factor.
FACT, FACTOR, PARAMETER = 0, 1, 2
STEP = "array<struct<kind:int,s:bigint,p:bigint,o:bigint>>"


def even(predicates: Column, objects: Column) -> Column:
    """Pairs of two lists; a list of one element is repeated to the length of the other, an empty list gives no pairs."""
    ps, os_ = (F.coalesce(c, F.array().cast("array<bigint>")) for c in (predicates, objects))
    n = F.greatest(F.size(ps), F.size(os_))
    whole = lambda c: F.when(F.size(c) == 1, F.flatten(F.array_repeat(c, n))).otherwise(c)
    pairs = F.arrays_zip(whole(ps).alias("p"), whole(os_).alias("o"))
    return F.when((F.size(ps) == 0) | (F.size(os_) == 0), F.array().cast("array<struct<p:bigint,o:bigint>>")).otherwise(pairs)


def fact_steps(records: DataFrame) -> Column:
    """Facts in order: focus, other triple, neighbours of subject, object and the other entity.

    A missing id is the unknown node, or the literal node where the record has a text for it.
    """
    c = F.col
    text = lambda name: F.coalesce(c(name), F.lit("")) != "" if name in records.columns else F.lit(False)
    known = lambda x, name="": F.when(x != 0, x).when(text(name) if name else F.lit(False), F.lit(LITERAL)).otherwise(F.lit(UNKNOWN)).cast("long")
    step = lambda s, p, o: F.struct(F.lit(FACT).alias("kind"), s.alias("s"), p.alias("p"), o.alias("o"))
    none = F.array().cast(STEP)
    other = F.when(c("other_subject") == c("subject"), c("other_object")).when(c("other_object") == c("object"), c("other_subject")).otherwise(F.lit(0).cast("long"))

    def many(entity: Column, name: str, text_name: str = "") -> Column:
        return F.transform(even(c(f"{name}_predicates"), c(f"{name}_objects")), lambda x: step(known(entity, text_name), known(x["p"]), known(x["o"])))

    whole = lambda s, p, o: (c(o) != 0) | text(f"{o}_text")
    one = lambda s, p, o: F.when(whole(s, p, o), F.array(step(known(c(s)), known(c(p)), known(c(o), f"{o}_text")))).otherwise(none)
    return F.concat(
        one("subject", "predicate", "object"), one("other_subject", "other_predicate", "other_object"), many(c("subject"), "subject"),
        many(c("object"), "object", "object_text"), F.when(other != 0, many(other, "other_entity")).otherwise(none),
    )


def factor_steps(factors: DataFrame, parameters: DataFrame) -> DataFrame:
    """(violation_id, factors): steps of each factor in attached order, its parameters behind it by predicate and value.

    ``factors`` is (violation_id, position, constraint_id), ``parameters`` (constraint_id, p, o).
    """
    lists = parameters.groupBy("constraint_id").agg(F.array_sort(F.collect_list(F.struct(F.lit(PARAMETER).alias("kind"), F.lit(0).cast("long").alias("s"), "p", "o"))).alias("more"))
    own = F.struct(F.lit(FACTOR).alias("kind"), F.col("constraint_id").alias("s"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("o"))
    each = factors.join(lists, "constraint_id", "left").select("violation_id", "position", F.concat(F.array(own), F.coalesce(_from_one("more"), F.array().cast(STEP))).alias("steps"))
    rows = each.groupBy("violation_id").agg(F.array_sort(F.collect_list(F.struct("position", "steps"))).alias("x"))
    return rows.select("violation_id", F.flatten(F.transform("x", lambda x: x["steps"])).alias("factors"))


def _from_one(parameters: str) -> Column:
    """Parameters of a factor with their distance from the factor's step as s."""
    return F.transform(parameters, lambda x, i: F.struct(x["kind"].alias("kind"), (i + 1).cast("long").alias("s"), x["p"].alias("p"), x["o"].alias("o")))


def held_factors(records: DataFrame, known: Catalog, parameters: DataFrame, scope: str = "local", most: int = INDEX_MOST) -> DataFrame:
    """Records with ``factors``, the steps of ``factor_steps`` for attached constraints with a checker: looked up in the row,
    without verdicts, joins or exchanges. A catalog or parameters that plans can't hold are joined."""
    supported = known.instances.where("supported").select("constraint_id")
    wanted = parameters.join(supported, "constraint_id", "left_semi")
    if not known.entries or wanted.limit(most + 1).count() > most:
        each = records.select("violation_id", F.posexplode(attached_ids(scope)).alias("position", "constraint_id")).join(supported, "constraint_id")
        made = factor_steps(each, parameters)
        return records.join(made, "violation_id", "left").withColumn("factors", F.coalesce("factors", F.array().cast(STEP)))
    held: dict[int, list] = {r.constraint_id: [{"kind": FACTOR, "s": r.constraint_id, "p": 0, "o": 0}] for r in supported.collect()}
    for r in sorted(wanted.collect(), key=lambda r: (r.constraint_id, r.p, r.o)):
        held[r.constraint_id].append({"kind": PARAMETER, "s": len(held[r.constraint_id]), "p": r.p, "o": r.o})
    places = {c: i for i, c in enumerate(held)}
    numbers = F.from_json(F.lit(json.dumps([places.get(known.low + i) for i in range(len(json.loads(known.numbers)))])), "array<int>")
    steps = F.from_json(F.lit(json.dumps(list(held.values()))), f"array<{STEP}>")
    at = lambda x: F.when(x >= known.low, F.get(numbers, (x - known.low).cast("int")))
    return records.withColumn("factors", F.flatten(F.transform(F.array_compact(F.transform(attached_ids(scope), at)), lambda n: F.get(steps, n))))


#: The key of a node that only step i uses: below every id.
_OWN = "(-9223372036854775807L + i)"
#: Keys of the nodes that steps use, in order; the first use of a key makes its node.
_KEYS = f"""flatten(transform(steps, (t, i) -> case t.kind when {FACT} then array(t.s, {_OWN}, t.o) when {FACTOR} then array({_OWN}) else array({_OWN}, t.o) end))"""
_AT = "try_element_at(numbers, {})".format
#: A parameter's s is its distance from its factor's step.
_PATHS = f"""transform(steps, (t, i) -> if(t.kind = {FACTOR},
  named_struct('kind', t.kind, 'id', t.s, 's', {_AT(_OWN)}, 'p', -1, 'o', -1),
  named_struct('kind', t.kind, 'id', t.p, 's', {_AT(f"if(t.kind = {FACT}, t.s, {_OWN} - t.s)")}, 'p', {_AT(_OWN)}, 'o', {_AT('t.o')})))"""


def numbered(records: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """(violation_id, nodes, paths): how many nodes a record has, and its paths (kind, id, s, p, o) in their numbers.

    A fact or parameter is a path s - p - o of predicate ``id``; a factor is one node s of constraint ``id``. ``factors``
    comes from ``factor_steps``; records may hold them already (``held_factors``).
    """
    rows = records.withColumn("steps", fact_steps(records))
    if factors is not None:
        rows = rows.join(factors, "violation_id", "left").withColumn("steps", F.concat("steps", F.coalesce("factors", F.array().cast(STEP))))
    elif "factors" in records.columns:
        rows = rows.withColumn("steps", F.concat("steps", "factors"))
    rows = rows.select("violation_id", "steps").withColumn("keys", F.array_distinct(F.expr(_KEYS)))
    rows = rows.withColumn("numbers", F.map_from_arrays("keys", F.transform("keys", lambda _, i: i)))
    return rows.select("violation_id", F.size("keys").alias("nodes"), F.expr(_PATHS).alias("paths"))
