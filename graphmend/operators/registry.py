"""Constraint registry: entries, families, compiled instances, closures over a record's properties."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Families with a checker.
SUPPORTED = (
    "conflictWith", "distinct", "inverse", "itemRequiresStatement", "oneOf", "single", "symmetric", "type",
    "valueRequiresStatement", "valueType",
)
#: Type items of the families.
TYPE_ITEMS = {
    "Q21502838": "conflictWith", "Q21502410": "distinct", "Q21510855": "inverse", "Q21503247": "itemRequiresStatement",
    "Q21510859": "oneOf", "Q19474404": "single", "Q21510862": "symmetric", "Q21503250": "type",
    "Q21510864": "valueRequiresStatement", "Q21510865": "valueType",
}
#: Ids of the default relations in the adapter: instance of, subclass of.
DEFAULT_RELATIONS = (106, 110)
#: Places and ids of a property index that a plan may hold: some 10 MB.
INDEX_MOST = 1 << 18
#: Entries with a checker, and values of one, that rules are written out for.
RULES_MOST, VALUES_MOST = 64, 256
#: Constraints with a checker that a mask has bits for.
BITS = 64


def is_property(value: Column) -> Column:
    """Integer property ids of the adapter; values from 1000 on are items."""
    return value.between(100, 999)


def local_properties() -> Column:
    """P_local: the main and other predicate and every neighbouring one, without 0."""
    every = F.concat(
        F.array("predicate", "other_predicate"),
        *(F.coalesce(F.col(c), F.array().cast("array<bigint>")) for c in ("subject_predicates", "object_predicates", "other_entity_predicates")),
    )
    return F.filter(F.array_distinct(every), lambda p: p.isNotNull() & (p != 0))


def property_index(definitions: DataFrame) -> DataFrame:
    """(property, constraint_ids), ids sorted."""
    return definitions.groupBy("property").agg(F.array_sort(F.collect_set("constraint_id")).alias("constraint_ids"))


@dataclass(frozen=True)
class PropertyIndex:
    """A property index as a constant of plans: at each property's distance from the lowest, its constraints' ids; and at each
    constraint's distance from the lowest, its property (empty where a constraint has several, or places are too many)."""

    low: int
    places: str
    own_low: int = 0
    own: str = ""

    @staticmethod
    def of(definitions: DataFrame, most: int = INDEX_MOST) -> PropertyIndex | None:
        """None where there are more than ``most`` places or ids."""
        index = property_index(definitions).where("property is not null")
        size = index.agg(F.min("property").alias("low"), F.max("property").alias("high"), F.sum(F.size("constraint_ids")).alias("ids")).first()
        if size.low is None or size.high - size.low >= most or size.ids > most:
            return None
        ids = {r["property"]: r.constraint_ids for r in index.collect()}
        places = json.dumps([ids.get(p) for p in range(size.low, size.high + 1)])
        named = [(c, p) for p, held in ids.items() for c in held]
        own = dict(named)
        if len(own) < len(named) or max(own) - min(own) >= most or definitions.where("property is null").limit(1).count():
            return PropertyIndex(size.low, places)
        return PropertyIndex(size.low, places, min(own), json.dumps([own.get(c) for c in range(min(own), max(own) + 1)]))

    def constrained(self, constraint: Column) -> Column:
        """The property of a constraint."""
        own = F.from_json(F.lit(self.own), "array<bigint>")
        return F.when(constraint >= self.own_low, F.get(own, (constraint - self.own_low).cast("int")))

    def ids(self, p: Column) -> Column:
        places = F.from_json(F.lit(self.places), "array<array<bigint>>")
        return F.when(p >= self.low, F.get(places, (p - self.low).cast("int")))


#: What checks read of an instance.
INSTANCE = (
    "family string, supported boolean, type_index bigint, property bigint, required array<bigint>, items array<bigint>, classes array<bigint>, "
    "relations array<bigint>, inverses array<bigint>, conflicts array<bigint>"
)


ENTRIES = f"array<struct<{INSTANCE.replace(' ', ':').replace(',:', ', ')}>>"


@dataclass(frozen=True)
class Catalog:
    """Instances, and the same as constants of plans: of each id the number of its entry, entries without repeats.

    Entries with a checker come first, and constraints without one are told apart by family alone, so there are few. Without
    the constants (a registry over ``INDEX_MOST`` places or values) instances are joined by id.
    """

    instances: DataFrame
    low: int = 0
    numbers: str = ""
    entries: str = ""
    supported: int = 0

    @staticmethod
    def of(instances: DataFrame, most: int = INDEX_MOST) -> Catalog:
        lists = ("required", "items", "classes", "relations", "inverses", "conflicts")
        values = sum((F.size(c) for c in lists), F.lit(0))
        size = instances.agg(F.min("constraint_id").alias("low"), F.max("constraint_id").alias("high"), F.sum(F.when(F.col("supported"), values)).alias("values")).first()
        if size.low is None or size.high - size.low >= most or (size["values"] or 0) > most:
            return Catalog(instances)
        told = ("family", "supported", "type_index", *(F.when(F.col("supported"), F.col(c)).alias(c) for c in ("property", *lists)))
        numbers: list[int | None] = [None] * (size.high - size.low + 1)
        entries: dict[str, int] = {}
        for r in sorted(instances.select("constraint_id", *told).collect(), key=lambda r: not r.supported):
            entry = {k: v for k, v in r.asDict().items() if k != "constraint_id"}
            numbers[r.constraint_id - size.low] = entries.setdefault(json.dumps(entry), len(entries))
        return Catalog(instances, size.low, json.dumps(numbers), f"[{','.join(entries)}]", sum(json.loads(e)["supported"] for e in entries))

    def number(self, constraint: Column) -> Column:
        """Of its entry; -1 outside the registry."""
        numbers = F.from_json(F.lit(self.numbers), "array<int>")
        return F.coalesce(F.when(constraint >= self.low, F.get(numbers, (constraint - self.low).cast("int"))), F.lit(-1))

    def entry(self, number: Column) -> Column:
        """The instance's struct; null for -1."""
        return F.get(F.from_json(F.lit(self.entries), ENTRIES), number)

    def kinds(self) -> list[tuple[str, bool]]:
        """(family, supported) of the entries, without repeats, those with a checker first."""
        return list(dict.fromkeys((e["family"], e["supported"]) for e in json.loads(self.entries)))

    def kind(self, constraint: Column) -> Column:
        """The place among ``kinds`` of a constraint's entry; -1 outside the registry."""
        places = {k: i for i, k in enumerate(self.kinds())}
        held = [places[e["family"], e["supported"]] for e in json.loads(self.entries)]
        of = F.from_json(F.lit(json.dumps([None if n is None else held[n] for n in json.loads(self.numbers)])), "array<int>")
        return F.coalesce(F.when(constraint >= self.low, F.get(of, (constraint - self.low).cast("int"))), F.lit(-1))

    def told(self, kind: Column) -> tuple[Column, Column, Column]:
        """The family (null outside the registry), ``supported`` and ``in_registry`` of a kind."""
        families, supported = [f for f, _ in self.kinds()], sum(s for _, s in self.kinds())
        family = F.when(kind >= 0, F.get(F.from_json(F.lit(json.dumps(families)), "array<string>"), kind))
        return family.alias("family"), kind.between(0, supported - 1).alias("supported"), (kind >= 0).alias("in_registry")

    def checked(self) -> list[dict]:
        """The entries with a checker where rules can be written out for each of them, otherwise none."""
        if not 0 < self.supported <= RULES_MOST:
            return []
        found = json.loads(self.entries)[: self.supported]
        sizes = (max(len(e["items"]), sum(len(e[c]) for c in ("required", "inverses", "conflicts")) + len(e["relations"]) * len(e["classes"])) for e in found)
        return found if all(e["family"] in SUPPORTED for e in found) and max(sizes) <= VALUES_MOST else []

    def bits(self) -> list[tuple[int, int]]:
        """(constraint_id, number of its entry) of the constraints with a checker where a mask has a bit for each, otherwise none."""
        if not self.checked():
            return []
        found = [(self.low + i, n) for i, n in enumerate(json.loads(self.numbers)) if n is not None and n < self.supported]
        return found if len(found) <= BITS else []

    def entry_sql(self, number: str) -> str:
        return f"get(from_json('{self.entries}', '{ENTRIES}'), {number})"


def with_closures(records: DataFrame, definitions: DataFrame, most: int = INDEX_MOST, index: PropertyIndex | None = None) -> DataFrame:
    """Adds ``local_constraint_ids`` and ``local_constraint_ids_focus``: sorted, unique, the own id included.

    The index from property to constraints (made here unless it is given) is part of the plan where it has at most
    ``most`` places and ids, so records stay where they are. A larger one is joined by property, and records are regrouped
    by their id.
    """
    index = index or PropertyIndex.of(definitions, most)
    if index and index.own:
        known = records.withColumn("constrained", index.constrained(F.col("constraint_id")))
    else:
        own = definitions.select(F.col("constraint_id").alias("own"), F.col("property").alias("constrained")).distinct()
        known = records.join(own, F.col("constraint_id") == F.col("own"), "left")
    focus = F.filter(F.array_distinct(F.array("predicate", "other_predicate", F.coalesce("constrained", F.lit(0).cast("long")))), lambda p: p != 0)
    keyed = known.withColumns({"p_local": local_properties(), "p_focus": focus})
    if index:
        found = keyed.withColumns({c: F.flatten(F.array_compact(F.transform(f"p_{c}", index.ids))) for c in ("local", "focus")})
    else:
        found = keyed.join(_regrouped(keyed, property_index(definitions)), "violation_id", "left")
    none = F.array().cast("array<bigint>")
    # Sorted without a comparator that is interpreted for each pair; a null own id stays, at the end.
    own = F.array_compact(F.array("constraint_id"))
    known_ids = lambda c: F.sort_array(F.array_distinct(F.concat(F.coalesce(F.col(c), none), own)))
    closed = lambda c: F.concat(known_ids(c), F.when(F.col("constraint_id").isNull(), F.array("constraint_id")).otherwise(none))
    return found.select(*records.columns, closed("local").alias("local_constraint_ids"), closed("focus").alias("local_constraint_ids_focus"))


def _regrouped(keyed: DataFrame, index: DataFrame) -> DataFrame:
    narrow = keyed.select("violation_id", "p_focus", F.explode(F.array_union("p_local", "p_focus")).alias("property"), "p_local")
    found = narrow.join(index, "property").select(
        "violation_id",
        F.when(F.array_contains("p_local", F.col("property")), F.col("constraint_ids")).alias("local"),
        F.when(F.array_contains("p_focus", F.col("property")), F.col("constraint_ids")).alias("focus"),
    )
    return found.groupBy("violation_id").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("local", "focus")))


def registry(definitions: DataFrame) -> DataFrame:
    """(constraint_id, family, supported, property, type_index, parameters): entries only for known families."""
    entries = definitions.where("family is not null").groupBy("constraint_id", "family", "property").agg(
        F.array_sort(F.collect_list(F.when(F.col("parameter").isNotNull(), F.struct("parameter", "value")))).alias("parameters")
    )
    return entries.join(type_index(entries), "family").select(
        "constraint_id", "family", F.col("family").isin(*SUPPORTED).alias("supported"), "property", "type_index", "parameters"
    )


def type_index(entries: DataFrame, item: str = "family") -> DataFrame:
    """(item, type_index): dense numbers from 0 by item; a blank item has -1. As many rows as types."""
    known = entries.select(item).where(F.trim(item) != "").distinct()
    numbered = known.withColumn("type_index", (F.row_number().over(Window.orderBy(item)) - 1).cast("long"))
    blank = entries.select(item).where(F.trim(item) == "").distinct().withColumn("type_index", F.lit(-1).cast("long"))
    return numbered.unionByName(blank)


def missing_items(entries: DataFrame, item: str = "type_item") -> DataFrame:
    """(type_item, entries): items that definitions use and the catalog of families lacks."""
    unknown = entries.where((F.col(item) != "") & ~F.col(item).isin(*TYPE_ITEMS))
    return unknown.groupBy(F.col(item).alias("type_item")).agg(F.count("*").alias("entries"))


def item_frequencies(entries: DataFrame) -> DataFrame:
    """(type_item, family, entries): by item (family "all") and by item and family."""
    sums = entries.rollup("type_item", "family").agg(F.count("*").alias("entries"), F.grouping("type_item").alias("top"), F.grouping("family").alias("whole"))
    return sums.where("top = 0").select("type_item", F.when(F.col("whole") == 1, "all").otherwise(F.col("family")).alias("family"), "entries")


def type_qid(value: Column) -> Column:
    """The Q-id that a raw type item names; null if none."""
    return F.nullif(F.regexp_extract(F.trim(F.regexp_replace(F.trim(value), "^<(.*)>$", "$1")), "^(?:http://www\\.wikidata\\.org/entity/)?(Q[0-9]+)$", 1), F.lit(""))


def family_name(label: Column) -> Column:
    """A label as a family name: letters and digits only, first word lower, others capitalised, joined."""
    clean = F.trim(F.lower(F.regexp_replace(label, "[^\\p{L}\\p{N}\\s]", "")))
    words = F.split(clean, "\\s+")
    joined = F.array_join(F.concat(F.slice(words, 1, 1), F.transform(F.slice(words, 2, 1000), F.initcap)), "")
    return F.when(clean == "", "unsupported").otherwise(joined)


def instances(definitions: DataFrame, default_relations: tuple[int, ...] = DEFAULT_RELATIONS) -> DataFrame:
    """Registry entries with typed parameter sets: required, items, classes, relations, inverses, conflicts.

    Every property-shaped parameter joins the conflicts, whatever its kind.
    """
    entries = registry(definitions)

    def values(kind: str | None, properties: bool) -> Column:
        keep = lambda x: (x["parameter"] == kind if kind else F.lit(True)) & (is_property(x["value"]) if properties else F.lit(True))
        return F.array_distinct(F.transform(F.filter("parameters", keep), lambda x: x["value"]))

    relations = values("P2309", True)
    inverses = values("P1696", True)
    fallback = F.array(*(F.lit(r).cast("long") for r in default_relations))
    return entries.select(
        "constraint_id", "family", "supported", "property", "type_index", values("P2306", True).alias("required"),
        values("P2305", False).alias("items"), values("P2308", False).alias("classes"),
        F.when(F.size(relations) == 0, fallback).otherwise(relations).alias("relations"),
        F.when(F.size(inverses) == 0, F.array("property")).otherwise(inverses).alias("inverses"),
        values(None, True).alias("conflicts"),
    )
