"""Violation records: the schema, readers, and the adapter that derives records from the star-schema tables.

One record is a violated constraint, its triple, facts of the entities around it and the historical edit. Ids are
integers, 0 is "absent"; lists are never null after reading.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Role placeholders 1 to 6, then reserved tokens.
ROLES = ("subject", "predicate", "object", "other_subject", "other_predicate", "other_object")
LITERAL, UNKNOWN = 7, 8
EDIT = ("add_subject", "add_predicate", "add_object", "del_subject", "del_predicate", "del_object")
SCALARS = ("constraint_id", *ROLES, *EDIT)
LISTS = (
    "constraint_predicates", "constraint_objects", "subject_predicates", "subject_objects", "object_predicates",
    "object_objects", "other_entity_predicates", "other_entity_objects", "local_constraint_ids", "local_constraint_ids_focus",
)
#: Violated families by order number.
FAMILIES = (
    "conflictWith", "distinct", "inverse", "itemRequiresStatement", "oneOf", "single", "type", "valueRequiresStatement", "valueType",
)
#: Fixed values of the adapter: filler constraints on property 130 + j.
FILLERS = (0, 30, 60, 80, 93, 130, 200, 300)
#: Fixed values of the adapter: (id, family, property, parameter, value).
DEFINITIONS = (
    (501, "conflictWith", 101, "P2306", 103), (502, "distinct", 101, None, None), (503, "inverse", 101, "P1696", 109),
    (504, "itemRequiresStatement", 101, "P2306", 102), (506, "single", 101, None, None), (507, "type", 101, "P2308", 9001),
    (507, "type", 101, "P2309", 106), (508, "valueRequiresStatement", 101, "P2306", 109), (509, "valueType", 101, "P2308", 9002),
    (509, "valueType", 101, "P2309", 106), (510, "single", 102, None, None), (511, "itemRequiresStatement", 103, "P2306", 102),
    (512, "symmetric", 101, None, None), (513, "unsupported:QX", 105, None, None), (514, "type", 104, "P2308", 9002),
    (515, "conflictWith", 104, "P2306", 105), (599, None, 106, None, None),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, dealt out while its rows are still narrow; others as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def long(value: int) -> Column:
    return F.lit(value).cast("long")


def definitions(spark: SparkSession) -> DataFrame:
    """(constraint_id, family, property, parameter, value), a row per parameter; family is null where no registry has it."""
    fixed = spark.createDataFrame(list(DEFINITIONS), "constraint_id long, family string, property long, parameter string, value long")
    items = spark.range(50).select(
        long(505).alias("constraint_id"), F.lit("oneOf").alias("family"), long(101).alias("property"),
        F.lit("P2305").alias("parameter"), (F.col("id") + 2_000_000_000).alias("value"),
    )
    j = F.explode(F.array(*(F.struct(long(i).alias("j"), long(n).alias("n")) for i, n in enumerate(FILLERS) if n))).alias("f")
    filler = spark.range(1).select(j).select("f.j", F.explode(F.sequence(long(1), F.col("f.n"))).alias("i"))
    filler = filler.select(
        (1000 * (F.col("j") + 1) + F.col("i")).alias("constraint_id"), F.lit("unsupported:QF").alias("family"),
        (130 + F.col("j")).alias("property"), F.lit(None).cast("string").alias("parameter"), F.lit(None).cast("long").alias("value"),
    )
    return fixed.unionByName(items).unionByName(filler)


def _facts(*parts: tuple[str, object, object]) -> str:
    """SQL of an array of (p, o) facts, those whose condition holds."""
    made = (f"if({c}, named_struct('p', cast({p} as bigint), 'o', cast({o} as bigint)), null)" for c, p, o in parts)
    return f"array_compact(array({', '.join(made)}))"


def _edit() -> list[str]:
    """SQL of the six edit slots, in placeholder ids, by the number of the family."""
    cases = {
        0: (0, 0, 0, 4, 5, 6), 1: (0, 0, 0, 1, 2, 3), 2: (3, 109, 1, 0, 0, 0), 3: (1, 102, 8079, 0, 0, 0),
        4: (1, 2, "2000000000 + ck % 50", 1, 2, 3), 5: (0, 0, 0, "if(q % 2 = 0, 4, 1)", "if(q % 2 = 0, 5, 2)", "if(q % 2 = 0, 6, 3)"),
        6: (1, 106, 9001, 0, 0, 0), 7: (3, 109, 1, 0, 0, 0), 8: (3, 106, 9002, 0, 0, 0),
    }
    pick = lambda i: " ".join(f"when {k} then {slots[i]}" for k, slots in cases.items())
    return [f"cast(if(q % 11 = 10, 0, case k {pick(i)} end) as bigint)" for i in range(6)]


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per order (rules in the fixtures' description), without the constraint closures."""
    orders, customer = spread(table(spark, sf_dir, "orders")), table(spark, sf_dir, "customer")
    counts = orders.agg(F.count("*").alias("no")).crossJoin(customer.agg(F.count("*").alias("nc")))  # one row
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).crossJoin(F.broadcast(counts)).selectExpr(
        "o_orderkey as violation_id", "o_orderkey % 9 as k", "o_orderkey div 9 as q", "o_custkey as ck", "o_orderkey + 1000000000 as s",
        "o_custkey + 2000000000 as o", "(o_orderkey + 1) % no + 1000000000 as s2", "(o_custkey + 1) % nc + 2000000000 as ob2",
        "ascii(o_orderstatus) + 8000L as status", "cast(substring(o_orderpriority, 1, 1) as bigint) + 8200 as pr",
        "cast(c_nationkey as bigint) + 3000000000 as nation", "ascii(c_mktsegment) + 8300L as segment", "c_acctbal >= 0 as good",
    )
    subject = _facts(
        ("q % 7 <> 6", 101, "o"), ("q % 5 <> 4", 102, "status"), ("q % 6 <> 5", 103, "pr"), ("q % 4 <> 0", 106, 9001),
        ("q % 8 = 0", 106, 9003), ("q % 6 = 2", 109, "s2"), ("k = 5", 101, "ob2"),
    )
    object_ = _facts(
        ("true", 104, "nation"), ("ck % 4 <> 0", 105, "segment"), ("good", 106, 9002), ("not good and ck % 2 = 0", 106, 9003),
        ("q % 3 = 0", 109, "s"), ("q % 3 = 1", 109, "s2"), ("ck % 3 = 0", 102, 8079), ("true", "130 + ck % 8", 7000),
    )
    own = _facts(
        ("k = 0 and q % 2 = 1", 106, 9004), ("k = 1", 101, "o"), ("k = 1", 106, 9001), ("k = 5 and q % 2 = 1", 104, 3_000_000_000),
    )
    rows = rows.selectExpr("*", f"{subject} as subject_facts", f"{object_} as object_facts").selectExpr(
        "*", f"if(k in (0, 5) and q % 2 = 0, subject_facts, {own}) as other_facts"
    )
    families = " ".join(f"when {k} then '{f}'" for k, f in enumerate(FAMILIES))
    lists = [
        f"transform({facts}_facts, x -> x.{part[0]}) as {role}_{name}"
        for facts, role in (("subject", "subject"), ("object", "object"), ("other", "other_entity"))
        for part, name in (("p", "predicates"), ("o", "objects"))
    ]
    return rows.selectExpr(
        "violation_id", "case when violation_id % 20 < 14 then 'train' when violation_id % 20 < 17 then 'val' else 'test' end as split",
        f"case k {families} end as constraint_type", "k + 501 as constraint_id", "s as subject", "101L as predicate", "o as object",
        "case k when 0 then s when 1 then s2 when 5 then s else 0L end as other_subject",
        "case k when 0 then 103L when 1 then 101L when 5 then 101L else 0L end as other_predicate",
        "case k when 0 then pr when 1 then o when 5 then ob2 else 0L end as other_object",
        *(f"{slot} as {name}" for slot, name in zip(_edit(), EDIT, strict=True)), *lists,
    )


_KEPT: dict[str, object] = {}


def property_index(spark: SparkSession):
    """The adapter's index; its definitions are fixed values, so one a process is enough."""
    from graphmend.operators.registry import PropertyIndex

    if "index" not in _KEPT:
        _KEPT["index"] = PropertyIndex.of(definitions(spark))
    return _KEPT["index"]


def catalog(spark: SparkSession):
    """The adapter's instances, also as constants of plans; made once a process."""
    from graphmend.operators.registry import Catalog, instances

    known = instances(definitions(spark))
    if "catalog" not in _KEPT:
        _KEPT["catalog"] = Catalog.of(known)
    return replace(_KEPT["catalog"], instances=known)


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records from orders with both closures; no Spark job runs here once the index is made."""
    from graphmend.operators.registry import with_closures

    return with_closures(from_orders(spark, sf_dir), definitions(spark), index=property_index(spark))
