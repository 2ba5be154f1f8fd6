"""Baselines: predictions of six slots (added triple, deleted triple) in placeholder ids, fitted by aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = ("add_s", "add_p", "add_o", "del_s", "del_p", "del_o")
EDIT = ("add_subject", "add_predicate", "add_object", "del_subject", "del_predicate", "del_object")


def _slots(values: list[Column | int]) -> list[Column]:
    return [(v if isinstance(v, Column) else F.lit(v)).cast("long").alias(n) for v, n in zip(values, SLOTS, strict=True)]


def gold(records: DataFrame) -> DataFrame:
    return records.select("violation_id", "constraint_type", "constraint_id", *_slots([F.coalesce(F.col(c), F.lit(0)) for c in EDIT]))


def delete_focus(records: DataFrame) -> DataFrame:
    return records.select("violation_id", *_slots([0, 0, 0, 1, 2, 3]))


def add_mirror(records: DataFrame, inverse: DataFrame) -> DataFrame:
    """For inverse and symmetric records adds (object, p', subject); p' is the inverse (property, inverse) or the predicate."""
    found = records.join(inverse.withColumnRenamed("property", "of"), F.col("predicate") == F.col("of"), "left")
    mirrored = F.col("constraint_type").isin("inverse", "symmetric")
    back = F.when(F.col("constraint_type") == "symmetric", F.lit(2)).otherwise(F.coalesce("inverse", F.lit(2)))
    values = [F.when(mirrored, v).otherwise(0) for v in (F.lit(3), back, F.lit(1))]
    return found.select("violation_id", *_slots([*values, 0, 0, 0]))


def fit_majority(train: DataFrame, key: str) -> DataFrame:
    """(key, slots): the mode of each slot, of equals the smaller id; the key null holds the mode over all keys."""
    slots = F.array(*(F.struct(F.lit(n).alias("slot"), F.coalesce(F.col(c), F.lit(0).cast("long")).alias("value")) for n, c in zip(SLOTS, EDIT, strict=True)))
    counts = train.select(F.col(key).alias("key"), F.explode(slots).alias("x")).groupBy("key", "x.slot", "x.value").agg(F.count("*").alias("n"))
    whole = counts.groupBy("slot", "value").agg(F.sum("n").alias("n")).select(F.lit(None).cast(train.schema[key].dataType).alias("key"), "slot", "value", "n")
    modes = counts.unionByName(whole).groupBy("key", "slot").agg(F.max_by("value", F.struct("n", -F.col("value"))).alias("mode"))
    return modes.groupBy("key").agg(*(F.max(F.when(F.col("slot") == n, F.col("mode"))).alias(n) for n in SLOTS))


def predict_majority(records: DataFrame, fitted: DataFrame, key: str) -> DataFrame:
    """The modes of the record's key; of a key that wasn't seen, those over all keys (one row)."""
    known = fitted.where("key is not null").select(F.col("key").alias("k"), *SLOTS)
    whole = fitted.where("key is null").select(*(F.col(n).alias(f"g_{n}") for n in SLOTS))
    found = records.select("violation_id", F.col(key).alias("wanted")).join(known, F.col("wanted") == F.col("k"), "left").crossJoin(F.broadcast(whole))
    return found.select("violation_id", *(F.coalesce(n, f"g_{n}").alias(n) for n in SLOTS))


def suite(records: DataFrame, inverse: DataFrame) -> DataFrame:
    """All baselines as one table with their names; majorities are fitted on the training split."""
    train = records.where("split = 'train'")
    parts = {
        "delete_focus": delete_focus(records), "add_mirror": add_mirror(records, inverse),
        "majority_definition": predict_majority(records, fit_majority(train, "constraint_id"), "constraint_id"),
        "majority_family": predict_majority(records, fit_majority(train, "constraint_type"), "constraint_type"),
    }
    return reduce(DataFrame.unionByName, (p.withColumn("baseline", F.lit(n)) for n, p in parts.items()))


def predictions(records: DataFrame) -> DataFrame:
    """(variant, violation_id, slots): stand-ins for a model's output, made from the records by rule.

    normal: the historical edit, but delete-focus for every fifth record; in the variant ``none`` every third record
    deletes the focus, in ``primary`` every third does nothing.
    """
    variants = F.explode(F.array(*map(F.lit, ("normal", "none", "primary")))).alias("variant")
    rows = gold(records).select("*", variants)
    third = (F.col("variant") != "normal") & (F.col("violation_id") % 3 == 0)
    focus = F.when(third, F.col("variant") == "none").otherwise(F.col("violation_id") % 5 == 0)
    nothing = third & (F.col("variant") == "primary")
    out = [F.when(nothing, 0).when(focus, f).otherwise(F.col(n)).cast("long").alias(n) for n, f in zip(SLOTS, (0, 0, 0, 1, 2, 3), strict=True)]
    return rows.select("variant", "violation_id", *out)
