"""Fidelity, repair outcomes and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .baselines import SLOTS
from .labels import rate


def triple(values: list[Column]) -> Column:
    """A struct of three ids; null unless all are there."""
    s, p, o = values
    return F.when((s != 0) & (p != 0) & (o != 0), F.struct(s.alias("s"), p.alias("p"), o.alias("o")))


def by_action(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(violation_id, constraint_type, action, predicted, gold): two rows a record."""
    named = gold.select("violation_id", "constraint_type", *(F.col(n).alias(f"g_{n}") for n in SLOTS))
    rows = predicted.join(named, "violation_id")
    acts = F.array(
        *(
            F.struct(F.lit(a).alias("action"), triple([F.col(f"{a}_{x}") for x in "spo"]).alias("predicted"), triple([F.col(f"g_{a}_{x}") for x in "spo"]).alias("gold"))
            for a in ("add", "del")
        )
    )
    others = [c for c in predicted.columns if c not in ("violation_id", *SLOTS)]
    return rows.select(*others, "violation_id", "constraint_type", F.explode(acts).alias("x")).select(*others, "violation_id", "constraint_type", "x.*")


def prf(rows: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = rate(tp, tp + fp), rate(tp, tp + fn)
    return rows.withColumns({"precision": p, "recall": r, "f1": rate(2 * tp, 2 * tp + fp + fn)})


def _hits() -> list[Column]:
    hit = F.coalesce(F.col("predicted") == F.col("gold"), F.lit(False))
    wrong = lambda x: F.col(x).isNotNull() & ~hit
    return [F.count_if(hit).alias("tp"), F.count_if(wrong("predicted")).alias("fp"), F.count_if(wrong("gold")).alias("fn")]


def fidelity(actions: DataFrame) -> DataFrame:
    """Micro figures by type and action, by type, by action and over all ("all" where summed over)."""
    sums = actions.cube("constraint_type", "action").agg(*_hits(), F.grouping("constraint_type").alias("t"), F.grouping("action").alias("a"))
    name = lambda flag, c: F.when(F.col(flag) == 1, "all").otherwise(F.col(c))
    return prf(sums.select(name("t", "constraint_type").alias("constraint_type"), name("a", "action").alias("action"), "tp", "fp", "fn"))


def macro(actions: DataFrame) -> DataFrame:
    """Per type the mean over its actions with any count; "all" is the mean of the types' micro figures."""
    per = prf(actions.groupBy("constraint_type", "action").agg(*_hits())).where("tp + fp + fn > 0")
    types = per.groupBy("constraint_type").agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")))
    micro = prf(actions.groupBy("constraint_type").agg(*_hits())).where("tp + fp + fn > 0")
    return types.unionByName(micro.agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1"))).withColumn("constraint_type", F.lit("all")))


def outcomes(actions: DataFrame, patterns: DataFrame) -> DataFrame:
    """Adds ``outcome`` to each action; ``patterns`` has the arrays ``add_patterns`` and ``del_patterns`` of a record."""
    rows = actions.join(patterns.select("violation_id", "add_patterns", "del_patterns"), "violation_id")
    held = F.when(F.col("action") == "add", F.col("add_patterns")).otherwise(F.col("del_patterns"))
    fits = lambda part, value: part.isNull() | F.array_contains(part, value)
    match = F.exists(held, lambda x: fits(x["s"], F.col("predicted.s")) & fits(x["p"], F.col("predicted.p")) & fits(x["o"], F.col("predicted.o")))
    outcome = (
        F.when(F.col("predicted").isNull(), F.when(F.col("gold").isNull(), "exact").otherwise("missing_prediction"))
        .when(F.col("predicted") == F.col("gold"), "exact").when(match, "alternative_fix").otherwise("no_fix")
    )
    return rows.withColumn("outcome", outcome).drop("add_patterns", "del_patterns")


def outcome_rates(found: DataFrame) -> DataFrame:
    """Counts and rates over all, by action, and by type and action."""
    names = ("exact", "alternative_fix", "missing_prediction", "no_fix")
    per = found.groupBy("constraint_type", "action").agg(F.count("*").alias("total"), *(F.count_if(F.col("outcome") == n).alias(n) for n in names))
    sums = per.rollup("action", "constraint_type").agg(*(F.sum(c).alias(c) for c in ("total", *names)))
    sums = sums.select(F.coalesce("constraint_type", F.lit("all")).alias("constraint_type"), F.coalesce("action", F.lit("all")).alias("action"), "total", *names)
    return sums.withColumns({f"{n}_rate": rate(F.col(n), F.col("total")) for n in names})


def primary_fix(found: DataFrame) -> DataFrame:
    """Per type: (exact + alternative) of both actions' total; both absent counts as exact."""
    good = F.count_if(F.col("outcome").isin("exact", "alternative_fix"))
    return found.groupBy("constraint_type").agg(F.count("*").alias("total"), good.alias("fixed")).withColumn("primary_fix_rate", rate(F.col("fixed"), F.col("total")))
