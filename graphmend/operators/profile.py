"""Sampling and profiling of attached constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmend.functions.ranking import half_even, ranked

from .labels import count_if, rate

#: Bins of attached counts by their last count.
BINS = ((32, "1-32"), (64, "33-64"), (83, "65-83"), (107, "84-107"), (108, "108"), (160, "109-160"), (267, "161-267"))


def attached_count(scope: str = "local") -> Column:
    ids = F.col("local_constraint_ids") if scope == "local" else F.coalesce("local_constraint_ids_focus", "local_constraint_ids")
    return F.coalesce(F.size(ids), F.lit(0)).cast("long")


def bin_label(count: Column) -> Column:
    out = F.when(count <= 0, "0")
    for last, label in BINS:
        out = out.when(count <= last, label)
    return out.otherwise("268+")


def with_bins(records: DataFrame, scope: str = "local") -> DataFrame:
    n = attached_count(scope)
    return records.select("violation_id", "split", "constraint_type", n.alias("attached"), bin_label(n).alias("bin"))


def stratified_sample(records: DataFrame, fraction: float = 0.5, seed: str = "42") -> DataFrame:
    """(violation_id, split, constraint_type, bin): of each stratum ``max(1, round(n * fraction))`` records, half to even."""
    rows = ranked(with_bins(records), ["split", "constraint_type", "bin"], "violation_id", seed)
    keep = F.least(F.col("total"), F.greatest(F.lit(1), half_even(F.col("total") * fraction)))
    return rows.where(F.col("rank") <= keep).select("violation_id", "split", "constraint_type", "bin")


def sampling_report(records: DataFrame, fraction: float = 0.5, seed: str = "42") -> DataFrame:
    keys = ["split", "constraint_type", "bin"]
    source = with_bins(records).groupBy(*keys).agg(F.count("*").alias("source"))
    kept = stratified_sample(records, fraction, seed).groupBy(*keys).agg(F.count("*").alias("sampled"))
    return source.join(kept, keys, "left").fillna(0, ["sampled"]).withColumn("realised", rate(F.col("sampled"), F.col("source")))


def histogram(records: DataFrame, scope: str = "local") -> DataFrame:
    """Records by attached count, of each split and over all ("all")."""
    counts = with_bins(records, scope).groupBy("split", "attached").agg(F.count("*").alias("n"))
    return counts.rollup("attached", "split").agg(F.sum("n").alias("records"), F.grouping("split").alias("whole"), F.grouping("attached").alias("top")).where("top = 0").select(
        F.when(F.col("whole") == 1, "all").otherwise(F.col("split")).alias("split"), "attached", "records"
    )


def summary(records: DataFrame, scope: str = "local") -> DataFrame:
    """Per split, from the cumulative histogram (a row per count): least, median, mean, 95th percentile, most."""
    counts = with_bins(records, scope).groupBy("split", "attached").agg(F.count("*").alias("n"))
    up = Window.partitionBy("split").orderBy("attached")
    counts = counts.withColumns({"upto": F.sum("n").over(up), "all": F.sum("n").over(Window.partitionBy("split"))})
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.col("attached")))
    return counts.groupBy("split").agg(
        F.min("attached").alias("least"), at(F.lit(0.5)).alias("median"), (F.sum(F.col("attached") * F.col("n")) / F.sum("n")).alias("mean"),
        at(F.lit(0.95)).alias("p95"), F.max("attached").alias("most"),
    )


def support_by_split(found: DataFrame) -> DataFrame:
    """Per split: factors and records by support, over exploded labels of all constraints."""
    s, r, p = (F.col(c) for c in ("supported", "in_registry", "is_primary"))
    rows = found.groupBy("split", "violation_id").agg(
        F.count("*").alias("n"), count_if(s).alias("good"), count_if(r & ~s).alias("bad"), count_if(~r).alias("gone"),
        F.max(p & s).alias("p_good"), F.max(p & ~r).alias("p_gone"),
        F.max(p & s & (F.col("family") != F.col("constraint_type"))).alias("p_other"),
    )
    return rows.groupBy("split").agg(
        F.count("*").alias("records"), F.sum("n").alias("factors"), F.sum("good").alias("supported"), F.sum("bad").alias("unsupported"),
        F.sum("gone").alias("missing"), count_if(F.col("good") > 0).alias("with_supported"), count_if(F.col("good") == 0).alias("without_supported"),
        count_if((F.col("good") == 0) & (F.col("bad") > 0)).alias("only_unsupported"), count_if(F.col("p_good")).alias("primary_supported"),
        count_if(F.col("p_gone")).alias("primary_missing"), count_if(F.col("p_other")).alias("primary_family_mismatch"),
    ).withColumns({"supported_rate": rate(F.col("supported"), F.col("factors")), "with_supported_rate": rate(F.col("with_supported"), F.col("records"))})


def primary_support(found: DataFrame) -> DataFrame:
    """Primary factors by type and support, and by type, family and support (family "all" where summed over)."""
    rows = found.where("is_primary").withColumn("family", F.coalesce("family", F.lit("missing_registry")))
    sums = rows.groupingSets(
        [[F.col("constraint_type"), F.col("supported")], [F.col("constraint_type"), F.col("family"), F.col("supported")]],
        F.col("constraint_type"), F.col("family"), F.col("supported"),
    ).agg(F.count("*").alias("factors"), F.grouping("family").alias("whole"))
    return sums.select("constraint_type", F.when(F.col("whole") == 1, "all").otherwise(F.col("family")).alias("family"), "supported", "factors")


def family_occurrences(found: DataFrame) -> DataFrame:
    """Per family: how often it is attached and to how many records, with the share of all attached."""
    per_record = found.where("in_registry").groupBy("family", "supported", "violation_id").agg(F.count("*").alias("n"))
    rows = per_record.groupBy("family", "supported").agg(F.sum("n").alias("occurrences"), F.count("*").alias("records"))
    total = found.agg(F.count("*").alias("all"))
    return rows.crossJoin(F.broadcast(total)).select("family", "supported", "occurrences", "records", rate(F.col("occurrences"), F.col("all")).alias("share"))  # one row


def missing_ids(found: DataFrame) -> DataFrame:
    """Over labels, or (constraint_id, is_primary) of those outside the registry alone."""
    gone = found.where("not in_registry") if "in_registry" in found.columns else found
    return gone.groupBy("constraint_id").agg(F.count("*").alias("occurrences"), count_if(F.col("is_primary")).alias("as_primary"))


def support_histogram(found: DataFrame) -> DataFrame:
    """Records by number of all, supported and unsupported attached constraints."""
    rows = found.groupBy("violation_id").agg(
        F.count("*").alias("total"), count_if(F.col("supported")).alias("supported"), count_if(F.col("in_registry") & ~F.col("supported")).alias("unsupported")
    )
    each = rows.select(F.explode(F.create_map(*(x for c in ("total", "supported", "unsupported") for x in (F.lit(c), F.col(c))))).alias("kind", "factors"))
    return each.groupBy("kind", "factors").agg(F.count("*").alias("records"))


def tallied_occurrences(found: DataFrame) -> DataFrame:
    """``family_occurrences`` over tallies: few rows are left before the share of all attached is taken."""
    rows = found.groupBy("family", "supported", "in_registry").agg(F.sum("n").alias("occurrences"), F.count("*").alias("records"))
    rows = rows.withColumn("all", F.sum("occurrences").over(Window.partitionBy(F.lit(1)))).where("in_registry")
    return rows.select("family", "supported", "occurrences", "records", rate(F.col("occurrences"), F.col("all")).alias("share"))


def counted_histogram(counts: DataFrame) -> DataFrame:
    """``support_histogram`` over support counts."""
    told = F.create_map(*(x for c in ("total", "supported", "unsupported") for x in (F.lit(c), F.col(c))))
    each = counts.select(F.explode(F.when(F.col("total") > 0, told)).alias("kind", "factors"))
    return each.groupBy("kind", "factors").agg(F.count("*").alias("records"))


def counted_support_by_split(counts: DataFrame) -> DataFrame:
    """``support_by_split`` over support counts."""
    c, p = F.col, F.col("primaries") > 0
    sums = counts.groupBy("split").agg(
        count_if(c("total") > 0).alias("records"), F.sum("total").alias("factors"), F.sum("supported").alias("supported"), F.sum("unsupported").alias("unsupported"),
        F.sum("missing").alias("missing"), count_if(c("supported") > 0).alias("with_supported"), count_if((c("supported") == 0) & (c("total") > 0)).alias("without_supported"),
        count_if((c("supported") == 0) & (c("unsupported") > 0)).alias("only_unsupported"), count_if(p & c("own_supported")).alias("primary_supported"),
        count_if(p & ~c("own_in_registry")).alias("primary_missing"), count_if(p & c("own_supported") & (c("family") != c("constraint_type"))).alias("primary_family_mismatch"),
    )
    return sums.where("records > 0").withColumns({"supported_rate": rate(F.col("supported"), F.col("factors")), "with_supported_rate": rate(F.col("with_supported"), F.col("records"))})


def counted_primary_support(counts: DataFrame) -> DataFrame:
    """``primary_support`` over support counts."""
    rows = counts.where("primaries > 0").select("constraint_type", F.coalesce("family", F.lit("missing_registry")).alias("family"), F.col("own_supported").alias("supported"), "primaries")
    sums = rows.groupingSets(
        [[F.col("constraint_type"), F.col("supported")], [F.col("constraint_type"), F.col("family"), F.col("supported")]],
        F.col("constraint_type"), F.col("family"), F.col("supported"),
    ).agg(F.sum("primaries").alias("factors"), F.grouping("family").alias("whole"))
    return sums.select("constraint_type", F.when(F.col("whole") == 1, "all").otherwise(F.col("family")).alias("family"), "supported", "factors")
