"""Candidates judged by masks, and what is chosen, reported and counted in the record's row."""

from pyspark.sql import functions as F

from graphmend.operators import evaluate, graph, labels
from graphmend.operators.registry import instances
from graphmend.plans import queries, reports
from graphmend.sources.violations import catalog, definitions, violations

SF = "/root/testdata/sf0.001"


def told(rows):
    names = sorted(rows.columns)
    return sorted(map(repr, rows.select(*names).collect()))


def moved(rows):
    """Whether a plan deals records out again after the scan."""
    return "hashpartitioning(violation_id" in rows._jdf.queryExecution().executedPlan().toString()


def test_masks_give_the_sums_of_verdicts(spark):
    records = violations(spark, SF).where("violation_id < 90")
    # Ids attached repeatedly count each time; a record may have none.
    odd = F.when(F.col("violation_id") % 4 == 0, F.concat("local_constraint_ids", F.slice("local_constraint_ids", 1, 3), F.array("constraint_id")))
    ids = odd.when(F.col("violation_id") % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.col("local_constraint_ids"))
    held = queries.with_simple_candidates(spark, records.withColumn("local_constraint_ids", ids))
    some = [told(evaluate.evaluate_held(held, known)) for known in (catalog(spark), instances(definitions(spark)))]
    assert some[0] == some[1] and some[0]


def test_degeneracy_report_moves_no_records(spark):
    assert not moved(reports.degeneracy_report(spark, SF))


FIGURES = "violation_id long, constraint_type string, idx int, score double, post_fraction double, ops long, srr double, primary_satisfied long, regressions long, non_vacuous_safe boolean"


def test_choices_as_candidates_pass(spark):
    """Records longer than a batch, ties, and records without a non-vacuous candidate."""
    rows = spark.range(0, 700, 1, 3).selectExpr("id as violation_id", "explode(sequence(0, cast(if(id = 5, 25000, id % 9) as int))) as idx")
    rows = rows.selectExpr(
        "violation_id", "concat('t', violation_id % 3) as constraint_type", "idx", "(violation_id * 7 + idx * 5) % 4 / 4.0D as score", "(violation_id + idx) % 3 / 3.0D as post_fraction",
        "idx % 2L as ops", "(violation_id + idx * 3) % 2 / 2.0D as srr", "(violation_id + idx div 3) % 2 as primary_satisfied", "(violation_id * idx) % 2 as regressions", "violation_id % 5 > 1 and (violation_id + idx) % 4 = 0 as non_vacuous_safe",
    )
    assert dict(rows.dtypes) == dict(x.split(" ") for x in FIGURES.replace("long", "bigint").split(", "))
    made = evaluate.adjoining_choices(rows, ("ops", "non_vacuous_safe"))
    assert told(made) == told(evaluate.choices(rows, ("ops", "non_vacuous_safe"))) and made.count() == 700


def test_best_candidates_move_no_records(spark):
    assert not moved(queries.best_candidates(spark, SF))


def test_targets_are_counted_in_the_row(spark):
    records, known = violations(spark, SF).where("violation_id < 120"), catalog(spark)
    factors = graph.factor_nodes(records, instances(definitions(spark)))
    overlap = reports.variant_overlap(graph.wiring(factors, graph.triples(records)))
    made = graph.held_variants(records, known)
    some = made.where("targets > 0").select(*overlap.columns)
    assert told(some) == told(overlap) and made.where("variant = 'none'").count() == 120
    sizes = factors.groupBy("violation_id").agg(F.count("*").alias("factors"))
    assert told(made.where("variant = 'none'").select("violation_id", "factors")) == told(sizes)
    assert not moved(reports.density_summary(spark, SF))


def test_label_arrays_are_made_in_the_row(spark):
    records, known = violations(spark, SF).where("violation_id < 60"), catalog(spark)
    ids = F.when(F.col("violation_id") % 4 == 0, F.concat("local_constraint_ids", F.slice("local_constraint_ids", 1, 3), F.array(F.lit(7).cast("long")))).when(F.col("violation_id") % 7 == 0, F.array().cast("array<bigint>"))
    records = records.withColumn("local_constraint_ids", F.coalesce(ids, F.col("local_constraint_ids")))
    found, made = labels.factors(records, known), labels.held_arrays(records, known)
    arrays = labels.factor_arrays(found)
    names = ["violation_id", *(c for c in arrays.columns if c.startswith("factor_"))]
    assert told(made.where("factor_types is not null").select(*names)) == told(arrays.select(*names))
    assert told(labels.held_invariants(made)) == told(labels.invariants(found)) and not moved(queries.label_invariants(spark, SF))


def test_alignment_moves_no_records_and_sees_odd_ones(spark):
    assert not moved(reports.label_alignment(spark, SF))
    made = labels.held_arrays(violations(spark, SF).where("violation_id < 40"), catalog(spark))
    odd = made.withColumn("local_constraint_ids", F.when(F.col("violation_id") < 3, F.reverse("local_constraint_ids")).when(F.col("violation_id") < 5, F.array(F.lit(1).cast("long"))).otherwise(F.col("local_constraint_ids")))
    assert graph.held_alignment(made).first()[:] == (40, 0, 0) and graph.held_alignment(odd).first()[:] == (40, 2, 5)
