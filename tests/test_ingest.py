"""Numbered lines, restartable shards, dense graphs, cached vectors, degeneracy levels."""

import gzip
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from graphmend.operators import dense, evaluate, labels, profile, vectors
from graphmend.operators.baselines import SLOTS
from graphmend.operators.registry import Catalog
from graphmend.sources import ingest
from graphmend.sources.violations import catalog, violations

from test_micro import flags, known, records


def test_lines_are_numbered_in_file_order(spark, tmp_path):
    for name, n in (("a", 5), ("b", 0), ("c", 700)):
        (tmp_path / f"file={name}").mkdir()
        with gzip.open(tmp_path / f"file={name}" / "part.txt.gz", "wt") as f:
            f.write("".join(f"{name}{i}\n" for i in range(n)))
    (tmp_path / "file=d").mkdir()
    (tmp_path / "file=d" / "part.txt").write_text("".join(f"d{i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # plain files come in several blocks
    try:
        found = ingest.numbered_lines(spark, str(tmp_path))
        rows = found.collect()
        assert len(rows) == 3705 and all(r.value == f"{r.file}{r.line}" for r in rows)
        got = {(r.file, r.line) for r in ingest.capped(found, 10, 12).collect()}
        assert got == {("a", i) for i in range(5)} | {("c", i) for i in range(7)}
        assert ingest.capped(found, 3).count() == 9 and ingest.capped(found).count() == 3705
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_killed_write_goes_on(spark, tmp_path):
    rows = spark.range(100).select(F.col("id"), F.when(F.col("id") < 60, "train").otherwise("val").alias("split"), (F.col("id") % 3).cast("int").alias("shard"))
    keep = F.col("id") % 10 != 0
    path = f"{tmp_path}/t"
    assert ingest.Shards(spark, path, 3).write(rows, keep, stop_after=2) == 2
    again = ingest.Shards(spark, path, 3)
    assert again.rows().count() == 36 and again.ledger().count() == 2
    # A unit that was moved but never entered does not exist, and is written anew.
    spark.range(7).select("id").write.parquet(f"{path}/data/split=val/shard=1")
    assert again.write(rows, keep) == 7 and again.write(rows, keep) == 0
    assert sorted(r.id for r in again.rows().collect()) == [i for i in range(100) if i % 10]
    entries = {(r.split, r.shard): (r.kept, r.dropped) for r in again.ledger().collect()}
    assert len(entries) == 9 and entries["test", 0] == (0, 0) and entries["train", 0] == (18, 2)
    assert sum(k for k, _ in entries.values()) == 90 and sum(d for _, d in entries.values()) == 10
    assert {p.name for p in (tmp_path / "t").iterdir()} == {"data", "ledger"}
    with pytest.raises(ValueError):
        ingest.Shards(spark, path, 400)


def test_nodes_are_numbered_by_first_use(spark):
    row = dict(
        subject=11, predicate=101, object=12, subject_predicates=[102, 103], subject_objects=[12, 13], object_predicates=[104], object_objects=[11, 14],
        other_subject=11, other_predicate=101, other_object=0, other_entity_predicates=[105], other_entity_objects=[],
    )
    rows = records(spark, row).withColumn("other_object_text", F.lit("text"))
    steps = dense.factor_steps(
        spark.createDataFrame([(1, 1, 6), (1, 0, 5)], "violation_id long, position int, constraint_id long"), spark.createDataFrame([(5, 2306, 13), (5, 2306, 99)], "constraint_id long, p long, o long")
    )
    got = dense.numbered(rows, steps).first()
    assert [tuple(p) for p in got.paths] == [
        (0, 101, 0, 1, 2),  # 11 - 101 - 12
        (0, 101, 0, 3, 4),  # the other object is a literal
        (0, 102, 0, 5, 2), (0, 103, 0, 6, 7), (0, 104, 2, 8, 0), (0, 104, 2, 9, 10),  # one predicate for two objects
        (1, 5, 11, -1, -1), (2, 2306, 11, 12, 7), (2, 2306, 11, 13, 14), (1, 6, 15, -1, -1),
    ]
    assert got.nodes == 16
    loop = dense.numbered(records(spark, dict(subject=5, object=5))).first()
    assert [tuple(p) for p in loop.paths] == [(0, 101, 0, 1, 0)] and loop.nodes == 2
    assert dense.numbered(records(spark, dict(subject=5, object=5)).limit(0)).count() == 0


def test_vectors_by_id_literal_and_fallback(spark, tmp_path):
    entries = spark.createDataFrame([(1, None, "one", [1.0]), (2, None, "unknown", [2.0]), (None, "k", "x", [3.0]), (9, "q", "y", [9.0])], "id long, key string, text string, vector array<double>")
    cache = vectors.VectorCache(entries, f"{tmp_path}/v")
    wanted = spark.createDataFrame([(1, "k"), (5, "k"), (None, "q"), (7, None), (1, None)], "id long, key string")
    found = cache.lookup(wanted)
    assert sorted((str(r.id), str(r.key), r.vector[0], r.source) for r in found.collect()) == [
        ("1", "None", 1.0, "id"), ("1", "k", 1.0, "id"), ("5", "k", 3.0, "literal"), ("7", "None", 2.0, "unknown"), ("None", "q", 9.0, "literal"),
    ]
    ids = wanted.select("id").distinct().join(cache.entries().hint("merge"), "id")
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "Bucketed: true" in plan  # only the wanted ids move
    cache.drop()


def test_verdicts_agree_with_and_without_a_catalog(spark):
    one = known(spark, (1, "single", 101, None, None), (2, "unsupported:Q", 101, None, None), (3, "type", 101, "P2308", 9), (4, "conflictWith", 101, "P2306", 102))
    base = dict(subject_predicates=[101, 101, 102], subject_objects=[1002, 55, 7], local_constraint_ids=[1, 2, 3, 4, 77])
    rows = records(spark, dict(base, del_subject=1, del_predicate=2, del_object=3), dict(base, violation_id=2, constraint_id=77, add_subject=1, add_predicate=102, add_object=8))
    whole, none = Catalog.of(one), Catalog.of(one, most=0)
    assert whole.entries and not none.entries
    for policy in ("all", "supported_only"):
        results = [labels.factors(rows, k, policy=policy) for k in (whole, none, one)]
        first = sorted(map(repr, results[0].collect()))
        assert all(sorted(map(repr, r.select(*results[0].columns).collect())) == first for r in results[1:]) and first
    edits = spark.createDataFrame([(i, k, 0, 0, 0, 1, 2, o) for i in (1, 2) for k, o in enumerate((3, 55, 99))], "violation_id long, idx int, " + ", ".join(f"{n} long" for n in SLOTS))
    both = [sorted(map(repr, evaluate.evaluate(edits, rows, k).collect())) for k in (whole, one)]
    assert both[0] == both[1] and len(both[0]) == 6
    assert flags(labels.factors(rows, whole))[1, 77] == (False, 0, False, 0)


def test_degeneracy_levels_list_examples(spark):
    one = known(spark, (1, "single", 101, None, None))
    rows = records(spark, *(dict(violation_id=i, subject_predicates=[101, 101], subject_objects=[1002, 55], local_constraint_ids=[1]) for i in range(1, 6)))
    edits = lambda o: evaluate.evaluate(c := spark.createDataFrame([(i, 0, 0, 0, 0, 1, 2, 3 if i == 1 else o) for i in range(1, 6)], "violation_id long, idx int, " + ", ".join(f"{n} long" for n in SLOTS)), rows, one).join(c, ["violation_id", "idx"])
    size = rows.select("violation_id", F.when(F.col("violation_id") < 4, "1").otherwise("2_4").alias("density"))
    got = {(r.density, r.constraint_type): r for r in evaluate.degeneracy_levels(edits(55), edits(3), size, 2).collect()}
    assert set(got) == {("all", "all"), ("1", "all"), ("2_4", "all"), ("all", "single")}
    assert got["all", "all"].exact == 0.2 and got["all", "all"].examples == [2, 3] and got["2_4", "all"].examples == [4, 5]
    assert (got["1", "all"].model_focus_deleted, got["1", "all"].focus_focus_deleted) == (1 / 3, 1.0)


def test_attached_constraints_counted_in_the_row_agree_with_labels(spark):
    one = known(spark, (1, "single", 101, None, None), (2, "unsupported:Q", 101, None, None), (3, "type", 101, "P2308", 9), (4, "unsupported:Q", 102, None, None), (5, "single", 102, None, None))
    held = ([1, 2, 3, 4, 5, 77, 78], [2, 2, 4], [77], [], [1, 5])
    rows = records(spark, *(dict(violation_id=i, split="train" if i % 2 else "test", constraint_id=own, local_constraint_ids=ids) for i, (ids, own) in enumerate(zip(held, (1, 2, 77, 1, 9), strict=True))))
    labelled = labels.factors(rows, one)
    told = lambda df: sorted(repr(sorted(r.asDict().items())) for r in df.collect())
    for k in (Catalog.of(one), Catalog.of(one, most=0)):
        tallied, counted = labels.tallies(rows, k), labels.support_counts(rows, k)
        for mine, theirs in (
            (labels.tallied_filter_stats(tallied), labels.filter_stats(labelled)), (labels.tallied_filter_families(tallied), labels.filter_families(labelled)),
            (profile.tallied_occurrences(tallied), profile.family_occurrences(labelled)), (profile.counted_histogram(counted), profile.support_histogram(labelled)),
            (profile.counted_support_by_split(counted), profile.support_by_split(labelled)), (profile.counted_primary_support(counted), profile.primary_support(labelled)),
            (profile.missing_ids(labels.missing_ids(rows, k)), profile.missing_ids(labelled)),
            (labels.primary_places(rows), labelled.where("is_primary").select("violation_id", "position")),
        ):
            assert told(mine) == told(theirs) and mine.columns == theirs.columns


@pytest.mark.parametrize("name", ["family_occurrences", "filter_stats", "missing_registry_ids", "support_histogram", "filter_families", "primary_factor_index", "primary_support", "support_by_split"])
def test_counts_of_attached_constraints_judge_nothing_and_regroup_no_record(spark, name):
    plan = __spark_entry__.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "checkable_pre" not in plan and not re.search(r"hashpartitioning\([^)]*violation_id", plan)


@pytest.mark.parametrize("name", ["deletion_degeneracy", "global_metrics"])
def test_candidates_that_follow_from_a_record_are_judged_in_its_row(spark, name):
    plan = __spark_entry__.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*(violation_id|o_orderkey|predicate)", plan)


def test_pairs_of_held_candidates_agree_with_joined_ones(spark):
    one = known(spark, (1, "single", 101, None, None))
    rows = records(spark, *(dict(violation_id=i, subject_predicates=[101, 101], subject_objects=[1002, 55], local_constraint_ids=[1]) for i in range(1, 6)))
    edits = [{n: (0, 0, 0, 1, 2, o)[k] for k, n in enumerate(SLOTS)} for o in (55, 3)]
    both = [spark.createDataFrame([(i, 0, *e.values()) for i in range(1, 6)], "violation_id long, idx int, " + ", ".join(f"{n} long" for n in SLOTS)) for e in edits]
    joined = evaluate.degeneracy(*(evaluate.evaluate(c, rows, one).join(c, ["violation_id", "idx"]) for c in both))
    held = F.array(*(F.struct(F.lit(k).alias("idx"), *(F.lit(v).cast("long").alias(n) for n, v in e.items())) for k, e in enumerate(edits)))
    for k in (Catalog.of(one), one):
        pairs = evaluate.degeneracy_of_pairs(evaluate.evaluate_pair(rows.withColumn("candidates", held), k))
        assert sorted(map(repr, pairs.collect())) == sorted(map(repr, joined.collect()))


@pytest.mark.parametrize("name", ["coverage_local", "coverage_open_world", "semantic_metrics", "auroc_auprc", "density_slices"])
def test_rules_of_labels_are_written_out_and_run_over_no_list_of_constraints(spark, name):
    plan = __spark_entry__.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "flags_pre" in plan and not re.search(r"lambda y(_\d+)?#\d+\.(checkable|watched|c)\b", plan)


@pytest.mark.parametrize("closed", [True, False])
def test_flags_agree_with_joined_entries(spark, closed):
    rows = violations(spark, "/root/testdata/sf0.001").where("violation_id < 300")
    # An id that is attached twice, one outside the registry, and edits of properties that are not local.
    twice = F.concat("local_constraint_ids", F.lit([501, 507, 9999]).cast("array<bigint>"))
    rows = rows.withColumns({"local_constraint_ids": twice, "del_predicate": F.when(F.col("violation_id") % 7 == 0, F.lit(999)).otherwise(F.col("del_predicate")).cast("long")})
    whole = catalog(spark)
    assert whole.checked()
    both = [labels.factors(rows, k, closed=closed) for k in (whole, whole.instances)]
    assert both[0].exceptAll(both[1].select(*both[0].columns)).count() == 0 and both[1].select(*both[0].columns).exceptAll(both[0]).count() == 0


def test_density_is_carried_in_the_record(spark):
    plan = __spark_entry__.QUERIES["density_slices"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*(violation_id|o_orderkey)", plan) and "Join [violation_id" not in plan


def test_dense_graphs_judge_nothing_and_keep_records_in_place(spark):
    plan = __spark_entry__.QUERIES["dense_graph"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "checkable" not in plan and "flags" not in plan and "aggregate(" not in plan and not re.search(r"hashpartitioning\([^)]*(violation_id|o_orderkey)", plan)


def test_held_factors_agree_with_joined_ones(spark):
    one = known(spark, (1, "single", 101, None, None), (2, "unsupported:Q", 101, None, None), (3, "type", 101, "P2308", 9), (3, "type", 101, "P2309", 106), (4, "oneOf", 102, "P2305", 3))
    params = spark.createDataFrame([(3, 2309, 106), (3, 2308, 9), (4, 2305, 3), (2, 1, 1)], "constraint_id long, p long, o long")
    rows = records(spark, *(dict(violation_id=i, local_constraint_ids=ids) for i, ids in enumerate(([4, 3, 2, 1], [3, 77, 3], [2], []))))
    whole = Catalog.of(one)
    told = [sorted(map(repr, dense.numbered(r).collect())) for r in (dense.held_factors(rows, whole, params), dense.held_factors(rows, whole, params, most=0), dense.held_factors(rows, Catalog.of(one, most=0), params))]
    assert told[0] == told[1] == told[2] and len(told[0]) == 4


def test_shards_are_written_without_a_sort_and_leave_the_session_as_it_was(spark, tmp_path, monkeypatch):
    asked, put = [], spark.conf.set
    monkeypatch.setattr(spark.conf, "set", lambda k, v: (asked.append((k, int(v))), put(k, v)))
    before = spark.conf.get(ingest.OPEN_WRITERS)
    rows = spark.range(100).select("id", F.lit("train").alias("split"), (F.col("id") % 2).cast("int").alias("shard"))
    for most, open_at_once in ((2, 2), (1, 0)):
        asked.clear()
        monkeypatch.setattr(ingest, "MOST_WRITERS", most)
        made = ingest.Shards(spark, f"{tmp_path}/t{most}", 2, ("train",))
        made.write(rows, F.lit(True))
        assert asked[0] == (ingest.OPEN_WRITERS, open_at_once) and spark.conf.get(ingest.OPEN_WRITERS) == before
        assert sorted(r.id for r in made.rows().collect()) == list(range(100))
