"""Readers, scans, vocabularies, caches and reports on literal rows."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from graphmend.operators import candidates, evaluate, graph, patterns, registry, reports, textcache, vocabulary
from graphmend.operators.registry import instances
from graphmend.plans import queries
from graphmend.sources import cells, corrections, tables
from graphmend.sources.violations import definitions, violations

SF = "/root/testdata/sf0.001"


def test_closures_agree_with_and_without_an_exchange(spark):
    records = violations(spark, SF).drop("local_constraint_ids", "local_constraint_ids_focus")
    names = ("violation_id", "local_constraint_ids", "local_constraint_ids_focus")
    some = [registry.with_closures(records, definitions(spark), most).select(*names) for most in (registry.INDEX_MOST, 0)]
    assert some[0].exceptAll(some[1]).count() == 0 and some[1].exceptAll(some[0]).count() == 0
    assert registry.with_closures(records.limit(0), definitions(spark).limit(0)).count() == 0


def test_hot_tokens_meet_the_vocabulary_like_others(spark):
    rows = spark.createDataFrame([(i, 101 if i % 2 else i + 2000) for i in range(3000)], "violation_id long, token long")
    ids = spark.createDataFrame([(101, 9)] + [(i + 2000, i + 10) for i in range(0, 3000, 4)], "token long, new_id long")
    got = {(r.violation_id, r.new_id, r.known) for r in vocabulary.with_new_ids(rows, "token", ids).collect()}
    assert got == {(i, 9, True) if i % 2 else (i, i + 10, True) if i % 4 == 0 else (i, 8, False) for i in range(3000)}
    assert vocabulary.with_new_ids(rows.limit(0), "token", ids).count() == 0


def test_encode_decode_and_concatenate(spark):
    ids = spark.createDataFrame([("Q1", 11), ("P1", 12)], "token string, id long")
    rows = spark.createDataFrame([("Q1",), ("",), (None,), ("Q9",)], "token string")
    assert sorted(r.id for r in vocabulary.encode(rows, ids).collect()) == [0, 0, 8, 11]
    assert vocabulary.decode(spark.createDataFrame([(12,)], "id long"), ids).first().token == "P1"
    a, b = spark.createDataFrame([(1, "x")], "a long, b string"), spark.createDataFrame([("y", 2)], "b string, a long")
    assert vocabulary.concatenated(a, b).count() == 2
    with pytest.raises(TypeError):
        vocabulary.concatenated(a, a.withColumn("a", F.col("a").cast("int")))


def test_scans_with_caps_and_files(spark, tmp_path):
    lines = spark.createDataFrame([(f, i, "x") for f in "ab" for i in range(5)], "file string, line long, value string")
    assert sorted((r.file, r.line) for r in corrections.capped(lines, 2, 3).collect()) == [("a", 0), ("a", 1), ("b", 0)]
    with gzip.open(tmp_path / "corpus-single.tsv.gz", "wt") as f:
        f.write("c1\t\t<http://www.wikidata.org/entity/Q1>\n")
    rows = spark.createDataFrame([(i, "val") for i in range(6)], "violation_id long, split string")
    assert [r.violation_id for r in tables.rows_after(rows, 2, 2).collect()] == [3, 4] and tables.rows_after(rows, 2).count() == 3
    assert tables.first_rows(rows, "val", 2).count() == 2 and tables.first_rows(rows, "test", 2).count() == 0
    read = corrections.read_corrections(spark, str(tmp_path / "corpus-single.tsv.gz")).first()
    assert read.value.startswith("c1\t") and "single" in read.constraint_type
    (tmp_path / "constraints.tsv").write_text("constraint id\t constraint type id\nc1\t<http://www.wikidata.org/entity/Q21502838>\n")
    defs = corrections.read_definitions(spark, str(tmp_path / "constraints.tsv"))
    qid = defs.select(registry.type_qid(F.col(defs.columns[1]).cast("string")).alias("q"), F.lit("  single Best_value constraint").alias("l"))
    assert qid.select("q", registry.family_name(F.col("l")).alias("f")).first() == ("Q21502838", "singleBestvalueConstraint")


def test_registry_files_and_ids(spark, tmp_path):
    entry = {"constraint_type_item": "Q2", "constraint_type_name": "single", "constraint_type_supported": True, "constrained_property": "<http://www.wikidata.org/entity/P5>", "param_predicates": [], "param_objects": []}
    spark.createDataFrame([(json.dumps({"<http://www.wikidata.org/entity/statement/x>": entry, "y": {**entry, "constraint_family": "type", "constraint_type_index": 7}}),)], "registry_json string").write.parquet(f"{tmp_path}/r")
    found = {r.raw_id: r for r in cells.read_registry(spark, f"{tmp_path}/r").collect()}
    assert found["y"].family == "type" and found["y"].type_index == 7 and found["y"].property == "P5"
    assert (found["<http://www.wikidata.org/entity/statement/x>"].family, found["<http://www.wikidata.org/entity/statement/x>"].type_index) == ("single", 0)
    vocab = spark.createDataFrame([("Q1", 5), ("<http://www.wikidata.org/entity/Q1>", 6), ("http://www.wikidata.org/prop/direct/P1", 7)], "token string, id long")
    raw = spark.createDataFrame([("http://www.wikidata.org/entity/Q1",), ("Q7",)], "raw string")
    assert {r.raw: r.id for r in cells.resolve_ids(raw, vocab, "raw").collect()} == {"http://www.wikidata.org/entity/Q1": 6, "Q7": None}
    assert tables.read_optional(spark, f"{tmp_path}/r", ["none", "registry_json"]).columns == ["registry_json"]
    odd = spark.createDataFrame([("7", ["1", "x", None], " ")], "a string, b array<string>, c string")
    assert odd.select(tables.to_id(F.col("a")), tables.to_ids(F.col("b")), tables.to_ids(F.col("b"), True), tables.to_type(F.col("c"))).first()[:] == (7, [1], [1, 0, 0], "UNKNOWN")
    tables.write_report(raw, f"{tmp_path}/report")
    assert spark.read.option("header", True).csv(f"{tmp_path}/report").count() == 2


def test_text_cache(spark, tmp_path):
    cache = spark.createDataFrame([("literal", "b", 2, "B"), ("uri", "a", None, "A"), ("literal", "b", 1, "C")], "kind string, key string, id long, text string")
    wanted = spark.createDataFrame([("literal", "b", 2), ("literal", "b", 9), ("uri", "a", None), ("uri", "z", 1)], "kind string, key string, id long")
    got = {(r.key, r.id): (r.text, r.state) for r in textcache.merge(cache, wanted).collect()}
    assert got == {("b", 2): ("B", "hit"), ("b", 9): ("B", "copied"), ("a", None): ("A", "hit"), ("z", 1): (None, "pending")}
    texts = {(r.key, r.id): r.text for r in textcache.lookup(wanted.drop("kind"), cache, "?").collect()}
    assert texts == {("b", 2): "B", ("b", 9): "B", ("a", None): "?", ("z", 1): "C"}
    stored = textcache.SortedCache(spark, f"{tmp_path}/c")
    stored.write(cache, 1)
    assert [(r.kind, r.key) for r in stored.rows().collect()] == sorted((r.kind, r.key) for r in cache.collect())
    spelled = spark.createDataFrame([("<http://www.wikidata.org/entity/Q5>",), ("http://www.wikidata.org/wiki/Q5",), ("x",)], "uri string")
    labels = spark.createDataFrame([("Q5", "human")], "entity string, label string")
    assert sorted(str(r.label) for r in textcache.with_labels(spelled, labels).collect()) == ["None", "human", "human"]


def test_policy_filter_keeps_all_without_a_match(spark):
    rows = spark.createDataFrame([(1, 0, "A"), (1, 1, "B"), (2, 0, "A"), (3, 0, "A")], "violation_id long, idx int, policy string")
    wanted = spark.createDataFrame([(1, "B"), (2, "C"), (3, "OTHER")], "violation_id long, policy string")
    kept = {(r.violation_id, r.idx): r.matches for r in patterns.policy_filtered(rows, wanted).collect()}
    assert kept == {(1, 1): True, (2, 0): False, (3, 0): True}
    assert patterns.policy_filtered(rows, wanted, strict=False).count() == 4


def test_literal_objects_have_no_scope_and_edges_lead_back(spark):
    wired = spark.createDataFrame([(1, 5, True, 4, 0, 0), (1, 5, True, 6, 77, 0)], "violation_id long, constraint_id long, is_primary boolean, type long, target long, ord long")
    assert sorted((r.type, r.source, r.target) for r in graph.both_ways(wired).collect()) == [(4, 5, 0), (6, 5, 77), (7, 0, 5), (9, 77, 5)]
    factors = spark.createDataFrame([(1, 5, True, "valueType", True, 101, [], [], [], [106], [101], 9, o, 0, 0) for o in (7, 9)],
        "violation_id long, constraint_id long, is_primary boolean, family string, supported boolean, property long, required array<long>, items array<long>, conflicts array<long>, relations array<long>, inverses array<long>, subject long, object long, other_subject long, other_predicate long")
    assert [r.s for r in factors.select("object", graph._scope().alias("s")).orderBy("object").collect()] == [[], [9]]


def test_whole_candidate_sets_agree_with_single_candidates(spark):
    """States shared by candidates are evaluated once: the same figures as for each candidate on its own."""
    records = violations(spark, SF).where("violation_id < 18")
    known = instances(definitions(spark))
    sets = queries.candidate_sets(spark, SF).where("violation_id < 18").drop("is_gold").cache()
    whole = evaluate.evaluate(sets, records, known).collect()
    alone = {}
    for i in (0, 2, 30):
        alone |= {(r.violation_id, r.idx): r for r in evaluate.evaluate(sets.where(F.col("idx") == i), records, known).collect()}
    by = {(r.violation_id, r.idx): r for r in whole}
    assert len(whole) == sets.count() and alone and all(by[k].asDict() == r.asDict() for k, r in alone.items())
    chosen = reports.chosen(evaluate.evaluate(sets, records, known).withColumn("score", -F.col("idx").cast("double"))).collect()
    for r in chosen:
        best = max((x for x in whole if x.violation_id == r.violation_id), key=lambda x: (x.primary_satisfied, x.regressions == 0, x.post_fraction, -x.ops, -x.srr, -x.idx))
        assert r.oracle_idx == best.idx and r.selected_idx == 0
    sets.unpersist()


def test_factors_are_wired_in_the_row(spark):
    from graphmend.operators import graph
    from graphmend.operators.registry import instances
    from graphmend.plans import queries
    from graphmend.sources.violations import catalog, definitions, violations

    sf = "/root/testdata/sf0.001"
    rows = violations(spark, sf).where("violation_id < 200")
    joined = graph.wiring(graph.factor_nodes(rows, instances(definitions(spark))), graph.triples(rows))
    held = graph.held_wiring(rows, catalog(spark))
    told = lambda found: sorted(tuple(r[c] for c in sorted(found.columns)) for r in found.collect())
    assert told(graph.held_edges(held)) == told(joined) and told(graph.held_overlap(held)) == told(graph.pressure_overlap(joined))
    for name in ("factor_wiring", "pressure_overlap"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("Join") <= plan.count("BroadcastHashJoin") + plan.count("BroadcastNestedLoopJoin") + plan.count("Cartesian") and "SortMergeJoin" not in plan
        assert plan.count("o_orderkey#") > 0 and "instances" not in plan and plan.count("HashAggregate") <= 4


def test_candidate_sets_are_made_in_the_row_as_from_tables(spark):
    made = queries.candidate_sets(spark, SF)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(violation_id" not in plan and "Window" not in plan
    records = patterns.with_patterns(violations(spark, SF).where("violation_id < 9"), instances(definitions(spark)))
    rows = candidates.candidate_sets(records, candidates.triple_topk(candidates.slot_topk(candidates.slot_scores(records))))
    some = [sorted(map(repr, x.collect())) for x in (made.where("violation_id < 9"), rows)]
    assert some[0] == some[1] and some[0]
