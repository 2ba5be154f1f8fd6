"""Small literal cases of the operators."""

import pytest
from pyspark.sql import functions as F

from graphmend.functions import tokens
from graphmend.functions.ranking import ranked
from graphmend.operators import baselines, evaluate, graph, labels, metrics, patterns, profile, scores, textcache
from graphmend.operators.registry import instances, type_index
from graphmend.sources import corrections, tables
from graphmend.sources.violations import LISTS, definitions, violations

ROW = dict(
    violation_id=1, split="train", constraint_type="single", constraint_id=1, subject=1001, predicate=101, object=1002, other_subject=0,
    other_predicate=0, other_object=0, add_subject=0, add_predicate=0, add_object=0, del_subject=0, del_predicate=0, del_object=0,
)
TYPES = "violation_id long, split string, constraint_type string, " + ", ".join(f"{c} long" for c in list(ROW)[3:])


def records(spark, *rows):
    full = [{**ROW, **{c: [] for c in LISTS}, **r} for r in rows]
    schema = TYPES + ", " + ", ".join(f"{c} array<long>" for c in LISTS)
    names = [*ROW, *LISTS]
    return spark.createDataFrame([[r[n] for n in names] for r in full], schema)


def known(spark, *rows):
    return instances(spark.createDataFrame(list(rows), "constraint_id long, family string, property long, parameter string, value long"))


def flags(found):
    return {(r.violation_id, r.constraint_id): (r.checkable_pre, r.satisfied_pre, r.checkable_post, r.satisfied_post) for r in found.collect()}


def test_symmetric_needs_the_way_back(spark):
    base = dict(constraint_type="symmetric", subject_predicates=[101], subject_objects=[1002], object_predicates=[101], local_constraint_ids=[1])
    rows = records(spark, dict(base, object_objects=[1001]), dict(base, violation_id=2, object_objects=[1003]))
    found = flags(labels.factors(rows, known(spark, (1, "symmetric", 101, None, None))))
    assert found[1, 1][:2] == (True, 1) and found[2, 1][:2] == (True, 0)


def test_single_in_open_world_and_after_unknown_edit(spark):
    base = dict(subject_predicates=[102], subject_objects=[5], object_predicates=[101], object_objects=[7], local_constraint_ids=[1])
    one = known(spark, (1, "single", 101, None, None))
    assert flags(labels.factors(records(spark, base), one))[1, 1] == (True, 1, True, 1)
    assert flags(labels.factors(records(spark, base), one, closed=False))[1, 1] == (False, 0, False, 0)
    edit = dict(base, add_subject=1, add_predicate=2, add_object=9)
    assert flags(labels.factors(records(spark, edit), one, closed=False))[1, 1][2:] == (False, 0)


def test_other_entity_overwrites_the_subject(spark):
    row = dict(subject_predicates=[101, 101], subject_objects=[1, 2], other_subject=1001, other_predicate=101, other_object=2, other_entity_predicates=[101], other_entity_objects=[1], local_constraint_ids=[1])
    assert flags(labels.factors(records(spark, row), known(spark, (1, "single", 101, None, None))))[1, 1][:2] == (True, 1)


def test_deletion_comes_before_addition(spark):
    row = dict(subject_predicates=[101], subject_objects=[1002], local_constraint_ids=[1], add_subject=1, add_predicate=2, add_object=3, del_subject=1, del_predicate=2, del_object=3)
    assert flags(labels.factors(records(spark, row), known(spark, (1, "oneOf", 101, "P2305", 1003))))[1, 1] == (True, 0, True, 0)


def test_supported_only_policy(spark):
    known_ = known(spark, (1, "single", 101, None, None), (2, "unsupported:Q", 101, None, None), (3, "type", 101, "P2308", 9))
    rows = records(spark, dict(local_constraint_ids=[1, 2, 3]), dict(violation_id=2, constraint_id=2, local_constraint_ids=[2, 1]))
    every = labels.factors(rows, known_)
    stats = labels.filter_stats(every).first()
    assert (stats.raw, stats.retained, stats.unsupported_filtered, stats.unsupported_primary_retained) == (5, 4, 1, 1)
    arrays = {r.violation_id: r for r in labels.factor_arrays(labels.factors(rows, known_, policy="supported_only")).collect()}
    assert arrays[1].factor_constraint_ids == [1, 3] and arrays[2].factor_constraint_ids == [2, 1]
    assert arrays[2].factor_checkable_pre[0] is False
    assert labels.factors(rows, known_, policy="all").count() == 5
    with pytest.raises(ValueError):
        labels.factors(rows, known_, policy="other")


def test_adapter_gives_the_expected_outcomes(spark):
    found = labels.factors(violations(spark, "/root/testdata/sf0.001"), instances(definitions(spark))).where("constraint_id in (501, 505, 514)")
    code = F.concat(*(F.when(~F.col(f"checkable_{s}"), "n").when(F.col(f"satisfied_{s}") == 1, "s").otherwise("v") for s in ("pre", "post")))
    got = {(r.constraint_id, r.c): r["count"] for r in found.groupBy("constraint_id", code.alias("c")).count().collect()}
    assert got == {
        (501, "nn"): 216, (501, "ss"): 273, (501, "sv"): 18, (501, "vs"): 185, (501, "vv"): 808, (505, "ss"): 733, (505, "vs"): 171,
        (505, "vv"): 596, (514, "nn"): 83, (514, "ss"): 1417,
    }


def test_majorities_take_the_smaller_of_equals(spark):
    rows = records(
        spark, dict(del_subject=11, del_predicate=12, del_object=13), dict(violation_id=2, del_subject=11, del_predicate=12, del_object=13),
        dict(violation_id=3, constraint_id=2, add_subject=21, add_predicate=22, add_object=23),
    )
    one = {r.violation_id: list(r)[1:] for r in baselines.predict_majority(rows, baselines.fit_majority(rows, "constraint_id"), "constraint_id").collect()}
    family = {r.violation_id: list(r)[1:] for r in baselines.predict_majority(rows, baselines.fit_majority(rows, "constraint_type"), "constraint_type").collect()}
    assert one[3] == [21, 22, 23, 0, 0, 0] and family[3] == [0, 0, 0, 11, 12, 13]
    new = records(spark, dict(violation_id=9, constraint_id=77))
    assert list(baselines.predict_majority(new, baselines.fit_majority(rows, "constraint_id"), "constraint_id").first())[1:] == [0, 0, 0, 11, 12, 13]


def test_evidence_flags_of_candidates(spark):
    rows = records(spark, dict(subject_predicates=[101, 101], subject_objects=[1002, 55], local_constraint_ids=[1]))
    cands = spark.createDataFrame([(1, 0, 0, 0, 0, 1, 2, 3), (1, 1, 0, 0, 0, 1, 2, 55)], "violation_id long, idx int, " + ", ".join(f"{n} long" for n in baselines.SLOTS))
    out = {r.idx: r for r in evaluate.evaluate(cands, rows, known(spark, (1, "single", 101, None, None))).collect()}
    assert (out[0].primary_satisfied, out[0].focus_deleted, out[0].deletes_focus, out[0].vacuous_improvement, out[0].non_vacuous_fix) == (1, True, True, True, False)
    assert (out[1].primary_satisfied, out[1].focus_preserved, out[1].non_vacuous_safe, out[1].pre_fraction, out[1].post_fraction) == (1, True, True, 0.0, 1.0)
    choice = evaluate.oracle_choice(evaluate.evaluate(cands, rows, known(spark, (1, "single", 101, None, None))).withColumn("score", F.lit(0.0))).first()
    assert (choice.oracle_idx, choice.non_vacuous_idx) == (0, 1)
    whole = evaluate.global_metrics(evaluate.evaluate(cands, rows, known(spark, (1, "single", 101, None, None)))).where("constraint_type = 'all'").first()
    assert whole.focus_preserved_rate == whole.focus_deleted_rate == whole.non_vacuous_fix_rate == 0.5


def test_score_metrics(spark):
    rows = spark.createDataFrame([("pre", True, 1, 0.9), ("pre", True, 1, 0.8), ("post", True, 1, 0.7), ("post", True, 0, 0.2), ("post", False, 0, 0.9)], "state string, checkable boolean, label int, score double")
    got = {r.state: r for r in scores.classification(rows, ["state"]).collect()}
    assert got["pre"].support == 2 and got["pre"].accuracy == 1.0 and got["post"].f1 == 1.0
    rank = {r.state: r for r in scores.ranking(rows, ["state"]).collect()}
    assert rank["pre"].auroc is None and rank["post"].auroc == 1.0 and rank["post"].auprc == 1.0
    seen = scores.exposure(records(spark, dict(local_constraint_ids=[1, 2, 2]), dict(violation_id=2, local_constraint_ids=[2, 3])))
    assert {r.constraint_id: r.exposure for r in seen.collect()} == {1: 1, 2: 3, 3: 1}


def test_bins_sampling_and_ranks(spark):
    sizes = [0, 1, 32, 33, 83, 84, 108, 109, 161, 268]
    got = [r.b for r in spark.createDataFrame([(n,) for n in sizes], "n int").select(profile.bin_label(F.col("n")).alias("b")).collect()]
    assert got == ["0", "1-32", "1-32", "33-64", "65-83", "84-107", "108", "109-160", "161-267", "268+"]
    rows = records(
        spark, dict(constraint_type="a", local_constraint_ids=[1]), dict(violation_id=2, constraint_type="a", local_constraint_ids=[1]),
        dict(violation_id=3, constraint_type="a", local_constraint_ids=list(range(108))), dict(violation_id=4, split="val"),
    )
    first, second = (sorted(r.violation_id for r in profile.stratified_sample(rows).collect()) for _ in range(2))
    assert first == second and len(first) == 3 and {3, 4} <= set(first)
    many = spark.range(5000).withColumn("k", F.lit("one"))
    got = ranked(many, ["k"], "id").agg(F.min("rank"), F.max("rank"), F.count_distinct("rank"), F.max("total")).first()
    assert list(got) == [1, 5000, 5000, 5000]


def test_outcomes(spark):
    rows = records(spark, dict(constraint_type="oneOf", add_subject=1, add_predicate=2, add_object=9))
    known_ = patterns.with_patterns(rows, known(spark, (1, "oneOf", 101, "P2305", 1003)))
    gold = baselines.gold(rows)
    slots = ", ".join(f"{n} long" for n in baselines.SLOTS)
    for add, want in (((1, 2, 9), "exact"), ((1, 101, 1003), "alternative_fix"), ((0, 0, 0), "missing_prediction"), ((1, 2, 8), "no_fix")):
        acts = metrics.by_action(spark.createDataFrame([(1, *add, 0, 0, 0)], f"violation_id long, {slots}"), gold)
        out = {r.action: r.outcome for r in metrics.outcomes(acts, known_).collect()}
        assert out == {"add": want, "del": "exact"}


def test_pressure_masks_and_overlap(spark):
    wired = spark.createDataFrame([(1, 5, True, 4, 7), (1, 5, True, 5, 7), (1, 6, False, 4, 7), (1, 6, False, 6, 8)], "violation_id long, constraint_id long, is_primary boolean, type long, target long")
    masks = {r.variant: r.edges for r in graph.pressure_masks(wired).collect()}
    assert masks == {"normal": 4, "primary": 2, "secondary": 2}
    over = graph.pressure_overlap(wired).first()
    assert (over.edges, over.targets, over.shared, over.most_factors) == (4, 3, 1, 2)


def test_tokens(spark):
    e, d = tokens.ENTITY, tokens.DIRECT
    values = ["<" + d + "P31>", e + "Q5", "^P7", " P0 ", "P12", '"x"^^<t>', e + "P5"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    got = rows.select(tokens.property_id(F.col("v")).alias("p"), tokens.token(F.col("v")).alias("t"), tokens.literal_text(F.col("v")).alias("l")).collect()
    assert [r.p for r in got] == ["P31", None, None, None, "P12", None, "P5"]
    assert [r.t for r in got][:5] == ["P31", "Q5", "P7", "P0", "P12"] and got[5].l == '"x"' and got[1].l == ""
    codes = spark.createDataFrame([(404,), (200,), (799,)], "c int").select(tokens.status_phrase(F.col("c")).alias("s")).collect()
    assert [r.s for r in codes] == ["NotFound", "Ok", "Status799"]


def test_corrections(spark):
    add, gone = (f"<{corrections.HISTORY}{k}>" for k in ("addition", "deletion"))
    fields = [f"f{i}" for i in range(9)] + ["a", "b", "c", add, "d", "e", "f", "<other>", "g", "h", "i", gone, "j", "k", "l", gone]
    tail = ['{"type":"page","statusCode":404,"content":"x"}', "", '{"type":"entity","id":"Q1","labels":{"en":"cat"},"facts":{"P1":["a","b"]}}']
    # Kinds end before the whole run of descriptions, and nothing but the two URIs is one.
    long = [f"f{i}" for i in range(9)] + ["a", "b", "c", gone, "{}", "{}", "{}", '{"type":"page","content":"in addition to this"}']
    odd = [f"f{i}" for i in range(9)] + ["a", "b", "c", f"<{corrections.HISTORY}Addition>", "d", "e", "f", "deletion", "g", "h", "i", "{addition"]
    lines = spark.createDataFrame([("\t".join(x),) for x in (fields + tail, fields, long, odd)], "value string")
    got = corrections.parse_corrections(lines).collect()
    assert (got[0].add_s, got[0].add_o, got[0].del_s, len(got[0].descriptions), len(got[1].descriptions)) == ("a", "c", "j", 3, 0)
    assert (got[2].add_s, got[2].del_s, got[2].del_o, got[2].descriptions) == ("", "a", "c", long[-3:])
    assert (got[3].add_s, got[3].del_s, got[3].descriptions) == ("", "", [])
    pages = spark.createDataFrame([(t,) for t in [*tail, "{broken"]], "raw string").select(corrections.parse_page(F.col("raw")).alias("p")).collect()
    assert pages[0].p.facts[0].o == "NotFound" and [f.o for f in pages[2].p.facts] == ["a", "b"] and pages[3].p.id is None


def test_cache_and_tables(spark, tmp_path):
    cache = spark.createDataFrame([("literal", "x", 1, "X"), ("uri", "y", None, "Y")], "kind string, key string, id long, text string")
    wanted = spark.createDataFrame([("literal", "x", 1), ("literal", "x", 2), ("literal", "z", 3), ("uri", "y", None)], "kind string, key string, id long")
    got = {(r.key, r.id): (r.state, r.text) for r in textcache.merge(cache, wanted).collect()}
    assert got == {("x", 1): ("hit", "X"), ("x", 2): ("copied", "X"), ("z", 3): ("pending", None), ("y", None): ("hit", "Y")}
    rows = records(spark, {}, dict(violation_id=2), dict(violation_id=3, split="val"))
    out = str(tmp_path / "shards")
    tables.write_sharded(rows, out, 1, drop=("other_subject",))
    listed = tables.manifest(spark, out).collect()
    assert sum(r.rows for r in listed) == 3 and all(len(r.sha256) == 64 for r in listed)
    assert tables.missing_rows(records(spark, {}, dict(violation_id=9)), spark, out).first().violation_id == 9
    (tmp_path / "p.json").write_text('{"violation_id":1,"add":[1,2,3]}\n{"violation_id":2,"slots":[0,0,0,4,5,6]}\n')
    assert [list(r) for r in tables.read_predictions(spark, str(tmp_path / "p.json")).orderBy("violation_id").collect()] == [[1, 1, 2, 3, 0, 0, 0], [2, 0, 0, 0, 4, 5, 6]]
    (tmp_path / "q.json").write_text('{"violation_id":1,"add":[1,2]}\n')
    with pytest.raises(Exception, match="six ids"):
        tables.read_predictions(spark, str(tmp_path / "q.json")).collect()
    assert tables.validate(rows).first().repeated_ids == 0
    idx = {r.family: r.type_index for r in type_index(spark.createDataFrame([("b",), ("a",), ("",)], "family string")).collect()}
    assert idx == {"a": 0, "b": 1, "": -1}


def test_labels_over_a_stream(spark, tmp_path):
    from graphmend.streaming.labels import label_stream, read_records

    rows = records(spark, dict(local_constraint_ids=[1]), dict(violation_id=2, local_constraint_ids=[1]))
    rows.write.parquet(str(tmp_path / "in"))
    one = known(spark, (1, "single", 101, None, None))
    label_stream(read_records(spark, str(tmp_path / "in")), one, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert flags(spark.read.parquet(str(tmp_path / "out"))) == flags(labels.factors(rows, one))
