"""Registry cells of several layouts, the filtered-id view in the row and by joins, predictions in order."""

import json

import pytest
from pyspark.sql import functions as F

from graphmend.operators import textcache
from graphmend.operators.idset import IdSet
from graphmend.sources import cells, ingest, tables

ENTITY = "http://www.wikidata.org/entity/"


def test_odd_cells(spark):
    whole = json.dumps({"a": {"constraint_type_item": "Q2", "constraint_type_name": "old", "constraint_family": "", "param_objects": ["x", None, 5]}, "b": 3, "c": {"constraint_type_index": [1]}, "d": {"constraint_type_index": "7"}})
    rows = spark.createDataFrame([(whole,), ("{broken",), (None,), ("{}",), ("[1]",), ('{"k": {}, "k": {}}',)], "registry_json string")
    found = cells.read_cells(rows).collect()
    by = {r.raw_id: r for r in found if r.raw_id}
    assert sorted(by) == ["a", "b", "c", "d"] and len(found) == 7
    assert (by["a"].family, by["a"].supported, by["a"].param_objects, by["a"].param_predicates, by["a"].rescued) == ("old", False, ["x", "5"], [], None)
    assert by["b"].rescued == {"": "3"} and by["c"].rescued == {"constraint_type_index": "[1]"} and by["d"].given_index == 7
    assert sorted(r.rescued[""] for r in found if not r.raw_id) == ["[1]", '{"k": {}, "k": {}}', "{broken"]


def test_cells_are_bounded_and_come_back(spark, tmp_path):
    entries = spark.range(50).select(F.concat(F.lit('q"'), F.col("id").cast("string")).alias("raw_id"), F.to_json(F.struct(F.lit("f").alias("constraint_family"))).alias("entry"))
    cells.write_cells(entries, str(tmp_path / "r"), per_cell=5)
    assert spark.read.parquet(str(tmp_path / "r")).count() > 5
    back = cells.read_registry(spark, str(tmp_path / "r"))
    assert {r.raw_id for r in back.collect()} == {f'q"{i}' for i in range(50)} and back.where("family = 'f' and type_index = -1").count() == 50
    cells.write_cells(entries.limit(0), str(tmp_path / "none"))
    assert cells.read_registry(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize(
    ("raw", "names"),
    [
        ("Q5", [f"{ENTITY}Q5", f"<{ENTITY}Q5>", "Q5"]),
        (" <http://www.wikidata.org/prop/direct/P7> ", [f"{ENTITY}P7", f"<{ENTITY}P7>", "P7"]),
        ("http://a.b/x", ["http://a.b/x", "<http://a.b/x>"]),
        ("P1$s", ["P1$s"]),
        ("", []),
        (None, []),
    ],
)
def test_spellings(spark, raw, names):
    assert (spark.createDataFrame([(raw,)], "r string").select(cells.spellings(F.col("r"))).first()[0] or []) == names


def test_all_sides(spark):
    entries = spark.createDataFrame([("Q1",), (f"<{ENTITY}Q1>",), ("Q2",), ("Q3",), (None,)], "raw_id string")
    vocab = spark.createDataFrame([(f"{ENTITY}Q1", 11), ("Q2", 12), ("Q3", 0)], "token string, id long")
    attached = spark.createDataFrame([(11,), (11,), (99,)], "id long")
    assert {(r.raw_id, r.id, r.side) for r in cells.by_id(entries, vocab, attached).collect()} == {("Q1", 11, "both"), ("Q2", 12, "registry"), ("Q3", None, "unresolved"), (None, 99, "records")}


def test_view_in_the_row_and_by_joins(spark, tmp_path, monkeypatch):
    kept = [1, 3, 7, 9, 32768, 32769, 40000, 70000, 2**31 + 5]
    given = spark.createDataFrame([(i,) for i in [*kept, 3, 0, -4, None]], "id long")
    ids = IdSet.of(given, "id", str(tmp_path / "s"))
    number = {v: i for i, v in enumerate(sorted({*kept, 8}), 1)}
    rows = [(1, 7, [9, 0, 2, None, 32769]), (2, None, []), (3, -1, None), (4, 2**31 + 5, [32768, 40000, 70000, 2**31 + 6, 10**12])]
    table = spark.createDataFrame(rows, "violation_id long, a long, b array<long>")
    new = lambda v: 0 if v is None or v < 1 else number.get(v, number[8])
    wanted = [(i, new(a), None if b is None else [new(x) for x in b]) for i, a, b in rows]
    small = ids.renumbered(table, ["a"], ["b"])
    assert [tuple(r) for r in small.orderBy("violation_id").collect()] == wanted
    assert "Exchange hashpartitioning" not in small._jdf.queryExecution().toString().split("== Physical Plan ==")[1].split("BroadcastExchange")[0]
    monkeypatch.setattr("graphmend.operators.idset.MOST", 1)
    assert not ids.small
    assert [tuple(r) for r in ids.renumbered(table, ["a"], ["b"]).orderBy("violation_id").collect()] == wanted
    with pytest.raises(ValueError):
        ids.row()


def test_an_empty_set_holds_the_unknown_token(spark, tmp_path):
    ids = IdSet.of(spark.createDataFrame([], "id long"), "id", str(tmp_path / "s"))
    assert ids.unknown() == 1 and ids.renumbered(spark.createDataFrame([(1, 5)], "violation_id long, a long"), ["a"], []).first().a == 1


def test_predictions_of_every_layout(spark, tmp_path):
    texts = ["[1,2,3,4,5,6]", '{"add":[1,2,3]}', '{"delete":[4,5,6],"add":null}', '{"slots":[0,0,0,0,0,0]}', '{"del":[1,1,1]}']
    spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file string, n int, value string").createOrReplaceTempView("given_lines")
    ingest.write_lines(spark.table("given_lines"), str(tmp_path / "p"), "n")
    found = tables.ordered_predictions(spark, str(tmp_path / "p")).orderBy("line").collect()
    assert [list(r)[1:] for r in found] == [[0, 1, 2, 3, 4, 5, 6], [1, 1, 2, 3, 0, 0, 0], [2, 0, 0, 0, 4, 5, 6], [3, 0, 0, 0, 0, 0, 0], [4, 0, 0, 0, 1, 1, 1]]


@pytest.mark.parametrize("text", ["[1,2]", "[1,2,3,4,5,-1]", "{broken", '{"add":[1,2]}', "7", '[1,2,3,4,5,"x"]'])
def test_broken_predictions_stop_the_read(spark, tmp_path, text):
    (tmp_path / "p.json").write_text(text + "\n")
    with pytest.raises(Exception, match="six ids"):
        tables.ordered_predictions(spark, str(tmp_path / "p.json")).collect()


def test_a_stored_cache_reads_the_files_of_its_keys(spark, tmp_path):
    n = F.col("id")
    rows = spark.range(2000).select(F.lit("uri").alias("kind"), F.format_string("Q%05d", n).alias("key"), n.alias("id"), n.cast("string").alias("text"))
    hot = spark.range(1000).select(F.lit("literal").alias("kind"), F.lit("hot").alias("key"), n.alias("id"), n.cast("string").alias("text"))
    cache = textcache.SortedCache(spark, str(tmp_path / "c"))
    cache.write(rows.unionByName(hot), 12)
    keys = lambda *pairs: spark.createDataFrame(list(pairs), "kind string, key string")
    assert len(cache.files_of(keys(("uri", "Q00700"), ("uri", "Q00701"), ("uri", "Q00700")))) <= 2
    assert cache.of(keys(("uri", "Q00700"), ("uri", "Q01999"))).where("key in ('Q00700', 'Q01999')").count() == 2
    assert cache.of(keys(("literal", "hot"))).where("key = 'hot'").count() == 1000 and 1 < len(cache.files_of(keys(("literal", "hot")))) < 12
    assert cache.files_of(keys(("a", "a"), ("zz", "z"), ("uri", None), (None, "x"))) == [] and cache.of(keys(("zz", "z"))).count() == 0
    plan = cache.of(keys(("uri", "Q00000")))._jdf.queryExecution().toString()
    assert plan.count("part-") <= 2 or "1 paths" in plan
    with pytest.raises(ValueError):
        cache.write(rows, textcache.MOST_FILES + 1)


def test_the_view_carries_no_set_in_its_rows(spark, tmp_path):
    ids = IdSet.of(spark.createDataFrame([(i,) for i in (3, 40000, 3_000_000_000)], "id long"), "id", str(tmp_path / "s"))
    assert ids.small
    view = ids.renumbered(spark.createDataFrame([(1, 3, [40000, 3_000_000_000, 2_999_999_999])], "violation_id long, a long, b array<long>"), ["a"], ["b"])
    assert "NestedLoopJoin" not in view._jdf.queryExecution().toString() and list(view.first()) == [1, 1, [3, 4, 2]]


def test_fields_of_frequent_tokens_are_remapped_in_place(spark, monkeypatch):
    from graphmend.operators import vocabulary

    big = 3_000_000_000
    table = spark.createDataFrame([(1, 9, [big, 0, 9, None, 70]), (2, 0, [9, 9]), (3, None, None), (4, big + 1, [])], "violation_id long, subject long, subject_objects array<long>")
    ids = spark.createDataFrame([(9, 11, 4), (70, None, 1), (big, 12, 1), (big + 1, 13, 1)], "token long, new_id long, n long")
    wanted = {(1, "subject"): [11], (1, "subject_objects"): [12, 11, 8], (2, "subject_objects"): [11, 11], (4, "subject"): [13]}
    for most in (vocabulary.OFTEN, 2, 1):
        monkeypatch.setattr(vocabulary, "OFTEN", most)
        assert {(r.violation_id, r.field): r["values"] for r in vocabulary.remapped(table, ids).collect()} == wanted
    assert {tuple(r) for r in vocabulary.counts(table, F.col("violation_id") == 1).collect()} == {(9, 2, 4), (70, 1, 1), (big, 1, 1), (big + 1, 0, 1)}
