"""Readers of raw corrections and constraint definitions, and the derivation of such lines from the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmend.functions.tokens import DIRECT, ENTITY, literal_text, property_id, status_phrase, token

#: Role tokens in order, the predicate of a label found in a page, places of a correction's fields.
ROLES = ("subject", "predicate", "object", "other_subject", "other_predicate", "other_object")
HISTORY = "http://wikiba.se/history/ontology#"
CONTAINS_LABEL = f"{HISTORY}pageContainsLabel"
FIRST_KIND, STEP = 12, 4
PAGE = "type string, id string, labels map<string,string>, facts map<string,array<string>>, statusCode int, content string"


def read_corrections(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(value, constraint_type): lines of (gzipped) files; the type is the file name's first part.

    Gzip files can't be split, so rows are dealt out anew after the scan.
    """
    lines = spark.read.text(paths)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[a-z]+)*(?:\.tsv|\.txt)?(?:\.gz)?$", 1)
    return lines.withColumn("constraint_type", name).repartition(spark.sparkContext.defaultParallelism)


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)


def parse_corrections(lines: DataFrame) -> DataFrame:
    """Fields, last added and last deleted triple, and up to three trailing descriptions of each line.

    Descriptions are the longest run of blank or JSON fields at the end, the last three of it. A kind stands at place 12,
    16, ... before that whole run; the three fields before it are its triple. Only the two URIs are kinds, other fields
    there are skipped.
    """
    rows = lines.withColumn("f", F.split("value", "\t", -1))
    at = lambda i: F.get("f", i)
    edits = F.transform("places", lambda i: F.struct(at(i - 3).alias("s"), at(i - 2).alias("p"), at(i - 1).alias("o"), at(i).alias("kind")))
    last = lambda word: F.try_element_at(F.filter("edits", lambda e: e["kind"] == f"<{HISTORY}{word}>"), F.lit(-1))
    blob = lambda x: (F.trim(x) == "") | (F.trim(x).startswith("{") & F.trim(x).endswith("}"))
    step = lambda a, x: F.when(a["done"] | ~blob(x), F.struct(F.lit(True).alias("done"), a["n"].alias("n"))).otherwise(F.struct(F.lit(False).alias("done"), (a["n"] + 1).alias("n")))
    run = F.aggregate(F.reverse("f"), F.struct(F.lit(False).alias("done"), F.lit(0).alias("n")), step, lambda a: a["n"])
    end = F.size("f") - F.col("run") - 1
    places = F.when(end >= FIRST_KIND, F.sequence(F.lit(FIRST_KIND), end, F.lit(STEP))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("run", run).withColumn("places", places).withColumns({"edits": edits, "run": F.least("run", F.lit(3))})
    blank = lambda x: F.coalesce(x, F.lit(""))
    return rows.select(
        *(c for c in lines.columns if c != "value"), blank(at(F.lit(0))).alias("constraint_id"),
        *(blank(at(F.lit(i))).alias(n) for i, n in enumerate(("subject", "predicate", "object", "other_subject", "other_predicate", "other_object"), 2)),
        *(blank(last(w)[x]).alias(f"{a}_{x}") for a, w in (("add", "addition"), ("del", "deletion")) for x in "spo"),
        F.when(F.col("run") > 0, F.slice("f", -F.col("run"), F.col("run"))).otherwise(F.array().cast("array<string>")).alias("descriptions"),
    )


def parse_page(raw: Column) -> Column:
    """A description as (kind, id, labels, facts): pages give their status as a fact; bad JSON gives nulls."""
    found = F.from_json(raw, PAGE)
    pairs = lambda f: F.flatten(F.transform(F.map_entries(f), lambda e: F.transform(e["value"], lambda v: F.struct(e["key"].alias("p"), v.alias("o")))))
    status = F.array(F.struct(F.lit("status").alias("p"), status_phrase(found["statusCode"]).alias("o")))
    facts = F.when(found["statusCode"].isNotNull(), status).otherwise(F.coalesce(pairs(found["facts"]), F.array().cast("array<struct<p:string,o:string>>")))
    return F.struct(found["type"].alias("kind"), found["id"].alias("id"), F.map_values(found["labels"]).alias("labels"), facts.alias("facts"), found["content"].alias("content"))


def mentions(labels: Column, content: Column) -> Column:
    """Whether a page's content holds any of an entity's labels; an empty label is in any content, no label in none."""
    return F.coalesce(F.exists(labels, lambda x: content.contains(x)), F.lit(False))


def capped(lines: DataFrame, per_file: int | None = None, overall: int | None = None) -> DataFrame:
    """The first lines of each file and of all files, in order of ``file`` and ``line``; null sets no cap."""
    if per_file is not None:
        place = F.row_number().over(Window.partitionBy("file").orderBy("line"))
        lines = lines.withColumn("place", place).where(F.col("place") <= per_file).drop("place")
    return lines if overall is None else lines.orderBy("file", "line").limit(overall)


def assigned(parsed: DataFrame) -> DataFrame:
    """Adds the description structs ``subject_d``, ``object_d`` and ``other_d`` (null if none).

    Entities go to the role whose id they have (an object only if it is an entity), the first page to an object without
    one; what is left fills subject, object and other in order.
    """
    rows = parsed.withColumn("d", F.transform("descriptions", parse_page))
    at = F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: F.get("d", i)["kind"].isNotNull() | F.get("d", i)["id"].isNotNull())
    rows = rows.withColumn("at", at)
    got = lambda s, x, o: F.struct(s.alias("s"), x.alias("x"), o.alias("o"))
    none = F.lit(-1)

    def step(a: Column, i: Column) -> Column:
        named = lambda role: F.trim(F.get("d", i)["id"]) == F.trim(F.col(role))
        entity = F.get("d", i)["kind"] == "entity"
        return (
            F.when(entity & named("subject") & (a["s"] < 0), got(i, a["x"], a["o"]))
            .when(entity & named("other_subject") & (a["x"] < 0), got(a["s"], i, a["o"]))
            .when(entity & named("object") & F.trim("object").startswith(f"<{ENTITY}") & (a["o"] < 0), got(a["s"], a["x"], i))
            .otherwise(a)
        )

    rows = rows.withColumn("r", F.aggregate("at", got(none, none, none), step))
    page = F.get(F.filter("at", lambda i: F.get("d", i)["kind"] == "page"), F.lit(0))
    rows = rows.withColumn("r", got(F.col("r.s"), F.col("r.x"), F.when(F.col("r.o") < 0, F.coalesce(page, none)).otherwise(F.col("r.o"))))
    rows = rows.withColumn("left", F.filter("at", lambda i: ~i.isin(F.col("r.s"), F.col("r.x"), F.col("r.o"))))
    one = lambda c: (F.col(f"r.{c}") < 0).cast("int")
    before = {"s": F.lit(0), "o": one("s"), "x": one("s") + one("o")}
    pick = lambda c: F.get("d", F.when(F.col(f"r.{c}") >= 0, F.col(f"r.{c}")).otherwise(F.get("left", before[c])))
    return rows.withColumns({"subject_d": pick("s"), "object_d": pick("o"), "other_d": pick("x")}).drop("d", "at", "r", "left")


def in_tokens(parsed: DataFrame) -> DataFrame:
    """Raw corrections as records of tokens: roles, literal texts, edits with role tokens, facts with found labels."""
    rows = assigned(parsed)
    facts = lambda d: F.transform(F.coalesce(F.col(f"{d}.facts"), F.array().cast("array<struct<p:string,o:string>>")), lambda f: F.struct(token(f["p"]).alias("p"), token(f["o"]).alias("o")))
    # (page's role, labels' role, what the fact names), in this order.
    found = (("object", "subject", "subject"), ("object", "other", "other_subject"), ("other", "subject", "subject"), ("other", "object", "object"))

    def with_labels(role: str) -> Column:
        held = [
            F.when(mentions(F.col(f"{of}_d.labels"), F.col(f"{on}_d.content")), F.struct(F.lit(CONTAINS_LABEL).alias("p"), token(F.col(name)).alias("o")))
            for on, of, name in found
            if on == role
        ]
        return F.concat(facts(f"{role}_d"), F.array_compact(F.array(*held))) if held else facts(f"{role}_d")

    def substituted(raw: str) -> Column:
        value = token(F.col(raw))
        marks = reduce(lambda a, r: a.when((value == token(F.col(r))) & (F.col(r) != ""), r), ROLES[1:], F.when((value == token(F.col(ROLES[0]))) & (F.col(ROLES[0]) != ""), ROLES[0]))
        return F.when(F.coalesce(F.col(raw), F.lit("")) == "", "").otherwise(marks.otherwise(value))

    parts = {"s": "subject", "p": "predicate", "o": "object"}
    return rows.select(
        *(c for c in parsed.columns if c in ("violation_id", "constraint_type")), "constraint_id", *(token(F.col(r)).alias(r) for r in ROLES),
        literal_text(F.col("object")).alias("object_text"), literal_text(F.col("other_object")).alias("other_object_text"),
        *(substituted(f"{a}_{x}").alias(f"{a}_{n}") for a in ("add", "del") for x, n in parts.items()),
        *(with_labels(r).alias(f"{n}_facts") for r, n in (("subject", "subject"), ("object", "object"), ("other", "other_entity"))),
        property_id(F.col("predicate")).alias("main_property"), property_id(F.col("other_predicate")).alias("other_property"),
    )


def literal_texts(rows: DataFrame) -> DataFrame:
    """(text): distinct trimmed literal texts of records, without empty ones and "nan"."""
    each = rows.select(F.explode(F.array("object_text", "other_object_text")).alias("text")).select(F.trim("text").alias("text"))
    return each.where("text is not null and text not in ('', 'nan')").distinct()


def build(lines: DataFrame, definitions: DataFrame) -> DataFrame:
    """Records of known constraints with the constraints of the properties around them and of their own properties.

    ``definitions`` is (constraint_id, property), one row a constraint; lines of other constraints are dropped.
    """
    parsed = parse_corrections(lines).join(definitions.select("constraint_id"), "constraint_id", "left_semi")
    rows = in_tokens(parsed).join(definitions.withColumnRenamed("property", "own_property"), "constraint_id")
    near = F.concat(*(F.transform(f"{r}_facts", lambda f: property_id(f["p"])) for r in ("subject", "object", "other_entity")))
    focus = F.array_compact(F.array("main_property", "other_property", "own_property"))
    local = F.array_compact(F.array_union(F.array("main_property", "other_property"), near))
    index = definitions.groupBy("property").agg(F.array_sort(F.collect_list("constraint_id")).alias("ids"))
    keyed = rows.select("violation_id", F.explode(F.array_union(local, focus)).alias("property"), local.alias("local"), focus.alias("focus")).join(index, "property")
    inside = lambda c: F.flatten(F.collect_list(F.when(F.array_contains(c, F.col("property")), F.col("ids"))))
    sets = keyed.groupBy("violation_id").agg(inside("local").alias("local_ids"), inside("focus").alias("focus_ids"))
    closed = lambda c: F.array_sort(F.array_distinct(F.concat(F.coalesce(F.col(c), F.array().cast("array<string>")), F.array("constraint_id"))))
    keep = [c for c in rows.columns if c not in ("main_property", "other_property", "own_property")]
    return rows.join(sets, "violation_id", "left").select(*keep, closed("local_ids").alias("local_constraint_ids"), closed("focus_ids").alias("local_constraint_ids_focus"))


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(violation_id, value): a correction a line, made from orders: entity and literal objects, pages, other triples;
    some with an edit of an unknown kind, some with more than three description fields, which can hold the words of kinds."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    uri = lambda x: F.concat(F.lit(f"<{ENTITY}Q"), x, F.lit(">"))
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"^^<http://www.w3.org/2001/XMLSchema#string>'))
    subject, rival = uri(key), uri(F.concat(F.lit("8"), key))
    item = n % 3 == 0
    thing = F.when(item, uri(F.concat(F.lit("9"), F.col("o_custkey").cast("string")))).otherwise(quoted(F.col("o_orderstatus")))
    direct = lambda p: F.lit(f"<{DIRECT}{p}>")
    has_other, none = n % 4 == 0, F.lit("")
    other = [F.when(has_other, x).otherwise(none) for x in (rival, direct("P102"), subject)]
    base = [F.concat(F.lit("c"), (n % 11).cast("string")), none, subject, direct("P101"), thing, *other, none]
    gone = F.concat_ws("\t", subject, direct("P101"), thing, F.lit(f"<{HISTORY}deletion>"))
    new = F.concat_ws("\t", rival, direct("P102"), quoted(F.col("o_orderpriority")), F.lit(f"<{HISTORY}addition>"))
    entity = lambda i, label: F.to_json(F.struct(F.lit("entity").alias("type"), i.alias("id"), F.create_map(F.lit("en"), label).alias("labels"), F.create_map(F.lit(f"<{DIRECT}P1>"), F.array(subject, i)).alias("facts")))
    page = F.to_json(F.struct(F.lit("page").alias("type"), F.lit(200).alias("statusCode"), F.when(n % 7 == 1, F.concat("o_orderpriority", F.lit(" in addition to this deletion"))).otherwise(F.col("o_orderpriority")).alias("content")))
    mine, theirs = entity(subject, F.col("o_orderstatus")), F.when(item, entity(thing, F.lit("thing"))).otherwise(page)
    third = F.when(has_other, entity(rival, F.substring("o_orderpriority", 3, 3))).otherwise(none)
    pair = F.when(n % 2 == 0, F.concat_ws("\t", theirs, mine)).otherwise(F.concat_ws("\t", mine, theirs))
    odd = F.when(n % 6 == 1, F.concat_ws("\t", rival, direct("P9"), rival, F.lit(f"<{HISTORY}additional>")))
    more = F.when(n % 7 == 1, F.concat_ws("\t", none, F.lit('{"type":"page","statusCode":404,"content":"addition"}')))
    value = F.concat_ws("\t", *base, odd, F.when(n % 5 == 0, F.concat_ws("\t", gone, new)).otherwise(gone), more, pair, third)
    return orders.select(n.alias("violation_id"), value.alias("value"))


def lines_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(violation_id, value): a correction line per order, with its events' JSON fields as descriptions."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey").cast("string")
    uri = lambda x: F.concat(F.lit("<http://www.wikidata.org/entity/"), x, F.lit(">"))
    gone = [uri(F.concat(F.lit("Q"), key)), F.lit("<http://www.wikidata.org/prop/direct/P101>"), uri(F.concat(F.lit("Q9"), F.col("o_custkey").cast("string")))]
    new = [gone[0], gone[1], F.concat(F.lit('"'), "o_orderstatus", F.lit('"^^<http://www.w3.org/2001/XMLSchema#string>'))]
    fields = [F.concat(F.lit("c"), (F.col("o_orderkey") % 9).cast("string")), F.lit(""), *gone, F.lit(""), F.lit(""), F.lit(""), F.lit("")]
    once = F.concat_ws("\t", *fields, *gone, F.lit(f"<{HISTORY}deletion>"))
    twice = F.concat_ws("\t", once, *new, F.lit(f"<{HISTORY}addition>"))
    tail = F.concat(F.lit('{"type":"entity","id":"Q'), key, F.lit('","labels":{"en":"'), "o_orderstatus", F.lit('"},"facts":{"P1":["a","b"]}}'))
    value = F.concat_ws("\t", F.when(F.col("o_orderkey") % 2 == 0, twice).otherwise(once), tail, F.lit(""))
    return orders.select(F.col("o_orderkey").alias("violation_id"), value.alias("value"))


def normalised(parsed: DataFrame) -> DataFrame:
    """Parsed corrections with property ids, tokens and literal texts in place of raw spellings."""
    return parsed.select(
        *(c for c in parsed.columns if c == "violation_id"), "constraint_id", token(F.col("subject")).alias("subject"),
        property_id(F.col("predicate")).alias("predicate"), token(F.col("object")).alias("object"),
        *(token(F.col(f"{a}_{x}")).alias(f"{a}_{x}") for a in ("add", "del") for x in "sp"),
        literal_text(F.col("add_o")).alias("add_text"), F.size("descriptions").cast("long").alias("n_descriptions"),
    )
