"""Registered queries over stored forms that the given tables are written to first: registry cells, predictions, the filtered-id view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmend.functions.tokens import DIRECT, ENTITY
from graphmend.operators import baselines, registry, textcache, vocabulary
from graphmend.operators.idset import IdSet
from graphmend.sources import cells, ingest, tables
from graphmend.sources.violations import LISTS, SCALARS, table, violations

from . import queries as base

#: Occurrences under which the filtered-id view leaves a token out.
LEAST = 5
#: Records that a file of predictions holds.
PER_FILE = 1000
#: Files of the stored text cache.
CACHE_FILES = 16


def raw_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raw_id, entry): a part as a registry entry, its id in one of five spellings, its JSON in one of four layouts: the present
    keys; the older ones; a blank family beside the older key; values of wrong types."""
    n = F.col("p_partkey")
    text = n.cast("string")
    uri = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    raw_id = (
        F.when(n % 5 == 0, uri("Q", text)).when(n % 5 == 1, uri(f"<{ENTITY}Q", text, ">")).when(n % 5 == 2, uri(f"{DIRECT}P", text))
        .when(n % 5 == 3, uri("P", text, "$stmt-", text)).otherwise(uri("http://example.org/item/Q", text))
    )
    item = F.element_at(F.array(*map(F.lit, sorted(registry.TYPE_ITEMS)), F.lit(" Q1 "), F.lit("")), (n % 12 + 1).cast("int")).alias("constraint_type_item")
    place = F.concat(F.lit(f"<{ENTITY}P"), (100 + n % 37).cast("string"), F.lit(">")).alias("constrained_property")
    named, known = F.concat(F.lit("family "), F.col("p_brand")), n % 3 == 0
    params = F.array(F.concat(F.lit("P"), F.col("p_size").cast("string")))
    present = F.struct(item, place, named.alias("constraint_family"), known.alias("constraint_family_supported"), (n % 50).alias("constraint_type_index"), params.alias("param_predicates"))
    older = F.struct(item, place, named.alias("constraint_type_name"), known.alias("constraint_type_supported"), params.alias("param_predicates"))
    blank = F.struct(item, place, F.lit("").alias("constraint_family"), named.alias("constraint_type_name"), known.alias("constraint_type_supported"))
    wrong = F.struct(
        item, place, named.alias("constraint_family"), F.lit("perhaps").alias("constraint_family_supported"), F.lit("x").alias("constraint_type_index"),
        F.array(F.lit("P1"), F.lit(None).cast("string"), F.col("p_size").cast("string")).alias("param_predicates"), text.alias("param_objects"),
    )
    layouts = [F.to_json(s) for s in (present, older, blank, wrong)]
    entry = F.when(n % 4 == 0, layouts[0]).when(n % 4 == 1, layouts[1]).when(n % 4 == 2, layouts[2]).otherwise(layouts[3])
    return table(spark, sf_dir, "part").select(raw_id.alias("raw_id"), entry.alias("entry"))


def part_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, id): the spellings under which a vocabulary holds parts; one part in seven is missing."""
    n, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    held = F.array(
        *(
            F.when((n % 7).isin(*on), F.struct(F.concat(F.lit(a), text, *([F.lit("$stmt-"), text] if b == "$" else [F.lit(b)])).alias("token"), (n * 10 + k).alias("id")))
            for k, (on, a, b) in enumerate((((0,), f"{ENTITY}Q", ""), ((0, 1, 2), "Q", ""), ((1,), f"<{ENTITY}Q", ">"), ((3,), f"{ENTITY}P", ""), ((4, 5), "P", "$"), ((5,), "P", "")))
        )
    )
    return table(spark, sf_dir, "part").select(F.explode(F.array_compact(held)).alias("x")).select("x.*")


def registry_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry entries written as cells, read back, keyed by id, against the ids that line items attach."""
    path = ingest.shared_folder(spark)
    cells.write_cells(raw_entries(spark, sf_dir), path)
    attached = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 10 + F.col("l_linenumber") - 1).cast("long").alias("id"))
    rows = cells.by_id(cells.read_registry(spark, path), part_vocabulary(spark, sf_dir), attached)
    told = lambda c: F.array_join(c, ",").alias(c)
    rescued = F.array_join(F.transform(F.array_sort(F.map_entries("rescued")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return rows.select("side", "raw_id", "id", "constraint_key", "type_item", "family", "supported", "type_index", "property", told("param_predicates"), told("param_objects"), rescued.alias("rescued"))


def stored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions written in the order of the records, in four layouts, read back by their place in the file."""
    six = baselines.predictions(violations(spark, sf_dir)).where("variant = 'normal'")
    n, slots = F.col("violation_id"), [F.col(c).cast("string") for c in baselines.SLOTS]
    listed = lambda cs: F.concat(F.lit("["), F.concat_ws(",", *cs), F.lit("]"))
    halves = lambda name: F.concat(F.lit('{"add":'), listed(slots[:3]), F.lit(f',"{name}":'), listed(slots[3:]), F.lit("}"))
    nothing = F.greatest(*(F.col(c) for c in baselines.SLOTS[3:])) == 0
    value = F.when(n % 4 == 0, listed(slots)).when((n % 4 == 1) & nothing, F.concat(F.lit('{"del":null,"add":'), listed(slots[:3]), F.lit("}")))
    value = value.when(n % 4 == 3, F.concat(F.lit('{"slots":'), listed(slots), F.lit("}"))).when(n % 4 == 1, halves("del")).otherwise(halves("delete"))
    lines = six.select(n, F.concat(F.lit("p"), F.expr(f"cast(violation_id div {PER_FILE} as string)")).alias("file"), value.alias("value"))
    path = ingest.shared_folder(spark)
    ingest.write_lines(lines, path, "violation_id")
    return tables.ordered_predictions(spark, path)


def kept_set(spark: SparkSession, sf_dir: str) -> IdSet:
    """The reserved tokens and those that training records hold often."""
    records = violations(spark, sf_dir)
    often = vocabulary.frequencies(records.where("split = 'train'")).where(F.col("n") >= LEAST).select("token")
    kept = often.unionByName(spark.range(1, vocabulary.RESERVED_LAST + 1).select(F.col("id").alias("token")))
    return IdSet.of(kept, "token", ingest.shared_folder(spark))


def filtered_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records in contiguous ids, told by a digest of each field."""
    records = violations(spark, sf_dir)
    lists = [c for c in LISTS if c in records.columns]
    rows = kept_set(spark, sf_dir).renumbered(records, list(SCALARS), lists)
    fields = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), (F.col(c) if c in lists else F.array(c)).alias("values")) for c in (*SCALARS, *lists)))).alias("x")
    rows = rows.select("violation_id", fields).select("violation_id", "x.field", F.array_remove("x.values", 0).alias("values")).where("size(values) > 0")
    return rows.select("violation_id", "field", F.size("values").cast("long").alias("n"), F.md5(base.told("values").cast("binary")).alias("values_md5"))


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the orders' customers from a stored cache that holds customers with a balance: by id, else by the literal of the
    order's priority, of which the cache holds two, else the fallback."""
    n, wide = F.col("c_custkey"), F.col("c_custkey") + 2_000_000_000
    rows = table(spark, sf_dir, "customer")
    named = rows.where("c_acctbal >= 0").select(F.lit("uri").alias("kind"), F.concat(F.lit("Q"), n.cast("string")).alias("key"), wide.alias("id"), F.col("c_name").alias("text"))
    orders = table(spark, sf_dir, "orders")
    urgent = orders.where("o_orderpriority < '3'").groupBy(F.col("o_orderpriority").alias("key")).agg(F.concat(F.lit("priority "), F.max("o_orderpriority")).alias("text"))
    cache = named.unionByName(urgent.select(F.lit("literal").alias("kind"), "key", F.lit(None).cast("long").alias("id"), "text"))
    stored = textcache.SortedCache(spark, ingest.shared_folder(spark))
    stored.write(cache, CACHE_FILES)
    wanted = orders.select("o_orderkey", (F.col("o_custkey") + 2_000_000_000).alias("id"), F.concat(F.lit("Q"), F.col("o_custkey").cast("string")).alias("uri"), F.col("o_orderpriority").alias("key"))
    asked = wanted.select(F.lit("uri").alias("kind"), F.col("uri").alias("key")).unionByName(wanted.select(F.lit("literal").alias("kind"), "key"))
    return textcache.lookup(wanted, stored.of(asked), "unknown").select("o_orderkey", "id", "text")


QUERIES: dict[str, base.Query] = {"registry_cells": registry_cells, "stored_predictions": stored_predictions, "filtered_view": filtered_view, "cache_lookup": cache_lookup}
