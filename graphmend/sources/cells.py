"""Registries stored as JSON cells: written in cells of bounded size, read as variants whatever their layout, keyed by id.

A cell is one JSON object, raw constraint id to entry. It is parsed once; entries are unfolded and read in the same stage, each
field by its key or by the key of an older layout.

Results for odd input: a null cell has no entries; a cell that is no JSON object (a key that stands twice in it among the
reasons) is one row without raw id, and an entry that is no object one without fields, their text in ``rescued`` under the empty
key; a value of the wrong type is null and its text is in ``rescued`` under its own key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmend.functions.tokens import DIRECT, ENTITY, token

#: Entries that a cell holds on average.
PER_CELL = 1000
#: Of each column: its keys, the present one first, and its type.
FIELDS = {
    "type_item": (("constraint_type_item",), "string"),
    "family": (("constraint_family", "constraint_type_name"), "string"),
    "supported": (("constraint_family_supported", "constraint_type_supported"), "boolean"),
    "given_index": (("constraint_type_index",), "bigint"),
    "property": (("constrained_property",), "string"),
    "param_predicates": (("param_predicates",), "array<string>"),
    "param_objects": (("param_objects",), "array<string>"),
}


def write_cells(entries: DataFrame, path: str, per_cell: int = PER_CELL) -> None:
    """Writes (raw_id, entry as JSON text) as cells; raw ids are unique."""
    cells = max(1, entries.count() // per_cell)
    rows = entries.select("raw_id", F.parse_json("entry").alias("v"), F.pmod(F.xxhash64("raw_id"), F.lit(cells)).alias("cell"))
    whole = rows.groupBy("cell").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("raw_id", "v")))).alias("registry_json"))
    whole.select("registry_json").write.mode("overwrite").parquet(path)


def _value(key: str, kind: str) -> Column:
    return F.try_variant_get("value", f"$.{key}", kind)


def _rescued() -> Column:
    """What could not be read, by key; null if nothing."""
    whole = F.when(F.col("v").isNull(), F.col("cell")).otherwise(F.to_json("value"))
    parts = [F.when(F.col("v").isNull() | ~F.schema_of_variant("value").startswith("OBJECT"), F.struct(F.lit("").alias("k"), whole.alias("t")))]
    for keys, kind in FIELDS.values():
        parts += [F.when(_value(k, kind).isNull() & _value(k, "string").isNotNull(), F.struct(F.lit(k).alias("k"), _value(k, "string").alias("t"))) for k in keys]
    found = F.array_compact(F.array(*parts))
    return F.when(F.size(found) > 0, F.map_from_entries(found))


def read_cells(cells: DataFrame, column: str = "registry_json") -> DataFrame:
    """A row per entry: raw_id, the columns of ``FIELDS``, rescued.

    A blank family gives way to the older key's, lists are without nulls, a missing list is empty.
    """
    parsed = cells.select(F.col(column).alias("cell"), F.try_parse_json(column).alias("v")).where("cell is not null")
    parsed = parsed.select("cell", F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v")).alias("v"))
    rows = parsed.lateralJoin(cells.sparkSession.tvf.variant_explode_outer(F.col("v").outer()))
    read = {n: F.coalesce(*(_value(k, kind) for k in keys)) for n, (keys, kind) in FIELDS.items()}
    names = FIELDS["family"][0]
    read["family"] = F.coalesce(*(F.nullif(_value(k, "string"), F.lit("")) for k in names), F.lit(""))
    read["type_item"] = F.coalesce(read["type_item"], F.lit(""))
    read["supported"] = F.coalesce(read["supported"], F.lit(False))
    for n in ("param_predicates", "param_objects"):
        read[n] = F.coalesce(F.array_compact(read[n]), F.array().cast("array<string>"))
    rows = rows.where("key is not null or v is null")
    return rows.select(F.col("key").alias("raw_id"), *(c.alias(n) for n, c in read.items()), _rescued().alias("rescued"))


def read_registry(spark: SparkSession, path: str, column: str = "registry_json") -> DataFrame:
    """Entries of stored cells with ``constraint_key``, ``property`` as a token, and ``type_index``: the given one, else the dense
    number of the trimmed type item, -1 for a blank one. As many rows meet the index as there are types."""
    from graphmend.operators.registry import type_index

    rows = read_cells(spark.read.parquet(path), column).withColumn("type_item", F.trim("type_item"))
    numbers = type_index(rows, "type_item").withColumnRenamed("type_index", "dense_index")
    rows = rows.join(numbers, "type_item", "left").withColumn("type_index", F.coalesce("given_index", "dense_index"))
    return rows.withColumns({"constraint_key": token(F.col("raw_id")), "property": token(F.col("property"))}).drop("given_index", "dense_index")


def spellings(raw: Column) -> Column:
    """What a vocabulary may call a raw id, in order of preference: as URI, as URI in brackets, by its last segment.

    Direct-property URIs are looked for as entities. Other ids (of statements, say) are looked for as they are.
    """
    plain = F.trim(F.regexp_replace(F.trim(raw), "^<(.*)>$", "$1"))
    plain = F.regexp_replace(plain, f"^{DIRECT.replace('.', '[.]')}", ENTITY)
    bracketed = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    tail, uri = F.nullif(F.regexp_extract(plain, "/([PQ][0-9]+)$", 1), F.lit("")), F.concat(F.lit(ENTITY), plain)
    tried = F.when(plain.rlike("^https?://"), F.array(plain, bracketed(plain), tail))
    tried = tried.when(plain.rlike("^[PQ][0-9]+$"), F.array(uri, bracketed(uri), plain)).otherwise(F.array(plain))
    return F.filter(tried, lambda x: x.isNotNull() & (x != ""))


def resolve_ids(raw: DataFrame, vocabulary: DataFrame, column: str) -> DataFrame:
    """Adds ``id`` of the first spelling that the vocabulary (token, id) holds; null if none. Id 0 is no id."""
    names = raw.select(F.col(column).alias("r")).distinct().select("r", F.posexplode(spellings(F.col("r"))).alias("rank", "t"))
    found = names.join(vocabulary.where("id <> 0").select(F.col("token").alias("t"), "id"), "t")
    best = found.groupBy("r").agg(F.min_by("id", F.struct("rank", "id")).alias("id"))
    return raw.join(best, F.col(column) == F.col("r"), "left").drop("r")


def by_id(entries: DataFrame, vocabulary: DataFrame, attached: DataFrame) -> DataFrame:
    """Entries with ``id`` and ``side``, and a row for each attached id without an entry.

    ``side`` is both, registry (no record attaches the id), unresolved (the vocabulary lacks the raw id), or records (an
    attached id without an entry). Of several raw ids with one id the greatest raw id's entry stands.
    """
    keyed = resolve_ids(entries.where("raw_id is not null"), vocabulary, "raw_id")
    last = keyed.where("id is not null").groupBy("id").agg(F.max("raw_id").alias("raw_id"))
    ids = attached.select("id").distinct().withColumn("held", F.lit(True))
    rows = keyed.where("id is not null").join(last, ["id", "raw_id"], "left_semi").join(ids, "id", "full")
    side = F.when(F.col("raw_id").isNull(), "records").when(F.col("held"), "both").otherwise("registry")
    rest = keyed.where("id is null").withColumn("side", F.lit("unresolved"))
    return rows.withColumn("side", side).drop("held").unionByName(rest)
