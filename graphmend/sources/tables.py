"""Readers and writers of record tables: predictions, sharded graph tables with manifests, report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmend.operators.baselines import SLOTS
from graphmend.sources.ingest import numbered_lines

#: Bytes of a file that its digest in a manifest covers.
DIGEST_BYTES = 16 << 20


def to_id(value: Column) -> Column:
    """A scalar as an id: null and unreadable values are 0."""
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("long"))


def to_ids(values: Column, zero_fill: bool = False) -> Column:
    """A list as ids: unreadable elements are left out, or 0 if ``zero_fill``; null is the empty list."""
    each = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.try_cast("bigint"))
    return F.transform(each, lambda x: F.coalesce(x, F.lit(0).cast("long"))) if zero_fill else F.filter(each, lambda x: x.isNotNull())


def to_type(value: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit("UNKNOWN"))


def read_optional(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """Those of the wanted columns that the table has."""
    rows = spark.read.parquet(path)
    return rows.select(*(c for c in wanted if c in rows.columns))


def edit_slots(line: Column) -> Column:
    """The six slots of a prediction's JSON: a flat list, {"slots": [6]}, or {"add": [3], "del" or "delete": [3]}.

    A missing or null half is no edit; null where six ids can't be read.
    """
    v = F.try_parse_json(line)
    ids = lambda path: F.try_variant_get(v, path, "array<bigint>")
    none = F.array(*(F.lit(0).cast("long"),) * 3)
    stored = lambda key: F.when(F.try_variant_get(v, f"$.{key}", "string").isNull(), none).otherwise(ids(f"$.{key}"))
    gone = F.when(F.try_variant_get(v, "$.del", "string").isNull(), stored("delete")).otherwise(ids("$.del"))
    is_list = F.schema_of_variant(v).startswith("ARRAY")
    six = F.when(is_list, ids("$")).when(F.try_variant_get(v, "$.slots", "string").isNotNull(), ids("$.slots"))
    return six.otherwise(F.when(F.schema_of_variant(v).startswith("OBJECT"), F.concat(stored("add"), gone)))


def _checked(six: Column) -> Column:
    """The slots, or an error from the task that meets a broken prediction: no pass over the file before the reading one."""
    sound = (F.size(six) == 6) & ~F.exists(six, lambda x: x.isNull() | (x < 0))
    return F.when(F.coalesce(sound, F.lit(False)), six).otherwise(F.raise_error(F.lit("predictions need six ids of 0 or more")))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(violation_id, slots) from JSON lines with a violation_id, in any layout of ``edit_slots``."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    key = F.try_variant_get(F.try_parse_json("value"), "$.violation_id", "bigint")
    rows = rows.select(key.alias("violation_id"), _checked(edit_slots(F.col("value"))).alias("six"))
    return rows.select("violation_id", *(F.get("six", i).alias(n) for i, n in enumerate(SLOTS)))


def ordered_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, slots) of predictions that stand in the order of the records of their file, numbered from 0."""
    rows = numbered_lines(spark, path).select("file", "line", _checked(edit_slots(F.col("value"))).alias("six"))
    return rows.select("file", "line", *(F.get("six", i).alias(n) for i, n in enumerate(SLOTS)))


def rows_after(rows: DataFrame, skip: int, most: int | None = None) -> DataFrame:
    """Rows behind the record ``skip``, in order of their ids; the first ``most`` of them if given."""
    rest = rows.where(F.col("violation_id") > skip)
    return rest if most is None else rest.orderBy("violation_id").limit(most)


def first_rows(rows: DataFrame, split: str, most: int) -> DataFrame:
    """The first records of a split by id, for a quick validation."""
    return rows.where(F.col("split") == split).orderBy("violation_id").limit(most)


def write_sharded(rows: DataFrame, path: str, per_file: int, mode: str = "overwrite", drop: tuple[str, ...] = ()) -> None:
    """Files of at most ``per_file`` rows by split; ``drop`` leaves debug columns out; mode ``ignore`` keeps what is there."""
    rows.drop(*drop).write.mode(mode).option("maxRecordsPerFile", per_file).partitionBy("split").parquet(path)


def missing_rows(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Rows that an interrupted write has not stored yet."""
    return rows.join(spark.read.parquet(path).select("violation_id"), "violation_id", "left_anti")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, rows, bytes, sha256): the digest covers a file's first 16 MiB."""
    counts = spark.read.parquet(path).groupBy(F.input_file_name().alias("file"), "split").agg(F.count("*").alias("rows"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    name = lambda c: F.substring_index(F.col(c), "/", -1)
    sizes = files.select(name("path").alias("name"), F.col("length").alias("bytes"), F.sha2(F.substring("content", 1, DIGEST_BYTES), 256).alias("sha256"))
    return counts.withColumn("name", name("file")).join(sizes, "name").select(F.col("name").alias("file"), "split", "rows", "bytes", "sha256")


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def validate(records: DataFrame) -> DataFrame:
    """Counts of records that break the schema's rules: one row."""
    from graphmend.sources.violations import LISTS, SCALARS

    scalars = [c for c in SCALARS if c in records.columns]
    lists = [c for c in LISTS if c in records.columns]
    return records.agg(
        F.count("*").alias("records"), (F.count("*") - F.count_distinct("violation_id")).alias("repeated_ids"),
        *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in (*scalars, *lists)),
        F.count_if(F.size("subject_predicates") != F.size("subject_objects")).alias("unequal_subject"),
    )
