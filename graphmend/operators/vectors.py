"""Cached vectors of nodes: by id, then by literal key, then the entry of the unknown token.

The cache is a table bucketed and sorted by id, written once: lookups are exchanged by id, the cache is read in place.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN_TEXT = "unknown"


class VectorCache:
    """(id, key, text, vector): entries with an id, a literal key, or both."""

    def __init__(self, entries: DataFrame, path: str) -> None:
        self.spark = entries.sparkSession
        self.name, buckets = f"vectors_{uuid4().hex}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = entries.select("id", "key", "text", "vector").repartition(buckets, "id")
        rows.write.format("parquet").bucketBy(buckets, "id").sortBy("id").option("path", path).saveAsTable(self.name)

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def fallback(self) -> DataFrame:
        """One row: the vector of the entry whose text is ``unknown``, else of the least id."""
        ranked = F.struct(F.col("text") != UNKNOWN_TEXT, "id")
        return self.entries().where("id is not null").agg(F.min_by("vector", ranked).alias("other"))

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Adds ``vector`` and ``source`` (id, literal or unknown) to rows of (id, key, ...).

        Different ids and keys are looked up once each; ids meet the cache without an exchange on its side.
        """
        ids = wanted.select("id").where("id is not null").distinct()
        by_id = ids.join(self.entries().where("id is not null").select("id", F.col("vector").alias("v1")).hint("merge"), "id")
        keys = self.entries().where("key is not null").groupBy("key").agg(F.min_by("vector", F.coalesce("id", F.lit(0))).alias("v2"))
        rows = wanted.join(by_id.groupBy("id").agg(F.first("v1").alias("v1")), "id", "left").join(keys, "key", "left").crossJoin(F.broadcast(self.fallback()))  # one row
        source = F.when(F.col("v1").isNotNull(), "id").when(F.col("v2").isNotNull(), "literal").otherwise("unknown")
        return rows.withColumns({"vector": F.coalesce("v1", "v2", "other"), "source": source}).drop("v1", "v2", "other")

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
