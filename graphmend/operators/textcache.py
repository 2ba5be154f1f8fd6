"""Text cache: keys to look up, incremental merge, lookups with a fallback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmend.functions.tokens import lookup_id


def merge(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """(kind, key, id, text, state) for the wanted (kind, key, id): ``hit``, ``copied`` from another id, or ``pending``.

    ``cache`` is (kind, key, id, text); an id may be null, and equals null there.
    """
    own = cache.where("text is not null").groupBy(F.col("kind").alias("a"), F.col("key").alias("b"), F.col("id").alias("c")).agg(F.max("text").alias("hit"))
    other = cache.groupBy("kind", "key").agg(F.min("text").alias("any"))
    same = (F.col("kind") == F.col("a")) & (F.col("key") == F.col("b")) & F.col("id").eqNullSafe(F.col("c"))
    per = wanted.distinct().join(own, same, "left").drop("a", "b", "c").join(other, ["kind", "key"], "left")
    state = F.when(F.col("hit").isNotNull(), "hit").when(F.col("any").isNotNull(), "copied").otherwise("pending")
    return per.select("kind", "key", "id", F.coalesce("hit", "any").alias("text"), state.alias("state"))


def lookup(wanted: DataFrame, cache: DataFrame, fallback: str) -> DataFrame:
    """Adds the text by id, else by literal key, else the fallback."""
    by_id = cache.where("id is not null").groupBy("id").agg(F.min("text").alias("by_id"))
    by_key = cache.where("kind = 'literal'").groupBy("key").agg(F.min("text").alias("by_key"))
    rows = wanted.join(by_id, "id", "left").join(by_key, "key", "left")
    return rows.withColumn("text", F.coalesce("by_id", "by_key", F.lit(fallback))).drop("by_id", "by_key")


def registry_ids(registry: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(key, id, occurrences): the properties and parameter values that the registry names; id null if unresolved.

    ``registry`` has (property, values), ``vocabulary`` (key, id).
    """
    named = registry.select(F.explode(F.array_union(F.array("property"), "values")).alias("key")).where("key is not null and key <> ''")
    return named.groupBy("key").agg(F.count("*").alias("occurrences")).join(vocabulary, "key", "left").select("key", "id", "occurrences")


def with_labels(spelled: DataFrame, labels: DataFrame, column: str = "uri") -> DataFrame:
    """Fetched labels (entity, label), once an entity, given to every spelling of it."""
    return spelled.withColumn("entity", lookup_id(F.col(column))).join(labels, "entity", "left")


#: Files of a stored cache: their ranges go to every task as one row.
MOST_FILES = 4096


class SortedCache:
    """(kind, key, id, text) stored in order of kind, key and id; a table beside it holds the range of each file.

    A lookup finds the files of each wanted key by bisection of the ranges, in the row, and reads those files alone. A key with
    more ids than a file holds spans several; all of them are read.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, cache: DataFrame, files: int) -> None:
        """Stores the cache in at most so many files, of nearly equal rows."""
        if files > MOST_FILES:
            raise ValueError(f"more than {MOST_FILES} files")
        order = ["kind", "key", "id"]
        cache.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{self.path}/data")
        name, place = F.col("_metadata.file_path").alias("file"), F.struct("kind", "key").alias("at")
        held = self.rows().select(name, place).groupBy("file").agg(F.min("at").alias("low"), F.max("at").alias("high"))
        held.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ranges")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data")

    def files_of(self, wanted: DataFrame) -> list[str]:
        """The files whose range holds a key of ``wanted`` (kind, key): as many as there are files, at most."""
        ranges = self.spark.read.parquet(f"{self.path}/ranges")
        row = ranges.agg(F.array_sort(F.collect_list(F.struct("low", "high", "file"))).alias("r")).select(F.col("r.low").alias("lows"), F.col("r.high").alias("highs"), F.col("r.file").alias("files"))
        at = F.struct("kind", "key")
        keys = wanted.select("kind", "key").where("kind is not null and key is not null").distinct().crossJoin(F.broadcast(row))  # one row
        first = _bisected(F.size("files"), lambda i: F.get("highs", i) < at)
        beyond = _bisected(F.size("files"), lambda i: F.get("lows", i) <= at)
        found = keys.select(F.explode(F.when(first < beyond, F.slice("files", first + 1, beyond - first))).alias("file")).distinct()
        return [r.file for r in found.collect()]  # MOST_FILES at most

    def of(self, wanted: DataFrame) -> DataFrame:
        """The stored rows of the wanted keys, and some beside them, from the files that hold such keys."""
        files = self.files_of(wanted)
        rows = self.rows()
        return self.spark.read.schema(rows.schema).parquet(*files) if files else rows.limit(0)


def _bisected(n: Column, before: Callable[[Column], Column]) -> Column:
    """The first place 0 .. n at which ``before`` does not hold, where it holds at all places up to some one."""
    whole = F.struct(F.lit(0).alias("lo"), n.alias("hi"))
    half = lambda s: F.shiftright(s["lo"] + s["hi"], 1)
    step = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(before(half(s)), F.struct((half(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), half(s).alias("hi")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(MOST_FILES.bit_length())), whole, step)["lo"]
