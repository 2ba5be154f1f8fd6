"""From files to numbered lines, and from records to shards by restartable writes with a ledger of kept and dropped rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Units that one pass counts: each has two counters in the plan.
MOST_UNITS = 512
#: Units that a task writes to at once without sorting its rows, and bytes of a row group, of which each writer holds one.
MOST_WRITERS, ROW_GROUP = 32, 8 << 20
OPEN_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def shared_folder(spark: SparkSession) -> str:
    """A new folder where executors and the driver both write: below ``spark.checkpoint.dir``, which a cluster must set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="graphmend-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/ingest-{uuid.uuid4().hex}"


def write_lines(lines: DataFrame, path: str, order: str) -> None:
    """(file, value) as one gzipped text file for each ``file``, its lines in order of a column."""
    dealt = lines.repartition("file").sortWithinPartitions("file", order)
    dealt.select("file", "value").write.option("compression", "gzip").partitionBy("file").text(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files under ``path``, numbered from 0 within their file.

    A scan reads each block of a file in order, so a line's number is its distance from the block's first row and the lines
    of the blocks before. Only a row a block is grouped and summed up: lines are neither sorted nor shuffled, and a file of
    any size needs no window.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = raw.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    ahead = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("path", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"), "first")
    name = F.regexp_extract("path", r"file=([^/]+)/[^/]*$", 1)
    file = F.when(name != "", name).otherwise(F.regexp_extract("path", r"([^/]+)$", 1))
    return raw.join(starts, ["path", "block"]).select(file.alias("file"), (F.col("at") - F.col("first") + F.col("before")).alias("line"), "value")


def capped(lines: DataFrame, per_file: int | None = None, overall: int | None = None) -> DataFrame:
    """The first lines of each file and of all files, in order of file and line; null sets no cap. A row a file is summed
    up, lines stay where they are."""
    kept = lines if per_file is None else lines.where(F.col("line") < per_file)
    if overall is None:
        return kept
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    before = kept.groupBy("file").agg(F.count("*").alias("n")).select("file", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return kept.join(before, "file").where(F.col("before") + F.col("line") < overall).drop("before")


class Shards:
    """A table of units (split, shard), written so that a killed run goes on where it stopped.

    A pass stages the missing units, moves each finished one into place by a rename, and enters it in the ledger with its
    kept and dropped rows, counted while they were written. What is not in the ledger does not exist: a later pass writes it
    again, and reads only rows of units that are missing.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int, splits: tuple[str, ...] = ("train", "val", "test")) -> None:
        if shards * len(splits) > MOST_UNITS:
            raise ValueError(f"more than {MOST_UNITS} units: use several tables")
        self.spark, self.path, self.shards, self.splits = spark, path.rstrip("/"), shards, splits
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def ledger(self) -> DataFrame:
        """(split, shard, kept, dropped) of finished units."""
        schema = "split string, shard int, kept long, dropped long"
        if not self.fs.exists(self.fs_path(f"{self.path}/ledger")):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.path}/ledger")

    def rows(self) -> DataFrame:
        """Rows of finished units."""
        done = self.ledger().select("split", "shard")
        return self.spark.read.parquet(f"{self.path}/data").join(F.broadcast(done), ["split", "shard"], "left_semi")  # MOST_UNITS rows

    def _stage(self, rows: DataFrame, staged: str, units: int) -> None:
        """Writes rows by unit. A task holds a writer for each unit, as long as they are few, and then needs no sort of all its
        rows; row groups are small, so that a task's buffers stay the same whatever it reads."""
        before = self.spark.conf.get(OPEN_WRITERS)
        self.spark.conf.set(OPEN_WRITERS, units if units <= MOST_WRITERS else 0)
        try:
            rows.write.option("parquet.block.size", ROW_GROUP).partitionBy("split", "shard").parquet(staged)
        finally:
            self.spark.conf.set(OPEN_WRITERS, before)

    def write(self, rows: DataFrame, keep: Column, stop_after: int | None = None) -> int:
        """Writes the units that the ledger lacks, without rows that ``keep`` rejects; how many it finished.

        ``rows`` have the columns split and shard. ``stop_after`` ends the pass after so many units, as a lost driver would.
        """
        done = {(r.split, r.shard) for r in self.ledger().collect()}
        missing = [(s, k) for s in self.splits for k in range(self.shards) if (s, k) not in done]
        if not missing:
            return 0
        of = lambda s, k: (F.col("split") == s) & (F.col("shard") == k)
        wanted = reduce(lambda a, b: a | b, (of(s, k) for s, k in missing))
        flagged = rows.where(wanted).withColumn("keep_", F.coalesce(keep, F.lit(False)))
        seen = Observation()
        counts = [F.count_if(of(s, k) & (F.col("keep_") == kept)).alias(f"{s}/{k}/{kept}") for s, k in missing for kept in (True, False)]
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        self._stage(flagged.observe(seen, *counts).where("keep_").drop("keep_"), staged, len(missing))
        found, finished = seen.get, 0
        for s, k in missing[:stop_after]:
            unit = f"split={s}/shard={k}"
            self.fs.delete(self.fs_path(f"{self.path}/data/{unit}"), True)  # moved but never entered
            self.fs.mkdirs(self.fs_path(f"{self.path}/data/split={s}"))
            if self.fs.exists(self.fs_path(f"{staged}/{unit}")):
                self.fs.rename(self.fs_path(f"{staged}/{unit}"), self.fs_path(f"{self.path}/data/{unit}"))
            entry = [(s, k, found[f"{s}/{k}/True"], found[f"{s}/{k}/False"])]
            self.spark.createDataFrame(entry, "split string, shard int, kept long, dropped long").coalesce(1).write.mode("append").json(f"{self.path}/ledger")
            finished += 1
        self.fs.delete(self.fs_path(staged), True)
        return finished
