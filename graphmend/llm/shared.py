"""Helpers that every operator of this subpackage uses: shared folders, written tables, sizes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent and Spark runs in one process (local tests) a temporary folder is chosen and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="graphmend-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more (tables of another make are left alone)."""
    for table in tables:
        if path := table.__dict__.pop("written_path", None):
            delete(table.sparkSession, path)


def reading(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df`` with the written tables that it reads named in ``reads``, to be forgotten once it is written itself."""
    df.reads = tables
    return df


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def each_text(
    docs: DataFrame, text_col: str, carry: list[str], fields: str, make: Callable[[], Callable[[list], list[pa.Array]]]
) -> DataFrame:
    """Columns ``carry`` of each row as the struct ``carried``, and new ``fields`` made from its text.

    ``make`` runs once a task and gives the function from a batch of texts (null stays None) to one array a field. Rows
    stay where they are: no shuffle. The struct keeps carried names apart from the new ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, names = make(), None
        for batch in slices(batches):
            made = work(batch.column(1).to_pylist())
            names = ["carried", *(f"f{i}" for i in range(len(made)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=names)

    source = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["carried"].dataType.simpleString()
    return source.mapInArrow(run, f"carried {kind}, {fields}")
