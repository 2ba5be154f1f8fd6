"""Factor labels over a stream of records: labelling looks at one record at a time, so it needs no state or watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from graphmend.operators.labels import factors


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """New record files of a folder as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def label_stream(records: DataFrame, instances: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Labels each new record once and appends the labels to ``out``; stops when all that is there is done."""
    labels = factors(records, instances)
    return labels.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
