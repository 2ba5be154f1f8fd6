"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (line hash, documents), bucketed and sorted by hash, so that joins with it merge and only the other
side is exchanged. Each new batch counts its lines, merge-anti-joins the settled runs (lines that are known to stand in
enough documents need no more counting) and adds what is left as a run of its own. ``FAN`` runs of a level are merged
into one of the next; lines that reach the limit there settle. After the last batch the open runs merge once more.

Then the lines of all documents meet the settled runs by hash, and each document drops its lines. Only documents and
32 bytes a different line of each are exchanged. **Hot lines**, which make up a ``HOT``-th of a batch's (line, document)
pairs, are at most ``HOT`` a batch: this bounded list goes to every task, and no key of the join holds a larger share.

Hashes are 128 bits (XXH3) of the key: the line without white space at either end, A to Z lowered.

Results for odd input: a null or empty text is one empty line, which has no key of one code point and stays; every row is
a document, also where ids or whole rows repeat; lines repeated within a document count once; a very long text is one
row; an empty table gives an empty result; columns named like the new ones are kept and the new ones get underscores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from uuid import uuid4

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import delete, forget, new_path, own_name, read_table, reading, slices, written

#: Fixed values of the contract: documents that make a line frequent, and code points of the shortest key.
DOCUMENTS, CHARS = 10, 1
SPACE = b" \t\n\x0b\x0c\r"
#: Batches of the registered query, and runs of a level that are merged.
BATCHES, FAN = 4, 2
HOT = 10_000
#: Different lines that a task counts before it hands them on.
HELD = 200_000


def keys(text: bytes) -> list[bytes]:
    return [line.strip(SPACE).lower() for line in text.split(b"\n")]  # bytes.lower() lowers A to Z only


def long_enough(key: bytes, chars: int) -> bool:
    return len(key) >= chars and (chars < 2 or len(key.decode()) >= chars)


def line_counts(docs: DataFrame, text_col: str, chars: int = CHARS) -> DataFrame:
    """(h, docs): documents of each line hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in slices(batches):
            for text in batch.column(0).cast(pa.large_binary()).to_pylist():
                held.update({xxhash.xxh3_128_digest(k) for k in set(keys(text)) if long_enough(k, chars)})
                if len(held) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["h", "docs"])
                    held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["h", "docs"])

    texts = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "h binary, docs long").groupBy("h").agg(F.sum("docs").alias("docs"))


class LineRuns:
    """Counts of line hashes that grow batch by batch."""

    def __init__(self, spark: SparkSession, documents: int = DOCUMENTS, fan: int = FAN, hot: int = HOT) -> None:
        self.spark, self.documents, self.fan, self.most_hot = spark, documents, fan, hot
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []
        self.hot: set[bytes] = set()
        self.tables: list[tuple[str, str]] = []

    def _saved(self, run: DataFrame) -> DataFrame:
        """A run as a bucketed, sorted table: a later join reads it without an exchange."""
        path, name = new_path(self.spark, "run"), f"line_run_{uuid4().hex}"
        run.write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", path).saveAsTable(name)
        self.tables.append((name, path))
        return self.spark.table(name)

    def add(self, counts: DataFrame) -> None:
        """Takes the (h, docs) of one more batch."""
        batch = written(counts, "batch")
        pairs = batch.agg(F.sum("docs")).first()[0] or 0
        hot = batch.where(F.col("docs") * self.most_hot >= pairs).select("h").collect()  # at most ``most_hot`` rows
        self.hot |= {bytes(r.h) for r in hot}
        fresh = batch if self.settled else batch.repartition(self.buckets, "h")
        for run in self.settled:
            fresh = fresh.join(run.hint("merge"), "h", "left_anti")
        self.levels[0].append(self._saved(fresh))
        forget(batch)
        level = 0
        while len(self.levels[level]) >= self.fan:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._merged(self.levels[level]))
            self.levels[level] = []
            level += 1

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """One run of several; lines that reach the limit leave it and settle."""
        together = reduce(DataFrame.unionByName, runs).groupBy("h").agg(F.sum("docs").alias("docs"))
        merged = self._saved(together.withColumn("often", F.col("docs") >= self.documents).repartition(self.buckets, "h"))
        self.settled.append(merged.where("often").drop("often"))
        return merged.where("not often").drop("often")

    def frequent(self) -> DataFrame:
        """(h): all lines in enough documents; one that settled while an older run still counted it may come twice."""
        if open_runs := [run for level in self.levels for run in level]:
            self.levels = [[self._merged(open_runs)]]
        if not self.settled:
            return self.spark.createDataFrame([], "h binary")
        return reduce(DataFrame.unionByName, self.settled).select("h")

    def drop(self) -> None:
        """Deletes the runs."""
        for name, path in self.tables:
            self.spark.sql(f"drop table if exists {name}")
            delete(self.spark, path)
        self.tables, self.levels, self.settled = [], [[]], []


def _text_key(text) -> list:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def drop_frequent_lines(
    batches: list[DataFrame], text_col: str = "text", documents: int = DOCUMENTS, chars: int = CHARS, hot: int = HOT
) -> DataFrame:
    """The rows of all batches, all columns, with ``n_lines``, ``n_dropped`` and ``kept``, the text without frequent lines."""
    spark = batches[0].sparkSession
    runs = LineRuns(spark, documents, hot=hot)
    for batch in batches:
        runs.add(line_counts(batch, text_col, chars))
    docs = reduce(DataFrame.unionByName, batches)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    frequent = runs.frequent()
    some = spark.createDataFrame(pa.table({"h": pa.array(sorted(runs.hot), pa.binary())}))
    hot_lines = frozenset(bytes(r.h) for r in frequent.join(F.broadcast(some), "h", "left_semi").collect())  # bounded as ``some`` is

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, hashes = [], []
            for i, data in enumerate(batch.column(2).cast(pa.large_binary()).to_pylist()):
                own = {xxhash.xxh3_128_digest(k) for k in set(keys(data)) if long_enough(k, chars)} - hot_lines
                at += [i] * len(own)
                hashes += own
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(hashes, pa.binary())], names=["t1", "t2", "h"])

    pairs = docs.select(*_text_key(text), text.alias("text")).mapInArrow(lines, "t1 long, t2 long, h binary")
    found = pairs.join(frequent.hint("merge"), "h").groupBy("t1", "t2").agg(F.collect_set("h").alias("drops"))
    found = written(found, "drops").select(F.col("t1").alias("u1"), F.col("t2").alias("u2"), "drops")
    runs.drop()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for data, drops in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = data.split(b"\n")
                gone = hot_lines.union(drops or ())
                left = [x for x, k in zip(own, keys(data), strict=True) if not long_enough(k, chars) or xxhash.xxh3_128_digest(k) not in gone] if gone else own
                rows.append((len(own), len(own) - len(left), b"\n".join(left)))
            n, dropped, texts = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["carried", "f0", "f1", "f2"],
            )

    carried = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("carried")
    keyed = docs.select(carried, text.alias("text"), *_text_key(text))
    met = keyed.join(found, (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")), "left").select("carried", "text", "drops")
    out = met.mapInArrow(kept, f"carried {met.schema['carried'].dataType.simpleString()}, n_lines long, n_dropped long, kept string")
    old = [F.col("carried").getField(c).alias(c) for c in docs.columns]
    return reading(out.select(*old, *(F.col(c).alias(own_name(docs, c)) for c in ("n_lines", "n_dropped", "kept"))), found)


def file_batches(table: DataFrame, batches: int = BATCHES) -> list[DataFrame]:
    """A table as read, in batches of whole files; together they are all its rows."""
    files = sorted(table.inputFiles())
    each = -(-len(files) // batches)
    parts = [files[i : i + each] for i in range(0, len(files), each)] if files else []
    return [table.sparkSession.read.schema(table.schema).parquet(*p) for p in parts] or [table]


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = [b.select("doc_id", "text") for b in file_batches(read_table(spark, sf_dir, "documents"))]
    return drop_frequent_lines(batches).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select r, unnest(ls) as x, unnest(range(len(ls))) as i from d),
k as (select r, i, x, translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key from k where len(key) >= 1 group by key having count(distinct r) >= 10),
m as (select k.*, f.key is not null as gone from k left join f on k.key = f.key),
g as (select r, count(*) as n_lines, count(*) filter (gone) as n_dropped,
        coalesce(string_agg(x, chr(10) order by i) filter (not gone), '') as kept from m group by r)
select doc_id, n_lines, n_dropped, sha256(kept) as kept_sha256 from d join g using (r)
"""
