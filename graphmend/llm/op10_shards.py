"""Sharding by histogram sort: shards of near equal bytes in key order, found by refining probes over exact counts.

Every row has a place on one axis: its key (nulls first), then a 60-bit hash of the whole row. Rounds count the exact
bytes between probes inside the brackets that still hold a splitter; each bracket shrinks to the gap between two
probes until a probe is within the tolerance or a bracket holds one row. Then rows are exchanged once, by shard and
place, and numbered.

The driver holds the brackets (one a splitter) and at most ``PROBES`` counts for each, at any corpus size.

Results for odd input: a null text has size 8 and CRC-32 zero; null keys sort first; equal keys are told apart by the
hash of the row; rows equal in every column are numbered first where they would weigh more than the tolerance, so a
hot row is split as well; an empty table gives an empty result; columns named like the new ones are kept and the new
ones get underscores.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_path, own_name, read_table, written

SHARDS = 24
PROBES = 64
#: Bytes a splitter may be off, as a part of a shard.
TOLERANCE = 0.0005
TIE_BITS = 60
PLACE = "decimal(38,0)"


def _number(value: int) -> Column:
    return F.lit(str(value)).cast(PLACE)


def _places(key: Column, tie: Column) -> Column:
    """The axis: key above, tie below; a null key is under every key."""
    high = F.coalesce(key.cast("decimal(20,0)") + F.lit(str(2**63 + 1)).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    low = tie.bitwiseAND(F.lit((1 << TIE_BITS) - 1))
    return (high.cast("decimal(21,0)") * F.lit(1 << TIE_BITS).cast("decimal(19,0)")).cast(PLACE) + low.cast(PLACE)


def _counted(sizes: DataFrame, brackets: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, int]]:
    """(bytes, rows) by bracket and slice of it, over all rows; brackets [low, high) are apart and in order."""
    lows = F.array(*(_number(low) for low, _ in brackets))
    highs = F.array(*(_number(high) for _, high in brackets))
    steps = F.array(*(_number(-(-(high - low) // PROBES)) for low, high in brackets))
    rows = sizes.withColumn("b", F.size(F.filter(lows, lambda x: x <= F.col("place"))) - 1).where("b >= 0")
    rows = rows.select("place", "size", "b", F.get(lows, "b").alias("lo"), F.get(highs, "b").alias("hi"), F.get(steps, "b").alias("st"))
    found = (
        rows.where("place < hi")
        .groupBy("b", F.expr("(place - lo) div st").alias("slice"))
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        .collect()  # at most PROBES a bracket
    )
    return {(r.b, r.slice): (int(r.bytes), r.rows) for r in found}


def splitters(sizes: DataFrame, shards: int, tolerance: float = TOLERANCE) -> tuple[list[int], bool]:
    """Places of the first row of shards 1, 2, ...; and whether equal places keep a splitter out of tolerance."""
    ends = sizes.agg(F.min("place").alias("low"), F.max("place").alias("high"), F.sum("size").alias("all")).first()
    if ends.low is None:
        return [0] * (shards - 1), False
    total, allowed = int(ends["all"]), tolerance * int(ends["all"]) / shards
    targets = [total * s / shards for s in range(1, shards)]
    found: list[int | None] = [None] * len(targets)
    # Of each splitter: its bracket and the bytes below it.
    state = [((int(ends.low), int(ends.high) + 1), 0)] * len(targets)
    stuck = False
    while any(f is None for f in found):
        brackets = sorted({state[i][0] for i, f in enumerate(found) if f is None})
        counts = _counted(sizes, brackets)
        for i, target in enumerate(targets):
            if found[i] is not None:
                continue
            (low, high), below = state[i]
            b, step = bisect.bisect_left(brackets, (low, high)), -(-(high - low) // PROBES)
            for k in range(PROBES):
                held, rows = counts.get((b, k), (0, 0))
                if below + held >= target:
                    break
                below += held
            left, right = low + k * step, min(low + (k + 1) * step, high)
            near = left if target - below <= below + held - target else right
            off = min(target - below, below + held - target)
            if off <= allowed or rows <= 1 or right - left == 1:
                found[i] = near
                stuck |= off > allowed and rows > 1
            state[i] = ((left, right), below)
    return sorted(found), stuck


def shard(docs: DataFrame, key_col: str, size: Column, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows, all columns, with ``shard`` and ``slot`` (gapless from 0 in the shard, in key order)."""
    spark = docs.sparkSession
    place, number, by, slot = (own_name(docs, c) for c in ("place", "number", "shard", "slot"))
    whole = [F.col(f"`{c}`") for c in docs.columns]
    placed = docs.withColumn(place, _places(F.col(key_col), F.xxhash64(*whole)))
    sizes = written(placed.select(F.col(place).alias("place"), size.cast("long").alias("size")), "sizes")
    bounds, stuck = splitters(sizes, shards, tolerance)
    if stuck:
        placed = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
        placed = placed.withColumn(place, _places(F.col(key_col), F.col(number))).drop(number)
        sizes = written(placed.select(F.col(place).alias("place"), size.cast("long").alias("size")), "sizes")
        bounds, _ = splitters(sizes, shards, tolerance)
    cuts = F.array(*(_number(b) for b in bounds))
    dealt = placed.withColumn(by, F.size(F.filter(cuts, lambda x: x <= F.col(place))))
    dealt = dealt.repartitionByRange(by, place).sortWithinPartitions(by, place).drop(place)
    # A task's rows are in order, so the number of a row in its task and the rows of tasks before it give its slot.
    path = new_path(spark, "shards")
    dealt.withColumn(number, F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    out = spark.read.parquet(path)
    task = F.shiftrightunsigned(F.col(number), 33)
    runs = out.groupBy(task.alias("task"), F.col(by).alias("s")).agg(F.count("*").alias("n"), F.min(number).alias("first"))
    ahead = Window.partitionBy("s").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    return (
        out.join(written(before, "runs"), (task == F.col("task")) & (F.col(by) == F.col("s")))
        .withColumn(slot, F.col(number) - F.col("first") + F.col("before"))
        .select(*whole, by, slot)
    )


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    out = shard(read_table(spark, sf_dir, "documents"), "doc_id", size)
    return out.select(
        "doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
