"""The filtered-id view: kept ids as a set of bitmaps, tested and renumbered in the row.

Kept ids get contiguous numbers from 1 in their own order; 0 stays 0 and every other id becomes the number of the unknown
token. A bitmap holds 32,768 ids in 4 KB. Sets within ``MOST`` bitmaps and ``PLACES`` places go to every task once, and whole
records are renumbered by batches without unfolding a list or moving a row: the set is never part of a row, so the cost of a
record doesn't grow with it. Larger sets meet their ids by salted joins.

Results for odd input: null ids and ids below 1 are 0 (a set holds none of them); a null list is null; an empty set holds the
unknown token alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from graphmend.sources.violations import UNKNOWN

#: Bitmaps (16 MB) and places between the lowest and highest bitmap (8 MB of offsets) that one row may hold.
MOST, PLACES = 4096, 1 << 20
#: Copies of a bitmap that a hot one's ids are spread over in the joins of a larger set.
SALTS = 32
#: Ids and bytes of a bitmap.
IDS, BYTES = 32768, 4096
_ONES = np.array([i.bit_count() for i in range(256)], dtype=np.int64)


class Places:
    """A small set in a task: where each bitmap stands by its distance from the lowest, and the ids before each of its bytes."""

    def __init__(self, low: int, buckets: list[int], bits: list[bytes], before: list[int]) -> None:
        self.low, self.before = low, np.array(before, dtype=np.int64)
        self.at = np.full(max(buckets) - low + 1, -1, dtype=np.int32)
        self.at[np.array(buckets) - low] = np.arange(len(buckets), dtype=np.int32)
        self.bits = np.frombuffer(b"".join(bits), dtype=np.uint8).reshape(len(bits), BYTES)
        ones = _ONES[self.bits].cumsum(axis=1)
        self.ahead = np.concatenate([np.zeros((len(bits), 1), dtype=np.int64), ones[:, :-1]], axis=1).astype(np.uint16)

    def numbers(self, ids: np.ndarray) -> np.ndarray:
        """Each id's number in the set; 0 for ids below 1, the unknown token's number for others outside."""
        found = np.where(ids > 0, self._within(np.array([UNKNOWN]))[0], 0)
        near = np.flatnonzero((ids > 0) & ((ids - 1) // IDS + 1 >= self.low) & ((ids - 1) // IDS + 1 < self.low + len(self.at)))
        held = self._within(ids[near])
        found[near] = np.where(held > 0, held, found[near])
        return found

    def _within(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of ids between the lowest and the highest bitmap; 0 outside the set."""
        at = self.at[(ids - 1) // IDS + 1 - self.low]
        place = (ids - 1) % IDS
        byte, bit = place >> 3, place & 7
        own = self.bits[at, byte].astype(np.int64)
        number = self.before[at] + self.ahead[at, byte] + _ONES[own & ((2 << bit) - 1)]
        return np.where((at >= 0) & ((own >> bit) & 1 == 1), number, 0)

    def column(self, values: pa.Array) -> pa.Array:
        """An array of ids, or of lists of ids, renumbered."""
        if pa.types.is_list(values.type):
            sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), self.column(values.flatten()), mask=values.is_null())
        return pa.array(self.numbers(pc.fill_null(values, 0).to_numpy(zero_copy_only=False)))


@dataclass(frozen=True)
class IdSet:
    """(bucket, bits, before): bitmaps and the number of ids in lower ones, a written table."""

    buckets: DataFrame
    low: int
    high: int
    count: int

    @staticmethod
    def of(ids: DataFrame, column: str, path: str) -> IdSet:
        """The set of a column's ids of 1 or more, and the unknown token, written to ``path``."""
        spark = ids.sparkSession
        every = ids.select(F.col(column).cast("long").alias("id")).unionByName(spark.range(UNKNOWN, UNKNOWN + 1)).where("id > 0")
        made = every.groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
        made.write.mode("overwrite").parquet(f"{path}/bits")
        made = spark.read.parquet(f"{path}/bits")
        ahead = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a number for every 32,768 ids
        before = made.select("bucket", F.bitmap_count("bits").alias("n")).select("bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
        made.join(before, "bucket").write.mode("overwrite").parquet(f"{path}/set")
        made = spark.read.parquet(f"{path}/set")
        size = made.agg(F.min("bucket").alias("low"), F.max("bucket").alias("high"), F.count("*").alias("count")).first()
        return IdSet(made, size.low, size.high, size["count"])

    @property
    def small(self) -> bool:
        return self.count <= MOST and self.high - self.low < PLACES

    def row(self) -> DataFrame:
        """One row: ``places``, each bitmap at its distance from the lowest (null where there is none), and ``unknown``."""
        if not self.small:
            raise ValueError(f"more than {MOST} bitmaps or {PLACES} places")
        held = self.buckets.agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("before", "bits")))).alias("held"))
        places = F.transform(F.sequence(F.lit(self.low), F.lit(self.high)), lambda b: F.try_element_at("held", b))
        return held.select(places.alias("places")).select("places", self.number(F.lit(UNKNOWN).cast("long")).alias("unknown"))

    def number(self, value: Column) -> Column:
        """An id's number by ``places``; null outside the set."""
        at = F.when(value > 0, F.get("places", (F.bitmap_bucket_number(value) - self.low).cast("int")))
        return _number(at["bits"], at["before"], F.bitmap_bit_position(value))

    def renumbered(self, records: DataFrame, scalars: list[str], lists: list[str]) -> DataFrame:
        """The records with the named columns renumbered: where they stand for small sets, otherwise by joins."""
        if not self.small:
            return self._joined(records, scalars, lists)
        new = {c: LongType() for c in scalars} | {c: ArrayType(LongType()) for c in lists}
        rows = records.select(*(F.col(c).cast(new[c]).alias(c) if c in new else c for c in records.columns))
        made = self.buckets.orderBy("bucket").collect()  # MOST at most
        sent = rows.sparkSession.sparkContext.broadcast((self.low, [r.bucket for r in made], [bytes(r.bits) for r in made], [r.before for r in made]))

        def renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places = Places(*sent.value)
            for b in batches:
                yield pa.RecordBatch.from_arrays([places.column(b.column(c)) if c in new else b.column(c) for c in b.schema.names], names=b.schema.names)

        return rows.mapInArrow(renumber, StructType([StructField(f.name, new.get(f.name, f.dataType)) for f in rows.schema.fields]))

    def _joined(self, records: DataFrame, scalars: list[str], lists: list[str]) -> DataFrame:
        """By salted joins on the bitmap's number; a record's lists meet again by its id."""
        tagged = [F.struct(F.lit(c).alias("field"), F.lit(-1).alias("pos"), F.col(c).cast("long").alias("id")) for c in scalars]
        of = lambda c: F.transform(F.coalesce(c, F.array().cast("array<bigint>")), lambda x, i: F.struct(F.lit(c).alias("field"), i.alias("pos"), x.alias("id")))
        each = records.select("violation_id", F.explode(F.concat(F.array(*tagged), *map(of, lists))).alias("x")).select("violation_id", "x.*")
        each = each.withColumn("id", F.greatest(F.coalesce("id", F.lit(0).cast("long")), F.lit(0).cast("long")))
        each = each.withColumns({"bucket": F.when(F.col("id") > 0, F.bitmap_bucket_number("id")).otherwise(-1), "salt": F.pmod(F.xxhash64("violation_id", "field", "pos"), F.lit(SALTS))})
        copies = self.buckets.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = each.join(copies, ["bucket", "salt"], "left")
        found = F.when(F.col("id") == 0, F.lit(0).cast("long")).otherwise(F.coalesce(_number(F.col("bits"), F.col("before"), F.bitmap_bit_position("id")), F.lit(self.unknown())))
        met = met.select("violation_id", "field", "pos", found.alias("n"))
        pick = lambda c: F.array_sort(F.collect_list(F.when(F.col("field") == c, F.struct("pos", "n"))))["n"]
        new = met.groupBy("violation_id").agg(*(F.max(F.when(F.col("field") == c, F.col("n"))).alias(f"{c}_new") for c in scalars), *(pick(c).alias(f"{c}_new") for c in lists))
        changed = {*scalars, *lists}
        value = lambda c: F.when(F.col(c).isNotNull(), F.col(f"{c}_new")) if c in lists else F.col(f"{c}_new")
        return records.join(new, "violation_id").select(*(value(c).alias(c) if c in changed else c for c in records.columns))

    def unknown(self) -> int:
        """The unknown token's number."""
        low = self.buckets.where("bucket = 1")
        return low.select(_number(F.col("bits"), F.col("before"), F.bitmap_bit_position(F.lit(UNKNOWN).cast("long")))).first()[0]


def _number(bits: Column, before: Column, position: Column) -> Column:
    """Ids in lower bitmaps, in lower bytes of this one, and at or below the place in its own byte; null if the bit is off."""
    byte, bit = F.shiftright(position, 3).cast("int"), (position % 8).cast("int")
    own = F.conv(F.hex(F.substring(bits, byte + 1, 1)), 16, 10).cast("int")
    upto = F.bit_count(own.bitwiseAND(F.call_function("shiftleft", F.lit(2), bit) - 1))
    return F.when(F.call_function("shiftright", own, bit).bitwiseAND(F.lit(1)) == 1, (before + F.bitmap_count(F.substring(bits, F.lit(1), byte)) + upto).cast("long"))
