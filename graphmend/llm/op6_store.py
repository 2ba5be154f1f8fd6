"""Content-addressed store of token ids.

A rolling hash over the last ``WINDOW`` ids cuts each document's id stream where its low bits are zero, so equal
passages give equal chunks wherever they stand. Chunks are named by a 128-bit BLAKE2b digest and stored once. A recipe
lists each document's chunks; recipe files are in ascending doc_id order, and a Merkle root over each file's documents
(leaves: digests of recipes) goes to the manifest. Reading checks every chunk against its name, every recipe against
its leaf and every file against its root.

File format under ``path``: ``chunks`` (digest, n_ids, ids as little-endian unsigned 16-bit integers), ``recipes``
(part, pos, doc_id, n_tokens, part_start, recipe as 16 digest bytes and a little-endian 32-bit count each, leaf),
``manifest`` (part, documents, n_tokens, start, root), all Parquet.

Results for odd input: a null or empty text is its end id alone; repeated rows and ids are documents of their own,
side by side in the order; null ids come first; very long texts are many chunks; an empty table gives an empty store;
other columns are not stored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import ByteLevelEncoder, Encoder
from .shared import new_path, read_table, written

END_ID = 2
WINDOW = 16
#: A cut where the low ten bits are zero: 1,024 ids a chunk on average, within these bounds.
CUT_BITS = 10
LEAST_IDS = 64
MOST_IDS = 8192
ENTRY = 20


def _mixed(n: int) -> np.ndarray:
    """A 64-bit mix of each id, by the splitmix rule."""
    x = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MIX = _mixed(65536)


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream, the last included."""
    n = len(ids)
    ends: list[int] = []
    if n > LEAST_IDS:
        rolled = _MIX[ids]
        step = 1
        while step < WINDOW:  # after each turn an entry covers twice as many ids
            more = rolled.copy()
            more[step:] += rolled[:-step] * np.uint64(pow(0xD1342543DE82EF95, step, 1 << 64))
            rolled, step = more, 2 * step
        hits = np.flatnonzero((rolled >> np.uint64(64 - CUT_BITS)) == 0) + 1
        last = 0
        for hit in [*hits[hits >= WINDOW].tolist(), n]:
            while hit - last > MOST_IDS:
                last += MOST_IDS
                ends.append(last)
            if hit - last >= LEAST_IDS and hit < n:
                ends.append(last := hit)
        if ends and ends[-1] == n:
            return ends
    return [*ends, n]


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _chunked(docs: DataFrame, tokenizer: str, text_col: str, id_col: str, end_id: int) -> DataFrame:
    """Rows of both kinds in one pass over the texts: a recipe for each document, and chunks new to their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(tokenizer, ByteLevelEncoder)
        for batch in batches:
            encoded = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            recipes, totals, fresh = [], [], {}
            for data in encoded:
                ids = np.append(np.frombuffer(data, "<u2"), np.uint16(end_id))
                raw, start, entries = ids.tobytes(), 0, []
                for end in cut_points(ids):
                    part = raw[2 * start : 2 * end]
                    name = _digest(part)
                    fresh.setdefault(name, part)
                    entries += (name, (end - start).to_bytes(4, "little"))
                    start = end
                recipes.append(b"".join(entries))
                totals.append(len(ids))
            n, m = batch.num_rows, len(fresh)
            names = list(fresh)
            keys = np.frombuffer(b"".join(x[:8] for x in names), "<i8")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["recipes"] * n + ["chunks"] * m),
                    pa.concat_arrays([batch.column(2).cast(pa.int64()), pa.array(keys)]),
                    pa.concat_arrays([batch.column(0), pa.nulls(m, batch.column(0).type)]),
                    pa.array(totals + [len(x) // 2 for x in fresh.values()], pa.int64()),
                    pa.array(recipes + names, pa.binary()),
                    pa.array([None] * n + list(fresh.values()), pa.binary()),
                ],
                names=["kind", "k", "doc_id", "n", "name", "ids"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    row = F.xxhash64(F.monotonically_increasing_id())
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), row.alias("k"))
    return source.mapInArrow(run, f"kind string, k long, doc_id {kind}, n long, name binary, ids binary")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes as they are; of the chunks of a name, which all come to one task, the first."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for kind, name in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True):
            new = kind == "recipes" or name not in seen
            if new and kind == "chunks":
                seen.add(name)
            keep.append(new)
        yield batch.filter(pa.array(keep))


class Merkle:
    """Root over leaves that come one by one; at most one subtree of each height is open."""

    def __init__(self) -> None:
        self.open: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        height = 0
        while self.open and self.open[-1][0] == height:
            leaf, height = _digest(b"\x01" + self.open.pop()[1] + leaf), height + 1
        self.open.append((height, leaf))

    def root(self) -> bytes:
        out = b""
        for _, node in reversed(self.open):
            out = node if not out else _digest(b"\x01" + node + out)
        return out


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, documents, n_tokens, root) of each part; the rows of a part come together and in order."""
    out, now, tree, count, tokens = [], None, Merkle(), 0, 0
    for batch in batches:
        for part, recipe, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if part != now:
                if count:
                    out.append((now, count, tokens, tree.root()))
                now, tree, count, tokens = part, Merkle(), 0, 0
            tree.add(_digest(b"\x00" + recipe))
            count, tokens = count + 1, tokens + n
    if count:
        out.append((now, count, tokens, tree.root()))
    columns = list(zip(*out, strict=True)) or [(), (), (), ()]
    types = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "documents", "n_tokens", "root"])


def _manifest(recipes: DataFrame) -> DataFrame:
    rows = recipes.select("part", "recipe", "n_tokens", "pos").repartition("part").sortWithinPartitions("part", "pos")
    return rows.mapInArrow(_roots, "part int, documents long, n_tokens long, root binary")


def write_store(docs: DataFrame, path: str, tokenizer: str, text_col: str = "text", id_col: str = "doc_id", end_id: int = END_ID) -> None:
    """Encodes the documents and writes chunks, recipes and manifest under ``path``."""
    spark = docs.sparkSession
    tagged = _chunked(docs, tokenizer, text_col, id_col, end_id)
    once = tagged.repartition("k").mapInArrow(_once, tagged.schema)
    raw = f"{path}/raw"
    once.write.option("compression", "zstd").partitionBy("kind").parquet(raw)
    recipes = _raw(spark, path, tagged, "recipes").select("doc_id", F.col("n").alias("n_tokens"), F.col("name").alias("recipe"), "k")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, pos, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n, totals = batch.num_rows, batch.column(1).to_numpy()
            begins = start + np.cumsum(totals) - totals
            leaves = [_digest(b"\x00" + r) for r in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array(range(pos, pos + n), pa.int64()), batch.column(0), batch.column(1),
                 pa.array(begins, pa.int64()), batch.column(2), pa.array(leaves, pa.binary())],
                names=["part", "pos", "doc_id", "n_tokens", "part_start", "recipe", "leaf"],
            )
            pos, start = pos + n, start + int(totals.sum())

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"part int, pos long, doc_id {kind}, n_tokens long, part_start long, recipe binary, leaf binary"
    ordered = recipes.repartitionByRange("doc_id", "k").sortWithinPartitions("doc_id", "k").drop("k")
    ordered.mapInArrow(placed, schema).write.option("compression", "zstd").parquet(f"{path}/recipes")
    # One row for each recipe file: the running start over them is a small window.
    first = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    found = _manifest(spark.read.schema(schema).parquet(f"{path}/recipes"))
    found = found.withColumn("start", F.coalesce(F.sum("n_tokens").over(first), F.lit(0)))
    found.coalesce(1).write.parquet(f"{path}/manifest")


def _raw(spark: SparkSession, path: str, like: DataFrame, kind: str) -> DataFrame:
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in like.schema if f.name != "kind")
    return spark.read.schema(f"{fields}, kind string").parquet(f"{path}/raw").where(F.col("kind") == kind).drop("kind")


def _powers() -> np.ndarray:
    """For k below 40, the 4 x 256 tables that put 2**k zero bytes behind a CRC-32 state."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    tables = np.zeros((40, 4, 256), np.uint32)
    byte = np.arange(256, dtype=np.uint32)
    for lane in range(4):
        state = byte << np.uint32(8 * lane)
        tables[0, lane] = (state >> np.uint32(8)) ^ one[state & np.uint32(255)]
    for k in range(1, 40):
        for lane in range(4):
            tables[k, lane] = _apply(tables[k - 1], tables[k - 1, lane])
    return tables


def _apply(table: np.ndarray, state: np.ndarray) -> np.ndarray:
    eight, low = np.uint32(8), np.uint32(255)
    return table[0][state & low] ^ table[1][state >> eight & low] ^ table[2][state >> np.uint32(16) & low] ^ table[3][state >> np.uint32(24)]


_POWERS: list[np.ndarray] = []


def crc_before(crc: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """What each part with this CRC-32 adds, by exclusive or, to that of a whole with so many bytes behind the part."""
    if not _POWERS:
        _POWERS.append(_powers())
    state, behind = crc.astype(np.uint32), behind.astype(np.int64)
    for k in range(40):
        bit = (behind >> k & 1).astype(bool)
        if bit.any():
            state[bit] = _apply(_POWERS[0][k], state[bit])
        if not (behind >> (k + 1)).any():
            break
    return state


def chunk_table(spark: SparkSession, path: str) -> DataFrame:
    """(digest, n_ids, ids) as stored; each chunk once."""
    files = spark.read.schema("n long, name binary, ids binary, kind string").parquet(f"{path}/raw").where("kind = 'chunks'")
    return files.select(F.col("name").alias("digest"), F.col("n").alias("n_ids"), "ids")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = []
        for digest, n, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if _digest(ids) != digest or len(ids) != 2 * n:
                raise ValueError(f"a chunk differs from its name: {digest.hex()}")
            crcs.append(zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], names=["digest", "n_ids", "crc"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of each recipe, with its place and the ids behind it; recipes are held against leaves."""
    for batch in batches:
        rows, digests, counts, seqs, behind = [], [], [], [], []
        for row, (recipe, leaf, total) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(2, 5)), strict=True)):
            if _digest(b"\x00" + recipe) != leaf:
                raise ValueError("a recipe differs from its leaf")
            left = total
            for seq, at in enumerate(range(0, len(recipe), ENTRY)):
                n = int.from_bytes(recipe[at + 16 : at + ENTRY], "little")
                left -= n
                rows.append(row)
                digests.append(recipe[at : at + 16])
                counts.append(n)
                seqs.append(seq)
                behind.append(left)
            if left:
                raise ValueError("a recipe's chunks don't add up")
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), pa.array(digests, pa.binary())]
            + [pa.array(x, pa.int64()) for x in (counts, seqs, behind)],
            names=["part", "pos", "digest", "n", "seq", "behind"],
        )


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/recipes")


def recipe_entries(spark: SparkSession, path: str) -> DataFrame:
    """(part, pos, digest, n, seq, behind): a row for each chunk of each document."""
    rows = _recipes(spark, path).select("part", "pos", "recipe", "leaf", "n_tokens")
    return rows.mapInArrow(_entries, "part int, pos long, digest binary, n long, seq long, behind long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): the ids of each document, put together from its chunks, as 16-bit bytes."""
    parts = recipe_entries(spark, path).join(chunk_table(spark, path), "digest")
    part = F.array_sort(F.collect_list(F.struct("seq", "ids")))
    joined = F.aggregate(part, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    whole = parts.groupBy("part", "pos").agg(joined.alias("ids"))
    return _placed(spark, path).join(whole, ["part", "pos"]).select("doc_id", "start", "ids")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    offsets = spark.read.parquet(f"{path}/manifest").select("part", F.col("start").alias("before"))
    recipes = _recipes(spark, path).select("part", "pos", "doc_id", "n_tokens", "part_start")
    return recipes.join(offsets, "part").withColumn("start", F.col("before") + F.col("part_start"))


def verify_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files whose recipes don't give the manifest's root: none in a sound store."""
    now = _manifest(_recipes(spark, path)).select("part", F.col("root").alias("now"))
    return spark.read.parquet(f"{path}/manifest").join(now, "part", "full_outer").where("not (root <=> now)")


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the files.

    The CRC-32 of a document follows from those of its chunks and the ids behind each, so each stored chunk is read and
    hashed once, and only small rows are shuffled.
    """
    if verify_manifest(spark, path).limit(1).count():
        raise ValueError("the manifest differs from the recipes")
    checked = chunk_table(spark, path).mapInArrow(_verified, "digest binary, n_ids long, crc long")
    checked = written(checked, "chunks")
    parts = written(recipe_entries(spark, path), "entries").join(checked, "digest", "left")

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column(2).null_count:
                raise ValueError("a chunk is missing")
            state = crc_before(batch.column(2).to_numpy(), 4 * batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(state.astype(np.int64))], names=["part", "pos", "crc"])

    shifted = parts.select("part", "pos", "crc", "behind").mapInArrow(moved, "part int, pos long, crc long")
    whole = shifted.groupBy("part", "pos").agg(F.bit_xor("crc").alias("ids_crc32"))
    return _placed(spark, path).join(whole, ["part", "pos"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "store")
    write_store(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return document_digests(spark, path)
