"""Packing token pieces into fixed-length sequences: first-fit decreasing over a tournament tree of bin capacities.

Documents are cut at every ``SEQUENCE`` tokens. A piece of that length is a sequence already and stays where it is; the
shorter ends go, ids and all, to randomised groups of documents by one shuffle, and each group is packed on its own,
largest first, each end into the first sequence with room. The tree keeps the largest free capacity of every span of
bins, so that first fit takes logarithmic time. A group has about ``GROUP_DOCS`` documents at any corpus size, each with
under ``SEQUENCE`` tokens, so tasks stay bounded and groups run apart; each leaves about one sequence partly filled.

The result is the sequences with their ids, padded, and where in them each document's pieces stand. ``pack_digest`` has a
row for each piece, with a digest taken from the sequence.

Results for odd input: a null text is empty and has its end id alone; a text without tokens likewise; a very long text
gives many full pieces and an end; repeated rows and equal ids are documents of their own; an empty table gives no
sequences; other columns are not carried, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .encoding import Encoder, WordEndEncoder
from .shared import read_table, slices, written

SEQUENCE = 4096
END_ID = 2
GROUP_DOCS = 4096
SEED = 20240501


def token_pieces(
    docs: DataFrame, tokenizer: str, text_col: str = "text", id_col: str = "doc_id", sequence: int = SEQUENCE, end_id: int = END_ID
) -> DataFrame:
    """(piece, doc_id, doc, start, length, doc_tokens, ids): ids little-endian unsigned 16-bit, the end id included.

    ``piece`` and ``doc`` number pieces and rows apart within one evaluation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(tokenizer, WordEndEncoder)
        for batch in slices(batches):
            encoded = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            end = end_id.to_bytes(2, "little")
            rows, starts, lengths, totals, ids = [], [], [], [], []
            for row, data in enumerate(encoded):
                whole = data + end
                total = len(whole) // 2
                for start in range(0, total, sequence):
                    part = whole[2 * start : 2 * (start + sequence)]
                    rows.append(row)
                    starts.append(start)
                    lengths.append(len(part) // 2)
                    totals.append(total)
                    ids.append(part)
            take = pa.array(rows, pa.int64())
            arrays = [batch.column(0).take(take), batch.column(2).take(take)]
            arrays += [pa.array(x, pa.int64()) for x in (starts, lengths, totals)] + [pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "doc", "start", "length", "doc_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("doc")
    )
    schema = f"doc_id {kind}, doc long, start long, length long, doc_tokens long, ids binary"
    return source.mapInArrow(run, schema).withColumn("piece", F.monotonically_increasing_id())


class Bins:
    """Bins in order of opening over a tournament tree whose inner nodes hold the largest capacity below them."""

    def __init__(self, most: int, capacity: int) -> None:
        self.size = 1 << max(0, most - 1).bit_length()
        self.tree = [capacity] * (2 * self.size)

    def put(self, length: int) -> tuple[int, int]:
        """The first bin with room, and what it held before."""
        tree, node = self.tree, 1
        while node < self.size:
            node *= 2
            if tree[node] < length:
                node += 1
        free = tree[node]
        place = node - self.size
        tree[node] = free - length
        while node > 1:
            node //= 2
            left, right = tree[2 * node], tree[2 * node + 1]
            best = left if left > right else right
            if tree[node] == best:
                break
            tree[node] = best
        return place, free


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; ties in length keep their order."""
    order = np.argsort(-lengths, kind="stable")
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = int((lengths >= capacity).sum())  # these come first and fill a bin each
    place[order[:full]] = np.arange(full)
    bins = Bins(len(lengths) - full, capacity)
    for k in order[full:].tolist():
        b, free = bins.put(int(lengths[k]))
        place[k], offset[k] = full + b, capacity - free
    return place, offset


def padded_length(tokens: int, capacity: int) -> int:
    """A sequence is padded to the capacity unless its tokens are a power of two already."""
    return tokens if tokens & (tokens - 1) == 0 else capacity


def sequences(pieces: DataFrame, documents: int, capacity: int = SEQUENCE, group_docs: int = GROUP_DOCS, seed: int = SEED, pad_id: int = 0) -> DataFrame:
    """(sequence_id, tokens, input_ids, pieces) from the pieces of about so many documents.

    ``input_ids`` are little-endian unsigned 32-bit ids, padded; ``pieces`` are structs (doc_id, start, length, doc_tokens,
    offset) in order of their offsets in the sequence.
    """
    groups = max(1, math.ceil(documents / group_docs))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    place_kind = f"array<struct<doc_id:{kind},start:long,length:long,doc_tokens:long,offset:long>>"
    schema = f"sequence_id long, tokens long, input_ids binary, pieces {place_kind}"
    id_type = to_arrow_type(pieces.schema["doc_id"].dataType)
    place_type = pa.struct([("doc_id", id_type), *((x, pa.int64()) for x in ("start", "length", "doc_tokens", "offset"))])

    def padded(parts: list[bytes]) -> bytes:
        ids = np.frombuffer(b"".join(parts), "<u2").astype("<u4")
        return np.append(ids, np.full(padded_length(len(ids), capacity) - len(ids), pad_id, "<u4")).tobytes()

    def table(names: pa.Array, tokens: pa.Array, data: list[bytes], of: pa.Array, counts: np.ndarray) -> pa.Table:
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        columns = [names, tokens, pa.array(data, pa.binary()), pa.ListArray.from_arrays(ends, of)]
        return pa.Table.from_arrays(columns, names=["sequence_id", "tokens", "input_ids", "pieces"])

    def placed(source, offsets: np.ndarray) -> pa.Array:
        fields = [source.column(x) for x in ("doc_id", "start", "length", "doc_tokens")] + [pa.array(offsets, pa.int64())]
        fields = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in fields]
        return pa.StructArray.from_arrays(fields, fields=list(place_type))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            names = pa.array(-1 - batch.column("piece").to_numpy(), pa.int64())
            data = [padded([x]) for x in batch.column("ids").to_pylist()]
            yield from table(names, batch.column("length"), data, placed(batch, np.zeros(n, np.int64)), np.ones(n, np.int64)).to_batches()

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("piece")
        lengths = group.column("length").to_numpy()
        place, offset = first_fit_decreasing(lengths, capacity)
        order = np.lexsort((offset, place))
        counts = np.bincount(place)
        tokens = np.bincount(place, lengths).astype(np.int64)
        ids, firsts = group.column("ids").to_pylist(), np.concatenate([[0], np.cumsum(counts)]).tolist()
        data = [padded([ids[k] for k in order[a:b].tolist()]) for a, b in zip(firsts, firsts[1:], strict=False)]
        names = pa.array((group.column("g")[0].as_py() << 32) | np.arange(len(counts)), pa.int64())
        return table(names, pa.array(tokens), data, placed(group.take(pa.array(order)), offset[order]), counts)

    whole = pieces.where(F.col("length") == capacity).mapInArrow(full, schema)
    ends = pieces.where(F.col("length") < capacity).withColumn("g", F.pmod(F.xxhash64("doc", F.lit(seed)), F.lit(groups)))
    return ends.groupBy("g").applyInArrow(pack, schema).unionByName(whole)


def pack_documents(docs: DataFrame, tokenizer: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents as padded sequences of ids, and where each stands in them: see ``sequences``."""
    pieces = written(token_pieces(docs, tokenizer, text_col, id_col), "pieces")
    return sequences(pieces, pieces.where("start = 0").count())


def pack_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row for each piece of the packed documents, with the CRC-32 of its ids as they stand in its sequence."""
    rows = pack_documents(docs, tokenizer).select("sequence_id", "input_ids", F.explode("pieces").alias("p"))
    part = F.expr("substring(input_ids, int(4 * p.offset + 1), int(4 * p.length))")
    return rows.select("p.doc_id", "p.start", "p.length", F.crc32(part).alias("ids_crc32"), "p.doc_tokens", "sequence_id", "p.offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
