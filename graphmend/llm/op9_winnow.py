"""Benchmark decontamination by winnowing.

Of every ``WINDOW`` consecutive k-grams of words the one with the least hash is kept, with its place, from documents and
benchmark items alike. A passage of at least ``K + WINDOW - 1`` = 13 shared words therefore shares a kept k-gram at
the same place within the passage. Kept k-grams are joined and each hit is extended, word by word, as far as both texts
agree; extensions of 13 words or more are windows of the item. Items of fewer words are looked up by all their words.

Where the items have at most ``INDEX_BYTES``, they go to every task as one index and documents stay where they are.
Larger benchmarks stay distributed, in blocks of half that size: the kept k-grams of documents and blocks are joined on
their hashes, and each document meets the blocks that share any. A document is worked on alone in its task either way; a
very long one is one row.

Results for odd input: a null, empty or wordless text has no words and no hits, and is not contaminated; an item with a
null id counts as an item with hits but has no name in the list; ids of any type are told as strings; repeated rows are
documents of their own; several items with equal texts are all listed; an item_id is listed once; empty tables give no
rows, or no hits; other columns are carried by ``drop_contaminated`` only, whatever their names.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import each_text, own_name, read_table, reading, slices, written

SPAN = 13
K = 7
WINDOW = SPAN - K + 1
#: UTF-8 bytes of all items in one index: at most half as many words, some 200 bytes each in a worker.
INDEX_BYTES = 4 << 20
#: Bytes of texts, and 4,096 a text, that one task holds with the index of a block.
TASK_WEIGHT = 32 << 20

#: Letters lowered; all that parts words made a blank.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, K - 1 - j, 1 << 64) for j in range(K)], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def winnow(ids: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the kept k-grams of a sequence of word ids: the last least one of every window."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    mixed = ids.astype(np.uint64) + np.uint64(1)
    hashes = np.zeros(n, np.uint64)
    for j in range(k):
        hashes += mixed[j : j + n] * _FACTORS[j]
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    least, place = hashes.copy(), np.arange(n)
    if n <= window:
        best = n - 1 - int(np.argmin(hashes[::-1]))
        return place[best : best + 1], hashes[best : best + 1]
    # Least of windows that double in length, then of two that overlap to the full window.
    size = 1
    while size < window:
        step = min(size, window - size)
        a, b = least[: len(least) - step], least[step:]
        later = b <= a
        least, place = np.where(later, b, a), np.where(later, place[step:], place[: len(place) - step])
        size += step
    kept = np.unique(place)
    return kept, hashes[kept]


class Index:
    """Benchmark items: word ids, kept k-grams by hash, short items by their first word."""

    def __init__(self, items: list[tuple[str | None, str | None]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names = [i for i, _ in items]
        self.words: list[np.ndarray] = []
        by_hash: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
        for item, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            self.words.append(np.array(ids, np.int64))
            if 0 < len(ids) < SPAN:
                self.short[ids[0]].append((item, tuple(ids)))
            else:
                for place, h in zip(*(x.tolist() for x in winnow(self.words[-1])), strict=True):
                    by_hash[h].append((item, place))
        self.by_hash = dict(by_hash)
        self.hashes = np.array(sorted(by_hash), np.uint64)
        self.firsts = np.array(sorted(self.short), np.int64)

    def hits(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, item) of the maximal shared passages in a document's word ids; 0 is a word of no item."""
        found: list[tuple[int, int, int]] = []
        places, hashes = winnow(ids)
        if len(places) and len(self.hashes):
            spot = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            reached: dict[tuple[int, int], int] = {}
            for p, h in zip(*(x[self.hashes[spot] == hashes].tolist() for x in (places, hashes)), strict=True):
                for item, q in self.by_hash[h]:
                    if reached.get((item, p - q), -1) < p:
                        start, end = self._extend(ids, p, self.words[item], q)
                        reached[item, p - q] = end
                        if end - start >= SPAN:
                            found.append((start, end, item))
        if len(self.firsts):
            spot = np.minimum(np.searchsorted(self.firsts, ids), len(self.firsts) - 1)
            for p in np.flatnonzero(self.firsts[spot] == ids).tolist():
                for item, words in self.short[int(ids[p])]:
                    if tuple(ids[p : p + len(words)].tolist()) == words:
                        found.append((p, p + len(words), item))
        return found

    @staticmethod
    def _extend(a: np.ndarray, p: int, b: np.ndarray, q: int) -> tuple[int, int]:
        """The stretch of ``a`` around p where it agrees with ``b`` around q; empty if the k-grams only share a hash."""
        most = min(len(a) - p, len(b) - q)
        differ = np.flatnonzero(a[p : p + most] != b[q : q + most])
        end = p + (int(differ[0]) if len(differ) else most)
        most = min(p, q)
        differ = np.flatnonzero(a[p - most : p][::-1] != b[q - most : q][::-1])
        return p - (int(differ[0]) if len(differ) else most), end


_FIELDS = "n_words long, starts array<long>, ends array<long>, items array<string>"
#: The index of this worker process, by the name of its benchmark: built once, not in every task.
_HELD: dict[str, Index] = {}


def _held(name: str, items: list[tuple[str | None, str]]) -> Index:
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Index(items)
    return _HELD[name]


def _found(index: Index, text: str | None) -> tuple[int, list[int], list[int], list[str | None]]:
    """(words, starts, ends, items) of the passages that a text shares with the items of an index."""
    words = words_of(text)
    word_id = index.vocabulary.get
    found = index.hits(np.fromiter([word_id(w, 0) for w in words], np.int64, len(words)))
    return len(words), [f[0] for f in found], [f[1] for f in found], [index.names[f[2]] for f in found]


def _arrays(found: list[tuple]) -> list[pa.Array]:
    columns = list(zip(*found, strict=True)) or [()] * 4
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
    return [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]


def _by_index(docs: DataFrame, items: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """(carried, fields) by one index of all items, which the caller has found to be small."""
    name = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast([(r.item, r.text) for r in items.collect()])

    def make():
        index = _held(name, shared.value)
        return lambda texts: _arrays([_found(index, t) for t in texts])

    return each_text(docs, text_col, carry, _FIELDS, make)


def _hashed(text: str | None) -> np.ndarray:
    import xxhash

    words = words_of(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _whole(ids: np.ndarray, n: int) -> np.ndarray:
    """A key for every n consecutive words: for items of fewer than ``SPAN`` words, which are found whole."""
    keys = np.full(len(ids) - n + 1, n, np.uint64)
    for j in range(n):
        keys = (keys ^ ids[j : len(ids) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def _keys(rows: DataFrame, short: list[int], of_items: bool) -> DataFrame:
    """(h, row): distinct keys of each (row, text): its kept k-grams, and what stands for items of the short lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for text in batch.column(1).to_pylist():
                ids = _hashed(text)
                few = 0 < len(ids) < SPAN
                parts = [_whole(ids, n) for n in short if n <= len(ids) and (not of_items or n == len(ids))]
                found.append(np.unique(np.concatenate([*parts, np.zeros(0, np.uint64) if of_items and few else winnow(ids)[1]])))
            take = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in found]))
            h = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), batch.column(0).take(take)], names=["h", "row"])

    return rows.select("row", "text").mapInArrow(run, "h long, row long")


def _lengths(items: DataFrame) -> DataFrame:
    """(n): the words of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(words_of(t)) for t in batch.column(0).to_pylist()], pa.int64())], names=["n"])

    return items.select("text").mapInArrow(run, "n long")


def _by_join(docs: DataFrame, items: DataFrame, text_col: str, carry: list[str], block_bytes: int) -> DataFrame:
    """(carried, fields) where each document meets only the blocks of items that share a key with it.

    A block is an index of some ``block_bytes`` of items. A key names the blocks that hold it, not the items, so a passage of
    all items and many documents gives one row a document and block; a block that many documents meet is worked on by
    several tasks, each of at most some ``TASK_WEIGHT``.
    """
    row, number = own_name(docs, "row"), F.monotonically_increasing_id()
    counted = each_text(docs.withColumn(row, number), text_col, list(dict.fromkeys([*carry, text_col, row])), "n_words long", lambda: lambda texts: [pa.array([len(words_of(t)) for t in texts], pa.int64())])
    inner = lambda c: F.col("carried").getField(c)
    numbered = counted.select(F.struct(*(inner(c).alias(c) for c in carry)).alias("carried"), inner(text_col).cast("string").alias("text"), inner(row).alias("row"), "n_words")
    numbered = written(numbered, "numbered")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 2 * total // block_bytes + 1
    items = written(items.withColumn("row", number).withColumn("block", F.pmod(F.xxhash64("text", "item"), F.lit(blocks)).cast("int")), "items")
    short = [r.n for r in _lengths(items).where(f"n between 1 and {SPAN - 1}").distinct().collect()]  # twelve at most
    theirs = _keys(items, short, True).join(items.select("row", "block"), "row").select("h", "block").distinct()
    pairs = written(_keys(numbered, short, False).join(theirs, "h").select("row", "block").distinct(), "pairs")
    weights = pairs.join(numbered.select("row", (F.octet_length("text") + 4096).alias("weight")), "row").groupBy("block").agg(F.sum("weight").alias("weight"))
    salts = written(weights.select("block", F.ceil(F.col("weight") / TASK_WEIGHT).cast("int").alias("salts")), "salts")
    asked = pairs.join(salts, "block").select("row", "block", F.pmod(F.xxhash64("row"), F.col("salts")).alias("salt"))
    asked = asked.join(numbered.select("row", "text"), "row")
    held = items.join(salts, "block").select("block", "item", F.col("text").alias("item_text"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)).alias("salt"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        index = Index(list(zip(right["item"].to_pylist(), right["item_text"].to_pylist(), strict=True))) if left.num_rows else None
        found = [_found(index, left["text"][i].as_py())[1:] for i in range(left.num_rows)]
        starts, ends, names = zip(*found, strict=True) if found else ((), (), ())
        lists = [pa.array(x, pa.list_(k)) for x, k in ((starts, pa.int64()), (ends, pa.int64()), (names, pa.string()))]
        return pa.table([left["row"].combine_chunks(), *lists], names=["row", "starts", "ends", "items"])

    met = asked.groupBy("block", "salt").cogroup(held.groupBy("block", "salt")).applyInArrow(run, "row long, starts array<long>, ends array<long>, items array<string>")
    lists = met.groupBy("row").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")))
    none = {"starts": "array<long>", "ends": "array<long>", "items": "array<string>"}
    out = numbered.select("carried", "row", "n_words").join(lists, "row", "left")
    return reading(out.select("carried", "n_words", *(F.coalesce(c, F.array().cast(k)).alias(c) for c, k in none.items())), numbered, items, pairs, salts)


def contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", carry: list[str] | None = None, most_bytes: int = INDEX_BYTES,
    block_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """(carried, n_words, n_hit, items, spans, contaminated) per document.

    ``carried`` holds the columns ``carry`` (all by default), ``items`` the sorted distinct ids of items with occurring
    windows, ``spans`` the hit word ranges, sorted. Contaminated: hits are a twentieth of the words or more.
    """
    carry = docs.columns if carry is None else carry
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    small = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= most_bytes
    found = _by_index(docs, items, text_col, carry) if small else _by_join(docs, items, text_col, carry, block_bytes)
    reads = found.__dict__.get("reads", ())
    spans = F.array_sort(F.arrays_zip(F.col("starts").alias("s"), F.col("ends").alias("e")))
    found = found.select("carried", "n_words", F.array_sort(F.array_distinct("items")).alias("items"), spans.alias("spans"))
    return reading(found.withColumn("n_hit", _united()).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words")), *reads)


def _united():
    """Words in the union of the spans, which are sorted by start."""
    zero = F.lit(0).cast("long")

    def step(a, r):
        new = F.greatest(zero, r["e"] - F.greatest(a["to"], r["s"]))
        return F.struct((a["n"] + new).alias("n"), F.greatest(a["to"], r["e"]).alias("to"))

    start = F.struct(zero.alias("n"), zero.alias("to"))
    return F.aggregate("spans", start, step, lambda a: a["n"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, all columns, without the contaminated ones."""
    found = contamination(docs, benchmark, text_col)
    return reading(found.where("not contaminated").select("carried.*"), *found.__dict__.get("reads", ()))


def op9_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    found = contamination(docs, benchmark, carry=["doc_id"])
    names = F.array_join("items", ",")  # sorted as strings, null ids left out
    return found.select(
        F.col("carried.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), "contaminated",
    )


ORACLE = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w, row_number() over () r
  from documents),
items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from benchmark),
windows as (
  select distinct item_id, least(len(w), 13) size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) i from items where len(w) > 0)),
sizes as (select distinct size from windows),
places as (
  select r, i, size, array_to_string(w[i : i + size - 1], ' ') g
  from (select r, w, size, unnest(range(1, len(w) - size + 2)) i from words, sizes where len(w) >= size)),
found as (select p.r, p.i, p.size, x.item_id from places p join windows x on p.g = x.g and p.size = x.size),
hit as (select r, count(distinct h) n from (select r, unnest(range(i, i + size)) h from found) group by r),
named as (select r, count(*) n, string_agg(item_id::varchar, ',' order by item_id::varchar) names
  from (select distinct r, item_id from found) group by r)
select doc_id, len(w)::bigint n_words, coalesce(h.n, 0)::bigint n_hit, coalesce(m.n, 0)::bigint n_items,
  sha256(coalesce(m.names, '')) items_sha256, coalesce(h.n, 0) > 0 and 20 * coalesce(h.n, 0) >= len(w) contaminated
from words left join hit h using (r) left join named m using (r)
"""
