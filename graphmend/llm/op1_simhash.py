"""SimHash near-duplicates: fingerprints, BK-tree shards, connected components.

Fingerprints that differ in at most ``radius`` bits agree on at least ``BLOCKS - radius`` of ``BLOCKS`` bit blocks, so
every linked pair meets in a shard keyed by the values of some two agreeing blocks. Each shard becomes a BK-tree whose
children hang at their integer Hamming distance to the parent; a search follows only the edges within the radius.

The trees of one shard go to the tasks that hold the fingerprints of that shard by one shuffle on the shard key and not
by a broadcast: together they hold every fingerprint of the corpus several times, so their size has no bound.

``keep_one_of_each`` takes five-word shingles and a similarity of 0.8. Such texts differ in about 15 % of their bits, so
no choice of agreeing bit blocks finds them. There a shard is a group of texts with the same least hashes in some band;
its BK-tree holds fingerprints of 256 bits, whose distances keep unrelated texts out of the radius and let searches pass
over whole families. What the searches join is compared by exact similarity, each text in one place (``joined``).

Results for odd input: a null or wordless text has the fingerprint zero and links like any other; texts of one or two
words have one shingle, the whole sequence; equal texts (repeated rows too) share a fingerprint and meet before any
search; a null doc_id stays a row and never becomes a component id unless its whole component has none; an empty table
gives an empty result; other columns are carried by ``keep_one_of_each`` only, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import forget, own_name, read_table, reading, slices, written

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
#: 64 bits in five blocks: with a radius of 3 two blocks agree, ten pairs of blocks, 25 or 26 bits a key. A shard of
#: unrelated fingerprints then averages n / 2**25 members: one or two at 50 million distinct fingerprints.
BLOCKS = 5
#: Members of one tree and of the searches put to it in one task. Fuller shards are split into chunks, and each pair of
#: chunks is a group of its own, so no group outgrows a task and no member is left out.
CHUNK = 1024

#: Similarity (Jaccard, of the sets of shingles) from which texts are copies of each other.
SIMILAR_WORDS = 5
SIMILARITY = 0.8
#: Bits of the fingerprints behind that similarity, and their radius. A bit differs with probability 0.15 at 0.8 (0.19 for
#: sets of five shingles and fewer): 38 of 256, deviation 5.7, so more than 64 in 4 of a million pairs. At a similarity of 0.2,
#: as passages that many documents share may give, 100 bits differ: within the radius in 2 of a million pairs.
SIMILAR_BITS = 256
SIMILAR_RADIUS = 64
#: A pair at 0.8 shares no band with probability (1 - 0.8 ** 6) ** 28 = 0.0002; one at 0.1 shares some with 0.00003.
BANDS, BAND_ROWS = 28, 6
#: Texts and shingles that one task holds at a time (8 bytes a shingle); fuller groups are split by both.
CHUNK_TEXTS = 2048
CHUNK_SHINGLES = 1 << 22
#: Links that a task writes, at least: some 8 MB.
EDGES_A_TASK = 500_000


def shingle_hashes(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """Unsigned 64-bit hashes of the shingles in order, repeats included; none for a text without words."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if len(words) < shingle_words:
        shingles: list[bytes] = [b" ".join(words)] if words else []
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False)))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(shingles))


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit integer whose bits are those set in over half the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    # Eight byte lanes at a time: bit k of every byte, summed over at most 255 hashes so that no lane overflows.
    lane = np.uint64(0x0101010101010101)
    for k in range(8):
        bits = (hashes >> np.uint64(k)) & lane
        sums = np.add.reduceat(bits, np.arange(0, len(bits), 255))
        counts[k::8] = sums.view(np.uint8).reshape(-1, 8).astype(np.int64).sum(axis=0)
    set_bits = counts * 2 > len(hashes)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def simhash(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Fingerprint of one text as an unsigned 64-bit integer."""
    return majority_bits(shingle_hashes(text, shingle_words, seed))


def long_fingerprint(hashes: np.ndarray, bits: int = SIMILAR_BITS) -> bytes:
    """As ``majority_bits``, over a longer hash of each shingle: one 64-bit mix of it for every 64 bits."""
    if not len(hashes):
        return bytes(bits // 8)
    factors = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(bits // 64)], np.uint64)
    mixed = factors[:, None] * hashes
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    counts = np.zeros((bits // 64, 64), np.int64)
    lane, parts = np.uint64(0x0101010101010101), np.arange(0, len(hashes), 255)
    for k in range(8):
        sums = np.add.reduceat(mixed >> np.uint64(k) & lane, parts, axis=1)
        counts[:, k::8] = sums.view(np.uint8).reshape(bits // 64, -1, 8).sum(axis=1, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), axis=1, bitorder="little").tobytes()


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp): one row per document; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.fromiter((simhash(t) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, fp long"
    )


class BKTree:
    """Burkhard-Keller tree over 64-bit integers under the Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Inserts a value (one that is present stays one node) and returns its node."""
        values, children = self.values, self.children
        if not values:
            values.append(value)
            children.append({})
            return 0
        node = 0
        while True:
            distance = (values[node] ^ value).bit_count()
            if distance == 0:
                return node
            below = children[node].get(distance)
            if below is None:
                children[node][distance] = len(values)
                values.append(value)
                children.append({})
                return len(values) - 1
            node = below

    def search(self, value: int, radius: int) -> Iterator[int]:
        """Nodes within the radius; by the triangle inequality only edges within it lead to any."""
        if not self.values:
            return
        stack = [0]
        values, children = self.values, self.children
        while stack:
            node = stack.pop()
            distance = (values[node] ^ value).bit_count()
            if distance <= radius:
                yield node
            low, high = distance - radius, distance + radius
            for edge, child in children[node].items():
                if low <= edge <= high:
                    stack.append(child)


def _links(tree_members: list[int], search_members: list[int], same: bool, radius: int) -> list[tuple[int, int]]:
    """Links that join the members as all pairs within the radius would, at most one fewer than there are members."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (above := parent.setdefault(x, x)) != x:
            parent[x] = parent[above]
            x = above
        return x

    tree, links = BKTree(), []
    if not same:
        for value in tree_members:
            tree.add(value)
    for value in search_members:
        for node in tree.search(value, radius):
            a, b = root(value), root(tree.values[node])
            if a != b:
                parent[a] = b
                links.append((value, tree.values[node]))
        if same:
            tree.add(value)
    return links


def _block_masks(blocks: int) -> list[int]:
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return [((1 << high) - (1 << low)) for low, high in zip(edges, edges[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def near_links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` whose components are those of all pairs within the radius."""
    masks = _block_masks(blocks)
    keys = [sum(pick) for pick in combinations(masks, blocks - radius)]
    shards = F.array(
        *(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for t, m in enumerate(keys))
    )
    members = distinct.select("fp", F.explode(shards).alias("s")).select("s.t", "s.bits", "fp")
    sizes = members.groupBy("t", "bits").agg(F.count("*").alias("n")).where("n > 1")
    # Full shards: a member of chunk c meets the chunks up to the last; the groups are the pairs (i, j) with i <= j.
    chunks = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = (
        members.join(sizes, ["t", "bits"])
        .withColumn("chunks", chunks)
        .withColumn("c", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("t", "bits", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), "c", "fp")
    )
    group = ["t", "bits", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, low, high = None, [], []

        def close() -> list[tuple[int, int]]:
            if now is None:
                return []
            return _links(low, low, True, radius) if now[2] == now[3] else _links(low, high, False, radius)

        mask = (1 << 64) - 1
        for batch in batches:
            found: list[tuple[int, int]] = []
            for t, bits, i, j, c, fp in zip(*(batch.column(x).to_pylist() for x in range(6)), strict=True):
                if (t, bits, i, j) != now:
                    found += close()
                    now, low, high = (t, bits, i, j), [], []
                (low if c == i else high).append(fp & mask)
            yield _pairs(found)
        yield _pairs(close())

    def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
        both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

    return dealt.repartition(*group).sortWithinPartitions(*group, "c", "fp").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): alternating star contraction until nothing changes.

    A round keeps components and replaces links by links to smaller nodes; the number of rounds grows with the
    logarithm of the longest chain. Each round is written to the shared folder. The smallest neighbours are written
    too, so both sides of the join that follows are plain scans and Spark may split a hub's rows over many tasks. Tables
    are written by as many tasks as their rows are worth.
    """
    larger, smaller = F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")
    edges = written(links.where("a <> b").select(larger, smaller).distinct(), "edges")
    before = _state(edges)
    while before[0]:
        few = lambda df, name, n=before[0]: written(df.coalesce(max(8, n // EDGES_A_TASK)), name)
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(
            edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
        )
        least = few(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")), "least")
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        large = few(large, "large")
        low = few(large.groupBy("v").agg(F.min("u").alias("m")), "low")
        small = (
            large.join(low, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
            .unionByName(low.select("v", F.col("m").alias("u")))
            .distinct()
        )
        small = few(small, "edges")
        forget(edges, least, large, low)
        edges, now = small, _state(small)
        if now == before:
            break
        before = now
    out = edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
        edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    )
    out.written_path = edges.written_path
    return out


def _state(edges: DataFrame) -> tuple:
    """Number of the links and a sum over them: equal only if a round has changed nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, root) after links between their roots, or nodes that had none: only the links are contracted."""
    more = components(links)
    renamed = more.select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = found.join(renamed, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    fresh = more.join(found.select("node"), "node", "left_anti").select("node", "root")
    out = written(moved.unionByName(fresh), "merged")
    forget(more, found)
    return out


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id, component_docs): component_id is the smallest doc_id that links reach."""
    marked = written(fingerprints(docs, text_col, id_col), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("docs")), "distinct")
    found = components(near_links(distinct, radius))
    rooted = distinct.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "least_id", "docs", F.coalesce("root", "fp").alias("root")
    )
    rooted = written(rooted, "rooted")
    heads = written(rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.sum("docs").alias("component_docs")), "heads")
    by_fp = written(rooted.join(heads, "root").select("fp", "component_id", "component_docs"), "classes")
    forget(distinct, found, rooted, heads)
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id", "component_docs")


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One signed 64-bit key a band: its least hashes of a set of shingles under ``BAND_ROWS`` odd multipliers."""
    draw = np.random.default_rng(SEED)
    odd = draw.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    mix = draw.integers(0, 1 << 63, BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 256):
        np.minimum(least, (shingles[at : at + 256, None] * odd).min(axis=0), out=least)
    return (least.reshape(BANDS, BAND_ROWS) * mix).sum(axis=1, dtype=np.uint64).view(np.int64)


def shingle_sets(docs: DataFrame, text_col: str, row_col: str) -> DataFrame:
    """(row, same, size, fp, keys): digest, size, fingerprint and band keys of each text's set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches):
            same, sizes, fps, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = np.unique(shingle_hashes(text, SIMILAR_WORDS))
                same.append(xxhash.xxh3_128_digest(found.tobytes()))
                sizes.append(len(found))
                fps.append(long_fingerprint(found))
                keys.append(band_keys(found))
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            columns = [pa.array(x, kind) for x, kind in zip((same, sizes, fps, keys), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row", "same", "size", "fp", "keys"])

    return docs.select(F.col(row_col).alias("row"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "row long, same binary, size long, fp binary, keys array<long>"
    )


class Shard:
    """A BK-tree of held texts, and the links found so far between the nodes that the texts stand for.

    A text meets the held ones within the radius whose nodes aren't joined with its own yet. Where texts are given, sets
    of shingles are compared exactly; else fingerprints and sizes decide.
    """

    def __init__(self, radius: int, similarity: float) -> None:
        self.radius, self.similarity = radius, similarity
        self.tree, self.at = BKTree(), []
        self.parent: dict[int, int] = {}
        self.holding: set[int] = set()  # roots of the nodes with held texts
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while (above := self.parent.setdefault(x, x)) != x:
            self.parent[x] = self.parent[above]
            x = above
        return x

    def alike(self, a: list, b: list) -> bool:
        """For two held or met texts [node, size, text or set of shingles]."""
        small, large = (a, b) if a[1] <= b[1] else (b, a)
        if small[1] < self.similarity * large[1] - 1e-9:
            return False
        if a[2] is None:
            return True
        for x in (small, large):
            if isinstance(x[2], str):
                x[2] = np.unique(shingle_hashes(x[2], SIMILAR_WORDS))
        small, large = small[2], large[2]
        place = np.minimum(np.searchsorted(large, small), len(large) - 1)
        both = int(np.count_nonzero(large[place] == small))
        return both >= self.similarity * (len(small) + len(large) - both) - 1e-9

    def put(self, node: int, size: int, fp: bytes, text: str | None, meets: bool, holds: bool) -> None:
        bits, mine = int.from_bytes(fp, "little"), [node, size, text]
        if meets:
            self._meet(mine, bits)
        if holds:
            spot = self.tree.add(bits)
            if spot == len(self.at):
                self.at.append([])
            self.at[spot].append(mine)
            self.holding.add(self.root(node))

    def _meet(self, mine: list, bits: int) -> None:
        for spot in self.tree.search(bits, self.radius):
            for other in self.at[spot]:
                a, b = self.root(mine[0]), self.root(other[0])
                if a != b and self.alike(mine, other):
                    self.parent[a] = b
                    self.holding.discard(a)
                    self.links.append((mine[0], other[0]))
                    a = b
                if len(self.holding) == 1 and a in self.holding:  # no node is left to join
                    return


def _links_of(placed: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Links (a, b) between the nodes of each group (g, i, j) of rows that meet what the group holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, Shard(radius, similarity)
        for batch in slices(batches):
            links: list[tuple[int, int]] = []
            for g, i, j, meets, holds, node, size, fp, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, i, j) != now:
                    links += shard.links
                    now, shard = (g, i, j), Shard(radius, similarity)
                shard.put(node, size, fp, text, meets, holds)
            yield _rows(links)
        yield _rows(shard.links)

    def _rows(links: list[tuple[int, int]]) -> pa.RecordBatch:
        both = np.array(links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

    rows = placed.select("g", "i", "j", "meets", "holds", "node", "size", "fp", "text")
    sorted_rows = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "meets", "node")
    return sorted_rows.mapInArrow(run, "a long, b long")


def joined(members: DataFrame, radius: int, similarity: float, chunk: int = CHUNK_TEXTS, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """(node, root) as all links within each group ``g`` of ``members`` (g, row, size, fp, text) would join its rows.

    A group of more than ``chunk`` texts (or ``chunk_shingles`` shingles) is dealt out in three turns, so that none is one task's
    work: chunks on their own; then one text for each component of the group, again and again, which makes one component
    of what is alike throughout; then the texts outside the group's largest component against all texts of the group.
    A group of near copies thus costs in proportion to its size; one of many texts that are not alike costs the square of its
    number of chunks.
    """
    some, no, zero = F.lit(True), F.lit(False), F.lit(0)

    def parts(n: str, held: str):
        return F.greatest(F.ceil(F.col(n) / F.lit(chunk)), F.ceil(F.col(held) / F.lit(chunk_shingles))).cast("int")

    def dealt(column: str, n: str, seed: int = 0):
        return F.pmod(F.xxhash64(column, F.lit(seed)), F.col(n)).cast("int")

    sizes = members.groupBy("g").agg(F.count("*").alias("n"), F.sum("size").alias("held"))
    full = written(sizes.withColumn("chunks", parts("n", "held")).where("chunks > 1").select(F.col("g").alias("full"), "chunks"), "full")
    any_full = full.count() > 0
    alone = members.withColumn("node", F.col("row"))
    if any_full:
        alone = alone.join(full, F.col("g") == F.col("full"), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        alone = alone.withColumn("i", dealt("row", "chunks"))
    else:
        alone = alone.withColumn("i", zero)
    tied = alone.withColumns({"j": zero, "meets": some, "holds": some})
    found = components(_links_of(tied, radius, similarity))
    if not any_full:
        forget(full)
        return found

    large = written(members.join(full, F.col("g") == F.col("full")).drop("full"), "large")

    def known() -> DataFrame:
        """The large groups' rows with the component of each so far as ``comp``."""
        return large.join(found, F.col("row") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "row")).drop("node", "root")

    while True:
        heads = known().groupBy("g", "comp").agg(F.min("row").alias("row"))
        heads = heads.join(large.drop("chunks"), ["g", "row"])
        left = heads.groupBy("g").agg(F.count("*").alias("n"), F.sum("size").alias("held")).where("n > 1")
        heads = heads.join(left.select("g", parts("n", "held").alias("chunks")), "g")
        heads = written(heads.withColumn("i", dealt("comp", "chunks")).withColumn("node", F.col("comp")), "heads")
        links = written(_links_of(heads.withColumns({"j": zero, "meets": some, "holds": some}), radius, similarity), "links")
        more, split = links.limit(1).count() > 0, heads.where("chunks > 1").limit(1).count() > 0
        if more:
            found = merged(found, links)
        forget(heads, links)
        if not (more and split):
            break

    rows = written(known(), "known")
    comps = rows.groupBy("g", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("held"))
    first = F.struct("n", "comp")
    rest = comps.groupBy(F.col("g").alias("of")).agg(
        F.max_by("comp", first).alias("main"), (F.sum("n") - F.max("n")).alias("n"), (F.sum("held") - F.max_by("held", first)).alias("held")
    )
    rest = written(rest.where("n > 0").select("of", "main", parts("n", "held").alias("outer")), "rest")
    if not rest.limit(1).count():
        forget(full, large, rows, rest)
        return found
    both = rows.join(rest, F.col("g") == F.col("of")).withColumn("node", F.col("comp"))
    every = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    held = both.where("comp <> main").withColumns({"i": dealt("row", "outer", 1), "meets": no, "holds": some}).withColumn("j", every("chunks"))
    met = both.withColumns({"j": dealt("row", "chunks", 2), "meets": some, "holds": no}).withColumn("i", every("outer"))
    links = written(_links_of(held.unionByName(met), radius, similarity), "links")
    if links.limit(1).count() > 0:
        found = merged(found, links)
    forget(full, large, rows, rest, links)
    return found


def similar_documents(
    docs: DataFrame,
    text_col: str,
    row_col: str,
    radius: int = SIMILAR_RADIUS,
    similarity: float = SIMILARITY,
    chunk: int = CHUNK_TEXTS,
) -> DataFrame:
    """(row, component_id, component_docs) of documents with a unique long ``row_col``; component_id is a least row.

    Texts of equal sets of shingles become one first. Then fingerprints meet within shards, the texts with a common band
    key; what they join are families, whose texts meet once more and stay joined where they are similar.
    """
    marked = written(shingle_sets(docs, text_col, row_col), "sets")
    same = (F.first(c).alias(c) for c in ("size", "fp", "keys"))
    alone = written(marked.groupBy("same").agg(F.min("row").alias("row"), F.count("*").alias("docs"), *same), "alone")
    none = F.lit(None).cast("string").alias("text")
    shards = alone.where("size > 0").select(F.explode("keys").alias("g"), "row", "size", "fp", none)
    families = joined(shards, radius, similarity, chunk)
    texts = docs.select(F.col(row_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    placed = families.select(F.col("root").alias("g"), F.col("node").alias("row")).join(alone.select("row", "size", "fp"), "row")
    placed = written(placed.join(texts, "row").select("g", "row", "size", "fp", "text"), "families")
    found = joined(placed, radius, similarity, chunk)
    rooted = alone.select("same", "docs", "row").join(found, F.col("row") == F.col("node"), "left")
    rooted = written(rooted.select("same", "docs", F.coalesce("root", "row").alias("component_id")), "rooted")
    sizes = rooted.groupBy("component_id").agg(F.sum("docs").alias("component_docs"))
    classes = rooted.join(sizes, "component_id").select("same", "component_id", "component_docs")
    out = written(marked.select("row", "same").join(classes, "same").select("row", "component_id", "component_docs"), "classes")
    forget(marked, alone, families, placed, found, rooted)
    return out


def keep_one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """The documents, all columns, with one row of each near-duplicate component: that of the smallest doc_id.

    Repeated rows of that doc_id count as copies too: the first in row order stays. Null ids come last, so a row
    without an id stays only where no document of its component has one. Texts without words are copies of each other.
    """
    row = own_name(docs, "row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    classes = similar_documents(numbered, text_col, row, similarity=similarity)
    copies = classes.where("component_docs > 1").select(F.col("row").alias("copy"), "component_id")
    ids = numbered.select(F.col(row).alias("r"), F.col(f"`{id_col}`").alias("i"))
    rank = F.struct(F.col("i").isNull().alias("none"), F.col("i").alias("i"), F.col("r").alias("r"))
    first = copies.join(ids, F.col("copy") == F.col("r")).groupBy("component_id").agg(F.min(rank).alias("first"))
    stay = written(first.select(F.col("first.r").alias("stays")), "stay")
    gone = copies.join(stay, F.col("copy") == F.col("stays"), "left_anti").select(F.col("copy").alias(own_name(docs, "copy")))
    gone = written(gone, "gone")
    forget(classes, stay)
    kept = numbered.join(gone, F.col(row) == F.col(own_name(docs, "copy")), "left_anti").drop(row)
    return reading(kept, numbered, gone)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
