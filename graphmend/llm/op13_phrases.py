"""Phrase collocations by weighted acyclic automata (``automata``), per language.

1. Tasks read texts in chunks of about ``CHUNK`` words, count their n-grams of one to three words and build a count
   transducer of them for each language (table ``shards``).
2. N-grams are dealt to prefix ranges of about ``RANGE`` arcs, cut at (language, first word, second word); the cuts come
   from probes at even distances in all transducers, and only the sizes of ranges depend on them. Each transducer is cut
   there, the slices of a range meet, and their union adds the weights. N-grams under ``LEAST`` occurrences end here:
   no part of a candidate is rarer than the candidate (table ``counts``).
3. Each range builds acceptors of the parts that its candidates ask for, one a range that holds some, weighted by the
   largest count of a longer candidate that asks. Composed with the count transducer there, an acceptor turns into
   answers; the same weights tell a two-word phrase the counts of the longer ones around it.
4. Scores are exact (Python integers). Each range keeps its best, a salted and a final ranking by language the first.

No key is hot: a chunk, a range or an acceptor has one arc for an n-gram, however often it stands there. Memory is bounded by a
chunk, a range, or the distinct continuations of one pair of words; the driver holds the cuts, one a range.

Results for odd input: a null text is empty; a null language is ``und``; texts without words and empty tables give no
rows; repeated rows count each; a text longer than a chunk is counted in several, and no n-gram is lost where they meet;
a word of any length is a word; other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .automata import WORDS, Automaton, Grams, compose, union
from .shared import forget, read_table, reading, slices, written

#: Fixed values of the contract.
LEAST, TOP, MILLION, INSIDE = 10, 2000, 1_000_000, 50
BREAKS = b".,;:!?\n\x0b\x0c\r"
_STOP = b"."
#: A break becomes a word that no word can be; A to Z are lowered.
_FOLD = bytes(_STOP[0] if c in BREAKS else c + 32 if ord("A") <= c <= ord("Z") else c for c in range(256))
#: Words of a chunk, arcs of a range, arcs between two probes, bytes of text that are words at a time.
CHUNK, RANGE, PROBE, BLOCK = 1 << 20, 1 << 20, 1 << 13, 1 << 22


class Chunk:
    """Words of one language, as ids by first appearance; id 0 is a break."""

    def __init__(self, context: list[bytes]) -> None:
        self.vocabulary: defaultdict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.vocabulary[_STOP]
        self.parts = [np.array([self.vocabulary[w] for w in context], np.int64)]
        self.context = len(context)
        self.words = 0

    def add(self, words: list[bytes]) -> None:
        ids = np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words))
        self.parts.append(ids)
        self.words += int(np.count_nonzero(ids))

    def rest(self) -> list[bytes]:
        """Words behind the last break, two at most: the next chunk goes on from them."""
        ids = np.concatenate(self.parts)[1 - WORDS :].tolist()
        names = list(self.vocabulary)
        cut = max((i + 1 for i, x in enumerate(ids) if not x), default=0)
        return [names[x] for x in ids[cut:]]

    def grams(self) -> Grams:
        """Counts of all n-grams that end behind the words taken over from the chunk before."""
        names = list(self.vocabulary)
        order = sorted(range(1, len(names)), key=names.__getitem__)
        rank = np.full(len(names), -1, np.int64)
        rank[order] = np.arange(len(order))
        x, base, old = rank[np.concatenate(self.parts)], len(order) + 1, self.context
        single = x[old:]
        a, b = x[max(old - 1, 0) : -1], x[max(old - 1, 0) + 1 :]
        pairs = np.where((a < 0) | (b < 0), -1, a * base + b)
        c = x[max(old - 2, 0) + 2 :]
        pairs3 = np.where((x[max(old - 2, 0) : -2] < 0) | (x[max(old - 2, 0) + 1 : -1] < 0) | (c < 0), -1, x[max(old - 2, 0) : -2] * base + x[max(old - 2, 0) + 1 : -1])
        ids, weights = [], []
        one, n1 = np.unique(single[single >= 0], return_counts=True)
        ids.append(np.column_stack([one, np.full((len(one), 2), -1)]))
        two, n2 = np.unique(pairs[pairs >= 0], return_counts=True)
        ids.append(np.column_stack([two // base, two % base, np.full(len(two), -1)]))
        if base**WORDS < 2**63:
            three, n3 = np.unique((pairs3 * base + c)[pairs3 >= 0], return_counts=True)
            ids.append(np.column_stack([three // base // base, three // base % base, three % base]))
        else:
            three, n3 = np.unique(np.column_stack([pairs3, c])[pairs3 >= 0], axis=0, return_counts=True)
            ids.append(np.column_stack([three[:, 0] // base, three[:, 0] % base, three[:, 1]]))
        # Beginnings can stand in the chunk before only, so they are added where they lack.
        return Grams.of([names[i] for i in order], np.concatenate(ids), np.concatenate([n1, n2, n3]), closed=not old)


def _blocks(text: bytes) -> Iterator[list[bytes]]:
    """Words and breaks of a text, some at a time."""
    text = text.translate(_FOLD).replace(b"\t", b" ")
    start = 0
    while start < len(text):
        end = min(start + BLOCK, len(text))
        if end < len(text):
            end = max(text.rfind(b" ", start, end), text.rfind(_STOP, start, end)) + 1
            if end <= start:  # one word is longer than a block
                ends = [e for e in (text.find(b" ", start), text.find(_STOP, start)) if e >= 0]
                end = min(ends) + 1 if ends else len(text)
        yield text[start:end].replace(_STOP, b" . ").split()
        start = end
    yield [_STOP]


def _probes(grams: Grams) -> list[dict]:
    at = grams.ids[PROBE::PROBE, :2]
    return [{"w1": grams.words[a], "w2": grams.words[b] if b >= 0 else b""} for a, b in at.tolist()]


_SHARD = "lang string, words long, arcs long, probes array<struct<w1:binary,w2:binary>>, automaton binary"
_SHARD_ARROW = pa.schema([("lang", pa.string()), ("words", pa.int64()), ("arcs", pa.int64()), ("probes", pa.list_(pa.struct([("w1", pa.binary()), ("w2", pa.binary())]))), ("automaton", pa.binary())])


def shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", chunk: int = CHUNK) -> DataFrame:
    """A count transducer for each chunk of words and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Chunk] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, own in held.items():
                if own.words:
                    grams = own.grams()
                    row = {"lang": lang, "words": own.words, "arcs": len(grams), "probes": _probes(grams), "automaton": Automaton.build(grams).encode()}
                    yield pa.RecordBatch.from_pylist([row], _SHARD_ARROW)
                held[lang] = Chunk(own.rest())

        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                own = held.setdefault(lang, Chunk([]))
                for words in _blocks(text):
                    own.add(words)
                    if sum(c.words for c in held.values()) >= chunk:
                        yield from flushed()
                        own = held[lang]
        yield from flushed()

    texts = docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    return texts.mapInArrow(run, _SHARD)


def cuts(table: DataFrame, ranges: int) -> list[tuple[str, bytes, bytes]]:
    """The first (language, first word, second word) of each range but the first."""
    if ranges < 2:
        return []
    probes = table.select("lang", F.explode("probes").alias("p")).select("lang", "p.w1", "p.w2")
    dealt = probes.repartitionByRange(ranges, "lang", "w1", "w2").groupBy(F.spark_partition_id()).agg(F.min(F.struct("lang", "w1", "w2")).alias("least"))
    found = sorted({(r.least.lang, bytes(r.least.w1), bytes(r.least.w2)) for r in dealt.collect()}, key=_order)  # one a range
    return found[1:]


def _order(cut: tuple[str, bytes, bytes]) -> tuple[bytes, bytes, bytes]:
    return cut[0].encode(), cut[1], cut[2]


class Ranges:
    """Prefix ranges: range i begins at cut i - 1."""

    def __init__(self, found: list[tuple[str, bytes, bytes]]) -> None:
        self.cuts = [_order(c) for c in found]

    def split(self, lang: str, grams: Grams) -> Iterator[tuple[int, Grams]]:
        """The n-grams of each range that has some."""
        name = lang.encode()
        low, high = bisect_right(self.cuts, (name,)), bisect_right(self.cuts, (name + b"\0",))
        own = [c for c in self.cuts[low:high] if c[0] == name]
        at = [0, *grams.places([(c[1], c[2]) for c in own]), len(grams)]
        for i, (start, end) in enumerate(zip(at, at[1:], strict=False)):
            if end > start:
                yield low + i, grams.slice(start, end)


_SLICE = "lang string, range int, source int, automaton binary"
_SLICE_ARROW = pa.schema([("lang", pa.string()), ("range", pa.int32()), ("source", pa.int32()), ("automaton", pa.binary())])


def _automata(column: pa.ChunkedArray) -> list[Automaton]:
    return [Automaton.decode(x) for x in column.to_pylist()]


def _slices_of(table: DataFrame, ranges: Ranges, asks: bool) -> DataFrame:
    """Each row's n-grams, or the parts that its candidates ask for, cut at the ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            lang, source, automaton = (batch.column(k)[0].as_py() for k in range(3))
            grams = Automaton.decode(automaton).grams()
            for to, own in ranges.split(lang, asked_parts(grams) if asks else grams):
                yield pa.RecordBatch.from_pylist([{"lang": lang, "range": to, "source": source, "automaton": Automaton.build(own).encode()}], _SLICE_ARROW)

    source = F.col("range") if asks else F.lit(None).cast("int")
    return table.select("lang", source.alias("source"), "automaton").mapInArrow(run, _SLICE)


def asked_parts(grams: Grams) -> Grams:
    """Parts of all candidates, weighted by one and the largest count of a longer candidate around them."""
    real = grams.weights > 0
    two, three = real & (grams.ids[:, 1] >= 0) & (grams.ids[:, 2] < 0), real & (grams.ids[:, 2] >= 0)
    single = np.unique(np.concatenate([grams.ids[two, 0], grams.ids[two, 1], grams.ids[three, 0], grams.ids[three, 2]]))
    ids, weights = [np.column_stack([single, np.full((len(single), 2), -1)])], [np.ones(len(single), np.int64)]
    for at in (0, 1):
        ids.append(np.column_stack([grams.ids[three, at], grams.ids[three, at + 1], np.full(int(three.sum()), -1)]))
        weights.append(grams.weights[three] + 1)
    return Grams.of(grams.words, np.concatenate(ids), np.concatenate(weights), np.maximum)


def _united(least: int):
    def run(table: pa.Table) -> pa.Table:
        grams = union(_automata(table["automaton"])).at_least(least)
        row = {"lang": table["lang"][0].as_py(), "range": table["range"][0].as_py(), "source": None, "automaton": Automaton.build(grams).encode()}
        return pa.Table.from_pylist([row] if len(grams) else [], _SLICE_ARROW)

    return run


_ANSWER = "lang string, range int, longer boolean, automaton binary"
_ANSWER_ARROW = pa.schema([("lang", pa.string()), ("range", pa.int32()), ("longer", pa.bool_()), ("automaton", pa.binary())])


def _answered(counts: pa.Table, asked: pa.Table) -> pa.Table:
    """Of each acceptor: the counts of what it asks for. For this range: the largest count around its two-word phrases."""
    rows = []
    if counts.num_rows and asked.num_rows:
        own = _automata(counts["automaton"])[0]
        lang, here = counts["lang"][0].as_py(), counts["range"][0].as_py()
        acceptors = _automata(asked["automaton"])
        for to, acceptor in zip(asked["source"].to_pylist(), acceptors, strict=True):
            answers = compose(acceptor, own, lambda want, n: np.where(want > 0, n, 0)).at_least(1)
            rows.append({"lang": lang, "range": to, "longer": False, "automaton": Automaton.build(answers).encode()})
        around = compose(Automaton.build(union(acceptors, np.maximum)), own, lambda want, n: np.where(n > 0, np.maximum(want - 1, 0), 0)).at_least(1)
        rows.append({"lang": lang, "range": here, "longer": True, "automaton": Automaton.build(around).encode()})
    return pa.Table.from_pylist(rows, _ANSWER_ARROW)


_PHRASE = "lang string, range int, phrase string, a long, l long, r long, score long"
_PHRASE_ARROW = pa.schema([("lang", pa.string()), ("range", pa.int32()), ("phrase", pa.string()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64()), ("score", pa.int64())])


def _by_words(automata: list[Automaton]) -> dict[tuple[bytes, ...], int]:
    found: dict[tuple[bytes, ...], int] = {}
    for automaton in automata:
        grams = automaton.grams()
        for ids, n in zip(grams.ids.tolist(), grams.weights.tolist(), strict=True):
            if n:
                key = tuple(grams.words[i] for i in ids if i >= 0)
                found[key] = max(n, found.get(key, 0))
    return found


def scored(words: tuple[bytes, ...], a: int, count: dict[tuple[bytes, ...], int]) -> tuple[int, int, int]:
    """(score, l, r) of the lowest-scoring cut, the first of equal ones."""
    best = None
    for k in range(1, len(words)):
        left, right = count[words[:k]], count[words[k:]]
        score = MILLION * a * a // (left * right)
        if best is None or score < best[0]:
            best = score, left, right
    return best


def _scores(inside: int, top: int):
    def run(counts: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if counts.num_rows:
            lang, here = counts["lang"][0].as_py(), counts["range"][0].as_py()
            longer = answers["longer"].to_numpy(zero_copy_only=False).astype(bool)
            automata = _automata(answers["automaton"])
            count = _by_words([x for x, y in zip(automata, longer, strict=True) if not y])
            around = _by_words([x for x, y in zip(automata, longer, strict=True) if y])
            grams = _automata(counts["automaton"])[0].grams()
            for ids, a in zip(grams.ids.tolist(), grams.weights.tolist(), strict=True):
                if a and ids[1] >= 0:
                    words = tuple(grams.words[i] for i in ids if i >= 0)
                    if 100 * around.get(words, 0) >= inside * a:
                        continue
                    score, left, right = scored(words, a, count)
                    rows.append((-score, -a, b" ".join(words), left, right))
            rows = [(lang, here, p.decode(), -a, le, ri, -s) for s, a, p, le, ri in sorted(rows)[:top]]
        return pa.Table.from_pylist([dict(zip(_PHRASE_ARROW.names, r, strict=True)) for r in rows], _PHRASE_ARROW)

    return run


def phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, inside: int = INSIDE,
    chunk: int = CHUNK, range_arcs: int = RANGE,
) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    made = written(shards(docs, text_col, lang_col, chunk), "shards")
    arcs = made.agg(F.sum("arcs")).first()[0] or 0
    ranges = Ranges(cuts(made, math.ceil(arcs / range_arcs)))
    total = written(made.groupBy("lang").agg(F.sum("words").alias("n")), "totals")
    slice_rows = _slices_of(made.select("lang", F.lit(None).cast("int").alias("range"), "automaton"), ranges, False)
    counts = written(slice_rows.groupBy("lang", "range").applyInArrow(_united(least), _SLICE), "counts")
    forget(made)
    asked = _slices_of(counts, ranges, True)
    answers = counts.groupBy("lang", "range").cogroup(asked.groupBy("lang", "range")).applyInArrow(_answered, _ANSWER)
    best = counts.groupBy("lang", "range").cogroup(answers.groupBy("lang", "range")).applyInArrow(_scores(inside, top), _PHRASE)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salts = math.isqrt(len(ranges.cuts)) + 1
    salted = Window.partitionBy("lang", F.pmod("range", F.lit(salts))).orderBy(*order)
    near = best.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top).drop("rank", "range")
    first = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return reading(first.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), counts, total)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
with p as (select row_number() over () as r, coalesce(lang, 'und') as lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
n as (select lang, sum(len(ws))::bigint as n from w group by lang),
i as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from w),
g as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase from i, (values (1), (2), (3)) s(k) where i + k - 1 <= len(ws)),
f as (select lang, k, phrase, count(*)::hugeint as f from g group by all),
c as (select * from f where k > 1 and f >= 10),
t as (select *, string_split(phrase, ' ') as ws from c),
o as (select lang, phrase, max(f) as longer from (
    select lang, f, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) as phrase from t where k = 3) group by all),
x as (select t.*, unnest(range(1, k)) as cut from t),
s as (select x.lang, x.phrase, x.f as a, x.cut, a.f as l, b.f as r, (1000000::hugeint * x.f * x.f) // (a.f * b.f) as score
    from x join f a on a.lang = x.lang and a.phrase = array_to_string(ws[1:cut], ' ')
    join f b on b.lang = x.lang and b.phrase = array_to_string(ws[cut + 1:], ' ')),
m as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
z as (select m.* from m left join o using (lang, phrase) where longer is null or 100 * longer < 50 * a),
y as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from z)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from y join n using (lang) where rank <= 2000
"""
