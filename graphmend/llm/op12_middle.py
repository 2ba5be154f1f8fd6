"""Fill-in-the-middle by a piece table: documents are descriptors over buffers that never change.

A buffer is a text (its UTF-8 bytes) or the bytes of the sentinels; a descriptor is (buffer, start, length). Cutting
splits descriptors at places, an arrangement is a permutation of them with sentinels between, and the inverse permutation
gives the text back. No step copies text: output is joined from its descriptors when it is written, digests stream
through them.

``fill_in_middle`` gives each row its arrangement, the descriptors and the output; ``restored`` reads such outputs and
forms and gives the exact texts. Rows stay where they are: no shuffle, memory bounded by one batch of rows.

Results for odd input: a null text is empty; an empty text is plain, with one descriptor of length 0; a text that holds
a sentinel itself is plain, since its output could not be told apart; a null id is spelled as the empty string in its
hash; equal rows give equal results; a very long text is one row of a batch and costs its own length; an empty table
gives an empty result; carried columns are kept apart in a struct until the end, and new columns get underscores where
they would clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import own_name, read_table, slices

#: What stands before the prefix, the suffix and the middle.
SENTINELS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
#: Order of the parts in each form; positions in (prefix, middle, suffix).
ARRANGEMENTS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
PARTS = ("prefix", "middle", "suffix")
#: Of 100 documents: how many stay plain, and how many of the others put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
TEXT, SENTINEL = 0, 1
_SENTINEL_BYTES = b"".join(SENTINELS[p] for p in PARTS)


class Piece(NamedTuple):
    buffer: int
    start: int
    length: int


class PieceTable:
    """Descriptors over the buffers (text, sentinels)."""

    def __init__(self, text: bytes | memoryview, pieces: list[Piece] | None = None) -> None:
        self.buffers = (memoryview(text), memoryview(_SENTINEL_BYTES))
        self.pieces = [Piece(TEXT, 0, len(self.buffers[TEXT]))] if pieces is None else pieces

    def cut(self, places: Iterable[int]) -> PieceTable:
        """Descriptors split at ascending byte places of the document; equal places leave empty descriptors."""
        out, rest, before = [], list(reversed(self.pieces)), 0
        for place in places:
            while len(rest) > 1 and before + rest[-1].length < place:
                before += rest[-1].length
                out.append(rest.pop())
            buffer, start, length = rest.pop()
            left = place - before
            out.append(Piece(buffer, start, left))
            rest.append(Piece(buffer, start + left, length - left))
            before = place
        return self._with(out + rest[::-1])

    def arranged(self, order: tuple[int, ...]) -> PieceTable:
        """The cut parts in another order, each behind its sentinel."""
        out = []
        for part in order:
            out += (Piece(SENTINEL, 3 * part, 3), self.pieces[part])
        return self._with(out)

    def inverse(self, order: tuple[int, ...]) -> PieceTable:
        """The parts of ``arranged`` back in the order of the text, without sentinels."""
        own = self.pieces[1::2]
        out: list[Piece | None] = [None] * len(own)
        for at, part in enumerate(order):
            out[part] = own[at]
        return self._with(out)

    def digest(self) -> str:
        """SHA-256 of the document, streamed through its descriptors."""
        h = hashlib.sha256()
        for chunk in self.stream():
            h.update(chunk)
        return h.hexdigest()

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start : start + length]

    def bytes(self) -> bytes:
        return b"".join(self.stream())

    def _with(self, pieces: list[Piece]) -> PieceTable:
        out = object.__new__(PieceTable)
        out.buffers, out.pieces = self.buffers, pieces
        return out


def read_back(output: bytes | memoryview, form: str) -> PieceTable:
    """The text as descriptors over an output: sentinels are found, parts between them put back in order.

    No sentinel can begin in a part and end in the next sentinel, so the first place of each is the true one.
    """
    if form == "plain":
        return PieceTable(output)
    order, data = ARRANGEMENTS[form], bytes(output)
    pieces, at = [], 0
    for k, part in enumerate(order):
        if data[at : at + 3] != SENTINELS[PARTS[part]]:
            raise ValueError("an output does not begin with its sentinel")
        start = at + 3
        at = data.index(SENTINELS[PARTS[order[k + 1]]], start) if k + 1 < len(order) else len(data)
        pieces += (Piece(SENTINEL, 3 * part, 3), Piece(TEXT, start, at - start))
    return PieceTable(data, pieces).inverse(order)


class Units:
    """Places of all units (runs of ASCII letters, else single code points) of a batch of texts, found at once."""

    def __init__(self, texts: pa.Array) -> None:
        column = texts.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        self.offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        base, end = int(self.offsets[0]), int(self.offsets[-1])
        self.base, self.data = base, memoryview(data)[base:end] if data else memoryview(b"")
        codes = np.frombuffer(self.data, np.uint8)
        folded = codes | 0x20
        letter = (folded >= ord("a")) & (folded <= ord("z"))
        self.leads = (codes & 0xC0) != 0x80
        starts = self.leads.copy()
        starts[1:] &= ~(letter[1:] & letter[:-1])
        first = self.offsets[:-1] - base
        starts[first[first < len(starts)]] = True  # a letter run ends with its text
        self.places = np.flatnonzero(starts)
        self.upto = np.searchsorted(self.places, self.offsets - base)

    def text(self, i: int) -> memoryview:
        return self.data[self.offsets[i] - self.base : self.offsets[i + 1] - self.base]

    def count(self, i: int) -> int:
        return int(self.upto[i + 1] - self.upto[i])

    def place(self, i: int, units: int) -> int:
        """Bytes of text i before its unit number ``units``."""
        own = int(self.offsets[i]) - self.base
        if units == self.count(i):
            return int(self.offsets[i + 1]) - self.base - own
        return int(self.places[self.upto[i] + units]) - own

    def chars(self, i: int, start: int, end: int) -> int:
        """Code points between two byte places of text i."""
        own = int(self.offsets[i]) - self.base
        return int(np.count_nonzero(self.leads[own + start : own + end]))


def decision(doc_id: int | None, units: int) -> tuple[int, int, str]:
    """Units in the prefix, units in prefix and middle, and the form that the document's hash chooses."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (units + 1), h2 % (units + 1)))
    if h3 % 100 >= 100 - PLAIN:
        return a, b, "plain"
    return a, b, "spm" if h4 % 100 < SUFFIX_FIRST else "psm"


#: Fields that a document gets.
FIELDS = (
    "n long, form string, prefix_chars long, middle_chars long, pieces array<struct<buffer:int,start:long,length:long>>, output string, output_sha256 string"
)
_PIECES = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))


def _arrange(ids: list[int | None], texts: pa.Array) -> list[pa.Array]:
    units = Units(texts.fill_null(""))
    rows = []
    for i, doc_id in enumerate(ids):
        n, text = units.count(i), units.text(i)
        a, b, form = decision(doc_id, n)
        whole = bytes(text)
        if not n or any(s in whole for s in SENTINELS.values()):
            form = "plain"
        table, chars = PieceTable(whole), (None, None)
        if form != "plain":
            cuts = units.place(i, a), units.place(i, b)
            table = table.cut(cuts).arranged(ARRANGEMENTS[form])
            chars = units.chars(i, 0, cuts[0]), units.chars(i, *cuts)
        rows.append((n, form, *chars, [p._asdict() for p in table.pieces], table.bytes(), table.digest()))
    n, form, before, middle, pieces, output, digest = zip(*rows, strict=True) if rows else [()] * 7
    return [
        pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()),
        pa.array(pieces, _PIECES), pa.array(output, pa.binary()).cast(pa.string()), pa.array(digest, pa.string()),
    ]


def _mapped(df: DataFrame, keep: list[str], inputs: list, fields: str, work) -> DataFrame:
    """``keep`` of each row and the new ``fields`` that ``work`` makes of the other columns of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = work(*batch.columns[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["carried", *(f"f{i}" for i in range(len(made)))])

    source = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("carried"), *inputs)
    out = source.mapInArrow(run, f"carried {source.schema['carried'].dataType.simpleString()}, {fields}")
    names = [own_name(df.select(*(F.col(f"`{c}`") for c in keep)), f.split(" ")[0]) for f in fields.split(", ")]
    old = [F.col("carried").getField(c).alias(c) for c in keep]
    return out.select(*old, *(F.col(f.split(" ")[0]).alias(n) for f, n in zip(fields.split(", "), names, strict=True)))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns but the text, with ``n`` (units), ``form``, code points of prefix and middle (null if plain),
    the descriptors (buffer 0: the text's UTF-8 bytes, 1: sentinels), the output and its SHA-256."""
    keep = [c for c in docs.columns if c != text_col]
    inputs = [F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")]
    return _mapped(docs, keep, inputs, FIELDS, lambda ids, texts: _arrange(ids.to_pylist(), texts))


def restored(arranged: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """The rows, all columns but the output, with ``text``, rebuilt from output and form, and ``restored_sha256``."""

    def back(outputs: pa.Array, forms: pa.Array) -> list[pa.Array]:
        data = outputs.cast(pa.large_binary())
        tables = [read_back(o.as_buffer(), f) for o, f in zip(data, forms.to_pylist(), strict=True)]
        texts = pa.array([t.bytes() for t in tables], pa.binary()).cast(pa.string())
        return [texts, pa.array([t.digest() for t in tables], pa.string())]

    keep = [c for c in arranged.columns if c != output_col]
    inputs = [F.coalesce(F.col(f"`{output_col}`"), F.lit("")).alias("output"), F.coalesce(F.col(f"`{form_col}`"), F.lit("plain")).alias("form_")]
    return _mapped(arranged, keep, inputs, "text string, restored_sha256 string", back)


def op12_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fill_in_middle(docs).drop("pieces")
    return restored(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


ORACLE = """
with t as (select doc_id, coalesce(text, '') as x, sha256('1:' || coalesce(doc_id::varchar, '')) as s from documents),
u as (select *, regexp_extract_all(x, '[A-Za-z]+|[^A-Za-z]') as w,
        ('0x' || s[1:8])::bigint as h1, ('0x' || s[9:16])::bigint as h2, ('0x' || s[17:24])::bigint as h3, ('0x' || s[25:32])::bigint as h4 from t),
v as (select *, len(w) as n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) as a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) as b,
        case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or h3 % 100 >= 90 then 'plain'
             when h4 % 100 < 20 then 'spm' else 'psm' end as form from u),
p as (select *, array_to_string(w[1:a], '') as pre, array_to_string(w[a + 1:b], '') as mid, array_to_string(w[b + 1:], '') as suf from v),
o as (select *, case form when 'plain' then x when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
                     else '<S>' || suf || '<P>' || pre || '<M>' || mid end as y from p),
q as (select *, strpos(y, '<P>') as ap, strpos(y, '<S>') as sp, strpos(y, '<M>') as mp from o)
select doc_id, n::bigint as n, form, case when form <> 'plain' then len(pre) end::bigint as prefix_chars,
  case when form <> 'plain' then len(mid) end::bigint as middle_chars, sha256(y) as output_sha256,
  sha256(case form when 'plain' then y
    when 'psm' then y[ap + 3:sp - 1] || y[mp + 3:] || y[sp + 3:mp - 1]
    else y[ap + 3:mp - 1] || y[mp + 3:] || y[sp + 3:ap - 1] end) as restored_sha256
from q
"""
