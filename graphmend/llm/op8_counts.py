"""Token counts by section from whole documents that are encoded once.

Tokens of a byte-level vocabulary are stretches of the text's bytes, so token spans follow from the lengths of the
tokens; bytes map to characters. Sections are character intervals in order and apart: here the title (the first
sentence or line) and each later line. Token spans are joined to sections by place (both are sorted). A token that
lies in more than one section goes, by rule:

* ``first`` or ``last``: to the section of its first or last character;
* ``most`` (default): to the section with most of its characters, of equals the first.

A token within a multi-byte character takes that character's place. So section counts add up to the document's.

Results for odd input: null and empty texts have one empty title section and no tokens; texts without line ends are a
title and a body; very long texts are one row in and one row a line out; repeated rows are counted apart; an empty
table gives no rows; carried columns may have any name, as they travel in one struct.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import ByteLevelEncoder, Encoder
from .shared import each_text, read_table

RULES = ("first", "last", "most")
_TITLE = re.compile(r"[^\n]*?(?:[.!?]\n|[.!?](?=\s)|\n|$)")


def sections(text: str) -> list[int]:
    """Starts of the sections: the title at 0, then each line; the blank after a title is the title's neighbour."""
    end = _TITLE.match(text).end()
    starts = [0]
    if end < len(text):
        starts.append(end)
    starts += [i for i in (m.end() for m in re.finditer("\n", text)) if end < i < len(text)]
    return starts


def token_lengths(encoder: Encoder) -> np.ndarray:
    """Bytes of each token of a byte-level vocabulary: one a sign of its spelling."""
    vocabulary = encoder.library.get_vocab()
    lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        lengths[i] = len(token)
    return lengths


def allocate(text: str, ids: np.ndarray, lengths: np.ndarray, starts: list[int], rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section; a crossing token counts as such where it is allocated."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    ends = np.cumsum(lengths[ids])
    if len(data) != (int(ends[-1]) if len(ends) else 0):
        raise ValueError("the tokens don't spell the text")
    tokens, crossing = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    if not len(ids):
        return tokens, crossing
    char = np.cumsum((data & 0xC0) != 0x80) - 1  # the character of each byte
    first, last = char[np.concatenate([[0], ends[:-1]])], char[ends - 1]
    edges = np.array(starts, np.int64)
    low, high = (np.searchsorted(edges, x, "right") - 1 for x in (first, last))
    where = high if rule == "last" else low.copy()
    across = np.flatnonzero(low != high)
    if rule == "most":
        for t in across.tolist():
            inner = edges[low[t] + 1 : high[t] + 1]
            held = np.diff([first[t], *inner, last[t] + 1])
            where[t] = low[t] + int(np.argmax(held))
    np.add.at(tokens, where, 1)
    np.add.at(crossing, where[across], 1)
    return tokens, crossing


def section_counts(docs: DataFrame, tokenizer: str, text_col: str = "text", carry: list[str] | None = None, rule: str = "most") -> DataFrame:
    """(carried, section, start, end, n_tokens, n_crossing, doc_tokens): section 0 is the title, then the lines."""
    if rule not in RULES:
        raise ValueError(f"unknown rule: {rule}")

    def make():
        encoder = Encoder.at(tokenizer, ByteLevelEncoder)
        lengths = token_lengths(encoder)

        def work(texts: list) -> list[pa.Array]:
            texts = [t or "" for t in texts]
            begins, ends, counts, crossings = [], [], [], []
            for text, data in zip(texts, encoder.encode(texts), strict=True):
                starts = sections(text)
                tokens, crossing = allocate(text, np.frombuffer(data, "<u2"), lengths, starts, rule)
                begins.append(starts)
                ends.append([*starts[1:], len(text)])
                counts.append(tokens)
                crossings.append(crossing)
            return [pa.array(x, pa.list_(pa.int64())) for x in (begins, ends, counts, crossings)]

        return work

    fields = ", ".join(f"{c} array<long>" for c in ("start", "end", "n_tokens", "n_crossing"))
    found = each_text(docs, text_col, docs.columns if carry is None else carry, fields, make)
    whole = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    each = F.posexplode(F.arrays_zip("start", "end", "n_tokens", "n_crossing")).alias("section", "x")
    return found.select("carried", whole.alias("doc_tokens"), each).select("carried", "section", "x.*", "doc_tokens")


def op8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = section_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), carry=["doc_id"])
    return found.select("carried.doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens")
