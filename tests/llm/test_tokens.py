import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphmend.llm.encoding import ByteLevelEncoder, WordEndEncoder
from graphmend.llm.op2_packing import first_fit_decreasing, pack_digest, pack_documents, padded_length
from graphmend.llm.op6_store import (
    LEAST_IDS,
    MOST_IDS,
    chunk_table,
    crc_before,
    cut_points,
    document_digests,
    read_documents,
    recipe_entries,
    verify_manifest,
    write_store,
)
from graphmend.llm.shared import new_path, written

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, piece string, Part int"


def library(path):
    return Tokenizer.from_file(path)


def plain(path, text):
    return [*library(path).encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def rows():
    rng = random.Random(3)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(9000))
    texts = ["Hello, World! It's fine.\nNew line", "", None, " odd  space\t", long, long, "same same " * 3000, "Émile Zola. <|endoftext|>"]
    return [(i, t, "x", 1) for i, t in enumerate(texts)] + [(0, texts[0], None, 2), (None, "null id", "x", 3)]


@pytest.mark.parametrize(("path", "kind"), [(WORD, WordEndEncoder), (BYTE, ByteLevelEncoder)])
def test_special_tokens_in_texts(path, kind):
    """Strings of special tokens inside, before and after words get the ids that the library as loaded gives them."""
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|endoftext", "|>"]
    texts = [f"{a}{m}{b}" for m in marks for a in ("", "a ", "a", "A\n", ". ") for b in ("", " b", "b", "\nB c.", m)]
    texts += [" ".join(marks), "plain words", "plain words <|endoftext|>"]
    for spelled_out in (False, True):
        theirs = library(path)
        theirs.encode_special_tokens = spelled_out
        mine = kind(path, spelled_out)
        for _ in range(2):
            assert mine.encode(texts) == [np.array(theirs.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]


@pytest.mark.parametrize(("path", "kind"), [(WORD, WordEndEncoder), (BYTE, ByteLevelEncoder)])
def test_cached_encoding_is_the_librarys(path, kind):
    mine, theirs = kind(path), library(path)
    points = [c for c in range(1, 0x2100)] + [0x212A, 0x2028, 0x3000, 0x4E2D, 0xFEFF, 0x1F600]
    texts = [f"ab{chr(c)} {chr(c)}cd {chr(c)} e{chr(c)}f\nG{chr(c)}\n{chr(c)}H don't {chr(c)}. Σ{chr(c)}Σ |" for c in points]
    pieces = [" ", "\n", "  ", "a", "B", "'s", "é", "Σ", "1", "23", ".", "|", "́", "\xa0", " ", "\x1c", "İ", "中", "\r\n"]
    rng = random.Random(1)
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(5000)]
    want = [np.array(e.ids, "<u2").tobytes() for e in theirs.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert mine.encode(texts) == want


def test_first_fit_decreasing_matches_the_plain_loop():
    rng = random.Random(2)
    for n in (0, 1, 7, 300):
        lengths = np.array([rng.randrange(1, 101) for _ in range(n)], np.int64)
        place, offset = first_fit_decreasing(lengths, 100)
        free, want = [], {}
        for k in sorted(range(n), key=lambda k: -lengths[k]):
            b = next((b for b, f in enumerate(free) if f >= lengths[k]), len(free))
            if b == len(free):
                free.append(100)
            want[k] = (b, 100 - free[b])
            free[b] -= lengths[k]
        assert want == {k: (place[k], offset[k]) for k in range(n)}


def test_packing_holds_every_id_once(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = pack_digest(docs, WORD).collect()
    by = {}
    for r in out:
        by.setdefault((r.doc_id), []).append(r)
    for doc_id, text, _, _ in rows():
        ids = plain(WORD, text)
        for r in by[doc_id]:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == crc(ids[r.start : r.start + r.length])
        copies = sum(x[0] == doc_id for x in rows())
        assert sum(r.length for r in by[doc_id]) == copies * len(ids)
    in_sequence = {}
    for r in out:
        in_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in in_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in out)
    assert len(in_sequence) <= total // 4096 + 2
    assert pack_digest(spark.createDataFrame([], SCHEMA), WORD).count() == 0


def test_sequences_carry_the_ids(spark):
    """Every id of every document stands in the padded sequences where the pieces say."""
    out = pack_documents(spark.createDataFrame(rows(), SCHEMA), WORD).collect()
    assert len({r.sequence_id for r in out}) == len(out)
    found = []
    for r in out:
        ids = np.frombuffer(bytes(r.input_ids), "<u4")
        assert len(ids) == (r.tokens if r.tokens & (r.tokens - 1) == 0 else 4096) == padded_length(r.tokens, 4096)
        at = 0
        for p in r.pieces:
            assert p.offset == at
            found.append((p.doc_id is None, p.doc_id or 0, p.doc_tokens, p.start, tuple(ids[at : at + p.length].tolist())))
            at += p.length
        assert at == r.tokens and not ids[at:].any()
    want = []
    for i, text, _, _ in rows():
        ids = plain(WORD, text)
        want += [(i is None, i or 0, len(ids), a, tuple(ids[a : a + 4096])) for a in range(0, len(ids), 4096)]
    assert sorted(found) == sorted(want)
    assert pack_documents(spark.createDataFrame([], SCHEMA), WORD).count() == 0



def test_store_round_trip(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    path = new_path(spark, "store")
    write_store(docs, path, BYTE)
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for doc_id, text, _, _ in order:
        ids = plain(BYTE, text)
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    got = document_digests(spark, path).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    whole = {r.start: np.frombuffer(bytes(r.ids), "<u2").tolist() for r in read_documents(spark, path).collect()}
    assert whole == {s: plain(BYTE, t) for (_, t, _, _), (_, s, _, _) in zip(order, want, strict=True)}
    chunks = chunk_table(spark, path)
    assert chunks.count() == chunks.select("digest").distinct().count() < recipe_entries(spark, path).count()
    assert verify_manifest(spark, path).count() == 0


def test_empty_store(spark):
    path = new_path(spark, "store")
    write_store(spark.createDataFrame([], SCHEMA), path, BYTE)
    assert document_digests(spark, path).count() == 0


def test_cuts_depend_on_content_only():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50000, 20000).astype(np.uint16), rng.integers(0, 50000, 500).astype(np.uint16)
    one, two = cut_points(a), [x - 500 for x in cut_points(np.concatenate([b, a]))]
    assert len(set(one) & set(two)) >= len(one) - 2
    for ids in (a, np.full(50000, 7, np.uint16), np.zeros(1, np.uint16)):
        sizes = np.diff([0, *cut_points(ids)])
        assert sizes.sum() == len(ids) and sizes.max() <= MOST_IDS and (sizes[:-1] >= LEAST_IDS).all()


def test_crcs_combine():
    parts = [b"abc", b"", b"x" * 70000, bytes(range(256)) * 3]
    behind = [sum(map(len, parts[i + 1 :])) for i in range(4)]
    moved = crc_before(np.array([zlib.crc32(p) for p in parts]), np.array(behind))
    assert int(np.bitwise_xor.reduce(moved)) == zlib.crc32(b"".join(parts))
