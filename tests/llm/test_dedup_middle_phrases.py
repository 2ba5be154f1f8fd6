"""Line runs, piece tables and phrase automata against brute force, with odd input."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmend.llm import op11_lines, op12_middle, op13_phrases
from graphmend.llm.automata import Automaton, Grams, compose, union

SCHEMA = "doc_id long, text string, lang string, kept string, form string, n long, carried string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "k", "f", 5, None) for i, t, lang in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- line runs -----------------------------------------------------------------------------------------------------


def line_key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})


def slow_lines(texts, documents, chars=1):
    texts = [t or "" for t in texts]
    seen = Counter(k for t in texts for k in {line_key(x) for x in t.split("\n")} if len(k) >= chars)
    often = {k for k, n in seen.items() if n >= documents}
    out = []
    for t in texts:
        own = t.split("\n")
        left = [x for x in own if line_key(x) not in often]
        out.append((len(own), len(own) - len(left), "\n".join(left)))
    return out


def line_texts(rng, n):
    pool = ["ab", " Ab\t", "É x", "é x", "\x0bÉ X\r", "", "  ", "x" * 300, "\x1cq", "q ", "long " * 40] + [f"line {i}" for i in range(12)]
    return [rng.choice([None, "", "\n", "\n\n"]) if rng.random() < 0.1 else "\n".join(rng.choices(pool, k=rng.randint(1, 6))) for _ in range(n)]


@pytest.mark.parametrize("fan,hot,chars", [(2, 10_000, 1), (3, 4, 1), (2, 0, 3)])
def test_lines_by_batches(spark, monkeypatch, fan, hot, chars):
    monkeypatch.setattr(op11_lines.LineRuns.__init__, "__defaults__", (op11_lines.DOCUMENTS, fan, op11_lines.HOT))
    rng = random.Random(fan)
    texts = line_texts(rng, 70)
    texts += texts[:5]
    rows = [(i % 40 if i % 7 else None, t, None) for i, t in enumerate(texts)]
    batches = [frame(spark, rows[k : k + 13]) for k in range(0, len(rows), 13)]
    out = op11_lines.drop_frequent_lines(batches, documents=5, chars=chars, hot=hot)
    assert out.columns == ["doc_id", "text", "lang", "kept", "form", "n", "carried", "n_lines", "n_dropped", "kept_"]
    mine = Counter((r.doc_id, r.text, r.n_lines, r.n_dropped, r.kept_) for r in out.collect())
    slow = slow_lines(texts, 5, chars)
    assert mine == Counter((i, t, *s) for (i, t, _), s in zip(rows, slow, strict=True))
    assert not any(t.name.startswith("line_run") for t in spark.catalog.listTables())


def test_lines_add_up_across_levels(spark):
    """A line that is rare in every batch settles once its counts meet; settled lines are not counted again."""
    runs = op11_lines.LineRuns(spark, documents=3, fan=2)
    for batch in range(5):
        docs = frame(spark, [(batch, f"same\nonly {batch}", None), (batch, "twice" if batch < 2 else "z", None)])
        runs.add(op11_lines.line_counts(docs, "text"))
    import xxhash

    assert {bytes(r.h) for r in runs.frequent().collect()} == {xxhash.xxh3_128_digest(k) for k in (b"same", b"z")}
    runs.drop()


def test_no_lines(spark):
    assert op11_lines.drop_frequent_lines([frame(spark, [])]).count() == 0
    one = op11_lines.drop_frequent_lines([frame(spark, [(1, None, None)])]).collect()[0]
    assert (one.n_lines, one.n_dropped, one.kept_) == (1, 0, "")


# --- fill in the middle --------------------------------------------------------------------------------------------


def slow_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), form, len(pre), len(mid), out


def test_middles_and_back(spark):
    rng = random.Random(5)
    signs = ["a", "Zz", "é", "日本", "😀", " ", "\n", "<", "<S", "P>", "<P", "M>", "_", "@", "[", "`", "{", "0", "\x00"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(300)] + [None, "", "x<P>y", "<S>", "only", "Ω" * 9, "word " * 40_000]
    rows = [(rng.choice([None, -3, i]) if i % 50 == 0 else i, t, None) for i, t in enumerate(texts)] + [(7, texts[7], None)]
    made = op12_middle.fill_in_middle(frame(spark, rows))
    assert made.columns == ["doc_id", "lang", "kept", "form", "n", "carried", "n_", "form_", "prefix_chars", "middle_chars", "pieces", "output", "output_sha256"]
    found = made.collect()
    assert {r.form_ for r in found} == {"plain", "psm", "spm"}
    for r, (i, t, _) in zip(found, rows, strict=True):
        n, form, before, middle, output = slow_middle(i, t)
        assert (r.n_, r.form_, r.prefix_chars, r.middle_chars, r.output, r.output_sha256) == (n, form, before, middle, output, sha(output))
        buffers = [(t or "").encode(), b"<P><M><S>"]
        assert b"".join(buffers[p.buffer][p.start : p.start + p.length] for p in r.pieces).decode() == output
    back = op12_middle.restored(made, form_col="form_").collect()
    assert [(r.text, r.restored_sha256) for r in back] == [(t or "", sha(t or "")) for _, t, _ in rows]
    assert op12_middle.fill_in_middle(frame(spark, [])).count() == 0


def test_piece_tables_cut_again_and_again():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(200))
    table = op12_middle.PieceTable(data)
    for _ in range(5):
        table = table.cut(sorted(rng.choices(range(201), k=4)))
        assert table.bytes() == data and table.digest() == hashlib.sha256(data).hexdigest()
    three = op12_middle.PieceTable(data).cut([0, 200])
    for order in op12_middle.ARRANGEMENTS.values():
        assert three.arranged(order).inverse(order).bytes() == data


# --- phrases -------------------------------------------------------------------------------------------------------


def slow_phrases(rows, least, top, inside):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang, text = lang or "und", (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            counts.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang in total:
        own = {g[1:]: n for g, n in counts.items() if g[0] == lang}
        found = []
        for g, a in own.items():
            if len(g) < 2 or a < least:
                continue
            longer = [n for h, n in own.items() if len(g) == 2 and len(h) == 3 and n >= least and g in (h[:2], h[1:])]
            if any(100 * n >= inside * a for n in longer):
                continue
            score, _, left, right = min((1_000_000 * a * a // (own[g[:k]] * own[g[k:]]), k, own[g[:k]], own[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i, p.decode(), -a, le, ri, total[lang], -s) for i, (s, a, p, le, ri) in enumerate(sorted(found)[:top], 1)]
    return out


@pytest.mark.parametrize("chunk,arcs", [(1 << 20, 1 << 20), (40, 60), (7, 25)])
def test_phrases(spark, monkeypatch, chunk, arcs):
    monkeypatch.setattr(op13_phrases, "PROBE", 8)
    monkeypatch.setattr(op13_phrases, "BLOCK", 16)
    rng = random.Random(3)
    vocabulary = ["The", "the", "é", "É", "of", "new", "york", "a\x1cb", "\x01", "ß", "x" * 40, "日本", "<", "-"]
    texts = []
    for _ in range(60):
        words = rng.choices(vocabulary, weights=range(14, 0, -1), k=rng.randint(0, 60))
        texts.append("".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for w in words))
    rows = [(rng.choice([None, "en", "de", "en\x00"]), t) for t in texts] + [("en", None), ("de", ""), ("xx", "..."), ("one", "new york " * 30), ("one", "new york")]
    docs = frame(spark, [(i, t, lang) for i, (lang, t) in enumerate(rows)]).repartition(3)
    out = op13_phrases.phrases(docs, least=3, top=25, chunk=chunk, range_arcs=arcs)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    mine = sorted(tuple(r) for r in out.collect())
    assert mine == sorted(slow_phrases(rows, 3, 25, 50)) and len(mine) > 50


def test_no_phrases(spark):
    assert op13_phrases.phrases(frame(spark, [])).count() == 0
    assert op13_phrases.phrases(frame(spark, [(1, "a b", "en"), (2, None, None)])).count() == 0


def test_scores_beyond_64_bits():
    big = 10**10
    count = {(b"a",): big, (b"b",): 3 * big, (b"a", b"b"): big - 1, (b"b", b"c"): big - 1, (b"c",): big}
    assert op13_phrases.scored((b"a", b"b"), big - 1, count) == (1_000_000 * (big - 1) ** 2 // (3 * big * big), big, 3 * big)
    assert op13_phrases.scored((b"a", b"b", b"c"), big - 1, count)[0] == 1_000_000 * (big - 1) ** 2 // (big * (big - 1))


def random_grams(rng, n, words=b"abcdefgh"):
    found = Counter()
    for _ in range(n):
        g = [rng.randrange(len(words)) for _ in range(rng.randint(1, 3))]
        for k in range(1, len(g) + 1):
            found[tuple(g[:k] + [-1] * (3 - k))] += 1
    names = [bytes([w]) for w in words]
    return found, Grams.of(names, np.array(list(found), np.int64).reshape(-1, 3), np.array(list(found.values()), np.int64))


def as_counts(grams):
    return {tuple(grams.words[i] for i in ids if i >= 0): n for ids, n in zip(grams.ids.tolist(), grams.weights.tolist(), strict=True)}


def test_automata_keep_add_and_compose():
    rng = random.Random(2)
    for n in (0, 1, 5, 60, 400):
        (one, a), (two, b) = random_grams(rng, n), random_grams(rng, n, b"bdfhz")
        first, second = Automaton.decode(Automaton.build(a).encode()), Automaton.decode(Automaton.build(b).encode())
        assert as_counts(first.grams()) == as_counts(a) and len(a) == len(one)
        assert len(first.label) <= len(one)  # equal continuations are stored once
        both = Counter(as_counts(a)) + Counter(as_counts(b))
        assert as_counts(union([first, second])) == both
        common = {g: (x, as_counts(b)[g]) for g, x in as_counts(a).items() if g in as_counts(b)}
        assert as_counts(compose(first, second, lambda x, y: 1000 * x + y)) == {g: 1000 * x + y for g, (x, y) in common.items()}
        places = a.places([(b"c", b""), (b"c", b"d"), (b"zz", b"")])
        assert as_counts(a.slice(places[0], places[1])).keys() >= {g for g in as_counts(a) if (b"c", b"") <= (*g, b"")[:2] < (b"c", b"d")}


def test_counts_of_wide_vocabularies(monkeypatch):
    """Where three ids don't fit into 64 bits, rows are compared instead."""
    rng = random.Random(4)
    _, a = random_grams(rng, 200)
    wide = Grams.of([b"%08d" % i for i in range(2_100_000)], a.ids.copy(), a.weights)
    assert (wide.ids == a.ids).all() and (wide.weights == a.weights).all()
