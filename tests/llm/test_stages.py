"""The pipeline stage by stage against brute force on random documents; splitters against a sort."""

import itertools
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from test_brute import WORD, is_depleted, normal, slow_kept
from test_op1 import similar_components
from test_texts import slow_hits
from tokenizers import Tokenizer

from graphmend.llm import op5_pii, op10_shards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def random_documents(seed, count=200):
    """Documents of three hosts with menus and shared pages, copies with some words replaced, passages of test items, addresses."""
    rng = random.Random(seed)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    items = [say(rng.choice([5, 13, 30])) for _ in range(6)]
    menus = {h: [say(6) for _ in range(4)] for h in ("a", "b", None)}
    rows = []
    while len(rows) < count:
        host = rng.choice(["a", "a", "b", None])
        if rows and rng.random() < 0.25:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = "w" + say(1)
            text = " ".join(words)
        else:
            body = [rng.choice(menus[host]) for _ in range(rng.randrange(3))] + [say(rng.randrange(1, 60)) for _ in range(2)]
            body += [rng.choice(items)] if rng.random() < 0.15 else []
            body += ["mail kim at host dot org or +44 20 7946 0958"] if rng.random() < 0.2 else []
            text = "\n".join(dict.fromkeys(body))
        rows.append((len(rows) * 3, text, host))
    return rows + [(9000, None, "a"), (9001, "", None)], list(enumerate(items))


@pytest.mark.parametrize("seed", [1, 2])
def test_each_stage_is_brute_forces(spark, tmp_path, seed):
    rows, items = random_documents(seed)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = spark.createDataFrame([(i, t, "en", h, len(t or "")) for i, t, h in rows], SCHEMA)
    held = {i: (t, h) for i, t, h in rows}
    kept = []
    for (_, stage), judge in zip(corpus_pipeline.STAGES, (of_quality, of_copies, of_items(items), of_people), strict=False):
        out = stage(spark, out, str(tmp_path)).cache()
        held = judge(held)
        assert {r.doc_id: (r.text, r.source) for r in out.collect()} == held
        kept.append(len(held))
    assert len(rows) > kept[0] > kept[1] > kept[2] == kept[3] > 50
    packed = corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole = {}
    for r in packed:
        ids = np.frombuffer(r.input_ids, "<u4").tolist()
        for p in r.pieces:
            whole.setdefault(p.doc_id, []).append((p.start, ids[p.offset : p.offset + p.length]))
    ids = {i: list(itertools.chain.from_iterable(part for _, part in sorted(parts))) for i, parts in whole.items()}
    assert ids == {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, (t, _) in held.items()}


def of_quality(held):
    """Kept documents; lines that are frequent in their host go, but from texts that are depleted and stay."""
    rows, out = [(i, *r) for i, r in held.items()], {}
    lines = {i: [x for x in (t or "").split("\n") if WORD.search(x)] for i, t, _ in rows}
    for (i, text, host), keep in zip(rows, slow_kept(rows), strict=True):
        every = {frozenset(map(normal, lines[j])) for j, _, h in rows if h == host}
        count = Counter(x for c in every for x in c)
        often = lambda x, count=count, n=len(every): WORD.search(x) and count[normal(x)] >= 20 and count[normal(x)] > 0.05 * n
        size, lost = (sum(len(WORD.findall(x)) for x in some) for some in (lines[i], filter(often, lines[i])))
        if keep:
            out[i] = (text if is_depleted(size, lost) else "\n".join(x for x in text.split("\n") if not often(x)), host)
    return out


def of_copies(held):
    first = {}
    for i, c in zip(held, similar_components([t for t, _ in held.values()]), strict=True):
        first[c] = min(first.get(c, i), i)
    return {i: held[i] for i in first.values()}


def of_items(items):
    return lambda held: {i: r for i, r in held.items() if not slow_hits(r[0], items)[3]}


def of_people(held):
    return {i: (op5_pii.redacted(t), h) for i, (t, h) in held.items()}


@pytest.mark.parametrize(("seed", "shards"), [(1, 24), (2, 5), (3, 24)])
def test_splitters_are_a_sorts(spark, seed, shards):
    """Below each splitter stand as many bytes as the target, within the tolerance or as near as whole places come."""
    rng = random.Random(seed)
    wide = 10**30 if seed == 1 else 10**6
    rows = [(rng.randrange(wide), rng.choice([8, 9, 50, 4000 if seed == 3 else 60])) for _ in range(4000)]
    sizes = spark.createDataFrame([(str(p), s) for p, s in rows], "p string, size long").selectExpr("cast(p as decimal(38,0)) as place", "size")
    bounds, _ = op10_shards.splitters(sizes, shards)
    total, allowed = sum(s for _, s in rows), op10_shards.TOLERANCE * sum(s for _, s in rows) / shards
    by = {}
    for p, s in rows:
        by[p] = by.get(p, 0) + s
    below, places = [0], sorted(by)
    for p in places:
        below.append(below[-1] + by[p])
    assert bounds == sorted(bounds) and len(bounds) == shards - 1
    for k, bound in enumerate(bounds, 1):
        target = total * k / shards
        held = sum(s for p, s in rows if p < bound)
        assert abs(held - target) <= max(allowed, min(abs(b - target) for b in below))
