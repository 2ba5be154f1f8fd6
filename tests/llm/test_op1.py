from collections import Counter

import numpy as np
import xxhash

from graphmend.llm.op1_simhash import (
    BKTree,
    _links,
    band_keys,
    joined,
    keep_one_of_each,
    long_fingerprint,
    near_duplicates,
    near_links,
    shingle_hashes,
    similar_documents,
    simhash,
)

SCHEMA = "doc_id long, text string, fp string"


def slow_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        ones.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))


def slow_components(ids, fps):
    comp = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    least = {}
    for c, i in zip(comp, ids, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return [least.get(c) for c in comp]


def rows():
    base = "the quick brown fox jumps over a lazy dog and runs far away from every hound in town " * 6
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(30000))
    texts = [base, base, base + " today", base.replace("lazy", "idle", 1), "", None, "  \n", "one", "One two", "zebra", long, long + " end"]
    return [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (None, base, None)]


def test_simhash_matches_definition():
    for _, text, _ in rows():
        assert simhash(text) == slow_simhash(text)


def test_components_match_brute_force(spark):
    data = rows()
    out = near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()
    want = slow_components([r[0] for r in data], [slow_simhash(r[1]) for r in data])
    assert Counter((r.doc_id, r.component_id) for r in out) == Counter(zip([r[0] for r in data], want, strict=True))


def test_links_join_all_close_pairs_in_any_chunking(spark):
    import random

    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    fps = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(3))) for s in seeds for _ in range(20)})
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    want = slow_components(fps, fps)
    for chunk in (4, 1000):
        found = near_links(spark.createDataFrame(signed, "fp long"), chunk=chunk).collect()
        parent = {f: f for f in fps}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in found:
            a, b = root(r.a % (1 << 64)), root(r.b % (1 << 64))
            parent[max(a, b)] = min(a, b)
        assert [root(f) for f in fps] == want


def test_tree_search_and_links():
    tree = BKTree()
    for v in (0, 1, 3, 255, 1):
        tree.add(v)
    assert len(tree.values) == 4
    assert sorted(tree.values[n] for n in tree.search(0, 2)) == [0, 1, 3]
    assert len(_links([0, 1, 2], [0, 1, 2], True, 3)) == 2


def test_empty_table_and_keep(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    data = rows()
    kept = keep_one_of_each(spark.createDataFrame(data, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp"]
    comps = similar_components([r[1] for r in data])
    want = {}
    for c, r in zip(comps, data, strict=True):
        want[c] = min(want.get(c, (True, 0)), (r[0] is None, r[0] or 0))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for _, i in want.values())
    assert keep_one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar_components(texts):
    sets = [shingle_set(t) for t in texts]
    comp = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) > 0:
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    return comp


def families(seed, count=12, copies=12):
    """Texts of 8 to 300 words, and copies of each with more and more words replaced."""
    import random

    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    texts = []
    for _ in range(count):
        base = [word() for _ in range(rng.choice([8, 30, 100, 300]))]
        for k in range(copies):
            copy = list(base)
            for at in rng.sample(range(len(copy)), min(len(copy), k * len(copy) // 150)):
                copy[at] = word()
            texts.append(" ".join(copy))
    return texts


def partition(comps):
    groups = {}
    for i, c in enumerate(comps):
        groups.setdefault(c, []).append(i)
    return sorted(groups.values())


def test_similar_components_match_brute_force(spark):
    texts = families(3) + ["", None, "one two", "One two", "three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    found = {r.row: r.component_id for r in similar_documents(docs, "text", "row").collect()}
    assert partition([found[i] for i in range(len(texts))]) == partition(similar_components(texts))


def test_groups_are_joined_in_any_chunking(spark):
    texts = [t for t in families(4, count=4) if t] + families(9, count=1, copies=40)
    want = partition(similar_components(texts))
    rows = []
    for i, t in enumerate(texts):
        found = np.unique(shingle_hashes(t, 5))
        rows.append((0, i, len(found), bytearray(long_fingerprint(found)), t))
    members = spark.createDataFrame(rows, "g long, row long, size long, fp binary, text string")
    for chunk, shingles in ((1000, 1 << 22), (5, 1 << 22), (1000, 500)):
        comp = list(range(len(texts)))
        for r in joined(members, 64, 0.8, chunk, shingles).collect():
            comp[r.node] = r.root
        assert partition(comp) == want


def test_recall_of_the_pairs_of_every_fiftieth_text(spark):
    """All texts similar to those with an id divisible by 50, by brute force, are in their component."""
    texts = families(21, count=40, copies=14)
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    found = {r.row: r.component_id for r in similar_documents(docs, "text", "row").collect()}
    sets = [shingle_set(t) for t in texts]
    pairs = [(q, i) for q in range(0, len(texts), 50) for i in range(len(texts)) if 10 * len(sets[q] & sets[i]) >= 8 * len(sets[q] | sets[i])]
    assert len(pairs) > 20
    assert sum(found[a] == found[b] for a, b in pairs) == len(pairs)


def test_trees_pass_over_families():
    rng = np.random.default_rng(8)
    seeds = [int.from_bytes(rng.bytes(32), "little") for _ in range(20)]
    near = lambda s: s ^ sum(1 << int(b) for b in rng.choice(256, 40, replace=False))
    tree, seen = BKTree(), 0
    for s in seeds:
        for _ in range(50):
            tree.add(near(s))
    values = tree.values

    class Counted(list):
        def __getitem__(self, i):
            nonlocal seen
            seen += 1
            return values[i]

    tree.values = Counted(values)
    hits = list(tree.search(seeds[0], 64))
    assert len(hits) == 50 and seen < 0.9 * len(values)


def test_band_keys_meet_at_the_similarity():
    rng, met = np.random.default_rng(1), Counter()
    for shared in (800, 300):
        for _ in range(200):
            both = rng.integers(0, 1 << 63, 1000, np.uint64)
            own = (1000 - shared) // 2
            a, b = both[: shared + own], np.concatenate([both[:shared], both[shared + own :]])
            met[shared] += bool((band_keys(a) == band_keys(b)).any())
    assert met[800] >= 196 and met[300] <= 10
    assert len(shingle_hashes("", 5)) == len(shingle_hashes(None, 5)) == 0
