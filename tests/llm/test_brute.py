"""Verdicts, links and token places of whole operators against plain loops over random small tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from graphmend.llm import op3_quality, op7_secrets, op8_counts
from graphmend.llm.encoding import ByteLevelEncoder

SCHEMA = "doc_id long, text string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def normal(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", line.lower().strip(" \t\n\x0b\x0c\r")))


def is_depleted(words, removed):
    return removed > 0 and (words - removed < 20 or words - removed < 0.2 * words)


def slow_kept(rows):
    """The verdict for each row; base measures come from elsewhere, so texts here don't repeat eight words."""
    lines, size = [], []
    for _, text, _ in rows:
        held = [(normal(x), len(WORD.findall(x))) for x in (text or "").split("\n") if WORD.search(x)]
        lines.append(held)
        size.append(sum(n for _, n in held))
    rank = lambda r: (rows[r][0] is None, rows[r][0] or 0, r)
    kept = [n >= 20 for n in size]
    for host in {h for _, _, h in rows}:
        mine = [r for r in range(len(rows)) if rows[r][2] == host]
        copy = {r: frozenset(x for x, _ in lines[r]) for r in mine}
        every = set(copy.values())
        held = Counter(x for c in every for x in c)
        above = lambda n, of: n >= 20 and n > 0.05 * of
        frequent = {x for x, n in held.items() if above(n, len(every))}
        lost = {r: sum(n for x, n in lines[r] if x in frequent) for r in mine}
        bare = [r for r in mine if kept[r] and is_depleted(size[r], lost[r])]
        for r in bare:
            kept[r] = False
        texts = {}
        for r in sorted(bare, key=rank):
            texts.setdefault(copy[r], r)
        texts = list(texts.values())
        first = {}
        for r in texts:  # in order of rank
            core = copy[r] & frequent
            for key in (*core, frozenset(core)):
                first.setdefault(key, r)
        group = {}
        for r in texts:
            core = copy[r] & frequent
            leads = []
            for lead in {first[k] for k in (*core, frozenset(core))} - {r}:
                both = copy[r] & copy[lead]
                share = lambda t, b=both: sum(n for x, n in lines[t] if x in b) >= 0.8 * size[t]
                if share(r) and share(lead):
                    leads.append(lead)
            group[r] = min(leads, key=rank, default=r)
        less = len(texts) - len(set(group.values()))
        still = set()
        for x in frequent:
            holders = [r for r in texts if x in copy[r]]
            if holders and above(held[x] - len(holders) + len({group[r] for r in holders}), len(every) - less):
                still.add(x)
        sizes = Counter(group.values())
        for r in texts:
            if group[r] == r and sizes[r] > 1 and not is_depleted(size[r], sum(n for x, n in lines[r] if x in still)):
                kept[r] = True
    return kept


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_verdicts_of_quality_rules(spark, seed):
    rng = random.Random(seed)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    rows = []
    for host in ("a", "b", None):
        menu, page = [say(rng.randrange(2, 9)) for _ in range(6)], [say(9) for _ in range(9)]
        for _ in range(90):
            body = [rng.choice(menu) for _ in range(rng.randrange(5))]
            if rng.random() < 0.4:
                body += [x if rng.random() > 0.07 else say(9) for x in page]
            body += [say(rng.randrange(1, 30)) for _ in range(rng.randrange(3))]
            rows.append((rng.choice([None, *range(400)]), "\n".join(dict.fromkeys(body)), host))
        rows += rng.choices(rows[-90:], k=12)
    rows += [(None, None, "a"), (3, " \n\t", "b")]
    found = op3_quality.judged(spark.createDataFrame(rows, SCHEMA).coalesce(1)).orderBy("row").collect()
    want = slow_kept(rows)
    assert [r.kept for r in found] == want
    assert any(r.depleted and r.kept for r in found) and any(r.depleted and not r.kept for r in found)


def test_footers_go_whatever_their_hash(spark):
    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    footers = {f"h{h}": say(6) for h in range(40)}
    rows = [(i, f"{say(30)}\n{f}", h) for h, f in footers.items() for i in range(40)]
    kept = op3_quality.keep_good(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(kept) == 1600 and not any(footers[r.source] in r.text for r in kept)


def slow_secrets(text, scope=256):
    spans = []
    for kind, (pattern, group, least) in (op7_secrets.PATTERNS | op7_secrets.WEAK).items():
        for m in re.finditer(pattern, text):
            x = m.group()
            if len(m.group(group)) >= least and (kind != "secret" or all(re.search(c, x) for c in ("[0-9]", "[a-z]", "[A-Z]"))):
                spans.append((op7_secrets.KINDS.index(kind), *m.span()))
    base = [s for s in spans if s[0] < 3]
    spans = base + [s for s in spans if s[0] >= 3 and not any(b[1] < s[2] and s[1] < b[2] for b in base)]
    part = {0: "secret", 1: "ident", 2: "secret", 3: "ident", 4: "secret", 5: "endpoint"}
    near = lambda s, p: any(t != s and part[t[0]] == p and max(t[1] - s[2], s[1] - t[2]) <= scope for t in spans)
    good = {"ident": lambda s: near(s, "secret"), "secret": lambda s: near(s, "ident"), "endpoint": lambda s: near(s, "ident") and near(s, "secret")}
    return sorted((s[1], s[0], s[2], s[0] < 3) for s in spans if s[0] < 3 or good[part[s[0]]](s))


def test_links_of_credentials(spark):
    rng = random.Random(4)
    secret = lambda: "".join(rng.choice("abcXYZ012+/") for _ in range(40))
    parts = [
        lambda: "AKIA" + "Q" * 16, lambda: "ASIA" + "Z" * 14, lambda: "client_id=abc123", lambda: f" {secret()} ", lambda: "password: hunter2hunter2",
        lambda: "postgres://db.example.com/x", lambda: "0123456789abcdef" * 2, lambda: " " * rng.randrange(300), lambda: "word " * rng.randrange(20), lambda: "\n",
    ]
    rows = [(i, "".join(rng.choice(parts)() for _ in range(rng.randrange(12))), "s") for i in range(400)]
    out = {r.carried.doc_id: [tuple(s) for s in r.spans] for r in op7_secrets.secrets(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text, _ in rows:
        assert out[i] == slow_secrets(text), text
    assert sum(not s[3] for spans in out.values() for s in spans) > 100


def slow_counts(text, rule, encoder, spelled):
    starts, counts = op8_counts.sections(text), defaultdict(int)
    chars = [i for i, c in enumerate(text) for _ in c.encode()]
    at = 0
    for token in encoder.library.encode(text, add_special_tokens=False).ids:
        held = sorted({chars[b] for b in range(at, at + len(spelled[token]))})
        at += len(spelled[token])
        of = [max(k for k, s in enumerate(starts) if s <= c) for c in held]
        best = {"first": of[0], "last": of[-1], "most": min(of, key=lambda k: (-of.count(k), k))}[rule]
        counts[best] += 1
    return [counts[k] for k in range(len(starts))]


@pytest.mark.parametrize("rule", op8_counts.RULES)
def test_token_places_in_texts_of_many_scripts(rule):
    rng = random.Random(6)
    encoder = ByteLevelEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    spelled = {i: t for t, i in encoder.library.get_vocab().items()}
    lengths = op8_counts.token_lengths(encoder)
    pieces = ["Été", "中文", "привет", "😀", "é", "\n", "\n\n", ". ", "! ", " ", "word", "☃", "don't", "…", "\t"]
    for _ in range(400):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        ids = np.frombuffer(encoder.encode([text])[0], "<u2")
        tokens, _ = op8_counts.allocate(text, ids, lengths, op8_counts.sections(text), rule)
        assert tokens.tolist() == slow_counts(text, rule, encoder, spelled), text
