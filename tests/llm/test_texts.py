"""Operators on whole texts against brute force: quality, personal data, secrets, winnowing, section counts, shards, WARC."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphmend.llm import op3_quality, op4_warc, op5_pii, op7_secrets, op8_counts, op9_winnow, op10_shards
from graphmend.llm.shared import new_path

SCHEMA = "doc_id long, text string, source string, row int, h string, n_chars long"
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "h", None) for i, t, s in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- quality -------------------------------------------------------------------------------------------------------


def slow_measures(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def quality_rows():
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    texts = ["", None, " \t\n", say(19), say(20), say(10) + "\n" + "a b c d e f g h i j " * 9, say(40) + "\n\n" + "x # $\n" * 3, say(20000)]
    passage = say(12)
    texts += [f"{passage} {say(40)} {passage}", f"{passage}\n{passage}\n" + say(100)]
    return [(i, t, "a") for i, t in enumerate(texts)]


def test_quality_base(spark):
    rows = quality_rows() + [(3, quality_rows()[4][1], None), (None, quality_rows()[4][1], "b")]
    out = op3_quality.judged(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = Counter((r.carried.doc_id, r.host, *(r[n] for n in names), r.base_failed) for r in out)
    want = Counter()
    for i, t, s in rows:
        m = slow_measures(t)
        want[i, s, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]] += 1
    assert got == want
    assert op3_quality.judged(frame(spark, [])).count() == 0


def test_boilerplate_lines_go_and_depleted_documents(spark):
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(n))
    notice = "Please  accept cookies 12 to go on"
    rows = [(i, f"{say(30)}\n{notice.replace('12', str(i))}", "a") for i in range(40)]
    rows += [(40, f"{notice}\n" * 5 + say(8), "a"), (41, f"{notice}\n{say(30)}", "b")]
    copy = f"{say(30)}\n{say(30)}"
    rows += [(100 + i, copy, "a") for i in range(30)]
    kept = {r.doc_id: r.text for r in op3_quality.keep_good(frame(spark, rows)).collect()}
    assert 40 not in kept and len(kept) == 71
    assert all("cookies" not in kept[i] and len(words(kept[i])) == 30 for i in range(40))
    assert "cookies" in kept[41] and kept[105] == copy


def test_lines_count_once_a_distinct_document(spark):
    """Whatever the hashes are: lines that always come together, on documents with one line of their own."""
    rng = random.Random(7)
    say = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(n))
    shared = [say(4) for _ in range(12)]
    rows = [(i, "\n".join([*shared, say(60)]), "a") for i in range(25)]
    rows += [(100 + i, rows[0][1], "a") for i in range(30)] + [(200 + i, say(60), "a") for i in range(100)]
    rows += [(300 + i, "\n".join([*shared, say(60)]), "b") for i in range(19)] + [(400, rows[-1][1], "b")]
    kept = {r.doc_id: r.text for r in op3_quality.keep_good(frame(spark, rows)).collect()}
    assert len(kept) == len(rows)
    for i, text, _ in rows:
        assert kept[i] == (text.split("\n")[-1] if i < 200 else text)


def test_depleted_documents_go_but_the_first_of_near_copies(spark):
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(n))
    menu = [say(10) for _ in range(3)]
    rows = [(i, "\n".join([*menu, say(40)]), "a") for i in range(30)]
    rows += [(100 + i, "\n".join([*menu, say(8)]), "a") for i in range(12)]  # menu pages, all within the base rules
    rows += [(112, rows[-1][1], "a"), (113, "\n".join([*menu, say(10), say(9)]), "a")]
    lines = [say(10) for _ in range(10)]
    near = [(200 + i, "\n".join([*lines[: i % 10], say(10), *lines[i % 10 + 1 :]]), "b") for i in range(40)]
    half = [(300 + i, f"{lines[0]} {lines[1]}\n{say(15)}", "c") for i in range(30)]  # depleted by a notice, not copies
    full = {r.carried.doc_id: r for r in op3_quality.judged(frame(spark, rows + near + half)).collect()}
    assert not any(r.base_failed for r in full.values())
    assert all(full[i].depleted for i, _, _ in near + half) and all(full[i].depleted for i in range(100, 114))
    assert sorted(i for i, r in full.items() if r.kept) == [*range(30), 200]


# --- personal data -------------------------------------------------------------------------------------------------


def slow_base(text):
    out = []
    for k, pattern in enumerate((op5_pii.EMAIL, op5_pii.IP, op5_pii.CARD, op5_pii.PHONE)):
        for m in pattern.finditer(text or ""):
            digits = [int(c) for c in m.group() if c.isdigit()]
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            good = (True, k == 1 and all(int(p) <= 255 for p in m.group().split(".")), 13 <= len(digits) <= 19 and luhn, 9 <= len(digits) <= 15)
            if good[k]:
                out.append((k, *m.span()))
    return out


def test_base_personal_data_matches_plain_patterns():
    rng = random.Random(8)
    parts = ["a.b", "@", "x-y", ".com", ".", " ", "+1", "(0)", "12", "255", "4111 1111 1111 1111", "-", "é", "1.2.3.4", "@@", "555-0123", "\n"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert op5_pii.detect(text) == slow_base(text), text


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write to john.doe at example dot com now", "email", "john.doe at example dot com"),
        ("john [at] mail (dot) example [dot] org!", "email", "john [at] mail (dot) example [dot] org"),
        ("jоhn@exаmple.cоm", "email", "jоhn@exаmple.cоm"),
        ("call plus one two zero two five five five zero one two three ok", "phone", "plus one two zero two five five five zero one two three"),
        ("é ４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("at one nine two dot one six eight dot one dot two up", "ip", "one nine two dot one six eight dot one dot two"),
        ("joh​n@ex.com", "email", "joh​n@ex.com"),
    ],
)
def test_disguises_map_back(text, kind, found):
    spans = op5_pii.find_spans(text)
    assert (kind, found) in [(op5_pii.KINDS[k], text[a:b]) for k, a, b, base in spans if not base]
    assert found not in op5_pii.redacted(text)


@pytest.mark.parametrize("a", "[({<")
@pytest.mark.parametrize("blank", ["", " ", "\t"])
def test_each_disguise_alone_is_found(a, blank):
    b = {"[": "]", "(": ")", "{": "}", "<": ">"}[a]
    texts = [f"john{x}{a}{blank}{w}{blank}{b}{x}example.com" for w in ("at", "AT", "@", "arroba", "chez") for x in ("", " ")]
    texts += [f"john@example{x}{a}{blank}{w}{blank}{b}{x}com" for w in ("dot", ".", "punkt", "Punto", "point", "po\u0130nt") for x in ("", " ")]
    texts += ["john @ example.com", "john@ example.com", "john @example.com", "john\t@\texample.com"]
    for text in texts:
        assert [(k, text[s:e]) for k, s, e, base in op5_pii.find_spans(text) if not base] == [(0, text)], text


@pytest.mark.parametrize(
    "text",
    ["dot" + " " * 10**6, "1.2" + "3" * 10**6, "dot " + "-" * 10**6 + " at " + "-" * 10**6, "(" * 10**6 + " at " + ")" * 10**6,
     "dot .-" + "at-" * 300_000, "x dot " * 200_000 + "at y dot z", "a@" * 500_000 + " dot", ("one" + " " * 1000) * 1000, "+1" + "-" * 10**6, "1" * 10**6],
    ids=range(10),
)
def test_long_runs_take_linear_time(text):
    best = []
    for part in (text[: len(text) // 4], text):
        start = time.process_time()
        op5_pii.find_spans(part)
        best.append(time.process_time() - start)
    assert best[1] < 12 * best[0] + 1  # four times the length; a quadratic pattern takes minutes


@pytest.mark.parametrize("text", ["j\u043e\u043a\u0435r@mail.com", "\u0442\u043e\u043c@mail.com", "\u24d9ohn@mail.com", "\U0001d41cat@mail.com", "j\u1d0fhn@mail.com", "john@mail\ufe52com"])
def test_letters_of_other_alphabets_are_seen_through(text):
    assert (0, 0, len(text), False) in op5_pii.find_spans(text)


def test_plain_texts_stay():
    for text in ("one two three go", "Meet at noon. Dot the i.", "", None, "The point is at home", "© 2024 été"):
        assert op5_pii.find_spans(text) == [] and op5_pii.redacted(text) == text


@pytest.mark.parametrize("odd", "\u0130\u0131\u017f\u212a")
def test_letters_that_match_ascii_ones_without_case(odd):
    for word in ("six", "five"):
        for letter in "isk":
            text = f"a@b.co, one two three and {word.replace(letter, odd)} one two three"
            assert [s[:3] for s in op5_pii.find_spans(text) if s[3]] == slow_base(text) == [(0, 0, 6)]


def test_personal_data_frames(spark):
    rows = [(1, "mail a@b.org", "s"), (2, None, "s"), (3, "", None), (None, "x " * 50000 + "a at b dot net", "s")]
    out = {r.carried.doc_id: r.spans for r in op5_pii.personal_data(frame(spark, rows)).collect()}
    assert [len(out[k]) for k in (1, 2, 3, None)] == [1, 0, 0, 1]
    red = op5_pii.redact(frame(spark, rows))
    assert red.columns == frame(spark, []).columns and {r.doc_id: r.text for r in red.collect()}[1] == "mail [EMAIL]"
    assert op5_pii.redact(frame(spark, [])).count() == 0


# --- secrets -------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def slow_secrets(text):
    text = text or ""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 8]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out, key=lambda s: (s[1], op7_secrets.BASE.index(s[0])))


def test_base_secrets_match_plain_patterns(spark):
    rng = random.Random(9)
    parts = ["token", "Secret", "API_KEY", "apikey", "=", ": ", "'", '"', "abcdefgh12", "x", " ", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef" * 2, "é", "\n"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(16))), "s") for i in range(1500)] + [(-1, None, "s"), (-2, "", "s")]
    out = op7_secrets.secrets(frame(spark, rows)).collect()
    got = {r.carried.doc_id: [(op7_secrets.KINDS[s.kind], s.start, s.end) for s in r.spans if s.base] for r in out}
    assert got == {i: slow_secrets(t) for i, t, _ in rows}
    assert op7_secrets.secrets(frame(spark, [])).count() == 0


def test_weak_parts_need_each_other(spark):
    ident, secret, place = "ASIA" + "Q" * 16, "aB3" + "xY7/" * 9 + "q", "https://db.example.net:5432"
    far = " z" * 400
    rows = [(1, f"{ident} {secret} {place}", "s"), (2, f"{ident}{far} {secret}", "s"), (3, f"{place} {ident}", "s"), (4, secret, "s")]
    rows += [(5, f"AKIA{'B' * 16} and {secret}", "s"), (6, f"token = {secret} by {ident}", "s")]
    out = {r.carried.doc_id: [op7_secrets.KINDS[s.kind] for s in r.spans] for r in op7_secrets.secrets(frame(spark, rows)).collect()}
    assert out == {1: ["ident", "secret", "endpoint"], 2: [], 3: [], 4: [], 5: ["access", "secret"], 6: ["assign", "ident"]}


def test_secrets_follow_their_keys_in_any_form(spark):
    ident, secret = "AKIA" + "Q" * 16, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    forms = ("KEY=%s", "KEY = %s", 'KEY="%s"', "KEY='%s'", "KEY:%s", "KEY: %s", "export KEY=%s;", "KEY==%s")
    rows = [(i, f"AWS_ACCESS_KEY_ID={ident}\nAWS_SECRET_ACCESS_" + f % secret, "s") for i, f in enumerate(forms)]
    rows += [(100, f"KEY={secret}", "s"), (101, f"{ident} KEY={secret}=", "s"), (102, f"{ident} KEY={secret}x", "s")]
    out = {r.carried.doc_id: r.spans for r in op7_secrets.secrets(frame(spark, rows)).collect()}
    for i, text, _ in rows[: len(forms)]:
        assert [(op7_secrets.KINDS[s.kind], text[s.start : s.end]) for s in out[i]] == [("access", ident), ("secret", secret)], text
    assert [len(out[i]) for i in (100, 101, 102)] == [0, 1, 1]


# --- decontamination -----------------------------------------------------------------------------------------------


def slow_hits(text, items):
    w, hit, names = op9_winnow.words_of(text), set(), set()
    for name, item in items:
        v = op9_winnow.words_of(item)
        n = min(13, len(v))
        if n:
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    names.add(None if name is None else str(name))
    return len(w), len(hit), sorted(names, key=lambda x: (x is None, x)), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_winnowing_finds_every_window(spark, monkeypatch):
    rng = random.Random(10)
    some = ["w%d" % i for i in range(5)]
    say = lambda n: " ".join(rng.choice(some) for _ in range(n))
    items = [(i, say(rng.choice((2, 9, 13, 14, 20, 40)))) for i in range(25)] + [(99, None), (98, ""), (97, "A-b. C!"), (96, "same " * 30)]
    items += [(None, say(15)), (None, say(3))]
    rows = [(i, say(rng.choice((0, 5, 30, 200))), "s") for i in range(60)]
    for i in range(60, 90):
        k, text = rng.randrange(25), items[rng.randrange(25)][1].upper().replace(" ", ", ")
        rows.append((i, f"{say(k)} {text} {say(k)}", "s"))
    rows += [(90, None, "s"), (91, "a B c", "s"), (92, "Same " * 50, "s"), (90, "é " * 30, "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter((i, n, h, tuple(m), c) for i, t, _ in rows for n, h, m, c in [slow_hits(t, items)])
    for most in (10**6, 0):  # one index, and a join
        out = op9_winnow.contamination(frame(spark, rows), bench, most_bytes=most).collect()
        assert Counter((r.carried.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in out) == want
    kept = op9_winnow.drop_contaminated(frame(spark, rows), bench)
    assert kept.count() == sum(n for (_, _, _, _, c), n in want.items() if not c)
    # Blocks of one or two items, each met by several tasks.
    monkeypatch.setattr(op9_winnow, "TASK_WEIGHT", 9000)
    again = op9_winnow.contamination(frame(spark, rows), bench, most_bytes=-1, block_bytes=60).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))
    assert op9_winnow.contamination(frame(spark, []), bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert op9_winnow.contamination(frame(spark, rows), none).where("n_hit > 0").count() == 0
    assert op9_winnow.contamination(frame(spark, rows), none, most_bytes=-1).where("n_hit > 0").count() == 0
    named = spark.createDataFrame([("b-2", "same " * 30), ("b-10", "same " * 20)], "item_id string, text string")
    hits = op9_winnow.contamination(frame(spark, [(92, "Same " * 50, "s")]), named).first()
    assert hits["items"] == ["b-10", "b-2"] and hits.n_hit == 50


# --- section counts ------------------------------------------------------------------------------------------------


def test_section_counts(spark):
    texts = ["Title one. Body here\nand more ☃ lines\n\nend", "", None, "No end", "Ein Satz.\nZwei", "\n\n", "word " * 20000 + ". x"]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    library = Tokenizer.from_file(BYTE)
    out = op8_counts.section_counts(frame(spark, rows), BYTE).collect()
    for i, t, _ in rows:
        mine = sorted((r for r in out if r.carried.doc_id == i), key=lambda r: r.section)
        ids = library.encode(t or "", add_special_tokens=False)
        assert sum(r.n_tokens for r in mine) == len(ids.ids) == mine[0].doc_tokens
        assert [r.start for r in mine][1:] == [r.end for r in mine][:-1] and mine[-1].end == len(t or "")
        spelled = [library.decode([x]) for x in ids.ids]
        if t and t.isascii():  # tokens are their characters there
            at, counts = 0, Counter()
            for s in spelled:
                held = [(-max(0, min(r.end, at + len(s)) - max(r.start, at)), r.section) for r in mine]
                counts[min(held)[1]] += 1
                at += len(s)
            assert [counts[r.section] for r in mine] == [r.n_tokens for r in mine]
    title = next(r for r in out if r.carried.doc_id == 0 and r.section == 1)
    assert title.n_crossing == 0 and op8_counts.section_counts(frame(spark, []), BYTE).count() == 0


def test_rules_place_crossing_tokens():
    import numpy as np

    lengths, ids = np.array([0, 3, 2]), np.array([1, 2])
    for rule, want in (("first", [1, 1, 0]), ("last", [0, 1, 1]), ("most", [0, 2, 0])):
        assert op8_counts.allocate("abcde", ids, lengths, [0, 1, 4], rule)[0].tolist() == want


# --- shards --------------------------------------------------------------------------------------------------------


def test_shards_are_even_gapless_and_whole(spark):
    rng = random.Random(11)
    rows = [(i, "x" * rng.randrange(200), "s") for i in range(3000)] + [(None, "é", "s"), (5, None, "s")]
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    out = op10_shards.shard(frame(spark, rows), "doc_id", size, 24).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((i, t) for i, t, _ in rows)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    total = {s: sum(len((r.text or "").encode()) + 8 for r in v) for s, v in by.items()}
    assert len(by) == 24 and max(total.values()) - min(total.values()) <= 2 * 208
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
    order = [r.doc_id for s in range(24) for r in sorted(by[s], key=lambda r: r.slot) if r.doc_id is not None]
    assert order == sorted(order)


def test_equal_rows_and_empty_tables_are_sharded(spark):
    rows = [(7, "same text", "s")] * 1000
    out = op10_shards.shard(frame(spark, rows), "doc_id", F.length("text"), 4).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in out) == [250] * 4
    assert op10_shards.shard(frame(spark, []), "doc_id", F.length("text"), 4).count() == 0
    named = frame(spark, rows[:10]).withColumn("slot", F.lit(1)).withColumn("shard", F.lit(2))
    assert set(op10_shards.shard(named, "doc_id", F.length("text"), 2).columns) >= {"slot", "shard", "slot_", "shard_"}


# --- WARC ----------------------------------------------------------------------------------------------------------


def test_derivatives_link_and_survive_the_file(spark):
    html = '<html lang="en"><head><title>A &amp; B</title><script>x<y</script></head><body><p>One<br>two</p><a href="/z">z</a></body>'
    pages = spark.createDataFrame([(1, "http://a/", html, "x"), (2, None, None, "x"), (3, "u", "plain < text\r\n\r\n", "x")], "page_id long, url string, html string, record_id string")
    found = op4_warc.responses(pages)
    out = op4_warc.derivatives(found).collect()
    ids = {r.page_id: r.record_id for r in found.collect()}
    assert len(out) == 6 and all(r.refers_to == ids[r.page_id] for r in out) and len({r.record_id for r in out}) == 6
    text = next(r for r in out if r.page_id == 1 and r.warc_type == "conversion")
    assert text.block == "A & B\nOne\ntwo\nz"
    assert text.source_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    about = next(r for r in out if r.page_id == 1 and r.warc_type == "metadata").block.split("\r\n")
    assert about[:2] == ["title: A & B", "language: en"] and "outlink: /z" in about
    path = new_path(spark, "warc")
    records = op4_warc.all_records(found).select("header", "block")
    op4_warc.write_records(records, path)
    assert Counter(map(tuple, op4_warc.read_records(spark, path).collect())) == Counter(map(tuple, records.collect()))
    assert op4_warc.derivatives(op4_warc.responses(pages.limit(0))).count() == 0


def test_records_of_odd_pages(spark):
    html = "<html lang=fr><title>A\r\nWARC-Type: x</title><a href='/q'>&#65;&#x1F600;&#x110000;</a><a\nhref=/r>&amp;#66; &hellip;</a><a href=\"/s\nt\">"
    rows = [(1, "http://a/\r\nX: y", html, "2020-02-03T04:05:06Z"), (1, "http://a/\r\nX: y", html, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, date string")
    out = op4_warc.all_records(op4_warc.responses(pages)).collect()
    assert {r.date for r in out} == {"2020-02-03T04:05:06Z", op4_warc.DATE} and len(out) == 6
    named = {r.record_id for r in out if r.warc_type == "response"}
    assert all(r.refers_to in named for r in out if r.warc_type != "response") and len(named) == 1
    assert all(r.target == "http://a/%0D%0AX: y" and "\nX: y" not in r.header for r in out)
    about = next(r for r in out if r.warc_type == "metadata").block.split("\r\n")
    assert about[:2] == ["title: A WARC-Type: x", "language: fr"] and about[4:] == ["outlink: /q", "outlink: /r", "outlink: /s t"]
    text = next(r for r in out if r.warc_type == "conversion").block
    assert "A\U0001F600&#x110000;" in text and "&#66; …" in text


def test_crc_of_text_is_the_plain_one(spark):
    row = spark.createDataFrame([("é",)], "t string").select(F.crc32(F.col("t").cast("binary")).alias("c")).first()
    assert row.c == zlib.crc32("é".encode())
