r"""Personal data with offset-preserving deobfuscation.

Base kinds are matched in the text as it is. Then transducers rewrite a copy of the text and keep, for every character
of the copy, the source span it stands for: look-alike and full-width signs become ASCII and invisible ones go, runs of
spelled digits become digits, bracketed or spelled at/dot disguises become signs. The same detectors run on the copy,
and what they find maps back to source characters. A mapped span counts unless a base span of its kind holds all of it.

Results for odd input: null and empty texts have no spans; texts that no transducer changes have base spans only; long
texts are handled whole, in time linear in their length (no pattern starts anew within a run that it has scanned); repeated rows are documents of their own; an empty table gives
no rows; carried columns may have any name, as they travel in one struct.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import each_text, read_table

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # starts within a run of digits give nothing new
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Letters of other scripts that look like ASCII ones (Cyrillic, Greek, Armenian, Latin), signs, and number
#: words. Full-width, mathematical, circled, raised and lowered signs and small capitals follow from Unicode's own data.
ALIKE = dict(
    zip(
        "авгеһікӏмноԛрѕтухԁјԝѵүпьАВЕЅІЈКМНОРСТУХҮԌԚԜс"
        "αβγεηικνορτυχωϲΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
        "աօոսհցզ"
        "ıİɑɡɩƅ"
        "＠﹫。．․‧﹒",
        "abrehiklmhoqpstyxdjwvynbABESIJKMHOPCTYXYGQWc"
        "abyenikvoptuxwcABEZHIKMNOPTYX"
        "wonuhgq"
        "iIagib"
        "@@.....",
        strict=True,
    )
)
INVISIBLE = "​‌‍⁠﻿­"
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}

_WORD = "(?:" + "|".join(DIGIT_WORDS) + ")"
#: Spelled digits, three or more in a row; a spelled plus, dot or dash may stand among them.
_SPELLED = re.compile(rf"(?<![A-Za-z])(?:plus[\x20-]+)?{_WORD}(?:[\x20,-]+(?:(?:dot|point|dash)[\x20,-]+)?{_WORD}){{2,}}(?![A-Za-z])", re.I)
_SPELLED_PART = re.compile(rf"plus|dot|point|dash|{_WORD}", re.I)
_OPEN, _CLOSE = r"(?<![\[({<])[\[({<]++[\x20\t]*+", r"[\x20\t]*+[\])}>]++[\x20\t]*+"
_BRACKET_AT = re.compile(rf"{_OPEN}(?:at|@|arroba|chez){_CLOSE}", re.I)
_BRACKET_DOT = re.compile(rf"{_OPEN}(?:dot|\.|punkt|punto|point){_CLOSE}", re.I)
_LOOSE_AT = re.compile(r"(?<=[A-Za-z0-9])[\x20\t]++@[\x20\t]*+(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@[\x20\t]++(?=[A-Za-z0-9])")
#: A spelled address, name at host dot end: its middle, and what must follow.
_SPELLED_AT = re.compile(r"(?<=[\x20_-])at(?=[\x20_-])|(?<=[A-Za-z0-9_%+-])@(?=[A-Za-z0-9])", re.I)
_SPELLED_HOST = re.compile(r"[\x20_-]*+[A-Za-z0-9]++(?:[\x20_-]++dot[\x20_-]++[A-Za-z0-9]++)++", re.I)
_ADDRESS_PART = re.compile(r"(?<![\x20_-])[\x20_-]++(at|dot)[\x20_-]++", re.I)
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")
_NOT_ASCII = re.compile("[^\x00-\x7f]")
_ANY_WORD = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


def _passes(kind: str, match: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in match.split(".")))
    digits = [int(c) for c in match if "0" <= c <= "9"]
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if not 13 <= len(digits) <= 19:
        return False
    doubled = (2 * d - 9 if d > 4 else 2 * d for d in digits[-2::-2])
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


#: What must be in a text for a kind to match, as quick tests.
_NEEDS = {"email": re.compile("@"), "ip": re.compile(r"[0-9]\.[0-9]"), "card": re.compile(r"[0-9]"), "phone": re.compile(r"\+[0-9]")}


def _emails(text: str) -> Iterable[tuple[int, int]]:
    """The leftmost matches one after the other, started only at the run of name characters before an at sign."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and (text[start - 1] in "._%+-" or (text[start - 1].isascii() and text[start - 1].isalnum())):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def detect(text: str) -> list[tuple[int, int, int]]:
    """Base spans (kind index, start, end): by kind, then start."""
    out = []
    for k, (kind, pattern) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True)):
        if _NEEDS[kind].search(text):
            found = _emails(text) if kind == "email" else (m.span() for m in pattern.finditer(text))
            out += [(k, a, b) for a, b in found if _passes(kind, text[a:b])]
    return out


class Tape:
    """A text under rewriting, with the source span of each of its characters."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces stretches [a, b), in order and apart; each new character stands for its whole stretch."""
        if not edits:
            return
        texts, starts, ends, last = [], [], [], 0
        for a, b, new in edits:
            texts += (self.text[last:a], new)
            starts += self.starts[last:a] + [self.starts[a]] * len(new)
            ends += self.ends[last:a] + [self.ends[b - 1]] * len(new)
            last = b
        self.text = "".join([*texts, self.text[last:]])
        self.starts, self.ends = starts + self.starts[last:], ends + self.ends[last:]


@cache
def _plain(c: str) -> str | None:
    """What stands for a character outside ASCII; None if the character itself does."""
    if c in INVISIBLE:
        return ""
    if c in ALIKE:
        return ALIKE[c]
    plain = unicodedata.normalize("NFKC", c)
    if len(plain) == 1 and plain.isascii():
        return plain
    if (digit := unicodedata.decimal(c, None)) is not None:
        return str(digit)
    start, _, letter = unicodedata.name(c, "").rpartition(" ")
    return letter.lower() if start == "LATIN LETTER SMALL CAPITAL" and len(letter) == 1 else None


def _alike(tape: Tape) -> None:
    found = ((m.start(), _plain(m.group())) for m in _NOT_ASCII.finditer(tape.text))
    tape.rewrite([(i, i + 1, new) for i, new in found if new is not None])


def _spelled_digits(tape: Tape) -> None:
    signs = {"plus": "+", "dot": ".", "point": ".", "dash": "-"} | DIGIT_WORDS
    edits = []
    for m in _SPELLED.finditer(tape.text):
        parts = [(p.start(), p.end(), signs[p.group().lower()]) for p in _SPELLED_PART.finditer(tape.text, *m.span())]
        for i, (a, b, new) in enumerate(parts):
            if i:
                edits.append((parts[i - 1][1], a, ""))
            edits.append((a, b, new))
    tape.rewrite([e for e in edits if e[0] < e[1]])


def _bracketed(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """Matches from bracket to bracket with the blanks around them."""
    last = 0
    for m in pattern.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in " \t":
            start -= 1
        yield start, m.end()
        last = m.end()


def _back(text: str, at: int, last: int, signs: str) -> int:
    while at > last and text[at - 1] in signs:
        at -= 1
    return at


def _spelled_addresses(text: str) -> Iterator[tuple[int, int]]:
    """Names, spelled dots in them allowed, before a spelled or plain at and a host with spelled dots."""
    last = dead = 0  # the end of the last address; the start of a name that can't be one
    for m in _SPELLED_AT.finditer(text):
        host = _SPELLED_HOST.match(text, m.end()) if m.start() >= last else None
        if not host:
            continue
        at = m.start() if m.group() == "@" else _back(text, m.start(), last, " _-")
        first = at
        while True:
            end = first
            while first > last and first != dead and text[first - 1] in _NAME:
                first -= 1
            if first == end:  # a dot without a name before it
                first = -1
                break
            if first > last and text[first - 1] == ".":
                first -= 1
                continue
            gap = _back(text, first, last, " _-")
            if gap == first or gap - 3 < last or text[gap - 3 : gap].lower() != "dot":
                break
            before = _back(text, gap - 3, last, " _-")
            if before == gap - 3 or before == last or text[before - 1] not in _NAME:
                break
            first = before
        if first < 0 or first == dead > 0 or not any(c not in "_%+-" for c in text[first:at]):
            dead = at
            continue
        yield first, host.end()
        last = host.end()


def _disguises(tape: Tape) -> None:
    for pattern, sign in ((_BRACKET_AT, "@"), (_BRACKET_DOT, ".")):
        tape.rewrite([(a, b, sign) for a, b in _bracketed(tape.text, pattern)])
    tape.rewrite([(m.start(), m.end(), "@") for m in _LOOSE_AT.finditer(tape.text)])
    edits = []
    for span in _spelled_addresses(tape.text):
        edits += [(p.start(), p.end(), "@" if p.group(1).lower() == "at" else ".") for p in _ADDRESS_PART.finditer(tape.text, *span)]
    tape.rewrite(edits)


def _disguised(text: str) -> bool:
    """Whether a pattern of ``_disguises`` may match: by what each needs, then by the pattern itself."""
    bracket = "[" in text or "(" in text or "{" in text or "<" in text
    if bracket and (_BRACKET_AT.search(text) or _BRACKET_DOT.search(text)):
        return True
    return "dot" in text.lower() or "@" in text and _LOOSE_AT.search(text) is not None


def deobfuscated(text: str) -> Tape | None:
    """The rewritten text; None if nothing in it can change."""
    tape = None
    try:
        text.encode("latin-1")
        odd = any(c in text for c in "\xad¹²³ªº")
    except UnicodeEncodeError:
        odd = True
    if odd:
        tape = Tape(text)
        _alike(tape)
    low = (tape.text if tape else text).lower()
    if sum(w in low for w in _ANY_WORD) and _SPELLED.search(low):
        tape = tape or Tape(text)
        _spelled_digits(tape)
    if _disguised(tape.text if tape else text):
        tape = tape or Tape(text)
        _disguises(tape)
    return tape if tape is not None and tape.text != text else None


def find_spans(text: str | None) -> list[tuple[int, int, int, bool]]:
    """(kind index, start, end, base) by kind, then start."""
    if not text:
        return []
    base = detect(text)
    tape = deobfuscated(text)
    more: list[tuple[int, int, int]] = []
    if tape:
        by_kind: dict[int, list[tuple[int, int]]] = {}
        for k, a, b in base:
            by_kind.setdefault(k, []).append((a, b))
        places = {k: 0 for k in by_kind}
        for k, a, b in detect(tape.text):
            start, end = tape.starts[a], tape.ends[b - 1]
            own, at = by_kind.get(k, []), places.get(k, 0)
            while at < len(own) and own[at][1] <= start:
                at += 1
            places[k] = at
            if at == len(own) or own[at][0] > start or own[at][1] < end:
                more.append((k, start, end))
    return sorted([(*s, True) for s in base] + [(*s, False) for s in more])


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def _spans_array(found: list) -> pa.Array:
    rows = [[{"kind": k, "start": a, "end": b, "base": base} for k, a, b, base in f] for f in found]
    return pa.array(rows, _SPANS)


_FIELD = "spans array<struct<kind:int,start:int,end:int,base:boolean>>"


def personal_data(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(carried, spans) per document: sorted structs (kind index, start, end, base) in code points."""

    def make():
        return lambda texts: [_spans_array([find_spans(t) for t in texts])]

    return each_text(docs, text_col, docs.columns if carry is None else carry, _FIELD, make)


def redacted(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; spans that overlap are replaced as one, by the first."""
    found = sorted((a, -b, k) for k, a, b, _ in find_spans(text))
    if not found:
        return text
    out, last = [], 0
    for a, b, k in found:
        if a >= last:
            out += (text[last:a], f"[{KINDS[k].upper()}]")
        last = max(last, -b)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, all columns, with personal data replaced in their texts."""

    def make():
        return lambda texts: [pa.array([redacted(t) for t in texts], pa.string())]

    rest = [c for c in docs.columns if c != text_col]
    found = each_text(docs, text_col, rest, "redacted string", make)
    return found.select(*(F.col("redacted").alias(c) if c == text_col else F.col(f"carried.`{c}`") for c in docs.columns))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(k) for k in KINDS))
    told = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    counts = (F.size(F.filter(base, lambda s, k=k: s["kind"] == k)).cast("long").alias(f"n_{x}") for k, x in enumerate(KINDS))
    return personal_data(read_table(spark, sf_dir, "documents"), carry=["doc_id"]).select(
        F.col("carried.doc_id").alias("doc_id"), *counts,
        F.sha2(F.array_join(F.transform(base, told), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", told), ",").alias("spans"),
    )
