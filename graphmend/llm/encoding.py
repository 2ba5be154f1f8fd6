"""Exact, cached encoding with public tokenizer files (the ``tokenizers`` library does all encoding).

Word shapes repeat, and both tokenizer kinds here never merge across a boundary of a non-space and a space that follows
it. A text that is words parted by single spaces or line breaks is therefore cut into such words, each distinct word is
encoded once per worker, and the ids are joined. Any other text is encoded whole. Both ways give the same ids.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Words that one call to the library encodes at a time.
JOINED = 400

#: Characters whose words are held at a time.
SLICE_CHARS = 1 << 20

#: Letters that normalisation and lowering keep letters.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch

_KEPT: dict[tuple[str, bool], "Encoder"] = {}


class Encoder:
    """Encodes texts as little-endian unsigned 16-bit id bytes (both vocabularies have under 65,536 ids)."""

    #: A text that is one token wherever white space or a line break surrounds it, and what surrounds it here.
    mark = "\n"
    glue = ""
    #: Words kept per worker process: about 270 bytes each.
    cache_words = 600_000
    #: Signs that never merge with a letter before them.
    tails = ".,;:!?"

    def __init__(self, path: str, spelled_out: bool = False) -> None:
        """``spelled_out``: strings of special tokens in a text are ordinary text; else they get the special ids, as the
        library's files have it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        # A text that spells a special token, in any case, is encoded whole by the library as loaded; it costs more there.
        self.loaded = self.library if spelled_out else Tokenizer.from_file(path)
        self.special = () if spelled_out else tuple(t.content.lower() for t in self.library.get_added_tokens_decoder().values() if t.special)
        self.hint = "|>" if all(s.endswith("|>") for s in self.special) else ""
        if self.library.get_vocab_size() > 65536:
            raise ValueError("ids need more than 16 bits")
        self.cache: dict[str, bytes] = {}
        ids = self.library.encode(self.mark, add_special_tokens=False).ids
        if len(ids) != 1:
            raise ValueError("the mark must be one token")
        self.mark_id = ids[0]
        self.tail_ids = dict(zip(self.tails, self._whole(list(self.tails)), strict=True))

    @staticmethod
    def at(path: str, kind: type[Encoder], spelled_out: bool = False) -> Encoder:
        """The process's encoder for a file."""
        if (path, spelled_out) not in _KEPT:
            _KEPT[path, spelled_out] = kind(path, spelled_out)
        return _KEPT[path, spelled_out]

    def _holds_special(self, text: str) -> bool:
        return self.hint in text and any(s in text.lower() for s in self.special)

    def _whole(self, texts: list[str]) -> list[bytes]:
        if any(map(self._holds_special, texts)):
            return [np.array((self.loaded if self._holds_special(t) else self.library).encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
        return [np.array(e.ids, "<u2").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, text: str) -> list[str] | None:
        """Keys of words whose ids, joined, are the text's; None where the text has another shape."""
        raise NotImplementedError

    def _spelled(self, key: str) -> str:
        """The text that a key stands for, but for what _before gives."""
        return key

    def _before(self, key: str) -> bytes:
        """Ids in front of those of the spelled text."""
        return b""

    def _learn(self, keys: list[str]) -> dict[str, bytes]:
        spelled = {k: self._spelled(k) for k in keys}
        odd = [k for k in keys if self.mark in spelled[k]]
        learnt = dict(zip(odd, self._whole([spelled[k] for k in odd]), strict=True))
        before = self._before
        plain = [k for k in keys if self.mark not in spelled[k]]
        between = f"{self.glue}{self.mark}{self.glue}"
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        joined = [between.join(map(spelled.__getitem__, g)) for g in groups]
        for group, e in zip(groups, self.library.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u2")
            cuts = np.flatnonzero(ids == self.mark_id).tolist()
            if len(cuts) != len(group) - 1:
                learnt.update(zip(group, self._whole([spelled[k] for k in group]), strict=True))
                continue
            data, start = ids.tobytes(), 0
            for key, end in zip(group, [*cuts, len(ids)], strict=True):
                learnt[key] = data[2 * start : 2 * end]
                start = end + 1
        return {k: before(k) + ids for k, ids in learnt.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; words are cut for about ``SLICE_CHARS`` characters of texts at a time."""
        out: list[bytes] = []
        start = held = 0
        for end, text in enumerate(texts, 1):
            held += len(text)
            if held >= SLICE_CHARS or end == len(texts):
                out += self._encode(texts[start:end])
                start, held = end, 0
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        get, tails = self.cache.get, self.tail_ids
        rows: list[tuple[list, list] | None] = []
        need: set[str] = set()
        for text in texts:
            words = None if self._holds_special(text) else self._words(text)
            if words is None:
                rows.append(None)
                continue
            parts, gaps = list(map(get, words)), []
            if None in parts:
                for i, part in enumerate(parts):
                    if part is None:
                        word = words[i]
                        core, tail = word[:-1], tails.get(word[-1])
                        if tail is None or not _LATIN(core):
                            core, tail = word, b""
                        part = get(core)
                        if part is None:
                            need.add(core)
                            gaps.append((i, core, tail))
                        else:
                            parts[i] = part + tail
            rows.append((parts, gaps))
        learnt = self._learn(list(need)) if need else {}
        whole = iter(self._whole([t for t, r in zip(texts, rows, strict=True) if r is None]))
        out = []
        for row in rows:
            if row is None:
                out.append(next(whole))
                continue
            parts, gaps = row
            for i, core, tail in gaps:
                parts[i] = learnt[core] + tail
            out.append(b"".join(parts))
        if len(self.cache) + len(learnt) <= self.cache_words:
            self.cache.update(learnt)
        return out


class ByteLevelEncoder(Encoder):
    """For byte_bpe_50k.json: a word keeps the space before it, a line break between words is a token of its own.

    A key is a word that a space precedes; with a line break in front, the first word of a later line; with a carriage
    return in front, the first word of the text.
    """

    def _words(self, text: str) -> list[str] | None:
        words = text.split()
        if " ".join(words) != text.replace("\n", " "):
            return None
        if words:
            words[0] = "\r" + words[0]
        if "\n" in text:
            at = 0
            for line in text.split("\n")[:-1]:
                at += line.count(" ") + 1
                words[at] = "\n" + words[at]
        return words

    def _spelled(self, key: str) -> str:
        return key[1:] if key[0] in "\n\r" else " " + key

    def _before(self, key: str) -> bytes:
        return self.mark_id.to_bytes(2, "little") if key[0] == "\n" else b""


class WordEndEncoder(Encoder):
    """For word_bpe_49k.json: white space is dropped and letters are lowered, so words alone decide the ids."""

    mark = "|"
    glue = " "
    #: Packing shares its workers with other stages of a pipeline.
    cache_words = 250_000
    #: White space to str.split that the tokenizer takes for symbols.
    control = "\x1c\x1d\x1e\x1f"

    def _words(self, text: str) -> list[str] | None:
        if any(c in text for c in self.control):
            return None
        try:
            text.encode("latin-1")
            text = text.lower()  # for these letters the same as the tokenizer's own lowering
        except UnicodeEncodeError:
            pass
        return text.split()
