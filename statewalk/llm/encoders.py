"""Token ids through the tokenizers library, with a bounded cache of pieces per worker process.

The library spends most of a text's time on bookkeeping that ids don't need, and corpora repeat words.
Texts are therefore cut at white space, where the two known kinds of description cut as well; a piece
that the worker has not seen yet is cut into the description's words, and the library's model gives their
ids. Texts for which that could differ (other scripts, odd white space, special tokens) go to the
library whole, so ids are the library's own in any case.
"""

from __future__ import annotations

import json
from codecs import charmap_decode
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

#: Pieces, and words, of a generation; a worker holds two of each at most.
CACHE = 1 << 18
#: Characters on whose class all regular expression engines agree, unchanged by NFC.
PLAIN = regex.compile(r"[\n\x20-\x7E¡-¬®-ĩĲ-ſ]*")
LEVEL_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Marks without letters and numbers; an apostrophe may begin a word.
MARKS = "!#$%&()*+,-./:;<=>?@[]^_{|}~"
MARK_BYTES = MARKS.encode()
#: Bytes of ASCII letters and of the characters from U+00C0 to U+00FF and from U+0140 to U+017F, all of them plain.
LETTER_BYTES = bytes([*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC5])
#: White space whose pieces are not independent of each other, and marks of our own.
ODD = (b"\x00", b"\x01", b"\t", b"\r", b"\x0b", b"\x0c", b"  ", b" \n", b"\n\n\n", b"\n\n ")


def odd(data: bytes) -> bool:
    """Whether a text has such white space, at its ends included."""
    return data.startswith(b" ") or data.endswith((b" ", b"\n\n")) or any(x in data for x in ODD)


def byte_symbols() -> dict[int, str]:
    """Byte to its printable stand-in: itself where printable, else the next free code point."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as bytes of ``dtype``, without special tokens added."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.dtype = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        # When a cache is full it becomes the old one, from which what is still used moves over.
        self.cache: dict[bytes, bytes | bool] = {}
        self.old_cache: dict[bytes, bytes | bool] = {}
        self.known: dict[str, bytes] = {}  # words, which pieces with other punctuation share
        self.old_known: dict[str, bytes] = {}
        symbols = byte_symbols()
        self.stand_ins = "".join(symbols[i] for i in range(256))
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.model = self.tokenizer.model
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.names = [i.to_bytes(int(self.dtype[-1]), "little") for i in range(max(size, 1 + max(self.tokenizer.get_vocab().values(), default=0)))]
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        split = spec.get("pre_tokenizer") or {}
        steps = split.get("pretokenizers", [])
        norms = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.keeps_space = (
            split.get("type") == "ByteLevel" and split.get("use_regex")
            and not split.get("add_prefix_space") and spec.get("normalizer") is None
        )
        self.drops_space = [x.get("type") for x in steps] == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"]
        self.lead = symbols[32] if self.keeps_space else ""
        self.words = regex.compile(steps[0]["pattern"]["Regex"]) if self.drops_space else LEVEL_WORDS

    def encode(self, text: str) -> bytes:
        data = text.encode("utf-8")
        pieces = None
        if self.keeps_space and data and not odd(data):
            # A space goes with the word after it; a line's first word has a mark instead.
            pieces = (b"\x01" + data.replace(b"\n", b" \x00")).split(b" ")
        elif self.drops_space:
            pieces = data.lower().split()
        if pieces is not None and not any(s in data for s in self.special):
            found = list(map(self.cache.get, pieces))
            try:
                return b"".join(found)
            except TypeError:  # a piece that is not known, or False
                found = [self._learn(p) if ids is None else ids for p, ids in zip(pieces, found, strict=True)]
            try:
                return b"".join(found)
            except TypeError:  # False
                pass
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()

    def _learn(self, piece: bytes) -> bytes | bool:
        """Ids of a piece; False where its text has to go to the library whole."""
        ids: bytes | bool | None = self.cache.get(piece)
        if ids is not None:
            return ids
        ids = self.old_cache.get(piece)
        if ids is None:
            ids = self._piece(piece)
        if len(self.cache) >= CACHE:
            self.old_cache, self.cache = self.cache, {}
        self.cache[piece] = ids
        return ids

    def _piece(self, piece: bytes) -> bytes | bool:
        # Letters are one word of either kind, and so are marks after them.
        if piece.isalpha():
            return self._ids(self.lead + piece.decode())
        letters = piece.rstrip(MARK_BYTES)
        if letters.isalpha() or letters and not letters.translate(None, LETTER_BYTES) and letters.decode("utf-8").isalpha():
            if len(letters) < len(piece):
                return self._learn(letters) + self._word(piece[len(letters) :].decode())
            if self.drops_space:
                letters = letters.decode("utf-8").lower().encode("utf-8")
            return self._ids(self.lead + charmap_decode(letters, "strict", self.stand_ins)[0])
        head = {0: "\n", 1: ""}.get(piece[0] if piece else -1) if self.keeps_space else ""
        text = piece[self.keeps_space and head is not None :].decode("utf-8")
        if self.drops_space:
            text = text.lower()
        if not (text.isascii() and text.isprintable() or PLAIN.fullmatch(text)):
            return False
        body = text.rstrip(MARKS)
        if body.isalpha():
            # A line's mark is a word of its own before letters, a space is part of the word.
            first = self._word("\n") if head == "\n" else b""
            word = self._word(" " + body if head is None else body)
            return first + word + self._word(text[len(body) :]) if len(body) < len(text) else first + word
        return b"".join(map(self._word, self.words.findall((" " if head is None else head) + text)))

    def _ids(self, symbols: str) -> bytes:
        names = self.names
        return b"".join([names[t.id] for t in self.model.tokenize(symbols)])

    def _word(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is not None:
            return ids
        ids = self.old_known.get(word)
        if ids is None:
            symbols = charmap_decode(word.encode("utf-8"), "strict", self.stand_ins)[0]
            ids = self._ids(symbols)
        if len(self.known) >= CACHE:
            self.old_known, self.known = self.known, {}
        self.known[word] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)
