"""Byte-pair encoding and decoding with a priority queue over a doubly linked symbol list.

The vocabulary file is a parameter: a tokenizer description with normalised, lower-cased words,
byte-level symbols and an end-of-word suffix. A word's symbols form a doubly linked list; a heap holds
the applicable merges by (rank, place). An entry whose symbols have changed since is stale and skipped.
Decoding looks ids up and joins the vocabulary strings with single spaces, as a description
without a decoder asks for.

Texts are cut at white space; a piece's ids are kept in a bounded cache of the worker. Texts with
characters outside a plain range are normalised as a whole first, so both ways give the same ids.
One narrow pass, no shuffle; the working set of a task is one Arrow batch.

Defined cases: a null text counts as empty and has no ids. Strings of special tokens inside a text
become those tokens. Repeated rows are encoded row by row; empty tables give empty results; columns
of the input are kept, except those named like an output.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewalk.llm.encoders import byte_symbols

CACHE = 1_000_000
#: Texts of these characters only are unchanged by NFC, and their white space is that of str.split.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7E¡-¬®-ĩĲ-ſ]*")


class WordBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.symbols = byte_symbols()
        self.marked = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.cache: dict[str, bytes] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Symbols after all merges, lowest rank first and leftmost first among equals."""
        n = len(symbols)
        if n < 2:
            return symbols
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        live = list(symbols)
        merges = self.merges
        queue = []
        for i in range(n - 1):
            if hit := merges.get((live[i], live[i + 1])):
                queue.append((hit[0], i, live[i], live[i + 1], hit[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, joined = heapq.heappop(queue)
            j = after[i]
            if live[i] != left or j >= n or live[j] != right:
                continue  # stale: one of the two has been merged away
            live[i], live[j] = joined, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if hit := merges.get((joined, live[after[i]])):
                    heapq.heappush(queue, (hit[0], i, joined, live[after[i]], hit[1]))
            if (p := before[i]) >= 0 and (hit := merges.get((live[p], joined))):
                heapq.heappush(queue, (hit[0], p, live[p], joined, hit[1]))
        return [s for s in live if s >= 0]

    def word(self, word: str) -> list[int]:
        symbols = [self.symbols[b] for b in word.encode("utf-8")]
        symbols[-1] += self.suffix
        return self.merge([self.ids[s] for s in symbols if s in self.ids])

    def piece(self, text: str) -> bytes:
        """Ids of lower-cased text, little-endian unsigned 32-bit."""
        ids = [i for w in self.words.findall(text) for i in self.word(w)]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if PLAIN.fullmatch(text) and "<|" not in text:
            return self._pieces(text.lower().split())
        out = []
        for part in self.marked.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                part = regex.sub(r"\s+", " ", unicodedata.normalize("NFC", part))
                # Letter by letter: no final sigma.
                out.append(self.piece("".join(c.lower() for c in part)))
        return b"".join(out)

    def _pieces(self, pieces: list[str]) -> bytes:
        cache = self.cache
        found = list(map(cache.get, pieces))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    ids = cache.get(pieces[k])
                    if ids is None:
                        ids = self.piece(pieces[k])
                        if len(cache) < CACHE:
                            cache[pieces[k]] = ids
                    found[k] = ids
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One encoder per worker process and file."""
    return WordBpe(path)


def encode_decode(df: DataFrame, path: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with ids (binary, little-endian unsigned 32-bit), decoded (string), n_tokens,
    ids_sha256 and decoded_sha256; without the two large columns where ``keep_text`` is false."""
    made = ["ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"][0 if keep_text else 2 :]
    kept = [c for c in df.columns if c.lower() not in made]
    types = {"ids": "binary", "n_tokens": "long"}
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_source_text"))
    plain = source.drop("_source_text").schema
    schema = plain
    for c in made:
        schema = schema.add(c, types.get(c, "string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_bpe(path)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in made}
            for t in batch.column(batch.num_columns - 1):
                ids = coder.encode(t.as_py() or "")
                decoded = coder.decode(ids)
                if keep_text:
                    out["ids"].append(ids)
                    out["decoded"].append(decoded)
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, *[pa.array(out[c], pa.binary() if c == "ids" else pa.int64() if c == "n_tokens" else pa.string()) for c in made]],
                names=schema.names,
            )

    return source.mapInArrow(run, schema)
