"""Periodic runs of words: every maximal repetition of a text, by string synchronising sets.

A run is a stretch of words with smallest period q whose length is at least four periods and
``LEAST`` words, and which no neighbouring word extends. Texts of a batch are laid end to end with a
unique separator after each, and words become numbers. Then:

* Scales. At scale t = 16, 32, 64, ... every place gets the hash of the t words from there on, from
  two hashes of half the length. Places whose hash is the least of some t/2 neighbours are the
  synchronising set: whether a place belongs depends on the words around it alone, so a text that
  repeats with period q has its places repeated with period q, too.
* Pairs. Two neighbouring places of the set with equal contexts, between t/2 and t words apart, propose
  that distance as a period. A run of period q in (t/2, t] has 4q words or more; a window of t/2
  places and its copy q words on both lie inside it, and equal contexts of t >= q words cannot lie
  closer than q, so every such run is proposed.
* Highly periodic regions. Places inside a run of period t/4 or less, found before, leave the set of
  scale t (as they would crowd it); no window of t/2 places in a run of period above t/2 consists
  of such places alone. Periods up to ``SMALL`` are found apart, by comparing all words with those q
  places on.
* Every proposal is verified by words and extended to its full stretch; contexts with equal hashes
  but other words make the batch start again with another hash. Equal stretches keep their smallest
  period.

Work is proportional to words times scales; a text takes part only in scales below half its length.

Defined cases: a null text has no words; a text without words has no run, and its collapsed form is
empty. Words are what stands between white space of ASCII. Repeated rows are analysed row by row, ties of
the longest run go to the smallest start, then period. Texts of any length are read whole; a batch
holds ``BATCH_BYTES`` of text or one longer text. An empty table gives an empty result; other columns
stay, and columns named like the results give way.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 6
EXPONENT = 4
SMALL = 8
BATCH_BYTES = 1 << 22
#: Columns of the result: 64-bit numbers, then texts.
NUMBERS = ("n_runs", "start", "length", "period", "exponent_milli")
TEXTS = ("runs_sha256", "collapsed_sha256", "runs", "collapsed")


class _Collision(Exception):
    """Two different contexts have one hash."""


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of pairs."""
    with np.errstate(over="ignore"):
        z = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _sliding(x: np.ndarray, width: int, best: Callable) -> np.ndarray:
    """``best`` of every ``width`` neighbours (a power of two), by their first place."""
    step = 1
    while step < width:
        x = best(x[:-step], x[step:])
        step *= 2
    return x


def _stretch(words: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The longest stretch around ``at`` in which words ``period`` places apart are equal."""
    low, size = at, 64
    while low > 0:
        first = max(0, low - size)
        differ = np.flatnonzero(words[first:low] != words[first + period : low + period])
        if len(differ):
            low = first + int(differ[-1]) + 1
            break
        low, size = first, size * 4
    high, size = at, 64
    last = len(words) - period
    while high < last:
        until = min(last, high + size)
        differ = np.flatnonzero(words[high:until] != words[high + period : until + period])
        if len(differ):
            high += int(differ[0])
            break
        high, size = until, size * 4
    return low, high + period


def _small_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    out = []
    for q in range(1, SMALL + 1):
        if len(words) <= q:
            break
        same = np.zeros(len(words) - q + 2, dtype=np.int8)
        same[1:-1] = words[:-q] == words[q:]
        turns = np.diff(same)
        start, end = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1) + q
        long = end - start >= max(LEAST, EXPONENT * q)
        out += [(int(s), int(e), q) for s, e in zip(start[long], end[long], strict=True)]
    return out


def _proposals(words: np.ndarray, code: np.ndarray, scale: int, found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(place, period) of neighbouring equal contexts of the synchronising set."""
    width = scale // 2
    busy = np.zeros(len(code) + 1, dtype=np.int32)
    for s, e, q in found:
        if 4 * q <= scale <= e - s and s < len(code):
            busy[s] += 1
            busy[min(e - scale + 1, len(code))] -= 1
    free = np.cumsum(busy[:-1]) == 0
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    ranked = np.where(free, code, top)
    least = _sliding(ranked, width, np.minimum)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero(free & (ranked == _sliding(padded, width, np.maximum)))
    order = chosen[np.argsort(code[chosen], kind="stable")]
    first, second = order[:-1], order[1:]
    gap = second - first
    good = (code[first] == code[second]) & (gap <= scale) & (gap > width)
    return list(zip(first[good].tolist(), gap[good].tolist(), strict=True))


def _runs_once(words: np.ndarray, bounds: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Runs (start, end, period) of texts laid end to end, shortest text last; ``bounds`` has the end of
    each text, and its separator stands before that."""
    found = _small_runs(words)
    code = _mixed(words.astype(np.uint64), np.full(len(words), seed, dtype=np.uint64))
    lengths = np.diff(bounds, prepend=0)
    scale = 1
    while True:
        # Periods above half the next scale need texts of twice that scale.
        n_texts = int(np.count_nonzero(lengths > 4 * scale))
        if not n_texts:
            return found
        until = int(bounds[n_texts - 1])
        words, code = words[:until], code[:until]
        if len(code) <= scale:
            return found
        code = _mixed(code[:-scale], code[scale:])
        scale *= 2
        if scale <= SMALL or len(code) < scale // 2:
            continue
        seen: dict[int, tuple[int, int]] = {}
        for at, period in sorted(_proposals(words, code, scale, found), key=lambda x: (x[1], x[0])):
            known = seen.get(period)
            if known and known[0] <= at and at + period + scale <= known[1]:
                continue
            s, e = _stretch(words, at, period)
            if e < at + period + scale:
                raise _Collision
            seen[period] = (s, e)
            if e - s >= max(LEAST, EXPONENT * period):
                found.append((s, e, period))


def all_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of every text, a text being an array of word numbers below 2^62;
    sorted by start, then period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    parts, bounds = [], []
    for rank, i in enumerate(order):
        parts += [texts[i], np.array([(1 << 62) + rank], dtype=np.int64)]
        bounds.append((bounds[-1] if bounds else 0) + len(texts[i]) + 1)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not texts:
        return out
    words, ends = np.concatenate(parts), np.array(bounds)
    for seed in itertools.count(1):
        try:
            found = _runs_once(words, ends, seed)
            break
        except _Collision:
            continue
    least: dict[tuple[int, int], int] = {}
    for s, e, q in found:
        least[s, e] = min(q, least.get((s, e), q))
    for (s, e), q in sorted(least.items()):
        at = int(np.searchsorted(ends, s, side="right"))
        first = int(ends[at - 1]) if at else 0
        out[order[at]].append((s - first, e - s, q))
    for rows in out:
        rows.sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Places of the words that stay when every run is cut to its first period."""
    stay = np.ones(n, dtype=bool)
    for start, length, period in runs:
        stay[start + period : start + length] = False
    return np.flatnonzero(stay)


def _row(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    collapsed = b" ".join([words[i] for i in kept_words(len(words), runs)] if runs else words)
    if not runs:
        return 0, None, None, None, None, listed, collapsed
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
    return len(runs), s, n, q, 1000 * n // q, listed, collapsed


def analysed(texts: list[bytes], loops: list[tuple[int, int] | None] | None = None) -> list[tuple]:
    """Result rows of some texts. ``loops`` may give each a word number from which on its words are
    replaced by repetitions of some of them (number, count)."""
    vocabulary: dict[bytes, int] = defaultdict(itertools.count().__next__)
    words = [t.split() for t in texts]
    for i, loop in enumerate(loops or ()):
        if loop:
            words[i] = repeat_words(words[i], *loop)
    numbers = [np.fromiter(map(vocabulary.__getitem__, w), np.int64, len(w)) for w in words]
    return [_row(w, r) for w, r in zip(words, all_runs(numbers), strict=True)]


def repeat_words(words: list[bytes], start: int, period: int) -> list[bytes]:
    """``words`` with those from ``start`` on replaced by the first ``period`` of them, over and over."""
    count = len(words) - start
    unit = words[start : start + period]
    return words[:start] + (unit * (count // period + 1))[:count]


def seeded_loop(seed: int | None, n: int) -> tuple[int, int] | None:
    """Start and period of the loop a seed plants into a text of ``n`` words."""
    if seed is None or not n:
        return None
    start = seed % n
    return start, 1 + (n - start) // (3 + seed % 8)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded text."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        base = int(sizes[first - 1]) if first else 0
        n = max(1, int(np.searchsorted(sizes, base + BATCH_BYTES, side="right")) - first)
        yield batch.slice(first, n)
        first += n


def find_runs(
    df: DataFrame, text: str = "text", into: str = "runs", seeds: Column | None = None, keep_texts: bool = True
) -> DataFrame:
    """``df`` with a struct column ``into``: n_runs, the longest run's start, length, period and
    exponent_milli (thousandths), the digests runs_sha256 and collapsed_sha256, all runs (lines of
    start,length,period) and the collapsed text. Without ``keep_texts`` the text itself and the collapsed one
    stay away. Where ``seeds`` is not null, the words are first rewritten by ``seeded_loop``."""
    df = df.drop(into)
    plain = [c for c in df.columns if c.lower() != text.lower()]
    clear = {c: f"_c{i}" for i, c in enumerate(plain)}
    source = df.select(
        *[F.col(f"`{c}`").alias(a) for c, a in clear.items()],
        F.col(f"`{text}`").cast("binary").alias("_text"),
        (F.lit(None) if seeds is None else seeds).cast("long").alias("_seed"),
    )
    sent = [*clear.values(), *(["_text"] if keep_texts else [])]
    out = pa.struct([*[(n, pa.int64()) for n in NUMBERS], *[(n, pa.string()) for n in TEXTS]])
    ddl = "struct<" + ", ".join([*[f"{n}: long" for n in NUMBERS], *[f"{n}: string" for n in TEXTS]]) + ">"
    schema = source.select(*sent, F.lit(None).cast(ddl).alias("_out")).schema

    def analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in itertools.chain.from_iterable(_slices(b, "_text") for b in batches):
            texts = [t or b"" for t in batch.column("_text").to_pylist()]
            seeded = batch.column("_seed").to_pylist()
            loops = [seeded_loop(s, len(t.split())) if s is not None else None for s, t in zip(seeded, texts, strict=True)]
            rows = []
            for *numbers, listed, collapsed in analysed(texts, loops):
                digests = hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()
                rows.append((*numbers, *digests, listed, collapsed.decode() if keep_texts else None))
            fields = [pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), out, strict=True)]
            found = pa.StructArray.from_arrays(fields, fields=list(out))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in sent], found], names=[*sent, "_out"])

    done = source.mapInArrow(analyse, schema)
    back = {text.lower(): F.col("_text").cast("string")} if keep_texts else {}
    columns = [
        (F.col(clear[c]) if c in clear else back[c.lower()]).alias(c) for c in df.columns if c in clear or keep_texts
    ]
    return done.select(*columns, F.col("_out").alias(into))
