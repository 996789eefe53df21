"""Toxicity of documents by their nearest labelled examples.

Examples are a bounded sample of labelled rows, half of each class as far as there are. Vectors are plain TF-IDF
over all words: square root of the count times ln((1 + documents) / (1 + documents with the word)) + 1, counted over
the whole corpus, divided by the Euclidean length. A word that no example holds counts as one of a single document: it
meets no example and only lengthens the text's vector. Neighbours are the examples of highest exact cosine.

Block-max inverted index: each word's posting list is cut into blocks of ``RANGE`` neighbouring examples (sorted so
that similar ones lie together), and each block keeps its largest weight. The words of few examples are added up
first; the block maxima of the frequent ones then bound every range, the ranges with the highest bounds are opened, and of the
others all whose bound stays below the cosine of the last neighbour so far are skipped with their blocks.

Neighbours vote with the square of their cosine over that of all neighbours; a toxic neighbour's vote is weighed by how
strongly the words that it shares with the text go with the label. Neither depends on a text's length. Votes are calibrated on the
examples themselves (each without itself), re-weighted to the class shares of all labelled documents, by steps that
never fall, with straight lines between them. Evidence names the neighbours and their cosines.

Words are 64-bit hashes; two words of a vocabulary of a hundred million share one with a probability of 0.03 %.

Bounds: ``Settings.examples`` rows and ``Settings.words`` distinct words in all, per class, bound the index that goes
to every task (20 bytes per word of an example); postings are built in the tasks, those of frequent words as blocks only. No shuffle carries texts except the
sampled ones. Labels are used to learn only.

Defined cases: null and empty texts, and texts without a word of the examples, have no neighbours and the rate that
such texts have among the examples. Long texts are read whole; an example with more words than its class may hold in all teaches nothing.
Null keys and null labels teach nothing, nor do labels of documents that aren't there; of several labels of a
key the larger counts, of several texts of a key the smallest is the example. Examples with equal cosines (to nine digits) are
taken in the order of the index, which depends on the examples only. Other columns stay as they are; one named like the result is replaced.
Without any labelled rows every score is 0. Repeated rows are scored row by row; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statewalk.llm.common import fresh
from statewalk.session import materialize

WORDS = re.compile(r"[^\W\d_]+")
#: Examples of a range, the unit of blocks.
RANGE = 64
#: The most frequent words, whose posting lists are kept as blocks with maxima; the postings of others are simply added.
FREQUENT = 384
#: Rough cosines are sums of positive products in single precision, each and each sum off by a share of 6e-8 at most: with up to 800
#: products, two that differ by a larger share than this are in their true order.
SLACK = 1e-4
#: Longer words (bytes) are hashed one by one.
LONG = 64
#: ASCII letters in lower case, all else as white space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))
#: The same for Latin-1, whose letters in lower case are of Latin-1, too.
LATIN = bytes(ord(chr(c).lower()) if WORDS.fullmatch(chr(c)) else 32 for c in range(256))
#: Texts searched at once, and rows whose neighbours are held until they are given back.
BATCH = 128
PIECE = 1024
#: Random projections by which examples are ordered, at most 64.
PROJECTIONS = 24
#: Ranges opened before the rest is compared with its bounds.
FIRST = 8


@dataclass(frozen=True)
class Settings:
    """examples: most labelled rows of each class in the sample
    words: most distinct words of a class's examples, summed over them
    neighbours: examples that vote
    association: likelihood ratio (G) against the label at which a word has half of its full weight in a vote
    bins: steps of the calibration, of about equal numbers of examples
    """

    examples: int = 8192
    words: int = 4_000_000
    neighbours: int = 32
    association: float = 20.0
    bins: int = 64


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _split(text: str) -> bytes:
    """The lower-cased words of a text with white space between them."""
    if text.isascii():
        return text.encode().translate(LETTERS)
    try:
        return text.encode("latin-1").translate(LATIN).decode("latin-1").encode()
    except UnicodeEncodeError:
        return " ".join(WORDS.findall(text.lower())).encode("utf-8", "surrogatepass")


def bags(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, counts) of the distinct lower-cased words of each text, hashes ascending. Words are hashed eight bytes at a
    time, those of all texts together."""
    parts = [_split(t or "") for t in texts]
    data = b" ".join([b"", *parts, b" " * 8])
    seen = np.frombuffer(data, np.uint8) != 32
    edges = np.flatnonzero(seen[1:] != seen[:-1]) + 1
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    chunks = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    hashes, at, left = lengths.astype(np.uint64), np.flatnonzero(lengths <= LONG), lengths
    while len(at):
        n = np.minimum(left[at], 8).astype(np.uint64)
        piece = chunks[starts[at] + lengths[at] - left[at]] << (np.uint64(64) - n * np.uint64(8))
        with np.errstate(over="ignore"):
            hashes[at] = _mix(hashes[at] * np.uint64(0x9E3779B97F4A7C15) + piece)
        left = left - 8
        at = at[left[at] > 0]
    for i in np.flatnonzero(lengths > LONG).tolist():
        hashes[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + lengths[i]])
    ends = np.searchsorted(starts, np.cumsum([len(p) + 1 for p in parts]) + 1)
    out, first = [], 0
    for end in ends.tolist():
        some = np.sort(hashes[first:end])
        first = end
        new = np.flatnonzero(np.append(True, some[1:] != some[:-1])) if len(some) else np.zeros(0, np.int64)
        out.append((some[new], np.diff(np.append(new, len(some)))))
    return out


def words_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    return bags([text])[0]


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all half-open spans one after the other, and the spans' lengths."""
    length = ends - starts
    return np.repeat(starts - np.cumsum(length) + length, length) + np.arange(length.sum()), length


@dataclass
class Index:
    """Examples by word (``vocabulary``, ascending) with the words of each one after the other. ``postings`` is made where the index is used."""

    vocabulary: np.ndarray
    idf: np.ndarray
    unknown: float
    association: np.ndarray
    keys: list
    labels: np.ndarray
    starts: np.ndarray
    held: np.ndarray
    counts: np.ndarray
    settings: Settings
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))
    without: float = 0.0  # score of texts without neighbours
    _postings: Postings | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_postings": None}

    @property
    def postings(self) -> Postings:
        if self._postings is None:
            self._postings = Postings(self)
        return self._postings

    def vectors(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(words, weights) of each text: the words that examples hold, by number; weights over the length of all its words."""
        found = bags(texts)
        if not len(self.vocabulary):
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(found)
        # Words of all texts are looked up once, in order.
        distinct, place = np.unique(np.concatenate([h for h, _ in found]), return_inverse=True)
        at = np.minimum(np.searchsorted(self.vocabulary, distinct), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == distinct
        idf = np.where(known, self.idf[at], self.unknown)
        out, start = [], 0
        for hashes, counts in found:
            part = place[start : start + len(hashes)]
            start += len(hashes)
            weights = np.sqrt(counts) * idf[part]
            if len(part):
                weights /= np.sqrt(weights @ weights)
            held = known[part]
            out.append((at[part[held]], weights[held]))
        return out

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return self.vectors([text])[0]

    def example(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[i], self.starts[i + 1])
        return self.held[part], np.sqrt(self.counts[part]) * self.idf[self.held[part]] / self.postings.norms[i]

    def vote(self, vector: tuple[np.ndarray, np.ndarray], near: list[tuple[float, int]]) -> float:
        """Share of the toxic neighbours in the sum of squared cosines, each by the association of its shared words."""
        if not near:
            return -1.0
        toxic = [(s * s, i) for s, i in near if self.labels[i]]
        if not toxic:
            return 0.0
        shared = self.postings.shared
        shared[vector[0]] = self.association[vector[0]]
        words = [self.held[self.starts[i] : self.starts[i + 1]] for _, i in toxic]
        strong = np.maximum.reduceat(shared.take(np.concatenate(words)), np.cumsum([0, *map(len, words[:-1])]))
        shared[vector[0]] = 0
        return sum(x * y for (x, _), y in zip(toxic, strong.tolist(), strict=True)) / sum(s * s for s, _ in near)

    def score(self, vote: float) -> float:
        return self.without if vote < 0 else float(np.interp(vote, *self.steps))


def _projected(index: Index, some: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Random projections of examples with these starts and weights."""
    bits = index.vocabulary[index.held[some[0] : some[-1]], None] >> np.arange(PROJECTIONS, dtype=np.uint64)
    return np.add.reduceat((1.0 - 2.0 * (bits & np.uint64(1))) * weight[:, None], some[:-1] - some[0])


def _alike(seen: np.ndarray) -> np.ndarray:
    """Order of examples in which similar ones lie together: random projections of their vectors, halved again and
    again along the direction in which they differ most."""
    n = len(seen)
    parts, out = [np.arange(n)], []
    while parts:
        part = parts.pop()
        if len(part) <= RANGE:
            out.append(part)
            continue
        x = seen[part] - seen[part].mean(axis=0)
        along = x @ np.linalg.eigh(x.T @ x)[1][:, -1]
        turned = part[np.argsort(along, kind="stable")]
        half = max(1, round(len(part) / RANGE / 2)) * RANGE
        parts += [turned[half:], turned[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Postings:
    """Block-max inverted index of an ``Index``.

    order: examples by place; starts, at, weights: places and weights by word, without the frequent ones
    row: a frequent word's column of blocks, or -1; blocks: weights of the frequent words by place, in single precision; maxima: the
    largest of each word and range; exact: the same weights for the examples that the blocks leave
    """

    def __init__(self, index: Index) -> None:
        n, size = len(index.keys), len(index.vocabulary)
        self.n, self.ranges = n, -(-n // RANGE)
        self.neighbours = index.settings.neighbours
        self.shared = np.zeros(size)
        held_by = np.bincount(index.held, minlength=size)
        often = np.argsort(-held_by, kind="stable")[:FREQUENT]
        often = often[held_by[often] >= RANGE]
        self.row = np.full(size, -1, np.int64)
        self.row[often] = np.arange(len(often))
        # Some examples at a time, so that nothing but the result is as long as all postings.
        self.norms, seen = np.empty(n), np.empty((n, PROJECTIONS))
        for first, some, weight in self._parts(index):
            self.norms[first : first + RANGE] = np.sqrt(np.add.reduceat(weight * weight, some[:-1] - some[0]))
            seen[first : first + RANGE] = _projected(index, some, weight) / self.norms[first : first + RANGE, None]
        self.order = _alike(seen)
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.exact = np.zeros((self.ranges * RANGE, len(often)))
        held_by[often] = 0
        self.starts = np.append(0, np.cumsum(held_by))
        self.at, self.weights = np.empty(self.starts[-1], np.int64), np.empty(self.starts[-1])
        free = self.starts[:-1].copy()
        for first, some, weight in self._parts(index):
            lengths = np.diff(some)
            weight /= np.repeat(self.norms[first : first + RANGE], lengths)
            place = np.repeat(self.place[first : first + RANGE], lengths)
            words = index.held[some[0] : some[-1]]
            row = self.row[words]
            known = row >= 0
            self.exact[place[known], row[known]] = weight[known]
            words, place, weight = (x[~known] for x in (words, place, weight))
            order = np.argsort(words, kind="stable")
            distinct, start, times = np.unique(words[order], return_index=True, return_counts=True)
            to = np.repeat(free[distinct] - start, times) + np.arange(len(order))
            free[distinct] += times
            self.at[to], self.weights[to] = place[order], weight[order]
        self.blocks = self.exact.astype(np.float32)
        self.maxima = np.ascontiguousarray(self.blocks.reshape(self.ranges, RANGE, len(often)).max(axis=1, initial=0).T)

    def _parts(self, index: Index) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Some examples at a time: the first one, their starts and the end, and the weights of their words before division by lengths."""
        for first in range(0, self.n, RANGE):
            some = index.starts[first : first + RANGE + 1]
            part = slice(some[0], some[-1])
            yield first, some, np.sqrt(index.counts[part]) * index.idf[index.held[part]]

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """(cosine, example) of each vector's nearest examples with a cosine above 0, best first; ``without``: an example
        that each vector does not meet."""
        if not self.n:
            return [[] for _ in vectors]
        barred = [-1] * len(vectors) if without is None else [int(self.place[i]) for i in without]
        queries = np.zeros((len(vectors), self.maxima.shape[0]))
        scores = np.empty((len(vectors), self.ranges * RANGE))
        for i, (words, x) in enumerate(vectors):
            row = self.row[words]
            often = row >= 0
            queries[i, row[often]] = x[often]
            few = words[~often]
            at, length = _spans(self.starts[few], self.starts[few + 1])
            weights = np.repeat(x[~often], length)
            weights *= self.weights.take(at)
            scores[i] = np.bincount(self.at.take(at), weights=weights, minlength=scores.shape[1])
        rough, asked = scores.astype(np.float32), queries.astype(np.float32)
        parts = rough.reshape(len(vectors), self.ranges, RANGE)
        bounds = asked @ self.maxima + parts.max(axis=2)
        best = np.argpartition(-bounds, min(FIRST, self.ranges) - 1, axis=1)[:, :FIRST]
        opened = np.zeros(self.ranges, bool)
        opened[best] = True
        self._open(opened, asked, rough, barred)
        wanted = np.broadcast_to(opened, bounds.shape)
        if not opened.all():
            k, seen = self.neighbours, parts[:, opened].reshape(len(vectors), -1)
            least = np.partition(seen, -k, axis=1)[:, -k] if seen.shape[1] > k else np.zeros(len(vectors))
            wanted = wanted | (bounds >= least[:, None] * (1 - SLACK))
            more = wanted.any(axis=0) & ~opened
            self._open(more, asked, rough, barred)
            # A skipped range holds no neighbour.
            parts[:, ~(opened | more)] = 0
        self.share_opened = wanted.mean()
        most = parts.max(axis=2)
        return [self._best(queries[i], scores[i], rough[i], most[i]) for i in range(len(vectors))]

    def _open(self, wanted: np.ndarray, queries: np.ndarray, scores: np.ndarray, barred: list[int]) -> None:
        """Adds the frequent words to the scores of these ranges; the blocks of all others are skipped."""
        edges = np.flatnonzero(np.diff(wanted, prepend=False, append=False)) * RANGE
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            scores[:, start:end] += queries @ self.blocks[start:end].T
        for i, b in enumerate(barred):
            if b >= 0:
                scores[i, b] = 0

    def _best(self, query: np.ndarray, few: np.ndarray, rough: np.ndarray, most: np.ndarray) -> list[tuple[float, int]]:
        """The nearest of the opened examples; ``most``: the largest rough score of each range, of which the k-th bounds the last
        neighbour. What can be among the nearest gets its exact cosine: that of the other words (``few``) and the frequent ones."""
        k = self.neighbours
        least = np.partition(most, -k)[-k] * (1 - SLACK) if len(most) > k else 0.0
        hit = np.flatnonzero(rough >= least) if least > 0 else np.flatnonzero(rough > 0)
        if len(hit) > k:
            seen = rough[hit]
            hit = hit[seen >= np.partition(seen, -k)[-k] * (1 - SLACK)]
        seen = few[hit] + self.exact[hit] @ query
        # Cosines equal to nine digits are ties.
        best = np.lexsort((hit, -np.round(seen, 9)))[:k]
        return [(c, i) for c, i in zip(seen[best].tolist(), self.order[hit[best]].tolist(), strict=True)]


def association(a: np.ndarray, b: np.ndarray, toxic: int, clean: int, half: float) -> np.ndarray:
    """How strongly words of ``a`` toxic and ``b`` clean examples go with the label, from 0 to 1: by their likelihood ratio (G)
    and the excess of their share."""
    n = max(1, toxic + clean)

    def part(x: np.ndarray, share: float) -> np.ndarray:
        return x * np.log(np.maximum(x, 1) / (np.maximum(a + b, 1) * share))

    ratio = np.maximum(2 * (part(a, max(toxic, 0.5) / n) + part(b, max(clean, 0.5) / n)), 0)
    excess = np.maximum(1 - b * max(toxic, 1) / np.maximum(a * max(clean, 1), 1), 0)
    return excess * ratio / (ratio + half)


def build_index(
    examples: list[tuple], frequency: dict[int, int], documents: int, settings: Settings = Settings()
) -> Index:
    """Index of examples (key, label, hashes, counts), one with words or more each, by the corpus' ``documents`` and those with each word."""
    lengths = [len(h) for _, _, h, _ in examples]
    flat = [np.concatenate([np.asarray(e[i]) for e in examples]) if examples else np.zeros(0) for i in (2, 3)]
    vocabulary = np.unique(flat[0].astype(np.uint64))
    known = np.array([frequency.get(int(w), 0) for w in vocabulary])
    return _indexed(vocabulary, known, documents, [e[0] for e in examples], [e[1] for e in examples], lengths, flat[0], flat[1], settings)


def _indexed(vocabulary, frequency, documents: int, keys, labels, lengths, hashes, counts, settings: Settings) -> Index:
    labels, lengths = np.asarray(labels, bool), np.asarray(lengths, np.int64)
    kept = np.flatnonzero(lengths)
    held = np.searchsorted(vocabulary, np.asarray(hashes).astype(np.uint64)).astype(np.int32)
    toxic = np.repeat(labels, lengths)
    a, b = (np.bincount(held[x], minlength=len(vocabulary)).astype(np.float64) for x in (toxic, ~toxic))
    strong = association(a, b, int(labels.sum()), int((~labels).sum()), settings.association)
    idf = np.log((1 + documents) / (1 + np.asarray(frequency, np.float64))) + 1
    return Index(
        vocabulary, idf, float(np.log((1 + documents) / 2) + 1), strong, [keys[i] for i in kept], labels[kept],
        np.append(0, np.cumsum(lengths[kept])), held, np.asarray(counts, np.int32), settings,
    )


def _known(labelled: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, label) of the labelled keys that ``docs`` holds, one row a key."""
    one = labelled.where("key IS NOT NULL AND label IS NOT NULL").groupBy("key").agg((F.max("label") > 0).cast("int").alias("label"))
    return materialize(one.join(docs.select("key"), "key", "left_semi"), "labels")


def _sample(one: DataFrame, settings: Settings) -> DataFrame:
    """(key, label) of at most ``examples`` rows a class, by a hash of the key."""
    parts = [one.where(F.col("label") == c).orderBy(F.xxhash64("key"), "key").limit(settings.examples) for c in (0, 1)]
    return materialize(parts[0].union(parts[1]), "label-sample")


def _word_counts(sampled: DataFrame) -> DataFrame:
    """(key, label, words, counts) of the sampled texts, one text a key."""
    schema = sampled.select("key", "label").schema.add("words", T.ArrayType(T.LongType())).add("counts", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words_of(t.as_py()) for t in batch.column(2)]
            words = pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words, pa.array([c for _, c in found], pa.list_(pa.int32()))], names=schema.names)

    return sampled.select("key", "label", "text").mapInArrow(run, schema)


def _bounded(counted: DataFrame, settings: Settings) -> DataFrame:
    """The examples of each class, by a hash of the key, that hold at most ``words`` words in all. There are at most
    ``examples`` rows a class."""
    light = counted.select("key", "label", F.size("words").alias("n")).where(F.col("n") <= settings.words)
    before = Window.partitionBy("label").orderBy(F.xxhash64("key"), "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = light.withColumn("sum", F.sum("n").over(before)).where(F.col("sum") <= settings.words)
    return counted.join(F.broadcast(kept.select("key")), "key", "left_semi")


def _frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Documents that hold each word, and documents, over the whole corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        counts = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            counts[-1] += batch.num_rows
            parts = (batch.column(0).slice(i, BATCH).to_pylist() for i in range(0, batch.num_rows, BATCH))
            found = [h for some in parts for h, _ in bags(some)]
            words = np.concatenate(found) if found else np.zeros(0, np.uint64)
            if len(words) and len(known):
                words, times = np.unique(words, return_counts=True)
                at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                held = known[at] == words
                counts[at[held]] += times[held]
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    out[rows["word"].to_numpy()] = rows["n"].to_numpy()
    return out[:-1], int(out[-1])


def learn(docs: DataFrame, labelled: DataFrame, settings: Settings = Settings()) -> Index:
    """Index and calibration from ``docs`` (key, text) and ``labelled`` (key, label)."""
    labelled = _known(labelled, docs)
    sample = _sample(labelled, settings)
    # The sample has at most 2 * examples rows, which bounds what is broadcast.
    texts = docs.where("key IS NOT NULL").join(F.broadcast(sample), "key").groupBy("key").agg(
        F.first("label").alias("label"), F.min("text").alias("text")
    )
    counted = materialize(_bounded(materialize(_word_counts(texts), "counted"), settings), "examples")
    # Bounded by the settings: 12 bytes per word of an example.
    rows = counted.orderBy(F.xxhash64("key"), "key").toArrow().combine_chunks()
    flat = [rows[x].combine_chunks().flatten().to_numpy() if rows.num_rows else np.zeros(0, np.int64) for x in ("words", "counts")]
    hashes = flat[0].view(np.uint64)
    vocabulary = np.unique(hashes)
    held, documents = _frequencies(docs, vocabulary)
    lengths = pa.compute.list_value_length(rows["words"]).to_numpy()
    keys, labels = rows["key"].to_pylist(), rows["label"].to_numpy()
    index = _indexed(vocabulary, held, documents, keys, labels, lengths, hashes, flat[1], settings)
    del rows, flat, hashes
    _calibrate(index, np.bincount(labels.astype(int), minlength=2).tolist(), labelled, settings)
    return index


def _votes(index: Index, labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(votes, labels) of the examples, each searched without itself, in tasks."""
    spark = labelled.sparkSession
    shared = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids, votes = batch.column(0).to_pylist(), []
            for start in range(0, len(ids), BATCH):
                some = ids[start : start + BATCH]
                vectors = [index.example(i) for i in some]
                votes += [index.vote(v, near) for v, near in zip(vectors, index.postings.nearest(vectors, some), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.float64())], names=["id", "vote"])

    n = len(index.keys)
    out = spark.range(0, n, 1, max(1, min(32, n // 256))).mapInArrow(run, "id long, vote double").toArrow()
    shared.destroy()
    return out["vote"].to_numpy(), index.labels[out["id"].to_numpy()]


def _calibrate(index: Index, sampled: list[int], labelled: DataFrame, settings: Settings) -> None:
    """Scores by vote: shares of toxic rows in steps of the sorted votes, re-weighted to all labelled rows. ``sampled``
    counts the examples of each class, those without words included."""
    if not sum(sampled):
        return
    shares = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weight = [shares.get(c, 0) / max(1, sampled[c]) for c in (0, 1)]
    prior = shares.get(1, 0) / max(1, sum(shares.values()))
    votes, labels = _votes(index, labelled) if index.keys else (np.zeros(0), np.zeros(0, bool))
    mass = np.where(labels, weight[1], weight[0])
    none = votes < 0
    lost = [weight[c] * (sampled[c] - int((index.labels == bool(c)).sum())) for c in (0, 1)]
    lost = [lost[c] + mass[none & (labels == bool(c))].sum() for c in (0, 1)]
    index.without = float((lost[1] + prior) / (sum(lost) + 1))
    votes, labels, mass = votes[~none], labels[~none], mass[~none]
    if not len(votes):
        index.steps = (np.zeros(1), np.full(1, prior))
        return
    # Steps of about equal numbers of examples; equal votes share one.
    distinct, inverse, counts = np.unique(votes, return_inverse=True, return_counts=True)
    step = ((np.cumsum(counts) - counts) * settings.bins // len(votes))[inverse]
    step = np.unique(step, return_inverse=True)[1]
    total, toxic = np.bincount(step, weights=mass), np.bincount(step, weights=mass * labels)
    rates = np.maximum.accumulate((toxic + prior) / (total + 1))
    index.steps = (np.bincount(step, weights=votes * mass) / total, rates)


def score(df: DataFrame, index: Index, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``df`` with a struct column ``into``: score, neighbours (keys as text) and cosines."""
    df = df.drop(into)
    shared = df.sparkSession.sparkContext.broadcast(index)
    source = fresh(df, "_text")
    result = T.StructType([
        T.StructField("score", T.DoubleType()), T.StructField("neighbours", T.ArrayType(T.StringType())),
        T.StructField("cosines", T.ArrayType(T.DoubleType())),
    ])
    schema = T.StructType([*df.schema.fields, T.StructField(into, result)])
    arrow = pa.struct([("score", pa.float64()), ("neighbours", pa.list_(pa.string())), ("cosines", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in (b.slice(i, PIECE) for b in batches for i in range(0, b.num_rows, PIECE)):
            texts, scores, found = batch.column(batch.num_columns - 1), [], []
            for start in range(0, batch.num_rows, BATCH):
                vectors = index.vectors(texts.slice(start, BATCH).to_pylist())
                nearest = index.postings.nearest(vectors)
                scores += [index.score(index.vote(v, near)) for v, near in zip(vectors, nearest, strict=True)]
                found += nearest
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            names = pa.array([str(index.keys[i]) for near in found for _, i in near], pa.string())
            cosines = pa.array([c for near in found for c, _ in near], pa.float64())
            made = [pa.array(scores, pa.float64()), *(pa.ListArray.from_arrays(ends, x) for x in (names, cosines))]
            out = pa.StructArray.from_arrays(made, fields=list(arrow))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=schema.names)

    return df.withColumn(source, F.col(f"`{text}`")).mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """Whether a key's labels are kept from learning."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), into: str = "toxicity") -> DataFrame:
    """``docs`` (doc_id, text, ...) with the struct column ``into``, learnt from ``labels`` (doc_id, toxic) that
    are not held out."""
    labelled = labels.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("key"), F.col("toxic").alias("label"))
    corpus = docs.select(F.col("doc_id").alias("key"), "text")
    return score(docs, learn(corpus, labelled, settings), into=into)
