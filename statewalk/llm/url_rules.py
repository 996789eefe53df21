"""Allow and block rules for URLs through a cascade of Bloom filters.

A rule is a host with all its subdomains and a path prefix. A URL's keys are its host's suffixes
with its path's prefixes, of the label counts and path lengths that rules have; the complete key
universe of the corpus is known, so a cascade of filters can be exact on it: level 1 encodes the
listed keys, level 2 the universe's keys that wrongly pass level 1, level 3 the listed keys that
wrongly pass level 2, and so on until none is left. Lookups need no join.

The first level's error rate is chosen from the sizes of list and universe so that every later level
holds no more keys than the list: all filters together stay within a small multiple of the list's
size, whatever the corpus is. Beyond ``MAX_BYTES`` a shuffle join decides instead.

Defined cases: a null URL, or one without ``://``, has an empty host and path and no rule. URLs without
a rule get ``default``. The longest rule wins, among equally long ones that with the longer host; of a
rule listed twice with different verdicts, block wins. Repeated rows are judged row by row. Empty
tables and empty rule lists are allowed. Columns of the input are kept, except those named like an output.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statewalk.llm.common import fresh, lower_ascii
from statewalk.session import materialize

MAX_BYTES = 64 << 20
MAX_LEVELS = 64
#: Error rate of the levels after the first.
RATE = 0.5


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass
class Filter:
    words: np.ndarray  # uint64
    bits: int
    probes: int
    level: int

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """(keys, probes) bit places; every level mixes the two hashes in its own way."""
        with np.errstate(over="ignore"):
            odd = np.uint64(2 * self.level + 1) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
            a = (h1.view(np.uint64) ^ (h2.view(np.uint64) >> np.uint64(self.level % 31 + 1))) * odd
            a ^= a >> np.uint64(32)
            b = (h2.view(np.uint64) * odd) | np.uint64(1)
            steps = np.arange(self.probes, dtype=np.uint64)
            return (a[:, None] + steps * b[:, None]) % np.uint64(self.bits)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self.places(h1, h2)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


class Cascade:
    def __init__(self, levels: list[Filter]) -> None:
        self.levels = levels

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact membership for keys of the universe."""
        inside = np.zeros(len(h1), bool)
        rest = np.arange(len(h1))
        for n, level in enumerate(self.levels):
            rest = rest[level.holds(h1[rest], h2[rest])]
            inside[rest] = n % 2 == 0
        return inside

    @property
    def n_bytes(self) -> int:
        return sum(x.words.nbytes for x in self.levels)


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit("second"))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))


def _filter_of(keys: DataFrame, n: int, rate: float, level: int) -> Filter:
    """Filter over the (h1, h2) rows of ``keys``; tasks emit set bits by word, Spark unites them."""
    bits = max(64, math.ceil(n * math.log(1 / rate) / math.log(2) ** 2))
    empty = Filter(np.zeros(-(-bits // 64), np.uint64), bits, max(1, round(math.log2(1 / rate))), level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(empty.places(*_arrays(batch)).ravel())
            word, first = np.unique((at >> np.uint64(6)).astype(np.int64), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], names=["word", "value"])

    united = keys.mapInArrow(run, "word bigint, value bigint").groupBy("word").agg(F.expr("bit_or(value)").alias("value"))
    for word, value in united.collect():  # at most one row per filter word; the filter's size is bounded
        empty.words[word] = np.int64(value).astype(np.uint64)
    return empty


def _passing(keys: DataFrame, level: Filter) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.holds(*_arrays(batch))))

    return keys.mapInArrow(run, keys.schema)


def build_cascade(listed: DataFrame, others: DataFrame) -> Cascade | None:
    """Cascade for ``listed`` against ``others``, both distinct (h1, h2) rows; None beyond MAX_BYTES."""
    inside, outside = listed, others
    n_in, n_out = inside.count(), outside.count()
    levels: list[Filter] = []
    if n_in == 0:
        return Cascade(levels)
    rate = min(RATE, n_in / max(1, n_out) / math.sqrt(2))
    if n_in * math.log(1 / rate) / math.log(2) ** 2 / 8 > MAX_BYTES:
        return None
    while n_in:
        if len(levels) == MAX_LEVELS:
            raise ValueError("two different keys share both hashes")
        levels.append(_filter_of(inside, n_in, rate if not levels else RATE, len(levels)))
        # What wrongly passes is the next level's content; the sides change places.
        wrong = materialize(_passing(outside, levels[-1]), "bloom-level")
        inside, outside, n_in = wrong, inside, wrong.count()
    return Cascade(levels)


def url_parts(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The keys under which a rule could fit, longest first, then longer host first."""
    labels = F.split(host, r"\.")
    made = []
    for count in sorted({r.host.count(".") + 1 for r in rules}):
        name = F.array_join(F.slice(labels, F.size(labels) - count + 1, count), ".")
        for length in sorted({len(r.path) for r in rules}):
            fits = (F.size(labels) >= count) & (F.length(path) >= length)
            row = F.struct(
                (-F.length(name) - length).alias("a"), (-F.length(name)).alias("b"),
                F.concat(name, F.substr(path, F.lit(1), F.lit(length))).alias("key"),
            )
            made.append(F.when(fits, row))
    rows = F.array_sort(F.filter(F.array(*made), lambda x: x.isNotNull()))
    return F.transform(rows, lambda x: x["key"])


def judge(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule (null without one) and verdict."""
    spark: SparkSession = df.sparkSession
    made = ("host", "path", "rule", "verdict")
    source = fresh(df, "_url")
    wide = df.withColumn(source, F.col(f"`{url}`")).select(
        *[F.col(f"`{c}`") for c in df.columns if c.lower() not in made], F.col(source)
    )
    kept = [c for c in wide.columns if c != source]
    host, path = url_parts(F.col(source))
    wide = wide.withColumn("host", host).withColumn("path", path).drop(source)
    if not rules:
        return wide.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    keys = fresh(wide, "_keys")
    wide = wide.withColumn(keys, candidate_keys(F.col("host"), F.col("path"), rules))
    listed = spark.createDataFrame([(r.key, r.verdict) for r in rules], "key string, verdict string")
    listed = listed.groupBy("key").agg(F.max("verdict").alias("verdict"))  # block wins
    h1, h2 = hashes(F.col("key"))
    pair = [h1.alias("h1"), h2.alias("h2")]
    universe = wide.select(F.explode(keys).alias("key")).distinct().join(listed, "key", "left_anti").select(*pair)
    cascade = build_cascade(listed.select(*pair), materialize(universe, "url-keys"))
    blocked = build_cascade(
        listed.where("verdict = 'block'").select(*pair), listed.where("verdict <> 'block'").select(*pair)
    )
    if cascade is None or blocked is None:
        return _by_join(wide, keys, kept, listed, default)
    shared = spark.sparkContext.broadcast((cascade, blocked))
    first, second = fresh(wide, "_h1"), fresh(wide, "_h2")
    wide = wide.withColumn(first, F.transform(keys, lambda k: hashes(k)[0])).withColumn(
        second, F.transform(keys, lambda k: hashes(k)[1])
    )
    n_kept = len(kept) + 2
    schema = wide.drop(keys, first, second).schema.add("rule", "string").add("verdict", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed, block = shared.value
        for batch in batches:
            lists = batch.column(n_kept)
            a, b = (batch.column(n_kept + k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
            names = lists.flatten()
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.flatnonzero(allowed.holds(a, b))
            # The first fitting key of a row is the longest.
            rows, first_at = np.unique(row[at], return_index=True)
            at = at[first_at]
            where = np.full(len(sizes), -1)
            where[rows] = at
            stops = np.zeros(len(names), bool)
            stops[at] = block.holds(a[at], b[at])
            rule = names.take(pa.array(where, mask=where < 0))
            verdict = [default if k < 0 else "block" if stops[k] else "allow" for k in where]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(n_kept)], rule, pa.array(verdict, pa.string())], names=schema.names
            )

    return wide.mapInArrow(run, schema)


def _by_join(wide: DataFrame, keys: str, kept: list[str], listed: DataFrame, default: str) -> DataFrame:
    """For rule lists too large to send to every task: keys join the list, the first hit stays."""
    row = fresh(wide, "_row")
    stored = materialize(wide.withColumn(row, F.monotonically_increasing_id()), "url-rows")
    hits = (
        stored.select(row, F.posexplode(keys).alias("_at", "key")).join(listed, "key")
        .groupBy(row).agg(F.min_by(F.struct("key", "verdict"), "_at").alias("_hit"))
    )
    out = stored.join(hits, row, "left")
    columns = [F.col(f"`{c}`") for c in [*kept, "host", "path"]]
    return out.select(*columns, F.col("_hit.key").alias("rule"), F.coalesce("_hit.verdict", F.lit(default)).alias("verdict"))
