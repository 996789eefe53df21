"""Token ids in binary shards with a minimal perfect hash index.

Documents are put in key order by a range partitioning of the texts, tokenised where they lie, and
written as segments. A segment is one row of a Parquet table (the one container that Spark writes to any
store): its place, first and last key, the keys in order, an index and a payload of raw little-endian ids
(two bytes where the vocabulary allows it, else four).

The index maps a key to its place in the payload in constant time. A minimal perfect hash (buckets with
displacements, buckets of one placed directly) gives each key its own slot among exactly as many slots as keys; a
slot holds a fingerprint of the key, the payload offset and the number of ids. A fingerprint that differs
means that the key is absent.

    index   = "MPHI", version u2, id width u2, n u4, buckets u4, displacements i4[buckets],
              fingerprints u4[n], offsets u8[n], lengths u4[n]

Segments hold at most ``SEGMENT_IDS`` ids (a longer document is a segment of its own), so a task's
memory is bounded whatever the partition. One shuffle, of the texts.

Defined cases: a null text counts as empty and has the end id only. Keys that occur more than once
are told apart by their number within the segment; equal keys are in the order of a hash of their
texts. Null keys come first; ``lookup`` does not find them. Empty tables give an empty store.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statewalk.llm.encoders import encoder

SEGMENT_IDS = 1 << 22
SEGMENT_DOCS = 1 << 14
HEAD = struct.Struct("<4sHHII")


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """How many equal hashes stand before each."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(hashes) else np.zeros(0, int)
    out = np.empty(len(hashes), np.int64)
    out[order] = np.arange(len(hashes)) - np.repeat(first, np.diff(np.r_[first, len(hashes)]))
    return out


def _identity(hashes: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(hashes.view(np.uint64) + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _slots(x: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(x ^ (displacement.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) % np.uint64(n)).astype(np.int64)


def build_index(hashes: np.ndarray, fingerprints: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, width: int) -> bytes:
    """Index bytes for int64 hashes (repeats allowed) and uint32 fingerprints."""
    n = len(hashes)
    x = _identity(hashes, occurrences(hashes))
    if len(np.unique(x)) != n:
        raise ValueError("two keys of a segment share a 64-bit hash")
    m = max(1, -(-n // 4))
    bucket = (x >> np.uint64(32)) % np.uint64(m)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(m + 1).astype(np.uint64))
    sizes = np.diff(starts)
    displacement = np.zeros(m, np.int32)
    taken = np.zeros(n, bool)
    slot_of = np.zeros(n, np.int64)
    for b in np.argsort(-sizes, kind="stable"):
        size = sizes[b]
        if size < 2:
            break
        members = order[starts[b] : starts[b + 1]]
        tried = 1
        while True:
            tries = np.arange(tried, tried + 64)
            slots = _slots(x[members][None, :], tries[:, None], n)
            good = ~taken[slots].any(axis=1)
            ordered = np.sort(slots, axis=1)
            good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if good.any():
                k = int(good.argmax())
                displacement[b] = tries[k]
                taken[slots[k]] = True
                slot_of[members] = slots[k]
                break
            tried += 64
    ones = np.flatnonzero(sizes == 1)
    free = np.flatnonzero(~taken)[: len(ones)]
    displacement[ones] = -free - 1  # a bucket of one names its slot
    slot_of[order[starts[ones]]] = free
    place = np.empty(n, np.int64)
    place[slot_of] = np.arange(n)
    return b"".join([
        HEAD.pack(b"MPHI", 1, width, n, m), displacement.astype("<i4").tobytes(), fingerprints[place].astype("<u4").tobytes(),
        offsets[place].astype("<u8").tobytes(), lengths[place].astype("<u4").tobytes(),
    ])


class Index:
    """Reader of the bytes that ``build_index`` makes."""

    def __init__(self, data: bytes) -> None:
        magic, version, self.width, self.n, m = HEAD.unpack_from(data)
        if magic != b"MPHI" or version != 1:
            raise ValueError("not an index of this format")
        at = HEAD.size
        parts = []
        for kind, count in (("<i4", m), ("<u4", self.n), ("<u8", self.n), ("<u4", self.n)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        self.displacement, self.fingerprints, self.offsets, self.lengths = parts

    def find(self, hashes: np.ndarray, fingerprints: np.ndarray, occurrence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, lengths) in the payload; an offset of -1 for keys that are not there."""
        if not self.n or not len(hashes):
            return np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        x = _identity(hashes, occurrence)
        d = self.displacement[((x >> np.uint64(32)) % np.uint64(len(self.displacement))).astype(np.int64)]
        slot = np.where(d < 0, -d.astype(np.int64) - 1, _slots(x, np.maximum(d, 0), self.n))
        known = self.fingerprints[slot] == fingerprints
        return np.where(known, self.offsets[slot].astype(np.int64), -1), np.where(known, self.lengths[slot].astype(np.int64), 0)


def _hash_columns(key) -> list:
    return [F.xxhash64(key), F.xxhash64(key, F.lit("fingerprint")).bitwiseAND(F.lit(0xFFFFFFFF))]


def write_store(df: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all rows, each with ``end_id`` appended, in ascending key order."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange(F.col("key").asc_nulls_first(), tie).sortWithinPartitions(F.col("key").asc_nulls_first(), tie)
    h1, h2 = _hash_columns(F.col("key"))
    rows = rows.select(F.spark_partition_id().alias("shard"), "key", h1.alias("h1"), h2.alias("h2"), "text")
    kind = rows.schema["key"].dataType
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("segment", T.LongType()), T.StructField("first_key", kind),
        T.StructField("last_key", kind), T.StructField("keys", T.ArrayType(kind)), T.StructField("n_ids", T.LongType()),
        T.StructField("index", T.BinaryType()), T.StructField("payload", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        end = np.array([end_id], coder.dtype).tobytes()
        width = len(end)
        done = 0
        shard = 0
        parts: list[pa.RecordBatch] = []
        ids: list[bytes] = []
        total = 0

        def segment() -> pa.RecordBatch:
            keys = pa.concat_arrays([p.column(1) for p in parts])
            h1, h2 = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in (2, 3))
            lengths = np.array([len(x) // width for x in ids], np.int64)
            offsets = np.cumsum(lengths) - lengths
            index = build_index(h1, h2.astype(np.uint32), offsets, lengths, width)
            listed = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int64()), pa.array([done], pa.int64()), keys.slice(0, 1), keys.slice(len(keys) - 1, 1),
                    listed, pa.array([int(lengths.sum())], pa.int64()), pa.array([index], pa.binary()),
                    pa.array([b"".join(ids)], pa.binary()),
                ],
                names=schema.names,
            )

        for batch in batches:
            first = 0  # rows of the batch before this one are in ``parts`` already
            shard = batch.column(0)[0].as_py() if batch.num_rows else shard
            for i, text in enumerate(batch.column(4).to_pylist()):
                row = coder.encode(text or "") + end
                if ids and (len(ids) == SEGMENT_DOCS or total + len(row) // width > SEGMENT_IDS):
                    if i > first:
                        parts.append(batch.slice(first, i - first))
                    first = i
                    yield segment()
                    done, total = done + 1, 0
                    parts.clear()
                    ids.clear()
                ids.append(row)
                total += len(row) // width
            if batch.num_rows:
                parts.append(batch.slice(first))
        if ids:
            yield segment()

    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def _read(segments: DataFrame, columns: list[str]) -> DataFrame:
    """One row per document of the segments, through the index: key, shard, segment, local (ids of
    the segment before it), n_tokens and ids (little-endian unsigned 32-bit) or their crc32."""
    hashed = [F.transform("keys", lambda k: _hash_columns(k)[i]).alias(f"h{i}") for i in (0, 1)]
    source = segments.select("keys", *hashed, "shard", "segment", "index", "payload")
    kind = segments.schema["keys"].dataType.elementType
    fields = {"shard": T.LongType(), "segment": T.LongType(), "local": T.LongType(), "n_tokens": T.LongType(), "ids": T.BinaryType(), "ids_crc32": T.LongType()}
    schema = T.StructType([T.StructField("key", kind), *[T.StructField(c, fields[c]) for c in columns]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                index = Index(one.column(5)[0].as_py())
                payload = memoryview(one.column(6)[0].as_py())
                h1, h2 = (one.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
                at, n = index.find(h1, h2.astype(np.uint32), occurrences(h1))
                if (at < 0).any():
                    raise ValueError("a stored key is missing from its index")
                size = index.width
                ids = (np.frombuffer(payload[a * size : (a + k) * size], f"<u{size}").astype("<u4").tobytes() for a, k in zip(at, n, strict=True))
                made = {"shard": pa.repeat(one.column(3)[0], len(at)), "segment": pa.repeat(one.column(4)[0], len(at)),
                        "local": pa.array(at, pa.int64()), "n_tokens": pa.array(n, pa.int64())}
                if "ids" in columns:
                    made["ids"] = pa.array(list(ids), pa.binary())
                else:
                    made["ids_crc32"] = pa.array([zlib.crc32(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([one.column(0).flatten(), *[made[c] for c in columns]], names=schema.names)

    return source.mapInArrow(run, schema)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document; start counts the ids of all before it."""
    segments = spark.read.parquet(path)
    sizes = segments.select("shard", "segment", "n_ids")
    # Totals in two steps: segments within their shard, then one row per shard.
    inner = sizes.withColumn("inner", F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_ids"))
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    bases = inner.join(shards, "shard").select("shard", "segment", (F.col("inner") + F.col("base")).alias("base"))
    rows = _read(segments, ["shard", "segment", "local", "n_tokens", "ids_crc32"]).join(bases, ["shard", "segment"])
    return rows.select("key", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(key, n_tokens, ids) of the stored documents with the given keys (one column, any name).

    Keys meet the segments whose key range holds them, by shard: shards are ranges, too, and there are
    no more of them than the writing job had partitions, so their bounds go to every task."""
    segments = spark.read.parquet(path)
    wanted = keys.select(F.col(f"`{keys.columns[0]}`").alias("want")).where("want IS NOT NULL").distinct()
    bounds = segments.groupBy("shard").agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi"), F.max(F.col("first_key").isNull()).alias("open"))
    # A range that begins with null keys has no lower bound.
    near = wanted.join(
        F.broadcast(bounds), (F.col("open") | (F.col("want") >= F.col("lo"))) & (F.col("want") <= F.col("hi"))
    ).select("want", "shard")
    places = segments.select("shard", "segment", "first_key", "last_key")
    met = near.join(places, "shard").where(
        (F.col("first_key").isNull() | (F.col("want") >= F.col("first_key"))) & (F.col("want") <= F.col("last_key"))
    )
    asked = met.groupBy("shard", "segment").agg(F.collect_set("want").alias("wanted"))
    hashed = [F.transform("wanted", lambda k: _hash_columns(k)[i]).alias(f"h{i}") for i in (0, 1)]
    source = segments.join(asked, ["shard", "segment"]).select("wanted", *hashed, "index", "payload")
    schema = T.StructType([T.StructField("key", wanted.schema["want"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                index, payload = Index(one.column(3)[0].as_py()), memoryview(one.column(4)[0].as_py())
                names = one.column(0).flatten()
                h1, h2 = (one.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
                todo, turn = np.arange(len(h1)), 0
                while len(todo):  # again for keys that occur more than once
                    at, n = index.find(h1[todo], h2[todo].astype(np.uint32), np.full(len(todo), turn))
                    todo, at, n = todo[at >= 0], at[at >= 0], n[at >= 0]
                    size = index.width
                    ids = [np.frombuffer(payload[a * size : (a + k) * size], f"<u{size}").astype("<u4").tobytes() for a, k in zip(at, n, strict=True)]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(todo)), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=schema.names)
                    turn += 1

    return source.mapInArrow(run, schema)
