"""Packing documents into token windows by Karmarkar-Karp multiway differencing.

A task tokenises its documents and packs them in groups of bounded size: full windows are cut off
long documents first; the rest of the group goes to k windows by differencing: the two partial
partitions with the largest imbalance are merged, the largest subset of one with the smallest of
the other, until one near-equal partition is left. k starts at what the tokens would fill and rises while
capacity is exceeded. Where documents may be cut, the group's odd tokens leave first as tail sequences
at powers of two (which need no padding), and what exceeds a window moves to one with room.

One narrow pass: no shuffle, no key whose rows must meet, memory bounded by ``GROUP_TOKENS`` (a
longer document is a group of its own). Sequence ids are unique, made of the partition and a counter.

Defined cases: a null or empty text has its end id only. Documents with equal or null keys are
packed row by row. Empty tables give empty results. Only the key column is carried along.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewalk.llm.encoders import encoder

CAPACITY = 4096
GROUP_DOCS = 2048
GROUP_TOKENS = 1 << 22


def differencing(sizes: list[int], k: int) -> list[int]:
    """Window number of each item, by Karmarkar-Karp differencing into k subsets."""
    follow = [-1] * len(sizes)
    # A partial partition: its subsets that are not empty as (-sum, first item, last item), largest
    # first; sums are relative to its smallest subset.
    heap = [(-s, i, [(-s, i, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    stamp = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        joined = a
        over = len(a) + len(b) - k
        if over <= 0:
            for x in b:
                insort(joined, x)
        else:
            # Opposing order: with both filled up to k by empty subsets, place i of a meets place
            # k-1-i of b, and ``over`` places meet a subset that is not empty.
            alone, merged = b[: len(b) - over], []
            for n in range(over):
                x, y = a[len(a) - over + n], b[len(b) - 1 - n]
                follow[x[2]] = y[1]
                merged.append((x[0] + y[0], x[1], y[2]))
            joined = a[: len(a) - over] + merged + alone
            joined.sort()
        if len(joined) == k and (low := joined[-1][0]):
            joined = [(s - low, i, j) for s, i, j in joined]
        widest = joined[0][0] - (joined[-1][0] if len(joined) == k else 0)
        heapq.heappush(heap, (widest, stamp, joined))
        stamp += 1
    where = [0] * len(sizes)
    for w, (_, item, _) in enumerate(heap[0][2] if heap else []):
        while item >= 0:
            where[item] = w
            item = follow[item]
    return where


def _off(items: list[list], tokens: int) -> list[list]:
    """Take that many tokens off the ends of the longest items."""
    taken = []
    order = sorted(range(len(items)), key=lambda i: -items[i][2])
    for i in order:
        if not tokens:
            break
        n = min(tokens, items[i][2])
        taken.append([items[i][0], items[i][1] + items[i][2] - n, n])
        items[i][2] -= n
        tokens -= n
    return taken


def _slices(pieces: list[list], room: int) -> list[list]:
    """Take ``room`` tokens from the front of a list of pieces."""
    out = []
    while room:
        doc, start, n = pieces[-1]
        take = min(n, room)
        out.append([doc, start, take])
        room -= take
        if take == n:
            pieces.pop()
        else:
            pieces[-1] = [doc, start + take, n - take]
    return out


def pack_group(lengths: list[int], capacity: int = CAPACITY, cut: bool = True) -> list[list[list]]:
    """Windows of (document, start, length); lengths are positive. Without ``cut`` only documents
    longer than a window are cut."""
    windows, items = [], []
    for doc, n in enumerate(lengths):
        full = n // capacity
        windows += [[[doc, i * capacity, capacity]] for i in range(full)]
        if n % capacity:
            items.append([doc, full * capacity, n % capacity])
    total = sum(x[2] for x in items)
    if cut and total % capacity:
        tail = _off(items, total % capacity)[::-1]
        items = [x for x in items if x[2]]
        size = capacity
        rest = total % capacity
        while rest:
            size = 1 << (rest.bit_length() - 1)
            windows.append(_slices(tail, size))
            rest -= size
    total = sum(x[2] for x in items)
    k = total // capacity
    while items:
        k = max(1, k)
        groups: list[list[list]] = [[] for _ in range(k)]
        for x, w in zip(items, differencing([x[2] for x in items], k), strict=True):
            groups[w].append(x)
        sums = [sum(x[2] for x in g) for g in groups]
        if max(sums) > capacity and not (cut and total <= k * capacity):
            k += 1
            continue
        spare = [p for g, s in zip(groups, sums, strict=True) if s > capacity for p in _off(g, s - capacity)]
        for g, s in zip(groups, sums, strict=True):
            if s < capacity and spare:
                g += _slices(spare, min(capacity - s, sum(x[2] for x in spare)))
        windows += [[x for x in g if x[2]] for g in groups if g]
        break
    return windows


def pack(
    df: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text",
    capacity: int = CAPACITY, cut: bool = True,
) -> DataFrame:
    """One row per piece: key, start, length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset."""
    source = df.select(
        F.spark_partition_id().alias("part"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")
    )
    schema = source.select("key").schema
    for name in ("start", "length"):
        schema = schema.add(name, "long")
    schema = schema.add("ids", "binary")
    for name in ("doc_tokens", "sequence_id", "offset"):
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        end = np.array([end_id], coder.dtype).tobytes()
        keys: list[pa.Array] = []
        ids: list[np.ndarray] = []
        state = {"next": 0}

        def flush() -> pa.RecordBatch:
            rows: list[tuple] = []
            for window in pack_group([len(x) for x in ids], capacity, cut):
                at = 0
                for doc, start, n in window:
                    rows.append((doc, start, n, state["next"], at))
                    at += n
                state["next"] += 1
            doc = [r[0] for r in rows]
            data = [ids[d][s : s + n].astype("<u4").tobytes() for d, s, n, _, _ in rows]
            wide = pa.int64()
            out = pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays(keys).take(pa.array(doc, wide)),
                    pa.array([r[1] for r in rows], wide), pa.array([r[2] for r in rows], wide),
                    pa.array(data, pa.binary()), pa.array([len(ids[d]) for d in doc], wide),
                    pa.array([r[3] for r in rows], wide), pa.array([r[4] for r in rows], wide),
                ],
                names=schema.names,
            )
            keys.clear()
            ids.clear()
            return out

        tokens = 0
        for batch in batches:
            column = batch.column(2)
            for i in range(batch.num_rows):
                if not ids and not i and not state["next"]:
                    state["next"] = batch.column(0)[0].as_py() << 36
                row = np.frombuffer(coder.encode(column[i].as_py() or "") + end, coder.dtype)
                if ids and (len(ids) == GROUP_DOCS or tokens + len(row) > GROUP_TOKENS):
                    yield flush()
                    tokens = 0
                keys.append(batch.column(1).slice(i, 1))
                ids.append(row)
                tokens += len(row)
        if ids:
            yield flush()

    return source.mapInArrow(run, schema).withColumnRenamed("key", key)
