"""Jaccard self-join of documents as sets of word n-grams: partition signatures, then a token-group matrix for crowds.

A document's words are lower-cased (A-Z); its set holds the hashes of its distinct n-grams. Documents
with equal sets are one node. Nodes link when ``100 * intersection >= percent * union``.

1. Signatures: two sets that link differ by a bounded number d of tokens. Tokens are dealt to more than d buckets by hash, so linked
   sets agree on a number of whole buckets. A set gives the hash of each of its buckets, for each class of sizes in which a partner may
   be. Signatures that few sets hold list their pairs, and a pair is a candidate if it agrees on as many as linked sets must, where
   signatures that many hold (a common line) count as agreed. Only sets that could link by such signatures alone are joined through them.
   What candidates reach are candidates, too: every link lies within such a class of candidates.
2. Classes of bounded size are compared whole inside tasks, many small ones in one; every set goes there once.
3. Crowds, that is larger classes, are cut into groups of bounded size. Every node gives the first tokens of its set in a global
   order (tokens known to be frequent last, then by hash). Two sets that link share at least ``least_shared`` of these, so
   the matrix needs them only: one row per token and group, the union over the group's members. Two groups whose unions share
   fewer of them than any of their pairs must are never opened, and only sets that pass meet the members, by posting lists inside the task.

A task holds the members of one group and of up to ``PARTNERS`` partner groups that can have links; both
lists are also bounded by the total size of their sets. It returns a spanning forest of the links it finds, so no pair within a crowd of
near copies is listed. Signatures and frequent tokens only choose what is compared: links are counted on whole sets.
Hashes have 64 bits: two different sets of a corpus of a billion documents share one with
probability of about 3 %, and only then would be taken as equal.

Defined cases: null and empty texts, and those of white space, have an empty set and link with
nothing; a text with fewer words than n is one n-gram. Repeated rows are copies. A null key takes part
like any other; a component's id is its smallest key that is not null. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statewalk.llm.common import fresh
from statewalk.llm.graph import components
from statewalk.session import materialize

BROADCAST_ROWS = 1_000_000
FREQUENT_TOKENS = 2_000_000
FREQUENT = 20
#: Nodes per group, and partner groups that meet a group in one task.
GROUP = 2048
PARTNERS = 32
#: Tokens per group, and tokens of partners that meet a group in one task (a larger set is alone).
GROUP_TOKENS = 1 << 20
PARTNER_TOKENS = 1 << 22
#: Ratio of the bounds of a class of sizes.
RATIO = 1.5
#: Sets that hold a signature whose pairs are listed, at most.
SHARED = 8
#: Low bits of a signature that name its class of sizes.
CLASS_BITS = 6
#: Nodes that a task remembers to have described.
SEEN = 500_000


@dataclass(frozen=True)
class SetJoin:
    """n words per gram; percent of the union that two linked sets share."""

    n: int = 3
    percent: int = 90

    def needed(self, size: int) -> int:
        """The least intersection of a set of this size with a linked one."""
        return -(-self.percent * size // 100)

    def least_shared(self, size: int) -> int:
        """Tokens that a set of this size shares at least with a linked one, among the first."""
        return 3 if self.needed(size) >= 12 else 1

    def first(self, size: int) -> int:
        return min(size, size - self.needed(size) + self.least_shared(size))

    def classes(self, size: int) -> list[tuple[int, int, int]]:
        """(number, buckets, spare) of the classes of sizes in which a set of this size may have partners at least as large as
        the class's lower bound; linked sets agree on more than ``spare`` buckets."""
        return _classes(self.percent, size)

    def counted(self, size: int) -> int:
        """Tokens whose frequency is looked at, so that frequent ones can give way to later ones."""
        return self.first(size) * 3 // 2 + 16


@lru_cache(maxsize=100_000)
def _classes(percent: int, size: int) -> list[tuple[int, int, int]]:
    out, low, number = [], 1, 0
    while percent * low <= 100 * size:
        after = max(low + 1, int(low * RATIO))
        # Sets of at most ``after - 1`` tokens differ by at most this many if they link.
        differ = 2 * (after - 1) * (100 - percent) // (100 + percent)
        if size < after and differ:
            # Buckets that both sets leave empty tell nothing; spare ones outnumber those of most sets.
            least, spare = max(1, percent * low // 100), 1
            while spare < differ and spare < 1 + 1.5 * (differ + 1 + spare) * np.exp(-least / (differ + 1 + spare)):
                spare += 1
            out.append((number, differ + 1 + spare, spare))
        low, number = after, number + 1
    return out


def signatures(tokens: np.ndarray, join: SetJoin) -> np.ndarray:
    """Hashes of the buckets of a set, one or more of which every linked set has, too."""
    return bucketed(tokens, join)[0]


def bucketed(tokens: np.ndarray, join: SetJoin) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Hashes of the buckets of a set, with the number of their class in the low bits, and (class, surplus): with a linked set of that
    class it shares more than ``surplus`` of them."""
    out, surplus = [np.zeros(0, np.uint64)], []
    classes = join.classes(len(tokens))
    if not classes:
        return out[0], surplus
    place, value = mix(tokens ^ np.uint64(0x9FB21C651E98DF25)) >> np.uint64(32), mix(tokens + np.uint64(0xD6E8FEB86659FD93))
    for number, buckets, spare in classes:
        bucket = (place % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        held = np.bincount(bucket, minlength=buckets)
        full = np.flatnonzero(held)
        # The sum of a bucket's values names its tokens. Sets with more empty buckets than spare ones may agree on these alone.
        names = np.zeros(buckets, np.uint64)
        names[full] = np.add.reduceat(value[order], (np.cumsum(held) - held)[full])
        empty = buckets - len(full)
        used = full if empty <= spare else np.arange(buckets)
        with np.errstate(over="ignore"):
            made = mix(mix(names[used]) + used.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number))
        out.append((made >> np.uint64(CLASS_BITS) << np.uint64(CLASS_BITS)) + np.uint64(number % (1 << CLASS_BITS)))
        # Buckets that are empty in both sets count as agreed.
        surplus.append((number % (1 << CLASS_BITS), spare - empty))
    return np.concatenate(out), surplus


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def tokens_of(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of a text."""
    digest = xxhash.xxh64_intdigest
    words = np.array([digest(w) for w in (text or "").encode("utf-8").lower().split()], np.uint64)
    if not len(words):
        return words
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        grams = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            grams = mix(grams * np.uint64(0x9E3779B97F4A7C15)) + words[k : len(words) - n + 1 + k]
    return np.unique(mix(grams + np.uint64(n)))


def node_of(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        first, second = mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(), mix(tokens + np.uint64(0x14057B7EF767814F)).sum()
        return int(mix(np.array([first * np.uint64(3) + second], np.uint64))[0].astype(np.int64))


def _lists(values: list[np.ndarray], kind: type) -> pa.Array:
    sizes = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values).view(kind) if values else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))


def short(tokens: np.ndarray) -> np.ndarray:
    """The upper half of a token's bits: enough to count by, as any set of frequent tokens will do."""
    return (tokens >> np.uint64(32)).astype(np.uint32)


def describe(docs: DataFrame, join: SetJoin) -> DataFrame:
    """(key, node, size, signatures, surplus) of the documents; ``docs`` has key and text. A task gives the signatures of a node once.
    A number of ``surplus`` has the class in its low bits, as signatures have, and above these how many are shared beyond it."""
    schema = docs.select("key").schema.add("node", "long").add("size", "long").add("signatures", T.ArrayType(T.LongType()))
    schema = schema.add("surplus", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, sizes, found, surplus = [], [], [], []
            for text in batch.column(1):
                t = tokens_of(text.as_py(), join.n)
                node = node_of(t) if len(t) else None
                given, more = (t[:0], []) if node is None or node in seen else bucketed(t, join)
                found.append(given)
                surplus.append(np.array([(n << CLASS_BITS) + c for c, n in more], np.int64))
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                nodes.append(node)
                sizes.append(len(t))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), _lists(found, np.int64), _lists(surplus, np.int64)],
                names=schema.names,
            )

    return docs.select("key", "text").mapInArrow(run, schema)


def _few(df: DataFrame) -> DataFrame:
    """``df`` (a stored table), to be broadcast if its rows are few; else Spark joins by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _sets(docs: DataFrame, wanted: DataFrame, join: SetJoin) -> DataFrame:
    """(node, tokens) of the wanted (key, node), a stored table; keys find the texts. Rows of a node can repeat."""
    texts = docs.join(_few(wanted.select(F.col("key").alias("k")).distinct()), F.col("key").eqNullSafe(F.col("k")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sets, nodes = [], []
            for text in batch.column(0):
                t = tokens_of(text.as_py(), join.n)
                node = node_of(t) if len(t) else None
                if node is not None and node not in seen:
                    sets.append(t)
                    nodes.append(node)
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), _lists(sets, np.int64)], names=["node", "tokens"])

    return texts.select("text").mapInArrow(run, "node long, tokens array<long>")


def _compare(pdf: pd.DataFrame, join: SetJoin) -> pd.DataFrame:
    """Spanning forest of the links between a group (side 1) and partner groups (side 0), or, without sides, of all rows."""
    pdf = pdf.drop_duplicates([c for c in ("node", "side") if c in pdf])
    asked, group = (pdf[pdf["side"] == x] for x in (0, 1)) if "side" in pdf else (pdf, pdf)
    sets = [np.asarray(x, np.int64) for x in group["tokens"]]
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    member = np.repeat(np.arange(len(sets)), sizes)[order]
    union, starts = np.unique(flat[order], return_index=True)
    ends = np.append(starts[1:], len(flat))
    names = group["node"].to_numpy()
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for node, tokens in zip(asked["node"], asked["tokens"], strict=True):
        q = np.asarray(tokens, np.int64)
        at = np.minimum(np.searchsorted(union, q), len(union) - 1)
        at = at[union[at] == q]
        if len(at) < join.needed(len(q)):
            continue  # the union cannot hold a partner
        length = ends[at] - starts[at]
        rows = np.repeat(starts[at] - np.cumsum(length) + length, length) + np.arange(length.sum())
        shared = np.bincount(member[rows], minlength=len(sets))
        hit = shared * 100 >= join.percent * (len(q) + sizes - shared)
        for other in names[hit].tolist():
            a, b = root(node), root(other)
            if a != b:
                parent[a] = b
                edges.append((node, other))
    return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")


def _frequent(sets: DataFrame, join: SetJoin) -> np.ndarray:
    """Sorted frequent tokens (their upper halves), at most FREQUENT_TOKENS: the order needs no particular set of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [short(t[: join.counted(len(t))]) for t in _token_lists(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found or [np.zeros(0, np.uint32)]).view(np.int32))], names=["token"])

    counted = sets.select("tokens").mapInArrow(run, "token int").groupBy("token").count().where(F.col("count") > FREQUENT)
    counted = materialize(counted, "token-counts")
    least = FREQUENT
    while counted.where(F.col("count") > least).count() > FREQUENT_TOKENS:
        least *= 2
    # Bounded by FREQUENT_TOKENS (8 MB), whatever the corpus.
    rows = counted.where(F.col("count") > least).select("token").toPandas()["token"].to_numpy()
    return np.sort(rows.astype(np.int32).view(np.uint32))


def _token_lists(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return [flat[a - ends[0] : b - ends[0]] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _first_tokens(sets: DataFrame, frequent: np.ndarray, join: SetJoin) -> DataFrame:
    """(token, node): a set's first tokens in the order (frequent, hash)."""
    shared = sets.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value
        for batch in batches:
            tokens, nodes = [], []
            for node, t in zip(batch.column(0).to_pylist(), _token_lists(batch.column(1)), strict=True):
                k = join.first(len(t))
                if len(late):
                    half = short(t)
                    known = late[np.minimum(np.searchsorted(late, half), len(late) - 1)] == half
                    first = np.concatenate([t[~known], t[known]])[:k]
                else:
                    first = t[:k]
                tokens.append(first)
                nodes.append(np.full(len(first), node, np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes))], names=["token", "node"]
                )

    return sets.select("node", "tokens").mapInArrow(run, "token long, node long")


def _qualified(rows: DataFrame, join: SetJoin) -> DataFrame:
    """(node, group, other): nodes and the groups (their own included) that can hold partners of
    theirs, by the overlap of the node's tokens with the group's union. ``rows`` has token, node, size, group."""
    # The fewest tokens that a set of this size shares with a partner, whose size may be a little less.
    size = F.col("size") * join.percent / 100
    least = F.when(F.ceil(F.floor(size) * join.percent / 100) >= 12, 3).otherwise(1)
    matrix = rows.groupBy("token", F.col("group").alias("other")).agg(F.count("*").alias("members"))
    met = rows.join(matrix, "token").where("group <> other OR members > 1")
    bound = met.groupBy("node", "size", "group", "other").agg(F.count("*").alias("shared"))
    return bound.where(F.col("shared") >= least).select("node", "size", "group", "other")


def _crowd_links(sets: DataFrame, members: DataFrame, join: SetJoin) -> DataFrame:
    """Links (a, b) that connect all that is linked within the crowds; ``sets`` (node, tokens), ``members`` (node, size, group)."""
    first = materialize(_first_tokens(sets, _frequent(sets, join), join), "first-tokens")
    both = first.groupBy("token").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y")
    shared = materialize(both.select("token"), "shared-tokens")
    rows = first.join(_few(shared), "token").distinct().join(members.select("node", "size", "group"), "node")
    rows = materialize(rows, "rows")
    asked = materialize(_qualified(rows, join), "qualified")

    # A pair of groups is opened where members of both qualify, and only these members meet.
    sides = asked.select(
        F.least("group", "other").alias("one"), F.greatest("group", "other").alias("two"), "node", "size",
        (F.col("group") > F.col("other")).cast("int").alias("side"),
    )
    partner = F.when((F.col("side") == 1) | (F.col("one") == F.col("two")), F.col("size"))
    pairs = sides.groupBy("one", "two").agg(F.min("side").alias("a"), F.max("side").alias("b"), F.sum(partner).alias("tokens"))
    pairs = pairs.where("one = two OR a < b")
    dealt = pairs.groupBy("one").agg(
        F.greatest(F.ceil(F.count("*") / PARTNERS), F.ceil(F.sum("tokens") / PARTNER_TOKENS)).alias("parts")
    )
    dealt = pairs.join(dealt, "one").select("one", "two", F.pmod(F.xxhash64("two"), F.col("parts")).alias("part"))
    met = sides.join(dealt, ["one", "two"])
    # Within one group every member is on both sides.
    inside = met.where("one = two").select("one", "part", "node", F.lit(1).alias("side"))
    met = materialize(met.select("one", "part", "node", "side").union(inside).distinct(), "met")
    return met.join(sets, "node").groupBy("one", "part").applyInPandas(lambda pdf: _compare(pdf, join), "a long, b long")


def _candidates(described: DataFrame) -> DataFrame:
    """(node, component): nodes that agree on as many signatures as linked ones must, and what they reach in that way."""
    found = described.where(F.size("signatures") > 0)
    kind = F.col("signature").bitwiseAND((1 << CLASS_BITS) - 1).alias("class")
    given = found.select("node", F.explode("signatures").alias("signature")).repartition("signature").distinct()
    agreed = given.withColumn("sets", F.count("*").over(Window.partitionBy("signature"))).where("sets > 1")
    agreed = materialize(agreed.select("node", "signature", kind, (F.col("sets") > SHARED).alias("common")), "agreed")
    common = agreed.where("common")

    # A set shares at least ``need`` signatures that are not common with a linked one.
    surplus = found.select("node", F.explode("surplus").alias("x")).distinct()
    surplus = surplus.select("node", F.col("x").bitwiseAND((1 << CLASS_BITS) - 1).alias("class"), F.shiftright("x", CLASS_BITS).alias("surplus"))
    needs = surplus.join(agreed.groupBy("node", "class").agg(F.sum(F.col("common").cast("long")).alias("n")), ["node", "class"])
    needs = materialize(needs.select("node", "class", (F.col("surplus") + 1 - F.col("n")).alias("need")), "needs")

    few = agreed.where("NOT common").groupBy("signature", "class").agg(F.collect_list("node").alias("nodes"))
    few = few.select("class", F.explode("nodes").alias("a"), "nodes")
    few = few.select("class", "a", F.explode(F.filter("nodes", lambda n: n > F.col("a"))).alias("b"))
    few = few.groupBy("class", "a", "b").agg(F.count("*").alias("n"))
    for end in ("a", "b"):
        few = few.join(needs.select(F.col("node").alias(end), "class", "need"), [end, "class"]).where("n >= need").drop("need")

    # Sets that could agree with a linked one on common signatures alone.
    star = common.join(needs.where("need <= 0").select("node", "class"), ["node", "class"])
    star = star.select(F.min("node").over(Window.partitionBy("signature")).alias("a"), F.col("node").alias("b"))
    return components(few.select("a", "b").union(star))


def link_classes(df: DataFrame, key: str = "doc_id", text: str = "text", join: SetJoin = SetJoin()) -> DataFrame:
    """(key, n_shingles, node, component): one row per row of ``df``; component is the smallest key
    of all documents reachable by links."""
    docs = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    described = materialize(describe(docs, join), "described")
    nodes = materialize(
        described.where("node IS NOT NULL").groupBy("node").agg(F.min("key").alias("key"), F.first("size").alias("size")), "nodes"
    )
    near = nodes.join(_candidates(described), "node")
    parts = near.groupBy("component").agg(
        F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("size") / GROUP_TOKENS)).alias("parts")
    )
    near = materialize(near.join(parts, "component"), "near")

    # Classes of one part: some of them, by hash, make a task.
    few = near.where("parts = 1")
    tasks = (few.agg(F.sum("size")).first()[0] or 0) * 2 // GROUP_TOKENS + 1
    few = few.select("node", F.pmod(F.xxhash64("component"), F.lit(tasks)).alias("task"))
    sets = _sets(docs, near.where("parts = 1").select("key", "node"), join).join(_few(few), "node")
    links = materialize(sets.groupBy("task").applyInPandas(lambda pdf: _compare(pdf, join), "a long, b long"), "links")

    crowds = near.where("parts > 1")
    if not crowds.isEmpty():
        sets = _sets(docs, crowds.select("key", "node"), join).join(_few(crowds.select("node")), "node", "left_semi")
        sets = materialize(sets.dropDuplicates(["node"]), "sets")
        group = F.xxhash64("component", F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts"))).alias("group")
        links = links.union(_crowd_links(sets, materialize(crowds.select("node", "size", group), "members"), join))
    found = components(links)

    owner = nodes.join(found, "node", "left").select("node", "key", F.coalesce("component", "node").alias("class"))
    smallest = owner.groupBy("class").agg(F.min("key").alias("component"))
    owner = materialize(owner.join(smallest, "class").select("node", "component"), "owners")
    out = described.select("key", F.col("size").alias("n_shingles"), "node").join(owner, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component"))
    return out.select("key", "n_shingles", "node", component.alias("component"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", join: SetJoin = SetJoin(5, 80)) -> DataFrame:
    """``df`` with one row of each class: that with the smallest key, of equal keys any one."""
    classes = materialize(link_classes(df, key, text, join), "classes")
    # What goes: rows of a class whose key is not the smallest. Its keys are told apart by node.
    named = classes.where("node IS NOT NULL")
    first = named.where(F.col("key").eqNullSafe(F.col("component"))).groupBy("component").agg(
        F.min("node").alias("stay"), F.count("*").alias("rows")
    )
    marked = named.join(first.select(F.col("component").alias("c"), "stay", "rows"), F.col("component").eqNullSafe(F.col("c")), "left")
    stays = F.col("key").eqNullSafe(F.col("component")) & (F.col("node") == F.col("stay"))
    marked = materialize(marked.select("key", "node", stays.alias("stays"), "rows"), "marked")
    node, k, n = fresh(df, "_node"), fresh(df, "_k"), fresh(df, "_n")
    source = df.withColumn(k, F.col(f"`{key}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [tokens_of(t.as_py(), join.n) for t in batch.column(batch.schema.get_field_index(text))]
            nodes = pa.array([node_of(t) if len(t) else None for t in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], names=[*batch.schema.names, node])

    named_rows = source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField(node, T.LongType())]))
    gone = marked.where("NOT stays").select(F.col("key").alias("gone_key"), F.col("node").alias("gone_node")).distinct()
    gone = materialize(gone, "gone")
    on = F.col(k).eqNullSafe(F.col("gone_key")) & (F.col(node) == F.col("gone_node"))
    kept = named_rows.join(_few(gone), on, "left_anti")
    again = materialize(
        marked.where("stays AND rows > 1").select(F.col("key").alias("again_key"), F.col("node").alias("again_node")).distinct(), "again"
    )
    if again.isEmpty():
        return kept.drop(k, node)
    twice = _few(again)
    on = F.col(k).eqNullSafe(F.col("again_key")) & (F.col(node) == F.col("again_node"))
    once = kept.join(twice, on, "left_semi").dropDuplicates([k, node])
    return kept.join(twice, on, "left_anti").unionByName(once).drop(k, node)
