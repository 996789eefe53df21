"""Filter interaction audit over a sparse document-term matrix.

1. Shards. A task lays its documents into a CSR shard of at most ``SHARD_BYTES`` of text, in pieces of
   at most ``PIECE_BYTES``: row pointers, column numbers, counts and the words that no piece before had. Columns
   are numbered within the shard at first. Each row also brings what needs its text but not its words:
   share of capitals, symbols and a digest of the text.
2. Dictionary. One entry per word and shard is dealt to a slot by the word's hash. The words of a slot are
   ranked, and rank and slot give a number that all shards share. Slots follow the number of entries, so
   they stay small and about equal, and numbers have next to no gaps.
3. Matrix. Entries return to their shards, whose column numbers become those of the dictionary.
4. Flags. Row sums are words and nonzero counts are distinct words: conditions A and B. Documents
   with equal texts are found by digest (SHA-256), their smallest id by a grouped minimum; only the rows at
   that id, met by (digest, id), are free of condition E.
5. Audit. Rows fold to one count per part, set of failed filters and label. All orders are evaluated
   on these counts: 32 sets of filters at most per part and label.

Shuffles carry one entry per word and shard (twice), the shards once, and a few dozen bytes per document. A
text that a third of the documents share folds before it is shuffled by (digest, id).

Defined cases: a null text is an empty one; an empty text has no words, so it fails A only (0 words) and E
where it repeats. A null part is the empty string. A row with a null id is never a repeat (E) and makes none, and has
no label. Rows that share the smallest id of their text are all free of E. Labels of one id that contradict each other count
as 1. Texts of any length are read whole (one such text is a shard of its own). An empty table gives no row. Other columns
are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewalk.session import materialize

# Fixed values of the filters.
FILTERS = "ABCDE"
MIN_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes that begin no character of UTF-8.
CONTINUATION = bytes(range(0x80, 0xC0))

SHARD_BYTES = 1 << 25
PIECE_BYTES = 1 << 20
SLOT_ENTRIES = 1 << 16
PLACE_BITS = 32
PIECES = """
shard long, ids array<long>, parts array<string>, digests array<binary>, capital array<boolean>,
symbol array<boolean>, indptr array<long>, indices array<int>, counts array<int>, first int, vocabulary array<binary>
"""
KEPT = ("ids", "parts", "digests", "capital", "symbol", "indptr")
MATRIX = """
shard long, ids array<long>, parts array<string>, digests array<binary>, capital array<boolean>, symbol array<boolean>,
indptr array<long>, counts array<int>, indices array<long>
"""


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        base = int(sizes[first - 1]) if first else 0
        n = max(1, int(np.searchsorted(sizes, base + PIECE_BYTES, side="right")) - first)
        yield batch.slice(first, n)
        first += n


def _character_flags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Whether capitals are too many, and whether a symbol occurs, per UTF-8 text."""
    sizes, small, heads, plain = (
        np.array([len(t.translate(None, without)) for t in texts], dtype=np.int64) for without in (b"", CAPITALS, CONTINUATION, SYMBOLS)
    )
    return 100 * (sizes - small) > CAPITAL_PERCENT * heads, plain < sizes


def _csr(rows: np.ndarray, numbers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pointers, column numbers and counts of ``n`` rows, from the row and the column number of each word."""
    width = int(numbers.max(initial=0)) + 1
    cells, counts = np.unique(rows * width + numbers, return_counts=True)
    indptr = np.concatenate([[0], np.cumsum(np.bincount(cells // width, minlength=n))])
    return indptr.astype(np.int64), (cells % width).astype(np.int32), counts.astype(np.int32)


def _lists(values, kind: pa.DataType) -> pa.Array:
    return pa.array([values], pa.list_(kind))


def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of some UTF-8 texts, and how many each text has."""
    split = pc.ascii_split_whitespace(texts.view(pa.string()))
    words = split.flatten().view(pa.binary())
    rows = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    real = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty word, which is none
    lengths = np.bincount(rows[real.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return words.filter(real).dictionary_encode(), lengths


def _shard(shard: int, held: list[dict[str, pa.Array]], words: list[pa.DictionaryArray], lengths: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The pieces of a shard; its words are numbered as they first occur."""
    coded = pa.chunked_array(words).unify_dictionaries().chunks
    words.clear()
    vocabulary = coded[-1].dictionary
    first = 0
    for columns, chunk, each in zip(held, coded, lengths, strict=True):
        numbers = chunk.indices.to_numpy().astype(np.int64)
        last = max(first, int(numbers.max(initial=-1)) + 1)
        indptr, indices, counts = _csr(np.repeat(np.arange(len(each)), each), numbers, len(each))
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int64()), **columns,
            "indptr": _lists(indptr, pa.int64()), "indices": _lists(indices, pa.int32()),
            "counts": _lists(counts, pa.int32()), "first": pa.array([first], pa.int32()),
            "vocabulary": pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), vocabulary.slice(first, last - first)),
        })
        first = last


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 10
    # Of the texts only their words stay, each once a piece, until the shard is full.
    held: list[dict[str, pa.Array]] = []
    words: list[pa.DictionaryArray] = []
    lengths: list[np.ndarray] = []
    total = 0
    for batch in batches:
        for part in _slices(batch):
            texts = part.column("text").to_pylist()
            size = sum(map(len, texts))
            if total and total + size > SHARD_BYTES:
                yield from _shard(shard, held, words, lengths)
                shard, total, held, words, lengths = shard + 1, 0, [], [], []
            total += size
            capital, symbol = _character_flags(texts)
            held.append({
                "ids": _lists(part.column("id").to_pylist(), pa.int64()),
                "parts": _lists(part.column("part").to_pylist(), pa.string()),
                "digests": _lists([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                "capital": _lists(capital, pa.bool_()), "symbol": _lists(symbol, pa.bool_()),
            })
            del texts
            found, each = _words(part.column("text"))
            words.append(found)
            lengths.append(each)
    if held:
        yield from _shard(shard, held, words, lengths)
    pa.default_memory_pool().release_unused()


@dataclass
class TermMatrix:
    """``shards``: pieces of CSR shards whose columns are numbers of the dictionary; ``entries``: word,
    place (shard and local number) and number, one row per word and shard."""

    shards: DataFrame
    entries: DataFrame

    def dictionary(self) -> DataFrame:
        """One row per word of the corpus: word, number."""
        return self.entries.select("word", "number").distinct()


def _entries(pieces: DataFrame) -> DataFrame:
    """(word, place, number): place holds shard and local number."""
    total = pieces.agg(F.sum(F.size("vocabulary")).alias("n")).first()["n"] or 0
    slots = max(1, -(-total // SLOT_ENTRIES))
    words = pieces.select("shard", "first", F.posexplode("vocabulary").alias("at", "word"))
    placed = words.select(
        "word", (F.shiftleft("shard", PLACE_BITS) + F.col("first") + F.col("at")).alias("place"),
        F.pmod(F.xxhash64("word"), F.lit(slots)).alias("slot"),
    )
    rank = F.dense_rank().over(Window.partitionBy("slot").orderBy("word"))
    return placed.select("word", "place", ((rank - 1) * F.lit(slots).cast("long") + F.col("slot")).alias("number"))


def _recoded(pieces: pa.Table, entries: pa.Table) -> pa.Table:
    """Pieces of one shard with the dictionary's numbers."""
    local = entries.column("place").to_numpy() & ((1 << PLACE_BITS) - 1)
    numbers = np.empty(len(local), dtype=np.int64)
    numbers[local] = entries.column("number").to_numpy()
    new = [numbers[np.asarray(v.values)] for v in pieces.column("indices")]
    return pieces.select(["shard", *KEPT, "counts"]).append_column("indices", pa.array(new, pa.list_(pa.int64())))


def term_matrix(df: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> TermMatrix:
    """Document-term matrix of all rows."""
    source = df.select(
        F.col(f"`{key}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"),
    )
    pieces = materialize(source.mapInArrow(_pieces, PIECES), "pieces")
    entries = _entries(pieces)
    back = entries.select(F.shiftright("place", PLACE_BITS).alias("shard"), "place", "number")
    cells = pieces.select("shard", *KEPT, "indices", "counts")
    shards = cells.groupBy("shard").cogroup(back.groupBy("shard")).applyInArrow(_recoded, MATRIX)
    return TermMatrix(shards, entries)


def _row_flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            ids, parts, digests, capital, symbol, indptr, indices, counts = (
                batch.column(c)[r].values for c in (*KEPT, "indices", "counts")
            )
            bounds = np.asarray(indptr)
            words = np.diff(np.concatenate([[0], np.cumsum(np.asarray(counts), dtype=np.int64)])[bounds])
            distinct = np.diff(bounds)
            if len(indices) != bounds[-1]:
                raise ValueError("a shard's pointers do not match its columns")
            yield pa.RecordBatch.from_arrays(
                [ids, parts, digests, pa.array(words < MIN_WORDS),
                 pa.array(100 * distinct < DISTINCT_PERCENT * words), capital, symbol],
                names=["id", "part", "digest", "A", "B", "C", "D"],
            )


def document_flags(matrix: TermMatrix) -> DataFrame:
    """(id, part, A, B, C, D, E, n): what documents fail, equal rows folded."""
    schema = "id long, part string, digest binary, A boolean, B boolean, C boolean, D boolean"
    each = matrix.shards.mapInArrow(_row_flags, schema)
    folded = materialize(
        each.groupBy("id", "part", "digest", "A", "B", "C", "D").agg(F.count(F.lit(1)).alias("n")), "flags"
    )
    first = folded.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    with_id = folded.where("id IS NOT NULL").join(first, ["digest", "id"], "left")
    without = folded.where("id IS NULL").withColumn("first", F.lit(True))
    return with_id.unionByName(without).select(
        "id", "part", "A", "B", "C", "D", F.col("first").isNull().alias("E"), "n"
    )


def audit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step; see ``interactions`` for the columns."""
    flags = document_flags(term_matrix(df, key, text, part))
    marks = labels.groupBy(F.col(key).cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    ).where("id IS NOT NULL")
    known = flags.where("id IS NOT NULL").join(marks, "id", "left")
    none = flags.where("id IS NULL").withColumn("good", F.lit(0)).withColumn("toxic", F.lit(0))
    mask = sum((F.col(f).cast("int") * (1 << i) for i, f in enumerate(FILTERS)), F.lit(0))
    counts = known.unionByName(none).groupBy("part", mask.alias("mask")).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )
    return interactions(counts)


def interactions(counts: DataFrame) -> DataFrame:
    """Effects of all orders of the filters from (part, mask, n, good, toxic), where bit i of the mask
    tells that filter i fails: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley. A part has at most 32 masks."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            steps.append((name, step, f, 1 << f, before))
            before |= 1 << f
    cell = "struct<filter_order:string,step:int,filter:int,own:int,before:int>"
    listed = "array(" + ", ".join(f"struct('{o}', {s}, {f}, {own}, {b})" for o, s, f, own, b in steps) + ")"
    each = counts.select("*", F.explode(F.expr(listed).cast(f"array<{cell}>")).alias("s")).select(
        "part", "mask", "n", "good", "toxic", "s.*"
    )
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(condition: Column, value: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(F.lit(0))).cast("long")

    table = each.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"), total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter")).cast("long")
    return table.withColumn("shapley", shapley).drop("filter")
