"""Benchmark decontamination, by DataFrame functions only.

The distinct windows of all benchmark items (``window`` words; a shorter item is one window) make a
hash set that is broadcast. Every document is read once: its words are hashed, hashes of windows come
from those of their halves, each window of each document probes the set, and a hit is verified by its
words. Hits are gathered per document, so the only shuffle carries one row per document and one per
hit.

The set is broadcast in blocks of at most ``BLOCK_WINDOWS`` windows and ``BLOCK_CHARS`` characters,
so its size is bounded; a larger benchmark takes more blocks, each probed by all documents, and loses
no window.

Defined cases: a null text, document or item, has no words; a text without words is never hit. An
item without words has no window. Repeated documents are judged row by row; items with equal texts
are all reported; items of one id count once. Null item ids are left out of the items, their windows
still hit. An empty benchmark hits nothing and an empty document table gives an empty result. Texts
of any length are read whole; a document's work is proportional to its words. Columns of the input
are kept whatever their names; temporary columns take names that are free, and a column that is named
like the result gives way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewalk.llm.common import computed, fresh, lower_ascii
from statewalk.session import materialize

WINDOW = 10
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text that still has its capital letters.
CASED_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_WINDOWS = 1 << 20
BLOCK_CHARS = 1 << 26


def word_list(text: Column) -> Column:
    """Lower-cased words of a text; empty for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def _pairs(left: Column, right: Column, shift: int) -> Column:
    """Hash of each value of ``left`` and the value of ``right`` that is ``shift`` places on."""
    ahead = F.slice(right, F.lit(shift + 1), F.greatest(F.size(right) - shift, F.lit(0)))
    behind = F.slice(left, F.lit(1), F.greatest(F.least(F.size(left), F.size(right) - shift), F.lit(0)))
    return F.zip_with(behind, ahead, lambda a, b: F.xxhash64(a, b))


def with_codes(df: DataFrame, words: str, lengths: list[int], into: str) -> DataFrame:
    """``df`` with array columns ``into`` + length: the hash of every window of that many words, by place.
    Windows of 2, 4, 8, ... words are hashed from two neighbours of half the length, others from the
    parts of their binary form; every step is computed once."""
    powers, size = {1: f"{into}_1"}, 1
    df = computed(df, powers[1], F.transform(words, lambda w: F.xxhash64(w)))
    while lengths and 2 * size <= max(lengths):
        powers[2 * size] = f"{into}_{2 * size}"
        df = computed(df, powers[2 * size], _pairs(F.col(powers[size]), F.col(powers[size]), size))
        size *= 2
    for n in lengths:
        parts = [p for p in powers if n & p]
        whole, done = powers[parts[0]], parts[0]
        for p in parts[1:]:
            step = f"{into}_{n}_{p}"
            df = computed(df, step, _pairs(F.col(whole), F.col(powers[p]), done))
            whole, done = step, done + p
        df = df.withColumn(f"{into}{n}", F.col(whole))
    return df


def item_windows(items: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """Distinct windows: n_words, code (hash), words (joined by one space), items (their ids)."""
    source = items.select(F.col(f"`{key}`").alias("item"), word_list(F.col(f"`{text}`")).alias("w"))
    source = source.where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)
    each = source.select("item", "n", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.col("n")))).alias("g"))
    spread = each.select("item", F.col("n").alias("n_words"), F.array_join("g", " ").alias("words"), "g")
    grouped = spread.groupBy("n_words", "words").agg(F.collect_set("item").alias("items"), F.first("g").alias("g"))
    coded = with_codes(grouped, "g", list(range(1, window + 1)), "_h")
    code = F.coalesce(*[F.when(F.col("n_words") == n, F.get(f"_h{n}", F.lit(0))) for n in range(1, window + 1)])
    return coded.select("n_words", code.alias("code"), "words", "items")


def _probe(docs: DataFrame, others: list[str], lengths: list[int], block: DataFrame, mark: bool) -> DataFrame:
    """Hits of the documents' windows in one broadcast block; with ``mark`` also one row per document,
    the only one that carries its other columns."""
    parts = [F.struct(F.lit(n).alias("n"), F.col(f"_h{n}").alias("codes")) for n in lengths]
    parts += [F.struct(F.lit(0).alias("n"), F.array(F.lit(0).cast("long")).alias("codes"))] if mark else []
    of_length = docs.select("_r", *others, "_w", F.explode(F.array(*parts)).alias("_p"))
    placed = of_length.select("_r", *others, "_w", F.col("_p.n").alias("_n"), F.posexplode("_p.codes").alias("_at", "_code"))
    found = placed.join(F.broadcast(block), F.col("_code") == F.col("_set_code"), "left")
    joined = F.array_join(F.slice("_w", F.col("_at") + 1, F.col("_n")), " ")
    same = F.col("_set_words").isNotNull() & (F.col("_set_words") == joined)
    return found.where((F.col("_n") == 0) | same).select(
        "_r", *[F.when(F.col("_n") == 0, F.col(c)).alias(c) for c in others], "_at", "_n", "_set_items"
    )


def _union_length(spans: Column) -> Column:
    """Words covered by (start, length) spans that are sorted by start."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("end"))

    def step(state: Column, x: Column) -> Column:
        end = (x["start"] + x["length"]).cast("long")
        new = F.greatest(F.lit(0).cast("long"), end - F.greatest(state["end"], x["start"].cast("long")))
        return F.struct((state["total"] + new).alias("total"), F.greatest(state["end"], end).alias("end"))

    return F.aggregate(spans, start, step, lambda s: s["total"])


def scan(
    docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
    window: int = WINDOW, into: str = "leaks", block_windows: int = BLOCK_WINDOWS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, n_hit (long), spans (array of start, length in
    words, by start) and items (sorted distinct ids of the items whose windows occur)."""
    docs = docs.drop(into)
    sets = item_windows(items, item_key, item_text, window)
    facts = sets.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("words") + 8 * F.size("items")).alias("chars"),
        F.collect_set("n_words").alias("lengths"),
    ).first()
    blocks = max(1, -(-facts["n"] // block_windows), -(-(facts["chars"] or 0) // block_chars))
    lengths = sorted(facts["lengths"])
    kept = [c for c in docs.columns if c.lower() != text.lower()]
    clear = {c: f"_c{i}" for i, c in enumerate([*kept, text])}
    plain = docs.select(
        F.monotonically_increasing_id().alias("_r"), *[F.col(f"`{c}`").alias(a) for c, a in clear.items()]
    )
    if blocks > 1:
        # Several passes must see the same row numbers.
        plain = materialize(plain, "documents")
    split = computed(plain, "_w", word_list(F.col(clear[text]))).withColumn("_len", F.size("_w").cast("long"))
    split = with_codes(split, "_w", lengths, "_h")
    others = [*clear.values(), "_len"]
    named = sets.select(
        F.col("code").alias("_set_code"), F.col("words").alias("_set_words"), F.col("items").alias("_set_items")
    )
    hits = _probe(split, others, lengths, _block(named, 0, blocks), True)
    for b in range(1, blocks):
        more = _probe(split, [], lengths, _block(named, b, blocks), False)
        hits = hits.unionByName(more, allowMissingColumns=True)
    hit = F.col("_n") > 0
    grouped = hits.groupBy("_r").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in others],
        F.array_sort(
            F.collect_list(F.when(hit, F.struct(F.col("_at").alias("start"), F.col("_n").alias("length"))))
        ).alias("_spans"),
        F.collect_set(F.when(hit, F.col("_set_items"))).alias("_items"),
    )
    found = F.struct(
        F.col("_len").alias("n_words"), _union_length(F.col("_spans")).alias("n_hit"), F.col("_spans").alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.col("_items")))).alias("items"),
    )
    return grouped.select(*[F.col(clear[c]).alias(c) for c in docs.columns], found.alias(into))


def _block(windows: DataFrame, number: int, blocks: int) -> DataFrame:
    return windows if blocks == 1 else windows.where(F.pmod(F.hash("_set_words"), F.lit(blocks)) == number)


def without_documents(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents no window occurs in; the columns of ``docs``."""
    into = fresh(docs, "_leaks")
    scanned = scan(docs, items, text, into=into, **options)
    return scanned.where(F.col(into)["n_hit"] == 0).select(*[f"`{c}`" for c in docs.columns])


def without_spans(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """All documents, their texts without the words of any hit; what stands between words stays."""
    into = fresh(docs, "_leaks")
    scanned = scan(docs, items, text, into=into, **options)
    value = F.col(f"`{text}`")
    words = F.array_remove(F.split(value, CASED_SEPARATOR), "")
    gaps = F.split(value, CASED_WORD)
    reach = F.col(into)["spans"]

    def stays(i: Column) -> Column:
        return ~F.exists(reach, lambda x: (x["start"] <= i) & (i < x["start"] + x["length"]))

    kept = F.transform(words, lambda w, i: F.when(stays(i), w).otherwise(F.lit("")))
    pieces = F.transform(
        F.arrays_zip(gaps.alias("gap"), kept.alias("word")), lambda z: F.concat(z["gap"], F.coalesce(z["word"], F.lit("")))
    )
    clean = F.when(F.col(into)["n_hit"] == 0, value).otherwise(F.array_join(pieces, ""))
    return scanned.withColumn(text, clean).select(*[f"`{c}`" for c in docs.columns])
