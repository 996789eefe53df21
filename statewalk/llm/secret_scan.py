"""Secret detection through a trigram inverted index, by DataFrame functions only.

Each rule's regular expression is parsed and turned into a Boolean query over the (lower-cased)
trigrams that any match must hold. Documents are cut into blocks of bounded size by a hash of their
key; the index holds a posting list per block and trigram. Intersecting and uniting the postings of
a block gives each rule's candidates, and only these are verified by the expression. Rules whose
query is empty scan every document.

Shuffles: the postings (a few keys a document), the candidates, and the texts once, by key. A block
has at most about ``BLOCK`` keys whatever the table's size, and equal keys count once in it.

Defined cases: a null text counts as empty and has no span. Rows with a null key are not indexed
but verified against all rules. Rows that share a key share their candidates; verification keeps
each row's result exact. Empty tables give empty results. Columns of the input are kept whatever
their names.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewalk.llm.common import computed, fresh, let, lower_ascii

BLOCK = 4096


@dataclass(frozen=True)
class Rule:
    """group/least: the match stays if that group has at least so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# Fixed values of the base kinds; order and patterns are those of the contract.
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6, True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
)
OWN = (
    # Header lines, then base64 and hyphens up to the END line, or base64 alone. Plain enough for every engine.
    Rule(
        "private_key",
        r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
        r"(?:[\x20\x09-\x0D]*[A-Za-z0-9-]+:\x20[^\x0A\x0D]*[\x0A\x0D]){0,40}"
        r"(?:[A-Za-z0-9+/=\x20\x09-\x0D-]*?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|[A-Za-z0-9+/=\x20\x09-\x0D]*)",
    ),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}"),
    Rule("login_url", r"[a-z][a-z0-9+.-]{2,20}://[A-Za-z0-9._-]+:[^\x20\x09-\x0D@/:]{3,}@[A-Za-z0-9.-]+"),
)
RULES = BASE + OWN


# Boolean trigram queries: None matches everything, a string is one trigram, and
# ("and" | "or", tuple of queries) combines them.
_FEW = 16


def _all_of(queries) -> object:
    parts = []
    for q in queries:
        if q is None:
            continue
        parts += list(q[1]) if isinstance(q, tuple) and q[0] == "and" else [q]
    parts = list(dict.fromkeys(parts))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any_of(queries) -> object:
    queries = list(dict.fromkeys(queries))
    if not queries or any(q is None for q in queries):
        return None
    return queries[0] if len(queries) == 1 else ("or", tuple(queries))


def _of_texts(texts) -> object:
    """Query of a place that must hold one of some texts."""
    return _any_of(_all_of(t[i : i + 3] for i in range(len(t) - 2)) for t in sorted(texts))


def _walk(items) -> tuple[set[str] | None, object]:
    """(all texts the items can match, if few; query that every match satisfies)."""
    known: set[str] | None = {""}
    whole, queries = True, []
    for op, arg in items:
        texts, query = None, None
        if op is sre.LITERAL:
            texts = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= _FEW:
            texts = {chr(v).lower() for _, v in arg}
        elif op is sre.SUBPATTERN:
            texts, query = _walk(arg[3])
        elif op is sre.BRANCH:
            each = [_walk(x) for x in arg[1]]
            if all(t is not None for t, _ in each):
                texts = set().union(*(t for t, _ in each))
            else:
                query = _any_of(_all_of([q, _of_texts(t) if t is not None else None]) for t, q in each)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            inner, inner_query = _walk(arg[2])
            if arg[0] == 0 and arg[1] == 1 and inner is not None:
                texts = inner | {""}
            elif arg[0] > 0:
                query = _all_of([inner_query, _of_texts(inner) if inner is not None else None])
        elif op is sre.AT:
            texts = {""}
        if texts is not None and known is not None and len(texts) * len(known) <= _FEW:
            known = {a + b for a in known for b in texts}
            continue
        queries += [query, _of_texts(known) if known is not None else None]
        whole, known = False, texts if texts is not None else {""}
    if whole and known is not None:
        return known, None
    return None, _all_of([*queries, _of_texts(known) if known is not None else None])


def trigram_query(pattern: str) -> object:
    """What a text must hold to match ``pattern``; None where nothing is certain."""
    texts, query = _walk(sre_parser.parse(pattern))
    return _of_texts(texts) if texts is not None else query


def trigrams_of(query: object) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_of(q) for q in query[1]))


def index(df: DataFrame, key: str, text: str, trigrams: list[str], block: int = BLOCK) -> DataFrame:
    """Postings (block, trigram, keys) of the given trigrams over all rows with a key."""
    rows = df.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    blocks = -(-max(1, df.select(F.col(f"`{key}`")).count()) // block)
    low = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    held = let(low, lambda t: F.filter(F.array(*[F.lit(g) for g in trigrams]), lambda g: t.contains(g)))
    return (
        rows.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), "key", F.explode(held).alias("trigram"))
        .groupBy("block", "trigram")
        .agg(F.collect_set("key").alias("keys"))
    )


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, kinds) of the documents that satisfy a rule's query, by postings of their block."""
    empty = F.array().cast(postings.schema["keys"].dataType)

    def answer(query: object, lists: Column) -> Column:
        if isinstance(query, str):
            return F.coalesce(F.get(F.transform(F.filter(lists, lambda x: x["trigram"] == query), lambda x: x["keys"]), 0), empty)
        parts = [answer(q, lists) for q in query[1]]
        combine = F.array_intersect if query[0] == "and" else F.array_union
        while len(parts) > 1:
            parts = [combine(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    queried = [(r.kind, trigram_query(r.pattern)) for r in rules]
    each = [
        F.struct(F.lit(kind).alias("kind"), answer(q, F.col("lists")).alias("keys")) for kind, q in queried if q is not None
    ]
    return (
        postings.groupBy("block")
        .agg(F.collect_list(F.struct("trigram", "keys")).alias("lists"))
        .select(F.explode(F.array(*each)).alias("hit"))
        .select(F.explode("hit.keys").alias("key"), F.col("hit.kind").alias("kind"))
        .groupBy("key")
        .agg(F.collect_set("kind").alias("kinds"))
    )


_CHUNK = 256


def running_totals(values: Column) -> Column:
    """Totals up to and with each element; chunked, so long arrays don't cost their square."""

    def plain(part: Column, start: Column) -> Column:
        first = F.struct(start.alias("sum"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(
            part, first,
            lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.array_append(s["all"], s["sum"] + x).alias("all")),
            lambda s: s["all"],
        )

    zero = F.lit(0).cast("long")

    def chunked(v: Column) -> Column:
        chunks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _CHUNK).cast("int")),
            lambda c: F.slice(v, c * _CHUNK + 1, _CHUNK),
        )

        def joined(parts: Column) -> Column:
            sums = F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, x: a + x))
            return let(
                plain(sums, zero),
                lambda t: F.flatten(
                    F.transform(parts, lambda p, c: plain(p, F.when(c == 0, zero).otherwise(F.get(t, F.greatest(c - 1, F.lit(0))))))
                ),
            )

        return let(chunks, joined)

    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(let(values, chunked))


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number, end) in code points of the rule's matches that stay."""
    size = lambda x: F.length(x).cast("long")

    def placed(gaps: Column) -> Column:
        def with_matches(rows: Column) -> Column:
            steps = F.transform(
                rows, lambda x, i: size(x["g"]) + F.when(i == 0, F.lit(0)).otherwise(size(F.get(rows, F.greatest(i - 1, F.lit(0)))["m"]))
            )
            return let(
                running_totals(steps),
                lambda starts: F.transform(
                    F.filter(
                        F.transform(
                            rows,
                            lambda x, i: F.struct(
                                F.get(starts, i).alias("start"), F.lit(number).alias("kind"),
                                (F.get(starts, i) + size(x["m"])).alias("end"), size(x["k"]).alias("size"),
                            ),
                        ),
                        lambda x: x["size"] >= rule.least,
                    ),
                    lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")),
                ),
            )

        whole = F.regexp_extract_all(text, F.lit(rule.pattern), 0)
        part = F.regexp_extract_all(text, F.lit(rule.pattern), rule.group)
        rows = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(gaps) - 1).alias("g"), whole.alias("m"), part.alias("k"))
        return let(rows, with_matches)

    found = let(F.split(text, rule.pattern, -1), placed)
    # A cheap test first: only texts with a long enough match are cut up.
    return F.when(text.rlike(rule.pattern if rule.group else _at_least(rule)), found).otherwise(
        F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    )


def _at_least(rule: Rule) -> str:
    """The pattern, with a trailing repetition that must reach the least length of a match."""
    if rule.least > 1 and rule.pattern.endswith("]+"):
        head = rule.pattern[: rule.pattern.rindex("[")]
        return rule.pattern[:-1] + "{%d,}" % max(1, rule.least - len(head))
    return rule.pattern


def scan(
    df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "secrets"
) -> DataFrame:
    """``df`` with an array column ``into`` of (start, kind, end), sorted by start and then by
    kind; kind is a place in ``rules``, places count code points, ends are exclusive."""
    df = df.drop(into)
    wanted = sorted(set().union(*(trigrams_of(trigram_query(r.pattern)) for r in rules)))
    found = candidates(index(df, key, text, wanted), rules)
    kinds, other = fresh(df, "_kinds"), fresh(df, "_key")
    found = found.select(F.col("key").alias(other), F.col("kinds").alias(kinds))
    wide = df.join(found, F.col(f"`{key}`") == F.col(other), "left").drop(other)
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    each = []
    for number, rule in enumerate(rules):
        spans = spans_of(raw, rule, number)
        if trigram_query(rule.pattern) is not None:
            open_ = F.array_contains(F.col(kinds), rule.kind) | F.col(f"`{key}`").isNull()
            spans = F.when(open_, spans).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
        each.append(spans)
    return computed(wide, into, F.array_sort(F.concat(*each))).drop(kinds)


def redact(df: DataFrame, text: str = "text", mark: str = "[redacted]", spans: str = "secrets") -> DataFrame:
    """``df`` (with a column of spans) with every span of the text replaced by ``mark``; overlapping and
    touching spans become one mark, a null text stays null."""
    raw = F.col(f"`{text}`")
    spans = F.col(spans)

    def pieces(chars: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

        def step(s: Column, x: Column) -> Column:
            gap = F.slice(chars, (s["at"] + 1).cast("int"), F.greatest(x["start"] - s["at"], F.lit(0)).cast("int"))
            parts = F.when(x["start"] > s["at"], F.array(F.array_join(gap, ""), F.lit(mark))).when(
                s["at"] == 0, F.array(F.lit(mark))
            ).otherwise(F.array().cast("array<string>"))
            return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], parts).alias("out"))

        def close(s: Column) -> Column:
            rest = F.slice(chars, (s["at"] + 1).cast("int"), F.size(chars))
            return F.array_join(F.array_append(s["out"], F.array_join(rest, "")), "")

        return F.aggregate(spans, start, step, close)

    cut = let(F.regexp_extract_all(raw, F.lit("(?s)."), 0), pieces)
    return df.withColumn(text, F.when(F.size(spans) > 0, cut).otherwise(raw))
