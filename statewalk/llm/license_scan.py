"""License detection by ordered signature rules, by DataFrame functions only.

A text is lower-cased (A-Z) and cut into words; signatures are regular expressions over words. A
rule is tried only on documents that hold its keyword. Detections that lie inside another detection
of the same or a higher priority are suppressed. One narrow pass, no shuffle.

Rules are built from license names and statement forms, each written by hand: every name in every
form is one rule. Priorities: identifier lines 3, grants 2, mentions 1. The score is the share of
certainty of the strongest detection that stays (1.0, 0.8, 0.5), 0 without one.

Defined cases: a null text counts as empty; a text without words has no detection, null places and
empty labels. Repeated rows are scanned row by row. Empty tables give empty results. Columns of the
input are kept whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewalk.llm.common import computed, fresh, let, lower_ascii

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and labels of the base.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: label, keyword, name (words, optional parts in groups)
NAMES = (
    ("mit", "mit", "mit"),
    ("mit", "expat", "expat"),
    ("apache", "apache", "apache(?: software)?"),
    ("apache-2.0", "apache", "apache(?: license)?(?: version)? 2(?: 0)?"),
    ("gpl", "gnu", "gnu general public"),
    ("gpl", "gpl", "(?:gnu )?gpl"),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl(?: version| v)? (?:2|2 0|v2)(?: only| or later)?"),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl(?: version| v)? (?:3|3 0|v3)(?: only| or later)?"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl(?: 2 1| 3 0)?(?: only| or later)?"),
    ("agpl", "affero", "(?:gnu )?affero general public"),
    ("agpl", "agpl", "(?:gnu )?agpl(?: 3 0)?(?: only| or later)?"),
    ("bsd", "bsd", "bsd"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd)"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)"),
    ("mpl", "mozilla", "mozilla public(?: license)?(?: version)?(?: 1 1| 2 0)?"),
    ("mpl", "mpl", "mpl(?: 1 1| 2 0)?"),
    ("epl", "eclipse", "eclipse public"),
    ("epl", "epl", "epl(?: 1 0| 2 0)?"),
    ("cddl", "cddl", "cddl(?: 1 0)?"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("boost", "boost", "boost software"),
    ("boost", "bsl", "bsl 1 0"),
    ("unlicense", "unlicense", "unlicense"),
    ("cc0", "cc0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "attribution", "(?:creative commons )?attribution(?: 4 0| 3 0)?(?: international)?"),
    ("cc-by-sa", "sharealike", "(?:creative commons )?attribution sharealike(?: 4 0| 3 0)?(?: international)?"),
    ("cc-by-nc", "noncommercial", "(?:creative commons )?attribution noncommercial(?: 4 0| 3 0)?(?: international)?"),
    ("cc-by", "cc", "cc by(?: 4 0| 3 0)?"),
    ("cc-by-sa", "cc", "cc by sa(?: 4 0| 3 0)?"),
    ("cc-by-nc", "cc", "cc by nc(?: 4 0| 3 0)?"),
    ("artistic", "artistic", "artistic(?: 2 0)?"),
    ("eupl", "eupl", "eupl(?: 1 1| 1 2)?"),
    ("odbl", "odbl", "(?:odc )?odbl(?: 1 0)?"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("ofl", "ofl", "(?:sil )?ofl(?: 1 1)?"),
    ("public-domain", "domain", "public domain"),
)
#: priority, statement around a name
FORMS = (
    (3, "spdx license identifier {}(?: license)?"),
    (2, "(?:is |are )?licensed under (?:the )?(?:terms of the )?{}(?: license)?"),
    (2, "(?:is |are )?released under (?:the )?(?:terms of the )?{}(?: license)?"),
    (2, "(?:re)?distributed? (?:it )?(?:and or modify it )?under (?:the )?(?:terms of the )?{}(?: license)?"),
    (2, "available under (?:the )?(?:terms of the )?{}(?: license)?"),
    (2, "subject to (?:the )?(?:terms of the )?{}(?: license)?"),
    (2, "dedicated to the {}"),
    (1, "{} licen[sc]ed?"),
)
CERTAINTY = {1: 0.5, 2: 0.8, 3: 1.0}
OPENING, CLOSING = "\x01", "\x02"


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str  # over words with two spaces between them, one at either end
    priority: int


def spaced(words: str) -> str:
    """A pattern over texts in which every word has a space of its own on either side."""
    return " (" + words.replace(" ", "  ") + ") "


def default_rules() -> tuple[Rule, ...]:
    return tuple(
        Rule(label, keyword, spaced(form.format(f"(?:{name})")), priority)
        for label, keyword, name in NAMES
        for priority, form in FORMS
    )


def normalized(text: Column) -> Column:
    """Lower-cased words, each between two spaces of its own; empty without words."""
    words = F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATOR, "  "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def places(norm: Column, pattern: Column | str) -> Column:
    """Array of (start, end) word places of a pattern's matches, end exclusive."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    marked = F.regexp_replace(norm, pattern, F.lit(f" {OPENING}$1{CLOSING} "))

    def of(words: Column) -> Column:
        numbered = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.cast("long").alias("i")))
        starts = F.transform(F.filter(numbered, lambda x: x["w"].startswith(OPENING)), lambda x: x["i"])
        ends = F.transform(F.filter(numbered, lambda x: x["w"].endswith(CLOSING)), lambda x: x["i"] + 1)
        return F.transform(
            F.arrays_zip(starts.alias("a"), ends.alias("b")),
            lambda z: F.struct(z["a"].alias("start"), z["b"].alias("end")),
        )

    return let(F.split(F.trim(marked), "  "), of)


def detections(norm: Column, rules: tuple[Rule, ...]) -> Column:
    """Detections that stay after suppression: array of (start, end, priority, label)."""
    kind = "array<struct<start:bigint,end:bigint,priority:int,label:string>>"
    table = F.array(
        *[
            F.struct(
                F.lit(f" {r.keyword} ").alias("keyword"), F.lit(r.pattern).alias("pattern"),
                F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"),
            )
            for r in rules
        ]
    )
    gated = F.filter(table, lambda r: norm.contains(r["keyword"]))
    raw = F.flatten(
        F.transform(
            F.filter(gated, lambda r: F.regexp_like(norm, r["pattern"])),
            lambda r: F.transform(
                places(norm, r["pattern"]),
                lambda p: F.struct(
                    p["start"].alias("start"), (-p["end"]).alias("end"), (-r["priority"]).alias("priority"),
                    r["label"].alias("label"),
                ),
            ),
        )
    )
    levels = sorted({r.priority for r in rules})

    def suppressed(rows: Column) -> Column:
        # Sorted by start, then longest, then highest priority: a detection lies inside an earlier
        # one exactly if a reach of its level or above is not before its end.
        start = F.struct(
            *[F.lit(-1).cast("long").alias(f"p{k}") for k in levels], F.array().cast(kind).alias("kept")
        )

        def step(state: Column, x: Column) -> Column:
            end, priority = -x["end"], -x["priority"]
            inside = F.lit(False)
            for k in levels:
                inside = inside | ((F.lit(k) >= priority) & (state[f"p{k}"] >= end))
            row = F.struct(
                x["start"].alias("start"), end.alias("end"), priority.alias("priority"), x["label"].alias("label")
            )
            return F.struct(
                *[
                    F.when(priority == k, F.greatest(state[f"p{k}"], end)).otherwise(state[f"p{k}"]).alias(f"p{k}")
                    for k in levels
                ],
                F.when(inside, state["kept"]).otherwise(F.array_append(state["kept"], row)).alias("kept"),
            )

        return F.aggregate(rows, start, step, lambda s: s["kept"])

    return let(F.array_sort(raw), suppressed)


def scan(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """``df`` with a struct column ``license``: n_words, base (array of start, end places), labels
    (array, sorted), base_labels (array, sorted), found (detections with places) and score."""
    rules = default_rules() if rules is None else rules
    df = df.drop("license")
    norm = fresh(df, "_norm")
    wide = computed(df, norm, normalized(F.col(f"`{text}`")))
    n = F.col(norm)
    spans = "array<struct<start:bigint,end:bigint>>"
    phrase = spaced("|".join(p for p, _ in BASE))
    base = F.when(n.contains(" license "), places(n, phrase)).otherwise(F.array().cast(spans))
    base_labels = F.array_sort(
        F.filter(
            F.array(*[F.when(n.contains(f" {p.replace(' ', '  ')} "), F.lit(label)) for p, label in BASE]),
            lambda x: x.isNotNull(),
        )
    )
    gate = F.lit(False)
    for word in sorted({r.keyword for r in rules}):
        gate = gate | n.contains(f" {word} ")
    none = F.array().cast("array<struct<start:bigint,end:bigint,priority:int,label:string>>")
    found = F.when(gate, detections(n, rules)).otherwise(none)
    best = F.array_max(F.transform(F.col("license.found"), lambda x: x["priority"]))
    score = F.lit(0.0)
    for level, value in CERTAINTY.items():
        score = F.when(best == level, F.lit(value)).otherwise(score)
    wide = computed(
        wide, "license",
        F.struct(
            ((F.length(n) - F.length(F.replace(n, F.lit(" "), F.lit("")))) / 2).cast("long").alias("n_words"),
            base.alias("base"), base_labels.alias("base_labels"), found.alias("found"),
        ),
    )
    labels = F.array_sort(
        F.array_distinct(
            F.concat(F.col("license.base_labels"), F.transform(F.col("license.found"), lambda x: x["label"]))
        )
    )
    # A base place alone is a mention.
    score = F.greatest(score, F.when(F.size("license.base") > 0, F.lit(CERTAINTY[1])).otherwise(F.lit(0.0)))
    wide = wide.withColumn("license", F.col("license").withField("labels", labels).withField("score", score))
    return wide.drop(norm)
