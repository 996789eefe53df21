"""Line-first cleaning of documents, by DataFrame functions only.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines are removed,
and a document that loses too much of its words is rejected. The plan is one narrow pass: no
shuffle, and a document's work is linear in its length but for one sort of its five-word windows.

Defined cases: a null text counts as a text without words (it is rejected, its cleaned text is
empty); empty texts and texts of white space alike. Repeated rows are judged row by row. An empty
table gives an empty result. Columns of the input are kept whatever their names; temporary columns
take names that are free.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewalk.llm.common import SPACES, computed, fresh, let

# Fixed values of the base measures.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20

SPACE_RUN = r"[\x20\x09-\x0D]+"
#: A window's place takes the low 31 bits of a long, its hash the rest.
PLACE_BITS = 31


@dataclass(frozen=True)
class LineRules:
    """Parameters of the method's own rules.

    decoration_percent: symbol characters a line may have, in percent of its non-space characters
    shout_percent: doubled marks (!!, ??) a line may have, in percent of its words
    navigation_separators: from so many separators (| » ›) on, a line is a menu
    boilerplate_words: a line with a boilerplate phrase fails if it has at most so many words
    kept_percent: a document must keep more than this share of its words
    """

    decoration_percent: int = 10
    shout_percent: int = 30
    navigation_separators: int = 3
    boilerplate_words: int = 40
    kept_percent: int = 50


DECORATION = "#*$%&<>{}~^=\\@_"
SEPARATORS = "|»›•"
NAVIGATION = r"(?i)^[\x20\x09-\x0D]*(home|menu|login|log in|sign in|sign up|register|search|next|previous|back to top|skip to content|contact us|about us|share|read more)[\x20\x09-\x0D.:»>]*$"
BOILERPLATE = (
    r"(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies"
    r"|subscribe to our newsletter|enable javascript|javascript is disabled|lorem ipsum|click here to"
    r"|powered by wordpress|follow us on|add to cart)"
)


def _count(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are among ``characters``."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def word_list(text: Column) -> Column:
    """Words of ``text``; an empty list for null or blank texts."""
    pieces = F.split(F.coalesce(text, F.lit("")), SPACE_RUN)
    return F.filter(pieces, lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words covered by five-word windows that occur at least twice.

    Windows are first sorted by (part of hash, place) in one long each; only windows that share
    that part with a neighbour are then compared as texts, so the count is exact.
    """
    n = F.size(words)
    mask = F.lit((1 << PLACE_BITS) - 1)

    def coded(i: Column) -> Column:
        window = [F.get(words, i + k) for k in range(WINDOW)]
        return F.xxhash64(*window).bitwiseAND(F.lit(-(1 << PLACE_BITS))).bitwiseOR(i.cast("long"))

    def neighbours(rows: Column, key) -> Column:
        same = lambda x, other: F.coalesce(key(x) == key(other), F.lit(False))
        return F.filter(
            rows, lambda x, j: ((j > 0) & same(x, F.get(rows, F.greatest(j - 1, F.lit(0))))) | same(x, F.get(rows, j + 1))
        )

    def covered(places: Column) -> Column:
        reach = F.transform(
            places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce((F.get(places, k + 1) - p).cast("int"), F.lit(WINDOW)))
        )
        return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

    def exact(codes: Column) -> Column:
        texts = F.array_sort(
            F.transform(
                codes,
                lambda c: let(
                    c.bitwiseAND(mask),
                    lambda i: F.struct(
                        F.array_join(F.slice(words, (i + 1).cast("int"), WINDOW), " ").alias("g"), i.alias("i")
                    ),
                ),
            )
        )
        twice = let(texts, lambda s: neighbours(s, lambda x: x["g"]))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    codes = F.sort_array(F.transform(F.sequence(F.lit(0), n - WINDOW), coded))
    suspects = let(codes, lambda e: neighbours(e, lambda x: F.shiftright(x, PLACE_BITS)))
    found = let(suspects, lambda s: F.when(F.size(s) == 0, F.lit(0).cast("long")).otherwise(exact(s)))
    return F.when(n < WINDOW, F.lit(0).cast("long")).otherwise(found)


def line_fails(line: Column, rules: LineRules) -> Column:
    """Whether a line with words breaks a punctuation, navigation or boilerplate rule."""
    letters = F.length(F.translate(line, SPACES, ""))
    words = F.size(F.split(line, SPACE_RUN))
    decorated = _count(line, DECORATION) * 100 > letters * rules.decoration_percent
    doubled = F.length(line) - F.length(F.replace(F.replace(line, F.lit("!!"), F.lit("")), F.lit("??"), F.lit("")))
    shouting = doubled * 50 > words * rules.shout_percent
    menu = (_count(line, SEPARATORS) >= rules.navigation_separators) | line.rlike(NAVIGATION)
    boiler = (words <= rules.boilerplate_words) & line.rlike(BOILERPLATE)
    return decorated | shouting | menu | boiler


def assess(df: DataFrame, text: str = "text", rules: LineRules = LineRules(), into: str = "quality") -> DataFrame:
    """``df`` with a struct column ``into``: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), n_failed_lines (long), kept_words (long), base_failed, kept (boolean) and
    clean_text, the text without its failing lines. A column of that name gives way."""
    df = df.drop(into)
    words, lines = fresh(df, "_words"), fresh(df, "_lines")
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    wide = computed(computed(df, words, word_list(raw)), lines, F.split(raw, "\n"))
    has_word = lambda x: F.length(F.translate(x, SPACES, "")) > 0

    def measured(kept_lines: Column) -> Column:
        clean = F.array_join(kept_lines, "\n")
        full = F.filter(F.col(lines), has_word)
        n = F.size(words).cast("long")
        return F.struct(
            n.alias("n_words"),
            F.length(F.translate(raw, SPACES, "")).cast("long").alias("word_chars"),
            _count(raw, SYMBOLS).cast("long").alias("n_symbols"),
            let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col(words)).alias("n_repeat_words"),
            (F.size(lines) - F.size(kept_lines)).cast("long").alias("n_failed_lines"),
            F.size(word_list(clean)).cast("long").alias("kept_words"),
            clean.alias("clean_text"),
        )

    good = F.filter(F.col(lines), lambda x: ~(has_word(x) & line_fails(x, rules)))

    def judged(q: Column) -> Column:
        failed = (q["n_words"] < MIN_WORDS) | (q["n_repeat_words"] * 100 > q["n_words"] * REPEAT_PERCENT)
        stays = ~failed & (q["kept_words"] * 100 > q["n_words"] * rules.kept_percent)
        return q.withField("base_failed", failed).withField("kept", stays)

    return computed(wide, into, let(let(good, measured), judged)).drop(words, lines)


def clean(df: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Documents that stay, with their cleaned text; the columns of ``df``."""
    into = fresh(df, "_quality")
    judged = assess(df, text, rules, into).where(F.col(into)["kept"])
    return judged.withColumn(text, F.col(into)["clean_text"]).select(*[f"`{c}`" for c in df.columns])
