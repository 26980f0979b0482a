"""Quality rules: a table of thresholds compiled into one projection.

A text is measured once (words, characters, symbols, stop words, lines,
repeated words), and ``RULES`` is compiled into one boolean column for each
rule over these measures. Both are column expressions of the same row, so the
scan, the measures and the verdict are one stage: no user function, no
shuffle, and rows are independent whatever their number of copies.

Measures are whole numbers, and a rule compares products of them
(1000 x measure with threshold x base), so a verdict never depends on
rounding. Repeated three-word windows are found by sorting the windows of the
text and looking at neighbours, not by comparing all pairs.

Results by case: a null or blank text has no words and fails for its length;
a text with fewer than three words has no windows; repeated rows are judged
one by one; a null id passes as null; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3
MIN_WORDS = 50
#: Share of the words, in thousandths, that repeated windows may cover.
MAX_REPEATED = 500

_SPACE = " \t\n\x0b\x0c\r"
_SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
_BULLET, _CUT = r"^\s*[-*•]", r"(\.\.\.|…)\s*\z"
#: What is cut from the ends of a word before it is looked up among the stop words.
_POINTS = ".,;:!?()\"'"

#: Frequent function words of the languages in the corpus.
STOP_WORDS = {
    "en": "the of and to a in is that it for was on with as be by are this at from or an have not he they which but his her".split(),
    "fr": "de la le et les en des un du une que pour est par avec qui dans sur pas au ou il elle ne ce se plus son sa".split(),
    "de": "der die und in den von zu das sich mit auf des für ist im nicht dem ein eine als es an auch er sie aus bei".split(),
    "es": "de la que el en y los las se del un por con no una su para es al lo como más pero sus le ya o este".split(),
}


@dataclass(frozen=True)
class Rule:
    """Bounds, in thousandths, of ``measure`` for each unit of ``base``; 1000 for 1 of each unit."""

    name: str
    measure: str
    base: str
    at_least: int | None = None
    at_most: int | None = None


#: The threshold table. A rule whose base is 0 holds.
RULES = (
    Rule("word length", "word_chars", "n_words", at_least=2000, at_most=14000),
    Rule("longest word", "longest_word", "one", at_most=1_000_000),
    Rule("symbols", "n_symbols", "n_words", at_most=250),
    Rule("stop words", "n_stop_words", "n_words", at_least=60),
    Rule("worded", "n_lettered", "n_words", at_least=700),
    Rule("shouted", "n_shouted", "n_words", at_most=300),
    Rule("repeated lines", "n_dup_lines", "n_lines", at_most=500),
    Rule("bullets", "n_bullets", "n_lines", at_most=900),
    Rule("cut lines", "n_cut_lines", "n_lines", at_most=300),
)


def _pairs(values: Column, made) -> Column:
    """``made`` of every value and the one after it."""
    n = F.greatest(F.size(values) - 1, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(2), n), made)


def _let(value: Column, made) -> Column:
    """``made(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), made)[0]


def repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more among ``words``, each word counted once."""
    n = F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))
    zipped = F.arrays_zip(*[F.slice(words, F.lit(k + 1), n).alias(f"w{k}") for k in range(WINDOW)])
    windows = F.transform(zipped, lambda w, at: F.struct(F.concat_ws(" ", *[w[f"w{k}"] for k in range(WINDOW)]).alias("text"), at.alias("at")))
    alike = _let(F.sort_array(windows), lambda s: _pairs(s, lambda a, b: F.when(a["text"] == b["text"], F.array(a["at"], b["at"]))))
    places = F.sort_array(F.flatten(F.filter(alike, lambda p: p.isNotNull())))
    # a window adds the words that the window before it has not covered
    added = _let(places, lambda p: F.when(F.size(p) > 0, F.aggregate(_pairs(p, lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(WINDOW), lambda s, x: s + x)))
    return F.coalesce(added, F.lit(0))


def _count(values: Column, test) -> Column:
    return F.size(F.filter(values, test))


def measures(stop_words: Sequence[str]) -> dict[str, Column]:
    """Whole numbers by name, over the columns ``text``, ``words`` and ``lines``."""
    text, words, lines = F.col("text"), F.col("words"), F.col("lines")
    found = {
        "n_words": F.size(words),
        "word_chars": F.length(F.translate(text, _SPACE, "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated_words(words),
        "n_lines": F.size(lines),
        "n_stop_words": _count(words, lambda w: F.btrim(F.lower(w), F.lit(_POINTS)).isin(*stop_words)),
        "n_lettered": _count(words, lambda w: w.rlike(r"\p{L}")),
        "n_shouted": _count(words, lambda w: (F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w)),
        "longest_word": F.coalesce(F.array_max(F.transform(words, lambda w: F.length(w))), F.lit(0)),
        "n_bullets": _count(lines, lambda x: x.rlike(_BULLET)),
        "n_cut_lines": _count(lines, lambda x: x.rlike(_CUT)),
        "one": F.lit(1),
    }
    return {name: value.cast("bigint") for name, value in found.items()}


def compiled(rules: Sequence[Rule], values: Mapping[str, Column]) -> dict[str, Column]:
    """For every rule of the table, by name, whether it holds."""
    holds = {}
    for rule in rules:
        measure, base = values[rule.measure] * 1000, values[rule.base]
        bounds = []
        if rule.at_least is not None:
            bounds.append(measure >= base * rule.at_least)
        if rule.at_most is not None:
            bounds.append(measure <= base * rule.at_most)
        holds[rule.name] = reduce(Column.__and__, bounds, F.lit(True)) | (base == 0)
    return holds


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, stop_words: Mapping[str, Sequence[str]] = STOP_WORDS) -> DataFrame:
    """Per row ``doc_id``, the measures, ``base_failed``, ``broken`` (names of broken rules) and ``kept``."""
    listed = sorted({w for words in stop_words.values() for w in words})
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    parts = texts.select(
        "doc_id",
        "text",
        F.array_remove(F.split("text", _SPACES, -1), "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(_SPACE)) != "").alias("lines"),
    )
    found = measures(listed)
    measured = parts.select("doc_id", *[value.alias(name) for name, value in found.items() if name != "one"])
    values = {name: F.lit(1) if name == "one" else F.col(name) for name in found}
    holds = compiled(rules, values)
    too_short = F.col("n_words") < MIN_WORDS
    repetitive = 1000 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")
    broken = F.concat_ws(",", *[F.when(~ok, F.lit(name)) for name, ok in holds.items()])
    return measured.select(
        "*",
        (too_short | repetitive).alias("base_failed"),
        broken.alias("broken"),
        (~too_short & ~repetitive & reduce(Column.__and__, holds.values(), F.lit(True))).alias("kept"),
    )
