"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACES = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "#*$%&|<>"
#: Function words of the languages of the corpus.
STOP_WORDS = tuple(
    dict.fromkeys(
        "the of and to in a is that it for on was be with as by this from are at or an not which "
        "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch "
        "le la les de des et en un une du que qui dans pour par sur est au pas plus "
        "el los las del y que se por con una su para es no lo al".split()
    )
)
#: The fixed rule that comes before the table: fewer words than this, or more of them in repeated windows.
BASE_WORDS, BASE_REPEAT_PERCENT = 50, 50


@dataclass(frozen=True)
class Rule:
    """``low <= ratio <= high`` must hold, in so far as a bound is given."""

    ratio: str
    low: float | None = None
    high: float | None = None


#: What a rule may test, as numerator and denominator (None: 1); a denominator of 0 counts as 1.
RATIOS: dict[str, tuple[str, str | None]] = {
    "words": ("n_words", None),
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "upper_ratio": ("n_upper", "word_chars"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
}
DEFAULT_RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", None, 0.2),
    Rule("stop_word_ratio", 0.06, None),
    Rule("upper_ratio", None, 0.5),
    Rule("dup_line_ratio", None, 0.5),
)
MEASURES = ("n_words", "n_repeat_words", "n_stop_words", "n_lines", "n_dup_lines", "word_chars", "n_symbols", "n_upper")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row: it is the variable of a one-element transform."""
    return F.transform(F.array(value), body)[0]


def _size(x: Column) -> Column:
    return F.size(x).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Each window becomes one long, its hash above
    its place; sorted, equal windows stand side by side and are confirmed word by word. O(n log n) a text."""

    def of(c: Column) -> Column:
        n, mask = c["n"], c["mask"]
        keys = F.transform(
            words,
            lambda x, i: F.when(i < n - 2, F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))),
        )

        def twice(s: Column) -> Column:
            def like(k: Column, other: Column) -> Column:
                i, j = k.bitwiseAND(mask).cast("int"), other.bitwiseAND(mask).cast("int")
                same = k.bitwiseXOR(other).bitwiseAND(F.bitwise_not(mask)) == 0
                for d in range(3):
                    same = same & (F.get(words, i + d) == F.get(words, j + d))
                return F.coalesce(same, F.lit(False))

            return F.sort_array(
                F.array_compact(F.transform(s, lambda k, j: F.when(like(k, F.get(s, j - 1)) | like(k, F.get(s, j + 1)), k.bitwiseAND(mask).cast("int"))))
            )

        # a place covers itself and two more words, less what an earlier place covers
        return F.aggregate(
            _let(F.sort_array(F.array_compact(keys)), twice),
            F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("last")),
            lambda acc, x: F.struct((acc["sum"] + F.least(F.lit(3), x - acc["last"])).alias("sum"), x.alias("last")),
            lambda acc: acc["sum"].cast("long"),
        )

    bits = F.length(F.bin(F.size(words).cast("long")))
    head = F.struct(F.size(words).alias("n"), (F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).alias("mask"))
    return _let(head, of)


def _measures(text: Column, stop_words: Sequence[str]) -> Column:
    """A struct of MEASURES, nested as w (of words), l (of lines) and plain counts."""
    length = F.length(text)
    blank = F.translate(text, _SPACES, " " * len(_SPACES))
    of_words = _let(
        F.array_remove(F.split(blank, " ", -1), ""),
        lambda w: F.struct(
            _size(w).alias("n_words"),
            _repeat_words(w).alias("n_repeat_words"),
            _size(F.filter(w, lambda x: F.lower(x).isin(*stop_words))).alias("n_stop_words"),
        ),
    )
    of_lines = _let(
        F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, _SPACES, "")) > 0),
        lambda x: F.struct(_size(x).alias("n_lines"), (_size(x) - _size(F.array_distinct(x))).alias("n_dup_lines")),
    )
    return F.struct(
        of_words.alias("w"),
        of_lines.alias("l"),
        F.length(F.translate(text, _SPACES, "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (length - F.length(F.translate(text, _UPPER, ""))).cast("long").alias("n_upper"),
    )


def _verdict(m: Column, rules: Sequence[Rule]) -> Column:
    value = {k: m["w"][k] if k in MEASURES[:3] else m["l"][k] if k in MEASURES[3:5] else m[k] for k in MEASURES}
    tests = []
    for rule in rules:
        top, under = RATIOS[rule.ratio]
        ratio = value[top] / F.greatest(value[under], F.lit(1)) if under else value[top].cast("double")
        bounds = [ratio < rule.low] * (rule.low is not None) + [ratio > rule.high] * (rule.high is not None)
        for bad in bounds:
            tests.append(F.when(bad, F.lit(rule.ratio)))
    failed = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    base = (value["n_words"] < BASE_WORDS) | (value["n_repeat_words"] * 100 > value["n_words"] * BASE_REPEAT_PERCENT)
    return _let(
        failed,
        lambda bad: F.struct(*(v.alias(k) for k, v in value.items()), base.alias("base_failed"), bad.alias("failed"), (~base & (F.size(bad) == 0)).alias("kept")),
    )


def evaluate(docs: DataFrame, *, text: str = "text", rules: Sequence[Rule] = DEFAULT_RULES, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """``docs`` and one struct column ``quality``: the measures of the whole text, ``base_failed``,
    ``failed`` (ratios of the table that are out of bounds) and ``kept`` (nothing fails). One projection
    without shuffle or user function.

    The base rule fails a text of under 50 words or with over half of them in repeated 3-word windows.
    A null or empty text has no words, so it fails; equal rows get equal results; an empty table stays
    empty; an input column of the name ``quality`` is replaced, others pass through."""
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.withColumn("quality", _let(_let(value, lambda t: _measures(t, stop_words)), lambda m: _verdict(m, rules)))
