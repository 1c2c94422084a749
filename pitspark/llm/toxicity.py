"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding maps case, homoglyphs, invisible characters and digits or signs that stand for letters to one
form. The lexicon's terms are word beginnings or whole words whose weight is the log odds of toxic
against clean labelled texts; phrases that only clean texts hold are exceptions that cancel the
terms inside them. The sum of weights is normalised by length and set against a fitted threshold.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.llm._io import cut
from pitspark.llm._text import slices

#: Used where labels give no lexicon, and beside it where no clean labelled text holds the term.
SEED_TERMS = ("idiot", "moron", "stupid", "loser", "scum", "worthless", "pathetic", "disgusting", "trash", "clown", "retard", "bastard", "bitch", "asshole", "fuck", "whore")
SEED_WEIGHT = 4.0
#: Labelled rows that the lexicon is fitted on at most, chosen by a hash of the key.
FIT_ROWS = 20_000
#: Lengths of word beginnings.
SHORTEST, LONGEST = 4, 10
#: A term needs this many toxic texts, this log odds, and this log likelihood ratio (chance: about 2e-5).
MIN_TEXTS, MIN_ODDS, MIN_EVIDENCE = 3, 3.0, 18.0
#: Texts are often copies. A term counts by the distinct pairs of words around it in toxic texts, of which
#: there must be this share of the toxic texts that hold it.
MIN_VARIETY = 0.3
#: Words that a text counts as at least when its sum is normalised.
LENGTH_FLOOR = 20

_ALIKE = {
    "a": "аαａ@4", "b": "Ььｂ", "c": "сϲｃ", "d": "ԁｄ", "e": "еεｅ3", "f": "ｆ", "g": "ɡｇ", "h": "һｈ", "i": "іıιｉl1|ӏｌ", "j": "јｊ", "k": "кκｋ", "m": "мｍ",
    "n": "ｎη", "o": "оοｏ0", "p": "рρｐ", "q": "ԛｑ", "r": "ｒг", "s": "ѕｓ$5", "t": "тτｔ7", "u": "υцｕ", "v": "νѵｖ", "w": "ԝωｗ", "x": "хχｘ", "y": "уγｙ", "z": "ｚ",
}
#: Signs that stand for a letter only inside a word.
_SIGNS = "@$|"
_INNER = re.compile(r"(?<=\w)[@$|](?=\w)|(?<!\S)[@$|](?=[^\W\d_])")
_INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"


class _Folds(dict):
    """For str.translate: a letter's form, None for invisible characters, a space for all that is no letter."""

    def __missing__(self, code: int) -> int | str | None:
        c = chr(code)
        self[code] = code if c.isalpha() or unicodedata.category(c) in ("Mn", "Mc") else " "
        return self[code]


_FOLDS = _Folds({ord(x): letter for letter, alike in _ALIKE.items() for x in alike if x not in _SIGNS} | {ord(x): None for x in _INVISIBLE})
_AS_LETTER = {ord(x): letter for letter, alike in _ALIKE.items() for x in alike if x in _SIGNS}


def fold(text: str) -> str:
    """Folded words between single or more spaces. ``l``, ``1`` and ``|`` become ``i``, so that either reading of a ``1`` matches."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    text = text.lower()
    if any(x in text for x in _SIGNS):
        text = _INNER.sub(lambda m: m[0].translate(_AS_LETTER), text)
    return f" {text.translate(_FOLDS)} "


@dataclass(frozen=True)
class Lexicon:
    """Weights of terms in folded form: " idio" is a word beginning, " idiot " a word. ``exceptions`` are
    folded phrases that cancel terms inside them; ``threshold`` is the normalised sum that scores 0.5."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    threshold: float = 0.02
    known: dict = field(default_factory=dict, compare=False)

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        a = ahocorasick.Automaton()
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), None))
        for term, weight in self.weights.items():
            a.add_word(term, (len(term), weight))
        a.make_automaton()
        return a


def density(folded: str, automaton: ahocorasick.Automaton | None) -> float:
    """The sum of weights of the terms outside exception phrases, over the number of words."""
    if automaton is None:
        return 0.0
    hits: list[tuple[int, int, float]] = []
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(folded):
        if weight is None:
            spared.append((end - size + 1, end))
        else:
            hits.append((end - size + 1, end, weight))
    if not hits:
        return 0.0
    total = sum(w for a, b, w in hits if not any(x <= a and b <= y for x, y in spared))
    return total / max(LENGTH_FLOOR, len(folded.split()))


def _terms(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        out.update(_terms_of(w))
    return out


def _terms_of(word: str) -> list[str]:
    """Beginnings of a word; words of three letters or very long ones count whole."""
    return [f" {word[:k]}" for k in range(SHORTEST, min(len(word), LONGEST) + 1)] + [f" {word} "] * (len(word) == 3 or len(word) > LONGEST)


def _evidence(t: int, c: int, toxic: int, clean: int) -> tuple[float, float]:
    """Log odds and log likelihood ratio of a term in t of ``toxic`` and c of ``clean`` texts."""
    odds = math.log((t + 0.5) / (toxic + 1) * (clean + 1) / (c + 0.5))
    p, both = (t + c) / (toxic + clean), 0.0
    for k, n in ((t, toxic), (c, clean)):
        for x, q in ((k, p), (n - k, 1 - p)):
            if x and n and q:
                both += x * math.log(x / (n * q))
    return odds, 2 * both


def _strong(t: int, c: int, toxic: int, clean: int) -> bool:
    odds, evidence = _evidence(t, c, toxic, clean)
    return t >= MIN_TEXTS and odds >= MIN_ODDS and evidence >= MIN_EVIDENCE


def select_terms(counts: Iterable[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """The most general terms that keep the evidence: of a chain of ever longer beginnings with nearly the
    same toxic texts the longest, and none that begins with a chosen term."""
    good = {}
    for term, t, c in counts:
        if _strong(t, c, toxic, clean):
            good[term] = t, _evidence(t, c, toxic, clean)[0]
    longest = set(good)
    for term, (t, _) in good.items():
        stem = term.rstrip(" ")
        for k in range(len(stem) - (term == stem), SHORTEST, -1):
            if (above := stem[:k]) in good and t >= 0.9 * good[above][0]:
                longest.discard(above)
    chosen: dict[str, float] = {}
    for term in sorted(longest, key=len):
        if not any(term[:k] in chosen for k in range(SHORTEST + 1, len(term))):
            chosen[term] = round(good[term][1], 6)
    return chosen


def cut_point(values: Sequence[tuple[float, int]]) -> float:
    """The density that best parts the labels by F1, half way between two neighbours; the lowest such."""
    positives = sum(y for _, y in values)
    ordered = sorted((x for x in values if x[0] > 0), reverse=True)
    best, at, hit = (-1.0, 0.0), 0, 0
    while at < len(ordered):
        x = ordered[at][0]
        while at < len(ordered) and ordered[at][0] == x:
            hit += ordered[at][1]
            at += 1
        f1 = 2 * hit / (positives + at) if positives + at else 0.0
        low = ordered[at][0] if at < len(ordered) else 0.0
        if f1 >= best[0]:
            best = f1, (x + low) / 2
    return best[1] or 0.02


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> Lexicon:
    """A lexicon from at most ``rows`` rows of ``labels`` (key and label; those of the smallest key hashes) and their
    texts; ``rows`` also bounds the terms and phrases that reach the driver, of which none is left out. Null labels and keys
    are left out, a text of several labels counts for each, equal texts of one label count once, and other columns may
    have any name; without toxic or clean texts, or of empty tables, the seed terms are the lexicon."""
    # the sample is bounded, so it can be broadcast
    sample = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), (F.col(f"`{label}`") > 0).cast("int").alias("y"))
    sample = sample.orderBy(F.xxhash64("key"), "key", "y").limit(rows)
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    picked = cut(texts.join(F.broadcast(sample), "key").select("text", "y").dropDuplicates())

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                found["", y] += 1
                found.update((t, y) for t in _terms(fold(text or "")))
        if found:
            keys = list(found)
            yield pa.RecordBatch.from_pydict({"term": [k[0] for k in keys], "y": pa.array([k[1] for k in keys], pa.int32()), "n": list(found.values())})

    counts = picked.mapInArrow(terms, "term string, y int, n long").groupBy("term").agg(F.sum(F.col("n") * F.col("y")).alias("t"), F.sum(F.col("n") * (1 - F.col("y"))).alias("c"))
    counts = counts.where(f"term = '' OR (t >= {MIN_TEXTS} AND t > c) OR term IN ({', '.join(repr(fold(w).rstrip()) for w in SEED_TERMS)})")
    counts = cut(counts)
    totals = counts.where("term = ''").first()
    toxic, clean = (totals["t"], totals["c"]) if totals else (0, 0)
    listed = {r["term"]: (r["t"], r["c"]) for r in counts.where("term <> ''").collect()}
    good = {k for k, (t, c) in listed.items() if toxic and clean and _strong(t, c, toxic, clean)}

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = set()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                words = ["", *fold(text or "").split(), ""] if y else []
                for before, w, after in zip(words, words[1:], words[2:], strict=False):
                    found.update((t, before, after) for t in _terms_of(w) if t in good)
        if found:
            yield pa.RecordBatch.from_pydict({k: list(v) for k, v in zip(("term", "before", "after"), zip(*found, strict=True), strict=True)})

    varied = picked.mapInArrow(contexts, "term string, before string, after string").distinct().groupBy("term").count()
    variety = {r["term"]: r["count"] for r in varied.collect()} if good else {}
    weights = select_terms(((k, min(listed[k][0], n), listed[k][1]) for k, n in variety.items() if n >= MIN_VARIETY * listed[k][0]), toxic, clean)
    for word in SEED_TERMS:
        stem = fold(word).rstrip()
        if not any(stem.startswith(k.rstrip(" ")) for k in weights) and not listed.get(stem, (0, 0))[1]:
            weights[stem] = SEED_WEIGHT
    if not (toxic and clean):
        return Lexicon(weights)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of words of which one begins with a term, and each text's density."""
        automaton = Lexicon(weights).automaton()
        for batch in batches:
            out: dict[str, list] = {"phrase": [], "y": [], "d": []}
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                folded = fold(text or "")
                d = density(folded, automaton)
                phrases = [""]
                if d:
                    words = folded.split()
                    hit = [any(f" {w} ".startswith(t) for t in weights) for w in words]
                    phrases += sorted({f" {a} {b} " for a, b, x, z in zip(words, words[1:], hit, hit[1:], strict=False) if x or z})
                for p in phrases:
                    out["phrase"].append(p)
                    out["y"].append(y)
                    out["d"].append(d)
            yield pa.RecordBatch.from_pydict({"phrase": out["phrase"], "y": pa.array(out["y"], pa.int32()), "d": pa.array(out["d"], pa.float64())})

    seen = cut(picked.mapInArrow(around, "phrase string, y int, d double"))
    spared = seen.where("phrase <> ''").groupBy("phrase").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")).where(f"t = 0 AND c >= {MIN_TEXTS}")
    exceptions = tuple(r["phrase"] for r in spared.orderBy("phrase").collect())
    densities = [(r["d"], r["y"]) for r in seen.where("phrase = ''").collect()]
    return Lexicon(weights, exceptions, cut_point(densities))


def score(docs: DataFrame, lexicon: Lexicon, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``score`` and ``predicted``: with density d of the whole text the score is d / (d + threshold), and
    1 is predicted from 0.5 on. A null or empty text scores 0; equal rows score alike; an empty table gives
    none; other columns are left out."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            for part in slices(batch, "text"):
                scores = []
                for text in part.column("text").to_pylist():
                    d = density(fold(text), automaton) if text else 0.0
                    scores.append(d / (d + lexicon.threshold))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=[key, "score", "predicted"])

    return docs.selectExpr(f"`{key}` AS key", f"cast(`{text}` AS string) AS text").mapInArrow(run, f"`{key}` {kind}, score double, predicted int")


def without_toxic(docs: DataFrame, lexicon: Lexicon, *, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not predicted toxic. No shuffle: rows pass through
    the scoring tasks whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            for part in slices(batch, text):
                values = part.column(text).to_pylist()
                d = [density(fold(x), automaton) if x else 0.0 for x in values]
                yield part.filter(pa.array([x / (x + lexicon.threshold) < 0.5 for x in d]))

    return docs.mapInArrow(run, docs.schema)
