"""Toxicity by a weighted lexicon matched with Aho-Corasick over folded text.

Texts are lower-cased, homoglyphs and digit substitutions are folded, and what is
not a letter becomes one blank. Lexicon entries are whole words (" idiot ") or
word beginnings (" achlich"), with weights learned from labels; exception phrases
cancel the entries they cover. The weights found in a text, also normalised by
its length, give the score through a logistic curve.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, python_batches, stage, without

#: Letters of other scripts that look like Latin ones, and signs used for letters.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ո": "n", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ο": "o", "ι": "i", "ν": "v", "ρ": "p", "τ": "t", "κ": "k", "υ": "u", "ε": "e", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "€": "e"}
INVISIBLE = "​‌‍⁠﻿­"
_FULLWIDTH = {0xFF01 + i: 0x21 + i for i in range(94)}
_TABLE = _FULLWIDTH | {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord(c): None for c in INVISIBLE}
_INNER = re.compile(r"(?<=[^\W\d_])[0-9@$!€]+(?=[^\W\d_])|(?<![^\W\d_])[0134579@$]{1,2}(?=[^\W\d_][^\W_])")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_DIGIT_TABLE = {ord(k): v for k, v in DIGITS.items()}

#: Rows with labels that the weights and the curve are fitted on, at most; chosen by a hash of the id.
FIT_ROWS = 24_000
#: Entries need so many toxic documents, so much log odds, and so large a likelihood ratio (twice its log).
MIN_TOXIC, MIN_WEIGHT, MIN_G2 = 5, 1.2, 24.0
#: Letters of word beginnings that can be entries.
PREFIX_LETTERS = range(4, 9)
#: A phrase with an entry is an exception if so many fitted documents hold it and less than this share is toxic.
MIN_PHRASE, MAX_PHRASE_TOXIC = 4, 0.25


def folded(text: str | None) -> str:
    """Letters of a text by word, one blank around each; an empty text gives one blank."""
    if not text:
        return " "
    text = text.lower().translate(_TABLE)
    text = _INNER.sub(lambda m: m[0].translate(_DIGIT_TABLE), text)
    return f" {_NOT_LETTERS.sub(' ', text).strip()} "


@dataclass
class Lexicon:
    """Weighted entries, exception phrases, and the logistic curve over the features."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, ...] = (-3.0, 1.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (entry, weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (phrase, None))
        if len(found):
            found.make_automaton()
        return found

    def matches(self, text: str, automaton) -> list[tuple[int, float]]:
        """Start and weight of the heaviest entry at each word of a folded text, less what exceptions cover."""
        best: dict[int, float] = {}
        covered: list[tuple[int, int]] = []
        if len(automaton):
            for end, (entry, weight) in automaton.iter(text):
                start = end - len(entry) + 1
                if weight is None:
                    covered.append((start, end))
                elif weight > best.get(start, 0.0):
                    best[start] = weight
        return [(s, w) for s, w in best.items() if not any(a <= s < b for a, b in covered)] if covered else list(best.items())

    def features(self, text: str, automaton) -> tuple[float, float, float]:
        """Heaviest weight, log of the sum, and the sum per square root of words."""
        found = [w for _, w in self.matches(text, automaton)]
        total = sum(found)
        return (max(found, default=0.0), math.log1p(total), total / math.sqrt(max(1, text.count(" ") - 1)))

    def score(self, features: tuple[float, float, float]) -> float:
        z = self.curve[0] + sum(a * b for a, b in zip(self.curve[1:], features, strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _entries(text: str) -> set[str]:
    """Candidate entries of a folded text: its words whole and their beginnings."""
    words = set(text.split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:k]}" for w in words for k in PREFIX_LETTERS if len(w) > k}


def _document_counts(rows: DataFrame, listed) -> DataFrame:
    """``entry, toxic, n``: documents of each label that hold each entry that ``listed`` makes of a folded text."""

    def counted(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts.update((e, toxic) for e in listed(folded(text)))
        keys = list(counts)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"entry": pa.array([k[0] for k in part], pa.string()), "toxic": pa.array([k[1] for k in part], pa.int32()), "n": pa.array([counts[k] for k in part], pa.int64())})

    return rows.mapInArrow(counted, "entry string, toxic int, n long").groupBy("entry").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))


def _likelihood_ratio(t: int, toxic: int, c: int, clean: int) -> float:
    """Twice the log likelihood ratio of an entry's share in toxic and in clean documents being two, not one."""
    part = lambda k, n, p: (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)
    both = (t + c) / (toxic + clean)
    return 2 * (part(t, toxic, t / toxic) + part(c, clean, c / clean) - part(t, toxic, both) - part(c, clean, both))


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Lexicon:
    """Fit a lexicon on at most ``rows`` labelled documents (``labels``: ``doc_id, toxic``).

    The sample is by a hash of the id, so it is the same in each run; its texts are
    staged once and all counts are taken from there. Counting runs
    on executors; the driver gets what the sample bounds: entries seen in its toxic
    documents and three numbers a row. Null labels and texts are left out. Without
    toxic rows the lexicon is empty and all scores are low and alike.
    """
    python_batches(docs.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    if total > rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * 0.97 * rows / total))
    fit = stage(docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(known), "doc_id").select("text", "toxic"), "toxicity-fit")
    size = {r["toxic"]: r["count"] for r in fit.groupBy("toxic").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, [], (math.log((toxic + 0.5) / (clean + 0.5)) if toxic else -3.0, 0.0, 0.0, 0.0))
    spark = docs.sparkSession
    seen = [r["entry"] for r in _document_counts(fit.filter("toxic = 1"), _entries).filter(F.col("t") >= MIN_TOXIC).select("entry").collect()]
    wanted = spark.sparkContext.broadcast(frozenset(seen))
    weights: dict[str, float] = {}
    for r in _document_counts(fit, lambda t: _entries(t) & wanted.value).collect():
        odds = math.log((r["t"] + 0.5) / (toxic + 1)) - math.log((r["c"] + 0.5) / (clean + 1))
        if r["t"] >= MIN_TOXIC and odds >= MIN_WEIGHT and _likelihood_ratio(r["t"], toxic, r["c"], clean) >= MIN_G2:
            weights[r["entry"]] = odds
    plain = Lexicon(weights)
    entries = spark.sparkContext.broadcast(plain)

    def phrases(text: str) -> set[str]:
        words = text.split()
        w = entries.value.weights
        known = {x for x in set(words) if f" {x} " in w or any(f" {x[:k]}" in w for k in PREFIX_LETTERS)}
        return {f" {a} {b} " for a, b in zip(words, words[1:]) if a in known or b in known}

    common = _document_counts(fit, phrases).filter((F.col("t") + F.col("c") >= MIN_PHRASE) & (F.col("t") < MAX_PHRASE_TOXIC * (F.col("t") + F.col("c"))))
    lexicon = Lexicon(weights, [r["entry"] for r in common.select("entry").collect()])
    lexicon.curve = _fitted_curve(fit, lexicon)
    return lexicon


def _fitted_curve(fit: DataFrame, lexicon: Lexicon) -> tuple[float, ...]:
    """Ridge logistic regression on the features of the bounded sample."""
    shared = fit.sparkSession.sparkContext.broadcast(lexicon)

    def features(batches):
        automaton = shared.value.automaton()
        for batch in batches:
            rows = [shared.value.features(folded(t), automaton) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"a": [r[0] for r in rows], "b": [r[1] for r in rows], "c": [r[2] for r in rows], "y": pa.array(batch.column("toxic").to_pylist(), pa.int32())})

    table = fit.mapInArrow(features, "a double, b double, c double, y int").toPandas()
    x = np.column_stack([np.ones(len(table)), table[["a", "b", "c"]].to_numpy()])
    y, w = table["y"].to_numpy(float), np.zeros(4)
    ridge = np.diag([1e-6, 0.5, 0.5, 0.5])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score_texts(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` with ``tox_score`` (0 to 1) of each whole text.

    Null and empty texts match nothing and get the curve's value at zero; repeated
    rows score alike. The lexicon is bounded by the rows it was fitted on.
    """
    python_batches(docs.sparkSession)
    docs = without(docs, "tox_score")
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def scored(batches):
        lexicon = shared.value
        automaton = lexicon.automaton()
        for batch in batches:
            yield append_arrow(batch, tox_score=pa.array([lexicon.score(lexicon.features(folded(t), automaton)) for t in batch.column("text").to_pylist()], pa.float64()))

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField("tox_score", T.DoubleType())]))

