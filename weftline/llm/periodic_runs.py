"""Periodic runs of words by the branching-tandem test on an enhanced suffix array.

The words of a batch of texts are one array of integers in which each text has an
alphabet of its own, so its suffix array is those of the texts side by side and no
common prefix leaves a text. Prefix doubling sorts it; the ranks of each doubling are
kept and give the longest common prefixes of neighbours. For each LCP interval of
depth d, the suffixes of all but its largest child are looked up: where the suffix d
words on, or d words back, lies in another child of the interval, a square of root
length d begins that cannot be rotated to the right. Rotated to the left as far as it
goes it is a run. There are no tree nodes: intervals are places of the LCP array.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, let, python_batches, without, words

#: Words of the texts that are sorted together (a longer text is sorted by itself).
GROUP_WORDS = 1 << 18
#: Words and periods that a run needs.
MIN_LENGTH, MIN_PERIODS = 24, 3


def suffix_ranks(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Suffix array, the ranks by the first 1, 2, 4, ... symbols, and for each place the level that parts it from the one before.

    Ranks have one entry more, the end. A class of equal prefixes has the place of its
    first suffix as rank; classes of one suffix are settled and left out of later
    levels. The last level has only those.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable").astype(np.int64)
    held = symbols[order]
    new = np.ones(n, bool)
    new[1:] = held[1:] != held[:-1]
    parted = np.where(new, 0, -1).astype(np.int8)
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels = [rank]
    step, level = 1, 0
    while True:
        # a place is open if it, or the next one, goes on the class before it
        grown = parted < 0
        open_ = np.flatnonzero(grown | np.append(grown[1:], False))
        if not len(open_):
            return order, levels, parted
        level += 1
        at = order[open_]
        first, second = rank[at], rank[np.minimum(at + step, n)]
        sorted_ = np.lexsort((second, first))
        at, first, second = at[sorted_], first[sorted_], second[sorted_]
        order[open_] = at
        split = np.ones(len(at), bool)
        split[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        here = open_[split]
        parted[here[parted[here] < 0]] = level
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(split, open_, 0))
        levels.append(rank)
        step *= 2


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], parted: np.ndarray) -> np.ndarray:
    """Longest common prefix of each place and the one before; 0 for the first."""
    lcp = np.zeros(len(order), np.int64)
    known = parted > 0
    lcp[known] = 1 << (parted[known].astype(np.int64) - 1)
    for k in range(len(levels) - 3, -1, -1):
        asked = np.flatnonzero(parted > k + 1)
        same = levels[k][order[asked] + lcp[asked]] == levels[k][order[asked - 1] + lcp[asked]]
        lcp[asked[same]] += 1 << k
    return lcp


def _bounds(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place: the one before that is not deeper, the one before that is shallower, the next that is shallower."""
    n = len(lcp)
    not_deeper, shallower, ends = [0] * n, [0] * n, [n] * n
    depth, stack = lcp.tolist(), [0]
    for k in range(1, n):
        d = depth[k]
        while depth[stack[-1]] > d:
            ends[stack.pop()] = k
        top = stack[-1]
        not_deeper[k] = top
        shallower[k] = top if depth[top] < d else shallower[top]
        stack.append(k)
    return np.array(not_deeper), np.array(shallower), np.array(ends)


def branching_squares(order: np.ndarray, rank: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and root lengths of the squares that are not followed by their own next symbol.

    ``lcp`` has to begin with 0. A child of an interval ends before each place of the
    interval's depth; the last one ends with it.
    """
    not_deeper, shallower, ends = _bounds(lcp)
    inner = np.flatnonzero(lcp > 0)
    # the last place of each interval: the next one that is not deeper is shallower
    follows = np.zeros(len(lcp), bool)
    follows[not_deeper[inner][lcp[not_deeper[inner]] == lcp[inner]]] = True
    last = inner[~follows[inner]]
    low = np.concatenate([not_deeper[inner], last])
    high = np.concatenate([inner, ends[last]])
    at = np.concatenate([inner, last])
    depth, left, right = lcp[at], shallower[at], ends[at]
    # the largest child of each interval is left out
    by = np.lexsort((low, high - low, depth, left))
    largest = np.ones(len(by), bool)
    largest[:-1] = (left[by][1:] != left[by][:-1]) | (depth[by][1:] != depth[by][:-1])
    small = by[~largest]
    sizes = (high - low)[small]
    child = np.repeat(small, sizes)
    place = np.arange(len(child)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[child]
    found = []
    for sign in (1, -1):
        other = order[place] + sign * depth[child]
        there = (other >= 0) & (other < len(rank) - 1)
        where = rank[np.where(there, other, 0)]
        branching = there & (where >= left[child]) & (where < right[child]) & ((where < low[child]) | (where >= high[child]))
        found.append((np.minimum(order[place], other)[branching], depth[child][branching]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _least_agreement(min_length: int, min_periods: int) -> int:
    """What two suffixes with the first symbol of any square of a run agree in at least.

    Of a run of length n and period q the first suffix with a given symbol begins
    within a period of its start, and at least ``min_periods`` periods before its end.
    """
    within = (max(min_length - 2 * q + 1, (min_periods - 1) * q) for q in range(1, min_length // min_periods + 1))
    return min([(min_periods - 1) * (min_length // min_periods + 1), *within])


def _deep(order: np.ndarray, rank: np.ndarray, lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of those first symbols for which two agree in ``least`` symbols, as an array of their own; -1 is the rank of the others."""
    begins = np.flatnonzero(lcp == 0)
    deep = np.repeat(np.maximum.reduceat(lcp, begins) >= least, np.diff(np.append(begins, len(lcp))))
    place = np.where(deep, np.cumsum(deep) - 1, -1)
    return order[deep], np.append(place[rank[:-1]], -1), lcp[deep]


def runs_of(symbols: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all runs of at least ``min_length`` symbols and ``min_periods`` periods, by start and period.

    Intervals are looked through only below first symbols for which two suffixes agree
    as far as they do in a run of this length.
    """
    none = np.zeros(0, np.int64)
    if len(symbols) < max(min_length, min_periods):
        return none, none, none
    order, levels, parted = suffix_ranks(symbols)
    lcp = common_prefixes(order, levels, parted)
    order, rank, lcp = _deep(order, levels[-1], lcp, _least_agreement(min_length, min_periods))
    if not len(order):
        return none, none, none
    start, period = branching_squares(order, rank, lcp)
    end = start + 2 * period
    # rotate to the left by blocks of a power of two as long as both ends have equal blocks
    for k in range(len(levels) - 2, -1, -1):
        back = start - (1 << k)
        asked = np.flatnonzero(back >= 0)
        same = levels[k][back[asked]] == levels[k][(back + period)[asked]]
        start[asked[same]] -= 1 << k
    length = end - start
    long_ = length >= np.maximum(min_length, min_periods * period)
    start, length, period = start[long_], length[long_], period[long_]
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    # squares of a multiple of the period end in the same run
    first = np.ones(len(by), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        change[s + q] += 1
        change[s + length] -= 1
    return np.cumsum(change)[:n] == 0


class _Numbers(dict):
    """Numbers by word in the order in which words come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def _numbered(texts: list[list[bytes]]) -> np.ndarray:
    """One array for the words of all texts; equal numbers are equal words of one text."""
    ids = _Numbers()
    flat = np.fromiter(map(ids.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
    return flat + len(ids) * np.repeat(np.arange(len(texts)), [len(w) for w in texts])


def runs_of_texts(texts: list[list[bytes]], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, as words of it: ``(start, length, period)`` by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    at = 0
    while at < len(texts):
        to, total = at + 1, len(texts[at])
        while to < len(texts) and total + len(texts[to]) <= GROUP_WORDS:
            total += len(texts[to])
            to += 1
        ends = np.cumsum([len(w) for w in texts[at:to]])
        start, length, period = runs_of(_numbered(texts[at:to]), min_length, min_periods)
        which = np.searchsorted(ends, start, "right")
        before = np.concatenate([[0], ends])[which]
        for k, s, n, q in zip(which.tolist(), (start - before).tolist(), length.tolist(), period.tolist(), strict=True):
            out[at + k].append((s, n, q))
        at = to
    return out


RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (array of ``start, length, period`` in words) and ``collapsed_text``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. A run has the smallest period
    given, at least ``min_length`` words and ``min_periods`` periods, and no neighbouring
    word goes on with it. ``collapsed_text`` has the words that no run holds after its
    first period, joined by one blank. Null and empty texts have no words, no runs and
    an empty collapsed text. Repeated rows are alike; own columns of the three names are
    replaced, all others kept. No shuffle: rows of a batch are worked on together.
    """
    if min_length < 2 or min_periods < 2:
        raise ValueError("a run has at least two words and two periods")
    python_batches(docs.sparkSession)
    docs = without(docs, "n_words", "runs", "collapsed_text")
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def found(batches):
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column("text").to_pylist()]
            runs = runs_of_texts(texts, min_length, min_periods)
            collapsed = [b" ".join(w if not r else [x for x, keep in zip(w, kept_words(len(w), r).tolist(), strict=True) if keep]) for w, r in zip(texts, runs, strict=True)]
            named = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
            yield append_arrow(batch, n_words=pa.array([len(w) for w in texts], pa.int64()), runs=pa.array(named, kind), collapsed_text=pa.array(collapsed, pa.binary()).cast(pa.string()))

    added = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUN), T.StructField("collapsed_text", T.StringType())]
    return docs.mapInArrow(found, T.StructType([*docs.schema.fields, *added]))


def greatest_run(runs: Column) -> Column:
    """The run of the greatest ``length / period``, compared as fractions; the first by start and period of equal ones; null for none."""
    return F.aggregate(runs, F.get(runs, 0), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def planted(text: Column, doc_id: Column) -> Column:
    """The text with a periodic end in a tenth of the documents, chosen and shaped by the crc32 of the id.

    From word ``a`` on, each word becomes the one at the same place of the period; ids
    and texts that are null stay as they are.
    """
    code = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(code / 10).cast("long")

    def shaped(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.when(n > 0, F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.element_at(w, (a + F.greatest(i - a, F.lit(0)) % p + 1).cast("int")))), " ")).otherwise(text)

    return F.when(code % 10 == 0, let(words(text), shaped)).otherwise(text)
