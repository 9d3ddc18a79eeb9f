"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of 13 consecutive words of a benchmark item (a shorter item
is one pattern). Block shift tables skip positions where no pattern can end,
buckets by the last block select the patterns to test, and a direct comparison
confirms them. The benchmark is the query set: it is compiled in blocks of a
bounded number of windows and each block is broadcast; documents stream past it in
one pass a block, without a shuffle. After a pass its result is staged and its
broadcast given up, so one block is alive at a time.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, carried, python_batches, restored, stage, without

WINDOW = 13
#: Windows in one broadcast block of the benchmark.
BLOCK_WORDS = 1_000_000
#: Pattern lengths are searched in classes, so that one short pattern does not shorten every skip.
LENGTH_CLASSES = (13, 8, 4, 2, 1)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text: str | None) -> list[bytes]:
    """Words of a text after lower-casing A-Z, as UTF-8; none for null."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class WuManber:
    """Search of one length class. ``patterns``: word tuples of at least ``least`` words, each with its items."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]], least: int):
        self.least, self.block = least, min(2, least)
        self.default = least - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        #: Patterns by the last block of their least length, and by their first words.
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list]] = defaultdict(lambda: defaultdict(list))
        for p, items in patterns.items():
            for end in range(self.block, least + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.default), least - end)
            self.bucket[p[least - self.block : least]][p[: self.block]].append((p, items))
        self.bucket = {k: dict(v) for k, v in self.bucket.items()}

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """Start, end and items of each occurrence."""
        shift, default, block, back = self.shift, self.default, self.block, self.least - 1
        at, n = back, len(words)
        while at < n:
            key = tuple(words[at - block + 1 : at + 1])
            skip = shift.get(key, default)
            if skip:
                at += skip
                continue
            start = at - back
            for p, items in self.bucket[key].get(tuple(words[start : start + block]), ()):
                if tuple(words[start : start + len(p)]) == p:
                    yield start, start + len(p), items
            at += 1


def compiled(patterns: dict[tuple[bytes, ...], set[str]]) -> list[WuManber]:
    """One searcher for each length class that has patterns."""
    classes: dict[int, dict] = defaultdict(dict)
    for p, items in patterns.items():
        classes[next(c for c in LENGTH_CLASSES if c <= len(p))][p] = items
    return [WuManber(found, least) for least, found in classes.items()]


def pattern_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[list[WuManber]]:
    """Compiled blocks of the benchmark; the driver holds one at a time. A null id is listed as the empty string."""
    patterns: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").toLocalIterator():
        words = item_words(row["text"])
        for start in range(max(1, len(words) - window + 1) if words else 0):
            patterns[tuple(words[start : start + window])].add(row["item_id"])
            if len(patterns) >= block_words:
                yield compiled(patterns)
                patterns = defaultdict(set)
    yield compiled(patterns)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, sorted and apart."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))), T.StructField("hit_items", T.ArrayType(T.StringType()))])


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (word positions, half open, apart) and ``hit_items`` (sorted).

    Whole texts are searched. Null and empty texts have no words and no hits, as
    has everything where the benchmark is empty. Rows that repeat an id are
    searched alike; own columns of these three names are replaced.
    """
    python_batches(docs.sparkSession)
    docs = without(docs, *_FOUND.names)
    out, old = docs, None
    for searchers in pattern_blocks(benchmark, window, block_words):
        if old is not None:  # another block follows
            out = stage(out, "benchmark-hits")
            old.unpersist()
        known = old = docs.sparkSession.sparkContext.broadcast(searchers)

        def search(batches, known=known):
            for batch in batches:
                names = batch.schema.names
                old_spans = batch.column("hit_spans").to_pylist() if "hit_spans" in names else None
                old_items = batch.column("hit_items").to_pylist() if old_spans is not None else None
                counts, spans, items = [], [], []
                for k, text in enumerate(batch.column("text").to_pylist()):
                    words = item_words(text)
                    hits = [(s["start"], s["end"]) for s in old_spans[k]] if old_spans else []
                    ids = set(old_items[k]) if old_items else set()
                    for searcher in known.value:
                        for start, end, its in searcher.find(words):
                            hits.append((start, end))
                            ids |= its
                    counts.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in merged(hits)])
                    items.append(sorted(ids))
                kept = batch.select([x for x in names if x not in _FOUND.names])
                yield append_arrow(kept, n_words=pa.array(counts, pa.int64()), hit_spans=pa.array(spans, _SPANS), hit_items=pa.array(items, pa.list_(pa.string())))

        out = out.mapInArrow(search, T.StructType([*docs.schema.fields, *_FOUND.fields]))
    return out


def n_hit() -> Column:
    """Words inside hit spans."""
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def is_contaminated() -> Column:
    """At least one word in twenty is inside an occurrence."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns alone."""
    found = benchmark_hits(carried(docs, "doc_id", "text"), benchmark, **options)
    return found.filter(~is_contaminated()).select(*restored(docs, "doc_id", "text"))
