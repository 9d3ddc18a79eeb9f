"""Packing by lexical retrieval: a sharded BM25 index gives each seed document unused neighbours, which fill its window.

Documents become token ids, which are the terms of the index too; their document
frequencies over the whole corpus are at most one row a token. Documents are dealt by
a term that weighs much in them, so that near texts meet, and each task cuts what it
gets into shards with an inverted index each. In a shard each document in turn seeds a
window; neighbours go in by falling score, the last one is cut where the window ends,
and its rest stays for other windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_batches, stage
from .wavelet import word_encoder

#: Saturation of a term's count and share of length in it.
K1, B = 1.2, 0.75
#: Terms of a seed that ask, those that weigh most; neighbours that are ranked at first.
QUERY_TERMS, NEIGHBOURS = 32, 16
#: Tokens and documents after which a shard is closed; tokens a partition is made for, and the most partitions (they grow instead).
SHARD_TOKENS, SHARD_DOCS = 1 << 20, 1 << 15
PARTITION_TOKENS, MOST_PARTITIONS = 1 << 22, 20_000
#: Ids are below this.
VOCABULARY = 1 << 16

PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, seed boolean, ids binary"


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``doc_id, n_tokens, topic, ids`` (16-bit integers): the library's ids of each text and ``end_id`` after them.

    A task closes with a row of -1 tokens whose ``ids`` are the number of its documents
    that have each term (32-bit integers), so that texts are read once.
    """
    end = np.array([end_id], "<u2").tobytes()

    def encode(batches):
        encoder, frequency = word_encoder(path), np.zeros(VOCABULARY, "<u4")
        for batch in batches:
            ids = [encoder.encode(t) + end for t in batch.column("text").to_pylist()]
            topics = []
            for x in ids:
                terms, counts = term_counts(np.frombuffer(x, "<u2"))
                frequency[terms] += 1
                topics.append(topic(terms, counts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(topics, pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "topic", "ids"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([-1], pa.int32()), pa.array([frequency.tobytes()])], names=["doc_id", "n_tokens", "topic", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, n_tokens long, topic int, ids binary")


def term_counts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids before the end id, ascending, and how often each occurs."""
    held = np.sort(ids[:-1], kind="stable")
    n = len(held)
    if not n:
        return held, np.zeros(0, np.int64)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(held[1:], held[:-1], out=new[1:])
    starts = new.nonzero()[0]
    counts = np.empty(len(starts), np.int64)
    counts[-1] = n - starts[-1]
    np.subtract(starts[1:], starts[:-1], out=counts[:-1])
    return held[starts], counts


def topic(terms: np.ndarray, counts: np.ndarray) -> int:
    """The term that weighs most by its count and its place in the vocabulary, where frequent ones come first; -1 for none.

    It only says which shard a document goes to, and is known before the corpus is counted.
    """
    return int(terms[np.argmax(np.log1p(terms.astype(float)) * counts / (counts + K1))]) if len(terms) else -1


class Weights:
    """BM25 weights by the statistics of the whole corpus."""

    def __init__(self, n_docs: int, n_tokens: int, frequency: np.ndarray):
        self.n_tokens = n_tokens
        self.idf = np.log1p((n_docs - frequency + 0.5) / (frequency + 0.5))
        self.mean_length = max(1.0, n_tokens / max(1, n_docs))

    def of(self, terms: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
        return self.idf[terms] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * length / self.mean_length))


def corpus_weights(tokens: DataFrame) -> Weights:
    """Weights by the documents that have each term, summed over the tasks' own counts: one row a token comes to the driver."""

    def unpacked(batches):
        found = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            for counts in batch.column("ids").to_pylist():
                found += np.frombuffer(counts, "<u4")
        terms = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int32)), pa.array(found[terms])], names=["term", "n"])

    frequency = np.zeros(VOCABULARY, np.int64)
    for row in tokens.filter("n_tokens < 0").select("ids").mapInArrow(unpacked, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        frequency[row["term"]] = row["n"]
    n_docs, n_tokens = tokens.filter("n_tokens >= 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    return Weights(n_docs, n_tokens, frequency)


class Index:
    """The inverted index of a shard: postings of a term are the documents that have it, and its weight in each."""

    def __init__(self, docs: list[np.ndarray], weights: Weights):
        found = [term_counts(ids) for ids in docs]
        sizes = np.array([len(t) for t, _ in found])
        terms = np.concatenate([t for t, _ in found])
        weight = np.concatenate([weights.of(t, c, len(ids)) for (t, c), ids in zip(found, docs, strict=True)])
        self.n, self.begins = len(docs), np.concatenate([[0], np.cumsum(sizes)])
        self.terms, self.weights = terms, weight
        by = np.argsort(terms, kind="stable")
        self.docs, self.posted = np.repeat(np.arange(self.n), sizes)[by], weight[by]
        self.places = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=VOCABULARY))])

    def scores(self, doc: int) -> np.ndarray:
        """BM25 score of each document for the terms that weigh most in ``doc``."""
        own = slice(self.begins[doc], self.begins[doc + 1])
        terms, weights = self.terms[own], self.weights[own]
        if len(terms) > QUERY_TERMS:
            terms = terms[np.argpartition(weights, -QUERY_TERMS)[-QUERY_TERMS:]]
        if not len(terms):
            return np.zeros(self.n)
        begins, ends = self.places[terms], self.places[terms.astype(np.int64) + 1]
        sizes = ends - begins
        at = np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
        return np.bincount(self.docs[at], self.posted[at], self.n)

    def neighbours(self, doc: int, left: np.ndarray) -> Iterator[int]:
        """Documents with tokens left, but not ``doc``, by falling score, then place; those without a common term come last."""
        scores = np.where(left > 0, self.scores(doc), -1.0)
        scores[doc] = -1.0
        for _ in range(NEIGHBOURS):
            best = int(scores.argmax())
            if scores[best] < 0:
                return
            yield best
            scores[best] = -1.0
        rest = np.flatnonzero(scores >= 0)
        yield from rest[np.lexsort((rest, -scores[rest]))].tolist()


def pack_shard(docs: list[np.ndarray], weights: Weights, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces ``(document, start, length)`` that hold each token once.

    All sequences have ``window`` tokens, but the tokens that are left at the end are
    cut into sequences of falling powers of two.
    """
    index = Index(docs, weights)
    left, size = np.array([len(d) for d in docs]), [len(d) for d in docs]
    out: list[list[tuple[int, int, int]]] = []

    def take(doc: int, n: int) -> tuple[int, int, int]:
        start = size[doc] - int(left[doc])
        left[doc] -= n
        return doc, start, n

    for seed in range(len(docs)):
        while left[seed] >= window:
            out.append([take(seed, window)])
        if not left[seed]:
            continue
        space = window - int(left[seed])
        out.append([take(seed, int(left[seed]))])
        for doc in index.neighbours(seed, left):
            n = min(space, int(left[doc]))
            out[-1].append(take(doc, n))
            space -= n
            if not space:
                break
        if space:
            out += powers_of_two(out.pop())
    return out


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces in order as sequences whose lengths are the powers of two in their sum, the greatest first."""
    total, waiting, out = sum(n for *_, n in pieces), pieces[::-1], []
    while total:
        space = 1 << (total.bit_length() - 1)
        total -= space
        out.append([])
        while space:
            doc, start, n = waiting.pop()
            out[-1].append((doc, start, min(n, space)))
            if n > space:
                waiting.append((doc, start + space, n - space))
            space -= min(n, space)
    return out


def pack(docs: DataFrame, path: str, end_id: int = 0, window: int = 1024) -> DataFrame:
    """Pieces of all documents in sequences of ``window`` tokens.

    ``doc_id, start, length, doc_tokens, sequence_id, offset, seed, ids``: ``start`` are the document's
    tokens before the piece, ``offset`` those of its sequence, ``seed`` marks the piece that asked for the
    others, ``ids`` are little-endian unsigned 32-bit integers. ``path`` is of a
    ``tokenizer.json`` file with ids below 65,536 that executors can read.

    Each token lies in one piece. A sequence is shorter than the window only at the end of a
    shard, where lengths are powers of two; none needs padding then. Null and empty texts are the end id
    alone, and go where there is space. Ids are whole numbers. Rows that repeat an id are documents of their own, null
    ids are kept. Further columns are not read; an empty table gives no rows. Order in a
    task is by topic, id and tokens, so a task that runs again packs alike.
    """
    if window < 1:
        raise ValueError("a window has at least one token")
    spark = docs.sparkSession
    python_batches(spark)
    tokens = stage(encoded(docs, path, end_id), "packing-tokens")
    weights = corpus_weights(tokens)
    shared = spark.sparkContext.broadcast(weights)
    parts = int(min(MOST_PARTITIONS, max(1, weights.n_tokens // PARTITION_TOKENS)))

    def packed(batches):
        sequence = TaskContext.get().partitionId() << 33
        names, held, total = [], [], 0

        def emit():
            nonlocal sequence
            rows = []
            for pieces in pack_shard(held, shared.value, window):
                offset = 0
                for k, (doc, start, n) in enumerate(pieces):
                    rows.append((names[doc], start, n, len(held[doc]), sequence, offset, k == 0, held[doc][start : start + n].astype("<u4").tobytes()))
                    offset += n
                sequence += 1
                if len(rows) >= 4096:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

        for batch in batches:
            for name, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                names.append(name)
                held.append(np.frombuffer(ids, "<u2"))
                total += len(held[-1])
                if total >= SHARD_TOKENS or len(held) >= SHARD_DOCS:
                    yield from emit()
                    names, held, total = [], [], 0
        if held:
            yield from emit()

    order = ["topic", "doc_id", "ids"]
    ranged = tokens.filter("n_tokens >= 0").repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
    return ranged.mapInArrow(packed, PIECE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [c.split(" ") for c in PIECE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], names=[name for name, _ in fields])
