"""Language-model scores by prediction by partial matching over the bytes of whole texts.

A text is one stream of bytes: its words, lower-cased, each closed by one blank, and
an end. A byte is predicted from up to five bytes before it, over blanks and words,
in a context trie: escape probabilities follow the number of distinct symbols of a
context (method D), symbols of a longer context are excluded in the shorter ones,
and a shorter context counts in how many longer ones a symbol was seen (update
exclusion). The code length is of the trained trie, documents learnt from included.

The trie is never in one place. Documents are packed in chunks; a chunk's distinct
(context, symbol) keys are dealt by hash over parts, which add up the chunks'
counts. The corpus' distinct keys are then dealt by the last three bytes of their
context over buckets, where all that predicts them is local but for the contexts
of two bytes and less (at most 2**24 counts, broadcast). Answers go back the same
way. Frequent contexts are thus split before they are counted, and a bucket holds
what is distinct, not with the corpus; the numbers of parts and buckets follow the number
of chunks, so tasks stay of one size. All training bytes count; nothing is
pruned. Words, for the base score, travel with the keys as 64-bit hashes.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, python_batches, stage

#: Bytes of context; with the symbol a key is at most one 64-bit number.
ORDER = 5
#: Bytes of context that name a bucket; shorter contexts are broadcast.
LOCAL = 3
#: Bytes of text in a chunk, about, and bytes whose keys are sorted at a time.
CHUNK_BYTES, BLOCK_BYTES = 16 << 20, 4 << 20
#: Chunks to a bucket of contexts.
BUCKET_CHUNKS = 4
#: A tab cannot be in a stream; it stands before its beginning. A blank is before the first word and closes words.
_PAD, _BLANK, _END = 9, 32, 10
_MASKS = [np.uint64((1 << (8 * (k + 1))) - 1) for k in range(8)]


def _squeezed(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _spread(data: pa.Scalar | bytes, dtype) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data if isinstance(data, bytes) else data.as_py()), dtype)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, compressed a byte of the number at a time."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return _squeezed(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T))


def _read_keys(data: pa.Scalar) -> np.ndarray:
    planes = _spread(data, np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def text_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text after lower-casing A-Z; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hash(words) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64)


_CHUNKS = "chunk long, doc_ids array<long>, held array<boolean>, n_tokens array<long>, sizes array<long>, data binary, words binary, word_counts binary"


def packed(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of documents: ids, the streams one after another, and the hashes of their words (the empty word is the end).

    ``word_counts`` are the words' occurrences in documents that are not ``held``.
    """

    def chunks(batches):
        from pyspark import TaskContext

        base, seq = TaskContext.get().partitionId() << 32, 0

        def begin():
            return Counter(), set(), [], [], [], [], 0

        learnt, others, ids, held, sizes, streams, size = begin()

        def row():
            words = [*learnt, *(others - learnt.keys())]
            counts = np.zeros(len(words), np.int64)
            counts[: len(learnt)] = list(learnt.values())
            hashes, at = np.unique(word_hash(words), return_inverse=True)
            counts = np.bincount(at, weights=counts, minlength=len(hashes)).astype(np.int64)
            data = b"".join(streams)
            lengths = [len(s) for s in streams]
            return pa.RecordBatch.from_pydict({"chunk": pa.array([base + seq], pa.int64()), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "held": pa.array([held], pa.list_(pa.bool_())), "n_tokens": pa.array([sizes], pa.list_(pa.int64())), "sizes": pa.array([lengths], pa.list_(pa.int64())), "data": pa.array([_squeezed(np.frombuffer(data, np.uint8))], pa.binary()), "words": pa.array([_packed_keys(hashes)], pa.binary()), "word_counts": pa.array([_squeezed(counts)], pa.binary())})

        for batch in batches:
            for doc, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = text_words(text)
                words.append(b"")
                streams.append(b" ".join(words) + b"\n")
                (others if out else learnt).update(words)
                ids.append(doc)
                held.append(out)
                sizes.append(len(words))
                size += len(streams[-1]) + 16
                if size >= chunk_bytes:
                    yield row()
                    seq += 1
                    learnt, others, ids, held, sizes, streams, size = begin()
        if ids:
            yield row()

    return docs.mapInArrow(chunks, _CHUNKS)


def stream_keys(data: np.ndarray, sizes: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Keys (``order`` bytes of context, then the symbol) of all bytes of the streams of ``sizes`` bytes in ``data``."""
    head = order + 1
    place = np.arange(len(data)) + np.repeat(head * np.arange(1, len(sizes) + 1), sizes)
    padded = np.full(len(data) + head * len(sizes), _PAD, np.uint8)
    padded[place] = data
    padded[np.cumsum(sizes) - sizes + head * np.arange(1, len(sizes) + 1) - 1] = _BLANK
    keys = np.zeros(len(padded) - order, np.uint64)
    for back in range(order, -1, -1):
        keys = (keys << np.uint64(8)) | padded[order - back : len(padded) - back]
    return keys[place - order]


def _blocks(sizes: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Runs of streams of about ``BLOCK_BYTES``: first and last stream, first and last byte."""
    ends = np.cumsum(sizes)
    cuts = np.flatnonzero(np.diff(ends // BLOCK_BYTES, prepend=0)) + 1
    cuts = sorted({0, *cuts.tolist(), len(sizes)})
    return [(a, b, int(ends[a - 1]) if a else 0, int(ends[b - 1])) for a, b in zip(cuts, cuts[1:])]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of several sorted lists and their counts added up."""
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(all_keys, kind="stable")
    all_keys = all_keys[order]
    firsts = np.flatnonzero(np.r_[True, all_keys[1:] != all_keys[:-1]]) if len(all_keys) else np.empty(0, np.int64)
    return all_keys[firsts], np.add.reduceat(all_counts[order], firsts) if len(firsts) else np.empty(0, np.int64)


def chunk_keys(data: np.ndarray, sizes: np.ndarray, held: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of a chunk, and how often each is in streams that are not ``held``."""
    found, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for a, b, begin, end in _blocks(sizes):
        keys = stream_keys(data[begin:end], sizes[a:b], order)
        out = np.repeat(held[a:b], sizes[a:b])
        for part, weight in ((keys[~out], 1), (keys[out], 0)):
            u, n = np.unique(part, return_counts=True)
            found.append(u)
            counts.append(n * weight)
    return _summed(found, counts)


def _dealt(keys: np.ndarray, n: int) -> np.ndarray:
    """A number below ``n`` for each key by its scrambled value."""
    with np.errstate(over="ignore"):
        x = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a key: by the last bytes of its context."""
    return _dealt((keys >> np.uint64(8)) & _MASKS[LOCAL - 1], buckets)


def _spans(group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order that puts groups together (stable), and each group with its first and last place in it."""
    order = np.argsort(group, kind="stable")
    group = group[order]
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
    return order, [(int(group[a]), int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(group)], strict=True)]


_ROWS = "chunk long, part long, keys binary, counts binary, words binary, word_counts binary"


def key_rows(chunks: DataFrame, parts: int) -> DataFrame:
    """``chunk, part`` and the chunk's keys and word hashes of that part with trained counts, each sorted."""
    empty = np.empty(0, np.uint64), np.empty(0, np.int64)

    def listed(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                chunk = batch.column("chunk")[k].as_py()
                sizes = np.array(batch.column("sizes")[k].as_py(), np.int64)
                keys, counts = chunk_keys(_spread(batch.column("data")[k], np.uint8), sizes, np.array(batch.column("held")[k].as_py(), bool))
                words, word_counts = _read_keys(batch.column("words")[k]), _spread(batch.column("word_counts")[k], np.int64)
                rows: dict[int, list] = {}
                for at, (what, n) in enumerate(((keys, counts), (words, word_counts))):
                    order, spans = _spans(_dealt(what, parts))
                    for part, a, b in spans:
                        rows.setdefault(part, [empty, empty])[at] = (what[order[a:b]], n[order[a:b]])
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk] * len(rows), pa.int64()), "part": pa.array(list(rows), pa.int64()), "keys": pa.array([_packed_keys(x[0][0]) for x in rows.values()], pa.binary()), "counts": pa.array([_squeezed(x[0][1]) for x in rows.values()], pa.binary()), "words": pa.array([_packed_keys(x[1][0]) for x in rows.values()], pa.binary()), "word_counts": pa.array([_squeezed(x[1][1]) for x in rows.values()], pa.binary())})

    return chunks.select("chunk", "held", "sizes", "data", "words", "word_counts").mapInArrow(listed, _ROWS)


_TRIE = "part long, bucket long, keys binary, counts binary, n_seen long, n_all long"
#: The bucket number of a part's words.
_WORDS = -1


def trie_rows(rows: DataFrame, parts: int, buckets: int) -> DataFrame:
    """``part, bucket, keys, counts``: distinct keys of the corpus with trained counts, and words as bucket -1; ``n_seen, n_all`` count the latter's."""

    def added(key, table):
        part = key[0].as_py()
        keys, counts = _summed([_read_keys(k) for k in table.column("keys")], [_spread(c, np.int64) for c in table.column("counts")])
        words, word_counts = _summed([_read_keys(k) for k in table.column("words")], [_spread(c, np.int64) for c in table.column("word_counts")])
        order, spans = _spans(bucket_of(keys, buckets))
        out = [(bucket, keys[order[a:b]], counts[order[a:b]], 0, 0) for bucket, a, b in spans] + [(_WORDS, words, word_counts, int((word_counts > 0).sum()), int(word_counts.sum()))]
        return pa.table({"part": pa.array([part] * len(out), pa.int64()), "bucket": pa.array([x[0] for x in out], pa.int64()), "keys": pa.array([_packed_keys(x[1]) for x in out], pa.binary()), "counts": pa.array([_squeezed(x[2]) for x in out], pa.binary()), "n_seen": pa.array([x[3] for x in out], pa.int64()), "n_all": pa.array([x[4] for x in out], pa.int64())})

    return rows.repartition(parts, "part").groupBy("part").applyInArrow(added, _TRIE)


def short_contexts(trie: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many trained contexts of three bytes each (two bytes of context, symbol) was seen: at most 2**24 rows.

    A key of three bytes of context is in one bucket, so the buckets' numbers add up.
    """

    def seen(key, table):
        keys = [_read_keys(k)[_spread(c, np.int64) > 0] & _MASKS[LOCAL] for k, c in zip(table.column("keys"), table.column("counts"), strict=True)]
        low, n = np.unique(np.unique(np.concatenate(keys)) & _MASKS[LOCAL - 1], return_counts=True)
        return pa.table({"low": pa.array(low.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    found = trie.filter(F.col("bucket") != _WORDS).select("bucket", "keys", "counts").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(seen, "low long, n long").groupBy("low").agg(F.sum("n").alias("n")).toPandas()
    return found["low"].to_numpy(np.int64).astype(np.uint64), found["n"].to_numpy(np.float64)


class _Level:
    """Counts of the contexts of one order: sorted (context, symbol) keys and sorted contexts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray | None = None):
        self.keys, at, n = np.unique(keys, return_inverse=True, return_counts=True)
        self.counts = n.astype(np.float64) if counts is None else np.bincount(at, weights=counts, minlength=len(self.keys))
        self.contexts, self.firsts, self.distinct = np.unique(self.keys >> np.uint64(8), return_index=True, return_counts=True)
        self.totals = np.add.reduceat(self.counts, self.firsts) if len(self.keys) else np.zeros(0)

    def count(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0.0)

    def context(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key's context, or -1."""
        wanted = keys >> np.uint64(8)
        if not len(self.contexts):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.contexts, wanted), len(self.contexts) - 1)
        return np.where(self.contexts[at] == wanted, at, -1)

    def excluded(self, shorter: _Level, order: int) -> np.ndarray:
        """Per context: how often its symbols were counted in the context one byte shorter."""
        return np.add.reduceat(shorter.count(self.keys & _MASKS[order - 1]), self.firsts) if len(self.keys) else np.zeros(0)


def code_lengths(asked: np.ndarray, keys: np.ndarray, counts: np.ndarray, low_keys: np.ndarray, low_counts: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Natural log probability of each key ``asked`` in the trie of ``keys`` with ``counts``.

    ``keys`` are all keys of these contexts of three bytes and more, trained if counted;
    ``low_keys`` and ``low_counts`` are the whole corpus' :func:`short_contexts`.
    """
    trained = counts > 0
    levels = {order: _Level(keys[trained], counts[trained])}
    for k in range(order - 1, -1, -1):
        levels[k] = _Level(low_keys, low_counts) if k == LOCAL - 1 else _Level(levels[k + 1].keys & _MASKS[k])
    known = order - sum((((asked >> np.uint64(8 * (b + 1))) & np.uint64(0xFF)) == _PAD).astype(np.int64) for b in range(order))
    out, open_ = np.zeros(len(asked)), np.ones(len(asked), bool)
    out_of = np.zeros(len(asked))  # counts and symbols that longer contexts exclude
    gone = np.zeros(len(asked))
    for k in range(order, -1, -1):
        level, q = levels[k], asked & _MASKS[k]
        at = level.context(q)
        seen = open_ & (at >= 0) & (known >= k)
        if seen.any():
            n = level.count(q)
            left = np.where(seen, level.totals[at] - out_of, 0.0)
            symbols = np.where(seen, level.distinct[at] - gone, 0.0)
            hit = seen & (n > 0)
            out[hit] += np.log((2 * n[hit] - 1) / (2 * left[hit]))
            miss = seen & ~hit & (left > 0) & (symbols > 0)
            out[miss] += np.log(symbols[miss] / (2 * left[miss]))
            open_ &= ~hit
            gone = np.where(seen, level.distinct[at], gone)
            if k:
                out_of = np.where(seen, level.excluded(levels[k - 1], k)[at], out_of)
    return np.where(open_, out - np.log(np.maximum(1.0, 256 - gone)), out)


def answered(trie: DataFrame, buckets: int, low_keys: np.ndarray, low_counts: np.ndarray) -> DataFrame:
    """``part, keys, logs``: the log probability of each key of the corpus."""
    shared = trie.sparkSession.sparkContext.broadcast((low_keys, low_counts))

    def solved(key, table):
        lists = [_read_keys(k) for k in table.column("keys")]
        keys, counts = np.concatenate(lists), np.concatenate([_spread(c, np.int64) for c in table.column("counts")])
        logs = np.split(code_lengths(keys, keys, counts, *shared.value).astype(np.float32), np.cumsum([len(x) for x in lists])[:-1])
        return pa.table({"part": table.column("part"), "keys": table.column("keys"), "logs": pa.array([_squeezed(x) for x in logs], pa.binary())})

    return trie.filter(F.col("bucket") != _WORDS).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(solved, "part long, keys binary, logs binary")


def returned(rows: DataFrame, parts: int, trie: DataFrame, answers: DataFrame) -> DataFrame:
    """``k_chunk, keys, logs, words, word_counts``: the corpus' answers to each chunk's rows."""
    words = trie.filter(F.col("bucket") == _WORDS).select("part", "keys", F.lit(None).cast("binary").alias("logs"), "counts")
    known = words.unionByName(answers.select("part", "keys", "logs", F.lit(None).cast("binary").alias("counts")))

    def found(left, right):
        keys, logs, words, counts = [np.empty(0, np.uint64)], [np.empty(0, np.float32)], np.empty(0, np.uint64), np.empty(0, np.int64)
        for k, log, n in zip(right.column("keys"), right.column("logs"), right.column("counts"), strict=True):
            if log.is_valid:
                keys.append(_read_keys(k))
                logs.append(_spread(log, np.float32))
            else:
                words, counts = _read_keys(k), _spread(n, np.int64)
        all_keys, all_logs = np.concatenate(keys), np.concatenate(logs)
        order = np.argsort(all_keys)
        all_keys, all_logs = all_keys[order], all_logs[order]
        out_logs = [_squeezed(all_logs[np.searchsorted(all_keys, _read_keys(k))]) for k in left.column("keys")]
        out_counts = [_squeezed(counts[np.searchsorted(words, _read_keys(w))]) for w in left.column("words")]
        return pa.table({"k_chunk": left.column("chunk"), "keys": left.column("keys"), "logs": pa.array(out_logs, pa.binary()), "words": left.column("words"), "word_counts": pa.array(out_counts, pa.binary())})

    asked = rows.select("chunk", "part", "keys", "words")
    return asked.repartition(parts, "part").groupBy("part").cogroup(known.repartition(parts, "part").groupBy("part")).applyInArrow(found, "k_chunk long, keys binary, logs binary, words binary, word_counts binary")


class _Places:
    """The place of each asked number in a list of distinct ones that holds it: a table of hashes, then a search for those that collide."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.table = np.zeros(1 << self.bits, np.int32)
        self.table[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)
        self.order = np.argsort(keys)
        self.sorted = keys[self.order]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (((keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, asked: np.ndarray) -> np.ndarray:
        at = self.table[self._slot(asked)]
        missed = np.flatnonzero(self.keys[at] != asked)
        at[missed] = self.order[np.searchsorted(self.sorted, asked[missed])]
        return at


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, held=held_out, of: int = 5, rest: int = 1, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Scores of each row of ``docs`` (``doc_id, text``), learning from the rows that are not held out.

    Null and empty texts are an end alone. Ids are whole numbers; other text as an id fails the job. Null ids are learnt from. Rows that
    repeat an id are rows of their own. ``base_score`` is of single tokens with half
    a count added; both scores are log10. Without a training row every byte is as
    likely as any. Other columns are ignored; an empty table gives no rows. Words
    are told apart by 64 bits.
    """
    spark = docs.sparkSession
    python_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held(F.col("doc_id"), of, rest).alias("held"), "text")
    chunks = stage(packed(rows, chunk_bytes), "ppm-chunks", codec="none")
    parts = max(1, chunks.count())
    keys = stage(key_rows(chunks, parts), "ppm-keys", codec="none")
    buckets = math.ceil(parts / BUCKET_CHUNKS)
    trie = stage(trie_rows(keys, parts, buckets), "ppm-trie", codec="none")
    size = trie.agg(F.coalesce(F.sum("n_all"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("n_seen"), F.lit(0)).alias("distinct")).first()
    known = returned(keys, parts, trie, answered(trie, buckets, *short_contexts(trie, buckets)))
    train, below = size["tokens"], size["tokens"] + 0.5 * (size["distinct"] + 1)

    def scored(left, right):
        places = _Places(np.concatenate([_read_keys(k) for k in right.column("keys")]))
        logs = np.concatenate([_spread(x, np.float32) for x in right.column("logs")]).astype(np.float64) / math.log(10)
        hashes = np.concatenate([_read_keys(k) for k in right.column("words")])
        order = np.argsort(hashes)
        hashes, counts = hashes[order], np.concatenate([_spread(x, np.int64) for x in right.column("word_counts")])[order]
        of_end = counts[np.searchsorted(hashes, word_hash([b""]))[0]]
        out = []
        for k in range(left.num_rows):
            data = _spread(left.column("data")[k], np.uint8)
            sizes = np.array(left.column("sizes")[k].as_py(), np.int64)
            n_tokens = np.array(left.column("n_tokens")[k].as_py(), np.int64)
            score, base, n_known = [], [], []
            for a, b, begin, end in _blocks(sizes):
                block = data[begin:end]
                symbol_logs = logs[places.of(stream_keys(block, sizes[a:b]))]
                score.append(np.add.reduceat(symbol_logs, np.cumsum(sizes[a:b]) - sizes[a:b]))
                # a text's stream ends in its one line feed, so the block's words in order are all but the ends
                words = block.tobytes().split()
                distinct = list(set(words))
                of_word = dict(zip(distinct, counts[np.searchsorted(hashes, word_hash(distinct))].tolist(), strict=True))
                seen = np.zeros(int(n_tokens[a:b].sum()), np.int64)
                ends = np.cumsum(n_tokens[a:b]) - 1
                inner = np.ones(len(seen), bool)
                inner[ends] = False
                seen[inner] = np.fromiter(map(of_word.__getitem__, words), np.int64, len(words))
                seen[ends] = of_end
                firsts = ends + 1 - n_tokens[a:b]
                base.append(np.add.reduceat(np.log10((seen + 0.5) / below), firsts))
                n_known.append(np.add.reduceat((seen > 0).astype(np.int64), firsts))
            out.append(pa.table({"doc_id": pa.array(left.column("doc_ids")[k].as_py(), pa.int64()), "held_out": pa.array(left.column("held")[k].as_py(), pa.bool_()), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(np.concatenate(n_known), pa.int64()), "train_tokens": pa.array(np.full(len(sizes), train), pa.int64()), "base_score": pa.array(np.concatenate(base), pa.float64()), "score": pa.array(np.concatenate(score), pa.float64())}))
        return pa.concat_tables(out)

    texts = chunks.select("chunk", "doc_ids", "held", "n_tokens", "sizes", "data")
    return texts.repartition(parts, "chunk").groupBy("chunk").cogroup(known.repartition(parts, "k_chunk").groupBy("k_chunk")).applyInArrow(scored, _SCORES)
