"""Packing by retrieval: every token once, no padding, and neighbours by a plain BM25."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftline.llm import packing

from .test_operators import SCHEMA, docs, library, rows, vocabulary  # noqa: F401


def check_pieces(pieces, tokens, window):
    """``pieces`` hold each of ``tokens`` (by document) once, in sequences without gaps or padding; the lengths of these."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert by_doc.keys() == tokens.keys()
    for doc, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            own = np.array(tokens[doc][at : at + p["length"]], "<u4").tobytes()
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(tokens[doc]), zlib.crc32(own)) and p["length"] > 0
            at += p["length"]
        assert at == len(tokens[doc])
    lengths = []
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == window or at < window and at & (at - 1) == 0
        lengths.append(at)
    return lengths


def test_query(spark, tmp_path, docs, rows, library):  # noqa: F811
    from weftline.llm.queries import op12_bm25_packing

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for at in (str(tmp_path), "/root/testdata/sf0.001"):
        given = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()
        tokens = {d: library.encode(t or "", add_special_tokens=False).ids + [0] for d, t in given}
        lengths = check_pieces(op12_bm25_packing(spark, at).collect(), tokens, 1024)
        assert lengths.count(1024) >= sum(map(len, tokens.values())) // 1024 - 4


def test_small_shards(spark, monkeypatch, docs, vocabulary, library):  # noqa: F811
    """Several shards and partitions, ids given twice and null ids, and the same result again."""
    monkeypatch.setattr(packing, "SHARD_DOCS", 7)
    monkeypatch.setattr(packing, "PARTITION_TOKENS", 9000)
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(3, "a b c"), (None, "null"), (None, None)], "doc_id long, text string"))
    got = packing.pack(more, vocabulary, window=100)
    first = sorted(map(tuple, got.collect()), key=repr)
    assert first == sorted(map(tuple, packing.pack(more.repartition(5), vocabulary, window=100).collect()), key=repr)
    texts = Counter()
    for p in got.collect():
        texts[p["doc_id"]] += p["length"]
    want = Counter()
    for d, t in more.collect():
        want[d] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    assert texts == want
    assert packing.pack(docs.limit(0), vocabulary).count() == 0
    with pytest.raises(ValueError, match="at least one token"):
        packing.pack(docs, vocabulary, window=0)


def corpus(seed=4, n=60):
    r = random.Random(seed)
    topics = [[r.randrange(1, 60000) for _ in range(25)] for _ in range(5)]
    return [np.array([r.choice(topics[k % 5] if r.random() < 0.6 else range(1, 40)) for _ in range(r.randrange(5, 40))] + [0], np.uint16) for k in range(n)]


def weights_of(texts):
    frequency = np.zeros(packing.VOCABULARY, np.int64)
    for ids in texts:
        frequency[sorted(set(ids[:-1].tolist()))] += 1
    return packing.Weights(len(texts), sum(map(len, texts)), frequency)


def plain_scores(texts, seed):
    mean, n = sum(map(len, texts)) / len(texts), len(texts)
    counts = [Counter(ids[:-1].tolist()) for ids in texts]
    df = Counter(t for c in counts for t in c)

    def weight(t, k):
        tf = counts[k][t]
        return math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(texts[k]) / mean))

    return [sum(weight(t, k) for t in counts[seed]) for k in range(n)]


def test_neighbours_are_those_of_plain_bm25():
    texts = corpus()
    index = packing.Index(texts, weights_of(texts))
    left = np.array([len(t) for t in texts])
    left[::7] = 0
    for seed in range(len(texts)):
        want = plain_scores(texts, seed)
        assert np.allclose(index.scores(seed), want)
        got = list(index.neighbours(seed, left))
        assert sorted(got) == [k for k in range(len(texts)) if k != seed and left[k]]
        assert all(want[a] >= want[b] - 1e-9 for a, b in zip(got, got[1:], strict=False))


def test_windows_hold_near_texts():
    """Texts of one subject meet in a window far more often than by chance."""
    texts = corpus(n=200)
    sequences = packing.pack_shard(texts, weights_of(texts), 64)
    held = defaultdict(set)
    for pieces in sequences:
        for doc, start, n in pieces:
            held[doc] |= set(range(start, start + n))
    assert all(held[k] == set(range(len(t))) for k, t in enumerate(texts)) and sum(n for s in sequences for *_, n in s) == sum(map(len, texts))
    same = [pieces[0][0] % 5 == doc % 5 for pieces in sequences for doc, *_ in pieces[1:]]
    assert sum(same) > 0.8 * len(same) > 100


def test_powers_of_two():
    assert packing.powers_of_two([(4, 10, 5), (2, 0, 6)]) == [[(4, 10, 5), (2, 0, 3)], [(2, 3, 2)], [(2, 5, 1)]]


def test_index_of_documents_without_terms():
    texts = [np.array([0], np.uint16)] * 40
    assert sum(n for s in packing.pack_shard(texts, weights_of(texts), 16) for *_, n in s) == 40
