"""Hard negatives against a comparison of every anchor with every row."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, anchor_id string, c string"


def plain(rows, positives=5, negatives=10, low=30, high=90, scale=256):
    """Sorted result rows of ``(vec_id, embedding, label)``."""
    held = [(i, [math.floor(scale * float(np.float32(x))) for x in e], y) for i, e, y, *_ in rows if i is not None and y is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, (anchor, c, y) in enumerate(held):
        if anchor % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(c, d, strict=False)), i, k) for k, (i, d, _) in enumerate(held) if k != a)
        for s, i, _ in [x for x in scored if held[x[2]][2] == y][:positives]:
            window = [(-t, j) for t, j, k in scored if held[k][2] != y and low * -s <= 100 * -t <= high * -s]
            out += [(anchor, i, rank + 1, j, -s, t) for rank, (t, j) in enumerate(window[:negatives])]
    return sorted(out)


def rows_of(seed, n=900, dims=6):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(7)]
    out = [(k, [x + r.gauss(0, 0.4) for x in centres[k % 7]], r.choice([k % 4, 5]), "clash", "x") for k in range(n)]
    return out + [(2000 + k, centres[0], k % 3, None, None) for k in range(80)]


AWKWARD = [(None, [1.0] * 6, 1, "", ""), (3000, None, 1, "", ""), (3100, [1.0] * 6, None, "", ""), (3200, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, "", ""), (3300, [1.0, math.nan, 1.0, 1.0, 1.0, 1.0], 1, "", ""), (3400, [math.inf] * 6, 1, "", ""), (3500, [], 1, "", ""), (3600, [0.5, 1.0], 2, "", ""), (3700, [0.0] * 6, 77, "", ""), (200, [2.0] * 6, 3, "", ""), (201, [2.0] * 6, 3, "", "")]


@pytest.fixture(autouse=True)
def small(monkeypatch):
    """Several buckets, blocks, chunks and reductions on few rows."""
    for name, value in {"BLOCK_ROWS": 16, "BUCKET_ROWS": 150, "CHUNK_ANCHORS": 4, "HELD": 50}.items():
        monkeypatch.setattr(hn, name, value)


def test_against_all_pairs(spark):
    rows = rows_of(1) + AWKWARD
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = hn.hard_negatives(frame, F.col("vec_id") % 100 == 0)
    want = plain(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 300
    few = hn.hard_negatives(frame, F.col("vec_id") % 100 == 0, positives=2, negatives=3, low_pct=-50, high_pct=100, scale=7)
    assert sorted(map(tuple, few.collect())) == plain(rows, 2, 3, -50, 100, 7)


def test_empty(spark):
    frame = spark.createDataFrame(AWKWARD[:5], SCHEMA)
    assert hn.hard_negatives(frame.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert hn.hard_negatives(frame, F.col("vec_id") % 100 == 0).collect() == []
    assert hn.hard_negatives(spark.createDataFrame(AWKWARD[5:], SCHEMA), F.lit(None).cast("boolean")).count() == 0


def test_curve_is_a_hilbert_curve():
    """Every cell has a place of its own, and cells next to each other on the curve touch."""
    for dims, bits in ((2, 4), (3, 3), (5, 2), (1, 5)):
        cells = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
        key = hn.hilbert(cells, bits)
        assert sorted(key) == list(range(1 << dims * bits))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_bounds_hold_and_prune(spark, tmp_path):
    """No score leaves its block's bounds, and clustered vectors are read in part."""
    rows = [(k, [math.cos(k / 300), math.sin(k / 300)], k % 2, "", "") for k in range(1800)]
    frame = spark.createDataFrame(rows, SCHEMA)
    n, dims = hn.write_blocks(frame, F.col("vec_id") == 0, f"{tmp_path}/blocks")
    blocks = [r.asDict() for r in spark.read.schema(hn.BLOCK).parquet(f"{tmp_path}/blocks").collect()]
    assert (n, dims) == (1800, 2) and sorted(x for b in blocks for x in np.frombuffer(b["ids"], "<i8")) == list(range(1800))
    c = np.array([[256, 0]])
    for b in blocks:
        low, high = hn.score_bounds(c, np.array(b["lo"]), np.array(b["hi"]))
        scores = hn._products(c, hn._Block(b, dims).components)
        assert low[0] <= scores.min() and scores.max() <= high[0]
    asked = {"c": c, "labels": np.array([0]), "rows": np.array([-1]), "anchor": np.array([0]), "low": np.array([60_000]), "high": np.array([1 << 40])}
    asking = sum(len(hn._Search(asked, 5, True).asking(b)) for b in blocks)
    assert 0 < asking < len(blocks) / 4


def test_products_beyond_floating_point():
    a, b = np.array([[1 << 25, 3]]), np.array([[1 << 25, 5], [-(1 << 25), 1]])
    assert hn._products(a * 4, b * 4).tolist() == [[(1 << 54) + 240, -(1 << 54) + 48]]
