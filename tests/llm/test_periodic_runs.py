"""Periodic runs against a comparison of all words at all periods."""

import hashlib
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from weftline.llm.periodic_runs import periodic_runs, planted, runs_of_texts

from . import brute
from .test_operators import texts


def periodic_text(r):
    """Words of few kinds, with squares, cubes and longer runs one in the other."""
    t = []
    for _ in range(r.randrange(5)):
        kinds = r.choice([1, 2, 3, 20])
        unit = [bytes([97 + r.randrange(kinds)]) for _ in range(r.randrange(1, 7))]
        t += unit * r.choice([1, 2, 3, 9]) + unit[: r.randrange(len(unit))]
        t += [bytes([97 + r.randrange(kinds)]) for _ in range(r.randrange(9))]
    return t * r.choice([1, 1, 1, 2, 4])


@pytest.mark.parametrize("least", [(24, 3), (4, 2), (6, 3), (8, 4), (2, 2), (30, 5)])
def test_runs_of_random_texts(least):
    r = random.Random(str(least))
    for _ in range(200):
        some = [periodic_text(r) for _ in range(r.randrange(1, 6))]
        assert runs_of_texts(some, *least) == [brute.periodic_runs(t, *least) for t in some]


def test_long_runs_cost_no_more_than_their_words():
    unit = [str(k).encode() for k in range(700)]
    assert runs_of_texts([[b"a"] * 300_000, unit * 300, []]) == [[(0, 300_000, 1)], [(0, 210_000, 700)], []]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    some = [*(t for t in texts() if len(brute.words(t)) < 3000), *(b" ".join(periodic_text(r)).decode() for _ in range(60)), "a\u00a0b " * 30, "x\ty\n" * 12 + "x", "\x1c a" * 25]
    rows = [(k, t, "clash", "kept") for k, t in enumerate(some)] + [(7, "again " * 30, "clash", "kept"), (None, "null " * 24, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, runs string, other string").repartition(3).cache()


def test_operator(spark, docs):
    for row in periodic_runs(docs, 12, 2).collect():
        w = brute.words(row["text"])
        runs = brute.periodic_runs(w, 12, 2)
        assert (row["n_words"], [tuple(x) for x in row["runs"]], row["collapsed_text"].encode()) == (len(w), runs, brute.collapsed(w, runs))
    assert periodic_runs(docs).columns == ["doc_id", "text", "other", "n_words", "runs", "collapsed_text"]
    assert periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        periodic_runs(docs, 24, 1)


def test_query(spark, docs, tmp_path):
    from weftline.llm.queries import op11_periodic_runs

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for at, least in ((str(tmp_path), 20), ("/root/testdata/sf0.001", 10)):
        given = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()
        got = sorted((tuple(r) for r in op11_periodic_runs(spark, at).collect()), key=repr)
        want, some = [], 0
        for doc, text in given:
            w = brute.planted_words(doc, text)
            runs = brute.periodic_runs(w)
            best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
            some += bool(runs)
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
            want.append((doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(brute.collapsed(w, runs)).hexdigest()))
        assert got == sorted(want, key=repr) and some >= least


def test_planted_ends(docs):
    for doc, text, shaped in docs.select("doc_id", "text", planted(F.col("text"), F.col("doc_id"))).collect():
        assert brute.words(shaped) == brute.planted_words(doc, text) and (text is None) == (shaped is None)
