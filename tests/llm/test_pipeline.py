"""The pipeline against a plain Python version of its five stages."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from . import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def sentence(r, n):
    return " ".join(f"{r.choice(['stone', 'river', 'walks', 'blue', 'hill', 'tree'])}{r.randrange(400)}" for _ in range(n))


def documents():
    r = random.Random(12)
    rows = [[k, sentence(r, r.randrange(55, 160)), ("en", "de")[k % 2], ("a", "b", None)[k % 3]] for k in range(90)]
    for k in range(90, 110):
        w = rows[k - 90][1].split()
        w[len(w) // 2] = "changed"
        rows.append([k, " ".join(w), "en", "b"])
    rows += [[110 + k, sentence(r, 80).replace(" ", "*** "), "en", "a"] for k in range(6)]
    rows += [[120 + k, sentence(r, 20), "en", "a"] for k in range(4)]
    rows += [[130, None, "en", "a"], [131, "", None, None], [132, rows[3][1], "en", "a"]]
    items = [(k, sentence(r, 30)) for k in range(3)]
    rows += [[140 + k, sentence(r, 40) + " " + items[k][1] + " " + sentence(r, 40), "de", "a"] for k in range(3)]
    return [tuple(x) for x in rows], items


def test_pipeline(spark, tmp_path):
    rows, items = documents()
    spark.createDataFrame([(*r, len(r[1] or ""), "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, n_words string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    good = brute.kept(rows)
    one = [r for r in rows if r[0] in good]
    alone = brute.components([(r[0], r[1]) for r in one])
    two = [r for r in one if alone[r[0]][1] == r[0]]
    three = [r for r in two if not brute.contamination(r[1], items)[3]]
    sizes = {}
    for r in three:
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, left, open_ = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(order)}, {}, 1.5 * sum(sizes.values()), set(order)
    while over := {s for s in open_ if left / sum(weight[o] for o in open_) * weight[s] > 2 * sizes[s]}:
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    target |= {s: left / sum(weight[o] for o in open_) * weight[s] for s in open_}
    four = []
    for r in three:
        rate = target[r[3]] / sizes[r[3]]
        draw = int(hashlib.md5(f"mix-1\x1f{r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        four += [r] * (math.floor(rate) + (draw < rate - math.floor(rate)))
    assert 0 < len(three) < len(two) < len(one) < len(rows)

    from tokenizers import Tokenizer

    library, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for r in sorted(four, key=lambda r: r[0]):
        ids = [*library.encode(r[1], add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got.collect()) == sorted(want)

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert step(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert {r["n_words"] for r in corpus_pipeline.quality_rules(spark, docs, str(tmp_path)).collect()} == {"x"}
