"""What the fourth review found."""


def test_conflict_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """One relation of many specs is small before its pairs are made; they are made in as many tasks as they ask for."""
    from weftline.operators import ledger as L

    monkeypatch.setattr(L, "BLOCK_SPECS", 50)
    monkeypatch.setattr(L, "TASK_PAIRS", 10_000, raising=False)
    specs = spark.range(600).selectExpr("id AS spec_id", "'d' AS database", "1 AS level", "array('t') AS relations")
    got = L.conflict_pairs(specs)
    assert got.rdd.getNumPartitions() >= 18
    made = got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(made) == 600 * 599 // 2 and max(made) < 40_000
    assert {(r["a"], r["b"], *r["shared"]) for r in got.collect()} == {(a, b, "t") for b in range(600) for a in range(b)}


def test_a_large_side_is_sieved_and_not_broadcast(spark):
    """The driver holds a table of bits of a bounded size; rows are those of the plain join."""
    import pytest
    from pyspark.sql import functions as F

    common = pytest.importorskip("weftline.llm.common")
    df = spark.range(-500, 3000).selectExpr("IF(id % 50 = 7, NULL, id) AS k", "id AS n")
    small = common.stage(spark.range(0, 6000, 5).selectExpr("id AS s", "id * 2 AS v"), "small")
    on = F.col("k") == F.col("s")
    for how in ("inner", "left_anti"):
        found = common.join_sieved(df, "k", small, "s", on, how, rows=100)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, df.join(small, on, how).collect()))
        assert len(found.columns) == len(df.join(small, on, how).columns)
    assert common.SIEVE_WORDS <= 1 << 16
    from weftline.llm import ngram_join

    assert ngram_join.NARROW_ROWS <= common.SIEVE_WORDS
