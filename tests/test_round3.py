"""What the third review found, on inputs that showed it."""

import duckdb
import pytest

from weftline.operators import walk as B
from weftline.plans import ORACLES, QUERIES


def by_sql(name, views):
    con = duckdb.connect()
    for t, source in views.items():
        con.sql(f"CREATE VIEW {t} AS {source}")
    return con.sql(ORACLES[name]).fetchall()


@pytest.mark.parametrize("cut", [0, 5000, 49_999, 50_000, 150_000])
def test_progress_is_its_sql(spark, tmp_path, cut):
    """A share below, at and above the share before, and no rows."""
    source = f"SELECT * FROM '/root/testdata/sf0.1/orders.parquet' WHERE o_orderkey BETWEEN 1 AND {cut}"
    duckdb.sql(f"COPY ({source}) TO '{tmp_path}/orders.parquet'")
    got = [tuple(r) for r in QUERIES["b8_walk_progress"](spark, str(tmp_path)).collect()]
    assert repr(got) == repr(by_sql("b8_walk_progress", {"orders": source}))


def test_progress_that_stands_still(spark):
    half = spark.range(10)
    assert tuple(B.walk_progress(half, "id", 4, 0.5, 60.0).first()) == (0.5, float("inf"))
    assert tuple(B.walk_progress(half, "id", 4, 0.7).first()) == (0.5, None)


def test_many_bounds_are_not_copied_for_each_row(spark):
    from weftline.functions.ranks import last_bound

    bounds = spark.range(0, 10_000, 10).selectExpr("id AS lo", "'p' || CAST(id AS string) AS name")
    keys = spark.range(0, 10_000).selectExpr("CASE WHEN id % 3 > 0 THEN id END AS key")
    found = last_bound(keys, "key", bounds, "b")
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.select("key", "b.name").collect()
    assert len(rows) == 10_000 and all(r["name"] == (None if r["key"] is None else f"p{r['key'] // 10 * 10}") for r in rows)


@pytest.mark.parametrize("seed", range(2))
def test_levels_over_parts(spark, monkeypatch, seed):
    """Random graphs with cycles in parts of seven nodes, against plain Python; a long chain in few rounds."""
    import random

    from weftline.operators import ledger as L

    r = random.Random(seed)
    monkeypatch.setattr(L, "PART_NODES", 7)
    pairs = [(a, b) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(55)) if a >= b or r.random() < 0.06] + [(5, 99)]
    needs = {k: {b for a, b in pairs if a == k and b < 60} for k in range(60)}
    want: dict = {}
    while more := {k: 1 + max((want[b] for b in needs[k]), default=0) for k in needs if k not in want and needs[k] <= want.keys()}:
        want |= more
    got = L.dependency_levels(spark.createDataFrame(pairs, "node long, needs long"), spark.range(60).toDF("node"))
    assert {x["node"]: x["level"] for x in got.collect()} == {k: want.get(k) for k in range(60)}


def test_a_chain_takes_as_many_rounds_as_parts(spark, monkeypatch):
    from weftline.operators import ledger as L

    monkeypatch.setattr(L, "PART_NODES", 250, raising=False)
    chain = spark.range(1, 1000).selectExpr("id AS node", "id - 1 AS needs")
    levels = L.dependency_levels(chain, spark.range(1000).toDF("node"), 5)
    assert all(x["level"] == x["node"] + 1 for x in levels.collect())
    closed = chain.union(spark.sql("SELECT 300L, 303L"))
    assert {x["node"] for x in L.cycle_members(closed, 6).collect()} == {300, 301, 302, 303}


def test_all_pairs_are_as_one_by_one(spark):
    """Matrices give the same numbers as a comparison pair by pair, also to rows that are no vector of the length."""
    from pyspark.sql import functions as F
    from weftline.operators import search as V

    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").filter("vec_id < 90")
    v = e.selectExpr("vec_id AS id", "CASE WHEN vec_id % 11 = 3 THEN NULL WHEN vec_id % 11 = 4 THEN slice(embedding, 1, 9) ELSE embedding END AS v")
    q = e.filter("vec_id % 7 = 0").selectExpr("vec_id AS q_id", "CASE WHEN vec_id = 14 THEN NULL ELSE embedding END AS q")
    names = ["l2", "ip", "cosine", "l1"]
    plain = v.join(q).select("q_id", "id", *[V.distance(F.col("q"), F.col("v"), m).alias(m) for m in names])
    rows = lambda df: sorted(map(repr, df.select("q_id", "id", *names).collect()))
    found = V.distances(q, v, names)
    assert rows(found) == rows(plain)
    # the sums are no longer higher-order functions over every pair of rows
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    best = {}
    for r in sorted(plain.collect(), key=lambda r: (r["l2"] is None, r["l2"] or 0, r["id"])):
        best.setdefault(r["q_id"], []).append(r["id"])
    near = {}
    for r in sorted(V.knn(q, v, 80).collect(), key=lambda r: r["place"]):
        near.setdefault(r["q_id"], []).append(r["id"])
    assert near == {k: ids[:80] for k, ids in best.items()}


def test_a_task_holds_small_matrices(spark, monkeypatch):
    from weftline.operators import search as V

    assert [(s.start, s.stop) for s in V._slices(5, 10, 20)] == [(0, 2), (2, 4), (4, 5)]
    d = "/root/testdata/sf0.01"
    want = sorted(map(tuple, QUERIES["v9_quantized_knn"](spark, d).collect()))
    monkeypatch.setattr(V, "MATRIX_CELLS", 30)
    assert sorted(map(tuple, QUERIES["v9_quantized_knn"](spark, d).collect())) == want
    assert sorted(map(tuple, QUERIES["v7_knn_l2"](spark, d).collect())) == want


@pytest.mark.parametrize("seed", range(2))
def test_conflict_pairs_in_blocks(spark, monkeypatch, seed):
    """Random specs, some twice, on two levels or without relations; no pair goes through an exchange."""
    import random

    from weftline.operators import ledger as L

    monkeypatch.setattr(L, "BLOCK_SPECS", 3, raising=False)
    monkeypatch.setattr(L, "MET_BLOCKS", 2, raising=False)
    r = random.Random(seed)
    data = [(r.randrange(45), r.choice("de"), r.choice([1, 2, None]), r.choice([[], None, ["t1", None], *[sorted(r.sample(["t1", "t2", "t3", "t4"], r.randrange(1, 3))) for _ in range(8)]])) for _ in range(70)]
    shared, denied = {}, set()
    for a in data:
        for b in data:
            if a[0] < b[0] and a[1] == b[1] and a[2] is not None and a[2] == b[2]:
                if both := {x for x in a[3] or () if x} & {x for x in b[3] or () if x}:
                    shared.setdefault((a[0], b[0]), set()).update(both)
                if [] in (a[3], b[3]):
                    denied.add((a[0], b[0]))
    want = [(*k, sorted(v)) for k, v in shared.items()] + [(*k, []) for k in denied]
    got = L.conflict_pairs(spark.createDataFrame(data, "spec_id long, database string, level int, relations array<string>"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(denied) > 10
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_long_ranges_are_in_few_bins(spark):
    from weftline.operators import constraints as K

    long_ = spark.range(20_000).selectExpr("id", "id AS lo", "id + 4000 AS hi")
    assert K._binned(long_, "lo", "hi").count() <= 2 * 20_000


def test_texts_are_read_once_for_a_search(spark):
    from weftline.operators import search as V

    index = spark.sql("SELECT * FROM VALUES ('of', 1L, array(0, 4), 2L), ('that', 1L, array(1), 1L), ('of', 2L, array(3), 1L) AS t(lexeme, id, positions, n)")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    counted = index.mapInArrow(count, index.schema)
    assert [tuple(r) for r in V.text_phrase(counted, ["of", "that"]).collect()] == [(1, [0])] and seen.value == 3


def test_signs_around_a_word(spark):
    from weftline.operators import search as V

    df = spark.createDataFrame([(1, "  (a-b!) \"x\" ... 12, a@b.cd. It's #9z www.a.b/ é1 ")], "id int, text string")
    assert [(r["position"], r["token"], r["type"]) for r in V.text_tokens(df, "id", "text").collect()] == [(0, "a-b", "hword"), (1, "x", "asciiword"), (2, "12", "int"), (3, "a@b.cd", "email"), (4, "It's", "word"), (5, "9z", "numword"), (6, "www.a.b/", "url"), (7, "é1", "word")]
