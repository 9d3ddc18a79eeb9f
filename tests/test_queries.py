"""Every registered query of the library's own operators against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from weftline.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
#: Queries that find nothing in the given tables, since nothing is wrong there.
EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(float(v)) if hasattr(v, "as_tuple") else repr(v)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert name in EMPTY or not got.isEmpty()
    assert canon([tuple(r) for r in got.collect()], got.columns) == canon(want.fetchall(), want.columns)


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
@pytest.mark.parametrize("name", ["v8_ivf_search", "v9_half_knn", "v9_quantized_knn"])
def test_nine_tenths_of_neighbours_are_found(spark, name, scale):
    large = f"/root/testdata/{scale}"
    exact = {(r.q_id, r.id) for r in QUERIES["v7_knn_l2"](spark, large).collect()}
    found = {(r.q_id, r.id) for r in QUERIES[name](spark, large).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


@pytest.mark.parametrize("name", ["l2_classify_specs", "l3_gate_specs", "l4_ledger_drift", "l5_duplicate_ids", "l6_missing_dependencies", "l15_blocking_closure"])
def test_ledger_takes_all_rows(spark, name):
    """At sf0.1 too each result is its SQL's."""
    large, con = "/root/testdata/sf0.1", duckdb.connect()
    for t in ("customer", "events", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{large}/{t}.parquet'")
    got, want = QUERIES[name](spark, large), con.sql(ORACLES[name])
    rows = [tuple(r) for r in got.collect()]
    assert rows and canon(rows, got.columns) == canon(want.fetchall(), want.columns)


def test_each_kind_of_drift_occurs(spark):
    """Drift and notes at each size; retired epochs and those without a file are in the ledger and left out."""
    for d in ("sf0.001", "sf0.01"):
        found = QUERIES["l4_ledger_drift"](spark, f"/root/testdata/{d}").collect()
        assert {r["kind"] for r in found} == {"drift", "note"} and {r["epoch"] for r in found} == {"e0"}


def test_closure_from_the_first_event_has_all(spark):
    from pyspark.sql import functions as F

    large = "/root/testdata/sf0.1"
    events = spark.read.parquet(f"{large}/events.parquet").filter("event_id > 1").count()
    assert QUERIES["l15_blocking_closure"](spark, large).filter(F.col("root") == 1).count() == events


@pytest.mark.parametrize("search", ["knn", "quantized_knn"])
def test_neighbours_in_blocks_of_queries(spark, monkeypatch, search):
    from weftline.operators import search as V
    from weftline.plans.data_queries import _vectors

    q, v = _vectors(spark, DATA)
    rows = lambda df: sorted((r.q_id, r.id, r.dist, r.place) for r in df.collect())
    once = rows(getattr(V, search)(q, v, 5))
    blocks = {"most_queries": 3} if search == "knn" else {}
    monkeypatch.setattr(V, "MATRIX_QUERIES", 3)
    monkeypatch.setattr(V, "HELD", 20)
    assert len(once) == 5 * q.count() and rows(getattr(V, search)(q, v.repartition(3), 5, **blocks)) == once
