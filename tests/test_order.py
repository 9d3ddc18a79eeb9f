"""Order over all partitions: running maxima, bounds, batches by bytes, and what rests on them, against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.functions.ranks import in_order, last_bound, running_max
from weftline.operators import constraints as K
from weftline.operators import layout as P
from weftline.operators import walk as B
from weftline.operators.changes import Refused


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("inclusive", [False, True])
def test_running_max_is_a_loop(spark, seed, inclusive):
    r = random.Random(seed)
    data = [(r.choice([None, "a", "b", "c"]), k, r.choice([None, r.randrange(50)])) for k in range(200)]
    r.shuffle(data)
    want, best = [], {}
    for key, k, v in sorted(data, key=lambda x: (x[0] is not None, x[0] or "", x[1])):
        before = best.get(key)
        best[key] = max((x for x in (before, v) if x is not None), default=None)
        want.append((key, k, v, best[key] if inclusive else before))
    df = spark.createDataFrame(data, "g string, k int, v int").repartition(5)
    with_far = running_max(in_order(df, ["g", "k"]), ["g"], F.col("v"), "far", inclusive)
    assert rows(with_far.select("g", "k", "v", "far")) == sorted(want, key=repr)


def test_one_key_is_spread_over_partitions(spark):
    """All rows under one key, and none: no range holds more than its share, and results are those of one window."""
    n = 20_000
    df = spark.range(n).select(F.lit("hot").alias("g"), ((F.col("id") * 7919) % n).cast("int").alias("lo"), (F.col("id") % 3).cast("int").alias("len")).withColumn("hi", F.col("lo") + F.col("len"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = in_order(df, ["g", "lo", "hi"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [x["count"] for x in placed.groupBy("__part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.5 * n / 4
    for key in (["g"], []):
        got = {x["lo"] for x in K.check_without_overlaps(df, key, "lo", "hi").collect()}
        real = sorted((x["lo"], x["hi"]) for x in df.filter("len > 0").collect())
        far, want = -1, set()
        for lo, hi in real:
            if lo < far:
                want.add(lo)
            far = max(far, hi)
        assert got == want and want


@pytest.mark.parametrize("seed", range(3))
def test_periods_are_sets_of_points(spark, seed):
    r = random.Random(seed)
    some = lambda n: [(k, r.choice(["a", "b", None]), *(lambda lo: (lo, lo + r.randrange(-1, 6)))(r.randrange(30))) for k in range(n)]
    child, parent = some(60), some(25) + [(99, "a", None, 5)]
    schema = "id int, g string, lo int, hi int"
    got = {x["id"] for x in K.check_foreign_key_period(spark.createDataFrame(child, schema), spark.createDataFrame(parent, schema), ["g"], "lo", "hi").collect()}
    points = {(g, p) for _, g, lo, hi in parent if lo is not None for p in range(lo, hi)}
    assert got == {k for k, g, lo, hi in child if g and lo < hi and any((g, p) not in points for p in range(lo, hi))}


@pytest.mark.parametrize("most_packed", [100, 3])
def test_last_bound(spark, most_packed):
    r = random.Random(most_packed)
    bounds = [(None, "first"), *((lo, f"b{lo}") for lo in r.sample(range(100), 20))]
    keys = [(k, r.choice([None, r.randrange(-5, 110)])) for k in range(80)]
    got = last_bound(spark.createDataFrame(keys, "id int, key int"), "key", spark.createDataFrame(bounds, "lo int, name string"), "b", most_packed)
    want = [(k, v, None if v is None else max(((lo, n) for lo, n in bounds if lo is not None and lo <= v), default=(None, "first"))[1]) for k, v in keys]
    assert rows(got.select("id", "key", "b.name")) == sorted(want, key=repr)
    none = last_bound(spark.createDataFrame(keys, "id int, key int"), "key", spark.createDataFrame([(50, "x")], "lo int, name string"), "b", most_packed)
    assert {(x["key"] is not None and x["key"] >= 50) for x in none.filter("b IS NOT NULL").collect()} == {True}


def test_many_bounds_plan_quickly(spark):
    """10,000 ranges as a dictionary or a table: the plan does not hold them one by one."""
    bounds = {f"p{k}": {"lo": k * 10, "hi": k * 10 + 9} for k in range(10_000)}
    keys = spark.range(0, 100_100, 7).withColumnRenamed("id", "key")
    routed = P.route_rows(keys, "key", bounds, "rest")
    assert len(routed._jdf.queryExecution().executedPlan().toString()) < 20_000
    want = lambda k: f"p{k // 10}" if k < 100_000 and k % 10 < 9 else "rest"
    assert all(x["partition"] == want(x["key"]) for x in routed.collect())
    stats = P.partition_stats(keys, "key", bounds).filter("partition IS NULL").first()
    assert stats["rows"] == sum(want(k) == "rest" for k in range(0, 100_100, 7))


def test_bounds_of_each_kind(spark):
    schema = "partition string, kind string, lo int, hi int, value string, modulus int, remainder int"
    table = lambda *b: spark.createDataFrame([(*x, *[None] * (7 - len(x))) for x in b], schema)
    keys = spark.createDataFrame([(None,), (-3,), (0,), (5,), (9,), (12,)], "k int")
    ranges = table(("low", "range", None, 0), ("mid", "range", 0, 6), ("top", "range", 10, None), ("other", "default"))
    assert rows(P.route_rows(keys, "k", ranges)) == sorted([(None, "other"), (-3, "low"), (0, "mid"), (5, "mid"), (9, "other"), (12, "top")], key=repr)
    assert rows(P.route_rows(keys, "k", table(("l", "list", None, None, "5"), ("m", "list", None, None, "12")))) == sorted([(None, None), (-3, None), (0, None), (5, "l"), (9, None), (12, "m")], key=repr)
    assert rows(P.route_rows(keys, "k", table(*((f"h{x}", "hash", None, None, None, 4, x) for x in range(4))))) == sorted([(None, None), *((k, f"h{k % 4}") for k in (-3, 0, 5, 9, 12))], key=repr)
    for bad in (table(("a", "range", 0, 5), ("b", "range", 4, 9)), table(("a", "range", 0, None), ("b", "range", 4, 9)), table(("a", "range", 0, 5), ("b", "range", None, 1)), table(("a", "list", None, None, "5"), ("b", "list", None, None, "5")), table(("a", "odd"))):
        with pytest.raises(Refused):
            P.route_rows(keys, "k", bad)


def test_chunks_never_overlap(spark):
    day = lambda n, hour=0: datetime(2024, 1, 1) + timedelta(days=n, hours=hour)
    r = random.Random(2)
    chunks = spark.createDataFrame([(day(0), day(7)), (day(10), day(17))], "chunk_start timestamp_ntz, chunk_end timestamp_ntz")
    times = [(k, day(r.randrange(-6, 25), r.randrange(24))) for k in range(300)]
    got = P.set_chunk_interval(spark.createDataFrame(times, "id int, ts timestamp_ntz"), "ts", chunks, "5 days").collect()
    assert len(got) == 300 and all(x["chunk_start"] <= x["ts"] < x["chunk_end"] for x in got)
    spans = sorted({(x["chunk_start"], x["chunk_end"]) for x in got})
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)) and {(day(0), day(7)), (day(10), day(17))} <= set(spans) and len(spans) > 5
    with pytest.raises(Refused):
        P.set_chunk_interval(spark.createDataFrame(times, "id int, ts timestamp_ntz"), "ts", chunks.unionByName(chunks), "5 days")


@pytest.mark.parametrize("interval", ["1 day", "1 month"])
def test_rows_without_a_time_are_refused_or_kept(spark, interval):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, None), (3, datetime(2024, 6, 1))], "id int, ts timestamp_ntz")
    for call in (lambda: P.time_chunks(df, "ts", interval), lambda: P.chunk_catalog(df, "ts", interval), lambda: P.retention(df, "ts", interval, "1 day", "2024-05-01 00:00:00", True), lambda: P.continuous_aggregate(df, "ts", interval, [], [F.count("id")]), lambda: P.set_chunk_interval(df, "ts", P.chunk_catalog(df.filter("id = 1"), "ts", "1 day"), "2 days")):
        with pytest.raises(Refused):
            call()
    kept, report = P.retention(df, "ts", interval, "1 day", "2024-05-01 00:00:00", True, no_time="keep")
    assert {x["id"] for x in kept.collect()} == {2, 3} and tuple(report.first()) == (1, 1, 1)
    assert [x["id"] for x in P.time_chunks(df, "ts", interval, "keep").filter("chunk_start IS NULL").collect()] == [2]


@pytest.mark.parametrize("seed", range(4))
def test_batches_by_bytes_are_greedy(spark, seed):
    r = random.Random(seed)
    data = [(r.choice(["hot", "hot", "hot", "a", None]), k, r.choice([None, 0, 1, 5, 30, 200])) for k in range(250)]
    want = []
    for g in {x[0] for x in data}:
        batches, total = [], 0
        for _, k, size in sorted(x for x in data if x[0] == g):
            if not batches or len(batches[-1]) >= 6 or total + (size or 0) > 40:
                batches.append([])
                total = 0
            batches[-1].append((k, size or 0))
            total += size or 0
        want += [(g, n + 1, b[0][0], b[-1][0], len(b), sum(s for _, s in b)) for n, b in enumerate(batches)]
    df = spark.createDataFrame(data, "g string, k int, size int").repartition(3)
    got = B.byte_budget_batches(df, "g", "k", "size", 40, 6)
    assert got.columns == ["g", "batch", "first_key", "last_key", "rows", "bytes"] and rows(got) == sorted(want, key=repr)
    assert B.byte_budget_batches(df.limit(0), "g", "k", "size", 40, 6).count() == 0
    with pytest.raises(Refused):
        B.byte_budget_batches(spark.createDataFrame([("a", 1, -1)], "g string, k int, size int"), "g", "k", "size", 40, 6)


@pytest.mark.parametrize("elements", [[("lo,hi", "&&")], [("g", "="), ("lo,hi", "&&")], [("lo,hi", "&&"), ("g", "<>")]])
def test_exclusion_by_bins(spark, monkeypatch, elements):
    monkeypatch.setattr(K, "BIN_ROWS", 8)
    r = random.Random(9)
    data = [(k, r.choice(["a", "a", "b", None]), lo, lo + r.choice([-2, 0, 1, 3, 60])) for k, lo in enumerate([r.choice([5, r.randrange(100)]) for _ in range(150)])] + [(200, "a", None, 3), (201, "b", 3, None)]
    holds = {"=": lambda a, b: a[1] is not None and a[1] == b[1], "<>": lambda a, b: None not in (a[1], b[1]) and a[1] != b[1], "&&": lambda a, b: None not in (*a[2:], *b[2:]) and max(a[2], b[2]) < min(a[3], b[3])}
    want = [(a[0], b[0]) for a in data for b in data if a[0] < b[0] and all(holds[op](a, b) for _, op in elements)]
    got = K.check_exclusion(spark.createDataFrame(data, "id int, g string, lo int, hi int"), "id", elements)
    assert rows(got) == sorted(want, key=repr) and len(want) > 100
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString().replace("BroadcastNestedLoopJoin BuildRight, Inner\n", "")
    times = spark.createDataFrame([(k, datetime(2024, 1, 1) + timedelta(minutes=lo)) for k, _, lo, _ in data if lo is not None], "id int, lo timestamp_ntz").withColumn("hi", F.expr("lo + INTERVAL 1 minute"))
    starts = [(k, lo) for k, _, lo, _ in data if lo is not None]
    assert rows(K.check_exclusion(times, "id", [("lo,hi", "&&")])) == sorted(((a, b) for a, x in starts for b, y in starts if a < b and x == y), key=repr)
