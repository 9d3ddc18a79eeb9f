"""Properties of the changes against plain Python models, and the refusals."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.operators import changes as C
from weftline.operators import constraints as K
from weftline.operators import distribution as X
from weftline.operators import feed as D
from weftline.operators import layout as P
from weftline.operators import ledger as L
from weftline.operators import schema as E
from weftline.operators import search as V
from weftline.operators import walk as B
from weftline.sources import tables as S

T = "k int, v int, w string"


def frame(spark, rows, schema=T):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("rules", [("update", "insert", "nothing"), ("delete", "insert", "delete"), ("nothing", "insert", "delete"), ("update", "nothing", "nothing")])
def test_merge_is_the_dict_model(spark, seed, rules):
    r = random.Random(seed)
    value = lambda: r.choice([None, 1, 2])
    target = {k: (value(), r.choice("ab")) for k in r.sample(range(12), 7)}
    source = {k: (value(), r.choice("cd")) for k in r.sample(range(12), 7)}
    want = {}
    for k in target | source:
        if k in target and k in source:
            if rules[0] != "delete":
                want[k] = source[k] if rules[0] == "update" else target[k]
        elif k in source:
            if rules[1] == "insert":
                want[k] = source[k]
        elif rules[2] != "delete":
            want[k] = target[k]
    t, s = (frame(spark, [(k, *v) for k, v in x.items()]) for x in (target, source))
    merged = C.merge_rows(t, s, ["k"], *rules)
    assert rows(merged) == sorted(((k, *v) for k, v in want.items()), key=repr)
    saved = C.preserve(t, s.select("k").unionByName(t.select("k")), ["k"])
    assert rows(C.revert(merged, saved, ["k"]).join(t.select("k"), "k", "left_semi")) == rows(t)


def test_refusals(spark):
    t, s = frame(spark, [(1, 1, "a")]), frame(spark, [(1, 2, "b"), (1, 3, "c")])
    for bad in (lambda: C.merge_rows(t, s, ["k"]), lambda: C.merge_rows(t, t, ["k"], "nothing", "nothing", "nothing"), lambda: C.insert_rows(t, t, "refuse", ["k"]), lambda: C.backfill(t, {"v": "1"}), lambda: C.insert_identified(t, t, "k"), lambda: E.add_column(t, "x", "int", nullable=False), lambda: E.rename_column(t, "v", "w"), lambda: P.retention(t, "k", "1 day", "1 day", "2024-01-01"), lambda: X.distribute(frame(spark, [(None, 1, "a")]), "k", 4), lambda: X.colocated_join(t, t.withColumn("k", F.col("k").cast("long")), "k", 2), lambda: S.import_tables(spark, "", [], ["a"], ["b"]), lambda: S.literal_rows(spark, ["k"], [[1, 2]], t.schema), lambda: D.replica_identity(D.snapshot_diff(t, s.limit(1), ["k"]), "nothing", ["k"]), lambda: V.ivf_write(t, "", 0)):
        with pytest.raises(C.Refused):
            bad()


def test_null_keys_never_conflict(spark):
    t = frame(spark, [(None, 1, "a"), (2, 1, "a")])
    s = frame(spark, [(None, 5, "n"), (2, 6, "m")])
    assert rows(C.insert_rows(t, s, "skip", ["k"])) == sorted([(None, 1, "a"), (2, 1, "a"), (None, 5, "n")], key=repr)
    assert rows(C.update_rows(t, s, ["k"])) == sorted([(None, 1, "a"), (2, 6, "m")], key=repr)
    assert K.check_unique(t.unionByName(t), ["k"]).collect()[0]["k"] == 2
    assert K.check_primary_key(t, ["k"]).count() == 1


def test_clean_and_rejected_make_the_input(spark):
    df = frame(spark, [(k, k % 5 if k % 7 else None, "x") for k in range(60)])
    clean, rejected = K.quarantine(df, F.col("v") > 2)
    assert rows(clean.unionByName(rejected)) == rows(df)


def test_batches_make_the_input(spark):
    df = frame(spark, [(k * 3 % 101, k, "x") for k in range(101)])
    b = B.keyset_batches(df, ["k"], 10).orderBy("batch").collect()
    assert [x["rows"] for x in b] == [10] * 10 + [1] and all(x["last_key"] < y["first_key"] for x, y in zip(b, b[1:]))
    assert B.keyset_batches(df.limit(0), ["k"], 10).count() == 0


def test_ranges_and_overlaps(spark):
    r = random.Random(3)
    data = [(k, r.randrange(4), lo := r.randrange(60), lo + r.randrange(0, 8)) for k in range(80)]
    df = spark.createDataFrame(data, "id int, g int, lo int, hi int")
    real = [x for x in data if x[2] < x[3]]
    bad = {x[0] for x in real for y in real if x[1] == y[1] and x[0] != y[0] and (y[2], y[3]) <= (x[2], x[3]) and x[2] < y[3]}
    got = {x["id"] for x in K.check_without_overlaps(df, ["g"], "lo", "hi").collect()}
    assert got <= bad and bool(got) == bool(bad)
    points = {(x["g"], p) for x in K.merged_ranges(df, ["g"], "lo", "hi").collect() for p in range(x["lo"], x["hi"])}
    assert points == {(x[1], p) for x in real for p in range(x[2], x[3])}


def test_closure_ends_in_a_cycle(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (1, 3), (4, 3)], "waiter long, blocker long")
    got = rows(L.blocking_closure(edges, spark.createDataFrame([(1,)], "root long")))
    assert got == [(1, 2, 1), (1, 3, 2), (1, 4, 3)]


def test_feed_round_trip(spark):
    before, after = frame(spark, [(1, 1, "a"), (2, 2, None), (3, 3, "c")]), frame(spark, [(2, 2, "b"), (3, 3, "c"), (4, None, "d")])
    diff = {r["k"]: r for r in D.snapshot_diff(before, after, ["k"]).collect()}
    assert {k: r["action"] for k, r in diff.items()} == {1: "D", 2: "U", 4: "I"} and diff[2]["changed_fields"] == {"w": "b"}
    feed = spark.createDataFrame([(1, None, None, "D", 1), (2, 9, "x", "U", 1), (2, 2, "b", "U", 2), (4, None, "d", "I", 3)], T + ", action string, seq int")
    assert rows(D.apply_feed(before, feed, ["k"])) == rows(after)


@pytest.mark.parametrize("rule", ["skip", "update", "refuse"])
def test_a_key_given_twice_is_refused(spark, rule):
    """As is; NULL keys and rows outside the partial key may repeat."""
    t = frame(spark, [(1, 10, "a"), (2, 20, "b")])
    with pytest.raises(C.Refused):
        C.insert_rows(t, frame(spark, [(3, 31, "c"), (3, 32, "d")]), rule, ["k"])
    with pytest.raises(C.Refused):
        C.insert_rows(t, frame(spark, [(1, 11, "p"), (1, 12, "p")]), rule, ["k"], conflict_where="w = 'p'")
    free = [(None, 1, "n"), (None, 2, "n"), (5, 1, "q"), (5, 2, "q")]
    assert rows(C.insert_rows(t, frame(spark, free), rule, ["k"], conflict_where="w <> 'q'")) == sorted([(1, 10, "a"), (2, 20, "b"), *free], key=repr)
    why = C.insert_refusals(t, frame(spark, [(1, 1, "x"), (3, 1, "x"), (3, 2, "x"), (4, 1, "x"), (None, 1, "x"), (None, 1, "x")]), ["k"])
    assert rows(why) == [(1, "in the target"), (3, "given twice")]


def test_views_to_the_last_level(spark):
    chain = lambda n: spark.createDataFrame([(f"v{k}", f"v{k - 1}" if k > 1 else "t") for k in range(1, n + 1)], "view string, relation string")
    roots = spark.createDataFrame([("t",)], "relation string")
    assert {(r["view"], r["depth"]) for r in E.view_impact(chain(6), roots, 6).collect()} == {(f"v{k}", k) for k in range(1, 7)}
    for bad in (chain(7), chain(3).unionByName(spark.createDataFrame([("v1", "v3")], "view string, relation string"))):
        with pytest.raises(C.Refused):
            E.view_impact(bad, roots, 6)


def test_a_reference_is_a_unique_key(spark):
    child, parent = frame(spark, [(1, 1, "a"), (9, 2, "b"), (None, 3, "c")]), frame(spark, [(1, 1, "x"), (2, 2, "y"), (None, 1, "z"), (None, 1, "z")])
    assert rows(K.check_foreign_key(child, ["k"], parent, ["k"])) == [(9, 2, "b")]
    with pytest.raises(C.Refused):
        K.check_foreign_key(child, ["k"], parent, ["v"])


@pytest.mark.parametrize("seed", range(6))
def test_deletes_are_those_of_a_model(spark, seed):
    """Three tables, one of which refers to itself, with any action on each reference."""
    r = random.Random(seed)
    action = lambda: r.choice(["cascade", "cascade", "set null", "set default", "no action", "restrict"])
    some = lambda n: r.choice([None, *range(n)])
    a = {k: [some(k)] for k in range(8)}  # a.up -> a
    b = {k: [some(8), some(8)] for k in range(12)}  # b.x -> a, b.y -> a
    c = {k: [some(12)] for k in range(15)}  # c.b -> b
    acts = [action() for _ in range(4)]
    edges = [("a", 0, "a", acts[0]), ("b", 0, "a", acts[1]), ("b", 1, "a", acts[2]), ("c", 0, "b", acts[3])]
    tables = {"a": a, "b": b, "c": c}
    gone = {"a": set(r.sample(range(1, 8), 2)), "b": set(), "c": set()}
    while True:
        new = [(t, k) for t, i, p, act in edges if act == "cascade" for k, v in tables[t].items() if v[i] in gone[p] and k not in gone[t]]
        if not new:
            break
        for t, k in new:
            gone[t].add(k)
    first = set(gone["a"])
    want, refused = {t: {k: list(v) for k, v in rows_.items() if k not in gone[t]} for t, rows_ in tables.items()}, False
    for t, i, p, act in edges:
        if act == "cascade":
            continue
        hit = [k for k, v in tables[t].items() if v[i] in gone[p] and (act == "restrict" or k not in gone[t])]
        refused |= bool(hit) and (act in ("no action", "restrict") or act == "set default" and 0 in gone[p])
        for k in hit:
            if k in want[t]:
                want[t][k][i] = 0 if act == "set default" else None
    start = r.sample(sorted(first), len(first))
    made = {"a": (frame(spark, [(k, *v) for k, v in a.items()], "id int, up int"), ["id"]), "b": (frame(spark, [(k, *v) for k, v in b.items()], "id int, x int, y int"), ["id"]), "c": (frame(spark, [(k, *v) for k, v in c.items()], "id int, b int"), ["id"])}
    names = {"a": ["up"], "b": ["x", "y"], "c": ["b"]}
    references = [K.Reference(t, (names[t][i],), p, ("id",), act, (0,) if act == "set default" else ()) for t, i, p, act in edges]
    run = lambda: K.delete_with_references(made, references, "a", frame(spark, [(k,) for k in start], "id int"))
    if refused:
        with pytest.raises(C.Refused):
            run()
        return
    out = run()
    assert {t: {x[0]: list(x)[1:] for x in out[t].collect()} for t in out} == want


def test_deletes_by_compound_keys_and_chains(spark):
    """A chain of twelve rows of one table goes whole; a key of two columns with a NULL part refers to nothing."""
    chain = frame(spark, [(k, k - 1 if k else None, "x") for k in range(12)])
    out = K.delete_with_references({"t": (chain, ["k"])}, [K.Reference("t", ("v",), "t", ("k",), "cascade")], "t", frame(spark, [(3,)], "k int"))
    assert {x["k"] for x in out["t"].collect()} == {0, 1, 2}
    parent, child = frame(spark, [(1, 1, "p"), (1, 2, "p")]), frame(spark, [(10, 1, "a"), (11, 2, "b"), (12, None, "c")]).withColumn("one", F.lit(1))
    both = K.Reference("child", ("one", "v"), "parent", ("k", "v"), "cascade")
    out = K.delete_with_references({"parent": (parent, ["k", "v"]), "child": (child, ["k"])}, [both], "parent", frame(spark, [(1, 2)], "k int, v int"))
    assert {x["k"] for x in out["child"].collect()} == {10, 12} and out["child"].columns == child.columns
    for bad in ([K.Reference("child", ("one", "v"), "parent", ("k", "v"), "vanish")], [K.Reference("child", ("k",), "parent", ("v",), "set null"), K.Reference("parent", ("k",), "child", ("k",), "cascade")]):
        with pytest.raises(C.Refused):
            K.delete_with_references({"parent": (parent, ["k", "v"]), "child": (child, ["k"])}, bad, "parent", parent)


def test_layout_is_dealt(spark):
    df = frame(spark, [(k, k % 3, "x") for k in range(100)])
    assert X.placed(df, "k", 6).rdd.getNumPartitions() == 6
    assert set(X.undistribute(X.distribute(df, "k", 4)).columns) == set(df.columns)


def test_large_keys_are_many_files(spark, tmp_path):
    """A key with nearly all rows is evened out over files, each sorted; a stated number is kept."""
    df = spark.range(200_000).select(F.when(F.col("id") % 100 == 0, "small").otherwise("hot").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        back = S.export_partitioned(df, f"{tmp_path}/even", ["k"], ["v"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {k: list((tmp_path / "even" / f"k={k}").glob("*.parquet")) for k in ("hot", "small")}
    assert len(files["hot"]) >= 4 > len(files["small"]) and back.count() == 200_000
    import pyarrow.parquet as pq

    for f in files["hot"]:
        v = pq.ParquetFile(f).read(columns=["v"]).column("v").to_pylist()
        assert v == sorted(v)
    S.export_partitioned(df, f"{tmp_path}/one", ["k"], ["v"], 1)
    assert len(list((tmp_path / "one" / "k=hot").glob("*.parquet"))) == 1


def test_written_buckets_join_without_an_exchange(spark):
    df = frame(spark, [(k % 40, k, "x") for k in range(200)])
    for name in ("bucket_a", "bucket_b"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        X.write_colocated(df, name, "k", 4)
    joined = X.bucketed_join(spark, "bucket_a", "bucket_b", "k").groupBy("k").count()
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert {r["count"] for r in joined.collect()} == {25} and joined.count() == 40
    X.write_colocated(df.withColumn("k", F.col("k").cast("long")), "bucket_b", "k", 4)
    with pytest.raises(C.Refused):
        X.bucketed_join(spark, "bucket_a", "bucket_b", "k")
    for name in ("bucket_a", "bucket_b"):
        spark.sql(f"DROP TABLE {name}")


def test_cycles_and_what_is_behind_them(spark):
    """Nodes between two cycles are in none; a need in another state is told from a cycle."""
    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (3, 4), (4, 5), (5, 4), (6, 1), (7, 8), (9, 10), (10, 11), (12, 12), (5, 13)], "node long, needs long")
    assert {r["node"] for r in L.cycle_members(edges).collect()} == {1, 2, 4, 5, 12}
    state = {8: "in_progress", 11: "applied", 13: "modified_after_apply"}
    nodes = spark.createDataFrame([(k, state.get(k, "pending" if k % 2 else "failed")) for k in range(1, 14)], "node long, status string")
    got = {r["node"]: r["kind"] for r in L.unorderable(edges, nodes).collect()}
    assert got == {1: "cycle", 2: "cycle", 3: "blocked", 4: "cycle", 5: "state", 6: "blocked", 7: "state", 12: "cycle"}


@pytest.mark.parametrize("seed", range(3))
def test_cycles_are_the_strong_components(spark, seed):
    r = random.Random(seed)
    pairs = {(r.randrange(30), r.randrange(30)) for _ in range(34)}
    reach = {a: {y for x, y in pairs if x == a} for a in range(30)}
    for _ in range(30):
        reach = {a: s | {z for y in s for z in reach[y]} for a, s in reach.items()}
    got = {x["node"] for x in L.cycle_members(spark.createDataFrame(sorted(pairs), "node long, needs long")).collect()}
    assert got == {a for a in reach if a in reach[a]}


def test_blocking_summary(spark):
    edges = spark.createDataFrame([(2, 1, 5), (3, 1, 3), (4, 2, 1), (1, 4, 2)], "waiter long, blocker long, s int").selectExpr("waiter", "blocker", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) AS waitstart")
    got = {r["root"]: tuple(r)[1:] for r in L.blocking_summary(edges, spark.createDataFrame([(1,), (3,)], "root long"), "2024-01-01 00:00:10").collect()}
    assert got == {1: (2, 3, 3, 7000, 12000), 3: (0, 0, None, 0, 0)}


def test_subscription_goes_on(spark, tmp_path):
    """Batches are applied once and in order over restarts, with and without something new, and after a compaction."""
    from weftline.streaming import streams as R

    target = frame(spark, [(1, 10, "a"), (2, 20, "b")])
    schema = T + ", action string, seq int"
    changes = [[(1, 99, "x", "U", 1)], [(3, 30, "c", "I", 1)], [(2, None, None, "D", 1), (1, 98, "y", "U", 2)], [(3, 31, "d", "U", 1)]]
    want = [{1: (99, "x"), 2: (20, "b")}, {1: (99, "x"), 2: (20, "b"), 3: (30, "c")}, {1: (98, "y"), 3: (30, "c")}, {1: (98, "y"), 3: (31, "d")}]
    run = lambda: {r["k"]: (r["v"], r["w"]) for r in R.subscribe(R.read_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, 1), target, ["k"], f"{tmp_path}/out", f"{tmp_path}/check", compact_after=3).collect()}
    (tmp_path / "in").mkdir()
    assert run() == {1: (10, "a"), 2: (20, "b")}
    for new, state in zip(changes, want, strict=True):
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert run() == state
        assert run() == state
    assert len(list((tmp_path / "out").glob("copy=*"))) == 2


def test_late_rows_are_dropped(spark, tmp_path):
    from weftline.streaming import streams as R

    start = datetime(2024, 1, 1)
    batches = [[0, 10, 50], [70, 200], [210], [20, 220], [400]]  # minutes; 20 comes after its hour is closed
    for b in batches:
        spark.createDataFrame([(start + timedelta(minutes=m), "a") for m in b], "ts timestamp_ntz, kind string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = R.read_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], "ts timestamp_ntz, kind string").schema, 1)
    R.write_batches(R.cagg_stream(stream, "ts", "1 hour", ["kind"], {"n": F.count(F.lit(1))}, "30 minutes"), f"{tmp_path}/out", f"{tmp_path}/check", {"rows": lambda x: x})
    got = {(r["bucket"] - start).seconds // 3600: r["n"] for r in spark.read.parquet(f"{tmp_path}/out/rows").collect()}
    assert got == {0: 3, 1: 1, 3: 3}


@pytest.mark.parametrize("kind", ["session", "sliding"])
def test_window_streams(spark, tmp_path, kind):
    """A session spans three batches and a restart, two others are joined by a row between them, and a row for a closed window is late."""
    from weftline.streaming import streams as R

    start = datetime(2024, 1, 1)
    schema = "ts timestamp_ntz, kind string"
    batches = [[0, 100], [25], [50, 75, 140], [90, 120, 300], [10, 700], [701]]  # minutes; 10 comes after all windows of its hour are closed
    for n, b in enumerate(batches):
        spark.createDataFrame([(start + timedelta(minutes=m), "a") for m in b], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if n in (1, 3, 5):  # the stream is started again and goes on from its state
            stream = R.read_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, 1)
            windows = R.window_stream(stream, "ts", kind, "30 minutes" if kind == "session" else "1 hour", ["kind"], "60 minutes", "30 minutes")
            R.write_batches(windows, f"{tmp_path}/out", f"{tmp_path}/check", {"rows": lambda x: x})
    minutes = lambda t: int((t - start).total_seconds() // 60)
    got = sorted((minutes(r["start"]), minutes(r["end"]), r["rows"]) for r in spark.read.parquet(f"{tmp_path}/out/rows").collect())
    if kind == "session":
        assert got == [(0, 170, 8), (300, 330, 1)]
    else:
        on_time = [0, 100, 25, 50, 75, 140, 90, 120, 300]
        assert got == sorted((w, w + 60, n) for w in range(-30, 330, 30) if (n := sum(w <= m < w + 60 for m in on_time)))


def test_indexes_differ_by_class_include_and_options(spark):
    cols = "table string, name string, method string, is_unique boolean, columns array<string>, descending array<boolean>, predicate string, opclasses array<string>, include array<string>, options array<string>"
    plain = ("t", "btree", False, ["a", "b"], [False, False], None)
    made = {"i0": (None, None, None), "i1": (["", ""], [], []), "i2": (["x_ops", ""], None, None), "i3": (None, ["c"], None), "i4": (None, None, ["fillfactor=70"]), "i5": (None, ["d", "c"], None), "i6": (None, ["c", "d"], None)}
    rows_ = [(plain[0], n, *plain[1:], *x) for n, x in made.items()]
    assert rows(E.index_equivalence(spark.createDataFrame(rows_, cols))) == [("t", "i1", "i0"), ("t", "i6", "i5")]


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    from weftline.functions import staging

    class Context:
        master = "spark://x"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})()

    with pytest.raises(ValueError):
        staging.shared_dir(Session())
    assert staging.shared_dir(spark)


def test_merge_counts_are_the_snapshots(spark):
    t, s = frame(spark, [(1, 1, "a"), (2, 2, "b"), (3, 3, "c"), (None, 4, "d")]), frame(spark, [(1, 1, "a"), (2, 9, "b"), (5, 5, "e"), (6, 6, "f")])
    for rules in (("update", "insert", "nothing"), ("delete", "insert", "delete"), ("nothing", "insert", "delete")):
        merged = C.delete_rows(C.merge_rows(t, s, ["k"], *rules), "k = 6")
        counted = C.merge_counts(t, s, ["k"], *rules, then_delete="k = 6").first().asDict()
        assert {k: v for k, v in C.change_counts(t.filter("k > 0"), merged.filter("k > 0"), ["k"]).first().asDict().items() if k == "inserted"} == {"inserted": counted["inserted"]}
        assert counted["inserted"] + counted["updated"] + counted["unchanged"] == merged.count() and counted["considered"] == counted["deleted"] + merged.count()


def test_sparse_vectors_and_dimensions(spark):
    most = V.MOST_NONZERO
    df = spark.createDataFrame([(1, [1.0] * 3), (2, [1.0] * (most + 1)), (3, None), (4, [1.0, None])], "id int, v array<double>")
    assert rows(V.check_dims(df, "v", 3, "sparsevec").select("id", "problem")) == [(2, "too_many_nonzero"), (3, "null")]
    assert rows(V.check_dims(df.filter("id <> 2"), "v", 2).select("id", "problem")) == [(1, "length"), (3, "null"), (4, "null_element")]
