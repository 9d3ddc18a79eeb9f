"""Queries of partitions and chunks (P) and of distribution (X)."""

import uuid

from pyspark.sql import functions as F

from ..operators import distribution as X
from ..operators import layout as P
from .frames import orders_holes, spans, table
from .registry import query

RANGES = {"low": {"hi": 100000.0}, "mid": {"lo": 100000.0, "hi": 300000.0}}
ROUTE = "CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice >= 100000 AND o_totalprice < 300000 THEN 'mid'"
DAY = "date_trunc('day', ts)"


def aggs():
    return [F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 4).alias("top")]



@query("p1_route_range", f"SELECT o_orderkey, {ROUTE} ELSE 'rest' END AS partition FROM orders_holes")
def p1(spark, d):
    return P.route_rows(orders_holes(spark, d), "o_totalprice", RANGES, "rest").select("o_orderkey", "partition")


@query("p1_route_list_and_hash", "SELECT CASE WHEN o_orderstatus IN ('F', 'P') THEN 'done' END AS partition, 'h' || CAST(o_orderkey % 4 AS VARCHAR) AS sub, count(*) AS rows FROM orders GROUP BY ALL")
def p1b(spark, d):
    listed = P.route_rows(table(spark, d, "orders"), "o_orderstatus", {"done": {"values": ["F", "P"]}}).withColumnRenamed("partition", "list")
    hashed = P.route_rows(listed, "o_orderkey", {f"h{r}": {"modulus": 4, "remainder": r} for r in range(4)}).withColumnRenamed("partition", "sub")
    return hashed.groupBy(F.col("list").alias("partition"), "sub").agg(F.count(F.lit(1)).alias("rows"))


@query("p1_route_table", "SELECT o_orderkey, coalesce('p' || CAST(c_custkey AS VARCHAR), 'rest') AS partition FROM orders LEFT JOIN customer ON o_custkey >= c_custkey AND o_custkey < c_custkey + 1 AND c_custkey % 3 < 2")
def p1c(spark, d):
    """A range for two of three customers: as many bounds as the table has."""
    bounds = table(spark, d, "customer").filter("c_custkey % 3 < 2").selectExpr("'p' || CAST(c_custkey AS string) AS partition", "'range' AS kind", "c_custkey AS lo", "c_custkey + 1 AS hi")
    return P.route_rows(table(spark, d, "orders"), "o_custkey", bounds, "rest").select("o_orderkey", "partition")


@query("p2_check_attach", "SELECT o_orderkey, o_totalprice FROM orders_holes WHERE (o_totalprice >= 100000 AND o_totalprice < 300000) IS NOT TRUE")
def p2(spark, d):
    return P.check_attach(orders_holes(spark, d), "o_totalprice", RANGES["mid"]).select("o_orderkey", "o_totalprice")


@query("p3_default_conflicts", "SELECT o_orderkey FROM orders_holes WHERE o_totalprice >= 400000 AND o_totalprice < 450000")
def p3(spark, d):
    rest = P.route_rows(orders_holes(spark, d), "o_totalprice", RANGES, "rest").filter("partition = 'rest'")
    return P.default_conflicts(rest, "o_totalprice", {"lo": 400000.0, "hi": 450000.0}).select("o_orderkey")


@query("p4_overlapping_bounds", "WITH b AS (SELECT user_id AS parent, event_id, lo, hi FROM spans WHERE lo < hi), r AS (SELECT *, max(hi) OVER w AS far, arg_max(event_id, hi) OVER w AS a FROM b WINDOW w AS (PARTITION BY parent ORDER BY lo, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT parent, 'range' AS kind, event_id AS b FROM r WHERE lo < far UNION ALL SELECT user_id, 'default', max(event_id) FROM spans WHERE lo = hi GROUP BY 1, 2 HAVING count(*) > 1")
def p4(spark, d):
    s = spans(spark, d)
    bounds = s.select(F.col("user_id").alias("parent"), F.col("event_id").alias("partition"), F.when(F.col("lo") < F.col("hi"), "range").otherwise("default").alias("kind"), "lo", "hi", F.lit(None).cast("string").alias("value"))
    return P.overlapping_bounds(bounds).drop("a")


@query("p5_detach_partition", "SELECT 'kept' AS side, count(*) AS rows FROM orders_holes WHERE (o_totalprice >= 100000 AND o_totalprice < 300000) IS NOT TRUE UNION ALL SELECT 'detached', count(*) FROM orders_holes WHERE o_totalprice >= 100000 AND o_totalprice < 300000")
def p5(spark, d):
    kept, gone = P.detach_partition(orders_holes(spark, d), "o_totalprice", RANGES["mid"])
    count = lambda df, side: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(side).alias("side"), "rows")
    return count(kept, "kept").unionByName(count(gone, "detached"))


@query("p6_partition_stats", f"SELECT {ROUTE} ELSE 'rest' END AS partition, count(*) AS rows, min(o_totalprice) AS min_key, max(o_totalprice) AS max_key FROM orders_holes GROUP BY 1")
def p6(spark, d):
    return P.partition_stats(orders_holes(spark, d), "o_totalprice", RANGES, "rest")


@query("p7_time_chunks", "SELECT event_id, date_trunc('month', ts)::TIMESTAMP AS chunk_start, (date_trunc('month', ts) + INTERVAL 1 MONTH)::TIMESTAMP AS chunk_end FROM events")
def p7(spark, d):
    return P.time_chunks(table(spark, d, "events"), "ts", "1 month").select("event_id", "chunk_start", "chunk_end")


@query("p8_chunk_catalog", f"SELECT {DAY}::TIMESTAMP AS chunk_start, ({DAY} + INTERVAL 1 DAY)::TIMESTAMP AS chunk_end, count(*) AS rows, min(ts) AS min_ts, max(ts) AS max_ts FROM events GROUP BY 1, 2")
def p8(spark, d):
    return P.chunk_catalog(table(spark, d, "events"), "ts", "1 day")


@query("p9_set_chunk_interval", """WITH c AS (SELECT DISTINCT time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS lo FROM events WHERE ts < TIMESTAMP '2024-01-15 12:00:00'),
g AS (SELECT ts, time_bucket(INTERVAL '5 days', ts, TIMESTAMP '1970-01-01') AS s FROM events)
SELECT coalesce(c.lo, greatest(s, (SELECT max(lo) FROM c WHERE lo <= ts) + INTERVAL 7 DAY)) AS chunk_start, coalesce(c.lo + INTERVAL 7 DAY, least(s + INTERVAL 5 DAY, coalesce((SELECT min(lo) FROM c WHERE lo > ts), s + INTERVAL 5 DAY))) AS chunk_end, count(*) AS rows FROM g LEFT JOIN c ON ts >= c.lo AND ts < c.lo + INTERVAL 7 DAY GROUP BY 1, 2""")
def p9(spark, d):
    """Chunks of seven days are there up to the middle of the month; what lies outside them goes to new ones of five days, the first of which is cut."""
    events = table(spark, d, "events")
    chunks = P.chunk_catalog(events.filter("ts < TIMESTAMP_NTZ '2024-01-15 12:00:00'"), "ts", "7 days")
    return P.set_chunk_interval(events, "ts", chunks, "5 days").groupBy("chunk_start", "chunk_end").agg(F.count(F.lit(1)).alias("rows"))


@query("p10_retention", f"SELECT count(*) FILTER ({DAY} + INTERVAL 1 DAY <= TIMESTAMP '2024-01-13 06:00:00') AS rows_dropped, count(DISTINCT {DAY}) FILTER ({DAY} + INTERVAL 1 DAY <= TIMESTAMP '2024-01-13 06:00:00') AS chunks_dropped FROM events")
def p10(spark, d):
    return P.retention(table(spark, d, "events"), "ts", "1 day", "7 days", "2024-01-20 06:00:00", data_loss_ok=True)[1].drop("rows_without_time")


@query("p10_rows_without_time", f"WITH e AS (SELECT event_id, CASE WHEN event_id % 9 > 0 THEN ts END AS ts FROM events), o AS (SELECT *, coalesce({DAY} + INTERVAL 1 DAY <= TIMESTAMP '2024-01-13 06:00:00', false) AS old FROM e) SELECT 'kept' AS side, event_id FROM o WHERE NOT old UNION ALL SELECT 'without_time', count(*) FROM o WHERE ts IS NULL UNION ALL SELECT 'dropped', count(*) FROM o WHERE old")
def p10b(spark, d):
    """A ninth of the rows has no time: they are kept and counted."""
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 9 > 0, F.col("ts")).alias("ts"))
    kept, report = P.retention(e, "ts", "1 day", "7 days", "2024-01-20 06:00:00", data_loss_ok=True, no_time="keep")
    counted = report.select(F.explode(F.array(F.struct(F.lit("without_time").alias("side"), F.col("rows_without_time").alias("event_id")), F.struct(F.lit("dropped").alias("side"), F.col("rows_dropped").alias("event_id")))).alias("r")).select("r.*")
    return kept.select(F.lit("kept").alias("side"), "event_id").unionByName(counted)


@query("p11_columnstore", "SELECT user_id, event_id, ts FROM events")
def p11(spark, d):
    return P.columnstore(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts").desc()])


@query("p12_columnstore_policy", f"SELECT {DAY}::TIMESTAMP AS chunk_start, count(*) AS rows FROM events WHERE {DAY} + INTERVAL 1 DAY <= TIMESTAMP '2024-01-17' GROUP BY 1")
def p12(spark, d):
    return P.columnstore_policy(P.chunk_catalog(table(spark, d, "events"), "ts", "1 day"), "3 days", "2024-01-20 00:00:00").select("chunk_start", "rows")


@query("p13_continuous_aggregate", f"SELECT {DAY}::TIMESTAMP AS bucket, event_type, count(*) AS n, round(max(value), 4) AS top FROM events GROUP BY 1, 2")
def p13(spark, d):
    return P.continuous_aggregate(table(spark, d, "events"), "ts", "1 day", ["event_type"], aggs())


@query("p14_cagg_refresh", f"WITH old AS (SELECT {DAY}::TIMESTAMP AS bucket, event_type, count(*) AS n, round(max(value), 4) AS top FROM events WHERE event_id % 3 > 0 GROUP BY 1, 2), new AS (SELECT {DAY}::TIMESTAMP AS bucket, event_type, count(*) AS n, round(max(value), 4) AS top FROM events GROUP BY 1, 2) SELECT * FROM old WHERE NOT (bucket >= TIMESTAMP '2024-01-10' AND bucket + INTERVAL 1 DAY <= TIMESTAMP '2024-01-18') UNION ALL SELECT * FROM new WHERE bucket >= TIMESTAMP '2024-01-10' AND bucket + INTERVAL 1 DAY <= TIMESTAMP '2024-01-18'")
def p14(spark, d):
    e = table(spark, d, "events")
    old = P.continuous_aggregate(e.filter("event_id % 3 > 0"), "ts", "1 day", ["event_type"], aggs())
    return P.cagg_refresh(old, e, "ts", "1 day", ["event_type"], aggs(), "10 days", "2 days", "2024-01-20 00:00:00")


@query("p15_cagg_realtime", f"SELECT {DAY}::TIMESTAMP AS bucket, event_type, count(*) AS n, round(max(value), 4) AS top FROM events GROUP BY 1, 2")
def p15(spark, d):
    e = table(spark, d, "events")
    old = P.continuous_aggregate(e.filter("ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'"), "ts", "1 day", ["event_type"], aggs())
    return P.cagg_realtime(old, e, "ts", "1 day", ["event_type"], aggs(), False)


@query("p17_sliding_windows", "WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') - INTERVAL 1 HOUR]) AS s FROM events) SELECT s AS start, s + INTERVAL 2 HOUR AS \"end\", event_type, count(*) AS rows FROM w GROUP BY ALL")
def p17(spark, d):
    return P.window_counts(table(spark, d, "events"), "ts", "sliding", "2 hours", ["event_type"], "1 hour")


@query("p17_session_windows", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL 3 HOUR AS \"end\", user_id, count(*) AS rows FROM s GROUP BY user_id, i")
def p17b(spark, d):
    return P.window_counts(table(spark, d, "events"), "ts", "session", "3 hours", ["user_id"])


@query("p18_unique_covers", "SELECT 't' || CAST(c_custkey % 7 AS VARCHAR) AS \"table\", 'u' || CAST(c_custkey AS VARCHAR) AS name, CASE WHEN c_custkey % 2 = 0 THEN ['ts'] ELSE ['id', 'ts'] END AS missing FROM customer WHERE c_custkey % 3 > 0")
def p18(spark, d):
    c = table(spark, d, "customer").selectExpr("'t' || CAST(c_custkey % 7 AS string) AS table", "'u' || CAST(c_custkey AS string) AS name", "CASE WHEN c_custkey % 3 = 0 THEN array('id', 'ts') WHEN c_custkey % 2 = 0 THEN array('id', 'x') ELSE array('x') END AS columns")
    dims = c.select("table").distinct().select("table", F.explode(F.array(F.lit("id"), F.lit("ts"))).alias("dimension"))
    return P.unique_covers_partition_key(c, dims)


@query("x1_distribute", "SELECT user_id % 16 AS shard, count(*) AS rows FROM events GROUP BY 1")
def x1(spark, d):
    return X.distribute(table(spark, d, "events"), "user_id", 16, "modulo").groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count(F.lit(1)).alias("rows"))


@query("x1_distribute_range", "SELECT CASE WHEN o_orderkey >= 10000 THEN 2 WHEN o_orderkey >= 5000 THEN 1 ELSE 0 END AS shard, count(*) AS rows FROM orders GROUP BY 1")
def x1b(spark, d):
    return X.distribute(table(spark, d, "orders"), "o_orderkey", 3, "range", [0, 5000, 10000]).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))


@query("x2_colocated_join", "SELECT o_orderkey, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def x2(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return X.colocated_join(table(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", 16).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("lines"))


@query("x2_written_colocated", "SELECT o_orderkey, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def x2_written(spark, d):
    """Both sides are written in buckets; the join and the count after it then need no exchange."""
    names = [f"colocated_{uuid.uuid4().hex}" for _ in range(2)]
    X.write_colocated(table(spark, d, "orders").select("o_orderkey"), names[0], "o_orderkey", 16)
    X.write_colocated(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), names[1], "o_orderkey", 16)
    return X.bucketed_join(spark, *names, "o_orderkey").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("lines"))


@query("x3_reference_join", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def x3(spark, d):
    return X.reference_join(table(spark, d, "customer"), table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("x4_alter_distribution", "SELECT 'orders' AS name, CAST(o_custkey % 8 AS INTEGER) AS shard, count(*) AS rows FROM orders GROUP BY ALL UNION ALL SELECT 'customer', CAST(c_custkey % 8 AS INTEGER), count(*) FROM customer GROUP BY ALL")
def x4(spark, d):
    frames = {"orders": table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "customer": table(spark, d, "customer").select(F.col("c_custkey").alias("k"))}
    first = X.alter_distribution(frames, "k", 32, "modulo")
    again = X.alter_distribution(first, "k", 8, "modulo")
    return X.union_fleet(again, "name").groupBy("name", "shard").agg(F.count(F.lit(1)).alias("rows"))


@query("x5_shard_stats", "WITH k AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT CAST(user_id % 8 AS INTEGER) AS shard, CAST(sum(n) AS BIGINT) AS rows, round(sum(n) / ((SELECT count(*) FROM events) / 8.0::DOUBLE), 6) AS skew, max(n) AS heaviest FROM k GROUP BY 1")
def x5(spark, d):
    return X.shard_stats(table(spark, d, "events"), "user_id", 8, "modulo")


@query("x6_salted_heavy_keys", "WITH h AS (SELECT event_type FROM events GROUP BY 1 HAVING count(*) > 0.2 * (SELECT count(*) FROM events)) SELECT event_type, CAST(CASE WHEN event_type IN (SELECT event_type FROM h) THEN event_id % 8 ELSE 0 END AS INTEGER) AS salt, count(*) AS rows FROM events GROUP BY ALL")
def x6b(spark, d):
    e = table(spark, d, "events")
    return X.salted(e, "event_type", X.heavy_keys(e, "event_type", 0.2), 8, F.col("event_id")).groupBy("event_type", "salt").agg(F.count(F.lit(1)).alias("rows"))


@query("x7_per_tenant_apply", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events")
def x7(spark, d):
    def placed(t):
        t = t.sort_values(["ts", "event_id"])
        return t.assign(place=range(1, len(t) + 1))[["user_id", "event_id", "place"]]

    return X.per_tenant_apply(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", placed, "user_id long, event_id long, place long")


@query("x7_tenant_batches", "SELECT user_id, event_id, CAST(row_number() OVER w AS BIGINT) AS place, CAST(sum(event_id % 11) OVER w AS BIGINT) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def x7_batches(spark, d):
    """Places and running totals of each tenant, carried over batches."""

    def step(state, batch):
        import pyarrow as pa
        import pyarrow.compute as pc

        place, total = state or (0, 0)
        totals = pc.cumulative_sum(pa.array([e % 11 for e in batch.column("event_id").to_pylist()], pa.int64()), start=total)
        out = pa.RecordBatch.from_arrays([batch.column("user_id"), batch.column("event_id"), pa.array(range(place + 1, place + 1 + batch.num_rows), pa.int64()), totals], names=["user_id", "event_id", "place", "total"])
        return (place + batch.num_rows, totals[-1].as_py()), out

    events = table(spark, d, "events").select("user_id", "event_id", "ts")
    return X.per_tenant_batches(events, "user_id", ["ts", "event_id"], step, "user_id long, event_id long, place long, total long")


@query("x8_union_fleet", "SELECT database, count(*) AS rows, count(s_name) AS named FROM (SELECT 'customers' AS database, NULL AS s_name FROM customer UNION ALL SELECT 'suppliers', s_name FROM supplier) GROUP BY 1")
def x8(spark, d):
    return X.union_fleet({"customers": table(spark, d, "customer"), "suppliers": table(spark, d, "supplier")}).groupBy("database").agg(F.count(F.lit(1)).alias("rows"), F.count("s_name").alias("named"))
