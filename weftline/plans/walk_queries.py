"""Queries of batches and cursors (B)."""

from pyspark.sql import functions as F

from ..operators import walk as B
from .frames import orders_holes, table
from .registry import query


@query("b1_keyset_batches", "SELECT CAST((rn - 1) // 1000 + 1 AS BIGINT) AS batch, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(*) AS rows FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders WHERE o_totalprice > 50000) GROUP BY 1")
def b1(spark, d):
    return B.keyset_batches(table(spark, d, "orders"), ["o_orderkey"], 1000, "o_totalprice > 50000")


@query("b2_compound_keyset", "SELECT CAST((rn - 1) // 50 + 1 AS BIGINT) AS batch, min(conv_id * 1000 + turn) AS first_key, max(conv_id * 1000 + turn) AS last_key, count(*) AS rows FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS rn FROM conversations) GROUP BY 1")
def b2(spark, d):
    flat = lambda c: (F.col(f"{c}.conv_id") * 1000 + F.col(f"{c}.turn")).alias(c)
    return B.keyset_batches(table(spark, d, "conversations"), ["conv_id", "turn"], 50).select("batch", flat("first_key"), flat("last_key"), "rows")


@query("b3_grouped_batches", "SELECT event_type, CAST((rn - 1) // 300 + 1 AS BIGINT) AS batch, min(event_id) AS first_key, max(event_id) AS last_key, count(*) AS rows FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) GROUP BY ALL")
def b3(spark, d):
    return B.grouped_batches(table(spark, d, "events"), "event_type", "event_id", 300)


@query("b4_byte_budget_batches", "WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(strlen(props) AS BIGINT) AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events), r AS (SELECT user_id, event_id, rn, 1::BIGINT AS batch, 1::BIGINT AS n, size AS total, size FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.event_id, e.rn, CASE WHEN r.n >= 20 OR r.total + e.size > 400 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.n >= 20 OR r.total + e.size > 400 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 20 OR r.total + e.size > 400 THEN e.size ELSE r.total + e.size END, e.size FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1) SELECT user_id, batch, min(event_id) AS first_key, max(event_id) AS last_key, count(*) AS rows, CAST(sum(size) AS BIGINT) AS bytes FROM r GROUP BY user_id, batch")
def b4(spark, d):
    return B.byte_budget_batches(table(spark, d, "events").withColumn("size", F.octet_length("props")), "user_id", "event_id", "size", 400, 20)


@query("b5_upper_bound", "SELECT count(*) AS rows, max(o_orderkey) AS bound FROM orders WHERE o_orderkey <= (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'P')")
def b5(spark, d):
    o = table(spark, d, "orders")
    return B.up_to_bound(o, "o_orderkey", B.upper_bound(o.filter("o_orderstatus = 'P'"), "o_orderkey")).agg(F.count(F.lit(1)).alias("rows"), F.max("o_orderkey").alias("bound"))


@query("b6_cursor_is_stale", "SELECT EXISTS (SELECT 1 FROM orders_holes WHERE o_totalprice IS NULL AND (o_orderstatus, o_orderkey) <= ('F', 700)) AS stale")
def b6(spark, d):
    return B.cursor_is_stale(orders_holes(spark, d), "o_totalprice IS NULL", ["o_orderstatus", "o_orderkey"], ["F", 700])


STATES = "CASE o_orderkey % 6 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' WHEN 2 THEN 'running' WHEN 3 THEN 'cancelled' WHEN 4 THEN 'interrupted' ELSE 'aborted' END"


@query("b7_resume", f"SELECT 'p' || CAST(o_custkey % 40 AS VARCHAR) AS plan_digest, CAST(o_orderkey % 3 AS INTEGER) AS ordinal, CAST(arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS VARCHAR) AS last_key, max(o_orderdate) AS updated_at FROM orders WHERE {STATES} <> 'succeeded' GROUP BY ALL")
def b7(spark, d):
    o = table(spark, d, "orders")
    jobs = o.selectExpr("o_orderkey AS job_id", "'p' || CAST(o_custkey % 40 AS string) AS plan_digest", f"{STATES} AS state")
    return B.resume(o.selectExpr("o_orderkey AS job_id", "CAST(o_orderkey % 3 AS int) AS ordinal", "CAST(o_orderkey AS string) AS last_key", "o_orderdate AS updated_at"), jobs)


@query("b8_walk_progress", "SELECT share, 60 * (1 - share) / (share - 0.1::DOUBLE) AS seconds_left FROM (SELECT count(*) FILTER (o_orderkey <= 5000)::DOUBLE / count(*) AS share FROM orders)")
def b8(spark, d):
    return B.walk_progress(table(spark, d, "orders"), "o_orderkey", 5000, 0.1, 60.0)


@query("b9_commit_reasons", "SELECT CASE WHEN l_quantity > 45 THEN 'lock_waiter' WHEN l_partkey % 500 >= 400 THEN 'interval' WHEN l_suppkey >= 80 THEN 'batch_cap' WHEN l_linenumber = 1 THEN 'group_end' ELSE 'final' END AS reason, count(*) AS batches FROM lineitem GROUP BY 1")
def b9(spark, d):
    b = table(spark, d, "lineitem").selectExpr("l_suppkey AS rows", "l_partkey % 500 AS elapsed_ms", "CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END AS waiters", "l_linenumber = 1 AS group_end")
    return B.commit_reasons(b, 400, 80)
