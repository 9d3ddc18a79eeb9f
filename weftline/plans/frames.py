"""Frames that are derived from the tables by rule, in Spark and in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["o_orderkey"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def orders_delta(spark, d):
    o = table(spark, d, "orders")
    return o.filter("o_orderkey % 10 = 0").withColumns({"o_totalprice": F.col("o_totalprice") * 1.1, "o_orderstatus": F.lit("U")}).unionByName(o.filter("o_orderkey % 50 = 1").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000))


def orders_kept(spark, d):
    return table(spark, d, "orders").filter("o_orderkey % 97 <> 0")


def orders_v2(spark, d):
    from ..operators.changes import merge_rows

    return merge_rows(table(spark, d, "orders"), orders_delta(spark, d), KEY, check=False).filter("o_orderkey % 97 <> 0")


def orders_holes(spark, d):
    return table(spark, d, "orders").withColumns({"o_custkey": F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")), "o_totalprice": F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice"))})


def orders_orphans(spark, d):
    return table(spark, d, "orders").withColumn("o_custkey", F.when(F.col("o_orderkey") % 13 == 0, F.col("o_custkey") + 10_000_000).otherwise(F.col("o_custkey")))


def orders_dups(spark, d):
    o = table(spark, d, "orders")
    return o.unionByName(o.filter("o_orderkey % 20 = 0"))


def spans(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", F.col("ts").alias("lo"), (F.col("ts") + F.make_dt_interval(hours=F.col("event_id") % 5)).alias("hi"))


def raw_text(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 17 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("raw"))


def wait_edges(spark, d):
    """Waiter n is blocked by n / 2, with a cycle between two ids; n are the ids of events from 1 on."""
    e = table(spark, d, "events").select(F.col("event_id").alias("waiter")).filter("waiter > 0")
    cycle = spark.range(1).select(F.lit(2).cast("long").alias("waiter"), F.lit(5).cast("long").alias("blocker"))
    return e.select("waiter", F.expr("waiter div 2").alias("blocker")).unionByName(cycle)


CTES = {
    "orders_delta": "SELECT * REPLACE (o_totalprice * 1.1::DOUBLE AS o_totalprice, 'U' AS o_orderstatus) FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT * REPLACE (o_orderkey + 10000000 AS o_orderkey) FROM orders WHERE o_orderkey % 50 = 1",
    "orders_kept": "SELECT * FROM orders WHERE o_orderkey % 97 <> 0",
    "orders_v2": "SELECT * FROM (SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders_delta) UNION ALL SELECT * FROM orders_delta) WHERE o_orderkey % 97 <> 0",
    "orders_holes": "SELECT * REPLACE (CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS o_custkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS o_totalprice) FROM orders",
    "orders_orphans": "SELECT * REPLACE (CASE WHEN o_orderkey % 13 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS o_custkey) FROM orders",
    "orders_dups": "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 20 = 0",
    "spans": "SELECT event_id, user_id, ts AS lo, ts + to_hours(CAST(event_id % 5 AS INTEGER)) AS hi FROM events",
    "raw_text": "SELECT event_id, event_type, CASE WHEN event_id % 17 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS raw FROM events",
    "wait_edges": "SELECT event_id AS waiter, event_id // 2 AS blocker FROM events WHERE event_id > 0 UNION ALL SELECT 2, 5",
}


def with_frames(sql: str) -> str:
    """``sql`` with the derived frames that it names put before it."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in CTES:
            if re.search(rf"\b{name}\b", text) and name not in wanted:
                need(CTES[name])
                wanted.append(name)

    need(sql)
    if not wanted:
        return sql
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in wanted)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[len('WITH RECURSIVE'):]}"
    return f"WITH {head}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {head} {body}"
