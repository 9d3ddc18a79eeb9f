"""Queries that run as streams over all that is available (E6, C15, P16, B10, F5)."""

import uuid

from pyspark.sql import functions as F

from ..functions.staging import settled, shared_dir
from ..streaming import streams as R
from .data_queries import ADDED, _feed
from .frames import KEY, orders_holes, table
from .registry import query

#: Rows of a file that a stream reads.
FILE_ROWS = 500_000


def _folder(spark, name):
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{base}/data", f"{base}/checkpoint"


def _streamed(spark, df, name, files=4, order=None):
    """``df`` written in at least ``files`` files and read back as a stream of ``files`` batches or more.

    With ``order`` a batch is a range of it: ranges are written in turn, each in as many
    files as its rows need, and a batch takes as many files as a range has.
    """
    folder, checkpoint = _folder(spark, name)
    if order is None:
        df.repartition(files).write.parquet(f"{folder}/in")
        return R.read_stream(spark, f"{folder}/in", df.schema, 1), folder, checkpoint
    cuts = df.selectExpr(f"percentile_approx({order}, array({', '.join(str(i / files) for i in range(1, files))}), 10000) AS c").first()["c"]
    place = sum((F.col(order) > F.lit(c)).cast("int") for c in cuts)
    each = max(1, min(1000, df.count() // (files * FILE_ROWS)))
    ranged = settled(df.withColumn("__range", place).repartition(files, "__range"), "ranges")
    for n in range(files):
        ranged.filter(F.col("__range") == n).drop("__range").repartition(each).write.mode("append").parquet(f"{folder}/in")
    return R.read_stream(spark, f"{folder}/in", df.schema, each), folder, checkpoint


@query("e6_fill_new_rows", "SELECT o_orderkey, coalesce(o_custkey, CASE WHEN o_orderstatus = 'F' THEN 11 WHEN o_orderstatus = 'O' THEN 12 END) AS o_custkey FROM orders_holes")
def e6(spark, d):
    stream, folder, checkpoint = _streamed(spark, orders_holes(spark, d).select("o_orderkey", "o_orderstatus", "o_custkey"), "fill")
    known = table(spark, d, "region").filter("r_regionkey < 2").selectExpr("CASE r_regionkey WHEN 0 THEN 'F' ELSE 'O' END AS o_orderstatus", "CAST(11 + r_regionkey AS long) AS fill")
    return R.incremental_apply(stream, lambda b: R.fill_new_rows(b, "o_custkey", known, "o_orderstatus", "fill"), folder, checkpoint).select("o_orderkey", "o_custkey")


@query("c15_quarantine_stream", "SELECT o_orderkey, 'price' AS failed FROM orders_holes WHERE (o_totalprice > 200000) IS FALSE")
def c15(spark, d):
    stream, folder, checkpoint = _streamed(spark, orders_holes(spark, d), "quarantine")
    R.quarantine_stream(stream, {"price": "o_totalprice > 200000"}, folder, checkpoint)
    return spark.read.parquet(f"{folder}/rejected").select("o_orderkey", F.array_join("failed", ",").alias("failed"))


CLOSED = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)"


@query("p16_cagg_stream", f"SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING bucket + INTERVAL 6 HOUR <= {CLOSED}")
def p16(spark, d):
    """The events come in four files by time, one a batch; then every fiftieth of the first half comes once more.

    A bucket is kept over batches until it is closed, and what comes for it afterwards
    is late and dropped.
    """
    events = table(spark, d, "events").select("ts", "event_type", "event_id")
    stream, folder, checkpoint = _streamed(spark, events, "cagg", order="ts")
    half = events.selectExpr("percentile_approx(ts, 0.5)").first()[0]
    events.filter((F.col("event_id") % 50 == 0) & (F.col("ts") < F.lit(half))).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    R.write_batches(R.cagg_stream(stream, "ts", "6 hours", ["event_type"], {"n": F.count(F.lit(1))}, "1 hour"), folder, checkpoint, {"rows": lambda b: b})
    return spark.read.parquet(f"{folder}/rows").select("bucket", "event_type", "n")


@query("p17_session_stream", f"WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL 3 HOUR AS \"end\", user_id, count(*) AS rows FROM s GROUP BY user_id, i HAVING max(ts) + INTERVAL 3 HOUR <= {CLOSED}")
def p17(spark, d):
    """Sessions of the events, which come in four files by time; those that the watermark has closed at the end."""
    stream, folder, checkpoint = _streamed(spark, table(spark, d, "events").select("ts", "user_id"), "sessions", order="ts")
    R.write_batches(R.window_stream(stream, "ts", "session", "3 hours", ["user_id"], "1 hour"), folder, checkpoint, {"rows": lambda b: b})
    return spark.read.parquet(f"{folder}/rows").select("start", "end", "user_id", "rows")


@query("p17_sliding_stream", f"WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') - INTERVAL 1 HOUR]) AS s FROM events) SELECT s AS start, s + INTERVAL 2 HOUR AS \"end\", event_type, count(*) AS rows FROM w GROUP BY ALL HAVING s + INTERVAL 2 HOUR <= {CLOSED}")
def p17b(spark, d):
    stream, folder, checkpoint = _streamed(spark, table(spark, d, "events").select("ts", "event_type"), "sliding", order="ts")
    R.write_batches(R.window_stream(stream, "ts", "sliding", "2 hours", ["event_type"], "1 hour", "1 hour"), folder, checkpoint, {"rows": lambda b: b})
    return spark.read.parquet(f"{folder}/rows").select("start", "end", "event_type", "rows")


@query("b10_incremental_apply", "SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders WHERE o_orderstatus = 'O'")
def b10(spark, d):
    stream, folder, checkpoint = _streamed(spark, table(spark, d, "orders"), "incremental")
    return R.incremental_apply(stream, lambda b: b.filter("o_orderstatus = 'O'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("doubled")), folder, checkpoint)


@query("f5_subscribe", f"SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 2 WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 10 > 0 UNION ALL {ADDED}")
def f5(spark, d):
    """The feed's four rounds come in a batch each; the subscription is then started again with nothing new."""
    stream, folder, checkpoint = _streamed(spark, _feed(spark, d), "subscribe", order="seq")
    R.subscribe(stream, table(spark, d, "orders"), KEY, f"{folder}/target", checkpoint, compact_after=3)
    return R.subscribe(stream, table(spark, d, "orders"), KEY, f"{folder}/target", checkpoint, compact_after=3)
