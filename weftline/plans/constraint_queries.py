"""Queries of constraint validation (C)."""

from pyspark.sql import functions as F

from ..operators import constraints as C
from .frames import KEY, orders_dups, orders_holes, orders_orphans, spans, table
from .registry import query


@query("c1_not_null", "SELECT * FROM orders_holes WHERE o_custkey IS NULL OR o_totalprice IS NULL")
def c1(spark, d):
    return C.check_not_null(orders_holes(spark, d), ["o_custkey", "o_totalprice"])


@query("c2_check", "SELECT * FROM orders_holes WHERE (o_totalprice > 200000) IS FALSE")
def c2(spark, d):
    return C.check_constraint(orders_holes(spark, d), "o_totalprice > 200000")


@query("c3_unique", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem WHERE l_quantity > 10 GROUP BY ALL HAVING count(*) > 1")
def c3(spark, d):
    return C.check_unique(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_quantity > 10")


@query("c4_primary_key", "SELECT o_orderkey, o_custkey, count(*) AS rows FROM (SELECT * FROM orders_holes UNION ALL SELECT * FROM orders_holes WHERE o_orderkey % 20 = 0) GROUP BY ALL HAVING count(*) > 1 OR o_orderkey IS NULL OR o_custkey IS NULL")
def c4(spark, d):
    o = orders_holes(spark, d)
    return C.check_primary_key(o.unionByName(o.filter("o_orderkey % 20 = 0")), ["o_orderkey", "o_custkey"])


@query("c5_domain", "SELECT 'orders' AS \"table\", 'o_totalprice' AS \"column\", count(*) FILTER (o_totalprice IS NULL OR (o_totalprice < 400000) IS FALSE) AS violations FROM orders_holes UNION ALL SELECT 'part', 'p_retailprice', count(*) FILTER (p_retailprice IS NULL OR (p_retailprice < 400000) IS FALSE) FROM part UNION ALL SELECT 'part', 'p_size', count(*) FILTER (p_size IS NULL OR (p_size < 400000) IS FALSE) FROM part")
def c5(spark, d):
    return C.check_domain({"orders": orders_holes(spark, d), "part": table(spark, d, "part")}, {"orders": ["o_totalprice"], "part": ["p_retailprice", "p_size"]}, ["value < 400000"], not_null=True)


@query("c6_enum", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def c6(spark, d):
    return C.check_enum(table(spark, d, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey", "c_mktsegment")


@query("c7_enum_order", "SELECT o_orderkey, o_orderstatus, CAST(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 WHEN 'F' THEN 3 END AS BIGINT) AS label_order FROM orders")
def c7(spark, d):
    return C.enum_order(table(spark, d, "orders"), "o_orderstatus", C.add_enum_value(["O", "F"], "P", before="F")).select("o_orderkey", "o_orderstatus", "label_order")


@query("c8_foreign_key", "SELECT * FROM orders_orphans o WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o.o_custkey)")
def c8(spark, d):
    return C.check_foreign_key(orders_orphans(spark, d), ["o_custkey"], table(spark, d, "customer"), ["c_custkey"])


@query("c9_foreign_key_period", "WITH p AS (SELECT * FROM spans WHERE event_id % 3 > 0 AND lo < hi), s AS (SELECT user_id, lo, hi, CASE WHEN lo > max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE THEN 1 ELSE 0 END AS f FROM p), g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS i FROM s), m AS (SELECT user_id, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY user_id, i) SELECT * FROM spans c WHERE lo < hi AND NOT EXISTS (SELECT 1 FROM m WHERE m.user_id = c.user_id AND m.lo <= c.lo AND c.hi <= m.hi)")
def c9(spark, d):
    s = spans(spark, d)
    return C.check_foreign_key_period(s, s.filter("event_id % 3 > 0"), ["user_id"], "lo", "hi")


@query("c10_without_overlaps", "SELECT DISTINCT a.* FROM spans a JOIN spans b ON a.user_id = b.user_id AND a.lo < a.hi AND b.lo < b.hi AND a.event_id <> b.event_id AND (b.lo, b.hi, b.event_id) < (a.lo, a.hi, a.event_id) AND a.lo < b.hi")
def c10(spark, d):
    return C.check_without_overlaps(spans(spark, d), ["user_id"], "lo", "hi")


@query("c11_exclusion", "SELECT a.event_id AS id_a, b.event_id AS id_b FROM (SELECT s.*, event_type FROM spans s JOIN events USING (event_id)) a JOIN (SELECT s.*, event_type FROM spans s JOIN events USING (event_id)) b ON a.user_id = b.user_id AND a.event_type <> b.event_type AND a.event_id < b.event_id AND a.lo < b.hi AND b.lo < a.hi AND a.lo < a.hi AND b.lo < b.hi")
def c11(spark, d):
    s = spans(spark, d).join(table(spark, d, "events").select("event_id", "event_type"), "event_id")
    return C.check_exclusion(s, "event_id", [("user_id", "="), ("lo,hi", "&&"), ("event_type", "<>")])


@query("c11_exclusion_without_equal", "WITH s AS (SELECT event_id, event_type, ts AS lo, ts + to_seconds(CAST(event_id % 5 AS INTEGER) * 20) AS hi FROM events) SELECT a.event_id AS id_a, b.event_id AS id_b FROM s a JOIN s b ON a.event_type <> b.event_type AND a.event_id < b.event_id AND a.lo < b.hi AND b.lo < a.hi AND a.lo < a.hi AND b.lo < b.hi")
def c11b(spark, d):
    """No element is an equality: ranges meet in bins of time alone."""
    s = table(spark, d, "events").select("event_id", "event_type", F.col("ts").alias("lo"), (F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 5 * 20).cast("decimal(18,6)"))).alias("hi"))
    return C.check_exclusion(s, "event_id", [("lo,hi", "&&"), ("event_type", "<>")])


def _deleted(spark, d, action):
    c = table(spark, d, "customer")
    tables = {"customer": (c, ["c_custkey"]), "orders": (table(spark, d, "orders"), ["o_orderkey"])}
    made_by = C.Reference("orders", ("o_custkey",), "customer", ("c_custkey",), action)
    return C.delete_with_references(tables, [made_by], "customer", c.filter("c_custkey % 9 = 0"))["orders"]


@query("c12_delete_set_null", "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 = 0) THEN NULL ELSE o_custkey END AS o_custkey FROM orders")
def c12(spark, d):
    return _deleted(spark, d, "set null").select("o_orderkey", "o_custkey")


@query("c12_delete_cascade", "SELECT * FROM orders WHERE o_custkey % 9 <> 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer)")
def c12b(spark, d):
    return _deleted(spark, d, "cascade")


@query("c12_delete_levels", """WITH RECURSIVE gone(k) AS (SELECT c_custkey FROM customer WHERE c_custkey IN (2, 7) UNION SELECT c_custkey FROM customer JOIN gone ON c_custkey // 3 = k AND c_custkey > 2),
o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT k FROM gone)), c AS (SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT k FROM gone))
SELECT 'customer' AS "table", c_custkey AS key, CASE WHEN c_custkey > 2 AND c_custkey // 3 IN (SELECT c_custkey FROM customer) THEN c_custkey // 3 END AS reference FROM customer WHERE c_custkey NOT IN (SELECT k FROM gone)
UNION ALL SELECT 'orders', o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)
UNION ALL SELECT 'lineitem', l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)
UNION ALL SELECT 'events', event_id, CASE WHEN user_id IN (SELECT k FROM gone) THEN 1 ELSE user_id END FROM events""")
def c12c(spark, d):
    """Two customers go: with them all whom they referred, through all levels, their orders and the lines of those; events change to customer 1."""
    customer = table(spark, d, "customer").withColumn("referrer", F.when(F.col("c_custkey") > 2, F.expr("c_custkey div 3")))
    customer = customer.join(customer.select(F.col("c_custkey").alias("referrer"), F.lit(True).alias("there")), "referrer", "left").select("c_custkey", F.when(F.col("there"), F.col("referrer")).alias("referrer"))
    events = table(spark, d, "events").select("event_id", "user_id")
    tables = {"customer": (customer, ["c_custkey"]), "orders": (table(spark, d, "orders"), ["o_orderkey"]), "lineitem": (table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"]), "events": (events, ["event_id"])}
    references = [
        C.Reference("customer", ("referrer",), "customer", ("c_custkey",), "cascade"),
        C.Reference("orders", ("o_custkey",), "customer", ("c_custkey",), "cascade"),
        C.Reference("lineitem", ("l_orderkey",), "orders", ("o_orderkey",), "cascade"),
        C.Reference("events", ("user_id",), "customer", ("c_custkey",), "set default", (1,)),
    ]
    out = C.delete_with_references(tables, references, "customer", customer.filter("c_custkey IN (2, 7)"))
    long = lambda name, key, ref: out[name].select(F.lit(name).alias("table"), F.col(key).cast("long").alias("key"), F.col(ref).cast("long").alias("reference"))
    return long("customer", "c_custkey", "referrer").unionByName(long("orders", "o_orderkey", "o_custkey")).unionByName(long("lineitem", "l_orderkey", "l_linenumber")).unionByName(long("events", "event_id", "user_id"))


@query("c13_policy_write", "SELECT * FROM orders_holes WHERE (o_totalprice > 200000) IS NOT TRUE")
def c13(spark, d):
    return C.check_policy_write(orders_holes(spark, d), "o_totalprice > 200000")


@query("c14_validation_report", "SELECT 'customer' AS name, count(*) AS rows, count(*) FILTER (o_custkey IS NULL) AS violations, count(*) FILTER (o_custkey IS NULL) = 0 AS valid FROM orders_holes UNION ALL SELECT 'price', count(*), count(*) FILTER ((o_totalprice > 1000) IS FALSE), count(*) FILTER ((o_totalprice > 1000) IS FALSE) = 0 FROM orders_holes UNION ALL SELECT 'status', count(*), count(*) FILTER ((o_orderstatus IN ('F', 'O')) IS FALSE), count(*) FILTER ((o_orderstatus IN ('F', 'O')) IS FALSE) = 0 FROM orders_holes")
def c14(spark, d):
    return C.validation_report(orders_holes(spark, d), {"customer": "NOT NULL o_custkey", "price": "o_totalprice > 1000", "status": "o_orderstatus IN ('F', 'O')"})


@query("c15_quarantine", "SELECT o_orderkey, list_filter([CASE WHEN (o_totalprice > 200000) IS FALSE THEN 'price' END, CASE WHEN (o_orderstatus <> 'F') IS FALSE THEN 'status' END], lambda x: x IS NOT NULL) AS failed FROM orders_holes WHERE (o_totalprice > 200000) IS FALSE OR (o_orderstatus <> 'F') IS FALSE")
def c15(spark, d):
    """The batch form of the quarantine stream: rejected rows with the names that they fail."""
    o = orders_holes(spark, d).withColumn("failed", C.failed_names({"price": "o_totalprice > 200000", "status": "o_orderstatus <> 'F'"}))
    return C.quarantine(o, F.size("failed") > 0)[1].select("o_orderkey", "failed")


@query("c16_constraint_impact", "SELECT 'pk' || CAST(c_custkey AS VARCHAR) AS object, 'fk' || CAST(o_orderkey AS VARCHAR) AS blocked_by, 'key' AS kind FROM customer JOIN orders ON o_custkey = c_custkey UNION ALL SELECT 'c' || CAST(o_custkey AS VARCHAR), 'fk' || CAST(o_orderkey AS VARCHAR), 'table' FROM orders UNION ALL SELECT 'o' || CAST(l_orderkey AS VARCHAR), 'v' || CAST(l_partkey AS VARCHAR), 'view' FROM lineitem")
def c16(spark, d):
    """A catalogue in which each customer is a table with a key, each order one that refers to it, and parts are views over orders."""
    o = table(spark, d, "orders")
    keys = table(spark, d, "customer").selectExpr("'c' || CAST(c_custkey AS string) AS table", "'pk' || CAST(c_custkey AS string) AS name")
    fks = o.selectExpr("'fk' || CAST(o_orderkey AS string) AS name", "'o' || CAST(o_orderkey AS string) AS table", "'c' || CAST(o_custkey AS string) AS ref_table", "'pk' || CAST(o_custkey AS string) AS ref_constraint")
    views = table(spark, d, "lineitem").selectExpr("'v' || CAST(l_partkey AS string) AS view", "'o' || CAST(l_orderkey AS string) AS relation")
    return C.constraint_impact(keys, fks, views)
