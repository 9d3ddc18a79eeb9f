"""Queries of schema evolution (E)."""

from pyspark.sql import functions as F

from ..operators import schema as E
from .frames import KEY, orders_holes, orders_v2, raw_text, table
from .registry import query

O = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@query("e1_add_column", "SELECT *, CAST(0 AS INTEGER) AS flags FROM orders")
def e1(spark, d):
    return E.add_column(table(spark, d, "orders"), "flags", "int", F.lit(0), nullable=False)


def _fill(spark, d):
    nations = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return [{"from": table(spark, d, "customer").filter("c_acctbal > 0"), "on": {"o_custkey": "c_custkey"}, "value": "CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END"}, {"from": nations, "on": {"o_custkey": "c_custkey"}, "value": "n_name"}, "CASE WHEN o_orderkey % 2 = 0 THEN 'none' END"]


FILL = "FROM orders_holes o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) a ON a.c_custkey = o.o_custkey LEFT JOIN (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey) b ON b.c_custkey = o.o_custkey"
V1 = "CASE WHEN a.c_custkey % 3 > 0 THEN a.c_mktsegment END"
V3 = "CASE WHEN o.o_orderkey % 2 = 0 THEN 'none' END"


@query("e2_fill_sources", f"SELECT o.*, coalesce({V1}, b.n_name, {V3}) AS segment {FILL}")
def e2(spark, d):
    return E.fill_column(orders_holes(spark, d), "segment", "string", _fill(spark, d))


@query("e3_fill_over_default", "SELECT * REPLACE (CASE WHEN o_orderstatus = 'O' AND o_custkey IS NOT NULL AND 'C' || CAST(o_custkey AS VARCHAR) <> 'O' THEN 'C' || CAST(o_custkey AS VARCHAR) ELSE o_orderstatus END AS o_orderstatus) FROM orders_holes")
def e3(spark, d):
    return E.fill_over_default(orders_holes(spark, d), "o_orderstatus", F.lit("O"), "'C' || CAST(o_custkey AS string)")


@query("e4_unfilled_rows", f"SELECT o.*, coalesce({V1}, b.n_name, {V3}) AS segment {FILL} WHERE coalesce({V1}, b.n_name, {V3}) IS NULL")
def e4(spark, d):
    return E.unfilled_rows(e2(spark, d), "segment")


@query("e5_fill_source_histogram", f"SELECT CASE WHEN {V1} IS NOT NULL THEN 1 WHEN b.n_name IS NOT NULL THEN 2 WHEN {V3} IS NOT NULL THEN 3 ELSE 0 END AS source, count(*) AS rows {FILL} GROUP BY 1")
def e5(spark, d):
    return E.fill_source_histogram(orders_holes(spark, d), _fill(spark, d))


@query("e7_alter_column_type", "SELECT event_id, event_type, CAST(CASE WHEN raw = 'n/a' THEN NULL ELSE raw END AS DOUBLE) AS raw FROM raw_text")
def e7(spark, d):
    return E.alter_column_type(raw_text(spark, d), "raw", "double", "nullif(raw, 'n/a')")


@query("e8_cast_failures", "SELECT * FROM raw_text WHERE raw IS NOT NULL AND TRY_CAST(raw AS DOUBLE) IS NULL")
def e8(spark, d):
    return E.cast_failures(raw_text(spark, d), "raw", "double")


@query("e9_classify_type_change", "SELECT c_custkey, old, new, CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_nationkey + 5 >= 10 THEN CASE WHEN c_nationkey = 5 THEN 'same' ELSE 'free' END ELSE 'rewrite' END WHEN 1 THEN 'free' WHEN 2 THEN 'rewrite' ELSE 'same' END AS class FROM (SELECT c_custkey, c_nationkey, CASE c_custkey % 4 WHEN 0 THEN 'varchar(10)' WHEN 1 THEN 'numeric(10,2)' WHEN 2 THEN 'numeric(10,2)' ELSE 'bigint' END AS old, CASE c_custkey % 4 WHEN 0 THEN 'varchar(' || CAST(c_nationkey + 5 AS VARCHAR) || ')' WHEN 1 THEN 'numeric(12,2)' WHEN 2 THEN 'numeric(12,4)' ELSE 'bigint' END AS new FROM customer)")
def e9(spark, d):
    pairs = table(spark, d, "customer").selectExpr("c_custkey", "CASE c_custkey % 4 WHEN 0 THEN 'varchar(10)' WHEN 1 THEN 'numeric(10,2)' WHEN 2 THEN 'numeric(10,2)' ELSE 'bigint' END AS old", "CASE c_custkey % 4 WHEN 0 THEN 'varchar(' || CAST(c_nationkey + 5 AS string) || ')' WHEN 1 THEN 'numeric(12,2)' WHEN 2 THEN 'numeric(12,4)' ELSE 'bigint' END AS new")
    return E.classify_type_change(pairs)


@query("e10_drop_and_rename", "SELECT o_orderkey AS order_id, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def e10(spark, d):
    return E.rename_column(E.drop_column(table(spark, d, "orders"), "o_orderpriority"), "o_orderkey", "order_id")


@query("e11_column_default", f"SELECT {O} FROM orders UNION ALL SELECT o_orderkey + 30000000, NULL, 'NEW', NULL, NULL, NULL FROM orders WHERE o_orderkey % 30 = 0")
def e11(spark, d):
    from ..operators.changes import insert_rows

    o = E.alter_column_default(table(spark, d, "orders"), "o_orderstatus", "'NEW'")
    return insert_rows(o, o.filter("o_orderkey % 30 = 0").select((F.col("o_orderkey") + 30_000_000).alias("o_orderkey")), defaults=E.column_defaults(o))


@query("e12_set_identity", "SELECT event_id, event_type, CAST(100 + 5 * (row_number() OVER (ORDER BY ts, event_id) - 1) AS BIGINT) AS id FROM events")
def e12(spark, d):
    return E.set_identity(table(spark, d, "events"), "id", ["ts", "event_id"], 100, 5).select("event_id", "event_type", "id")


@query("e13_generated", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1.0::DOUBLE - l_discount) AS net FROM lineitem")
def e13(spark, d):
    out = E.generated(table(spark, d, "lineitem"), "net", "l_extendedprice * (1.0D - l_discount)")
    return E.drop_expression(out, "net").select("l_orderkey", "l_linenumber", "net")


@query("e14_schema_diff", "WITH d(tab, col, typ) AS (SELECT 't' || CAST(c_nationkey AS VARCHAR), 'c' || CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 5 = 0 THEN 'int' ELSE 'string' END FROM customer WHERE c_custkey % 7 > 0), a(tab, col, typ) AS (SELECT 't' || CAST(c_nationkey AS VARCHAR), 'c' || CAST(c_custkey AS VARCHAR), 'string' FROM customer WHERE c_custkey % 11 > 0) SELECT coalesce(d.tab, a.tab) AS \"table\", coalesce(d.col, a.col) AS \"column\", CASE WHEN a.col IS NULL THEN 'missing' WHEN d.col IS NULL THEN 'undeclared' WHEN d.typ <> a.typ THEN 'type differs' ELSE '' END AS reason, CASE WHEN a.col IS NULL THEN 'apply' WHEN d.col IS NULL THEN 'conflict' WHEN d.typ <> a.typ THEN 'conflict' ELSE 'satisfied' END AS action FROM d FULL JOIN a ON d.tab = a.tab AND d.col = a.col")
def e14(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey", "'t' || CAST(c_nationkey AS string) AS table", "'c' || CAST(c_custkey AS string) AS column", "CASE WHEN c_custkey % 5 = 0 THEN 'int' ELSE 'string' END AS type", "false AS not_null")
    return E.schema_diff(c.filter("c_custkey % 7 > 0").drop("c_custkey"), c.filter("c_custkey % 11 > 0").withColumn("type", F.lit("string")).drop("c_custkey"))


@query("e15_index_equivalence", "WITH x AS (SELECT c_custkey // 3 AS g, c_custkey % 3 AS m FROM customer), n AS (SELECT 't' || CAST(g AS VARCHAR) AS \"table\", 'i' || CAST(m AS VARCHAR) AS name, m FROM x) SELECT a.\"table\", a.name, 'i0' AS same_as FROM n a WHERE a.m = 1 AND EXISTS (SELECT 1 FROM n b WHERE b.\"table\" = a.\"table\" AND b.m = 0)")
def e15(spark, d):
    """Three indexes a table: the second is the first in full reverse order, the third is another."""
    i = table(spark, d, "customer").selectExpr("'t' || CAST(c_custkey div 3 AS string) AS table", "'i' || CAST(c_custkey % 3 AS string) AS name", "'btree' AS method", "false AS is_unique", "array('a', 'b') AS columns", "CASE c_custkey % 3 WHEN 0 THEN array(false, true) WHEN 1 THEN array(true, false) ELSE array(true, true) END AS descending", "CAST(NULL AS string) AS predicate")
    return E.index_equivalence(i)


@query("e16_view_impact", "WITH RECURSIVE e AS (SELECT c_custkey AS view, c_custkey // 3 AS relation FROM customer WHERE c_custkey > 0 UNION ALL SELECT c_custkey, c_custkey // 2 FROM customer WHERE c_custkey > 0 AND c_custkey % 5 = 0), r(view, depth) AS (SELECT view, 1 FROM e WHERE relation = 4 UNION SELECT e.view, r.depth + 1 FROM e JOIN r ON e.relation = r.view) SELECT view, CAST(max(depth) AS INTEGER) AS depth FROM r GROUP BY view")
def e16(spark, d):
    c = table(spark, d, "customer").filter("c_custkey > 0")
    edges = c.selectExpr("c_custkey AS view", "c_custkey div 3 AS relation").unionByName(c.filter("c_custkey % 5 = 0").selectExpr("c_custkey AS view", "c_custkey div 2 AS relation"))
    return E.view_impact(edges, spark.range(4, 5).select(F.col("id").alias("relation")))


@query("e17_touch_updated_at", "SELECT a.o_orderkey, a.o_totalprice, a.o_orderstatus, CASE WHEN b.o_orderkey IS NULL OR (a.o_totalprice, a.o_orderstatus) IS DISTINCT FROM (b.o_totalprice, b.o_orderstatus) THEN TIMESTAMP '2024-06-01 00:00:00' END AS updated_at FROM orders_v2 a LEFT JOIN orders b USING (o_orderkey)")
def e17(spark, d):
    pick = lambda df: df.select("o_orderkey", "o_totalprice", "o_orderstatus")
    return E.touch_updated_at(pick(table(spark, d, "orders")), pick(orders_v2(spark, d)), KEY, "2024-06-01 00:00:00")
