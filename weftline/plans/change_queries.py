"""Queries of the row changes (D)."""

from pyspark.sql import functions as F

from ..operators import changes as C
from .frames import KEY, orders_delta, orders_dups, orders_holes, orders_kept, table
from .registry import query

NOT_IN = "o_orderkey NOT IN (SELECT o_orderkey FROM orders)"
PICK = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@query("merge_flagship", "SELECT count(*) AS considered, count(*) FILTER (b.o_orderkey IS NULL) AS inserted, count(*) FILTER (b.o_orderkey IS NOT NULL AND a.o_orderkey IS NOT NULL AND (a.o_totalprice, a.o_orderstatus) IS DISTINCT FROM (b.o_totalprice, b.o_orderstatus)) AS updated, count(*) FILTER (a.o_orderkey IS NULL) AS deleted, count(*) FILTER (b.o_orderkey IS NOT NULL AND a.o_orderkey IS NOT NULL AND (a.o_totalprice, a.o_orderstatus) IS NOT DISTINCT FROM (b.o_totalprice, b.o_orderstatus)) AS unchanged FROM orders b FULL JOIN orders_v2 a ON a.o_orderkey = b.o_orderkey")
def merge_flagship(spark, d):
    """Merge the delta, delete the dropped keys, and count what changed."""
    return C.merge_counts(table(spark, d, "orders"), orders_delta(spark, d), KEY, then_delete="o_orderkey % 97 = 0")


@query("d1_insert_append", f"SELECT {PICK} FROM orders UNION ALL SELECT o_orderkey + 20000000, NULL, 'N', NULL, NULL, NULL FROM orders WHERE o_orderkey % 40 = 0")
def d1(spark, d):
    o = table(spark, d, "orders")
    return C.insert_rows(o, o.filter("o_orderkey % 40 = 0").select((F.col("o_orderkey") + 20_000_000).alias("o_orderkey")), defaults={"o_orderstatus": F.lit("N")})


@query("d2_insert_refuse", f"SELECT {PICK} FROM orders UNION ALL SELECT {PICK} FROM orders_delta WHERE {NOT_IN}")
def d2(spark, d):
    o = table(spark, d, "orders")
    return C.insert_rows(o, orders_delta(spark, d).filter("o_orderkey > 10000000"), "refuse", KEY)


@query("d3_insert_skip", f"SELECT {PICK} FROM orders UNION ALL SELECT {PICK} FROM orders_delta WHERE {NOT_IN}")
def d3(spark, d):
    return C.insert_rows(table(spark, d, "orders"), orders_delta(spark, d), "skip", KEY)


@query("d3_refused_keys", "SELECT o_orderkey, 'given twice' AS why FROM orders_dups WHERE o_totalprice > 50000 GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT o_orderkey, 'in the target' FROM orders_dups WHERE o_totalprice > 50000 AND o_orderkey % 3 = 0")
def d3_refused(spark, d):
    """Why an insert of rows with repeated keys is refused, under a partial key; skipping refuses those given twice all the same."""
    return C.insert_refusals(table(spark, d, "orders").filter("o_orderkey % 3 = 0"), orders_dups(spark, d), KEY, "refuse", "o_totalprice > 50000")


@query("d4_upsert_columns", f"SELECT o.* REPLACE (CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_totalprice ELSE o.o_totalprice END AS o_totalprice) FROM orders o LEFT JOIN orders_delta s ON o.o_orderkey = s.o_orderkey UNION ALL SELECT {PICK} FROM orders_delta WHERE {NOT_IN}")
def d4(spark, d):
    return C.insert_rows(table(spark, d, "orders"), orders_delta(spark, d), "update", KEY, ["o_totalprice"])


@query("d5_partial_arbiter", f"SELECT {PICK} FROM orders UNION ALL SELECT {PICK} FROM orders_delta s WHERE s.o_orderpriority <> '1-URGENT' OR NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderpriority = '1-URGENT' AND o.o_orderkey = s.o_orderkey)")
def d5(spark, d):
    return C.insert_rows(table(spark, d, "orders"), orders_delta(spark, d), "skip", KEY, conflict_where="o_orderpriority = '1-URGENT'")


@query("d6_overriding_user", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY c_name, c_nationkey, c_acctbal, c_mktsegment), c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 5 = 0")
def d6(spark, d):
    c = table(spark, d, "customer")
    return C.insert_identified(c, c.filter("c_custkey % 5 = 0"), "c_custkey", "user")


@query("d7_update_rows", "SELECT o.* REPLACE (CASE WHEN o.o_orderkey % 10 = 0 THEN NULL ELSE o.o_orderpriority END AS o_orderpriority) FROM orders o")
def d7(spark, d):
    return C.update_rows(table(spark, d, "orders"), orders_delta(spark, d).select("o_orderkey", F.lit(None).cast("string").alias("o_orderpriority")), KEY)


@query("d8_delete_where_null_safe", "SELECT * FROM orders_holes WHERE (o_totalprice > 100000) IS NOT TRUE")
def d8(spark, d):
    return C.delete_rows(orders_holes(spark, d), "o_totalprice > 100000")


@query("d9_delete_keys", "SELECT * FROM orders WHERE NOT EXISTS (SELECT 1 FROM orders_delta s WHERE s.o_orderkey = orders.o_orderkey AND s.o_custkey = orders.o_custkey)")
def d9(spark, d):
    return C.delete_rows(table(spark, d, "orders"), keys=orders_delta(spark, d), key=["o_orderkey", "o_custkey"])


@query("d10_merge_full", f"SELECT {PICK} FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders_delta) UNION ALL SELECT {PICK} FROM orders_delta")
def d10(spark, d):
    return C.merge_rows(table(spark, d, "orders"), orders_delta(spark, d), KEY)


@query("d10_merge_by_source_delete", f"SELECT {PICK} FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders_kept)")
def d10b(spark, d):
    return C.merge_rows(table(spark, d, "orders"), orders_kept(spark, d), KEY, "nothing", "nothing", "delete")


@query("d10_merge_delete_both", f"SELECT {PICK} FROM orders_delta WHERE {NOT_IN}")
def d10c(spark, d):
    return C.merge_rows(table(spark, d, "orders"), orders_delta(spark, d), KEY, "delete", "insert", "delete")


@query("d11_merge_columns", "SELECT o.* REPLACE (CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_orderstatus ELSE o.o_orderstatus END AS o_orderstatus) FROM orders o LEFT JOIN orders_delta s ON o.o_orderkey = s.o_orderkey")
def d11(spark, d):
    return C.merge_rows(table(spark, d, "orders"), orders_delta(spark, d), KEY, "update", "nothing", update_columns=["o_orderstatus"])


@query("d12_backfill", "SELECT * REPLACE (CASE WHEN o_totalprice IS NULL THEN o_custkey * 1.0::DOUBLE ELSE o_totalprice END AS o_totalprice, CASE WHEN o_totalprice IS NULL THEN 'B' ELSE o_orderstatus END AS o_orderstatus) FROM orders_holes")
def d12(spark, d):
    return C.backfill(orders_holes(spark, d), {"o_totalprice": "o_custkey * 1.0D", "o_orderstatus": "'B'"}, "o_totalprice IS NULL")


@query("d13_backfill_join", "SELECT o.* REPLACE (CASE WHEN c.c_custkey IS NOT NULL AND n.n_nationkey IS NOT NULL AND o.o_totalprice IS NULL THEN c.c_mktsegment || '/' || n.n_name ELSE o.o_orderpriority END AS o_orderpriority) FROM orders_holes o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey")
def d13(spark, d):
    return C.backfill_from(orders_holes(spark, d), {"o_orderpriority": "c.c_mktsegment || '/' || n.n_name"}, [(table(spark, d, "customer"), "c", "c.c_custkey = t.o_custkey"), (table(spark, d, "nation"), "n", "n.n_nationkey = c.c_nationkey")], "t.o_totalprice IS NULL")


@query("d14_preimage", "SELECT o_orderkey, o_totalprice, o_orderstatus, TIMESTAMP '2024-01-01 00:00:00' AS saved_at FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders_delta)")
def d14(spark, d):
    return C.preserve(table(spark, d, "orders"), orders_delta(spark, d), KEY, ["o_totalprice", "o_orderstatus"])


@query("d15_revert", f"SELECT {PICK} FROM orders UNION ALL SELECT {PICK} FROM orders_delta WHERE {NOT_IN} AND o_orderkey % 97 <> 0")
def d15(spark, d):
    o, delta = table(spark, d, "orders"), orders_delta(spark, d)
    saved = C.preserve(o, delta.select("o_orderkey").unionByName(o.filter("o_orderkey % 97 = 0").select("o_orderkey")), KEY)
    return C.revert(C.merge_rows(o, delta, KEY).filter("o_orderkey % 97 <> 0"), saved, KEY)


@query("d16_duplicate_source_keys", "SELECT o_orderkey, count(*) AS rows FROM orders_dups GROUP BY 1 HAVING count(*) > 1")
def d16(spark, d):
    return C.duplicate_source_keys(orders_dups(spark, d), KEY)


@query("d17_ambiguous_matches", "SELECT o_orderkey, n AS matches FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1) ON l_orderkey = o_orderkey")
def d17(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return C.ambiguous_matches(table(spark, d, "orders"), lines, KEY, KEY)


@query("d18_key_is_unique", "SELECT count(*) FILTER (n > 1) = 0 AS \"unique\", count(*) FILTER (n > 1) AS repeated_keys, 0::BIGINT AS null_keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def d18(spark, d):
    return C.key_is_unique(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("d19_verify_remaining", "SELECT count(*) AS remaining FROM orders_holes WHERE o_totalprice IS NULL AND o_custkey IS NULL")
def d19(spark, d):
    filled = C.backfill(orders_holes(spark, d), {"o_totalprice": "o_custkey * 1.0D"}, "o_totalprice IS NULL")
    return C.verify_remaining(filled, "o_totalprice IS NULL")


@query("d20_invariants", "SELECT 'keys' AS name, CAST((SELECT count(DISTINCT o_orderkey) FROM orders) AS VARCHAR) AS before, CAST((SELECT count(DISTINCT o_orderkey) FROM orders_kept) AS VARCHAR) AS after, (SELECT count(DISTINCT o_orderkey) FROM orders) = (SELECT count(DISTINCT o_orderkey) FROM orders_kept) AS held UNION ALL SELECT 'customers', CAST((SELECT max(o_custkey) FROM orders) AS VARCHAR), CAST((SELECT max(o_custkey) FROM orders_kept) AS VARCHAR), (SELECT max(o_custkey) FROM orders) = (SELECT max(o_custkey) FROM orders_kept)")
def d20(spark, d):
    return C.assert_invariants(table(spark, d, "orders"), orders_kept(spark, d), [("keys", "count(DISTINCT o_orderkey)"), ("customers", "max(o_custkey)")])


@query("d21_sequence_catchup", "SELECT CAST(max(o_orderkey) + 1 AS BIGINT) AS next_value FROM orders")
def d21(spark, d):
    return C.sequence_catchup(table(spark, d, "orders"), "o_orderkey", 1)


@query("d22_change_counts", "SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM orders_delta WHERE o_orderkey > 10000000) AS considered, (SELECT count(*) FROM orders_delta WHERE o_orderkey > 10000000) AS inserted, (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 0) AS updated, 0::BIGINT AS deleted, (SELECT count(*) FROM orders WHERE o_orderkey % 10 <> 0) AS unchanged")
def d22(spark, d):
    o = table(spark, d, "orders")
    return C.change_counts(o, C.merge_rows(o, orders_delta(spark, d), KEY), KEY)
