"""Queries of sources (S), statistics (T), row policies (R), feeds (F) and search (V)."""

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.staging import shared_dir
from ..operators import feed as D
from ..operators import profile as T
from ..operators import search as V
from ..sources import tables as S
from .frames import KEY, orders_delta, orders_holes, orders_v2, table
from .registry import query

N = "n_nationkey, n_name, n_regionkey"


def _path(spark, name):
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s1_scan", "SELECT page_id, url, CAST(strlen(html) AS INTEGER) AS bytes FROM pages")
def s1(spark, d):
    return S.scan(spark, d, "pages").select("page_id", "url", F.octet_length("html").alias("bytes"))


@query("s2_literal_rows", f"SELECT {N} FROM nation UNION ALL SELECT 90, 'NOWHERE', NULL UNION ALL SELECT 91, NULL, 2")
def s2(spark, d):
    n = table(spark, d, "nation")
    from ..operators.changes import insert_rows

    return insert_rows(n, S.literal_rows(spark, ["n_nationkey", "n_name", "n_regionkey"], [[90, "NOWHERE", None], ["91", None, 2]], n.schema))


@query("s3_copy_rows", "SELECT c_custkey, c_name, c_nationkey FROM customer UNION ALL SELECT c_custkey + 1000000, c_name, NULL FROM customer WHERE c_custkey % 50 = 0")
def s3(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    path = _path(spark, "copy")
    c.filter("c_custkey % 50 = 0").select((F.col("c_custkey") + 1_000_000).alias("c_custkey"), "c_name").write.option("header", "true").csv(path)
    return S.copy_rows(c, path, StructType([StructField("c_custkey", LongType()), StructField("c_name", StringType())]))


@query("s4_create_table", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0")
def s4(spark, d):
    from ..operators.changes import insert_rows

    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return insert_rows(S.create_table(spark, c.schema, ["c_custkey"]), c.filter("c_custkey % 2 = 0"))


@query("s5_create_table_as", "SELECT o_orderstatus, count(*) AS rows FROM orders GROUP BY 1")
def s5(spark, d):
    q = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"))
    return S.create_table_as(q, _path(spark, "ctas")).unionByName(S.create_table_as(q, _path(spark, "ctas"), with_data=False))


@query("s6_materialize", "SELECT c_mktsegment, count(*) AS rows, max(c_acctbal) AS top FROM customer GROUP BY 1")
def s6(spark, d):
    return S.materialize(table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("rows"), F.max("c_acctbal").alias("top")), _path(spark, "matview"))


@query("s7_replace_view", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def s7(spark, d):
    return S.replace_view("weft_dear_orders", table(spark, d, "orders").filter("o_totalprice > 200000").select("o_orderkey", "o_totalprice"))


@query("s8_import_tables", "SELECT 'weft_in_nation' AS name, count(*) AS rows FROM nation UNION ALL SELECT 'weft_in_customer', count(*) FROM customer")
def s8(spark, d):
    names = S.import_tables(spark, d, ["region", "nation", "customer"], except_=["region"], prefix="weft_in_")
    parts = [spark.table(n).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n in names]
    return parts[0].unionByName(parts[1])


@query("s9_export_partitioned", "SELECT event_type, event_id FROM events")
def s9(spark, d):
    return S.export_partitioned(table(spark, d, "events").select("event_type", "event_id"), _path(spark, "export"), ["event_type"], ["event_id"]).select("event_type", "event_id")


@query("t1_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS \"distinct\", CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max FROM orders_holes" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")))
def t1(spark, d):
    return T.profile(orders_holes(spark, d).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


@query("t2_ext_ndistinct", "SELECT 'p_brand,p_type' AS columns, count(*) AS n_distinct FROM (SELECT DISTINCT p_brand, p_type FROM part) UNION ALL SELECT 'p_brand,p_size', count(*) FROM (SELECT DISTINCT p_brand, p_size FROM part) UNION ALL SELECT 'p_type,p_size', count(*) FROM (SELECT DISTINCT p_type, p_size FROM part) UNION ALL SELECT 'p_brand,p_type,p_size', count(*) FROM (SELECT DISTINCT p_brand, p_type, p_size FROM part)")
def t2(spark, d):
    return T.ext_ndistinct(table(spark, d, "part"), ["p_brand", "p_type", "p_size"])


DEP = "SELECT '{a}' AS a, '{b}' AS b, round(sum(CASE WHEN m = 1 THEN n ELSE 0 END) / sum(n)::DOUBLE, 6) AS degree FROM (SELECT count(*) AS n, count(DISTINCT {b}) AS m FROM customer GROUP BY {a})"


@query("t3_functional_dependencies", DEP.format(a="c_custkey", b="c_nationkey") + " UNION ALL " + DEP.format(a="c_nationkey", b="c_custkey"))
def t3(spark, d):
    return T.functional_dependencies(table(spark, d, "customer"), ["c_custkey", "c_nationkey"])


@query("t4_mcv", "WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 5) SELECT o_orderstatus, o_orderpriority, round(n / (SELECT count(*) FROM orders)::DOUBLE, 8) AS frequency, round(1.0::DOUBLE * (SELECT count(*) FROM orders x WHERE x.o_orderstatus = c.o_orderstatus) / (SELECT count(*) FROM orders) * (SELECT count(*) FROM orders x WHERE x.o_orderpriority = c.o_orderpriority) / (SELECT count(*) FROM orders), 8) AS base_frequency FROM c")
def t4(spark, d):
    return T.mcv(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], 5)


@query("t5_reconcile", "WITH b AS (SELECT o_orderstatus, count(*) AS rows_before, round(sum(o_totalprice), 2) AS sum_before FROM orders GROUP BY 1), a AS (SELECT o_orderstatus, count(*) AS rows_after, round(sum(o_totalprice), 2) AS sum_after FROM orders_v2 GROUP BY 1) SELECT o_orderstatus, rows_before, sum_before, rows_after, sum_after, rows_before IS NOT DISTINCT FROM rows_after AND sum_before IS NOT DISTINCT FROM sum_after AS same FROM b FULL JOIN a USING (o_orderstatus)")
def t5(spark, d):
    return T.reconcile(table(spark, d, "orders"), orders_v2(spark, d), ["o_orderstatus"], "o_totalprice")


@query("r1_apply_policies", "SELECT * FROM orders_holes WHERE o_totalprice > 300000 OR o_custkey < 100")
def r1(spark, d):
    policies = [{"roles": ["clerk"], "command": "select", "using": "o_totalprice > 300000"}, {"roles": ["PUBLIC"], "command": "all", "using": "o_custkey < 100"}, {"roles": ["boss"], "command": "select", "using": "true"}]
    return T.apply_policies(orders_holes(spark, d), policies, "clerk", "select")


@query("r2_visible_columns", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def r2(spark, d):
    return T.visible_columns(table(spark, d, "customer"), {"clerk": ["c_name", "c_mktsegment"], "PUBLIC": ["c_custkey"]}, "clerk")


@query("r3_effective_grants", "WITH x AS (SELECT c_custkey AS object, CASE WHEN c_custkey % 3 = 0 THEN 'PUBLIC' ELSE 'role' || CAST(c_nationkey AS VARCHAR) END AS grantee FROM customer) SELECT object, grantee, 'r' AS privilege, false AS grantable, 'owner' AS grantor FROM x UNION ALL SELECT object, grantee, 'w', object % 2 = 0, 'owner' FROM x")
def r3(spark, d):
    return T.effective_grants(table(spark, d, "customer").selectExpr("c_custkey AS object", "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'role' || CAST(c_nationkey AS string) END || '=rw' || CASE WHEN c_custkey % 2 = 0 THEN '*' ELSE '' END || '/owner' AS acl"))


@query("r4_labelled_columns", "SELECT c_custkey, sha256(c_name) AS c_name, c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer")
def r4(spark, d):
    return T.labelled_columns(table(spark, d, "customer"), {"c_name": "personal", "c_acctbal": "secret", "c_mktsegment": "open"}, {"open"})


def _feed(spark, d):
    """Three rounds of changes to orders: prices, statuses, and deletes."""
    o = table(spark, d, "orders")
    up = lambda n, seq: o.filter(f"o_orderkey % {n} = 0").withColumns({"o_totalprice": F.col("o_totalprice") + seq, "action": F.lit("U"), "seq": F.lit(seq)})
    return up(3, 1).unionByName(up(5, 2)).unionByName(o.filter("o_orderkey % 10 = 0").withColumns({"action": F.lit("D"), "seq": F.lit(3)})).unionByName(o.filter("o_orderkey % 7 = 0").withColumns({"o_orderkey": F.col("o_orderkey") + 50_000_000, "action": F.lit("I"), "seq": F.lit(4)}))


PICK = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
ADDED = "SELECT o_orderkey + 50000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 7 = 0"


@query("f1_snapshot_diff", "SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'I' WHEN a.o_orderkey IS NULL THEN 'D' ELSE 'U' END AS action, CASE WHEN b.o_orderkey IS NOT NULL AND a.o_orderkey IS NOT NULL THEN CAST(b.o_totalprice IS DISTINCT FROM a.o_totalprice AS INTEGER) + CAST(b.o_orderstatus IS DISTINCT FROM a.o_orderstatus AS INTEGER) END AS n_changed, a.o_orderstatus AS new_status FROM orders b FULL JOIN orders_v2 a ON a.o_orderkey = b.o_orderkey WHERE b.o_orderkey IS NULL OR a.o_orderkey IS NULL OR (b.o_totalprice, b.o_orderstatus) IS DISTINCT FROM (a.o_totalprice, a.o_orderstatus)")
def f1(spark, d):
    out = D.snapshot_diff(table(spark, d, "orders"), orders_v2(spark, d), KEY)
    return out.select("o_orderkey", "action", F.when(F.col("changed_fields").isNotNull(), F.size("changed_fields")).alias("n_changed"), F.col("new")["o_orderstatus"].alias("new_status"))


@query("f2_publish", "SELECT 'events' AS \"table\", CASE WHEN event_id % 3 = 1 THEN 'U' ELSE 'I' END AS action, count(*) AS rows FROM events WHERE event_id % 4 < 2 AND event_id % 3 < 2 GROUP BY ALL")
def f2(spark, d):
    feed = table(spark, d, "events").selectExpr("'events_' || CAST(event_id % 4 AS string) AS table", "CASE event_id % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'U' ELSE 'D' END AS action")
    roots = table(spark, d, "region").filter("r_regionkey < 2").selectExpr("'events_' || CAST(r_regionkey AS string) AS leaf", "'events' AS root")
    return D.publish(feed, ["events"], ["I", "U"], roots).groupBy("table", "action").agg(F.count(F.lit(1)).alias("rows"))


@query("f3_replica_identity", "SELECT o_orderkey, 1::INTEGER AS kept, o_orderstatus AS status FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 10 = 0")
def f3(spark, d):
    diff = D.snapshot_diff(table(spark, d, "orders"), orders_v2(spark, d), KEY).filter("action IN ('U', 'D')")
    return D.replica_identity(diff, "index", KEY, ["o_orderstatus"]).select("o_orderkey", F.size("old").alias("kept"), F.col("old")["o_orderstatus"].alias("status"))


@query("f4_apply_feed", f"SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 2 WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 10 > 0 UNION ALL {ADDED}")
def f4(spark, d):
    return D.apply_feed(table(spark, d, "orders"), _feed(spark, d), KEY)


@query("f6_initial_copy_then_follow", f"SELECT {PICK} FROM orders WHERE o_orderkey % 10 > 0 UNION ALL {ADDED}")
def f6(spark, d):
    return D.initial_copy_then_follow(table(spark, d, "orders"), _feed(spark, d), KEY, 2)


@query("f7_history_asof", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' GROUP BY 1 HAVING arg_max(o_orderstatus, (o_orderdate, o_orderkey)) <> 'P'")
def f7(spark, d):
    audit = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "P", "D").otherwise("U").alias("action"), F.struct("o_orderdate", "o_orderkey").alias("action_ts"))
    at = F.expr("struct(TIMESTAMP_NTZ '1998-01-01 00:00:00' AS o_orderdate, 9223372036854775807L AS o_orderkey)")
    return D.history_asof(audit, ["o_custkey"], at)


TOK = r"WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f]+'), lambda t: regexp_replace(t, '^[.,;:!?()\"''*#$%&|]+|[.,;:!?()\"''*#$%&|]+$', '', 'g')), lambda t: t <> '') AS ts FROM documents), e AS (SELECT doc_id AS id, unnest(range(0, len(ts))) AS position, unnest(ts) AS token FROM s), k AS (SELECT *, CASE WHEN regexp_matches(token, '^[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+$') THEN 'email' WHEN regexp_matches(token, '^(https?://[^\s]+|www\.[^\s]+)$') THEN 'url' WHEN regexp_matches(token, '^[0-9]+$') THEN 'int' WHEN regexp_matches(token, '^[A-Za-z]+$') THEN 'asciiword' WHEN regexp_matches(token, '^[A-Za-z]+(-[A-Za-z]+)+$') THEN 'hword' WHEN regexp_matches(token, '^[A-Za-z0-9]*[0-9][A-Za-z0-9]*$') THEN 'numword' ELSE 'word' END AS type FROM e)"
DICT = ", dw AS (SELECT DISTINCT lower(p_type) AS word FROM part), lx AS (SELECT id, position, token, type, CASE WHEN type = 'word' OR lower(token) NOT IN ('the', 'and') THEN lower(token) END AS lexeme FROM k WHERE type IN ('asciiword', 'word')), l AS (SELECT * FROM lx WHERE lexeme IS NOT NULL)"


def _lexemes(spark, d):
    stops = table(spark, d, "region").filter("r_regionkey < 2").selectExpr("'stop' AS dict", "CASE r_regionkey WHEN 0 THEN 'the' ELSE 'and' END AS word", "CAST(NULL AS string) AS lexeme")
    return V.text_map(V.text_tokens(table(spark, d, "documents"), "doc_id", "text"), {"asciiword": ["stop", "simple"], "word": ["simple"]}, stops)


@query("v1_text_tokens", TOK + " SELECT id, type, count(*) AS n, max(position) AS last FROM k GROUP BY ALL")
def v1(spark, d):
    return V.text_tokens(table(spark, d, "documents"), "doc_id", "text").groupBy("id", "type").agg(F.count(F.lit(1)).alias("n"), F.max("position").cast("long").alias("last"))


@query("v2_text_map", TOK + DICT + " SELECT lexeme, count(*) AS n FROM l GROUP BY 1")
def v2(spark, d):
    return _lexemes(spark, d).groupBy("lexeme").agg(F.count(F.lit(1)).alias("n"))


@query("v3_text_match", TOK + DICT + " SELECT id, CAST(count(*) AS BIGINT) AS rank FROM l WHERE lexeme IN ('of', 'that') GROUP BY id HAVING count(DISTINCT lexeme) = 2")
def v3(spark, d):
    return V.text_match(V.inverted_index(_lexemes(spark, d)), ["of", "that"])


@query("v3_text_phrase", TOK + DICT + " SELECT a.id, list_sort(list(DISTINCT CAST(a.position AS INTEGER))) AS starts FROM l a JOIN l b ON a.id = b.id AND b.position = a.position + 1 WHERE a.lexeme = 'of' AND b.lexeme = 'that' GROUP BY a.id")
def v3_phrase(spark, d):
    return V.text_phrase(V.inverted_index(_lexemes(spark, d)), ["of", "that"])


@query("v3_text_near", TOK + DICT + ", f AS (SELECT lexeme, count(DISTINCT id) AS n FROM l WHERE lexeme IN ('of', 'that', 'is') GROUP BY 1), r AS (SELECT lexeme FROM f ORDER BY n, lexeme LIMIT 1), p AS (SELECT id, position FROM l WHERE lexeme = (SELECT lexeme FROM r)) SELECT p.id, list_sort(list(CAST(p.position AS INTEGER))) AS at FROM p WHERE (SELECT count(DISTINCT o.lexeme) FROM l o WHERE o.id = p.id AND o.lexeme IN ('of', 'that', 'is') AND abs(o.position - p.position) <= 5) = 3 GROUP BY p.id")
def v3_near(spark, d):
    return V.text_near(V.inverted_index(_lexemes(spark, d)), ["of", "that", "is"], 5)


@query("v4_stale_vectors", TOK + DICT + " SELECT DISTINCT id FROM k WHERE type = 'asciiword' AND lower(token) IN ('the', 'and')")
def v4(spark, d):
    """Vectors stored when no word was stopped, against the mapping with stop words."""
    plain = V.text_map(V.text_tokens(table(spark, d, "documents"), "doc_id", "text"), {"asciiword": ["simple"], "word": ["simple"]}, table(spark, d, "region").selectExpr("'none' AS dict", "'x' AS word", "'x' AS lexeme"))
    return V.stale_vectors(plain.groupBy("id").agg(F.collect_set("lexeme").alias("lexemes")), _lexemes(spark, d))


@query("v5_check_dims", "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'length' ELSE 'null_element' END AS problem FROM embeddings WHERE vec_id % 5 = 0 OR vec_id % 7 = 0")
def v5(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 10)).when(F.col("vec_id") % 7 == 0, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(None).cast("float")))).otherwise(F.col("embedding")).alias("v"))
    return V.check_dims(e, "v", 64).select("vec_id", "problem")


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.filter("vec_id % 50 = 0").selectExpr("vec_id AS q_id", "embedding AS q"), e.selectExpr("vec_id AS id", "embedding AS v")


PAIR = "FROM (SELECT vec_id AS q_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0) CROSS JOIN (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"


@query("v6_distances", f"SELECT q_id, id, round(list_distance(q, v), 6) AS l2, round(-list_inner_product(q, v), 6) AS ip, round(1 - list_cosine_similarity(q, v), 6) AS cosine, round(list_sum(list_transform(list_zip(q, v), lambda p: abs(p[1] - p[2]))), 5) AS l1, CAST(bit_count(xor(q_id, id)) AS DOUBLE) AS hamming {PAIR}")
def v6(spark, d):
    q, v = _vectors(spark, d)
    of = lambda m, n=6: F.round(m, n).alias(m)
    return V.distances(q, v, ["l2", "ip", "cosine", "l1"]).select("q_id", "id", of("l2"), of("ip"), of("cosine"), of("l1", 5), V.distance(F.col("q_id"), F.col("id"), "hamming").alias("hamming"))


@query("v7_knn_l2", f"SELECT q_id, id, place FROM (SELECT q_id, id, row_number() OVER (PARTITION BY q_id ORDER BY list_distance(q, v), id) AS place {PAIR}) WHERE place <= 5")
def v7(spark, d):
    return V.knn(*_vectors(spark, d), 5).select("q_id", "id", F.col("place").cast("long").alias("place"))


@query("v8_ivf_search")
def v8(spark, d):
    """Lists are written, as many as the square root of the rows, and probed as far as a sample of the queries asks for its neighbours."""
    q, v = _vectors(spark, d)
    index = V.ivf_write(v, _path(spark, "ivf"))
    return V.ivf_search(q, index, 5, V.ivf_probes(index, q, 5)).select("q_id", "id", "place")


@query("v9_quantized_knn", f"SELECT q_id, id, place FROM (SELECT q_id, id, row_number() OVER (PARTITION BY q_id ORDER BY list_distance(q, v), id) AS place {PAIR}) WHERE place <= 5")
def v9(spark, d):
    """Four bits a dimension and fifty candidates find the exact neighbours here, which the SQL gives."""
    return V.quantized_knn(*_vectors(spark, d), 5).select("q_id", "id", F.col("place").cast("long").alias("place"))


HALF = "list_transform({0}, lambda x: CASE WHEN x = 0 THEN 0.0::DOUBLE ELSE round_even(x / pow(2.0::DOUBLE, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2.0::DOUBLE, greatest(floor(log2(abs(x))), -14) - 10) END)"


@query("v9_half_knn", f"SELECT q_id, id, place FROM (SELECT q_id, id, row_number() OVER (PARTITION BY q_id ORDER BY list_distance(q, v), id) AS place FROM (SELECT q_id, id, {HALF.format('q')} AS q, {HALF.format('v')} AS v {PAIR})) WHERE place <= 5")
def v9_half(spark, d):
    """Neighbours among vectors that are kept in half precision, as queries are."""
    q, v = _vectors(spark, d)
    return V.knn(q.withColumn("q", V.half(F.col("q"))), v.withColumn("v", V.half(F.col("v"))), 5).select("q_id", "id", F.col("place").cast("long").alias("place"))
