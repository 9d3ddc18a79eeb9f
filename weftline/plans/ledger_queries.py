"""Queries of the ledger and contention analytics (L); the ledgers are derived from orders, customers and events."""

from pyspark.sql import functions as F

from ..operators import ledger as L
from .frames import table, wait_edges
from .registry import query

STATE = "CASE o_orderkey % 4 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' WHEN 2 THEN 'running' ELSE 'succeeded' END"
MIG = "SELECT o_orderkey AS migration_id, 's' || CAST(o_custkey % 80 AS VARCHAR) AS spec_id, 'd' || CAST(o_orderkey % 3 AS VARCHAR) AS spec_digest, 'e' || CAST(o_custkey % 80 % 3 AS VARCHAR) AS epoch FROM orders"
IDX = f"SELECT epoch, spec_id, list_sort(list(DISTINCT spec_digest)) AS seen, list_sort(coalesce(list(DISTINCT spec_digest) FILTER (state = 'succeeded'), [])) AS succeeded, list_sort(coalesce(list(DISTINCT spec_digest) FILTER (state = 'running'), [])) AS running, list_sort(coalesce(list(DISTINCT spec_digest) FILTER (state = 'failed'), [])) AS failed FROM (SELECT m.*, CASE WHEN m.migration_id % 5 > 0 THEN {STATE} END AS state FROM ({MIG}) m JOIN orders ON o_orderkey = migration_id) GROUP BY ALL"
SPEC = "SELECT 's' || CAST(c_custkey % 100 AS VARCHAR) AS spec_id, 'd' || CAST(c_custkey // 100 AS VARCHAR) AS digest, 'e' || CAST(c_custkey % 100 % 3 AS VARCHAR) AS epoch, CASE WHEN c_custkey % 7 = 0 THEN 'other' ELSE 'main' END AS database, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'test' ELSE 'prod' END AS environment, CASE WHEN c_custkey % 4 = 0 THEN 'r' || CAST(c_custkey % 3 AS VARCHAR) END AS release FROM customer"


def index(spark, d, state=STATE):
    o = table(spark, d, "orders")
    migrations = o.selectExpr("o_orderkey AS migration_id", "'s' || CAST(o_custkey % 80 AS string) AS spec_id", "'d' || CAST(o_orderkey % 3 AS string) AS spec_digest", "'e' || CAST(o_custkey % 80 % 3 AS string) AS epoch")
    return L.applied_index(migrations, o.filter("o_orderkey % 5 > 0").selectExpr("o_orderkey AS migration_id", f"{state} AS state"))


def specs(spark, d):
    return table(spark, d, "customer").selectExpr("'s' || CAST(c_custkey % 100 AS string) AS spec_id", "'d' || CAST(c_custkey div 100 AS string) AS digest", "'e' || CAST(c_custkey % 100 % 3 AS string) AS epoch", "CASE WHEN c_custkey % 7 = 0 THEN 'other' ELSE 'main' END AS database", "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'test' ELSE 'prod' END AS environment", "CASE WHEN c_custkey % 4 = 0 THEN 'r' || CAST(c_custkey % 3 AS string) END AS release")


STATUS = f"SELECT s.*, CASE WHEN list_contains(i.running, digest) THEN 'in_progress' WHEN list_contains(i.succeeded, digest) THEN 'applied' WHEN len(i.succeeded) > 0 THEN 'modified_after_apply' WHEN list_contains(i.failed, digest) THEN 'failed' ELSE 'pending' END AS status FROM ({SPEC}) s LEFT JOIN ({IDX}) i USING (epoch, spec_id)"


@query("l1_applied_index", IDX)
def l1(spark, d):
    return index(spark, d)


@query("l2_classify_specs", STATUS)
def l2(spark, d):
    return L.classify_specs(specs(spark, d), index(spark, d))


@query("l3_gate_specs", f"SELECT *, CASE WHEN database <> 'main' THEN 'wrong_database' WHEN environment IS NOT NULL AND environment <> 'prod' THEN 'wrong_environment' WHEN epoch = 'e1' THEN 'retired_epoch' WHEN epoch = 'e2' THEN 'held_for_epoch' WHEN release IS NOT NULL AND release <> 'r1' THEN 'held_for_release' ELSE 'open' END AS gate FROM ({STATUS}) WHERE status IN ('pending', 'failed')")
def l3(spark, d):
    r = table(spark, d, "region")
    env = r.filter("r_regionkey = 0").selectExpr("'main' AS database", "'prod' AS name")
    rel = r.filter("r_regionkey < 2").selectExpr("'main' AS database", "'r' || CAST(r_regionkey AS string) AS tag", "r_regionkey = 1 AS ready")
    ep = r.filter("r_regionkey < 2").selectExpr("'main' AS database", "'e' || CAST(r_regionkey AS string) AS name", "CASE WHEN r_regionkey = 1 THEN TIMESTAMP_NTZ '2024-01-01 00:00:00' END AS retired_at")
    return L.gate_specs(l2(spark, d), "main", env, rel, ep)


#: Specs of every tenth number failed only; files lack every fifth number and all of epoch e2; e1 is retired.
STATE4 = f"CASE WHEN o_custkey % 80 % 10 = 0 THEN 'failed' ELSE {STATE} END"
FILES4 = f"SELECT epoch, spec_id FROM ({SPEC}) WHERE CAST(substr(spec_id, 2) AS INTEGER) % 5 > 0 AND epoch <> 'e2'"


@query("l4_ledger_drift", f"SELECT epoch, spec_id, CASE WHEN len(succeeded) > 0 OR len(running) > 0 THEN 'drift' ELSE 'note' END AS kind FROM ({IDX.replace(STATE, STATE4)}) i WHERE epoch <> 'e1' AND epoch IN (SELECT epoch FROM ({FILES4})) AND NOT EXISTS (SELECT 1 FROM ({FILES4}) f WHERE f.epoch = i.epoch AND f.spec_id = i.spec_id) AND len(succeeded) + len(running) + len(failed) > 0")
def l4(spark, d):
    s = specs(spark, d).filter("CAST(substr(spec_id, 2) AS int) % 5 > 0 AND epoch <> 'e2'")
    epochs = table(spark, d, "region").filter("r_regionkey = 1").selectExpr("'e1' AS name", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS retired_at")
    return L.ledger_drift(s, index(spark, d, STATE4), epochs)


@query("l5_duplicate_ids", f"SELECT spec_id, count(*) AS files, CASE WHEN count(DISTINCT digest) = 1 THEN 'identical' ELSE 'different' END AS kind FROM ({SPEC}) GROUP BY 1 HAVING count(*) > 1")
def l5(spark, d):
    return L.duplicate_ids(specs(spark, d))


@query("l6_missing_dependencies", f"WITH n AS (SELECT 's' || CAST(c_custkey AS VARCHAR) AS spec_id, unnest(['s' || CAST(c_custkey + 300 AS VARCHAR), 's' || CAST(c_custkey // 3 AS VARCHAR)]) AS depends_on FROM customer) SELECT * FROM n WHERE depends_on NOT IN (SELECT 's' || CAST(c_custkey AS VARCHAR) FROM customer) AND depends_on NOT IN (SELECT spec_id FROM ({IDX}) WHERE len(succeeded) > 0)")
def l6(spark, d):
    s = table(spark, d, "customer").selectExpr("'s' || CAST(c_custkey AS string) AS spec_id", "array('s' || CAST(c_custkey + 300 AS string), 's' || CAST(c_custkey div 3 AS string)) AS depends_on")
    return L.missing_dependencies(s, index(spark, d))


def _dag(spark, d):
    """Node n needs n - 700 and n / 3; the two highest ids need each other."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    top = c.agg(F.max("node").alias("m"))
    edges = c.filter("node > 0").selectExpr("node", "node div 3 AS needs").unionByName(c.filter("node >= 700").selectExpr("node", "node - 700 AS needs")).unionByName(top.selectExpr("m - 1 AS node", "m AS needs")).unionByName(top.selectExpr("m AS node", "m - 1 AS needs"))
    return edges.filter("node <> needs").distinct(), c


DAG = "m AS (SELECT max(c_custkey) AS m FROM customer), nodes AS (SELECT c_custkey AS node FROM customer), e AS (SELECT DISTINCT * FROM (SELECT c_custkey AS node, c_custkey // 3 AS needs FROM customer WHERE c_custkey > 0 UNION ALL SELECT c_custkey, c_custkey - 700 FROM customer WHERE c_custkey >= 700 UNION ALL SELECT m - 1, m FROM m UNION ALL SELECT m, m - 1 FROM m) WHERE node <> needs AND needs IN (SELECT node FROM nodes)), bad AS (SELECT m AS node FROM m UNION SELECT m - 1 FROM m UNION SELECT e.node FROM e JOIN bad ON e.needs = bad.node), r AS (SELECT node, 1 AS level FROM nodes WHERE node NOT IN (SELECT node FROM e) UNION SELECT e.node, r.level + 1 FROM e JOIN r ON e.needs = r.node WHERE e.node NOT IN (SELECT node FROM bad))"


@query("l7_dependency_levels", f"WITH RECURSIVE {DAG} SELECT node, CAST(max(level) AS INTEGER) AS level FROM r WHERE node NOT IN (SELECT node FROM bad) GROUP BY 1 UNION ALL SELECT node, NULL FROM bad")
def l7(spark, d):
    return L.dependency_levels(*_dag(spark, d))


#: The DAG's nodes but for applied ones and one that is in progress, and the needs that are open; two cycles have a bridge.
DAG8 = DAG.partition(", bad AS")[0] + ", st AS (SELECT node, CASE WHEN node % 50 = 7 THEN 'in_progress' WHEN node % 4 = 3 AND node < (SELECT m - 9 FROM m) THEN 'applied' WHEN node % 4 = 2 THEN 'failed' ELSE 'pending' END AS status FROM nodes), x AS (SELECT node, needs FROM e UNION SELECT m - 5, m - 4 FROM m UNION SELECT m - 4, m - 5 FROM m UNION SELECT m - 5, m - 3 FROM m UNION SELECT m - 3, m FROM m), o AS (SELECT x.node, needs, b.status FROM x JOIN st a ON a.node = x.node JOIN st b ON b.node = needs WHERE a.status IN ('pending', 'failed') AND b.status <> 'applied'), h AS (SELECT DISTINCT node FROM o WHERE status = 'in_progress'), s0 AS (SELECT node, needs FROM o WHERE status <> 'in_progress'), cy AS (SELECT m AS node FROM m UNION SELECT m - 1 FROM m UNION SELECT m - 4 FROM m UNION SELECT m - 5 FROM m), bad AS (SELECT node FROM cy UNION SELECT node FROM h UNION SELECT s0.node FROM s0 JOIN bad ON s0.needs = bad.node)"


@query("l8_unorderable", f"WITH RECURSIVE {DAG8} SELECT node, CASE WHEN node IN (SELECT node FROM h) THEN 'state' WHEN node IN (SELECT node FROM cy) THEN 'cycle' ELSE 'blocked' END AS kind FROM bad")
def l8(spark, d):
    """The top has two cycles with a bridge of one node between them."""
    edges, c = _dag(spark, d)
    m = c.agg(F.max("node").alias("m"))
    more = [m.selectExpr(f"m - {a} AS node", f"m - {b} AS needs") for a, b in ((5, 4), (4, 5), (5, 3), (3, 0))]
    for x in more:
        edges = edges.unionByName(x)
    status = F.when(F.col("node") % 50 == 7, "in_progress").when((F.col("node") % 4 == 3) & (F.col("node") < F.col("m") - 9), "applied").when(F.col("node") % 4 == 2, "failed").otherwise("pending")
    return L.unorderable(edges.distinct(), c.join(F.broadcast(m.withColumn("one", F.lit(1))), F.lit(1) == F.col("one")).select("node", status.alias("status")))


@query("l9_conflict_pairs", "WITH s AS (SELECT c_custkey, c_nationkey % 3 AS level, 'db' || CAST(c_custkey % 2 AS VARCHAR) AS database, c_custkey % 150 AS r FROM customer), x AS (SELECT c_custkey, level, database, unnest(['t' || CAST(r AS VARCHAR), 't' || CAST(r % 70 AS VARCHAR)]) AS relation FROM s WHERE c_custkey <> 77), d AS (SELECT DISTINCT * FROM x), p AS (SELECT a.c_custkey AS a, b.c_custkey AS b, list_sort(list(DISTINCT a.relation)) AS shared FROM d a JOIN d b ON a.level = b.level AND a.database = b.database AND a.relation = b.relation AND a.c_custkey < b.c_custkey GROUP BY 1, 2) SELECT * FROM p UNION ALL SELECT least(a.c_custkey, b.c_custkey), greatest(a.c_custkey, b.c_custkey), CAST([] AS VARCHAR[]) FROM s a JOIN s b ON a.level = b.level AND a.database = b.database AND a.c_custkey = 77 AND b.c_custkey <> 77")
def l9(spark, d):
    s = table(spark, d, "customer").selectExpr("c_custkey AS spec_id", "c_nationkey % 3 AS level", "'db' || CAST(c_custkey % 2 AS string) AS database", "CASE WHEN c_custkey = 77 THEN CAST(array() AS array<string>) ELSE array('t' || CAST(c_custkey % 150 AS string), 't' || CAST(c_custkey % 150 % 70 AS string)) END AS relations")
    return L.conflict_pairs(s)


SPECS9 = """WITH s AS (SELECT c_custkey, c_nationkey % 3 AS level, 'db' || CAST(c_custkey % 2 AS VARCHAR) AS database, c_custkey % 150 AS r, c_custkey % 77 = 0 AS blank FROM customer),
x AS (SELECT DISTINCT c_custkey, level, database, unnest(['t' || CAST(r AS VARCHAR), 't' || CAST(r % 70 AS VARCHAR)]) AS relation FROM s WHERE NOT blank)"""


def _specs9(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey AS spec_id", "c_nationkey % 3 AS level", "'db' || CAST(c_custkey % 2 AS string) AS database", "CASE WHEN c_custkey % 77 = 0 THEN CAST(array() AS array<string>) ELSE array('t' || CAST(c_custkey % 150 AS string), 't' || CAST(c_custkey % 150 % 70 AS string)) END AS relations")


@query("l9_conflict_classes", SPECS9 + """, n AS (SELECT database, level, relation, count(*) AS members FROM x GROUP BY ALL HAVING count(*) > 1), b AS (SELECT database, level, count(*) FILTER (blank) AS members, count(*) AS every FROM s GROUP BY ALL)
SELECT x.database, x.level, x.relation, c_custkey AS spec_id, members, CAST(members * (members - 1) // 2 AS BIGINT) AS links FROM x JOIN n ON x.database = n.database AND x.level = n.level AND x.relation = n.relation
UNION ALL SELECT s.database, s.level, NULL, c_custkey, members, CAST(members * (members - 1) // 2 + members * (every - members) AS BIGINT) FROM s JOIN b ON s.database = b.database AND s.level = b.level WHERE blank""")
def l9_classes(spark, d):
    return L.conflict_classes(_specs9(spark, d))


@query("l9_conflicts_of", SPECS9 + """, p AS (SELECT least(a.c_custkey, b.c_custkey) AS a, greatest(a.c_custkey, b.c_custkey) AS b, a.relation FROM x a JOIN x b ON a.database = b.database AND a.level = b.level AND a.relation = b.relation AND a.c_custkey <> b.c_custkey WHERE a.c_custkey IN (5, 77)
UNION ALL SELECT least(a.c_custkey, b.c_custkey), greatest(a.c_custkey, b.c_custkey), NULL FROM s a JOIN s b ON a.database = b.database AND a.level = b.level AND a.c_custkey <> b.c_custkey AND (a.blank OR b.blank) WHERE a.c_custkey IN (5, 77))
SELECT a, b, list_sort(list_distinct(coalesce(list(relation) FILTER (relation IS NOT NULL), []))) AS shared FROM p GROUP BY a, b""")
def l9_of(spark, d):
    """The pairs of two stated specs, one of which has no relations."""
    s = _specs9(spark, d)
    return L.conflicts_of(s, s.filter("spec_id IN (5, 77)"))


@query("l10_relation_closure", "WITH r AS (SELECT c_custkey AS spec_id, 'n' || CAST(c_nationkey AS VARCHAR) AS relation FROM customer), f AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS relation, 'r' || CAST(n_regionkey AS VARCHAR) AS other FROM nation UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'n' || CAST(n_nationkey // 2 AS VARCHAR) FROM nation), b AS (SELECT * FROM f UNION ALL SELECT other, relation FROM f) SELECT spec_id, relation FROM r UNION SELECT spec_id, other FROM r JOIN b USING (relation)")
def l10(spark, d):
    n = table(spark, d, "nation")
    f = n.selectExpr("'n' || CAST(n_nationkey AS string) AS relation", "'r' || CAST(n_regionkey AS string) AS other").unionByName(n.selectExpr("'n' || CAST(n_nationkey AS string) AS relation", "'n' || CAST(n_nationkey div 2 AS string) AS other"))
    return L.relation_closure(table(spark, d, "customer").selectExpr("c_custkey AS spec_id", "'n' || CAST(c_nationkey AS string) AS relation"), f)


_ROW11 = """'{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}'"""
_LANES11 = " || ':' || ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * k}, 15) AS BIGINT)) AS VARCHAR)" for k in range(4))


@query("l11_content_digest", f"SELECT count(*) AS rows, sha256(CAST(count(*) AS VARCHAR) || ':' || {_LANES11}) AS digest FROM (SELECT sha256({_ROW11}) AS h FROM orders)")
def l11(spark, d):
    return L.content_digest(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


@query("l11_row_digests", """SELECT l_orderkey, l_linenumber, sha256('{"a":[' || l_linenumber || ',null],"m":{"k1":"' || l_linestatus || '","k2":null},"s":{"part":' || l_partkey || ',"when":"' || strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') || '"}}') AS digest FROM lineitem""")
def l11_rows(spark, d):
    """Digests of nested rows whose fields and entries are not given in order."""
    lines = table(spark, d, "lineitem")
    nested = lines.select("l_orderkey", "l_linenumber", F.struct(F.col("l_shipdate").alias("when"), F.col("l_partkey").alias("part")).alias("s"), F.create_map(F.lit("k2"), F.lit(None).cast("string"), F.lit("k1"), F.col("l_linestatus")).alias("m"), F.array(F.col("l_linenumber"), F.lit(None)).alias("a"))
    return nested.select("l_orderkey", "l_linenumber", L.row_digest(nested.select("s", "m", "a")).alias("digest"))


STEPS = ("l_orderkey AS job_id", "CAST(l_linenumber AS int) AS ordinal", "CASE WHEN l_linestatus = 'F' THEN 'succeeded' ELSE 'running' END AS state", "l_shipdate AS started_at", "CASE WHEN l_linestatus = 'F' THEN l_shipdate + INTERVAL 1 HOUR END AS finished_at", "l_suppkey AS rows_affected")


@query("l12_job_timeline", "WITH s AS (SELECT l_orderkey AS job_id, count(*) AS steps, min(l_shipdate) AS first_start, max(CASE WHEN l_linestatus = 'F' THEN l_shipdate + INTERVAL 1 HOUR END) AS last_finish, sum(l_suppkey) AS rows FROM lineitem GROUP BY 1) SELECT job_id, o_orderstatus AS state, steps, first_start, last_finish, CAST(rows AS BIGINT) AS rows, CAST(epoch(last_finish) - epoch(first_start) AS BIGINT) AS seconds, CASE WHEN last_finish > first_start THEN rows::DOUBLE / (epoch(last_finish) - epoch(first_start)) END AS rows_per_s FROM s JOIN orders ON o_orderkey = job_id")
def l12(spark, d):
    return L.job_timeline(table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("state")), table(spark, d, "lineitem").selectExpr(*STEPS))


@query("l12_step_timeline", "SELECT l_orderkey AS job_id, CAST(l_linenumber AS INTEGER) AS ordinal, CASE WHEN l_linestatus = 'F' THEN 'succeeded' ELSE 'running' END AS state, CASE WHEN l_linestatus = 'F' THEN 3600::BIGINT END AS seconds, l_suppkey AS rows, CASE WHEN l_linestatus = 'F' THEN l_suppkey / 3600.0::DOUBLE END AS rows_per_s FROM lineitem")
def l12_steps(spark, d):
    return L.step_timeline(table(spark, d, "lineitem").selectExpr(*STEPS))


@query("l13_dead_jobs", "SELECT o_orderkey AS job_id FROM orders o WHERE o_orderstatus = 'P' AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey = o_orderkey % 25 AND TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 900 AS INTEGER)) <= o_orderdate)")
def l13(spark, d):
    jobs = table(spark, d, "orders").selectExpr("o_orderkey AS job_id", "o_custkey AS backend_pid", "o_orderkey % 25 AS lock_key", "o_orderdate AS started_at", "CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS finished_at")
    locks = table(spark, d, "customer").selectExpr("c_custkey AS pid", "c_nationkey AS lock_key", "TIMESTAMP_NTZ '1995-01-01 00:00:00' + make_dt_interval(CAST(c_custkey % 900 AS int)) AS backend_start")
    return L.dead_jobs(jobs, locks)


@query("l14_last_state", "SELECT o_custkey AS spec_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS job_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS state FROM orders GROUP BY 1")
def l14(spark, d):
    return L.last_state(table(spark, d, "orders").selectExpr("o_custkey AS spec_id", "o_orderkey AS job_id", "o_orderstatus AS state", "o_orderdate AS started_at"))


#: Roots are the first event, two in the cycle, and every thousandth one.
ROOTS = "event_id IN (1, 2, 40) OR event_id % 1000 = 7"


def _roots(spark, d):
    return table(spark, d, "events").filter(ROOTS).select(F.col("event_id").alias("root"))


@query("l15_blocking_closure", f"WITH RECURSIVE r(root, waiter, depth) AS (SELECT DISTINCT blocker, waiter, 1 FROM wait_edges WHERE blocker IN (SELECT event_id FROM events WHERE {ROOTS}) UNION SELECT r.root, w.waiter, r.depth + 1 FROM r JOIN wait_edges w ON w.blocker = r.waiter WHERE r.depth < 16) SELECT root, waiter, min(depth) AS depth FROM r WHERE waiter <> root GROUP BY 1, 2")
def l15(spark, d):
    return L.blocking_closure(wait_edges(spark, d), _roots(spark, d))


@query("l15_blocking_summary", f"WITH RECURSIVE w AS (SELECT waiter, blocker, TIMESTAMP '2024-01-01' + to_seconds(waiter % 100000) AS waitstart FROM wait_edges), g AS (SELECT event_id AS root FROM events WHERE {ROOTS}), r(root, waiter, depth) AS (SELECT DISTINCT blocker, waiter, 1 FROM w WHERE blocker IN (SELECT root FROM g) UNION SELECT r.root, w.waiter, r.depth + 1 FROM r JOIN w ON w.blocker = r.waiter WHERE r.depth < 16), t AS (SELECT root, count(DISTINCT waiter) AS transitive FROM r WHERE waiter <> root GROUP BY 1), x AS (SELECT blocker AS root, count(DISTINCT waiter) AS direct, arg_min(waiter, (waitstart, waiter)) AS blocking_waiter, max(epoch_ms(TIMESTAMP '2024-01-03') - epoch_ms(waitstart)) AS oldest_wait_ms, CAST(sum(epoch_ms(TIMESTAMP '2024-01-03') - epoch_ms(waitstart)) AS BIGINT) AS inflicted_ms FROM w GROUP BY 1) SELECT root, coalesce(direct, 0) AS direct, coalesce(transitive, 0) AS transitive, blocking_waiter, coalesce(oldest_wait_ms, 0) AS oldest_wait_ms, coalesce(inflicted_ms, 0) AS inflicted_ms FROM g LEFT JOIN x USING (root) LEFT JOIN t USING (root)")
def l15_summary(spark, d):
    edges = wait_edges(spark, d).withColumn("waitstart", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, waiter % 100000)"))
    return L.blocking_summary(edges, _roots(spark, d), "2024-01-03 00:00:00")


def ticks(spark, d):
    return table(spark, d, "events").selectExpr("event_type AS job_id", "ts AS tick", "CAST(event_id % 90 AS int) AS current_backends")


@query("l18_exhaustion_budget", "WITH t AS (SELECT event_type AS job_id, ts AS tick, event_id % 90 AS cur, lag(event_id % 90) OVER w AS old, floor(epoch(ts)) - lag(floor(epoch(ts))) OVER w AS secs FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)) SELECT job_id, tick, CAST(97 - cur AS INTEGER) AS headroom, CASE WHEN cur > old AND secs > 0 THEN (97 - cur)::DOUBLE / ((cur - old)::DOUBLE / secs) END AS seconds_left FROM t")
def l18(spark, d):
    return L.exhaustion_budget(ticks(spark, d), 100, 3)


@query("l19_policy_drift", "WITH a AS (SELECT o_custkey AS target, 'k' || CAST(o_custkey % 3 AS VARCHAR) AS kind, arg_max(o_orderpriority, o_orderkey) AS schedule, arg_max(o_orderstatus = 'P', o_orderkey) AS removed FROM orders GROUP BY 1, 2), p AS (SELECT c_custkey AS target, 'k' || CAST(c_custkey % 3 AS VARCHAR) AS kind, '1-URGENT' AS schedule, c_custkey % 4 = 0 AS paused FROM customer WHERE c_custkey % 5 > 0), j AS (SELECT coalesce(a.target, p.target) AS target, coalesce(a.kind, p.kind) AS kind, CASE WHEN removed IS FALSE AND p.target IS NULL THEN 'removed' WHEN removed IS NOT FALSE AND p.target IS NOT NULL THEN 're-added' WHEN removed IS FALSE AND paused THEN 'paused' WHEN removed IS FALSE AND a.schedule IS DISTINCT FROM p.schedule THEN 'changed' END AS drift FROM a FULL JOIN p ON a.target = p.target AND a.kind = p.kind) SELECT * FROM j WHERE drift IS NOT NULL")
def l19(spark, d):
    applied = table(spark, d, "orders").selectExpr("o_custkey AS target", "'k' || CAST(o_custkey % 3 AS string) AS kind", "o_orderkey AS seq", "o_orderpriority AS schedule", "'{}' AS config", "o_orderstatus = 'P' AS removed")
    there = table(spark, d, "customer").filter("c_custkey % 5 > 0").selectExpr("c_custkey AS target", "'k' || CAST(c_custkey % 3 AS string) AS kind", "'1-URGENT' AS schedule", "'{}' AS config", "c_custkey % 4 = 0 AS paused")
    return L.policy_drift(applied, there)


@query("l20_schedule_diff", "SELECT 'u' AS \"user\", 'j' || CAST(c_custkey AS VARCHAR) AS name, CASE WHEN c_custkey % 3 = 0 THEN 'apply' WHEN c_custkey % 7 = 0 THEN 'undeclared' WHEN c_nationkey < 20 THEN 'satisfied' ELSE 'conflict' END AS action FROM customer WHERE c_custkey % 3 > 0 OR c_custkey % 7 > 0")
def l20(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey", "'u' AS user", "'j' || CAST(c_custkey AS string) AS name", "'0 * * * *' AS schedule", "CAST(c_nationkey AS string) AS command", "'db' AS database", "true AS active")
    actual = c.filter("c_custkey % 3 > 0").withColumn("command", F.expr("CASE WHEN CAST(command AS int) < 20 THEN command ELSE 'x' END"))
    return L.schedule_diff(c.filter("c_custkey % 7 > 0").drop("c_custkey"), actual.drop("c_custkey"))


@query("l21_estimate_freshness", "SELECT o_orderkey AS \"table\", o_orderdate AS read_at, CAST(epoch(TIMESTAMP '2000-01-01') - epoch(o_orderdate) AS BIGINT) AS age_s, epoch(TIMESTAMP '2000-01-01') - epoch(o_orderdate) > 3600 AS stale FROM orders")
def l21(spark, d):
    return L.estimate_freshness(table(spark, d, "orders").select(F.col("o_orderkey").alias("table"), F.col("o_orderdate").alias("read_at")), "2000-01-01 00:00:00")
