"""Distribution over shards: placing, co-located joins, skew and moves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .changes import Refused

#: Rows up to which a reference table is copied to every node.
REFERENCE_ROWS = 1_000_000


def shard_of(name: str, shards: int, method: str = "hash", bounds: list | None = None) -> Column:
    """Shard number of a distribution column: hash, ``modulo`` (whole numbers), or range by ascending lower bounds."""
    if method == "range":
        return reduce(lambda n, b: n + (F.col(name) >= F.lit(b)).cast("int"), bounds, F.lit(-1))
    return F.pmod(F.col(name) if method == "modulo" else F.xxhash64(name), F.lit(shards)).cast("int")


def distribute(df: DataFrame, name: str, shards: int, method: str = "hash", bounds: list | None = None) -> DataFrame:
    """``df`` with ``shard``; a NULL distribution value is refused."""
    if not df.filter(F.col(name).isNull()).isEmpty():
        raise Refused(f"{name} holds NULL")
    return df.withColumn("shard", shard_of(name, shards, method, bounds))


def placed(df: DataFrame, name: str, shards: int) -> DataFrame:
    """Rows dealt so that each value of ``name`` is in one of ``shards`` partitions."""
    return df.repartition(shards, name)


def colocated_join(a: DataFrame, b: DataFrame, key: str, shards: int) -> DataFrame:
    """Join of two frames dealt alike on ``key``: one exchange each, which later joins on it use again. Types must agree."""
    if a.schema[key].dataType != b.schema[key].dataType:
        raise Refused(f"{key} differs in type")
    return a.repartition(shards, key).join(b.repartition(shards, key), key)


def write_colocated(df: DataFrame, name: str, key: str, shards: int) -> None:
    """A bucketed table under the session's warehouse; two with the same key and number join without an exchange."""
    df.repartition(shards, key).write.bucketBy(shards, key).sortBy(key).mode("overwrite").saveAsTable(name)


def bucketed_join(spark: SparkSession, a: str, b: str, key: str) -> DataFrame:
    """Join of two tables of :func:`write_colocated` bucket by bucket; types must agree.

    The hint keeps Spark from broadcasting a side, so the buckets decide at every size.
    """
    left, right = spark.table(a), spark.table(b)
    if left.schema[key].dataType != right.schema[key].dataType:
        raise Refused(f"{key} differs in type")
    return left.hint("merge").join(right, key)


def reference_join(fact: DataFrame, dim: DataFrame, on: Column) -> DataFrame:
    """Join with a table that every node holds, while it has at most ``REFERENCE_ROWS`` rows; a larger one is shuffled."""
    small = dim.limit(REFERENCE_ROWS + 1).count() <= REFERENCE_ROWS
    return fact.join(F.broadcast(dim) if small else dim, on)


def alter_distribution(frames: dict[str, DataFrame], name: str, shards: int, method: str = "hash") -> dict[str, DataFrame]:
    """Re-key or re-shard a frame and those co-located with it."""
    return {k: distribute(df.drop("shard"), name, shards, method) for k, df in frames.items()}


def undistribute(df: DataFrame) -> DataFrame:
    """The frame without its placing."""
    return df.drop("shard")


def shard_stats(df: DataFrame, name: str, shards: int, method: str = "hash") -> DataFrame:
    """``shard, rows, skew, heaviest``: rows over the mean, and the heaviest key with its share."""
    keys = df.groupBy(name).agg(F.count(F.lit(1)).alias("n")).withColumn("shard", shard_of(name, shards, method))
    rows = keys.groupBy("shard").agg(F.sum("n").alias("rows"), F.max("n").alias("heaviest"))
    mean = rows.agg((F.sum("rows") / F.lit(shards)).alias("__mean"))
    return rows.join(F.broadcast(mean)).select("shard", "rows", F.round(F.col("rows") / F.col("__mean"), 6).alias("skew"), "heaviest")


def salted(df: DataFrame, key: str, heavy: DataFrame, ways: int, spread: Column) -> DataFrame:
    """``df`` with ``salt``: 0, or one of ``ways`` for the keys in ``heavy`` (few, by the definition of heavy)."""
    marked = df.join(F.broadcast(heavy.select(F.col(key).alias("__heavy"))), F.col(key) == F.col("__heavy"), "left")
    return marked.withColumn("salt", F.when(F.col("__heavy").isNotNull(), F.pmod(spread, F.lit(ways))).otherwise(0).cast("int")).drop("__heavy")


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """``key, rows``: keys with more than ``share`` of all rows; at most ``1 / share`` of them."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    total = df.agg(F.count(F.lit(1)).alias("__all"))
    return counts.join(F.broadcast(total)).filter(F.col("rows") > share * F.col("__all")).drop("__all")


def per_tenant_apply(df: DataFrame, tenant: str, change, schema) -> DataFrame:
    """Run ``change`` (pandas frame to pandas frame) on one tenant's rows at a time; a tenant must fit a task."""
    return df.groupBy(tenant).applyInPandas(change, schema)


def per_tenant_batches(df: DataFrame, tenant: str, order: list[str], step, schema: str) -> DataFrame:
    """Run ``step`` over each tenant's rows in ``order``, an Arrow batch at a time, with state carried from one to the next.

    ``step(state, batch)`` gets None for a tenant's first batch and gives the next state and a
    batch of ``schema``; batches never span tenants. A tenant's rows are read by one task
    in order, but only one batch of them is held, so a tenant may be larger than a task's memory.
    """
    import pyarrow as pa

    def run(batches):
        state, now, begun = None, None, False
        for batch in batches:
            keys = batch.column(tenant).to_pylist()
            at = 0
            while at < len(keys):
                to = at + 1
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                if not begun or keys[at] != now:
                    state, now, begun = None, keys[at], True
                state, out = step(state, batch.slice(at, to - at))
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)
                at = to

    return df.repartition(tenant).sortWithinPartitions(tenant, *order).mapInArrow(run, schema)


def union_fleet(frames: dict[str, DataFrame], provenance: str = "database") -> DataFrame:
    """One frame of many databases with their name kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(provenance, F.lit(n)) for n, df in frames.items()])
