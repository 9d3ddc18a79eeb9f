"""Change feeds: differences of snapshots, publication, applying, and states in time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import same_key
from .changes import Refused


def snapshot_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Key, ``action`` (I/U/D), ``old`` and ``new`` as maps, and ``changed_fields``: the new values that differ."""
    rest = [c for c in before.columns if c not in key]
    b, a = before.withColumn("__b", F.lit(True)).alias("b"), after.withColumn("__a", F.lit(True)).alias("a")
    joined = b.join(a, same_key("b", "a", key), "full_outer")
    was, is_ = F.col("b.__b").isNotNull(), F.col("a.__a").isNotNull()
    differs = reduce(lambda x, y: x | y, [~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in rest], F.lit(False))
    as_map = lambda s: F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*[F.col(f"{s}.{c}").cast("string") for c in rest]))
    action = F.when(~was, "I").when(~is_, "D").when(differs, "U")
    rows = joined.select(*[F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in key], action.alias("action"), F.when(was, as_map("b")).alias("old"), F.when(is_, as_map("a")).alias("new")).filter("action IS NOT NULL")
    changed = F.when(F.col("action") == "U", F.map_filter("new", lambda k, v: ~v.eqNullSafe(F.col("old")[k])))
    return rows.withColumn("changed_fields", changed)


def publish(feed: DataFrame, tables: list[str], operations: list[str], roots: DataFrame | None = None) -> DataFrame:
    """The chosen tables and operations of ``table, action, ...``; with ``roots`` (``leaf, root``) a leaf's name becomes its root's first."""
    if roots is not None:
        feed = feed.join(roots, F.col("table") == F.col("leaf"), "left").withColumn("table", F.coalesce("root", "table")).drop("leaf", "root")
    return feed.filter(F.col("table").isin(tables) & F.col("action").isin(operations))


def replica_identity(feed: DataFrame, mode: str, key: list[str], index: list[str] | None = None) -> DataFrame:
    """``old`` cut to what identifies a row: the key, an index's columns, all, or nothing (then updates and deletes are refused)."""
    if mode == "full":
        return feed
    if mode == "nothing":
        if not feed.filter("action IN ('U', 'D')").isEmpty():
            raise Refused("updates and deletes have no identity")
        return feed.withColumn("old", F.lit(None).cast(feed.schema["old"].dataType))
    kept = index if mode == "index" else key
    return feed.withColumn("old", F.map_filter("old", lambda k, _: k.isin(kept)))


def last_changes(feed: DataFrame, key: list[str], sequence: str = "seq") -> DataFrame:
    """The last change per key."""
    rest = [c for c in feed.columns if c not in key]
    return feed.groupBy(*key).agg(F.max_by(F.struct(*rest), sequence).alias("__r")).select(*key, "__r.*")


def apply_feed(target: DataFrame, feed: DataFrame, key: list[str], sequence: str = "seq") -> DataFrame:
    """The last change per key in order wins, then rows are put in, replaced or taken out. ``feed``: the target's columns, ``action, seq``."""
    last = last_changes(feed, key, sequence)
    kept = target.join(last.select(*key), key, "left_anti")
    return kept.unionByName(last.filter("action <> 'D'").select(*target.columns))


def initial_copy_then_follow(base: DataFrame, feed: DataFrame, key: list[str], copied_at: int, sequence: str = "seq") -> DataFrame:
    """The copy, then only changes after it."""
    return apply_feed(base, feed.filter(F.col(sequence) > copied_at), key, sequence)


def history_asof(audit: DataFrame, key: list[str], at, ts: str = "action_ts") -> DataFrame:
    """The table at a time from its audit rows (``action``, the row's columns and ``ts``): the last row per key that is no delete."""
    rows = audit.filter(F.col(ts) <= F.lit(at))
    return last_changes(rows, key, ts).filter("action <> 'D'").drop("action", ts)
