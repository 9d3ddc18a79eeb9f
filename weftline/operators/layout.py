"""Partitions and time chunks: routing, bounds, retention, rollups and their refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import holds
from ..functions.ranks import in_order, last_bound, running_max
from .changes import Refused


def bound_condition(key: str, bound: dict) -> Column:
    """A partition's bound as an expression over ``key``: range ``[lo, hi)``, list, or hash; a NULL key is in none."""
    c = F.col(key)
    if "values" in bound:
        return holds(c.isin(bound["values"]))
    if "modulus" in bound:
        return holds(F.pmod(c, F.lit(bound["modulus"])) == bound["remainder"])
    out = F.lit(True)
    if bound.get("lo") is not None:
        out &= c >= F.lit(bound["lo"])
    if bound.get("hi") is not None:
        out &= c < F.lit(bound["hi"])
    return holds(out & c.isNotNull())


def _routed(df: DataFrame, key: str, bounds: DataFrame, default: str | None) -> DataFrame:
    """:func:`route_rows` by a table of bounds."""
    kind = df.schema[key].dataType
    bounds = bounds.withColumns({c: F.col(c).cast(kind) for c in ("lo", "hi", "value") if c in bounds.columns})
    bounds = bounds.withColumns({c: F.lit(None).cast(kind) for c in ("lo", "hi", "value") if c not in bounds.columns})
    if not overlapping_bounds(bounds.withColumn("parent", F.lit(0))).isEmpty():
        raise Refused("bounds overlap")
    kinds = {r[0] for r in bounds.select("kind").distinct().collect()}
    if bad := kinds - {"range", "list", "hash", "default"}:
        raise Refused(f"no kind of bound {bad}")
    of = lambda k: bounds.filter(F.col("kind") == k)
    if default is None and "default" in kinds:
        default = of("default").select("partition").first()[0]
    out, found = df, []
    if "range" in kinds:
        out = last_bound(out, key, of("range").select("lo", "hi", F.col("partition").alias("name")), "__range")
        found.append(F.when(F.col("__range.hi").isNull() | (F.col(key) < F.col("__range.hi")), F.col("__range.name")))
    if "list" in kinds:
        out = out.join(of("list").select(F.col("value").alias("__value"), F.col("partition").alias("__listed")), F.col(key) == F.col("__value"), "left")
        found.append(F.col("__listed"))
    moduli = [r[0] for r in of("hash").select("modulus").distinct().collect()] if "hash" in kinds else []
    for m in sorted(moduli):
        own = of("hash").filter(F.col("modulus") == m).select(F.col("remainder").alias(f"__r{m}"), F.col("partition").alias(f"__hash{m}"))
        out = out.join(own, F.pmod(F.col(key), F.lit(m)) == F.col(f"__r{m}"), "left")
        found.append(F.col(f"__hash{m}"))
    return out.select(*[c for c in df.columns if c != "partition"], F.coalesce(*found, F.lit(default)).alias("partition"))


def bound_table(spark, bounds: dict[str, dict]) -> DataFrame:
    """A dictionary of bounds as the table ``partition, kind, lo, hi, value, modulus, remainder`` (values as text)."""
    text = lambda v: None if v is None else str(v)
    rows = []
    for name, b in bounds.items():
        if "values" in b:
            rows += [(name, "list", None, None, text(v), None, None) for v in b["values"]]
        elif "modulus" in b:
            rows.append((name, "hash", None, None, None, b["modulus"], b["remainder"]))
        else:
            rows.append((name, "range", text(b.get("lo")), text(b.get("hi")), None, None, None))
    return spark.createDataFrame(rows, "partition string, kind string, lo string, hi string, value string, modulus int, remainder int")


#: Bounds of a dictionary that become conditions one by one; more are looked up in a table.
FEW_BOUNDS = 16


def route_rows(df: DataFrame, key: str, bounds: dict[str, dict] | DataFrame, default: str | None = None) -> DataFrame:
    """``df`` with ``partition``: by bound, else ``default``; NULL marks a row that no partition takes.

    ``bounds`` are a dictionary (see :func:`bound_condition`) or a table ``partition, kind`` (``range``,
    ``list``, ``hash``, ``default``) ``, lo, hi, value, modulus, remainder``, of which a kind uses its own; a NULL ``lo`` or ``hi`` is no limit.
    Ranges of a table are searched in order, values and remainders joined, so the plan
    does not grow with the bounds; bounds that overlap are refused.
    """
    if isinstance(bounds, DataFrame):
        return _routed(df, key, bounds, default)
    if len(bounds) > FEW_BOUNDS:
        return _routed(df, key, bound_table(df.sparkSession, bounds), default)
    out = F.lit(default)
    for name, bound in reversed(list(bounds.items())):
        out = F.when(bound_condition(key, bound), name).otherwise(out)
    return df.withColumn("partition", out)


def check_attach(df: DataFrame, key: str, bound: dict | None) -> DataFrame:
    """Rows of a candidate outside its bound, NULL keys included; a default has no bound."""
    return df.filter(~bound_condition(key, bound)) if bound else df.limit(0)


def default_conflicts(default: DataFrame, key: str, bound: dict) -> DataFrame:
    """Rows of the default partition that a new bound would take."""
    return default.filter(bound_condition(key, bound))


def overlapping_bounds(bounds: DataFrame) -> DataFrame:
    """``parent, kind, a, b`` of a bound table ``parent, partition, kind, lo, hi, value``: ranges that overlap an earlier one, list values given twice, second defaults.

    Ranges are compared with the farthest end before them in one order over all
    partitions; ``a`` has that end. A NULL ``lo`` or ``hi`` is no limit. Empty ranges overlap nothing.
    """
    ranges = bounds.filter("kind = 'range'").select("parent", F.col("lo").isNotNull().alias("some"), "lo", "partition", F.struct(F.col("hi").isNull().alias("none"), F.col("hi").alias("v"), F.col("partition").alias("p")).alias("end")).filter("lo IS NULL OR end.none OR lo < end.v")
    met = running_max(in_order(ranges, ["parent", "some", "lo", "partition"]), ["parent"], F.col("end"), "far")
    hit = F.col("far").isNotNull() & (F.col("lo").isNull() | F.col("far.none") | (F.col("lo") < F.col("far.v")))
    twice = lambda kind, *keys: bounds.filter(F.col("kind") == kind).groupBy("parent", *keys).agg(F.min("partition").alias("a"), F.max("partition").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("parent", F.lit(kind).alias("kind"), "a", "b")
    return met.filter(hit).select("parent", F.lit("range").alias("kind"), F.col("far.p").alias("a"), F.col("partition").alias("b")).unionByName(twice("list", "value")).unionByName(twice("default"))


def detach_partition(df: DataFrame, key: str, bound: dict) -> tuple[DataFrame, DataFrame]:
    """``kept, detached``."""
    inside = bound_condition(key, bound)
    return df.filter(~inside), df.filter(inside)


def partition_stats(df: DataFrame, key: str, bounds: dict[str, dict] | DataFrame, default: str | None = None) -> DataFrame:
    """``partition, rows, min_key, max_key``."""
    return route_rows(df, key, bounds, default).groupBy("partition").agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("min_key"), F.max(key).alias("max_key"))


def _step(interval: str) -> tuple[str | None, str]:
    number, unit = interval.split()
    months = {"month": 1, "quarter": 3, "year": 12}.get(unit.rstrip("s"))
    if months and int(number) != 1:
        raise Refused("months are counted one unit at a time")
    return (unit.rstrip("s"), interval) if months else (None, interval)


def time_chunks(df: DataFrame, ts: str, interval: str, no_time: str = "refuse") -> DataFrame:
    """``df`` with ``chunk_start, chunk_end``; chunks of fixed length count from 1970.

    Rows without a time belong to no chunk: they are refused, or with ``no_time="keep"``
    kept with NULL chunks, for months and for fixed lengths alike.
    """
    if no_time not in ("refuse", "keep"):
        raise Refused(f"no rule {no_time}")
    if no_time == "refuse" and not unchunkable(df, ts).isEmpty():
        raise Refused("rows without a time have no chunk")
    unit, text = _step(interval)
    if unit:
        start = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")
        return df.withColumn("chunk_start", start).withColumn("chunk_end", F.expr(f"chunk_start + INTERVAL 1 {unit}" if unit != "quarter" else "chunk_start + INTERVAL 3 months"))
    # a window leaves rows without a time out, so they get any, and no chunk
    w = F.window(F.coalesce(F.col(ts), F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")).cast(df.schema[ts].dataType)), text)
    of = lambda side: F.when(F.col(ts).isNotNull(), F.col(f"__w.{side}").cast("timestamp_ntz"))
    return df.withColumn("__w", w).withColumns({"chunk_start": of("start"), "chunk_end": of("end")}).drop("__w")


def unchunkable(df: DataFrame, ts: str) -> DataFrame:
    """Rows without a time."""
    return df.filter(F.col(ts).isNull())


def chunk_catalog(df: DataFrame, ts: str, interval: str) -> DataFrame:
    """``chunk_start, chunk_end, rows, min_ts, max_ts``."""
    return time_chunks(df, ts, interval).groupBy("chunk_start", "chunk_end").agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))


def set_chunk_interval(df: DataFrame, ts: str, chunks: DataFrame, interval: str) -> DataFrame:
    """``df`` in the ``chunks`` that are there (``chunk_start, chunk_end``, apart), and in new ones of ``interval`` where none is.

    A time is looked up in the chunks first. A new chunk ends where one that is there begins and
    begins where one ends, so no two chunks overlap. Rows without a time are refused.
    """
    spans = chunks.select(F.col("chunk_start").alias("lo"), F.col("chunk_end").alias("hi"))
    if not overlapping_bounds(spans.select(F.lit(0).alias("parent"), F.col("lo").alias("partition"), F.lit("range").alias("kind"), "lo", "hi", F.lit(None).cast("string").alias("value"))).isEmpty():
        raise Refused("chunks overlap")
    grid = time_chunks(df, ts, interval).withColumn("__ts", F.col(ts).cast("timestamp_ntz"))
    # the next chunk is the last one in the order of negated starts
    back = spans.select((-F.unix_micros(F.col("lo").cast("timestamp"))).alias("lo"), F.col("lo").alias("begins"))
    met = last_bound(grid, "__ts", spans, "__last").withColumn("__back", -F.unix_micros(F.col("__ts").cast("timestamp")) - 1)
    met = last_bound(met, "__back", back, "__next")
    inside = F.coalesce(F.col("__ts") < F.col("__last.hi"), F.lit(False))
    start = F.when(inside, F.col("__last.lo")).otherwise(F.greatest("chunk_start", "__last.hi"))
    end = F.when(inside, F.col("__last.hi")).otherwise(F.least("chunk_end", "__next.begins"))
    return met.withColumns({"__start": start, "__end": end}).select(*df.columns, F.col("__start").alias("chunk_start"), F.col("__end").alias("chunk_end"))


def retention(df: DataFrame, ts: str, interval: str, drop_after: str, as_of: str, data_loss_ok: bool = False, no_time: str = "refuse") -> tuple[DataFrame, DataFrame]:
    """``kept`` and one row ``rows_dropped, chunks_dropped, rows_without_time``: chunks that end at or before ``as_of - drop_after`` go whole.

    Rows without a time are refused, or kept and counted (``no_time``, see :func:`time_chunks`).
    """
    if not data_loss_ok:
        raise Refused("retention loses rows; say so")
    chunked = time_chunks(df, ts, interval, no_time)
    old = holds(F.col("chunk_end") <= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {drop_after}"))
    report = chunked.agg(F.count_if(old).alias("rows_dropped"), F.count_distinct(F.when(old, F.col("chunk_start"))).alias("chunks_dropped"), F.count_if(F.col("chunk_start").isNull()).alias("rows_without_time"))
    return chunked.filter(~old).drop("chunk_start", "chunk_end"), report


def columnstore(df: DataFrame, segment_by: list[str], order_by: list[Column]) -> DataFrame:
    """Clustered by segment and sorted inside, ready to be written as Parquet."""
    return df.repartition(*segment_by).sortWithinPartitions(*segment_by, *order_by)


def columnstore_policy(chunks: DataFrame, after: str, as_of: str) -> DataFrame:
    """Chunks of a catalogue that are due for compaction."""
    return chunks.filter(F.col("chunk_end") <= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {after}"))


def continuous_aggregate(df: DataFrame, ts: str, bucket: str, keys: list[str], aggs: list[Column]) -> DataFrame:
    """``bucket`` (its start), keys and aggregates."""
    return time_chunks(df, ts, bucket).groupBy(F.col("chunk_start").alias("bucket"), *keys).agg(*aggs)


def cagg_refresh(agg: DataFrame, df: DataFrame, ts: str, bucket: str, keys: list[str], aggs: list[Column], start_offset: str, end_offset: str, as_of: str) -> DataFrame:
    """Recompute the buckets wholly inside ``[as_of - start, as_of - end)``; the others stay as they were. Rows without a time are in no bucket and are refused."""
    if not unchunkable(df, ts).isEmpty():
        raise Refused("rows without a time have no bucket")
    lo, hi = (F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {o}") for o in (start_offset, end_offset))
    chunked = time_chunks(df.filter((F.col(ts) >= lo) & (F.col(ts) < hi)), ts, bucket, "keep").filter((F.col("chunk_start") >= lo) & (F.col("chunk_end") <= hi))
    fresh = chunked.groupBy(F.col("chunk_start").alias("bucket"), *keys).agg(*aggs)
    end = F.expr(f"bucket + INTERVAL {bucket}")
    return agg.filter(~((F.col("bucket") >= lo) & (end <= hi))).unionByName(fresh)


def cagg_realtime(agg: DataFrame, df: DataFrame, ts: str, bucket: str, keys: list[str], aggs: list[Column], materialized_only: bool) -> DataFrame:
    """The materialised buckets, and unless ``materialized_only`` the live ones past them."""
    if materialized_only:
        return agg
    mark = agg.agg(F.expr(f"max(bucket) + INTERVAL {bucket}").alias("__mark"))
    live = df.join(F.broadcast(mark), F.col("__mark").isNull() | F.col(ts).isNull() | (F.col(ts) >= F.col("__mark"))).drop("__mark")
    return agg.unionByName(continuous_aggregate(live, ts, bucket, keys, aggs))


def window_counts(df: DataFrame, ts: str, kind: str, duration: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """``start, end``, keys and ``rows`` of tumbling, sliding or session windows."""
    w = F.session_window(F.col(ts), duration) if kind == "session" else F.window(F.col(ts), duration, slide or duration)
    return df.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("rows")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), *keys, "rows")


def unique_covers_partition_key(constraints: DataFrame, dimensions: DataFrame) -> DataFrame:
    """``table, name, missing``: unique keys (``table, name, columns``) that leave out a dimension (``table, dimension``)."""
    dims = dimensions.groupBy("table").agg(F.array_sort(F.collect_set("dimension")).alias("dims"))
    return constraints.join(dims, "table").withColumn("missing", F.array_except("dims", "columns")).filter(F.size("missing") > 0).select("table", "name", "missing")

