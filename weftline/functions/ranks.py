"""Order over all partitions: a global row number, running maxima of any key, and the last bound at or below a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import settled


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in the order of ``order``.

    A range shuffle sorts; places inside a partition get the offset of the partitions
    before. Only the counts, one row a partition, meet in one task. The range sample
    is taken once, as the sorted rows are settled.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = settled(placed.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id"), "ranked")
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__offset"))
    return placed.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__offset") + F.col("__at") + 1).drop("__part", "__at", "__offset")


def in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` settled in ranges of ``order``, with ``__part`` (the range) and ``__at`` (the place in it).

    Rows that are equal in all of ``order`` are in one range; a key with many rows is in many.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    return settled(placed.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id"), "ordered")


def running_max(placed: DataFrame, keys: list[str], value: Column, name: str, inclusive: bool = False) -> DataFrame:
    """``placed`` (of :func:`in_order`, by ``keys`` first) with ``name``: the greatest ``value`` of the key's rows before, and with ``inclusive`` up to, each row.

    A segmented scan. Each range is scanned by itself; a key that goes on from the
    ranges before gets their greatest value, which takes the first and last key of a
    range and one value: one row a range is sorted in one task and broadcast. NULL
    keys are one key; a struct as value keeps what belongs to it.
    """
    whole = F.struct(*keys) if keys else F.struct(F.lit(0).alias("one"))
    rows = placed.withColumn("__key", whole).withColumn("__value", value)
    inside = Window.partitionBy("__part", "__key").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    per_key = rows.groupBy("__part", "__key").agg(F.max("__value").alias("v"), F.min("__at").alias("at"))
    ends = per_key.groupBy("__part").agg(F.min_by("__key", "at").alias("first"), F.max_by(F.struct("__key", "v"), "at").alias("last"))
    gives = ends.select("__part", F.col("last.__key").alias("k"), F.lit(1).alias("gives"), F.col("last.v").alias("v"))
    takes = ends.select("__part", F.col("first").alias("k"), F.lit(0).alias("gives"), F.lit(None).cast(gives.schema["v"].dataType).alias("v"))
    before = Window.partitionBy("k").orderBy("__part", "gives").rowsBetween(Window.unboundedPreceding, 0)
    carry = gives.unionByName(takes).withColumn("__carry", F.max("v").over(before)).filter("gives = 0").select("__part", F.col("k").alias("__first"), "__carry")
    met = rows.withColumn("__own", F.max("__value").over(inside)).join(F.broadcast(carry), "__part")
    # greatest() skips NULLs but does not order structs, a larger array of both does
    both = F.array_max(F.array("__own", F.when(F.col("__key").eqNullSafe(F.col("__first")), F.col("__carry"))))
    return met.withColumn(name, both).drop("__key", "__value", "__own", "__first", "__carry")


def unplaced(df: DataFrame) -> DataFrame:
    """``df`` without the columns of :func:`in_order`."""
    return df.drop("__part", "__at")


def place_in(array: Column, n: int, below) -> Column:
    """How many of the ``n`` elements of a sorted array are ``below`` (true of the first ones only), by halving."""

    def half(s: Column, _: Column) -> Column:
        middle = F.floor((s["a"] + s["b"]) / 2).cast("int")
        right = (s["a"] < s["b"]) & below(F.get(array, middle))
        return F.struct(F.when(right, middle + 1).otherwise(s["a"]).alias("a"), F.when(right | (s["a"] >= s["b"]), s["b"]).otherwise(middle).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, n.bit_length()))), F.struct(F.lit(0).alias("a"), F.lit(n).alias("b")), half)["a"]


#: Bounds that are packed into one broadcast row, which is copied for each row that meets it; more are merged with the rows by a shuffle.
MOST_PACKED = 64


def last_bound(df: DataFrame, key: str, bounds: DataFrame, name: str, most_packed: int = MOST_PACKED) -> DataFrame:
    """``df`` with ``name``: of the ``bounds`` (a column ``lo``, and others) the row of the greatest ``lo`` at or below the key, as a struct; NULL for none or a NULL key.

    A NULL ``lo`` is below all values. Bounds are counted: up to ``most_packed`` are one
    sorted array in a broadcast row, halved until the place is found (7 steps at
    most); more are sorted together with the rows, and the last one is carried along. Rows of
    one key, or without one, are in as many ranges as their number asks.
    """
    rest = [c for c in bounds.columns if c != "lo"]
    sorted_ = F.struct(F.col("lo").isNotNull().alias("some"), "lo", *rest)
    n = bounds.count()
    if n <= most_packed:
        packed = bounds.agg(F.sort_array(F.collect_list(sorted_)).alias("__all"))
        count = place_in(F.col("__all"), n, lambda b: ~b["some"] | (b["lo"] <= F.col(key)))
        found = df.join(F.broadcast(packed)).withColumn("__n", F.when(F.col(key).isNotNull(), count))
        return found.withColumn(name, F.when(F.col("__n") > 0, F.get(F.col("__all"), F.col("__n") - 1))).drop("__all", "__n")
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    marks = bounds.select(F.col("lo").alias("__v"), F.lit(0).alias("__kind"), sorted_.alias("__b"), F.lit(None).cast(df.select(own.alias("r")).schema["r"].dataType).alias("__row"))
    rows = df.select(F.col(key).alias("__v"), F.lit(1).alias("__kind"), F.lit(None).cast(marks.schema["__b"].dataType).alias("__b"), own.alias("__row"), F.monotonically_increasing_id().alias("__nth"))
    both = marks.withColumn("__nth", F.lit(0).cast("long")).unionByName(rows)
    met = running_max(in_order(both, ["__v", "__kind", "__nth"]), [], F.col("__b"), "__found").filter("__kind = 1")
    return met.select("__row.*", F.when(F.col("__v").isNotNull(), F.col("__found")).alias(name))
