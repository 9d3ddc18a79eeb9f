"""Mixing sources to target weights, with DataFrame operations only.

Tokens (words) are summed per source, each source gets a target from its weight,
and a document is emitted ``floor(rate)`` times plus one more copy with the
probability of the fraction, drawn from a hash of its id. The table of sources
is an aggregate with one row per source; documents are never grouped or sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, join_small, restored, stage, unit_hash, without, words

#: Production parameters: weights by source order, repeated; share of all words; limit of repetition.
WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MAX_REPEAT = 2.0
SEED = "mix-1"
#: Columns that the mix reads.
READ = ("doc_id", "text", "source")


def source_targets(sized: DataFrame, weights=WEIGHTS, share=TOTAL_SHARE, most=MAX_REPEAT) -> DataFrame:
    """``source, source_size, target, rate`` from rows of ``source, size``.

    Sources in code-point order, null last, take the weights in turn. The targets
    share ``share`` times all words; none passes ``most`` times its source's size,
    and what that cuts is shared again by weight among the others. The fixed point
    of that sharing is the water level ``max(left / weight left)`` over the sources
    in the order of their limit per weight, so no loop is needed. The two windows
    run over the aggregate of sources. An empty table gives no row; a source of no
    words gets target 0 and rate 0.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    limits = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("nth", F.row_number().over(ordered))
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(most)))
    )
    upward = Window.orderBy(F.col("most") / F.col("weight"), F.col("nth"))
    left = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)) - F.sum("most").over(upward.rowsBetween(Window.unboundedPreceding, 0)) + F.col("most")
    weight_left = F.sum("weight").over(upward.rowsBetween(0, Window.unboundedFollowing))
    levels = limits.withColumn("level", left / weight_left).withColumn("water", F.max("level").over(Window.partitionBy()))
    target = F.least(F.col("most"), F.col("water") * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def _copied(docs: DataFrame, seed: str, **targets) -> DataFrame:
    """``source, doc_id, text``, the rest as one struct, and size, source's size, target and copies under names of their own."""
    rows = carried(docs, *READ).withColumn("q__size", F.size(words(F.col("text"))).cast("long"))
    plan = stage(source_targets(rows.select("source", F.col("q__size").alias("size")), **targets), "mix-targets")
    plan = plan.select(*[F.col(c).alias(f"q__p_{c}") for c in plan.columns])
    joined = join_small(rows, plan, F.col("source").eqNullSafe(F.col("q__p_source")))
    whole = F.floor("q__p_rate")
    # a null id draws by its text
    drawn = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("\x1f"), F.coalesce("text", F.lit(""))))
    return joined.withColumn("q__copies", whole + (unit_hash(F.lit(seed), drawn) < F.col("q__p_rate") - whole).cast("long"))


def with_copies(docs: DataFrame, seed: str = SEED, **targets) -> DataFrame:
    """``docs`` with ``mix_size, mix_source_size, mix_target, mix_copies`` appended.

    Null texts count no words, null sources form one source. Rows that repeat an
    id draw alike, so reruns agree whatever the partitioning; rows without an id
    draw by their text. A document's copies never pass the repetition limit rounded
    up. Own columns of these four names are replaced, all others are kept whatever
    their names. An empty table gives no rows.
    """
    docs = without(docs, "mix_size", "mix_source_size", "mix_target", "mix_copies")
    made = {"mix_size": "q__size", "mix_source_size": "q__p_source_size", "mix_target": "q__p_target", "mix_copies": "q__copies"}
    return _copied(docs, seed, **targets).select(*restored(docs, *READ), *[F.col(q).alias(c) for c, q in made.items()])


def mix(docs: DataFrame, seed: str = SEED, **targets) -> DataFrame:
    """The mixture itself: each row of ``docs``, with its own columns alone, as many times as the mix takes it."""
    copies = F.when(F.col("q__copies") > 0, F.sequence(F.lit(1), F.col("q__copies").cast("int"))).otherwise(F.array().cast("array<int>"))
    return _copied(docs, seed, **targets).withColumn("q__copy", F.explode(copies)).select(*restored(docs, *READ))
