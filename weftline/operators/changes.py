"""Row changes on a key: insert, update, delete, merge, backfill, and the proofs beside them.

Every change is ``DataFrame -> DataFrame``. Expressions see the row as it was; a
refusal raises before anything is built on the change.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import column, holds, same_key
from ..functions.ranks import global_rank


class Refused(ValueError):
    """A declared change that its own rules forbid."""


def _refuse_if_any(rows: DataFrame, why: str) -> None:
    if not rows.isEmpty():
        raise Refused(why)


def _as_target(target: DataFrame, source: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Source rows in the target's columns; absent ones take their default, else NULL."""
    unknown = [c for c in source.columns if c not in target.columns]
    if unknown:
        raise Refused(f"the target has no column {unknown}")
    of = lambda f: F.col(f.name) if f.name in source.columns else (defaults or {}).get(f.name, F.lit(None))
    return source.select(*[of(f).cast(f.dataType).alias(f.name) for f in target.schema.fields])


def duplicate_source_keys(source: DataFrame, key: list[str]) -> DataFrame:
    """Keys given more than once, compared whole, with their ``rows``."""
    return source.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def ambiguous_matches(target: DataFrame, source: DataFrame, target_key: list[str], on: list[str]) -> DataFrame:
    """Target keys that match several source rows, with their ``matches``; counts are made per join key first."""
    counts = source.groupBy(*on).agg(F.count(F.lit(1)).alias("matches")).filter("matches > 1")
    return target.join(counts, on).select(*target_key, "matches")


def key_is_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """One row ``unique, repeated_keys, null_keys``: whether ``key`` names one row."""
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_keys"), F.coalesce(F.sum(F.when(null, F.col("n")).otherwise(0)), F.lit(0)).alias("null_keys"))
    return counts.select(((F.col("repeated_keys") == 0) & (F.col("null_keys") == 0)).alias("unique"), "repeated_keys", "null_keys")


def insert_refusals(target: DataFrame, source: DataFrame, conflict_target: list[str], on_conflict: str = "refuse", conflict_where: str | None = None) -> DataFrame:
    """The key columns and ``why`` of source rows for which an insert is refused: ``given twice``, and with ``refuse`` also ``in the target``.

    Every rule but ``append`` refuses a key that is given twice, as the first of its
    rows would make a conflict of the second. NULL keys, and rows outside ``conflict_where``, are never refused.
    """
    arbiter = holds(conflict_where) if conflict_where else F.lit(True)
    keyed = source.filter(arbiter).dropna(subset=conflict_target)
    twice = duplicate_source_keys(keyed, conflict_target).select(*conflict_target, F.lit("given twice").alias("why"))
    if on_conflict != "refuse":
        return twice
    there = keyed.join(target.filter(arbiter), conflict_target, "left_semi").select(*conflict_target).distinct()
    return twice.unionByName(there.withColumn("why", F.lit("in the target")))


def insert_rows(target: DataFrame, source: DataFrame, on_conflict: str = "append", conflict_target: list[str] | None = None, update_columns: list[str] | None = None, conflict_where: str | None = None, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Insert ``source`` into ``target`` by a stated conflict rule.

    ``append`` adds all rows. With ``conflict_target``: ``refuse`` raises if a key is
    in the target, ``skip`` keeps the target's row, ``update``
    changes ``update_columns`` (else all source columns but the key). A key twice in
    the source is refused by all three (see :func:`insert_refusals`). With
    ``conflict_where`` only rows that satisfy it on both sides can conflict.
    NULL keys never conflict.
    """
    rows = _as_target(target, source, defaults)
    if on_conflict == "append":
        return target.unionByName(rows)
    if not conflict_target:
        raise Refused("a conflict rule needs its key")
    arbiter = holds(conflict_where) if conflict_where else F.lit(True)
    keyed, rest = rows.filter(arbiter), rows.filter(~arbiter)
    known = target.filter(arbiter)
    if on_conflict not in ("refuse", "skip", "update"):
        raise Refused(f"no conflict rule {on_conflict}")
    _refuse_if_any(insert_refusals(target, rows, conflict_target, on_conflict, conflict_where), "a key is given twice or in the target")
    if on_conflict == "refuse":
        return target.unionByName(rows)
    new = keyed.alias("s").join(known.select(*conflict_target).alias("t"), same_key("s", "t", conflict_target), "left_anti").unionByName(rest)
    if on_conflict == "skip":
        return target.unionByName(new)
    changed = update_columns or [c for c in source.columns if c not in conflict_target]
    if missing := [c for c in changed if c not in source.columns]:
        raise Refused(f"the source has no column {missing}")
    match = same_key("t", "s", conflict_target)
    joined = target.withColumn("__arbiter", arbiter).alias("t").join(keyed.withColumn("__hit", F.lit(True)).alias("s"), match & F.col("t.__arbiter"), "left")
    kept = joined.select(*[(F.when(F.col("s.__hit"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")) if c in changed else F.col(f"t.{c}")).alias(c) for c in target.columns])
    return kept.unionByName(new)


def insert_identified(target: DataFrame, source: DataFrame, identity: str, overriding: str | None = None, always: bool = True, generated: tuple[str, ...] = ()) -> DataFrame:
    """Insert where ``identity`` is generated: ``user`` drops supplied ids, ``system`` keeps them.

    Without either, supplied ids of a GENERATED ALWAYS column are refused, as is any
    generated column. New ids follow the target's largest in the order of the rest
    of the row.
    """
    if bad := [c for c in generated if c in source.columns]:
        raise Refused(f"generated columns cannot be written: {bad}")
    if identity in source.columns and overriding != "user":
        if always and overriding != "system":
            raise Refused(f"{identity} is always generated")
        return insert_rows(target, source)
    rows = source.drop(identity)
    top = target.agg(F.coalesce(F.max(identity), F.lit(0)).alias("__top"))
    numbered = global_rank(rows, rows.columns, "__n").crossJoin(F.broadcast(top)).withColumn(identity, F.col("__top") + F.col("__n")).drop("__top", "__n")
    return insert_rows(target, numbered)


def update_rows(target: DataFrame, source: DataFrame, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """A value for each row by key; a NULL overwrites, unmatched source rows do nothing, repeated keys are refused."""
    _refuse_if_any(duplicate_source_keys(source, key), "a key is given twice")
    changed = columns or [c for c in source.columns if c not in key]
    joined = target.alias("t").join(source.withColumn("__hit", F.lit(True)).alias("s"), same_key("t", "s", key), "left")
    return joined.select(*[(F.when(F.col("s.__hit"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")) if c in changed else F.col(f"t.{c}")).alias(c) for c in target.columns])


def delete_rows(target: DataFrame, where: Column | str | None = None, keys: DataFrame | None = None, key: list[str] | None = None) -> DataFrame:
    """Delete by a predicate (only TRUE deletes) or by the keys of ``keys``."""
    if (where is None) == (keys is None):
        raise Refused("give a predicate or keys")
    return target.filter(~holds(where)) if keys is None else target.join(keys.select(*key).distinct(), key, "left_anti")


def _merged(target: DataFrame, source: DataFrame, key: list[str], rules: tuple[str, str, str], update_columns: list[str] | None, check: bool) -> DataFrame:
    """Every row of the full outer join as the target's columns, with ``__was`` (it was there), ``__keep`` and ``__same`` (no value changes)."""
    when_matched, when_not_matched, when_not_matched_by_source = rules
    if rules == ("nothing",) * 3:
        raise Refused("a merge that does nothing")
    for rule, known in zip(rules, (("update", "delete", "nothing"), ("insert", "nothing"), ("nothing", "delete")), strict=True):
        if rule not in known:
            raise Refused(f"no rule {rule}")
    if check:
        _refuse_if_any(duplicate_source_keys(source, key), "a key is twice in the source")
        _refuse_if_any(duplicate_source_keys(target, key), "a key is twice in the target")
    changed = update_columns or [c for c in source.columns if c not in key]
    joined = target.withColumn("__t", F.lit(True)).alias("t").join(source.withColumn("__s", F.lit(True)).alias("s"), same_key("t", "s", key), "full_outer")
    in_t, in_s = F.col("t.__t").isNotNull(), F.col("s.__s").isNotNull()
    keep = F.when(in_t & in_s, F.lit(when_matched != "delete")).when(in_s, F.lit(when_not_matched == "insert")).otherwise(F.lit(when_not_matched_by_source != "delete"))

    def value(c: str) -> Column:
        old, new = F.col(f"t.{c}"), F.col(f"s.{c}") if c in source.columns else F.lit(None)
        update = new if when_matched == "update" and c in changed else old
        return F.when(in_t & in_s, update).when(in_s, new).otherwise(old).cast(target.schema[c].dataType)

    same = reduce(lambda x, y: x & y, [F.col(f"t.{c}").eqNullSafe(value(c)) for c in target.columns if c not in key], F.lit(True))
    return joined.select(*[value(c).alias(c) for c in target.columns], in_t.alias("__was"), keep.alias("__keep"), same.alias("__same"))


def merge_rows(target: DataFrame, source: DataFrame, key: list[str], when_matched: str = "update", when_not_matched: str = "insert", when_not_matched_by_source: str = "nothing", update_columns: list[str] | None = None, check: bool = True) -> DataFrame:
    """The whole MERGE matrix in one full outer join on ``key``.

    ``check`` proves that the key is unique on both sides. A by-source delete is only
    right over the whole source. NULL keys match nothing.
    """
    rows = _merged(target, source, key, (when_matched, when_not_matched, when_not_matched_by_source), update_columns, check)
    return rows.filter("__keep").select(*target.columns)


def merge_counts(target: DataFrame, source: DataFrame, key: list[str], when_matched: str = "update", when_not_matched: str = "insert", when_not_matched_by_source: str = "nothing", update_columns: list[str] | None = None, check: bool = True, then_delete: Column | str = "false") -> DataFrame:
    """One row ``considered, inserted, updated, deleted, unchanged`` of :func:`merge_rows`, counted in its one join.

    Rows that hold ``then_delete`` after the merge are taken out too.
    """
    rows = _merged(target, source, key, (when_matched, when_not_matched, when_not_matched_by_source), update_columns, check)
    stays = F.col("__keep") & ~holds(then_delete)
    rows = rows.select("__was", "__same", stays.alias("__stays")).filter("__was OR __stays")
    return rows.agg(F.count(F.lit(1)).alias("considered"), F.count_if(~F.col("__was")).alias("inserted"), F.count_if(F.col("__was") & F.col("__stays") & ~F.col("__same")).alias("updated"), F.count_if(F.col("__was") & ~F.col("__stays")).alias("deleted"), F.count_if(F.col("__was") & F.col("__stays") & F.col("__same")).alias("unchanged"))


def backfill(target: DataFrame, set_: dict[str, Column | str], where: Column | str | bool | None = None) -> DataFrame:
    """Set columns of the rows that match ``where``, all from the old row; a missing ``where`` is refused, True is accepted."""
    if where is None:
        raise Refused("say which rows; True for all")
    hit = F.lit(True) if where is True else holds(where)
    return target.select(*[F.when(hit, column(set_[c])).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c) if c in set_ else F.col(c) for c in target.columns])


def backfill_from(target: DataFrame, set_: dict[str, Column | str], sources: list[tuple[DataFrame, str, Column | str]], where: Column | str = "true") -> DataFrame:
    """UPDATE ... FROM: ``sources`` are (frame, alias, join condition); the target's alias is ``t``.

    Rows that miss a source or do not match ``where`` stay. A source must match at
    most once a row (see ``ambiguous_matches``).
    """
    joined = target.alias("t")
    for frame, name, on in sources:
        joined = joined.join(frame.withColumn(f"__{name}", F.lit(True)).alias(name), column(on), "left")
    hit = reduce(lambda a, b: a & b, [F.col(f"{n}.__{n}").isNotNull() for _, n, _ in sources]) & holds(where)
    return joined.select(*[F.when(hit, column(set_[c])).otherwise(F.col(f"t.{c}")).cast(target.schema[c].dataType).alias(c) if c in set_ else F.col(f"t.{c}") for c in target.columns])


def preserve(before: DataFrame, changed_keys: DataFrame, key: list[str], columns: list[str] | None = None, saved_at: str = "2024-01-01 00:00:00") -> DataFrame:
    """Pre-image: key and the columns that a change can touch (all for a delete) as they were, with ``saved_at``."""
    rows = before.join(changed_keys.select(*key).distinct(), key, "left_semi")
    return rows.select(*(columns and [*key, *columns] or before.columns), F.to_timestamp_ntz(F.lit(saved_at)).alias("saved_at"))


def revert(after: DataFrame, preimage: DataFrame, key: list[str]) -> DataFrame:
    """Put preserved values back and re-insert deleted rows; rows that the change added stay."""
    return merge_rows(after, preimage.drop("saved_at"), key)


def verify_remaining(after: DataFrame, predicate: Column | str) -> DataFrame:
    """One row ``remaining``: rows that the change should have handled and did not."""
    return after.agg(F.count_if(holds(predicate)).alias("remaining"))


def assert_invariants(before: DataFrame, after: DataFrame, invariants: list[tuple[str, str]]) -> DataFrame:
    """``name, before, after, held`` for each (name, aggregate expression), compared as text; one scan a side."""
    sides = [df.agg(*[F.expr(e).cast("string").alias(n) for n, e in invariants]) for df in (before, after)]
    long = [s.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n, _ in invariants])).alias("r")).select("r.name", F.col("r.v").alias(side)) for s, side in zip(sides, ("before", "after"), strict=True)]
    return long[0].join(F.broadcast(long[1]), "name").withColumn("held", F.col("before").eqNullSafe(F.col("after")))


def sequence_catchup(df: DataFrame, column_: str, current: int) -> DataFrame:
    """One row ``next_value``: after the largest value if there are rows, else ``current``."""
    return df.agg(F.coalesce(F.greatest(F.max(column_) + 1, F.lit(current)), F.lit(current)).cast("long").alias("next_value"))


def change_counts(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """One row ``considered, inserted, updated, deleted, unchanged``."""
    rest = [c for c in before.columns if c not in key]
    joined = before.withColumn("__b", F.lit(True)).alias("b").join(after.withColumn("__a", F.lit(True)).alias("a"), same_key("b", "a", key), "full_outer")
    was, is_ = F.col("b.__b").isNotNull(), F.col("a.__a").isNotNull()
    same = reduce(lambda x, y: x & y, [F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in rest], F.lit(True))
    return joined.agg(F.count(F.lit(1)).alias("considered"), F.count_if(~was).alias("inserted"), F.count_if(was & is_ & ~same).alias("updated"), F.count_if(~is_).alias("deleted"), F.count_if(was & is_ & same).alias("unchanged"))

