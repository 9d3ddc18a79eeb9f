"""Schema evolution on data: columns added, filled, retyped, generated; catalogues compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.predicates import column
from ..functions.ranks import global_rank
from .changes import Refused


def add_column(df: DataFrame, name: str, type_: str, default: Column | None = None, nullable: bool = True) -> DataFrame:
    """Existing rows read the default. NOT NULL without one is refused on a table with rows."""
    if name in df.columns:
        raise Refused(f"{name} is there")
    if not nullable and default is None and not df.isEmpty():
        raise Refused(f"{name} would be NULL")
    return df.withColumn(name, (F.lit(None) if default is None else default).cast(type_))


def _sources(df: DataFrame, fill: list) -> tuple[DataFrame, list[Column], list[str]]:
    """The frame with each join source attached, the sources' values, and the helper columns."""
    out, values, added = df, [], []
    for i, source in enumerate(fill):
        if isinstance(source, dict):
            on, value = source["on"], f"__v{i}"
            keys = [f"__k{i}_{n}" for n in range(len(on))]
            picked = source["from"].select(*[column(right).alias(k) for (_, right), k in zip(on.items(), keys, strict=True)], column(source["value"]).alias(value))
            cond = reduce(lambda a, b: a & b, [F.col(left) == F.col(k) for left, k in zip(on, keys, strict=True)])
            out = out.join(picked, cond, "left")
            added += [*keys, value]
            values.append(F.col(value))
        else:
            values.append(column(source))
    return out, values, added


def fill_column(df: DataFrame, name: str, type_: str, fill: list) -> DataFrame:
    """Add ``name`` from ordered sources; the first value that is not NULL wins.

    A source is an expression over the row, or ``{"from": frame, "on": {column: expression}, "value": expression}``
    joined once; a row found with NULL falls through to the next.
    """
    out, values, added = _sources(df, fill)
    return out.withColumn(name, F.coalesce(*values).cast(type_)).drop(*added)


def fill_source_histogram(df: DataFrame, fill: list) -> DataFrame:
    """``source, rows``: which source number (from 1; 0 for none) gave the rows their value."""
    out, values, _ = _sources(df, fill)
    which = reduce(lambda otherwise, iv: F.when(iv[1].isNotNull(), iv[0]).otherwise(otherwise), reversed(list(enumerate(values, 1))), F.lit(0))
    return out.groupBy(which.alias("source")).agg(F.count(F.lit(1)).alias("rows"))


def fill_over_default(df: DataFrame, name: str, default: Column, fill: Column | str) -> DataFrame:
    """Write only rows that still hold the default, where the fill is not NULL and differs from it."""
    old, new = F.col(name), column(fill)
    return df.withColumn(name, F.when(old.eqNullSafe(default) & new.isNotNull() & ~new.eqNullSafe(default), new).otherwise(old))


def unfilled_rows(df: DataFrame, name: str) -> DataFrame:
    """Rows for which no source gave a value."""
    return df.filter(F.col(name).isNull())


def alter_column_type(df: DataFrame, name: str, type_: str, using: Column | str | None = None) -> DataFrame:
    """Cast, or the given expression cast; a value that does not convert fails the change (ANSI)."""
    return df.withColumn(name, (F.col(name) if using is None else column(using)).cast(type_))


def cast_failures(df: DataFrame, name: str, type_: str) -> DataFrame:
    """Rows whose value would not convert."""
    return df.filter(F.col(name).isNotNull() & F.col(name).try_cast(type_).isNull())


def classify_type_change(pairs: DataFrame) -> DataFrame:
    """``pairs`` (``old, new`` type names) with ``class``: same, free, or rewrite.

    Free are a longer or open varchar, varchar to text, and a numeric of more digits
    at the same scale.
    """
    length = lambda c: F.regexp_extract(c, r"^varchar\((\d+)\)$", 1)
    digits = lambda c, g: F.regexp_extract(c, r"^numeric\((\d+),(\d+)\)$", g)
    old, new = F.col("old"), F.col("new")
    number = lambda c: F.expr(f"try_cast({c} AS int)")
    named = pairs.withColumns({"__a": length(old), "__b": length(new), "__p": digits(old, 1), "__q": digits(new, 1), "__s": digits(old, 2), "__u": digits(new, 2)})
    free = (F.col("__a") != "") & (number("__b") >= number("__a")) | old.startswith("varchar") & new.isin("text", "varchar") | (F.col("__p") != "") & (F.col("__s") == F.col("__u")) & (number("__q") >= number("__p"))
    return named.withColumn("class", F.when(old == new, "same").when(F.coalesce(free, F.lit(False)), "free").otherwise("rewrite")).select(*pairs.columns, "class")


def drop_column(df: DataFrame, name: str) -> DataFrame:
    """An absent column is already dropped."""
    return df.drop(name)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """Already renamed is satisfied; both or neither there is a conflict."""
    there, done = old in df.columns, new in df.columns
    if there == done:
        raise Refused(f"{old} and {new} are {'both' if there else 'not'} there")
    return df.withColumnRenamed(old, new) if there else df


def alter_column_default(df: DataFrame, name: str, default: str | None) -> DataFrame:
    """Keep a default expression in the column's metadata; it applies to rows written from now on."""
    meta = dict(df.schema[name].metadata) | {"default": default}
    return df.withMetadata(name, {k: v for k, v in meta.items() if v is not None})


def column_defaults(df: DataFrame) -> dict[str, Column]:
    """Defaults that columns declare, for ``insert_rows(defaults=...)``."""
    return {f.name: F.expr(f.metadata["default"]) for f in df.schema.fields if "default" in f.metadata}


def set_identity(df: DataFrame, name: str, order: list[str], start: int = 1, increment: int = 1) -> DataFrame:
    """Generated ids ``start, start + increment, ...`` in the order of ``order``."""
    return global_rank(df, order, "__n").withColumn(name, F.lit(start) + (F.col("__n") - 1) * increment).drop("__n")


def generated(df: DataFrame, name: str, expression: Column | str) -> DataFrame:
    """Recompute a generated column from the row."""
    return df.withColumn(name, column(expression))


def drop_expression(df: DataFrame, name: str) -> DataFrame:
    """Freeze a generated column: its values stay as they are and its declaration goes."""
    return df.withMetadata(name, {k: v for k, v in df.schema[name].metadata.items() if k != "generated"})


def column_catalogue(schemas: dict[str, StructType], spark) -> DataFrame:
    """``table, column, type, not_null`` of named schemas."""
    rows = [(t, f.name, f.dataType.simpleString(), not f.nullable) for t, s in schemas.items() for f in s.fields]
    return spark.createDataFrame(rows, "table string, column string, type string, not_null boolean")


def schema_diff(desired: DataFrame, actual: DataFrame) -> DataFrame:
    """``table, column, action, reason`` of two column catalogues: apply, satisfied or conflict."""
    d, a = desired.alias("d"), actual.alias("a")
    both = d.join(a, (F.col("d.table") == F.col("a.table")) & (F.col("d.column") == F.col("a.column")), "full_outer")
    reason = F.when(F.col("a.column").isNull(), "missing").when(F.col("d.column").isNull(), "undeclared").when(F.col("d.type") != F.col("a.type"), "type differs").when(F.col("d.not_null") != F.col("a.not_null"), "nullability differs").otherwise("")
    action = F.when(F.col("reason") == "missing", "apply").when(F.col("reason") == "", "satisfied").otherwise("conflict")
    return both.select(F.coalesce("d.table", "a.table").alias("table"), F.coalesce("d.column", "a.column").alias("column"), reason.alias("reason")).withColumn("action", action)


def index_equivalence(indexes: DataFrame) -> DataFrame:
    """``table, name, same_as``: indexes that are one under two names.

    ``indexes``: ``table, name, method, is_unique, columns array, descending array of
    booleans, predicate``, and where they are there ``opclasses`` (by column, in their
    order), ``include`` and ``options`` (as sets); a missing one is as its default. A
    full reverse order serves as well, for plain btrees.
    """
    has = lambda c: F.col(c) if c in indexes.columns else F.lit(None).cast("array<string>")
    plain = F.transform("columns", lambda c: F.lit("").cast("string"))
    order = F.arrays_zip("columns", "descending", F.coalesce(has("opclasses"), plain).alias("opclass"))
    back = F.transform(order, lambda c: F.struct(c["columns"].alias("columns"), (~c["descending"]).alias("descending"), c["opclass"].alias("opclass")))
    as_set = lambda c: F.array_sort(F.array_distinct(F.coalesce(has(c), F.array().cast("array<string>")))).alias(c)
    key = F.to_json(F.struct("table", "method", "is_unique", F.least(F.to_json(order), F.when(F.col("method") == "btree", F.to_json(back)).otherwise(F.to_json(order))).alias("order"), F.coalesce("predicate", F.lit("")).alias("predicate"), as_set("include"), as_set("options")))
    keyed = indexes.select("table", "name", key.alias("key"))
    first = keyed.groupBy("key").agg(F.min("name").alias("same_as"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keyed.join(first, "key").filter(F.col("name") != F.col("same_as")).select("table", "name", "same_as")


def view_impact(edges: DataFrame, roots: DataFrame, bound: int = 32) -> DataFrame:
    """``view, depth``: what to rebuild when ``roots`` (``relation``) change; the depth is the longest path, deepest dropped first.

    ``edges``: ``view`` reads ``relation``. Levels are joined until none is new;
    views deeper than ``bound`` are refused, as are edges with a cycle, which have no end.
    """
    from ..functions.staging import settled

    level = roots.select(F.col("relation").alias("view")).distinct()
    found = None
    for depth in range(1, bound + 2):
        level = settled(edges.join(level.withColumnRenamed("view", "relation"), "relation").select("view").distinct(), "views")
        if level.isEmpty():
            break
        if depth > bound:
            raise Refused("the views do not end")
        at = level.withColumn("depth", F.lit(depth))
        found = at if found is None else found.unionByName(at)
    if found is None:
        return edges.select("view", F.lit(0).alias("depth")).limit(0)
    return found.groupBy("view").agg(F.max("depth").alias("depth"))


def touch_updated_at(before: DataFrame, after: DataFrame, key: list[str], stamp: str, name: str = "updated_at") -> DataFrame:
    """``after`` with ``name`` set to ``stamp`` where a value differs from ``before`` or the row is new, else NULL."""
    rest = [c for c in after.columns if c not in key]
    digest = lambda df: df.select(*key, F.struct(*rest).alias("__row"))
    old = digest(before).withColumnRenamed("__row", "__old")
    joined = digest(after).join(old, key, "left")
    return joined.select(*key, "__row.*", F.when(~F.col("__row").eqNullSafe(F.col("__old")), F.to_timestamp_ntz(F.lit(stamp))).alias(name))
