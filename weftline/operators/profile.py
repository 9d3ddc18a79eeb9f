"""Statistics and profiling, and row policies: what a table holds and who may see it."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import holds


def _comparable(c: str, kind: T.DataType) -> Column:
    """A column that can be ordered and counted: types that hold a map are taken as their JSON text, its entries in order where it is a map itself."""
    if isinstance(kind, T.MapType) and "map<" not in kind.valueType.simpleString() and "map<" not in kind.keyType.simpleString():
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.col(c)))))
    return F.to_json(F.col(c)) if "map<" in kind.simpleString() else F.col(c)


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """``column, rows, nulls, distinct, min, max`` (as text) of every column; maps by their JSON text.

    One aggregation without a shuffle of rows; exact distinct values are then counted
    a column at a time, each in two levels, so rows are not multiplied by columns.
    """
    df = df.select(*[_comparable(f"`{f.name}`", f.dataType).alias(f.name) for f in df.schema.fields])
    last = [("d", F.approx_count_distinct)] if approximate else []
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[f(F.col(c)).alias(f"{k}_{i}") for i, c in enumerate(df.columns) for k, f in [("n", lambda x: F.count_if(x.isNull())), ("lo", lambda x: F.min(x).cast("string")), ("hi", lambda x: F.max(x).cast("string")), *last]])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{i}").alias("nulls"), (F.col(f"d_{i}") if approximate else F.lit(None).cast("long")).alias("distinct"), F.col(f"lo_{i}").alias("min"), F.col(f"hi_{i}").alias("max")) for i, c in enumerate(df.columns)])
    out = row.select("rows", F.explode(each).alias("r")).select("r.column", "rows", "r.nulls", "r.distinct", "r.min", "r.max")
    if approximate or not df.columns:
        return out
    counts = [df.select(F.col(c).alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.lit(1)).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("of"), "n") for c in df.columns]
    return out.join(reduce(DataFrame.unionByName, counts), F.col("column") == F.col("of")).select("column", "rows", "nulls", F.col("n").alias("distinct"), "min", "max")


def ext_ndistinct(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns, n_distinct`` for every subset of at least two columns: combinations first, then one count over grouping sets."""
    sets = [c for k in range(2, len(columns) + 1) for c in combinations(columns, k)]
    base = df.select(*columns).distinct()
    named = F.lit("")
    grouped = base.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.grouping_id().alias("__gid"))
    for s in sets:
        gid = sum((c not in s) << (len(columns) - 1 - i) for i, c in enumerate(columns))
        named = F.when(F.col("__gid") == gid, ",".join(s)).otherwise(named)
    return grouped.groupBy(named.alias("columns")).agg(F.count(F.lit(1)).alias("n_distinct"))


def functional_dependencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, degree``: the share of rows in groups of ``a`` that hold a single ``b``, for each ordered pair."""
    def one(a: str, b: str) -> DataFrame:
        groups = df.groupBy(F.col(a).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.min(b).alias("lo"), F.max(b).alias("hi"), F.count(b).alias("known"))
        single = (F.col("lo") == F.col("hi")) & (F.col("known") == F.col("n")) | (F.col("known") == 0)
        return groups.agg((F.sum(F.when(single, F.col("n")).otherwise(0)) / F.sum("n")).alias("degree")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round("degree", 6).alias("degree"))

    return reduce(DataFrame.unionByName, [one(a, b) for a in columns for b in columns if a != b])


def mcv(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The ``k`` most common combinations with ``frequency`` and ``base_frequency`` (the product of the columns' own)."""
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), *columns).limit(k)
    out = counts.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("__all"))))
    base = F.lit(1.0)
    for c in columns:
        own = df.groupBy(F.col(c).alias(f"__{c}")).agg(F.count(F.lit(1)).alias(f"__n_{c}"))
        out = out.join(own, F.col(c).eqNullSafe(F.col(f"__{c}")))
        base = base * F.col(f"__n_{c}") / F.col("__all")
    return out.select(*columns, F.round(F.col("n") / F.col("__all"), 8).alias("frequency"), F.round(base, 8).alias("base_frequency"))


def reconcile(before: DataFrame, after: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Per group: rows and sums before and after, and whether both agree (sums to a cent)."""
    side = lambda df, s: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"rows_{s}"), F.round(F.sum(measure), 2).alias(f"sum_{s}"))
    both = side(before, "before").join(side(after, "after"), keys, "full_outer")
    return both.withColumn("same", F.col("rows_before").eqNullSafe(F.col("rows_after")) & F.col("sum_before").eqNullSafe(F.col("sum_after")))


def apply_policies(df: DataFrame, policies: list[dict], role: str, command: str, enabled: bool = True, owner: str | None = None, forced: bool = False, superusers: tuple[str, ...] = ()) -> DataFrame:
    """Rows for which a policy of the role (or PUBLIC) and the command is TRUE; none without a policy.

    The owner passes unless forced, superusers always. A policy is ``{"roles": [...], "command": ..., "using": expression}``.
    """
    if not enabled or role in superusers or (role == owner and not forced):
        return df
    mine = [p["using"] for p in policies if p["command"] in (command, "all") and (role in p["roles"] or "PUBLIC" in p["roles"])]
    return df.filter(reduce(lambda a, b: a | b, [holds(u) for u in mine], F.lit(False)))


def visible_columns(df: DataFrame, grants: dict[str, list[str]], role: str) -> DataFrame:
    """The columns that SELECT is granted on, for the role or PUBLIC."""
    seen = set(grants.get(role, [])) | set(grants.get("PUBLIC", []))
    return df.select(*[c for c in df.columns if c in seen])


def effective_grants(acl: DataFrame) -> DataFrame:
    """``object, grantee, privilege, grantable, grantor`` of ``object, acl`` items ``grantee=privs/grantor``; an empty grantee is PUBLIC, ``*`` marks the grant option."""
    part = lambda g: F.regexp_extract("acl", r"^([^=]*)=([A-Za-z*]*)/(.*)$", g)
    named = acl.select("object", F.when(part(1) == "", "PUBLIC").otherwise(part(1)).alias("grantee"), part(3).alias("grantor"), F.explode(F.regexp_extract_all(part(2), F.lit(r"([A-Za-z]\*?)"), F.lit(1))).alias("p"))
    return named.select("object", "grantee", F.substring("p", 1, 1).alias("privilege"), F.col("p").endswith("*").alias("grantable"), "grantor")


def labelled_columns(df: DataFrame, labels: dict[str, str], clearance: set[str]) -> DataFrame:
    """Columns whose label the reader lacks are masked: text as its SHA-256, the rest as NULL."""
    def masked(name: str, kind: str) -> Column:
        if name not in labels or labels[name] in clearance:
            return F.col(name)
        return (F.sha2(F.col(name), 256) if kind == "string" else F.lit(None).cast(kind)).alias(name)

    return df.select(*[masked(f.name, f.dataType.simpleString()) for f in df.schema.fields])

