"""Constraint validation by scan: violating rows, one-row summaries, and the split in clean and rejected."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import all_present, holds, violated
from ..functions.ranks import in_order, place_in, running_max, unplaced
from ..functions.staging import settled
from .changes import Refused, duplicate_source_keys


def summary(rows: DataFrame, bad: Column, name: str) -> DataFrame:
    """One row ``name, rows, violations, valid`` for a row-local condition."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("violations")).select(F.lit(name).alias("name"), "rows", "violations", (F.col("violations") == 0).alias("valid"))


def quarantine(df: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """``clean, rejected`` by a condition that marks violations."""
    return df.filter(~holds(bad)), df.filter(holds(bad))


def _any_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def check_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a NULL in any of ``columns``, in one scan."""
    return df.filter(_any_null(columns))


def check_constraint(df: DataFrame, expression: Column | str) -> DataFrame:
    """Rows for which a CHECK is FALSE; NULL passes."""
    return df.filter(violated(expression))


def check_unique(df: DataFrame, columns: list[str], where: Column | str | None = None) -> DataFrame:
    """Keys that occur more than once, with ``rows``; NULLs are distinct, ``where`` makes the constraint partial."""
    rows = df if where is None else df.filter(holds(where))
    return rows.filter(all_present(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def check_primary_key(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys that occur more than once or hold a NULL, with ``rows``, in one pass."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).filter((F.col("rows") > 1) | _any_null(columns))


def check_domain(tables: dict[str, DataFrame], column_map: dict[str, list[str]], checks: list[str], not_null: bool = False) -> DataFrame:
    """``table, column, violations``: a domain's checks (over ``value``) on each column of that type."""
    parts = []
    for name, df in tables.items():
        for c in column_map[name]:
            bad = reduce(lambda a, b: a | b, [violated(F.expr(e)) for e in checks], F.lit(False)) | (F.col("value").isNull() if not_null else F.lit(False))
            parts.append(df.select(F.col(c).alias("value")).agg(F.count_if(bad).alias("violations")).select(F.lit(name).alias("table"), F.lit(c).alias("column"), "violations"))
    return reduce(DataFrame.unionByName, parts)


def check_enum(df: DataFrame, name: str, labels: list[str]) -> DataFrame:
    """Rows whose value is none of the labels; NULL passes."""
    return df.filter(F.col(name).isNotNull() & ~F.col(name).isin(labels))


def add_enum_value(labels: list[str], value: str, before: str | None = None, after: str | None = None) -> list[str]:
    """The label list with ``value`` before or after another, or at its end; one that is there stays."""
    if value in labels:
        return labels
    at = labels.index(before) if before else labels.index(after) + 1 if after else len(labels)
    return [*labels[:at], value, *labels[at:]]


def enum_order(df: DataFrame, name: str, labels: list[str]) -> DataFrame:
    """``df`` with ``label_order``: the place of the value in the label list."""
    return df.withColumn("label_order", F.when(F.array_position(F.array(*map(F.lit, labels)), F.col(name)) > 0, F.array_position(F.array(*map(F.lit, labels)), F.col(name))))


def check_foreign_key(child: DataFrame, columns: list[str], parent: DataFrame, refs: list[str]) -> DataFrame:
    """Orphans by MATCH SIMPLE: a NULL in any part passes. The lists must be of one length, and ``refs`` a unique key of the parent (NULLs apart), else the constraint is refused."""
    if len(columns) != len(refs):
        raise Refused("a key and its reference differ in length")
    if not duplicate_source_keys(parent.dropna(subset=refs), refs).isEmpty():
        raise Refused("the reference is no unique key")
    keys = parent.select(*[F.col(r).alias(f"__{i}") for i, r in enumerate(refs)])
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{i}") for i, c in enumerate(columns)])
    return child.filter(all_present(columns)).join(keys, on, "left_anti")


def merged_ranges(df: DataFrame, key: list[str], lo: str, hi: str) -> DataFrame:
    """``key, lo, hi``: the union of half-open ranges per key, as ranges apart. Empty and NULL ranges are left out.

    A range begins an island where it begins past all before it; it is in the island
    that began last. Both are running maxima, so a key may be of any size.
    """
    rows = df.select(*key, F.col(lo).alias("lo"), F.col(hi).alias("hi")).filter(F.col("lo") < F.col("hi"))
    far = running_max(in_order(rows, [*key, "lo", "hi"]), key, F.col("hi"), "__far")
    begins = F.when(F.coalesce(F.col("lo") > F.col("__far"), F.lit(True)), F.col("lo"))
    return running_max(far, key, begins, "__island", inclusive=True).groupBy(*key, "__island").agg(F.max("hi").alias("hi")).withColumnRenamed("__island", "lo").select(*key, "lo", "hi")


def check_foreign_key_period(child: DataFrame, parent: DataFrame, key: list[str], lo: str, hi: str) -> DataFrame:
    """Child rows whose range the union of the parent's ranges of the same key does not cover. Empty and NULL ranges, and NULL keys, pass.

    Islands and children are put in one order; each child meets the last island that
    begins at or before it, which is the only one that can cover it.
    """
    real = child.filter(all_present(key) & (F.col(lo) < F.col(hi)))
    own = F.struct(*real.columns)
    kind = real.select(own.alias("r")).schema["r"].dataType
    cover = merged_ranges(parent, key, lo, hi).select(*key, F.col("lo").alias("__lo"), F.lit(0).alias("__child"), F.col("hi").alias("__hi"), F.lit(None).cast(kind).alias("__row"))
    asked = real.select(*key, F.col(lo).alias("__lo"), F.lit(1).alias("__child"), F.lit(None).cast(cover.schema["__hi"].dataType).alias("__hi"), own.alias("__row"))
    placed = in_order(cover.unionByName(asked), [*key, "__lo", "__child"])
    # islands of a key are apart, so the last one also ends last
    met = running_max(placed, key, F.col("__hi"), "__end").filter("__child = 1")
    return met.filter(F.col("__end").isNull() | (F.col(f"__row.{hi}") > F.col("__end"))).select("__row.*")


def check_without_overlaps(df: DataFrame, key: list[str], lo: str, hi: str) -> DataFrame:
    """Rows whose range begins inside an earlier row's range of the same key: a running maximum over all partitions, not a join."""
    real = df.filter(all_present(key) & (F.col(lo) < F.col(hi)))
    return unplaced(running_max(in_order(real, [*key, lo, hi]), key, F.col(hi), "__far").filter(F.col(lo) < F.col("__far")).drop("__far"))


#: Rows of a bin of ranges, and the most bins.
BIN_ROWS, MOST_BINS = 500, 10_000
#: Bins that a range meets on average, at most.
MOST_COPIES = 2


def _binned(rows: DataFrame, lo: str, hi: str) -> DataFrame:
    """``rows`` once for each bin (``__bin``) that their range meets, with their first bin ``__first``.

    Cuts are quantiles of where ranges begin, so dense stretches have narrow bins. Where ranges are longer than
    bins, neighbouring bins are put together until a range meets two at most, on average: copies grow as the rows, and
    most rows that share a bin then overlap. Empty and NULL ranges are left out.
    """
    real = rows.filter(F.col(lo) < F.col(hi))
    bins = max(1, min(MOST_BINS, real.count() // BIN_ROWS))
    plain = lambda c: c if real.schema[lo].dataType.simpleString() not in ("timestamp", "timestamp_ntz", "date") else F.unix_micros(c.cast("timestamp"))
    cuts = sorted(set(real.select(F.percentile_approx(plain(F.col(lo)), [k / bins for k in range(1, bins)], 10_000)).first()[0] or ())) if bins > 1 else []
    if not cuts:
        return real.withColumns({"__first": F.lit(0), "__bin": F.lit(0)})
    marks = rows.sparkSession.createDataFrame([(cuts,)], f"__cuts array<{real.select(plain(F.col(lo)).alias('v')).schema['v'].dataType.simpleString()}>")
    first = place_in(F.col("__cuts"), len(cuts), lambda c: c <= plain(F.col(lo)))
    last = place_in(F.col("__cuts"), len(cuts), lambda c: c < plain(F.col(hi)))
    met = real.join(F.broadcast(marks)).withColumns({"__first": first, "__last": last}).drop("__cuts")
    # every 2nd, 4th, ... cut: a bin's number is divided
    widths = [1 << k for k in range(len(cuts).bit_length() + 1)]
    copies = met.agg(F.count(F.lit(1)), *[F.sum(F.floor(F.col("__last") / w) - F.floor(F.col("__first") / w) + 1) for w in widths]).first()
    width = next((w for w, n in zip(widths, copies[1:], strict=True) if n is None or n <= MOST_COPIES * copies[0]), widths[-1])
    met = met.withColumns({c: F.floor(F.col(c) / width) for c in ("__first", "__last")})
    return met.withColumn("__bin", F.explode(F.sequence("__first", "__last"))).drop("__last")


def check_exclusion(df: DataFrame, identity: str, elements: list[tuple[str, str]], where: Column | str | None = None) -> DataFrame:
    """``id_a, id_b``: pairs for which every element's operator holds.

    An element is (column, ``=``/``<>``) or (``lo,hi``, ``&&``). Equal elements and the bins of
    the first range are the join key, the others its residual: a range is in all bins that
    it meets, and a pair is reported in the first that both meet, so neither a table without
    equal elements nor a hot key is compared pair by pair. A NULL makes no conflict. The constraint
    forbids the pairs, so a table near validity has few. With ``<>`` alone nearly all pairs are the result.
    """
    rows = df if where is None else df.filter(holds(where))
    used = {c for e, _ in elements for c in e.split(",")}
    ranges = [e for e, op in elements if op == "&&"]
    rows = rows.select(identity, *[c for c in used if c != identity])
    if ranges:
        rows = _binned(rows, *ranges[0].split(","))
    a, b = (rows.select(F.col(identity).alias(f"id_{s}"), *[F.col(c).alias(f"{s}_{c}") for c in (*used, *(("__first", "__bin") if ranges else ()))]) for s in "ab")
    on = F.col("id_a") < F.col("id_b")
    if ranges:
        on &= (F.col("a___bin") == F.col("b___bin")) & (F.col("a___bin") == F.greatest("a___first", "b___first"))
    for expression, op in elements:
        if op == "&&":
            lo, hi = expression.split(",")
            on &= (F.col(f"a_{lo}") < F.col(f"b_{hi}")) & (F.col(f"b_{lo}") < F.col(f"a_{hi}")) & (F.col(f"a_{lo}") < F.col(f"a_{hi}")) & (F.col(f"b_{lo}") < F.col(f"b_{hi}"))
        else:
            left, right = F.col(f"a_{expression}"), F.col(f"b_{expression}")
            on &= left == right if op == "=" else left != right
    return a.join(b, on).select("id_a", "id_b")


@dataclass(frozen=True)
class Reference:
    """A foreign key: ``columns`` of ``child`` refer to ``refs`` of ``parent``; ``default`` has a value for each column (for ``set default``)."""

    child: str
    columns: tuple[str, ...]
    parent: str
    refs: tuple[str, ...]
    on_delete: str = "no action"
    default: tuple = ()


ACTIONS = ("no action", "restrict", "cascade", "set null", "set default")


def _referring(reference: Reference, child: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``child`` that refer to rows of ``gone``, by MATCH SIMPLE."""
    keys = gone.select(*[F.col(r).alias(f"__{i}") for i, r in enumerate(reference.refs)]).distinct()
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{i}") for i, c in enumerate(reference.columns)])
    return child.join(keys, on, "left_semi")


def delete_with_references(tables: dict[str, tuple[DataFrame, list[str]]], references: list[Reference], table: str, keys: DataFrame, most_rounds: int = 10_000) -> dict[str, DataFrame]:
    """All ``tables`` after the rows of ``table`` with ``keys`` are deleted and every reference has acted.

    ``tables`` has a frame and its primary key by name. ``cascade`` deletes the rows that
    refer, and what refers to them, through all levels and tables, a table that refers to
    itself included, until nothing is new. Then ``set null`` and ``set default`` change the
    rows that stay. Checks come last: ``restrict`` refuses if any row referred to a deleted
    one, even one that went itself, ``no action`` if one that stays does, ``set default`` if the default
    is not in the parent. NULLs refer to nothing. A column that an action sets must not
    be referred to itself.

    A round joins the keys that are new with the references alone and stages them; rounds are as many as
    the longest chain of cascades.
    """
    names = {r.on_delete for r in references} - set(ACTIONS)
    if names:
        raise Refused(f"no action {names}")
    if bad := [r for r in references for q in references if r.on_delete.startswith("set") and q.parent == r.child and set(q.refs) & set(r.columns)]:
        raise Refused(f"a column that is referred to would be set: {bad[0].columns}")
    used = {n: {*pk, *(c for r in references if r.child == n for c in r.columns), *(c for r in references if r.parent == n for c in r.refs)} for n, (_, pk) in tables.items()}
    narrow = {n: settled(df.select(*sorted(used[n])), "references") for n, (df, _) in tables.items()}
    pk = {n: key for n, (_, key) in tables.items()}
    cascades = [r for r in references if r.on_delete == "cascade"]
    front = {table: settled(narrow[table].join(keys.select(*pk[table]).distinct(), pk[table], "left_semi"), "deleted")}
    gone = dict(front)
    for _ in range(most_rounds):
        met: dict[str, DataFrame] = {}
        for r in cascades:
            if r.parent in front:
                hit = _referring(r, narrow[r.child], front[r.parent])
                met[r.child] = hit if r.child not in met else met[r.child].unionByName(hit)
        front = {}
        for n, hit in met.items():
            new = hit.distinct() if n not in gone else hit.distinct().join(gone[n].select(*pk[n]), pk[n], "left_anti")
            new = settled(new.select(*narrow[n].columns), "deleted")
            if not new.isEmpty():
                front[n] = new
                gone[n] = new if n not in gone else gone[n].unionByName(new)
        if not front:
            break
    else:
        raise Refused("too many rounds")
    kept = lambda n, df: df if n not in gone else df.join(gone[n].select(*pk[n]), pk[n], "left_anti").select(*df.columns)
    out = {n: kept(n, df) for n, (df, _) in tables.items()}
    for r in references:
        if r.parent not in gone or r.on_delete == "cascade":
            continue
        rows = narrow[r.child] if r.on_delete == "restrict" else kept(r.child, narrow[r.child])
        if r.on_delete in ("restrict", "no action"):
            if not _referring(r, rows, gone[r.parent]).isEmpty():
                raise Refused(f"{r.child} refers to a deleted row of {r.parent}")
            continue
        # which rows change is found in the references as they were, so two actions on one row do not meet
        hit = _referring(r, rows, gone[r.parent]).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(pk[r.child])], F.lit(True).alias("__hit")).distinct()
        on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(pk[r.child])])
        values = dict(zip(r.columns, r.default if r.on_delete == "set default" else (None,) * len(r.columns), strict=True))
        if r.on_delete == "set default" and None not in values.values() and not hit.isEmpty():
            there = reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in zip(r.refs, values.values(), strict=True)])
            if kept(r.parent, narrow[r.parent]).filter(there).isEmpty():
                raise Refused(f"the default is not in {r.parent}")
        old = out[r.child]
        changed = old.join(hit, on, "left")
        out[r.child] = changed.select(*[(F.when(F.col("__hit"), F.lit(values[c]).cast(old.schema[c].dataType)).otherwise(F.col(c)) if c in values else F.col(c)).alias(c) for c in old.columns])
    return out


def check_policy_write(df: DataFrame, check: Column | str) -> DataFrame:
    """Rows that WITH CHECK refuses: all for which it is not TRUE."""
    return df.filter(~holds(check))


def validation_report(df: DataFrame, constraints: dict[str, str]) -> DataFrame:
    """``name, rows, violations, valid`` of all row-local checks in one scan; ``NOT NULL c`` is a check as well."""
    bad = {n: F.col(e[9:]).isNull() if e.upper().startswith("NOT NULL ") else violated(e) for n, e in constraints.items()}
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(b).alias(f"v_{i}") for i, b in enumerate(bad.values())])
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"v_{i}").alias("violations")) for i, n in enumerate(bad)])
    return row.select("rows", F.explode(each).alias("r")).select("r.name", "rows", "r.violations", (F.col("r.violations") == 0).alias("valid"))


def failed_names(constraints: dict[str, str]) -> Column:
    """The names of the checks that a row violates, as an array."""
    return F.array_compact(F.array(*[F.when(violated(e), F.lit(n)) for n, e in constraints.items()]))


def constraint_impact(constraints: DataFrame, foreign_keys: DataFrame, views: DataFrame) -> DataFrame:
    """``object, blocked_by, kind``: keys that foreign keys lean on, and tables that are referenced or read.

    ``constraints``: ``table, name``; ``foreign_keys``: ``name, table, ref_table, ref_constraint``; ``views``: ``view, relation``.
    """
    keys = constraints.join(foreign_keys.select(F.col("name").alias("blocked_by"), F.col("ref_constraint").alias("name")), "name").select(F.col("name").alias("object"), "blocked_by", F.lit("key").alias("kind"))
    tables = foreign_keys.filter(F.col("table") != F.col("ref_table")).select(F.col("ref_table").alias("object"), F.col("name").alias("blocked_by"), F.lit("table").alias("kind"))
    read = views.select(F.col("relation").alias("object"), F.col("view").alias("blocked_by"), F.lit("view").alias("kind"))
    return keys.unionByName(tables).unionByName(read)
