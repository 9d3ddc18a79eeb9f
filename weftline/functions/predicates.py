"""The NULL rules of conditions: the same expression passes or fails differently by where it stands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(expr: Column | str) -> Column:
    return F.expr(expr) if isinstance(expr, str) else expr


def holds(expr: Column | str) -> Column:
    """WHERE, row policies and WITH CHECK: only TRUE passes."""
    return F.coalesce(column(expr), F.lit(False))


def violated(expr: Column | str) -> Column:
    """CHECK constraints: only FALSE violates, NULL passes."""
    return ~F.coalesce(column(expr), F.lit(True))


def same_key(left: str, right: str, keys: list[str]) -> Column:
    """Equality of all keys between two aliased frames; NULL keys match nothing."""
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(f"{left}.{k}") == F.col(f"{right}.{k}"))
    return out


def all_present(keys: list[str]) -> Column:
    """No key is NULL."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out
