"""Small expression builders shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import constants as K


def lookup(key: Column, table: Mapping[str, object], default: object = None) -> Column:
    """``key`` translated through a small fixed mapping."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


def severity_rank(severity: Column) -> Column:
    return lookup(severity, {s: i + 1 for i, s in enumerate(K.SEVERITIES)}, 0)


def stronger(a: Column, b: Column) -> Column:
    """The stronger of two severities; ``b`` null or unknown leaves ``a``."""
    return F.when(severity_rank(b) > severity_rank(a), b).otherwise(a)


def bands(value: Column, steps: Iterable[tuple[float, str]], below: str, strict: bool = False) -> Column:
    """First label whose bound ``value`` reaches (``strict``: exceeds), else ``below``."""
    out = None
    for bound, label in steps:
        hit = value > bound if strict else value >= bound
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(below))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, digits)).otherwise(F.lit(0.0))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def slots_below(bounds: Column, value: Column, bits: int) -> Column:
    """How many of the ``2**bits - 1`` ascending ``bounds`` lie below ``value`` (binary search)."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(bits))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get(bounds, at + step - 1) < value, at + step).otherwise(at),
    )


def small(df: DataFrame) -> DataFrame:
    """Broadcast hint for a table bounded by the schema or a fixed parameter, never by the rows.

    Used for one-row-per-column tables, their bucket tables and parameter tables only.
    """
    return F.broadcast(df)
