"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import stored as stored


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once and not again for each element of a lambda in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole_text(text: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def same_row(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of all ``keys``, null meeting null."""
    on = None
    for k in keys:
        here = left[k].eqNullSafe(right[k])
        on = here if on is None else on & here
    return on


def third(doc_id: str = "doc_id") -> Column:
    """The remainder that splits documents: crc32 of the id's text by 3; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(third(doc_id) == 1, F.lit(False))


def spread_parts(df: DataFrame, rows: int, per_part: int, least: int = 1) -> int:
    """How many parts of about ``per_part`` rows, and at least ``least``."""
    return max(least, -(-rows // per_part))


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, with the length at the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]])
