"""Row-by-row scoring of texts in Arrow batches, with the other columns carried along."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 1000  # rows scored at once


def with_scores(docs: DataFrame, fields: list[T.StructField], score: Callable[[list], list[pa.Array]], text: str = "text") -> DataFrame:
    """``docs`` with the columns ``fields``, which ``score`` makes from a list of texts (null: None); same-named ones are replaced."""
    made = {f.name.lower() for f in fields}
    names = [c for c in docs.columns if c.lower() not in made]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    at = _place(names, text)
    out = T.StructType([rows.schema["row"], *fields])

    def run(batches):
        for b in _parts(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), *score(b.column(0).field(at).to_pylist())], names=["row", *[f.name for f in fields]])

    scored = rows.mapInArrow(run, out)
    return scored.select(*[F.col(f"row.`{c}`").alias(c) for c in names], *[f.name for f in fields])


def rows_where(docs: DataFrame, keep: Callable[[list], list[bool]], text: str = "text") -> DataFrame:
    """The rows of ``docs`` for whose texts (null: None) ``keep`` says so; the columns stay as they are, whatever their names."""
    rows = docs.select(F.struct("*").alias("row"))
    at = _place(docs.columns, text)

    def run(batches):
        for b in _parts(batches):
            yield b.filter(pa.array(keep(b.column(0).field(at).to_pylist()), pa.bool_()))

    return rows.mapInArrow(run, rows.schema).select("row.*")


def _parts(batches, rows: int = ROWS):
    """The batches in parts of at most ``rows`` rows, the only ones whose texts are held as Python strings."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def _place(names: list[str], text: str) -> int:
    """Where the text lies in a row, so that it is sent to Python once."""
    return [c.lower() for c in names].index(text.lower())


def slices(texts: list, most: int = 1_000_000):
    """Ranges (first, last) of ``texts`` of at most ``most`` characters, or one text: what a task takes apart at once."""
    first = held = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > first and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(texts):
        yield first, len(texts)
