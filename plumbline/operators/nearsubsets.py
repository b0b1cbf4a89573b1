"""Near-duplicate rows of tables with few columns, counted by subsets of columns and never paired.

Rows that agree on ``least`` of m columns or more agree on some subsets of that many. With N the rows that agree with a row on a
subset, its partners are the sum of (N - 1) over all subsets with the signs and weights of inclusion-exclusion. All of a
row's subsets are counted where the rows lie together, so that no row travels once for each of them:

* Rows of a block (equal block columns) with at most GROUP rows are sorted together, once.
* Rows of larger blocks meet on cuts: the columns in m - least + 1 runs, one of which every subset of ``least`` columns holds
  whole. A row travels once for each cut, and a subset is counted at the first cut that it holds.
* Rows that share a cut with more than GROUP others travel once for each subset of that cut, keyed by two hashes of 64 bits.

Within a task values are compared themselves, texts over LONG bytes by their SHA-256.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import predicates as P
from plumbline.functions.expressions import small
from plumbline.operators.nearrows import blocks_of
from plumbline.operators.skew import hot_keys, join_spread
from plumbline.session import stored

GROUP = 1 << 18  # rows that one task counts together
LONG = 64  # bytes of a text that travels as it is
NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def _hash(column: str) -> Column:
    value = F.col(P.quoted(column))
    return F.xxhash64(value.isNull(), value)


def _folded(df: DataFrame, name: str) -> Column:
    """The column with -0.0 as 0.0, as grouping has it."""
    value = F.col(P.quoted(name))
    return (value + 0.0).cast(df.schema[name].dataType) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else value


def _short(df: DataFrame, name: str) -> Column:
    """A value that is equal exactly where the column is, and short."""
    value, dtype = F.col(P.quoted(name)), df.schema[name].dataType
    if isinstance(dtype, NESTED):
        return F.sha2(F.to_json(F.struct(value.alias("v"))), 256)
    if P.is_text(dtype):
        return F.when(F.octet_length(value) > LONG, F.concat(F.lit("sha256:"), F.sha2(value, 256))).otherwise(value)
    return value


def _codes(column: pa.ChunkedArray | np.ndarray) -> tuple[np.ndarray, int]:
    """Values as numbers from 0, equal where the values are (null too), and how many there are."""
    array = pa.array(column) if isinstance(column, np.ndarray) else column.combine_chunks()
    coded = array.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))


def _joined(first: tuple[np.ndarray, int], *others: tuple[np.ndarray, int]) -> tuple[np.ndarray, int]:
    """Codes of tuples of codes."""
    key, n = first
    for code, k in others:
        if n * k >= 1 << 62:
            key, n = _codes(key)
        key, n = key * k + code, n * k
    return key, n


def _partners(group: tuple[np.ndarray, int], columns: list[tuple[np.ndarray, int]], copies: np.ndarray, subsets: Sequence[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Sum of weight * (N - 1) over ``subsets`` for each row, N counted among the rows of its group."""
    total = np.zeros(len(copies), np.int64)
    for subset, weight in subsets:
        code, n = _codes(_joined(group, *[columns[i] for i in subset])[0])
        total += weight * (np.bincount(code, weights=copies, minlength=n).astype(np.int64)[code] - 1)
    return total


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups of rows that come sorted by ``key``, of at least GROUP rows but for the last."""
    held: list[pa.Table] = []
    rows = 0
    for b in batches:
        table = pa.Table.from_batches([b])
        rows += table.num_rows
        if rows >= GROUP and table.num_rows:
            keys = table.column(key).to_numpy()
            edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            at = int(edges[-1]) if len(edges) else 0 if not held or held[-1].column(key)[-1].as_py() != keys[0] else None
            if at is not None:
                whole = pa.concat_tables([*held, table.slice(0, at)])
                if whole.num_rows:
                    yield whole
                held, table = [], table.slice(at)
                rows = table.num_rows
        if table.num_rows:
            held.append(table)
    if held:
        yield pa.concat_tables(held)


def subsets_of(m: int, least: int) -> list[tuple[tuple[int, ...], int]]:
    """All subsets of ``least`` to m columns with their weights, (-1)^(k - least) * C(k - 1, least - 1) for k columns."""
    return [(s, (-1) ** (k - least) * math.comb(k - 1, least - 1)) for k in range(least, m + 1) for s in itertools.combinations(range(m), k)]


def near_duplicates_by_subsets(df: DataFrame, block: Sequence[str], compare: Sequence[str], least: int, group: int = GROUP) -> DataFrame:
    """Distinct rows (block and compared columns) of ``df`` with ``copies`` and ``partners``, as ``rules.near_duplicates`` defines them."""
    columns = [*block, *compare]
    rows = df.select(*[_folded(df, x).alias(x) for x in columns])
    if not block:
        return _by_cuts(rows, block, compare, least, group)
    keyed = rows.withColumn("_b", F.xxhash64(*[_hash(x) for x in block]))
    large = stored(keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > group).select("_b"))  # at most one for each ``group`` rows
    by_block = _in_blocks(keyed.join(small(large), "_b", "left_anti"), block, compare, least)
    if large.isEmpty():
        return by_block
    return by_block.unionByName(_by_cuts(keyed.join(small(large), "_b", "left_semi").drop("_b"), block, compare, least, group))


def _in_blocks(keyed: DataFrame, block: Sequence[str], compare: Sequence[str], least: int) -> DataFrame:
    """Where all rows of a block lie in one task: they are folded and counted there."""
    columns = [*block, *compare]
    wide = {x: f"_v{i}" for i, x in enumerate(columns) if isinstance(keyed.schema[x].dataType, NESTED)}
    subsets = subsets_of(len(compare), least)
    out = keyed.select(*[P.quoted(x) for x in columns]).schema.add("copies", "long").add("partners", "long")
    sent = keyed.select("_b", *[P.quoted(x) for x in columns], *[_short(keyed, x).alias(v) for x, v in wide.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "_b"):
            code = {x: _codes(table.column(wide.get(x, x))) for x in columns}
            same, n = _codes(_joined(*[code[x] for x in columns])[0])
            first = np.full(n, len(same), np.int64)
            np.minimum.at(first, same, np.arange(len(same)))
            copies = np.bincount(same, minlength=n)
            part = {x: (c[first], k) for x, (c, k) in code.items()}
            inside = _codes(_joined(*[part[x] for x in block])[0])
            partners = _partners(inside, [part[x] for x in compare], copies, subsets)
            some = partners > 0
            kept = table.select(columns).combine_chunks().take(pa.array(first[some]))
            kept = kept.append_column("copies", pa.array(copies[some].astype(np.int64))).append_column("partners", pa.array(partners[some]))
            yield from kept.combine_chunks().to_batches()

    return sent.repartition("_b").sortWithinPartitions("_b").mapInArrow(run, out)


def _by_cuts(df: DataFrame, block: Sequence[str], compare: Sequence[str], least: int, group: int) -> DataFrame:
    """Where rows meet on cuts, or on single subsets where a cut is shared by too many."""
    columns, m = [*block, *compare], len(compare)
    rows = stored(df.groupBy(*[P.quoted(x) for x in columns]).agg(F.count(F.lit(1)).alias("copies")).withColumn("_id", F.monotonically_increasing_id()))
    cuts = blocks_of(m, m - least + 1)
    counted: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in cuts]
    for s in subsets_of(m, least):
        counted[next(i for i, cut in enumerate(cuts) if set(cut) <= set(s[0]))].append(s)
    hashes = [_hash(x) for x in block]
    of = lambda at, cols: F.xxhash64(F.lit(at), *hashes, *[_hash(compare[i]) for i in cols])
    values = [f"_v{i}" for i in range(len(columns))]
    keyed = rows.select("_id", "copies", *[_short(rows, x).alias(v) for x, v in zip(columns, values, strict=True)], F.posexplode(F.array(*[of(i, cut) for i, cut in enumerate(cuts)])).alias("_at", "_sig"))
    sizes = rows.select(F.posexplode(F.array(*[of(i, cut) for i, cut in enumerate(cuts)])).alias("_at", "_sig")).groupBy("_at", "_sig").agg(F.count(F.lit(1)).alias("_n"))
    met = stored(sizes.where("_n > 1"))
    large = small(met.where(F.col("_n") > group).select("_at", "_sig"))  # at most one for each ``group`` rows and cut
    ordered = keyed.join(large, ["_at", "_sig"], "left_anti").repartition("_sig").sortWithinPartitions("_sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "_sig"):
            at_of, ids = table.column("_at").to_numpy(), table.column("_id").to_numpy()
            copies, code = table.column("copies").to_numpy(), [_codes(table.column(v)) for v in values]
            for at in np.unique(at_of):
                here = np.flatnonzero(at_of == at)
                part = [(c[here], k) for c, k in code]
                # all subsets of a cut hold it whole, so groups need only the block
                inside = _codes(_joined((np.zeros(len(here), np.int64), 1), *part[: len(block)])[0])
                found = _partners(inside, part[len(block) :], copies[here], counted[at])
                some = found != 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[here][some]), pa.array(found[some])], names=["_id", "partners"])

    found = ordered.mapInArrow(run, "_id long, partners long")
    if not met.where(F.col("_n") > group).isEmpty():
        per_cut = F.array(*[F.array(*[F.struct(*[F.xxhash64(F.lit(salt), F.lit(at), F.lit(j), *hashes, *[_hash(compare[i]) for i in s]).alias(f"_s{salt}") for salt in (0, 1)], F.lit(w).cast("long").alias("weight")) for j, (s, w) in enumerate(subsets)]) for at, subsets in enumerate(counted)])
        spread = rows.select("_id", "copies", F.explode(F.arrays_zip(F.array(*[of(i, cut) for i, cut in enumerate(cuts)]).alias("sig"), per_cut.alias("subsets"), F.sequence(F.lit(0), F.lit(len(cuts) - 1)).alias("at"))).alias("c"))
        signed = spread.select("_id", "copies", F.col("c.at").alias("_at"), F.col("c.sig").alias("_sig"), F.col("c.subsets").alias("_subsets")).join(large, ["_at", "_sig"], "left_semi")
        signed = signed.select("_id", "copies", F.explode("_subsets").alias("s")).select("_id", "copies", "s.*")
        on = ["_s0", "_s1"]
        groups = signed.groupBy(*on).agg(F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("fan"))
        joined = join_spread(signed, groups.where("rows > 1").select(*on, "rows"), on, hot_keys(groups.select(*on, "fan"), on, "fan"), ["_id"])
        found = found.unionByName(joined.select("_id", (F.col("weight") * (F.col("rows") - 1)).alias("partners")))
    totals = found.groupBy("_id").agg(F.sum("partners").alias("partners")).where("partners > 0")
    return rows.join(totals, "_id").select(*[P.quoted(x) for x in columns], "copies", "partners")
