"""Near-duplicate rows of wide tables by the pigeonhole principle.

Two rows that agree on ``least`` of m columns differ on at most m - least. Cut into m - least + 1 blocks of columns, they are
equal on a whole block. So rows meet on the values of each block and are compared there, and a pair counts only on the first
block on which it is equal, which counts it once. Rows that share a block with more than POSTING others are divided further: the
columns outside of that block are cut into as many blocks again, on one of which the pair is equal too. What is still
large is compared in tiles of at most TILE rows by TILE rows, dealt over tasks. Pairs are compared in memory and never written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.skew import hot_keys, join_spread
from plumbline.session import cut_lineage

POSTING = 2000  # rows that share a block before they are divided further
TILE = 1000
CELLS = 4_000_000  # comparisons held at once


def blocks_of(columns: int, blocks: int) -> list[list[int]]:
    """Columns 0 to ``columns`` - 1 cut into ``blocks`` runs of nearly equal length."""
    return [x.tolist() for x in np.array_split(np.arange(columns), blocks)]


def wide_near_duplicates(rows: DataFrame, block: Sequence[str], compare: Sequence[str], least: int, posting: int = POSTING, tile: int = TILE) -> DataFrame:
    """``rows`` (distinct rows of block and compared columns with ``copies``) with ``partners``, those without any left out.

    A partner is another row with the same block columns that agrees on ``least`` compared columns or more, null agreeing with
    null; copies count too. Values are compared by 64-bit hashes.
    """
    m = len(compare)
    cuts = blocks_of(m, m - least + 1)
    value = lambda x: F.xxhash64(F.col(f"`{x}`").isNull(), F.col(f"`{x}`"))
    keyed = cut_lineage(rows.select("*", F.xxhash64(*[value(x) for x in [*block, *compare]]).alias("_id"), F.array(*[value(x) for x in compare]).alias("_h"), F.xxhash64(F.lit(0), *[value(x) for x in block]).alias("_b")))
    of = lambda cols: F.xxhash64(*[F.get("_h", F.lit(i)) for i in cols])

    first = keyed.select("_id", "_h", "copies", F.posexplode(F.array(*[F.xxhash64("_b", F.lit(i), of(cols)) for i, cols in enumerate(cuts)])).alias("_at", "_sig")).withColumn("_at2", F.lit(-1))
    sizes = first.groupBy("_sig").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    hot = hot_keys(sizes, ["_sig"], "_n")
    sized = join_spread(first, sizes, ["_sig"], hot, ["_id"])
    rest = [[i for i in range(m) if i not in cols] for cols in cuts]
    second = [[[others[j] for j in cut] for cut in blocks_of(len(others), m - least + 1)] if len(others) > m - least else [] for others in rest]  # none where a block would be empty
    deeper = F.array(*[F.array(*[F.xxhash64("_sig", F.lit(j), of(cols)) for j, cols in enumerate(cut)]) if cut else F.array().cast("array<bigint>") for cut in second])
    further = (F.col("_n") > posting) & F.col("_at").isin([i for i, cut in enumerate(second) if cut])
    divided = sized.where(further).select("_id", "_h", "copies", "_at", F.posexplode(F.get(deeper, F.col("_at"))).alias("_at2", "_sig")).select("_id", "_h", "copies", "_at", "_sig", "_at2")
    again = divided.groupBy("_sig").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = sized.where(~further).unionByName(join_spread(divided, again, ["_sig"], hot_keys(again, ["_sig"], "_n"), ["_id"]))

    tiles = F.ceil(F.col("_n") / tile).cast("int")
    own = F.pmod(F.xxhash64("_id", F.lit(1)), tiles).cast("int")
    placed = met.withColumn("_own", own).withColumn("_with", F.explode(F.sequence(F.lit(0), tiles - 1)))
    dealt = placed.select("_sig", F.least("_own", "_with").alias("_lo"), F.greatest("_own", "_with").alias("_hi"), (F.col("_own") > F.col("_with")).alias("_upper"), "_at", "_at2", "_id", "copies", "_h")
    group = ["_sig", "_lo", "_hi"]
    ordered = dealt.repartition(*group).sortWithinPartitions(*group)
    firsts = [np.array(c) for c in cuts]
    seconds = [[np.array(c) for c in cut] for cut in second]

    def compared(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(ids, partners) within the rows of one tile pair."""
        ids, copies = part.column("_id").to_numpy(), part.column("copies").to_numpy()
        h = part.column("_h").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
        side = part.column("_upper").to_numpy().astype(bool)
        at, at2 = part.column("_at")[0].as_py(), part.column("_at2")[0].as_py()
        across = part.column("_lo")[0].as_py() != part.column("_hi")[0].as_py()
        earlier = firsts[:at] + (seconds[at][:at2] if at2 >= 0 else [])
        total = np.zeros(len(ids), np.int64)
        step = max(1, CELLS // (len(ids) * m))
        for lo in range(0, len(ids), step):
            equal = h[lo : lo + step, None, :] == h[None, :, :]
            near = equal.sum(axis=2) >= least
            for cols in earlier:
                near &= ~equal[:, :, cols].all(axis=2)
            if across:  # pairs inside a tile are counted where it meets itself
                near &= side[lo : lo + step, None] != side[None, :]
            near[np.arange(len(near)), np.arange(lo, lo + len(near))] = False
            total[lo : lo + step] += near @ copies
        return ids, total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            table = pa.Table.from_batches([b])
            keys = np.stack([table.column(g).to_numpy() for g in group], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            out = []
            for lo, hi in zip(edges, edges[1:], strict=False):
                part = table.slice(lo, hi - lo)
                if held and [held[-1].column(g)[0].as_py() for g in group] != keys[lo].tolist():
                    out.append(compared(pa.concat_tables(held)))
                    held = []
                held.append(part)
            if out:
                yield _counts(out)
        if held:
            yield _counts([compared(pa.concat_tables(held))])

    found = ordered.mapInArrow(run, "_id long, partners long").groupBy("_id").agg(F.sum("partners").alias("partners"))
    self_copies = keyed.join(found, "_id", "left").withColumn("partners", F.coalesce("partners", F.lit(0)) + F.col("copies") - 1)
    return self_copies.where("partners > 0").select(*block, *compare, "copies", "partners")


def _counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    ids, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    some = counts > 0
    return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(counts[some])], names=["_id", "partners"])
