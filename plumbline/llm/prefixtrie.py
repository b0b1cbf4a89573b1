"""Conversation prefix trie: every distinct sequence of first turns is a node, from the root without a turn.

A turn is two 64-bit hashes of role and text, with the length of the text. Conversations lie as rows of WIDTH positional
turn columns, a further row for each further WIDTH turns, keyed by the node that the turns before it lead to. One ROLLUP over
the columns counts all prefixes of all rows together; grouping_id says how many turns a group holds. A second ROLLUP over
the nodes sums up subtrees; what lies below the last column of a row is carried to it.

A node is named by its depth and by the sums of hashes of (place, turn) along its path, two decimals that say the same
wherever they are added up, so the key of each row comes from sums over the rows before it and no block waits for another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import stored
from plumbline.operators.ordering import positions
from plumbline.operators.skew import hot_keys, join_spread

WIDTH = 8  # turn columns of a row
STEP = 1024  # rows of a conversation summed up by one task
CHUNK = 4096  # ids written into one text before they are hashed
TURN = "struct<a:bigint,b:bigint,n:bigint>"
ID = ["depth", "ia", "ib"]  # a node
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_of(role: Column, text: Column) -> Column:
    """A turn as two hashes and its code points; null role or text as empty."""
    r, t = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(F.lit(1), r, t).alias("a"), F.xxhash64(F.lit(2), r, t).alias("b"), F.char_length(t).cast("long").alias("n"))


def _placed(place: Column, turn: Column, side: str) -> Column:
    """What a turn at a place adds to the name of a node."""
    return F.xxhash64(F.lit(side), place.cast("long"), turn["a"], turn["b"]).cast("decimal(38,0)")


def sums_before(rows: DataFrame, by: str, at: str, values: list[str], step: int = STEP) -> DataFrame:
    """``rows`` with ``<value>_before``: the sum over the rows of the same ``by`` with a smaller ``at``; no task sums more than ``step`` rows and their totals."""
    part = rows.withColumn("_part", F.floor(F.col(at) / step))
    ahead = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = part.groupBy(by, "_part").agg(*[F.sum(v).alias(v) for v in values])
    starts = totals.select(by, "_part", *[F.coalesce(F.sum(v).over(ahead), F.lit(0)).alias(f"_{v}") for v in values])
    inside = Window.partitionBy(by, "_part").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    local = part.withColumns({f"{v}_before": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    both = local.join(starts, [by, "_part"])
    return both.withColumns({f"{v}_before": (F.col(f"{v}_before") + F.col(f"_{v}")).cast(rows.schema[v].dataType) for v in values}).drop("_part", *[f"_{v}" for v in values])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn): the turns of each conversation, numbered from 1 by turn, null first, then role and hashes of the text."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), F.coalesce("role", F.lit("")).alias("role"), turn_of(F.col("role"), F.col("text")).alias("turn"))
    placed = positions(rows, ["conv_id", "at", "role", "turn"])
    starts = placed.groupBy("conv_id").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n"))
    hot = hot_keys(starts.select("conv_id", "n"), ["conv_id"], "n")
    numbered = join_spread(placed.select("conv_id", "position", "turn"), starts.select("conv_id", "first"), ["conv_id"], hot, ["position"])
    return numbered.select("conv_id", (F.col("position") - F.col("first") + 1).alias("place"), "turn")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations c that begin with the first h turns of conversation c - c % ``group`` and go on with their own turns after the
    first h, for h = crc32(c as text) % ``most``: (conv_id, place, turn, turns) and (conv_id, turns), the number of turns.
    """
    own = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    base = (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    found = own.select("conv_id", "n", base, h).join(own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    plan = stored(found.select("conv_id", "base", "h", "n", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns")))
    hot = hot_keys(plan.select("conv_id", "n"), ["conv_id"], "n")
    kept = join_spread(turns, plan.select("conv_id", "h", "taken", "turns"), ["conv_id"], hot, ["place"]).where("place > h")
    tail = kept.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "turn", "turns")
    lent = turns.where((F.col("conv_id") % group == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "base")  # at most ``most`` turns for 2 * ``group`` conversations
    head = lent.join(plan.select("conv_id", "base", "h", "turns"), "base").where("place <= h").select("conv_id", "place", "turn", "turns")
    return tail.unionByName(head), plan.select("conv_id", "turns")


def _columns(width: int) -> list[str]:
    return [f"t{k}" for k in range(1, width + 1)]


def blocks_of(turns: DataFrame, conversations: DataFrame, width: int) -> DataFrame:
    """(conv_id, block, ka, kb, t1..., more): a row for each ``width`` turns, one at least; ka and kb name the node before it, more says that turns follow."""
    block = F.floor((F.col("place") - 1) / width)
    slot = (F.col("place") - 1) % width + 1
    rows = turns.select("conv_id", block.alias("block"), slot.alias("slot"), "turn", "turns", _placed(F.col("place"), F.col("turn"), "a").alias("ha"), _placed(F.col("place"), F.col("turn"), "b").alias("hb"))
    wide = rows.groupBy("conv_id", "block").agg(
        *[F.max(F.when(F.col("slot") == k, F.col("turn"))).alias(t) for k, t in enumerate(_columns(width), start=1)], F.sum("ha").cast("decimal(38,0)").alias("ka"), F.sum("hb").cast("decimal(38,0)").alias("kb"), F.max("turns").alias("turns"),
    )
    summed = sums_before(wide, "conv_id", "block", ["ka", "kb"]).withColumns({"ka": F.col("ka_before"), "kb": F.col("kb_before")})
    made = summed.select("conv_id", "block", "ka", "kb", *_columns(width), (F.col("turns") > (F.col("block") + 1) * width).alias("more"))
    none, zero = F.lit(None).cast(TURN), F.lit(0).cast("decimal(38,0)")
    bare = conversations.where("turns = 0").select("conv_id", F.lit(0).cast("long").alias("block"), zero.alias("ka"), zero.alias("kb"), *[none.alias(t) for t in _columns(width)], F.lit(False).alias("more"))
    return made.unionByName(bare)


def _rolled_up(rows: DataFrame, width: int, aggregates: str) -> DataFrame:
    """The groups of a ROLLUP over the turn columns that are nodes: with level, the turns they hold, and the node's name."""
    columns = ", ".join(_columns(width))
    groups = rows.sparkSession.sql(f"SELECT block, ka, kb, {columns}, {width} - bit_count(grouping_id()) AS level, {aggregates} FROM {{rows}} GROUP BY block, ka, kb, ROLLUP ({columns})", rows=rows)
    turns = F.array(*_columns(width))
    real = F.when(F.col("level") == 0, F.col("block") == 0).otherwise(F.get(turns, F.col("level") - 1).isNotNull())
    depth = F.col("block") * width + F.col("level")

    def name(key: str, side: str) -> Column:
        added = F.lit(0).cast("decimal(38,0)")
        for k, t in enumerate(_columns(width), start=1):
            added = (added + F.when(F.col("level") >= k, _placed(F.col("block") * width + k, F.col(t), side)).otherwise(F.lit(0).cast("decimal(38,0)"))).cast("decimal(38,0)")
        return (F.col(key) + added).cast("decimal(38,0)")

    return groups.where(real).withColumns({"depth": depth.cast("long"), "ia": name("ka", "a"), "ib": name("kb", "b"), "last": F.get(turns, F.col("level") - 1)})


def _hashed_ends(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(depth, ia, ib, ends_sha256) of (depth, ia, ib, conv_id): the SHA-256 of the ids in ascending order, joined by commas.

    Ids are sorted over ranges, so those of one node may lie in several; each range writes pieces of text of ``chunk`` ids, which are
    hashed one after another. A task holds one piece at a time.
    """
    ranged = ends.repartitionByRange(*ID, "conv_id").sortWithinPartitions(*ID, "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, done = None, [], []

        def close() -> None:
            if held:
                done.append((*node, held[0], ",".join(map(str, held))))

        for b in batches:
            for *at, conv in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if at != node or len(held) == chunk:
                    close()
                    node, held = at, []
                held.append(conv)
            if len(done) > 1000:
                yield _batch(done, ["depth", "ia", "ib", "first", "ids"])
                done = []
        close()
        yield _batch(done, ["depth", "ia", "ib", "first", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, done = None, None, []
        for b in batches:
            for *at, _, ids in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if at != node:
                    if node:
                        done.append((*node, digest.hexdigest()))
                    node, digest = at, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if len(done) > 10_000:
                yield _batch(done, ["depth", "ia", "ib", "ends_sha256"])
                done = []
        if node:
            done.append((*node, digest.hexdigest()))
        yield _batch(done, ["depth", "ia", "ib", "ends_sha256"])

    key = "depth long, ia decimal(38,0), ib decimal(38,0)"
    texts = ranged.mapInArrow(pieces, f"{key}, first long, ids string").repartition(*ID).sortWithinPartitions(*ID, "first")
    return texts.mapInArrow(hashes, f"{key}, ends_sha256 string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"depth": pa.int64(), "ia": pa.decimal128(38, 0), "ib": pa.decimal128(38, 0), "first": pa.int64()}
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, columns, strict=True)], names=names)


def trie(turns: DataFrame, conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """The nodes of the trie of conversations: turns (conv_id, place, turn, turns), conversations (conv_id, turns).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each node:
    conv_id is the smallest of its members, which with depth names it, and parent_conv_id its parent's, null for the root.
    saved_tokens adds up over the subtree what members after the first would repeat, in code points. A conversation without turns
    is a member of the root and ends there. No conversations: no nodes.
    """
    rows = stored(blocks_of(turns, conversations, width))
    going = [f"count({t}) AS c{k}" for k, t in enumerate(_columns(width))]  # members that go on from level k
    counts = _rolled_up(rows, width, f"count(1) AS n_convs, min(conv_id) AS conv_id, {', '.join(going)}, count_if(more) AS c{width}")
    goes_on = F.get(F.array(*[f"c{k}" for k in range(width + 1)]), F.col("level"))
    saved = F.coalesce((F.col("n_convs") - 1) * F.col("last.n"), F.lit(0))
    nodes = stored(counts.select(*ID, "block", "ka", "kb", "level", *_columns(width), "last", "n_convs", "conv_id", (goes_on == 0).cast("long").alias("leaf"), saved.alias("saved")))

    # what lies below a full row is brought to it: each node's value goes with its smallest member, which passed there
    owned = nodes.where("block > 0").groupBy("conv_id", "block").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    wide = rows.where("more or block > 0").join(owned, ["conv_id", "block"], "left").withColumns({"leaf": F.coalesce("leaf", F.lit(0)), "saved": F.coalesce("saved", F.lit(0)), "back": -F.col("block")})
    below = sums_before(wide.select("conv_id", "back", "leaf", "saved"), "conv_id", "back", ["leaf", "saved"]).select("conv_id", (-F.col("back")).alias("block"), F.col("leaf_before").alias("leaf"), F.col("saved_before").alias("saved"))
    carried = rows.where("more").join(below.where("leaf > 0 or saved > 0"), ["conv_id", "block"])
    path = ["block", "ka", "kb", *_columns(width), "leaf", "saved"]
    sums = _rolled_up(nodes.select(*path).unionByName(carried.select(*path)), width, "sum(leaf) AS n_leaves, sum(saved) AS saved_tokens").select(*ID, "n_leaves", "saved_tokens")

    deep = nodes.where("depth > 0")
    up = [(F.col("depth") - 1).alias("depth"), *[(F.col(i) - _placed(F.col("depth"), F.col("last"), s)).cast("decimal(38,0)").alias(i) for i, s in (("ia", "a"), ("ib", "b"))]]
    links = deep.select(*[c.alias(f"p_{n}") for c, n in zip(up, ID, strict=True)], *ID)
    ends = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("depth"), *[F.sum(_placed(F.col("place"), F.col("turn"), s)).cast("decimal(38,0)").alias(i) for i, s in (("ia", "a"), ("ib", "b"))])
    bare = conversations.where("turns = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("decimal(38,0)").alias(i) for i in ("ia", "ib")])
    hashed = _hashed_ends(ends.select(*ID, "conv_id").unionByName(bare.select(*ID, "conv_id")))

    facts = [
        nodes.select(*ID, "conv_id", "n_convs"), sums, hashed,
        links.groupBy(*[F.col(f"p_{n}").alias(n) for n in ID]).agg(F.count(F.lit(1)).alias("n_children")),
    ]
    every = facts[0]
    for more in facts[1:]:
        every = every.unionByName(more, allowMissingColumns=True)
    names = ["conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    full = every.groupBy(*ID).agg(*[F.max(n).alias(n) for n in names])

    fan = hot_keys(links.groupBy("p_depth", "p_ia", "p_ib").agg(F.count(F.lit(1)).alias("n")), ["p_depth", "p_ia", "p_ib"], "n")
    parents = nodes.select(*[F.col(n).alias(f"p_{n}") for n in ID], F.col("conv_id").alias("parent_conv_id"))
    parent = join_spread(links, parents, [f"p_{n}" for n in ID], fan, ID).select(*ID, "parent_conv_id")
    made = full.join(parent, ID, "left")
    return made.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """The trie of the rebuilt conversations (``rebuilt``) of a table (conv_id, turn, role, text); other columns are not read.

    Turns go by turn, null first; ties by role, then by two hashes of role and text, so that repeated rows are turns of their own.
    Null roles and texts count as empty, rows with a null conv_id as no conversation's. An empty table has no nodes.
    """
    turns, plan = rebuilt(stored(ordered_turns(conversations)))
    return trie(stored(turns), plan, width)
