"""Periodic run detection: every maximal repetition of words in a text, and the text without the repeats.

A run is a stretch of words with smallest period q that no neighbouring word extends, LEAST words or more and two periods
at least. Candidates are Lyndon roots: under an order of words or its inverse, every run holds a longest Lyndon word
of its length, which ends where the next smaller suffix starts. A root is extended to both sides by longest common
extensions, read off Ukkonen's suffix trees of the words and of their reversal: the string depth of the lowest common
ancestor of two leaves is the least depth between them on the Euler tour, found in constant time.

Each text is taken by itself, in the task where it lies; nothing is shuffled. A run of these lengths holds two equal
stretches of LEAST / 2 words for each of its words, so trees are only grown over the parts of a text in which such
stretches repeat: a part is a superset of the runs in it, and a text of unlike words has none.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.rowwise import with_scores

LEAST = 12  # words of a run
ROUNDS = 4  # times a part of a text is narrowed before trees are grown over what is left
END = -1  # ends a text; smaller than all words in both orders

RUN = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])


class Minima:
    """Least value of any range of an array in constant time and linear space.

    A sparse table over the minima of blocks of WIDTH values, and running minima from both ends of each block.
    """

    WIDTH = 16

    def __init__(self, values: np.ndarray):
        w = self.WIDTH
        padded = np.full(-(-max(len(values), 1) // w) * w, np.iinfo(values.dtype).max, values.dtype)
        padded[: len(values)] = values
        blocks = padded.reshape(-1, w)
        self.values = padded
        self.before = np.minimum.accumulate(blocks, axis=1).ravel()
        self.after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [blocks.min(axis=1)]
        while (step := 1 << (len(self.table) - 1)) * 2 <= len(blocks):
            last = self.table[-1]
            self.table.append(np.minimum(last[: len(last) - step], last[step:]))

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least values of the ranges [lo, hi], both ends included, lo <= hi."""
        out = np.minimum(self.after[lo], self.before[hi])
        first, last = lo // self.WIDTH, hi // self.WIDTH
        near = np.flatnonzero(first == last)
        if len(near):
            a, b = lo[near], hi[near]
            least = self.values[a]
            for k in range(1, self.WIDTH):
                least = np.minimum(least, self.values[np.minimum(a + k, b)])
            out[near] = least
        inner = last - first - 1
        level = np.zeros(len(lo), np.int64)
        some = inner > 0
        level[some] = np.floor(np.log2(inner[some])).astype(np.int64)
        for k in np.unique(level[some]):
            at = np.flatnonzero(some & (level == k))
            row = self.table[k]
            out[at] = np.minimum(out[at], np.minimum(row[first[at] + 1], row[last[at] - (1 << k)]))
        return out


class SuffixTree:
    """Ukkonen's suffix tree of a list of symbols that ends in END, which occurs nowhere else."""

    def __init__(self, symbols: list[int]):
        n = self.n = len(symbols)
        start, end, link, kids = [0], [0], [0], [{}]
        self.start, self.end, self.kids = start, end, kids

        def node(first: int, last: int, inner: bool) -> int:
            start.append(first)
            end.append(last)
            link.append(0)
            kids.append({} if inner else None)
            return len(start) - 1

        at = edge = length = open_ends = 0
        for i, symbol in enumerate(symbols):
            unlinked = 0
            open_ends += 1
            while open_ends:
                if not length:
                    edge = i
                head = symbols[edge]
                below = kids[at].get(head)
                if below is None:
                    kids[at][head] = node(i, n, False)
                    if unlinked:
                        link[unlinked] = at
                    unlinked = at
                else:
                    span = end[below] - start[below]
                    if length >= span:
                        edge += span
                        length -= span
                        at = below
                        continue
                    if symbols[start[below] + length] == symbol:
                        length += 1
                        if unlinked:
                            link[unlinked] = at
                        break
                    fork = node(start[below], start[below] + length, True)
                    kids[at][head] = fork
                    kids[fork][symbol] = node(i, n, False)
                    start[below] += length
                    kids[fork][symbols[start[below]]] = below
                    if unlinked:
                        link[unlinked] = fork
                    unlinked = fork
                open_ends -= 1
                if at:
                    at = link[at]
                elif length:
                    length -= 1
                    edge = i - open_ends + 1

    def tour(self) -> list[int]:
        """Grows the Euler tour of string depths; returns the suffixes in ascending order."""
        start, end, kids, n = self.start, self.end, self.kids, self.n
        depth = [0] * len(start)
        euler, place, order, stack = [], [0] * n, [], [0]
        while stack:
            v = stack.pop()
            if v < 0:  # back from a child
                euler.append(depth[~v])
                continue
            own = depth[v]
            below = kids[v]
            if below is None:
                place[n - own] = len(euler)
                order.append(n - own)
            else:
                for symbol in sorted(below, reverse=True):
                    child = below[symbol]
                    depth[child] = own + end[child] - start[child]
                    stack += (~v, child)
            euler.append(own)
        self.place, self.depths = np.array(place), Minima(np.array(euler, np.int64))
        return order

    def inverse(self) -> list[int]:
        """The suffixes in ascending order of the inverse order of symbols, END still smallest."""
        start, end, kids, n = self.start, self.end, self.kids, self.n
        order, stack = [], [(0, 0)]
        while stack:
            v, own = stack.pop()
            below = kids[v]
            if below is None:
                order.append(n - own)
                continue
            stack += [(child, own + end[child] - start[child]) for symbol, child in sorted(below.items()) if symbol != END]
            if END in below:
                child = below[END]
                stack.append((child, own + end[child] - start[child]))
        return order

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at i and j, i <> j, have in common from their starts on; needs ``tour``."""
        a, b = self.place[i], self.place[j]
        return self.depths.between(np.minimum(a, b), np.maximum(a, b))


def lyndon_ends(order: list[int]) -> np.ndarray:
    """Where the longest Lyndon word that starts at each place ends: at the next smaller suffix."""
    n = len(order) - 1  # without END
    rank = [0] * (n + 1)
    for r, i in enumerate(order):
        rank[i] = r
    ends, waiting = [n] * n, []
    for i in range(n):
        own = rank[i]
        while waiting and rank[waiting[-1]] > own:
            ends[waiting.pop()] = i
        waiting.append(i)
    return np.array(ends, np.int64)


def tree_runs(symbols: list[int], least: int = LEAST) -> np.ndarray:
    """(start, length, period) of all runs of a list of symbols from 0 on, by start and period."""
    n = len(symbols)
    ahead, back = SuffixTree([*symbols, END]), SuffixTree([*symbols[::-1], END])
    orders = [ahead.tour(), ahead.inverse()]
    back.tour()
    found = []
    for order in orders:
        i, j = np.arange(n), lyndon_ends(order)
        right, left = ahead.extension(i, j), back.extension(n - i, n - j)
        length, period = j - i + left + right, j - i
        run = length >= np.maximum(least, 2 * period)
        found.append(np.stack([i - left, length, period], axis=1)[run])
    return np.unique(np.concatenate(found), axis=0)


def _covered(hits: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of ``width`` whose start is hit."""
    change = np.zeros(n + 1, np.int64)
    change[:-width][: len(hits)] += hits
    change[width : width + len(hits)] -= hits
    return change[:n].cumsum() > 0


def repeating_parts(ids: np.ndarray, least: int = LEAST, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Parts [start, end) of a text outside of which no run lies: windows of least / 2 words repeat throughout each.

    Windows are compared by a 64-bit hash; two unlike ones that meet only make a part larger.
    """
    width = least // 2
    factors = np.random.default_rng(width).integers(1, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    todo, out = [(0, len(ids), 0)], []
    while todo:
        lo, hi, done = todo.pop()
        if hi - lo < least:
            continue
        part = (ids[lo:hi].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        part ^= part >> np.uint64(29)
        m = hi - lo - width + 1
        windows = np.zeros(m, np.uint64)
        for k in range(width):
            windows += part[k : k + m] * factors[k]
        order = np.argsort(windows, kind="stable")
        equal = windows[order[1:]] == windows[order[:-1]]
        if not equal.any():
            continue
        hits = np.zeros(m, np.int64)
        hits[order[1:][equal]] = 1
        hits[order[:-1][equal]] = 1
        inside = np.concatenate([[False], _covered(hits, width, hi - lo), [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        parts = list(zip((edges[::2] + lo).tolist(), (edges[1::2] + lo).tolist(), strict=True))
        if parts == [(lo, hi)] or done + 1 >= rounds:
            out += parts
        else:
            todo += [(a, b, done + 1) for a, b in parts]
    return sorted(out)


def runs(ids: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of all runs of a text of numbered words, by start and period."""
    found = [tree_runs(ids[lo:hi].tolist(), least) + np.array([lo, 0, 0]) for lo, hi in repeating_parts(ids, least) if hi - lo >= least]
    made = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return made[np.lexsort((made[:, 2], made[:, 0]))]


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words lie in no run after that run's first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return change[:n].cumsum() == 0


def find_runs(docs: DataFrame, least: int = LEAST, text: str = "text") -> DataFrame:
    """``docs`` with runs (array<struct<start, length, period>>, by start and period) and collapsed (the text without repeats).

    Words are parted by ASCII white space and numbered from 0. collapsed joins by one blank the words that no run
    holds after its first period. A null or empty text has no runs and an empty collapsed text. Each row stands for itself, so
    repeated rows each come back; columns named runs or collapsed are replaced. An empty table gives an empty table.
    A task holds the trees of one text at a time.
    """

    def score(texts: list) -> list[pa.Array]:
        spans, sizes, collapsed = [], [0], []
        for t in texts:
            words = (t or "").encode("utf-8", "surrogatepass").split()
            number = defaultdict(count().__next__)
            found = runs(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), least)
            spans.append(found)
            sizes.append(len(found))
            if len(found):
                kept = kept_words(len(words), found)
                words = [w for w, k in zip(words, kept.tolist(), strict=True) if k]
            collapsed.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        made = np.concatenate([np.zeros((0, 3), np.int64), *spans])
        entries = pa.StructArray.from_arrays([pa.array(made[:, k]) for k in range(3)], names=["start", "length", "period"])
        return [pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), entries), pa.array(collapsed, pa.string())]

    return with_scores(docs, [T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())], score, text)


def longest(runs: str = "runs"):
    """The run of greatest length; ties go to the smallest start, then period. Null without runs."""
    r = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(r.isNotNull(), F.struct((-r["s"]).alias("start"), r["length"].alias("length"), (-r["p"]).alias("period")))
