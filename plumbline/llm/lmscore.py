"""Language-model scoring with a weighted backoff automaton over the n-grams of the whole corpus.

Word n-grams are smoothed by Dirichlet priors: with c counted in training and h' the context h without its first word,
p(w | h) = (c(hw) + PRIOR p(w | h')) / (c(h) + PRIOR), down to p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). As an automaton, every context seen in
training is a state. An n-gram hw is an arc of h with weight log10 p(w | h), to the state of the longest known suffix of
hw. A failure arc leads from h to h' with weight log10(PRIOR / (c(h) + PRIOR)). The root has an arc for every word, known
or not. One pass over a text carries the state from word to word and adds the weights up.

The model of a large corpus fits into no task. Texts are dealt over blocks of bounded size. A block names the
n-grams of its own texts, each once, with their training counts; these meet those of other blocks by ranges of their
64-bit hashes, and the totals go back to each block that named them. The block then builds the part of the automaton that its texts
can reach, which is whole for them, and runs them all through it side by side.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = 2  # words of the longest n-gram
PRIOR = 128.0  # pseudo-counts of the shorter context
BLOCK_BYTES = 8 << 20  # text of a block
RANGE_BYTES = 12 << 20  # text for each range of hashes
PIECE = 4096  # words run through at a time
MOST_WORDS = 500_000  # distinct words counted in a task before they are handed on
START, STOP = 0, 1  # word numbers of the start of a text, which is only ever context, and of its end
SCORES = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def words_of(text: bytes | None) -> list[bytes]:
    """Words parted by ASCII white space, A to Z in lower case."""
    return (text or b"").lower().split()


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


STOP_HASH = word_hash(b" stop")  # no word holds a blank


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes, in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers as bytes, all lowest bytes first: the many zero bytes of small numbers lie together, where a shuffle's codec finds them."""
    return values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


@dataclass
class Grams:
    """The distinct n-grams of one length in a block. For length 1 they are the words by number."""

    key: np.ndarray  # hash
    context: np.ndarray  # number of the n-gram without its last word, one shorter
    suffix: np.ndarray  # number of the n-gram without its first word
    last: np.ndarray  # number of the last word
    count: np.ndarray  # in training texts; once filled, in all training texts of the corpus


class Block:
    """Texts as numbered words, each with START before and STOP after, and their n-grams up to ``order``."""

    def __init__(self, texts: list[bytes | None], train: np.ndarray, order: int = ORDER):
        number = defaultdict(count(2).__next__)
        parts = []
        for t in texts:
            words = words_of(t)
            ids = np.empty(len(words) + 2, np.int64)
            ids[0], ids[-1] = START, STOP
            ids[1:-1] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            parts.append(ids)
        self.order, self.n_texts = order, len(texts)
        self.ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.first = np.cumsum([0, *map(len, parts)])  # of each text's START, with the end
        lengths = np.diff(self.first)
        self.width = len(number) + 2
        learnt = np.repeat(train, lengths)
        place = np.arange(len(self.ids)) - np.repeat(self.first[:-1], lengths)
        none = np.zeros(self.width, np.int64)
        key = np.fromiter((word_hash(w) for w in number), np.uint64, len(number))
        key = np.concatenate([np.array([word_hash(b" start"), STOP_HASH], np.uint64), key])
        self.grams = [Grams(key, none, none, np.arange(self.width), np.bincount(self.ids[learnt], minlength=self.width))]
        at = self.ids
        for k in range(2, order + 1):
            here = np.flatnonzero(place >= k - 1)
            shorter = self.grams[-1]
            codes, inverse = np.unique(at[here - 1] * self.width + self.ids[here], return_inverse=True)
            context, last = codes // self.width, codes % self.width
            suffix = np.empty(len(codes), np.int64)
            suffix[inverse] = at[here]
            self.grams.append(Grams(_mixed(shorter.key[context], key[last]), context, suffix, last, np.bincount(inverse[learnt[here]], minlength=len(codes))))
            at = np.full(len(self.ids), -1)
            at[here] = inverse

    def named(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-grams in ascending order, each once, and where each n-gram's stands."""
        return np.unique(np.concatenate([g.key for g in self.grams]), return_inverse=True)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """``named`` hashes with their training counts in this block."""
        keys, where = self.named()
        return keys, np.bincount(where, np.concatenate([g.count for g in self.grams]), len(keys)).astype(np.int64)

    def fill(self, totals: np.ndarray) -> None:
        """Takes the corpus counts of the ``named`` hashes."""
        keys, where = self.named()
        if len(totals) != len(keys):
            raise ValueError(f"{len(totals)} counts came back for {len(keys)} n-grams: the texts of a block changed between two reads")
        every, at = totals[where], 0
        for g in self.grams:
            g.count = every[at : at + len(g.key)]
            at += len(g.key)

    def words(self, values: np.ndarray) -> np.ndarray:
        """The sum of ``values``, one a word number, over the words of each text and its STOP."""
        spoken = values[self.ids]
        spoken[self.first[:-1]] = 0
        return np.add.reduceat(spoken, self.first[:-1]) if self.n_texts else np.zeros(0)


class Automaton:
    """The backoff automaton of a filled block: states 0 (root) and one for each context known in training."""

    def __init__(self, block: Block, tokens: int, distinct: int, prior: float = PRIOR):
        words, scale = block.grams[0], tokens + 0.5 * (distinct + 1)
        self.width = block.width
        share = (words.count + 0.5) / scale
        self.base = np.log10(share)
        fail, weight, made = [np.zeros(1, np.int64)], [np.zeros(1)], 1
        known = []  # state of each n-gram, or of its longest known suffix
        arcs, arc_weight, arc_to = [], [], []
        for k, g in enumerate(block.grams, start=1):
            seen = g.count > 0
            shorter = known[-1][g.suffix] if known else np.zeros(len(g.key), np.int64)
            if k > 1:
                total = block.grams[k - 2].count[g.context]
                lower = share[g.suffix]
                share = np.where(total > 0, (g.count + prior * lower) / (total + prior), lower)
            if k < block.order:
                states = seen & (g.last != STOP)
                state = np.where(states, made + np.cumsum(states) - 1, shorter)
                made += int(states.sum())
                fail.append(shorter[states])
                weight.append(np.log10(prior / (g.count[states] + prior)))
            else:
                state = shorter
            if k > 1:
                arcs.append(known[-1][g.context][seen] * self.width + g.last[seen])
                arc_weight.append(np.log10(share[seen]))
                arc_to.append(state[seen])
            known.append(state)
        self.fail, self.fail_weight = np.concatenate(fail), np.concatenate(weight)
        self.root_to, self.start = known[0], int(known[0][START])
        none = np.zeros(0, np.int64)
        codes = np.concatenate(arcs or [none])
        order = np.argsort(codes)
        self.arcs, self.weight, self.to = np.append(codes[order], np.iinfo(np.int64).max), np.concatenate(arc_weight or [np.zeros(0)])[order], np.concatenate(arc_to or [none])[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and weight after reading one word in each state: down the failure arcs until a state has an arc for it."""
        total, after = np.zeros(len(state)), np.zeros(len(state), np.int64)
        todo = np.arange(len(state))
        while len(todo):
            at, read = state[todo], word[todo]
            code = at * self.width + read
            place = np.searchsorted(self.arcs, code)
            hit = (self.arcs[place] == code) & (at > 0)
            root = at == 0
            total[todo[hit]] += self.weight[place[hit]]
            after[todo[hit]] = self.to[place[hit]]
            total[todo[root]] += self.base[read[root]]
            after[todo[root]] = self.root_to[read[root]]
            todo = todo[~hit & ~root]
            total[todo] += self.fail_weight[state[todo]]
            state[todo] = self.fail[state[todo]]
        return after, total

    def run(self, block: Block, piece: int = PIECE) -> np.ndarray:
        """log10 probability of each text: all texts side by side, from left to right.

        A long text is taken in pieces. A piece starts at the root, order - 1 words early, and so is in the state
        of the whole text when its own words begin.
        """
        lengths = np.diff(block.first) - 1
        own = [(i, lo, min(lo + piece, n)) for i, n in enumerate(lengths.tolist()) for lo in range(0, n, piece)]
        if not own:
            return np.zeros(block.n_texts)
        text, lo, hi = np.array(own).T
        early = np.where(lo > 0, block.order - 1, 0)
        begin = block.first[text] + 1 + lo - early
        size = hi - lo + early
        longest = np.argsort(-size, kind="stable")
        text, begin, size, early = text[longest], begin[longest], size[longest], early[longest]
        state, total = np.where(early > 0, 0, self.start), np.zeros(len(text))
        going = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # pieces longer than each step
        for t, m in enumerate(going.tolist()):
            state[:m], gained = self.step(state[:m].copy(), block.ids[begin[:m] + t])
            total[:m] += np.where(t >= early[:m], gained, 0.0)
        return np.bincount(text, total, block.n_texts)


def corpus_size(docs: DataFrame, text: str, train: Column) -> tuple[int, int, int]:
    """(tokens, distinct tokens) of the training texts, ends included, and the bytes of all texts: three numbers of the whole corpus."""
    rows = docs.select(F.col(text).cast("binary").alias("t"), train.alias("train"))

    def batch(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], names=["kind", "key", "n"])

    def words(counted: dict[bytes, int]) -> pa.RecordBatch:
        return batch(0, np.fromiter(map(word_hash, counted), np.uint64, len(counted)), np.fromiter(counted.values(), np.int64, len(counted)))

    def run(batches):
        size = ends = 0
        counted = defaultdict(int)
        for b in batches:
            for t, learnt in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                size += len(t or b"")
                if learnt:
                    ends += 1
                    for w in words_of(t):
                        counted[w] += 1
            if len(counted) > MOST_WORDS:
                yield words(counted)
                counted.clear()
        yield words(counted)
        if ends:
            yield batch(0, np.array([STOP_HASH], np.uint64), np.array([ends]))
        yield batch(1, np.zeros(1, np.uint64), np.array([size]))

    counts = rows.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    row = counts.agg(F.sum(of(0, F.col("n"))).alias("tokens"), F.count(of(0, F.lit(1))).alias("distinct"), F.sum(of(1, F.col("n"))).alias("size")).first()
    return row["tokens"] or 0, row["distinct"], row["size"] or 0


def score_texts(docs: DataFrame, train: Column, text: str = "text", order: int = ORDER, prior: float = PRIOR, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The columns of ``docs`` but for the text, with n_tokens, n_known, train_tokens, base_score and score of every whole text.

    The model learns from the rows where ``train`` is true; null counts as false. Tokens are the words, A to Z in lower
    case, and one end. n_known of them occur in training, train_tokens are all of training. base_score is the smoothed
    unigram score, score that of the automaton, both log10 of the text's probability. A null text counts as empty and
    has its end only. Repeated rows each count and each come back; same-named columns are replaced. Without training rows
    all tokens are unknown. An empty table gives an empty table.

    Texts are dealt over blocks by a hash of their row and of the partition they come from, so that repeats are spread too.
    """
    made = {"n_tokens", "n_known", "train_tokens", "base_score", "score", text.lower()}
    names = [c for c in docs.columns if c.lower() not in made]
    learnt = F.coalesce(train, F.lit(False))
    tokens, distinct, size = corpus_size(docs, text, learnt)
    blocks, ranges = max(1, -(-size // block_bytes)), max(1, -(-size // range_bytes))
    others = [F.col(f"`{c}`") for c in names] or [F.lit(0).alias("none")]
    plain = [f"`{c}`" for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    block = F.pmod(F.xxhash64(F.spark_partition_id(), *plain), F.lit(blocks)).cast("int")
    rows = docs.select(block.alias("block"), F.struct(*others).alias("row"), F.col(text).cast("binary").alias("t"), learnt.alias("train"))

    def texts_of(part: pa.Table) -> Block:
        return Block(part.column("t").to_pylist(), part.column("train").to_numpy().astype(bool), order)

    def cuts(keys: np.ndarray) -> np.ndarray:
        bounds = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
        return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]]).astype(np.int64)

    def name_grams(part: pa.Table) -> pa.Table:
        keys, counts = texts_of(part).counts()
        at = cuts(keys)
        some = np.flatnonzero(np.diff(at))
        pack = lambda values: pa.array([packed(values(at[i], at[i + 1])) for i in some], pa.binary())
        number = np.full(len(some), part.column("block")[0].as_py(), np.int32)
        steps = pack(lambda a, b: np.diff(keys[a:b], prepend=np.uint64(0)))  # ascending
        return pa.table({"part": pa.array(some.astype(np.int32)), "block": pa.array(number), "keys": steps, "counts": pack(lambda a, b: counts[a:b])})

    def add_up(part: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpacked(x), dtype=np.uint64) for x in part.column("keys").to_pylist()]
        counts = np.concatenate([unpacked(x) for x in part.column("counts").to_pylist()])
        once, where = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(where, counts, len(once)).astype(np.int64)[where]
        ends = np.cumsum([0, *map(len, keys)]).tolist()
        back = [packed(totals[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        return pa.table({"block": part.column("block"), "part": part.column("part"), "totals": pa.array(back, pa.binary())})

    def score(part: pa.Table, replies: pa.Table) -> pa.Table:
        held = texts_of(part)
        held.fill(np.concatenate([unpacked(x) for x in replies.sort_by("part").column("totals").to_pylist()]).astype(np.int64))
        machine = Automaton(held, tokens, distinct, prior)
        known = held.words((held.grams[0].count > 0).astype(np.int64))
        columns = [np.diff(held.first) - 1, known, held.words(machine.base), machine.run(held)]
        return pa.table({"row": part.column("row"), **{f.name: pa.array(x) for f, x in zip(SCORES, columns, strict=True)}})

    named = rows.groupBy("block").applyInArrow(name_grams, "part int, block int, keys binary, counts binary")
    totals = named.groupBy("part").applyInArrow(add_up, "block int, part int, totals binary")
    scored = rows.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(score, T.StructType([rows.schema["row"], *SCORES]))
    return scored.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
