"""Benchmark decontamination by templates.

Tokens are lower-cased words; numbers, names (capitalised inside a sentence) and units (after a number) become typed
placeholders. Windows of five tokens are hashed, as template and as they stand in lower case, and joined with those of the
benchmark. Windows that lie at the same distance form an alignment; those count whose slots are filled consistently:
each value of the item stands for one value of the document and the other way round, or for itself. A document holds an
item if its alignments cover at least 0.8 of the item's windows, so a question with other numbers and names is found
like a literal copy, or if one alignment covers 13 tokens in a row. An item without template windows counts by its
literal ones, and one of fewer than five tokens is looked for as a whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import same_row, stored

WORDS = 5
COVERED = 0.8
RUN = 13  # tokens in a row
LEAST_LITERAL = 2  # a window with fewer words that are no placeholders says nothing
KEYS_HELD = 4_000_000  # benchmark windows that a task holds at once; a larger benchmark is taken in as many passes

TOKENS = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?\n]+")
UNITS = frozenset(
    "mm cm m km kg g mg t l ml s h min kwh w kw v a hz mb gb tb mph kmh inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers "
    "gram grams kilogram kilograms lb lbs oz pound pounds ounce ounces litre litres liter liters second seconds minute minutes hour hours day days week weeks month months year years percent "
    "degree degrees dollar dollars euro euros cent cents".split()
)
WORD, NUMBER, NAME, UNIT, STOP = range(5)
PLACEHOLDERS = np.array([0, *(xxhash.xxh64_intdigest(f"<{x}>") for x in ("number", "name", "unit"))], np.uint64)
TOKENS_HELD = 500_000


class _Codes(dict):
    """Number of a token; its hash and kind by that number. NAME and UNIT are what it may be, by its form."""

    def __init__(self):
        super().__init__()
        self.hashes, self.kinds = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int8)

    def __missing__(self, token: str) -> int:
        low = token.lower()
        kind = STOP if token[0] in ".!?\n" else NUMBER if token[0].isdecimal() else NAME if token[0] != low[0] else UNIT if low in UNITS else WORD
        at = self[token] = len(self)
        if at == len(self.kinds):
            self.hashes, self.kinds = np.resize(self.hashes, 2 * at), np.resize(self.kinds, 2 * at)
        self.hashes[at], self.kinds[at] = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")), kind
        return at


class Templates:
    """Template windows of texts; remembers tokens."""

    def __init__(self, words: int = WORDS):
        self.words, self.codes = words, _Codes()

    def __call__(self, text: str, inside: bool = False, short: tuple = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple, np.ndarray]:
        """Windows' places, hashes and whether literal, tokens with the places of those that count, and which of these are slots.

        A template window without slots is literal as well and comes once; its ``literal`` is false. ``inside``: the text
        starts within a sentence. ``short``: further lengths of literal windows.
        """
        if len(self.codes) > TOKENS_HELD:
            self.codes = _Codes()
        tokens = TOKENS.findall(text)
        at = np.fromiter(map(self.codes.__getitem__, tokens), np.int64, len(tokens))
        kind = self.codes.kinds[at]
        keep = np.flatnonzero(kind != STOP)
        first = np.concatenate([[not inside], kind[:-1] == STOP])[: len(kind)][keep]
        kind, at = kind[keep], at[keep]
        after_number = np.concatenate([[False], kind[:-1] == NUMBER])[: len(kind)]
        kind = np.where((kind == NAME) & first | (kind == UNIT) & ~after_number, WORD, kind)
        slot = kind != WORD
        own = self.codes.hashes[at]
        n = max(0, len(own) - self.words + 1)
        slots = sum((slot[j : j + n].astype(np.int64) for j in range(self.words)), np.zeros(n, np.int64))
        template = np.flatnonzero(slots <= self.words - LEAST_LITERAL)
        literal = np.flatnonzero(slots > 0)
        more = [_grams(own, k) for k in short]
        places = np.concatenate([template, literal, *map(np.arange, map(len, more))]).astype(np.int64)
        hashes = np.concatenate([_grams(np.where(slot, PLACEHOLDERS[kind], own), self.words)[template], _grams(own, self.words)[literal], *more])
        return places, hashes, np.arange(len(places)) >= len(template), (tokens, keep), slot


def _grams(value: np.ndarray, words: int) -> np.ndarray:
    """Hash of each run of ``words`` values."""
    n = max(0, len(value) - words + 1)
    made = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(words):
            made = made * np.uint64(0x9E3779B97F4A7C15) + value[j : j + n]
            made ^= made >> np.uint64(29)
    return made


def _slots(tokens: tuple, slot: np.ndarray, place: int, words: int) -> list[str]:
    return [tokens[0][tokens[1][i]].lower() for i in range(place, place + words) if slot[i]]


def benchmark_windows(benchmark: DataFrame, words: int = WORDS) -> DataFrame:
    """(item_id, place, key, slots, windows, length) of every window, as template and literal; the first one also as if inside a sentence.

    The places are those of template windows, or all if an item has none. An item of fewer than ``words`` tokens has
    one window, of that length. Items without a token have none. ``windows`` is how many places an item has.
    """

    def run(batches):
        made = Templates(words)
        for b in batches:
            out = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen, counted = {}, set()
                length = words
                for inside in (False, True):
                    places, keys, literal, tokens, slot = made(text or "", inside)
                    if 0 < len(slot) < words:
                        length = len(slot)
                        places, keys, literal, tokens, slot = made(text, inside, (length,))
                    for p, k, as_is in zip(places.tolist(), keys.view(np.int64).tolist(), literal.tolist(), strict=True):
                        seen[p, k] = [] if as_is else _slots(tokens, slot, p, words)
                        if not as_is:
                            counted.add(p)
                counted = counted or {p for p, _ in seen}
                out += [(item, p, k, s, len(counted), length) for (p, k), s in seen.items() if p in counted]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.column(0).type, pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int32(), pa.int32()), strict=True)], names=["item_id", "place", "key", "slots", "windows", "length"])

    schema = benchmark.select("item_id").schema.add("place", T.IntegerType()).add("key", T.LongType()).add("slots", T.ArrayType(T.StringType())).add("windows", T.IntegerType()).add("length", T.IntegerType())
    return benchmark.select("item_id", "text").mapInArrow(run, schema)


def _met(rows: DataFrame, keys: np.ndarray, words: int, short: tuple) -> DataFrame:
    """(doc_id, h, at, key, slots): the windows of all texts, also of the lengths ``short``, whose key is among the sorted ``keys``."""
    sent = rows.sparkSession.sparkContext.broadcast(keys)  # at most KEYS_HELD

    def run(batches):
        made, known = Templates(words), sent.value
        for b in batches:
            row, at, key, slots = [], [], [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                places, got, literal, tokens, slot = made(text or "", short=short)
                spot = np.searchsorted(known, got)
                hit = np.flatnonzero(known[np.minimum(spot, len(known) - 1)] == got) if len(known) else ()
                for j in hit:
                    row.append(i)
                    at.append(int(places[j]))
                    key.append(int(got[j].view(np.int64)))
                    slots.append([] if literal[j] else _slots(tokens, slot, int(places[j]), words))
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(at, pa.int32()), pa.array(key, pa.int64()), pa.array(slots, pa.list_(pa.string()))], names=["doc_id", "h", "at", "key", "slots"])

    schema = rows.select("doc_id", "h").schema.add("at", T.IntegerType()).add("key", T.LongType()).add("slots", T.ArrayType(T.StringType()))
    return rows.mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, covered: float = COVERED, keys_held: int = KEYS_HELD, run: int = RUN) -> DataFrame:
    """(doc_id, h, item_id, n_windows, n_found, coverage) for every document that holds an item; h is xxhash64 of the text.

    Null and empty texts hold nothing; rows with one doc_id and text are one document; an empty benchmark finds nothing.
    """
    index = stored(benchmark_windows(benchmark, words))
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    short = tuple(sorted(r["length"] for r in index.where(F.col("length") < words).select("length").distinct().collect()))  # fewer than words
    passes = max(1, -(-index.select("key").distinct().count() // keys_held))
    met = None
    for k in range(passes):
        part = index.where(F.pmod("key", F.lit(passes)) == k).select("key").distinct().toPandas()["key"].to_numpy(np.int64)
        found = _met(rows, np.sort(part.view(np.uint64)), words, short)
        met = found if met is None else met.unionByName(found)
    met = stored(met)
    pairs = met.join(index.withColumnRenamed("slots", "own"), "key").select("doc_id", "h", "item_id", "windows", "length", (F.col("at") - F.col("place")).alias("shift"), F.struct("place", F.arrays_zip("own", "slots").alias("filled")).alias("window"))
    aligned = pairs.groupBy("doc_id", "h", "item_id", "windows", "length", "shift").agg(F.collect_set("window").alias("met"))
    filled = aligned.withColumn("filled", F.array_distinct(F.flatten("met.filled")))
    # values that stand for more than one, and not for themselves
    double = lambda p, side: F.size(F.filter("filled", lambda q: q[side] == p[side])) > 1
    unlike = filled.withColumn("unlike", F.filter("filled", lambda p: (p["own"] != p["slots"]) & (double(p, "own") | double(p, "slots"))))
    good = unlike.withColumn("places", F.array_sort(F.array_distinct(F.transform(F.filter("met", lambda w: ~F.arrays_overlap(w["filled"], "unlike")), lambda w: w["place"]))))
    whole = good.withColumn("run", _longest("places", F.col("length"))).groupBy("doc_id", "h", "item_id", "windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n_found"), F.max("run").alias("run"))
    share = F.col("n_found") / F.col("windows")
    return whole.where((share >= covered) | (F.col("run") >= run)).select("doc_id", "h", "item_id", F.col("windows").alias("n_windows"), "n_found", share.alias("coverage"))


def _longest(places: str, length: Column) -> Column:
    """The most tokens in a row under windows of ``length`` at these sorted places."""
    start = F.struct(*[F.lit(0).alias(x) for x in ("first", "end", "most")])

    def then(s: Column, p: Column) -> Column:
        first, end = F.when(p <= s["end"], s["first"]).otherwise(p), p + length
        return F.struct(first.alias("first"), end.alias("end"), F.greatest(s["most"], end - first).alias("most"))

    return F.aggregate(places, start, then)["most"]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, covered: float = COVERED) -> DataFrame:
    """``docs`` without those that hold a benchmark item. The columns stay as they are, whatever their names."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("h"))
    gone = contaminated(docs, benchmark, words, covered).select("doc_id", "h").distinct()
    return rows.join(gone, same_row(rows, gone, ["doc_id", "h"]), "left_anti").select("row.*")
