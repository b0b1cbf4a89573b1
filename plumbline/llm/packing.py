"""Best-fit packing by minimum bin slack.

Lengths are at most the capacity, so how many pieces there are of each length is a table of at most ``capacity`` rows,
whatever the corpus. On it the bins are made: each takes the longest piece left and then the combination of the other
lengths that fills it most, found by a subset-sum over bitsets (bit s is set if some choice adds up to s). The same
combination is taken as often as its lengths last, so each step uses up a length and there are at most ``capacity``
steps. The pieces themselves are numbered within their length by counts per (length, bucket), and each number is looked
up in the plan; no piece passes through the driver, and a length that half of all pieces have is spread over buckets.
"""

import re
import unicodedata
import zlib
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import stored

CAPACITY = 2048
PER_BUCKET = 50_000  # pieces that a bucket holds on average

# Characters for which Python's own lowering and classes agree with the tokenizer's; other texts go to it whole.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u024f]*")
OTHER = "".join(re.escape(c) for c in map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x250)]) if not c.isalpha() and not c.isnumeric())
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_²³¹¼½¾]+|[0-9²³¹¼½¾]|[{OTHER}]+")  # the split of word_bpe_49k.json
HELD = 500_000  # words, with what touches them, whose ids a worker remembers
# How the tokenizer writes a byte: printable bytes as themselves, the others from 256 on (the public byte-level rule).
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}


class _Known(dict):
    """Ids, as bytes, of strings without white space; learnt when first asked for."""

    def __init__(self, model):
        super().__init__()
        self.model, self.words = model, {}

    def _word(self, word: str) -> bytes:
        if (ids := self.words.get(word)) is None:
            as_chars = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_CHARS)
            ids = self.words[word] = np.array([t.id for t in self.model.tokenize(as_chars)], np.uint32).tobytes()
        return ids

    def __missing__(self, part: str) -> bytes:
        ids = self[part] = b"".join(map(self._word, PIECES.findall(part)))
        return ids

    def trim(self) -> None:
        if len(self) > HELD:
            self.clear()
        if len(self.words) > HELD:
            self.words.clear()


class WordIds:
    """Ids of texts by word_bpe_49k.json, whose merges stay within words: each word is encoded once and remembered.

    Texts with characters outside PLAIN, or with the name of a special token, are encoded by the tokenizer as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _Known(self.tokenizer.model)

    def __call__(self, text: str) -> np.ndarray:
        if not PLAIN.fullmatch(text) or any(t in text.lower() for t in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        parts = unicodedata.normalize("NFC", text).lower().split()
        self.known.trim()
        found = itemgetter(*parts)(self.known) if len(parts) > 1 else [self.known[p] for p in parts]
        return np.frombuffer(b"".join(found), np.uint32)


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Each document's ids and then ``end_id``, cut into pieces of at most ``capacity``.

    (doc_id, piece, start, length, ids_crc32[, ids]). A null text counts as empty and is one piece of one id.
    """

    def run(batches):
        ids_of = encoder(tokenizer)
        for b in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                doc = np.append(ids_of(text or ""), np.uint32(end_id)).astype("<u4", copy=False)
                for k, lo in enumerate(range(0, len(doc), capacity)):
                    part = doc[lo : lo + capacity]
                    at.append(i)
                    piece.append(k)
                    start.append(lo)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        ids.append(part.astype(np.int32))
            cols = [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = docs.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return docs.select("doc_id", "text").mapInArrow(run, out.add("ids", T.ArrayType(T.IntegerType())) if keep_ids else out)


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """[(length, how many)] of the available lengths that fill ``room`` most, by subset sums over bitsets; long ones first."""
    whole = (1 << (room + 1)) - 1
    reach, trail = 1, []
    for length in sorted((x for x in counts if counts[x] and x <= room), reverse=True):
        many, take = min(counts[length], room // length), 1
        while many and not reach >> room & 1:
            take = min(take, many)
            trail.append((reach, length, take))
            reach |= reach << (length * take) & whole
            many -= take
            take *= 2
        if reach >> room & 1:
            break
    left, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(trail):
        if not before >> left & 1:
            left -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return sorted(chosen.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (repeats, [(length, how many)]): the longest piece left, with the fullest combination of the rest."""
    left, out = dict(counts), []
    while left:
        first = max(left)
        left[first] -= 1
        made = {first: 1}
        for length, many in fullest(left, capacity - first):
            made[length] = made.get(length, 0) + many
        left[first] += 1
        repeats = min(left[x] // m for x, m in made.items())
        out.append((repeats, sorted(made.items(), reverse=True)))
        for x, m in made.items():
            left[x] -= m * repeats
            if not left[x]:
                del left[x]
    return out


def _intervals(bins) -> np.ndarray:
    """For each (bin, length): length, first number within the length, how many a bin, first sequence, offset in it."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for repeats, parts in bins:
        offset = 0
        for length, many in parts:
            rows.append((length, used.get(length, 0), many, sequence, offset))
            used[length] = used.get(length, 0) + many * repeats
            offset += length * many
        sequence += repeats
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any others) with sequence_id and offset: as few sequences as minimum bin slack finds.

    Sequences are gapless from offset 0. Equal rows are each placed on their own; which of them comes first is open.
    An empty table gives an empty table. A length outside 1..capacity is an error.
    """
    pieces = stored(pieces)
    rows = pieces.count()
    buckets = max(16, -(-rows // PER_BUCKET))
    row = pieces.select(F.struct("*").alias("row"), "length", "doc_id", "piece", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int").alias("bucket"))
    by_bucket = stored(row.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in by_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    if any(not 1 <= x <= capacity for x in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    table = _intervals(plan(counts, capacity))
    before = by_bucket.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    numbered = row.withColumn("place", place).join(before, ["length", "bucket"])
    numbered = numbered.select("row", "length", (F.col("place") + F.col("before")).alias("number"))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(table[:, 0] * (1 << 44) + table[:, 1], length.to_numpy() * (1 << 44) + number.to_numpy(), side="right") - 1
        beyond = number.to_numpy() - table[at, 1]
        many = table[at, 2]
        return pd.DataFrame({"sequence_id": table[at, 3] + beyond // many, "offset": table[at, 4] + beyond % many * length.to_numpy()})

    return numbered.withColumn("spot", placed("length", "number")).select("row.*", "spot.sequence_id", "spot.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, doc_ids, ids) from packed pieces that carry ``ids``: one row a sequence, at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.col("parts.doc_id").alias("doc_ids"), F.flatten("parts.ids").alias("ids"))
