"""Repeated runs of lines, found by winnowing.

A document is the sequence of its lines that are not blank, each a hash. A window is the shortest run of lines from a
line onwards, or up to a line, that holds at least ``words`` words. The line with the smallest hash in a window is its
fingerprint. Equal windows choose the same fingerprint, so of any run of at least ``words`` words that occurs twice,
both places have fingerprints in common. Only fingerprints that occur at two or more positions are followed: their
windows are joined by their whole content to the first position that holds it. Windows that start at each line of a
run extend the match forwards to its last line but less than a window, those that end at each line extend it
backwards, and together they cover exactly the run. Whatever lies in a window that occurred before is deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import let, same_row, stored

WORDS = 10
PARTS = 16
KEYS = ["doc_id", "h"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _sequence(text: Column) -> Column:
    """array<struct<at, h, n>> of the lines that are not blank: place among all lines, hash without outer white space, words (inner spaces and one)."""
    def entry(bare: Column, at: Column) -> Column:
        words = F.char_length(bare) - F.char_length(F.replace(bare, F.lit(" "), F.lit(""))) + 1
        return F.when(bare != "", F.struct(at.alias("at"), F.xxhash64(bare).alias("h"), words.alias("n")))

    bare = F.transform(_lines(text), lambda line: F.btrim(line, F.lit(" \t\r\x0b\x0c")))
    return F.filter(F.transform(bare, entry), lambda x: x.isNotNull())


def _reach(part: Column, words: int) -> Column:
    """How many lines from the start of ``part`` hold ``words`` words; null if they all hold fewer."""
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines"))
    step = lambda s, x: F.when(s["words"] >= words, s).otherwise(F.struct((s["words"] + x["n"]).alias("words"), (s["lines"] + 1).alias("lines")))
    return F.aggregate(part, start, step, lambda s: F.when(s["words"] >= words, s["lines"]))


def _window(lines: Column, first: Column, size: Column) -> Column:
    """struct<fp, spot, content, first, at> of the run of ``size`` lines from place ``first`` (from 0); fp stands at ``spot``, and at has the lines' places in the text."""
    def made(part: Column) -> Column:
        hashes = part["h"]
        fp = F.array_min(hashes)
        spot = first + F.array_position(hashes, fp) - 1
        return F.struct(fp.alias("fp"), spot.cast("int").alias("spot"), F.xxhash64(hashes).alias("content"), first.cast("int").alias("first"), part["at"].alias("at"))

    return F.when(size.isNotNull(), let(F.slice(lines, first + 1, size), made))


def _windows(lines: Column, words: int) -> Column:
    """The windows from and up to each of a document's ``lines``; some come twice. A line has a word at least, so none looks at over ``words`` lines."""
    n = F.size(lines)

    def forward(i: Column) -> Column:
        return let(_reach(F.slice(lines, i + 1, F.lit(words)), words), lambda size: _window(lines, i, size))

    def backward(i: Column) -> Column:
        low = F.greatest(i + 1 - words, F.lit(0))
        return let(_reach(F.reverse(F.slice(lines, low + 1, i + 1 - low)), words), lambda size: _window(lines, i + 1 - size, size))

    def every(make) -> Column:
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), make)).otherwise(F.array())

    return F.filter(F.concat(every(forward), every(backward)), lambda w: w.isNotNull())


def _for_each_part(rows: DataFrame) -> DataFrame:
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))


def repeated_windows(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, h, at): places of the lines of windows whose content occurs at an earlier place.

    h is xxhash64 of the text. Places are ordered by doc_id (null first), h, line.
    """
    lined = docs.select("doc_id", F.xxhash64("text").alias("h"), _sequence(F.col("text")).alias("lines"))
    found = lined.select(*KEYS, F.explode(_windows_of(words)).alias("w")).select(*KEYS, "w.*")
    windows = stored(found)
    marks = windows.groupBy("fp").agg(F.min(F.struct(*KEYS, "spot")).alias("low"), F.max(F.struct(*KEYS, "spot")).alias("high"))
    followed = marks.where("low <> high").select("fp")
    # what very many places have is dealt over PARTS, each with its own row of the other side
    dealt = windows.withColumn("part", F.pmod(F.xxhash64(*KEYS, "first"), F.lit(PARTS)).cast("int"))
    met = dealt.join(_for_each_part(followed), ["fp", "part"])
    places = met.groupBy("content", "fp").agg(F.min(F.struct(*KEYS, "first")).alias("source"), F.max(F.struct(*KEYS, "first")).alias("last")).where("source <> last")
    again = dealt.join(_for_each_part(places.select("fp", "content", "source")), ["fp", "content", "part"])
    return again.where(F.struct(*KEYS, "first") > F.col("source")).select(*KEYS, "at")


def _windows_of(words: int) -> Column:
    return let(F.col("lines"), lambda lines: _windows(lines, words))


def drop_repeated_lines(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with every run of lines of at least ``words`` words deleted where it occurs again, and n_removed lines.

    The first place by (doc_id, text hash, line) stays; blank lines stay. Lines are parted by a line feed and compared
    without outer white space. Null texts stay null; shorter texts stay as they are. Other columns stay, whatever
    their names, but ``n_removed`` is replaced. Equal rows are one document and keep the same lines.
    """
    names = [c for c in docs.columns if c.lower() != "n_removed"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", F.xxhash64("text").alias("h"), "text")
    spans = repeated_windows(docs, words).groupBy(*KEYS).agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("gone"))
    marked = rows.join(spans, same_row(rows, spans, KEYS), "left").select("row", "text", "gone")
    rest = let(_lines(F.col("text")), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone"), lambda i: F.get(lines, i)), "\n"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(rest)
    fields = [text.alias(c) if c.lower() == "text" else F.col(f"row.`{c}`").alias(c) for c in names]
    return marked.select(*fields, F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
