"""Document fingerprints by consistent weighted sampling.

The terms of a document are its lower-case words, weighted by how often they occur. For sample k a term x has fixed
r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1), drawn from its hash. With weight S: t = floor(ln S / r + b) and
ln a = ln c - r (t - b + 1). The sample is the (x, t) with the least a. Two documents have the same sample with a
probability equal to their generalised Jaccard similarity, sum min(S) / sum max(S), so the share of equal samples
estimates it. A sample is kept as one long: a in 31 bits, then 32 bits of a hash of (x, t), and the minimum of that
is a plain aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.expressions import slots_below, small
from plumbline.llm.common import let, whole_text

SAMPLES = 64  # the likeness has a standard error of at most 1/16
LOW = (1 << 32) - 1
SURE = 40.0  # a sample is not the exact one with probability exp(-SURE)
BEHIND = (110 << 24) << 32  # above every sample
EMPTY = "none"  # the fingerprint of a text without words
BUCKETS = 4  # ranges of ids, for each shuffle partition


def terms(text: Column) -> Column:
    """array<struct<x, n>>: hash and count of each distinct word of a text."""
    words = F.filter(F.split(F.lower(text), r"\s+", -1), lambda w: w != "")
    hashes = F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))

    def counted(h: Column) -> Column:
        n = F.size(h)
        fresh = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(h, i) != F.get(h, i - 1)))
        pairs = let(fresh, lambda s: F.transform(s, lambda i, j: F.struct(F.get(h, i).alias("x"), (F.coalesce(F.get(s, j + 1), n) - i).alias("n"))))
        return F.when(n > 0, pairs)

    return let(hashes, counted)


def terms_of_both(text: Column, other: Column) -> Column:
    """array<struct<x, n, sides>>: the distinct (term, weight) of two texts; sides is 1 for the first text, 2 for the other, 3 for both."""
    marked = lambda t, side: F.transform(F.coalesce(terms(t), F.array().cast("array<struct<x:bigint,n:int>>")), lambda e: F.struct(e["x"].alias("x"), e["n"].alias("n"), F.lit(side).alias("sides")))
    same = lambda e, f: F.coalesce((e["x"] == f["x"]) & (e["n"] == f["n"]), F.lit(False))

    def merged(all_terms: Column) -> Column:
        seen = F.transform(all_terms, lambda e, i: F.when(~((i > 0) & same(e, F.get(all_terms, F.greatest(i - 1, F.lit(0))))), F.struct(e["x"].alias("x"), e["n"].alias("n"), F.when(same(e, F.get(all_terms, i + 1)), 3).otherwise(e["sides"]).alias("sides"))))
        return F.filter(seen, lambda e: e.isNotNull())

    return let(F.sort_array(F.concat(marked(text, 1), marked(other, 2))), merged)  # two sorted lists: the sort merges them


def sample(x: Column, one: Column, weight: Column, log_weight: Column, reach: Column, k: int) -> Column:
    """Sample ``k`` of a term as a long whose minimum over the terms is the document's sample.

    The five uniforms are parts of two hashes of (x, k): 24 bits each for r and c, 16 for b, at the middle of their steps.
    ``one`` is the hash of (x, 0) where the weight is 1, else null: as b is under 1, t is 0 there.

    a is distributed as an exponential with the term's weight for its rate, so the least a of a text is over ``reach`` =
    SURE / total weight with probability exp(-SURE). With p = exp(-c) and q = exp(-r), a is at least
    2 (1 - p) / (1 + p) q / weight, and for weight 1 even 2 (1 - p) / (1 + p) q / (1 - b + b q). Where this exceeds ``reach``, the
    logarithms are left out and the term stands behind all others, by its hash.
    """
    first, second = F.xxhash64(x, F.lit(2 * k)), F.xxhash64(x, F.lit(2 * k + 1))
    unit = lambda bits, shift, width: (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1)).cast("double") + 0.5) * 2.0**-width
    p, q = unit(second, 0, 24) * unit(second, 24, 24), unit(first, 0, 24) * unit(first, 24, 24)
    b = unit(first, 48, 16)
    r, c = -F.log(q), -F.log(p)
    t = F.when(one.isNotNull(), F.lit(0).cast("long")).otherwise(F.floor(log_weight / r + b))
    least = F.log(c) - r * (t - b + 1.0)
    exact = F.shiftleft(((least + 64.0) * float(1 << 24)).cast("long"), 32).bitwiseOR(F.coalesce(one, F.xxhash64(x, t)).bitwiseAND(F.lit(LOW)))
    room = F.when(one.isNotNull(), (1.0 - b) + b * q).otherwise(weight)
    return F.when((1.0 - p) * q * 2.0 > reach * (1.0 + p) * room, F.lit(BEHIND).bitwiseOR(x.bitwiseAND(F.lit(LOW)))).otherwise(exact)


def signatures(rows: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys``, own and changed: arrays of ``samples`` longs for the two texts of each row of ``rows`` (keys, text, edited); null without words.

    Rows with equal keys become one. Each distinct term and weight of the two texts is drawn once for both. Samples are
    combined where the texts lie, so a document crosses a shuffle as a few times ``samples`` longs at most, and not at all if ``keys``
    hold the column by which the texts are already dealt.
    """
    total = lambda side: F.aggregate("terms", F.lit(0), lambda s, e: s + F.when(e["sides"] != side, e["n"]).otherwise(0))
    found = rows.select(*keys, terms_of_both(whole_text(), whole_text("edited")).alias("terms"))
    reach = (SURE / F.greatest(F.least(total(2), total(1)), F.lit(1))).alias("reach")
    each = found.select(*keys, reach, "terms").select(*keys, "reach", F.explode_outer("terms").alias("term"))
    weight = F.col("term.n").cast("double")
    each = each.select(*keys, "reach", "term.sides", F.col("term.x").alias("x"), F.when(weight == 1, F.xxhash64("term.x", F.lit(0).cast("long"))).alias("one"), weight.alias("n"), F.log(weight).alias("s"))
    least = each.groupBy(*keys, "sides").agg(*[F.min(sample(F.col("x"), F.col("one"), F.col("n"), F.col("s"), F.col("reach"), k)).alias(f"s{k}") for k in range(samples)])
    made = least.select(*keys, "sides", F.array(*[f"s{k}" for k in range(samples)]).alias("least"))
    of = lambda side: F.max(F.when(F.col("sides") == side, F.struct("least")))["least"]
    sides = made.groupBy(*keys).agg(*[of(k).alias(f"l{k}") for k in (1, 2, 3)])
    low = lambda least: F.transform(least, lambda x: x.bitwiseAND(F.lit(LOW)))
    both = lambda own: low(F.coalesce(F.zip_with(own, "l3", lambda a, b: F.least(a, b)), F.col(own), F.col("l3")))
    return sides.select(*keys, both("l1").alias("own"), both("l2").alias("changed"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; texts without words are alike."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def fingerprint(signature: Column) -> Column:
    """8 hexadecimal digits for each sample."""
    return F.coalesce(F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""), F.lit(EMPTY))


def with_next(docs: DataFrame) -> DataFrame:
    """(to, place, copy, doc_id, text, next_text): each document and the next by doc_id; after the last, the first.

    Null ids come first, equal ids go by the hash of the text; place numbers the rows of a range in this order.
    Documents are dealt over ranges of ids (``to``); the first of a range is also sent to the range before it, as its
    last row, with ``copy`` 1.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), whole_text().alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"))
    bits = max(1, (BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    bounds = rows.agg(F.percentile_approx("id", shares, 10 * (1 << bits)).alias("b")).first()["b"] or []
    if not bounds:
        bounds = [0] * len(shares)
    bucket = slots_below(F.array(*[F.lit(int(x)).cast("long") for x in bounds]), F.col("id"), bits)
    dealt = rows.withColumn("bucket", bucket)
    firsts = sorted((r["bucket"], r["first"]) for r in dealt.groupBy("bucket").agg(F.min("id").alias("first")).collect())  # a row a range
    ahead = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    sent = small(spark.createDataFrame(ahead, "id long, back int"))
    both = dealt.join(sent, "id", "left").withColumn("at", F.explode(F.array(F.struct(F.lit(0).alias("copy"), F.col("bucket").alias("to")), F.when(F.col("back").isNotNull(), F.struct(F.lit(1).alias("copy"), F.col("back").alias("to")))))).where("at is not null")
    both = both.select("doc_id", "h", "text", "id", "at.copy", "at.to")
    order = Window.partitionBy("to").orderBy("copy", "id", "h")
    return both.select("to", F.row_number().over(order).alias("place"), "copy", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def edited_texts(docs: DataFrame) -> DataFrame:
    """with_next, with n_chars and edited: the last quarter of the text replaced by as much of the start of the next one; null for a copy."""
    n = F.char_length("text")
    part = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - part), F.substr(F.col("next_text"), F.lit(1), part))
    return with_next(docs).withColumn("n_chars", n.cast("long")).withColumn("edited", F.when(F.col("copy") == 0, edited))


def compare_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    A null text counts as empty. Repeated rows each come back. Equal texts have equal fingerprints, those without words ``none``.
    """
    keys = ["to", "place", "copy", "doc_id", "n_chars", "edited_sha256"]
    texts = edited_texts(docs).select("to", "place", "copy", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "text", "edited")
    # everything since the texts were dealt stays within its range: no further shuffle
    signed = signatures(texts, keys, samples)
    rows = signed.withColumn("next_own", F.lead("own").over(Window.partitionBy("to").orderBy("place"))).where("copy = 0")
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))
