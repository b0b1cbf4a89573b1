"""Personal data: pattern matches, and terms that give a protected entity away.

The matches of a pattern are placed by what lies between them: text.split(pattern) has the gaps, so a match starts
where the gaps and matches before it end. Positions are sums over a document's matches, in code points.

An entity is a matched value. Terms are the words of a text outside of its matches. Over all documents, a term t gives
entity e away by its pointwise mutual information, log2(p(e, t) / (p(e) p(t))), against what there is to know, the
information content -log2 p(e). Where the share reaches ``disclosure`` in at least ``support`` different texts, t is a
span of its own in every document, whether it holds e or not, and is generalised when the text is sanitised.

As e and t are in no more documents together than either is in, the share can reach d only if t is in at most
total^(1 - d) n(e)^d documents. Common words are left out by that, which is exact, before terms meet entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import let, same_row, stored, whole_text

# Leftmost matches that do not overlap, as specified; runs are possessive and start where they can start at all, so a
# long run is passed once and not once for each of its characters.
LOCAL = "A-Za-z0-9._%+-"
KINDS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
TERM = r"\p{L}{3,}"
ORDER = [*KINDS, "term"]
MAY_HOLD = r"[@+]|[0-9][ .-]?[0-9]"  # no text without this has a match
DISCLOSURE, SUPPORT = 0.9, 3
KEYS = ["doc_id", "h"]


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<kind, i, gap, match>> of a text."""
    def placed(parts: Column) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m, i: F.struct(F.lit(ORDER.index(kind)).alias("kind"), i.alias("i"), F.char_length(F.get(parts, i)).alias("gap"), m.alias("match")))

    return let(F.split(text, pattern, -1), placed)


def _terms(text: Column) -> Column:
    """The distinct words of a text in lower case, outside of its matches."""
    bare = F.when(text.rlike(MAY_HOLD), F.regexp_replace(F.regexp_replace(text, KINDS["email"], " "), KINDS["phone"], " ")).otherwise(text)  # the other kinds hold no letters
    return F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit(TERM), F.lit(0)))


def _luhn(digits: Column) -> Column:
    def worth(x: Column, i: Column) -> Column:
        d = F.when(i % 2 == 1, 2 * x.cast("int")).otherwise(x.cast("int"))
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda x, i: worth(x, i)), F.lit(0), lambda a, b: a + b) % 10 == 0


def _passes(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    small = F.forall(F.split(match, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda x: F.when(F.char_length(x) <= 3, (x == "") | (x.try_cast("int") <= 255)).otherwise(False)))
    card = F.char_length(digits).between(14, 19)
    at = {k: i for i, k in enumerate(ORDER)}
    return F.when(kind == at["ip"], small).when(kind == at["card"], F.when(card, _luhn(digits)).otherwise(False)).when(kind == at["phone"], F.char_length(digits).between(10, 15)).otherwise(True)


def _placed(found: DataFrame) -> DataFrame:
    """Start and end of the matches of (doc_id, h, kind, i, gap, match); the rows of a repeated document count once."""
    by = Window.partitionBy(*KEYS, "kind").orderBy("i")
    once = found.repartition(*KEYS).groupBy(*KEYS, "kind", "i").agg(F.first("gap").alias("gap"), F.first("match").alias("match"))
    end = F.sum(F.col("gap") + F.char_length("match")).over(by)
    return once.select(*KEYS, "kind", (end - F.char_length("match")).cast("int").alias("start"), end.cast("int").alias("end"), "match")


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, h, kind, start, end, match) of all patterns that pass, kind as its place in ORDER."""
    text = F.col("text")
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").where(F.col("text").rlike(MAY_HOLD))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,match:string>>")
    # card and ip need digits, which MAY_HOLD has looked for; the other two need their sign
    all_kinds = [F.when(text.contains(sign), _matches(text, k, KINDS[k])).otherwise(none) if sign else _matches(text, k, KINDS[k]) for k, sign in (("email", "@"), ("ip", ""), ("card", ""), ("phone", "+"))]
    found = rows.select(*KEYS, F.explode(F.concat(*all_kinds)).alias("m")).select(*KEYS, "m.*")
    return _placed(found).where(_passes(F.col("kind"), F.col("match")))


def disclosing_terms(docs: DataFrame, spans: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(kind, entity, term, together, with_term, share): terms whose information about an entity reaches ``disclosure`` of its own.

    Counted over all documents, whole texts: ``together`` those with both, ``with_term`` those with the term. Rows with equal
    doc_id and text are one document; only terms that meet an entity in ``support`` different texts count.
    """
    held = spans.select(*KEYS, "kind", F.lower("match").alias("entity")).distinct()
    entities = held.groupBy("kind", "entity").agg(F.count("*").alias("with_entity"), F.count_distinct("h").alias("texts")).where(F.col("texts") >= support).drop("texts")
    known = stored(held.join(entities, ["kind", "entity"]))
    copies = stored(docs.select("doc_id", F.xxhash64("text").alias("h")).groupBy(*KEYS).agg(F.count("*").alias("rows")))
    total = copies.count()
    repeated = copies.where("rows > 1").withColumnsRenamed({"doc_id": "own_id", "h": "own_h"})  # mostly empty
    most = known.agg(F.max("with_entity")).first()[0] or 0
    bound = lambda n: F.pow(F.lit(float(total)), 1.0 - disclosure) * F.pow(n, disclosure) + 1e-6
    once = docs.select("doc_id", F.xxhash64("text").alias("h"), _terms(whole_text()).alias("terms"))
    each = once.join(repeated, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("h") == F.col("own_h")), "left")
    spread = each.select((1.0 / F.coalesce("rows", F.lit(1))).alias("part"), F.explode("terms").alias("term")).groupBy("term").agg(F.round(F.sum("part")).cast("long").alias("with_term"))
    rare = spread.where((F.col("with_term") >= support) & (F.col("with_term") <= bound(F.lit(float(most)))))
    docs_of = known.select(*KEYS).distinct().withColumnsRenamed({"doc_id": "own_id", "h": "own_h"})
    met = once.join(docs_of, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("h") == F.col("own_h")), "left_semi").select(*KEYS, F.explode("terms").alias("term")).distinct().join(rare, "term")
    named = known.withColumnsRenamed({"doc_id": "own_id", "h": "own_h"})
    pairs = met.join(named, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("h") == F.col("own_h"))).where(F.col("with_term") <= bound(F.col("with_entity")))
    counted = pairs.groupBy("kind", "entity", "term").agg(F.count("*").alias("together"), F.count_distinct("h").alias("texts"), F.first("with_entity").alias("with_entity"), F.first("with_term").alias("with_term")).where(F.col("texts") >= support)
    know = F.log2(F.lit(float(total)) / F.col("with_entity"))
    told = F.log2(F.col("together") * F.lit(float(total)) / (F.col("with_entity") * F.col("with_term")))
    share = F.when(know > 0, told / know).otherwise(0.0)
    return counted.withColumn("share", share).where(F.col("share") >= disclosure - 1e-12).select("kind", "entity", "term", "together", "with_term", "share")


SPANS = "array<struct<start:int,kind:int,end:int>>"


def _term_spans(text: Column, terms: Column) -> Column:
    """Spans of the words of a text that are among ``terms``."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))

    def step(s: Column, m: Column) -> Column:
        start = s["at"] + m["gap"]
        end = start + F.char_length(m["match"])
        span = F.struct(start.cast("int").alias("start"), F.lit(ORDER.index("term")).alias("kind"), end.cast("int").alias("end"))
        return F.struct(end.cast("int").alias("at"), F.when(F.array_contains(terms, F.lower(m["match"])), F.concat(s["found"], F.array(span))).otherwise(s["found"]).alias("found"))

    return F.aggregate(_matches(text, "term", TERM), first, step, lambda s: s["found"])


def all_spans(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(doc_id, h, spans): the matches, and the disclosing terms wherever they stand; h is xxhash64 of the text. Documents without any are left out."""
    base = stored(base_spans(docs))
    telling = stored(disclosing_terms(docs, base, disclosure, support).select("term").distinct())
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").where("text is not null")
    hits = rows.select(*KEYS, F.explode(_terms(F.col("text"))).alias("term")).join(telling, "term")
    named = stored(hits.groupBy(*KEYS).agg(F.collect_set("term").alias("terms")))  # words of one text
    marked = rows.join(named, same_row(rows, named, KEYS)).select(rows["doc_id"], rows["h"], _term_spans(F.col("text"), F.col("terms")).alias("spans"))
    terms = marked.groupBy(*KEYS).agg(F.first("spans").alias("spans"))  # a repeated document counts once
    matches = base.groupBy(*KEYS).agg(F.collect_list(F.struct("start", "kind", "end")).alias("spans"))
    both = matches.unionByName(terms).groupBy(*KEYS).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return both.select(*KEYS, F.array_sort("spans").alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end joined by commas, of an array of (start, kind, end) in order."""
    name = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_spans(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """Every document (row, doc_id, text) with spans: array of (start, kind, end), by start, then kind; empty where there are none.

    ``row`` is the whole row. A null text counts as empty. Repeated rows each come back, with the same spans.
    """
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("h"), "text")
    found = all_spans(docs, disclosure, support)
    both = rows.join(found, same_row(rows, found, KEYS), "left")
    return both.select("row", rows["doc_id"], "text", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def sanitised(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """``docs`` with their texts sanitised: [EMAIL], [IP], [CARD] and [PHONE] for the matches, [TERM] for telling terms.

    Of spans that overlap the first stands, and the others are left out where it covers them.
    """
    marked = with_spans(docs, disclosure, support)
    label = F.array(*[F.lit(f"[{k.upper()}]") for k in ORDER])
    start = F.struct(F.lit("").alias("made"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substr(F.col("text"), s["at"] + 1, x["start"] - s["at"])
        return F.when(x["start"] < s["at"], F.struct(s["made"].alias("made"), F.greatest(s["at"], x["end"]).alias("at"))).otherwise(F.struct(F.concat(s["made"], gap, F.get(label, x["kind"])).alias("made"), x["end"].alias("at")))

    made = F.aggregate("spans", start, step, lambda s: F.concat(s["made"], F.substr(F.col("text"), s["at"] + 1, F.char_length("text"))))
    text = F.when(F.size("spans") > 0, made).otherwise(F.col("text"))
    return marked.select(*[text.alias(c) if c.lower() == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
