"""The registered queries of the corpus operators, each over its whole table, and the SQL that some must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import chat, cws, decontam, langid, linededup, lmscore, packing, periods, pii, prefixtrie, quality, secrets, simhash
from plumbline.llm.common import held_out, let


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


WORD_TOKENIZER, PIECE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer_file(WORD_TOKENIZER)))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, tokenizer_file(PIECE_VOCABULARY))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is preferred to itself with its last answer broken off in the middle."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = turns.where(F.col("role") == chat.LEARNT).groupBy("pair_id").agg(F.max("turn").alias("last"))
    half = F.substr("text", F.lit(1), F.floor(F.char_length("text") / 2).cast("int"))
    broken = turns.join(last, "pair_id", "left").withColumn("text", F.when((F.col("role") == chat.LEARNT) & (F.col("turn") == F.col("last")), half).otherwise(F.col("text"))).drop("last")
    made = chat.preferences(turns, broken)
    return made.select("pair_id", "n_shared", "prompt", "chosen", chat.spans_text(F.col("chosen_mask")).alias("chosen_mask"), "rejected", chat.spans_text(F.col("rejected_mask")).alias("rejected_mask"), "usable")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < len(pii.KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)], F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.compare_edits(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [r.kind for r in secrets.RULES if r.base]
    base = F.filter("secrets", lambda s: s["kind"].isin(kinds))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in kinds], F.sha2(text(base), 256).alias("base_sha256"), text("secrets").alias("spans"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def with_periods(docs: DataFrame) -> DataFrame:
    """``docs`` where the words of every tenth text, by h = crc32 of its id, repeat with a period from some place on; a null id leaves its text."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        source = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, source(i))), " ")).otherwise(F.lit(""))

    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return docs.withColumn("text", F.when(h % 10 == 0, let(words, repeated)).otherwise(F.col("text")))


def op12_periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.find_runs(with_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    line = lambda r: F.concat_ws(",", *[r[x].cast("string") for x in ("start", "length", "period")])
    text = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    top = found.withColumn("top", periods.longest())
    return top.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.floor(F.col("top.length") * 1000 / F.col("top.period")).alias("exponent_milli"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are rounded to 6 digits, so that the order of a sum doesn't show."""
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    scored = lmscore.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(fifth == 1, F.lit(False)).alias("held_out")), ~F.col("held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_quality_classifier, op3_simhash_near_dedup, op4_line_dedup, op5_language_id, op6_chat_preferences, op7_pii, op8_benchmark_decontamination, op9_document_fingerprints, op10_secret_scan, op11_conversation_prefix_trie, op12_periodic_run_detection, op13_lm_scoring)
}


def crc32_sql(value: str) -> str:
    """The unsigned CRC-32 of a value's decimal text, bit by bit; for ASCII."""
    bits = f"flatten(list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda ch: [CAST(ord(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_concat([4294967295], {bits}), lambda s, x: xor(xor(s, x) >> 1, 3988292384 * (xor(s, x) & 1))), 4294967295)"


SQL = {
    "op4_line_dedup": """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
bare AS (SELECT *, trim(line, concat(' ', chr(9), chr(13), chr(11), chr(12))) AS b FROM lines),
docs AS (
  SELECT doc_id, list(b ORDER BY pos) AS bs, list(length(b) - length(replace(b, ' ', '')) + 1 ORDER BY pos) AS ns, list(pos ORDER BY pos) AS poss FROM bare WHERE b <> '' GROUP BY doc_id),
starts AS (SELECT *, unnest(range(1, len(bs) + 1)) AS i FROM docs),
sizes AS (
  SELECT *, list_filter(range(1, 11), lambda k: i + k - 1 <= len(ns) AND list_sum(ns[i:i + k - 1]) >= 10)[1] AS f,
            list_filter(range(1, 11), lambda k: i - k + 1 >= 1 AND list_sum(ns[i - k + 1:i]) >= 10)[1] AS g FROM starts),
windows AS (
  SELECT doc_id, i AS first, bs[i:i + f - 1] AS content, poss[i:i + f - 1] AS pos FROM sizes WHERE f IS NOT NULL
  UNION SELECT doc_id, i - g + 1, bs[i - g + 1:i], poss[i - g + 1:i] FROM sizes WHERE g IS NOT NULL),
again AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY content ORDER BY doc_id, first) AS r FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(pos) AS pos FROM again WHERE r > 1),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text, count(g.pos) AS n FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, CAST(coalesce(k.n, 0) AS INT) AS n_removed FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    "op6_chat_preferences": """
WITH turns AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
         max(turn) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id) AS last FROM conversations),
both_sides AS (
  SELECT *, CASE WHEN role = 'assistant' AND turn = last THEN substr(text, 1, CAST(floor(length(text) / 2) AS INT)) ELSE text END AS cut FROM turns),
parted AS (
  SELECT *, coalesce(min(CASE WHEN text IS DISTINCT FROM cut THEN pos END) OVER (PARTITION BY conv_id), 1000000000) AS first,
         concat('<|', coalesce(role, ''), '|>', chr(10)) AS head, concat(chr(10), '<|end|>', chr(10)) AS tail FROM both_sides),
rendered AS (
  SELECT *, concat(head, coalesce(text, ''), tail) AS c, concat(head, coalesce(cut, ''), tail) AS r FROM parted),
placed AS (
  SELECT *, coalesce(sum(CASE WHEN pos >= first THEN length(c) END) OVER w, 0) AS ce, coalesce(sum(CASE WHEN pos >= first THEN length(r) END) OVER w, 0) AS re
  FROM rendered WINDOW w AS (PARTITION BY conv_id ORDER BY pos))
SELECT conv_id AS pair_id, CAST(count(*) FILTER (WHERE pos < first) AS INT) AS n_shared,
  coalesce(string_agg(c, '' ORDER BY pos) FILTER (WHERE pos < first), '') AS prompt,
  coalesce(string_agg(c, '' ORDER BY pos) FILTER (WHERE pos >= first), '') AS chosen,
  coalesce(string_agg(concat(CAST(ce - length(c) + length(head) AS BIGINT), '-', CAST(ce AS BIGINT)), ',' ORDER BY pos) FILTER (WHERE pos >= first AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(r, '' ORDER BY pos) FILTER (WHERE pos >= first), '') AS rejected,
  coalesce(string_agg(concat(CAST(re - length(r) + length(head) AS BIGINT), '-', CAST(re AS BIGINT)), ',' ORDER BY pos) FILTER (WHERE pos >= first AND role = 'assistant'), '') AS rejected_mask,
  count(*) FILTER (WHERE pos >= first AND role = 'assistant') > 0 AS usable
FROM placed GROUP BY conv_id""",
    "op11_conversation_prefix_trie": f"""
WITH own AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (
  SELECT o.conv_id, list_concat(CASE WHEN b.turns IS NULL THEN [] ELSE b.turns[1:o.h] END, o.turns[o.h + 1:]) AS s
  FROM (SELECT *, CAST({crc32_sql("conv_id")} % 6 AS BIGINT) AS h FROM own) o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
prefixes AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM rebuilt),
members AS (SELECT conv_id, depth, s[1:depth] AS p, CASE WHEN depth > 0 THEN length(s[depth].t) ELSE 0 END AS n, len(s) = depth AS done FROM prefixes),
nodes AS (
  SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE done), '')) AS ends_sha256 FROM members GROUP BY p, depth),
children AS (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
full_nodes AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.p = c.p AND n.depth = c.depth),
up AS (SELECT *, unnest(range(0, depth + 1)) AS above FROM full_nodes),
sums AS (SELECT p[1:above] AS p, above AS depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY 1, 2)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON s.p = n.p AND s.depth = n.depth LEFT JOIN nodes q ON q.depth = n.depth - 1 AND q.p = n.p[1:n.depth - 1]""",
    "op13_lm_scoring": f"""
WITH texts AS (
  SELECT doc_id, {crc32_sql("doc_id")} % 5 = 1 AS held_out, list_concat([' start'], list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''), [' stop']) AS l FROM documents),
pairs AS (SELECT doc_id, held_out, unnest(l[1:len(l) - 1]) AS u, unnest(l[2:]) AS w FROM texts),
words AS (SELECT w, count(*) AS c FROM pairs WHERE NOT held_out GROUP BY w),
contexts AS (SELECT u, count(*) AS c FROM pairs WHERE NOT held_out GROUP BY u),
both_words AS (SELECT u, w, count(*) AS c FROM pairs WHERE NOT held_out GROUP BY u, w),
totals AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM words),
shares AS (
  SELECT p.doc_id, p.held_out, n, coalesce(words.c, 0) > 0 AS known, (coalesce(words.c, 0) + 0.5e0) / (n + 0.5e0 * (v + 1)) AS share, coalesce(contexts.c, 0) AS cu, coalesce(both_words.c, 0) AS cuw
  FROM pairs p CROSS JOIN totals LEFT JOIN words ON words.w = p.w LEFT JOIN contexts ON contexts.u = p.u LEFT JOIN both_words ON both_words.u = p.u AND both_words.w = p.w)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE known) AS n_known, max(n) AS train_tokens, round(sum(log10(share)), 6) AS base_score,
  round(sum(log10(CASE WHEN cu > 0 THEN (cuw + {lmscore.PRIOR}e0 * share) / (cu + {lmscore.PRIOR}e0) ELSE share END)), 6) AS score
FROM shares GROUP BY doc_id, held_out""",
}
