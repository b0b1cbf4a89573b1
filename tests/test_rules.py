"""Rules that find their columns and run, and near-duplicate rows of wide tables, against brute force."""

import math
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.operators import history, nearrows, nearsubsets, rulebook, rules, subwords
from plumbline.sources.readers import load_rules

CATALOGUE = str(Path(history.__file__).parent.parent / "data" / "default_rules.json")
FITTING = {
    "customer_id": "key_unique", "first_name": "required_fields", "email": "email_shape", "phone": "phone_signs", "age": "age_span", "salary": "amount_floor", "signup_date": "not_in_future",
    "created_at": "not_in_future", "country": "few_categories", "category": "few_categories", "price": "amount_floor", "discountRate": "percent_span", "quantity": "within_deviations",
    "order_status": "few_categories", "birth_date": "not_in_future", "end_date": "end_after_start", "product_id": "parent_exists", "description": "text_encoding", "total_amount": "amount_floor",
}


@pytest.fixture(scope="module")
def default_rules(spark):
    return load_rules(spark, CATALOGUE)


def test_shipped_rules_find_their_columns(spark, default_rules):
    columns = spark.createDataFrame([(x,) for x in [*FITTING, "zqx"]], "column string")
    got = {}
    for r in rulebook.rules_for_columns(columns, default_rules).collect():
        got.setdefault(r["column"], set()).add(r["rule_id"])
    assert all(want in got[column] for column, want in FITTING.items())
    assert "zqx" not in got
    assert default_rules.select("kind").distinct().count() >= 14 and {r["kind"] for r in default_rules.collect()} <= set(rulebook.KINDS)


def brute_parts(text):
    import re

    out = Counter()
    for t in re.findall(r"[^\W_]+", text.lower()):
        for pattern, to in subwords.STEMS:
            if re.search(pattern, t):
                t = re.sub(pattern, to.replace("$1", r"\1"), t)
                break
        out["=" + t] += 0.5
        framed = f"^{t}$"
        for i in range(len(t)):
            out[framed[i : i + 3]] += 0.5 / len(t)
    return out


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.7])
def test_subwords_equal_all_pairs(spark, threshold):
    rng = random.Random(4)
    words = "age ages price prices customer customers id identifier country countries processed processing the the the dates boxes a".split()
    texts = {f"t{i:03}": " ".join(["the"] + rng.choices(words, k=rng.randint(0, 6))) for i in range(120)}
    asked = {f"q{i}": " ".join(rng.choices([*words, "unseen"], k=rng.randint(1, 4))) for i in range(40)} | {"hot": "the", "none": "..."}
    held = {d: set(brute_parts(t)) for d, t in texts.items()}
    df = Counter(p for s in held.values() for p in s)
    want = {}
    for q, t in asked.items():
        weights = {p: s * (math.log((1 + len(texts)) / (1 + df[p])) + 1) for p, s in brute_parts(t).items()}
        whole = sum(weights.values())
        scores = [(round(sum(w for p, w in weights.items() if p in held[d]) / whole, 12), d) for d in texts] if whole else []
        want[q] = [(d, s) for s, d in sorted(((s, d) for s, d in scores if s > 0 and s >= threshold - 1e-9), key=lambda x: (-x[0], x[1]))[:5]]
    q = spark.createDataFrame([*asked.items(), ("null", None)], "q string, text string")
    d = spark.createDataFrame([*texts.items(), ("null", None)], "d string, text string")
    got = {}
    for r in subwords.subword_top_k(q, d.where("text is not null"), "q", "text", "d", "text", 5, threshold).orderBy("q", "place").collect():
        got.setdefault(r["q"], []).append((r["d"], round(r["similarity"], 12)))
    for name in asked:
        assert [x for x, _ in got.get(name, [])] == [x for x, _ in want[name]]
        assert [s for _, s in got.get(name, [])] == pytest.approx([s for _, s in want[name]])


def test_common_terms_are_not_joined(spark):
    """A part that all texts hold is looked up only by a question that holds nothing rarer."""
    texts = spark.range(2000).select(F.col("id").alias("d"), F.concat(F.lit("column word"), F.col("id").cast("string")).alias("text"))
    asked = spark.createDataFrame([("q", "column word77")], "q string, text string")
    assert [r["d"] for r in subwords.subword_top_k(asked, texts, "q", "text", "d", "text", 1, 0.6).collect()] == [77]


def test_every_kind_runs(spark, default_rules):
    rows = [(1, "a@b.co", "+33 1", 5.0, 20, 10.0, "2024-01-01", "2024-01-02", "x", 1), (1, "bad", "1-AB", -5.0, 200, 120.0, "2024-01-05", "2024-01-02", "caf�", 9), (3, None, None, None, None, None, None, None, None, None), (4, "N/A", "+33 1", 5.0, 20, 10.0, "2024-01-01", "2099-01-02", "x", 1), (5, "", "+33 1", 5.0, 20, 10.0, "2024-01-01", "2024-01-02", "x", 1)]
    rows += [(10 + i, f"u{i}@b.co", "1", 5.0, 20, 10.0, "2024-01-01", "2024-01-02", f"n{i}", 2) for i in range(15)] + [(30, "z@b.co", "1", 900.0, 20, 10.0, "2024-01-01", "2024-01-02", "n99", 2)]
    df = spark.createDataFrame(rows, "id int, email string, phone string, amount double, age int, rate double, opened string, closed string, note string, parent int")
    df = df.withColumns({x: F.to_timestamp_ntz(x, F.lit("yyyy-MM-dd")) for x in ("opened", "closed")})
    bindings = {
        "key_unique": ["id"], "required_fields": ["email"], "missing_share": ["email"], "email_shape": ["email"], "phone_signs": ["phone"], "amount_floor": ["amount"], "age_span": ["age"], "percent_span": ["rate"],
        "end_after_start": ["closed"], "not_in_future": ["closed"], "text_encoding": ["note"], "few_categories": ["note"], "within_deviations": ["amount"], "parent_exists": ["parent"], "near_copies": ["phone", "amount", "age", "rate", "opened", "closed", "note", "parent"],
    }
    low = default_rules.withColumn("params", F.when(F.col("kind") == "cardinality", F.create_map(F.lit("limit"), F.lit("3"))).when(F.col("kind") == "null_share", F.create_map(F.lit("limit"), F.lit("0.01"))).otherwise(F.col("params")))
    options = dict(as_of="2030-01-01 00:00:00", starts={"closed": "opened"}, parents={"parent": (spark.createDataFrame([(1,), (2,)], "k int"), "k")}, block=[])
    got = {(r["rule_id"], r["column"]): r["violations"] for r in rulebook.rule_counts(df, low, bindings, **options).collect()}
    assert got == {
        ("key_unique", "id"): 1, ("required_fields", "email"): 2, ("missing_share", "email"): 1, ("email_shape", "email"): 3, ("phone_signs", "phone"): 1, ("amount_floor", "amount"): 1, ("age_span", "age"): 1, ("percent_span", "rate"): 1,
        ("end_after_start", "closed"): 1, ("not_in_future", "closed"): 1, ("text_encoding", "note"): 1, ("few_categories", "note"): 18, ("within_deviations", "amount"): 1, ("parent_exists", "parent"): 1, ("near_copies", None): 2,
    }
    issues = rulebook.run_rules(df, low, bindings, **options).collect()
    assert len(issues) == 15 and {i["issue_type"] for i in issues} == {"constraint_violation"}
    with pytest.raises(ValueError, match="lacks its argument"):
        rulebook.rule_counts(df, low, bindings)
    with pytest.raises(ValueError, match="kinds are"):
        rulebook.rule_counts(df, low.withColumn("kind", F.lit("magic")), bindings, **options)
    assert {r["violations"] for r in rulebook.rule_counts(df.limit(0), low, bindings, **options).collect()} == {0}


def brute_partners(rows, block, least):
    counts = Counter(rows)
    out = {}
    for a, n in counts.items():
        same = sum(k for b, k in counts.items() if b[:block] == a[:block] and sum(x == y for x, y in zip(a[block:], b[block:], strict=True)) >= least) - 1
        if same:
            out[a] = (n, same)
    return out


@pytest.mark.parametrize(("m", "ratio", "posting", "tile"), [(50, 0.9, 2000, 1000), (50, 0.9, 5, 7), (12, 0.5, 3, 4), (6, 0.2, 1, 2), (5, 1.0, 2, 2)])
def test_wide_near_duplicates(spark, m, ratio, posting, tile):
    rng = random.Random(m)
    bases = [[rng.randrange(40) for _ in range(m)] for _ in range(6)]
    rows = []
    for _ in range(250):
        row = list(rng.choice(bases))
        for i in rng.sample(range(m), min(m, rng.randint(0, max(1, round(m * (1 - ratio)) + 2)))):
            row[i % m] = rng.choice([None, rng.randrange(40)])
        rows.append((rng.choice([1, None]), *row))
    rows += rows[:10]
    names = [f"c{i}" for i in range(m)]
    df = spark.createDataFrame(rows, "g int, " + ", ".join(f"{x} int" for x in names))
    least = math.ceil(ratio * m - 1e-9)
    folded = df.groupBy("g", *names).agg(F.count(F.lit(1)).alias("copies"))
    got = {tuple(r)[:-2]: (r["copies"], r["partners"]) for r in nearrows.wide_near_duplicates(folded, ["g"], names, least, posting, tile).collect()}
    assert got == brute_partners(rows, 1, least)
    if m == 50 and posting == 2000:
        assert {tuple(r)[:-2]: (r["copies"], r["partners"]) for r in rules.near_duplicates(df, ["g"], names, ratio).collect()} == got


@pytest.mark.parametrize(("m", "ratio", "blocks", "group"), [(4, 0.75, 1, 1000), (4, 0.75, 1, 20), (10, 0.7, 0, 1000), (10, 0.7, 0, 6), (5, 0.2, 2, 1), (3, 1.0, 0, 2)])
def test_near_duplicates_by_subsets(spark, m, ratio, blocks, group):
    rng = random.Random(m + group)
    bases = [[rng.randrange(9) for _ in range(m)] for _ in range(8)]
    rows = []
    for _ in range(300):
        row = [float(x) if i == 0 else f"{'long ' * 20}{x}" if i == 1 else x for i, x in enumerate(rng.choice(bases))]
        for i in rng.sample(range(m), rng.randint(0, m - 1)):
            row[i] = None if rng.random() < 0.2 else rng.choice([0.0, 1.5, -7.0]) if i == 0 else str(rng.randrange(3)) if i == 1 else rng.randrange(5)
        rows.append((*[rng.choice([1, 2, None]) for _ in range(blocks)], *row))
    rows += rows[:40]
    by, names = [f"g {i}" for i in range(blocks)], [f"c{i}" for i in range(m)]
    kinds = [*["int"] * blocks, "double", "string", *["int"] * (m - 2)]
    schema = ", ".join(f"`{x}` {k}" for x, k in zip([*by, *names], kinds, strict=True))
    signed = [tuple(-0.0 if x == 0.0 and isinstance(x, float) and rng.random() < 0.5 else x for x in r) for r in rows]
    got = nearsubsets.near_duplicates_by_subsets(spark.createDataFrame(signed, schema), by, names, math.ceil(ratio * m - 1e-9), group).collect()
    assert {tuple(r)[:-2]: (r["copies"], r["partners"]) for r in got} == brute_partners(rows, blocks, math.ceil(ratio * m - 1e-9))
    assert len(got) == len({tuple(r)[:-2] for r in got})


def test_near_duplicates_travel_once(spark):
    """Rows of a block are counted where they lie, not sent once for each subset; times are compared to the microsecond, NaN is NaN."""
    df = spark.range(40).selectExpr("id % 4 as g", "timestamp_micros(id div 4) as t", "id % 5 as a", "id % 7 as b", "cast('NaN' as double) as x")
    found = rules.near_duplicates(df, ["g"], ["t", "a", "b", "x"], 0.75)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    rows = [(r["g"], r["t"], r["a"], r["b"], "nan") for r in df.collect()]
    want = brute_partners(rows, 1, 3)
    assert {(r["g"], r["t"], r["a"], r["b"], "nan"): (r["copies"], r["partners"]) for r in found.collect()} == want
