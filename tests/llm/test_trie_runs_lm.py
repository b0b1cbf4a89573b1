"""The prefix trie, periodic runs and language-model scores against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import lmscore, periods, prefixtrie
from plumbline.llm import queries as Q

SPACE = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, runs string, score string, block string"


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


@pytest.fixture(scope="module")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, an id twice, and columns named as the operators name theirs."""
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    rows = [(1, None, None, "r", "s", "b"), (2, "", "en", None, "s", "b"), (3, " \n ", "en", "r", None, "b"), (4, long, "en", "r", "s", "b"), (4, long, "en", "r", "s", "b"), (5, "one " * 20, "de", "r", "s", "b"), (5, "a\x0bB a\tb\x1fc", None, "r", "s", "b"), (None, "no id here", "en", "r", "s", None)]
    return spark.createDataFrame(rows, SCHEMA)


# periodic runs


def brute_runs(s, least):
    found = set()
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            length, part = j - i + q, s[i : j + q]
            if length >= max(least, 2 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                found.add((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def some_words(rng, most):
    n, k = rng.randint(0, most), rng.choice([1, 2, 2, 3, 5, 30])
    s = [rng.randrange(k) for _ in range(n)]
    if n > 10 and rng.random() < 0.5:
        a, p = rng.randrange(n), rng.randint(1, 12)
        s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)] if a + p < n else s
    return s


def test_runs_of_words():
    rng = random.Random(5)
    for _ in range(600):
        s = some_words(rng, 70)
        assert [tuple(r) for r in periods.runs(np.array(s, np.int64)).tolist()] == brute_runs(s, periods.LEAST), s
        if len(s) > 1:
            assert sorted(map(tuple, periods.tree_runs(s, 2).tolist())) == sorted(brute_runs(s, 2)), s


def test_extensions_and_minima():
    rng = random.Random(2)
    s = [rng.randrange(3) for _ in range(200)]
    tree = periods.SuffixTree([*s, periods.END])
    order = tree.tour()
    assert order == sorted(range(201), key=lambda i: [*s, periods.END][i:])
    i, j = np.triu_indices(200, 1)
    common = [next((k for k in range(200 - b) if s[a + k] != s[b + k]), 200 - b) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert tree.extension(i, j).tolist() == common
    values = np.array([rng.randrange(50) for _ in range(97)], np.int64)
    lo, hi = np.triu_indices(97)
    assert periods.Minima(values).between(lo, hi).tolist() == [values[a : b + 1].min() for a, b in zip(lo, hi, strict=True)]


def brute_op12(doc_id, text):
    words = words_of(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words, 12)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op12(spark, folder, documents):
    got = {r["doc_id"]: tuple(r) for r in Q.op12_periodic_run_detection(spark, folder).collect()}
    short = [r for r in documents.collect() if len(r["text"] or "") < 3000]  # brute force is quadratic
    assert len(got) == documents.count() and len(short) > 100
    assert any(brute_op12(r["doc_id"], r["text"])[1] for r in short)
    for r in short:
        assert got[r["doc_id"]] == brute_op12(r["doc_id"], r["text"])


def test_odd_texts_have_runs(odd, spark):
    rows = periods.find_runs(odd).collect()
    assert [f for f in rows[0].__fields__] == ["doc_id", "text", "lang", "score", "block", "runs", "collapsed"]
    found = sorted((r["doc_id"] or 0, r["text"] or "", [tuple(x) for x in r["runs"]], r["collapsed"]) for r in rows)
    by_id = [(i, runs) for i, _, runs, _ in found]
    assert by_id == [(0, []), (1, []), (2, []), (3, []), (4, [(0, 30_000, 700)]), (4, [(0, 30_000, 700)]), (5, []), (5, [(0, 20, 1)])]
    assert {c for i, t, _, c in found if i in (1, 2, 3)} == {""} and (5, "one " * 20, [(0, 20, 1)], "one") in found
    assert next(c for i, _, _, c in found if i == 4) == " ".join(f"w{i}" for i in range(700))
    assert periods.find_runs(spark.createDataFrame([], SCHEMA)).count() == 0


# prefix trie


def brute_trie(rows):
    conversations = {}
    for c, t, role, text in rows:
        if c is not None:
            conversations.setdefault(c, []).append(((t is not None, t or 0, role or ""), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v, key=lambda e: e[0])] for c, v in conversations.items()}
    made = {c: own.get(int(c / 100) * 100, [])[: zlib.crc32(str(c).encode()) % 6] + s[zlib.crc32(str(c).encode()) % 6 :] for c, s in own.items()}
    nodes, kids = {}, {}
    for c, s in made.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in kids.get(p, [])) or 1
        saved[p] = sum(saved[x] for x in kids.get(p, [])) + ((len(nodes[p]) - 1) * len(p[-1][1]) if p else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), len(kids.get(p, [])), leaves[p], saved[p], sha(c for c in m if len(made[c]) == len(p))) for p, m in nodes.items())


@pytest.mark.parametrize("width", [prefixtrie.WIDTH, 3])
def test_trie(spark, width):
    """Missing bases, conversations without turns left, many blocks, null turns, repeated rows, hot prefixes, clashing columns."""
    rng = random.Random(1)
    rows = []
    for c in [*range(130), *range(300, 330), -5, 1000, 1001, 1234]:
        shared = rng.randrange(3)
        for t in range(80 if c == 7 else rng.choice([1, 2, 3, 5, 9, 17, 30])):
            text = rng.choice(["a", "bb", None, "", "häß"]) if t > 3 + shared * 8 else f"x{t}"
            rows.append((c, t if t else None, None if t % 9 == 8 else "user", text))
    rows += [r for r in rows if r[0] == 8] + [(None, 1, "user", "no conversation")]
    df = spark.createDataFrame([(*r, "d", "l") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth string, leaf string")
    got = prefixtrie.rebuilt_trie(df, width).collect()
    assert sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in got) == brute_trie(rows)


def test_trie_of_nothing_and_long_ends(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert prefixtrie.rebuilt_trie(none).count() == 0
    ends = spark.range(10_000).select(F.lit(0).cast("long").alias("depth"), *[(F.col("id") % 2).cast("decimal(38,0)").alias(x) for x in ("ia", "ib")], F.col("id").alias("conv_id"))
    got = {int(r["ia"]): r["ends_sha256"] for r in prefixtrie._hashed_ends(ends, chunk=7).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, range(k, 10_000, 2))).encode()).hexdigest() for k in (0, 1)}


# language model


def brute_scores(texts, train, order, prior):
    """(n_tokens, n_known, base, score) of each text."""
    tokens = [[*words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for t in texts]
    c = Counter()
    for s, learnt in zip(tokens, train, strict=True):
        if learnt:
            for k in range(1, order + 1):
                c.update(tuple([" start", *s][i : i + k]) for i in range(len(s) + 2 - k))
    n = sum(len(s) for s, learnt in zip(tokens, train, strict=True) if learnt)
    v = len({w for s, learnt in zip(tokens, train, strict=True) if learnt for w in s})

    def share(h, w):
        if not h:
            return (c[(w,)] + 0.5) / (n + 0.5 * (v + 1))
        return (c[(*h, w)] + prior * share(h[1:], w)) / (c[h] + prior) if c[h] else share(h[1:], w)

    out = []
    for s in tokens:
        path = [" start", *s]
        out.append((len(s), sum(c[(w,)] > 0 for w in s), sum(math.log10(share((), w)) for w in s), sum(math.log10(share(tuple(path[max(0, i - order + 1) : i]), path[i])) for i in range(1, len(path)))))
    return out, n


@pytest.mark.parametrize(("order", "piece"), [(1, 4096), (2, 4096), (2, 5), (3, 4096), (3, 3)])
def test_automaton(documents, order, piece):
    rows = documents.limit(60).collect()
    texts = [r["text"] for r in rows] + [None, "", "zz  yy\x0bZZ never seen"]
    train = np.array([i % 5 != 1 for i in range(len(rows))] + [False] * 3)
    want, n = brute_scores(texts, train, order, 8.0)
    block = lmscore.Block([None if t is None else t.encode() for t in texts], train, order)
    block.fill(block.counts()[1])
    distinct = int((block.grams[0].count[1:] > 0).sum())
    machine = lmscore.Automaton(block, n, distinct, 8.0)
    assert machine.run(block, piece) == pytest.approx([w[3] for w in want], abs=1e-6)
    assert block.words(machine.base) == pytest.approx([w[2] for w in want], abs=1e-6)


@pytest.mark.parametrize(("order", "size"), [(2, 1 << 24), (2, 20_000), (3, 50_000)])
def test_scores_of_many_blocks(documents, order, size):
    rows = documents.select("doc_id", "text").collect()
    train = [zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1 for r in rows]
    want, n = brute_scores([r["text"] for r in rows], train, order, lmscore.PRIOR)
    learnt = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    got = {r["doc_id"]: r for r in lmscore.score_texts(documents, learnt, order=order, block_bytes=size, range_bytes=size).collect()}
    for r, w in zip(rows, want, strict=True):
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (w[0], w[1], n)
        assert (g["base_score"], g["score"]) == pytest.approx(w[2:], abs=1e-6)


def test_model_beats_words_on_held_out_texts(spark, folder):
    row = Q.op13_lm_scoring(spark, folder).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert row[0] > row[1]


def test_odd_texts_have_scores(odd, spark):
    got = lmscore.score_texts(odd, F.col("doc_id") == 4).collect()
    assert got[0].__fields__ == ["doc_id", "lang", "runs", "block", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert sorted(((r["doc_id"] or 0), r["n_tokens"], r["n_known"]) for r in got) == [(0, 4, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 30_001, 30_001), (4, 30_001, 30_001), (5, 5, 1), (5, 21, 1)]
    assert {r["train_tokens"] for r in got} == {60_002}
    unknown = lmscore.score_texts(odd, F.lit(None).cast("boolean")).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in unknown} == {(0, 0)}
    assert all(r["score"] == pytest.approx(r["base_score"]) for r in unknown)
    assert lmscore.score_texts(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
