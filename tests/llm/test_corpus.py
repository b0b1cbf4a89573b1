"""Corpus operators against brute force, round trips, held-out accuracy and their SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from compare import compare
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import chat, components, cws, decontam, langid, linededup, packing, pii, quality, secrets, simhash
from plumbline.llm import queries as Q
from plumbline.llm.common import held_out

WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, row string, h string"


@pytest.fixture(scope="module")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, an id twice, and columns named as the operators name theirs."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, None, "r", "h"), (2, "", "en", None, "h"), (3, "  \n ", "en", "r", None), (4, long, "en", "r", "h"), (4, long, "en", "r", "h"), (5, "one", "de", "r", "h"), (5, "other words", None, "r", "h"), (None, "no id here at all", "en", "r", "h")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", list(Q.SQL))
def test_sql(spark, folder, name):
    ok, message = compare(spark, folder, name, Q.QUERIES[name], Q.SQL[name])
    assert ok, message


def fingerprint(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def roots(ids, linked):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("posting", [simhash.POSTING, 1])
def test_simhash_components(documents, texts, posting):
    want = {i: fingerprint(t) for i, t in texts.items()}
    near = roots(want, [(a, b) for a in want for b in want if a < b and (want[a] ^ want[b]).bit_count() <= 3])
    got = simhash.near_duplicates(documents, posting=posting).select("doc_id", simhash.hex_digits(F.col("fp")).alias("fp"), "component_id").collect()
    assert {r["doc_id"]: r["fp"] for r in got} == {i: f"{x:016x}" for i, x in want.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == near


def test_byte_index_meets_every_near_pair():
    rng = np.random.default_rng(1)
    for _ in range(2000):
        a = int(rng.integers(1 << 63))
        b = a
        for bit in rng.choice(64, 3, replace=False):
            b ^= 1 << int(bit)
        assert any((a ^ b) & simhash._mask(c, 8) == 0 for c in simhash.INDEXED)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    assert {r["node"]: r["root"] for r in components.components(edges).collect()} == {**{i: 0 for i in range(1, 61)}, 101: 100}


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.mark.parametrize("group", [simhash.GROUP, 2])
def test_near_copies(documents, texts, group):
    kept = {r["doc_id"] for r in simhash.drop_near_copies(documents, group=group).collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in texts for b in texts if a < b}
    must = roots(texts, [p for p, x in like.items() if x >= 0.8])
    may = roots(texts, [p for p, x in like.items() if x >= 0.55])
    assert all(sum(m in kept for m in texts if must[m] == g) <= 1 for g in set(must.values()))
    assert all(g in kept for g in set(may.values()))


@pytest.mark.parametrize("group", [simhash.GROUP, 2])
def test_near_copies_by_exact_similarity(spark, group):
    """Copies with words replaced, at similarities of 0.69 to 0.93, and one in which a passage comes ten times as often."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        w = [f"w{x}" for x in rng.integers(0, 1 << 40, 304)]
        changed = list(w)
        for k in range(2 + i % 9):
            changed[10 + 30 * k] = f"other{i}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(changed) if i else " ".join(w[:2] * 200 + w)), (1000 + i, " ".join(w[:2] * 2 + w) if not i else None)]
    texts = {i: t for i, t in rows if t}
    sets = {i: shingles(t) for i, t in texts.items()}
    near = [(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    assert 30 < len(near) < 60
    got = {r["doc_id"] for r in simhash.drop_near_copies(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), group=group).collect()}
    assert got == set(roots(texts, near).values())


def test_pipeline_drops_what_fingerprints_link(spark, documents, texts):
    """Near-dedup links by the fingerprints of the byte index, and by similarity: a passage repeated another number of times differs in few bits but shares little of its set."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(40):
        w = [f"w{x}" for x in rng.integers(0, 1 << 40, 30)]
        rows += [(3 * i, " ".join(w * 12)), (3 * i + 1, " ".join(w * 12 + [f"e{x}" for x in rng.integers(0, 1 << 40, 6 + i % 8)]))]
    rows += [(1000 + 2 * i, t) for i, t in enumerate(texts.values())] + [(None, None), (5000, ""), (5001, " \n")]
    made = {i: t or "" for i, t in rows}
    order = sorted(made, key=lambda i: (i is not None, i))
    prints, sets = {i: fingerprint(t) for i, t in made.items()}, {i: shingles(t) for i, t in made.items()}
    at = {i: k for k, i in enumerate(order)}
    bits = [(at[a], at[b]) for a in order for b in order if at[a] < at[b] and (prints[a] ^ prints[b]).bit_count() <= 3]
    alike = [(at[a], at[b]) for a in order for b in order if at[a] < at[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    want = {order[x] for x in set(roots(at.values(), bits + alike).values())}
    assert len(want) < len(set(roots(at.values(), alike).values()))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(got, key=lambda i: (i is not None, i)) == sorted(want, key=lambda i: (i is not None, i))


def test_packing(documents, texts):
    rows = packing.pack(packing.token_pieces(documents, WORDS, keep_ids=True))
    got = rows.collect()
    encode = Tokenizer.from_file(WORDS)
    ids = {i: [*encode.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, want in ids.items():
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts))) and sum((r["ids"] for r in parts), []) == want
        assert all(r["length"] == 2048 for r in parts[:-1])
        assert all(zlib.crc32(np.array(want[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for r in parts)
    for parts in by_sequence.values():
        end = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 2048
    total = sum(map(len, ids.values()))
    assert len(by_sequence) <= -(-total // 2048) + 1
    assert packing.sequences(rows).agg(F.sum(F.size("ids"))).first()[0] == total


def test_fullest_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(200):
        counts = {int(x): int(rng.integers(1, 4)) for x in rng.integers(1, 40, 6)}
        room = int(rng.integers(1, 90))
        reach = {0}
        for length, n in counts.items():
            reach = {s + k * length for s in reach for k in range(n + 1) if s + k * length <= room}
        chosen = packing.fullest(counts, room)
        assert sum(x * n for x, n in chosen) == max(reach) and all(n <= counts[x] for x, n in chosen)


def test_word_ids_are_the_tokenizers():
    ids_of, plain = packing.WordIds(WORDS), Tokenizer.from_file(WORDS)
    for t in ["end <|endoftext|> x<|STARTOFTEXT|>y", "<|endoftext|><|startoftext|>", "<|endoftext| >", "It's Ünïcode, naïve!!  x²½ 12.5\tİstanbul", "漢字 ﬁ Σς", "<|endoftext|> '", "", "ÉÀ'll_re'VE", "\x1c a\x85b"]:
        assert list(ids_of(t)) == plain.encode(t, add_special_tokens=False).ids


def test_language_held_out(spark, documents):
    model = langid.fit(documents, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    got = langid.predict(documents, model).where(held_out()).select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert got >= 0.97


def test_letters_are_what_fitting_takes():
    assert langid.letter_runs("½ ² ① 3 _") == langid.letter_runs(None) == langid.letter_runs("") == []
    assert langid.letter_runs("Ab½cd, É²é_x1y 漢字 ǅ") == ["ab", "cd", "é", "é", "x", "y", "漢字", "ǆ"]


def test_texts_without_letters_are_undetermined(spark, documents):
    model = langid.fit(documents, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    odd = spark.createDataFrame([(1, "½"), (2, "² ① 3"), (3, None), (4, "und so weiter")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in langid.predict(odd, model).orderBy("doc_id").collect()] == [True, True, True, False]


def test_forward_sums_all_segmentations():
    pieces = {b" ": 0, b"a": 1, b"b": 2, b"ab": 3, b" a": 4}
    prob = np.array([[0.1], [0.2], [0.3], [0.25], [0.15]])
    want = 0.1 * 0.2 * 0.3 + 0.15 * 0.3 + 0.1 * 0.25
    assert np.isclose(np.exp(langid.word_scores([b" ab"], pieces, prob, langid._scaled(prob, pieces)))[0, 0], want)
    word = b" " + b"ab" * 40
    longer = langid._long_word(word, pieces, np.log(prob))
    with np.errstate(divide="ignore"):
        assert np.allclose(np.log(langid._forward(langid._lattice([word], pieces), langid._scaled(prob, pieces))[:, len(word)]) - langid.GAIN * len(word), longer)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = Q.op2_quality_classifier(spark, sf).where("held_out").join(labels, "doc_id").select("score", "quality").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() >= 0.9


def test_decontamination(spark, documents, texts, folder):
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    want = {(i, r["item_id"]) for r in bench.collect() for i, t in texts.items() if " ".join(r["text"].lower().split()) in " ".join(t.lower().split())}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(documents, bench).collect()}
    assert want and want <= got
    assert got == {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(documents, bench, keys_held=100).collect()}


def test_decontamination_of_changed_slots(spark):
    ask = "A farmer named Anna sells 12 kg of apples to her friend Boris and keeps 5 kg of pears for the winter months at home"
    bench = spark.createDataFrame([(1, ask)], "item_id bigint, text string")
    rows = [(1, ask.replace("Anna", "Maria").replace("12", "40").replace("kg", "lb")), (2, ask.replace("of apples", "of ripe green apples").replace("keeps", "has")), (3, ask.replace("12 kg", "7 kg").replace("5 kg", "7 kg"))]
    got = [r["doc_id"] for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()]
    assert got == [1]  # the second has other words, the third fills two values of the item with one


def test_decontamination_of_parts_and_short_items(spark):
    words = [f"plain{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(59)]
    long = "a teller named Anna gave 12 coins to the old miller and the young baker came back for 12 more of the same coins before the night"
    sums = "3 + 4 * 5 = 23 and 23 - 9 = 14"
    names = "yesterday Anna Berg met Carl Dahl near Eton Fell and Gus Holm saw Ida Jung"
    bench = spark.createDataFrame([(1, " ".join(words)), (2, long), (3, "Capital of Freedonia"), (4, "7 19 23 31 44 58 62 71"), (5, sums), (6, names)], "item_id bigint, text string")
    rows = [(1, "before it " + " ".join(words[5:50]) + " after it"), (2, long.replace("12 more", "15 more")), (3, "what is the capital of Freedonia now"), (4, "so 7 19 23 31 44 58 62 71 it is"), (5, "freedonia of capital"), (6, names.lower()), (7, names.upper()), (8, " ".join(words[5:16]))]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (6, 6), (7, 6)}


def test_pii_base_and_terms(spark):
    rows = [(i, f"Contact zorblatt{'x' * i} our treasurer Quixanda at q.anda@mail.example.org or +44 (0)20 7946 0958; 10.0.0.{i} and 300.1.1.1, 4111 1111 1111 1111.") for i in range(5)]
    rows += [(100 + i, f"Plain text number {i} about our treasurer and nothing else, 1.2.3.4.5.6.7.8 a@b.c_d@e.f") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def passes(kind, m):
        digits = re.sub(r"\D", "", m)
        luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
        return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".") if x.isdigit()), "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]

    text = dict(rows)
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in pii.with_spans(docs).collect()}
    for i, t in text.items():
        want = sorted((m.start(), k, m.end()) for k, (name, p) in enumerate(kinds) for m in re.finditer(p, t) if passes(name, m[0]))
        assert [s for s in got[i] if s[1] < 4] == want
    told = {text[i][a:b].lower() for i, spans in got.items() for a, k, b in spans if k == 4}
    assert "quixanda" in told and "treasurer" not in told
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert "[EMAIL]" in clean[0] and "[TERM]" in clean[0] and "mail.example" not in clean[0] and "Quixanda" not in clean[0]


def test_telling_terms_equal_brute_force(spark):
    """Whole texts count, and a term is marked where its entity isn't: a far name, a name alone, a common word, repeated rows."""
    rng = random.Random(9)
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)]
    rows = []
    for i in range(260):
        text = " ".join(rng.choices(words, k=rng.randint(0, 30)))
        if i % 20 == 0:
            text = f"Quixanda Morbel {'filler ' * 60}{text} a.person@mail.example.org"
        if i % 45 == 1:
            text += " it was Quixanda again"
        if i % 25 == 3:
            text += f" call +44 20 7946 0958 zorbl{'x' if i > 100 else ''}"
        rows.append((i if i % 50 else None, text))
    rows += rows[:3] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    once = {(i, t or "") if t is not None else (i, None) for i, t in rows}
    patterns = {0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 3: r"\+[0-9][\x20().0-9-]+[0-9]"}
    held, said = Counter(), Counter()
    both = {}
    for i, t in once:
        found = {(k, m.lower()) for k, p in patterns.items() for m in re.findall(p, t or "")}
        bare = re.sub(patterns[3], " ", re.sub(patterns[0], " ", t or ""))
        terms = set(re.findall(r"[^\W\d_]{3,}", bare.lower()))
        held.update(found)
        for e in found:
            for w in terms:
                both.setdefault((e, w), []).append(t)
    spans = pii.base_spans(docs)
    n = len({(i, t) for i, t in rows})
    got = {(r["kind"], r["entity"], r["term"]): (r["together"], r["with_term"]) for r in pii.disclosing_terms(docs, spans).collect()}
    said = Counter()
    for i, t in once:
        said.update(set(re.findall(r"[^\W\d_]{3,}", re.sub(patterns[3], " ", re.sub(patterns[0], " ", t or "")).lower())))
    want = {}
    for (e, w), texts_ in both.items():
        share = math.log2(len(texts_) * n / (held[e] * said[w])) / math.log2(n / held[e])
        if share >= 0.9 and len(set(texts_)) >= 3:
            want[(*e, w)] = (len(texts_), said[w])
    assert got == want and any(k[2] == "morbel" for k in want)
    marked = {(r["doc_id"], r["text"]): {r["text"][s["start"] : s["end"]].lower() for s in r["spans"] if s["kind"] == 4} for r in pii.with_spans(docs).collect()}
    telling = {k[2] for k in want}
    for (i, t), found in marked.items():
        assert found == {w for w in re.findall(r"[^\W\d_]{3,}", (t or "").lower()) if w in telling and w in re.sub(patterns[0], " ", (t or "").lower())}


def test_secrets(documents, texts):
    patterns = [("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32)]
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["secrets"]] for r in secrets.scan(documents).collect()}
    for i, t in texts.items():
        want = {(m.start(), k, m.end()) for k, p, ok in patterns for m in re.finditer(p, t, re.ASCII) if ok(m)}
        assert {s for s in got[i] if s[1] in ("assign", "access", "hex")} == want
    assert secrets.trigram_query("[0-9a-f]{32,}") is True
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))


def test_fingerprints(spark, documents, texts, folder):
    ids = sorted(texts)
    got = {r["doc_id"]: r for r in Q.op9_document_fingerprints(spark, folder).collect()}

    def jaccard(a, b):
        a, b = Counter(a.lower().split()), Counter(b.lower().split())
        return sum((a & b).values()) / max(1, sum((a | b).values()))

    miss = []
    for i, following in zip(ids, ids[1:] + ids[:1], strict=True):
        t, n = texts[i], texts[following]
        edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        miss += [got[i]["near_edited"] - jaccard(t, edited), got[i]["near_next"] - jaccard(t, n)]
    assert abs(np.mean(miss)) < 0.03 and np.std(miss) < 0.12
    same = {}
    for i in ids:
        same.setdefault(texts[i], set()).add(got[i]["fingerprint"])
    assert all(len(x) == 1 for x in same.values())


def test_fingerprints_tell_likeness_within_a_sixteenth(spark, folder):
    """The error of k samples at a likeness j has the deviation sqrt(j (1 - j) / k)."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    ids = sorted(texts)
    got = {r["doc_id"]: r for r in cws.compare_edits(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    off = []
    for i, following in zip(ids, ids[1:] + ids[:1], strict=True):
        t, n = texts[i], texts[following]
        a, b = Counter(t.lower().split()), Counter((t[: len(t) - len(t) // 4] + n[: len(t) // 4]).lower().split())
        off.append(got[i]["near_edited"] - sum((a & b).values()) / max(1, sum((a | b).values())))
        assert len(got[i]["fingerprint"]) in (4, 8 * 64)
    assert np.std(off) < 0.07


def test_preferences(spark):
    rows = [("a", 0, "user", "hi"), ("a", 1, "assistant", "yes"), ("b", 0, "user", None), ("b", 1, "assistant", "same"), ("d", 0, "user", "only here")]
    other = [("a", 0, "user", "hi"), ("a", 1, "assistant", "no"), ("a", 2, "user", "?"), ("b", 0, "user", None), ("b", 1, "assistant", "same")]
    frame = lambda x: spark.createDataFrame(x, "pair_id string, turn int, role string, text string")
    got = {r["pair_id"]: r for r in chat.preferences(frame(rows), frame(other)).collect()}
    assert set(got) == {"a", "b"}
    a = got["a"]
    assert a["n_shared"] == 1 and a["prompt"] == "<|user|>\nhi\n<|end|>\n" and a["usable"]
    assert [a["chosen"][s["start"] : s["end"]] for s in a["chosen_mask"]] == ["yes\n<|end|>\n"]
    assert [a["rejected"][s["start"] : s["end"]] for s in a["rejected_mask"]] == ["no\n<|end|>\n"]
    assert got["b"]["n_shared"] == 2 and got["b"]["chosen"] == "" and not got["b"]["usable"]


def test_odd_rows_and_empty_tables(spark, odd, empty, folder):
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    labels = spark.createDataFrame([(4, 1), (4, None), (5, 0), (None, 1)], "doc_id bigint, quality int")
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    each = {
        "langid": lambda d: langid.predict(d, langid.fit(d, vocabulary)), "quality": lambda d: quality.predict(d, quality.fit(d, labels)), "simhash": simhash.near_duplicates,
        "secrets": secrets.scan, "pii": pii.sanitised, "lines": linededup.drop_repeated_lines, "cws": cws.compare_edits,
    }
    for name, run in each.items():
        assert run(odd).count() == odd.count(), name
        assert run(empty).count() == 0, name
    und = {r["doc_id"]: r["lang_pred"] for r in each["langid"](odd).collect()}
    assert und[1] == und[2] == und[3] == "und"
    assert packing.pack(packing.token_pieces(odd, WORDS)).where("doc_id <> 4").count() == 5
    assert packing.pack(packing.token_pieces(empty, WORDS)).count() == 0
    assert decontam.contaminated(odd, bench).count() == 0 and decontam.contaminated(empty, bench.limit(0)).count() == 0
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 5]
    assert decontam.drop_contaminated(odd, bench).count() == odd.count() and langid.keep_identified(odd, langid.fit(odd, vocabulary)).columns == odd.columns


def test_pipeline(spark, documents, folder):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns, name
        assert after.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        docs = after.cache()
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
