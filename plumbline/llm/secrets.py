"""Secret scans through an index of trigrams.

From the syntax tree of each rule's pattern a Boolean query over trigrams is derived that every match must satisfy. A
block of documents is indexed by the trigrams that queries name: a posting tells which documents of the block hold the
trigram. Postings are intersected and united as the queries say, and only candidates are searched with the pattern;
a rule without mandatory trigrams searches all. Blocks are Arrow batches, so the index never leaves its task.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from re import _constants as OP
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.rowwise import with_scores

STRINGS = 64  # strings that a part of a pattern is spelled out to


@dataclass(frozen=True)
class Rule:
    """A pattern, searched in ASCII mode, and what its matches must pass; others are dropped without another try."""

    kind: str
    pattern: str
    passes: Callable[[re.Match], bool] = lambda m: True
    base: bool = False


RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16, True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),  # a run of 32 and more is where a run of any length is long enough
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
]


# --- queries: True (all documents), a trigram, ("and", [...]) or ("or", [...]) ---------------------------------------


def _both(kind: str, parts: list):
    neutral = kind == "and"
    if kind == "or" and True in parts:
        return True
    parts = list(dict.fromkeys(p if isinstance(p, str) else (p[0], tuple(p[1])) for p in parts if p is not True))
    return neutral or True if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _spelled(strings: set[str]):
    """What holds of a text with any of the strings in it."""
    if any(len(s) < 3 for s in strings):
        return True
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _exact(op, arg) -> set[str] | None:
    """All strings, in lower case, that a part of a pattern can match, if they are few."""
    if op is OP.LITERAL:
        return {chr(arg).lower()}
    if op is OP.IN:
        chars: set[str] = set()
        for o, a in arg:
            if o is OP.LITERAL:
                chars.add(chr(a).lower())
            elif o is OP.RANGE and a[1] - a[0] < 8:
                chars |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return None
        return chars if len(chars) <= 8 else None
    if op is OP.SUBPATTERN:
        return _exact_all(arg[3])
    if op is OP.BRANCH:
        parts = [_exact_all(p) for p in arg[1]]
        whole = None if None in parts else set().union(*parts)
        return whole if whole is not None and len(whole) <= STRINGS else None
    if op is OP.MAX_REPEAT and arg[1] is not OP.MAXREPEAT and arg[1] <= 3:
        one = _exact_all(arg[2])
        if one is None or len(one) ** arg[1] > STRINGS:
            return None
        return {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)}
    return {""} if op is OP.AT else None


def _exact_all(parts) -> set[str] | None:
    whole = {""}
    for op, arg in parts:
        one = _exact(op, arg)
        if one is None or len(whole) * len(one) > STRINGS:
            return None
        whole = {a + b for a in whole for b in one}
    return whole


def _query(parts):
    found, run = [], {""}
    for op, arg in parts:
        one = _exact(op, arg)
        if one is not None and len(run) * len(one) <= STRINGS:
            run = {a + b for a in run for b in one}
            continue
        found.append(_spelled(run))
        run = {""} if one is None else one
        if one is None:
            if op is OP.SUBPATTERN:
                found.append(_query(arg[3]))
            elif op is OP.BRANCH:
                found.append(_both("or", [_query(p) for p in arg[1]]))
            elif op in (OP.MAX_REPEAT, OP.MIN_REPEAT) and arg[0] > 0:
                found.append(_query(arg[2]))
    found.append(_spelled(run))
    return _both("and", found)


def trigram_query(pattern: str):
    """The Boolean query over lower-case trigrams that every text with a match satisfies; True if there is none."""
    return _query(_parser.parse(pattern, re.ASCII))


def trigrams(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _candidates(query, postings: dict[str, np.ndarray], all_of_them: np.ndarray) -> np.ndarray:
    if query is True:
        return all_of_them
    if isinstance(query, str):
        return postings[query]
    parts = [_candidates(q, postings, all_of_them) for q in query[1]]
    return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)


def scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with secrets: array of (kind, start, end) in code points, by start, then the rules' order. A null text has none.

    Whole texts are searched; matches of one rule do not overlap, those of two may.
    """
    rules = RULES if rules is None else rules
    queries = [trigram_query(r.pattern) for r in rules]
    named = sorted(set().union(*map(trigrams, queries)))

    def find(texts: list) -> list[pa.Array]:
        low = pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string()))
        postings = {t: pc.match_substring(low, t).to_numpy(zero_copy_only=False) for t in named}
        every = np.ones(len(texts), bool)
        found: list[list] = [[] for _ in texts]
        for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
            search = re.compile(rule.pattern, re.ASCII).finditer
            for i in np.flatnonzero(_candidates(query, postings, every)):
                found[i] += [(m.start(), k, m.end()) for m in search(texts[i] or "") if rule.passes(m)]
        spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(f)] for f in found]
        return [pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))]

    span = T.StructType().add("kind", "string").add("start", "integer").add("end", "integer")
    return with_scores(docs, [T.StructField("secrets", T.ArrayType(span))], find)
