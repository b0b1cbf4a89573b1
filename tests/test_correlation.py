"""Spearman against brute force, whichever side is joined."""

import itertools
import math
import random

import pytest

from plumbline.operators import correlation


def ranks(values):
    return [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]


def brute(a, b):
    both = [(x, y) for x, y in zip(a, b, strict=True) if x is not None and y is not None]
    rx, ry = (ranks(s) for s in zip(*both, strict=True))
    center = (len(both) + 1) / 2
    part = lambda p, q: sum((u - center) * (v - center) for u, v in zip(p, q, strict=True))
    whole = math.sqrt(part(rx, rx) * part(ry, ry))
    return part(rx, ry) / whole if whole else None


@pytest.mark.parametrize("few", [4096, 10, 0])
def test_spearman_joins_one_side(spark, monkeypatch, few):
    """Only sides of many values are joined by a shuffle, and of each pair one side alone."""
    rng = random.Random(few)
    wide = [rng.choice([None, rng.random()]) for _ in range(200)]
    columns = {"wide": wide, "tens": [rng.choice([None, *range(8)]) for _ in wide], "near": [(x or 0) + rng.random() / 3 for x in wide], "flat": [1.0] * 200, "sign": [rng.choice([-0.0, 0.0, -1.0]) for _ in wide]}
    calls, attach = [], correlation._attach
    monkeypatch.setattr(correlation, "FEW", few, raising=False)
    monkeypatch.setattr(correlation, "_attach", lambda *a: calls.append(a) or attach(*a))
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), "wide double, tens int, near double, flat double, sign double")
    got = {(r[0], r[1]): r[2] for r in correlation.spearman(df).collect()}
    assert len(calls) == (few < 4096)
    assert got == {(a, b): pytest.approx(brute(columns[a], columns[b])) for a, b in itertools.combinations(columns, 2)}
    assert correlation.spearman(df.limit(0)).count() == 0
