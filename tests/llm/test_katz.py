"""Katz scores against a plain dictionary model, and normalisation."""

import random
from collections import Counter
from functools import cache
from math import log10

import pytest
from pyspark.sql import functions as F

from foliant.llm import katz

TEXTS = ["a b a b c", "A b c", "", None, "a c d a b", "b b b b", "x y z a b", "a b " * 9, "c a", "d d a b q", "a b", "e f g h"]


def brute(rows, order=3):
    tok = lambda t: (t or "").lower().split() + ["</s>"]
    train = [tok(t) for i, t in rows if i % 5 != 2]
    grams = [Counter() for _ in range(order + 1)]
    hist = Counter()
    for t in train:
        grams[1].update((w,) for w in t)
        padded = ["<s>", *t]
        for k in range(2, order + 1):
            for i in range(len(padded) - k + 1):
                grams[k][tuple(padded[i : i + k])] += 1
                hist[tuple(padded[i : i + k - 1])] += 1
    uni = {w: c for (w,), c in grams[1].items()}
    n = sum(uni.values())
    coc = lambda c: [sum(x == r for x in c.values()) for r in range(1, 7)]
    factors = [None, *(katz.discounts(coc(c)) for c in grams[1:])]
    disc = lambda k, c: (factors[k][c] if c <= 5 else 1.0) * c
    unk = 1 - sum(disc(1, c) for c in uni.values()) / n
    scale = 1.0
    if unk <= 1e-12:
        unk, scale = 1 / (n + 1), n / (n + 1)

    @cache
    def weights(h):
        """Factor of seen words after h, and the backoff weight."""
        after = [g[-1] for g in grams[len(h) + 1] if g[:-1] == h]
        if not after:
            return 1.0, 1.0
        ps = sum(disc(len(h) + 1, grams[len(h) + 1][*h, w]) for w in after) / hist[h]
        s = hist[h] / (hist[h] + 1) if ps > 1 - 1e-9 else 1.0
        return s, (1 - s * ps) / (1 - sum(p(h[1:], w) for w in after))

    def p(h, w):
        if not h:
            return scale * disc(1, uni[w]) / n if w in uni else unk
        s, back = weights(h)
        c = grams[len(h) + 1][*h, w]
        return s * disc(len(h) + 1, c) / hist[h] if c else back * p(h[1:], w)

    for h in [*hist, ("never",), ("a", "never"), ("never", "a")]:
        if len(h) < order:
            assert sum(p(h, w) for w in uni) + p(h, "\0unknown") == pytest.approx(1)
    out = {}
    for i, t in rows:
        t = tok(t)
        padded = ["<s>", *t]
        log = sum(log10(p(tuple(padded[max(0, j + 2 - order) : j + 1])[: order - 1] if order > 1 else (), w)) for j, w in enumerate(t))
        out[i] = (len(t), sum(w in uni for w in t), n, sum(log10((uni.get(w, 0) + 1) / (n + len(uni) + 1)) for w in t), log)
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_brute_force(spark, order):
    rows = list(enumerate(TEXTS * 2))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, held string")
    got = {r.doc_id: r for r in katz.score(docs, F.col("doc_id") % 5 == 2, order).collect()}
    want = brute(rows, order)
    assert set(got) == set(want)
    for i, w in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3] and r.held_out == (i % 5 == 2)
        assert r.base_score == pytest.approx(w[3]) and r.score == pytest.approx(w[4])


def test_many_blocks_agree_with_one(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "doc_id long, text string").repartition(3)
    one = {r.doc_id: r.score for r in katz.score(docs, F.lit(False)).collect()}
    want = brute([(5 * i, t) for i, t in enumerate(TEXTS * 3)])
    assert all(one[i] == pytest.approx(want[5 * i][4]) for i in one)


def test_empty_and_null(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert katz.score(empty, F.lit(False)).collect() == []
    rows = katz.score(spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string"), F.lit(True)).collect()
    assert [(r.doc_id, r.n_tokens, r.score) for r in rows] == [(None, 1, 0.0)] * 2


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts_in_many_blocks(spark, seed):
    """Grams alone in a block, shared ones, histories that lose nothing to discounts, and unseen words, against the dictionary model."""
    rng = random.Random(seed)
    common, rare = "the of and".split(), [f"w{i}" for i in range(25)]
    rows = [(i, " ".join(rng.choice(common if rng.random() < 0.8 else rare) for _ in range(rng.randrange(12)))) for i in range(150)]
    rows = [(i, f"{t} only{i}" if i % 9 == 0 else t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r for r in katz.score(docs, F.col("doc_id") % 5 == 2).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for i, w in want.items():
        assert got[i].n_known == w[1] and got[i].base_score == pytest.approx(w[3]) and got[i].score == pytest.approx(w[4])
