import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pagelore.llm import lm as L


def grams(ws):
    """Counts of n-grams of 0 to 3 words by document, starts of texts as contexts included."""
    u, v, out = "^", "^", Counter({("^",): 1, ("^", "^"): 1})
    for w in ws:
        out.update([(w,), (v, w), (u, v, w)])
        u, v = v, w
    return out


def brute(rows):
    """By the formula, from counts of all other rows."""
    own = [(d, ws, grams(ws)) for d, ws in ((d, L.WORD.findall((t or "").lower())) for d, t in rows)]
    every, tokens = Counter(), sum(len(ws) for _, ws, _ in own)
    for _, _, g in own:
        every.update(g)
    out = {}
    for d, ws, g in own:
        c = lambda *k: every[k] - g[k]  # noqa: B023, E731
        u, v, s = "^", "^", 0.0
        for w in ws:
            if c(u, v, w):
                s += math.log10(c(u, v, w) / c(u, v))
            elif c(v, w):
                s += math.log10(0.4 * c(v, w) / c(v))
            else:
                s += math.log10(0.16 * max(c(w), 0.5) / max(1, tokens - len(ws)))
            u, v = v, w
        n0, s0 = out.get(d, (0, 0.0))
        out[d] = (n0 + len(ws), s0 + s)
    return out


@pytest.mark.parametrize("batch,keys", [(1_000_000, 1 << 20), (300, 1 << 20), (2000, 200)])
def test_scores(docs, rows, monkeypatch, batch, keys):
    monkeypatch.setattr(L, "BATCH", batch)
    monkeypatch.setattr(L, "KEYS", keys)
    got = {r.doc_id: r for r in L.scores(docs.withColumnRenamed("lang", "batch").withColumnRenamed("source", "n_tokens")).collect()}
    want = brute([(r[0], r[1]) for r in rows])
    assert set(got) == set(want)
    for d, (n, s) in want.items():
        assert got[d].n_tokens == n and got[d].log10_score == pytest.approx(s, abs=1e-6)
        assert got[d].mean_score == (pytest.approx(s / n) if n else None)


def test_packing():
    r = np.random.default_rng(2)
    for n in (1, 2, 700):
        for most in (2, 300, 1 << 62):
            x = r.integers(0, most, n)
            assert (L.unpacked(pa.scalar(L.packed(x), pa.binary()), n) == x).all()
        k = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        assert (np.cumsum(L.unpacked(pa.scalar(L.packed(np.diff(k, prepend=np.uint64(0))), pa.binary()), n)) == k).all()


def test_a_text_scores_the_same_in_a_corpus_with_more_of_other_words(spark):
    """No threshold follows the corpus: what rare words count doesn't depend on how much else there is."""
    few = [(1, "alpha beta gamma delta"), (2, "alpha beta gamma epsilon")]
    more = few + [(10 + i, " ".join(f"w{i}x{k}" for k in range(300))) for i in range(50)]
    a, b = ({r.doc_id: r.log10_score for r in L.scores(spark.createDataFrame(x, "doc_id long, text string")).collect()} for x in (few, more))
    # the first word's context is the start of all texts; the last words back off to one word among all tokens
    assert b[1] == pytest.approx(a[1] + math.log10(1 / 51) - math.log10(1 / 1) + math.log10(4 / (4 + 50 * 300)))


def test_empty(empty):
    assert L.scores(empty).count() == 0
