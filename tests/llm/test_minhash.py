"""Near duplicates against all pairs: weighted shingles, odd rows, one document a class."""

from collections import Counter
from math import log

import numpy as np
import pytest

from framewise.llm import minhash
from tests.llm.test_operators import words


def shingles(text):
    w = (text or "").split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else Counter()


def probability_jaccard(x, y, weight):
    x, y = ({d: weight(n) for d, n in s.items()} for s in (x, y))
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())


def classes(texts, weight, threshold=0.8):
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and (texts[i] == texts[j] or probability_jaccard(sets[i], sets[j], weight) >= threshold):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(texts))]


def repeated(seed):
    """Texts in which a stretch occurs many times, with edits."""
    g = np.random.default_rng(seed)
    w = words(seed, 60)
    out = [" ".join(w[:20] + w[20:40] * times + w[40:]) for times in (1, 2, 9)]
    for e in (1, 2, 4):
        c = w[:20] + w[20:40] * 3 + w[40:]
        for p in g.integers(0, len(c), e):
            c[p] = "zz"
        out.append(" ".join(c))
    return out


@pytest.mark.parametrize("weighted", [False, True])
def test_classes_against_all_pairs(spark, weighted):
    texts = [t for s in range(8) for t in repeated(s)] + [None, "", " \n", "one two", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS bands", "2 AS id", "3 AS label", "4 AS text_key")
    got = {r.doc_id: r.class_id for r in minhash.duplicate_classes(docs, weighted=weighted).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts, (lambda n: 1 + log(n)) if weighted else (lambda n: 1))


def test_probability_jaccard_of_arrays():
    g = np.random.default_rng(7)
    for _ in range(20):
        x, y = (np.sort(g.choice(30, 20, replace=False)) for _ in range(2))
        wx, wy = (1 + np.log(g.integers(1, 9, 20)) for _ in range(2))
        a, b = (dict(zip(k.tolist(), w.tolist(), strict=True)) for k, w in ((x, wx), (y, wy)))
        want = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())
        assert abs(minhash.probability_jaccard(x, wx, y, wy) - want) < 1e-9


def test_registers_estimate_the_weighted_similarity():
    x, y = np.arange(0, 60, dtype=np.uint64), np.arange(20, 80, dtype=np.uint64)
    wx, wy = 1 + x.astype(float) % 4, 1 + y.astype(float) % 5
    m = 20_000
    regs = minhash.prob_minhash(np.repeat([0, 1], 60), np.concatenate((x, y)), np.concatenate((wx, wy)), 2, m)
    exact = minhash.probability_jaccard(x, wx, y, wy)
    assert abs((regs[0] == regs[1]).mean() - exact) < 4 * (exact / m) ** 0.5


def test_one_document_of_a_class_stays(spark):
    long = " ".join(words(1, 30_000))
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (1, "other text of one id here"), (None, None), (None, "a b c d e f"), (5, None), (6, ""), (7, long), (8, long + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS class_id", "'k' AS n_links")
    out = minhash.near_deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(1, "a b c d e f"), (1, "other text of one id here"), (None, None), (None, "a b c d e f"), (5, None), (6, ""), (7, long)], key=repr)
