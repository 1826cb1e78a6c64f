"""Nearest neighbours against brute force, over several blocks and cells."""

import numpy as np
import pytest

from framewise.llm import ann


def frame(spark, ids, vecs):
    return spark.createDataFrame([(int(i), None if v is None else [None if x is None else float(x) for x in v]) for i, v in zip(ids, vecs, strict=True)], "vec_id long, embedding array<double>")


def brute_force(x, ids, q, own, k=10):
    dist = ann.distances(x, q)
    order = np.lexsort((ids, dist))
    return [(int(ids[i]), float(dist[i])) for i in order if ids[i] != own][:k]


def clustered(n=6000, dim=32, groups=60):
    g = np.random.default_rng(1)
    centres = g.standard_normal((groups, dim)) * 3
    sizes = np.where(g.random(n) < 0.33, 0, g.integers(0, groups, n))  # one group holds a third of all
    return centres[sizes] + g.standard_normal((n, dim)) * 0.6


def spread(n=4000, dim=64):
    x = np.random.default_rng(2).standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize(("make", "share"), [(clustered, 0.2), (spread, 0.3)])
def test_recall_and_verified_share(spark, make, share):
    x = make()
    ids = np.random.default_rng(3).permutation(len(x)) * 3
    df = frame(spark, ids, x).repartition(5).cache()
    queries = df.where("vec_id % 100 = 0")
    found = ann.searched(df, queries, block_values=1 << 14).toPandas()
    blocks = -(-len(x) * x.shape[1] // (1 << 14))
    assert blocks >= 5
    verified = found.verified.sum() / found.query_id.nunique() / len(x)
    hit = total = 0
    for q, g in ann.neighbours(df, queries, block_values=1 << 14).toPandas().groupby("query_id"):
        want = brute_force(x, ids, x[ids == q][0], q)
        exact = {i: d for i, d in brute_force(x, ids, x[ids == q][0], q, len(x))}
        hit, total = hit + len({i for i, _ in want} & set(g.vec_id)), total + 10
        assert sorted(g["rank"]) == list(range(1, 11)) and all(abs(exact[i] - s) < 1e-12 for i, s in zip(g.vec_id, g.score, strict=True))
    print("recall", hit / total, "verified", verified)
    assert hit >= 0.95 * total and verified <= share


def test_ties_copies_and_odd_vectors(spark):
    x = np.random.default_rng(4).standard_normal((40, 8))
    ids, vecs = list(range(100, 140)), x.tolist()
    ids += list(range(1000, 1400)) + [100, 100, 200, 201, 202, 203, 204, None, 205, 300, 301]
    vecs += [[1.0] * 8] * 400 + [x[0].tolist(), x[1].tolist(), None, [], [0.0] * 8, [float("nan")] * 8, [None] * 8, [1.0] * 8, [float("inf")] * 8, [1.0, 2.0], [1.0, 2.5]]
    df = spark.createDataFrame(list(zip(ids, vecs, strict=True)), "vec_id long, embedding array<double>").selectExpr("*", "'x' AS vec", "1 AS dim", "2 AS rank", "3 AS score")
    got = ann.neighbours(df, df.where("vec_id % 100 = 0")).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {100, 300, 1000, 1100, 1200, 1300}
    assert [(r.vec_id, r.score) for r in sorted(by[1100], key=lambda r: r.rank)] == [(i, 0.0) for i in range(1000, 1010)]
    assert [(r.vec_id, r.score) for r in by[300]] == [(301, 0.5)]
    assert len(by[100]) == 20 and all(r.vec_id != 100 for r in by[100])  # two vectors of one id, ranked apart


def test_sample_and_cells_lose_nothing(spark):
    """A bound and cells of the sample alone: with every vector verified, the result is exact."""
    x = clustered(1500, 16, 20)
    ids = np.arange(len(x))
    df = frame(spark, ids, x)
    old, ann.FEWEST = ann.FEWEST, 0.0
    try:
        got = ann.neighbours(df, df.where("vec_id % 100 = 0"), block_values=1 << 12).toPandas()
    finally:
        ann.FEWEST = old
    for q, g in got.groupby("query_id"):
        assert [i for i, _ in brute_force(x, ids, x[q], q)] == list(g.sort_values("rank").vec_id)
