"""Decisions of tests against enumeration and known values."""

from itertools import combinations, product

import numpy as np

from framewise.operators import statistics as T
from framewise.sources import recordings


def test_exact_signed_rank_against_all_signs():
    d = np.array([1.5, -0.3, 2.2, 0.9, -1.1, 3.0, 0.2])
    r = np.argsort(np.argsort(np.abs(d))) + 1
    sums = np.array([sum(r[np.array(s) > 0]) for s in product((1, -1), repeat=len(d))])
    w, p = T.wilcoxon_p(d)
    assert w == r[d > 0].sum() and abs(p - min(1, 2 * min((sums <= w).mean(), (sums >= w).mean()))) < 1e-12


def test_exact_rank_sum_against_all_splits():
    a, b = np.array([1.0, 4.5, 7.0, 2.2]), np.array([3.0, 8.0, 9.5, 6.0, 10.0])
    both = np.sort(np.concatenate((a, b)))
    us = np.array([sum(sum(x > y for y in set(both) - set(c)) for x in c) for c in combinations(both, len(a))])
    u, p = T.mann_whitney_p(a, b)
    assert u == sum(x > y for x in a for y in b) and abs(p - min(1, 2 * min((us <= u).mean(), (us >= u).mean()))) < 1e-12


def test_normality():
    g = np.random.default_rng(1)
    for n in (3, 5, 8, 20, 60):
        rejected = np.mean([T.shapiro_p(g.standard_normal(n)) < 0.05 for _ in range(1500)])
        assert 0.03 < rejected < 0.075, n
    assert T.shapiro_p(g.exponential(size=50)) < 0.01 and np.isnan(T.shapiro_p(np.array([1.0, 2.0])))


def test_decisions():
    g = np.random.default_rng(2)
    normal, skewed = g.standard_normal(30), g.exponential(size=40) ** 2
    assert T.paired_decision(normal)[0] == "t" and T.paired_decision(normal[:6])[0] == "wilcoxon" and T.paired_decision(normal[:6], small=0)[0] in ("t", "wilcoxon")
    assert T.paired_decision(np.zeros(9)) == ("wilcoxon", 0.0, 1.0) and T.paired_decision(normal[:2])[0] is None
    assert T.unpaired_decision(normal, normal + 2)[0] == "t" and T.unpaired_decision(normal, normal + 2, welch=True)[0] == "welch"
    assert T.unpaired_decision(normal, skewed)[0] == "mann-whitney" and T.unpaired_decision(normal[:5], normal)[0] == "mann-whitney"
    assert T.omnibus_decision([normal, normal + 1, normal])[0] == "anova" and T.omnibus_decision([normal, skewed])[0] == "kruskal" and T.omnibus_decision([np.ones(4)] * 3) == ("kruskal", 0.0, 1.0)
    assert abs(T.t_quantile(0.95, 10) - 2.2281388) < 1e-6


def test_decisions_on_tables(spark):
    g = np.random.default_rng(3)
    rows = [(k, bool(i % 2), float(v + 3 * k * (i % 2))) for k in range(3) for i, v in enumerate(g.standard_normal(40))]
    df = spark.createDataFrame(rows, "cell long, side boolean, v double")
    got = {r.cell: r for r in T.unpaired_test(df, "v", "side", "cell").collect()}
    for k in range(3):
        a, b = (np.array([v for c, s, v in rows if c == k and s == side]) for side in (True, False))
        assert (got[k].test, round(got[k].p, 12)) == (lambda x: (x[0], round(x[2], 12)))(T.unpaired_decision(a, b))
    assert T.paired_test(df, "v", "cell").count() == 3 and T.omnibus_test(df, "v", "side", "cell").count() == 3
    band = T.confidence_band(df.selectExpr("cast(cell as double) AS x", "v"), "x", "v", [0.0, 1.0]).collect()
    assert all(r.lo < r.fit < r.hi for r in band)


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, None)], "cell long, p double")
    recordings.write_statistics(df, f"{tmp_path}/s")
    assert sorted(map(tuple, recordings.read_statistics(spark, f"{tmp_path}/s", "cell long, p double").collect())) == [(1, 0.5), (2, None)]
    for name in ("a_good", "b_bad", "c_good"):
        (tmp_path / "animals" / name).mkdir(parents=True)
    assert [x.rsplit("/", 1)[1] for x in recordings.discovered(spark, f"{tmp_path}/animals/*good")] == ["a_good", "c_good"]
    assert recordings.first_existing(spark, [f"{tmp_path}/none", f"{tmp_path}/s", f"{tmp_path}/animals"]) == f"{tmp_path}/s"
    for name in ("x.csv", "y_filtered.csv"):
        (tmp_path / "animals" / name).write_text("s,a\nb,c\nd,x\n")
    assert recordings.newest_pose(spark, f"{tmp_path}/animals").endswith("y_filtered.csv")
    spark.createDataFrame([([1.0, 2.0], 1)], "f array<double>, v int").write.parquet(f"{tmp_path}/p1")
    spark.createDataFrame([([1.0, 3.0], 2), ([1.0, 2.0], 3)], "f array<double>, v int").write.parquet(f"{tmp_path}/p2")
    assert sorted(r.v for r in recordings.pooled_summaries(spark, [f"{tmp_path}/p1", f"{tmp_path}/p2"], "f").collect()) == [1, 3]
    done = recordings.job_results(df.select("cell"), spark.createDataFrame([(1, "success")], "cell long, status string"), "cell")
    assert {r.cell: r.status for r in done.collect()} == {1: "success", 2: "missing"}


def test_one_sample(spark):
    g = np.random.default_rng(7)
    v = g.standard_normal(12) + 0.5
    rows = [(1, float(x)) for x in v] + [(2, 3.0), (3, 1.0), (3, 1.0), (4, None)]
    got = {r.k: r for r in T.one_sample(spark.createDataFrame(rows, "k long, v double"), "v", 0.0, "k").collect()}
    t = v.mean() / (v.std(ddof=1) / np.sqrt(12))
    assert abs(got[1].t - t) < 1e-9 and abs(got[1].p - T.t_p(t, 11)) < 1e-12 and got[1].n == 12
    assert got[2].t is None and got[3].t is None and got[3].p is None and 4 not in got
