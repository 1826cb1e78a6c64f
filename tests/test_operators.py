import math

import numpy as np
import pandas as pd
import pytest

from framewise.operators import cells, grids, intervals, sequence, signals, statistics
from framewise.sources import recordings
from framewise.streaming.spike_sessions import drained, event_sessions
from tests.compare import rows, sql_rows


def spans(df):
    return sorted((r.lo, r.hi) for r in df.collect())


def cell(spark, values, name="v"):
    return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], f"cell long, frame long, {name} double")


def test_merges(spark):
    x = spark.createDataFrame([(1, 1, 3), (1, 4, 6), (1, 8, 9)], "cell long, lo long, hi long")
    assert spans(intervals.merged(x, 1)) == [(1, 6), (8, 9)]
    assert spans(intervals.merged(x, 0)) == [(1, 3), (4, 6), (8, 9)]


def test_runs(spark):
    x = cell(spark, [0, 1, 1, 0, 1]).selectExpr("*", "v > 0 as on")
    assert spans(intervals.runs(x, "on")) == [(1, 2), (4, 4)]


def test_isi_groups(spark):
    x = spark.createDataFrame([(1, f) for f in (0, 10, 15, 40)], "cell long, frame long")
    assert [r.grp for r in sequence.isi_groups(x, 10).orderBy("frame").collect()] == [0, 0, 0, 1]


def test_average_rank(spark):
    x = cell(spark, [5, 7, 7, 9])
    assert sorted(r.rk for r in sequence.average_rank(x, "v", "rk", "cell").collect()) == [1, 2.5, 2.5, 4]


def test_corrections(spark):
    x = spark.createDataFrame([(1, p) for p in (0.01, 0.04, 0.03)], "k long, p double")
    assert [round(r.q, 4) for r in statistics.holm(x, "p", "q", "k").orderBy("p").collect()] == [0.03, 0.06, 0.06]
    assert [round(r.q, 4) for r in statistics.benjamini_hochberg(x, "p", "q", "k").orderBy("p").collect()] == [0.03, 0.04, 0.04]


def test_information(spark):
    x = spark.createDataFrame([(1, 1.0, 0.0), (1, 1.0, 4.0)], "cell long, occ double, rate double")
    assert grids.spatial_information(x, "cell").first().info == pytest.approx(2.0)


@pytest.mark.parametrize(("got", "want"), [
    (statistics.t_p(2.228138852, 10), 0.05), (statistics.f_p(4.964602744, 1, 10), 0.05), (statistics.chi2_p(3.841458821, 1), 0.05),
    (statistics.normal_p(1.959963985), 0.05), (statistics.t_p(0, 5), 1.0), (statistics.chi2_p(18.30703805, 10), 0.05),
])
def test_distributions(got, want):
    assert got == pytest.approx(want, abs=1e-8)


def test_butterworth_keeps_fast_and_drops_slow(spark):
    t = np.arange(4000)
    slow, fast = np.sin(2 * np.pi * t / 1000), np.sin(2 * np.pi * t / 8)
    out = signals.butterworth(cell(spark, (slow + fast).tolist()), "v", "f", 0.02, block=1000).orderBy("frame").toPandas()
    assert len(out) == 4000
    assert np.abs(out.f.to_numpy() - fast)[200:-200].max() < 0.02


def test_find_peaks_takes_the_tallest_first(spark):
    v = np.zeros(40)
    v[[5, 7, 20, 30, 33, 36]] = [1, 2, 1, 1, 3, 2]
    got = signals.find_peaks(cell(spark, v.tolist()), "v", 0.5, 4)
    assert sorted(r.frame for r in got.collect()) == [7, 20, 33]


def test_poisson_tuning_without_penalty_is_the_rate(spark):
    c = spark.createDataFrame([(1, 0, 10, 5), (1, 1, 20, 4), (1, 2, 10, 1)], "cell long, bin long, frames long, spikes long")
    got = signals.poisson_tuning(c, 3, 0.0).orderBy("bin").toPandas().log_rate
    assert got.tolist() == pytest.approx([math.log(0.5), math.log(0.2), math.log(0.1)], abs=1e-6)


def test_components(spark):
    m = spark.createDataFrame([(1, x, y) for x, y in ((0, 0), (0, 1), (1, 2), (3, 3))], "map_id long, ix long, iy long").selectExpr("*", "true as on")
    count = lambda d: grids.components(m, "on", "map_id", d).select("component").distinct().count()
    assert (count(False), count(True)) == (3, 2)


def test_pose_and_experiment_and_manifest(spark, tmp_path):
    (tmp_path / "p.csv").write_text("scorer,a,a,a,a,a,a\nbodyparts,nose,nose,nose,tail,tail,tail\ncoords,x,y,likelihood,x,y,likelihood\n0,1,2,0.9,3,4,0.8\n1,5,6,0.7,7,8,0.6\n")
    assert [tuple(r) for r in recordings.pose(spark, str(tmp_path / "p.csv")).orderBy("frame", "part").collect()][:2] == [(0, "nose", 1.0, 2.0, 0.9), (0, "tail", 3.0, 4.0, 0.8)]
    (tmp_path / "e.xml").write_text('<X><LSM frameRate="500.5" pixelX="64" pixelY="32"/></X>')
    assert tuple(recordings.experiment(spark, str(tmp_path / "e.xml")).first())[1:] == (64, 32, 500.5)
    (tmp_path / "m.json").write_text('{"sessions": [{"session": 1, "path": "/old/a", "n_frames": 5}, {"session": 2, "path": "/old/b", "n_frames": 7}]}')
    assert [(r.path, r.lo) for r in recordings.manifest(spark, str(tmp_path / "m.json"), "/old", "/new").orderBy("session").collect()] == [("/new/a", 0), ("/new/b", 5)]


def test_stream_equals_batch(spark, tmp_path):
    rows = pd.DataFrame({"user_id": [1, 1, 1, 2], "ts": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:05", "2024-01-01 02:00", "2024-01-01 00:00"]), "value": [1.0, 2.0, 3.0, 4.0]})
    late = pd.DataFrame({"user_id": [9], "ts": pd.to_datetime(["2024-02-01"]), "value": [0.0]})
    spark.createDataFrame(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame(late).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained(spark, event_sessions(source, "10 minutes", "1 hour"), "stream").where("user_id < 9")
    want = event_sessions(spark.read.parquet(str(tmp_path / "in")), "10 minutes", "1 hour").where("user_id < 9")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rank_correlation_of_constants_is_null(spark):
    rows = [(1, 2.0, 1.0), (1, 2.0, 3.0), (1, 2.0, 2.0), (2, 1.0, 5.0), (2, 2.0, 5.0), (3, 1.0, 1.0), (4, 1.0, 3.0), (4, 2.0, 1.0), (4, 3.0, 2.0)]
    got = {r.k: r.rho for r in cells.rank_correlation(spark.createDataFrame(rows, "k long, a double, b double"), "a", "b", "k").collect()}
    assert got == {1: None, 2: None, 3: None, 4: -0.5}


def test_rank_correlation_of_rows_in_any_order(spark):
    rng, pairs = np.random.default_rng(4), np.array([(4, 1), (1, 2), (1, 2), (1, 1), (1, 1), (4, 1), (3, 3), (2, 5), (5, 4), (2, 1), (6, 2)], float)
    shuffled = [(k, *map(float, p)) for k in range(200) for p in rng.permutation(pairs)]
    got = cells.rank_correlation(spark.createDataFrame(shuffled, "k long, a double, b double"), "a", "b", "k").collect()
    ra, rb = (2 * pd.Series(c).rank().to_numpy() - len(pairs) - 1 for c in pairs.T)
    assert len(got) == 200 and {r.rho for r in got} == {(ra @ rb) / (4 * len(pairs)) / (((ra @ ra) / (4 * len(pairs))) ** 0.5 * ((rb @ rb) / (4 * len(pairs))) ** 0.5)}
    assert [r.rho for r in cells.rank_correlation(spark.createDataFrame([], "a double, b double"), "a", "b").collect()] == [None]


def test_similar_occupancy_at_its_threshold(spark, tmp_path):
    """Cells whose rho is -0.5 but for the last bit, which is the same in the SQL in whatever order their rows come; cells 0 to 2 are above the threshold by it."""
    from framewise.catalog import QUERIES, SQL

    occupancy = [
        [(3, 2), (3, 1), (1, 2)], [(2, 2), (1, 3), (2, 1), (2, 2), (4, 2), (2, 2)], [(2, 2), (1, 3), (2, 1), (4, 2), (2, 2), (2, 2)],
        [(1, 2), (2, 3), (3, 1)],
    ]
    at = [(cell, day, 6.0 * (b % 6), 6 * (b // 6)) for cell, bins in enumerate(occupancy) for b, pair in enumerate(bins) for day, n in zip((1, 20), pair) for _ in range(n)]
    events = pd.DataFrame({"event_id": range(len(at)), "ts": [pd.Timestamp(2024, 1, a[1]) + pd.Timedelta(seconds=i) for i, a in enumerate(at)], "user_id": [a[0] for a in at], "event_type": "click", "value": [a[2] for a in at], "props": [f'{{"k": {a[3]}}}' for a in at]})
    events["ts"] = events["ts"].astype("datetime64[us]")
    events.to_parquet(tmp_path / "events.parquet")
    got = rows(QUERIES["p10_similar_occupancy"](spark, str(tmp_path)).toPandas())
    assert got == rows(sql_rows(str(tmp_path), SQL["p10_similar_occupancy"])) and [c for c, _ in got] == [0, 1, 2]
