"""Raw movies by ranges, random-reference nulls and trends of signal and noise against plain Python."""

import time
import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewise.operators import nulls, snr
from framewise.sources.raw_movies import RawMovieReader, register
from framewise.streaming.spike_sessions import drained


def movie_files(folder):
    g = np.random.default_rng(1)
    both = [g.integers(0, 60000, (n, 3, 4)).astype("<u2") for n in (50, 31)]
    for name, m in zip("ab", both, strict=True):
        (folder / f"{name}.raw").write_bytes(m.tobytes())
    return both


def test_raw_movies_are_concatenated(spark, tmp_path):
    a, b = movie_files(tmp_path)
    register(spark)
    df = spark.read.format("raw_movies").options(paths=f"{tmp_path}/a.raw\n{tmp_path}/b.raw", height=3, width=4, drop=5, partition_bytes=200).load()
    got = df.orderBy("at").toPandas()
    want = np.concatenate((a[5:], b[5:])).reshape(-1, 12)
    assert (np.stack(got.pixels) == want).all() and got["at"].tolist() == list(range(71)) and got.groupby("session").frame.max().tolist() == [44, 25]
    assert df.rdd.getNumPartitions() > 5
    folder = spark.read.format("raw_movies").options(paths=f"file://{tmp_path}", height=3, width=4).load()
    assert folder.count() == 81


def test_only_asked_frames_are_read(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan

    movie_files(tmp_path)
    options = {"paths": f"{tmp_path}/a.raw\n{tmp_path}/b.raw", "height": "3", "width": "4", "partition_bytes": "96"}

    def asked(*filters):
        reader = RawMovieReader(options)
        assert list(reader.pushFilters(list(filters))) == []
        return sorted(p.at + i for p in reader.partitions() for i in range(p.count))

    assert asked() == list(range(81)) and asked(GreaterThanOrEqual(("at",), 48), LessThan(("at",), 53)) == [48, 49, 50, 51, 52]
    assert asked(EqualTo(("session",), 1), GreaterThan(("at",), 70)) == list(range(71, 81)) and asked(EqualTo(("at",), 7)) == [7]
    assert list(RawMovieReader(options).pushFilters([EqualTo(("frame",), 1)])) == [EqualTo(("frame",), 1)]
    register(spark)
    df = spark.read.format("raw_movies").options(**options).load().where("at between 48 and 52")
    assert df.count() == 5 and df.rdd.getNumPartitions() <= 3
    with pytest.raises(ValueError, match="whole frames"):
        RawMovieReader(options | {"height": "7"}).partitions()


def test_random_references_against_draws_by_hand(spark):
    g = np.random.default_rng(2)
    pdf = pd.DataFrame({"cell": g.integers(0, 2, 3000), "bin": g.integers(0, 3, 3000), "d": g.random(3000) * 360})
    pdf["hit"] = g.random(3000) < np.where((pdf.cell == 0) & (np.abs(pdf.d - 180) < 60), 0.6, 0.1)
    reference = spark.createDataFrame([(c, b, 180.4) for c in range(2) for b in range(3)], "cell long, bin long, degree double")
    got = {(r.cell, r.surrogate): r for r in nulls.random_reference_rates(spark.createDataFrame(pdf), reference, "d", "hit", 10.0, 50, 50, 0.5, 3, "cell", "bin").collect()}
    for (cell, k), row in got.items():
        pref, other = [], []
        for b in range(3):
            own = pdf[(pdf.cell == cell) & (pdf.bin == b)]
            turn = 0 if k == 0 else int(hashlib.md5(f"3:{cell}:{k}:{b}".encode()).hexdigest()[:8], 16) % 360
            near = np.abs((np.floor(own.d) - 180 - turn + 180) % 360 - 180) <= 50
            pref.append(own.hit[near].mean() * 10)
            other.append(own.hit[~near].mean() * 10)
        assert (row.preferred, row.other, row.bins) == pytest.approx((np.mean(pref), np.mean(other), 3))
    rates = nulls.random_reference_rates(spark.createDataFrame(pdf), reference, "d", "hit", 10.0, 50, 50, 0.5, 3, "cell", "bin")
    p = {r.cell: r for r in nulls.random_reference_p(rates, "cell").collect()}
    diff = {k: r.preferred - r.other for k, r in got.items()}
    assert len(got) == 102 and all(p[c].p == (1 + sum(diff[c, k] >= diff[c, 0] - 1e-12 for k in range(1, 51))) / 51 for c in range(2)) and p[0].p < 0.05


@pytest.mark.parametrize("rising", [False, True])
def test_trends_against_a_dense_search(spark, rising):
    g = np.random.default_rng(4)
    t = np.sort(g.random(80)) * 600
    y = (3 - 2 * np.exp(-t / 150) if rising else 1 + 5 * np.exp(-t / 90)) + 0.05 * g.standard_normal(80)
    rows = [(1, float(a), float(b)) for a, b in zip(t, y, strict=True)] + [(2, 1.0, 4.0), (2, 2.0, 6.0), (3, 1.0, 2.0), (3, 2.0, 2.0), (3, 3.0, 2.0)]
    got = {r.cell: r for r in snr.exponential_trend(spark.createDataFrame(rows, "cell long, t double, y double"), "t", "y", rising).collect()}

    def cost(tau):
        x = np.column_stack((np.ones(80), np.exp(-t / tau)))
        return ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()

    taus = np.exp(np.linspace(np.log(20), np.log(1000), 20001))
    best = taus[np.argmin([cost(x) for x in taus])]
    mine = ((y - got[1].a - got[1].b * np.exp(-t / got[1].tau)) ** 2).sum()
    assert got[1].tau == pytest.approx(best, rel=2e-3) and mine <= cost(best) * (1 + 1e-6)
    assert (got[2].a, got[2].b, got[2].tau) == (5.0, 0.0, None) and (got[3].a, got[3].b) == (2.0, 0.0)


def test_signal_to_noise_falls(spark):
    g = np.random.default_rng(5)
    n, rate = 12_000, 100.0
    at = np.arange(50, n - 10, 60)
    v = (0.5 + 0.5 * (1 - np.exp(-np.arange(n) / rate / 60))) * g.standard_normal(n) * 0.2
    v[at] += 2 + 6 * np.exp(-at / rate / 40)
    trace = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "cell long, frame long, v double")
    out = snr.snr_over_time(trace, "v", spark.createDataFrame([(1, int(i)) for i in at], "cell long, frame long"), None, rate).orderBy("frame").toPandas()
    assert len(out) == n and out.height.iloc[0] > 7 and 2 < out.height.iloc[-1] < 3.5 and out.snr.iloc[0] > 2 * out.snr.iloc[-1] and (out.noise.diff().dropna() >= 0).all()


def test_heights_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    g = np.random.default_rng(6)
    rows = [(c, i, float(g.standard_normal()), bool(g.random() < 0.15)) for c in range(3) for i in range(120)]
    kind = "cell long, frame long, v double, spike boolean"
    df = spark.createDataFrame(rows, kind)
    want = snr.spike_heights(df, "v", df.where("spike"), 4)
    for lo in range(0, 120, 40):
        df.where(F.col("frame").between(lo, lo + 39)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = drained(spark, snr.streamed_heights(stream, 4), "heights")
    key = lambda d: sorted((r.cell, r.frame, round(r.height, 9)) for r in d.collect())
    assert key(got) == key(want) and len(key(want)) > 20


def test_random_references_of_many_bins_take_no_running_sums(spark):
    """Arrays of 721 running sums for each of these 2,000 bins took about a minute before."""
    rows = spark.range(2000 * 10).select((F.col("id") % 2000).alias("cell"), F.lit(0).alias("bin"), ((F.col("id") * 37) % 360).cast("double").alias("d"), (F.col("id") % 3 == 0).alias("hit"))
    reference = spark.range(2000).select(F.col("id").alias("cell"), F.lit(0).alias("bin"), F.lit(90.0).alias("degree"))
    began = time.time()
    got = nulls.random_reference_rates(rows, reference, "d", "hit", 10.0, 50, 20, 0.1, 3, "cell", "bin").where("surrogate = 0").toPandas()
    assert time.time() - began < 25
    pdf = rows.toPandas()
    inside = (pdf.d - 40) % 360 <= 100
    want = {c: 10 * g[inside[g.index]].hit.mean() - 10 * g[~inside[g.index]].hit.mean() for c, g in pdf.groupby("cell") if inside[g.index].any() and not inside[g.index].all()}
    assert {r.cell: r.preferred - r.other for r in got.itertuples()} == pytest.approx(want)
