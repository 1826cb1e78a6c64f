from framewise.operators import cells, detectors, traces


def test_heights_depend_on_what_was_accepted(spark):
    windows = spark.createDataFrame([(0, 0, 0, 9), (0, 1, 20, 29)], "cell long, burst long, lo long, hi long")
    spikes = [(0, f, v) for f, v in [(1, 5.0), (2, 30.0), (4, 50.0), (5, 70.0), (7, 100.0), (8, 130.0), (9, None), (21, 19.0), (50, 500.0)]]
    got = detectors.accepted_in_bursts(spark.createDataFrame(spikes, "cell long, frame long, v double"), windows, "v", [20.0, 60.0, 120.0])
    assert {(r.burst, r.frame): r.accepted for r in got.collect()} == {(0, 1): False, (0, 2): True, (0, 4): False, (0, 5): True, (0, 7): False, (0, 8): True, (0, 9): False, (1, 21): False}


def test_place_cells_stand_out(spark):
    rows = [(c, f, (f // 10) % 6, 0, ((f // 10) % 6 == 2 if c == 0 else f % 7 == 0)) for c in range(2) for f in range(600)]
    got = {r.cell: r for r in cells.place_cells(spark.createDataFrame(rows, "cell long, frame long, ix long, iy long, hit boolean"), "hit", 10.0, 40).collect()}
    assert got[0].info > got[1].info and got[0].p <= 0.2 < got[1].p


def test_jumps_take_the_nearest_position(spark):
    x = [0.0, 1.0, 2.0, 3.0, 500.0, 5.0, 6.0, 7.0, 8.0, 9.0]
    df = spark.createDataFrame([(0, f, 100.0 * f, v, 0.0) for f, v in enumerate(x)], "cell long, frame long, ms double, x double, y double")
    got = [(r.x, r.speed) for r in traces.steady_positions(df, 50.0, 1).orderBy("frame").collect()]
    assert [a for a, _ in got] == [0, 1, 2, 2, 2, 7, 7, 7, 8, 9] and max(s for _, s in got) <= 51
