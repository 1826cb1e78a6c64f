import os

from framewise.scratch import clear, scratch_path, stored


def test_tables_are_cleared(spark):
    df = stored(spark.range(5), "five")
    assert df.count() == 5
    folder = scratch_path(spark, "x").removeprefix("file://").rsplit("/", 1)[0]
    assert os.listdir(folder)
    clear(spark)
    assert not os.path.exists(folder)
