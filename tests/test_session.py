import os

from docloom.session import removed, scratch, stored, written


def test_scratch_keeps_the_last_table(spark):
    with scratch(spark):
        first = written(spark.range(3), "a")
        path = stored(first.where("id > 0"), "b")
    assert spark.read.parquet(path).count() == 2
    gone = first.inputFiles()[0].removeprefix("file:")
    assert not os.path.exists(os.path.dirname(gone))
    removed(spark, path)
    assert not os.path.exists(path.removeprefix("file:"))
