"""Places, sums, values before and last values in the order of groups, against a loop, on groups that lie in many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import same_rows
from tracegrain.operators.ordered import running


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_running_equals_a_loop(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.choice(["a", "b", None, "b", "b"]), i, rng.choice([1, 2, None]), rng.choice([None, None, None, f"v{i}"])) for i in range(2500)]
    rows += [(f"k{i}", 0, 1, None) for i in range(20)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = running(spark.createDataFrame(rows, "g string, t long, x long, v string"), ["g"], [F.col("t")], ["x"], ["v"], ["v"])
        assert got.columns == ["g", "t", "x", "v", "n", "run_x", "prev_v", "last_v"]
        got = [r.asDict() for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    expected, groups = [], {}
    for g, t, x, v in sorted(rows, key=lambda r: r[1]):
        n, total, before, last = groups.get(g, (0, 0, None, None))
        n, total, last = n + 1, total + (x or 0), last if v is None else v
        expected.append({"g": g, "t": t, "x": x, "v": v, "n": n, "run_x": total, "prev_v": before, "last_v": last})
        groups[g] = n, total, v, last
    same_rows(got, expected)


def test_running_of_nothing(spark):
    assert running(spark.createDataFrame([], "g string, t long"), ["g"], [F.col("t")]).count() == 0
