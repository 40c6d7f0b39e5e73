"""Places and running values against plain Python, with groups that span partitions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wayfare.operators.ordered import running, with_place


@pytest.mark.parametrize("parts, batch", [("7", "10000"), ("3", "13"), ("40", "5")])
def test_running_values(spark, parts, batch):
    random.seed(3)
    rows = [(random.choice(["a", None, *["hot"] * 6, f"g{random.randint(0, 40)}"]), i, random.randint(-9, 2**40)) for i in range(900)]
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(old, (parts, batch, "false")):
            spark.conf.set(k, v)
        frame = spark.createDataFrame(rows, "g string, at int, v long").repartition(5)
        found = running(frame, ["g"], ["at"], {"n": F.lit(1), "total": F.col("v")}, {"mix": F.col("v")})
        assert found.columns == ["g", "at", "v", "n", "total", "mix"]
        found = {(r.g, r.at): (r.n, r.total, r.mix) for r in found.collect()}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state, truth = defaultdict(lambda: (0, 0, 0)), {}
    for g, at, v in sorted(rows, key=lambda r: r[1]):
        n, total, mix = state[g]
        state[g] = truth[g, at] = (n + 1, total + v, mix ^ v)
    assert found == truth


def test_places_of_ties_and_nothing(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("b", 2)], "g string, at int")
    assert sorted((r.g, r.position) for r in with_place(frame, ["g"], ["at"]).collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    assert [r.at for r in with_place(frame, ["g"], ["at"]).where("g = 'a' and position = 0").collect()] == [None]
    assert with_place(frame.limit(0), ["g"], ["at"]).count() == 0


def test_no_window_and_no_list_in_the_plan(spark):
    plan = with_place(spark.range(10).selectExpr("id % 2 as g", "id"), ["g"], ["id"])._jdf.queryExecution().toString()
    assert "Window" not in plan and "collect" not in plan
