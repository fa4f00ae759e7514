"""Bands of amounts against plain loops."""

import random

from pyspark.sql import functions as F

from casetrail.operators import bands


def _bounds(amounts, tolerance):
    low, high = bands.band_around_credit("x", tolerance)
    return amounts.withColumns({"lo": low, "hi": high})


def _plain(probes, targets):
    found = {}
    for key, lo, hi in probes:
        values = [v for k, x, v in targets if k == key and lo <= x <= hi]
        if values:
            found[key, lo, hi] = max(values)
    return found


def _check(spark, tolerance, xs, ys):
    probes = _bounds(spark.createDataFrame([(i % 2, x) for i, x in enumerate(xs)], "k int, x bigint"), tolerance)
    targets = [(i % 2, y, i) for i, y in enumerate(ys)]
    best = bands.band_max(probes, spark.createDataFrame(targets, "k int, x bigint, value bigint"), ["k"], tolerance)
    asked = [tuple(r) for r in probes.select("k", "lo", "hi").collect()]
    assert {(r.k, r.lo, r.hi): r.best for r in best.collect()} == _plain(asked, targets)


def test_bands_of_small_and_large_amounts(spark):
    rng = random.Random(3)
    draw = lambda: [rng.randrange(0, rng.choice((60, 400, 3_000, 10**7))) for _ in range(400)]
    for tolerance in (0.05, 0.25):
        _check(spark, tolerance, draw(), draw())


def test_no_tolerance_asks_for_equal_amounts(spark):
    _check(spark, 0, [10_000, 10_001, 5], [10_001, 10_002, 7, 10_000, 5])


def test_a_band_lies_in_few_cells_and_is_sorted_once(spark):
    probes = _bounds(spark.range(10_000, 5_000_000, 997).select(F.lit(1).alias("k"), F.col("id").alias("x")), 0.05)
    targets = spark.range(10).select(F.lit(1).alias("k"), F.col("id").alias("x"), F.col("id").alias("value"))
    cell = bands._cells(0.05)
    assert probes.select(F.max(cell(F.col("hi")) - cell(F.col("lo")))).first()[0] <= 2
    plan = bands.band_max(probes, targets, ["k"], 0.05)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1
