"""The common grid over all sets, against brute force."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401 (registers the queries)
from pointloom.operators import resample
from pointloom.plans.registry import QUERIES, scatter
from tests.oracle import DATA


def _brute(sets):
    """(set, x): y of sets {id: {x: y}} at every place of any set within the set's range."""
    places = np.unique([x for s in sets.values() for x in s])
    out = {}
    for k, s in sets.items():
        known = sorted(x for x, y in s.items() if y is not None)
        if known:
            inside = places[(places >= known[0]) & (places <= known[-1])]
            out |= {(k, x): y for x, y in zip(inside, np.interp(inside, known, [s[x] for x in known]))}
    return out


def test_grid_over_many_places(spark):
    rng = np.random.default_rng(6)
    sets = {k: {round(float(x), 3): float(rng.normal()) for x in np.cumsum(rng.exponential(2.0 ** -(k % 5), 30)) - k} for k in range(40)}
    sets[1][min(sets[1])] = None
    sets[40] = {5.0: None, 6.0: None}
    rows = [(k, i, x, y) for k, s in sets.items() for i, (x, y) in enumerate(s.items())]
    got = resample.grid(spark.createDataFrame(rows, "set_id long, idx long, x double, y double"), "x", "y").collect()
    want = _brute(sets)
    assert len(got) == len(want)
    assert all(abs(r["y"] - want[r["set_id"], r["x"]]) < 1e-9 for r in got)


def test_grid_of_more_than_ten_thousand_sets(spark):
    n = 10_050
    df = spark.range(n).select(F.col("id").alias("set_id"), F.explode(F.array(F.col("id") % 7, F.col("id") % 7 + 2).cast("array<double>")).alias("x")).withColumns({"idx": F.col("x").cast("long"), "y": F.col("x") * 3})
    got = resample.grid(df, "x", "y").agg(F.count("*").alias("n"), F.max(F.abs(F.col("y") - 3 * F.col("x"))).alias("off")).first()
    assert got["n"] == 3 * n and got["off"] < 1e-9


def test_average_curves_are_of_all_sets_and_points(spark):
    sets = {}
    for r in scatter(spark, DATA).select("set_id", "x", "y").collect():
        sets.setdefault(r["set_id"], {}).setdefault(float(r["x"]), []).append(float(r["y"]))
    curve = {}
    for (_, x), y in _brute({k: {x: float(np.mean(v)) for x, v in s.items()} for k, s in sets.items()}).items():
        curve.setdefault(x, []).append(y)
    slope, intercept = np.polyfit(list(curve), [np.mean(v) for v in curve.values()], 1)
    got = QUERIES["workload3_average_curves"](spark, DATA).collect()
    assert len(got) == 1 and got[0]["n"] == len(curve)
    assert abs(got[0]["slope"] - slope) < 1e-3 and abs(got[0]["intercept"] - intercept) < 1e-2
