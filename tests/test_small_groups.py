"""Steps over many small groups: no call of Python for each group, and results as by the plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import smooth
from pointloom.operators import stats as st
from pointloom.operators import windows as wn


def _plan(df):
    return df._jdf.queryExecution().toString()


def _sets(spark, sizes=(1, 4, 9, 30, 31), seed=5):
    rng = np.random.default_rng(seed)
    rows = [(None if s == 2 else s, k, None if rng.random() < 0.2 else float(rng.normal()), 0.3 * k if rng.random() < 0.9 else None) for s, n in enumerate(sizes) for k in range(n)]
    return spark.createDataFrame(rows, "set_id long, idx long, v double, t double")


def _by_place(df, *columns):
    return {(r["set_id"], r["idx"]): [r[c] for c in columns] for r in df.collect()}


@pytest.mark.parametrize("args", [{"dt": 0.5, "tau": 2.0}, {"t": "t", "tau": 2.0}, {"dt": 1.0, "tau": 0.0}, {"t": "t", "tau": 1.5, "y": "w"}])
def test_recursive_filters_of_many_blocks(spark, args):
    df = _sets(spark).withColumn("w", F.abs("v"))
    got = smooth.recursive_filters_in_blocks(df, "v", memory=0.4, block=4, **args)
    assert "FlatMapGroups" not in _plan(got)
    want = _by_place(smooth.recursive_filters(df, "v", memory=0.4, **args), "filtered")
    own = _by_place(got, "filtered")
    assert own.keys() == want.keys() and all(np.allclose(own[k], want[k], equal_nan=True) for k in want)


@pytest.mark.parametrize("ends", [{}, {"low": 3.0, "high": -2.0}])
def test_convolutions_of_many_blocks(spark, ends):
    df = _sets(spark).withColumn("u", F.col("v") * 2)
    mask = [0.5, -1.0, 2.0, 0.25, 1.5]
    got = wn.convolved_in_blocks(df, {"c": "v", "d": "u"}, mask, block=20, **ends)
    assert "FlatMapGroups" not in _plan(got)
    plain = wn.convolved(wn.convolved(df, "v", mask, "c", **ends), "u", mask, "d", **ends)
    own, want = _by_place(got, "c", "d"), _by_place(plain, "c", "d")
    assert own.keys() == want.keys()
    for k in want:
        assert [x is None for x in own[k]] == [x is None for x in want[k]] and np.allclose(*([x or 0.0 for x in v] for v in (own[k], want[k])))
    assert wn.convolved_in_blocks(df.limit(0), {"c": "v"}, mask, block=20).count() == 0


def test_robust_fits_of_groups_that_a_task_would_sort_are_whole(spark):
    rng = np.random.default_rng(8)
    groups = {k: (rng.normal(size=12), rng.normal(size=12)) for k in range(3)}
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (x, y) in groups.items() for a, b in zip(x, y)], "k long, x double, y double")
    got = st.robust_fit(df, ["k"], "x", "y", most_rows=4)
    assert "FlatMapGroups" in _plan(got) and "checkpoint" not in _plan(got) and "Generate" not in _plan(got)  # no passes over all rows
    for row in got.collect():
        assert np.allclose([row["slope"], row["intercept"], row["deviation"]], st.robust_fit_arrays(*groups[row["k"]]), atol=1e-6)
