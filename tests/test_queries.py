import datetime

import duckdb
import numpy as np
import pytest

import __spark_entry__
from pointloom.operators import resample
from pointloom.plans.registry import ORACLE, QUERIES, series
from tests.oracle import DATA, compare, connection


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_its_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLE[name]) is None


@pytest.mark.parametrize("name", ["w08_integral", "w08_integral_in_blocks", "w09_integral_resets", "w09_integral_resets_in_blocks"])
def test_integrals_of_odd_sets_against_their_sql(spark, tmp_path, name):
    sets = {1: [0.0, 3.0, None, 2.0], 2: [None, 0.0, 5.0, 1.0], 3: [4.0], 4: [0.0], 5: [None, None, 7.0], 6: [None], 7: [0.0, None, 2.0, 2.5], 8: [1.0, 0.0]}
    rows = [(10 * k + i, datetime.datetime(2024, 1, 1, k, 7 * i), k, "error" if v is None else "view", v or 0.0) for k, vs in sets.items() for i, v in enumerate(vs)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    own = duckdb.connect()
    own.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert compare(spark, own, QUERIES[name], ORACLE[name], str(tmp_path)) is None


def test_queries_without_sql_have_tests_of_their_own():
    assert set(QUERIES) - set(ORACLE) == {"workload2_trajectories", "workload3_average_curves"}  # here and in test_grid


def test_trajectories_against_numpy(spark):
    sets = {}
    for p in series(spark, DATA).collect():
        sets.setdefault(p["set_id"], []).append((p["idx"], p["t"], np.nan if p["y"] is None else p["y"]))
    even = {}
    for k, rows in sets.items():
        _, t, y = np.array(sorted(rows)).T
        at = np.arange(len(y))
        if np.isnan(y).all():
            continue
        y = np.interp(at, at[~np.isnan(y)], y[~np.isnan(y)])
        wide = np.concatenate([[y[0]] * 2, y, [y[-1]] * 2])
        y = np.convolve(wide, np.array([-3, 12, 17, 12, -3]) / 35, "valid")
        grid = np.linspace(t[0], t[-1], 64)
        even[k] = np.stack([grid, resample.spline_at(t, y, resample.natural_spline(t, y), grid)])
    want = {k: np.sqrt(((even[k] - even[k + 1]) ** 2).sum(axis=0)).mean() for k in even if k % 2 == 0 and k + 1 in even}
    got = {r["set_a"]: r["distance"] for r in QUERIES["workload2_trajectories"](spark, DATA).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-3) for k in want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
