"""Rules and edge cases of the operators, each on a small table."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import special
from pointloom.operators import compare, joins, resample, selection, smooth, spectral
from pointloom.operators import stats as st
from pointloom.operators import windows as wn


def _set(spark, values, name="y", set_id=1):
    return spark.createDataFrame([(set_id, i, None if v is None else float(v)) for i, v in enumerate(values)], f"set_id long, idx long, {name} double")


def _column(df, c):
    return [r[c] for r in df.orderBy("set_id", "idx").collect()]


def test_bins_of_none_one_and_zero_weight(spark):
    df = spark.createDataFrame([("one", 4.0, 2.0), ("zero", 4.0, 0.0), ("nan", float("nan"), 1.0), ("inf", float("inf"), 1.0), ("inf", -2.0, 1.0), ("two", 1.0, 1.0), ("two", 3.0, 1.0)], "k string, x double, w double")
    got = {r["k"]: r for r in st.describe(df, ["k"], "x", "w", empty=-9.0).collect()}
    assert (got["one"]["mean"], got["one"]["stdev"], got["one"]["skew"]) == (4.0, 0.0, 0.0)
    assert (got["zero"]["mean"], got["zero"]["stdev"]) == (-9.0, -1.0)
    assert (got["nan"]["n"], got["nan"]["mean"], got["nan"]["stdev"], got["nan"]["stderr"]) == (0, -9.0, -1.0, -1.0)
    assert (got["inf"]["max"], got["inf"]["pos_min"], got["inf"]["neg_max"]) == (math.inf, -1.0, -2.0)
    assert got["two"]["stdev"] == pytest.approx(math.sqrt(2))


def test_scaling_all_weights_changes_nothing(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("k"), F.sin("id").alias("x"), (1 + F.col("id") % 5).cast("double").alias("w"))
    a, b = (sorted(map(tuple, st.describe(d, ["k"], "x", "w").select("k", "mean", "stdev", "skew").collect())) for d in (df, df.withColumn("w", F.col("w") * 7)))
    assert np.allclose(a, b)


def test_special_functions_at_known_values():
    assert special.t_probability(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert special.chi2_probability(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert special.f_probability(4.964602744, 1, 10) / 2 == pytest.approx(0.05, abs=1e-7)
    assert special.incomplete_gamma(2.0, [0.0, 1.0, 50.0]) == pytest.approx([0, 1 - 2 / math.e, 1])
    assert special.incomplete_beta(2, 3, [0, 0.4, 1]) == pytest.approx([0, 0.5248, 1])
    assert special.log_gamma([1, 0.5, 10]) == pytest.approx([0, math.log(math.pi) / 2, math.log(362880)])
    assert np.isnan(special.incomplete_beta(1, 1, 2.0)) and special.t_probability(np.nan, 3) == 2


def test_quantile_of_one_value_and_missing(spark):
    df = _set(spark, [5.0, None])
    assert df.agg(st.quantile("y", 0.25)).first()[0] == 5.0 and df.agg(st.median("y")).first()[0] == 5.0


def test_angles_about_zero(spark):
    got = st.angular(_set(spark, [350, 10, 30, 350]), ["set_id"], "y").first()
    assert got["mean"] == pytest.approx(5.0, abs=0.5) and 10 < got["stdev"] < 25
    u = wn.with_unwrapped(_set(spark, [350, 10, 30, 350]), "y")
    assert _column(u, "unwrapped") == pytest.approx([350, 370, 390, 350])


def test_half_turns_unwrap_to_the_other_side(spark):
    above = 180.00000000000003  # the next number after 180
    for block in (None, 2):
        got = _column(wn.with_unwrapped(_set(spark, [0, 180, 0, above, 360]), "y", block=block), "unwrapped")
        assert got == pytest.approx([0, -180, 0, -180, 0])


def test_f_test_rules(spark):
    rows = spark.createDataFrame([("a", 5, 1.0, 4.0, "b", 5, 2.0, 4.0), ("a", 5, 1.0, 0.0, "c", 4, 1.0, 4.0), ("a", 1, 1.0, 0.0, "d", 4, 1.0, 4.0)], "k1 string, n1 long, m1 double, v1 double, k2 string, n2 long, m2 double, v2 double")
    got = {r["k2"]: r for r in st.t_test_chosen(rows).collect()}
    assert got["b"]["f_p"] == 1.0 and got["c"]["f"] == math.inf and got["c"]["f_p"] == 0.0 and got["d"]["f_p"] == 2.0
    assert got["b"]["t"] == pytest.approx(-1 / math.sqrt(8 / 5)) and got["c"]["c_t"] == got["c"]["u_t"]


def test_gaps_step_and_linear(spark):
    df = _set(spark, [None, 1, None, None, 4, None])
    assert _column(wn.with_gaps_filled(df, "y"), "filled") == [1, 1, 2, 3, 4, 4]
    assert _column(wn.with_gaps_filled(df, "y", linear=False), "filled") == [1, 1, 4, 4, 4, 4]
    assert _column(wn.with_gaps_filled(_set(spark, [None, None]), "y"), "filled") == [None, None]


def test_convolution_identity_clamping_and_gaps(spark):
    df = _set(spark, [3, None, 5, 9])
    assert _column(wn.convolved(df, "y", [1.0]), "convolved") == [3, None, 5, 9]
    assert _column(wn.convolved(_set(spark, [1, 2, 4]), "y", [1.0, 0.0, 10.0]), "convolved") == [21, 41, 42]


def test_integral_first_sample_rules(spark):
    def integral(values, **o):
        df = spark.createDataFrame([(1, i, t, v) for i, (t, v) in enumerate(values)], "set_id long, idx long, t double, v double")
        return _column(wn.with_integral(df, "v", "t", **o), "integral")

    assert integral([(0.0, 2.0), (1.0, 3.0), (3.0, 1.0)]) == pytest.approx([3.0, 6.0, 8.0])  # first value times the mean step of 1.5
    assert integral([(0.0, 0.0), (1.0, 3.0), (3.0, 1.0)]) == pytest.approx([0.0, 0.0, 2.0])
    assert integral([(0.0, None), (1.0, 2.0), (2.0, None), (4.0, 1.0)]) == pytest.approx([0.0, 3.0, 3.0, 6.0])
    got = integral([(0.0, 1.0), (1.0, 1.0), (2.0, None), (3.0, 5.0), (4.0, 1.0)], resets=True)
    assert got[:2] == pytest.approx([1.0, 2.0]) and got[2] is None and got[3:] == pytest.approx([0.0, 1.0])


def test_crop_ties_runs_and_splits(spark):
    assert _column(wn.cropped(_set(spark, [0, 0, 0, 5, 6, 7, 7]), "y"), "y") == [5, 6]
    assert _column(wn.cropped(_set(spark, [0, 5, 6, 7]), "y"), "y") == [0, 5, 6, 7]
    ties = wn.ties_removed(_set(spark, [1, 1, 2, 1, 1]), "y")
    assert _column(ties, "y") == [1, 2, 1] and _column(ties, "unique_idx") == [0, 1, 2]
    assert _column(wn.with_direction_runs(_set(spark, [0, 1, 2, 1, 1, 0, 3]), "y"), "run_id") == [0, 0, 0, 1, 1, 1, 2]
    split = wn.with_splits(wn.with_splits(_set(spark, [1, 9, 1]), F.col("y") > 5, name="a"), F.col("y") > 5, True, "b")
    assert _column(split, "a") == [0, 1, 1] and _column(split, "b") == [0, 0, 1]


def test_signed_length_keeps_its_sign_on_ties(spark):
    df = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate([(1.0, 0.0), (1.0, 1.0), (2.0, 2.0), (1.0, 0.0)])], "set_id long, idx long, x double, y double")
    got = _column(wn.with_curve_length(df, signed=3), "length")
    assert got == pytest.approx([0, 1, 1 + math.sqrt(2), 1 + math.sqrt(2) - math.sqrt(5)])
    assert _column(wn.with_curve_length(df.withColumn("x", F.when(F.col("idx") != 1, F.col("x")))), "length")[:3] == [0, 0, 0]


def test_monotone_and_same(spark):
    df = _set(spark, [1, 2, 2, 3]).unionByName(_set(spark, [3, 2, 4], set_id=2))
    assert sorted(map(tuple, wn.monotone(df, "y").collect())) == [(1, 1, None), (2, 0, 2)]
    assert wn.monotone(df, "y", strict=True).where("set_id = 1").first()["first_against"] == 2
    assert _column(_set(spark, [1, 1, 2]).withColumn("s", wn.stays_same("y", 1)), "s") == [1, 0, -1]


def test_savitzky_golay_masks():
    assert np.allclose(smooth.savitzky_golay_mask(2, 2), np.array([-3, 12, 17, 12, -3]) / 35)
    assert np.allclose(smooth.savitzky_golay_mask(2, 2, 1, 0.5), np.array([-2, -1, 0, 1, 2]) / 10 / 0.5)
    with pytest.raises(ValueError):
        smooth.savitzky_golay_mask(1, 3)


def test_recursive_filters():
    assert smooth.low_pass(np.array([1.0, 1.0, np.nan]), 2.0, np.ones(3)).tolist() == [0.5, 0.75, 0.75]
    assert smooth.shunt(np.full(200, 3.0), np.full(200, 1.0), 2.0, 10.0, np.ones(200))[-1] == pytest.approx(1.0)


def test_splines():
    x = np.array([0.0, 1, 2.5, 4])
    m = resample.natural_spline(x, 2 * x - 1)
    assert np.allclose(m, 0) and resample.spline_integral(x, 2 * x - 1, m, 0, 4) == pytest.approx(12)
    y = np.sin(x)
    m = resample.natural_spline(x, y)
    assert np.allclose(resample.spline_at(x, y, m, x), y) and m[0] == m[-1] == 0
    fine = np.linspace(0, 4, 40_001)
    v = resample.spline_at(x, y, m, fine)
    assert resample.spline_integral(x, y, m, -1, 9) == pytest.approx(((v[1:] + v[:-1]) / 2).sum() * 1e-4, abs=1e-7)
    assert resample.polynomial_at([0, 1, 3], [1, 2, 10], 2) == pytest.approx(5)


def test_splines_and_filters_in_blocks_are_those_of_whole_sets(spark):
    rng, rows = np.random.default_rng(8), []
    for k, n in enumerate((700, 3, 2, 1, 300)):
        x = np.cumsum(rng.exponential(1.0, n))
        y = np.where((rng.random(n) < 0.1) & (np.arange(n) > 0), None, np.sin(x) + rng.normal(0, 0.1, n))
        rows += [(k, i, float(a), None if b is None else float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "set_id long, idx long, x double, y double").repartition(5)
    pieces = resample.spline_pieces(df, "x", "y", block=150).cache()
    order = lambda d, c: [tuple(r) for r in d.select("set_id", "idx", c).orderBy("set_id", "idx").collect()]
    a, b = (order(d, "y") for d in (resample.resampled_pieces(pieces, "x", "y", 40), resample.spline_resample(df, "x", "y", 40)))
    assert [r[:2] for r in a] == [r[:2] for r in b] and np.allclose([r[2] for r in a], [r[2] for r in b], atol=1e-9)
    a, b = ({r["set_id"]: r["integral"] for r in d.collect()} for d in (resample.integrals_of_pieces(pieces, 3.5, 200.0), resample.spline_integrals(df, "x", "y", 3.5, 200.0)))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-8) for k in a)
    for t in ("x", None):
        step = {"t": "x"} if t else {"dt": 0.5}
        a, b = (order(d, "filtered") for d in (smooth.recursive_filters_in_blocks(df, "y", 3.0, memory=0.7, block=64, **step), smooth.recursive_filters(df, "y", 3.0, memory=0.7, **step)))
        assert [r[:2] for r in a] == [r[:2] for r in b] and np.allclose([r[2] for r in a], [r[2] for r in b])


def test_alignment_over_many_parameters(spark):
    df = spark.createDataFrame([(1, i, float(i), float(i * i)) for i in range(6)] + [(2, i, i - 0.331, float(i * i)) for i in range(6)], "set_id long, idx long, x double, y double")
    best = compare.best_alignment(df, spark.createDataFrame([(1, 2)], "set_a long, set_b long"), [{"dx": k / 1000} for k in range(520)]).first()
    assert best["p_id"] == 331 and best["score"] == pytest.approx(0, abs=1e-9)


def test_overlap_of_equal_sets_is_one(spark):
    rows = [(s, i, float(i), 0.5 if i else 0.0) for s in (1, 2, 3) for i in range(4)]
    df = spark.createDataFrame(rows, "set_id long, idx long, y double, e double")
    found = compare.overlap(df, spark.createDataFrame([(1, 2), (2, 3)], "set_a long, set_b long"))
    assert tuple(compare.overall_overlap(found).first()) == (2, 1.0, 0.0, 0.0, 0.0)


def test_spline_drops_end_gaps_and_duplicates(spark):
    df = spark.createDataFrame([(1, 0, 0.0, None), (1, 1, 1.0, 2.0), (1, 2, 1.0, 4.0), (1, 3, 2.0, 5.0)], "set_id long, idx long, x double, y double")
    got = resample.spline_resample(df, "x", "y", 3).orderBy("idx").collect()
    assert [r["x"] for r in got] == [1, 1.5, 2] and got[0]["y"] == 3 and got[2]["y"] == 5
    first = resample.spline_resample(df, "x", "y", 3, duplicates="last").orderBy("idx").first()
    assert first["y"] == 4


def test_spectrum_there_and_back(spark):
    df = _set(spark, [1, 5, None, 2, 8, 3, 4])
    back = spectral.inverse(spectral.spectrum(df, "y"))
    assert np.allclose(_column(back, "value"), [1, 5, 3.5, 2, 8, 3, 4])


def test_long_spectrum_is_that_of_whole_sets(spark):
    rng = np.random.default_rng(5)
    values = [[float(v) for v in rng.normal(0, 3, n)] for n in (1, 2, 97, 500)]
    values[2][0] = values[2][40] = values[2][41] = values[2][96] = None
    df = _set(spark, values[0])
    for k, v in enumerate(values[1:], 2):
        df = df.unionByName(_set(spark, v, set_id=k))
    for cells in (64, 1 << 20):
        got, want = ([tuple(r) for r in f(df).orderBy("set_id", "k").select("set_id", "k", "n", "re", "im", "power").collect()] for f in (lambda d: spectral.long_spectrum(d, "y", cells), lambda d: spectral.spectrum(d, "y")))  # noqa: B023
        assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3:] for r in got], [r[3:] for r in want], atol=1e-9)


def test_bracket_ends_ties_and_tolerance(spark):
    q = spark.createDataFrame([(1, 0.5), (2, 2.0), (3, 2.95), (4, 9.0), (5, None)], "q long, v double")
    ref = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (3.0,)], "v double")
    got = {r["q"]: (r["lower"], r["upper"], r["closest"]) for r in joins.bracket(q, ref, "v").collect()}
    assert got == {1: (None, 1, 1), 2: (2, 2, 2), 3: (2, 3, 3), 4: (3, None, 3)}
    named = joins.bracket(q.withColumnRenamed("v", "x"), ref.select(F.col("v").alias("x"), "v"), "x", ["v"]).where("q = 1").first()  # a payload of any name
    assert (named["lower_v"], named["upper_v"]) == (None, 1)
    near = {r["q"]: (r["lower"], r["upper"]) for r in joins.bracket(q, ref, "v", tolerance=0.1).collect()}
    assert near[3] == (3, 3)


@pytest.mark.parametrize("leaf", [1, 4, 32])
def test_nearest_in_groups_of_uneven_density(spark, leaf):
    rng, rows, asked = np.random.default_rng(leaf), [], []
    for g in range(3):
        dense = np.concatenate([rng.normal(0, 1e-4, (300, 2)), rng.uniform(-50, 50, (40, 2)), np.full((20, 2), 7.0)])
        rows += [(g, i, *map(float, np.round(p, 6))) for i, p in enumerate(dense)]
        asked += [(g, i, *map(float, p)) for i, p in enumerate(np.concatenate([rng.uniform(-500, 500, (15, 2)), rng.normal(0, 1e-4, (15, 2)), [[7.0, 7.0], [7.0, 7.0]]]))]
    q = spark.createDataFrame(asked + [(9, 0, 1.0, 1.0)], "g long, q long, x double, y double")
    ref = spark.createDataFrame(rows + [(1, 999, None, 0.0), (1, 998, float("nan"), 0.0)], "g long, idx long, x double, y double")
    got = {(r["g"], r["q"]): (r["ref_idx"], r["distance"]) for r in joins.nearest(q, ref, ["g"], leaf=leaf, hot_rows=5 * leaf).collect()}
    want = {}
    for g, i, x, y in asked:
        d, k = min(((x - a) ** 2 + (y - b) ** 2, k) for h, k, a, b in rows if h == g)
        want[g, i] = (k, math.sqrt(d))
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_bracket_over_ranges_and_hot_groups(spark):
    rng = np.random.default_rng(3)
    q = [(i, int(rng.choice([0, 0, 0, 1, 2])), float(rng.integers(0, 400))) for i in range(500)]
    ref = [(int(rng.choice([0, 0, 1])), float(rng.integers(100, 300))) for _ in range(200)]
    qs, refs = spark.createDataFrame(q, "q long, g long, v double"), spark.createDataFrame(ref, "g long, v double")
    for by in ([], ["g"]):
        got = {r["q"]: (r["lower"], r["upper"]) for r in joins.bracket(qs, refs, "v", by=by, spread=True).collect()}
        own = {i: [v for h, v in ref if not by or h == g] for i, g, _ in q}
        assert got == {i: (max((w for w in own[i] if w <= v), default=None), min((w for w in own[i] if w >= v), default=None)) for i, _, v in q}


def test_nearest_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(0, 100, (40, 2)), np.concatenate([rng.uniform(0, 100, (60, 2)), rng.uniform(40, 41, (200, 2))])
    q = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)] + [(99, None, 1.0)], "q long, x double, y double")
    r = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(b)], "idx long, x double, y double")
    got = {g["q"]: g["ref_idx"] for g in joins.nearest(q, r).collect()}
    assert got == {i: int(((b - p) ** 2).sum(axis=1).argmin()) for i, p in enumerate(a)}
    assert joins.nearest(q, r.limit(0)).count() == 0
    beside = {g["q"]: g["ref_idx"] for g in joins.nearest_or_beside(q, r).collect()}
    assert beside == got | {99: int(np.abs(b[:, 1] - 1.0).argmin())}


def test_figures_of_equal_and_turned_sets(spark):
    rng = np.random.default_rng(2)
    p = [(1, i, *map(float, v)) for i, v in enumerate(rng.uniform(0, 10, (25, 2)))]
    df = spark.createDataFrame(p + [(2, *r[1:]) for r in p], "set_id long, idx long, x double, y double").withColumn("e", F.col("x"))
    pair = spark.createDataFrame([(1, 2)], "set_a long, set_b long")
    assert compare.figural_distance(df, pair).first()["distance"] == 0 and compare.closeness(df, pair).first()["closeness_y"] == 1
    x, y = selection.shift_rotate(F.col("x"), F.col("y"), 90, 1.0, (0, 0), (3, 0))
    turned = df.withColumns({"x": F.when(F.col("set_id") == 2, x).otherwise(F.col("x")), "y": F.when(F.col("set_id") == 2, y).otherwise(F.col("y"))})
    grid = [{"angle": a, "dy": d} for a in (0, 90, -90) for d in (0, 3)]
    best = compare.best_alignment(turned, pair, grid).first()
    assert grid[best["p_id"]] == {"angle": -90, "dy": 3} and best["score"] == pytest.approx(0, abs=1e-9)
    there, back = compare.figural_distance(turned, pair).first(), compare.figural_distance(turned, spark.createDataFrame([(2, 1)], "set_a long, set_b long")).first()
    assert there["distance"] == pytest.approx(back["distance"])


def test_robust_line_shrugs_off_an_outlier():
    x = np.arange(21.0)
    y = 3 * x - 2
    y[20] = 1e4
    slope, intercept, _ = st.robust_fit_arrays(x, y)
    assert slope == pytest.approx(3, abs=1e-6) and intercept == pytest.approx(-2, abs=1e-5)
    assert st.robust_fit_arrays(np.array([1.0]), np.array([4.0]))[:2] == (0.0, 4.0)


def test_crude_bins(spark):
    assert st.crude_bin_starts(np.array([0, 0.4, 0.9, 1.0, 1.9]), 1.0).tolist() == [0, 0, 0, 1.0, 1.0]
    df = _set(spark, [0, 0, 0.9, 5])
    assert sorted({r["bin"] for r in st.crude_bins(df, "y", 1.0).collect()}) == pytest.approx([0.3, 5])


@pytest.mark.parametrize("domain,eps", [("linear", 1.0), ("log10", 0.2)])
def test_crude_bins_by_leaps_are_those_of_the_scan(spark, domain, eps):
    rng = np.random.default_rng(4)
    df = _set(spark, [float(v) for v in np.round(rng.uniform(1, 60, 300), 3)])
    plain = lambda d: sorted((r["idx"], round(r["bin"], 9)) for r in d.collect())
    assert plain(st.crude_bins(df, "y", eps, domain, most_values=5)) == plain(st.crude_bins(df, "y", eps, domain))


def test_histogram_adds_up(spark):
    h = st.histogram(_set(spark, [1, 1, 2, None]), "y", normalise="sum")
    assert sum(r["h"] for r in h.collect()) == pytest.approx(1)


@pytest.mark.parametrize("parts", [1, 16])
def test_results_do_not_depend_on_partitions(spark, parts):
    df = spark.range(500).select((F.col("id") % 3).alias("set_id"), F.floor(F.col("id") / 3).alias("idx"), F.sin("id").alias("y")).repartition(parts)
    a = _column(wn.running_sum_in_blocks(df, "y", block=20), "running")
    b = _column(df.withColumn("running", F.sum("y").over(wn.running())), "running")
    assert np.allclose(a, b)


def test_listed_pairs_of_bins(spark):
    df = spark.createDataFrame([("abc"[i % 3], float(i * i)) for i in range(12)], "k string, x double")
    listed = spark.createDataFrame([("c", "a"), ("a", "zz"), ("b", "b")], "k1 string, k2 string")
    bins = st.bins(df, ["k"], "x")
    got, every = st.pairs_of(bins, "k", listed), st.pairs_of(bins, "k")
    assert sorted((r["k1"], r["k2"]) for r in got.collect()) == [("b", "b"), ("c", "a")] and got.columns == every.columns
    assert every.count() == 3


@pytest.mark.parametrize("cells", [6, 1 << 22])
def test_long_inverse_and_convolution_are_those_of_whole_sets(spark, cells):
    rng = np.random.default_rng(cells % 97)
    rows = [(g, i, None if i % 11 == 5 else float(rng.normal())) for g, n in ((1, 1), (2, 2), (3, 7), (4, 24)) for i in range(n)]
    df = spark.createDataFrame(rows, "set_id long, idx long, y double")
    f = spectral.spectrum(df, "y").cache()
    mask = [0.1, -0.2, 0.9, 0.3, 0.1]
    cases = [(lambda s, **o: getattr(spectral, s + "inverse")(f.where("k < 3"), **o)), (lambda s, **o: getattr(spectral, s + "inverse")(f, False, **o))]
    cases += [(lambda s, back=back, **o: getattr(spectral, s + "cyclic_convolution")(df, "y", mask, back, **o)) for back in (False, True)]
    for case in cases:
        got, want = (sorted(map(tuple, d.select("set_id", "idx", "value").collect())) for d in (case("long_", cells=cells), case("")))
        assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-9)
