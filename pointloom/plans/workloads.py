"""The three workloads that chain operators: describe conditions, process trajectories, average curves."""

from pyspark.sql import functions as F

from pointloom.operators import compare, resample, smooth
from pointloom.operators import stats as st
from pointloom.operators import windows as wn
from pointloom.operators.points import checkpointed
from pointloom.operators.selection import assign_roles, discard, scale
from pointloom.plans.registry import query, r, scatter, series


def described(spark, d):
    """Roles, scaling, discarding and statistics per set: one scan, one small shuffle after the set's numbering."""
    p = assign_roles(scatter(spark, d), "x", "y", e="e", n="w")
    kept = discard(scale(p, fy=0.001), (F.col("y") > 90) | (F.col("x") < 3)).where("not discarded")
    got = st.describe(kept, ["set_id"], "y", "n")
    return got.select("set_id", "n", *[r(c, 5).alias(c) for c in ("mean", "stdev", "stderr")], r("min").alias("min"), r("max").alias("max"))


query(
    "workload1_describe",
    """WITH {P}, k AS (SELECT set_id, y * 0.001 AS y, w FROM p WHERE NOT (y * 0.001 > 90 OR x < 3)),
b AS (SELECT set_id, count(*) AS n, sum(w) AS w, sum(w * y) AS s1, sum(w * y * y) AS s2, min(y) AS mn, max(y) AS mx FROM k GROUP BY set_id),
v AS (SELECT *, CASE WHEN n > 1 THEN sqrt((n / w * s2 - power(n / w * s1, 2) / n) / (n - 1)) ELSE 0 END AS s FROM b)
SELECT set_id, n, round(s1 / w, 5) AS mean, round(s, 5) AS stdev, round(s / sqrt(n), 5) AS stderr, round(mn, 6) AS min, round(mx, 6) AS max FROM v""",
)(described)


@query("workload2_trajectories")
def trajectories(spark, d):
    """Fill gaps, smooth, resample to a common length, take path lengths, compare neighbours point by point."""
    s = wn.with_gaps_filled(series(spark, d), "y", "y0")
    smoothed = smooth.savitzky_golay(s, "y0", 2, 2, name="y1").select("set_id", "idx", "t", "y1")
    even = resample.spline_resample(smoothed, "t", "y1", 64).select("set_id", "idx", F.col("t").alias("x"), F.col("y1").alias("y"))
    long = checkpointed(wn.with_curve_length(even))  # read three times
    pairs = long.where("set_id % 2 = 0").select(F.col("set_id").alias("set_a"), (F.col("set_id") + 1).alias("set_b")).distinct()
    got = compare.figural_distance(long, pairs, pointwise=True)
    return got.select("set_a", "set_b", "n", r("distance", 4).alias("distance"))


@query("workload3_average_curves")
def average_curves(spark, d):
    """A common grid of x over repetitions, interpolated; their average curve and its line."""
    curve = resample.grid(scatter(spark, d), "x", "y").groupBy("x").agg(F.avg("y").alias("y"), F.count("*").alias("n"))
    fit = st.line_fit(curve.withColumn("g", F.lit(1)), ["g"], "x", "y")
    return fit.select("g", "n", r("slope", 4).alias("slope"), r("intercept", 3).alias("intercept"), r("chi2", 1).alias("chi2"))
