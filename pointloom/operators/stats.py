"""Statistics per bin: sums, moments, quantiles, angles, tests, histograms, fits.

Every aggregate leaves out null and NaN values (and infinite ones with ``finite=True``). Sums are partial
aggregates, so a hot bin is summed where its rows are. Exact quantiles as columns keep a bin's distinct values in
memory; for bins of any size there are ``order_stats.quantiles`` and its like, also exact, and ``approximate``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.special import chi2_probability_udf, f_probability_udf, t_probability_udf
from pointloom.operators.joins import bracket
from pointloom.operators.order_stats import BROADCAST_BINS, medians
from pointloom.operators.points import checkpointed, column

MAD = 1.482602218505602
TAU = 2 * math.pi


def _valid(x: Column, finite: bool = False) -> Column:
    ok = x.isNotNull() & ~F.isnan(x)
    return ok & (F.abs(x) < float("inf")) if finite else ok


def sums(x: str | Column, w: str | Column | None = None, finite: bool = False) -> dict[str, Column]:
    """Aggregates of a bin: n, w_sum, s1, s2, s3, min, max, pos_min, neg_max (the last two -1 and 1 if there are none)."""
    x = column(x).cast("double")
    w = F.lit(1.0) if w is None else column(w).cast("double")
    ok = _valid(x, finite) & _valid(w)
    x, w = F.when(ok, x), F.when(ok, w)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return {
        "n": F.count(x),
        "w_sum": zero(w),
        "s1": zero(w * x),
        "s2": zero(w * x * x),
        "s3": zero(w * x * x * x),
        "min": F.min(x),
        "max": F.max(x),
        "pos_min": F.coalesce(F.min(F.when((x > 0) & (x < float("inf")), x)), F.lit(-1.0)),
        "neg_max": F.coalesce(F.max(F.when((x < 0) & (x > float("-inf")), x)), F.lit(1.0)),
    }


def mean(empty: float | None = None, n: str = "n", w_sum: str = "w_sum", s1: str = "s1") -> Column:
    """Weighted mean from a bin's sums; an empty bin gives ``empty``."""
    return F.when((F.col(n) > 0) & (F.col(w_sum) != 0), F.col(s1) / F.col(w_sum)).otherwise(F.lit(empty).cast("double"))


def variance() -> Column:
    """Weights scaled to add up to n, then the sample formula; 0 for one value, null for none."""
    n, f = F.col("n"), F.col("n") / F.col("w_sum")
    v = (f * F.col("s2") - F.pow(f * F.col("s1"), 2) / n) / (n - 1)
    return F.when((n == 0) | (F.col("w_sum") <= 0), None).when(n == 1, 0.0).otherwise(F.greatest(v, F.lit(0.0)))


def stdev() -> Column:
    return F.coalesce(F.sqrt(variance()), F.lit(-1.0))


def stderr() -> Column:
    return F.coalesce(F.sqrt(variance() / F.col("n")), F.lit(-1.0))


def cv() -> Column:
    """Standard deviation over the mean; null for a mean of 0."""
    return F.when(F.col("s1") != 0, stdev() / mean())


def skew_ref() -> Column:
    """(3 m S2 - S3 - 2 S1^3 / n^2) / (s n) of the scaled sums; 0 for one value or no spread."""
    n, f, s = F.col("n"), F.col("n") / F.col("w_sum"), F.sqrt(variance())
    s1, s2, s3 = (f * F.col(c) for c in ("s1", "s2", "s3"))
    top = 3 * (s1 / n) * s2 - s3 - 2 * s1 * s1 * s1 / (n * n)
    return F.when((n > 1) & (s > 0), top / (s * n)).otherwise(0.0)


def bins(df: DataFrame, by: list[str], x: str | Column, w: str | Column | None = None, finite: bool = False) -> DataFrame:
    """One row of sums per bin."""
    return df.groupBy(*by).agg(*[c.alias(k) for k, c in sums(x, w, finite).items()])


def describe(df: DataFrame, by: list[str], x: str | Column, w: str | Column | None = None, empty: float | None = None) -> DataFrame:
    """The bins' sums with mean, stdev, stderr, cv and skew."""
    return bins(df, by, x, w).withColumns({"mean": mean(empty), "stdev": stdev(), "stderr": stderr(), "cv": cv(), "skew": skew_ref()})


def median(x: str | Column) -> Column:
    x = column(x)
    return F.median(F.when(_valid(x), x))


def quantile(x: str | Column, p: float, approximate: bool = False, accuracy: int = 10_000) -> Column:
    """By linear interpolation between order statistics; a single value is its own quantile."""
    x = F.when(_valid(column(x)), column(x))
    return F.percentile_approx(x, p, accuracy) if approximate else F.percentile(x, p)


def median_deviation(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Median and median absolute deviation times 1.4826 per bin; the medians (one row per bin) are joined back."""
    centre = df.groupBy(*by).agg(median(x).alias("median"))
    off = df.join(centre, by).withColumn("_off", F.abs(F.col(x) - F.col("median")))
    return off.groupBy(*by).agg(F.first("median").alias("median"), (median("_off") * MAD).alias("adev"))


def stdev_two_pass(df: DataFrame, by: list[str], x: str, w: str) -> DataFrame:
    """n, mean and stdev with the mean joined back, for values far from 0."""
    centre = df.groupBy(*by).agg((F.sum(F.col(w) * F.col(x)) / F.sum(w)).alias("mean"))
    off = df.join(centre, by)
    square = F.sum(F.col(w) * F.pow(F.col(x) - F.col("mean"), 2)) * F.count(x) / F.sum(w) / (F.count(x) - 1)
    return off.groupBy(*by).agg(F.count(x).alias("n"), F.first("mean").alias("mean"), F.when(F.count(x) > 1, F.sqrt(square)).otherwise(0.0).alias("stdev"))


def fold(difference: Column, base: float) -> Column:
    """A difference of angles brought to [-base/2, base/2)."""
    half = base / 2
    return F.pmod(difference + half, F.lit(float(base))) - half


def angular(df: DataFrame, by: list[str], x: str, w: str | None = None, base: float = 360.0) -> DataFrame:
    """n, mean direction in [0, base) and spread (weighted sample stdev of the folded differences) per bin."""
    weight = F.lit(1.0) if w is None else F.col(w)
    theta = F.col(x) * (TAU / base)
    two = df.where(_valid(F.col(x))).groupBy(*by).agg(F.sum(weight * F.cos(theta)).alias("c_sum"), F.sum(weight * F.sin(theta)).alias("s_sum"), F.sum(weight).alias("w_sum"), F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"))
    centre = two.withColumn("mean", F.pmod(F.atan2("s_sum", "c_sum") * (base / TAU), F.lit(float(base))))
    off = df.where(_valid(F.col(x))).join(centre.select(*by, "mean"), by).withColumn("_d", fold(F.col(x) - F.col("mean"), base))
    spread = off.groupBy(*by).agg(F.sum(weight * F.col("_d") * F.col("_d")).alias("_dd"), F.sum(weight * F.col("_d")).alias("_d1"))
    v = (F.col("_dd") - F.col("_d1") * F.col("_d1") / F.col("w_sum")) * F.col("n") / F.col("w_sum") / (F.col("n") - 1)
    return centre.join(spread, by).withColumn("stdev", F.when(F.col("n") > 1, F.sqrt(F.greatest(v, F.lit(0.0)))).otherwise(0.0)).withColumn("cv", F.when(F.col("mean") != 0, F.col("stdev") / F.col("mean"))).drop("_dd", "_d1")


def pairs_of(bins_: DataFrame, key: str, pairs: DataFrame | None = None) -> DataFrame:
    """Two bins a row (k1, k2), by n, mean and variance; the table of bins is one row per bin.

    ``pairs`` (k1, k2) lists the bins to be held against each other, in either order; a pair of which a bin is missing
    has no row, one listed twice has two. Without it each two different bins are a pair: the square of their number.
    """
    one = bins_.select(F.col(key).alias("k"), "n", mean().alias("m"), variance().alias("v"))
    a, b = (one.select(*[F.col(c).alias(c + i) for c in ("k", "n", "m", "v")]) for i in "12")
    if pairs is not None:
        return pairs.select("k1", "k2").join(a, "k1").join(b, "k2").select(*a.columns, *b.columns)
    return a.join(b, F.col("k1") < F.col("k2"))


def f_test(pairs: DataFrame) -> DataFrame:
    """f, f_df1, f_df2 and f_p; equal variances and counts have p 1, fewer than two values p 2."""
    first = F.col("v1") >= F.col("v2")
    f = F.when((F.col("v1") == 0) & (F.col("v2") == 0), 1.0).when(F.least("v1", "v2") == 0, float("inf")).otherwise(F.try_divide(F.greatest("v1", "v2"), F.least("v1", "v2")))
    out = pairs.withColumns({"f": f, "f_df1": F.when(first, F.col("n1")).otherwise(F.col("n2")) - 1, "f_df2": F.when(first, F.col("n2")).otherwise(F.col("n1")) - 1})
    p = F.when((F.col("n1") < 2) | (F.col("n2") < 2), 2.0).when((F.col("v1") == F.col("v2")) & (F.col("n1") == F.col("n2")), 1.0).when(F.col("f") == float("inf"), 0.0)
    return out.withColumn("f_p", p.otherwise(f_probability_udf(F.col("f"), F.col("f_df1").cast("double"), F.col("f_df2").cast("double"))))


def t_test(pairs: DataFrame) -> DataFrame:
    """t, t_df and t_p for equal variances; 2 marks an error."""
    df = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / F.nullif(df, F.lit(0))
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(pooled * (F.try_divide(F.lit(1.0), "n1") + F.try_divide(F.lit(1.0), "n2"))))
    out = pairs.withColumns({"t": t, "t_df": df.cast("double")})
    return out.withColumn("t_p", F.coalesce(t_probability_udf("t", "t_df"), F.lit(2.0)))


def t_test_unequal(pairs: DataFrame) -> DataFrame:
    """u_t, u_df and u_p for unequal variances (Welch)."""
    a, b = F.col("v1") / F.nullif(F.col("n1"), F.lit(0)), F.col("v2") / F.nullif(F.col("n2"), F.lit(0))
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(a + b))
    df = F.try_divide((a + b) * (a + b), F.try_divide(a * a, F.col("n1") - 1) + F.try_divide(b * b, F.col("n2") - 1))
    out = pairs.withColumns({"u_t": t, "u_df": df})
    return out.withColumn("u_p", F.coalesce(t_probability_udf("u_t", "u_df"), F.lit(2.0)))


def t_test_chosen(pairs: DataFrame, most: float = 0.05) -> DataFrame:
    """The test for unequal variances where the F-test's p is below ``most``, else that for equal ones."""
    out = t_test_unequal(t_test(f_test(pairs)))
    unequal = F.col("f_p") < most
    return out.withColumns({"c_t": F.when(unequal, F.col("u_t")).otherwise(F.col("t")), "c_p": F.when(unequal, F.col("u_p")).otherwise(F.col("t_p"))})


def t_test_paired(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """n, t, df and p of paired values per group."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    g = pairs.where(both).groupBy(*by).agg(F.count("*").alias("n"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.covar_samp(a, b).alias("c"))
    t = F.try_divide(F.col("ma") - F.col("mb"), F.sqrt((F.col("va") + F.col("vb") - 2 * F.col("c")) / F.col("n")))
    out = g.withColumns({"t": t, "df": (F.col("n") - 1).cast("double")}).drop("ma", "mb", "va", "vb", "c")
    return out.withColumn("p", F.coalesce(t_probability_udf("t", "df"), F.lit(2.0)))


def chi2(rows: DataFrame, by: list[str], observed: str, expected: str, constraints: int = 1) -> DataFrame:
    """chi2, df and p of observed against expected counts per group."""
    term = F.try_divide(F.pow(F.col(observed) - F.col(expected), 2), F.col(expected))
    g = rows.groupBy(*by).agg(F.sum(term).alias("chi2"), (F.count("*") - constraints).cast("double").alias("df"))
    return g.withColumn("p", chi2_probability_udf("chi2", "df"))


def chi2_two(rows: DataFrame, by: list[str], a: str, b: str, constraints: int = 1) -> DataFrame:
    """chi2, df and p of two observed distributions over bins; bins empty on both sides drop a degree of freedom."""
    totals = rows.groupBy(*by).agg(F.sum(a).alias("_sa"), F.sum(b).alias("_sb"))
    joined = rows.join(totals, by)
    ra, rb = F.sqrt(F.col("_sb") / F.col("_sa")), F.sqrt(F.col("_sa") / F.col("_sb"))
    term = F.try_divide(F.pow(ra * F.col(a) - rb * F.col(b), 2), F.col(a) + F.col(b))
    fixed = F.when(F.first("_sa") == F.first("_sb"), constraints).otherwise(max(1, constraints))
    used = F.count(F.when(F.col(a) + F.col(b) > 0, 1))
    g = joined.groupBy(*by).agg(F.sum(term).alias("chi2"), (used - fixed).cast("double").alias("df"))
    return g.withColumn("p", chi2_probability_udf("chi2", "df"))


def histogram(df: DataFrame, x: str, by: list[str] = [], classes: DataFrame | None = None, normalise: str | None = None) -> DataFrame:  # noqa: B006
    """How often each value occurs, or each of the given ``classes`` (a table of one column, each class once, missing
    ones with 0); normalised by the total matched or by the largest count."""
    counts = df.where(_valid(F.col(x).cast("double"))).groupBy(*by, F.col(x).alias("value")).agg(F.count("*").cast("double").alias("h"))
    if classes is not None:
        if by:
            raise ValueError("classes are for the whole table")
        counts = classes.select(F.col(classes.columns[0]).alias("value")).distinct().join(counts, "value", "left").fillna(0.0, ["h"])
    if normalise:
        whole = {"sum": F.sum, "max": F.max}[normalise]("h")
        if by:
            return counts.withColumn("h", F.col("h") / whole.over(Window.partitionBy(*by)))
        names = counts.columns
        counts = counts.crossJoin(F.broadcast(counts.agg(whole.alias("_whole")))).withColumn("h", F.try_divide(F.col("h"), F.col("_whole"))).select(*names)  # with one row
    return counts


def line_fit(df: DataFrame, by: list[str], x: str, y: str, e: str | None = None) -> DataFrame:
    """Least-squares line: n, slope, intercept, their uncertainties, chi2 and goodness (1 without errors).

    Rows with a missing value are left out; an error of 0 counts as half the smallest non-zero one of the group.
    """
    rows = df.where(_valid(F.col(x)) & _valid(F.col(y)) & (_valid(F.col(e)) if e else F.lit(True)))
    if e:
        least = rows.groupBy(*by).agg(F.min(F.when(F.col(e) != 0, F.abs(e))).alias("_least"))
        rows = rows.join(least, by).withColumn("_s", F.when(F.col(e) == 0, F.coalesce(F.col("_least") / 2, F.lit(1.0))).otherwise(F.abs(F.col(e))))
        w = 1 / (F.col("_s") * F.col("_s"))
    else:
        w = F.lit(1.0)
    # centred sums, for precision
    centre = rows.groupBy(*by).agg(F.sum(w).alias("_w"), (F.sum(w * F.col(x)) / F.sum(w)).alias("_mx"), (F.sum(w * F.col(y)) / F.sum(w)).alias("_my"))
    off = rows.join(centre, by).withColumns({"_dx": F.col(x) - F.col("_mx"), "_dy": F.col(y) - F.col("_my")})
    g = off.groupBy(*by).agg(F.count("*").alias("n"), F.first("_w").alias("_w"), F.first("_mx").alias("_mx"), F.first("_my").alias("_my"), F.sum(w * F.col("_dx") * F.col("_dx")).alias("_xx"), F.sum(w * F.col("_dx") * F.col("_dy")).alias("_xy"), F.sum(w * F.col("_dy") * F.col("_dy")).alias("_yy"))
    slope = F.try_divide("_xy", "_xx")
    out = g.withColumn("slope", slope).withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx"))
    out = out.withColumn("chi2", F.greatest(F.col("_yy") - F.col("slope") * F.col("_xy"), F.lit(0.0)))
    ds, di = F.sqrt(F.try_divide(F.lit(1.0), "_xx")), F.sqrt(1 / F.col("_w") + F.try_divide(F.col("_mx") * F.col("_mx"), "_xx"))
    df_ = (F.col("n") - 2).cast("double")
    if e:
        out = out.withColumns({"d_slope": ds, "d_intercept": di, "goodness": F.when(df_ > 0, chi2_probability_udf(F.col("chi2"), df_)).otherwise(1.0)})
    else:
        s = F.sqrt(F.try_divide(F.col("chi2"), df_))
        out = out.withColumns({"d_slope": ds * s, "d_intercept": di * s, "goodness": F.lit(1.0)})
    return out.select(*by, "n", "slope", "intercept", "d_slope", "d_intercept", "chi2", "goodness")


def robust_fit_arrays(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope, intercept and mean absolute deviation of the line of least absolute deviations.

    The sign of sum x * sign(y - a - b x), with a the median of y - b x, is bracketed about the least-squares slope
    and bisected.
    """
    n = len(x)
    if n == 0:
        return math.nan, math.nan, math.nan
    dx = x - x.mean()
    square = float(dx @ dx)
    if n < 2 or square == 0:
        a = float(np.median(y))
        return 0.0, a, float(np.abs(y - a).mean())
    slope = float(dx @ y) / square

    def balance(b: float) -> float:
        rest = y - b * x
        off = rest - np.median(rest)
        off[np.abs(off) < 1e-12 * max(1.0, float(np.abs(y).max()))] = 0
        return float(x @ np.sign(off))

    width = 3 * math.sqrt(max(float(((y - y.mean() - slope * dx) ** 2).sum()), 1e-300) / max(n - 2, 1) / square) or 1e-9
    f0 = balance(slope)
    low, high = slope, slope
    if f0:
        step = math.copysign(width, f0)
        high = slope + step
        for _ in range(200):
            if balance(high) * f0 <= 0:
                break
            low, high, step = high, high + 2 * step, 2 * step
        for _ in range(100):
            mid = (low + high) / 2
            if balance(mid) * f0 > 0:
                low = mid
            else:
                high = mid
            if abs(high - low) <= 1e-12 * max(1.0, abs(mid)):
                break
    best = min((low, high), key=lambda b: np.abs(y - b * x - np.median(y - b * x)).sum())
    a = float(np.median(y - best * x))
    return best, a, float(np.abs(y - a - best * x).mean())


def _robust_fit_over_tasks(df: DataFrame, by: list[str], x: str, y: str, most_rows: int, slopes: int = 32) -> DataFrame:
    """As :func:`robust_fit` for groups of any size, all at once.

    Each pass tries ``slopes`` + 1 slopes of a group's bracket: the median of y - b x of each is found by distributed
    selection, and the sign of sum x * sign(y - a - b x) tells which two of them the line of least deviations lies
    between, or on which side the bracket must move on.
    """
    rows = checkpointed(df.select(F.struct(*by).alias("bin"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(_valid(F.col("x")) & _valid(F.col("y"))))
    n, vx, cov = F.count("*"), F.var_pop("x"), F.covar_pop("x", "y")
    start = rows.groupBy("bin").agg(n.alias("n"), vx.alias("vx"), F.coalesce(F.try_divide(cov, vx), F.lit(0.0)).alias("slope"), F.var_pop("y").alias("vy"), cov.alias("cov"), F.max(F.abs("y")).alias("top"))
    rest = F.greatest(F.col("n") * (F.col("vy") - F.col("slope") * F.col("cov")), F.lit(1e-300))
    width = 3 * F.sqrt(F.try_divide(rest / F.greatest(F.col("n") - 2, F.lit(1)), F.col("n") * F.col("vx")))
    flat = (F.col("vx") == 0) | (F.col("n") < 2)
    width = F.when(flat, 0.0).otherwise(F.greatest(F.coalesce(width, F.lit(0.0)), F.lit(1e-9)))
    state = checkpointed(start.select("bin", "n", (1e-12 * F.greatest(F.lit(1.0), "top")).alias("zero"), (F.col("slope") - width).alias("low"), (F.col("slope") + width).alias("high")))
    few = state.count() <= BROADCAST_BINS  # groups of more than most_rows rows, so they are few

    def residuals(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows with what is left of y, and the medians of that, for each line (bin, i, b)."""
        met = rows.join(F.broadcast(lines) if few else lines, "bin").withColumn("r", F.col("y") - F.col("b") * F.col("x"))
        return met, checkpointed(medians(met, ["bin", "i"], "r", most_rows).select("bin", "i", F.col("median").alias("a")))

    for _ in range(60):
        tight = F.col("high") - F.col("low") <= 1e-12 * F.greatest(F.lit(1.0), F.abs(F.col("low") + F.col("high")) / 2)
        going = checkpointed(state.withColumn("tight", tight))
        if not going.where("NOT tight").limit(1).count():
            break
        lines = going.where("NOT tight").select("bin", "zero", "low", "high", F.posexplode(F.array(*[F.col("low") + (F.col("high") - F.col("low")) * (k / slopes) for k in range(slopes + 1)])).alias("i", "b"))
        met, centres = residuals(lines)
        off = F.col("r") - F.col("a")
        sign = F.when(F.abs(off) < F.col("zero"), 0.0).otherwise(F.signum(off))
        joined_ = met.join(F.broadcast(centres) if few else centres, ["bin", "i"])
        balance = joined_.groupBy("bin", "i").agg(F.sum(F.col("x") * sign).alias("f"), F.first("b").alias("b"))
        # it falls as the slope grows
        turn = balance.groupBy("bin").agg(F.max(F.when(F.col("f") > 0, F.struct("i", "b"))).alias("above"), F.min(F.when(F.col("f") <= 0, F.struct("i", "b"))).alias("below"))
        span = F.col("high") - F.col("low")
        low = F.when(F.col("above").isNull(), F.col("low") - 4 * span).when(F.col("below").isNull(), F.col("high")).otherwise(F.col("above.b"))
        high = F.when(F.col("above").isNull(), F.col("low")).when(F.col("below").isNull(), F.col("high") + 4 * span).otherwise(F.col("below.b"))
        moved = going.where("NOT tight").join(turn, "bin").select("bin", "n", "zero", low.alias("low"), high.alias("high"))
        state = checkpointed(going.where("tight").drop("tight").unionByName(moved))
    met, centres = residuals(state.select("bin", F.posexplode(F.array("low", "high")).alias("i", "b")))
    of = met.join(F.broadcast(centres) if few else centres, ["bin", "i"]).groupBy("bin", "i").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("r") - F.col("a"))).alias("deviation"), F.first("b").alias("slope"), F.first("a").alias("intercept"))
    best = of.groupBy("bin").agg(F.min(F.struct("deviation", "i", "n", "slope", "intercept")).alias("f"))
    return best.select(*[f"bin.{k}" for k in by], "f.n", "f.slope", "f.intercept", "f.deviation")


def robust_fit(df: DataFrame, by: list[str], x: str, y: str, most_rows: int = 1_000_000, sort_rows: int = 1_000_000) -> DataFrame:
    """Line of least absolute deviations per group: n, slope, intercept and mean absolute deviation.

    Groups of up to ``most_rows`` rows are one task's work each, and so are those of up to ``sort_rows``, of which a task
    would sort all residuals for each median; larger ones are fitted over all tasks.
    """
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    bin_ = F.struct(*by).alias("_bin")
    large = checkpointed(df.groupBy(bin_).agg(F.count(F.when(ok, 1)).alias("_n")).where(F.col("_n") > max(most_rows, sort_rows)).select("_bin"))
    n_large = large.count()
    if not n_large:
        return _robust_fit_in_tasks(df, by, x, y)
    there = F.broadcast(large) if n_large <= BROADCAST_BINS else large
    split = df.select(*by, x, y, bin_)
    small = _robust_fit_in_tasks(split.join(there, "_bin", "left_anti"), by, x, y)
    return small.unionByName(_robust_fit_over_tasks(split.join(there, "_bin", "left_semi"), by, x, y, sort_rows))


def _robust_fit_in_tasks(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    keys = {c: df.schema[c].dataType.simpleString() for c in by}

    def one(key, frame: pd.DataFrame) -> pd.DataFrame:
        ok = frame[[x, y]].dropna()
        b, a, dev = robust_fit_arrays(ok[x].to_numpy(float), ok[y].to_numpy(float))
        return pd.DataFrame([[*key, len(ok), b, a, dev]])

    schema = ", ".join([f"{c} {t}" for c, t in keys.items()] + ["n long, slope double, intercept double, deviation double"])
    return df.select(*by, x, y).groupBy(*by).applyInPandas(one, schema)


def correlation(pairs: DataFrame, by: list[str], parts: list[tuple[str, str]]) -> DataFrame:
    """Pearson correlation of each pair of columns, and their mean weighted by the numbers of points."""
    aggs = []
    for k, (a, b) in enumerate(parts):
        aggs += [F.corr(a, b).alias(f"r{k}"), F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias(f"n{k}")]
    g = pairs.groupBy(*by).agg(*aggs)
    used = [F.col(f"r{k}").isNotNull() & ~F.isnan(f"r{k}") for k in range(len(parts))]
    top = sum((F.when(u, F.col(f"r{k}") * F.col(f"n{k}")).otherwise(0.0) for k, u in enumerate(used)), F.lit(0.0))
    low = sum((F.when(u, F.col(f"n{k}")).otherwise(0) for k, u in enumerate(used)), F.lit(0))
    return g.withColumn("r", F.try_divide(top, low.cast("double")))


def correlation_two_pass(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """The correlation from products about the means, which are joined back."""
    centre = pairs.groupBy(*by).agg(F.avg(a).alias("_ma"), F.avg(b).alias("_mb"))
    off = pairs.join(centre, by).withColumns({"_a": F.col(a) - F.col("_ma"), "_b": F.col(b) - F.col("_mb")})
    g = off.groupBy(*by).agg(F.sum(F.col("_a") * F.col("_b")).alias("_ab"), F.sum(F.col("_a") * F.col("_a")).alias("_aa"), F.sum(F.col("_b") * F.col("_b")).alias("_bb"))
    return g.select(*by, F.try_divide(F.col("_ab"), F.sqrt(F.col("_aa") * F.col("_bb"))).alias("r"))


def crude_bin_starts(values: np.ndarray, eps: float, domain: str = "linear") -> np.ndarray:
    """For sorted distinct values the first value of each one's bin: those less than eps above it share it."""
    f: Callable = {"linear": lambda v: v, "log10": np.log10}[domain]
    out, end = np.empty(len(values)), None
    for i, (v, at) in enumerate(zip(values, f(np.asarray(values, float)))):
        if end is None or not at < end:
            start, end = v, at + eps
        out[i] = start
    return out


def _starts_by_leaps(values: DataFrame, eps: float, domain: str) -> DataFrame:
    """The first values of the crude bins of a table of distinct values (v).

    The start behind any value is found by a join in order; from the least value on, leaps of 1, 2, 4, ... starts
    double those known each time.
    """
    place = F.log10("v") if domain == "log10" else F.col("v")
    placed = checkpointed(values.select("v", place.alias("at")))
    leap = bracket(placed.select("v", (F.col("at") + eps).alias("at")), placed.select("at", F.col("v").alias("next")), "at", ["next"]).select("v", F.col("upper_next").alias("to")).where("to is not null")
    leap = checkpointed(leap)
    known = checkpointed(placed.agg(F.min("v").alias("v")).where("v is not null"))
    while True:
        new = checkpointed(known.join(leap, "v").select(F.col("to").alias("v")))
        if not new.limit(1).count():
            return known
        known = checkpointed(known.unionByName(new))
        twice = leap.alias("a").join(leap.alias("b"), F.col("a.to") == F.col("b.v")).select("a.v", "b.to")
        leap = checkpointed(twice)


def crude_bins(df: DataFrame, field: str, eps: float, domain: str = "linear", label: str = "bin", most_values: int = 1_000_000) -> DataFrame:
    """``df`` with the label of each row's crude bin: the mean of the bin's values by their frequency.

    From the least value on, those less than eps above a bin's first value (in its logarithm for ``log10``) share the
    bin. Rows without a value are left out. Up to ``most_values`` distinct values are scanned in one place and their
    labels broadcast; more are leapt over by joins.
    """
    counts = df.where(_valid(F.col(field).cast("double"))).groupBy(F.col(field).cast("double").alias("v")).count()
    some = counts.limit(most_values + 1).toPandas().sort_values("v")
    if len(some) <= most_values:
        some["_start"] = crude_bin_starts(some["v"].to_numpy(float), eps, domain)
        total = (some["v"] * some["count"]).groupby(some["_start"]).sum() / some["count"].groupby(some["_start"]).sum()
        table = pd.DataFrame({"_v": some["v"], label: some["_start"].map(total).to_numpy(float)})
        names = F.broadcast(df.sparkSession.createDataFrame(table, f"_v double, {label} double"))
    else:
        starts = _starts_by_leaps(counts.select("v"), eps, domain)
        of = bracket(counts, starts, "v", spread=True).select("v", "count", F.col("lower").alias("_start"))
        means = of.groupBy("_start").agg((F.sum(F.col("v") * F.col("count")) / F.sum("count")).alias(label))
        names = of.join(means, "_start").select(F.col("v").alias("_v"), label)
    return df.join(names, F.col(field).cast("double") == F.col("_v")).drop("_v")


def accumulate(df: DataFrame, indexes: list[str], value: str, sizes: list[int]) -> DataFrame:
    """Sums in the cells of a matrix of two, three or more indexes, of which -1 stands for the whole of its range."""
    # cells are summed before they are spread, so that only distinct cells are
    cells = df.groupBy(*indexes).agg(F.sum(value).alias("value"))
    for c, n in zip(indexes, sizes):
        all_ = F.sequence(F.lit(0), F.lit(n - 1))
        cells = cells.withColumn(c, F.explode(F.when(F.col(c) == -1, all_).otherwise(F.array(F.col(c).cast("int")))))
    return cells.groupBy(*indexes).agg(F.sum("value").alias("value"))


def samples(df: DataFrame, by: list[str], x: str, w: str) -> DataFrame:
    """The samples of each bin as an array of (x, w), sorted. A whole bin in a row: for bins that fit one."""
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(x).alias("x"), F.col(w).alias("w")))).alias("samples"))


def of_samples(samples_: str | Column) -> dict[str, Column]:
    """n, weight sum and mean of an array of samples."""
    s = column(samples_)
    total = lambda f: F.aggregate(s, F.lit(0.0), lambda a, v: a + f(v))
    w = total(lambda v: v["w"])
    return {"n": F.size(s), "w_sum": w, "mean": F.try_divide(total(lambda v: v["x"] * v["w"]), w)}
