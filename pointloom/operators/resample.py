"""Interpolation: linear at given places, natural cubic splines, integrals of splines, grids over sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators.joins import bracket
from pointloom.operators.points import with_positions
from pointloom.operators.scans import grouped


def without_duplicates(df: DataFrame, x: str, *columns: str, how: str = "mean") -> DataFrame:
    """One row per set and x: the mean, the first or the last (by idx) of the rows that share it."""
    f = {"mean": F.avg, "first": lambda c: F.min_by(c, "idx"), "last": lambda c: F.max_by(c, "idx")}[how]
    return df.groupBy("set_id", x).agg(*[f(c).alias(c) for c in columns])


def linear(queries: DataFrame, df: DataFrame, x: str, y: str, name: str = "value") -> DataFrame:
    """y of the set's points, linearly interpolated at the queries' x (set_id, x); null outside the set's range."""
    known = without_duplicates(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, y)
    b = bracket(queries, known, x, [y], ["set_id"])
    lo, hi = F.col(f"lower_{y}"), F.col(f"upper_{y}")
    part = F.try_divide(F.col(x) - F.col("lower"), F.col("upper") - F.col("lower"))
    value = F.when(F.col("lower") == F.col("upper"), lo).otherwise(lo + (hi - lo) * part)
    return b.withColumn(name, value).select(*queries.columns, name)


def grid(df: DataFrame, x: str, y: str, buckets: int = 256) -> DataFrame:
    """Every x that occurs in any set, for every set whose range holds it, with y given or interpolated.

    Each set asks only for the places in its range, by a join on buckets of x that hold about as many places each.
    The result has a row for each set and place in its range.
    """
    ranges = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy("set_id").agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    places = df.where(F.col(x).isNotNull()).select(x).distinct()
    cuts = places.agg(F.array_distinct(F.percentile_approx(x, [k / buckets for k in range(1, buckets)])).alias("_cuts"))  # one row
    bucket = lambda v: F.size(F.filter("_cuts", lambda c: c <= F.col(v)))
    at = places.crossJoin(F.broadcast(cuts)).select(x, bucket(x).alias("_b"))
    touched = ranges.crossJoin(F.broadcast(cuts)).select("set_id", "_lo", "_hi", F.explode(F.sequence(bucket("_lo"), bucket("_hi"))).alias("_b"))
    asked = touched.join(at, "_b").where(F.col(x).between(F.col("_lo"), F.col("_hi"))).select("set_id", x)
    return linear(asked, df, x, y, y)


def natural_spline(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots of the natural cubic spline through points of increasing x."""
    n = len(x)
    m = np.zeros(n)
    if n < 3:
        return m
    h = np.diff(x)
    diagonal = 2 * (h[:-1] + h[1:])
    right = 6 * np.diff(np.diff(y) / h)
    upper, work = np.zeros(n - 2), np.zeros(n - 2)
    upper[0], work[0] = h[1] / diagonal[0], right[0] / diagonal[0]
    for i in range(1, n - 2):
        p = diagonal[i] - h[i] * upper[i - 1]
        upper[i] = h[i + 1] / p
        work[i] = (right[i] - h[i] * work[i - 1]) / p
    for i in range(n - 3, -1, -1):
        m[i + 1] = work[i] - upper[i] * m[i + 2]
    return m


def spline_at(x: np.ndarray, y: np.ndarray, m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The spline's values; outside the knots the end pieces go on, a single knot is a constant."""
    if len(x) == 0:
        return np.full(len(at), np.nan)
    if len(x) == 1:
        return np.full(len(at), y[0])
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    h = x[k + 1] - x[k]
    a, b = (x[k + 1] - at) / h, (at - x[k]) / h
    return a * y[k] + b * y[k + 1] + ((a**3 - a) * m[k] + (b**3 - b) * m[k + 1]) * h * h / 6


def spline_integral(x: np.ndarray, y: np.ndarray, m: np.ndarray, low: float, high: float) -> float:
    """The exact integral of the spline over the part of [low, high] that its knots span."""
    low, high = max(low, x[0]), min(high, x[-1])
    if len(x) < 2 or high <= low:
        return 0.0
    cuts = np.unique(np.concatenate([[low], x[(x > low) & (x < high)], [high]]))
    middle = (cuts[1:] + cuts[:-1]) / 2
    # a cubic is integrated exactly by Simpson's rule
    f = lambda at: spline_at(x, y, m, at)
    return float(((cuts[1:] - cuts[:-1]) / 6 * (f(cuts[:-1]) + 4 * f(middle) + f(cuts[1:]))).sum())


def _filled(x: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots in order: gaps inside become ramps by place, at the ends they are left out."""
    known = np.flatnonzero(~np.isnan(v))
    if not len(known):
        return x[:0], v[:0]
    inside = slice(known[0], known[-1] + 1)
    gaps = np.flatnonzero(np.isnan(v[inside])) + known[0]
    filled = v.copy()
    filled[gaps] = np.interp(gaps, known, v[known])
    return x[inside], filled[inside]


def _knots(frame: pd.DataFrame, x: str, y: str) -> tuple[np.ndarray, np.ndarray]:
    frame = frame.sort_values(x)
    return _filled(frame[x].to_numpy(float), frame[y].to_numpy(float))


def spline_resample(df: DataFrame, x: str, y: str, n: int, duplicates: str = "mean") -> DataFrame:
    """set_id, idx, x and y at n equal steps over each set's range of x. A set is one task's work, and a task goes
    through many of them, sorted."""

    def resampled(rows: pa.RecordBatch, starts: list[int]) -> pa.RecordBatch:
        all_x, all_y = (rows.column(c).to_numpy(zero_copy_only=False) for c in (x, y))
        first, places, values = [], [np.empty(0)], [np.empty(0)]
        for a, b in zip(starts[:-1], starts[1:]):
            kx, ky = _filled(all_x[a:b], all_y[a:b])
            if len(kx):
                first.append(a)
                places.append(np.linspace(kx[0], kx[-1], n))
                values.append(spline_at(kx, ky, natural_spline(kx, ky), places[-1]))
        sets = rows.column("set_id").take(pa.array(np.repeat(np.array(first, np.int64), n)))
        idx = np.tile(np.arange(n), len(first)).astype(np.int64)
        return pa.RecordBatch.from_arrays([sets, pa.array(idx), *(pa.array(np.concatenate(v)) for v in (places, values))], ["set_id", "idx", x, y])

    clean = without_duplicates(df.where(F.col(x).isNotNull()), x, y, how=duplicates)
    rows = clean.select("set_id", *[F.col(c).cast("double").alias(c) for c in (x, y)]).repartition("set_id").sortWithinPartitions("set_id", x)
    kind = df.schema["set_id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: grouped(batches, ["set_id"], resampled), f"set_id {kind}, idx long, {x} double, {y} double")


def spline_values(queries: DataFrame, df: DataFrame, x: str, y: str, duplicates: str = "mean", name: str = "value") -> DataFrame:
    """The spline of each set at the queries' x (set_id, x)."""

    def run(asked: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"set_id": [], x: [], name: []})
        kx, ky = _knots(frame, "_x", "_y")
        at = asked[x].to_numpy(float)
        return pd.DataFrame({"set_id": asked["set_id"], x: at, name: spline_at(kx, ky, natural_spline(kx, ky), at)})

    clean = without_duplicates(df.where(F.col(x).isNotNull()), x, y, how=duplicates)
    # new names for the columns, as both sides may come from one table, whose columns a cogroup would mix up
    clean = clean.select(F.col("set_id").alias("_set"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    return queries.select("set_id", x).groupBy("set_id").cogroup(clean.groupBy("_set")).applyInPandas(run, f"set_id long, {x} double, {name} double")


def spline_integrals(df: DataFrame, x: str, y: str, low: float, high: float, duplicates: str = "mean") -> DataFrame:
    """set_id and the integral of each set's spline over [low, high]."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        kx, ky = _knots(frame, x, y)
        value = spline_integral(kx, ky, natural_spline(kx, ky), low, high) if len(kx) else None
        return pd.DataFrame({"set_id": [frame["set_id"].iloc[0]], "integral": [value]})

    clean = without_duplicates(df.where(F.col(x).isNotNull()), x, y, how=duplicates)
    return clean.groupBy("set_id").applyInPandas(run, "set_id long, integral double")


#: Knots beside a block that its solution takes along. Their ends' influence at least halves with each knot.
MARGIN = 64


def spline_pieces(df: DataFrame, x: str, y: str, duplicates: str = "mean", block: int = 100_000) -> DataFrame:
    """The pieces of each set's natural spline: set_id, x0, y0, m0 (second derivative), x1, y1 and m1.

    For sets of any length: knots are numbered over the whole table and solved in blocks of ``block`` with 64 knots of
    the neighbours on each side, which is exact in double precision. A set's last knot has no piece (x1 null).
    """
    clean = without_duplicates(df.where(F.col(x).isNotNull()), x, y, how=duplicates).select("set_id", F.col(x).cast("double").alias("x0"), F.col(y).cast("double").alias("y0"))
    placed = with_positions(clean, ["set_id", "x0"], "_p")
    known = placed.where(F.col("y0").isNotNull())
    # gaps inside become ramps by place, at the ends they are left out
    gaps = bracket(placed.where(F.col("y0").isNull()).drop("y0"), known.select("set_id", "_p", "y0"), "_p", ["y0"], ["set_id"], spread=True)
    part = (F.col("_p") - F.col("lower")) / (F.col("upper") - F.col("lower"))
    ramps = gaps.where("lower is not null and upper is not null").select("set_id", "x0", (F.col("lower_y0") + (F.col("upper_y0") - F.col("lower_y0")) * part).alias("y0"), "_p")
    own = F.floor(F.col("_p") / block)
    rest = F.pmod(F.col("_p"), F.lit(block))
    blocks = F.array(own, F.when(rest < MARGIN, own - 1), F.when(rest >= block - MARGIN, own + 1))
    dealt = known.unionByName(ramps).withColumn("_b", F.explode(F.filter(blocks, lambda b: b.isNotNull()))).withColumn("_own", own == F.col("_b"))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_p")
        kx, ky = frame["x0"].to_numpy(), frame["y0"].to_numpy()
        m = natural_spline(kx, ky)
        after = lambda v: np.append(v[1:], np.nan)
        out = pd.DataFrame({"set_id": frame["set_id"].to_numpy(), "x0": kx, "y0": ky, "m0": m, "x1": after(kx), "y1": after(ky), "m1": after(m)})
        return out[frame["_own"].to_numpy()]

    kind = df.schema["set_id"].dataType.simpleString()
    pieces = dealt.groupBy("set_id", "_b").applyInPandas(solve, f"set_id {kind}, x0 double, y0 double, m0 double, x1 double, y1 double, m1 double")
    return pieces.select("set_id", *[F.nanvl(c, F.lit(None)).alias(c) for c in ("x0", "y0", "m0", "x1", "y1", "m1")])


def _in_piece(at: Column, x0: Column, y0: Column, m0: Column, x1: Column, y1: Column, m1: Column) -> Column:
    h = x1 - x0
    a, b = (x1 - at) / h, (at - x0) / h
    return a * y0 + b * y1 + ((a * a * a - a) * m0 + (b * b * b - b) * m1) * h * h / 6


def values_of_pieces(queries: DataFrame, pieces: DataFrame, x: str, name: str = "value") -> DataFrame:
    """The spline's value at the queries' x (set_id, x, ...), by a join in order; outside the knots the end pieces go on."""
    parts = ["y0", "m0", "x1", "y1", "m1", "x0"]
    whole = pieces.where(F.col("x1").isNotNull()).select("set_id", F.col("x0").alias(x), *parts)
    single = pieces.groupBy("set_id").agg(F.count("*").alias("_n"), F.max("y0").alias("_only")).where("_n = 1").select("set_id", "_only")
    found = bracket(queries, whole, x, parts, ["set_id"], spread=True).join(single, "set_id", "left")
    side = [F.coalesce(f"lower_{c}", f"upper_{c}") for c in ("x0", "y0", "m0", "x1", "y1", "m1")]
    return found.withColumn(name, F.coalesce(_in_piece(F.col(x), *side), F.col("_only"))).select(*queries.columns, name)


def integrals_of_pieces(pieces: DataFrame, low: float, high: float) -> DataFrame:
    """set_id and the integral over the part of [low, high] that the knots span, as partial sums over pieces."""
    a, b = F.greatest("x0", F.lit(float(low))), F.least("x1", F.lit(float(high)))
    f = lambda at: _in_piece(at, *[F.col(c) for c in ("x0", "y0", "m0", "x1", "y1", "m1")])
    # a cubic is integrated exactly by Simpson's rule
    part = F.when(F.col("x1").isNotNull() & (b > a), (b - a) / 6 * (f(a) + 4 * f((a + b) / 2) + f(b))).otherwise(0.0)
    return pieces.groupBy("set_id").agg(F.sum(part).alias("integral"))


def resampled_pieces(pieces: DataFrame, x: str, y: str, n: int) -> DataFrame:
    """set_id, idx, x and y at n equal steps over each set's range of knots."""
    ends = pieces.groupBy("set_id").agg(F.min("x0").alias("_lo"), F.max("x0").alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / max(n - 1, 1)
    asked = ends.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).select("set_id", "idx", (F.col("_lo") + F.col("idx") * step).alias(x))
    return values_of_pieces(asked, pieces, x, y)


def polynomial_at(x: np.ndarray, y: np.ndarray, at: float) -> float:
    """The value at one place of the polynomial through all points (Neville's scheme)."""
    p = np.array(y, float)
    x = np.asarray(x, float)
    for k in range(1, len(x)):
        p[: len(x) - k] = ((at - x[k:]) * p[: len(x) - k] + (x[: len(x) - k] - at) * p[1 : len(x) - k + 1]) / (x[: len(x) - k] - x[k:])
    return float(p[0]) if len(x) else float("nan")


