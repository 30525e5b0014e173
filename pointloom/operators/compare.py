"""Comparison of sets in pairs: distances between figures, closeness, overlap, alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from pointloom.operators.joins import nearest, paired
from pointloom.operators.points import checkpointed
from pointloom.operators.scans import grouped
from pointloom.operators.selection import shift_rotate
from pointloom.operators.stats import TAU, fold, mean, stdev, sums


#: Points of a set up to which its pairs are whole in a task.
WHOLE = 4096


def _sides(known: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """The points of both sets of each pair, a pair in one partition: set_a, set_b, _side (0 or 1), the columns, _x and _y."""
    side = lambda own, k: pairs.select("set_a", "set_b", F.col(own).alias("set_id"), F.lit(k).alias("_side"))
    rows = known.join(side("set_a", 0).unionByName(side("set_b", 1)), "set_id").select("set_a", "set_b", "_side", *columns, F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"))
    return rows.repartition("set_a", "set_b").sortWithinPartitions("set_a", "set_b", "_side", *columns)


def closest_points(df: DataFrame, pairs: DataFrame, extra: list[str] = [], whole: int = WHOLE) -> DataFrame:  # noqa: B006
    """For each pair (set_a, set_b) and each point of either set the closest point of the other: direction 12 or 21.

    Pairs of sets of up to ``whole`` points are met whole, many a task, in one shuffle of the points; pairs of longer
    sets are searched by :func:`nearest`, which deals a set over tasks.
    """
    there = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    known = df.select("set_id", "idx", "x", "y", *extra).where(there("x") & there("y"))
    long = checkpointed(known.groupBy("set_id").count().where(F.col("count") > whole).select("set_id"))
    if not long.take(1):
        return _closest_in_whole_pairs(known, pairs, extra)
    own = lambda c: long.select(F.col("set_id").alias(c))
    rest = pairs.join(own("set_a"), "set_a", "left_anti")
    large = pairs.join(own("set_a"), "set_a", "left_semi").unionByName(rest.join(own("set_b"), "set_b", "left_semi"))
    small = rest.join(own("set_b"), "set_b", "left_anti")
    side = lambda own, d: large.join(known.withColumnRenamed("set_id", own), own).withColumn("direction", F.lit(d))
    # the points of both sets, told apart by the direction in which they ask and are asked
    asked = side("set_a", 12).unionByName(side("set_b", 21))
    given = side("set_b", 12).unionByName(side("set_a", 21))
    return _closest_in_whole_pairs(known, small, extra).unionByName(nearest(asked, given, ["set_a", "set_b", "direction"], ref_id=["idx", "x", "y", *extra]))


def _closest_in_whole_pairs(known: DataFrame, pairs: DataFrame, extra: list[str], at_once: int = 1 << 20) -> DataFrame:
    """closest_points() of pairs that each fit a task, which goes through many of them, sorted."""
    columns = ["idx", "x", "y", *extra]
    rows = _sides(known, pairs, columns)  # the first one of equals has the least id

    def met(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each point of either set (the first n points are the first set's) the place of its closest, and their square distance."""
        ax, ay, bx, by = x[:n], y[:n], x[n:], y[n:]
        to, least = np.empty(len(x), np.int64), np.full(len(x), np.inf)
        step = max(1, at_once // len(bx))
        for k in range(0, n, step):
            d = (ax[k : k + step, None] - bx) ** 2 + (ay[k : k + step, None] - by) ** 2
            best = d.argmin(axis=1)
            to[k : k + len(d)], least[k : k + len(d)] = n + best, d[np.arange(len(d)), best]
            back = d.argmin(axis=0)
            found = d[back, np.arange(len(bx))]
            nearer = np.flatnonzero((found < least[n:]) | (k == 0))
            to[n + nearer], least[n + nearer] = k + back[nearer], found[nearer]
        return to, least

    def closest(rows: pa.RecordBatch, starts: list[int]) -> pa.RecordBatch:
        side, x, y = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("_side", "_x", "_y"))
        asks, given, least = [], [], []
        for a, b in zip(starts[:-1], starts[1:]):
            n = int(np.searchsorted(side[a:b], 1))
            if 0 < n < b - a:
                to, d = met(x[a:b], y[a:b], n)
                asks.append(np.arange(a, b))
                given.append(a + to)
                least.append(d)
        asks, given, least = (np.concatenate([np.empty(0, t), *v]) for v, t in ((asks, np.int64), (given, np.int64), (least, float)))
        own, other = rows.take(pa.array(asks)), rows.take(pa.array(given))
        got = {c: own.column(c) for c in ("set_a", "set_b", *columns)} | {"direction": pa.array(np.where(side[asks] == 0, 12, 21).astype(np.int32))}
        got |= {f"ref_{c}": other.column(c) for c in columns} | {"distance": pa.array(np.sqrt(least))}
        return pa.RecordBatch.from_arrays(list(got.values()), list(got))

    of = rows.schema
    fields = [of["set_a"], of["set_b"], *[of[c] for c in columns], StructField("direction", IntegerType())]
    return rows.mapInArrow(lambda batches: grouped(batches, ["set_a", "set_b"], closest), StructType([*fields, *[StructField(f"ref_{c}", of[c].dataType) for c in columns], StructField("distance", DoubleType())]))


def _transformed(d: Column, transform: str | None, parameter: float) -> Column:
    if transform == "power":
        return F.pow(d, F.lit(abs(parameter)))
    if transform == "log":
        return F.when(d > 0, F.log(d) / F.log(F.lit(10.0)) if parameter == 10 else F.log(d) if parameter <= 1 else F.log(d) / F.log(F.lit(parameter))).otherwise(0.0)
    return d


def figural_distance(df: DataFrame, pairs: DataFrame, pointwise: bool = False, transform: str | None = None, parameter: float = 1.0, orientation: str | None = None, base: float = 360.0) -> DataFrame:
    """set_a, set_b and distance: the mean distance to the closest point, both ways, or ``pointwise`` that of paired points.

    ``transform`` ('log' or 'power') is applied to each distance; with ``orientation`` the mean absolute difference of
    that column of the matched points comes along, as a share of half the base.
    """
    extra = [orientation] if orientation else []
    if pointwise:
        m = paired(df, pairs, "x", "y", *extra)
        d = F.sqrt(F.pow(F.col("a_x") - F.col("b_x"), 2) + F.pow(F.col("a_y") - F.col("b_y"), 2))
        turn = F.abs(fold(F.col(f"a_{orientation}") - F.col(f"b_{orientation}"), base)) if orientation else None
    else:
        m = closest_points(df, pairs, extra)
        d = F.col("distance")
        turn = F.abs(fold(F.col(orientation) - F.col(f"ref_{orientation}"), base)) if orientation else None
    aggs = [F.avg(_transformed(d, transform, parameter)).alias("distance"), F.count("*").alias("n")]
    if orientation:
        aggs.append((F.avg(turn) / (base / 2)).alias("orientation"))
    return m.groupBy("set_a", "set_b").agg(*aggs)


def mean_direction(df: DataFrame, pairs: DataFrame, base: float = 360.0) -> DataFrame:
    """set_a, set_b and the mean direction from the points of the first set to their closest of the second, and back
    (there turned round)."""
    m = closest_points(df, pairs)
    sign = F.when(F.col("direction") == 12, 1.0).otherwise(-1.0)
    dx, dy = sign * (F.col("ref_x") - F.col("x")), sign * (F.col("ref_y") - F.col("y"))
    d = F.sqrt(dx * dx + dy * dy)
    g = m.groupBy("set_a", "set_b").agg(F.sum(F.coalesce(F.try_divide(dx, d), F.lit(1.0))).alias("_c"), F.sum(F.coalesce(F.try_divide(dy, d), F.lit(0.0))).alias("_s"))
    return g.select("set_a", "set_b", F.pmod(F.atan2("_s", "_c") * (base / TAU), F.lit(float(base))).alias("direction"))


#: Rows of a parameter grid, which every task gets (a hundred bytes a row).
MOST_PARAMETERS = 5_000_000
_GRID = {"scale": 1.0, "dx": 0.0, "dy": 0.0, "rx": 0.0, "ry": 0.0, "angle": 0.0}
_MOMENTS = ("n", "ax", "ay", "bx", "by", "vax", "vay", "vbx", "vby", "bb", "axbx", "axby", "aybx", "ayby")


def _moments() -> list[Column]:
    """Count, means, variances and covariances of the pairs of points, in the order of _MOMENTS."""
    c = {"ax": "a_x", "ay": "a_y", "bx": "b_x", "by": "b_y"}
    both = [("bx", "by", "bb"), ("ax", "bx", "axbx"), ("ax", "by", "axby"), ("ay", "bx", "aybx"), ("ay", "by", "ayby")]
    return [F.count("*").alias("n"), *[F.avg(v).alias(k) for k, v in c.items()], *[F.var_pop(v).alias(f"v{k}") for k, v in c.items()], *[F.covar_pop(c[a], c[b]).alias(k) for a, b, k in both]]


def _grid_table(df: DataFrame, parameters: list[dict] | DataFrame) -> DataFrame:
    """p_id and the linear map of each row of the grid: x' = m11 x + m12 y + t1, y' = m21 x + m22 y + t2."""
    if isinstance(parameters, list):
        rows = [(k, *[float((_GRID | p)[c]) for c in _GRID]) for k, p in enumerate(parameters)]
        parameters = df.sparkSession.createDataFrame(rows, "p_id int, " + ", ".join(f"{c} double" for c in _GRID))
    given = parameters.select("p_id", *[(F.col(c) if c in parameters.columns else F.lit(v)).cast("double").alias(c) for c, v in _GRID.items()])
    at = lambda x, y: shift_rotate(F.lit(x), F.lit(y), F.col("angle"), F.col("scale"), (F.col("rx"), F.col("ry")), (F.col("dx"), F.col("dy")))
    (t1, t2), (x1, x2), (y1, y2) = at(0.0, 0.0), at(1.0, 0.0), at(0.0, 1.0)
    return given.select("p_id", *_GRID, t1.alias("t1"), t2.alias("t2"), (x1 - t1).alias("m11"), (x2 - t2).alias("m21"), (y1 - t1).alias("m12"), (y2 - t2).alias("m22"))


def _bounds(g: dict[str, np.ndarray], m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of the grid a lower and an upper bound of the mean distance of a pair, from the moments of its chunks.

    A chunk's mean distance is at least the distance of its means and at most its root mean square distance.
    """
    low, high = np.zeros(len(g["t1"])), np.zeros(len(g["t1"]))
    for row in m:
        v = dict(zip(_MOMENTS, row))
        mx = v["ax"] - g["m11"] * v["bx"] - g["m12"] * v["by"] - g["t1"]
        my = v["ay"] - g["m21"] * v["bx"] - g["m22"] * v["by"] - g["t2"]
        spread = v["vax"] + v["vay"]
        for p, q, k in (("m11", "m12", "ax"), ("m21", "m22", "ay")):
            spread = spread + g[p] ** 2 * v["vbx"] + g[q] ** 2 * v["vby"] + 2 * g[p] * g[q] * v["bb"] - 2 * g[p] * v[k + "bx"] - 2 * g[q] * v[k + "by"]
        square = mx * mx + my * my
        low += v["n"] * np.sqrt(square)
        high += v["n"] * np.sqrt(square + np.maximum(spread, 0))
    n = m[:, 0].sum()
    return low / n, high / n


def _pooled(m: np.ndarray, parts: int) -> np.ndarray:
    """The moments of neighbouring chunks put together, ``parts`` of them."""
    out = []
    for own in np.array_split(m, min(parts, len(m))):
        n, mean = own[:, 0], own[:, 1:5]
        centre = (n[:, None] * mean).sum(axis=0) / n.sum()
        d = mean - centre
        pairs = [(0, 0), (1, 1), (2, 2), (3, 3), (2, 3), (0, 2), (0, 3), (1, 2), (1, 3)]
        second = [(n * (own[:, 5 + k] + d[:, i] * d[:, j])).sum() / n.sum() for k, (i, j) in enumerate(pairs)]
        out.append([n.sum(), *centre, *second])
    return np.array(out)


def _best_of_whole_pairs(known: DataFrame, pairs: DataFrame, shared, grid: DataFrame, at_once: int = 32, parts: int = 8) -> DataFrame:
    """best_alignment() by distance of pairs that each fit a task, which goes through many of them, sorted.

    The rows of the grid that the bounds leave are tried from the least lower bound on, some at once, until the bounds
    of the rest are above the best so far.
    """
    rows = _sides(known, pairs, ["idx"])

    def best_of(g: dict[str, np.ndarray], c: np.ndarray) -> tuple[int, float] | None:
        """The place in the grid and the score of the best row for pairs of points (a_x, a_y, b_x, b_y)."""
        if not np.isfinite(c).all():
            return None
        # neighbours in the second set share a chunk
        c = c[:, np.lexsort((c[3] > np.median(c[3]), c[2]))]
        moments = []
        for own in np.array_split(c, min(parts, c.shape[1]), axis=1):
            centre = own.mean(axis=1)
            d = own - centre[:, None]
            v = d @ d.T / own.shape[1]
            moments.append([own.shape[1], *centre, *v.diagonal(), v[2, 3], v[0, 2], v[0, 3], v[1, 2], v[1, 3]])
        moments = np.array(moments)
        slack = 1e-12 * max(1.0, np.abs(c).max())  # bounds are rounded at the coordinates' size
        left = np.arange(len(g["p_id"]))
        for n in (1, parts):
            low, high = _bounds({k: v[left] for k, v in g.items() if k[0] in "mt"}, _pooled(moments, n))
            near = low <= high.min() * (1 + 1e-9) + slack
            left, low = left[near], low[near]
        order = np.argsort(low, kind="stable")
        left, low = left[order], low[order]
        ax, ay, bx, by = c
        best, score = None, np.inf
        for k in range(0, len(left), at_once):
            if low[k] > score * (1 + 1e-9) + slack:
                break
            at = left[k : k + at_once]
            m11, m12, t1, m21, m22, t2 = (g[v][at, None] for v in ("m11", "m12", "t1", "m21", "m22", "t2"))
            v = np.sqrt((ax - (m11 * bx + m12 * by + t1)) ** 2 + (ay - (m21 * bx + m22 * by + t2)) ** 2).mean(axis=1)
            least = v.min()
            if least <= score:  # ties go to the smallest p_id, in whose order the grid is
                first = int(at[v == least].min())
                best = first if least < score or best is None else min(best, first)
                score = least
        return None if best is None else (int(g["p_id"][best]), float(score))

    def aligned(batch: pa.RecordBatch, starts: list[int]) -> pa.RecordBatch:
        g = shared.value
        side, idx, x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_side", "idx", "_x", "_y"))
        at, found = [], []
        for a, b in zip(starts[:-1], starts[1:]):
            n = a + int(np.searchsorted(side[a:b], 1))
            _, i, j = np.intersect1d(idx[a:n], idx[n:b], assume_unique=True, return_indices=True)
            got = best_of(g, np.stack([x[a + i], y[a + i], x[n + j], y[n + j]])) if len(i) else None
            if got:
                at.append(a)
                found.append(got)
        keys = batch.take(pa.array(at, pa.int64()))
        columns = [pa.array([p for p, _ in found], kind), pa.array([v for _, v in found], pa.float64())]
        return pa.RecordBatch.from_arrays([keys.column("set_a"), keys.column("set_b"), *columns], ["set_a", "set_b", "p_id", "score"])

    kind = to_arrow_type(grid.schema["p_id"].dataType)
    of = rows.schema
    return rows.mapInArrow(lambda batches: grouped(batches, ["set_a", "set_b"], aligned), StructType([of["set_a"], of["set_b"], grid.schema["p_id"], StructField("score", DoubleType())]))


def best_alignment(df: DataFrame, pairs: DataFrame, parameters: list[dict] | DataFrame, correlation: bool = False, chunks: int = 64, whole: int = WHOLE) -> DataFrame:
    """The row of the parameter grid that brings the second set nearest to the first, point by point.

    ``parameters`` is a list or a table of scale, dx, dy, rx, ry and angle; p_id is the place in the list, or a column
    of the table (up to MOST_PARAMETERS rows). The least mean distance wins, or with ``correlation`` the greatest mean
    of the correlations of x and of y; ties go to the smallest p_id.

    Correlations follow from a pair's moments alone. For distances the moments of chunks of a pair's points bound every
    row of the grid, coarse to fine; only the rows that the bounds leave are tried on the points. Pairs of which a set
    has up to ``whole`` points are whole in a task for that; longer ones are dealt over tasks.
    """
    grid = checkpointed(_grid_table(df, parameters))
    if grid.count() > MOST_PARAMETERS:
        raise ValueError(f"a grid has more than {MOST_PARAMETERS} rows")
    table = grid.toPandas().sort_values("p_id", ignore_index=True)
    shared = df.sparkSession.sparkContext.broadcast({c: table[c].to_numpy() for c in table.columns})
    best = None
    if not correlation:
        known = df.where(~F.col("discarded")) if "discarded" in df.columns else df
        known = known.where("x IS NOT NULL AND y IS NOT NULL").select("set_id", "idx", "x", "y")
        long = checkpointed(known.groupBy("set_id").count().where(F.col("count") > whole).select("set_id"))
        pairs = pairs.distinct()
        if not long.take(1):
            return _best_of_whole_pairs(known, pairs, shared, grid)
        meets = lambda rows, c, how: rows.join(long.select(F.col("set_id").alias(c)), c, how)
        half = meets(pairs, "set_b", "left_semi")
        best = _best_of_whole_pairs(known, meets(pairs, "set_b", "left_anti").unionByName(meets(half, "set_a", "left_anti")), shared, grid)
        pairs = meets(half, "set_a", "left_semi")
    m = checkpointed(paired(df, pairs, "x", "y"))
    wide = -(-((m.agg(F.max("idx")).first()[0] or 0) + 1) // chunks)
    moments = m.where("a_x IS NOT NULL AND a_y IS NOT NULL AND b_x IS NOT NULL AND b_y IS NOT NULL").groupBy("set_a", "set_b", F.floor(F.col("idx") / wide).alias("chunk")).agg(*_moments())
    # at most ``chunks`` rows a pair
    outlines = moments.groupBy("set_a", "set_b").agg(F.sort_array(F.collect_list(F.struct("chunk", F.array(*[F.col(c).cast("double") for c in _MOMENTS]).alias("m")))).alias("ms"))
    keys = f"set_a {df.schema['set_id'].dataType.simpleString()}, set_b {df.schema['set_id'].dataType.simpleString()}"

    def correlations(m: np.ndarray, g: dict) -> tuple[int, float]:
        v = dict(zip(_MOMENTS, m[0]))
        total = np.zeros(len(g["p_id"]))
        for p, q, k in (("m11", "m12", "ax"), ("m21", "m22", "ay")):
            with np.errstate(all="ignore"):
                var = g[p] ** 2 * v["vbx"] + g[q] ** 2 * v["vby"] + 2 * g[p] * g[q] * v["bb"]
                total = total + (g[p] * v[k + "bx"] + g[q] * v[k + "by"]) / np.sqrt(var * v["v" + k]) / 2
        best = int(np.argmax(np.where(np.isnan(total), -2.0, total)))
        return int(g["p_id"][best]), float(total[best])

    def rows_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for frame in frames:
            out = []
            for a, b, ms in zip(frame["set_a"], frame["set_b"], frame["ms"]):
                own = np.array([x["m"] for x in ms], float)
                if correlation:
                    out.append((a, b, *correlations(_pooled(own, 1), g)))
                    continue
                left = np.arange(len(g["p_id"]))
                for parts in (1, 8, len(own)):
                    low, high = _bounds({c: v[left] for c, v in g.items() if c[0] in "mt"}, _pooled(own, parts))
                    left = left[low <= high.min() * (1 + 1e-9) + 1e-12]
                out += [(a, b, int(g["p_id"][k]), None) for k in left]
            yield pd.DataFrame(out, columns=["set_a", "set_b", "p_id", "score"])

    found = outlines.mapInPandas(rows_of, f"{keys}, p_id {grid.schema['p_id'].dataType.simpleString()}, score double")
    if correlation:
        return found
    tried = found.drop("score").join(F.broadcast(grid), "p_id").join(m, ["set_a", "set_b"])
    x, y = shift_rotate(F.col("b_x"), F.col("b_y"), F.col("angle"), F.col("scale"), (F.col("rx"), F.col("ry")), (F.col("dx"), F.col("dy")))
    distance = F.sqrt(F.pow(F.col("a_x") - x, 2) + F.pow(F.col("a_y") - y, 2))
    scored = tried.groupBy("set_a", "set_b", "p_id").agg(F.avg(distance).alias("_v"))
    dealt = scored.groupBy("set_a", "set_b").agg(F.min(F.struct("_v", "p_id")).alias("_b"))
    return best.unionByName(dealt.select("set_a", "set_b", F.col("_b.p_id").alias("p_id"), F.col("_b._v").alias("score")))


def closeness(df: DataFrame, pairs: DataFrame, columns: tuple[str, ...] = ("y", "e")) -> DataFrame:
    """Per pair and column the mean of 1 - |difference| / range, the range being that of both sets' paired points."""
    m = paired(df, pairs, *columns)
    aggs = []
    for c in columns:
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        span = F.greatest(F.max(a), F.max(b)) - F.least(F.min(a), F.min(b))
        aggs.append((1 - F.coalesce(F.try_divide(F.avg(F.abs(a - b)), span), F.lit(0.0))).alias(f"closeness_{c}"))
    return m.groupBy("set_a", "set_b").agg(*aggs)


def overlap(df: DataFrame, pairs: DataFrame, weight: str | None = None) -> DataFrame:
    """Per pair the mean (overlap) and the stdev (spread) of the share of the shorter error bar that both bars cover,
    weighted by both sides' observations."""
    m = paired(df, pairs, "y", "e", *([weight] if weight else []))
    low = F.greatest(F.col("a_y") - F.col("a_e"), F.col("b_y") - F.col("b_e"))
    high = F.least(F.col("a_y") + F.col("a_e"), F.col("b_y") + F.col("b_e"))
    shorter = 2 * F.least("a_e", "b_e")
    share = F.when(shorter == 0, F.when(F.least("a_e", "b_e") == F.greatest("a_e", "b_e"), (F.col("a_y") == F.col("b_y")).cast("double")).otherwise((high >= low).cast("double"))).otherwise(F.try_divide(F.greatest(high - low, F.lit(0.0)), shorter))
    w = F.col(f"a_{weight}") + F.col(f"b_{weight}") if weight else F.lit(1.0)
    g = m.groupBy("set_a", "set_b").agg(*[f.alias(k) for k, f in sums(share, w).items() if k in ("n", "w_sum", "s1", "s2")])
    return g.select("set_a", "set_b", mean().alias("overlap"), stdev().alias("spread"))


def overall_overlap(overlaps: DataFrame) -> DataFrame:
    """One row over all pairs of :func:`overlap`: mean and sample stdev of their means and of their spreads."""
    spread_of = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    return overlaps.agg(F.count("*").alias("pairs"), F.avg("overlap").alias("overlap"), spread_of("overlap").alias("overlap_stdev"), F.avg("spread").alias("spread"), spread_of("spread").alias("spread_stdev"))


def turtle_distance(df: DataFrame, pairs: DataFrame, c: str, k: float = 1.0) -> DataFrame:
    """Per pair (reference set_a, test set_b): sum of differences over the reference's sum plus k, which takes its sign."""
    m = paired(df, pairs, c)
    g = m.groupBy("set_a", "set_b").agg(F.sum(F.col(f"b_{c}") - F.col(f"a_{c}")).alias("_d"), F.sum(f"a_{c}").alias("_s"))
    flip = ((F.col("_s") < 0) & F.lit(k > 0)) | ((F.col("_s") >= 0) & F.lit(k < 0))
    return g.select("set_a", "set_b", F.try_divide(F.col("_d"), F.col("_s") + F.when(flip, -k).otherwise(k)).alias("distance"))
