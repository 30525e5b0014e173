"""Operators along each ordered set. All use one window, partitioned by set and ordered by ``idx``, so a chain of
them shuffles once. Those with a ``block`` take sets too long for one task in blocks of so many points (see ``scans``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pointloom.operators.points import column, ordered, running, whole
from pointloom.operators.scans import begun, scanned
from pointloom.operators.stats import fold, mean, stdev


#: Values of a mask up to which a convolution is a sum of window columns.
LONG_MASK = 64
#: Values that are transformed together.
_TRANSFORM_CELLS = 1 << 21


def counters(df: DataFrame, block: int | None = None) -> DataFrame:
    """counter: points so far; kept: those not discarded."""
    return scanned(df, block, sums={"counter": F.lit(1).cast("long"), "kept": F.when(F.col("discarded"), 0).otherwise(1)})


def changed(*columns: str) -> Column:
    """Whether any of the columns differs from the point before; a set's first point counts as changed."""
    w = ordered()
    same = None
    for c in columns:
        e = F.col(c).eqNullSafe(F.lag(c).over(w))
        same = e if same is None else same & e
    return (F.row_number().over(w) == 1) | ~same


def with_changed(df: DataFrame, *columns: str, name: str = "changed", block: int | None = None) -> DataFrame:
    """As :func:`changed`, as a column."""
    there = scanned(df, block, lag={f"_p{k}": c for k, c in enumerate(columns)} | {"_is": F.lit(True)})
    same = F.col("_is").isNotNull()
    for k, c in enumerate(columns):
        same = same & F.col(c).eqNullSafe(F.col(f"_p{k}"))
    return there.withColumn(name, ~same).drop("_is", *[f"_p{k}" for k in range(len(columns))])


def stays_same(c: str, n: int) -> Column:
    """1 if the column keeps its value for the next n points (the last -n if negative), 0 if not, -1 past the set's end."""
    low, high = (0, n) if n >= 0 else (n, 0)
    w = ordered().rowsBetween(low, high)
    return F.when(F.count(F.lit(1)).over(w) <= abs(n), -1).when((F.min(c).over(w) == F.col(c)) & (F.max(c).over(w) == F.col(c)) & (F.count(c).over(w) == abs(n) + 1), 1).otherwise(0)


def with_curve_length(df: DataFrame, x: str = "x", y: str = "y", name: str = "length", signed: int = 0, block: int | None = None) -> DataFrame:
    """Length of the curve up to each point; segments with a missing end count 0.

    ``signed``: 1 or -1 takes the sign of the step in x or y, 2 that of the turn about the origin, 3 that of the step
    seen from the direction of the point before; there ties keep the sign before them.
    """
    return with_curve_lengths(df, {name: signed}, x, y, block)


def with_curve_lengths(df: DataFrame, signed: dict[str, int], x: str = "x", y: str = "y", block: int | None = None) -> DataFrame:
    """As :func:`with_curve_length` for several kinds at once (name: ``signed``), in the scans of one."""
    df = scanned(df, block, lag={"_px": x, "_py": y})
    px, py = F.col("_px"), F.col("_py")
    dx, dy = F.col(x) - px, F.col(y) - py
    length = F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    minus = lambda c: F.when(c, -1.0).otherwise(1.0)
    signs = {0: F.lit(1.0), 1: minus(dx < 0), -1: minus(dy < 0), 2: minus(F.col(y) * px - F.col(x) * py < 0)}
    if 3 in signed.values():
        along, across = px * dx + py * dy, px * dy - py * dx
        df = df.withColumns({"_s": F.when(across > 0, 1.0).when(across < 0, -1.0), "_d": F.when((across == 0) & (along > 0), -1.0).when((across == 0) & (along < 0), 1.0)})
        known = F.when(F.col("_d").isNotNull(), F.col("idx"))
        df = scanned(df, block, last={"_s": "_s"}, whole={"_d1": F.min_by("_d", known), "_i1": F.min(known)})
        signs[3] = F.coalesce(F.col("_s"), F.when(F.col("idx") >= F.col("_i1"), F.col("_d1")), F.lit(-1.0))
    return scanned(df, block, sums={name: signs[kind] * length for name, kind in signed.items()}).drop("_px", "_py", "_s", "_d", "_d1", "_i1")


def with_error_length(df: DataFrame, e: str = "e", name: str = "length", base: float | None = None, block: int | None = None) -> DataFrame:
    """Sum of the absolute changes up to each point; with a base, of changes folded to half of it."""
    df = scanned(df, block, lag={"_p": e})
    step = F.col(e) - F.col("_p")
    step = step if base is None else F.when(F.abs(step) > base / 2, fold(step, base)).otherwise(step)
    return scanned(df, block, sums={name: F.coalesce(F.abs(step), F.lit(0.0))}).drop("_p")


def with_unwrapped(df: DataFrame, a: str, name: str = "unwrapped", base: float = 360.0, block: int | None = None) -> DataFrame:
    """The angle without jumps: the first one plus the differences, less the nearest whole number of turns where they
    reach half the base (half a turn up counts as half a turn down, and the reverse)."""
    df = scanned(df, block, lag={"_p": a})
    step = F.col(a) - F.col("_p")
    step = F.when(F.abs(step) < base / 2, step).otherwise(step - base * F.round(step / base))
    return scanned(df, block, sums={name: F.coalesce(step, F.col(a))}).drop("_p")


def with_integral(df: DataFrame, v: str, t: str, name: str = "integral", resets: bool = False, initial: float = 0.0, block: int | None = None, late_zero: bool = True) -> DataFrame:
    """Running sum of v times the step in t.

    Rows with a missing v or t keep the sum and the time before. A non-zero first value counts with the mean step;
    a first value of zero makes the sum start a row later, or is as any other where ``late_zero`` is false. With
    ``resets`` the missing rows have no sum, and the next valid row starts again at the initial value. Rows before the
    first valid one are null, and so is a sum without a mean step (the first valid row is the set's last).
    """
    ok = F.col(v).isNotNull() & F.col(t).isNotNull()
    idx, first, known = F.col("idx"), F.col("_first"), F.when(ok, F.col("idx"))
    timed = F.when(F.col(t).isNotNull(), idx)
    df = scanned(df, block, whole={"_first": F.min(known), "_v0": F.min_by(v, known), "_t0": F.min_by(t, known), "_n": F.count(F.lit(1)), "_t1": F.max_by(t, timed), "_i1": F.max(timed)})
    df = df.withColumn("_t1", F.when(F.col("_i1") >= first, F.col("_t1")))
    zero = (F.col("_v0") == 0) & F.lit(late_zero)
    at, late = idx == first, zero & (idx == first + 1)
    missing = F.when((idx > first) & ~ok, 1).otherwise(0)
    held = F.when((idx >= first) & (ok | late), F.col(t))
    # of a missing row, and of valid ones how many have come before
    df = scanned(df, block, before={"_b": held, "_ok": F.when(ok, idx), "_gap": F.when(missing == 1, idx)})
    again = F.lit(False)
    if resets:
        again = F.col("_gap").isNotNull() & (F.col("_ok").isNull() | (F.col("_ok") < F.col("_gap")))
    average = F.try_divide(F.col("_t1") - F.col("_t0"), F.col("_n") - first - 1)
    step = F.when(~ok, 0.0).when(at, F.when(F.col("_v0") != 0, F.col(v) * F.coalesce(average, F.lit(0.0))).otherwise(0.0)).when(late | again, 0.0).otherwise(F.col(v) * (F.col(t) - F.col("_b")))
    df = scanned(df, block, since={"_total": (step, (missing == 1) if resets else F.lit(False))})
    total = F.when(zero | average.isNotNull(), F.col("_total") + initial)
    shown = F.when(idx >= first, F.when(ok | F.lit(not resets), total)).when((idx == first - 1) & ~zero, F.lit(float(initial)))
    return df.withColumn(name, shown).drop("_first", "_v0", "_t0", "_n", "_t1", "_i1", "_b", "_ok", "_gap", "_total")


def _filled(c: str, a: str, i: str, b: str, j: str, linear: bool) -> Column:
    """The column, where it is missing from the last known value a at place i and the next one b at j."""
    gap = F.col(j) - F.col(i)
    if linear:
        inside = F.col(a) + (F.col(b) - F.col(a)) / F.nullif(gap, F.lit(0)) * (F.col("idx") - F.col(i))
    else:
        inside = F.when(F.col("idx") < F.col(i) + F.floor(gap / 2), F.col(a)).otherwise(F.col(b))
    return F.when(F.col(c).isNotNull(), F.col(c)).when(F.col(a).isNull(), F.col(b)).when(F.col(b).isNull(), F.col(a)).otherwise(inside)


def with_gaps_filled(df: DataFrame, c: str, name: str = "filled", linear: bool = True, block: int | None = None) -> DataFrame:
    """Missing values filled by index: linearly, or by a step at half the gap; at the ends by the nearest value."""
    place = F.when(F.col(c).isNotNull(), F.col("idx"))
    df = scanned(df, block, last={"_a": c, "_i": place}, ahead={"_b": c, "_j": place})
    return df.withColumn(name, _filled(c, "_a", "_i", "_b", "_j", linear)).drop("_a", "_i", "_b", "_j")


def with_trend_removed(df: DataFrame, c: str, start: int, start_trend: float | None, end: int = -1, end_trend: float | None = None, name: str = "detrended") -> DataFrame:
    """The column less a line over the points from start to end; a trend of None is the mean over that range."""
    n = F.count(F.lit(1)).over(whole())
    last = (n - 1) if end == -1 else F.least(F.lit(end), n - 1)
    inside = (F.col("idx") >= start) & (F.col("idx") <= last)
    average = F.avg(F.when(inside, F.col(c))).over(whole())
    a = average if start_trend is None else F.lit(float(start_trend))
    b = average if end_trend is None else F.lit(float(end_trend))
    line = a + F.coalesce(F.try_divide((b - a), last - start), F.lit(0.0)) * (F.col("idx") - start)
    return df.withColumn(name, F.when(inside, F.col(c) - line).otherwise(F.col(c)))


def ties_removed(df: DataFrame, c: str, block: int | None = None) -> DataFrame:
    """The first point of each run of equal consecutive values, with unique_idx, its place among those."""
    marked = scanned(with_changed(df, c, name="_new", block=block), block, sums={"unique_idx": F.col("_new").cast("long")})
    return marked.where("_new").withColumn("unique_idx", F.col("unique_idx") - 1).drop("_new")


def monotone(df: DataFrame, c: str, strict: bool = False) -> DataFrame:
    """Per set: 1 if rising, -1 if falling, 0 if neither, and the first idx that goes against the set's first direction."""
    w = ordered()
    step = df.withColumn("_d", F.signum(F.col(c) - F.lag(c).over(w)))
    # the first step that is not 0 gives the direction
    first = step.withColumn("_f", F.first(F.when(F.col("_d") != 0, F.col("_d")), True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    against = (F.col("_d") == -F.col("_f")) | ((F.col("_d") == 0) & F.lit(strict))
    g = first.groupBy("set_id").agg(F.first("_f").alias("_f"), F.min(F.when(against, F.col("idx"))).alias("first_against"))
    return g.select("set_id", F.when(F.col("first_against").isNull() & F.col("_f").isNotNull(), F.col("_f").cast("int")).otherwise(0).alias("direction"), "first_against")


def cropped(df: DataFrame, c: str, block: int | None = None) -> DataFrame:
    """Without a leading and a trailing run of one value, where such a run is 2 points or longer."""
    runs = scanned(with_changed(df, c, name="_new", block=block), block, sums={"_pos": F.lit(1)})
    start = F.when(F.col("_new"), F.col("_pos"))
    runs = scanned(runs, block, whole={"_tail": F.max(start), "_second": F.min(F.when(start > 1, start)), "_n": F.max("_pos")})
    head_end = F.coalesce("_second", F.col("_n") + 1)  # the first point behind the leading run
    head = (F.col("_pos") < head_end) & (head_end > 2)
    tail = (F.col("_pos") >= F.col("_tail")) & (F.col("_tail") < F.col("_n"))
    return runs.where(~(head | tail)).drop("_new", "_pos", "_tail", "_second", "_n")


def with_direction_runs(df: DataFrame, x: str, name: str = "run_id", block: int | None = None) -> DataFrame:
    """Number of the run of one direction of x; steps of 0 belong to the run before."""
    df = scanned(df, block, lag={"_x": x})
    d = F.signum(F.col(x) - F.col("_x"))
    df = scanned(df.withColumn("_d", F.when(d != 0, d)), block, before={"_p": "_d"})
    turn = F.when(F.col("_d").isNotNull() & F.col("_p").isNotNull() & (F.col("_d") != F.col("_p")), 1).otherwise(0)
    return scanned(df, block, sums={name: turn}).drop("_x", "_d", "_p")


def with_splits(df: DataFrame, condition: Column, after: bool = False, name: str = "run_id", block: int | None = None) -> DataFrame:
    """Number of the part of the set, which a new one follows at (or after) each point that meets the condition."""
    hit = F.coalesce(condition, F.lit(False)).cast("long")
    df = scanned(df.withColumn("_h", hit), block, sums={name: "_h"})
    return (df.withColumn(name, F.col(name) - F.col("_h")) if after else df).drop("_h")


def with_moving_statistics(df: DataFrame, x: str, k: int, w: str | None = None) -> DataFrame:
    """n, mean and stdev of the last k + 1 points."""
    window = ordered().rowsBetween(-k, 0)
    weight = F.lit(1.0) if w is None else F.col(w)
    v = F.col(x)
    own = {"n": F.count(v), "w_sum": F.sum(F.when(v.isNotNull(), weight)), "s1": F.sum(weight * v), "s2": F.sum(weight * v * v)}
    wide = df.withColumns({name: c.over(window) for name, c in own.items()})
    return wide.withColumns({"mean": mean(), "stdev": stdev()}).drop("w_sum", "s1", "s2")


def differences(c: str | Column, x: str | Column) -> dict[str, Column]:
    """Differences to the points before and after, and the slopes there."""
    w, c, x = ordered(), column(c), column(x)
    before, after = c - F.lag(c).over(w), F.lead(c).over(w) - c
    return {"before": before, "after": after, "slope_before": F.try_divide(before, x - F.lag(x).over(w)), "slope_after": F.try_divide(after, F.lead(x).over(w) - x)}


def circle(x: str = "x", y: str = "y") -> dict[str, Column]:
    """Of the circle through each point and its neighbours: signed radius (positive for a left turn), centre and turn.

    The radius is null where the three points lie on a line.
    """
    w = ordered()
    ax, ay = F.lag(x).over(w) - F.col(x), F.lag(y).over(w) - F.col(y)
    bx, by = F.lead(x).over(w) - F.col(x), F.lead(y).over(w) - F.col(y)
    cross = bx * ay - by * ax
    aa, bb = ax * ax + ay * ay, bx * bx + by * by
    chord = F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))
    radius = F.try_divide(F.sqrt(aa) * F.sqrt(bb) * chord, 2 * cross)
    cx, cy = F.try_divide(by * aa - ay * bb, -2 * cross), F.try_divide(ax * bb - bx * aa, -2 * cross)
    turn = F.degrees(F.atan2(-ax * by + ay * bx, -(ax * bx + ay * by)))
    return {"radius": radius, "centre_x": F.col(x) + cx, "centre_y": F.col(y) + cy, "turn": turn}


def padded(df: DataFrame, c: str, n: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """set_id, idx and the column with n points put before and behind each set: the given values, or the end values."""
    ends = df.groupBy("set_id").agg(F.min_by(c, "idx").alias("_a"), F.max_by(c, "idx").alias("_b"), F.count("*").alias("_n"))
    steps = ends.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    before = steps.select("set_id", (-F.col("_k")).cast("long").alias("idx"), (F.col("_a") if low is None else F.lit(float(low))).alias(c))
    behind = steps.select("set_id", (F.col("_n") + F.col("_k") - 1).alias("idx"), (F.col("_b") if high is None else F.lit(float(high))).alias(c))
    return df.select("set_id", "idx", c).unionByName(before).unionByName(behind)


def convolved(df: DataFrame, c: str, mask: list[float], name: str = "convolved", linear: bool = True, low: float | None = None, high: float | None = None) -> DataFrame:
    """Sum of mask[j] times the value j - len(mask) // 2 points on; the ends go on with the end values, or with
    ``low`` and ``high`` where they are given.

    Gaps are filled for the sums and are gaps again in the result. Masks of more than LONG_MASK values go by
    :func:`convolved_in_blocks`.
    """
    if len(mask) > LONG_MASK:
        return convolved_in_blocks(df, {name: c}, mask, linear, low, high)
    filled = with_gaps_filled(df, c, "_f", linear)
    both = ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = [F.lit(float(v)) if v is not None else f("_f").over(both) for v, f in ((low, F.first), (high, F.last))]
    filled = filled.withColumns({"_lo": ends[0], "_hi": ends[1], "_n": F.count(F.lit(1)).over(whole())})
    half, w, total = len(mask) // 2, ordered(), F.lit(0.0)
    for j, m in enumerate(mask):
        k = j - half
        v = F.col("_f") if k == 0 else F.when(F.col("idx") + k < 0, F.col("_lo")).when(F.col("idx") + k >= F.col("_n"), F.col("_hi")).otherwise(F.lead("_f", k).over(w) if k > 0 else F.lag("_f", -k).over(w))
        total = total + F.lit(float(m)) * v
    return filled.withColumn(name, F.when(F.col(c).isNotNull(), total)).drop("_f", "_lo", "_hi", "_n")


def convolved_in_blocks(df: DataFrame, columns: dict[str, str], mask: list[float], linear: bool = True, low: float | None = None, high: float | None = None, block: int = 1 << 16) -> DataFrame:
    """As :func:`convolved` for sets and masks of any length, several columns (result: column) at a time.

    Overlap-save: a set is cut into blocks of consecutive idx, at least four masks long; each takes the points that its
    mask reaches from its neighbours too and is convolved by Fourier transforms.
    """
    half, m = len(mask) // 2, np.array(mask, float)
    block = max(block, 4 * len(mask))
    reach = len(mask) - 1 - half  # points ahead
    names, each = df.columns, range(len(columns))
    last, ahead, ends = {}, {}, {"_n": F.max("idx") + 1}
    for k, c in enumerate(columns.values()):
        place = F.when(F.col(c).isNotNull(), F.col("idx"))
        last |= {f"_a{k}": c, f"_i{k}": place}
        ahead |= {f"_b{k}": c, f"_j{k}": place}
        # the ends are filled by the nearest value
        ends |= {f"_lo{k}": F.min_by(c, place).cast("double") if low is None else F.max(F.lit(float(low))), f"_hi{k}": F.max_by(c, place).cast("double") if high is None else F.max(F.lit(float(high)))}
    found = scanned(df, block, last=last, ahead=ahead, whole=ends)
    filled = [_filled(c, f"_a{k}", f"_i{k}", f"_b{k}", f"_j{k}", linear).cast("double").alias(f"_f{k}") for k, c in enumerate(columns.values())]
    known = [F.col(c).isNotNull().alias(f"_k{k}") for k, c in enumerate(columns.values())]
    sent = F.explode(F.sequence(F.floor(F.greatest(F.col("idx") - reach, F.lit(0)) / block), F.floor((F.col("idx") + half) / block))).alias("_b")
    points = found.select(*names, F.col("idx").cast("long").alias("_at"), *filled, *known, *ends, sent).where(F.col("_b") * block < F.col("_n"))

    def convolve(batch: pa.RecordBatch, first_row: np.ndarray) -> pa.RecordBatch:
        """The results of whole blocks, those that need transforms of one size at a time."""
        get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(first_row)), np.diff(np.append(first_row, batch.num_rows)))
        first = get("_b")[first_row] * block
        count = np.minimum(block, get("_n")[first_row] - first)
        at = get("_at") - first[of]
        mine = (at >= 0) & (at < count[of])
        size = np.array([1 << int(n + len(mask) - 2).bit_length() for n in count])
        out = [np.empty(batch.num_rows) for _ in each]
        values = [(get(f"_f{k}").astype(float), get(f"_lo{k}").astype(float)[first_row], get(f"_hi{k}").astype(float)[first_row]) for k in each]
        for n in np.unique(size):
            transform = np.conj(np.fft.rfft(m, n))
            same = np.flatnonzero(size == n)
            step = max(1, _TRANSFORM_CELLS // int(n))
            for part in (same[k : k + step] for k in range(0, len(same), step)):
                place = np.full(len(first), -1)
                place[part] = np.arange(len(part))
                rows = np.flatnonzero(place[of] >= 0)
                ahead_of = (first[part, None] + np.arange(n) - half) < 0
                for k, (f, lo, hi) in enumerate(values):
                    v = np.where(ahead_of, lo[part, None], hi[part, None])
                    v[place[of[rows]], at[rows] + half] = f[rows]
                    got = np.fft.irfft(np.fft.rfft(v) * transform, int(n))
                    own = rows[mine[rows]]
                    out[k][own] = got[place[of[own]], at[own]]
        own = pa.array(np.flatnonzero(mine))
        kept = batch.select(names).take(own)
        results = [pa.array(out[k][mine], mask=~get(f"_k{k}")[mine].astype(bool) | np.isnan(out[k][mine])) for k in each]
        return pa.RecordBatch.from_arrays([*kept.columns, *results], [*names, *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of a block that may go on
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            begins = begun(batch, ["set_id", "_b"])
            held = batch.slice(begins[-1])
            if len(begins) > 1:
                yield convolve(batch.slice(0, begins[-1]), begins[:-1])
        if held is not None and held.num_rows:
            yield convolve(held, np.array([0]))

    schema = StructType([df.schema[c] for c in names] + [StructField(r, DoubleType()) for r in columns])
    return points.repartition("set_id", "_b").sortWithinPartitions("set_id", "_b", "_at").mapInArrow(run, schema)


def running_sum_in_blocks(df: DataFrame, c: str, name: str = "running", block: int = 1_000_000) -> DataFrame:
    """A running sum for sets too long for one task."""
    return scanned(df, block, sums={name: c})
