"""Smoothing: Savitzky-Golay filters as convolutions, and recursive filters with memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.points import checkpointed
from pointloom.operators.scans import joined
from pointloom.operators.windows import LONG_MASK, convolved, convolved_in_blocks


def savitzky_golay_mask(half: int, order: int, derivative: int = 0, dx: float = 1.0) -> list[float]:
    """The mask that fits a polynomial over 2 * half + 1 points and takes its value or derivative in the middle.

    The gain of a derivative d is 1 / dx for d = 1; for higher ones dx to the power d over d.
    """
    if order > 2 * half or derivative > order:
        raise ValueError("the order is at most twice the half width, the derivative at most the order")
    at = np.arange(-half, half + 1)
    rows = np.linalg.pinv(np.vander(at, order + 1, increasing=True).astype(float))
    gain = 1.0 if derivative == 0 else 1 / dx if derivative == 1 else dx**derivative / derivative
    return (rows[derivative] * gain).tolist()


def savitzky_golay(df: DataFrame, columns: str | list[str], half: int, order: int, derivative: int = 0, dx: float = 1.0, name: str = "smooth", pad_low: float | None = None, pad_high: float | None = None, block: int | None = None) -> DataFrame:
    """Each column smoothed, or its derivative: ``name`` for a single column, else <column>_<name>.

    The ends go on with the first and last values, or with ``pad_low`` and ``pad_high`` where they are given. With a
    ``block``, and for long masks, sets are taken in blocks of so many points, all columns at once.
    """
    mask = savitzky_golay_mask(half, order, derivative, dx)
    if block or len(mask) > LONG_MASK:
        results = {name: columns} if isinstance(columns, str) else {f"{c}_{name}": c for c in columns}
        return convolved_in_blocks(df, results, mask, low=pad_low, high=pad_high, block=block or 1 << 16)
    if isinstance(columns, str):
        return convolved(df, columns, mask, name, low=pad_low, high=pad_high)
    for c in columns:
        df = convolved(df, c, mask, f"{c}_{name}", low=pad_low, high=pad_high)
    return df


def low_pass(values: np.ndarray, tau: float, dt: np.ndarray, memory: float = 0.0) -> np.ndarray:
    """y += dt / tau * (x - y), from ``memory`` on; a missing value leaves y as it is (tau 0: no filter)."""
    out = np.empty(len(values))
    y = memory
    for i, (x, step) in enumerate(zip(values, dt)):
        if not (np.isnan(x) or np.isnan(step)):
            y = x if tau == 0 else y + min(step / tau, 1.0) * (x - y)
        out[i] = y
    return out


def shunt(x: np.ndarray, y: np.ndarray, c: float, tau: float, dt: np.ndarray, memory: float = 0.0) -> np.ndarray:
    """Shunting inhibition: s += dt / tau * (x - (c + y) * s); missing values leave s as it is."""
    out = np.empty(len(x))
    s = memory
    for i in range(len(x)):
        if not (np.isnan(x[i]) or np.isnan(y[i]) or np.isnan(dt[i])):
            s = x[i] / (c + y[i]) if tau == 0 else s + min(dt[i] / tau, 1.0) * (x[i] - (c + y[i]) * s)
        out[i] = s
    return out


def recursive_filters(df: DataFrame, x: str, tau: float, dt: float | None = None, t: str | None = None, y: str | None = None, c: float = 1.0, memory: float = 0.0) -> DataFrame:
    """set_id, idx and the filtered x of each set: low-passed, or with ``y`` inhibited. A set is one task's work.

    The step is ``dt``, or the difference in ``t`` (0 for the first point).
    """
    used = ["set_id", "idx", x, *[v for v in (t, y) if v]]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        v = frame[x].to_numpy(float)
        step = np.full(len(v), float(dt)) if t is None else np.diff(frame[t].to_numpy(float), prepend=frame[t].iloc[0])
        out = low_pass(v, tau, step, memory) if y is None else shunt(v, frame[y].to_numpy(float), c, tau, step, memory)
        return pd.DataFrame({"set_id": frame["set_id"], "idx": frame["idx"], "filtered": out})

    return df.select(*dict.fromkeys(used)).groupBy("set_id").applyInPandas(run, "set_id long, idx long, filtered double")


def recursive_filters_in_blocks(df: DataFrame, x: str, tau: float, dt: float | None = None, t: str | None = None, y: str | None = None, c: float = 1.0, memory: float = 0.0, block: int = 1_000_000) -> DataFrame:
    """As :func:`recursive_filters`, for sets too long for one task.

    Both filters are linear in their memory: a block of consecutive points (by idx) turns the value behind its first
    point into a s + b at its end. One row a block (its first point, its last t, a and b) is chained along the set, and
    each block then starts from its own value. Tasks go through many blocks, sorted, one point after the other.
    """
    null = F.lit(None)
    cut = df.select("set_id", "idx", F.col(x).cast("double").alias("_x"), (F.col(t) if t else null).cast("double").alias("_t"), (F.col(y) if y else null).cast("double").alias("_y"), F.floor(F.col("idx") / block).alias("_block"))
    cut = checkpointed(cut.repartition("set_id", "_block").sortWithinPartitions("set_id", "_block", "idx"))
    kind = df.schema["set_id"].dataType.simpleString()
    inhibited = y is not None

    def advanced(s: float, v: float, step: float, w: float) -> float:
        if v != v or step != step or inhibited and w != w:
            return s
        if tau == 0:
            return float(np.float64(v) / (c + w)) if inhibited else v
        return s + min(step / tau, 1.0) * (v - ((c + w) * s if inhibited else s))

    def behind(at: float, before: float) -> float:
        return at - before if t else float(dt)

    def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
        return [batch.column(n).to_numpy(zero_copy_only=False).tolist() if pa.types.is_floating(batch.column(n).type) else batch.column(n).to_pylist() for n in names]

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["set_id", "_block", "x", "t", "y", "last", "a", "b"]
        own, one, none, last = None, 1.0, 0.0, 0.0

        def done(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, type_) for v, type_ in zip(zip(*rows), types)], names)

        for batch in batches:
            types, out = [batch.schema.field("set_id").type, pa.int64(), *[pa.float64()] * 6], []
            for s, k, v, at, w in zip(*columns(batch, "set_id", "_block", "_x", "_t", "_y")):
                if own is None or s != own[0] or k != own[1]:
                    if own is not None:
                        out.append((*own, last, one - none, none))
                    own, one, none = (s, k, v, at, w), 1.0, 0.0
                else:
                    step = behind(at, last)
                    one, none = advanced(one, v, step, w), advanced(none, v, step, w)
                last = at
            if out:
                yield done(out)
        if own is not None:
            yield done([(*own, last, one - none, none)])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_, own, value, before = False, None, memory, 0.0
        for batch in batches:
            starts, from_ = [], []
            for s, v, at, w, last, a, b in zip(*columns(batch, "set_id", "x", "t", "y", "last", "a", "b")):
                if not known_ or s != own:
                    known_, own, value, before = True, s, memory, at
                starts.append(value)
                from_.append(before)
                value = a * advanced(value, v, behind(at, before), w) + b
                before = last
            yield pa.RecordBatch.from_arrays([batch.column("set_id"), batch.column("_block"), pa.array(starts, pa.float64()), pa.array(from_, pa.float64())], ["set_id", "_block", "_start", "_from"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, value, before = None, memory, 0.0
        for batch in batches:
            out = []
            for s, k, v, at, w, start, from_ in zip(*columns(batch, "set_id", "_block", "_x", "_t", "_y", "_start", "_from")):
                if own != (s, k):
                    own, value, before = (s, k), start, from_
                value = advanced(value, v, behind(at, before), w)
                before = at
                out.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("set_id"), batch.column("idx"), pa.array(out, pa.float64())], ["set_id", "idx", "filtered"])

    outlines = cut.mapInArrow(outline, f"set_id {kind}, _block long, x double, t double, y double, last double, a double, b double")
    starts = outlines.repartition("set_id").sortWithinPartitions("set_id", "_block").mapInArrow(chain, f"set_id {kind}, _block long, _start double, _from double")
    known = joined(cut, starts, ["set_id", "_block"]).withColumn("idx", F.col("idx").cast("long"))
    return known.repartition("set_id", "_block").sortWithinPartitions("set_id", "_block", "idx").mapInArrow(run, f"set_id {kind}, idx long, filtered double")
