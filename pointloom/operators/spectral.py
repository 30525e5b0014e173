"""Fourier transforms of sets.

A set is one task's work, up to ``most`` points; the forms named ``long_...`` deal sets of more than ``cells`` points,
of any length, over tasks of so many cells, and the others out as wholes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators.joins import bracket
from pointloom.operators.points import checkpointed

MOST_POINTS = 50_000_000


def _series(frame: pd.DataFrame, c: str, most: int) -> np.ndarray:
    if len(frame) > most:
        raise ValueError(f"a set has more than {most} points; see the forms named long_...")
    # gaps are filled by place, as the transform knows no missing values
    return frame.sort_values("idx")[c].astype(float).interpolate(limit_direction="both").fillna(0.0).to_numpy()


def spectrum(df: DataFrame, c: str, most: int = MOST_POINTS) -> DataFrame:
    """set_id, k, re, im and power = |X|^2 / N^2 for the N / 2 + 1 lower frequencies of each set, and n = N."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        v = _series(frame, c, most)
        f = np.fft.rfft(v)
        return pd.DataFrame({"set_id": frame["set_id"].iloc[0], "k": np.arange(len(f)), "re": f.real, "im": f.imag, "power": np.abs(f) ** 2 / len(v) ** 2, "n": len(v)})

    return df.select("set_id", "idx", c).groupBy("set_id").applyInPandas(run, f"set_id {_kind(df)}, k long, re double, im double, power double, n long")


def inverse(transformed: DataFrame, scaled: bool = True) -> DataFrame:
    """set_id, idx and value from the columns of :func:`spectrum`, with or without the factor 1 / N; absent frequencies
    are 0."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        n = int(frame["n"].iloc[0])
        f = np.zeros(n // 2 + 1, complex)
        low = frame[frame["k"] <= n // 2]
        f[low["k"]] = low["re"].to_numpy() + 1j * low["im"].to_numpy()
        v = np.fft.irfft(f, n) * (1 if scaled else n)
        return pd.DataFrame({"set_id": frame["set_id"].iloc[0], "idx": np.arange(n), "value": v})

    return transformed.groupBy("set_id").applyInPandas(run, f"set_id {_kind(transformed)}, idx long, value double")


def cyclic_convolution(df: DataFrame, c: str, mask: list[float], deconvolve: bool = False, most: int = MOST_POINTS, least: float = 1e-12) -> DataFrame:
    """set_id, idx and value: each set convolved cyclically with a mask (of any length) centred on its middle, or the reverse.

    Where the mask's transform is 0 (not above ``least``) a deconvolution has nothing to divide by and leaves 0.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        v = _series(frame, c, most)
        wide = np.zeros(len(v))  # cells of a mask longer than the set wrap round and add up
        np.add.at(wide, (np.arange(len(mask)) - len(mask) // 2) % len(v), mask)
        f = np.fft.rfft(wide)
        g = np.fft.rfft(v)
        with np.errstate(all="ignore"):
            out = np.fft.irfft(np.where(np.abs(f) > least, g / f, 0) if deconvolve else g * f, len(v))
        return pd.DataFrame({"set_id": frame["set_id"].iloc[0], "idx": np.arange(len(v)), "value": out})

    return df.select("set_id", "idx", c).groupBy("set_id").applyInPandas(run, f"set_id {_kind(df)}, idx long, value double")


def _kind(df: DataFrame) -> str:
    return df.schema["set_id"].dataType.simpleString()


def _parted(df: DataFrame, n: Column, cells: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of the sets whose length, the aggregate ``n``, is at most ``cells``, and of the longer ones if any."""
    longer = checkpointed(df.groupBy("set_id").agg(n.alias("n")).where(F.col("n") > cells).select("set_id"))
    if not longer.limit(1).count():
        return df, None
    return df.join(longer, "set_id", "left_anti"), df.join(longer, "set_id", "left_semi")


def _transform(rows: DataFrame, high: int, low: int, sign: int, cells: int) -> DataFrame:
    """The unscaled transform of (set_id, i, re, im), i below high * low, absent rows being zero, in two steps: along
    the columns of the matrix of ``low`` columns that the set fills row by row, and along its rows. Each task has
    about ``cells`` cells of it."""
    kind, n = _kind(rows), high * low
    wide, tall = max(1, cells // high), max(1, cells // low)
    along = lambda m, axis: np.fft.fft(m, axis=axis) if sign < 0 else np.fft.ifft(m, axis=axis) * m.shape[axis]

    def frame_of(key, a, b, m: np.ndarray) -> pd.DataFrame:
        a, b = np.broadcast_arrays(a, b)
        return pd.DataFrame({"set_id": key, "a": a.ravel(), "b": b.ravel(), "re": m.real.ravel(), "im": m.imag.ravel()})

    def columns(key, frame: pd.DataFrame) -> pd.DataFrame:
        first = int(key[1]) * wide
        m = np.zeros((high, min(wide, low - first)), complex)
        m[frame["i"] // low, frame["i"] % low - first] = frame["re"].to_numpy() + 1j * frame["im"].to_numpy()
        a, b = np.arange(high)[:, None], first + np.arange(m.shape[1])
        return frame_of(key[0], a, b, along(m, 0) * np.exp(sign * 2j * np.pi * ((a * b) % n) / n))

    def lines(key, frame: pd.DataFrame) -> pd.DataFrame:
        first = int(key[1]) * tall
        m = np.zeros((min(tall, high - first), low), complex)
        m[frame["a"] - first, frame["b"]] = frame["re"].to_numpy() + 1j * frame["im"].to_numpy()
        return frame_of(key[0], first + np.arange(m.shape[0])[:, None], np.arange(low), along(m, 1))

    schema = f"set_id {kind}, a long, b long, re double, im double"
    half = rows.groupBy("set_id", F.floor(F.pmod("i", F.lit(low)) / wide).alias("_k")).applyInPandas(columns, schema)
    done = half.groupBy("set_id", F.floor(F.col("a") / tall).alias("_k")).applyInPandas(lines, schema)
    return done.select("set_id", (F.col("a") + high * F.col("b")).alias("i"), "re", "im")


def _filled(df: DataFrame, c: str) -> tuple[DataFrame, DataFrame]:
    """The values of sets of any length (set_id, idx, v), gaps filled by place, and each set's length n."""
    given = df.select("set_id", "idx", F.col(c).cast("double").alias("v"))
    known = given.where(F.col("v").isNotNull())
    gaps = bracket(given.where(F.col("v").isNull()).drop("v"), known, "idx", ["v"], ["set_id"], spread=True)
    part = (F.col("idx") - F.col("lower")) / (F.col("upper") - F.col("lower"))
    line = F.col("lower_v") + (F.col("upper_v") - F.col("lower_v")) * part
    filled = known.unionByName(gaps.select("set_id", "idx", F.coalesce(line, "lower_v", "upper_v", F.lit(0.0)).alias("v")))
    return filled, checkpointed(given.groupBy("set_id").agg(F.count("*").alias("n")))


def _places(counts: DataFrame, block: int = 1 << 16) -> DataFrame:
    """set_id, n and each place i below n, a long set's in blocks over tasks."""
    blocks = counts.where("n > 0").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))))
    first = F.col("_block") * block
    return blocks.repartition("set_id", "_block").select("set_id", "n", F.explode(F.sequence(first, F.least(first + block, F.col("n")) - 1)).alias("i"))


def _long_transform(rows: DataFrame, counts: DataFrame, cells: int) -> DataFrame:
    """The unscaled transform (set_id, n, i, re, im) of (set_id, i, re, im), i below the set's n, absent rows being zero.

    A convolution with a chirp turns a length into the power of two that holds twice as many points, whose transform
    is dealt over tasks.
    """
    longest = counts.agg(F.max("n")).first()[0] or 1
    bits = max(2, (2 * longest - 1).bit_length())
    high, low = 1 << (bits // 2), 1 << (bits - bits // 2)
    m = high * low
    angle = F.lit(math.pi) * (F.pmod(F.col("i") * F.col("i"), 2 * F.col("n")) / F.col("n"))
    turned = [(F.col("re") * F.cos(angle) + F.col("im") * F.sin(angle)).alias("re"), (F.col("im") * F.cos(angle) - F.col("re") * F.sin(angle)).alias("im")]
    a = rows.join(counts, "set_id").select("set_id", "i", *turned)
    both = F.array_distinct(F.array(F.col("i"), F.pmod(m - F.col("i"), F.lit(m))))  # the chirp is even
    b = _places(counts).select("set_id", F.explode(both).alias("i"), F.cos(angle).alias("re"), F.sin(angle).alias("im"))
    fa, fb = (_transform(t, high, low, -1, cells) for t in (a, b))
    product = _product(fa, fb)
    out = _transform(product, high, low, 1, cells).join(counts, "set_id").where(F.col("i") < F.col("n"))
    return out.select("set_id", "n", "i", *[(t / m).alias(k) for t, k in zip(turned, ("re", "im"))])


def _product(a: DataFrame, b: DataFrame, by_reverse: bool = False, least: float = 0.0) -> DataFrame:
    """Place by place a * b, or a / b (0 where b is not above ``least``)."""
    both = a.join(b.select("set_id", "i", F.col("re").alias("_re"), F.col("im").alias("_im")), ["set_id", "i"])
    re, im, c, d = F.col("re"), F.col("im"), F.col("_re"), F.col("_im")
    if not by_reverse:
        return both.select("set_id", "i", (re * c - im * d).alias("re"), (re * d + im * c).alias("im"))
    size = c * c + d * d
    over = lambda v: F.when(size > least * least, v / size).otherwise(0.0)
    return both.select("set_id", "i", over(re * c + im * d).alias("re"), over(im * c - re * d).alias("im"))


def long_spectrum(df: DataFrame, c: str, cells: int = 1 << 22) -> DataFrame:
    """As :func:`spectrum`, for sets of any length (idx from 0 without gaps), dealt over tasks of ``cells`` cells."""
    short, longer = _parted(df.select("set_id", "idx", c), F.count("*"), cells)
    return spectrum(short, c, cells) if longer is None else spectrum(short, c, cells).unionByName(_dealt_spectrum(longer, c, cells))


def _dealt_spectrum(df: DataFrame, c: str, cells: int) -> DataFrame:
    filled, counts = _filled(df, c)
    rows = filled.select("set_id", F.col("idx").alias("i"), F.col("v").alias("re"), F.lit(0.0).alias("im"))
    found = _long_transform(rows, counts, cells).where(F.col("i") <= F.floor(F.col("n") / 2)).withColumnRenamed("i", "k")
    return found.withColumn("power", (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("n") * F.col("n"))).select("set_id", "k", "re", "im", "power", "n")


def _long_back(rows: DataFrame, counts: DataFrame, cells: int, scaled: bool = True) -> DataFrame:
    """set_id, idx and value, the real part of the inverse transform: that of the conjugate is its conjugate."""
    out = _long_transform(rows.select("set_id", "i", "re", (-F.col("im")).alias("im")), counts, cells)
    return out.select("set_id", F.col("i").alias("idx"), (F.col("re") / F.col("n") if scaled else F.col("re")).alias("value"))


def long_inverse(transformed: DataFrame, scaled: bool = True, cells: int = 1 << 22) -> DataFrame:
    """As :func:`inverse`, for sets of any length."""
    short, longer = _parted(transformed, F.max("n"), cells)
    return inverse(short, scaled) if longer is None else inverse(short, scaled).unionByName(_dealt_inverse(longer, scaled, cells))


def _dealt_inverse(transformed: DataFrame, scaled: bool, cells: int) -> DataFrame:
    n, k = F.col("n"), F.col("k")
    counts = checkpointed(transformed.groupBy("set_id").agg(F.max("n").cast("long").alias("n")))
    half = transformed.where(k <= F.floor(n / 2))
    own = F.struct(k.alias("i"), F.col("re").cast("double").alias("re"), F.when((k == 0) | (2 * k == n), 0.0).otherwise(F.col("im").cast("double")).alias("im"))
    # the upper frequencies are the lower ones' conjugates
    mirrored = F.when((k > 0) & (2 * k < n), F.array(own, F.struct((n - k).alias("i"), F.col("re").cast("double").alias("re"), (-F.col("im")).cast("double").alias("im")))).otherwise(F.array(own))
    return _long_back(half.select("set_id", F.explode(mirrored).alias("_x")).select("set_id", "_x.*"), counts, cells, scaled)


def long_cyclic_convolution(df: DataFrame, c: str, mask: list[float], deconvolve: bool = False, cells: int = 1 << 22, least: float = 1e-9) -> DataFrame:
    """As :func:`cyclic_convolution`, for sets of any length (idx from 0 without gaps).

    Values and mask of a long set are transformed over tasks, multiplied place by place and turned back. A deconvolution
    leaves 0 where the mask's transform is not above ``least``, which is larger than for a set in one task, as rounding is.
    """
    short, longer = _parted(df.select("set_id", "idx", c), F.count("*"), cells)
    out = cyclic_convolution(short, c, mask, deconvolve, cells, least)
    return out if longer is None else out.unionByName(_dealt_convolution(longer, c, mask, deconvolve, cells, least))


def _dealt_convolution(df: DataFrame, c: str, mask: list[float], deconvolve: bool, cells: int, least: float) -> DataFrame:
    filled, counts = _filled(df, c)
    values = filled.select("set_id", F.col("idx").alias("i"), F.col("v").alias("re"), F.lit(0.0).alias("im"))

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, weights = np.arange(len(mask)) - len(mask) // 2, np.asarray(mask, float)
        for frame in frames:
            for key, n in zip(frame["set_id"], frame["n"]):
                # cells of a mask longer than the set wrap round and add up
                cell, own = np.unique(at % n, return_inverse=True)
                yield pd.DataFrame({"set_id": key, "i": cell, "re": np.bincount(own, weights), "im": 0.0})

    wide = counts.mapInPandas(placed, f"set_id {_kind(counts)}, i long, re double, im double")
    a, b = (_long_transform(t, counts, cells).drop("n") for t in (values, wide))
    return _long_back(_product(a, b, deconvolve, least), counts, cells)
