"""Projections, filters and predicates on points and sets."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators.points import column, whole

TAU = 6.283185307179586


def assign_roles(df: DataFrame, x: str, y: str, e: str | None = None, l: str | None = None, n: str | None = None, keys: tuple = ("set_id", "idx")) -> DataFrame:  # noqa: E741
    """Which columns are x, y, error, length and observations; without x the index serves (one-column sets)."""
    given = {"x": x or "idx", "y": y, "e": e, "l": l, "n": n}
    return df.select(*keys, *[F.col(c).cast("double").alias(role) for role, c in given.items() if c])


def scale(df: DataFrame, fx: float = 1.0, fy: float = 1.0, fe: float = 1.0, per_set: DataFrame | None = None, absolute_y: bool = False) -> DataFrame:
    """x, y and e times the table's factors and, from ``per_set`` (set_id, fx, fy, fe), the set's own."""
    if per_set is not None:
        df = df.join(per_set.select("set_id", *[F.col(c).alias(f"_{c}") for c in ("fx", "fy", "fe")]), "set_id", "left")
    new = {c: F.col(c) * f * (F.coalesce(f"_f{c}", F.lit(1.0)) if per_set is not None else 1.0) for c, f in (("x", fx), ("y", fy), ("e", fe)) if c in df.columns}
    if absolute_y:
        new["y"] = F.abs(new["y"])
    return df.withColumns(new).drop("_fx", "_fy", "_fe")


def process(df: DataFrame, **expressions: Column) -> DataFrame:
    """New columns, all of whose expressions see the point as it was."""
    kept = [c for c in df.columns if c not in expressions]
    return df.select(*kept, *[e.alias(c) for c, e in expressions.items()])


def staged(df: DataFrame, initial: dict[str, Column], each: dict[str, Column], final: dict[str, Column], by: str = "set_id") -> tuple[DataFrame, DataFrame]:
    """Per set: aggregates first, then expressions per point that may use them, then aggregates of the results."""
    first = df.withColumns({c: a.over(whole(by)) for c, a in initial.items()})
    points = process(first, **each)
    return points, points.groupBy(by).agg(*[a.alias(c) for c, a in final.items()])


def set_specific(df: DataFrame, name: str, cases: dict[int, Column], common: Column | None = None, by: str = "set_id") -> DataFrame:
    """A column by an expression of its own for some sets, and a common one (or itself) for the others."""
    out = None
    for key, e in cases.items():
        out = F.when(F.col(by) == key, e) if out is None else out.when(F.col(by) == key, e)
    other = F.col(name) if common is None else common
    return df.withColumn(name, other if out is None else out.otherwise(other))


def log_axis(x: str | Column, for_zero: float | None = None) -> Column:
    """log10 of x; zero counts as ``for_zero`` if given, else it gives minus infinity; negative values give null."""
    x = column(x)
    zero = F.lit(float("-inf")) if for_zero is None else F.lit(for_zero)
    return F.when(x == 0, zero if for_zero is None else F.log10(zero)).when(x > 0, F.log10(x))


def power_axis(x: str | Column, exponent: float) -> Column:
    """|x| to a power, with the sign of x."""
    return F.signum(column(x)) * F.pow(F.abs(column(x)), F.lit(exponent))


def polar(angle: str | Column, radius: str | Column, base: float = 360.0, offset: float = 0.0, exponent: float = 1.0) -> tuple[Column, Column]:
    """Cartesian x and y of a radius at an angle; the cosine and sine keep their sign under the exponent."""
    theta = TAU * (column(angle) + offset) / base
    curve = lambda c: c if exponent == 1.0 else power_axis(c, exponent)
    return column(radius) * curve(F.cos(theta)), column(radius) * curve(F.sin(theta))


def discard(df: DataFrame, condition: Column, low: int | None = None, high: int | None = None, restore: Column | None = None) -> DataFrame:
    """Mark points as discarded where the condition holds (for idx from low to high) and unmark where ``restore`` does."""
    before = F.col("discarded") if "discarded" in df.columns else F.lit(False)
    inside = F.lit(True)
    if low is not None:
        inside &= F.col("idx") >= low
    if high is not None:
        inside &= F.col("idx") <= high
    marked = F.when(inside & F.coalesce(condition, F.lit(False)), True)
    if restore is not None:
        marked = F.when(inside & F.coalesce(restore, F.lit(False)), False).when(inside & F.coalesce(condition, F.lit(False)), True)
    return df.withColumn("discarded", marked.otherwise(before))


def where_equal(df: DataFrame, field: str, value, eps: float | None = None) -> DataFrame:
    return df.where(F.col(field) == value) if eps is None else df.where(F.abs(F.col(field) - value) < eps)


def where_not_equal(df: DataFrame, field: str, value, eps: float | None = None) -> DataFrame:
    return df.where(F.col(field) != value) if eps is None else df.where(F.abs(F.col(field) - value) >= eps)


def where_less(df: DataFrame, field: str, value) -> DataFrame:
    return df.where(F.col(field) < value)


def where_less_equal(df: DataFrame, field: str, value) -> DataFrame:
    return df.where(F.col(field) <= value)


def where_greater(df: DataFrame, field: str, value) -> DataFrame:
    return df.where(F.col(field) > value)


def where_greater_equal(df: DataFrame, field: str, value) -> DataFrame:
    return df.where(F.col(field) >= value)


def where_in(df: DataFrame, field: str, values: list) -> DataFrame:
    return df.where(F.col(field).isin(values))


def where_true(df: DataFrame, field: str, predicate: Callable[[Column], Column]) -> DataFrame:
    """Rows for which a function of the column is true; the function may be built of columns or be a pandas UDF."""
    return df.where(predicate(F.col(field)))


def in_box(x: str | Column, y: str | Column, low_x: float, low_y: float, high_x: float, high_y: float) -> Column:
    return column(x).between(low_x, high_x) & column(y).between(low_y, high_y)


def box_filter(df: DataFrame, box: Column, only_set: int | None = None, **expressions: Column) -> DataFrame:
    """Expressions for the points inside a box (of one set, if given); other points stay as they are."""
    where = box if only_set is None else box & (F.col("set_id") == only_set)
    return process(df, **{c: F.when(where, e).otherwise(F.col(c)) for c, e in expressions.items()})


def visible_indexes(df: DataFrame, visible: Column, by: str = "set_id") -> DataFrame:
    """Per set the sorted places of the visible points. A list of a whole set: for sets that fit a row."""
    return df.where(visible).groupBy(by).agg(F.sort_array(F.collect_list("idx")).alias("indexes"))


def every_nth(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("idx") % n == 0)


def select_sets(points: DataFrame, sets: DataFrame, condition: Column, reverse: bool = False) -> DataFrame:
    """The points of the sets that meet a condition on their metadata, or of the others."""
    return points.join(sets.where(condition).select("set_id"), "set_id", "left_anti" if reverse else "left_semi")


def has_all(assoc: str | Column, values: list[float]) -> Column:
    wanted = F.array(*[F.lit(float(v)) for v in dict.fromkeys(values)])
    return F.size(F.array_intersect(column(assoc), wanted)) == len(set(values))


def has_any(assoc: str | Column, values: list[float]) -> Column:
    return F.arrays_overlap(column(assoc), F.array(*[F.lit(float(v)) for v in values]))


def nth_in(assoc: str | Column, k: int, values: list[float]) -> Column:
    """Whether the association at place k (from 0) is one of the values; false beyond the list's end."""
    return F.coalesce(F.get(column(assoc), F.lit(k)).isin([float(v) for v in values]), F.lit(False))


def resized(assoc: str | Column, n: int, fill: float = 0.0) -> Column:
    """The list cut or filled up to n values."""
    c = column(assoc)
    return F.slice(F.concat(c, F.array_repeat(F.lit(fill), n)), 1, n)


def column_like(df: DataFrame, pattern: str, partial: bool = True, with_case: bool = False) -> str | None:
    """The first column whose name matches a pattern, in part or as a whole."""
    p = re.compile(pattern, 0 if with_case else re.I)
    return next((c for c in df.columns if (p.search(c) if partial else p.fullmatch(c))), None)


def keep_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c in names])


def shift_rotate(x: Column, y: Column, angle: Column | float = 0.0, scale_by: Column | float = 1.0, centre: tuple = (0.0, 0.0), shift: tuple = (0.0, 0.0), base: float = 360.0) -> tuple[Column, Column]:
    """Scaled, then turned about a centre, then moved."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    cx, cy, dx, dy = map(as_column, (*centre, *shift))
    theta = as_column(angle) * (TAU / base)
    u, v = x * as_column(scale_by) - cx, y * as_column(scale_by) - cy
    return u * F.cos(theta) - v * F.sin(theta) + cx + dx, u * F.sin(theta) + v * F.cos(theta) + cy + dy


def clip(x: str | Column, low: float, high: float) -> Column:
    return F.least(F.greatest(column(x), F.lit(low)), F.lit(high))


def is_missing(x: str | Column) -> Column:
    return column(x).isNull() | F.isnan(column(x))


def is_infinite(x: str | Column) -> Column:
    return F.abs(column(x)) == float("inf")
