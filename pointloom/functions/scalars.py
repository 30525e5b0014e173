"""Scalar functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pointloom.operators.points import column

TAU = 2 * math.pi
EPSILON = 2.220446049250313e-16


def _c(v: str | float | Column) -> Column:
    return v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(v)


def divide(a, b, undefined: float | None = None) -> Column:
    """a / b; over 0 it is infinite with the sign of a, and 0 / 0 is ``undefined``."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return F.when(b != 0, F.try_divide(a, b)).when(b == 0, F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a == 0, F.lit(undefined).cast("double")))


def relative_difference(a, b) -> Column:
    """(a - b) / b."""
    return F.try_divide(_c(a) - _c(b), _c(b))


def fmadd(a, b, c) -> Column:
    return _c(a) * _c(b) + _c(c)


def signed_power(x, y) -> Column:
    """x to a power; for negative x minus the power of |x|."""
    return F.signum(_c(x)) * F.pow(F.abs(_c(x)), _c(y))


def product_of_steps(x, dx: float = 1.0) -> Column:
    """x (x - dx) (x - 2 dx) ... down to the last positive factor; 1 for x <= 0. dx 1 gives the factorial."""
    n = F.greatest(F.ceil(_c(x) / dx), F.lit(0)).cast("int")
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(1.0), lambda a, k: a * (_c(x) - k * dx))).otherwise(1.0)


def log_base(x, base: float = math.e) -> Column:
    return F.when(_c(x) > 0, F.log(_c(x)) / math.log(base))


def norm(*values) -> Column:
    return F.sqrt(sum((_c(v) * _c(v) for v in values), F.lit(0.0)))


def compress(x, exponent: float, c: float) -> Column:
    """x^F / (|x^F| + C^F), keeping the sign of x."""
    p = signed_power(x, F.lit(exponent))
    return F.try_divide(p, F.abs(p) + abs(c) ** exponent)


def _angle(x, base: float) -> Column:
    return _c(x) * (TAU / (base or TAU))


def sin(x, base: float = 0) -> Column:
    return F.sin(_angle(x, base))


def cos(x, base: float = 0) -> Column:
    return F.cos(_angle(x, base))


def tan(x, base: float = 0) -> Column:
    return F.tan(_angle(x, base))


def asin(x, base: float = 0) -> Column:
    return F.when(_c(x).between(-1, 1), F.asin(_c(x)) * ((base or TAU) / TAU))


def acos(x, base: float = 0) -> Column:
    return F.when(_c(x).between(-1, 1), F.acos(_c(x)) * ((base or TAU) / TAU))


def atan(x, base: float = 0) -> Column:
    return F.atan(_c(x)) * ((base or TAU) / TAU)


def atan2(y, x, base: float = 0) -> Column:
    return F.atan2(_c(y), _c(x)) * ((base or TAU) / TAU)


def arg(x, y, base: float = 0) -> Column:
    """The angle of (x, y) in [0, base); 0 for the origin."""
    b = base or TAU
    a = F.atan2(_c(y), _c(x)) * (b / TAU)
    return F.when(a < 0, a + b).otherwise(a)


def half_turn(x, base: float = 360.0) -> Column:
    """An angle brought to (-base/2, base/2]."""
    r = F.pmod(_c(x).cast("double"), F.lit(float(base)))
    return F.when(r > base / 2, r - base).otherwise(r)


def full_turn(x, base: float = 360.0) -> Column:
    """An angle brought to [0, base)."""
    return F.pmod(_c(x).cast("double"), F.lit(float(base)))


def angle_difference(a, b, base: float = 360.0) -> Column:
    return half_turn(_c(a) - _c(b), base)


def subtended(radius, distance, base: float = 0, sphere: bool = False) -> Column:
    """The angle under which a disc (or a sphere) of a radius appears at a distance."""
    b = base or TAU
    if sphere:
        return F.when(_c(distance) >= _c(radius), 2 * F.asin(F.try_divide(_c(radius), _c(distance)))) * (b / TAU)
    return 2 * F.atan2(_c(radius), _c(distance)) * (b / TAU)


def truncate(x) -> Column:
    """The whole part, toward 0."""
    return F.signum(_c(x)) * F.floor(F.abs(_c(x)))


def round_to(x, precision: float, half_up: bool = True) -> Column:
    """x to a multiple of the precision: the nearest, or the one below."""
    q = _c(x) / precision
    return (F.floor(q + 0.5) if half_up else F.floor(q)) * precision


def fmod(x, y) -> Column:
    """Remainder with the sign of x."""
    return _c(x) % F.nullif(_c(y).cast("double"), F.lit(0.0))


def fmod_positive(x, y) -> Column:
    """Remainder in [0, |y|)."""
    return F.pmod(_c(x), F.nullif(F.abs(_c(y)).cast("double"), F.lit(0.0)))


def is_even(x) -> Column:
    return F.pmod(F.floor(_c(x)), F.lit(2)) == 0


def close(x, y, precision: float = -1) -> Column:
    """Whether x lies within (1 - p) y and (1 + p) y; -1 stands for the machine's precision."""
    p = EPSILON if precision < 0 else precision
    a, b = (1 - p) * _c(y), (1 + p) * _c(y)
    return _c(x).between(F.least(a, b), F.greatest(a, b))


def compare(x, y, precision: float = -1) -> Column:
    """0 if close, else 1 or -1."""
    return F.when(close(x, y, precision), 0).when(_c(x) > _c(y), 1).otherwise(-1)


def at_least(x, y, precision: float = -1) -> Column:
    return close(x, y, precision) | (_c(x) > _c(y))


def at_most(x, y, precision: float = -1) -> Column:
    return close(x, y, precision) | (_c(x) < _c(y))


def truth(x) -> Column:
    """Numbers as truth: 0 and NaN (and null) are false, all others true."""
    return F.coalesce((_c(x) != 0) & ~F.isnan(_c(x).cast("double")), F.lit(False))


def either(a: Column, b: Column) -> Column:
    """Exactly one of the two."""
    return a != b


def switch(x, cases: list[tuple], default=None) -> Column:
    """The value of the first case that x equals, or is one of if the case is a list."""
    out = None
    for case, value in cases:
        hit = _c(x).isin(list(case)) if isinstance(case, (list, tuple)) else _c(x) == case
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.lit(default) if out is None else out.otherwise(default)


def flat_index(indexes: list, sizes: list[int]) -> Column:
    """The place of an element in a matrix stored by rows; null outside."""
    out, inside = F.lit(0), F.lit(True)
    for i, n in zip(indexes, sizes):
        out = out * n + _c(i)
        inside = inside & (_c(i) >= 0) & (_c(i) < n)
    return F.when(inside, out)


def strided(array: str | Column, stride: int = 1, start: int = 0) -> Column:
    """Every stride-th element from ``start`` on, backwards if negative."""
    a = F.reverse(column(array)) if stride < 0 else column(array)
    return F.filter(a, lambda v, i: (i >= start) & ((i - start) % abs(stride) == 0))


def basename(path, extension: str = "") -> Column:
    """What follows the last slash, without the extension if it ends in it."""
    name = F.regexp_extract(_c(path), r"([^/]*)$", 1)
    if not extension:
        return name
    return F.when(name.endswith(extension) & (F.length(name) > len(extension)), F.substring(name, 1, F.length(name) - len(extension))).otherwise(name)


def text_differs(a, b, n: int | None = None, ignore_case: bool = False) -> Column:
    """0 if two texts (or their first n characters) are equal, else -1 or 1 by their order."""
    a, b = _c(a), _c(b)
    if ignore_case:
        a, b = F.lower(a), F.lower(b)
    if n is not None:
        a, b = F.substring(a, 1, n), F.substring(b, 1, n)
    return F.when(a == b, 0).when(a < b, -1).otherwise(1)


def from_match(text, part: str, last: bool = False, ignore_case: bool = False) -> Column:
    """The text from the first (or last) occurrence of a part on; null if there is none."""
    s, low, p = _c(text), F.lower(_c(text)) if ignore_case else _c(text), part.lower() if ignore_case else part
    if last:
        at = F.length(s) - F.locate(p[::-1], F.reverse(low)) - len(p) + 2
        return F.when(F.locate(p, low) > 0, F.substring(s, at, F.length(s)))
    return F.when(F.locate(p, low) > 0, F.substring(s, F.locate(p, low), F.length(s)))


def count_of(text, part: str) -> Column:
    """How often a part occurs, without overlaps."""
    return ((F.length(_c(text)) - F.length(F.replace(_c(text), F.lit(part), F.lit("")))) / len(part)).cast("int")


def newlines_encoded(text) -> Column:
    return F.replace(F.replace(_c(text), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def timecode(t, base: float = 0) -> Column:
    """Seconds as HH:MM:SS.ff, or with a base as HH:MM:SS:ticks."""
    s = F.floor(_c(t))
    head = F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    part = _c(t) - s
    return F.concat(head, F.format_string(":%02d", F.floor(part * base)) if base else F.format_string(".%02d", F.floor(part * 100 + 1e-6)))


def year_day(day, month, year) -> Column:
    """The day of the year, null for a date that does not exist."""
    date = F.try_make_timestamp(_c(year), _c(month), _c(day), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))
    return F.dayofyear(date)


def text_hash(text) -> Column:
    """A whole number from 0 to 2^60 - 1 from the first digits of the text's MD5, the same in every engine."""
    return F.conv(F.substring(F.md5(_c(text).cast("binary")), 1, 15), 16, 10).cast("long")


def uniform(low: float, high: float, seed: int) -> Column:
    return low + (high - low) * F.rand(seed)


def normal(mean: float, deviation: float, seed: int) -> Column:
    return mean + deviation * F.randn(seed)


def abnormal(average: float, deviation: float, seed: int) -> Column:
    """A normal variate about the average, as far as it is positive there: |normal(0, 1)| * deviation + average."""
    return average + deviation * F.abs(F.randn(seed))


def line_in_circle(x1, y1, x2, y2, cx, cy, radius) -> Column:
    """Where the segment from 1 to 2 crosses a circle: an array of 0 to 2 places (x, y), in order from 1 on."""
    dx, dy, fx, fy = _c(x2) - _c(x1), _c(y2) - _c(y1), _c(x1) - _c(cx), _c(y1) - _c(cy)
    a, b, c = dx * dx + dy * dy, 2 * (fx * dx + fy * dy), fx * fx + fy * fy - _c(radius) * _c(radius)
    square = b * b - 4 * a * c
    root = F.when((a > 0) & (square >= 0), F.sqrt(F.greatest(square, F.lit(0.0))))
    places = F.array_distinct(F.array(F.try_divide(-b - root, 2 * a), F.try_divide(-b + root, 2 * a)))
    hits = F.filter(places, lambda s: s.isNotNull() & (s >= 0) & (s <= 1))
    return F.transform(hits, lambda s: F.struct((_c(x1) + s * dx).alias("x"), (_c(y1) + s * dy).alias("y")))
