"""What users bring: functions of columns, of values, of whole sets, aggregates and row generators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def call(f: Callable[..., Column], *arguments: str | Column, **named) -> Column:
    """A procedure of columns applied to columns: it is inlined into the plan."""
    return f(*[F.col(a) if isinstance(a, str) else a for a in arguments], **named)


def on_values(f: Callable[..., np.ndarray], returns: str = "double"):
    """A function of NumPy arrays as a column function, by batches of rows."""

    @F.pandas_udf(returns)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(f(*[c.to_numpy() for c in columns]))

    return run


def on_sets(df: DataFrame, f: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str, by: str = "set_id") -> DataFrame:
    """A function that gets a whole set's columns as arrays, in point order, and returns columns. A set is one task's
    work."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        return pd.DataFrame(f({c: frame[c].to_numpy() for c in frame.columns}))

    return df.groupBy(by).applyInPandas(run, schema)


def aggregate(f: Callable[..., float], returns: str = "double"):
    """A function of arrays to a number as an aggregate."""

    from pyspark.sql.pandas.functions import PandasUDFType

    return F.pandas_udf(lambda *c: float(f(*[v.to_numpy() for v in c])), returns, PandasUDFType.GROUPED_AGG)


@F.udtf(returnType="idx int, t double, x double, y double")
class CurvePoints:
    """Rows of one curve of the family y = (x - i) x - i over n places."""

    def eval(self, i: int, n: int):
        for k in range(n):
            x = float(k)
            yield k, k / max(n - 1, 1), x, (x - i) * x - i
