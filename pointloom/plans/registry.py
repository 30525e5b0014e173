"""The registry that every module of queries adds to, and the points the queries start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.points import points

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The scatter points: one set per supplier.
P = """p AS (
  SELECT l_suppkey AS set_id,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS idx,
         l_quantity AS x, l_extendedprice AS y, l_tax AS e, 1 + l_discount AS w
  FROM lineitem)"""
#: The series: one set per user; t in hours, y the value (missing for errors), v the value, a an angle of base 360.
S = """s AS (
  SELECT user_id AS set_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
         (epoch_us(ts) - 1704067200000000) / 3.6e9 AS t,
         CASE WHEN event_type <> 'error' THEN value END AS y, value AS v, (value * 37) % 360 AS a
  FROM events)"""


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its DuckDB form, in which {P} and {S} stand for the points' definitions."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql.replace("{P0}", P.replace("p AS", "p0 AS", 1)).replace("{P}", P).replace("{S}", S).strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    return points(rows, "l_suppkey", order, x="l_quantity", y="l_extendedprice", e="l_tax", w=1 + F.col("l_discount"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / F.lit(3.6e9)
    y = F.when(F.col("event_type") != "error", F.col("value"))
    return points(rows, "user_id", ["ts", "event_id"], t=t, y=y, v="value", a=(F.col("value") * 37) % 360)


def r(column, digits: int = 6):
    """Rounded, for results that are compared over engines; NaN and infinite values become null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.round(c, digits))
