"""Exact order statistics of bins of any size, by ranges of values.

A bin of up to ``most_rows`` values is sorted in a task. The values of larger ones are counted and dealt over ranges,
in the order of bin and value, so that a large bin has many ranges and many a bin shares one. How many values a bin
has in each range tells the range that holds a rank, and only there the bin's values are sorted. All bins and ranks
go at once, and nothing of a bin is gathered beyond its share of a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.points import checkpointed

MOST_ROWS = 1_000_000
GRID = 512
#: Large bins, or ranks of theirs, up to which the tables about them are broadcast (some hundred bytes a row).
BROADCAST_BINS = 100_000


def _spread(rows: DataFrame, table: DataFrame, keys: list[str], n_table: int) -> DataFrame:
    """Rows with the row of their key in ``table``, which is broadcast where it is small."""
    return rows.join(F.broadcast(table) if n_table <= BROADCAST_BINS else table, keys)


def selected(values: DataFrame, targets: DataFrame, keys: list[str], grid: int = GRID) -> DataFrame:
    """The values at given ranks: ``values`` has keys (never null) and v; ``targets`` has keys and rank (from 0).
    Returns keys, rank and v. Values are dealt over ``grid`` ranges at least."""
    targets = checkpointed(targets.select(*keys, "rank"))
    n_targets = targets.count()
    ranges = max(grid, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # equal values are one row, so that no value is more than a range
    counted = values.groupBy(*keys, "v").agg(F.count("*").alias("c"))
    dealt = checkpointed(counted.repartitionByRange(ranges, *keys, "v").withColumn("range", F.spark_partition_id()))
    cell = [*keys, "range"]
    upto = lambda c, order: F.sum(c).over(Window.partitionBy(*(k for k in cell if k != order)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    sizes = dealt.groupBy(*cell).agg(F.sum("c").alias("n")).withColumn("end", upto("n", "range"))
    within = (F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("n"))
    found = checkpointed(_spread(sizes, targets, keys, n_targets).where(within).select(*cell, "rank", (F.col("rank") - F.col("end") + F.col("n")).alias("at")))
    held = _spread(dealt, found.select(*cell).distinct(), cell, n_targets).withColumn("end", upto("c", "v"))
    at = (F.col("at") < F.col("end")) & (F.col("at") >= F.col("end") - F.col("c"))
    return _spread(held, found, cell, n_targets).where(at).select(*keys, "rank", "v")


def quantiles(df: DataFrame, by: list[str], x: str | Column, ps: list[float], most_rows: int = MOST_ROWS, grid: int = GRID) -> DataFrame:
    """by, n and q (an array, by linear interpolation between order statistics) of each bin, null and NaN left out.

    Bins may have null keys; a bin without values has n 0 and a null q; an empty table has no bins.
    """
    c = (F.col(x) if isinstance(x, str) else x).cast("double")
    # a struct of the keys is never null, and its null fields meet
    rows = df.select(F.struct(*by).alias("bin") if by else F.struct(F.lit(0).alias("all")).alias("bin"), F.when(~F.isnan(c), c).alias("v"))
    sizes = checkpointed(rows.groupBy("bin").agg(F.count("v").alias("n")))
    rows = rows.where("v IS NOT NULL")
    large = sizes.where(F.col("n") > most_rows).select("bin", "n")
    n_large = large.count()
    n_small = sizes.where(F.col("n") <= most_rows).count()
    out = rows
    if n_large and n_small:
        out = rows.join(F.broadcast(large.select("bin")) if n_large <= BROADCAST_BINS else large.select("bin"), "bin", "left_anti")
    found = out.groupBy("bin").agg(F.percentile("v", F.array(*[F.lit(float(p)) for p in ps])).alias("q"))
    if n_large:
        place = [F.col("n").cast("double") * p - p for p in ps]
        ranks = F.array_distinct(F.array(*[f(h).cast("long") for h in place for f in (F.floor, F.ceil)]))
        targets = large.select("bin", "n", F.explode(ranks).alias("rank"))
        held = _spread(rows, large.select("bin"), ["bin"], n_large) if n_small else rows
        got = selected(held, targets, ["bin"], grid).groupBy("bin").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))  # two entries a quantile
        got = got.join(large, "bin")
        low, high = ([F.element_at("at", f(h).cast("long")) for h in place] for f in (F.floor, F.ceil))
        between = [a + F.when(b > a, (b - a) * (h - F.floor(h))).otherwise(0.0) for a, b, h in zip(low, high, place)]
        got = got.select("bin", F.array(*between).alias("q"))
        found = found.unionByName(got) if n_small else got
    out = sizes.join(found, "bin", "left")
    return out.select(*([f"bin.{k}" for k in by]), "n", "q")


def medians(df: DataFrame, by: list[str], x: str | Column, most_rows: int = MOST_ROWS, grid: int = GRID) -> DataFrame:
    """by, n and median of each bin."""
    return quantiles(df, by, x, [0.5], most_rows, grid).select(*by, "n", F.get("q", F.lit(0)).alias("median"))


def median_deviations(df: DataFrame, by: list[str], x: str, scale: float, most_rows: int = MOST_ROWS, grid: int = GRID) -> DataFrame:
    """by, median and adev: the median absolute deviation about it, times ``scale``."""
    centre = checkpointed(medians(df, by, x, most_rows, grid).select(F.struct(*by).alias("bin"), "median"))
    few = centre.count() <= BROADCAST_BINS
    rows = df.select(F.struct(*by).alias("bin"), F.col(x).cast("double").alias("v"))
    off = rows.join(F.broadcast(centre) if few else centre, "bin").select("bin", F.abs(F.col("v") - F.col("median")).alias("off"))
    adev = medians(off, ["bin"], "off", most_rows, grid).select("bin", (F.col("median") * scale).alias("adev"))
    return centre.join(adev, "bin").select(*[f"bin.{k}" for k in by], "median", "adev")
