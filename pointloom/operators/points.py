"""The table of points and what it is made from.

A table of points has one row per point, the key ``set_id`` of its set and ``idx``, its place in the set from 0.
Missing values are null in the library; sources turn NaN into null where a column's meaning asks for it.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def points(rows: DataFrame, set_id: str | Column, order: list, **roles: str | Column) -> DataFrame:
    """set_id, idx and a column for each role; ``order`` must be unique within a set."""
    place = Window.partitionBy(column(set_id)).orderBy(*[column(o) for o in order])
    return rows.select(
        column(set_id).alias("set_id"),
        (F.row_number().over(place) - 1).cast("long").alias("idx"),
        *[column(c).alias(name) for name, c in roles.items()],
    )


def ordered(order: str | Column = "idx", by: str | list = "set_id") -> Window:
    """The window that the ordered operators share: partitioned by set, in point order."""
    return Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(order)


def running(order: str | Column = "idx", by: str | list = "set_id") -> Window:
    """From the set's first point to the present one."""
    return ordered(order, by).rowsBetween(Window.unboundedPreceding, 0)


def whole(by: str | list = "set_id") -> Window:
    return Window.partitionBy(*([by] if isinstance(by, str) else by))


def nan_to_null(c: str | Column) -> Column:
    return F.nanvl(column(c), F.lit(None).cast("double"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a local session gets a temporary folder; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, with their lineage cut through the shared folder."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def with_positions(df: DataFrame, order: list, name: str) -> DataFrame:
    """Each row's place (long, from 0) in the order of the whole table, which must be unique for a stable result.

    The table is sorted over all tasks; the places before a partition come from the counts of the others, one row for
    each partition.
    """
    rows = checkpointed(df.orderBy(*[column(o) for o in order]).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    w = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    before = rows.groupBy(part).count().select("_part", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("_part", part).join(F.broadcast(before), "_part").select(*df.columns, place.cast("long").alias(name))
