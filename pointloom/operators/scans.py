"""Scans along ordered sets: what a point takes from those before and behind it.

:func:`scanned` adds such columns in one go. Without ``block`` they are window columns, a set being one task's work.
With it a set of any length is cut into blocks of consecutive ``idx``: each block is scanned on its own and leaves one
row of what it hands on (its last row, last and first known values, sums, sums since the last reset); those rows are
scanned in turn, and every block takes what came before it from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.points import checkpointed, column


def _known(c: Column, order: str) -> Column:
    return F.when(c.isNotNull(), F.col(order))


def scanned(
    df: DataFrame,
    block: int | None = None,
    by: str | list[str] = "set_id",
    order: str = "idx",
    lag: dict[str, str | Column] | None = None,
    last: dict[str, str | Column] | None = None,
    before: dict[str, str | Column] | None = None,
    ahead: dict[str, str | Column] | None = None,
    sums: dict[str, str | Column] | None = None,
    since: dict[str, tuple[str | Column, str | Column]] | None = None,
    whole: dict[str, Column] | None = None,
) -> DataFrame:
    """``df`` with columns from along each set; of each kind a name for each column.

    lag: the value in the row before; last: the last known (non-null) value up to the row; before: the same without the
    row; ahead: the first known value from the row on; sums: the sum up to the row, 0 while there is nothing to add;
    since: (value, reset) the sum since the last row with a true reset, that row included; whole: an aggregate of the
    set. Sets may have a null key; ``order`` is unique in a set.
    """
    by = [by] if isinstance(by, str) else by
    lag, last, before, ahead, sums = ({k: column(c) for k, c in (d or {}).items()} for d in (lag, last, before, ahead, sums))
    since = {k: (column(c), F.coalesce(column(reset).cast("boolean"), F.lit(False))) for k, (c, reset) in (since or {}).items()}
    whole = whole or {}
    part = by if block is None else [*by, "_block"]
    if block is not None:
        # read twice, for the blocks' rows and for the points
        df = checkpointed(df.withColumn("_block", F.floor(F.col(order) / block)))
    names = df.columns
    w = Window.partitionBy(*part).orderBy(order)
    up_to, strictly, from_here = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    # columns of the frames come first, so that a name may be given to what it is made from
    own = {f"_in_{k}": c for d in (lag, last, before, ahead, sums) for k, c in d.items()}
    own |= {f"_in_{k}": c for k, (c, _) in since.items()} | {f"_re_{k}": reset.cast("long") for k, (_, reset) in since.items()}
    df = df.withColumns(own) if own else df
    segments = {f"_at_{k}": F.sum(f"_re_{k}").over(up_to) for k in since}
    df = df.withColumns(segments) if segments else df
    found = {f"_a_{k}": F.lag(f"_in_{k}").over(w) for k in lag}
    found |= {f"_a_{k}": F.last(f"_in_{k}", True).over(up_to) for k in last} | {f"_a_{k}": F.last(f"_in_{k}", True).over(strictly) for k in before}
    found |= {f"_a_{k}": F.first(f"_in_{k}", True).over(from_here) for k in ahead}
    found |= {f"_a_{k}": F.coalesce(F.sum(f"_in_{k}").over(up_to), F.lit(0)) for k in sums}
    found |= {f"_a_{k}": F.coalesce(F.sum(f"_in_{k}").over(Window.partitionBy(*part, f"_at_{k}").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) for k in since}
    results = [k for d in (lag, last, before, ahead, sums, since, whole) for k in d]
    if block is None:
        found |= {f"_a_{k}": c.over(Window.partitionBy(*by)) for k, c in whole.items()}
        return df.withColumns(found).select(*[n for n in names if n not in results], *[F.col(f"_a_{k}").alias(k) for k in results])

    inner = df.withColumns(found | {"_first": F.row_number().over(w) == 1}) if lag else df.withColumns(found)
    handed = [F.max_by(f"_in_{k}", order).alias(f"_h_{k}") for k in lag]
    handed += [F.max_by(f"_in_{k}", _known(F.col(f"_in_{k}"), order)).alias(f"_h_{k}") for k in (*last, *before)]
    handed += [F.min_by(f"_in_{k}", _known(F.col(f"_in_{k}"), order)).alias(f"_h_{k}") for k in ahead]
    handed += [F.sum(f"_in_{k}").alias(f"_h_{k}") for k in sums]
    blocks = df.groupBy(*part).agg(*handed, F.count(F.lit(1)).alias("_rows"))
    for k in since:  # the sum of the block's last segment, and how many resets the block has
        tails = df.groupBy(*part, f"_at_{k}").agg(F.sum(f"_in_{k}").alias("_s")).groupBy(*part).agg(F.max_by("_s", f"_at_{k}").alias(f"_h_{k}"), F.max(f"_at_{k}").alias(f"_r_{k}"))
        blocks = joined(blocks, tails, part)
    along = Window.partitionBy(*by).orderBy("_block")  # one row a block
    past, next_ = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    carry = {f"_c_{k}": F.lag(f"_h_{k}").over(along) for k in lag}
    carry |= {f"_c_{k}": F.last(f"_h_{k}", True).over(past) for k in (*last, *before)} | {f"_c_{k}": F.first(f"_h_{k}", True).over(next_) for k in ahead}
    carry |= {f"_c_{k}": F.coalesce(F.sum(f"_h_{k}").over(past), F.lit(0)) for k in sums}
    for k in since:
        blocks = blocks.withColumn(f"_g_{k}", F.sum((F.col(f"_r_{k}") > 0).cast("long")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
        blocks = blocks.withColumn(f"_t_{k}", F.sum(f"_h_{k}").over(Window.partitionBy(*by, f"_g_{k}").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)))
        carry |= {f"_c_{k}": F.coalesce(F.lag(f"_t_{k}").over(along), F.lit(0))}
    blocks = blocks.withColumns(carry) if carry else blocks
    if whole:
        blocks = joined(blocks, df.groupBy(*by).agg(*[c.alias(f"_c_{k}") for k, c in whole.items()]), by)
    got = joined(inner, blocks.select(*part, *[f"_c_{k}" for k in results]), part)
    a, c = (lambda k: F.col(f"_a_{k}")), (lambda k: F.col(f"_c_{k}"))
    end = {k: F.when(F.col("_first"), c(k)).otherwise(a(k)) for k in lag} | {k: F.coalesce(a(k), c(k)) for k in (*last, *before, *ahead)}
    end |= {k: a(k) + c(k) for k in sums} | {k: F.when(F.col(f"_at_{k}") > 0, a(k)).otherwise(a(k) + c(k)) for k in since} | {k: c(k) for k in whole}
    return got.select(*[n for n in names if n not in end and n != "_block"], *[v.alias(k) for k, v in end.items()])


def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which null keys meet."""
    right = right.select(*[F.col(k).alias(f"_k_{k}") if k in keys else F.col(k) for k in right.columns])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_k_{k}"]) for k in keys])
    return left.join(right, on).drop(*[f"_k_{k}" for k in keys])


def begun(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """The places in a batch sorted by the keys at which their values change, the first row's among them; nulls are equal."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for key in keys:
        c = batch.column(key)
        a, b = c.slice(1), c.slice(0, max(n - 1, 0))
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= other.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], f: Callable[[pa.RecordBatch, list[int]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``f`` makes of whole groups of rows sorted by the keys, given with the places at which they start and the end."""
    whole = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    left = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if left and len(begun(whole([left[-1].slice(left[-1].num_rows - 1), batch]), keys)) == 1:
            left.append(batch)  # the group goes on
            continue
        held = whole([*left, batch])
        starts = begun(held, keys).tolist()
        left = [held.slice(starts[-1])]
        if len(starts) > 1:
            yield f(held, starts)
    if left:
        held = whole(left)
        yield f(held, [0, held.num_rows])
