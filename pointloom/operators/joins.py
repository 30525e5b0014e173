"""Joins of points: by number, by neighbourhood in order or in the plane, by category, by segment."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from pointloom.operators.points import checkpointed, ordered
from pointloom.operators.scans import joined


def value_of_set(df: DataFrame, offset: int, *columns: str, by: str = "set_id") -> DataFrame:
    """The columns of the same-numbered point of the set ``offset`` further on, as other_<column>."""
    other = df.select((F.col(by) - offset).alias(by), "idx", *[F.col(c).alias(f"other_{c}") for c in columns])
    return df.join(other, [by, "idx"], "left")


def paired(df: DataFrame, pairs: DataFrame, *columns: str) -> DataFrame:
    """Point by point pairs of sets: set_a, set_b, idx and a_<column>, b_<column>, over the shorter of the two.

    ``pairs`` is the list of pairs (set_a, set_b); a discarded point on either side drops the pair.
    """
    if "discarded" in df.columns:
        df = df.where(~F.col("discarded"))
    side = lambda s: df.select(F.col("set_id").alias(f"set_{s}"), "idx", *[F.col(c).alias(f"{s}_{c}") for c in columns])
    return pairs.join(side("a"), "set_a").join(side("b"), ["set_b", "idx"]).select("set_a", "set_b", "idx", *[f"{s}_{c}" for s in "ab" for c in columns])


def bracket(queries: DataFrame, refs: DataFrame, value: str, payload: list[str] = [], by: list[str] = [], tolerance: float = 0.0, spread: bool | None = None) -> DataFrame:  # noqa: B006
    """For each query the nearest reference at or below its value and the nearest at or above it.

    Adds lower and upper (null beyond the ends), lower_<p> and upper_<p> for the payload, and closest: whichever is
    nearer (the lower of equals). Within ``tolerance`` of a reference both are that reference. Queries without a value
    are left out. Both tables are merged in order of the value, so nothing is compared pairwise.

    A group of ``by`` is one task's work unless ``spread`` (the default without ``by``): then ranges of the order by
    group and value are, and each range takes the references next to it over from the others' ends.
    """
    spread = not by if spread is None else spread
    given = F.struct(F.col(value).alias("_value"), *[F.col(p).alias(p) for p in payload])
    row = F.struct(*[F.col(c) for c in queries.columns])
    kind = queries.select(row.alias("q")).schema["q"].dataType
    a = queries.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), F.lit(1).alias("_side"), F.lit(None).cast(refs.select(given.alias("r")).schema["r"].dataType).alias("_r"), row.alias("_q"))
    b = refs.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), F.lit(0).alias("_side"), given.alias("_r"), F.lit(None).cast(kind).alias("_q"))
    both = a.unionByName(b)
    keys = list(by)
    if spread:
        # equal values are never parted, so a range's ends are all that others need of it
        both = checkpointed(both.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()))
        keys = [*by, "_part"]
    w = Window.partitionBy(*keys).orderBy("_v", "_side")
    # references come before queries of their value, so the last one so far is at or below; above, the first one after
    up = Window.partitionBy(*keys).orderBy(F.col("_v").desc(), "_side")
    found = both.withColumns({"_lo": F.last("_r", True).over(w), "_hi": F.last("_r", True).over(up)}).where("_side = 1")
    if spread:
        ends = both.groupBy(*keys).agg(F.min_by("_r", F.when(F.col("_r").isNotNull(), F.col("_v"))).alias("_first"), F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_v"))).alias("_last"))
        along = Window.partitionBy(*by or [F.lit(0)]).orderBy("_part")  # one row for each range
        before = F.last("_last", True).over(along.rowsBetween(Window.unboundedPreceding, -1))
        after = F.first("_first", True).over(along.rowsBetween(1, Window.unboundedFollowing))
        taken = ends.select(*keys, before.alias("_before"), after.alias("_after"))
        found = joined(found, taken, keys).withColumns({"_lo": F.coalesce("_lo", "_before"), "_hi": F.coalesce("_hi", "_after")})
    near_lo = F.col("_lo").isNotNull() & (F.col("_v") - F.col("_lo._value") <= tolerance)
    near_hi = F.col("_hi").isNotNull() & (F.col("_hi._value") - F.col("_v") <= tolerance)
    lo = F.when(near_hi & ~near_lo, F.col("_hi")).otherwise(F.col("_lo"))
    hi = F.when(near_lo, F.col("_lo")).otherwise(F.col("_hi"))
    out = found.select("_q", lo.alias("_lo"), hi.alias("_hi"), "_v")
    closest = F.when(F.col("_lo").isNull(), F.col("_hi._value")).when(F.col("_hi").isNull() | (F.col("_v") - F.col("_lo._value") <= F.col("_hi._value") - F.col("_v")), F.col("_lo._value")).otherwise(F.col("_hi._value"))
    extra = [F.col(f"_{s}.{p}").alias(f"{n}_{p}") for s, n in (("lo", "lower"), ("hi", "upper")) for p in payload]
    return out.select("_q.*", F.col("_lo._value").alias("lower"), F.col("_hi._value").alias("upper"), *extra, closest.alias("closest"))


#: Children per side of a grid's cell, and places that need no further division.
_FAN, _LEAF = 4, 1024
#: Queries of a cell beyond which it is split.
_HOT_ROWS = 200_000


def _nearest_in_cells(at_once: int = 1 << 22):
    """Over rows in the order of _cell, _part, _side and _rid: for each query (side 1) the square of the distance to the
    nearest place of its cell (side 0) and the least id at that distance. A cell's places are held, its queries pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, places = None, [], None
        for batch in batches:
            cell, part, side, x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_cell", "_part", "_side", "_x", "_y"))
            if not len(cell):
                continue
            new = np.ones(len(cell), bool)
            new[1:] = (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (side[1:] != side[:-1])
            first = np.flatnonzero(new)
            ids, least, found = [], [], []
            for a, b in zip(first.tolist(), np.append(first[1:], len(cell)).tolist()):
                if (cell[a], part[a]) != key:
                    key, held, places = (cell[a], part[a]), [], None
                if side[a] == 0:
                    held.append((x[a:b], y[a:b], batch.column("_rid").slice(a, b - a)))
                    continue
                if not held:
                    continue
                if places is None:
                    places = (*(np.concatenate([h[k] for h in held]) for k in (0, 1)), pa.concat_arrays([h[2] for h in held]))
                px, py, rid = places
                step = max(1, at_once // len(px))
                for k in range(a, b, step):
                    e = min(b, k + step)
                    d = (x[k:e, None] - px) ** 2 + (y[k:e, None] - py) ** 2
                    best = d.argmin(axis=1)  # the first one of equals has the least id
                    ids.append(batch.column("_id").slice(k, e - k))
                    least.append(d[np.arange(e - k), best])
                    found.append(rid.take(pa.array(best)))
            if ids:
                yield pa.record_batch([pa.concat_arrays(ids), pa.array(np.concatenate(least)), pa.concat_arrays(found)], names=["_id", "_d", "_rid"])

    return run


def nearest(queries: DataFrame, refs: DataFrame, by: list[str] = [], x: str = "x", y: str = "y", ref_id: list[str] = ["idx"], leaf: int = _LEAF, most_depth: int = 24, hot_rows: int = _HOT_ROWS) -> DataFrame:  # noqa: B006
    """The nearest reference in the plane for each query (all columns of ``queries``, ref_<id>..., distance).

    Groups of ``by`` are searched on their own. Each group's references are counted in nested grids, each cell of one
    holding four by four of the next; cells of more than ``leaf`` places are divided, down to a depth that the densest
    cell calls for. Queries go down level by level with the cells that can hold their nearest reference: those no
    farther than the farthest corner of some other's bounding box. So a query meets the places of a few cells,
    however dense or remote, and no level meets whole tables. At the end each place goes to the one undivided cell it
    lies in, and a task holds a cell's places while the cell's queries pass; cells of more than ``hot_rows`` queries
    are split by a hash of the query. Ties go to the smallest ids. Rows with a missing coordinate on either side take
    no part; queries of a group without references have no row.
    """
    if by and by != ["_by"]:  # a struct of the keys, so that null keys meet
        whole = F.struct(*by).alias("_by")
        return nearest(queries.select("*", whole), refs.select("*", whole), ["_by"], x, y, ref_id, leaf, most_depth, hot_rows).drop("_by")
    there = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    given = queries.where(there(x) & there(y)).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.struct(*[F.col(c) for c in queries.columns]).alias("_q"))
    left = checkpointed(given).withColumn("_id", F.monotonically_increasing_id())
    known = refs.where(there(x) & there(y))
    # a place that several references share is one, of the smallest ids
    ref = checkpointed(known.groupBy(*by, F.col(x).cast("double").alias("_rx"), F.col(y).cast("double").alias("_ry")).agg(F.min(F.struct(*[F.col(c).alias(c) for c in ref_id])).alias("_rid")))
    box = {"x0": F.min("_rx"), "x1": F.max("_rx"), "y0": F.min("_ry"), "y1": F.max("_ry"), "n": F.count("*")}
    groups = checkpointed(ref.groupBy(*by).agg(*[f.alias(c) for c, f in box.items()]).where("n > 0")).withColumn("_cell", -1 - F.monotonically_increasing_id())
    largest = groups.agg(F.max("n")).first()[0]
    if largest is None:
        ids = [F.lit(None).cast(refs.schema[c].dataType).alias(f"ref_{c}") for c in ref_id]
        return queries.limit(0).select("*", *ids, F.lit(None).cast("double").alias("distance"))
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    frame = groups.select(*by, "_cell", F.col("x0").alias("_x0"), F.col("y0").alias("_y0"), F.when(span > 0, span).otherwise(1.0).alias("_span"))
    beside = lambda df, table: df.join(table, by) if by else df.crossJoin(F.broadcast(table))  # noqa: E731  (one row without groups)
    framed = beside(ref, frame)
    depth = math.ceil(math.log(largest / leaf, _FAN * _FAN)) + 1 if largest > leaf else 0
    while True:
        n = float(_FAN**depth)
        at = lambda c, low: F.least(F.floor((F.col(c) - F.col(low)) / F.col("_span") * n), F.lit(n - 1)).cast("long")  # noqa: B023, E731
        placed = framed.select(*by, "_cell", "_rx", "_ry", "_rid", at("_rx", "_x0").alias("i"), at("_ry", "_y0").alias("j"))
        if not depth:  # the groups themselves, which all are small
            break
        level = placed.groupBy(*by, "i", "j").agg(*[f.alias(c) for c, f in box.items()])
        densest = level.agg(F.max("n")).first()[0]
        if densest <= 4 * leaf or depth >= most_depth:
            break
        depth = min(most_depth, depth + max(1, math.ceil(math.log(densest / leaf, _FAN * _FAN) / 2)))
    up = [f(c).alias(c) for c, f in (("x0", F.min), ("x1", F.max), ("y0", F.min), ("y1", F.max), ("n", F.sum))]
    levels = [level.withColumn("level", F.lit(depth))] if depth else []
    for k in range(depth - 1, 0, -1):
        level = level.groupBy(*by, F.shiftright("i", 2).alias("i"), F.shiftright("j", 2).alias("j")).agg(*up)
        levels.append(level.withColumn("level", F.lit(k)))
    tree = checkpointed(functools.reduce(DataFrame.unionByName, levels)).withColumn("_cell", F.monotonically_increasing_id()) if depth else None
    near = lambda low, c, high: F.greatest(F.col(low) - F.col(c), F.lit(0.0), F.col(c) - F.col(high))
    far = lambda low, c, high: F.greatest(F.abs(F.col(low) - F.col(c)), F.abs(F.col(c) - F.col(high)))
    square = lambda f: F.pow(f("x0", "_x", "x1"), 2) + F.pow(f("y0", "_y", "y1"), 2)
    zero = F.lit(0).cast("long")
    cells = beside(left.select(*by, "_id", "_x", "_y"), groups).withColumns({"level": F.lit(0), "i": zero, "j": zero})
    own = ["_cell", "level", "i", "j", "n", "x0", "x1", "y0", "y1"]
    for k in range(1, depth + 1):
        children = tree.where(F.col("level") == k).select(*by, F.shiftright("i", 2).alias("_pi"), F.shiftright("j", 2).alias("_pj"), F.struct(*own).alias("_c"))
        divided = (F.col("level") == k - 1) & (F.col("n") > leaf)
        # cells that stay get keys that meet nothing, spread by the query's number
        asked = cells.withColumns({"_pi": F.when(divided, F.col("i")).otherwise(-1 - F.pmod("_id", F.lit(1 << 20))), "_pj": F.when(divided, F.col("j")).otherwise(F.lit(-1)), "_c0": F.struct(*own)})
        met = asked.join(children, [*by, "_pi", "_pj"], "left").select(*by, "_id", "_x", "_y", F.coalesce("_c", "_c0").alias("_c")).select(*by, "_id", "_x", "_y", "_c.*")
        bound = F.min(square(far)).over(Window.partitionBy("_id"))
        cells = met.withColumn("_bound", bound).where(square(near) <= F.col("_bound")).drop("_bound")
        if k % 4 == 0:
            cells = checkpointed(cells)
    if depth:
        # the undivided cell of each of the deepest cells, and so of its places
        down = F.lit(2) * (F.lit(depth) - F.col("level"))
        above = lambda c: F.call_function("shiftright", F.col(c), down)
        deepest = tree.where(F.col("level") == depth).select(*by, F.col("i").alias("_di"), F.col("j").alias("_dj"), F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
        whole = tree.select(*by, "level", "i", "j", "n", "_cell").unionByName(groups.select(*by, F.lit(0).alias("level"), zero.alias("i"), zero.alias("j"), "n", "_cell"))
        whole = whole.where((F.col("n") <= leaf) | (F.col("level") == depth)).drop("n")
        of = deepest.withColumns({"i": above("_di"), "j": above("_dj")}).join(whole, [*by, "level", "i", "j"]).groupBy(*by, "_di", "_dj").agg(F.min_by("_cell", "level").alias("_cell"))
        placed = placed.drop("_cell").join(of.withColumnsRenamed({"_di": "i", "_dj": "j"}), [*by, "i", "j"])
        cells = checkpointed(cells.select("_cell", "_id", "_x", "_y"))
    counts = checkpointed(cells.groupBy("_cell").count().where(F.col("count") > hot_rows).select("_cell", F.ceil(F.col("count") / hot_rows).cast("int").alias("_parts")))
    few = counts.count() <= 100_000
    parts = lambda rows: rows.join(F.broadcast(counts) if few else counts, "_cell", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    kind = ref.schema["_rid"].dataType
    asked = parts(cells.select("_cell", "_id", "_x", "_y")).select("_cell", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int").alias("_part"), F.lit(1).alias("_side"), "_id", "_x", "_y", F.lit(None).cast(kind).alias("_rid"))
    held = parts(placed.select("_cell", "_rx", "_ry", "_rid")).select("_cell", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_id"), F.col("_rx").alias("_x"), F.col("_ry").alias("_y"), "_rid")
    rows = asked.unionByName(held).repartition("_cell", "_part").sortWithinPartitions("_cell", "_part", "_side", "_rid")
    met = rows.mapInArrow(_nearest_in_cells(), StructType([StructField("_id", LongType()), StructField("_d", DoubleType()), StructField("_rid", kind)]))
    # without levels a query has one cell
    best = met.select("_id", F.struct(F.col("_d").alias("d"), F.col("_rid").alias("id")).alias("_b"))
    best = best.groupBy("_id").agg(F.min("_b").alias("_b")) if depth else best
    ids = [F.col(f"_b.id.{c}").alias(f"ref_{c}") for c in ref_id]
    return left.join(best, "_id").select("_q.*", *ids, F.sqrt("_b.d").alias("distance"))


def nearest_or_beside(queries: DataFrame, refs: DataFrame, x: str = "x", y: str = "y", ref_id: str = "idx") -> DataFrame:
    """As :func:`nearest`, but a query that misses one coordinate is held against the other one only.

    Returns the queries' columns, ref_<id> and distance. Queries that miss both take no part.
    """
    parts = [nearest(queries, refs, x=x, y=y, ref_id=[ref_id])]
    for known, missing in ((x, y), (y, x)):
        asked = queries.where(F.col(known).isNotNull() & F.col(missing).isNull())
        lines = refs.where(F.col(known).isNotNull()).groupBy(known).agg(F.min(ref_id).alias(ref_id))
        b = bracket(asked, lines, known, [ref_id])
        low = F.col("upper").isNull() | (F.col("closest") == F.col("lower"))
        parts.append(b.select(*queries.columns, F.when(low, F.col(f"lower_{ref_id}")).otherwise(F.col(f"upper_{ref_id}")).alias(f"ref_{ref_id}"), F.abs(F.col(known) - F.col("closest")).alias("distance")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def category(df: DataFrame, value: str, categories: DataFrame, closest: bool = False) -> DataFrame:
    """The category of each value, exact (null if there is none) or closest (the lower of two as near; null for no
    value). ``categories`` has value and category, one row per category, of any number."""
    if not closest:
        return df.join(categories.select(F.col("value").alias("_cv"), "category"), F.col(value) == F.col("_cv"), "left").drop("_cv")
    # distinct values are looked up, not rows
    values = df.select(F.col(value).alias("_cv")).where("_cv IS NOT NULL").distinct()
    found = bracket(values, categories.select(F.col("value").alias("_cv"), F.col("category").alias("_category")), "_cv", ["_category"])
    low = F.col("upper").isNull() | (F.col("closest") == F.col("lower"))
    named = checkpointed(found.select("_cv", F.when(low, F.col("lower__category")).otherwise(F.col("upper__category")).alias("category")))
    few = named.count() <= 1_000_000
    return df.join(F.broadcast(named) if few else named, F.col(value) == F.col("_cv"), "left").drop("_cv")


def members(df: DataFrame, value: str, others: DataFrame, inside: bool = True) -> DataFrame:
    """Rows whose value occurs (or does not) among the values of another table's first column."""
    o = others.select(F.col(others.columns[0]).alias(value)).distinct()
    return df.join(o, value, "left_semi" if inside else "left_anti")


def segments(df: DataFrame, t: str, duration: float) -> DataFrame:
    """The number of the segment of fixed duration that each sample falls in, and marks at its first and last sample."""
    cut = df.withColumn("segment", F.floor(F.col(t) / duration))
    w = ordered()
    return cut.withColumns({"starts": ~F.col("segment").eqNullSafe(F.lag("segment").over(w)), "ends": ~F.col("segment").eqNullSafe(F.lead("segment").over(w))})


def in_segments(df: DataFrame, t: str, table: DataFrame, hot_rows: int = 200_000) -> DataFrame:
    """Samples with the segments (segment, start, end; end excluded) they fall in; segments of any length may overlap.

    A segment lies in one or two cells of the level whose cells are at least as long as it and at most twice that, and
    a sample asks the one cell of each level that it is in. Cells that more than ``hot_rows`` samples ask are split by
    a hash of the sample, their segments going to each part.
    """
    length = F.col("end").cast("double") - F.col("start")
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level")))
    placed = table.where(length > 0).withColumn("_level", F.ceil(F.log2(length)).cast("int"))
    placed = checkpointed(placed.withColumn("_cell", F.explode(F.array_distinct(F.array(cell("start"), cell("end"))))))
    levels = sorted(row[0] for row in placed.select("_level").distinct().collect())  # at most some two thousand powers of two
    if not levels:
        return df.join(table.limit(0), F.lit(False))
    asked = df.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels]))).where(F.col(t).isNotNull())
    asked = asked.withColumn("_cell", cell(t))
    counts = asked.groupBy("_level", "_cell").count().where(F.col("count") > hot_rows)
    hot = checkpointed(counts.join(placed.select("_level", "_cell").distinct(), ["_level", "_cell"]).select("_level", "_cell", F.ceil(F.col("count") / hot_rows).cast("int").alias("_parts")))
    few = hot.count() <= 100_000
    parts = lambda rows: rows.join(F.broadcast(hot) if few else hot, ["_level", "_cell"], "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    left = parts(asked).withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.col("_parts")).cast("int")).drop("_parts")
    right = parts(placed).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    met = left.join(right, ["_level", "_cell", "_part"])
    return met.where((F.col(t) >= F.col("start")) & (F.col(t) < F.col("end"))).drop("_level", "_cell", "_part")


def with_metadata(df: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    return df.join(sets.select("set_id", *columns), "set_id", "left")
