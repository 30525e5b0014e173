"""Exact top-k search by inner product with block-at-a-time pruning.

The vectors, in order of their ids, are cut into ranges (blocks). A block has the largest and smallest value of each
term (component) and a forward index (the rows of its vectors). For a query, the summed term maxima (the maximum
where the query's term is positive, the minimum where it is negative) bound every score in the block. Blocks are
taken in descending order of their bounds and scored through their forward indexes until the next bound is below
the k-th best score so far; a block whose bound equals it may still hold a smaller id.

Nothing is sent to meet before it is pruned. First only the term maxima of blocks meet the stated queries, on a grid of
(group of blocks' maxima, group of queries), and each query names the few blocks of the highest bounds. Those are
scored; the k-th score of a query so far is its floor. Then maxima and queries meet once more, and of each cell (group
of blocks, group of queries) only the blocks and queries of which some pair's bound reaches the floor are sent; the
cell takes each query's blocks in order of their bounds, from its floor on. No task holds more than one group of each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import checkpointed

SCALE = 256
BLOCK_ROWS = 256
#: Vectors and queries that meet in one cell of the grid, about.
CELL_VECTORS = 8192
CELL_QUERIES = 2048
#: Blocks whose term maxima meet a group of queries at once, about.
MAXIMA_BLOCKS = 4096
#: Blocks that give a query its floor; more where they hold k rows or fewer.
FLOOR_BLOCKS = 4
#: The floor of queries that have found fewer than k rows.
NO_FLOOR = -(1 << 63)
_PACKED = "part long, block long, n long, ids binary, rows binary, dim int, high binary, low binary"


def usable(embedding: Column) -> Column:
    """True for a vector that is not null and holds only finite components."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & F.coalesce(fine, F.lit(False))


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and q, the components as floor(scale * x); unusable vectors and those without an id are left out."""
    e = F.col(embedding).cast("array<double>")
    return vectors.where(F.col(vec_id).isNotNull() & usable(e)).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x)).alias("q"))


def _pack(block_rows: int, cell_blocks: int):
    """The sorted rows of a partition as blocks; ``cell_blocks`` blocks that follow each other share a part."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, at = TaskContext.get().partitionId() << 32, 0
        for frame in frames:
            ids, vectors, out = frame["vec_id"].to_numpy(np.int64), list(frame["q"]), []
            for k in range(0, len(ids), block_rows):
                own, part = ids[k : k + block_rows], first + at // cell_blocks
                rows = vectors[k : k + block_rows]
                matrix = np.zeros((len(rows), max(map(len, rows))), "<i8")
                for i, r in enumerate(rows):
                    matrix[i, : len(r)] = r
                out.append((part, first + at, len(rows), own.astype("<i8").tobytes(), matrix.tobytes(), matrix.shape[1], matrix.max(axis=0).tobytes(), matrix.min(axis=0).tobytes()))
                at += 1
            yield pd.DataFrame(out, columns=["part", "block", "n", "ids", "rows", "dim", "high", "low"])

    return run


def _padded(rows: list, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _numbers(packed: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(b, "<i8") for b in packed]


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Summed term maxima, queries by blocks: no score of a block is above its bound.

    Sums that doubles may round are raised by more than the rounding.
    """
    q, high, low = (m.astype(np.float64) for m in (queries, high, low))
    size = np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T + np.where(size < 2.0**53, 0, size * (q.shape[1] + 1) * 2.0**-50)


def block_at_a_time(blocks: list[tuple[np.ndarray, np.ndarray]], query: np.ndarray, own: int, k: int, bound: np.ndarray, floor: int = NO_FLOOR) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the k best rows of the blocks that reach the floor, and the number of blocks that were scored."""
    ids, scores, scored = np.empty(0, np.int64), np.empty(0, query.dtype), 0
    for b in np.argsort(-bound, kind="stable"):
        if bound[b] < floor:
            break
        scored += 1
        block_ids, matrix = blocks[b]
        s = matrix @ query
        take = (block_ids != own) & (s >= floor)
        if take.any():
            ids, scores = np.concatenate([ids, block_ids[take]]), np.concatenate([scores, s[take]])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(ids) == k:
                floor = max(floor, int(scores[-1]))
    return ids, scores, scored


def _bounded(maxima: pd.DataFrame, asked: pd.DataFrame, rows: int = 256) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """A few queries at a time with their bounds for all blocks of the group."""
    high, low, queries = _numbers(maxima["high"]), _numbers(maxima["low"]), list(asked["q"])
    dim = max(map(len, [*high, *queries]), default=0)
    high, low = _padded(high, dim), _padded(low, dim)
    for at in range(0, len(queries), rows):
        yield asked.iloc[at : at + rows], bounds(_padded(queries[at : at + rows], dim), high, low)


def _best_blocks(k: int, floor_blocks: int):
    """Each query's blocks of the highest bounds in a group: ``floor_blocks`` of them, and on until they hold over k rows."""

    def run(maxima: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        maxima, out = maxima.sort_values("block", ignore_index=True), []
        parts, blocks, n = (maxima[c].to_numpy(np.int64) for c in ("part", "block", "n"))
        for some, bound in _bounded(maxima, asked) if len(maxima) else ():
            for j, own, b in zip(some["j"], some["query_id"], bound):
                order = np.argsort(-b, kind="stable")
                before = np.cumsum(n[order]) - n[order]
                order = order[(np.arange(len(order)) < floor_blocks) | (before <= k)]
                out += zip(parts[order].tolist(), [j] * len(order), [own] * len(order), blocks[order].tolist(), n[order].tolist(), b[order].tolist())
        return pd.DataFrame(out, columns=["i", "j", "query_id", "block", "n", "bound"])

    return run


def _wanted(maxima: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """For each part and group of queries: the blocks and the queries that have a pair whose bound reaches its floor."""
    out = []
    maxima = maxima.sort_values("block", ignore_index=True)
    parts, blocks = maxima["part"].to_numpy(np.int64), maxima["block"].to_numpy(np.int64)
    for some, bound in _bounded(maxima, asked) if len(maxima) else ():
        reached = bound >= some["floor"].to_numpy(np.int64)[:, None]
        for row, known in zip(reached, some["known"]):
            row[np.isin(blocks, known)] = False
        ids = some["query_id"].to_numpy(np.int64)
        for part in np.unique(parts[reached.any(axis=0)]):
            cell = reached[:, parts == part]
            out.append((part, some["j"].iloc[0], blocks[parts == part][cell.any(axis=0)], ids[cell.any(axis=1)]))
    return pd.DataFrame(out, columns=["i", "j", "blocks", "queries"])


def _scored(k: int, known: bool):
    """The best of a cell: of the blocks that are known to a query, or of the others."""

    def run(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(vectors) and len(asked):
            queries = list(asked["q"])
            dim = max([int(vectors["dim"].max()), *map(len, queries)])
            matrices = [_padded(np.frombuffer(r, "<i8").reshape(n, own), dim) for r, n, own in zip(vectors["rows"], vectors["n"], vectors["dim"])]
            matrix = _padded(queries, dim)
            # sums below 2^53 are exact in doubles, which multiply faster; else whole numbers of 64 bits
            largest = [max(float(np.abs(m.astype(np.float64)).max(initial=0)) for m in side) for side in (matrices, [matrix])]
            kind = np.float64 if dim * largest[0] * largest[1] < 2.0**53 else np.int64
            blocks = list(zip(_numbers(vectors["ids"]), (m.astype(kind) for m in matrices)))
            bound = bounds(matrix, np.stack([m.max(axis=0) for m in matrices]), np.stack([m.min(axis=0) for m in matrices]))
            names = vectors["block"].to_numpy(np.int64)
            for own, query, b, mine, floor in zip(asked["query_id"], matrix.astype(kind), bound, asked["known"], asked["floor"]):
                meant = np.flatnonzero(np.isin(names, mine) == known)
                found, scores, _ = block_at_a_time([blocks[i] for i in meant], query, own, k, b[meant], int(floor))
                out += zip([int(own)] * len(found), found.tolist(), map(int, scores))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, cell_vectors: int = CELL_VECTORS, cell_queries: int = CELL_QUERIES, maxima_blocks: int = MAXIMA_BLOCKS, floor_blocks: int = FLOOR_BLOCKS) -> DataFrame:
    """The k vectors of highest integer inner product for each query, its own row not counted.

    ``vectors`` and ``queries`` have vec_id and q (see :func:`quantised`). Columns: query_id, rank (from 1), vec_id,
    score; ties go to the smaller vec_id, fewer than k rows come back if there are fewer. Shorter vectors count as
    filled up with zeros. Rows that repeat a vec_id are candidates each by itself, never for a query of their id;
    of queries that repeat an id the least vector is asked. Scores must fit a signed 64-bit number.
    :func:`quantised` leaves out null vectors and those that hold null or non-finite parts, so these are neither asked
    nor found. An empty table of vectors or of queries gives an empty result; other columns are not read.
    """
    one = queries.groupBy("vec_id").agg(F.min("q").alias("q"))
    n, m = vectors.count(), one.count()
    rows, columns, groups = (max(1, math.ceil(a / b)) for a, b in ((n, cell_vectors), (m, cell_queries), (n, block_rows * maxima_blocks)))
    # rows that repeat an id are parted too
    dealt = vectors.repartitionByRange(rows, "vec_id", F.xxhash64("q")).sortWithinPartitions("vec_id")
    blocks = checkpointed(dealt.mapInPandas(_pack(block_rows, max(1, cell_vectors // block_rows)), _PACKED))
    group = F.pmod(F.spark_partition_id(), F.lit(columns)).cast("long").alias("j")
    asked = checkpointed(one.repartitionByRange(columns, "vec_id").select(group, F.col("vec_id").alias("query_id"), "q"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    maxima = blocks.select(F.pmod(F.xxhash64("part"), F.lit(groups)).alias("g"), every(columns).alias("j"), "part", "block", "n", "high", "low")

    def bounded(asked: DataFrame, run, schema: str) -> DataFrame:
        # the stated queries against the maxima of all blocks, in groups
        return maxima.groupBy("g", "j").cogroup(asked.withColumn("g", every(groups)).groupBy("g", "j")).applyInPandas(run, schema)

    def scored(cells: DataFrame, pairs: DataFrame, asked: DataFrame, known: bool) -> DataFrame:
        left = cells.join(blocks.drop("part", "high", "low"), "block")
        # new names of its own, for both sides come from the same rows
        right = pairs.select(*[F.col(c).alias(c) for c in pairs.columns]).join(asked.drop("j"), "query_id")
        return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(_scored(k, known), "query_id long, vec_id long, score long")

    first = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")
    named = bounded(asked, _best_blocks(k, floor_blocks), "i long, j long, query_id long, block long, n long, bound double")
    before = F.coalesce(F.sum("n").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seeds = checkpointed(named.withColumn("_at", F.row_number().over(first)).withColumn("_before", before).where((F.col("_at") <= floor_blocks) | (F.col("_before") <= k)).select("i", "j", "query_id", "block"))
    asked = asked.join(seeds.groupBy("query_id").agg(F.collect_list("block").alias("known")), "query_id").withColumn("floor", F.lit(NO_FLOOR))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    top = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    held = checkpointed(top(scored(seeds.select("i", "j", "block").distinct(), seeds.select("i", "j", "query_id").distinct(), asked, True)))
    floors = held.where(F.col("rank") == k).select("query_id", F.col("score").alias("_kth"))
    asked = checkpointed(asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("_kth", "floor")).drop("_kth"))
    wanted = checkpointed(bounded(asked, _wanted, "i long, j long, blocks array<long>, queries array<long>"))
    more = scored(wanted.select("i", "j", F.explode("blocks").alias("block")).distinct(), wanted.select("i", "j", F.explode("queries").alias("query_id")), asked, False)
    return top(held.drop("rank").unionByName(more))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
