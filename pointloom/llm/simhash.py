"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits link when they differ in at most ``radius`` bits. Each bit position has a vector of
radius + 1 bits, and for every non-zero vector v there is a table whose key keeps the bits whose vector has odd
parity with v. The vectors of at most ``radius`` differing bits can't span the whole space, so some v is
orthogonal to all of them, and in that table the two keys are equal: no pair within the radius is missed.

Documents of one fingerprint are one node. In each bucket of a table only a spanning forest of the links leaves,
never all pairs; a bucket too large for one task is cut into chunks, and each pair of chunks is a task of its own.
The components of the forests' edges are found by alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import checkpointed, shuffle_partitions, spread_join

BITS = 64
SHINGLE_WORDS = 4
RADIUS = 4
#: Most fingerprints of a bucket that are compared in one go.
CHUNK = 4096
#: Edges of a task in the star steps, and their tasks at least.
TASK_EDGES, LEAST_TASKS = 50_000, 12


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles, repeats included; 0 without words."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # only A-Z are lowered, only ASCII space splits
    if not parts:
        return 0
    whole = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(whole, 42)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    first = [0, *(ends[: len(parts) - words] + 1).tolist()]
    hashes = np.array([digest(whole[a:b], 42) for a, b in zip(first, ends[words - 1 :].tolist())], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; a null text counts as empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fps = np.array([fingerprint(t, words) for t in frame["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"row": frame["row"], "fp": fps})

    rows = docs.select(F.struct("doc_id").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"row {rows.schema['row'].dataType.simpleString()}, fp long").select("row.doc_id", "fp")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The bit masks of the tables, 2^(radius + 1) - 1 of them."""
    space = 1 << (radius + 1)
    vectors = [i % (space - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, space)]


def _apart(x: np.ndarray) -> np.ndarray:
    """Bits set in signed 64-bit values (NumPy counts those of the absolute value)."""
    return np.bitwise_count(x.view(np.uint64))


def forest(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links among distinct fingerprints, breadth first."""
    left, edges = fps, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _apart(left ^ x) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found)
                edges.append((np.full(len(found), x), found))
    return edges


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


_SCHEMA = "t int, key long, chunk int, a long, b long"


def _table(t, key, chunk, a, b) -> pd.DataFrame:
    return pd.DataFrame({"t": np.asarray(t, np.int32), "key": np.asarray(key, np.int64), "chunk": np.asarray(chunk, np.int32), "a": a, "b": b})


def _bucket_edges(radius: int, chunk_rows: int):
    """Over rows (t, key, fp) sorted by all three: edges with chunk -1; of large buckets the rows, by chunk."""

    def edges_of(fps: np.ndarray) -> pd.DataFrame | None:
        found = forest(fps, radius)
        if not found:
            return None
        a, b = (np.concatenate([e[k] for e in found]) for k in (0, 1))
        return _table(np.zeros(len(a)), np.zeros(len(a)), np.full(len(a), -1), a, b)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.empty((0, 3), np.int64)
        chunk = 0  # chunks of the held bucket that have left

        def leave(rows: np.ndarray) -> pd.DataFrame:
            n = len(rows)
            return _table(rows[:, 0], rows[:, 1], np.full(n, chunk), rows[:, 2], rows[:, 2])

        for frame in frames:
            rows = np.concatenate([held, frame[["t", "key", "fp"]].to_numpy(np.int64)])
            if not len(rows):
                continue
            new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(rows)))
            done = np.arange(len(first)) < len(first) - 1
            pair = first[done & (size == 2)]
            if chunk and len(pair) and pair[0] == 0:
                pair = pair[1:]
            a, b = rows[pair, 2], rows[pair + 1, 2]
            near = _apart(a ^ b) <= radius
            if near.any():
                n = int(near.sum())
                yield _table(np.zeros(n), np.zeros(n), np.full(n, -1), a[near], b[near])
            for k in np.flatnonzero(done & ((size > 2) | ((np.arange(len(size)) == 0) & (chunk > 0)))):
                own = rows[first[k] : first[k] + size[k]]
                if k == 0 and chunk:
                    yield leave(own)
                elif size[k] <= chunk_rows:
                    out = edges_of(own[:, 2])
                    if out is not None:
                        yield out
                else:
                    for at in range(0, size[k], chunk_rows):
                        part = leave(own[at : at + chunk_rows])
                        part["chunk"] = np.int32(at // chunk_rows)
                        yield part
            held = rows[first[-1] :]
            if len(first) > 1:
                chunk = 0
            while len(held) > chunk_rows:
                yield leave(held[:chunk_rows])
                held, chunk = held[chunk_rows:], chunk + 1
        if chunk and len(held):
            yield leave(held)
        elif len(held) > 1:
            out = edges_of(held[:, 2])
            if out is not None:
                yield out

    return run


def links(nodes: DataFrame, radius: int = RADIUS, chunk_rows: int = CHUNK) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints of the column fp just as all links do."""
    spark = nodes.sparkSession
    parts = shuffle_partitions(spark)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(covering_masks(radius))])
    rows = nodes.select("fp", F.explode(tables).alias("x")).select("x.t", "x.key", "fp")
    dealt = rows.repartition(parts, "t", "key").sortWithinPartitions("t", "key", "fp")
    found = checkpointed(dealt.mapInPandas(_bucket_edges(radius, chunk_rows), _SCHEMA))
    edges = found.where("chunk < 0").select("a", "b")
    large = found.where("chunk >= 0").select("t", "key", "chunk", F.col("a").alias("fp"))
    if large.limit(1).count():
        n = large.groupBy("t", "key").agg((F.max("chunk") + 1).alias("n"))
        other = large.join(n, ["t", "key"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        pairs = other.select("t", "key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "fp")

        def between(frame: pd.DataFrame) -> pd.DataFrame:
            got = forest(frame["fp"].to_numpy(np.int64), radius)
            return pd.DataFrame({k: np.concatenate([e[i] for e in got]) if got else np.empty(0, np.int64) for i, k in enumerate("ab")})

        edges = edges.unionByName(pairs.groupBy("t", "key", "i", "j").applyInPandas(between, "a long, b long"))
    return edges.distinct()


def _forests():
    """Of each partition's edges (a, b): every node with the least one that it reaches there, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            up: dict = {}

            def top(x):
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                up.setdefault(a, a)
                up.setdefault(b, b)
                a, b = top(a), top(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            found = [(x, top(x)) for x in up]
            found = [(x, y) for x, y in found if x != y]
            kinds = [batch.schema.field(c).type for c in "ab"]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kinds[k]) for k in (0, 1)], ["u", "v"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """For every node of the edges (a, b): node and root, the smallest node reachable.

    Batches of edges are first replaced by forests of their own, so that what the rounds have to join is little. Rounds
    go on until all nodes point to roots, which takes at most the square of the logarithm of the number of nodes.
    """
    kind = edges.schema["a"].dataType.simpleString()
    own = edges.where("a != b").select("a", "b").mapInArrow(_forests(), f"u {kind}, v {kind}")
    parts = shuffle_partitions(edges.sparkSession)
    e = checkpointed(own.distinct())
    n = e.count()
    while True:
        # as many tasks as the edges left call for, not as many as a table of documents does
        tasks = min(parts, max(LEAST_TASKS, -(-n // TASK_EDGES)))
        few = lambda df: df.coalesce(tasks)  # noqa: B023, E731
        e = few(e)
        # all are stars where no node points to two others, or to one that points on
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("out")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("out")))
        open_ = few(ends.groupBy("x").agg(F.sum("out").alias("out"), F.min("out").alias("least"))).where("out > 1 OR out = 1 AND least = 0")
        if not open_.limit(1).count():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a component's links gather at its hub, whose rows are dealt out
        least = few(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w"))).select("u", F.least("u", "m").alias("m"), "w")
        large = few(few(spread_join(both, least, "u", ["m"], "w", 2 * n)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        root = few(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w")))
        small = few(spread_join(large, root, "u", ["m"], "w", 2 * n)).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(few(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct()))
        n = e.count()


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS, chunk_rows: int = CHUNK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links.

    A row without an id is a node like others, but null is nobody's component_id unless all ids reachable are
    null. Texts without words, null among them, have fingerprint 0. Repeated rows share their result; an empty table
    gives an empty result. Other columns of ``docs`` are not read.
    """
    fps = checkpointed(fingerprints(docs, words))
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    roots = components(links(nodes.select("fp"), radius, chunk_rows))
    placed = checkpointed(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root")))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("nodes"))
    n_nodes, n = placed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    named = spread_join(placed, lowest, "root", ["component_id"], "nodes", n_nodes).select("fp", "n", "component_id")
    return spread_join(fps, named, "fp", ["component_id"], "n", n).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One document of each group of near-duplicates, the one of smallest id, with the columns of ``docs``.

    Rows that share an id share their fate; rows without an id stay only if no row of their group has one.
    """
    found = near_duplicates(docs, words, radius).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = found.select(F.col("doc_id").alias("_id")).distinct().alias("c")
    return docs.alias("d").join(chosen, F.expr("d.doc_id <=> c._id"), "left_semi")
