"""MinHash near-duplicates by SuperMinHash signatures, banding, verification on whole sets and union-find.

SuperMinHash gives each element a random permutation of the signature's places and, at step j, the value j plus a
random fraction for the j-th of them; a place keeps its least value. The values of one element are correlated, which
lowers the variance of the share of equal places, and no step after j can lower a place whose value is below j + 1,
so a document stops as soon as all its places are that low. Here a step is taken for all elements of many documents
at once.

Documents of one shingle set are one node. Nodes that share a band of their signatures are candidates: each band's
nodes are tied to the least of them, and the components of those ties are clusters. All links between different nodes
lie within clusters (but for pairs that share none of the bands, one in 10^10 of those at the threshold). In a cluster
links are confirmed on the whole sets. A task of one cluster is bounded: larger clusters are cut into chunks that first
meet a few pivots of their cluster; what that leaves in more than one component is compared chunk by chunk, without
pairs of one component. Only edges that connect components leave a task, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import checkpointed, shuffle_files_dropped, shuffle_partitions, spread_join
from pointloom.llm.simhash import components

WORDS = 5
PERCENT = 85
#: Bands of the signature and places in a band: a pair of similarity 0.85 shares no band once in 10^10.
BANDS, ROWS = 32, 4
#: Elements that take their steps together; places of a matrix of so many permutations take 16 MB.
STEP_ELEMENTS = 1 << 17
#: A chunk of a cluster has about so many shingles and nodes at most; pivots of a cluster that every chunk meets.
CHUNK_SHINGLES, CHUNK_NODES, PIVOTS = 2_000_000, 1024, 16

_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW32 = np.uint64(0xFFFFFFFF)


def _golden(k: int) -> np.uint64:
    return np.uint64(k * int(_GOLD) & 0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; the whole sequence if it has fewer words."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # only A-Z are lowered, only ASCII space splits
    if not parts:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    each = np.array([digest(p) for p in parts], np.uint64)
    length = min(words, len(parts))
    h = each[: len(each) - length + 1] + _golden(length)
    for k in range(1, length):
        h = _mixed(h) + each[k : len(each) - length + 1 + k]
    h = np.sort(_mixed(h))
    return h[np.r_[True, h[1:] != h[:-1]]]


def signatures(sets: list[np.ndarray], places: int = BANDS * ROWS) -> np.ndarray:
    """A SuperMinHash signature for each set: step in the upper half of a value, fraction in the lower."""
    out = np.full((len(sets), places), np.iinfo(np.uint64).max, np.uint64)
    held, n = [], 0
    for k, s in enumerate(sets):
        for at in range(0, len(s), STEP_ELEMENTS):
            part = s[at : at + STEP_ELEMENTS]
            if n + len(part) > STEP_ELEMENTS:
                _steps(out, held)
                held, n = [], 0
            held.append((k, part))
            n += len(part)
    _steps(out, held)
    return out


def _steps(out: np.ndarray, held: list[tuple[int, np.ndarray]]) -> None:
    if not held:
        return
    places = out.shape[1]
    flat = out.reshape(-1)
    x = np.concatenate([part for _, part in held])
    own = np.repeat(np.array([k for k, _ in held]), [len(part) for _, part in held])
    order = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.int32), (len(x), 1))
    for j in range(places):
        z = _mixed(x + _golden(j + 1))
        swap = j + ((z & _LOW32) * np.uint64(places - j) >> np.uint64(32)).astype(np.int64)
        row = np.arange(len(x))
        place = order[row, swap]
        order[row, swap] = order[:, j]
        np.minimum.at(flat, own * places + place, (np.uint64(j) << np.uint64(32)) | (z >> np.uint64(32)))
        mine = np.unique(own)
        still = mine[out[mine].max(axis=1) >= np.uint64(j + 1) << np.uint64(32)]
        if not len(still):
            return
        if len(still) < len(mine):
            left = np.isin(own, still)
            x, own, order = x[left], own[left], order[left]


def band_keys(signed: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A signed 64-bit key for each band of each signature."""
    cut = signed.reshape(len(signed), bands, signed.shape[1] // bands)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, (len(signed), 1))
    for k in range(cut.shape[2]):
        key = _mixed(key ^ cut[:, :, k]) + _GOLD
    return key.view(np.int64)


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def signed_documents(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, node (digest of the set, null if empty) and keys (of the first row of a node in its batch)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes, nodes, new, first = [], [], {}, []
            for k, text in enumerate(frame["text"]):
                s = shingle_set(text, words)
                node = _digest(s) if len(s) else None
                sizes.append(len(s))
                nodes.append(node)
                if node is not None and node not in new:
                    new[node] = s
                    first.append(k)
            keys = [None] * len(nodes)
            for k, own in zip(first, band_keys(signatures(list(new.values())))):
                keys[k] = own
            yield pd.DataFrame({"row": frame["row"], "n_shingles": np.array(sizes, np.int64), "node": nodes, "keys": keys})

    rows = docs.select(F.struct("doc_id").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInPandas(run, f"row {kind}, n_shingles long, node binary, keys array<long>").select("row.doc_id", "n_shingles", "node", "keys")


def clusters(signed: DataFrame) -> DataFrame:
    """node and root for all nodes that share a band with another one: the components of those ties."""
    rows = signed.where("keys IS NOT NULL").select("node", F.explode("keys").alias("key"))
    tied = rows.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").alias("n")).where("hub != last")
    tied = checkpointed(tied.select("key", "hub", "n"))
    n = signed.where("keys IS NOT NULL").count() * BANDS
    ties = spread_join(rows, tied, "key", ["hub"], "n", n).where("hub != node").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    # a node's ties together, so that a batch ties their hubs
    return components(ties.repartition("a").sortWithinPartitions("a"))


def connecting(sets: list[np.ndarray], sketch: np.ndarray, percent: int, label: np.ndarray, first: int | None = None) -> list[tuple[int, int]]:
    """Edges that connect the labels of sets as their links do: 100 * intersection >= percent * union.

    With ``first`` the sets before that place are compared with those from there on, else all with all. Pairs whose
    label is the same by then are not compared, nor those whose sketches tell that they can't link (a link at the
    threshold would have so few equal places once in 10^9).
    """
    sizes = np.array([len(s) for s in sets])
    p = percent / 100
    least = sketch.shape[1] * p - 6 * np.sqrt(sketch.shape[1] * p * (1 - p))
    label, edges = label.copy(), []
    for i in range(len(sets) if first is None else first):
        at = i + 1 if first is None else first
        low, high = np.minimum(sizes[at:], sizes[i]), np.maximum(sizes[at:], sizes[i])
        other = at + np.flatnonzero((label[at:] != label[i]) & (100 * low >= percent * high))
        if len(other):
            other = other[(sketch[other] == sketch[i]).sum(axis=1) >= least]
        if not len(other):
            continue
        flat = np.concatenate([sets[k] for k in other])
        place = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
        both = np.add.reduceat((sets[i][place] == flat).astype(np.int64), np.r_[0, np.cumsum(sizes[other])[:-1]])
        other = other[100 * both >= percent * (sizes[i] + sizes[other] - both)]
        new, at = np.unique(label[other], return_index=True)
        edges += [(i, int(k)) for k in other[at]]
        label[np.isin(label, new)] = label[i]
    return edges


def _edges_of(key: list[str], percent: int, between: bool = False):
    """Over rows sorted by their key: each group's nodes with the least of their component (others than itself).

    The components are those of the group's links, by union-find; the caller has bounded the groups.
    """

    def edges(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        rows = list({row[0]: row for row in rows}.values())  # repeated documents, and pivots in their own chunk
        first = None
        if between:
            rows.sort(key=lambda row: row[4])
            first = sum(row[4] == 0 for row in rows)
            first = None if first == len(rows) else first
        if len(rows) < 2:
            return []
        sketch = np.frombuffer(b"".join(row[2] for row in rows), np.uint8).reshape(len(rows), -1)
        label = pd.factorize(np.array([row[3] for row in rows], object))[0] if between else np.arange(len(rows))
        up = list(range(len(rows)))

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = i = up[up[i]]
            return i

        for i, k in connecting([np.frombuffer(row[1], np.uint64) for row in rows], sketch, percent, label, first):
            up[top(k)] = top(i)
        least: dict[int, bytes] = {}
        for i, row in enumerate(rows):
            least[top(i)] = min(least.get(top(i), row[0]), row[0])
        return [(row[0], least[top(i)]) for i, row in enumerate(rows) if row[0] != least[top(i)]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last = [], None
        for frame in frames:
            out = []
            columns = ["node", "shingles", "sketch"] + ["label", "side"] * between
            for own, row in zip(zip(*[frame[k] for k in key]), zip(*[frame[c] for c in columns])):
                if own != last:
                    out += [(last[0], *e) for e in edges(held)]
                    held, last = [], own
                held.append(row)
            yield pd.DataFrame(out, columns=[key[0], "a", "b"])
        yield pd.DataFrame([(last[0], *e) for e in edges(held)], columns=[key[0], "a", "b"])

    return run


def _whole_sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """members (root, chunk, chunks, node, low) with shingles and sketch, from the text of the row low."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [shingle_set(t, words) for t in frame.pop("text")]
            right = np.array([_digest(s) == n for s, n in zip(sets, frame["node"])], bool)  # an id may have several texts
            sets = [s for s, ok in zip(sets, right) if ok]
            frame = frame[right].reset_index(drop=True)
            frame["shingles"] = [s.tobytes() for s in sets]
            frame["sketch"] = [row.tobytes() for row in (signatures(sets) & np.uint64(255)).astype(np.uint8)]
            yield frame

    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = members.join(texts, F.expr("low <=> _id")).select("root", "chunk", "chunks", "node", "text")
    return rows.mapInPandas(run, "root binary, chunk int, chunks int, node binary, shingles binary, sketch binary")


def linked_nodes(docs: DataFrame, nodes: DataFrame, roots: DataFrame, words: int, percent: int, chunk_shingles: int, chunk_nodes: int) -> DataFrame:
    """node and root, the least node that it reaches over links, for the nodes of clusters that reach another one.

    ``nodes`` has node, low (an id whose text it is) and size, ``roots`` the clusters.
    """
    parts = shuffle_partitions(docs.sparkSession)
    members = checkpointed(roots.join(nodes, "node").select("root", "node", "low", "size"))
    need = F.greatest(F.ceil(F.sum("size") / chunk_shingles), F.ceil(F.count("*") / chunk_nodes)).cast("int")
    totals = members.groupBy("root").agg(need.alias("chunks"), F.count("*").alias("n"))
    n = members.count()
    placed = spread_join(members, totals, "root", ["chunks", "n"], "n", n).select(
        "root", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk"), "chunks", "node", "low", "n"
    )
    sets = checkpointed(_whole_sets(docs, placed, words))
    pivot = (F.col("chunks") > 1) & (F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(1 << 30)) < F.lit(PIVOTS << 30) / (F.col("chunks") * chunk_nodes))
    where = F.when(pivot, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    met = sets.select("root", F.explode(where).alias("chunk"), "node", "shingles", "sketch", (F.col("chunks") > 1).alias("large"))
    dealt = met.repartition(parts, "large", "root", "chunk").sortWithinPartitions("large", "root", "chunk")
    found = checkpointed(dealt.mapInPandas(_edges_of(["large", "root", "chunk"], percent), "large boolean, a binary, b binary"))
    small = found.where("NOT large").select(F.col("a").alias("node"), F.col("b").alias("root"))
    large = sets.where("chunks > 1").select("root", "node")
    if not large.limit(1).count():
        return small
    edges = found.where("large").select("a", "b")
    # what is left of large clusters: pairs of different components, of which one is not the largest
    reached = components(edges).withColumnRenamed("root", "label")
    labelled = checkpointed(large.join(reached, "node", "left").select("root", "node", F.coalesce("label", "node").alias("label")))
    sizes = labelled.groupBy("root", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.sum("n").alias("all"), F.max("n").alias("n_most"), F.count("*").alias("labels"))
    left = largest.where("labels > 1").select(
        "root", "most", F.ceil((F.col("all") - F.col("n_most")) / chunk_nodes).cast("int").alias("few"), F.ceil(F.col("n_most") / chunk_nodes).cast("int").alias("many"), F.col("all").alias("n")
    )
    open_ = spread_join(labelled, left, "root", ["most", "few", "many", "n"], "n", n).where("most IS NOT NULL")
    mine = F.pmod(F.xxhash64(F.lit(5), "node"), F.when(F.col("label") == F.col("most"), F.col("many")).otherwise(F.col("few"))).cast("int")
    numbered = open_.withColumn("mine", F.when(F.col("label") == F.col("most"), F.col("few") + mine).otherwise(mine))
    # chunk i of the few meets every chunk j >= i, those of the largest component included; these don't meet each other
    met = F.when(F.col("mine") >= F.col("few"), F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda i: F.struct(i.alias("i"), F.col("mine").alias("j"), F.lit(1).alias("side"))))
    met = met.otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("mine")), lambda i: F.struct(i.alias("i"), F.col("mine").alias("j"), (i < F.col("mine")).cast("int").alias("side"))),
            F.transform(F.expr("slice(sequence(mine, few + many), 2, few + many - mine - 1)"), lambda j: F.struct(F.col("mine").alias("i"), j.alias("j"), F.lit(0).alias("side"))),
        )
    )
    pairs = numbered.join(sets.select("node", "shingles", "sketch"), "node").select("root", "node", "label", "shingles", "sketch", F.explode(met).alias("p"))
    pairs = pairs.select("root", "p.i", "p.j", "p.side", "node", "label", "shingles", "sketch")
    dealt = pairs.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    more = dealt.mapInPandas(_edges_of(["root", "i", "j"], percent, True), "root binary, a binary, b binary").select("a", "b")
    return small.unionByName(components(edges.unionByName(more)))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, chunk_shingles: int = CHUNK_SHINGLES, chunk_nodes: int = CHUNK_NODES) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept (doc_id is component_id).

    A document without words, null text included, links with nothing and is its own component. A row without an id
    is a node like others, but null is nobody's component_id unless all ids reachable are null. Repeated rows share
    their result, and so do rows of one id and equal sets; texts are read whole; an empty table gives an empty
    result; other columns of ``docs`` are not read. Thresholds from 75 up suit the bands.
    """
    with shuffle_files_dropped(docs.sparkSession):
        signed = checkpointed(signed_documents(docs, words))
        nodes = checkpointed(signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"), F.max("n_shingles").alias("size")))
        roots = linked_nodes(docs, nodes, clusters(signed), words, percent, chunk_shingles, chunk_nodes)
        placed = checkpointed(nodes.join(roots, "node", "left").select("node", "low", "n", F.coalesce("root", "node").alias("root")))
        lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("nodes"))
        n_nodes, n = placed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        named = checkpointed(spread_join(placed, lowest, "root", ["component_id"], "nodes", n_nodes).select("node", "n", "component_id"))
    found = spread_join(signed.select("doc_id", "n_shingles", "node"), named, "node", ["component_id"], "n", n)
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return found.select("doc_id", "n_shingles", own).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
