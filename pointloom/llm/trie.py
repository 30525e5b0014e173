"""Prefix trie of conversations from padded matrices of turn ids, in shards of their order.

A conversation is the sequence of its turns' ids (16 bytes of a digest of role and text). The sequences are sorted over
all tasks, with conv_id behind them, so that even equal conversations are parted. Each shard lays its sequences out as
padded matrices of dense ids, a block of columns at a time and without the rows that have ended, sorts the rows with
``lexsort``, and collects the changes against the row before, or-ed from column to column: where a column's mask is set a
node of that depth starts, and ``reduceat`` over those places gives its numbers. Sums over subtrees go up level by
level.

Neighbouring shards share the nodes on the common prefix of one's last row and the other's first, and no others. For
these each shard gives its part, less what it counts twice with the next shard: a child, a leaf or a turn's words on the
shared path. The parts add up by a digest of the prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from pointloom.llm.common import WORD, checkpointed, shuffle_partitions, spread_join

ID = 16
#: Turns for which there is a shard; columns of a matrix; characters of a piece of conv_ids.
SHARD_TURNS, COLUMNS, PIECE = 1_000_000, 32, 1 << 20

_FOUND = (
    "kind int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, turn_id binary, ends string, shard int, piece int"
)
_FINAL, _PART, _ENDS = range(3)
_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def turn_id(role: Column, text: Column) -> Column:
    """The id of a turn, as 32 hex digits."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns (id, words), by turn (null first), of equal turns by role and id. Rows of no conversation go."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", role.alias("role"), turn_id(role, text).alias("id"), words.alias("words")).alias("t"))
    # a conversation is one row, of digests and not of texts
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return lists.select("conv_id", F.transform("ts", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("ts"))


def rebuilt(lists: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Conversations that begin like the first of their group: its first h turns, then their own behind the first h.

    h is crc32 of the decimal conv_id modulo ``most``. Without that first conversation they lose their first h turns.
    """
    first = F.col("conv_id") - F.col("conv_id") % group
    heads = lists.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_first"), F.slice("ts", 1, max(1, most - 1)).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    joined = lists.withColumn("_at", first).join(heads, F.col("_at") == F.col("_first"), "left")
    head = F.when(F.col("_head").isNull(), F.slice("ts", F.lit(1), F.lit(0))).otherwise(F.slice("_head", F.lit(1), h))
    return joined.select("conv_id", F.concat(head, F.slice("ts", h + 1, F.greatest(F.size("ts"), F.lit(1)))).alias("ts"))


def _ranks(raw: bytes) -> np.ndarray:
    """Dense numbers of the ids in the order of their bytes."""
    pairs = np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    new = np.r_[False, (pairs[order][1:] != pairs[order][:-1]).any(axis=1)]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class ShardTrie:
    """The nodes of a shard's sequences, by depth; ``first`` and ``last`` are the nodes on those rows' paths."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, words: np.ndarray, conv: np.ndarray, columns: int = COLUMNS):
        n = len(lengths)
        start = np.cumsum(lengths) - lengths
        made: dict[str, list[np.ndarray]] = {k: [v] for k, v in (("n", np.array([n])), ("conv", np.array([conv.min()])), ("w", np.zeros(1, np.int64)), ("parent", np.array([-1])), ("row", np.zeros(1, np.int64)))}
        self.levels, total = [0, 1], 1
        self.end_of = np.zeros(n, np.int64)  # each row's last node
        self.first, self.last = [0], [0]
        rows, node = np.arange(n), np.zeros(n, np.int64)
        for at in range(0, int(lengths.max(initial=0)), columns):
            left = lengths[rows] > at
            rows, node = rows[left], node[left]
            width = min(columns, int(lengths[rows].max()) - at)
            matrix = np.full((len(rows), width), -1, np.int64)
            inside = lengths[rows, None] > at + np.arange(width)
            matrix[inside] = ids[(start[rows, None] + at + np.arange(width))[inside]]
            order = np.lexsort((*matrix.T[::-1], node))
            rows, node, matrix, inside = rows[order], node[order], matrix[order], inside[order]
            changed = np.r_[True, node[1:] != node[:-1]]
            for c in range(width):
                changed[1:] |= matrix[1:, c] != matrix[:-1, c]
                live = np.flatnonzero(inside[:, c])
                begins = np.flatnonzero(changed[live])
                lead = rows[live[begins]]
                made["n"].append(np.diff(np.append(begins, len(live))))
                made["conv"].append(np.minimum.reduceat(conv[rows[live]], begins))
                made["w"].append(words[start[lead] + at + c])
                made["parent"].append(node[live[begins]])
                made["row"].append(lead)
                node[live] = total + np.cumsum(changed[live]) - 1
                total += len(begins)
                self.levels.append(total)
                ended = live[lengths[rows[live]] == at + c + 1]
                self.end_of[rows[ended]] = node[ended]
                if lengths[0] > at + c:
                    self.first.append(int(node[0]))
                if lengths[-1] > at + c:
                    self.last.append(int(node[-1]))
        self.n, self.conv, self.w, self.parent, self.row = (np.concatenate(made[k]).astype(np.int64) for k in ("n", "conv", "w", "parent", "row"))
        self.depth = np.repeat(np.arange(len(self.levels) - 1), np.diff(self.levels))
        self.children = np.bincount(self.parent[1:], minlength=total)
        self.leaves = (self.children == 0).astype(np.int64)
        self.saved = (self.n - 1) * self.w
        for d in range(len(self.levels) - 2, 0, -1):
            level = slice(self.levels[d], self.levels[d + 1])
            np.add.at(self.leaves, self.parent[level], self.leaves[level])
            np.add.at(self.saved, self.parent[level], self.saved[level])


def _path_keys(sequence: bytes, depth: int) -> list[bytes]:
    """Keys of the prefixes of 0 to ``depth`` turns."""
    state, keys = xxhash.xxh3_128(), []
    for d in range(depth + 1):
        if d:
            state.update(sequence[ID * (d - 1) : ID * d])
        keys.append(d.to_bytes(8, "big") + state.digest())
    return keys


def _shard_nodes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over the rows of one shard in order: its own nodes, its parts of shared ones, and who ends at these."""
    held = [f for f in frames if len(f)]
    if not held:
        return
    frame = pd.concat(held, ignore_index=True)
    raw = [bytes(k) for k in frame["key"]]
    lengths = np.array([len(k) // ID for k in raw])
    conv = frame["conv_id"].to_numpy(np.int64)
    words = np.concatenate([np.asarray(w, np.int64) for w in frame["words"]]) if lengths.sum() else np.empty(0, np.int64)
    shard, before, after = (int(frame[c].iloc[0]) for c in ("shard", "before", "after"))
    t = ShardTrie(_ranks(b"".join(raw)), lengths, words, conv)
    if after >= 0:  # what the next shard counts too: its last row's path down to the common depth
        path = np.array(t.last[: after + 1])
        t.children[path[:-1]] -= 1
        t.leaves[path] -= int(lengths[-1] == after)
        t.saved[path] += np.cumsum(t.w[path][::-1])[::-1]
    keys: dict[int, bytes] = {0: _path_keys(b"", 0)[0]}
    for path, row, depth in ((t.first, raw[0], before), (t.last, raw[-1], after)):
        keys |= dict(zip(path, _path_keys(row, depth))) if depth > 0 else {}
    shared = np.zeros(len(t.n), bool)
    shared[list(keys)] = True
    # rows of equal sequences lie together, in the order of conv_id
    ends: dict[int, str] = {}
    cut = np.flatnonzero(np.r_[True, t.end_of[1:] != t.end_of[:-1], True])
    pieces = []
    for a, b in zip(cut[:-1], cut[1:]):
        node = int(t.end_of[a])
        text = ",".join(map(str, conv[a:b].tolist()))
        if node in keys:
            pieces += [(keys[node], shard, k // PIECE, text[k : k + PIECE]) for k in range(0, len(text), PIECE)]
        else:
            ends[node] = hashlib.sha256(text.encode()).hexdigest()
    nobody = hashlib.sha256(b"").hexdigest()
    for at in range(0, len(t.n), 100_000):
        own = np.arange(at, min(at + 100_000, len(t.n)))
        parent = t.parent[own]
        below_shared = (parent >= 0) & shared[parent]
        out = pd.DataFrame({"kind": np.where(shared[own], _PART, _FINAL), "conv_id": t.conv[own], "depth": t.depth[own], "n_convs": t.n[own], "n_children": t.children[own], "n_leaves": t.leaves[own], "saved_tokens": t.saved[own]})
        out["key"] = [keys.get(v) for v in own.tolist()]
        out["parent_key"] = [keys[p] if s else None for p, s in zip(parent.tolist(), below_shared)]
        out["parent_conv_id"] = pd.array(t.conv[parent], "Int64")
        out.loc[below_shared | (parent < 0), "parent_conv_id"] = pd.NA
        out["turn_id"] = [raw[r][ID * (d - 1) : ID * d] if d else None for r, d in zip(t.row[own].tolist(), t.depth[own].tolist())]
        out["ends"] = [None if v in keys else ends.get(v, nobody) for v in own.tolist()]
        out["shard"], out["piece"] = shard, 0
        yield out[_NAMES]
    if pieces:
        more = pd.DataFrame(pieces, columns=["key", "shard", "piece", "ends"]).assign(kind=_ENDS)
        yield more.reindex(columns=_NAMES).astype(dict.fromkeys(("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), "Int64"))


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over pieces by key, shard and piece: a digest of each key's conv_ids, read as a stream."""
    last, shard, state = None, None, hashlib.sha256()
    for frame in frames:
        done = []
        for key, at, text in zip(frame["key"], frame["shard"], frame["ends"]):
            if key != last:
                if last is not None:
                    done.append((last, state.hexdigest()))
                last, shard, state = key, at, hashlib.sha256()
            elif at != shard:
                state.update(b",")
                shard = at
            state.update(text.encode())
        yield pd.DataFrame(done, columns=["key", "ends"])
    if last is not None:
        yield pd.DataFrame([(last, state.hexdigest())], columns=["key", "ends"])


@F.pandas_udf(IntegerType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Turns that two sequences have in common at their beginning; -1 if there is no other."""

    def one(x: bytes | None, y: bytes | None) -> int:
        if x is None or y is None:
            return -1
        n = min(len(x), len(y))
        differ = np.flatnonzero(np.frombuffer(x[:n], np.uint8) != np.frombuffer(y[:n], np.uint8))
        return (int(differ[0]) if len(differ) else n) // ID

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=np.int32)


def prefix_trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie over sequences of turns (conv_id, ts as :func:`turns` and :func:`rebuilt` give them).

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
    (of the conv_ids that end there) and turn_id (of the node's last turn, null for the root). Conversations without
    turns are members of the root. An empty table has no node.
    """
    spark = sequences.sparkSession
    ids = F.array_join(F.transform("ts", lambda t: t["id"]), "")
    rows = checkpointed(sequences.select("conv_id", F.unhex(ids).alias("key"), F.transform("ts", lambda t: t["words"]).alias("words")))
    n_turns = rows.agg(F.coalesce(F.sum(F.size("words") + 1), F.lit(0))).first()[0]
    shards = max(shuffle_partitions(spark), -(-n_turns // shard_turns))
    # written once: the bounds of the shards must be the same for their edges and their nodes
    dealt = checkpointed(rows.repartitionByRange(shards, "key", "conv_id").sortWithinPartitions("key", "conv_id"))
    placed = dealt.withColumn("shard", F.spark_partition_id())
    edges = placed.groupBy("shard").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    by = Window.partitionBy(F.lit(0)).orderBy("shard")  # over one row a shard
    common = edges.select("shard", F.lag("high").over(by).alias("left"), "low", "high", F.lead("low").over(by).alias("right"))
    common = common.select("shard", _common("left", "low").alias("before"), _common("high", "right").alias("after"))
    found = checkpointed(placed.join(F.broadcast(checkpointed(common)), "shard").mapInPandas(_shard_nodes, _FOUND))

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = found.where(F.col("kind") == _PART).groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent_key").alias("parent_key"), F.min("turn_id").alias("turn_id"), *sums)
    pieces = found.where(F.col("kind") == _ENDS).select("key", "shard", "piece", "ends")
    ends = pieces.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", "shard", "piece").mapInPandas(_hashed, "key binary, ends string")
    shared = checkpointed(parts.join(ends, "key", "left").withColumn("ends", F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256))))
    above = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    names = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "turn_id", "ends"]
    final = found.where(F.col("kind") == _FINAL)
    below = final.where("parent_key IS NOT NULL").select("parent_key", *names)
    named = spread_join(below, above.withColumnRenamed("n_children", "_n"), "parent_key", ["parent_conv_id"], "_n", below.count())
    own = shared.join(above.drop("n_children"), "parent_key", "left")
    out = final.where("parent_key IS NULL").select("parent_conv_id", *names)
    out = out.unionByName(named.select("parent_conv_id", *names)).unionByName(own.select("parent_conv_id", *names))
    return out.select("conv_id", "depth", "parent_conv_id", *names[2:6], F.col("ends").alias("ends_sha256"), F.lower(F.hex("turn_id")).alias("turn_id"))


def conversation_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """:func:`prefix_trie` of the rebuilt conversations of a table with conv_id, turn, role and text.

    A null role or text is empty; a null turn comes first; rows without conv_id belong to no conversation and take no
    part; repeated rows are turns of their own, in the order of role and digest if their turn is equal. Texts are read
    whole and left behind as digests. Other columns are not read.
    """
    return prefix_trie(rebuilt(turns(conversations)), shard_turns)


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (
  SELECT conv_id, list(id ORDER BY turn NULLS FIRST, r, id) AS ids, list(w ORDER BY turn NULLS FIRST, r, id) AS ws,
         CAST(xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1),
           lambda i: [CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 4 AS INT) AS h
  FROM t GROUP BY conv_id),
b AS (
  SELECT l.conv_id, list_concat(coalesce(f.ids[1:l.h], []), l.ids[l.h + 1:]) AS ids, list_concat(coalesce(f.ws[1:l.h], []), l.ws[l.h + 1:]) AS ws
  FROM l LEFT JOIN l f ON f.conv_id = l.conv_id - l.conv_id % 20),
p AS (SELECT conv_id, ids, ws, unnest(range(0, len(ids) + 1)) AS depth FROM b),
n AS (
  SELECT array_to_string(ids[1:depth], '') AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth > 0 THEN ws[depth] ELSE 0 END) AS w,
         sha256(coalesce(string_agg(CASE WHEN len(ids) = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM p GROUP BY 1, 2),
k AS (SELECT *, (SELECT count(*) FROM n c WHERE c.depth = n.depth + 1 AND starts_with(c.p, n.p)) AS n_children FROM n)
SELECT a.conv_id, a.depth, u.conv_id AS parent_conv_id, a.n_convs, a.n_children,
       s.n_leaves, s.saved_tokens, a.ends_sha256, CASE WHEN a.depth > 0 THEN right(a.p, 32) END AS turn_id
FROM k a LEFT JOIN k u ON u.depth = a.depth - 1 AND starts_with(a.p, u.p)
JOIN (SELECT x.p, x.depth, count(*) FILTER (y.n_children = 0) AS n_leaves, CAST(sum((y.n_convs - 1) * y.w) AS BIGINT) AS saved_tokens
      FROM k x JOIN k y ON y.depth >= x.depth AND starts_with(y.p, x.p) GROUP BY 1, 2) s ON s.p = a.p AND s.depth = a.depth
"""
