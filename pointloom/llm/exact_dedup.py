"""Exact deduplication over a sharded cuckoo-filter index of live digests.

Each shard of the index holds a cuckoo filter (two candidate buckets of four 16-bit tags for each digest)
and, per home bucket, the stored 256-bit digests with what is known of them. A lookup asks the filter first:
a miss is certain, a hit is verified against the digests stored in the bucket. An insertion that finds no
free slot after the allowed number of moves doubles the filter and refills it from the stored digests.
Deletion takes the tag out of the filter and the digest out of the bucket.

Rows go through the index twice: each map task merges its own rows (so a digest that a third of all rows
share leaves each task once), then each shard merges what the tasks sent. The number of shards follows the number of
rows, a map task's index leaves when it is full, and what leaves an index goes in small tables.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import SPACE, checkpointed, shuffle_partitions, spread_join

SLOTS = 4
MAX_MOVES = 200
#: Rows for which there is a shard, and the digests that a map task's index holds at most.
SHARD_ROWS = 200_000
OUT_ROWS = 20_000
INDEX_SCHEMA = "digest binary, keep_id long, no_id boolean, n_chars long, group_size long"
_COLUMNS = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]


class CuckooIndex:
    """Cuckoo filter over digests plus the stored digests by home bucket; values are the caller's."""

    def __init__(self, n_buckets: int = 64):
        self.resizes = 0
        self.size = 0
        self._clear(max(2, 1 << (n_buckets - 1).bit_length()))

    def _clear(self, n_buckets: int) -> None:
        self.n_buckets = n_buckets
        self.slots = array("H", bytes(2 * SLOTS * n_buckets))
        self.stored: list[list | None] = [None] * n_buckets

    def _tag(self, digest: bytes) -> int:
        return int.from_bytes(digest[8:10], "little") or 1

    def _home(self, digest: bytes) -> int:
        return int.from_bytes(digest[:8], "little") & (self.n_buckets - 1)

    def _other(self, bucket: int, tag: int) -> int:
        # an odd multiple of the tag, so that the move can be undone from either bucket
        return (bucket ^ (tag * 0x5BD1E995 | 1)) & (self.n_buckets - 1)

    def _put(self, bucket: int, tag: int) -> bool:
        for at in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
            if not self.slots[at]:
                self.slots[at] = tag
                return True
        return False

    def _insert_tag(self, digest: bytes) -> bool:
        tag, bucket = self._tag(digest), self._home(digest)
        if self._put(bucket, tag) or self._put(other := self._other(bucket, tag), tag):
            return True
        bucket = other
        for move in range(MAX_MOVES):
            at = SLOTS * bucket + (move * 7 + tag) % SLOTS
            tag, self.slots[at] = self.slots[at], tag
            bucket = self._other(bucket, tag)
            if self._put(bucket, tag):
                return True
        return False

    def _maybe(self, digest: bytes) -> bool:
        tag, bucket = self._tag(digest), self._home(digest)
        for b in (bucket, self._other(bucket, tag)):
            if tag in self.slots[SLOTS * b : SLOTS * b + SLOTS]:
                return True
        return False

    def get(self, digest: bytes):
        """The value stored for the digest, or None."""
        if self._maybe(digest):
            for entry in self.stored[self._home(digest)] or ():
                if entry[0] == digest:
                    return entry[1]
        return None

    def insert(self, digest: bytes, value) -> None:
        """Store a digest that is not in the index."""
        home = self._home(digest)
        if self.stored[home] is None:
            self.stored[home] = []
        self.stored[home].append((digest, value))
        self.size += 1
        if not self._insert_tag(digest):
            self._resize()

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest; False if it is not in the index."""
        home = self._home(digest)
        entries = self.stored[home] or []
        left = [e for e in entries if e[0] != digest]
        if len(left) == len(entries):
            return False
        self.stored[home] = left
        self.size -= 1
        tag = self._tag(digest)
        for b in (home, self._other(home, tag)):
            for at in range(SLOTS * b, SLOTS * b + SLOTS):
                if self.slots[at] == tag:
                    self.slots[at] = 0
                    return True
        raise AssertionError("a stored digest has no tag")

    def _resize(self) -> None:
        entries = list(self.items())
        while True:
            self.resizes += 1
            self._clear(2 * self.n_buckets)
            if all([self._insert_tag(digest) for digest, _ in entries]):
                break
        for digest, value in entries:
            home = self._home(digest)
            if self.stored[home] is None:
                self.stored[home] = []
            self.stored[home].append((digest, value))

    def items(self) -> Iterator[tuple[bytes, object]]:
        for entries in self.stored:
            yield from entries or ()


def _merge(index: CuckooIndex, frame: pd.DataFrame) -> None:
    """Values are [characters, a known id before none, id] of the row that stays, negated where less is better, and the
    group's size."""
    for digest, keep_id, no_id, n_chars, size in zip(*(frame[c].tolist() for c in _COLUMNS)):
        digest, order = bytes(digest), (n_chars, not no_id, -keep_id)
        kept = index.get(digest)
        if kept is None:
            index.insert(digest, [order, size])
        else:
            kept[0] = max(kept[0], order)
            kept[1] += size


def _merge_partition(most: int | None = None):
    """Merge the rows of a partition; an index of ``most`` digests leaves and a new one starts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = CuckooIndex()
        for frame in frames:
            _merge(index, frame)
            if most and index.size >= most:
                yield from _tables(index)
                index = CuckooIndex()
        yield from _tables(index)

    return run


def _tables(index: CuckooIndex) -> Iterator[pd.DataFrame]:
    entries = index.items()
    while rows := [(digest, -v[0][2], not v[0][1], v[0][0], v[1]) for digest, v in islice(entries, OUT_ROWS)]:
        yield pd.DataFrame(rows, columns=_COLUMNS)


def _flagged(doc_id: str, name: str = "keep_id") -> list:
    """An id and whether it is missing; a missing one is 0."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias(name), F.col(doc_id).isNull().alias("no_id")]


def _unflagged(index: DataFrame) -> DataFrame:
    return index.withColumn("keep_id", F.when(~F.col("no_id"), F.col("keep_id"))).drop("no_id")


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, digest (binary SHA-256 of the text without white space; null counts as empty) and n_chars."""
    whole = F.coalesce(F.col(text), F.lit(""))
    bare = F.regexp_replace(whole, SPACE + "+", "")
    return docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(bare, 256)).alias("digest"), F.length(whole).cast("long").alias("n_chars"))


def build_index(rows: DataFrame, n_rows: int | None = None) -> DataFrame:
    """One row per distinct digest: keep_id, its n_chars and the group's size.

    ``rows`` is what :func:`digests` returns. The row with most code points, then the smallest id, is kept;
    a null id counts as larger than every other and comes back as null.
    """
    one = rows.select("digest", *_flagged("doc_id"), "n_chars", F.lit(1).cast("long").alias("group_size"))
    shards = max(shuffle_partitions(rows.sparkSession), -(-(rows.count() if n_rows is None else n_rows) // SHARD_ROWS))
    local = one.mapInPandas(_merge_partition(SHARD_ROWS), INDEX_SCHEMA)
    merged = local.repartition(shards, "digest").mapInPandas(_merge_partition(), INDEX_SCHEMA)
    return _unflagged(merged)


def apply_changes(index: DataFrame, changes: DataFrame, shards: int | None = None) -> DataFrame:
    """The index after a batch of changes.

    ``changes`` has op ('insert' or 'delete'), seq (order of the changes of one digest), digest, doc_id and
    n_chars. A deletion takes the digest out, so that a later insertion of the same text is new again.
    Deleting a digest that is not live, or an unknown op, changes nothing. Each shard of the index and its
    changes are brought together in one task; their number follows that of the rows unless ``shards`` is given.
    """
    if shards is None:
        shards = max(shuffle_partitions(index.sparkSession), -(-(index.count() + changes.count()) // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")
    a = index.select(shard, "digest", *_flagged("keep_id"), "n_chars", "group_size")
    b = changes.select(shard, "op", "seq", "digest", *_flagged("doc_id", "doc_id"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))

    def update(state: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        live = CuckooIndex(max(64, len(state) // 2))
        _merge(live, state)
        batch = batch.sort_values(["seq"], kind="stable")
        for op, digest, doc_id, no_id, n_chars in zip(*(batch[c].tolist() for c in ("op", "digest", "doc_id", "no_id", "n_chars"))):
            if op == "delete":
                live.delete(bytes(digest))
            elif op == "insert":
                _merge(live, pd.DataFrame([(digest, doc_id, no_id, n_chars, 1)], columns=_COLUMNS))
        return pd.concat([pd.DataFrame(columns=_COLUMNS), *_tables(live)])

    out = a.groupBy("shard").cogroup(b.groupBy("shard")).applyInPandas(update, INDEX_SCHEMA)
    return _unflagged(out)


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every document with the one of its equals that stays.

    Columns: doc_id, keep_id, group_size, kept, text_sha256. Texts are equal when identical without white
    space; null counts as empty. Rows that repeat both id and text share their row's decision. An empty
    table gives an empty result; other columns of ``docs`` are not read.
    """
    rows = digests(docs, text, doc_id)
    n = docs.count()
    index = checkpointed(build_index(rows, n))
    return spread_join(rows, index, "digest", ["keep_id", "group_size"], "group_size", n).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that stay, with the columns of ``docs``: one row of each group of equal texts.

    Null texts count as empty, so one document without text stays; of null ids and repeated rows see
    :func:`exact_dedup`. An empty table stays empty.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(F.regexp_replace(whole, SPACE + "+", ""), 256))
    # by digest, id and length at once: the rows of a large group are dealt out by their ids
    key = lambda d, i, n: F.struct(d.alias("digest"), i.alias("id"), n.cast("long").alias("n")).alias("_key")
    kept = build_index(digests(docs, text, doc_id), docs.count()).select(key(F.col("digest"), F.col("keep_id"), F.col("n_chars")))
    rows = docs.select(F.struct("*").alias("_doc"), key(digest, F.col(doc_id).cast("long"), F.length(whole)))
    # rows that repeat the keeper's id and length; few, as all others are gone by now
    first = rows.join(kept, "_key").withColumn("_k", F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(0))))
    return first.where("_k = 1").select("_doc.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
