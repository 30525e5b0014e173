"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A suffix (a position of a document) repeats if its first ``length`` bytes also start in a document of smaller id.

1. Each task cuts its texts into stretches: maximal runs of suffixes whose first ``length`` bytes have the same
   least gram (by a hash of the gram). Equal strings have the same least gram, so a bucket of suffixes is named by
   it, and a stretch carries the bytes of all its suffixes once. Grams that a sample of documents shows to be
   common count as the largest, so that no bucket is hot. A stretch that a task has twice is decided there.
2. Each bucket decides equal stretches as wholes, leaves out stretches and suffixes that share no slot of a hash table
   with another id, and sorts the other suffixes, one range of first bytes at a time, by their first 16 bytes. Ties that documents
   of different ids share are resolved by the ranks of a difference cover: positions whose residue lies in a set of
   which every residue is a difference are ranked by their first ``length - period + 1`` bytes (a true order: ranks
   are equal where the bytes are), so that any two suffixes have cover positions at one distance below ``period``
   from their starts. Equal first bytes, equal ranks there and equal last bytes are equal strings.
3. Answers (runs of repeated suffixes) go back to the task's table of documents and become removed spans.

Everything compares bytes; hashes only choose buckets. Memory is bounded by a task's block of text, by a bucket, and
by the suffixes that are sorted at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import checkpointed, scratch, shuffle_files_dropped, shuffle_partitions

LENGTH = 50
#: Bytes of text that a task cuts into stretches at a time.
BLOCK_BYTES = 8 << 20
#: Bytes of stretches that a bucket holds on average.
BUCKET_BYTES = 8 << 20
#: Suffixes that a bucket sorts at once, as far as their first two bytes tell them apart.
SORTED_AT_ONCE = 1 << 20
#: Partitions that the buckets are dealt over at most; a task takes its buckets one after the other.
MOST_PARTITIONS = 20_000
#: Documents looked at for common grams: so many at least, and one of so many; a gram that more than HOT_COUNT of them
#: have is common, so that about 10,000 documents of a table of any size, or a hundredth of a small one, are too many.
HOT_DOCS, HOT_ONE_OF, HOT_COUNT = 2000, 500, 20
#: Looks at the sample at most: with some grams behind all others, others of the same phrase may become the least.
HOT_ROUNDS = 6
#: Most common grams (4 bytes each, in every task).
MOST_HOT = 1 << 20
#: Most suffixes of a stretch.
STRETCH = 1024
#: Perfect difference covers by period.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9)}
#: Words of a removed span that make it a passage.
PASSAGE_WORDS = 50
_NO_ID = (1 << 63) - 1
_U = np.uint64
_HOT = np.uint32(1 << 31)
_PART = 1 << 17
ANSWER, OWN = 0, 1


def period_for(length: int) -> int:
    """The period of the cover for strings of ``length`` bytes."""
    return 13 if length >= 32 else 7


def _words(raw: np.ndarray, order: str) -> np.ndarray:
    """The 8 bytes from each position on as one number, without a copy."""
    return np.ndarray((max(0, len(raw) - 7),), f"{order}u8", raw, strides=(1,))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def _least_grams(raw: np.ndarray, length: int, hot: np.ndarray) -> np.ndarray:
    """For each string of ``length`` bytes the least hash of a gram of 12 bytes (8 for short strings) in it."""
    gram = 12 if length >= 24 else 8
    words = _words(raw, "<")
    n = len(raw) - gram + 1
    h = words[:n] * _U(0x9E3779B97F4A7C15)
    if gram == 12:
        h ^= words[4 : 4 + n] * _U(0xC2B2AE3D27D4EB4F)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h = (h >> _U(33)).astype(np.uint32)
    least = _least(h, length - gram + 1)
    for _ in range(len(hot)):
        some = np.unique(least)
        common = some[hot[np.minimum(np.searchsorted(hot, some), len(hot) - 1)] == some]
        if not len(common):
            break
        h[np.isin(h, common)] |= _HOT  # behind all others, and no longer equal to a hash of the list
        least = _least(h, length - gram + 1)
    return least


def stretches(raw: np.ndarray, bounds: np.ndarray, length: int, hot: np.ndarray, slab: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First suffix, number of suffixes and least gram of each stretch, in order. ``bounds`` are the texts' ends, from 0 on."""
    firsts, counts, grams = [], [], []
    for s in range(0, len(raw) - length + 1, slab):
        least = _least_grams(raw[s : min(len(raw), s + slab + length - 1)], length, hot)
        n = len(least)
        # the last length - 1 positions of a text start no string of it
        fits = np.ones(n, bool)
        for end in (bounds[(bounds > s) & (bounds - length + 1 < s + n)] - s).tolist():
            fits[max(0, end - length + 1) : end] = False
        edge = ~fits
        edge[0] = True
        edge[1:] |= ~fits[:-1] | (least[1:] != least[:-1])
        at = np.flatnonzero(edge)
        size = np.diff(np.append(at, n))
        at, size = at[fits[at]], size[fits[at]]
        if len(size) and size.max() > STRETCH:
            parts = -(-size // STRETCH)
            k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            at, size = np.repeat(at, parts) + k * STRETCH, np.minimum(STRETCH, np.repeat(size, parts) - k * STRETCH)
        firsts.append(at + s)
        counts.append(size)
        grams.append(least[at])
    if not firsts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)
    return np.concatenate(firsts), np.concatenate(counts), np.concatenate(grams)


def _planes(values: np.ndarray) -> bytes:
    """Numbers by byte planes of the width that the largest needs."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplaned(data: memoryview, n: int) -> tuple[np.ndarray, memoryview]:
    width = data[0]
    full = np.zeros((n, 8), np.uint8)
    full[:, :width] = np.frombuffer(data, np.uint8, n * width, 1).reshape(width, n).T
    return full.view("<u8").ravel(), data[1 + n * width :]


def _gaps(values: np.ndarray) -> np.ndarray:
    """Numbers (in any order, negative ones too) as small ones where neighbours are near: gaps with the sign last."""
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(0))
    return ((gaps << 1) ^ (gaps >> 63)).view(_U)


def _ungapped(values: np.ndarray) -> np.ndarray:
    return np.cumsum((values >> _U(1)).view(np.int64) ^ -(values & _U(1)).view(np.int64))


def _pressed(*columns: np.ndarray, tail: bytes = b"") -> bytes:
    """Columns of whole numbers of one length, and bytes behind them."""
    n = len(columns[0])
    return zstandard.ZstdCompressor(level=3).compress(n.to_bytes(8, "little") + b"".join(map(_planes, columns)) + tail)


def _opened(data: bytes, columns: int) -> tuple[list[np.ndarray], memoryview]:
    rest = memoryview(zstandard.ZstdDecompressor().decompress(data))
    n, rest, out = int.from_bytes(rest[:8], "little"), rest[8:], []
    for _ in range(columns):
        column, rest = _unplaned(rest, n)
        out.append(column)
    return out, rest


def _equal_stretches(data: bytes, first: np.ndarray, last: np.ndarray, gram: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which stretches have the bytes of one of a smaller id."""
    gone = np.zeros(len(first), bool)
    if len(first) < 2:
        return gone
    words = _words(np.frombuffer(data, np.uint8), "<")
    key = gram.astype(_U) + (last - first).astype(_U) * _U(0xC2B2AE3D27D4EB4F)
    for at in (first, (first + last) // 2 - 4, last - 8):
        key = (key ^ words[at]) * _U(0x9E3779B97F4A7C15)
        key ^= key >> _U(31)
    order = np.lexsort((ids, key))
    key = key[order]
    leads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.append(leads[1:], len(key))
    for a, b in zip(leads[ends - leads > 1].tolist(), ends[ends - leads > 1].tolist()):
        lead = order[a]
        whole = data[first[lead] : last[lead]]
        for k in order[a + 1 : b].tolist():
            if ids[k] > ids[lead] and data[first[k] : last[k]] == whole:
                gone[k] = True
    return gone


_SENT = pa.schema([("bucket", pa.int64()), ("piece", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(_SENT.types)], schema=_SENT)


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


class _Texts:
    """Rows of Arrow batches (doc_id, key, text) that are held until they make a block."""

    def __init__(self):
        self.held: list[pa.RecordBatch] = []
        self.size = 0

    def blocks(self, batches: Iterator[pa.RecordBatch], most: int):
        for batch in batches:
            sizes = np.diff(np.frombuffer(batch.column("text").buffers()[1], np.int32, len(batch) + 1, 4 * batch.column("text").offset)) if len(batch) else []
            at = 0
            for k, size in enumerate(sizes):
                self.size += int(size)
                if self.size >= most:
                    self.held.append(batch.slice(at, k + 1 - at))
                    yield self.taken()
                    at = k + 1
            if at < len(batch):
                self.held.append(batch.slice(at))
        if self.held:
            yield self.taken()

    def taken(self) -> tuple[np.ndarray, bytes, np.ndarray, bytes]:
        """ids, keys (16 bytes each), sizes and bytes of the held rows, without repeated rows, by id."""
        table = pa.Table.from_batches(self.held)
        self.held, self.size = [], 0
        ids = table.column("doc_id").to_numpy().astype(np.int64)
        keys = table.column("key").to_pylist()
        rows, seen = [], set()
        for k in np.argsort(ids, kind="stable").tolist():
            if (ids[k], keys[k]) not in seen:
                seen.add((ids[k], keys[k]))
                rows.append(k)
        texts = [c.as_buffer() for c in table.column("text").cast(pa.binary()).take(pa.array(rows, pa.int64()))]
        return ids[rows], b"".join(keys[k] for k in rows), np.array([t.size for t in texts], np.int64), b"".join(texts)


def _name(ids: np.ndarray, keys: bytes) -> int:
    """The name of a block: 63 bits of a hash of its rows' ids and of their texts' digests."""
    return int.from_bytes(hashlib.blake2b(ids.astype("<i8").tobytes() + keys, digest_size=8).digest(), "little") >> 1


def _cut(texts: tuple, length: int, n_buckets: int, hot: np.ndarray, piece: int) -> Iterator[pa.RecordBatch]:
    """What a block of texts sends: its stretches to their buckets, and its table of documents."""
    ids, keys, sizes, data = texts
    ends = np.cumsum(sizes)
    first, count, gram = stretches(np.frombuffer(data, np.uint8), ends, length, hot)
    own = ids[np.searchsorted(ends, first, "right")]
    last = first + count + length - 1
    gone = _equal_stretches(data, first, last, gram, own)
    decided = _runs(first[gone], count[gone])
    table = _pressed(_gaps(ids), sizes.astype(_U), tail=keys + _pressed(_gaps(decided)))
    yield _sent([((piece * 0x9E3779B97F4A7C15 % (1 << 64) >> 33) % n_buckets, piece, OWN, table)])
    left = np.flatnonzero(~gone)
    mixed = (gram[left].astype(_U) + _U(1)) * _U(0x94D049BB133111EB)
    mixed = (mixed ^ (mixed >> _U(32))) * _U(0xD6E8FEB86659FD93)
    bucket = ((mixed >> _U(32)) * _U(n_buckets)) >> _U(32)
    left = left[np.argsort(bucket, kind="stable")]
    bucket = np.sort(bucket)
    rows = []
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for a, b in zip(starts, np.append(starts[1:], len(bucket)) if len(bucket) else []):
        some = left[a:b]
        bytes_ = b"".join([data[i:j] for i, j in zip(first[some].tolist(), last[some].tolist())])
        rows.append((int(bucket[a]), piece, ANSWER, _pressed(_gaps(first[some]), count[some].astype(_U), _gaps(own[some]), gram[some].astype(_U) & _U(0xFFFFFF), tail=bytes_)))
        if len(rows) == 64:
            yield _sent(rows)
            rows = []
    if rows:
        yield _sent(rows)


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Starts and ends, in turn, of runs of positions given in order; runs that touch are one."""
    if not len(first):
        return np.empty(0, np.int64)
    end = first + count
    new = np.flatnonzero(np.r_[True, first[1:] != end[:-1]])
    return np.stack([first[new], end[np.append(new[1:], len(first)) - 1]], axis=1).ravel()


def _tied(groups: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of rows in the order of their groups, those whose group has several ids."""
    if not len(groups):
        return np.zeros(0, bool)
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
    return np.repeat(several, np.diff(np.append(first, len(groups))))


def _ranks(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by the keys, the first before the others, and the rank of each row in that order."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.cumsum(new)


def repeats(raw: np.ndarray, at: np.ndarray, residue: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings of ``length`` bytes at the positions ``at`` a smaller id has too.

    ``residue`` is a position's distance from the start of its stretch.
    """
    out = np.zeros(len(at), bool)
    words = _words(raw, ">")
    key = words[at].astype(_U)
    order = np.argsort(key)
    rows = order[_tied(key[order], ids[order])]
    order, group = _ranks(words[at[rows]].astype(_U), words[at[rows] + 8].astype(_U))
    rows = rows[order]
    tied = _tied(group, ids[rows])
    rows, group = rows[tied], group[tied]
    if not len(rows):
        return out
    # the bytes behind the last that a rank is sure to reach
    order, group = _ranks(group, words[at[rows] + length - 16].astype(_U), words[at[rows] + length - 8].astype(_U))
    rows = rows[order]
    tied = _tied(group, ids[rows])
    rows, group = rows[tied], group[tied]
    if not len(rows):
        return out
    period = period_for(length)
    size = length - period + 1
    steps = np.array([sorted((d - r) % period for d in COVERS[period]) for r in range(period)])[residue[rows] % period]
    near = at[rows][:, None] + steps
    covered = np.zeros(len(raw), bool)
    covered[near] = True
    sample = np.flatnonzero(covered)
    order, rank = _ranks(*[words[sample + k].astype(_U) for k in (*range(0, size - 8, 8), size - 8)])
    rank_of = np.empty(len(raw), np.int32)
    rank_of[sample[order]] = rank
    # one row for each suffix and cover position: the same group, distance and rank are the same string
    both = ((group - group[0]).repeat(steps.shape[1]) * period + steps.ravel()) * (int(rank[-1]) + 1) + rank_of[near.ravel()]
    order = np.argsort(both, kind="stable")
    both = both[order]
    first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
    own = ids[rows].repeat(steps.shape[1])[order]
    low = np.empty(len(both), np.int64)
    low[order] = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(both))))
    out[rows] = low.reshape(steps.shape).min(axis=1) < ids[rows]
    return out


def _perhaps_repeated(raw: np.ndarray, at: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """Rows of the strings that may occur under several ids: the others share no slot of a table with another id."""
    words, rows = _words(raw, "<"), np.arange(len(at))
    for k in (0, 8):
        bits = min(24, len(rows).bit_length() + 1)
        slot, last, several = np.empty(len(rows), np.int32), np.empty(1 << bits, np.int32), np.zeros(1 << bits, bool)
        parts = [slice(a, a + _PART) for a in range(0, len(rows), _PART)]  # small ones, as they stay in the cache
        for part in parts:
            own = rows[part]
            start = at[own]
            h = words[start + k] * _U(0x9E3779B97F4A7C15)
            h ^= (words[start + (length - 8 - k)] ^ (h >> _U(31))) * _U(0xC2B2AE3D27D4EB4F)
            slot[part] = h >> _U(64 - bits)
            last[slot[part]] = ids[own]
        for part in parts:
            several[slot[part][last[slot[part]] != ids[rows[part]]]] = True
        rows = rows[np.concatenate([several[slot[part]] for part in parts])] if parts else rows
    return rows


def _answers(table: pa.Table, length: int, at_once: int) -> pa.Table:
    """Of one bucket: which suffixes of each piece repeat. What a piece sends for itself passes."""
    pieces, kinds, payloads = (table.column(c).to_pylist() for c in ("piece", "kind", "payload"))
    bucket = table.column("bucket")[0].as_py()
    out = [(bucket, p, OWN, x) for p, k, x in zip(pieces, kinds, payloads) if k == OWN]
    own = [i for i, k in enumerate(kinds) if k != OWN]
    if own:
        opened = [_opened(payloads[i], 4) for i in own]
        where, ids = (np.concatenate([_ungapped(c[k]) for c, _ in opened]) for k in (0, 2))
        count, gram = (np.concatenate([c[k].astype(np.int64) for c, _ in opened]) for k in (1, 3))
        ends = np.cumsum([len(c[0]) for c, _ in opened])
        data = b"".join([rest for _, rest in opened])
        del opened, payloads
        raw, size = np.frombuffer(data, np.uint8), count + length - 1
        start = np.cumsum(size) - size
        whole = _equal_stretches(data, start, start + size, gram, ids)
        # of the others, those whose gram stretches of several ids share
        left = np.flatnonzero(~whole)
        left = left[np.argsort(gram[left], kind="stable")]
        left = np.sort(left[_tied(gram[left], ids[left])])
        n = count[left]
        before = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(start[left] - before, n)
        rows = _perhaps_repeated(raw, at, np.repeat(np.unique(ids[left], return_inverse=True)[1].astype(np.int32), n), length)
        place = np.searchsorted(before, rows, "right") - 1
        at, of, step = at[rows], left[place], rows - before[place]
        prefix = (raw[at].astype(np.int32) << 8) | raw[at + 1]
        gone = np.zeros(len(at), bool)
        for a, b in _ranges(np.bincount(prefix, minlength=1 << 16), at_once):
            some = np.flatnonzero((prefix >= a) & (prefix < b))
            if len(some) > 1:
                gone[some] = repeats(raw, at[some], step[some], ids[of[some]], length)
        position, of, whole = where[of[gone]] + step[gone], of[gone], np.flatnonzero(whole)
        for i, a, b in zip(own, [0, *ends[:-1]], ends):
            singles = position[np.searchsorted(of, a) : np.searchsorted(of, b)]
            full = whole[np.searchsorted(whole, a) : np.searchsorted(whole, b)]
            if len(singles) or len(full):
                runs = [_runs(singles, np.ones(len(singles), np.int64)), _runs(where[full], count[full])]
                out.append((bucket, pieces[i], ANSWER, _pressed(_gaps(np.concatenate(runs)))))
    return pa.Table.from_batches([_sent(out)])


def _ranges(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of first bytes whose suffixes number at most ``most``, or that are one value."""
    total, first, before = np.cumsum(counts), 0, 0
    while first < len(counts):
        end = max(first + 1, int(np.searchsorted(total, before + most, "right")))
        yield first, end
        first, before = end, int(total[end - 1])


_SPANS = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def _spans(table: pa.Table, length: int) -> pa.Table:
    """Of one piece: the removed spans of each document that has any."""
    kinds, payloads = table.column("kind").to_pylist(), table.column("payload").to_pylist()
    if OWN not in kinds:
        raise RuntimeError("a task was run again with its rows in another order; write the documents first")
    (ids, sizes), rest = _opened(payloads[kinds.index(OWN)], 2)
    ids, sizes = _ungapped(ids), sizes.astype(np.int64)
    keys = bytes(rest[: 16 * len(ids)])
    runs = [_ungapped(_opened(bytes(rest[16 * len(ids) :]), 1)[0][0])]
    runs += [_ungapped(_opened(x, 1)[0][0]) for k, x in zip(kinds, payloads) if k != OWN]
    runs = np.concatenate(runs).reshape(-1, 2)
    if not len(runs):
        return _SPANS.empty_table()
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    bounds = np.append(0, np.cumsum(sizes))
    start, top = runs[:, 0], np.maximum.accumulate(runs[:, 1] + length - 1)
    doc = np.searchsorted(bounds, start, "right") - 1
    new = np.ones(len(runs), bool)
    new[1:] = (start[1:] > top[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    doc, start, end = doc[first], start[first] - bounds[doc[first]], top[np.append(first[1:], len(runs)) - 1] - bounds[doc[first]]
    found, at = np.unique(doc, return_index=True)
    offsets = pa.array(np.append(at, len(doc)).astype(np.int32))
    columns = [pa.array(ids[found]), pa.array([keys[16 * i : 16 * i + 16] for i in found.tolist()], pa.binary())]
    columns += [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int64))) for v in (start, end)]
    return pa.table(columns, schema=_SPANS)


def _common_grams(docs: DataFrame, length: int, most_docs: int, one_of: int, count: int) -> np.ndarray:
    """Least grams of more than ``count`` documents of a sample, chosen by a hash of their texts: about ``most_docs``
    of them, or one of ``one_of`` where those are more. The sample is looked at until no gram is common that is not
    behind the others already, ``HOT_ROUNDS`` times at most.

    They change in which buckets strings meet, never the result.
    """
    n = docs.count()
    wanted = max(most_docs, n // one_of)
    part = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(min(1.0, wanted / max(n, 1)) * (1 << 30)) + 1
    some = checkpointed(docs.where(part).dropDuplicates(["key"]).select("text"))
    hot, room = np.empty(0, np.uint32), min(MOST_HOT, wanted // 2)
    for _ in range(HOT_ROUNDS):
        counts = some.mapInArrow(_grams_of(length, hot), "gram long").groupBy("gram").count()
        common = counts.where((F.col("count") > count) & (F.col("gram") < int(_HOT)))
        found = common.orderBy(F.desc("count"), "gram").limit(room - len(hot)).collect()
        hot = np.union1d(hot, np.array([r["gram"] for r in found], np.uint32))
        if not found or len(hot) >= room:
            break
    return hot


def _grams_of(length: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                raw = np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), np.uint8)
                yield pa.record_batch([pa.array(np.unique(stretches(raw, np.array([len(raw)]), length, hot)[2]).astype(np.int64))], names=["gram"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, at_once: int = SORTED_AT_ONCE) -> DataFrame:
    """What is repeated in each document, and what is left.

    Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that are left), n_passages (spans of 50
    words or more), starts and ends (the maximal removed runs, in bytes). Null and empty texts have 0 bytes. A null
    id counts as larger than every other, so it is never the smaller one; rows of one id do not remove each other's
    strings, and repeated rows have equal results; ids of both -2^63 and 2^63-1 can't be told from null. Long texts are cut like others; an empty table gives an empty
    result; other columns of ``docs`` are not read. ``length`` is 16 at least. A task that is run again must meet its rows in
    the same order, as rows of files and checkpoints are: write rows of a shuffle first. A block of text is named by a
    hash of its rows, so answers are never taken for another block's; those for a block that is no more raise an error.
    """
    if length < 16:
        raise ValueError("strings of fewer than 16 bytes are not supported")
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    n_bytes, largest = docs.agg(F.sum(F.octet_length(text).cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    n_bytes = n_bytes or 0
    # ids move down by one where the largest one has the number that stands for a null id
    down = int(largest == _NO_ID)
    doc_id = F.coalesce(F.col("doc_id").cast("long") - down, F.lit(_NO_ID))
    whole = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key"))
    n_buckets = max(shuffle_partitions(spark), -(-int(3.5 * n_bytes) // bucket_bytes))
    hot = _common_grams(whole, length, HOT_DOCS, HOT_ONE_OF, HOT_COUNT)

    def send(batches):
        for texts in _Texts().blocks(batches, block_bytes):
            yield from _cut(texts, length, n_buckets, hot, _name(*texts[:2]))

    sent = whole.mapInArrow(send, _ddl(_SENT))
    answers = sent.repartition(min(n_buckets, MOST_PARTITIONS), "bucket").groupBy("bucket").applyInArrow(lambda table: _answers(table, length, at_once), _ddl(_SENT))
    spans = answers.groupBy("piece").applyInArrow(lambda table: _spans(table, length), "doc_id long, key binary, starts array<long>, ends array<long>")
    folder = scratch(spark, "spans")
    with shuffle_files_dropped(spark):  # the stretches need not lie beside the texts of the last step
        spans.dropDuplicates(["doc_id", "key"]).write.parquet(folder)
    joined = whole.join(spark.read.schema(spans.schema).parquet(folder), ["doc_id", "key"], "left").select("doc_id", "text", "starts", "ends")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, starts, ends in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("starts").to_pylist(), batch.column("ends").to_pylist()):
                kept, before, passages = hashlib.sha256(), 0, 0
                for a, b in zip(starts or (), ends or ()):
                    kept.update(text[before:a])
                    before = b
                    passages += b - a >= 2 * PASSAGE_WORDS - 1 and len(text[a:b].split()) >= PASSAGE_WORDS
                kept.update(text[before:])
                rows.append((len(text), sum(ends or ()) - sum(starts or ()), len(starts or ()), kept.hexdigest(), passages, starts or [], ends or []))
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64()] + [pa.list_(pa.int64())] * 2
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "starts", "ends"]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=names)

    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, starts array<long>, ends array<long>"
    return joined.mapInArrow(remove, result).withColumn("doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id") + down))
