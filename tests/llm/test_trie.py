import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from pointloom.llm import trie
from pointloom.llm.queries import QUERIES
from tests.oracle import DATA, connection

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _slow(rows):
    """The contract's rows by a dictionary of prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(ts, key=lambda x: x[0])] for c, ts in own.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:])
    nodes = {}
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(ts[:d], []).append(c)
    children, leaves, saved = {p: 0 for p in nodes}, {p: 0 for p in nodes}, {p: 0 for p in nodes}
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    for p, members in nodes.items():
        w = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(members) - 1) * w
            leaves[p[:d]] += children[p] == 0
    sha = lambda cs: hashlib.sha256(",".join(map(str, sorted(cs))).encode()).hexdigest()
    return sorted(
        ((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha([c for c in m if full[c] == p])) for p, m in nodes.items()), key=str
    )


def _got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, b"k") for r in rows], "conv_id long, turn int, role string, text string, depth int, key binary")


def _random_rows(rng, n, texts, longest):
    rows, kept = [], []
    for c in rng.sample(range(3 * n), n):
        if kept and rng.random() < 0.5:
            ts = list(rng.choice(kept))[: rng.randrange(longest)]
        else:
            ts = []
        ts += [rng.choice(texts) for _ in range(rng.randrange(0 if ts else 1, longest))]
        kept.append(ts)
        rows += [(c, k, rng.choice("ua") if rng.random() < 0.1 else "ua"[k % 2], t) for k, t in enumerate(ts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,shard_turns", [(1, 20), (2, 60), (3, 1_000_000)])
def test_nodes_against_a_dictionary(spark, seed, shard_turns):
    rng = random.Random(seed)
    rows = _random_rows(rng, 120, ["a", "b c", "d  e\tf", ""], 7)
    assert _got(trie.conversation_trie(_frame(spark, rows), shard_turns)) == _slow(rows)


def test_equal_conversations_over_many_shards(spark):
    rows = [(c, k, "u", f"turn {k}") for c in range(300) for k in range(5)] + [(c, k, "u", f"turn {k}") for c in range(300, 330) for k in range(9)] + [(400 + c, 0, "u", f"turn {c}") for c in range(20)]
    assert _got(trie.conversation_trie(_frame(spark, rows), 40)) == _slow(rows)


def test_long_conversations_beyond_a_block_of_columns(spark):
    rows = [(c, k, "u", f"t{k % 7}" if k < 90 + c else f"own {c} {k}") for c in range(12) for k in range(130 - c)] + [(50, 0, "u", "t0")]
    for shard_turns in (100, 1_000_000):
        assert _got(trie.conversation_trie(_frame(spark, rows), shard_turns)) == _slow(rows)


def test_odd_rows(spark):
    rows = [
        (0, None, "u", "first"), (0, 3, None, "x y"), (0, 5, "u", None), (7, 0, "u", "alone"), (8, 0, "u", "alone"), (21, 0, "u", "no first one"), (22, 0, "u", "a"), (23, 0, "u", "a"), (24, 0, "u", "a"),
        (-3, 0, "u", "negative"), (-20, 0, "u", "z"), (None, 0, "u", "nobody's"), (40, 0, "u", "again"), (40, 0, "u", "again"), (41, 0, "", "u"), (42, 0, "u", ""), (43, 0, "u", "w " * 30_000),
    ]
    assert _got(trie.conversation_trie(_frame(spark, rows), 5)) == _slow(rows)
    assert trie.conversation_trie(_frame(spark, rows).limit(0)).count() == 0


def test_whole_table_against_a_dictionary(spark):
    rows = connection().execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert _got(QUERIES["op13_prefix_trie"](spark, DATA)) == _slow(rows)


def test_matrix_blocks_agree():
    rng = np.random.default_rng(2)
    lengths = rng.integers(0, 12, 200)
    sequences = sorted([rng.integers(0, 2, n).tolist() for n in lengths])
    lengths = np.array([len(s) for s in sequences])
    flat = np.array([x for s in sequences for x in s])
    one, two = (trie.ShardTrie(flat, lengths, flat + 1, np.arange(200), columns) for columns in (3, 32))
    for name in ("n", "conv", "w", "parent", "row", "depth", "children", "leaves", "saved", "end_of", "first", "last"):
        assert np.array_equal(getattr(one, name), getattr(two, name)), name
