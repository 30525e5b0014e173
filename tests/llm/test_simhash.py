import itertools
import random

import numpy as np
import pytest
import xxhash

from pointloom.llm import simhash as sh


def _slow(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_against_a_slow_one():
    rng = random.Random(1)
    for text in ["", " \t\n", "One", "a B c", "a b c d", "a b c d e", "É\xa0é x\x0by z W w", "x " * 40_000] + [" ".join(rng.choices(["Aa", "b", "É", "d\x1cd", "\t"], k=rng.randrange(30))) for _ in range(200)]:
        assert sh.fingerprint(text) == _slow(text)


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_masks_cover_every_difference(radius):
    masks, rng = sh.covering_masks(radius), random.Random(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    some = itertools.combinations(range(64), radius) if radius < 3 else (rng.sample(range(64), radius) for _ in range(20_000))
    for bits in some:
        diff = sum(1 << b for b in bits)
        assert any(not m & diff for m in masks)


def _brute(fps, radius):
    label = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius and label[i] != label[j]:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return label


@pytest.mark.parametrize("chunk", [8, 4096])
def test_components_against_all_pairs(spark, chunk):
    rng, fps = random.Random(7), []
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 30)):
            fps.append(x)
            for b in rng.sample(range(64), rng.randrange(0, 7)):
                x ^= 1 << b
    fps = list(dict.fromkeys(fps + [0, 1, (1 << 64) - 1]))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    roots = {r["node"]: r["root"] for r in sh.components(sh.links(df, 4, chunk)).collect()}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    want, got = _brute(fps, 4), {}
    for s, w in zip(signed, want):
        got.setdefault(roots.get(s, s), set()).add(w)
    assert all(len(v) == 1 for v in got.values()) and len(got) == len(set(want))


def test_components_of_hubs_and_chains(spark):
    # a hub of more links than a key may have before its rows are dealt out, a chain to a second hub, and a chain apart
    edges = [(5000, i) for i in range(1, 3001)] + [(i, i + 1) for i in range(5000, 5040)] + [(5040, i) for i in range(6000, 7500)]
    edges += [(i, i + 1) for i in range(-40, -20)] + [(5000, 5000), (2, 5000)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in sh.components(df).collect()}
    assert got == {x: -40 if x < 0 else 1 for e in edges for x in e}
    assert sh.components(df.limit(0)).count() == 0


def test_documents_with_odd_rows(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choices(["sea", "land", "moon", "sun", "tree"], k=400)) for _ in range(6)]
    texts = base + [b.replace("sea", "Sea") for b in base] + [b + " end" for b in base] + ["", None, "  ", "moon"]
    rows = [(i, t, "x", 0) for i, t in enumerate(texts, 10)] + [(None, base[0], None, 1), (10, base[0], "x", 0), (99, "sun " * 100_000, "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id long")
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in sh.near_duplicates(df).collect()]
    fps = [sh.fingerprint(r[1] or "") for r in rows]
    label = _brute(fps, 4)
    low = {k: min((r[0] for r, x in zip(rows, label) if x == k and r[0] is not None), default=None) for k in label}
    want = [(r[0], f"{f:016x}", low[k]) for r, f, k in zip(rows, fps, label)]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sh.near_duplicates(df.limit(0)).count() == 0


def test_edges_that_a_batch_connects_need_no_round(spark, monkeypatch):
    def joined(*args):
        raise AssertionError("a round of star steps")

    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95)]
    df = spark.createDataFrame(edges, "a long, b long").coalesce(1)
    monkeypatch.setattr(sh, "spread_join", joined)
    got = {r["node"]: r["root"] for r in sh.components(df).collect()}
    assert got == {k: 0 for k in range(41)} | {90: 90, 95: 90, 100: 90}
    monkeypatch.undo()
    parted = {r["node"]: r["root"] for r in sh.components(df.repartition(7)).collect()}
    assert parted == got
