import itertools
import random
import re

import numpy as np
import pytest

from pointloom.llm import minhash as mh
from pointloom.llm.queries import QUERIES
from tests.oracle import DATA, connection

COLUMNS = ["doc_id", "n_shingles", "component_id", "kept"]


def _slow_sets(texts, words=5):
    out = []
    for text in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return out


def _slow(rows, percent=85):
    """Rows (doc_id, text) by all pairs: doc_id, size, least id reachable, kept."""
    sets, label = _slow_sets([t for _, t in rows]), list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = len(sets[i]), len(sets[j])
        if not a or not b or label[i] == label[j] or 100 * min(a, b) < percent * max(a, b):
            continue
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (a + b - both):
            label = [label[i] if x == label[j] else x for x in label]
    low = {}
    for (doc_id, _), x in zip(rows, label):
        low[x] = min([i for i in (low.get(x), doc_id) if i is not None], default=None)
    return sorted(((d, len(s), low[x], d == low[x]) for (d, _), s, x in zip(rows, sets, label)), key=str)


def _got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def _family(rng, vocabulary, n_words, n_copies, edits):
    base = rng.choices(vocabulary, k=n_words)
    out = []
    for _ in range(n_copies):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(" ".join(words))
    return out


def test_signatures_estimate_similarity_with_less_variance_than_independent_places():
    rng = np.random.default_rng(3)
    for similarity, size in ((0.85, 400), (0.5, 60), (0.9, 19)):
        errors = []
        for _ in range(200):
            both = int(size * similarity)
            pool = rng.integers(0, 1 << 63, 2 * size - both, dtype=np.uint64)
            a, b = pool[:size], np.r_[pool[:both], pool[size:]]
            s = mh.signatures([a, b])
            errors.append((s[0] == s[1]).mean() - both / len(pool))
        true = int(size * similarity) / (2 * size - int(size * similarity))
        assert abs(np.mean(errors)) < 0.012
        assert np.std(errors) < 1.1 * np.sqrt(true * (1 - true) / 128)


def test_a_signature_is_the_least_over_all_elements_step_by_step():
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 2, 3, 40, 700)]
    want = np.full((len(sets), 128), np.iinfo(np.uint64).max, np.uint64)
    for k, s in enumerate(sets):
        for x in s:
            order = list(range(128))
            for j in range(128):
                z = int(mh._mixed(np.array([x]) + mh._golden(j + 1))[0])
                swap = j + ((z & 0xFFFFFFFF) * (128 - j) >> 32)
                order[j], order[swap] = order[swap], order[j]
                want[k, order[j]] = min(int(want[k, order[j]]), j << 32 | z >> 32)
    assert (mh.signatures(sets) == want).all()
    assert (mh.signatures([np.concatenate(sets)])[0] == want.min(axis=0)).all()


def test_elements_beyond_one_batch(monkeypatch):
    rng = np.random.default_rng(6)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (5, 0, 300, 90)]
    want = mh.signatures(sets)
    monkeypatch.setattr(mh, "STEP_ELEMENTS", 64)
    assert (mh.signatures(sets) == want).all()


@pytest.mark.parametrize("nodes", [4, 1024])
def test_components_against_all_pairs(spark, nodes):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(500)]
    texts = []
    for _ in range(14):
        texts += _family(rng, vocabulary, rng.choice([6, 12, 40, 120, 400]), rng.randrange(1, 14), rng.choice([0, 1, 2, 4]))
    texts += [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 60))) for _ in range(60)]
    texts += ["one", "ONE", "one two three", "x " * 9, "x " * 50, "Éa b c d e", "éa b c d e", "a\xa0b c d e f", "a b\x0bc\td e f"]
    rng.shuffle(texts)
    rows = [(k * 7 % 1000, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _got(mh.near_duplicates(df, chunk_nodes=nodes)) == _slow(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_a_large_cluster_in_chunks_keeps_links_between_chunks(spark, seed):
    # a family at the threshold, in which many pairs share bands without a link, in chunks of six
    rng = random.Random(seed)
    texts = _family(rng, [f"w{k}" for k in range(300)], 120, 90, 6)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = _got(mh.near_duplicates(df, chunk_nodes=6))
    assert got == _slow(rows)
    assert 1 < sum(r[3] for r in got) < 90


def test_whole_table_against_all_pairs(spark):
    rows = connection().execute("SELECT doc_id, text FROM documents").fetchall()
    assert _got(QUERIES["op11_minhash"](spark, DATA)) == _slow(rows)


def test_odd_rows(spark):
    long = " ".join(f"t{k}" for k in range(60_000))
    rows = [(3, None), (4, ""), (5, " \t\n"), (None, "a b c d e f"), (9, "A b c d e f"), (9, "A b c d e f"), (9, "other words of the same id"), (None, "alone alone"), (None, None), (8, long), (7, long + " end")]
    df = spark.createDataFrame([(i, t, "c", 1, "r") for i, t in rows], "doc_id long, text string, component_id string, node int, keys string")
    want = [(3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (None, 2, 9, False), (9, 2, 9, True), (9, 2, 9, True), (9, 2, 9, True), (None, 1, None, True), (None, 0, None, True), (8, 59996, 7, False), (7, 59997, 7, True)]
    assert _got(mh.near_duplicates(df)) == sorted(want, key=str)
    assert mh.near_duplicates(df.limit(0)).count() == 0
