import hashlib
import random

import numpy as np
import pytest

from pointloom.llm import suffix_dedup
from pointloom.llm.suffix_dedup import COVERS, repeated_spans


@pytest.mark.parametrize("period", COVERS)
def test_covers(period):
    assert {(a - b) % period for a in COVERS[period] for b in COVERS[period]} == set(range(period))


def _brute(rows, length):
    order = lambda i: (i is None, i or 0)
    low = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            low[s] = min(low.get(s, (2, 0)), order(i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if low[raw[k : k + length]] < order(i):
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _got(df, **options):
    rows = repeated_spans(df, **options).collect()
    for r in rows:
        assert sum(b - a for a, b in zip(r["starts"], r["ends"])) == r["n_removed"] and len(r["starts"]) == r["n_spans"]
    return sorted((tuple(r)[:5] for r in rows), key=str)


def _rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abé ", k=rng.randrange(1, 9)))
    pool = ["".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(25)]
    rows = []
    for i in rng.sample(range(1000), 60):
        parts = [rng.choice(pool) if rng.random() < 0.6 else "".join(word() for _ in range(20)) for _ in range(rng.randrange(5))]
        rows.append((i, "".join(parts)))
    rows += [(2000, "a" * 300), (2001, "b" + "a" * 200 + "b"), (2002, "a" * 49), (2003, ""), (2004, None), (None, "a" * 60 + "q"), (None, "a" * 60 + "q")]
    rows += [(2005, rows[3][1]), (rows[5][0], rows[5][1] + rows[6][1]), (2006, "x".join(pool)), (2007, "x".join(pool)[3:]), (2008, "y " * 60_000)]
    return rows


@pytest.mark.parametrize("seed,length", [(1, 50), (2, 50), (3, 30)])
def test_spans_against_brute_force(spark, seed, length):
    rows = _rows(seed)
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, block string, n_bytes int")
    assert _got(df, length=length) == _brute(rows, length)
    if seed == 1:
        assert _got(df.repartition(5), length=length, block_bytes=2000, bucket_bytes=5000, at_once=100) == _brute(rows, length)
        assert repeated_spans(df.limit(0)).count() == 0


def test_common_lines_and_their_grams(spark):
    rng = random.Random(6)
    line = "".join(rng.choices("abcdefgh ", k=90))
    rows = [(i, "".join(rng.choices("abcdefgh ", k=150)) + line[i % 3 :] + "".join(rng.choices("abcdefgh ", k=150))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    keyed = df.selectExpr("text", "unhex(md5(text)) AS key")
    hot = suffix_dedup._common_grams(keyed, 50, 2000, 500, 20)
    assert 0 < len(hot) < 60
    for text in (line, rows[0][1]):
        raw = np.frombuffer(text.encode(), np.uint8)
        plain, ordered = (suffix_dedup.stretches(raw, np.array([len(raw)]), 50, h)[2] for h in (hot[:0], hot))
        assert set(plain) & set(hot) and not set(ordered) & set(hot)
    assert _got(df) == _brute(rows, 50)


def test_texts_larger_than_a_block(spark):
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 123, 9_000_000, dtype=np.uint8)
    other = raw.copy()
    places = [100, 1_000_000, 8_388_600, 8_999_900]
    other[places] = 32
    assert len(raw) > suffix_dedup.BLOCK_BYTES
    df = spark.createDataFrame([(2, other.tobytes().decode()), (1, raw.tobytes().decode()), (3, "x" + other.tobytes().decode()[:100])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in repeated_spans(df).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == len(raw) - 4 and got[2]["n_spans"] == 5
    assert got[2]["starts"] == [0, *(p + 1 for p in places)] and got[2]["ends"] == [*places, len(raw)]
    assert got[3]["n_removed"] == 100 and got[3]["starts"] == [1] and got[3]["n_passages"] == 0


def test_the_largest_id_is_no_missing_one(spark):
    most, text = (1 << 63) - 1, "all that is said here is said again in a longer text of more than fifty bytes"
    df = spark.createDataFrame([(most, text), (None, text), (5, "short")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in repeated_spans(df).collect()}
    assert got == {most: 0, None: len(text), 5: 0}


def test_a_gram_in_fewer_than_one_of_a_hundred_documents(spark, monkeypatch):
    rng = random.Random(8)
    word = "a phrase of forty bytes in nine of a 1000"
    text = lambda i: "".join(rng.choices("abcdefgh ", k=60)) + (word if i % 111 == 0 else "") + "".join(rng.choices("abcdefgh ", k=60))
    rows = [(i, text(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keyed = df.selectExpr("text", "unhex(md5(text)) AS key")
    few, many = (suffix_dedup._common_grams(keyed, 50, 100, one_of, 20) for one_of in (500, 1))
    assert len(few) < len(many)  # the share of a sample grows with the table
    raws = [np.frombuffer(t.encode(), np.uint8) for i, t in rows if i % 111 == 0]
    for hot, most in ((few, len(raws)), (many, 20)):
        held = [set(suffix_dedup.stretches(r, np.array([len(r)]), 50, hot)[2].tolist()) for r in raws]
        largest = max(sum(g in h for h in held) for g in set().union(*held))
        assert largest <= most and (hot is few) == (largest > 20), largest
    monkeypatch.setattr(suffix_dedup, "MOST_PARTITIONS", 2)
    again = rows[:300] + [(5000 + i, t[7:]) for i, t in rows[:300]]
    assert _got(spark.createDataFrame(again, "doc_id long, text string"), bucket_bytes=2000, block_bytes=4000) == _brute(again, 50)


def test_blocks_are_named_by_their_rows():
    ids, keys = np.array([3, 5]), bytes(32)
    name = suffix_dedup._name(ids, keys)
    assert name == suffix_dedup._name(ids.copy(), keys) and 0 <= name < 1 << 63
    assert len({name, suffix_dedup._name(ids[::-1], keys), suffix_dedup._name(ids, bytes(31) + b"1")}) == 3
