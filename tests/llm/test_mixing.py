import math
import random
import re

import pytest
import xxhash

from pointloom.llm.mixing import mix, mixed_documents, targets


def test_targets_by_hand():
    got = targets([("a", 10), ("b", 100), ("c", 1000), (None, 90)])
    assert sum(got.values()) == pytest.approx(1200)
    assert got["a"] == 30 and got["b"] == 300 and got[None] == pytest.approx(870 / 4)
    assert targets([]) == {} and targets([("a", 0)]) == {"a": 0.0}


def test_mix_meets_targets_and_repeats(spark):
    rows = [(i, "w " * (1 + i * 7919 % 50), ["a", "b", "c", None][i % 4 if i % 3 else 0], "x") for i in range(4000)]
    rows += [(5000, None, "b", "x"), (5001, "", "b", "x"), (5002, "z z " * 4000, "c", "x"), (5003, "same", "b", "x"), (5003, "same", "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    got = mix(df, bins=16).collect()
    assert len(got) == len(rows)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in rows}
    total = {}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        total.setdefault(r["source"], [0, r["target"], r["source_size"]])[0] += r["taken"]
    want = targets([(s, v[2]) for s, v in total.items()])
    for s, (taken, target, _) in total.items():
        assert target == pytest.approx(want[s]) and abs(taken - target) <= 4000
    for bins, parts in ((16, 3), (4096, 7)):
        again = mix(df.repartition(parts), bins=bins).collect()
        assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)
    assert mixed_documents(df).count() == sum(r["copies"] for r in got)
    assert mixed_documents(df).columns == df.columns
    assert mix(df.limit(0)).count() == 0


def _factor(sizes, target, most=3):
    """The factor k at which sum(min(most, k * log1p(n)) * n) is the target, by bisection."""
    low, high = 0.0, 1e9
    for _ in range(300):
        k = (low + high) / 2
        low, high = (k, high) if sum(min(most, k * math.log1p(n)) * n for n in sizes) < target else (low, k)
    return high


def test_sample_against_brute_force(spark):
    rng, rows = random.Random(5), []
    for i in range(900):
        rows.append((i, "w " * int(rng.paretovariate(0.9) * 4 % 700), rng.choice(["a", "b", "c", "c", "c", None])))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mix(df, bins=8).collect()}
    by = {}
    for i, t, s in rows:
        by.setdefault(s, []).append((i, len(t.split())))
    goal = targets([(s, sum(n for _, n in d)) for s, d in by.items()])
    for s, found in by.items():
        k = _factor([n for _, n in found], goal[s])
        wanted = {i: min(3.0, k * math.log1p(n)) if n else 0.0 for i, n in found}
        assert all(got[i]["expected"] == pytest.approx(wanted[i], abs=1e-6) for i in wanted)
        whole = {i: math.floor(wanted[i] + 1e-9) for i in wanted}
        left = goal[s] - sum(whole[i] * n for i, n in found)
        ranks = []
        for i, n in found:
            p = wanted[i] - whole[i]
            if p > 1e-9:
                # the uniform number of the row, from the hash that the operator gives it
                h = spark_hash(got[i]["_row"])
                u = ((h >> 11) + 0.5) * 2.0**-53
                ranks.append(((u / (1 - u)) / (p / (1 - p)), i, n))
        copies, words = dict(whole), 0
        for _, i, n in sorted(ranks):
            if words + n / 2 > left or words >= left:
                break
            copies[i] += 1
            words += n
        off = goal[s] - sum(copies[i] * n for i, n in found)
        turns = [(abs(off - (n if copies[i] == whole[i] else -n)), rank, i) for rank, i, n in ranks if n]
        if turns and min(turns)[0] < abs(off):
            i = min(turns)[2]
            copies[i] = whole[i] + (copies[i] == whole[i])
        assert {i: got[i]["copies"] for i in copies} == copies, s


def spark_hash(row):
    """Spark's xxhash64 of a long and the integer 42, unsigned."""
    one = xxhash.xxh64_intdigest(row.to_bytes(8, "little", signed=True), 42)
    return xxhash.xxh64_intdigest((42).to_bytes(4, "little"), one)


def test_copies_follow_their_expectation(spark):
    rows = [(i, "w " * (2 if i % 4 < 2 else 60), "a" if i % 2 else "b") for i in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in (1, 2):
        found = mix(df, seed=seed).collect()
        for source in "ab":
            for size in (2, 60):
                some = [r for r in found if r["source"] == source and r["size"] == size]
                want = some[0]["expected"]
                assert abs(sum(r["copies"] for r in some) / len(some) - want) < 0.05
                assert {r["copies"] for r in some} <= {math.floor(want), math.ceil(want)}


def test_more_sources_than_are_broadcast(spark):
    rows = [(i, "w " * (i % 13), None if i % 11 == 0 else f"s{i % 11}é") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain = lambda d: sorted((r["doc_id"], r["copies"], round(r["target"], 6)) for r in d.collect())
    assert plain(mix(df)) == plain(mix(df, max_sources=2))


def test_rows_that_share_a_hash_keep_their_copies(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (2, "a b", "s"), (None, "c", "t"), (None, "c", "t"), (None, None, None)], "doc_id long, text string, source string")
    taken = {}
    for r in mix(df).collect():
        taken[r["doc_id"], r["source"]] = taken.get((r["doc_id"], r["source"]), 0) + r["copies"]
    got = {}
    for r in mixed_documents(df).collect():
        got[r["doc_id"], r["source"]] = got.get((r["doc_id"], r["source"]), 0) + 1
    assert got == {k: n for k, n in taken.items() if n}
