import hashlib
import random
import re

from pointloom.llm.exact_dedup import CuckooIndex, apply_changes, build_index, digests, exact_dedup, kept_documents


def _digest(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_index_against_a_dict():
    rng, index, live = random.Random(1), CuckooIndex(2), {}
    for step in range(6000):
        k = rng.randrange(1500)
        if rng.random() < 0.6:
            if index.get(_digest(k)) is None:
                assert k not in live
                index.insert(_digest(k), step)
                live[k] = step
        else:
            assert index.delete(_digest(k)) == (k in live)
            live.pop(k, None)
        assert index.get(_digest(k)) == live.get(k)
    assert index.resizes and index.size == len(live)
    assert {d for d, _ in index.items()} == {_digest(k) for k in live}


def test_exact_dedup_against_brute_force(spark):
    texts = {1: "a b\tc", 2: "abc", 3: " a  b c ", 4: None, 5: "", 6: "\x0b\x0c", 7: "é" * 3000, 8: "é " * 3000, 9: "x", 10: "a bc"}
    rows = [(i, t, "x", i) for i, t in texts.items()] + [(None, "x", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, group_size long")
    got = {r["doc_id"]: r for r in exact_dedup(df).collect()}
    bare = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in texts.items()}
    for i, t in texts.items():
        group = [j for j in texts if bare[j] == bare[i]]
        best = min(group, key=lambda j: (-len(texts[j] or ""), j))
        assert got[i]["keep_id"] == best and got[i]["kept"] == (best == i)
        assert got[i]["group_size"] == len(group) + (bare[i] == "x")
        assert got[i]["text_sha256"] == hashlib.sha256(bare[i].encode()).hexdigest()
    assert not got[None]["kept"] and got[None]["keep_id"] == 9
    assert exact_dedup(df.limit(0)).count() == 0


def test_full_indexes_hot_digests_and_long_texts(spark, monkeypatch):
    from pointloom.llm import common, exact_dedup as module

    monkeypatch.setattr(module, "SHARD_ROWS", 40)
    monkeypatch.setattr(module, "OUT_ROWS", 7)
    rows = [(i, f"text {i % 97 if i % 3 else 0}") for i in range(3000)] + [(5000, "é " * 400_000), (5001, "é" * 400_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup(df).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(t.replace(" ", ""), []).append((-len(t), i))
    assert got == {i: (min(groups[t.replace(" ", "")])[1], len(groups[t.replace(" ", "")])) for i, t in rows}
    kept = sorted(r["doc_id"] for r in module.kept_documents(df).collect())
    assert kept == sorted(min(g)[1] for g in groups.values())
    table = spark.createDataFrame([(0, "hot", 2000), (1, "cold", 1)], "k long, name string, n long")
    joined = common.spread_join(spark.range(2001).selectExpr("CAST(id = 2000 AS long) AS k", "id"), table, "k", ["name"], "n", 2001)
    assert sorted((r["name"], r["id"]) for r in joined.collect()) == [("cold", 2000)] + [("hot", i) for i in range(2000)]


def test_changes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a a")], "doc_id long, text string")
    index = build_index(digests(docs))
    more = spark.createDataFrame([("delete", 1, 0, "b"), ("insert", 2, 9, "b"), ("insert", 1, 7, "c"), ("delete", 1, 0, "zz"), ("insert", 1, 0, "a")], "op string, seq int, doc_id long, text string")
    more = more.join(digests(more), "doc_id").where("true").select("op", "seq", "digest", "doc_id", "n_chars").dropDuplicates()
    got = {bytes(r["digest"]): r for r in apply_changes(index, more, 4).collect()}
    bit = lambda s: hashlib.sha256(s.encode()).digest()
    assert got[bit("b")]["keep_id"] == 9 and got[bit("b")]["group_size"] == 1
    assert got[bit("c")]["keep_id"] == 7 and bit("zz") not in got


def test_the_largest_id_is_no_missing_one(spark):
    most = (1 << 63) - 1
    rows = [(most, "a b"), (None, "ab"), (most, "c"), (None, "d"), (-most - 1, "e"), (3, "e"), (None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["text_sha256"][:8]): (r["keep_id"], r["kept"]) for r in exact_dedup(df).collect()}
    assert sorted(got.values(), key=str) == sorted([(most, True), (most, False), (most, True), (None, True), (-most - 1, True), (-most - 1, False), (-most - 1, False)], key=str)
    assert sorted((tuple(r) for r in kept_documents(df).collect()), key=str) == sorted([(most, "a b"), (most, "c"), (None, "d"), (-most - 1, "e")], key=str)
