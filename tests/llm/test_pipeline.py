import random
import re
from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
from pointloom.llm import mixing, pieces, quality, simhash

WORDS = [a + b for a in ("riv", "gard", "ston", "tow", "lan", "gre", "slo") for b in ("er", "en", "e", "ns", "ds", "wly")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows = random.Random(8), []
    for i in range(300):
        text = " ".join(rng.choices(WORDS, k=rng.randrange(30, 90))).capitalize() + "."
        good = int(rng.random() < 0.75)
        rows.append((i, text if good else text.upper().replace(" ", "!! "), f"src{i % 3}", good))
    rows += [(300 + k, rows[k][1].replace(" ", "\n"), "src1", rows[k][3]) for k in range(40)]
    rows += [(400 + k, rows[k][1] + " end", "src2", rows[k][3]) for k in range(60)]
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], r[3], 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    stages = [f for _, f in corpus_pipeline.STAGES]

    one = stages[0](spark, docs, folder)
    kept = {i for i, r in rows.items() if model.score(quality.features(r["text"])) >= 0.3}
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == kept and 0 < len(kept) < len(rows)

    two = stages[1](spark, one, folder)
    groups = {}
    for i in kept:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", rows[i]["text"]), []).append(i)
    stay = {min(g, key=lambda i: (-len(rows[i]["text"]), i)) for g in groups.values()}
    assert two.columns == columns and sorted(r["doc_id"] for r in two.collect()) == sorted(stay) and len(stay) < len(kept)

    three = stages[2](spark, two, folder)
    fps, label = {i: simhash.fingerprint(rows[i]["text"]) for i in stay}, {i: i for i in stay}
    for i in sorted(stay):
        for j in sorted(stay):
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 4 and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    left = set(label.values())
    assert three.columns == columns and sorted(r["doc_id"] for r in three.collect()) == sorted(left) and len(left) < len(stay)

    four = stages[3](spark, three, folder)
    got = Counter(r["doc_id"] for r in four.collect())
    assert four.columns == columns and max(got.values()) <= 3
    size = lambda i: len(rows[i]["text"].split())
    sizes = Counter()
    for i in left:
        sizes[rows[i]["source"]] += size(i)
    for s, target in mixing.targets(list(sizes.items())).items():
        assert abs(sum(n * size(i) for i, n in got.items() if rows[i]["source"] == s) - target) <= 90

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    final = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r["doc_id"] for r in final) == got
    assert all(r["ids"] == lib.encode(rows[r["doc_id"]]["text"]) for r in final)


def test_stages_take_odd_rows(spark, folder):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "a", 0), (1, "", None, "a", 0), (2, "word " * 50_000, "en", None, 3), (3, "a b", "en", "b", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
        out = stage(spark, docs, folder)
        assert name == "encoding" or out.columns == docs.columns
        got[name] = Counter(r["doc_id"] for r in out.collect())
    # no labels of its own ids are known, so the classifier keeps all or none of the texts that look alike
    assert got["quality"][None] == (got["quality"][1] > 0) and got["quality"][1] in (0, 2)
    assert got["exact_dedup"] == {1: 1, 2: 1, 3: 1} and got["near_dedup"] == {1: 2, 2: 1, 3: 1}
    assert got["mixing"][None] == got["mixing"][1] == 0 and got["mixing"][2] in (0, 1, 2, 3) and got["mixing"][3] in (0, 1, 2, 3)
    assert got["encoding"] == {None: 1, 1: 2, 2: 1, 3: 1}
