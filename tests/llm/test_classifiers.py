import random
import zlib

import numpy as np
import pytest

from pointloom.llm import quality, toxicity

CLEAN = "the garden is green and the river runs slowly to the sea".split()


def _docs(n=400, seed=3):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lines = [" ".join(rng.choices(CLEAN, k=8)) + "." for _ in range(rng.randrange(1, 12))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words = lines[rng.randrange(len(lines))].split()
            k = rng.randrange(len(lines))
            words[rng.randrange(len(words))] = rng.choice(["vilewort", "nastyfool"])
            lines[k] = " ".join(words)
        good = int(rng.random() < 0.7)
        text = "\n".join(lines)
        rows.append((i, text if good else " ".join(w + "%%%" for w in text.split()), toxic, good))
    return rows


@pytest.mark.parametrize("module,label,query", [(toxicity, 2, "toxicity_scores"), (quality, 3, "quality_scores")])
def test_held_out_accuracy_and_odd_rows(spark, module, label, query):
    rows = _docs()
    docs = [(i, t, "src", "x") for i, t, *_ in rows] + [(9000, "", None, None), (9001, None, None, None), (None, "the sea.", None, None), (9002, "word " * 60_000, "s", "x"), (3, rows[3][1], "src", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, score string")
    name = "toxic" if label == 2 else "quality"
    labels = spark.createDataFrame([(r[0], r[label]) for r in rows] + [(None, 1), (5, None)], f"doc_id long, {name} int")
    got = getattr(module, query)(df, labels).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(by[r[0]]["held_out"] for r in out) and sum(r["held_out"] for r in got if r["doc_id"] is not None and r["doc_id"] < 400) in (len(out), len(out) + 1)
    assert np.mean([by[r[0]]["predicted"] == r[label] for r in out]) > 0.9
    assert by[9000]["score"] == by[9001]["score"]
    again = getattr(module, query)(df.repartition(3), labels).collect()
    assert sorted((str(r["doc_id"]), r["score"]) for r in again) == sorted((str(r["doc_id"]), r["score"]) for r in got)


def test_no_labels_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.toxicity_scores(df, none).first()["predicted"] == 0
    assert quality.quality_scores(df, none).first()["score"] == pytest.approx(0.5)
    assert quality.quality_scores(df.limit(0), none).count() == 0
    assert toxicity.toxicity_scores(df.limit(0), none).count() == 0


def test_offending_sentence_is_located(spark):
    rows = _docs()
    bags = [toxicity.features(t)[1:] for _, t, _, g in rows]
    model = toxicity.fit_rows(bags, np.array([r[2] for r in rows]))
    text = "Émile saw the sea. The river is a vilewort and green!\nThe garden."
    spans, flat, starts = toxicity.features(text)
    worst = toxicity.char_span(text, spans[int(model.sentence_scores(flat, starts).argmax())])
    assert text[slice(*worst)] == " The river is a vilewort and green!"
    assert model.score(*toxicity.features("")[1:]) == 0


def test_dual_coordinate_descent_meets_its_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    y = (x[:, 0] + 0.3 * rng.normal(size=60) > 0).astype(float)
    rows, cost = [np.arange(5)] * 60, 0.7
    w, b = quality.dual_coordinate_descent(rows, list(x), y, 5, cost, epochs=3000)
    sign = np.where(y > 0, 1, -1)
    loss = lambda v: 0.5 * v @ v + cost * np.maximum(0, 1 - sign * (x @ v[:5] + v[5])).sum()
    best = loss(np.append(w, b))
    assert all(best <= loss(np.append(w, b) + 0.02 * rng.normal(size=6)) + 1e-3 for _ in range(300))
