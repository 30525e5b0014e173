import math
import random

import numpy as np

from pointloom.llm.topk import block_at_a_time, bounds, quantised, top_k


def _brute(rows, k, every=50):
    usable = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in usable if i % every == 0}):
        query = min(v for i, v in usable if i == q)
        scores = sorted((-sum(a * b for a, b in zip(query, v)), i) for i, v in usable if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return out


def test_top_k_against_brute_force(spark):
    rng, nan = random.Random(2), float("nan")
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, -0.3]) for _ in range(4)]) for i in range(-60, 700)]  # many ties
    rows += [(800, None), (801, [1.0, None]), (802, [nan, 1.0]), (803, [float("inf")]), (850, []), (900, [0.5]), (None, [1.0]), (7, rows[3][1]), (100, [9.0, 9.0]), (950, [1e9, 1e9, 1e9, -1e9])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, rank string, score int")
    v = quantised(df)
    for options in ({"block_rows": 16, "cell_vectors": 100, "cell_queries": 5}, {"block_rows": 2, "cell_vectors": 30, "cell_queries": 3, "maxima_blocks": 60, "floor_blocks": 1}, {}):
        got = top_k(v, v.where("vec_id % 50 = 0"), 5, **options).collect()
        assert sorted(map(tuple, got)) == _brute(rows, 5)
    assert top_k(v.limit(0), v.limit(0)).count() == 0
    few = v.where("vec_id in (50, 51, 52)").dropDuplicates(["vec_id"])
    assert top_k(few, few.where("vec_id = 50")).count() == 2


def test_blocks_below_the_bound_are_not_scored():
    blocks = [(np.arange(4) + 10 * k, np.full((4, 2), k)) for k in range(10)]
    ids, scores, scored = block_at_a_time(blocks, np.array([1, 1]), -1, 3, np.array([2 * k for k in range(10)]))
    assert ids.tolist() == [90, 91, 92] and scores.tolist() == [18] * 3 and scored == 1
    ids, _, scored = block_at_a_time(blocks[:9], np.array([1, 1]), -1, 3, np.array([2 * k for k in range(9)]), floor=18)
    assert not len(ids) and scored == 0


def test_bounds_are_not_below_scores():
    rng = np.random.default_rng(4)
    for size in (9, 1 << 30):
        q, rows = rng.integers(-size, size, (6, 8)), rng.integers(-size, size, (5, 40, 8))
        got = bounds(q, rows.max(axis=1), rows.min(axis=1))
        exact = [[max(sum(int(a) * int(b) for a, b in zip(x, r)) for r in block) for block in rows] for x in q]
        assert all(b >= e for bs, es in zip(got.tolist(), exact) for b, e in zip(bs, es))
        if size < 1 << 20:
            assert (got == np.maximum(q, 0) @ rows.max(axis=1).T + np.minimum(q, 0) @ rows.min(axis=1).T).all()


def test_only_pairs_whose_bound_reaches_the_floor_meet(spark):
    # each query's own block holds k rows of its score or more: no block meets a query twice, few meet at all
    from pointloom.llm import topk

    rows = [(i, [float(i // 64 == d) for d in range(8)]) for i in range(512)]
    v = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    met = spark.sparkContext.accumulator(0)
    before = topk._scored

    def counting(k, known):
        run = before(k, known)

        def counted(vectors, asked):
            met.add(len(vectors) * len(asked))
            return run(vectors, asked)

        return counted

    topk._scored = counting
    try:
        got = top_k(v, v.where("vec_id % 64 = 0"), 3, block_rows=64, cell_vectors=64, floor_blocks=1).collect()
    finally:
        topk._scored = before
    assert sorted(map(tuple, got)) == _brute([(i, r) for i, r in rows], 3, 64)
    assert met.value == 8  # of 64 pairs of a block and a query
