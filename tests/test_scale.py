"""The forms for sets, bins, files and grids of any size, against slow ones."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import compare, joins, order_stats, resample, scans, smooth, spectral
from pointloom.operators import stats as st
from pointloom.operators import windows as wn
from pointloom.plans import workloads
from pointloom.sources import datasource, splits
from pointloom.sources import readers as rd
from pointloom.streaming import jobs
from tests.oracle import DATA


def _series(spark, n=90, seed=3):
    rng = random.Random(seed)
    rows = [(s, k, rng.choice([None, 0.0, 1.0, 2.5, -3.0]), rng.choice([10.0, 200.0, 350.0])) for s in (1, None) for k in range(n)]
    return spark.createDataFrame(rows, "set_id long, idx long, v double, a double")


def _rows(df):
    return sorted((tuple(None if isinstance(c, float) and np.isnan(c) else round(c, 9) if isinstance(c, float) else c for c in r) for r in df.collect()), key=str)


def test_scans_in_blocks_equal_whole_ones(spark):
    df = _series(spark)
    kinds = {
        "lag": {"p": "v"}, "last": {"l": "v"}, "before": {"b": "v"}, "ahead": {"h": "v"}, "sums": {"s": "v"},
        "since": {"r": ("v", F.col("v") == 1.0)}, "whole": {"n": F.count("v"), "least": F.min_by("idx", "v")},
    }
    assert _rows(scans.scanned(df, **kinds)) == _rows(scans.scanned(df, 7, **kinds))
    for f in (lambda b: wn.with_gaps_filled(df, "v", block=b), lambda b: wn.with_integral(df.withColumn("t", F.col("idx") * 0.5), "v", "t", resets=True, block=b), lambda b: wn.cropped(df, "v", b)):
        assert _rows(f(None)) == _rows(f(8))
    assert scans.scanned(df.limit(0), 7, sums={"s": "v"}).count() == 0


@pytest.mark.parametrize("n_mask", [1, 4, 70])
def test_convolution_in_blocks(spark, n_mask):
    rng = np.random.default_rng(n_mask)
    mask, v = rng.normal(size=n_mask), rng.normal(size=200)
    df = spark.createDataFrame([(1, k, None if k == 5 else float(x)) for k, x in enumerate(v)], "set_id long, idx long, v double")
    got = {r["idx"]: r["c"] for r in wn.convolved_in_blocks(df, {"c": "v"}, mask.tolist(), block=10).collect()}
    v[5] = (v[4] + v[6]) / 2
    for i in range(200):
        want = sum(m * v[min(max(i + j - n_mask // 2, 0), 199)] for j, m in enumerate(mask))
        assert got[i] is None if i == 5 else abs(got[i] - want) < 1e-9


def test_order_statistics_of_large_bins(spark):
    rng = random.Random(2)
    bins = {1: [rng.gauss(0, 1e9) for _ in range(900)], None: [5.0] * 300 + [rng.choice([1.0, 5.0, 6.0]) for _ in range(300)], 3: [float("inf"), float("-inf"), 0.0] * 40, 4: [2.0], 5: []}
    rows = [(k, x) for k, xs in bins.items() for x in [*xs, None, float("nan")]]
    df = spark.createDataFrame(rows, "k long, x double")
    ps = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r["k"]: (r["n"], r["q"]) for r in order_stats.quantiles(df, ["k"], "x", ps, 20, 8).collect()}
    assert got[5] == (0, None) and got[4] == (1, [2.0] * 5)
    for k in (1, None):
        assert got[k][0] == len(bins[k]) and np.allclose(got[k][1], np.quantile(bins[k], ps))
    assert got[3][1][2] == 0.0 and got[3][1][0] == float("-inf") and got[3][1][4] == float("inf")
    assert order_stats.quantiles(df.limit(0), ["k"], "x", ps).count() == 0


def test_order_statistics_take_as_many_steps_for_larger_bins(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(order_stats, "checkpointed", lambda df, f=order_stats.checkpointed: (steps.append(1), f(df))[1])
    rng = random.Random(6)
    for n in (100, 4000):
        xs = [[rng.gauss(0, 1) if rng.random() < 0.7 else 0.5 for _ in range(n)] for _ in range(3)]
        df = spark.createDataFrame([(k if k else None, x) for k, own in enumerate(xs) for x in own], "k long, x double")
        got = {r["k"]: (r["median"], r["adev"]) for r in order_stats.median_deviations(df, ["k"], "x", 2.0, 20, 8).collect()}
        for k, own in enumerate(xs):
            assert np.allclose(got[k or None], (np.median(own), 2 * np.median(np.abs(np.array(own) - np.median(own)))), atol=1e-12)
    assert len(steps) == 2 * 9  # whatever the bins' sizes


def test_robust_fit_over_tasks(spark):
    rng = np.random.default_rng(9)
    x = rng.uniform(0, 10, 120)
    y = 3 * x - 7 + rng.normal(size=120) * (rng.random(120) < 0.2) * 30
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)] + [(2, 1.0, 4.0), (2, 1.0, 6.0), (2, 1.0, 6.0)], "k long, x double, y double")
    got = {r["k"]: r for r in st.robust_fit(df, ["k"], "x", "y", most_rows=2).collect()}
    slope, intercept, deviation = st.robust_fit_arrays(x, y)
    assert np.allclose([got[1]["slope"], got[1]["intercept"], got[1]["deviation"]], [slope, intercept, deviation], atol=1e-6)
    assert (got[2]["slope"], got[2]["intercept"]) == (0.0, 6.0)


def test_shunting_inhibition_in_blocks(spark):
    df = _series(spark).where("set_id = 1")
    args = {"tau": 3.0, "dt": 1.0, "y": "a", "c": 0.5}
    df = df.withColumn("a", F.col("a") / 360)
    assert _rows(smooth.recursive_filters(df, "v", **args)) == _rows(smooth.recursive_filters_in_blocks(df, "v", block=8, **args))


def test_masks_longer_than_the_set(spark):
    df = spark.createDataFrame([(1, k, float(k + 1)) for k in range(4)], "set_id long, idx long, v double")
    got = [r["value"] for r in spectral.cyclic_convolution(df, "v", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]).orderBy("idx").collect()]
    want = [sum(m * [1, 2, 3, 4][(i - (j - 3)) % 4] for j, m in enumerate([1, 2, 3, 4, 5, 6])) for i in range(4)]
    assert np.allclose(got, want) and sorted(np.round(got)) == [44, 53, 55, 58]


def test_only_long_sets_are_dealt_over_tasks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(s, k, float(v)) for s, n in ((1, 12), (2, 7), (3, 90)) for k, v in enumerate(rng.normal(size=n))], "set_id long, idx long, v double")
    mask, seen, dealt = [0.2, 0.6, 0.1], [], spectral._long_transform
    monkeypatch.setattr(spectral, "_long_transform", lambda rows, counts, cells: seen.append({r["set_id"] for r in counts.collect()}) or dealt(rows, counts, cells))
    there = spectral.spectrum(df, "v").where("k <> 2")  # absent frequencies are 0
    for f in (lambda n: spectral.long_spectrum(df, "v", n), lambda n: spectral.long_inverse(there, cells=n), lambda n: spectral.long_cyclic_convolution(df, "v", mask, cells=n), lambda n: spectral.long_cyclic_convolution(df, "v", mask, True, n)):
        seen.clear()
        whole = _rows(f(90))
        assert not seen
        assert np.allclose(whole, _rows(f(12)), atol=1e-7) and seen and all(s == {3} for s in seen)


def test_null_groups_meet(spark):
    q = spark.createDataFrame([(None, 2.0), (1, 2.0)], "g long, v double")
    refs = spark.createDataFrame([(None, 1.0), (None, 5.0), (1, 3.0)], "g long, v double")
    got = {r["g"]: (r["lower"], r["upper"]) for r in joins.bracket(q, refs, "v", by=["g"], spread=True).collect()}
    assert got == {None: (1.0, 5.0), 1: (None, 3.0)}
    places = refs.select("g", F.col("v").alias("x"), F.lit(0.0).alias("y"), F.monotonically_increasing_id().alias("idx"))
    near = {r["g"]: r["distance"] for r in joins.nearest(q.select("g", F.col("v").alias("x"), F.lit(0.0).alias("y")), places, ["g"]).collect()}
    assert near == {None: 1.0, 1: 1.0}


def test_segments_of_any_length(spark):
    rng = random.Random(5)
    t = [(k, rng.uniform(-50, 50)) for k in range(300)] + [(999, None)]
    table = [(k, s, s + n) for k, (s, n) in enumerate((rng.uniform(-60, 60), rng.choice([0.0, -1.0, 1e-6, 0.3, 4.0, 4.0, 120.0, 1e6])) for _ in range(60))]
    df, segments = spark.createDataFrame(t, "k long, t double"), spark.createDataFrame(table, "segment long, start double, end double")
    got = sorted((r["k"], r["segment"]) for r in joins.in_segments(df, "t", segments, 40).collect())
    assert got == sorted((k, s) for k, x in t if x is not None for s, a, b in table if a <= x < b)
    assert joins.in_segments(df, "t", segments.limit(0)).count() == 0


def test_missing_values_are_no_change(spark, tmp_path):
    rows = [(1, 1.0, 5.0), (1, 2.0, None), (1, 3.0, None), (1, 4.0, 5.0)]
    spark.createDataFrame(rows, "key long, t double, v double").write.parquet(f"{tmp_path}/in")
    stream = jobs.change_stream(spark.readStream.schema("key long, t double, v double").parquet(f"{tmp_path}/in"), "key", "t", "v", count_late=True)
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination()
    got = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").orderBy("t").collect()
    assert [(r["t"], r["run_id"], r["late"]) for r in got] == [(1.0, 0, 0), (2.0, 1, 0), (4.0, 2, 0)]


LINES = ["1 2 3", "4 5", "7", "", "", '"name a', "*NAME* q", "*N* 3", "*ASSOCIATE* 1,2", "*SPLIT*", "*INTERVAL* 2", "*INTERVAL* 1", "*COLUMNS* x=1 y=0", "*SCALEFACT* 2 3", "junk line", "*TITLE* t", "*COLUMNLABELS* a,b"]


def test_ranges_of_a_text_composed_in_order():
    rng = random.Random(1)
    for _ in range(2000):
        lines = [rng.choice(LINES) for _ in range(rng.randrange(1, 30))]
        cuts = sorted(rng.randrange(len(lines) + 1) for _ in range(rng.randrange(5)))
        parts = [p for a, b in zip([0, *cuts], [*cuts, len(lines)]) if (p := lines[a:b])]
        outlines, got = [], []
        for part in parts:
            own = splits.Outline()
            for line in part:
                own.read(*rd.classified(line))
            outlines.append(json.loads(json.dumps(own.as_dict())))
        for part, (state, names) in zip(parts, splits.composed(outlines)):
            parser = rd.MultisetParser(state)
            for line in part:
                parser.read(*rd.classified(line))
            got += parser.named(names)
        assert got == rd.parse_multiset("\n".join(lines))[0]


def test_text_in_ranges_of_a_few_bytes(spark, tmp_path):
    rng = random.Random(7)
    for k in range(2):
        (tmp_path / f"f{k}.txt").write_text("\n".join(rng.choice(LINES) for _ in range(400)))
    whole = rd.read_multiset(spark, str(tmp_path))
    assert _rows(splits.read_multiset_splits(spark, str(tmp_path), 97).select(whole.columns)) == _rows(whole)


def test_records_written_and_read_in_ranges(spark, tmp_path):
    datasource.register(spark)
    at = str(tmp_path / "r")
    df = spark.range(0, 500, 1, 3).select(F.array(F.col("id").cast("double"), (F.col("id") * 2).cast("double")).alias("columns"))
    for mode in ("append", "overwrite", "append"):
        df.write.format("loom_records").option("size", 4).mode(mode).save(at)
    got = spark.read.format("loom_records").option("columns", 2).option("size", 4).option("split_bytes", 100).load(at)
    assert got.rdd.getNumPartitions() > 30
    assert sorted(r["columns"][0] for r in got.collect()) == sorted(2 * list(map(float, range(500))))
    assert got.groupBy("file").agg(F.max("idx") + 1 - F.count("*")).where("`((max(idx) + 1) - count(1))` <> 0").count() == 0


def test_lengths_of_several_signs_share_their_scans(spark, monkeypatch):
    df = _series(spark, 40).withColumnRenamed("v", "x").withColumnRenamed("a", "y")
    signed, scans_ = {"l": 0, "x1": 1, "y1": -1, "t": 2, "s": 3}, []
    want = _rows(df.select("set_id", "idx"))
    for block in (None, 7):
        one = {n: {(r["set_id"], r["idx"]): round(r[n], 9) for r in wn.with_curve_length(df, name=n, signed=k, block=block).collect()} for n, k in signed.items()}
        got = wn.with_curve_lengths(df, signed, block=block).collect()
        assert len(got) == len(want) and all(round(r[n], 9) == one[n][r["set_id"], r["idx"]] for r in got for n in signed)
    real = wn.scanned
    monkeypatch.setattr(wn, "scanned", lambda *a, **k: scans_.append(1) or real(*a, **k))
    wn.with_curve_lengths(df, {"x1": 1, "y1": -1, "t": 2}, block=7)
    assert len(scans_) == 2


def test_many_ranges_and_files_share_partitions(spark, tmp_path):
    datasource.register(spark)
    rng = np.random.default_rng(1)
    want = []
    for k in range(700):
        a = rng.normal(size=(int(rng.integers(0, 6)), 2)).astype("<f4")
        (tmp_path / f"r{k:03d}.bin").write_bytes(a.tobytes())
        want += [(f"r{k:03d}.bin", i, *map(float, row)) for i, row in enumerate(a)]
    got = spark.read.format("loom_records").option("columns", 2).option("size", 4).option("split_bytes", 8).load(str(tmp_path))
    assert 1 < got.rdd.getNumPartitions() <= datasource.MOST_PARTITIONS
    assert sorted((r["file"].rpartition("/")[2], r["idx"], *r["columns"]) for r in got.collect()) == sorted(want)
    ranges = [datasource.FileRange("f", k, k + 1) for k in range(1000)] + [datasource.FileRange("g", 0, 10**9)]
    parts = datasource.bundled(ranges, 7)
    assert len(parts) <= 7 and sum(r.end - r.start for p in parts for r in p.ranges) == 1000 + 10**9


@pytest.mark.parametrize("idle", [None, 1e6])
def test_streams_out_of_order_keep_few_states(spark, tmp_path, idle):
    rng = random.Random(4)
    at = f"{tmp_path}/in"
    rows = [(k if k % 50 else None, float(t), float(rng.randrange(2))) for k in range(2500) for t in rng.sample(range(10, 1000), 3)]
    rows += [(None, 1000.0 + t, float(t % 3)) for t in range(0, 40, 2)]
    rows = list({(k, t): (k, t, v) for k, t, v in rows}.values())  # one row of a key and time
    rng.shuffle(rows)
    batches = [rows[::3], rows[1::3], rows[2::3], [(-1, 1e5, 0.0)]]
    for batch in batches:  # one after another, as a stream takes files in the order of their times
        df = spark.createDataFrame(batch, "key long, t double, v double").withColumn("time", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
        df.coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema("key long, t double, v double, time timestamp").option("maxFilesPerTrigger", 1).parquet(at)
    q = jobs.changes_in_order(stream, "key", "time", "v", "2000 seconds", idle).writeStream.format("parquet").outputMode("append")
    q = q.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination()
    last, want = {}, []
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        value, run = last.get(k, (None, -1))
        if v != value:
            run += 1
            want.append((k, t, v, run, 0))
        last[k] = (v, run)
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("key", "t", "value", "run_id", "late").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= jobs.STATES + 1


def test_closest_points_of_whole_and_dealt_pairs(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(s, k, rng.choice([None, float("nan"), *map(float, range(6))]), float(rng.randrange(6)), 10.0 * (s or 0) + k) for s, n in ((1, 30), (2, 45), (3, 1), (4, 12), (None, 5)) for k in range(n)]
    df = spark.createDataFrame([*rows, (5, 0, None, 1.0, 0.0)], "set_id long, idx long, x double, y double, a double").repartition(5)
    pairs = spark.createDataFrame([(1, 2), (2, 1), (2, 2), (3, 4), (4, 1), (1, 5), (1, 9), (None, 1)], "set_a long, set_b long")
    there = [r for r in rows if r[2] is not None and r[2] == r[2]]
    want = []
    for a, b in ((1, 2), (2, 1), (2, 2), (3, 4), (4, 1)):
        for direction, own, other in ((12, a, b), (21, b, a)):
            for _, k, x, y, v in (r for r in there if r[0] == own):
                d, *ref = min(((x - r[2]) ** 2 + (y - r[3]) ** 2, *r[1:]) for r in there if r[0] == other)
                want.append((a, b, direction, k, x, y, v, *ref, round(d**0.5, 9)))
    names = ["set_a", "set_b", "direction", "idx", "x", "y", "a", "ref_idx", "ref_x", "ref_y", "ref_a", "distance"]
    for most in (compare.WHOLE, 20):  # all pairs whole; those of sets of more than 20 points dealt over tasks
        assert _rows(compare.closest_points(df, pairs, ["a"], most).select(*names)) == sorted(want, key=str)
    assert _rows(compare._closest_in_whole_pairs(df.where("x IS NOT NULL AND NOT isnan(x)"), pairs, ["a"], 40).select(*names)) == sorted(want, key=str)
    monkeypatch.setattr(compare, "nearest", None)  # short sets need no search over tasks
    assert compare.closest_points(df, pairs).count() == len(want)
    assert compare.closest_points(df, pairs.limit(0)).count() == 0


def test_alignment_of_whole_and_dealt_pairs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    sets = {s: rng.uniform(-50, 50, (n, 2)).tolist() for s, n in ((1, 30), (2, 40), (3, 35), (4, 7), (5, 0))}
    sets[1][3][0] = sets[2][5][1] = None
    rows = [(s, k, *p) for s, ps in sets.items() for k, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "set_id long, idx long, x double, y double").repartition(4)
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (4, 1), (3, 4), (1, 5), (1, 2)], "set_a long, set_b long")
    grid = [{"scale": s, "angle": a, "dx": x, "dy": -x} for s in (0.3, 1.0) for a in (0.0, 360.0, 40.0, 190.0) for x in (-3.0, 0.0, 0.0, 8.0)]
    want = []
    for a, b in ((1, 2), (2, 3), (3, 3), (4, 1), (3, 4)):
        c = np.array([(*p, *q) for p, q in zip(sets[a], sets[b]) if None not in (*p, *q)]).T
        scores = []
        for g in grid:
            w, s = np.radians(g["angle"]), g["scale"]
            x, y = s * (c[2] * np.cos(w) - c[3] * np.sin(w)) + g["dx"], s * (c[2] * np.sin(w) + c[3] * np.cos(w)) + g["dy"]
            scores.append(np.hypot(c[0] - x, c[1] - y).mean())
        want.append((a, b, round(min(scores), 9), scores))
    for whole in (compare.WHOLE, 20):  # all pairs whole; those of two sets of more than 20 points dealt over tasks
        got = sorted(tuple(r) for r in compare.best_alignment(df, pairs, grid, whole=whole).select("set_a", "set_b", "score", "p_id").collect())
        assert [(a, b, round(v, 9) + 0.0) for a, b, v, _ in got] == sorted((a, b, v) for a, b, v, _ in want)
        for (*_, k), (*_, scores) in zip(got, sorted(want, key=lambda r: r[:2])):
            assert scores[k] == pytest.approx(min(scores), abs=1e-12) and grid.index(grid[k]) == k  # the first of equal rows
    monkeypatch.setattr(compare, "paired", None)  # short sets are not joined point by point
    assert compare.best_alignment(df, pairs, grid).count() == len(want)


def test_sets_resampled_many_a_task(spark):
    rng = random.Random(12)
    sets = {"a": 1, "b": 2, "c": 40, "d": 0, "e": 90, None: 25, "f": 3}
    rows = [(s, k, 0.5 * k, rng.choice([None, float("nan"), *map(float, range(5))])) for s, n in sets.items() for k in range(n)]
    rows += [("d", k, float(k), None) for k in range(4)] + [("g", 0, None, 1.0), ("c", 99, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "set_id string, idx long, x double, y double").repartition(3)
    want = []
    for s in {r[0] for r in rows}:
        at = {r[2]: [q[3] for q in rows if q[0] == s and q[2] == r[2] and q[3] is not None] for r in rows if r[0] == s and r[2] is not None}
        x, y = np.array(sorted(at)), np.array([np.mean(at[k]) if at[k] else np.nan for k in sorted(at)])
        known = np.flatnonzero(~np.isnan(y))
        if len(known):
            places = np.arange(known[0], known[-1] + 1)
            kx, ky = x[places], np.interp(places, known, y[known])
            grid = np.linspace(kx[0], kx[-1], 7)
            want += [(s, k, *map(float, v)) for k, v in enumerate(zip(grid, resample.spline_at(kx, ky, resample.natural_spline(kx, ky), grid)))]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for n in ("4", before):  # sets go on over batches; many sets share one
        spark.conf.set(key, n)
        try:
            got = resample.spline_resample(df, "x", "y", 7)
            assert _rows(got) == sorted((tuple(round(c, 9) if isinstance(c, float) else c for c in r) for r in want), key=str)
        finally:
            spark.conf.set(key, before)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()  # no call of Python for each set
    chain = workloads.trajectories(spark, DATA)._jdf.queryExecution().toString()
    assert "InPandas" not in chain and "InArrow" not in chain  # the curves are made once, not for every reading
