import math
import struct

import pytest
from pyspark.sql import functions as F

from pointloom.functions import scalars as sc
from pointloom.sources import readers as rd
from pointloom.streaming import jobs

FIVE = '''3 -1.25
4 2.75
"rising
6 .5

"falling and rising
10 7e-1
-12.5 3e2

0.25 1.5 9
0.5 2.5 8

"beyond numbers
Inf 1
5 ---
6 ++
7 nan

"single column
-8
2

'''


def test_text_of_five_sets():
    points, sets = rd.parse_multiset(FIVE)
    assert [s["name"] for s in sets] == ["rising", "falling and rising", None, "beyond numbers", "single column"] and [s["points"] for s in sets] == [3, 2, 2, 4, 2]
    assert (points[0]["x"], points[0]["y"], points[0]["e"]) == (3, -1.25, None) and points[5]["e"] == 9
    assert points[7]["x"] == math.inf and points[8]["y"] == -math.inf and points[9]["y"] == math.inf and math.isnan(points[10]["y"])
    assert [(p["x"], p["y"]) for p in points[-2:]] == [(0, -8), (1, 2)]
    assert rd.parse_multiset("") == ([], [])


def test_directives():
    points, sets = rd.parse_multiset("*COLUMNS* N=4 x=0 y=2 e=3\n*SCALEFACT* 2 10\n*LEGEND* a name\n*N* 7\n*ASSOCIATE* 3 4\n1 9 5 0.5\n*SPLIT*\n2 9 6 0.25\nnot a number\n\n*INTERVAL* 2\n1 0 1 0\n2 0 1 0\n3 0 1 0\n")
    assert [(p["x"], p["y"], p["e"], p["run_id"]) for p in points[:2]] == [(2, 50, 0.5, 0), (4, 60, 0.25, 1)]
    assert sets[0]["name"] == "a name" and sets[0]["n_obs"] == 7 and sets[0]["assoc"] == [3, 4]
    assert [p["x"] for p in points[2:]] == [2, 6]


def test_several_files_are_one_collection(spark, tmp_path):
    (tmp_path / "a.txt").write_text(FIVE)
    (tmp_path / "b.txt").write_text("1 2\n")
    got = rd.read_multiset(spark, str(tmp_path))
    assert got.select("set_id").distinct().count() == 6 and got.where("file_id = 1").first()["set_id"] == 5
    assert rd.read_sets(spark, str(tmp_path)).count() == 6


def test_importers(spark, tmp_path):
    (tmp_path / "a.txt").write_text(FIVE)
    got = rd.read_format(spark, "multiset", str(tmp_path))
    assert got.count() == 13 and got.where("name = 'rising'").count() == 3
    rd.register_importer("pairs", "a int, b int", lambda data: [tuple(data[k : k + 2]) for k in range(0, len(data), 2)], text=False)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.bin").write_bytes(bytes([1, 2, 3, 4]))
    assert sorted((r["a"], r["b"]) for r in rd.read_format(spark, "pairs", str(tmp_path / "b")).collect()) == [(1, 2), (3, 4)]


def test_written_sets_come_back(spark, tmp_path):
    rows = [(s, i, float(i), s / 2, 0.5) for s in range(60) for i in range(1 + s % 4)]
    df = spark.createDataFrame(rows, "set_id long, idx long, x double, y double, e double").repartition(7)
    rd.write_multiset(df, str(tmp_path / "sets"), sets_a_file=9)
    got = rd.read_multiset(spark, str(tmp_path / "sets"))
    assert sorted((r["set_id"], r["idx"], r["x"], r["y"], r["e"]) for r in got.collect()) == rows
    assert {(r["set_id"], r["file_id"]) for r in got.collect()} == {(s, s // 9) for s in range(60)}
    for folders in (None, 3):
        rd.write_processed(df.withColumn("discarded", F.col("x") > 1), str(tmp_path / f"kept{folders}"), folders)
        assert spark.read.parquet(str(tmp_path / f"kept{folders}")).count() == sum(r[2] <= 1 for r in rows)


def test_binary_records(spark, tmp_path):
    (tmp_path / "r.bin").write_bytes(struct.pack(">6d", 1, 2, 3, 4, 5, 6))
    got = rd.read_records(spark, str(tmp_path), 3, 8, swap=True).orderBy("idx").collect()
    assert [list(r["columns"]) for r in got] == [[1, 2, 3], [4, 5, 6]]
    assert rd.parse_records(bytes([0, 255]), 1, 1, extremes=[(-1, 1)]).ravel().tolist() == [-1, 1]
    with pytest.raises(ValueError):
        rd.parse_records(bytes(2), 1, 1)


def test_recording(spark, tmp_path):
    data = rd._GENERAL.pack(b"rec", 2, 0.5, 2.0, 3, 0, 0, 0, 0, 0, 0.0, 1, 0, 0, 0, b"")
    for values in ((0, 0, 0), (3276, 0, -3276)):
        data += rd._CHANNEL.pack(b"sk", 100, 7, 1.0, 0.0, 0, 0, b"mV", b"") + struct.pack("<3h", *values)
    data += struct.pack("<II80s", 2, 0, b"start")
    (tmp_path / "x.rec").write_bytes(data)
    rows = rd.read_recordings(spark, str(tmp_path)).orderBy("idx").collect()
    assert [r["channel"] for r in rows] == [1, 1, 1] and [r["t"] for r in rows] == [0, 0.25, 0.5]
    assert [r["value"] for r in rows] == pytest.approx([7 + 3276 * 100 / 3276.8, 7, 7 - 3276 * 100 / 3276.8]) and rows[0]["units"] == "mV"
    event = rd.read_recordings(spark, str(tmp_path), events=True).first()
    assert (event["position"], event["t"], event["text"]) == (2, 0.5, "start")


def test_tables(spark, tmp_path):
    at = str(tmp_path / "t")
    rd.write_table(spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "k int, s string, v double"), at, ";")
    back = rd.read_table(spark, at, ";")
    assert back.dtypes == [("k", "int"), ("s", "string"), ("v", "double")] and back.where("v is null and s is null").count() == 1
    (tmp_path / "d.txt").write_text('"a"\t"b"\n1,5\t2\nx\t3\n')
    assert [tuple(r) for r in rd.read_delimited(spark, str(tmp_path / "d.txt"), ["a"], decimal_comma=True).collect()] == [(1.5,), (None,)]


def test_cut(spark):
    lines = spark.createDataFrame([("a|b",), ("# no",), ("c||7",), ("x|NA|1",), ("",)], "value string")
    assert [tuple(r) for r in rd.cut_columns(lines, [0, 2], "|", missing="0", no_data="NA").collect()] == [("a", "0"), ("c", "7")]
    assert ("x", "?") in [tuple(r) for r in rd.cut_columns(lines, [0, 1], "|", no_data="NA", replacement="?").collect()]


def _stream(spark, at, batches):
    schema = "k string, t double, x double"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/in/b{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{at}/in")


def _run(stream, at):
    q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out")
    q.awaitTermination()
    return stream.sparkSession.read.parquet(f"{at}/out")


def test_filter_with_state_and_late_rows(spark, tmp_path):
    batches = [[("a", 0.0, 1.0), ("a", 1.0, 3.0)], [("a", 0.5, 99.0), ("a", 3.0, 3.0), ("b", 0.0, 5.0)]]
    got = _run(jobs.low_pass_stream(_stream(spark, tmp_path, batches), "k", "t", "x", 2.0), tmp_path)
    rows = sorted((r["key"], r["t"], r["filtered"], r["late"]) for r in got.collect())
    assert rows == [("a", 0.0, 1.0, 0), ("a", 1.0, 2.0, 0), ("a", 3.0, 3.0, 1), ("b", 0.0, 5.0, 0)]


def test_changes_over_batches(spark, tmp_path):
    batches = [[("a", 0.0, 1.0), ("a", 1.0, 1.0)], [("a", 2.0, 1.0), ("a", 3.0, 2.0)]]
    got = _run(jobs.change_stream(_stream(spark, tmp_path, batches), "k", "t", "x"), tmp_path)
    assert sorted(tuple(r) for r in got.collect()) == [("a", 0.0, 1.0, 0), ("a", 3.0, 2.0, 1)]


def test_appending_is_complete(spark, tmp_path):
    stream = _stream(spark, tmp_path, [[("a", 0.0, 1.0)], [("b", 1.0, 2.0)]])
    jobs.append_points(stream, str(tmp_path / "points"), str(tmp_path / "state2"))
    assert spark.read.parquet(str(tmp_path / "points")).count() == 2


def test_scalars_at_their_edges(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 4.0)], "a double, b double")
    assert [r[0] for r in df.select(sc.divide("a", "b", undefined=7.0)).collect()] == [math.inf, -math.inf, 7.0, 1.5]
    one = spark.range(1)
    v = lambda c: one.select(c.alias("v")).first()["v"]
    assert v(sc.half_turn(F.lit(180.0))) == 180 and v(sc.half_turn(F.lit(-180.0))) == 180 and v(sc.half_turn(F.lit(540.5))) == -179.5
    assert v(sc.arg(F.lit(0.0), F.lit(0.0))) == 0 and v(sc.arg(F.lit(0.0), F.lit(-1.0), 360)) == 270
    assert v(sc.year_day(29, 2, 2023)) is None and v(sc.year_day(29, 2, 2024)) == 60
    assert v(sc.truth(F.lit(float("nan")))) is False and v(sc.truth(F.lit(math.inf))) is True
    assert v(sc.product_of_steps(F.lit(5.0))) == 120 and v(sc.product_of_steps(F.lit(0.0))) == 1
    assert v(sc.timecode(F.lit(3661.5))) == "01:01:01.50" and v(sc.timecode(F.lit(1.5), 24)) == "00:00:01:12"
    assert v(sc.from_match(F.lit("abcabc"), "bc", last=True)) == "bc" and v(sc.from_match(F.lit("abc"), "x")) is None
    assert v(sc.basename(F.lit("/a/.dat"), ".dat")) == ".dat" and v(sc.newlines_encoded(F.lit("a\n\\"))) == "a\\n\\\\"
    assert v(sc.close(F.lit(-1.05), F.lit(-1.0), 0.1)) is True and v(sc.compare(F.lit(1.0), F.lit(1.0 + 1e-16))) == 0
    assert v(F.size(sc.line_in_circle(F.lit(-5.0), F.lit(0.0), F.lit(5.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))) == 2
    assert v(F.size(sc.line_in_circle(F.lit(-5.0), F.lit(1.0), F.lit(5.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))) == 1
    assert v(sc.strided(F.array(*map(F.lit, range(5))), -2)) == [4, 2, 0]


def test_a_large_multiset_file_is_strung_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rd, "TASK_ROWS", 40)
    assert rd._tasks(spark, 10_000_000) == 250_000  # tasks grow with the rows, not with their size on disk
    df = spark.range(300).selectExpr("id % 7 AS set_id", "id div 7 AS idx", "id * 0.5 AS x", "id + 1.0 AS y", "0.25D AS e")
    rd.write_multiset_file(df, f"{tmp_path}/one")
    rd.write_multiset(df, f"{tmp_path}/sorted", sets_a_file=1 << 40)
    text = lambda at: "".join(p.read_text() for p in sorted((tmp_path / at).rglob("part-*.txt")))
    assert text("one") == text("sorted") and len([p for p in (tmp_path / "one").rglob("part-*.txt") if p.stat().st_size]) == 1
    got = rd.read_multiset(spark, f"{tmp_path}/one").selectExpr("set_id", "idx", "x", "y", "e", "file_id")
    assert sorted(map(tuple, got.collect())) == sorted((*r, 0) for r in df.collect())
