"""Queries of sources and sinks (IO1 to IO12), streams (ST1 to ST4) and users' functions (UD1 to UD5).

What a query reads is written from the given tables first, to the session's shared folder.
"""

import contextlib
import struct

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from pointloom.functions import user
from pointloom.operators import stats as st
from pointloom.operators.points import scratch
from pointloom.plans.registry import ORACLE, query, r, scatter, series, table
from pointloom.sources import datasource
from pointloom.sources import readers as rd
from pointloom.sources import splits
from pointloom.streaming import jobs


folder = scratch


def _written_sets(spark, d) -> str:
    """The scatter sets as files of several sets each."""
    at = folder(spark, "multiset")
    rd.write_multiset(scatter(spark, d), at)
    return at


@query("io01_multiset", "WITH {P} SELECT 'set ' || set_id AS name, idx, x, y, e FROM p")
def io01(spark, d):
    return rd.read_multiset(spark, _written_sets(spark, d)).select("name", "idx", "x", "y", "e")


@query("io01_set_table", "WITH {P} SELECT 'set ' || set_id AS name, count(*) AS points FROM p GROUP BY set_id")
def io01b(spark, d):
    return rd.read_sets(spark, _written_sets(spark, d)).select("name", "points")


@query("io01_multiset_in_splits", ORACLE["io01_multiset"])
def io01c(spark, d):
    at = folder(spark, "multiset")
    rd.write_multiset_file(scatter(spark, d), at)
    return splits.read_multiset_splits(spark, at, 64 << 10).select("name", "idx", "x", "y", "e")


@query("io02_delimited", "SELECT s_suppkey::DOUBLE AS s_suppkey, s_acctbal FROM supplier")
def io02(spark, d):
    at = folder(spark, "delimited")
    s = table(spark, d, "supplier")
    s.select("s_suppkey", F.lit("x").alias("skip"), F.regexp_replace(F.col("s_acctbal").cast("string"), r"\.", ",").alias("s_acctbal")).write.csv(at, sep="\t", header=True)
    return rd.read_delimited(spark, at, ["s_suppkey", 2], decimal_comma=True)


@query("io03_typed_table", "SELECT p_partkey::INTEGER AS column00, p_name AS column01, CASE WHEN p_size > 10 THEN p_retailprice END AS column02 FROM part")
def io03(spark, d):
    at = folder(spark, "typed")
    table(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 10, F.col("p_retailprice"))).write.csv(at, sep=";")
    return rd.read_table(spark, at, sep=";", header=False)


@query("io04_written_table", "SELECT c_custkey::INTEGER AS c_custkey, c_name, c_acctbal FROM customer")
def io04(spark, d):
    at = folder(spark, "table")
    rd.write_table(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), at)
    return rd.read_table(spark, at)


@query("io05_binary_records", "WITH {P} SELECT set_id, idx, x, y, e FROM p")
def io05(spark, d):
    datasource.register(spark)
    at = folder(spark, "records")
    cells = F.array(*[F.col(c).cast("double") for c in ("set_id", "idx", "x", "y", "e")])
    scatter(spark, d).select(cells.alias("columns")).write.format("loom_records").option("size", 8).mode("append").save(at)
    got = spark.read.format("loom_records").option("columns", 5).option("size", 8).option("split_bytes", 64 << 10).load(at)
    c = F.col("columns")
    return got.select(c[0].cast("long").alias("set_id"), c[1].cast("long").alias("idx"), c[2].alias("x"), c[3].alias("y"), c[4].alias("e"))


@query("io05_item_sizes", """WITH {P}, q AS (SELECT x, round(e * 100) AS e, set_id % 200 AS k FROM p)
SELECT size, x::DOUBLE AS x, e::DOUBLE AS e, k, count(*) AS n FROM q, (SELECT unnest([1, 2, 4, 8]) AS size) GROUP BY ALL""")
def io05b(spark, d):
    datasource.register(spark)
    cells = F.array("x", F.round(F.col("e") * 100), (F.col("set_id") % 200).cast("double"))
    rows = scatter(spark, d).select(cells.alias("columns"))
    parts = []
    for size in (1, 2, 4, 8):
        at = folder(spark, f"records{size}")
        # whole numbers are kept between the columns' extremes, here such that their steps are 1
        options = {"columns": 3, "size": size, "swap": size in (2, 8), "split_bytes": 10_000} | ({"extremes": str([[0, 256**size - 1]] * 3)} if size < 4 else {})
        rows.write.format("loom_records").options(**options).mode("overwrite").save(at)
        parts.append(spark.read.format("loom_records").options(**options).load(at).select(F.lit(size).alias("size"), *[F.col("columns")[k].alias(c) for k, c in enumerate("xek")]))
    union = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return union.groupBy("size", "x", "e", F.round("k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("io06_recordings", """WITH {S}, q AS (SELECT set_id, idx, round_even(v, 0) AS v, round_even(a, 0) AS a FROM s), c AS (SELECT set_id, idx, 0 AS channel, 'a' AS name, v AS raw FROM q UNION ALL SELECT set_id, idx, 1, 'b', a FROM q),
k AS (SELECT set_id, channel FROM c GROUP BY ALL HAVING max(abs(raw)) > 0)
SELECT c.set_id, CAST(c.channel AS BIGINT) AS channel, name, idx, idx * 0.5::DOUBLE AS t, round(raw * (3277 / 3276.8::DOUBLE) + 2, 6) AS value, 1::BIGINT AS events FROM c JOIN k ON k.set_id = c.set_id AND k.channel = c.channel""")
def io06(spark, d):
    datasource.register(spark)
    at = folder(spark, "recordings")
    _recordings_of(series(spark, d), at)
    read = spark.read.format("loom_recordings").option("split_bytes", 2000)
    samples, events = read.load(at), read.option("events", True).load(at)
    signal = samples.groupBy("file", "channel").agg(F.max(F.abs("raw")).alias("most")).where("most > 0").drop("most")
    got = samples.join(signal, ["file", "channel"]).join(events.groupBy("file").agg(F.count("*").alias("events")), "file")
    number = F.regexp_extract("file", r"set(\d+)\.rec$", 1).cast("long")
    return got.select(number.alias("set_id"), "channel", "name", "idx", "t", r("value").alias("value"), "events")


def _recordings_of(s, at: str) -> None:
    """A recording of each set, of the channels v, a and an empty one, and one event."""

    def record(frame):
        import pandas as pd

        frame = frame.sort_values("idx")
        v = np.array([frame["v"], frame["a"], 0 * frame["a"]]).round().astype("<i2")
        data = rd._GENERAL.pack(b"rec", 3, 0.5, 1.0, v.shape[1], 0, 0, 0, 0, 0, 0.0, 1, 0, 0, 0, b"")
        for k in range(3):
            data += rd._CHANNEL.pack(b"ab"[k : k + 1] or b"z", 3277, 2, 1.0, 0.0, 0, 0, b"unit", b"") + v[k].tobytes()
        fs, root = datasource.file_system(at)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/set{frame['set_id'].iloc[0]}.rec") as f:
            f.write(data + struct.pack("<II80s", 1, 0, b"mark"))
        return pd.DataFrame({"n": [len(frame)]})

    s.select("set_id", "idx", "v", "a").groupBy("set_id").applyInPandas(record, "n long").agg(F.sum("n")).first()


@query("io07_processed_dump", "WITH {P} SELECT set_id, idx, x FROM p WHERE x <= 40")
def io07(spark, d):
    at = folder(spark, "processed")
    p = scatter(spark, d).withColumn("discarded", F.col("x") > 40)
    rd.write_processed(p, at, folders=64)
    return spark.read.parquet(at).select("set_id", "idx", "x")


@query("io08_cut", """SELECT CASE WHEN p_partkey = 7 THEN '0' ELSE p_partkey::VARCHAR END AS c0, CASE WHEN p_size > 20 THEN p_brand ELSE '-' END AS c1, CASE WHEN p_size = 7 THEN '0' ELSE p_size::VARCHAR END AS c2 FROM part WHERE p_partkey % 10 <> 3""")
def io08(spark, d):
    p = table(spark, d, "part")
    line = F.when(F.col("p_partkey") % 10 == 3, F.concat(F.lit("# "), "p_name")).otherwise(F.concat_ws("|", "p_partkey", "p_size", F.when(F.col("p_size") > 20, F.col("p_brand"))))
    at = folder(spark, "lines")
    p.select(line.alias("value")).write.text(at)
    return rd.cut_columns(spark.read.text(at), [0, 2, 1], "|", missing="-", no_data="7", replacement="0")


@query("io09_parameter_range", """WITH n AS (SELECT count(*) AS n FROM part), t AS (SELECT i AS idx, i * (2.0::DOUBLE / (n - 1)) AS t FROM n, range((SELECT count(*) FROM part)) g(i))
SELECT 0::BIGINT AS set_id, idx, round(t * t, 9) AS x, round(sin(t), 9) AS y FROM t""")
def io09(spark, d):
    n = table(spark, d, "part").count()
    got = rd.parameter_points(spark, 0.0, 2.0, n, lambda t: t * t, F.sin)
    return got.select("set_id", "idx", r("x", 9).alias("x"), r("y", 9).alias("y"))


@query("io10_files", "WITH {P} SELECT dense_rank() OVER (ORDER BY set_id // 25) - 1 AS file_id, dense_rank() OVER (ORDER BY set_id) - 1 AS set_id, count(*) AS n FROM p GROUP BY p.set_id")
def io10(spark, d):
    got = rd.read_multiset(spark, _written_sets(spark, d))
    return got.groupBy("file_id", "set_id").agg(F.count("*").alias("n"))


@query("io11_printed_values", "WITH {P} SELECT set_id::VARCHAR AS _c0, idx::VARCHAR AS _c1, x::DOUBLE AS x FROM p")
def io11(spark, d):
    at = folder(spark, "printed")
    rd.write_values(scatter(spark, d), at, "set_id", "idx", "x")
    return spark.read.csv(at, sep="\t").select("_c0", "_c1", F.col("_c2").cast("double").alias("x"))


@query("io12_importer", "WITH {P} SELECT 'set ' || set_id AS name, idx, x, y FROM p")
def io12(spark, d):
    datasource.register(spark)
    return spark.read.format("loom_multiset").load(_written_sets(spark, d)).select("name", "idx", "x", "y")


def _events_stream(spark, d):
    at = f"{d}/events.parquet"
    schema = spark.read.parquet(at).schema
    if any(f[0].rstrip("/").endswith("events.parquet") for f in spark.read.parquet(at).select("_metadata.file_path").limit(1).collect()):
        # the table is a single file: a stream reads folders, and takes of this one the table's files only
        return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return spark.readStream.schema(schema).parquet(at)


def _collected(spark, stream, mode: str, name: str):
    """Run a stream over all that is there and return what it wrote."""
    at = folder(spark, name)
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{at}-state").trigger(availableNow=True).start(at)
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(at)

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{at}/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(at)


@query("st01_running_bins", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY user_id")
def st01(spark, d):
    got = _collected(spark, jobs.running_bins(_events_stream(spark, d), "user_id", "value"), "update", "running")
    last = Window.partitionBy("user_id").orderBy(F.col("batch").desc())
    return got.withColumn("k", F.row_number().over(last)).where("k = 1").select("user_id", "n", r("mean").alias("mean"))


@query("st02_recursive_filter", """WITH RECURSIVE q AS (SELECT user_id AS key, epoch_us(ts) / 1e6 AS t, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
f AS (SELECT key, t, i, v AS y FROM q WHERE i = 1 UNION ALL SELECT q.key, q.t, q.i, y + least((q.t - f.t) / 3600.0, 1.0) * (q.v - y) FROM f JOIN q ON q.key = f.key AND q.i = f.i + 1)
SELECT key, round(t, 3) AS t, round(y, 4) AS filtered, 0::BIGINT AS late FROM f""")
def st02(spark, d):
    s = _events_stream(spark, d).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return _collected(spark, jobs.low_pass_stream(s, "user_id", "t", "value", 3600.0), "append", "filtered").select("key", r("t", 3).alias("t"), r("filtered", 4).alias("filtered"), "late")


@query("st03_changes", """WITH q AS (SELECT user_id AS key, epoch_us(ts) / 1e6 AS t, floor(value / 100) AS value FROM events), c AS (SELECT *, lag(value) OVER (PARTITION BY key ORDER BY t) AS b FROM q)
SELECT key, round(t, 3) AS t, value, row_number() OVER (PARTITION BY key ORDER BY t) - 1 AS run_id FROM c WHERE b IS NULL OR b <> value""")
def st03(spark, d):
    s = _events_stream(spark, d).withColumns({"t": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "level": F.floor(F.col("value") / 100)})
    return _collected(spark, jobs.change_stream(s, "user_id", "t", "level"), "append", "changes").select("key", r("t", 3).alias("t"), "value", "run_id")


def _shuffled_stream(spark, d):
    """The events in five files, out of order by up to three days, and a last row far behind all others that closes the
    stream (of a key of its own, whose row never leaves)."""
    at = folder(spark, "shuffled")
    rows = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    came = F.unix_micros("ts") + F.pmod(F.xxhash64("user_id", "ts"), F.lit(3 * 86_400_000_000))
    first, last = rows.agg(F.min(came), F.max(came)).first()
    part = F.floor((came - first) * 5 / (last - first + 1))
    rows.withColumn("part", part).repartition(5, "part").write.partitionBy("part").parquet(at)
    spark.range(1).select(F.lit(-1).cast("long").alias("user_id"), F.timestamp_micros(F.lit(last + 60 * 86_400_000_000)).alias("ts"), F.lit(0.0).alias("value")).write.parquet(f"{at}/part=5")
    paths = [f"{at}/part={k}" for k in range(6)]
    stream = folder(spark, "arriving")
    # written one after another, as a stream takes files in the order of their times
    for k, p in enumerate(paths):
        spark.read.schema(rows.schema).parquet(p).coalesce(1).write.mode("append").parquet(stream)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(stream)


@contextlib.contextmanager
def _states_on_disk(spark):
    """A state store that holds more than memory does."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@query("st02_out_of_order", ORACLE["st02_recursive_filter"])
def st02b(spark, d):
    with _states_on_disk(spark):
        got = _collected(spark, jobs.low_pass_in_order(_shuffled_stream(spark, d), "user_id", "ts", "value", 3600.0, "4 days"), "append", "filtered")
    return got.select("key", r("t", 3).alias("t"), r("filtered", 4).alias("filtered"), "late")


@query("st03_out_of_order", ORACLE["st03_changes"])
def st03b(spark, d):
    stream = _shuffled_stream(spark, d).withColumn("level", F.floor(F.col("value") / 100))
    with _states_on_disk(spark):
        got = _collected(spark, jobs.changes_in_order(stream, "user_id", "ts", "level", "4 days"), "append", "changes")
    return got.select("key", r("t", 3).alias("t"), "value", "run_id")


@query("st04_appended_points", "SELECT user_id, event_id, value FROM events")
def st04(spark, d):
    at = folder(spark, "appended")
    jobs.append_points(_events_stream(spark, d).select("user_id", "event_id", "value"), at, f"{at}-state")
    return spark.read.parquet(at).select("user_id", "event_id", "value")


@query("ud01_procedure", "WITH {P} SELECT set_id, idx, (x - 3) * (x - 3) + 1 AS v FROM p")
def ud01(spark, d):
    square = lambda x, about, plus=0.0: (x - about) * (x - about) + plus
    return scatter(spark, d).select("set_id", "idx", user.call(square, "x", F.lit(3), plus=1).alias("v"))


@query("ud02_on_values", "WITH {P} SELECT set_id, idx, round(sqrt(x * x + e * e), 9) AS v FROM p")
def ud02(spark, d):
    return scatter(spark, d).select("set_id", "idx", r(user.on_values(np.hypot)("x", "e"), 9).alias("v"))


@query("ud03_on_sets", "WITH {P} SELECT set_id, idx, x - min(x) OVER (PARTITION BY set_id) AS v FROM p")
def ud03(spark, d):
    f = lambda c: {"set_id": c["set_id"], "idx": c["idx"], "v": c["x"] - c["x"].min()}
    return user.on_sets(scatter(spark, d), f, "set_id long, idx long, v double")


@query("ud04_aggregate", "WITH {P} SELECT set_id, round(avg(x), 8) AS own, round(sum(w * x) / sum(w), 8) AS built_in FROM p GROUP BY set_id")
def ud04(spark, d):
    p = scatter(spark, d)
    own = p.groupBy("set_id").agg(user.aggregate(np.mean)("x").alias("own"))
    built = st.bins(p, ["set_id"], "x", "w").select("set_id", r(st.mean(), 8).alias("built_in"))
    return own.join(built, "set_id").select("set_id", r("own", 8).alias("own"), "built_in")


@query("ud05_row_generator", "SELECT s_suppkey AS set_id, CAST(k AS INTEGER) AS idx, CAST((k - s_nationkey) * k - s_nationkey AS DOUBLE) AS y FROM supplier, range(5) g(k)")
def ud05(spark, d):
    spark.udtf.register("curve_points", user.CurvePoints)
    table(spark, d, "supplier").createOrReplaceTempView("curve_suppliers")
    return spark.sql("SELECT s_suppkey AS set_id, c.idx, c.y FROM curve_suppliers, LATERAL curve_points(CAST(s_nationkey AS INT), 5) c")
