"""Queries of joins, resampling, spectra, comparison, order and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pointloom.operators import compare as cmp
from pointloom.operators import joins as jn
from pointloom.operators import resample as rs
from pointloom.operators import smooth, spectral
from pointloom.operators import stats as st
from pointloom.operators.points import with_positions
from pointloom.plans.registry import ORACLE, query, r, scatter, series, table
from pointloom.plans.selection import sets

_PAIRS = "pr AS (SELECT DISTINCT set_id AS set_a, set_id + 1 AS set_b FROM p WHERE set_id % 2 = 0)"
_J = _PAIRS + """, j AS (SELECT set_a, set_b, a.idx, a.x AS a_x, a.y AS a_y, a.e AS a_e, a.w AS a_w, b.x AS b_x, b.y AS b_y, b.e AS b_e, b.w AS b_w
  FROM pr JOIN p a ON a.set_id = set_a JOIN p b ON b.set_id = set_b AND a.idx = b.idx)"""
_Q = "p AS (SELECT set_id, idx, x, y / 1000 AS y, e, w FROM p0)"


def pairs(p):
    """Each even set with the next one."""
    return p.where("set_id % 2 = 0").select(F.col("set_id").alias("set_a"), (F.col("set_id") + 1).alias("set_b")).distinct()


def thousands(spark, d):
    """The scatter points with y in thousands."""
    return scatter(spark, d).withColumn("y", F.col("y") / 1000)


@query("j01_value_of_set", "WITH {P} SELECT a.set_id, a.idx, b.x AS other_x FROM p a LEFT JOIN p b ON b.set_id = a.set_id + 3 AND b.idx = a.idx")
def j01(spark, d):
    return jn.value_of_set(scatter(spark, d), 3, "x").select("set_id", "idx", "other_x")


@query("j02_paired", "WITH {P}, " + _J + " SELECT set_a, set_b, idx, a_x, b_x FROM j WHERE a_x <> 7 AND b_x <> 7")
def j02(spark, d):
    p = scatter(spark, d)
    return jn.paired(p.withColumn("discarded", F.col("x") == 7), pairs(p), "x").select("set_a", "set_b", "idx", "a_x", "b_x")


@query("j03_bracket", """WITH c AS (SELECT c_custkey, c_acctbal AS v FROM customer), s AS (SELECT s_acctbal AS v FROM supplier),
b AS (SELECT c_custkey, c.v, (SELECT max(s.v) FROM s WHERE s.v <= c.v) AS lo, (SELECT min(s.v) FROM s WHERE s.v >= c.v) AS hi FROM c)
SELECT c_custkey, lo AS lower, hi AS upper, CASE WHEN lo IS NULL THEN hi WHEN hi IS NULL OR v - lo <= hi - v THEN lo ELSE hi END AS closest FROM b""")
def j03(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("v"))
    return jn.bracket(c, table(spark, d, "supplier").select(F.col("s_acctbal").alias("v")), "v").select("c_custkey", "lower", "upper", "closest")


@query("j03_bracket_in_groups", """WITH c AS (SELECT c_custkey, c_acctbal AS v, c_nationkey AS g FROM customer), s AS (SELECT s_acctbal AS v, s_nationkey AS g FROM supplier),
b AS (SELECT c_custkey, c.v, (SELECT max(s.v) FROM s WHERE s.v <= c.v AND s.g = c.g) AS lo, (SELECT min(s.v) FROM s WHERE s.v >= c.v AND s.g = c.g) AS hi FROM c)
SELECT c_custkey, lo AS lower, hi AS upper FROM b""")
def j03b(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("v"), F.col("c_nationkey").alias("g"))
    s = table(spark, d, "supplier").select(F.col("s_acctbal").alias("v"), F.col("s_nationkey").alias("g"))
    return jn.bracket(c, s, "v", by=["g"], spread=True).select("c_custkey", "lower", "upper")


@query("j04_nearest_point", """WITH {P0}, p AS (SELECT set_id, idx, x, y / 1000 AS y FROM p0), q AS (SELECT s_suppkey AS q_id, s_nationkey * 2 + 0.5 AS x, s_acctbal / 100 AS y FROM supplier),
b AS (SELECT q_id, min({'d': power(p.x - q.x, 2) + power(p.y - q.y, 2), 's': set_id, 'i': idx}) AS b FROM q, p GROUP BY q_id)
SELECT q_id, b.s AS ref_set_id, b.i AS ref_idx, round(sqrt(b.d), 6) AS distance FROM b""")
def j04(spark, d):
    q = table(spark, d, "supplier").select(F.col("s_suppkey").alias("q_id"), (F.col("s_nationkey") * 2 + 0.5).alias("x"), (F.col("s_acctbal") / 100).alias("y"))
    got = jn.nearest(q, thousands(spark, d), ref_id=["set_id", "idx"])
    return got.select("q_id", "ref_set_id", "ref_idx", r("distance").alias("distance"))


@query("j04_nearest_line", """WITH {P0}, p AS (SELECT set_id, idx, x, y / 1000 AS y FROM p0), q AS (SELECT s_suppkey AS q_id, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey * 2 + 0.5 END AS x, CASE WHEN s_suppkey % 2 = 1 THEN s_acctbal / 100 END AS y FROM supplier),
k AS (SELECT x, CAST(NULL AS DOUBLE) AS y, min(set_id * 10000 + idx) AS i FROM p GROUP BY x UNION ALL SELECT NULL, y, min(set_id * 10000 + idx) FROM p GROUP BY y),
b AS (SELECT q_id, min({'d': coalesce(abs(k.x - q.x), abs(k.y - q.y)), 'v': coalesce(k.x, k.y), 'i': i}) AS b FROM q JOIN k ON (q.x IS NULL) = (k.x IS NULL) GROUP BY q_id)
SELECT q_id, b.i AS ref_place, round(b.d, 6) AS distance FROM b""")
def j04b(spark, d):
    even = F.col("s_suppkey") % 2 == 0
    q = table(spark, d, "supplier").select(F.col("s_suppkey").alias("q_id"), F.when(even, F.col("s_nationkey") * 2 + 0.5).alias("x"), F.when(~even, F.col("s_acctbal") / 100).alias("y"))
    p = thousands(spark, d).withColumn("place", F.col("set_id") * 10000 + F.col("idx"))
    return jn.nearest_or_beside(q, p, ref_id="place").select("q_id", "ref_place", r("distance").alias("distance"))


_CLOSE = """WITH {P0}, """ + _Q + ", " + _PAIRS + """,
m AS (SELECT set_a, set_b, 12 AS direction, a.idx, a.x, a.y, min({'d': power(a.x - b.x, 2) + power(a.y - b.y, 2), 'i': b.idx, 'x': b.x, 'y': b.y}) AS b FROM pr JOIN p a ON a.set_id = set_a JOIN p b ON b.set_id = set_b GROUP BY ALL
UNION ALL SELECT set_a, set_b, 21, b.idx, b.x, b.y, min({'d': power(a.x - b.x, 2) + power(a.y - b.y, 2), 'i': a.idx, 'x': a.x, 'y': a.y}) FROM pr JOIN p a ON a.set_id = set_a JOIN p b ON b.set_id = set_b GROUP BY ALL)"""


@query("j05_closest_points", _CLOSE + " SELECT set_a, set_b, direction, idx, b.i AS ref_idx, round(sqrt(b.d), 6) AS distance FROM m")
def j05(spark, d):
    p = thousands(spark, d)
    got = cmp.closest_points(p, pairs(p))
    return got.select("set_a", "set_b", "direction", "idx", "ref_idx", r("distance").alias("distance"))


@query("j06_category", """WITH c AS (SELECT n_nationkey * 2.0 AS value, n_name AS category FROM nation)
SELECT l_orderkey, l_linenumber, l_partkey, c.category AS exact, (SELECT k.category FROM c k ORDER BY abs(k.value - l_quantity), k.value LIMIT 1) AS closest FROM lineitem LEFT JOIN c ON c.value = l_quantity""")
def j06(spark, d):
    c = table(spark, d, "nation").select((F.col("n_nationkey") * 2.0).alias("value"), F.col("n_name").alias("category"))
    rows = jn.category(table(spark, d, "lineitem"), "l_quantity", c).withColumnRenamed("category", "exact")
    return jn.category(rows, "l_quantity", c, closest=True).select("l_orderkey", "l_linenumber", "l_partkey", "exact", F.col("category").alias("closest"))


@query("j07_members", """SELECT 'in' AS kind, c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)
UNION ALL SELECT 'out', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def j07(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    a = jn.members(c, "c_custkey", o.where("o_totalprice > 450000").select("o_custkey")).select(F.lit("in").alias("kind"), "c_custkey")
    return a.unionAll(jn.members(c, "c_custkey", o.select("o_custkey"), False).select(F.lit("out").alias("kind"), "c_custkey"))


_GRID = """WITH {P}, k AS (SELECT set_id, x, avg(y) AS y FROM p GROUP BY ALL), rg AS (SELECT set_id, min(x) AS lo, max(x) AS hi FROM k GROUP BY set_id),
q AS (SELECT set_id, x FROM (SELECT DISTINCT x FROM k) JOIN rg ON x BETWEEN lo AND hi),
b AS (SELECT q.set_id, q.x, max(k.x) FILTER (k.x <= q.x) AS x0, min(k.x) FILTER (k.x >= q.x) AS x1 FROM q JOIN k USING (set_id) GROUP BY q.set_id, q.x, k.set_id) """.replace("FROM q JOIN k USING (set_id)", "FROM q JOIN k ON k.set_id = q.set_id") + """,
g AS (SELECT b.set_id, b.x, CASE WHEN x0 = x1 THEN a.y ELSE a.y + (c.y - a.y) * (b.x - x0) / (x1 - x0) END AS y FROM b JOIN k a ON a.set_id = b.set_id AND a.x = x0 JOIN k c ON c.set_id = b.set_id AND c.x = x1)"""


def _grid(spark, d):
    return rs.grid(scatter(spark, d), "x", "y")


@query("j08_grid", _GRID + " SELECT set_id, x, round(y, 6) AS y FROM g")
def j08(spark, d):
    return _grid(spark, d).select("set_id", "x", r("y").alias("y"))


@query("a26_average_interpolated", _GRID + " SELECT x, count(*) AS n, round(avg(y), 4) AS y FROM g GROUP BY x")
def a26(spark, d):
    return _grid(spark, d).groupBy("x").agg(F.count("*").alias("n"), r(F.avg("y"), 4).alias("y"))


@query("j09_segments", """WITH {S}, c AS (SELECT set_id, idx, CAST(floor(t / 6) AS BIGINT) AS segment FROM s)
SELECT set_id, idx, segment, coalesce(segment <> lag(segment) OVER o, true) AS starts, coalesce(segment <> lead(segment) OVER o, true) AS ends FROM c WINDOW o AS (PARTITION BY set_id ORDER BY idx)""")
def j09(spark, d):
    return jn.segments(series(spark, d), "t", 6.0).select("set_id", "idx", "segment", "starts", "ends")


@query("j09_segment_table", """WITH {S}, g AS (SELECT o_orderkey AS segment, o_custkey / 10.0 AS start, o_custkey / 10.0 + 0.25 AS end_ FROM orders)
SELECT set_id, idx, segment FROM s JOIN g ON t >= start AND t < end_""")
def j09b(spark, d):
    g = table(spark, d, "orders").select(F.col("o_orderkey").alias("segment"), (F.col("o_custkey") / 10.0).alias("start"), (F.col("o_custkey") / 10.0 + 0.25).alias("end"))
    return jn.in_segments(series(spark, d), "t", g).select("set_id", "idx", "segment")


@query("j09_long_segments", """WITH {S}, b AS (SELECT min(t) AS lo, max(t) AS hi FROM s), g AS (SELECT s_suppkey AS segment, lo + (hi - lo) * ((s_suppkey * 37) % 100) / 100.0 AS start, power(2.0, s_suppkey % 7) AS length FROM supplier, b
  UNION ALL SELECT 0, lo, hi - lo FROM b UNION ALL SELECT -1, lo - 1e6, 2e6 FROM b)
SELECT segment, count(*) AS n, sum(set_id) AS sets, sum(idx) AS places FROM s JOIN g ON t >= start AND t < start + length GROUP BY segment""")
def j09c(spark, d):
    s = series(spark, d)
    lo, hi = s.agg(F.min("t"), F.max("t")).first()
    k = F.col("s_suppkey")
    start = F.lit(lo) + F.lit(hi - lo) * ((k * 37) % 100) / 100.0
    g = table(spark, d, "supplier").select(k.alias("segment"), start.alias("start"), (start + F.pow(F.lit(2.0), k % 7)).alias("end"))
    g = g.unionByName(spark.createDataFrame([(0, lo, lo + (hi - lo)), (-1, lo - 1e6, lo - 1e6 + 2e6)], "segment long, start double, end double"))
    return jn.in_segments(s, "t", g, 2000).groupBy("segment").agg(F.count("*").alias("n"), F.sum("set_id").alias("sets"), F.sum("idx").alias("places"))


@query("j10_metadata", "WITH {P} SELECT set_id, idx, s_name AS title FROM p LEFT JOIN supplier ON s_suppkey = set_id")
def j10(spark, d):
    return jn.with_metadata(scatter(spark, d), sets(spark, d), "title").select("set_id", "idx", "title")


_STEPS = """WITH RECURSIVE {S}, q AS (SELECT set_id, idx, v, a / 360 AS i, t - coalesce(lag(t) OVER (PARTITION BY set_id ORDER BY idx), t) AS dt FROM s),
"""


@query("w12_recursive_filter", _STEPS + """f AS (SELECT set_id, idx, 0.0::DOUBLE + least(dt / 2.0, 1.0) * (v - 0.0) AS y FROM q WHERE idx = 0
  UNION ALL SELECT q.set_id, q.idx, y + least(q.dt / 2.0, 1.0) * (q.v - y) FROM f JOIN q ON q.set_id = f.set_id AND q.idx = f.idx + 1)
SELECT set_id, idx, round(y, 6) AS filtered FROM f""")
def w12(spark, d):
    return smooth.recursive_filters(series(spark, d), "v", 2.0, t="t").select("set_id", "idx", r("filtered").alias("filtered"))


@query("w12_recursive_filter_in_blocks", _STEPS + """f AS (SELECT set_id, idx, 0.0::DOUBLE + least(dt / 2.0, 1.0) * (v - 0.0) AS y FROM q WHERE idx = 0
  UNION ALL SELECT q.set_id, q.idx, y + least(q.dt / 2.0, 1.0) * (q.v - y) FROM f JOIN q ON q.set_id = f.set_id AND q.idx = f.idx + 1)
SELECT set_id, idx, round(y, 6) AS filtered FROM f""")
def w12c(spark, d):
    return smooth.recursive_filters_in_blocks(series(spark, d), "v", 2.0, t="t", block=32).select("set_id", "idx", r("filtered").alias("filtered"))


@query("w12_shunting_inhibition", _STEPS + """f AS (SELECT set_id, idx, 0.2 * v AS y FROM q WHERE idx = 0
  UNION ALL SELECT q.set_id, q.idx, y + 0.2 * (q.v - (1.0 + q.i) * y) FROM f JOIN q ON q.set_id = f.set_id AND q.idx = f.idx + 1)
SELECT set_id, idx, round(y, 6) AS filtered FROM f""")
def w12b(spark, d):
    s = series(spark, d).withColumn("inhibit", F.col("a") / 360)
    return smooth.recursive_filters(s, "v", 5.0, dt=1.0, y="inhibit", c=1.0).select("set_id", "idx", r("filtered").alias("filtered"))


@query("w12_shunting_inhibition_in_blocks", ORACLE["w12_shunting_inhibition"])
def w12d(spark, d):
    s = series(spark, d).withColumn("inhibit", F.col("a") / 360)
    return smooth.recursive_filters_in_blocks(s, "v", 5.0, dt=1.0, y="inhibit", c=1.0, block=32).select("set_id", "idx", r("filtered").alias("filtered"))


@query("w14_linear_interpolation", """WITH {S}, k AS (SELECT set_id, t, y FROM s WHERE y IS NOT NULL), q AS (SELECT set_id, CAST(t AS DOUBLE) AS t FROM (SELECT DISTINCT set_id FROM s), range(0, 700, 50) g(t)),
b AS (SELECT q.set_id, q.t, max(k.t) FILTER (k.t <= q.t) AS t0, min(k.t) FILTER (k.t >= q.t) AS t1 FROM q LEFT JOIN k ON k.set_id = q.set_id GROUP BY q.set_id, q.t)
SELECT b.set_id, b.t, round(CASE WHEN t0 = t1 THEN a.y ELSE a.y + (c.y - a.y) * (b.t - t0) / (t1 - t0) END, 5) AS value FROM b LEFT JOIN k a ON a.set_id = b.set_id AND a.t = t0 LEFT JOIN k c ON c.set_id = b.set_id AND c.t = t1""")
def w14(spark, d):
    s = series(spark, d)
    q = s.select("set_id").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(650), F.lit(50)))).withColumn("t", F.col("t").cast("double"))
    return rs.linear(q, s, "t", "y").select("set_id", "t", r("value", 5).alias("value"))


_SPLINE = """, n AS (SELECT *, count(*) OVER (PARTITION BY set_id) AS n, row_number() OVER (PARTITION BY set_id ORDER BY x) - 1 AS i, lead(x) OVER (PARTITION BY set_id ORDER BY x) - x AS h, (lead(y) OVER (PARTITION BY set_id ORDER BY x) - y) / (lead(x) OVER (PARTITION BY set_id ORDER BY x) - x) AS d FROM knots),
e AS (SELECT *, lag(h) OVER (PARTITION BY set_id ORDER BY i) AS g, 6 * (d - lag(d) OVER (PARTITION BY set_id ORDER BY i)) AS rhs FROM n),
there AS (SELECT set_id, i, 0.0::DOUBLE AS u, 0.0::DOUBLE AS z FROM e WHERE i = 0
  UNION ALL SELECT e.set_id, e.i, e.h / (2 * (e.g + e.h) - e.g * u), (e.rhs - e.g * z) / (2 * (e.g + e.h) - e.g * u) FROM there JOIN e ON e.set_id = there.set_id AND e.i = there.i + 1 WHERE e.i < e.n - 1),
back AS (SELECT set_id, i, 0.0::DOUBLE AS m FROM e WHERE i = n - 1
  UNION ALL SELECT there.set_id, there.i, CASE WHEN there.i = 0 THEN 0 ELSE z - u * m END FROM back JOIN there ON there.set_id = back.set_id AND there.i = back.i - 1),
k AS (SELECT e.set_id, e.i, e.n, e.x, e.y, e.h, m, lead(e.x) OVER w AS x1, lead(e.y) OVER w AS y1, lead(m) OVER w AS m1 FROM e JOIN back ON back.set_id = e.set_id AND back.i = e.i WINDOW w AS (PARTITION BY e.set_id ORDER BY e.i))"""
#: The spline's value at {at} in the piece k.
_PIECE = "((x1 - {at}) / h * y + ({at} - x) / h * y1 + ((power((x1 - {at}) / h, 3) - (x1 - {at}) / h) * m + (power(({at} - x) / h, 3) - ({at} - x) / h) * m1) * h * h / 6)"
_SERIES_KNOTS = """WITH RECURSIVE {S}, d AS (SELECT set_id, t AS x, avg(y) AS y FROM s GROUP BY ALL), b AS (SELECT set_id, min(x) FILTER (y IS NOT NULL) AS lo, max(x) FILTER (y IS NOT NULL) AS hi FROM d GROUP BY set_id),
o AS (SELECT d.set_id, x, y, row_number() OVER (PARTITION BY d.set_id ORDER BY x) AS r FROM d JOIN b ON b.set_id = d.set_id WHERE x BETWEEN lo AND hi),
z AS (SELECT *, last_value(y IGNORE NULLS) OVER a AS y0, last_value(CASE WHEN y IS NOT NULL THEN r END IGNORE NULLS) OVER a AS r0, first_value(y IGNORE NULLS) OVER f AS y1, first_value(CASE WHEN y IS NOT NULL THEN r END IGNORE NULLS) OVER f AS r1 FROM o
  WINDOW a AS (PARTITION BY set_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY set_id ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
knots AS (SELECT set_id, x, CASE WHEN y IS NOT NULL THEN y ELSE y0 + (y1 - y0) * (r - r0) / (r1 - r0) END AS y FROM z)""" + _SPLINE


@query("w15_spline_resample", _SERIES_KNOTS + """, r AS (SELECT set_id, min(x) AS lo, max(x) AS hi, max(n) AS n FROM k GROUP BY set_id), q AS (SELECT set_id, j AS idx, n, lo + j * ((hi - lo) / 49) AS at FROM r, range(50) g(j)),
p AS (SELECT q.set_id, q.idx, q.n, q.at, max(k.i) FILTER (k.x <= q.at AND k.i < k.n - 1) AS i FROM q JOIN k ON k.set_id = q.set_id GROUP BY ALL)
SELECT p.set_id, p.idx, round(p.at, 5) AS t, round(CASE WHEN p.n = 1 THEN y ELSE """ + _PIECE.replace("{at}", "p.at") + """ END, 4) AS y FROM p JOIN k ON k.set_id = p.set_id AND k.i = coalesce(p.i, 0)""")
def w15(spark, d):
    got = rs.spline_resample(series(spark, d), "t", "y", 50)
    return got.select("set_id", "idx", r("t", 5).alias("t"), r("y", 4).alias("y"))


@query("w15_spline_values", """WITH RECURSIVE {P}, knots AS (SELECT set_id, x, avg(y) AS y FROM p GROUP BY ALL)""" + _SPLINE + """, q AS (SELECT *, x + 0.25 * h AS place FROM k WHERE h IS NOT NULL)
SELECT set_id, place AS x, round(""" + _PIECE.replace("{at}", "place") + """, 4) AS value FROM q""")
def w15b(spark, d):
    p = scatter(spark, d)
    w = Window.partitionBy("set_id").orderBy("x")
    q = p.select("set_id", "x").distinct().withColumn("h", F.lead("x").over(w) - F.col("x")).where("h is not null").select("set_id", (F.col("x") + 0.25 * F.col("h")).alias("x"))
    return rs.spline_values(q, p, "x", "y").select("set_id", "x", r("value", 4).alias("value"))


@query("w16_spline_integral", _SERIES_KNOTS + """, c AS (SELECT *, greatest(x, 100.0) AS a, least(x1, 400.0) AS b FROM k WHERE h IS NOT NULL AND least(x1, 400.0) > greatest(x, 100.0)),
v AS (SELECT set_id, (b - a) / 6 * (""" + _PIECE.replace("{at}", "a") + " + 4 * " + _PIECE.replace("{at}", "((a + b) / 2)") + " + " + _PIECE.replace("{at}", "b") + """) AS part FROM c)
SELECT g.set_id, round(coalesce(sum(part), CASE WHEN max(g.n) IS NOT NULL THEN 0 END), 3) AS integral FROM (SELECT o.set_id, max(k.n) AS n FROM (SELECT DISTINCT set_id FROM s) o LEFT JOIN k ON k.set_id = o.set_id GROUP BY o.set_id) g LEFT JOIN v ON v.set_id = g.set_id GROUP BY g.set_id""")
def w16(spark, d):
    return rs.spline_integrals(series(spark, d), "t", "y", 100.0, 400.0).select("set_id", r("integral", 3).alias("integral"))


@query("w16_integral_in_blocks", _SERIES_KNOTS + """, c AS (SELECT *, greatest(x, 100.0) AS a, least(x1, 400.0) AS b FROM k),
v AS (SELECT set_id, CASE WHEN h IS NOT NULL AND b > a THEN (b - a) / 6 * (""" + _PIECE.replace("{at}", "a") + " + 4 * " + _PIECE.replace("{at}", "((a + b) / 2)") + " + " + _PIECE.replace("{at}", "b") + """) ELSE 0 END AS part FROM c)
SELECT set_id, round(sum(part), 3) AS integral FROM v GROUP BY set_id""")
def w16b(spark, d):
    pieces = rs.spline_pieces(series(spark, d), "t", "y", block=1000)
    return rs.integrals_of_pieces(pieces, 100.0, 400.0).select("set_id", r("integral", 3).alias("integral"))


_DFT = """WITH {S}, n AS (SELECT set_id, count(*) AS n FROM s GROUP BY set_id), k AS (SELECT set_id, n, unnest(range(n // 2 + 1)) AS k FROM n),
f AS (SELECT s.set_id, k.k, k.n, sum(v * cos(2 * pi() * ((k.k * idx) % k.n) / k.n)) AS re, -sum(v * sin(2 * pi() * ((k.k * idx) % k.n) / k.n)) AS im FROM k JOIN s ON s.set_id = k.set_id GROUP BY ALL)
SELECT set_id, k, round(re, 5) + 0 AS re, round(im, 5) + 0 AS im, round((re * re + im * im) / (n * n), 6) AS power FROM f"""


@query("w25_spectrum", _DFT)
def w25(spark, d):
    got = spectral.spectrum(series(spark, d), "v")
    return got.select("set_id", "k", (r("re", 5) + 0.0).alias("re"), (r("im", 5) + 0.0).alias("im"), r("power", 6).alias("power"))


@query("w25_spectrum_over_tasks", _DFT)
def w25b(spark, d):
    got = spectral.long_spectrum(series(spark, d), "v", cells=1 << 12)
    return got.select("set_id", "k", (r("re", 5) + 0.0).alias("re"), (r("im", 5) + 0.0).alias("im"), r("power", 6).alias("power"))


_INVERSE = "WITH {S}, n AS (SELECT set_id, count(*) AS n FROM s GROUP BY set_id)" + """, k AS (SELECT set_id, n, unnest(range(least(n // 2, 3) + 1)) AS k FROM n),
f AS (SELECT s.set_id, k.k, k.n, sum(v * cos(2 * pi() * ((k.k * idx) % k.n) / k.n)) AS re, -sum(v * sin(2 * pi() * ((k.k * idx) % k.n) / k.n)) AS im FROM k JOIN s ON s.set_id = k.set_id GROUP BY ALL)
SELECT s.set_id, s.idx, round(sum(CASE WHEN k = 0 THEN re WHEN 2 * k = n THEN re * cos(pi() * idx) ELSE 2 * (re * cos(2 * pi() * ((k * idx) % n) / n) - im * sin(2 * pi() * ((k * idx) % n) / n)) END / n), 5) AS value
FROM s JOIN f ON f.set_id = s.set_id GROUP BY s.set_id, s.idx"""


@query("w26_inverse", _INVERSE)
def w26(spark, d):
    low = spectral.spectrum(series(spark, d), "v").where("k <= 3")  # only the lowest frequencies go back
    return spectral.inverse(low).select("set_id", "idx", r("value", 5).alias("value"))


@query("w26_inverse_over_tasks", _INVERSE)
def w26b(spark, d):
    low = spectral.long_spectrum(series(spark, d), "v", cells=1 << 12).where("k <= 3")
    return spectral.long_inverse(low, cells=1 << 12).select("set_id", "idx", r("value", 5).alias("value"))


@query("w27_cyclic_convolution", """WITH {S}, n AS (SELECT *, count(*) OVER (PARTITION BY set_id) AS n FROM s)
SELECT a.set_id, a.idx, round(0.25 * b.v + 0.5 * a.v + 0.25 * c.v, 5) AS value FROM n a JOIN n b ON b.set_id = a.set_id AND b.idx = (a.idx + a.n - 1) % a.n JOIN n c ON c.set_id = a.set_id AND c.idx = (a.idx + 1) % a.n""")
def w27(spark, d):
    return spectral.cyclic_convolution(series(spark, d), "v", [0.25, 0.5, 0.25]).select("set_id", "idx", r("value", 5).alias("value"))


_LONG_MASK = [0.05, -0.2, 0.3, 0.6, 0.15, -0.1, 0.02]


_WRAPPED = """WITH {S}, n AS (SELECT *, count(*) OVER (PARTITION BY set_id) AS n FROM s), m AS (SELECT unnest(range(7)) AS j, unnest([0.05, -0.2, 0.3, 0.6, 0.15, -0.1, 0.02]) AS m)
SELECT a.set_id, a.idx, round(sum(m * b.v), 5) AS value FROM n a, m JOIN n b ON b.set_id = a.set_id AND b.idx = (a.idx - j + 3 + 7 * a.n) % a.n GROUP BY a.set_id, a.idx"""


@query("w27_long_mask", _WRAPPED)
def w27c(spark, d):
    return spectral.cyclic_convolution(series(spark, d), "v", _LONG_MASK).select("set_id", "idx", r("value", 5).alias("value"))


@query("w27_long_mask_over_tasks", _WRAPPED)
def w27d(spark, d):
    return spectral.long_cyclic_convolution(series(spark, d), "v", _LONG_MASK, cells=1 << 12).select("set_id", "idx", r("value", 5).alias("value"))


@query("w27_deconvolution", "WITH {S} SELECT set_id, idx, round(v, 4) AS value FROM s")
def w27b(spark, d):
    mask = [0.2, 0.6, 0.1]
    there = spectral.cyclic_convolution(series(spark, d), "v", mask)
    return spectral.cyclic_convolution(there, "value", mask, deconvolve=True).select("set_id", "idx", r("value", 4).alias("value"))


@query("w27_deconvolution_over_tasks", "WITH {S} SELECT set_id, idx, round(v, 4) AS value FROM s")
def w27e(spark, d):
    mask = [0.2, 0.6, 0.1]
    there = spectral.cyclic_convolution(series(spark, d), "v", mask)
    return spectral.long_cyclic_convolution(there, "value", mask, deconvolve=True, cells=1 << 12).select("set_id", "idx", r("value", 4).alias("value"))


@query("a33_correlation", "WITH {P}, " + _J + """, c AS (SELECT set_a, set_b, count(*) AS n, corr(a_x, b_x) AS rx, corr(a_y, b_y) AS ry, corr(a_e, b_e) AS re FROM j GROUP BY ALL)
SELECT set_a, set_b, round(rx, 8) AS rx, round(ry, 8) AS ry, round(re, 8) AS re, round((rx + ry + re) / 3, 8) AS r FROM c""")
def a33(spark, d):
    p = scatter(spark, d)
    got = st.correlation(jn.paired(p, pairs(p), "x", "y", "e"), ["set_a", "set_b"], [("a_x", "b_x"), ("a_y", "b_y"), ("a_e", "b_e")])
    return got.select("set_a", "set_b", r("r0", 8).alias("rx"), r("r1", 8).alias("ry"), r("r2", 8).alias("re"), r("r", 8).alias("r"))


@query("a34_correlation_two_pass", "WITH {P}, " + _J + " SELECT set_a, set_b, round(corr(a_y, b_y), 8) AS r FROM j GROUP BY ALL")
def a34(spark, d):
    p = scatter(spark, d)
    return st.correlation_two_pass(jn.paired(p, pairs(p), "y"), ["set_a", "set_b"], "a_y", "b_y").select("set_a", "set_b", r("r", 8).alias("r"))


@query("a35_figural_distance", _CLOSE + " SELECT set_a, set_b, count(*) AS n, round(avg(sqrt(b.d)), 7) AS distance FROM m GROUP BY ALL")
def a35(spark, d):
    p = thousands(spark, d)
    return cmp.figural_distance(p, pairs(p)).select("set_a", "set_b", "n", r("distance", 7).alias("distance"))


@query("a35_pointwise_distance", "WITH {P0}, " + _Q + ", " + _J + """ SELECT set_a, set_b, count(*) AS n, round(avg(sqrt(sqrt(power(a_x - b_x, 2) + power(a_y - b_y, 2)))), 7) AS distance,
  round(avg(abs(a_e - b_e)) / 180, 9) AS orientation FROM j GROUP BY ALL""")
def a35b(spark, d):
    p = thousands(spark, d)
    got = cmp.figural_distance(p, pairs(p), pointwise=True, transform="power", parameter=0.5, orientation="e")
    return got.select("set_a", "set_b", "n", r("distance", 7).alias("distance"), r("orientation", 9).alias("orientation"))


@query("a36_mean_direction", _CLOSE + """, v AS (SELECT set_a, set_b, CASE direction WHEN 12 THEN 1 ELSE -1 END * (b.x - x) AS dx, CASE direction WHEN 12 THEN 1 ELSE -1 END * (b.y - y) AS dy, sqrt(b.d) AS d FROM m),
a AS (SELECT set_a, set_b, degrees(atan2(sum(CASE WHEN d = 0 THEN 0 ELSE dy / d END), sum(CASE WHEN d = 0 THEN 1 ELSE dx / d END))) AS g FROM v GROUP BY ALL)
SELECT set_a, set_b, round(CASE WHEN g < 0 THEN g + 360 ELSE g END, 4) AS direction FROM a""")
def a36(spark, d):
    p = thousands(spark, d)
    return cmp.mean_direction(p, pairs(p)).select("set_a", "set_b", r("direction", 4).alias("direction"))


_GRID_PARAMETERS = [{"scale": s, "angle": a, "dx": x} for s in (0.8, 1.0) for a in (0.0, 15.0, -30.0) for x in (0.0, 5.0)]
_GRID_SQL = ", ".join(f"({k}, {p['scale']}, {p['angle']}, {p['dx']})" for k, p in enumerate(_GRID_PARAMETERS))


@query("a37_alignment", "WITH {P0}, " + _Q + ", " + _J + f""", g AS (SELECT * FROM (VALUES {_GRID_SQL}) t(p_id, s, a, dx)),
v AS (SELECT set_a, set_b, p_id, avg(sqrt(power(a_x - (b_x * s * cos(radians(a)) - b_y * s * sin(radians(a)) + dx), 2) + power(a_y - (b_x * s * sin(radians(a)) + b_y * s * cos(radians(a))), 2))) AS score FROM j, g GROUP BY ALL)
SELECT set_a, set_b, CAST(arg_min(p_id, score) AS INTEGER) AS p_id, round(min(score), 6) AS score FROM v GROUP BY ALL""")
def a37(spark, d):
    p = thousands(spark, d)
    return cmp.best_alignment(p, pairs(p), _GRID_PARAMETERS).select("set_a", "set_b", "p_id", r("score").alias("score"))


@query("a37_alignment_by_correlation", "WITH {P0}, " + _Q + ", " + _J + f""", g AS (SELECT * FROM (VALUES {_GRID_SQL}) t(p_id, s, a, dx)),
v AS (SELECT set_a, set_b, p_id, (corr(a_x, b_x * s * cos(radians(a)) - b_y * s * sin(radians(a)) + dx) + corr(a_y, b_x * s * sin(radians(a)) + b_y * s * cos(radians(a)))) / 2 AS score FROM j, g GROUP BY ALL),
m AS (SELECT set_a, set_b, max(score) AS score FROM v GROUP BY ALL)
SELECT set_a, set_b, round(score, 6) AS score FROM m""")
def a37b(spark, d):
    p = thousands(spark, d)
    # scale and shift leave a correlation as it is, so that several parameters may win
    return cmp.best_alignment(p, pairs(p), _GRID_PARAMETERS, correlation=True).select("set_a", "set_b", r("score").alias("score"))


@query("a37_alignment_over_a_table", "WITH {P0}, " + _Q + ", " + _J + """, g AS (SELECT i * 100 + k AS p_id, 0.5 + i / 20.0 AS s, 0.0 + 3.6 * k AS a, -2.0 + ((i + k) % 5) AS dx FROM range(20) t(i), range(100) u(k)),
v AS (SELECT set_a, set_b, p_id, avg(sqrt(power(a_x - (b_x * s * cos(radians(a)) - b_y * s * sin(radians(a)) + dx), 2) + power(a_y - (b_x * s * sin(radians(a)) + b_y * s * cos(radians(a))), 2))) AS score FROM j, g GROUP BY ALL)
SELECT set_a, set_b, CAST(arg_min(p_id, score) AS BIGINT) AS p_id, round(min(score), 6) AS score FROM v GROUP BY ALL""")
def a37c(spark, d):
    p = thousands(spark, d)
    i, k = F.floor(F.col("id") / 100), F.col("id") % 100
    grid = spark.range(2000).select(F.col("id").alias("p_id"), (0.5 + i / 20.0).alias("scale"), (k * 3.6).alias("angle"), (-2.0 + (i + k) % 5).alias("dx"))
    return cmp.best_alignment(p, pairs(p), grid).select("set_a", "set_b", "p_id", r("score").alias("score"))


@query("a38_closeness", "WITH {P}, " + _J + """ SELECT set_a, set_b, round(1 - avg(abs(a_y - b_y)) / (greatest(max(a_y), max(b_y)) - least(min(a_y), min(b_y))), 8) AS closeness_y,
  round(1 - avg(abs(a_e - b_e)) / (greatest(max(a_e), max(b_e)) - least(min(a_e), min(b_e))), 8) AS closeness_e FROM j GROUP BY ALL""")
def a38(spark, d):
    p = scatter(spark, d)
    return cmp.closeness(p, pairs(p)).select("set_a", "set_b", r("closeness_y", 8).alias("closeness_y"), r("closeness_e", 8).alias("closeness_e"))


_OVERLAP = "WITH {P0}, p AS (SELECT set_id, idx, x, x AS y, round(e * 100) AS e, w FROM p0), " + _J + """, o AS (SELECT set_a, set_b, a_w + b_w AS w, 2 * least(a_e, b_e) AS s, greatest(0, least(a_y + a_e, b_y + b_e) - greatest(a_y - a_e, b_y - b_e)) AS c, least(a_y + a_e, b_y + b_e) >= greatest(a_y - a_e, b_y - b_e) AS met,
  CASE WHEN least(a_e, b_e) = greatest(a_e, b_e) THEN a_y = b_y ELSE least(a_y + a_e, b_y + b_e) >= greatest(a_y - a_e, b_y - b_e) END AS same FROM j),
h AS (SELECT set_a, set_b, w, CASE WHEN s = 0 THEN CASE WHEN same THEN 1 ELSE 0 END ELSE c / s END AS v FROM o),
g AS (SELECT set_a, set_b, count(*) AS n, sum(w) AS sw, sum(w * v) / sum(w) AS overlap, sum(w * v * v) AS s2 FROM h GROUP BY ALL),
q AS (SELECT set_a, set_b, overlap, CASE WHEN n > 1 THEN sqrt(greatest(n / sw * s2 - n * overlap * overlap, 0) / (n - 1)) ELSE 0 END AS spread FROM g)"""


def _overlaps(spark, d):
    p = scatter(spark, d).withColumns({"y": F.col("x"), "e": F.round(F.col("e") * 100)})
    return cmp.overlap(p, pairs(p), "w")


@query("a39_overlap", _OVERLAP + " SELECT set_a, set_b, round(overlap, 8) AS overlap, round(spread, 6) AS spread FROM q")
def a39(spark, d):
    return _overlaps(spark, d).select("set_a", "set_b", r("overlap", 8).alias("overlap"), r("spread").alias("spread"))


@query("a39_overall_overlap", _OVERLAP + " SELECT count(*) AS pairs, round(avg(overlap), 8) AS overlap, round(coalesce(stddev_samp(overlap), 0), 7) AS overlap_stdev, round(avg(spread), 7) AS spread, round(coalesce(stddev_samp(spread), 0), 7) AS spread_stdev FROM q")
def a39b(spark, d):
    got = cmp.overall_overlap(_overlaps(spark, d))
    return got.select("pairs", r("overlap", 8).alias("overlap"), *[r(c, 7).alias(c) for c in ("overlap_stdev", "spread", "spread_stdev")])


@query("a40_turtle_distance", "WITH {P}, " + _J + " SELECT set_a, set_b, round(sum(b_x - a_x) / (sum(a_x) + 1), 9) AS distance FROM j GROUP BY ALL")
def a40(spark, d):
    p = scatter(spark, d)
    return cmp.turtle_distance(p, pairs(p), "x").select("set_a", "set_b", r("distance", 9).alias("distance"))


@query("o01_sorted", "SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS place FROM part")
def o01(spark, d):
    return with_positions(table(spark, d, "part").select("p_partkey", "p_size"), [F.col("p_size").desc(), "p_partkey"], "place").orderBy("place")


@query("o02_sorted_sets", "WITH {P} SELECT set_id, idx, row_number() OVER (PARTITION BY set_id ORDER BY x * e, y DESC, idx) - 1 AS place FROM p")
def o02(spark, d):
    w = Window.partitionBy("set_id").orderBy(F.col("x") * F.col("e"), F.col("y").desc(), "idx")
    return scatter(spark, d).select("set_id", "idx", (F.row_number().over(w) - 1).cast("long").alias("place"))


@query("o03_comparator", """SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(embedding, lambda x: CAST(round(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT))), lambda v: CAST(v AS VARCHAR)), ',') AS sorted FROM embeddings""")
def o03(spark, d):
    e = F.transform("embedding", lambda x: F.round(F.abs(x.cast("double")) * 1000).cast("long"))
    by = F.array_sort(e, lambda a, b: F.when(a < b, -1).when(a > b, 1).otherwise(0))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(by, lambda v: v.cast("string")), ",").alias("sorted"))


@query("o04_truncated", "WITH {P} SELECT set_id, idx, x FROM p WHERE idx < 10")
def o04(spark, d):
    return scatter(spark, d).where("idx < 10").select("set_id", "idx", "x")


@query("o05_lowest_highest", """WITH {P} SELECT set_id, arg_min(idx, {'y': y, 'i': idx}) AS lowest, arg_max(idx, {'y': y, 'i': idx}) AS highest FROM p GROUP BY set_id""")
def o05(spark, d):
    k = F.struct("y", "idx")
    return scatter(spark, d).groupBy("set_id").agg(F.min_by("idx", k).alias("lowest"), F.max_by("idx", k).alias("highest"))


@query("o05_top_three", """WITH {P}, k AS (SELECT set_id, idx, y, row_number() OVER (PARTITION BY set_id ORDER BY y DESC, idx) AS k FROM p) SELECT set_id, idx, y FROM k WHERE k <= 3""")
def o05b(spark, d):
    w = Window.partitionBy("set_id").orderBy(F.col("y").desc(), "idx")
    return scatter(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 3").select("set_id", "idx", "y")


@query("o06_sets_reordered", "SELECT s_suppkey AS set_id, row_number() OVER (ORDER BY s_nationkey = 7 DESC, s_suppkey) - 1 AS place FROM supplier")
def o06(spark, d):
    return with_positions(table(spark, d, "supplier").select(F.col("s_suppkey").alias("set_id"), "s_nationkey"), [(F.col("s_nationkey") == 7).desc(), "set_id"], "place").select("set_id", "place")


@query("u01_appended", "SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def u01(spark, d):
    c = table(spark, d, "customer").select(F.col("c_acctbal").alias("o_totalprice"), F.col("c_custkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").unionByName(c)


@query("u02_new_fields", "SELECT s_suppkey AS k, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer")
def u02(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u03_points_added", """WITH {P}, n AS (SELECT set_id, max(idx) + 1 AS n FROM p GROUP BY set_id)
SELECT set_id, idx, x FROM p WHERE set_id <> 4 UNION ALL SELECT n.set_id, n + p.idx, p.x * 2 FROM p JOIN n ON n.set_id = p.set_id WHERE p.idx < 2 AND n.set_id <> 4""")
def u03(spark, d):
    p = scatter(spark, d).select("set_id", "idx", "x")
    n = p.groupBy("set_id").agg((F.max("idx") + 1).alias("n"))
    new = p.where("idx < 2").join(n, "set_id").select("set_id", (F.col("n") + F.col("idx")).alias("idx"), (F.col("x") * 2).alias("x"))
    gone = table(spark, d, "supplier").where("s_suppkey = 4").select(F.col("s_suppkey").alias("set_id"))
    return p.unionByName(new).join(gone, "set_id", "left_anti")


@query("u04_linked_set", "WITH {P} SELECT set_id, idx, x, y FROM p UNION ALL SELECT set_id + 1000000, idx, y, e FROM p")
def u04(spark, d):
    p = scatter(spark, d)
    linked = p.select((F.col("set_id") + 1000000).alias("set_id"), "idx", F.col("y").alias("x"), F.col("e").alias("y"))
    return p.select("set_id", "idx", "x", "y").unionByName(linked)

