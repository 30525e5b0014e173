"""Queries of aggregations (A1 to A43; those on pairs of sets are in compare)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pointloom.operators import order_stats as os_
from pointloom.operators import stats as st
from pointloom.plans.registry import ORACLE, query, r, scatter, series, table

_BINS = """b AS (SELECT set_id, count(x) AS n, sum(w) AS w_sum, sum(w * x) AS s1, sum(w * x * x) AS s2, sum(w * x * x * x) AS s3,
  min(x) AS mn, max(x) AS mx FROM p GROUP BY set_id),
v AS (SELECT *, n / w_sum AS f, CASE WHEN n > 1 THEN greatest((n / w_sum * s2 - power(n / w_sum * s1, 2) / n) / (n - 1), 0) ELSE 0 END AS var FROM b)"""
_ORDERS = """o AS (SELECT o_orderpriority AS k, o_totalprice / 1000 AS x FROM orders),
g AS (SELECT k, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM o GROUP BY k),
pr AS (SELECT a.k AS k1, b.k AS k2, a.n AS n1, b.n AS n2, a.m AS m1, b.m AS m2, a.v AS v1, b.v AS v2 FROM g a JOIN g b ON a.k < b.k)"""


#: Simpson's rule over the densities of Student's t (from 0 to |t|) and of F (from 0 to f).
_T_P = """greatest(0, 1 - 2 * abs({t}) / 6000 * list_sum(list_transform(range(0, 2001), lambda k: CASE WHEN k % 2000 = 0 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
  * exp(lgamma(({d} + 1) / 2) - lgamma({d} / 2) - 0.5 * ln({d} * pi()) - ({d} + 1) / 2 * ln(1 + power({t} * k / 2000, 2) / {d})))))"""
_F_P = """2 * (1 - f / 12000 * list_sum(list_transform(range(1, 4001), lambda k: CASE WHEN k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
  * exp(lgamma((d1 + d2) / 2) - lgamma(d1 / 2) - lgamma(d2 / 2) + d1 / 2 * ln(d1 / d2) + (d1 / 2 - 1) * ln(f * k / 4000) - (d1 + d2) / 2 * ln(1 + d1 * f * k / 4000 / d2)))))"""
_TESTS = _ORDERS + """, q AS (SELECT *, greatest(v1, v2) / least(v1, v2) AS f, (CASE WHEN v1 >= v2 THEN n1 ELSE n2 END - 1)::DOUBLE AS d1, (CASE WHEN v1 >= v2 THEN n2 ELSE n1 END - 1)::DOUBLE AS d2,
  (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1::DOUBLE + 1.0 / n2::DOUBLE)) AS t, (n1 + n2 - 2)::DOUBLE AS td, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS ut,
  power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)) AS ud FROM pr),
z AS (SELECT *, """ + _F_P + " AS fp, " + _T_P.replace("{t}", "t").replace("{d}", "td") + " AS tp, " + _T_P.replace("{t}", "ut").replace("{d}", "ud") + """ AS up FROM q),
y AS (SELECT * REPLACE (CASE WHEN fp > 1 THEN 2 - fp ELSE fp END AS fp) FROM z)"""


def _orders(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), (F.col("o_totalprice") / 1000).alias("x"))
    return st.pairs_of(st.bins(o, ["k"], "x"), "k")


@query("a01_bins", "WITH {P}, " + _BINS + " SELECT set_id, n, round(w_sum, 6) AS w_sum, round(s1, 5) AS s1, mn AS min, mx AS max FROM v")
def a01(spark, d):
    return st.bins(scatter(spark, d), ["set_id"], "x", "w").select("set_id", "n", r("w_sum").alias("w_sum"), r("s1", 5).alias("s1"), "min", "max")


@query("a02_sums", "WITH {P}, " + _BINS + " SELECT set_id, n, round(w_sum, 6) AS w_sum, round(s1, 5) AS s1, round(s2, 3) AS s2, round(s3, 1) AS s3 FROM v")
def a02(spark, d):
    return st.bins(scatter(spark, d), ["set_id"], "x", "w").select("set_id", "n", r("w_sum").alias("w_sum"), r("s1", 5).alias("s1"), r("s2", 3).alias("s2"), r("s3", 1).alias("s3"))


@query("a03_mean", "WITH {P}, " + _BINS + " SELECT set_id, round(s1 / w_sum, 8) AS mean FROM v")
def a03(spark, d):
    return st.describe(scatter(spark, d), ["set_id"], "x", "w").select("set_id", r("mean", 8).alias("mean"))


@query("a04_spread", "WITH {P}, " + _BINS + " SELECT set_id, round(sqrt(var), 7) AS stdev, round(sqrt(var / n), 7) AS stderr, round(sqrt(var) / (s1 / w_sum), 7) AS cv FROM v")
def a04(spark, d):
    return st.describe(scatter(spark, d), ["set_id"], "x", "w").select("set_id", r("stdev", 7).alias("stdev"), r("stderr", 7).alias("stderr"), r("cv", 7).alias("cv"))


@query("a04_spread_two_pass", """WITH {P}, m AS (SELECT *, sum(w * y) OVER (PARTITION BY set_id) / sum(w) OVER (PARTITION BY set_id) AS mean FROM p)
SELECT set_id, count(*) AS n, round(max(mean), 5) AS mean, round(CASE WHEN count(*) > 1 THEN sqrt(sum(w * power(y - mean, 2)) * count(*) / sum(w) / (count(*) - 1)) ELSE 0 END, 4) AS stdev FROM m GROUP BY set_id""")
def a04b(spark, d):
    return st.stdev_two_pass(scatter(spark, d), ["set_id"], "y", "w").select("set_id", "n", r("mean", 5).alias("mean"), r("stdev", 4).alias("stdev"))


@query("a05_skew", "WITH {P}, " + _BINS + """ SELECT set_id, CASE WHEN n > 1 AND var > 0 THEN
  round((3 * (f * s1 / n) * f * s2 - f * s3 - 2 * power(f * s1, 3) / (n * n)) / (sqrt(var) * n), 4) ELSE 0 END AS skew FROM v""")
def a05(spark, d):
    return st.describe(scatter(spark, d), ["set_id"], "x", "w").select("set_id", r("skew", 4).alias("skew"))


@query("a06_extremes", """WITH {P}, q AS (SELECT set_id, x - 25 AS x FROM p)
SELECT set_id, min(x) AS min, max(x) AS max, coalesce(min(x) FILTER (x > 0), -1) AS pos_min, coalesce(max(x) FILTER (x < 0), 1) AS neg_max FROM q GROUP BY set_id""")
def a06(spark, d):
    return st.bins(scatter(spark, d).withColumn("x", F.col("x") - 25), ["set_id"], "x").select("set_id", "min", "max", "pos_min", "neg_max")


@query("a07_median", "WITH {P} SELECT set_id, round(median(y), 6) AS median FROM p GROUP BY set_id")
def a07(spark, d):
    return scatter(spark, d).groupBy("set_id").agg(r(st.median("y")).alias("median"))


@query("a08_quantile", "WITH {P} SELECT set_id, round(quantile_cont(y, 0.1), 4) AS q10, round(quantile_cont(y, 0.9), 4) AS q90 FROM p GROUP BY set_id")
def a08(spark, d):
    return scatter(spark, d).groupBy("set_id").agg(r(st.quantile("y", 0.1), 4).alias("q10"), r(st.quantile("y", 0.9), 4).alias("q90"))


@query("a09_median_deviation", """WITH {P}, m AS (SELECT set_id, median(x) AS median FROM p GROUP BY set_id)
SELECT set_id, max(median) AS median, round(median(abs(x - median)) * 1.482602218505602, 8) AS adev FROM p JOIN m USING (set_id) GROUP BY set_id""")
def a09(spark, d):
    return st.median_deviation(scatter(spark, d), ["set_id"], "x").select("set_id", "median", r("adev", 8).alias("adev"))


# Bins of more than 50 values count as large here, so that they are dealt over ranges, eight of them at least.
@query("a07_median_of_large_bins", ORACLE["a07_median"])
def a07b(spark, d):
    return os_.medians(scatter(spark, d), ["set_id"], "y", 50, 8).select("set_id", r("median").alias("median"))


@query("a08_quantile_of_large_bins", ORACLE["a08_quantile"])
def a08b(spark, d):
    got = os_.quantiles(scatter(spark, d), ["set_id"], "y", [0.1, 0.9], 50, 8)
    return got.select("set_id", *[r(F.get("q", F.lit(k)), 4).alias(name) for k, name in enumerate(("q10", "q90"))])


@query("a09_median_deviation_of_large_bins", ORACLE["a09_median_deviation"])
def a09b(spark, d):
    got = os_.median_deviations(scatter(spark, d), ["set_id"], "x", st.MAD, 50, 8)
    return got.select("set_id", "median", r("adev", 8).alias("adev"))


@query("a10_angular", """WITH {S}, c AS (SELECT set_id, count(a) AS n, min(a) AS mn, max(a) AS mx, degrees(atan2(sum(sin(radians(a))), sum(cos(radians(a))))) AS g FROM s GROUP BY set_id),
m AS (SELECT *, CASE WHEN g < 0 THEN g + 360 ELSE g END AS mean FROM c),
o AS (SELECT s.set_id, n, mn, mx, mean, a - mean - 360 * floor((a - mean + 180) / 360) AS dd FROM s JOIN m USING (set_id))
SELECT set_id, max(n) AS n, round(max(mn), 4) AS min, round(max(mx), 4) AS max, round(max(mean), 6) AS mean,
  round(CASE WHEN max(n) > 1 THEN sqrt((sum(dd * dd) - sum(dd) * sum(dd) / count(*)) / (count(*) - 1)) ELSE 0 END, 6) AS stdev FROM o GROUP BY set_id""")
def a10(spark, d):
    got = st.angular(series(spark, d), ["set_id"], "a")
    return got.select("set_id", "n", r("min", 4).alias("min"), r("max", 4).alias("max"), r("mean").alias("mean"), r("stdev").alias("stdev"))


@query("a11_f_test", "WITH " + _ORDERS + """ SELECT k1, k2, round(greatest(v1, v2) / least(v1, v2), 8) AS f, CASE WHEN v1 >= v2 THEN n1 ELSE n2 END - 1 AS f_df1,
  CASE WHEN v1 >= v2 THEN n2 ELSE n1 END - 1 AS f_df2 FROM pr""")
def a11(spark, d):
    return st.f_test(_orders(spark, d)).select("k1", "k2", r("f", 8).alias("f"), "f_df1", "f_df2")


@query("a11_f_probability", "WITH " + _TESTS + " SELECT k1, k2, round(fp, 6) AS f_p FROM y")
def a11p(spark, d):
    return st.f_test(_orders(spark, d)).select("k1", "k2", r("f_p").alias("f_p"))


@query("a12_t_test", "WITH " + _ORDERS + """ SELECT k1, k2, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1::DOUBLE + 1.0 / n2::DOUBLE)), 7) AS t, (n1 + n2 - 2)::DOUBLE AS t_df FROM pr""")
def a12(spark, d):
    return st.t_test(_orders(spark, d)).select("k1", "k2", r("t", 7).alias("t"), "t_df")


@query("a12_t_probability", "WITH " + _TESTS + " SELECT k1, k2, round(tp, 6) AS t_p FROM y")
def a12p(spark, d):
    return st.t_test(_orders(spark, d)).select("k1", "k2", r("t_p").alias("t_p"))


@query("a13_t_test_unequal", "WITH " + _ORDERS + """ SELECT k1, k2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 7) AS u_t,
  round(power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)), 4) AS u_df FROM pr""")
def a13(spark, d):
    return st.t_test_unequal(_orders(spark, d)).select("k1", "k2", r("u_t", 7).alias("u_t"), r("u_df", 4).alias("u_df"))


@query("a14_t_test_paired", """WITH {P}, j AS (SELECT a.set_id, a.x AS u, b.x AS v FROM p a JOIN p b ON b.set_id = a.set_id + 1 AND a.idx = b.idx)
SELECT set_id, count(*) AS n, round((avg(u) - avg(v)) / sqrt((var_samp(u) + var_samp(v) - 2 * covar_samp(u, v)) / count(*)), 7) AS t, (count(*) - 1)::DOUBLE AS df FROM j GROUP BY set_id HAVING count(*) > 1""")
def a14(spark, d):
    p = scatter(spark, d)
    b = p.select((F.col("set_id") - 1).alias("set_id"), "idx", F.col("x").alias("v"))
    pairs = p.select("set_id", "idx", F.col("x").alias("u")).join(b, ["set_id", "idx"])
    return st.t_test_paired(pairs, ["set_id"], "u", "v").where("n > 1").select("set_id", "n", r("t", 7).alias("t"), "df")


@query("a15_t_test_chosen", "WITH " + _TESTS + " SELECT k1, k2, round(fp, 6) AS f_p, round(CASE WHEN fp < 0.05 THEN ut ELSE t END, 7) AS c_t, round(CASE WHEN fp < 0.05 THEN up ELSE tp END, 6) AS c_p FROM y")
def a15(spark, d):
    return st.t_test_chosen(_orders(spark, d)).select("k1", "k2", r("f_p").alias("f_p"), r("c_t", 7).alias("c_t"), r("c_p").alias("c_p"))


_CHI = """c AS (SELECT o_orderpriority AS k, o_orderstatus AS s, count(*)::DOUBLE AS o FROM orders GROUP BY ALL)"""


def _status(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k"), F.col("o_orderstatus").alias("s")).agg(F.count("*").cast("double").alias("o"))


@query("a16_chi2", "WITH " + _CHI + """, e AS (SELECT k, s, o, sum(o) OVER (PARTITION BY k) / count(*) OVER (PARTITION BY k) AS e FROM c)
SELECT k, round(sum(power(o - e, 2) / e), 8) AS chi2, (count(*) - 1)::DOUBLE AS df FROM e GROUP BY k""")
def a16(spark, d):
    w = Window.partitionBy("k")
    rows = _status(spark, d).withColumn("e", F.sum("o").over(w) / F.count("*").over(w))
    return st.chi2(rows, ["k"], "o", "e").select("k", r("chi2", 8).alias("chi2"), "df")


@query("a16_chi2_probability", "WITH " + _CHI + """, e AS (SELECT k, s, o, sum(o) OVER (PARTITION BY k) / count(*) OVER (PARTITION BY k) AS e FROM c), t AS (SELECT k, sum(power(o - e, 2) / e) / 2 AS h, (count(*) - 1) / 2.0 AS a FROM e GROUP BY k)
SELECT k, round(1 - list_sum(list_transform(range(0, 3000), lambda n: exp(a * ln(h) - h + n * ln(h) - lgamma(a + n + 1)))), 6) + 0 AS p FROM t""")
def a16p(spark, d):
    w = Window.partitionBy("k")
    rows = _status(spark, d).withColumn("e", F.sum("o").over(w) / F.count("*").over(w))
    return st.chi2(rows, ["k"], "o", "e").select("k", r("p").alias("p"))


@query("a17_chi2_two", "WITH " + _CHI + """, j AS (SELECT coalesce(a.s, b.s) AS s, coalesce(a.o, 0) AS a, coalesce(b.o, 0) AS b
  FROM (SELECT * FROM c WHERE k = '1-URGENT') a FULL JOIN (SELECT * FROM c WHERE k = '5-LOW') b ON a.s = b.s),
t AS (SELECT sum(a) AS sa, sum(b) AS sb FROM j)
SELECT 1 AS g, round(sum(power(sqrt(sb / sa) * a - sqrt(sa / sb) * b, 2) / (a + b)), 8) AS chi2, (count(*) - 1)::DOUBLE AS df FROM j, t""")
def a17(spark, d):
    c = _status(spark, d)
    a, b = (c.where(F.col("k") == k).select("s", F.col("o").alias(n)) for k, n in (("1-URGENT", "a"), ("5-LOW", "b")))
    rows = a.join(b, "s", "full").fillna(0.0).withColumn("g", F.lit(1))
    return st.chi2_two(rows, ["g"], "a", "b").select("g", r("chi2", 8).alias("chi2"), "df")


@query("a18_histogram", """WITH {P}, h AS (SELECT x AS value, count(*)::DOUBLE AS h FROM p GROUP BY x),
k AS (SELECT unnest([1.0, 2.0, 7.0, 99.0]::DOUBLE[]) AS value), c AS (SELECT value, coalesce(h, 0) AS h FROM k LEFT JOIN h USING (value))
SELECT 'all' AS kind, value, round(h / max(h) OVER (), 9) AS h FROM h UNION ALL SELECT 'classes', value, round(h / sum(h) OVER (), 9) FROM c""")
def a18(spark, d):
    p = scatter(spark, d)
    classes = table(spark, d, "lineitem").where("l_quantity in (1, 2, 7)").select("l_quantity").distinct().unionAll(spark.createDataFrame([(99.0,)], "v double"))
    a, b = st.histogram(p, "x", normalise="max"), st.histogram(p, "x", classes=classes, normalise="sum")
    return a.select(F.lit("all").alias("kind"), "value", r("h", 9).alias("h")).unionAll(b.select(F.lit("classes").alias("kind"), "value", r("h", 9).alias("h")))


@query("a19_distinct", "SELECT DISTINCT l_quantity, l_returnflag FROM lineitem")
def a19(spark, d):
    return table(spark, d, "lineitem").select("l_quantity", "l_returnflag").distinct().orderBy("l_quantity", "l_returnflag")


@query("a20_mean_std", """SELECT o_orderpriority AS k, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 3) AS std,
  round(stddev_pop(o_totalprice) / sqrt(count(*)), 4) AS sem FROM orders GROUP BY 1""")
def a20(spark, d):
    x = F.col("o_totalprice")
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(r(F.avg(x), 4).alias("mean"), r(F.stddev_pop(x), 3).alias("std"), r(F.stddev_pop(x) / F.sqrt(F.count(x)), 4).alias("sem"))


@query("a21_group", "SELECT p_brand, count(*) AS n, min(p_size) AS low FROM part GROUP BY p_brand")
def a21(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_size").alias("low")).orderBy("p_brand")


def _crude(field: str, eps: float, n: str, at: str = "x") -> str:
    """Tables of DuckDB SQL that give each value of a field of p its crude bin's label, as l{n} (v, bin)."""
    f = at.replace
    return f"""d{n} AS (SELECT DISTINCT {field} AS v FROM p), n{n} AS (SELECT a.v, min(b.v) AS nx FROM d{n} a LEFT JOIN d{n} b ON {f("x", "b.v")} >= {f("x", "a.v")} + {eps} GROUP BY a.v),
t{n} AS (SELECT min(v) AS v FROM d{n} UNION ALL SELECT nx FROM t{n} JOIN n{n} ON n{n}.v = t{n}.v WHERE nx IS NOT NULL),
m{n} AS (SELECT d{n}.v, max(t{n}.v) AS s FROM d{n} JOIN t{n} ON t{n}.v <= d{n}.v GROUP BY d{n}.v), a{n} AS (SELECT s, avg(v) AS bin FROM p JOIN m{n} ON m{n}.v = p.{field} GROUP BY s), l{n} AS (SELECT v, bin FROM m{n} JOIN a{n} ON a{n}.s = m{n}.s)"""


@query("a22_crude_bins", "WITH RECURSIVE {P}, " + _crude("x", 4.0, "1") + " SELECT round(bin, 6) AS bin, count(*) AS n, min(x) AS low, max(x) AS high FROM p JOIN l1 ON l1.v = x GROUP BY bin")
def a22(spark, d):
    got = st.crude_bins(scatter(spark, d), "x", 4.0)
    return got.groupBy(r("bin").alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))


@query("a23_crude_bins_two", "WITH RECURSIVE {P}, " + _crude("x", 0.3, "1", "log10(x)") + ", " + _crude("e", 0.025, "2") + " SELECT round(l1.bin, 6) AS bin1, round(l2.bin, 6) AS bin2, count(*) AS n FROM p JOIN l1 ON l1.v = x JOIN l2 ON l2.v = e GROUP BY ALL")
def a23(spark, d):
    got = st.crude_bins(st.crude_bins(scatter(spark, d), "x", 0.3, "log10", "bin1"), "e", 0.025, label="bin2")
    return got.groupBy(r("bin1").alias("bin1"), r("bin2").alias("bin2")).agg(F.count("*").alias("n"))


@query("a24_average_sets", """WITH {P} SELECT idx, count(*) AS n, round(avg(x), 8) AS x, round(sum(y * w / (1 + e)) / sum(w / (1 + e)), 5) AS y,
  round(CASE WHEN count(*) > 1 THEN stddev_samp(y) ELSE 0 END, 4) AS e FROM p GROUP BY idx""")
def a24(spark, d):
    weight = F.col("w") / (1 + F.col("e"))
    got = scatter(spark, d).groupBy("idx").agg(F.count("*").alias("n"), F.avg("x").alias("x"), (F.sum(F.col("y") * weight) / F.sum(weight)).alias("y"), F.when(F.count("*") > 1, F.stddev_samp("y")).otherwise(0.0).alias("e"))
    return got.select("idx", "n", r("x", 8).alias("x"), r("y", 5).alias("y"), r("e", 4).alias("e"))


@query("a25_average_by_x", """WITH {P} SELECT x, count(*) AS n, round(sum(y * w / (1 + e)) / sum(w / (1 + e)), 5) AS y, min(idx) AS first FROM p GROUP BY x""")
def a25(spark, d):
    weight = F.col("w") / (1 + F.col("e"))
    got = scatter(spark, d).groupBy("x").agg(F.count("*").alias("n"), (F.sum(F.col("y") * weight) / F.sum(weight)).alias("y"), F.min("idx").alias("first"))
    return got.orderBy("x", "first").select("x", "n", r("y", 5).alias("y"), "first")


@query("a27_matrix", """WITH c AS (SELECT CASE WHEN l_linenumber = 7 THEN -1 ELSE l_linenumber - 1 END AS i, CASE WHEN l_quantity > 45 THEN -1 ELSE CAST(l_quantity AS INTEGER) % 5 END AS j, l_quantity AS q FROM lineitem),
a AS (SELECT unnest(CASE WHEN i = -1 THEN range(6) ELSE [i] END) AS i, j, q FROM c), b AS (SELECT i, unnest(CASE WHEN j = -1 THEN range(5) ELSE [j] END) AS j, q FROM a)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, sum(q) AS value FROM b GROUP BY ALL""")
def a27(spark, d):
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") == 7, -1).otherwise(F.col("l_linenumber") - 1).alias("i"), F.when(F.col("l_quantity") > 45, -1).otherwise(F.col("l_quantity").cast("int") % 5).alias("j"), "l_quantity")
    return st.accumulate(rows, ["i", "j"], "l_quantity", [6, 5])


@query("a27_matrix_of_three", """WITH c AS (SELECT CASE WHEN l_linenumber = 7 THEN -1 ELSE l_linenumber - 1 END AS i, CASE WHEN l_quantity > 45 THEN -1 ELSE CAST(l_quantity AS INTEGER) % 5 END AS j, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE -1 END AS k, l_quantity AS q FROM lineitem),
a AS (SELECT unnest(CASE WHEN i = -1 THEN range(6) ELSE [i] END) AS i, j, k, q FROM c), b AS (SELECT i, unnest(CASE WHEN j = -1 THEN range(5) ELSE [j] END) AS j, k, q FROM a), e AS (SELECT i, j, unnest(CASE WHEN k = -1 THEN range(3) ELSE [k] END) AS k, q FROM b)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, sum(q) AS value FROM e GROUP BY ALL""")
def a27b(spark, d):
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(-1)
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") == 7, -1).otherwise(F.col("l_linenumber") - 1).alias("i"), F.when(F.col("l_quantity") > 45, -1).otherwise(F.col("l_quantity").cast("int") % 5).alias("j"), flag.alias("k"), "l_quantity")
    return st.accumulate(rows, ["i", "j", "k"], "l_quantity", [6, 5, 3])


@query("a28_extremes_of_sets", "WITH {P} SELECT set_id, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(e) AS emin, max(e) AS emax, round(min(log10(y)), 8) AS tr_ymin FROM p GROUP BY set_id")
def a28(spark, d):
    return scatter(spark, d).groupBy("set_id").agg(*[f(c).alias(f"{c}{n}") for c in "xye" for f, n in ((F.min, "min"), (F.max, "max"))], r(F.min(F.log10("y")), 8).alias("tr_ymin"))


@query("a29_report", """WITH {P}, q AS (SELECT set_id % 4 AS file_id, set_id, x FROM p)
SELECT file_id, set_id, count(*) AS n, round(avg(x), 8) AS mean, round(stddev_samp(x), 8) AS stdev FROM q GROUP BY GROUPING SETS ((file_id, set_id), (file_id), ())""")
def a29(spark, d):
    got = scatter(spark, d).withColumn("file_id", F.col("set_id") % 4).rollup("file_id", "set_id")
    return got.agg(F.count("*").alias("n"), r(F.avg("x"), 8).alias("mean"), r(F.stddev_samp("x"), 8).alias("stdev"))


@query("a30_mean_slope", """WITH {S}, g AS (SELECT set_id, (v - lag(v) OVER o) / nullif(t - lag(t) OVER o, 0) AS m FROM s WINDOW o AS (PARTITION BY set_id ORDER BY idx))
SELECT set_id, round(avg(m), 3) AS slope, round(avg(abs(m)), 3) AS absolute FROM g GROUP BY set_id""")
def a30(spark, d):
    from pointloom.operators.points import ordered

    w = ordered()
    m = F.try_divide(F.col("v") - F.lag("v").over(w), F.col("t") - F.lag("t").over(w))
    return series(spark, d).withColumn("m", m).groupBy("set_id").agg(r(F.avg("m"), 3).alias("slope"), r(F.avg(F.abs("m")), 3).alias("absolute"))


@query("a31_line_fit", "WITH {P} SELECT set_id, count(*) AS n, round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 4) AS intercept FROM p GROUP BY set_id")
def a31(spark, d):
    return st.line_fit(scatter(spark, d), ["set_id"], "x", "y").select("set_id", "n", r("slope", 5).alias("slope"), r("intercept", 4).alias("intercept"))


@query("a31_line_fit_errors", """WITH {P}, m AS (SELECT *, min(CASE WHEN e <> 0 THEN e END) OVER (PARTITION BY set_id) / 2 AS half FROM p),
q AS (SELECT set_id, x, y / 1000 AS y, 1 / power(CASE WHEN e = 0 THEN half ELSE e END, 2) AS w FROM m), c AS (SELECT set_id, sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM q GROUP BY set_id),
f AS (SELECT set_id, max(sw) AS sw, max(mx) AS mx, max(my) AS my, sum(w * (x - mx) * (y - my)) / sum(w * power(x - mx, 2)) AS b, sum(w * power(x - mx, 2)) AS xx FROM q JOIN c USING (set_id) GROUP BY set_id)
SELECT set_id, round(b, 7) AS slope, round(my - b * mx, 6) AS intercept, round(sqrt(1 / xx), 9) AS d_slope, round(sqrt(1 / sw + mx * mx / xx), 8) AS d_intercept FROM f""")
def a31e(spark, d):
    got = st.line_fit(scatter(spark, d).withColumn("y", F.col("y") / 1000), ["set_id"], "x", "y", "e")
    return got.select("set_id", r("slope", 7).alias("slope"), r("intercept").alias("intercept"), r("d_slope", 9).alias("d_slope"), r("d_intercept", 8).alias("d_intercept"))


@query("a32_robust_fit", """WITH {S}, g AS (SELECT a.set_id, (b.v - a.v) / (b.t - a.t) AS m, a.v - (b.v - a.v) / (b.t - a.t) * a.t AS c FROM s a JOIN s b ON b.set_id = a.set_id AND a.idx < b.idx AND a.t <> b.t),
k AS (SELECT g.set_id, m, c, avg(abs(v - c - m * t)) AS k FROM g JOIN s ON s.set_id = g.set_id GROUP BY ALL), o AS (SELECT set_id, arg_min(m, k) AS m, min(k) AS k FROM k GROUP BY set_id)
SELECT s.set_id, count(*) AS n, round(coalesce(max(m), 0), 4) AS slope, round(median(v - coalesce(m, 0) * t), 2) AS intercept, round(coalesce(max(k), 0), 4) AS deviation FROM s LEFT JOIN o ON o.set_id = s.set_id GROUP BY s.set_id""")
def a32(spark, d):
    got = st.robust_fit(series(spark, d), ["set_id"], "t", "v")
    return got.select("set_id", "n", r("slope", 4).alias("slope"), r("intercept", 2).alias("intercept"), r("deviation", 4).alias("deviation"))


@query("a32_robust_fit_over_tasks", ORACLE["a32_robust_fit"])
def a32b(spark, d):
    got = st.robust_fit(series(spark, d), ["set_id"], "t", "v", most_rows=4)
    return got.select("set_id", "n", r("slope", 4).alias("slope"), r("intercept", 2).alias("intercept"), r("deviation", 4).alias("deviation"))


@query("a41_sizes", """SELECT n_regionkey AS g, count(*) AS n_points, count(DISTINCT s_suppkey) AS n_sets, sum(l_quantity) AS n_obs
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def a41(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    s, n = table(spark, d, "supplier"), F.broadcast(table(spark, d, "nation"))  # 25 nations
    j = rows.join(s, rows["l_suppkey"] == s["s_suppkey"]).join(n, s["s_nationkey"] == n["n_nationkey"])
    return j.groupBy(F.col("n_regionkey").alias("g")).agg(F.sum("n").alias("n_points"), F.count("*").alias("n_sets"), F.sum("q").alias("n_obs"))


@query("a42_extremes_of_arrays", """WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT vec_id, list_min(e) AS low, list_max(e) AS high, list_min(list_transform(e, lambda x: abs(x))) AS abs_low, list_max(list_transform(e, lambda x: abs(x))) AS abs_high,
  CAST(list_position(e, list_max(e)) - 1 AS BIGINT) AS at, greatest(e[1], e[2]) AS of_two FROM a""")
def a42(spark, d):
    e = F.col("embedding").cast("array<double>")
    a = F.transform(e, F.abs)
    return table(spark, d, "embeddings").select("vec_id", F.array_min(e).alias("low"), F.array_max(e).alias("high"), F.array_min(a).alias("abs_low"), F.array_max(a).alias("abs_high"), (F.array_position(e, F.array_max(e)) - 1).alias("at"), F.greatest(e[0], e[1]).alias("of_two"))


@query("a43_samples", "WITH {P} SELECT set_id, CAST(count(*) AS INTEGER) AS n, round(sum(w), 6) AS w_sum, round(sum(w * x) / sum(w), 8) AS mean FROM p GROUP BY set_id")
def a43(spark, d):
    got = st.samples(scatter(spark, d), ["set_id"], "x", "w")
    o = st.of_samples("samples")
    return got.select("set_id", o["n"].alias("n"), r(o["w_sum"]).alias("w_sum"), r(o["mean"], 8).alias("mean"))
