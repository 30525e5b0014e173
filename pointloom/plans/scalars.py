"""Queries of scalar functions (F1 to F20)."""

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pointloom.functions import scalars as sc
from pointloom.functions import special
from pointloom.operators.resample import polynomial_at
from pointloom.plans.registry import query, r, scatter, series, table


@query("f01_arithmetic", """WITH {P}, q AS (SELECT set_id, idx, x, y, CASE WHEN idx % 7 = 0 THEN 0 ELSE e * 100 END AS b, x - 25 AS a FROM p)
SELECT set_id, idx, round(x + y, 6) AS added, round(x * y, 4) AS times, CASE WHEN b = 0 THEN CASE WHEN a > 0 THEN 'Infinity' WHEN a < 0 THEN '-Infinity' ELSE 'none' END ELSE 'finite' END AS kind,
  CASE WHEN b <> 0 THEN round(a / b, 8) END AS quotient, round((y - x) / x, 9) AS relative, round(x * y + a, 4) AS fused FROM q""")
def f01(spark, d):
    p = scatter(spark, d).withColumns({"b": F.when(F.col("idx") % 7 == 0, 0.0).otherwise(F.col("e") * 100), "a": F.col("x") - 25})
    q = sc.divide("a", "b")
    kind = F.when(q.isNull(), "none").when(q == float("inf"), "Infinity").when(q == float("-inf"), "-Infinity").otherwise("finite")
    return p.select("set_id", "idx", r(F.col("x") + F.col("y")).alias("added"), r(F.col("x") * F.col("y"), 4).alias("times"), kind.alias("kind"), r(q, 8).alias("quotient"), r(sc.relative_difference("y", "x"), 9).alias("relative"), r(sc.fmadd("x", "y", "a"), 4).alias("fused"))


@query("f02_powers", """WITH {P}, q AS (SELECT set_id, idx, x - 25.5 AS a, x FROM p)
SELECT set_id, idx, round(sign(a) * power(abs(a), 1.7), 5) AS power, round(exp(a / 20), 8) AS exp, round(ln(x) / ln(3), 9) AS log3, round(sqrt(a * a + x * x), 8) AS norm,
  round(sign(a) * power(abs(a), 2) / (power(abs(a), 2) + power(5, 2)), 9) AS compressed, CASE WHEN x <= 10 THEN factorial(CAST(x AS INTEGER))::DOUBLE END AS factorial FROM q""")
def f02(spark, d):
    p = scatter(spark, d).withColumn("a", F.col("x") - 25.5)
    return p.select("set_id", "idx", r(sc.signed_power("a", 1.7), 5).alias("power"), r(F.exp(F.col("a") / 20), 8).alias("exp"), r(sc.log_base("x", 3), 9).alias("log3"), r(sc.norm("a", "x"), 8).alias("norm"), r(sc.compress("a", 2, 5), 9).alias("compressed"), F.when(F.col("x") <= 10, sc.product_of_steps("x")).alias("factorial"))


@query("f03_trigonometry", """WITH {S} SELECT set_id, idx, round(sin(radians(a)), 8) AS sin, round(cos(2 * pi() * a / 100), 8) AS cos, round(degrees(asin(a / 360)), 7) AS asin, round(degrees(acos(a / 360)), 7) AS acos,
  round(degrees(atan(v)), 7) AS atan, round(degrees(atan2(v, a - 180)), 7) AS atan2, round(radians(a), 8) AS radians FROM s""")
def f03(spark, d):
    return series(spark, d).select("set_id", "idx", r(sc.sin("a", 360), 8).alias("sin"), r(sc.cos("a", 100), 8).alias("cos"), r(sc.asin(F.col("a") / 360, 360), 7).alias("asin"), r(sc.acos(F.col("a") / 360, 360), 7).alias("acos"), r(sc.atan("v", 360), 7).alias("atan"), r(sc.atan2("v", F.col("a") - 180, 360), 7).alias("atan2"), r(F.radians("a"), 8).alias("radians"))


@query("f04_angles", """WITH {S}, q AS (SELECT set_id, idx, a - 180 AS x, 150 - a AS y, 3 * a - 500 AS b, a FROM s), z AS (SELECT *, degrees(atan2(y, x)) AS g, b - 360 * floor(b / 360) AS m, a - b - 360 * floor((a - b) / 360) AS n FROM q)
SELECT set_id, idx, round(CASE WHEN g < 0 THEN g + 360 ELSE g END, 6) AS arg, round(CASE WHEN m > 180 THEN m - 360 ELSE m END, 6) AS half, round(m, 6) AS full_, round(CASE WHEN n > 180 THEN n - 360 ELSE n END, 6) AS difference FROM z""")
def f04(spark, d):
    s = series(spark, d).withColumns({"x": F.col("a") - 180, "y": 150 - F.col("a"), "b": 3 * F.col("a") - 500})
    return s.select("set_id", "idx", r(sc.arg("x", "y", 360)).alias("arg"), r(sc.half_turn("b")).alias("half"), r(sc.full_turn("b")).alias("full_"), r(sc.angle_difference("a", "b")).alias("difference"))


@query("f05_subtended", "WITH {P} SELECT set_id, idx, round(2 * degrees(atan2(x, y)), 9) AS disc, round(2 * degrees(asin(x / y)), 9) AS sphere FROM p")
def f05(spark, d):
    return scatter(spark, d).select("set_id", "idx", r(sc.subtended("x", "y", 360), 9).alias("disc"), r(sc.subtended("x", "y", 360, True), 9).alias("sphere"))


#: Regularised lower incomplete gamma by its series, for moderate arguments.
_GAMMA_P = "list_sum(list_transform(range(0, 300), lambda k: exp({a} * ln({x}) - {x} + k * ln({x}) - lgamma({a} + k + 1))))"


@query("f06_special", "WITH {P}, q AS (SELECT DISTINCT x, power(x / 20, 2) AS z FROM p) SELECT x, round(" + _GAMMA_P.replace("{a}", "0.5").replace("{x}", "z") + ", 9) AS erf, round(1 - " + _GAMMA_P.replace("{a}", "0.5").replace("{x}", "z") + ", 9) AS erfc, round(" + _GAMMA_P.replace("{a}", "7.5").replace("{x}", "x") + ", 9) AS gamma_p FROM q")
def f06(spark, d):
    p = scatter(spark, d).select("x").distinct()
    return p.select("x", r(special.erf_udf(F.col("x") / 20), 9).alias("erf"), r(special.one_minus_erf_udf(F.col("x") / 20), 9).alias("erfc"), r(special.incomplete_gamma_udf(F.lit(7.5), "x"), 9).alias("gamma_p"))


@query("f07_rounding", """WITH {P}, q AS (SELECT set_id, idx, (x - 25.5) / 2 AS a FROM p)
SELECT set_id, idx, abs(a) AS abs, sign(a)::DOUBLE AS sign, sign(a) * floor(abs(a)) AS whole, floor(a)::BIGINT AS floor, ceil(a)::BIGINT AS ceil, floor(a / 0.5 + 0.5) * 0.5 AS nearest,
  round(a % 3, 6) AS fmod, round(a - 3 * floor(a / 3), 6) AS positive, floor(a) % 2 = 0 AS even FROM q""")
def f07(spark, d):
    p = scatter(spark, d).withColumn("a", (F.col("x") - 25.5) / 2)
    return p.select("set_id", "idx", F.abs("a").alias("abs"), F.signum("a").alias("sign"), sc.truncate("a").alias("whole"), F.floor("a").alias("floor"), F.ceil("a").alias("ceil"), sc.round_to("a", 0.5).alias("nearest"), r(sc.fmod("a", 3.0)).alias("fmod"), r(sc.fmod_positive("a", 3.0)).alias("positive"), sc.is_even("a").alias("even"))


@query("f08_comparison", """WITH {P} SELECT set_id, idx, x BETWEEN 0.9 * 20 AND 1.1 * 20 AS close, CASE WHEN x = 20 THEN 0 WHEN x > 20 THEN 1 ELSE -1 END AS cmp, x >= 0.9 * 20 AS at_least, x <= 1.1 * 20 AS at_most,
  x > 10 AND e > 0.02 AS both, x > 10 OR e > 0.02 AS any_, (x > 10) <> (e > 0.02) AS either, e <> 0 AS truth FROM p""")
def f08(spark, d):
    a, b = F.col("x") > 10, F.col("e") > 0.02
    return scatter(spark, d).select("set_id", "idx", sc.close("x", 20.0, 0.1).alias("close"), sc.compare("x", 20.0).alias("cmp"), sc.at_least("x", 20.0, 0.1).alias("at_least"), sc.at_most("x", 20.0, 0.1).alias("at_most"), (a & b).alias("both"), (a | b).alias("any_"), sc.either(a, b).alias("either"), sc.truth("e").alias("truth"))


@query("f09_bits", """SELECT o_orderkey, o_custkey & 12 AS b_and, o_custkey | 12 AS b_or, xor(o_custkey, 12) AS b_xor, ~o_custkey AS b_not, o_custkey << 3 AS l, o_custkey >> 2 AS r, CAST((o_custkey >> 4) & 1 AS INTEGER) AS bit FROM orders""")
def f09(spark, d):
    c = F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", c.bitwiseAND(12).alias("b_and"), c.bitwiseOR(12).alias("b_or"), c.bitwiseXOR(12).alias("b_xor"), F.bitwise_not(c).alias("b_not"), F.shiftleft(c, 3).alias("l"), F.shiftright(c, 2).alias("r"), F.getbit(c, F.lit(4)).cast("int").alias("bit"))


@query("f10_switch", "SELECT p_partkey, CASE WHEN p_size = 7 THEN 1 WHEN p_size IN (1, 2, 3) THEN 2 ELSE 0 END AS k, CASE WHEN p_retailprice > 1000 THEN 'dear' ELSE 'cheap' END AS price FROM part")
def f10(spark, d):
    return table(spark, d, "part").select("p_partkey", sc.switch("p_size", [(7, 1), ([1, 2, 3], 2)], 0).alias("k"), F.when(F.col("p_retailprice") > 1000, "dear").otherwise("cheap").alias("price"))


@query("f11_arrays", """WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 4)) AS e FROM embeddings)
SELECT vec_id, e[3] AS third, len(e) AS n, round(list_sum(list_transform(list_zip(e, e[2:]), lambda z: coalesce(z[1] * z[2], 0))), 9) AS products, round(list_sum(list_concat(e, [1.0, 1.0])), 6) AS total,
  CASE WHEN vec_id % 5 < 4 THEN (vec_id % 3) * 4 + vec_id % 5 END AS place FROM a""")
def f11(spark, d):
    e = F.transform("embedding", lambda x: F.round(x.cast("double"), 4))
    a = table(spark, d, "embeddings").select("vec_id", e.alias("e"))
    add = lambda s, v: s + v
    products = F.aggregate(F.zip_with("e", F.slice("e", F.lit(2), F.size("e") - 1), lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), add)
    total = F.aggregate(F.concat("e", F.array_repeat(F.lit(1.0), 2)), F.lit(0.0), add)
    return a.select("vec_id", F.get("e", F.lit(2)).alias("third"), F.size("e").cast("long").alias("n"), r(products, 9).alias("products"), r(total).alias("total"), sc.flat_index([F.col("vec_id") % 3, F.col("vec_id") % 5], [3, 4]).alias("place"))


@query("f12_apply", """WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(e, lambda x, i: x * (i - 1))), 6) AS weighted, round(list_sum(e[1:64:4]), 6) AS fourth, round(list_reverse(e)[2], 8) AS second_last FROM a""")
def f12(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    add = lambda s, v: s + v
    return a.select("vec_id", r(F.aggregate(F.transform("e", lambda x, i: x * i), F.lit(0.0), add)).alias("weighted"), r(F.aggregate(sc.strided("e", 4), F.lit(0.0), add)).alias("fourth"), r(F.get(sc.strided("e", -1), F.lit(1)), 8).alias("second_last"))


@query("f13_arrays_and_rows", "WITH {S} SELECT set_id, idx, round(v * 2, 6) AS v FROM s")
def f13(spark, d):
    whole = series(spark, d).groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("a"))
    doubled = whole.select("set_id", F.posexplode(F.transform("a", lambda s: s["v"] * 2)))
    return doubled.select("set_id", F.col("pos").cast("long").alias("idx"), r("col").alias("v"))


@query("f14_strings", r"""SELECT p_partkey, p_name || '-' || p_brand AS joined, regexp_extract('/a/' || p_name || '.dat', '([^/]*)\.dat$', 1) AS base, length(p_name) AS n, CASE WHEN p_name = 'red widget' THEN 0 WHEN p_name < 'red widget' THEN -1 ELSE 1 END AS cmp,
  CASE WHEN lower(p_name[1:3]) = 'red' THEN 0 WHEN lower(p_name[1:3]) < 'red' THEN -1 ELSE 1 END AS case_cmp, regexp_matches(p_name, 'r[ei]') AS pattern, CASE WHEN contains(p_name, 'r') THEN p_name[instr(p_name, 'r'):] END AS tail,
  CASE WHEN contains(p_name, 'i') THEN regexp_extract(p_name, '(i[^i]*)$', 1) END AS last_tail, CAST(length(p_name) - length(replace(p_name, 'e', '')) AS INTEGER) AS n_e FROM part""")
def f14(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", F.concat_ws("-", "p_name", "p_brand").alias("joined"), sc.basename(F.concat(F.lit("/a/"), n, F.lit(".dat")), ".dat").alias("base"), F.length(n).cast("long").alias("n"), sc.text_differs("p_name", F.lit("red widget")).alias("cmp"), sc.text_differs("p_name", F.lit("RED"), 3, True).alias("case_cmp"), n.rlike("r[ei]").alias("pattern"), sc.from_match("p_name", "r").alias("tail"), sc.from_match("p_name", "i", last=True).alias("last_tail"), sc.count_of("p_name", "e").alias("n_e"))


@query("f15_timecode", """WITH q AS (SELECT event_id, (epoch_us(ts) - 1704067200000000) // 10000 AS c FROM events)
SELECT event_id, printf('%02d:%02d:%02d.%02d', c // 360000, (c // 6000) % 60, (c // 100) % 60, c % 100) AS code FROM q""")
def f15(spark, d):
    c = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 10000)
    return table(spark, d, "events").select("event_id", sc.timecode(c / 100).alias("code"))


@query("f16_year_day", "SELECT o_orderkey, CAST(dayofyear(o_orderdate) AS INTEGER) AS day, CASE WHEN o_custkey % 13 BETWEEN 1 AND 12 THEN CAST(dayofyear(make_date(2024, o_custkey % 13, 28)) AS INTEGER) END AS other FROM orders")
def f16(spark, d):
    t, c = F.col("o_orderdate"), (F.col("o_custkey") % 13).cast("int")
    return table(spark, d, "orders").select("o_orderkey", sc.year_day(F.dayofmonth(t), F.month(t), F.year(t)).alias("day"), sc.year_day(28, c, 2024).alias("other"))


@query("f17_hash", "SELECT p_partkey, CAST('0x' || md5(p_name)[1:15] AS BIGINT) AS hash FROM part")
def f17(spark, d):
    return table(spark, d, "part").select("p_partkey", sc.text_hash("p_name").alias("hash"))


@query("f18_random", "SELECT count(*) AS n, true AS uniform_inside, true AS uniform_mean, true AS normal_mean, true AS normal_stdev, true AS abnormal_mean FROM lineitem")
def f18(spark, d):
    """Bounds and moments of one draw a row, each within six standard errors."""
    draws = table(spark, d, "lineitem").select(sc.uniform(2, 5, 1).alias("u"), sc.normal(1, 2, 2).alias("g"), sc.abnormal(1, 2, 3).alias("a"))
    n, near = F.count("*"), lambda v, want, sd: F.abs(v - want) < 6 * sd / F.sqrt(F.count("*"))
    return draws.agg(
        n.alias("n"),
        ((F.min("u") >= 2) & (F.max("u") <= 5)).alias("uniform_inside"),
        near(F.avg("u"), 3.5, 0.87).alias("uniform_mean"),
        near(F.avg("g"), 1.0, 2.0).alias("normal_mean"),
        near(F.stddev_samp("g"), 2.0, 1.5).alias("normal_stdev"),
        near(F.avg("a"), 1.0 + 2 * (2 / math.pi) ** 0.5, 1.21).alias("abnormal_mean"),
    )


@query("f19_line_in_circle", """WITH {P}, q AS (SELECT set_id, idx, x AS x1, 0.0::DOUBLE AS y1, 50 - x AS x2, 50.0::DOUBLE AS y2 FROM p), z AS (SELECT *, power(x2 - x1, 2) + power(y2 - y1, 2) AS a, 2 * ((x1 - 25) * (x2 - x1) + (y1 - 20) * (y2 - y1)) AS b, power(x1 - 25, 2) + power(y1 - 20, 2) - 100 AS c FROM q),
k AS (SELECT *, CASE WHEN b * b - 4 * a * c >= 0 THEN (-b - sqrt(b * b - 4 * a * c)) / (2 * a) END AS s, CASE WHEN b * b - 4 * a * c >= 0 THEN (-b + sqrt(b * b - 4 * a * c)) / (2 * a) END AS t FROM z)
SELECT set_id, idx, CAST(CASE WHEN s BETWEEN 0 AND 1 THEN 1 ELSE 0 END + CASE WHEN t BETWEEN 0 AND 1 AND t <> s THEN 1 ELSE 0 END AS INTEGER) AS n, CASE WHEN s BETWEEN 0 AND 1 THEN round(x1 + s * (x2 - x1), 6) WHEN t BETWEEN 0 AND 1 THEN round(x1 + t * (x2 - x1), 6) END AS first_x FROM k""")
def f19(spark, d):
    hits = sc.line_in_circle("x", F.lit(0.0), 50 - F.col("x"), F.lit(50.0), F.lit(25.0), F.lit(20.0), F.lit(10.0))
    return scatter(spark, d).withColumn("h", hits).select("set_id", "idx", F.size("h").alias("n"), r(F.get("h", F.lit(0))["x"]).alias("first_x"))


@query("f20_polynomial", """WITH a AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS p, CAST(embedding[2] AS DOUBLE) AS q, CAST(embedding[3] AS DOUBLE) AS s FROM embeddings)
SELECT vec_id, round(p * 0.375 + q * 0.75 - s * 0.125, 8) AS value FROM a""")
def f20(spark, d):
    @F.pandas_udf(DoubleType())
    def at_half(arrays: pd.Series) -> pd.Series:
        return pd.Series([polynomial_at([0.0, 1.0, 2.0], v[:3], 0.5) for v in arrays])

    return table(spark, d, "embeddings").select("vec_id", r(at_half(F.col("embedding").cast("array<double>")), 8).alias("value"))
