"""Queries of projections, filters and predicates (PF1 to PF21)."""

from pyspark.sql import functions as F

from pointloom.operators import selection as sel
from pointloom.plans.registry import query, r, scatter, series, table

_SETS = """sets AS (
  SELECT s_suppkey AS set_id, s_name AS title, [CAST(s_nationkey AS DOUBLE), CAST(n_regionkey AS DOUBLE)] AS assoc
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def sets(spark, d):
    """Metadata of the scatter sets: title, and nation and region as associations."""
    s, n = table(spark, d, "supplier"), F.broadcast(table(spark, d, "nation"))  # 25 nations
    assoc = F.array(F.col("s_nationkey").cast("double"), F.col("n_regionkey").cast("double"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("set_id"), F.col("s_name").alias("title"), assoc.alias("assoc"))


@query("pf01_roles", "WITH {P} SELECT set_id, idx, x, y, e, w AS n FROM p")
def pf01(spark, d):
    return sel.assign_roles(scatter(spark, d), "x", "y", e="e", n="w")


@query("pf02_scale", """WITH {P} SELECT set_id, idx, round(x * 2 * (1 + s_nationkey / 10.0), 6) AS x,
  round(abs(y * 0.001 * -1), 6) AS y FROM p JOIN supplier ON s_suppkey = set_id""")
def pf02(spark, d):
    s = table(spark, d, "supplier")
    factors = s.select(F.col("s_suppkey").alias("set_id"), (1 + F.col("s_nationkey") / 10.0).alias("fx"), F.lit(-1.0).alias("fy"), F.lit(1.0).alias("fe"))
    got = sel.scale(scatter(spark, d), fx=2.0, fy=0.001, per_set=factors, absolute_y=True)
    return got.select("set_id", "idx", r("x").alias("x"), r("y").alias("y"))


@query("pf03_process", "WITH {P} SELECT set_id, idx, round(y / 100, 6) AS x, round(x * 3 + e, 6) AS y, round(x - e, 6) AS e FROM p")
def pf03(spark, d):
    got = sel.process(scatter(spark, d), x=F.col("y") / 100, y=F.col("x") * 3 + F.col("e"), e=F.col("x") - F.col("e"))
    return got.select("set_id", "idx", r("x").alias("x"), r("y").alias("y"), r("e").alias("e"))


@query("pf04_staged", """WITH {P}, c AS (SELECT set_id, x - avg(x) OVER (PARTITION BY set_id) AS x FROM p)
SELECT set_id, round(max(x), 6) AS top, round(sum(x * x), 4) AS square FROM c GROUP BY set_id""")
def pf04(spark, d):
    _, last = sel.staged(scatter(spark, d), {"m": F.avg("x")}, {"x": F.col("x") - F.col("m")}, {"top": F.max("x"), "square": F.sum(F.col("x") * F.col("x"))})
    return last.select("set_id", r("top").alias("top"), r("square", 4).alias("square"))


@query("pf05_set_specific", "WITH {P} SELECT set_id, idx, CASE set_id WHEN 1 THEN x + 100 WHEN 2 THEN -x ELSE x * 2 END AS x FROM p")
def pf05(spark, d):
    got = sel.set_specific(scatter(spark, d), "x", {1: F.col("x") + 100, 2: -F.col("x")}, F.col("x") * 2)
    return got.select("set_id", "idx", "x")


@query("pf06_axis", """WITH {P} SELECT set_id, idx, round(log10(CASE WHEN e = 0 THEN 0.001 ELSE e END), 9) AS le, round(power(y, 0.5), 6) AS py FROM p""")
def pf06(spark, d):
    return scatter(spark, d).select("set_id", "idx", r(sel.log_axis("e", 0.001), 9).alias("le"), r(sel.power_axis("y", 0.5)).alias("py"))


@query("pf07_polar", """WITH {S} SELECT set_id, idx, round(v * cos(2 * pi() * (a + 15) / 360), 6) AS px,
  round(v * sign(sin(2 * pi() * (a + 15) / 360)) * power(abs(sin(2 * pi() * (a + 15) / 360)), 2), 6) AS py FROM s""")
def pf07(spark, d):
    x, _ = sel.polar("a", "v", 360, 15)
    _, y = sel.polar("a", "v", 360, 15, 2)
    return series(spark, d).select("set_id", "idx", r(x).alias("px"), r(y).alias("py"))


@query("pf08_discard", """WITH {P} SELECT set_id, count(*) FILTER (idx BETWEEN 10 AND 400 AND y > 60000 AND NOT x > 45) AS n_discarded,
  round(sum(x) FILTER (NOT (idx BETWEEN 10 AND 400 AND y > 60000 AND NOT x > 45)), 4) AS sum_kept FROM p GROUP BY set_id""")
def pf08(spark, d):
    got = sel.discard(scatter(spark, d), F.col("y") > 60000, 10, 400, restore=F.col("x") > 45)
    kept = F.sum(F.when(~F.col("discarded"), F.col("x")))
    return got.groupBy("set_id").agg(F.count(F.when(F.col("discarded"), 1)).alias("n_discarded"), r(kept, 4).alias("sum_kept"))


@query("pf09_equal", """SELECT 'equal' AS kind, l_orderkey, l_quantity FROM lineitem WHERE l_quantity = 7
UNION ALL SELECT 'near', l_orderkey, l_quantity FROM lineitem WHERE abs(l_quantity - 9.2) < 0.5
UNION ALL SELECT 'other', l_orderkey, l_quantity FROM lineitem WHERE l_quantity <> 7
UNION ALL SELECT 'far', l_orderkey, l_quantity FROM lineitem WHERE abs(l_quantity - 9.2) >= 40""")
def pf09(spark, d):
    rows = table(spark, d, "lineitem")
    parts = {"equal": sel.where_equal(rows, "l_quantity", 7), "near": sel.where_equal(rows, "l_quantity", 9.2, 0.5), "other": sel.where_not_equal(rows, "l_quantity", 7), "far": sel.where_not_equal(rows, "l_quantity", 9.2, 40)}
    out = [p.select(F.lit(k).alias("kind"), "l_orderkey", "l_quantity") for k, p in parts.items()]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


@query("pf10_compare", """SELECT o_orderkey, o_totalprice, 'low' AS kind FROM orders WHERE o_totalprice < 20000
UNION ALL SELECT o_orderkey, o_totalprice, 'middle' FROM orders WHERE o_totalprice > 200000 AND o_totalprice <= 220000
UNION ALL SELECT o_orderkey, o_totalprice, 'high' FROM orders WHERE o_totalprice >= 400000""")
def pf10(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    parts = {"low": sel.where_less(o, "o_totalprice", 20000), "middle": sel.where_less_equal(sel.where_greater(o, "o_totalprice", 200000), "o_totalprice", 220000), "high": sel.where_greater_equal(o, "o_totalprice", 400000)}
    low, middle, high = (p.withColumn("kind", F.lit(k)) for k, p in parts.items())
    return low.unionAll(middle).unionAll(high)


@query("pf11_in", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def pf11(spark, d):
    return sel.where_in(table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "5-LOW"]).select("o_orderkey", "o_orderpriority")


@query("pf12_predicate", "SELECT p_partkey, p_size FROM part WHERE p_size % 7 = 3")
def pf12(spark, d):
    return sel.where_true(table(spark, d, "part"), "p_size", lambda c: c % 7 == 3).select("p_partkey", "p_size")


@query("pf13_box", """WITH {P}, b AS (SELECT set_id, CASE WHEN x BETWEEN 10 AND 20 AND y BETWEEN 20000 AND 60000 THEN -x ELSE x END AS x,
  x BETWEEN 10 AND 20 AND y BETWEEN 20000 AND 60000 AS inside, y FROM p)
SELECT set_id, sum(x) AS sum_x, count(*) FILTER (inside) AS n_inside, round(avg(y) FILTER (inside), 4) AS mean_inside FROM b GROUP BY set_id""")
def pf13(spark, d):
    box = sel.in_box("x", "y", 10, 20000, 20, 60000)
    got = sel.box_filter(scatter(spark, d).withColumn("inside", box), F.col("inside"), x=-F.col("x"))
    return got.groupBy("set_id").agg(F.sum("x").alias("sum_x"), F.count(F.when(F.col("inside"), 1)).alias("n_inside"), r(F.avg(F.when(F.col("inside"), F.col("y"))), 4).alias("mean_inside"))


@query("pf14_visible", """WITH {P} SELECT set_id, array_to_string(list(idx ORDER BY idx), ',') AS indexes FROM p
WHERE x BETWEEN 3 AND 5 AND y BETWEEN 0 AND 30000 GROUP BY set_id""")
def pf14(spark, d):
    got = sel.visible_indexes(scatter(spark, d), sel.in_box("x", "y", 3, 0, 5, 30000))
    return got.select("set_id", F.array_join(F.transform("indexes", lambda i: i.cast("string")), ",").alias("indexes"))


@query("pf15_every_nth", "WITH {P} SELECT set_id, idx, x FROM p WHERE idx % 5 = 0")
def pf15(spark, d):
    return sel.every_nth(scatter(spark, d), 5).select("set_id", "idx", "x")


@query("pf16_sets", f"WITH {{P}}, {_SETS}" + """ SELECT 'match' AS kind, set_id, count(*) AS n FROM p WHERE set_id IN (SELECT set_id FROM sets WHERE regexp_matches(title, '0[1-3]$')) GROUP BY set_id
UNION ALL SELECT 'other', set_id, count(*) FROM p WHERE set_id NOT IN (SELECT set_id FROM sets WHERE contains(title, '00')) GROUP BY set_id""")
def pf16(spark, d):
    p, s = scatter(spark, d), sets(spark, d)
    a = sel.select_sets(p, s, F.col("title").rlike("0[1-3]$")).groupBy("set_id").count()
    b = sel.select_sets(p, s, F.col("title").contains("00"), reverse=True).groupBy("set_id").count()
    return a.select(F.lit("match").alias("kind"), "set_id", F.col("count").alias("n")).unionAll(b.select(F.lit("other").alias("kind"), "set_id", F.col("count").alias("n")))


@query("pf17_associations", f"WITH {_SETS}" + """ SELECT set_id, list_has_all(assoc, [3.0, 1.0]::DOUBLE[]) AS has_all, list_has_any(assoc, [3.0, 1.0]::DOUBLE[]) AS has_any,
  assoc[2] IN (0, 2) AS second_in, CAST(len(assoc) AS INTEGER) AS n, assoc[1] AS first, list_sum(list_resize(assoc, 3, 7.0::DOUBLE)) AS grown FROM sets""")
def pf17(spark, d):
    s = sets(spark, d)
    total = F.aggregate(sel.resized("assoc", 3, 7.0), F.lit(0.0), lambda a, b: a + b)
    return s.select("set_id", sel.has_all("assoc", [3, 1]).alias("has_all"), sel.has_any("assoc", [3, 1]).alias("has_any"), sel.nth_in("assoc", 1, [0, 2]).alias("second_in"), F.size("assoc").alias("n"), F.get("assoc", F.lit(0)).alias("first"), total.alias("grown"))


@query("pf18_label", "SELECT l_orderkey AS k, l_extendedprice AS value FROM lineitem")
def pf18(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select(F.col(sel.column_like(rows, "ORDERkey")).alias("k"), F.col(sel.column_like(rows, "l_ext.*", partial=False)).alias("value"))


@query("pf19_columns", "SELECT p_partkey, p_size, p_size * 2 AS twice FROM part")
def pf19(spark, d):
    df = table(spark, d, "part").drop("p_name").withColumn("twice", F.col("p_size") * 2)
    return sel.keep_columns(df, "p_partkey", "p_size", "twice")


@query("pf20_shift_rotate", """WITH {P}, q AS (SELECT set_id, idx, x * 1.5 - 25 AS u, y * 0.001 * 1.5 - 50 AS v, radians(30) AS g FROM p)
SELECT set_id, idx, round(u * cos(g) - v * sin(g) + 25 + 2, 6) AS x, round(u * sin(g) + v * cos(g) + 50 - 3, 6) AS y FROM q""")
def pf20(spark, d):
    x, y = sel.shift_rotate(F.col("x"), F.col("y") * 0.001, 30, 1.5, (25, 50), (2, -3))
    return scatter(spark, d).select("set_id", "idx", r(x).alias("x"), r(y).alias("y"))


@query("pf21_clip", """WITH {S} SELECT set_id, idx, least(greatest(v, 10), 200) AS clipped, v BETWEEN 10 AND 200 AS inside, y IS NULL AS missing, isinf(v) AS infinite FROM s""")
def pf21(spark, d):
    return series(spark, d).select("set_id", "idx", sel.clip("v", 10.0, 200.0).alias("clipped"), F.col("v").between(10, 200).alias("inside"), sel.is_missing("y").alias("missing"), sel.is_infinite("v").alias("infinite"))
