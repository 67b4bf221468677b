"""Table operators: lists, shares, weights, products, grids, wide and long scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelmill.operators import tables as tb
from pixelmill.plans.check_scores import rounded
from pixelmill.plans.lenses import INDICATOR_SQL, POINTS_SQL, PREDS_SQL, RUNS_SQL, VALUES, VECTORS_SQL
from pixelmill.plans.registry import query
from pixelmill.sources import layers


@query("implode", "SELECT o_custkey AS k, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS id, string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS s FROM orders GROUP BY 1")
def _implode(t):
    lists = tb.implode(t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s")), ["k"], ["id"])
    return lists.select("k", F.array_join("id", ",").alias("id"), F.array_join("s", ",").alias("s"))


@query("implode_singletons", """SELECT o_custkey AS k, CASE WHEN count(*) > 1 THEN string_agg(o_orderkey, ',' ORDER BY o_orderkey) END AS id,
  CASE WHEN count(*) = 1 THEN min(o_orderkey) END AS id_single FROM orders GROUP BY 1""")
def _implode_single(t):
    lists = tb.implode(t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id")), ["k"], keep_singletons=False)
    return lists.select("k", F.array_join("id", ",").alias("id"), "id_single")


@query("null_ratio", f"""WITH {INDICATOR_SQL}, p AS (SELECT upper(n_name) AS c, v AS x FROM nation LEFT JOIN indicator_long i ON i.country = n_name AND (n_nationkey + y) % 3 = 0)
  SELECT 'c' AS "column", 0.0::DOUBLE AS null_ratio, 1.0::DOUBLE AS not_null_ratio UNION ALL SELECT 'x', round(avg((x IS NULL)::INT), 6), round(1 - avg((x IS NULL)::INT), 6) FROM p""")
def _nulls(t):
    wide, years = t.indicator_wide
    long = layers.read_indicator(wide, "X.1", years)
    p = t.nation.join(long, (F.col("country_long") == F.col("n_name")) & ((F.col("n_nationkey") + F.col("year")) % 3 == 0), "left") \
        .select(F.upper("n_name").alias("c"), F.col("indicator_value").alias("x"))
    return rounded(tb.null_ratio(p))


@query("class_counts", "SELECT o_orderpriority AS c, count(*) AS n, round(count(*)/sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def _counts(t):
    return rounded(tb.class_counts(t.orders.select(F.col("o_orderpriority").alias("c")), "c"))


@query("inverse_prior_weights", """WITH a AS (SELECT o_orderstatus AS c, count(*) AS n, count(*)/sum(count(*)) OVER () AS s FROM orders GROUP BY 1)
  SELECT c, n, round(s, 6) AS share, round(1/(s + 0.01)*count(*) OVER ()/sum(1/(s + 0.01)) OVER (), 6) AS weight FROM a""")
def _weights(t):
    return rounded(tb.inverse_prior_weights(t.orders.select(F.col("o_orderstatus").alias("c")), "c", 0.01))


@query("with_class_weights", """WITH a AS (SELECT o_orderstatus AS c, 1/(count(*)/sum(count(*)) OVER ()) AS i FROM orders GROUP BY 1)
  SELECT o_orderkey AS id, c, round(w, 6) AS weight FROM orders JOIN (SELECT c, i*count(*) OVER ()/sum(i) OVER () AS w FROM a) ON c = o_orderstatus""")
def _with_weights(t):
    return rounded(tb.with_class_weights(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("c")), "c"))


@query("biased_sample_weight", f"""WITH {POINTS_SQL}, s AS (SELECT 0.01*sum((NOT fire)::INT)/(sum(fire::INT)*0.99) AS w FROM points)
  SELECT id, fire::INT AS y, round(CASE WHEN fire THEN w ELSE 1 END, 6)::DOUBLE AS weight FROM points, s""")
def _biased(t):
    return rounded(tb.biased_sample_weight(t.points.select("id", F.col("fire").cast("int").alias("y")), "y", 0.01))


def _freq_sql(where=""):
    return f"""{POINTS_SQL}, f AS (SELECT v, h, i % 4 AS q, avg(fire::INT) AS p, count(*) AS n FROM points {where} GROUP BY ALL),
  fr AS (SELECT *, p/(SELECT max(p) FROM f)*0.9 AS r FROM f)"""


def _features(t):
    return t.points.select("id", "v", "h", (F.col("i") % 4).alias("q"), F.col("fire").cast("int").alias("y"))


@query("frequency_table", f"WITH {_freq_sql()} SELECT v, h, q, round(r, 6) AS proba, n FROM fr")
def _freq(t):
    return rounded(tb.frequency_table(_features(t), ["v", "h", "q"], "y", 0.9))


@query("predict_from_frequency", f"""WITH {_freq_sql()}, p AS (SELECT id, v, h + 1 AS h, i % 4 AS q FROM points)
  SELECT id, p.v, p.h, p.q, round(coalesce(r, 0.05), 6)::DOUBLE AS proba, (coalesce(r, 0.05) >= 0.5)::INT AS label FROM p
  LEFT JOIN fr ON fr.v=p.v AND fr.h=p.h AND fr.q=p.q""")
def _predict_freq(t):
    """The tile to the east of every sample; the last column of tiles has none."""
    f = tb.frequency_table(_features(t), ["v", "h", "q"], "y", 0.9)
    return rounded(tb.predict_from_frequency(_features(t).drop("y").withColumn("h", F.col("h") + 1), f, ["v", "h", "q"], 0.05))


@query("weighted_average", "SELECT l_linenumber AS k, round(sum(CASE WHEN l_tax > 0 THEN l_discount*l_quantity END)/sum(CASE WHEN l_tax > 0 THEN l_quantity END), 6) AS mean FROM lineitem GROUP BY 1")
def _wavg(t):
    x = t.lineitem.select(F.col("l_linenumber").alias("k"), F.when(F.col("l_tax") > 0, F.col("l_discount")).alias("x"), F.col("l_quantity").alias("w"))
    return rounded(tb.weighted_average(x, "x", "w", ["k"]))


@query("harmonize", "SELECT c_custkey AS id, round((SELECT sum(c_acctbal*c_nationkey)/sum(c_nationkey) FROM customer), 6) AS x FROM customer")
def _harmonize(t):
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("w"))
    return rounded(tb.harmonize(c, "x", "w").drop("w"))


@query("is_constant", """SELECT 'o_orderkey' AS "column", false AS is_constant, count(DISTINCT o_orderkey) = count(*) AS all_unique FROM orders
  UNION ALL SELECT 'one', true, false FROM (SELECT 1) UNION ALL SELECT 'o_custkey', max(o_custkey) - min(o_custkey) <= 1e-8 + 1e-5*abs(min(o_custkey)), count(DISTINCT o_custkey) = count(*) FROM orders""")
def _constant(t):
    return tb.is_constant(t.orders.withColumn("one", F.lit(1)), ["o_orderkey", "one", "o_custkey"])


@query("cross", "SELECT n_name, r_name, n_regionkey, r_regionkey FROM nation CROSS JOIN region")
def _cross(t):
    return tb.cross(t.nation.select("n_name", "n_regionkey"), t.region.select("r_name", "r_regionkey"))


@query("cross_preserve", """SELECT coalesce(a.k, b.k) AS k, a.x AS x_x, b.x AS x_y FROM (SELECT n_regionkey AS k, n_name AS x FROM nation WHERE n_nationkey % 3 <> 0) a
  FULL JOIN (SELECT r_regionkey AS k, r_name AS x FROM region WHERE r_regionkey > 0) b ON a.k = b.k""")
def _cross_preserve(t):
    a = t.nation.filter("n_nationkey % 3 <> 0").select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("x"))
    return tb.cross(a, t.region.filter("r_regionkey > 0").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("x")), ["k"])


@query("grid_product", "SELECT n_nationkey AS id, a AS x, b AS y FROM nation, unnest([0, 1, n_regionkey]) AS ta(a), unnest([10, 20]) AS tb(b)")
def _grid_product(t):
    n = t.nation.select(F.col("n_nationkey").alias("id"), F.array(F.lit(0), F.lit(1), F.col("n_regionkey")).alias("a"), F.array(F.lit(10), F.lit(20)).alias("b"))
    return tb.grid_product(n, {"x": "a", "y": "b"})


_SUMS = {"x0": VALUES[:32], "x1": VALUES[32:]}


@query("grid_over", f"""WITH {VECTORS_SQL}, w AS (SELECT {', '.join(f"{' + '.join(v)} AS {k}" for k, v in _SUMS.items())} FROM vectors),
  s AS (SELECT min(x0) AS a0, max(x0) AS b0, min(x1) AS a1, max(x1) AS b1 FROM w)
  SELECT round(a0 - 0.1*(b0 - a0) + i*1.2*(b0 - a0)/9, 6) AS x0, round(a1 - 0.1*(b1 - a1) + j*1.2*(b1 - a1)/9, 6) AS x1, 7.0::DOUBLE AS c FROM s, range(0, 10) t1(i), range(0, 10) t2(j)""")
def _grid_over(t):
    """Over the sums of both halves of the values."""
    sums = t.vectors.select(*[sum((F.col(x) for x in v), F.lit(0.0)).alias(k) for k, v in _SUMS.items()], F.lit(7.0).alias("c"))
    return rounded(tb.grid_over(sums, ["x0", "x1", "c"], 105, 0.1))


@query("scores_wide", f"""WITH {RUNS_SQL} SELECT model, round(avg(CASE WHEN split = 'O' THEN y_true END), 6) AS "O_ptrue_mean", round(avg(CASE WHEN split = 'F' THEN y_true END), 6) AS "F_ptrue_mean" FROM runs GROUP BY 1""")
def _wide(t):
    long = t.runs.groupBy("model", "split").agg(F.avg("y_true").alias("value")).withColumns({"target": F.lit("ptrue"), "measure": F.lit("mean")})
    return rounded(tb.scores_wide(long, ["model"], ["split", "target", "measure"], "value", ["O_ptrue_mean", "F_ptrue_mean"]))


@query("scores_long", f"WITH {PREDS_SQL}, s AS (SELECT l_linenumber AS model, avg(p_f) AS a, avg(p_i) AS b FROM preds GROUP BY 1) SELECT model, 'a' AS name, round(a, 6) AS value FROM s UNION ALL SELECT model, 'b', round(b, 6) FROM s")
def _long(t):
    s = t.preds.groupBy(F.col("l_linenumber").alias("model")).agg(F.avg("p_f").alias("a"), F.avg("p_i").alias("b"))
    return rounded(tb.scores_long(s, ["model"]))


@query("concat", "SELECT c_custkey AS id, c_acctbal AS bal, c_mktsegment AS seg FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def _concat(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    return tb.concat([a, t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))])
