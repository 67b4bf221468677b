"""Sampling and balancing over the samples; the hash contract makes them checkable row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelmill.operators import sampling as sp
from pixelmill.operators import tables as tb
from pixelmill.plans.check_layers import BOUNDS_SQL, BURN_FULL_SQL, burn_full
from pixelmill.plans.lenses import BURN_SQL, POINTS_SQL
from pixelmill.plans.registry import query

KEY = ["id"]


def h(seed, key="id"):
    return f"('0x' || substr(md5(concat_ws('|', {key}, '{seed}')), 1, 15))::BIGINT"


def u(seed, key="id"):
    return f"({h(seed, key)}/1152921504606846976.0::DOUBLE)"


@query("undersample_negatives", f"WITH {POINTS_SQL} SELECT id, fire FROM points WHERE fire OR {u(1)} >= 0.8")
def _under(t):
    return sp.undersample_negatives(t.points.select("id", "fire"), "fire", KEY, 0.8, 1)


@query("undersample_to_rate", f"""WITH {POINTS_SQL}, p AS (SELECT id, fire, sum(fire::INT) OVER () AS np, avg(fire::INT) OVER () AS r,
    row_number() OVER (PARTITION BY fire ORDER BY {h(2)}, id) AS rn FROM points),
  c AS (SELECT *, row_number() OVER (ORDER BY {h(3)}, id) AS rk FROM p WHERE fire OR rn <= round_even(np*0.25/0.75, 0))
  SELECT id, fire, round(r, 6) AS r_pos_original FROM c WHERE rk <= 300""")
def _to_rate(t):
    return sp.undersample_to_rate(t.points.select("id", "fire"), "fire", KEY, 300, 0.75, 2) \
        .withColumn("r_pos_original", F.round("r_pos_original", 6))


@query("restore_prior", f"WITH {POINTS_SQL} SELECT id, fire FROM points WHERE NOT fire OR {u(4)} < 0.1")
def _restore(t):
    return sp.restore_prior(t.points.select("id", "fire"), "fire", KEY, 0.1, 4)


@query("balance_classes_under", f"""WITH c AS (SELECT o_orderkey AS id, o_orderstatus AS s, count(*) OVER (PARTITION BY o_orderstatus) AS n,
    row_number() OVER (PARTITION BY o_orderstatus ORDER BY {h(5, 'o_orderkey')}, o_orderkey) AS rn FROM orders)
  SELECT id, s FROM c WHERE rn <= (SELECT min(n) FROM c)""")
def _balance_under(t):
    o = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"))
    return sp.balance_classes(o, "s", KEY, 5)


@query("balance_classes_over", f"""WITH c AS (SELECT o_orderkey AS id, o_orderpriority AS s, count(*) OVER (PARTITION BY o_orderpriority) AS n,
    row_number() OVER (PARTITION BY o_orderpriority ORDER BY {h(6, 'o_orderkey')}, o_orderkey) AS rn FROM orders), m AS (SELECT max(n) AS m FROM c)
  SELECT id, s, CAST(unnest(range(1, CAST(m//n + CASE WHEN rn <= m % n THEN 1 ELSE 0 END AS BIGINT) + 1)) AS INT) AS copy FROM c, m""")
def _balance_over(t):
    o = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("s"))
    return sp.balance_classes(o, "s", KEY, 6, oversample=True)


@query("sample_fraction", f"""WITH {POINTS_SQL}, c AS (SELECT id, row_number() OVER (ORDER BY {h(7)}, id) AS rn, count(*) OVER () AS n FROM points)
  SELECT id, CAST(unnest(range(1, 3 + CASE WHEN rn <= round_even(n*0.25, 0) THEN 1 ELSE 0 END)) AS INT) AS copy FROM c""")
def _fraction(t):
    return sp.sample_fraction(t.points.select("id"), KEY, 2.25, 7)


_SPLIT_SQL = """SELECT id, fire, CASE WHEN rn <= floor(n*0.5 + 1e-9) THEN 'train' WHEN rn <= n - floor((n - floor(n*0.5 + 1e-9))*0.6 + 1e-9) THEN 'val'
  ELSE 'test' END AS split FROM c"""


@query("split", f"""WITH {POINTS_SQL}, c AS (SELECT id, fire, row_number() OVER (ORDER BY {h(8)}, id) AS rn, count(*) OVER () AS n FROM points)
  {_SPLIT_SQL}""")
def _split(t):
    return sp.split(t.points.select("id", "fire"), KEY, 0.5, 0.2, 8)


@query("split_stratified", f"""WITH {POINTS_SQL}, c AS (SELECT id, fire, row_number() OVER (PARTITION BY fire ORDER BY {h(9)}, id) AS rn,
    count(*) OVER (PARTITION BY fire) AS n FROM points) {_SPLIT_SQL}""")
def _split_strat(t):
    return sp.split(t.points.select("id", "fire"), KEY, 0.5, 0.2, 9, "fire")


@query("exact_random_subset", f"""WITH {POINTS_SQL}, c AS (SELECT id, row_number() OVER (ORDER BY {h(10)}, id) AS rn FROM points)
  SELECT id FROM c WHERE rn <= 123""")
def _subset(t):
    return sp.exact_random_subset(t.points.select("id"), KEY, 123, 10)


@query("bernoulli", f"WITH {POINTS_SQL} SELECT id FROM points WHERE {u(11)} < 0.3")
def _bernoulli(t):
    return sp.bernoulli(t.points.select("id"), KEY, 0.3, 11)


@query("first_fraction", f"""WITH {POINTS_SQL}, c AS (SELECT id, row_number() OVER (ORDER BY {h(12)}, id) AS rn, count(*) OVER () AS n FROM points)
  SELECT id FROM c WHERE rn <= floor(n*0.1 + 1e-9)""")
def _first_fraction(t):
    return sp.first_fraction(t.points.select("id"), KEY, 0.1, 12)


@query("complement", f"WITH {POINTS_SQL} SELECT id, fire FROM points WHERE NOT ({u(13)} < 0.3)")
def _complement(t):
    p = t.points.select("id", "fire")
    return sp.complement(p, sp.bernoulli(p, KEY, 0.3, 13), KEY)


@query("assign_sample_day", f"""WITH {BURN_SQL}, {BURN_FULL_SQL}, {BOUNDS_SQL} SELECT v, h, i, j, year, month,
  CAST(CASE WHEN burn_date > 0 THEN burn_date ELSE lo + {h(14, 'v, h, i, j, year, month')} % (hi - lo + 1) END AS INT) AS yday
  FROM bounds WHERE lo <= hi""")
def _day(t):
    key = ["v", "h", "i", "j", "year", "month"]
    return sp.assign_sample_day(burn_full(t).withColumn("fire", F.col("burn_date") > 0), key, 14).select(*key, "yday")


@query("permute_column", f"""WITH {POINTS_SQL}, a AS (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM points),
  b AS (SELECT i, row_number() OVER (ORDER BY {h(15)}, id) AS rn FROM points) SELECT id, i FROM a JOIN b USING (rn)""")
def _permute(t):
    return tb.permute_column(t.points.select("id", "i"), "id", "i", 15)


@query("task_seed", f"WITH {POINTS_SQL} SELECT v, h, year, {h(16, 'v, h, year')} % 4294967296 AS seed FROM points GROUP BY ALL")
def _seed(t):
    return t.points.select("v", "h", "year").distinct().withColumn("seed", sp.task_seed([F.col(c) for c in ("v", "h", "year")], 16))


@query("split_head_tail", f"""WITH {POINTS_SQL} SELECT id, row_number() OVER (ORDER BY id) <= 100 AS is_head FROM points""")
def _head(t):
    return tb.split_head_tail(t.points.select("id"), "id", 100)


@query("batches", f"""WITH {POINTS_SQL} SELECT id, h, CAST(floor((row_number() OVER (PARTITION BY h ORDER BY id) - 1)/64) AS BIGINT) AS batch FROM points""")
def _batches(t):
    return tb.batches(t.points.select("id", "h"), "id", 64, ["h"])
