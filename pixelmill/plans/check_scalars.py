"""Row-wise expressions over samples, names and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelmill.functions import scalars as s
from pixelmill.operators import tables as tb
from pixelmill.plans.lenses import COUNTRIES_SQL, NAMES_SQL, POINTS_SQL, PREDS_SQL, VALUES, VECTORS_SQL, crc32_sql
from pixelmill.plans.registry import query

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def r6(c, name):
    return F.round(c, 6).alias(name)


@query("yday_to_date", f"""WITH {POINTS_SQL} SELECT id, CASE WHEN yday - 30 >= 1
  THEN CAST(make_date(year,1,1) + CAST(yday - 31 AS INT) AS DATE) END AS date FROM points""")
def _yday_to_date(t):
    return t.points.select("id", s.yday_to_date(F.col("year"), F.col("yday") - 30).alias("date"))


@query("month_bounds", f"""WITH {POINTS_SQL} SELECT id, CAST(date_trunc('month', d) AS DATE) AS first_date,
  last_day(d) AS last_date, CAST(dayofyear(make_date(year,12,31)) AS INT) AS n_days FROM points""")
def _month_bounds(t):
    b = s.month_bounds(F.col("year"), F.month("d"))
    return t.points.select("id", *[c.alias(n) for n, c in b.items()], s.days_in_year(F.col("year")).alias("n_days"))


@query("parse_layer_name", f"""WITH {NAMES_SQL} SELECT id, 'MCD64A1' AS product,
  CAST(make_date(year,1,1) + CAST(yday - 1 AS INT) AS DATE) AS date, h, v FROM names""")
def _parse_layer_name(t):
    return t.names.select("id", *[c.alias(n) for n, c in s.parse_layer_name(F.col("path")).items()])


@query("tile_name", f"WITH {POINTS_SQL} SELECT id, printf('h%02dv%02d', h, v) AS tile FROM points")
def _tile_name(t):
    return t.points.select("id", s.tile_name(F.col("h"), F.col("v")).alias("tile"))


@query("qa_ok", """WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey % 256 AS INT) AS qa FROM lineitem)
  SELECT *, qa & 3 = 3 AND qa & 4 = 0 AND NOT (qa >> 5 BETWEEN 1 AND 5) AS ok, NOT (qa >> 5 BETWEEN 1 AND 5) AS ok_legacy FROM q""")
def _qa_ok(t):
    qa = F.col("qa")
    return t.lineitem.select(*KEY, (F.col("l_partkey") % 256).cast("int").alias("qa")).select(
        *KEY, "qa", s.qa_ok(qa).alias("ok"), s.qa_ok(qa, legacy=True).alias("ok_legacy"))


@query("one_hot", f"""WITH {POINTS_SQL} SELECT id, {', '.join(f'1 + i % 17 = {k} AS x_lct_{k}' for k in range(1, 18))} FROM points""")
def _one_hot(t):
    return t.points.select("id", *s.one_hot(1 + F.col("i") % 17, range(1, 18)))


@query("sigmoid_logit", f"""WITH {PREDS_SQL} SELECT {KEY_SQL}, round(1/(1 + exp(-(4*p_f - 2))), 6) AS sig,
  CASE WHEN p_f > 0 AND p_f < 1 THEN round(ln(p_f) - ln(1 - p_f), 6) END AS logit,
  round(p_f/(1 - p_f), 6) AS odds, round(p_i/(p_i + 1), 6) AS from_odds FROM preds""")
def _sigmoid_logit(t):
    p = F.col("p_f")
    return t.preds.select(*KEY, r6(s.sigmoid(4 * p - 2), "sig"), r6(s.logit(p), "logit"), r6(s.odds(p), "odds"),
                          r6(s.odds_to_proba(F.col("p_i")), "from_odds"))


@query("clamp", """SELECT c_custkey AS id, greatest(0.0, least(5000.0, c_acctbal))::DOUBLE AS x FROM customer""")
def _clamp(t):
    return t.customer.select(F.col("c_custkey").alias("id"), s.clamp(F.col("c_acctbal"), 0.0, 5000.0).alias("x"))


@query("stretch", """WITH a AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
  SELECT c_custkey AS id, round((c_acctbal - lo)/(hi - lo)*0.8 + 0.1, 6) AS x,
  round((c_acctbal - lo)/(hi - lo)*(20000 - lo) + lo, 6) AS x_moved FROM customer, a""")
def _stretch(t):
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    both = tb.stretch(c.withColumn("x_moved", F.col("x")), "x", 0.1, 0.9)
    return tb.move_max(both, "x_moved", 20000.0).select("id", r6(F.col("x"), "x"), r6(F.col("x_moved"), "x_moved"))


@query("stretch_by_group", """WITH a AS (SELECT c_nationkey AS nk, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1)
  SELECT c_custkey AS id, c_nationkey, round((c_acctbal - lo)/(hi - lo), 6) AS x FROM customer JOIN a ON nk = c_nationkey""")
def _stretch_by_group(t):
    c = t.customer.select(F.col("c_custkey").alias("id"), "c_nationkey", F.col("c_acctbal").alias("x"))
    return tb.stretch(c, "x", 0.0, 1.0, by=["c_nationkey"]).select("id", "c_nationkey", r6(F.col("x"), "x"))


@query("zscore", f"""WITH {VECTORS_SQL}, a AS (SELECT {', '.join(f'avg({x}) AS m_{x}, stddev_pop({x}) AS s_{x}' for x in VALUES)} FROM vectors)
  SELECT vec_id, {', '.join(f"round(({x} - m_{x})/s_{x}*2{' + 0.5' if x == 'x0' else ''}, 6) AS {x}" for x in VALUES)} FROM vectors, a""")
def _zscore(t):
    z = tb.zscore(t.vectors.select("vec_id", *VALUES), VALUES, scale=2.0, shift_first=0.5)
    return z.select("vec_id", *[r6(F.col(x), x) for x in VALUES])


@query("recode", f"""SELECT {KEY_SQL}, CASE WHEN l_quantity = 1 THEN 2.0 WHEN l_quantity = 2 THEN 1.0 WHEN l_quantity = 50 THEN -9.0
  ELSE l_quantity END::DOUBLE AS q FROM lineitem""")
def _recode(t):
    return t.lineitem.select(*KEY, s.recode(F.col("l_quantity"), {1: 2, 2: 1, 50: -9}).alias("q"))


@query("fill_country_code", f"""WITH {COUNTRIES_SQL} SELECT name, CASE WHEN iso3 <> '-99' THEN iso3
  WHEN name = 'France' THEN 'FRA' WHEN name = 'Norway' THEN 'NOR' WHEN name = 'Kosovo' THEN 'XKX' ELSE name END AS iso3 FROM countries""")
def _fill_country_code(t):
    return t.countries.select("name", s.fill_country_code(F.col("iso3"), F.col("name")).alias("iso3"))


def _hex_crc(text):
    return f"upper(to_hex({crc32_sql(text)}))"


@query("crc_id", f"""WITH {NAMES_SQL} SELECT id, {_hex_crc('path')} AS crc, {_hex_crc("('h: ' || h || ',' || chr(10) || 'v: ' || v || ',' || chr(10))")} AS crc_fields FROM names""")
def _crc_id(t):
    return t.names.select("id", s.crc_id(F.col("path")).alias("crc"), s.crc_of_fields(F.create_map(
        F.lit("v"), F.col("v").cast("string"), F.lit("h"), F.col("h").cast("string"))).alias("crc_fields"))


@query("nodata_to_null", f"""SELECT {KEY_SQL}, CASE WHEN l_quantity NOT IN (1, 50) THEN l_quantity END AS q FROM lineitem""")
def _nodata(t):
    return t.lineitem.select(*KEY, s.nodata_to_null(F.col("l_quantity"), [1.0, 50.0]).alias("q"))


@query("regex_match", r"""SELECT page_id, regexp_matches(url, 'ref=') AS has_ref,
  CASE WHEN regexp_matches(url, 'page=([0-9]+)') THEN regexp_extract(url, 'page=([0-9]+)', 1) END AS page_no FROM pages""")
def _regex(t):
    u = F.col("url")
    return t.pages.select("page_id", s.regex_like(u, "ref=").alias("has_ref"),
                          s.regex_extract(u, "page=([0-9]+)", 1).alias("page_no"))


@query("to_date_strict", "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d FROM orders")
def _to_date(t):
    return t.orders.select(F.col("o_orderkey").alias("id"),
                           s.to_date_strict(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"))


@query("undo_oversampling", f"""WITH {PREDS_SQL}, o AS (SELECT *, p_f/(1 - p_f)*((0.01/0.99)/(0.25/0.75)) AS od FROM preds)
  SELECT {KEY_SQL}, round(od/(1 + od), 6) AS p FROM o""")
def _undo(t):
    return t.preds.select(*KEY, r6(s.undo_oversampling(F.col("p_f"), 0.01, 0.25), "p"))


@query("proba_functions", f"""WITH {PREDS_SQL}, c AS (SELECT {KEY_SQL}, p_f, l_linenumber % 6 AS rain, l_partkey % 6 AS temp FROM preds)
  SELECT {KEY_SQL}, round(greatest(0, least(1, (p_f - 0.2)*1.5))*0.8, 6)::DOUBLE AS lin,
  round(0.9/(1 + exp(-((p_f - 0.5)*4))), 6) AS sig,
  round(greatest(0.0, least(1.0, 0.2*temp - 0.25*rain)), 6)::DOUBLE AS lvl FROM c""")
def _proba_functions(t):
    p = F.col("p_f")
    return t.preds.select(*KEY, r6(s.linear_clip_proba(p, -0.2, 1.5, 0.8), "lin"), r6(s.sigmoid_proba(p, 0.5, 4.0, 0.9), "sig"),
                          r6(s.level_fire_proba(F.col("l_linenumber") % 6, F.col("l_partkey") % 6), "lvl"))


@query("noisy_or_score", f"""WITH {VECTORS_SQL}, c AS (SELECT vec_id, 1/(1 + exp(-(x0 - x1 + 0.1*label))) AS p_f,
  greatest(0.0, least(1.0, 0.9*(1 - (1 - 1/(1 + exp(-x2)))*(1 - CAST(vec_id % 2 AS DOUBLE)*0.3))))::DOUBLE AS p_i FROM vectors)
  SELECT vec_id, round(p_f, 6) AS p_f, round(p_i, 6) AS p_i, round(p_f*p_i, 6) AS p FROM c""")
def _noisy_or(t):
    params = t.vectors.select(F.col("label").alias("pid")).distinct().select(
        "pid", F.lit(0.3).alias("spread"), (0.1 * F.col("pid")).alias("shift"))
    v = t.vectors.withColumnRenamed("label", "pid").join(params, "pid")
    p = s.noisy_or_score(F.col("x0"), F.col("x1"), F.col("x2"), (F.col("vec_id") % 2).cast("double"), F.lit(0.9),
                         F.col("spread"), F.col("shift"))
    return v.select("vec_id", *[r6(c, n) for n, c in p.items()])


FIRST, SECOND = VALUES[:32], VALUES[32:]
W_FIRST, W_SECOND = ([(k * m % 7 - 3) / 8 for k in range(32)] for m in (3, 5))


def _sum_sql(names, weights, bias):
    return " + ".join(f"({w})*{x}" for x, w in zip(names, weights)) + f" + ({bias})"


@query("score_product", f"""WITH {VECTORS_SQL}, c AS (SELECT vec_id, 1/(1 + exp(-({_sum_sql(FIRST, W_FIRST, 0.5)}))) AS p_f,
  1/(1 + exp(-({_sum_sql(SECOND, W_SECOND, -1)}))) AS p_i, 1/(1 + exp(-(0.7 - 0.2))) AS one FROM vectors)
  SELECT vec_id, round(p_f, 6) AS p_f, round(p_i, 6) AS p_i, round(p_f*p_i, 6) AS p, round(p_f*one, 6) AS p_const FROM c""")
def _score_product(t):
    first, second = ([F.col(x) for x in names] for names in (FIRST, SECOND))
    two = s.score_product(first, W_FIRST, 0.5, second, W_SECOND, -1)
    const = s.score_product(first, W_FIRST, 0.5, [], [0.7], -0.2)
    return t.vectors.select("vec_id", *[r6(c, n) for n, c in two.items()], r6(const["p"], "p_const"))


_L1 = [([((n + 2) * k % 9 - 4) / 16 for k in range(64)], 0.1 * n - 0.1) for n in range(3)]


@query("score_mlp", f"""WITH {VECTORS_SQL}, l AS (SELECT vec_id, {', '.join(
    f"1/(1 + exp(-({_sum_sql(VALUES, ws, b)}))) AS h{n}" for n, (ws, b) in enumerate(_L1))} FROM vectors)
  SELECT vec_id, round(1/(1 + exp(-(2*h0 - 1.5*h1 + h2 - 0.3))), 6) AS p FROM l""")
def _score_mlp(t):
    layers = [([w for w, _ in _L1], [b for _, b in _L1]), ([[2.0, -1.5, 1.0]], [-0.3])]
    return t.vectors.select("vec_id", r6(s.score_mlp([F.col(x) for x in VALUES], layers), "p"))


@query("rename_to_generic", "SELECT o_totalprice AS x0, o_custkey AS x1, o_orderstatus = 'F' AS fire FROM orders")
def _rename(t):
    return s.rename_to_generic(t.orders.withColumn("f", F.col("o_orderstatus") == "F"), ["o_totalprice", "o_custkey"], "f")


@query("enforce_sample_schema", f"""WITH {POINTS_SQL} SELECT v, h, i AS i2, j AS j2, year, yday, CAST(1 + i % 17 AS INT) AS lct, fire
  FROM points WHERE year = 1997""")
def _schema(t):
    p = t.points.filter("year = 1997").select(
        F.col("v").cast("bigint").alias("v"), "h", F.col("i").alias("i2"), F.col("j").alias("j2"), "year", "yday",
        (1 + F.col("i") % 17).cast("bigint").alias("lct"), F.col("fire").cast("int").alias("fire"))
    return s.enforce_sample_schema(p)


@query("flatten_columns", f"WITH {POINTS_SQL} SELECT id, v AS cell_v, h AS cell_h, i AS cell_at_i, j AS cell_at_j FROM points")
def _flatten(t):
    return s.flatten_columns(t.points.select("id", F.struct("v", "h", F.struct("i", "j").alias("at")).alias("cell")))


@query("bin_mid", f"WITH {PREDS_SQL} SELECT {KEY_SQL}, round((floor(p_f*10)/10 + floor(p_f*10)/10 + 0.1)/2, 6) AS mid FROM preds")
def _bin_mid(t):
    lo = F.floor(F.col("p_f") * 10) / 10
    return t.preds.select(*KEY, F.struct(lo.alias("lo"), (lo + 0.1).alias("hi")).alias("b")).select(
        *KEY, r6(s.bin_mid(F.col("b")), "mid"))


@query("pick_elements", f"""WITH {POINTS_SQL} SELECT id, array_to_string(list_filter([v, h, i, j], lambda x: x > 5), ',') AS picked,
  NOT (v > 5) AS drop_v, NOT (h > 5) AS drop_h, NOT (i > 5) AS drop_i, NOT (j > 5) AS drop_j FROM points""")
def _pick(t):
    values = F.array("v", "h", "i", "j")
    mask = F.transform(values, lambda x: x > 5)
    out = t.points.select("id", F.array_join(s.pick_elements(values, mask), ",").alias("picked"), s.negate(mask).alias("dropped"))
    return out.select("id", "picked", *s.unstack_columns(F.col("dropped"), ["drop_v", "drop_h", "drop_i", "drop_j"]))


@query("drop_map_keys", f"WITH {POINTS_SQL} SELECT id, i AS i, j AS j, 2 AS n FROM points")
def _drop_keys(t):
    m = s.drop_map_keys(F.create_map(F.lit("v"), "v", F.lit("h"), "h", F.lit("i"), "i", F.lit("j"), "j"), ["v", "h"])
    return t.points.select("id", m.alias("m")).select("id", F.col("m.i").alias("i"), F.col("m.j").alias("j"), F.size("m").alias("n"))


@query("expand_range", """SELECT c_nationkey AS k, min(c_acctbal) - 5 AS lo, max(c_acctbal) + 5 AS hi,
  round(min(c_acctbal) - 0.1*(max(c_acctbal) - min(c_acctbal)), 6) AS lo_rel FROM customer GROUP BY 1""")
def _expand(t):
    a = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_acctbal").alias("a"), F.max("c_acctbal").alias("b"))
    e = s.expand_range(F.col("a"), F.col("b"), 5.0)
    return a.select("k", e["lo"].alias("lo"), e["hi"].alias("hi"),
                    r6(s.expand_range(F.col("a"), F.col("b"), 0.1, relative=True)["lo"], "lo_rel"))


@query("zero_to_minus_one", f"SELECT {KEY_SQL}, CASE WHEN l_tax = 0 THEN -1.0 ELSE l_tax END::DOUBLE AS x FROM lineitem")
def _zero(t):
    return t.lineitem.select(*KEY, s.zero_to_minus_one(F.col("l_tax")).alias("x"))


@query("scale_process_params", f"""WITH {VECTORS_SQL} SELECT vec_id, round(x0*2, 6) AS mu2, round(pow(sqrt(abs(x1))*3, 2), 6) AS var2,
  round(sign(x2)*pow(sqrt(abs(x2))*3, 2), 6) AS var12 FROM vectors""")
def _scale(t):
    c = s.scale_process_params(F.col("x0"), F.abs("x1"), F.col("x2"), 2.0, 3.0)
    return t.vectors.select("vec_id", *[r6(x, n) for n, x in c.items()])


@query("recycle", f"WITH {POINTS_SQL} SELECT id, concat_ws(',', v, h, v, h, v, h) AS a, v AS first_, h AS second_ FROM points")
def _recycle(t):
    return t.points.select("id", F.array_join(s.recycle(F.array("v", "h"), F.lit(6)), ",").alias("a"),
                           *s.unstack_columns(s.stack_columns(["v", "h"]), ["first_", "second_"]))


@query("adjust_bin_means", f"""WITH {PREDS_SQL}, b AS (SELECT l_linenumber AS bin, avg(y_true) AS m FROM preds GROUP BY 1), o AS (SELECT *, m/(1 - m)*((0.02/0.98)/(0.3/0.7)) AS o FROM b)
  SELECT bin, round((0.02/0.98)/(0.3/0.7), 6)::DOUBLE AS knr, round(o/(o + 1), 6) AS adjusted FROM o""")
def _adjust(t):
    b = t.preds.groupBy(F.col("l_linenumber").alias("bin")).agg(F.avg("y_true").alias("m"))
    k = s.keep_neg_rate(0.3, 0.02)
    return b.select("bin", r6(k, "knr"), r6(s.adjust_mean(F.col("m"), k), "adjusted"))


@query("stack_columns", f"WITH {POINTS_SQL} SELECT id, concat_ws(',', v, h, i, j) AS cell, i AS row_, j AS col_ FROM points")
def _stack(t):
    p = t.points.select("id", s.stack_columns(["v", "h", "i", "j"]).alias("cell"))
    return p.select("id", F.array_join("cell", ",").alias("cell"), *s.unstack_columns(F.slice("cell", 3, 2), ["row_", "col_"]))
