"""Views that let the driver's tables stand in for rasters, samples and predictions.

``Tables`` gives the DataFrame form; the ``*_SQL`` strings are the same definitions as common table
expressions for the SQL oracles.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TILE = 24  # cells per tile side in the lens
GRID = 6  # cells per side of the daily grid
VALUES = [f"x{k}" for k in range(64)]  # all values of an embedding


def _int(c: Column) -> Column:
    return c.cast("int")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                    "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
            return self.read(name)
        raise AttributeError(name)

    @cached_property
    def _line_cells(self) -> DataFrame:
        return self.lineitem.select(
            _int(F.col("l_linenumber") % 2).alias("v"), _int(F.col("l_suppkey") % 3).alias("h"),
            _int(F.col("l_partkey") % TILE).alias("i"), _int(F.col("l_orderkey") % TILE).alias("j"),
            _int(F.year("l_shipdate")).alias("year"), _int(F.month("l_shipdate")).alias("month"),
            "l_quantity", "l_tax", "l_returnflag", "l_shipdate")

    @cached_property
    def lct(self) -> DataFrame:
        """Yearly land cover class 1..17 with a quality flag."""
        return self._line_cells.groupBy("v", "h", "i", "j", "year").agg(
            _int(1 + F.sum(F.col("l_quantity").cast("bigint")) % 17).alias("lct"),
            F.max(F.when(F.col("l_tax") > 0.075, 1).otherwise(0)).alias("qc"))

    @cached_property
    def burn(self) -> DataFrame:
        """Monthly burn day (0 unburned, -1 unusable) with an uncertainty in days."""
        return self._line_cells.groupBy("v", "h", "i", "j", "year", "month").agg(
            F.max(F.when(F.col("l_returnflag") == "R", _int(F.dayofyear("l_shipdate")))
                  .when(F.col("l_returnflag") == "A", 0).otherwise(-1)).alias("burn_date"),
            F.min(_int(F.col("l_quantity")) % 4).alias("uncertainty"))

    @cached_property
    def cells(self) -> DataFrame:
        """Land cover layers in long form: one row per (product, var, tile, date, cell)."""
        return self.lct.select("v", "h", "i", "j", F.make_date("year", F.lit(1), F.lit(1)).alias("date"),
                               F.col("lct").cast("double").alias("lct"), F.col("qc").cast("double").alias("qc")) \
            .unpivot(["v", "h", "i", "j", "date"], ["lct", "qc"], "var", "value") \
            .withColumn("product", F.lit("LAND"))

    @cached_property
    def points(self) -> DataFrame:
        """Samples: one (pixel, day) per order."""
        return self.orders.select(
            F.col("o_orderkey").alias("id"), _int(F.col("o_orderkey") % 2).alias("v"),
            _int(F.col("o_custkey") % 3).alias("h"), _int(F.col("o_custkey") % TILE).alias("i"),
            _int(F.col("o_orderkey") % TILE).alias("j"), _int(F.year("o_orderdate")).alias("year"),
            _int(F.dayofyear("o_orderdate")).alias("yday"), F.col("o_orderdate").cast("date").alias("d"),
            (F.col("o_orderstatus") == "F").alias("fire"))

    @cached_property
    def daily(self) -> DataFrame:
        """Daily 6 x 6 grid."""
        return self.lineitem.groupBy(
            F.col("l_shipdate").cast("date").alias("date"), _int(F.col("l_partkey") % GRID).alias("row"),
            _int(F.col("l_suppkey") % GRID).alias("col")).agg(F.avg("l_quantity").alias("value"))

    @cached_property
    def monthly(self) -> DataFrame:
        """Monthly 6 x 6 grid, one value per month."""
        return self.lineitem.groupBy(
            _int(F.year("l_shipdate")).alias("year"), _int(F.month("l_shipdate")).alias("month"),
            _int(F.col("l_partkey") % GRID).alias("row"), _int(F.col("l_suppkey") % GRID).alias("col")) \
            .agg(F.avg("l_quantity").alias("value"))

    @cached_property
    def countries(self) -> DataFrame:
        k = F.col("n_nationkey")
        west = -180.0 + 72.0 * (k % 5)
        south = -90.0 + 36.0 * F.floor(k / 5)
        return self.nation.select(
            F.col("n_name").alias("name"),
            F.when(k % 8 == 3, "-99").otherwise(F.upper(F.substring("n_name", 1, 3))).alias("iso3"),
            F.col("n_regionkey").alias("continent"), west.alias("xmin"), (west + 72.0).alias("xmax"),
            south.alias("ymin"), (south + 36.0).alias("ymax"))

    @cached_property
    def geo_points(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.customer.select(k.alias("id"), (((k * 7919) % 36000).cast("double") / 100.0 - 180.0).alias("lon"),
                                    (((k * 104729) % 17000).cast("double") / 100.0 - 85.0).alias("lat"))

    @cached_property
    def preds(self) -> DataFrame:
        p_f = F.col("l_quantity") / 51.0
        p_i = (F.col("l_discount") + 0.01) / 0.12
        return self.lineitem.select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            _int(F.col("l_returnflag") == "R").alias("y_true"), p_f.alias("p_f"), p_i.alias("p_i"),
            (p_f * p_i).alias("y_proba"))

    @cached_property
    def runs(self) -> DataFrame:
        """Predictions of several models: model = line number, trial = order key mod 3."""
        return self.lineitem.select(
            F.col("l_linenumber").alias("model"), (F.col("l_orderkey") % 3).alias("trial"),
            F.col("l_linestatus").alias("split"), _int(F.col("l_returnflag") == "R").alias("y_true"),
            (F.col("l_quantity") / 51.0 * ((F.col("l_discount") + 0.01) / 0.12)).alias("y_proba"))

    @cached_property
    def indicator_wide(self) -> tuple[DataFrame, list[int]]:
        """An indicator table, wide by year, and its years: all that orders have."""
        joined = self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey")) \
            .join(self.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        first, last = self.orders.agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).head()
        years = list(range(first, last + 1))
        name = F.col("n_name")
        wide = joined.groupBy(name.alias("Country Name")).agg(*[F.sum(F.when(F.year("o_orderdate") == y, F.col("o_totalprice"))).alias(str(y)) for y in years])
        return wide.select("Country Name", F.upper(F.substring("Country Name", 1, 3)).alias("Country Code"), F.lit("X.1").alias("Indicator Code"),
                           *[F.col(f"`{y}`") for y in years]), years

    @cached_property
    def names(self) -> DataFrame:
        """Layer file names made from the samples."""
        return self.points.select(
            "id", "v", "h", "year", "yday", F.format_string(
                "data/MCD64A1/MCD64A1.A%d%03d.h%02dv%02d.006.2018142182903.hdf", "year", "yday", "h", "v")
            .alias("path"))

    @cached_property
    def vectors(self) -> DataFrame:
        e = F.col("embedding")
        return self.embeddings.select(
            "vec_id", "label", *[e[k].cast("double").alias(x) for k, x in enumerate(VALUES)])


def crc32_sql(text: str) -> str:
    """DuckDB expression of the unsigned CRC-32 of an ASCII string that isn't empty."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step}), 4294967295)"


LCT_SQL = """lct AS (
  SELECT l_linenumber % 2 AS v, CAST(l_suppkey % 3 AS INT) AS h, CAST(l_partkey % 24 AS INT) AS i,
         CAST(l_orderkey % 24 AS INT) AS j, CAST(year(l_shipdate) AS INT) AS year,
         CAST(1 + sum(CAST(l_quantity AS BIGINT)) % 17 AS INT) AS lct,
         max(CASE WHEN l_tax > 0.075 THEN 1 ELSE 0 END) AS qc
  FROM lineitem GROUP BY 1,2,3,4,5)"""
BURN_SQL = """burn AS (
  SELECT l_linenumber % 2 AS v, CAST(l_suppkey % 3 AS INT) AS h, CAST(l_partkey % 24 AS INT) AS i,
         CAST(l_orderkey % 24 AS INT) AS j, CAST(year(l_shipdate) AS INT) AS year,
         CAST(month(l_shipdate) AS INT) AS month,
         max(CASE WHEN l_returnflag = 'R' THEN CAST(dayofyear(l_shipdate) AS INT)
                  WHEN l_returnflag = 'A' THEN 0 ELSE -1 END) AS burn_date,
         min(CAST(l_quantity AS INT) % 4) AS uncertainty
  FROM lineitem GROUP BY 1,2,3,4,5,6)"""
CELLS_SQL = LCT_SQL + """, cells AS (
  SELECT 'LAND' AS product, 'lct' AS var, v, h, i, j, make_date(year,1,1) AS date, CAST(lct AS DOUBLE) AS value FROM lct
  UNION ALL
  SELECT 'LAND', 'qc', v, h, i, j, make_date(year,1,1), CAST(qc AS DOUBLE) FROM lct)"""
POINTS_SQL = """points AS (
  SELECT o_orderkey AS id, CAST(o_orderkey % 2 AS INT) AS v, CAST(o_custkey % 3 AS INT) AS h,
         CAST(o_custkey % 24 AS INT) AS i, CAST(o_orderkey % 24 AS INT) AS j,
         CAST(year(o_orderdate) AS INT) AS year, CAST(dayofyear(o_orderdate) AS INT) AS yday,
         CAST(o_orderdate AS DATE) AS d, o_orderstatus = 'F' AS fire
  FROM orders)"""
DAILY_SQL = """daily AS (
  SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_partkey % 6 AS INT) AS row_, CAST(l_suppkey % 6 AS INT) AS col_,
         avg(l_quantity) AS value
  FROM lineitem GROUP BY 1,2,3)"""
MONTHLY_SQL = """monthly AS (
  SELECT CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month,
         CAST(l_partkey % 6 AS INT) AS row_, CAST(l_suppkey % 6 AS INT) AS col_, avg(l_quantity) AS value
  FROM lineitem GROUP BY 1,2,3,4)"""
COUNTRIES_SQL = """countries AS (
  SELECT n_name AS name,
         CASE WHEN n_nationkey % 8 = 3 THEN '-99' ELSE upper(substr(n_name,1,3)) END AS iso3,
         n_regionkey AS continent,
         CAST(-180.0 + 72.0*(n_nationkey % 5) AS DOUBLE) AS xmin, CAST(-108.0 + 72.0*(n_nationkey % 5) AS DOUBLE) AS xmax,
         CAST(-90.0 + 36.0*CAST(floor(n_nationkey/5) AS INT) AS DOUBLE) AS ymin,
         CAST(-54.0 + 36.0*CAST(floor(n_nationkey/5) AS INT) AS DOUBLE) AS ymax
  FROM nation)"""
GEO_SQL = """geo_points AS (
  SELECT c_custkey AS id, CAST((c_custkey*7919) % 36000 AS DOUBLE)/100.0 - 180.0 AS lon,
         CAST((c_custkey*104729) % 17000 AS DOUBLE)/100.0 - 85.0 AS lat
  FROM customer)"""
PREDS_SQL = """preds AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_returnflag = 'R' AS INT) AS y_true,
         l_quantity/51.0 AS p_f, (l_discount + 0.01)/0.12 AS p_i,
         l_quantity/51.0*((l_discount + 0.01)/0.12) AS y_proba
  FROM lineitem)"""
RUNS_SQL = """runs AS (
  SELECT l_linenumber AS model, l_orderkey % 3 AS trial, l_linestatus AS split,
         CAST(l_returnflag = 'R' AS INT) AS y_true, l_quantity/51.0*((l_discount + 0.01)/0.12) AS y_proba
  FROM lineitem)"""
INDICATOR_SQL = """indicator_long AS (SELECT country, y, v FROM (SELECT DISTINCT n_name AS country FROM orders JOIN customer ON o_custkey=c_custkey
    JOIN nation ON c_nationkey=n_nationkey)
  CROSS JOIN (SELECT CAST(unnest(range(lo, hi + 1)) AS INT) AS y FROM (SELECT min(year(o_orderdate)) AS lo, max(year(o_orderdate)) AS hi FROM orders))
  LEFT JOIN (SELECT n_name AS country, CAST(year(o_orderdate) AS INT) AS y, sum(o_totalprice) AS v
    FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1, 2) USING (country, y))"""
NAMES_SQL = POINTS_SQL + """, names AS (
  SELECT id, v, h, year, yday,
         printf('data/MCD64A1/MCD64A1.A%d%03d.h%02dv%02d.006.2018142182903.hdf', year, yday, h, v) AS path
  FROM points)"""
VECTORS_SQL = f"""vectors AS (
  SELECT vec_id, label, {", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS {x}" for k, x in enumerate(VALUES))}
  FROM embeddings)"""
