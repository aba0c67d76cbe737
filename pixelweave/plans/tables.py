"""Tables that the queries start from, made of the driver's tables, and the register of queries.

The pixel stack numbers orders row by row on a grid 150 wide; its layers come from the order and its customer. Each table
has a text of SQL common table expressions that gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.grid import GridSpec
from pixelweave.operators import layers as L

WIDTH, AREA, YEARS = 150, 0.09, 5

G = """g AS (
SELECT CAST(floor(o.o_orderkey / 150) AS INT) AS row, CAST(o.o_orderkey % 150 AS INT) AS col,
  CASE WHEN o.o_custkey % 20 = 0 THEN NULL WHEN o.o_custkey % 10 < 8 THEN 1 ELSE 0 END AS forest_t1,
  CASE WHEN o.o_custkey % 20 = 7 THEN NULL WHEN o.o_custkey % 10 >= 8 THEN 0
       WHEN o.o_orderstatus = 'F' AND o.o_totalprice < 150000 THEN 0 ELSE 1 END AS forest_t2,
  CASE WHEN o.o_custkey % 20 = 7 THEN NULL WHEN o.o_custkey % 10 >= 8 THEN 0
       WHEN o.o_orderstatus IN ('F','P') AND o.o_totalprice < 200000 THEN 0 ELSE 1 END AS forest_t3,
  c.c_nationkey + 1 AS subj, CASE WHEN c.c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS pa,
  CAST(o.o_totalprice AS DOUBLE) AS elevation, CAST(floor(o.o_totalprice) AS INT) % 50 + 1 AS risk
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
l AS (SELECT *, CASE WHEN forest_t1 = 1 AND forest_t2 = 0 THEN 1 WHEN forest_t1 = 1 AND forest_t2 = 1 THEN 0 END AS loss,
  CASE WHEN coalesce(forest_t1, 0) = 1 AND coalesce(forest_t2, 0) = 0 AND coalesce(forest_t3, 0) = 0 THEN 1
       WHEN coalesce(forest_t1, 0) = 1 AND coalesce(forest_t2, 0) = 1 AND coalesce(forest_t3, 0) = 0 THEN 2
       WHEN coalesce(forest_t3, 0) = 1 THEN 3 ELSE 0 END AS fcc,
  CAST((row * 37 + col * 11) % 700 * 10 AS DOUBLE) AS edge FROM g)"""
COUNTS = """t AS (SELECT CAST({cat} AS BIGINT) AS cat, CAST(count(*) FILTER (WHERE {pop}) AS BIGINT) AS nfor,
  CAST(count(*) FILTER (WHERE {ev}) AS BIGINT) AS ndefor FROM {src} WHERE {cat} > 0 GROUP BY 1)"""
RATE_COLS = """SELECT cat, nfor, ndefor, 5e0 AS time_interval, round(rate_obs, 10) AS rate_obs, round(rate_mod, 10) AS rate_mod,
  round(rate_mod * k, 10) AS rate_abs, 0.09e0 AS pixel_area, round({dens} * 0.09e0 / 5e0, 10) AS defor_dens FROM u"""
PER_CAT = (
    "WITH " + G + ", " + COUNTS.format(cat="risk", pop="forest_t1 = 1 OR loss = 1", ev="loss = 1", src="l") + """,
s AS (SELECT *, CASE WHEN nfor > 0 THEN 1e0 - pow(1e0 - CAST(ndefor AS DOUBLE) / nfor, 1e0 / 5e0) END AS rate_obs,
  CASE WHEN cat = 1 THEN 0e0 ELSE ((cat - 2) * 999999e0 / 65533e0 + 1e0) * 1e-6 END AS rate_mod FROM t),
u AS (SELECT *, (SELECT sum(ndefor) / sum(nfor * rate_mod) FROM s) AS k FROM s)"""
)


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """The pixel stack with its loss layer, three-date stack and edge distance."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment")
    k, price, status = F.col("o_custkey"), F.col("o_totalprice"), F.col("o_orderstatus")
    later = lambda lost: F.when(k % 20 == 7, None).when(k % 10 >= 8, 0).when(lost, 0).otherwise(1)
    g = o.join(c, o.o_custkey == c.c_custkey).select(
        F.floor(F.col("o_orderkey") / WIDTH).cast("int").alias("row"),
        (F.col("o_orderkey") % WIDTH).cast("int").alias("col"),
        F.when(k % 20 == 0, None).when(k % 10 < 8, 1).otherwise(0).alias("forest_t1"),
        later((status == "F") & (price < 150000)).alias("forest_t2"),
        later(status.isin("F", "P") & (price < 200000)).alias("forest_t3"),
        (F.col("c_nationkey") + 1).alias("subj"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("pa"),
        price.cast("double").alias("elevation"),
        (F.floor(price).cast("int") % 50 + 1).alias("risk"),
    )
    t1, t2, t3 = (F.col(f"forest_t{i}") for i in (1, 2, 3))
    return g.select(
        "*",
        L.change(t1, t2, "loss").alias("loss"),
        L.three_dates(t1, t2, t3).alias("fcc"),
        (((F.col("row") * 37 + F.col("col") * 11) % 700) * 10).cast("double").alias("edge")
    )


def rounded(df: DataFrame, digits: int = 10) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in ("time_interval", "pixel_area") else F.col(c) for c, t in df.dtypes])


def grid(spark: SparkSession, d: str) -> GridSpec:
    """The stack's grid: 30 m pixels, the corner at (500000, 100000)."""
    n = spark.read.parquet(f"{d}/orders.parquet").agg(F.max("o_orderkey")).first()[0] // WIDTH + 1
    return GridSpec("EPSG:32631", 500_000.0, 100_000.0, 30.0, 30.0, n, WIDTH)


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """A layer catalog: one layer per supplier, named after its nation."""
    s, n = spark.read.parquet(f"{d}/supplier.parquet"), spark.read.parquet(f"{d}/nation.parquet")
    t = s.join(n, s.s_nationkey == n.n_nationkey)
    name, year = F.lower(F.regexp_replace("n_name", " ", "_")), (2000 + F.col("s_suppkey") % 25).cast("int")
    return t.select(
        F.col("s_suppkey").alias("id"), name.alias("name"), year.alias("year"),
        F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("raw"), F.lit("mask"))).when(F.col("s_suppkey") % 3 == 1, F.array(F.lit("raw"))).otherwise(F.array(F.lit("dist"))).alias("tags"),
        F.concat(F.lit("/data/"), name, F.lit("_"), year.cast("string"), F.lit(".tif")).alias("path"),
    )


K = """k AS (SELECT s_suppkey AS id, lower(replace(n_name, ' ', '_')) AS name, CAST(2000 + s_suppkey % 25 AS INT) AS year, s_suppkey % 3 AS m,
  '/data/' || lower(replace(n_name, ' ', '_')) || '_' || CAST(2000 + s_suppkey % 25 AS VARCHAR) || '.tif' AS path
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def trace(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(
        F.col("event_id").alias("iter"),
        F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("param"),
        F.col("value").cast("double").alias("value")
    )


E = "e AS (SELECT event_id AS iter, 'p' || CAST(user_id % 7 AS VARCHAR) AS param, CAST(value AS DOUBLE) AS value FROM events)"

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, source=pixels):
    """Register a function of the source table."""

    def add(f):
        Q[name] = lambda spark, d: f(source(spark, d))
        if sql:
            SQL[name] = sql
        return f

    return add


W = "WITH " + G + " "
PX = F.col


def box(x0, y0, x1, y1):
    """Rings of one rectangle, from columns."""
    return F.array(F.array(*[F.array(x.cast("double"), y.cast("double")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])).alias("rings")


def borders(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("r_regionkey") * 30
    return spark.read.parquet(f"{d}/region.parquet").select(
        F.col("r_regionkey").cast("long").alias("feature_id"),
        box(x + 2.3, F.lit(-7.7), x + 17.6, F.lit(-1.4))
    )


def parcels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c, s = spark.read.parquet(f"{d}/customer.parquet"), spark.read.parquet(f"{d}/supplier.parquet")
    x, y, w = PX("c_custkey") * 7 % 1000, PX("c_custkey") * 13 % 997, PX("c_nationkey") % 5 + 1.5
    u, v = PX("s_suppkey") * 31 % 1000 + 0.25, PX("s_suppkey") * 17 % 997 + 0.25
    return c.select(PX("c_custkey").cast("long").alias("feature_id"), box(x, y, x + w, y + w)), s.select(
        PX("s_suppkey").cast("long").alias("feature_id"),
        box(u, v, u + 20, v + 30)
    )
