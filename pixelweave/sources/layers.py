"""Reading and writing layers and tables with fixed schemas."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.sources.versions import newest, write_version

# The tables that are exchanged as CSV, with their columns in order. Training tables have their own columns.
TABLES = {
    "rates": "cat long, nfor long, ndefor long, time_interval double, rate_obs double, rate_mod double, rate_abs double, pixel_area double, defor_dens double",
    "forecast_rates": "cat long, nfor long, rate_mod double, pixel_area double, rate_abs double, defor_dens double",
    "distances": "distance double, npix long, area double, cum double, perc double",
    "points": "cell long, nfor_obs_ha double, ndefor_obs_ha double, ndefor_pred_ha double",
    "indices": "prediction string, model string, period string, truth string, csize_coarse_grid int, csize_coarse_grid_ha double, ncell long, MedAE double, R2 double, RMSE double, wRMSE double",
    "allocation": "period string, `length (yr)` int, `deforestation (ha)` double",
}
SAMPLE = "draw long, strata int, row int, col int, x double, y double"
GEOJSON = "type string, features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def read_layer(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    return spark.read.schema(f"row int, col int, value {kind}").parquet(newest(spark, path))


def replaced(spark: SparkSession, path: str, write) -> None:
    """Run ``write(part)`` on a new folder and put it in the place of ``path`` only when it has succeeded."""
    part, old = f"{path}.part-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    write(part)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(at(path))
    if had:
        fs.rename(at(path), at(old))
    if not fs.rename(at(part), at(path)):
        if had:
            fs.rename(at(old), at(path))
        raise OSError(f"could not put {part} in the place of {path}")
    if had:
        fs.delete(at(old), True)


def write_layer(df: DataFrame, path: str, tile: int = 1024) -> None:
    """Sorted by tile, so that row ranges prune row groups; all or nothing: a write that fails at any point, renames included,
    leaves the layer that was there, as a version of its own that ``read_layer`` finds."""
    tiles = [F.floor(F.col("row") / tile).alias("_tr"), F.floor(F.col("col") / tile).alias("_tc")]
    out = df.select("*", *tiles).repartitionByRange("_tr", "_tc").sortWithinPartitions("_tr", "_tc", "row", "col").drop("_tr", "_tc")
    write_version(df.sparkSession, path, lambda folder: out.write.parquet(folder))


def export_layers(px: DataFrame, names: list[str], folder: str, prefix: str = "", suffix: str = "") -> list[str]:
    """Each named column of ``px`` as a layer of its own; returns the paths, in order."""
    paths = [f"{folder}/{prefix}{n}{suffix}" for n in names]
    for n, path in zip(names, paths, strict=True):
        write_layer(px.select("row", "col", F.col(n).alias("value")), path)
    return paths


def read_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A table of ``TABLES``, or of a schema given as text."""
    return spark.read.schema(TABLES.get(kind, kind)).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str, kind: str | None = None) -> None:
    """``df`` with a header; with a kind of ``TABLES``, its columns in that order and of those types (an allocation has its
    hectares to one digit). A job that fails leaves the table that was there."""
    spark = df.sparkSession
    if kind == "allocation":
        df = df.select("period", F.col("length").alias("length (yr)"), F.bround("deforestation", 1).alias("deforestation (ha)"))
    if kind:
        fields = spark.createDataFrame([], TABLES[kind]).schema
        df = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields])
    replaced(spark, path, lambda part: df.write.option("header", True).csv(part))


def write_points(points: DataFrame, path: str) -> None:
    """Sample points, in a form that ``read_points`` reads back with its draw order."""
    out = points.select("draw", "strata", "row", "col", "x", "y")
    replaced(points.sparkSession, path, lambda part: out.write.parquet(part))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLE).parquet(path)


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON polygons and multipolygons: (feature_id, rings array<array<array<double>>>, props)."""
    t = spark.read.schema(GEOJSON).option("multiLine", True).json(path).select(F.posexplode("features").alias("feature_id", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    one = F.from_json(text, "array<array<array<double>>>")
    many = F.flatten(F.from_json(text, "array<array<array<array<double>>>>"))
    rings = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)
    return t.select((F.col("feature_id") + 1).cast("long").alias("feature_id"), rings.alias("rings"), F.col("f.properties").alias("props"))


def rasterize(polygons: DataFrame, n_rows: int, x0: float, y0: float, res: float, n_cols: int, unique: bool = False) -> DataFrame:
    """Pixels whose centre lies in a polygon (even-odd over its rings): edges meet row centres, crossings pair to spans.

    The value is 1, or with ``unique`` the feature_id, the larger one where polygons overlap; more than 255 features, which
    such a layer cannot number, raise ValueError.
    """
    if unique and polygons.limit(256).count() > 255:
        raise ValueError("unique ids need at most 255 features")
    edge = polygons.select("feature_id", F.explode("rings").alias("ring")).select(
        "feature_id", F.explode(F.arrays_zip(F.slice("ring", 1, F.size("ring") - 1).alias("a"), F.slice("ring", 2, F.size("ring") - 1).alias("b"))).alias("e")
    )
    ax, ay, bx, by = F.col("e.a")[0], F.col("e.a")[1], F.col("e.b")[0], F.col("e.b")[1]
    edge = edge.select("feature_id", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    # Rows whose centre lies in [min y, max y): centres at y0 - (row + .5) res.
    first = F.greatest(F.floor((y0 - F.greatest("ay", "by")) / res - 0.5) + 1, F.lit(0))
    last = F.least(F.floor((y0 - F.least("ay", "by")) / res - 0.5), F.lit(n_rows - 1))
    rows = edge.withColumn("r0", first).withColumn("r1", last).filter("r1 >= r0").withColumn("row", F.explode(F.sequence("r0", "r1")))
    y = y0 - (F.col("row") + 0.5) * res
    crossing = F.col("ax") + (y - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    spans = rows.select("feature_id", "row", crossing.alias("x")).groupBy("feature_id", "row").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    spans = spans.select("feature_id", "row", F.col("xs"), F.explode(F.sequence(F.lit(1), F.size("xs"), F.lit(2))).alias("i"))
    c0 = F.greatest(F.ceil((F.col("xs")[F.col("i") - 1] - x0) / res - 0.5), F.lit(0))
    c1 = F.least(F.ceil((F.col("xs")[F.col("i")] - x0) / res - 0.5) - 1, F.lit(n_cols - 1))
    px = spans.select("feature_id", F.col("row").cast("int").alias("row"), c0.alias("c0"), c1.alias("c1")).filter("c1 >= c0")
    px = px.select("feature_id", "row", F.explode(F.sequence(F.col("c0").cast("int"), F.col("c1").cast("int"))).alias("col"))
    value = F.max("feature_id").cast("int") if unique else F.lit(1)
    return px.groupBy("row", "col").agg(value.alias("value"))
