"""Rasters as cell tables: (r, c, z), with an optional raster_id, nodata as NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellur.sources.durable import durable, sent_whole

#: Columns of the lattice that driver tables are laid on.
WIDTH = 100


def keys(cells: DataFrame) -> list[str]:
    return ["raster_id"] if "raster_id" in cells.columns else []


def nodata(z: Column, value: float | None = None) -> Column:
    """NULL for NaN and for values within 1e-5 of the declared nodata value."""
    z = F.when(F.isnan(z), None).otherwise(z)
    return z if value is None else F.when(F.abs(z - F.lit(float(value))) <= 1e-5, None).otherwise(z)


def band(cells: DataFrame, number: int = 1) -> DataFrame:
    """One band of a raster with a `band` column."""
    return cells.where(F.col("band") == number).drop("band")


def extents(meta: DataFrame) -> DataFrame:
    """Adds `cell_size` (mean side of a cell) and `x_min`, `y_min`, `x_max`, `y_max` to rasters (rows, cols, x0, y0, px_w, px_h); an empty CRS becomes NULL."""
    x, y = F.col("x0") + F.col("cols") * F.col("px_w"), F.col("y0") + F.col("rows") * F.col("px_h")
    out = meta.withColumns({"cell_size": (F.abs("px_w") + F.abs("px_h")) / 2, "x_min": F.least("x0", x), "y_min": F.least("y0", y), "x_max": F.greatest("x0", x), "y_max": F.greatest("y0", y)})
    return out.withColumn("crs", F.nullif(F.trim("crs"), F.lit(""))) if "crs" in meta.columns else out


def shifted(cells: DataFrame, down: int, right: int, fill: float | None = None) -> DataFrame:
    """The raster moved by whole cells within its place; what comes in is `fill`, what goes out is lost."""
    by = [*keys(cells), "r", "c"]
    moved = cells.select(*keys(cells), (F.col("r") + down).alias("r"), (F.col("c") + right).alias("c"), "z", F.lit(True).alias("_in"))
    out = cells.select(*by).join(moved, by, "left")
    return out.select(*by, F.when(F.col("_in"), F.col("z")).otherwise(F.lit(fill).cast("double")).alias("z"))


#: Bands of the satellite: what they show, the side of a cell in metres, the middle of the band in nanometres (fixed values).
SENTINEL = {
    "B2": ("Blue", 10, 490),
    "B3": ("Green", 10, 560),
    "B4": ("Red", 10, 665),
    "B5": ("Vegetation Red Edge", 20, 705),
    "B6": ("Vegetation Red Edge", 20, 740),
    "B7": ("Vegetation Red Edge", 20, 783),
    "B8": ("NIR", 10, 842),
    "B8A": ("Narrow NIR", 20, 865),
    "B11": ("SWIR 1", 20, 1610),
    "B12": ("SWIR 2", 20, 2190),
}


def described(table: DataFrame, column: str = "band") -> DataFrame:
    """Adds description, resolution and center_nm of a satellite band's name, NULL for others."""
    known = F.create_map(*(y for k, (text, side, nm) in SENTINEL.items() for y in (F.lit(k), F.struct(F.lit(text).alias("description"), F.lit(side).alias("resolution"), F.lit(nm).alias("center_nm")))))
    return table.withColumn("_b", F.element_at(known, F.col(column))).select(*table.columns, "_b.description", "_b.resolution", "_b.center_nm")


def lattice(table: DataFrame, number: str, value: Column, width: int = WIDTH) -> DataFrame:
    """Rows with dense numbers 0, 1, ... as a raster of the given width."""
    at = F.col(number)
    return table.select(F.floor(at / width).cast("int").alias("r"), (at % width).cast("int").alias("c"), value.cast("double").alias("z"))


def densify(cells: DataFrame, fill: Column | None = None) -> DataFrame:
    """Every (r, c) of the bounding box, missing ones with z NULL (or `fill`)."""
    by = keys(cells)
    box = cells.groupBy(*by).agg(*(f(x).alias(f"{f.__name__}_{x}") for x in "rc" for f in (F.min, F.max)))
    full = box.select(*by, F.explode(F.sequence("min_r", "max_r")).alias("r"), "min_c", "max_c").select(*by, "r", F.explode(F.sequence("min_c", "max_c")).alias("c"))
    out = full.join(cells, [*by, "r", "c"], "left")
    return out if fill is None else out.withColumn("z", F.coalesce("z", fill))


def whole(cells: DataFrame, value: str = "z") -> DataFrame:
    """Every cell of each raster's box, missing ones NULL, with the raster's mean as `_mean`.

    One job tells whether any raster lacks cells; only then boxes are filled up. Means are sent to their rasters' cells,
    so no raster meets in one task.
    """
    by = keys(cells)
    said = cells.groupBy(*by).agg(F.avg(value).alias("_mean"), F.count("*").alias("n"), ((F.max("r") - F.min("r") + 1).cast("bigint") * (F.max("c") - F.min("c") + 1)).alias("box"))
    if not by:
        one = said.first()
        return (densify(cells) if one.n and one.n < one.box else cells).withColumn("_mean", F.lit(one["_mean"]).cast("double"))
    said = durable(said)
    if said.where("n < box").limit(1).count():
        cells = densify(cells)
    return cells.join(sent_whole(said.select(*by, "_mean")), by)


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", F.col("value"))


def dem_nd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same raster with every cell of event_id % 97 = 13 as nodata."""
    return lattice(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", F.when(F.col("event_id") % 97 != 13, F.col("value")))


def dems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raster_id, r, c, z): raster 1 is `dem_nd`; raster 2 the same values fifty times as high, on a lattice of 40 columns with other nodata."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    tall = lattice(events, "event_id", F.when(F.col("event_id") % 89 != 7, F.col("value") * 50 + 1000), 40)
    return dem_nd(spark, sf_dir).select(F.lit(1).alias("raster_id"), "*").unionByName(tall.select(F.lit(2).alias("raster_id"), "*"))


def dem_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second epoch: heights moved by the JSON property k."""
    k = F.get_json_object("props", "$.k").cast("double")
    return lattice(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", F.col("value") + (k - 50) / 50.0)


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, c, b1, b2, b3): three bands on the same lattice, and the names that satellites give to such bands."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    at = F.col("o_orderkey")
    return o.select(
        F.floor(at / WIDTH).cast("int").alias("r"), (at % WIDTH).cast("int").alias("c"), F.col("o_totalprice").alias("b1"), F.dayofmonth("o_orderdate").cast("double").alias("b2"), F.length("o_orderpriority").cast("double").alias("b3")
    )


#: The raster with nodata, and the one that stands beside it in `dems`, for DuckDB.
SQL_ND = "dem_nd AS (SELECT (event_id // 100)::INT AS r, (event_id % 100)::INT AS c, CASE WHEN event_id % 97 <> 13 THEN value END AS z FROM events)"
SQL_TALL = "dem_nd AS (SELECT (event_id // 40)::INT AS r, (event_id % 40)::INT AS c, CASE WHEN event_id % 89 <> 7 THEN value * 50 + 1000 END AS z FROM events)"
#: The same views for DuckDB.
SQL = f"""
dem AS (SELECT (event_id // 100)::INT AS r, (event_id % 100)::INT AS c, value AS z FROM events),
{SQL_ND},
dem_new AS (SELECT (event_id // 100)::INT AS r, (event_id % 100)::INT AS c, value + ((props->>'$.k')::DOUBLE - 50) / 50.0::DOUBLE AS z FROM events),
bands AS (SELECT (o_orderkey // 100)::INT AS r, (o_orderkey % 100)::INT AS c, o_totalprice AS b1, day(o_orderdate)::DOUBLE AS b2, length(o_orderpriority)::DOUBLE AS b3 FROM orders)"""
