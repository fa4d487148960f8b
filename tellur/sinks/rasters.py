"""Rasters as Parquet by rows of tiles, so that a window reads the tiles it needs; nothing written is overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellur.functions.recipes import slug
from tellur.operators.field import template
from tellur.sinks.geopackage import write_geopackage
from tellur.sources.cells import keys


def write_raster(cells: DataFrame, path: str, tile: int = 256) -> None:
    """Writes ([raster_id,] r, c, values...) under a new path, a folder for each row of tiles, cells of a tile together.

    Spark commits the whole or nothing, so a stopped job leaves no partial raster. Fails if the path is there.
    """
    at = {f"tile_{x}": F.floor(F.col(x) / tile).cast("int") for x in "rc"}
    parts = cells.withColumns(at).repartition(*keys(cells), "tile_r", "tile_c").sortWithinPartitions("tile_r", *keys(cells), "tile_c", "r", "c")
    parts.write.partitionBy("tile_r").mode("errorifexists").parquet(path)


def read_raster(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, tile: int = 256) -> DataFrame:
    """The cells of a written raster, or those of a window (first and last row, first and last column) from its tiles alone."""
    cells = spark.read.parquet(path)
    if window:
        r0, r1, c0, c1 = window
        cells = cells.where(F.col("tile_r").between(r0 // tile, r1 // tile) & F.col("tile_c").between(c0 // tile, c1 // tile) & F.col("r").between(r0, r1) & F.col("c").between(c0, c1))
    return cells.drop("tile_r", "tile_c")


def write_colours(cells: DataFrame, path: str, tile: int = 256) -> None:
    """Writes red, green and blue as bytes' worth of integers; other values fail the job."""
    names = ("red", "green", "blue")
    if missing := [n for n in names if n not in cells.columns]:
        raise ValueError(f"no {', '.join(missing)}")
    byte = lambda n: F.when(F.col(n).between(0, 255), F.col(n).cast("smallint")).otherwise(F.raise_error(F.lit(f"{n} isn't 0..255")).cast("smallint"))
    write_raster(cells.select(*keys(cells), "r", "c", *(byte(n).alias(n) for n in names)), path, tile)


def write_change(change: DataFrame, path: str, tile: int = 256) -> None:
    """Writes the difference (nodata NULL) and the mask (nodata 255) of `difference` as two rasters, path/difference and path/mask."""
    by = [*keys(change), "r", "c"]
    write_raster(change.select(*by, F.col("dod").cast("float").alias("z")), f"{path}/difference", tile)
    write_raster(change.select(*by, F.coalesce(F.col("mask"), F.lit(255)).cast("smallint").alias("z")), f"{path}/mask", tile)


def write_package(anomalies: DataFrame, layers: DataFrame, folder: str, project: str, crs: str | None = None) -> str:
    """Writes a field package, and gives its path: anomalies (as Parquet, and as GeoPackages in survey/), layers (name, crs, ...) and a project row, in a new folder named after the project.

    Without a CRS that of the layers is taken; raises if they have none or several. Fails if the folder is there.
    """
    spark = anomalies.sparkSession
    name = spark.createDataFrame([(project,)], "n string").select(slug(F.col("n"))).first()[0]
    if not crs:
        found = [r[0] for r in layers.where("trim(crs) <> ''").select("crs").distinct().limit(2).collect()]
        if len(found) != 1:
            raise ValueError("the layers have no CRS or several; give one")
        crs = found[0]
    path = f"{folder.rstrip('/')}/{name}"
    empty = template(spark)
    missing = {c: F.lit(None).cast(t) for c, t in empty.dtypes if c not in anomalies.columns}
    anomalies.withColumns(missing).select(*empty.columns, "x", "y").write.mode("errorifexists").parquet(f"{path}/anomalies")
    write_geopackage(anomalies.withColumns(missing).select(*empty.columns, "x", "y"), f"{path}/survey", "anomalies", crs)
    layers.write.mode("errorifexists").parquet(f"{path}/layers")
    spark.createDataFrame([(project, name, crs)], "project string, folder string, crs string").write.mode("errorifexists").parquet(f"{path}/project")
    return path
