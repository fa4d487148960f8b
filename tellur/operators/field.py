"""What goes out to the field and to viewers: anomaly records, footprints, viewer settings, checks of cloud rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellur.operators.ranges import attached
from tellur.sources.cells import keys

#: Fields of an anomaly record and what a missing one is taken as (fixed values; None: a name by its number, the present time).
FIELDS = {"anomaly_id": None, "detection_method": "manual", "confidence": 0.5, "feature_type": "unknown", "field_status": "pending", "observer": "", "photo_path": "", "notes": "", "timestamp": None}


def numbered(df: DataFrame, key: str, name: str = "number", width: int = 65_536) -> DataFrame:
    """Adds dense numbers from 1 in the order of an integer key.

    Ranks are taken within ranges of `width` keys, and each range begins where those before it end; only the counts of
    ranges, a row for each `width` keys, meet in one task. Equal keys are numbered in any order.
    """
    at = F.floor(F.col(key) / width)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(at.alias("_range")).agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = df.withColumn("_range", at).withColumn("_rank", F.row_number().over(Window.partitionBy("_range").orderBy(key)))
    return ranked.join(counts, "_range").withColumn(name, F.col("_before") + F.col("_rank")).drop("_range", "_rank", "_before")


def anomalies(features: DataFrame, key: str) -> DataFrame:
    """Point records of features with x and y: missing names become ANOM-0001 and so on by `key`, other fields of FIELDS get their defaults, whether missing in a row or altogether.

    A missing time is that of the query, as ISO 8601 text.
    """
    kinds = {"confidence": "double"}
    absent = {k: F.lit(None).cast(kinds.get(k, "string")) for k in FIELDS if k not in features.columns}
    out = numbered(features.withColumns(absent).where("x IS NOT NULL AND y IS NOT NULL"), key, "_number")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    out = out.withColumns({"anomaly_id": F.coalesce("anomaly_id", F.format_string("ANOM-%04d", "_number")), "timestamp": F.coalesce(F.col("timestamp").cast("string"), now)})
    return out.drop("_number").fillna({k: v for k, v in FIELDS.items() if v is not None})


def template(spark: SparkSession) -> DataFrame:
    """An empty table of anomaly records, to be filled in the field."""
    return spark.createDataFrame([], ", ".join(f"{k} {'double' if k == 'confidence' else 'string'}" for k in FIELDS))


def escaped(text: Column) -> Column:
    """Text as HTML shows it."""
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def pages(settings: DataFrame) -> DataFrame:
    """Adds `config` (JSON) and `html` of a viewer to rows with title, lon, lat, zoom and opacity."""
    config = F.to_json(F.struct("title", F.array("lon", "lat").alias("center"), "zoom", "opacity"))
    html = F.concat(F.lit("<!DOCTYPE html><html><head><meta charset='utf-8'><title>"), escaped(F.col("title")), F.lit("</title></head><body><div id='map'></div><script src='viewer.js' data-config='config.json'></script></body></html>"))
    return settings.withColumns({"config": config, "html": html})


def footprints(detections: DataFrame) -> DataFrame:
    """Adds the closed outline of each box as WKT and the box as text with two decimals; empty and malformed boxes go."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    real = detections.where((x2 > x1) & (y2 > y1))
    ring = F.format_string("POLYGON ((%.2f %.2f, %.2f %.2f, %.2f %.2f, %.2f %.2f, %.2f %.2f))", x1, y1, x2, y1, x2, y2, x1, y2, x1, y1)
    return real.withColumns({"wkt": ring, "bbox": F.format_string("%.2f,%.2f,%.2f,%.2f", x1, y1, x2, y2)})


def finite(x: Column, otherwise: float = 0.0) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), float(otherwise)).otherwise(x)


def viewer(rasters: DataFrame, min_zoom: int = 1) -> DataFrame:
    """(raster_id, lon, lat, zoom, opacity) of rasters (raster_id, x0, y0, x1, y1, opacity): the middle of each, and a zoom for its width.

    The zoom is at most 16, falls by one for each 5,000 units of width down to `min_zoom`, and is 8 where the width isn't
    finite. Opacity is cut to 0..1, 1 if missing.
    """
    wide = F.col("x1") - F.col("x0")
    known = wide.isNotNull() & ~F.isnan(wide) & (F.abs(wide) != float("inf"))
    zoom = F.when(known, F.greatest(F.lit(min_zoom), F.least(F.lit(16), (14 - wide / 5000).cast("int")))).otherwise(8)
    return rasters.select(
        "raster_id", finite((F.col("x0") + F.col("x1")) / 2).alias("lon"), finite((F.col("y0") + F.col("y1")) / 2).alias("lat"), zoom.cast("int").alias("zoom"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), finite(F.col("opacity"), 1.0))).alias("opacity")
    )


def cloud_check(meta: DataFrame) -> DataFrame:
    """Adds `level`, the overviews that a raster (rows, cols, block, overviews) needs, and `valid`.

    A valid one is in blocks of 64 cells or more and, beyond 1,024 cells a side, has overviews.
    """
    side = F.greatest("rows", "cols")
    bits = F.length(F.bin(F.floor(side / 256).cast("bigint")))
    level = F.when(side > 512, F.greatest(F.lit(1), bits - 1)).otherwise(0)
    valid = (F.coalesce(F.col("block"), F.lit(0)) >= 64) & ((side <= 1024) | (F.coalesce(F.col("overviews"), F.lit(0)) > 0))
    return meta.withColumns({"level": level.cast("int"), "valid": valid})


def detector_tiles(cells: DataFrame, rows: int | None = None, cols: int | None = None, tile: int = 640, overlap: int = 32) -> DataFrame:
    """([raster_id,] tr, tc, r, c, x): the cells of every overlapping tile, each tile stretched to 0..1 over its own range; nodata is 0.

    Tile k begins at k times (tile - overlap); there are as many as cover `rows` and `cols`, or each raster's own where none
    are given, one at least. A cell is sent to the
    few tiles that hold it, and the range of a tile is combined before its shuffle.
    """
    step, by = tile - overlap, keys(cells)
    own = cells.groupBy(*by).agg(*(F.coalesce(F.lit(n).cast("int"), F.max(x) + 1).alias(f"_{x}s") for x, n in (("r", rows), ("c", cols))))

    def tiles(axis: str) -> Column:
        n = F.greatest(F.lit(1), F.ceil((F.col(f"_{axis}s") - overlap) / step).cast("int"))
        first = F.greatest(F.lit(0), F.floor((F.col(axis) - tile) / step).cast("int") + 1)
        return F.explode(F.sequence(first, F.least(n - 1, F.floor(F.col(axis) / step).cast("int"))))

    sent = attached(cells, own).withColumn("tr", tiles("r")).withColumn("tc", tiles("c")).select(*by, "r", "c", "z", "tr", "tc")
    span = sent.groupBy(*by, "tr", "tc").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    x = F.when(F.col("hi") - F.col("lo") > 1e-6, (F.col("z") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return sent.join(span, [*by, "tr", "tc"]).select(*by, "tr", "tc", "r", "c", F.coalesce(x, F.lit(0.0)).alias("x"))
