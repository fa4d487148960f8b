"""Operators over square windows, by prefix sums within tiles: a task holds a tile and its halo, never a whole row or column.

Prefix sums are of heights less the raster's mean and begin anew in each tile, so their rounding doesn't grow with the
raster. A tile is as wide as four radii, 256 cells at least and 1,024 at most, so a cell is sent four times at most up to
a radius of WIDE, and a block has 32 MB. Beyond, sums are taken along rows in strips of STRIP rows, as long as two radii
and the halo, and of those along columns alike: a strip has STRIP x 4 radii cells, and a cell is sent twice for each axis.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellur.operators.ranges import attached
from tellur.operators.tiles import Block, over_tiles
from tellur.sources.cells import keys, whole

#: The greatest radius whose windows are summed within square blocks, and the width of strips for greater ones.
WIDE, STRIP = 512, 64


def side(radius: int) -> int:
    return max(256, min(1_024, 4 * radius))


def mean_of(block: Block, radius: int) -> np.ndarray:
    """The mean of the square around each cell, mirrored at the border, nodata as the raster's mean."""
    z = np.nan_to_num(block.mirrored() - block.mean)
    return block.mean + block.box_sums(z, radius) / (2 * radius + 1) ** 2


def line_sums(cells: DataFrame, radius: int, mirror: bool) -> DataFrame:
    """(r, c, z): of a raster without nodata the sums of z over squares, mirrored at the border or cut there, axis by axis."""

    def kernel(b: Block, axis: int) -> dict[str, np.ndarray]:
        z = b.mirrored() if mirror else np.nan_to_num(b.z)
        z = z if axis else z.T
        s = np.concatenate([np.zeros((len(z), 1)), np.cumsum(z, axis=1)], axis=1)
        n = z.shape[1] - 2 * radius
        out = s[:, 2 * radius + 1 : 2 * radius + 1 + n] - s[:, :n]
        return {"z": out if axis else out.T}

    along = over_tiles(cells, (0, radius), lambda b: kernel(b, 1), ["z"], (STRIP, max(256, 2 * radius)))
    return over_tiles(along, (radius, 0), lambda b: kernel(b, 0), ["z"], (max(256, 2 * radius), STRIP))


def _centred(cells: DataFrame) -> DataFrame:
    """(r, c, z, _mean, _x): every cell of each raster's box, and its height less the mean, 0 for nodata."""
    return whole(cells).withColumn("_x", F.coalesce(F.col("z") - F.col("_mean"), F.lit(0.0)))


def box_mean(cells: DataFrame, radius: int) -> DataFrame:
    """(r, c, z, mean): the mean over (2 radius + 1)^2 cells, reflected at the border, nodata and missing cells as the raster's mean; nodata has none."""
    if radius <= WIDE:
        return over_tiles(cells, radius, lambda b: {"z": b.cut(b.z), "mean": mean_of(b, radius)}, ["z", "mean"], side(radius))
    by, x = [*keys(cells), "r", "c"], _centred(cells)
    sums = line_sums(x.select(*by, F.col("_x").alias("z")), radius, True).withColumnRenamed("z", "_s")
    return x.join(sums, by).select(*by, "z", F.when(F.col("z").isNotNull(), F.col("_mean") + F.col("_s") / float((2 * radius + 1) ** 2)).alias("mean"))


def local_relief(cells: DataFrame, radius: int = 20) -> DataFrame:
    """(r, c, slrm): height over the mean of the surrounding square."""
    if radius <= WIDE:
        return over_tiles(cells, radius, lambda b: {"slrm": b.cut(b.z) - mean_of(b, radius)}, ["slrm"], side(radius))
    return box_mean(cells, radius).select(*keys(cells), "r", "c", (F.col("z") - F.col("mean")).alias("slrm"))


def deviation_of(block: Block, radius: int) -> np.ndarray:
    """(height - mean) / population deviation of the square within the raster; 0 where that is under 0.001. Nodata counts as the raster's mean."""
    z = np.nan_to_num(block.z - block.mean)  # nothing beyond the raster
    r0, r1, c0, c1 = block.box
    h, w = block.cut(z).shape
    count = [np.minimum(at + radius, last) - np.maximum(at - radius, first) + 1 for n, first, last in ((h, r0, r1), (w, c0, c1)) for at in (np.arange(n) + block.halo,)]
    n = np.outer(*count)
    mean = block.box_sums(z, radius) / n
    sd = np.sqrt(np.maximum(0, block.box_sums(z * z, radius) / n - mean * mean))
    return np.where(sd < 0.001, 0.0, (block.cut(z) - mean) / np.maximum(sd, 1e-300))


def deviations(cells: DataFrame, radii: tuple[int, ...]) -> DataFrame:
    """(r, c, z, dev_<radius>...): (height - mean) / population deviation of the clipped square; 0 where that is under 0.001.

    Nodata and missing cells count as the raster's mean, and have no deviations.
    """
    near, far = [q for q in radii if q <= WIDE], [q for q in radii if q > WIDE]
    most = max(near, default=0)
    names = ["z", *(f"dev_{q}" for q in near)]
    out = over_tiles(cells, most, lambda b: {"z": b.cut(b.z)} | {f"dev_{q}": deviation_of(b, q) for q in near}, names, side(most))
    by, x = [*keys(cells), "r", "c"], _centred(cells) if far else None
    for q in far:
        for k, v in (("_s", F.col("_x")), ("_q", F.col("_x") * F.col("_x"))):
            x = x.join(line_sums(x.select(*by, v.alias("z")), q, False).withColumnRenamed("z", f"{k}{q}"), by)
    if far:
        x = attached(x, x.groupBy(*keys(cells)).agg(*(f(n).alias(f"_{f.__name__}_{n}") for n in "rc" for f in (F.min, F.max))))
    for q in far:
        count = [F.least(F.col(n) + q, F.col(f"_max_{n}")) - F.greatest(F.col(n) - q, F.col(f"_min_{n}")) + 1 for n in "rc"]
        n = count[0].cast("double") * count[1]
        mean = F.col(f"_s{q}") / n
        sd = F.sqrt(F.greatest(F.lit(0.0), F.col(f"_q{q}") / n - mean * mean))
        x = x.withColumn(f"dev_{q}", F.when(F.col("z").isNotNull(), F.when(sd < 0.001, 0.0).otherwise((F.col("_x") - mean) / sd)))
    if far:
        out = out.join(x.select(*by, *(f"dev_{q}" for q in far)), by)
    return out.select(*by, "z", *(f"dev_{q}" for q in radii))


def byte(x, digits: int = 6):
    """Clipped to 0..255 and cut to an integer; rounded first, so that the last bits of a double don't decide."""
    return F.floor(F.round(F.least(F.lit(255.0), F.greatest(F.lit(0.0), x)), digits)).cast("int")


def topographic_position(cells: DataFrame, local: int = 5, meso: int = 50, broad: int = 500, lightness: float = 1.0) -> DataFrame:
    """(r, c, red, green, blue): broad, meso and local deviations as bytes around 127; nodata is 0."""

    def channel(q):
        return F.when(F.col("z").isNull(), 0).otherwise(byte(127 + F.col(f"dev_{q}") * (50 * lightness), 4))

    return deviations(cells, (local, meso, broad)).select(*keys(cells), "r", "c", channel(broad).alias("red"), channel(meso).alias("green"), channel(local).alias("blue"))
