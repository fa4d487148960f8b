"""3x3 operators within tiles that have one cell more on each side. Edges repeat the border cell."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellur.operators.tiles import Block, over_tiles
from tellur.sources.cells import keys


def surroundings(block: Block, fill: bool = True) -> dict[tuple[int, int], np.ndarray]:
    """The tile's heights moved by one cell each way, by (rows down, columns right). With `fill`, nodata counts as the raster's mean, otherwise it stays NaN."""
    z = np.nan_to_num(block.repeated(), nan=block.mean) if fill else block.repeated()
    return {(dr, dc): block.cut(z, dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)}


def gradient(block: Block, cell: float, method: str = "horn") -> tuple[np.ndarray, np.ndarray]:
    """(dz/dx, dz/dy) by Horn's 1-2-1 weights or by central differences; dz/dy is south minus north."""
    at = surroundings(block)
    if method == "finite_difference":
        return (at[0, 1] - at[0, -1]) / (2 * cell), (at[1, 0] - at[-1, 0]) / (2 * cell)
    side = lambda dr, dc: sum((2 if k == 0 else 1) * at[(dr, k) if dr else (k, dc)] for k in (-1, 0, 1))
    return (side(0, 1) - side(0, -1)) / (8 * cell), (side(1, 0) - side(-1, 0)) / (8 * cell)


def shade(steps: tuple[np.ndarray, np.ndarray], azimuth: float, altitude: float) -> np.ndarray:
    """Illumination in 0..1. The aspect points uphill, as the compatible variant has it."""
    dx, dy = steps
    zenith, az = math.radians(90 - altitude), math.radians((360 - azimuth % 360 + 90) % 360)
    steep = np.arctan(np.hypot(dx, dy))
    return np.clip(np.cos(steep) * math.cos(zenith) + np.sin(steep) * math.sin(zenith) * np.cos(az - np.arctan2(-dy, dx)), 0, 1)


def slope(cells: DataFrame, units: str = "degrees", method: str = "horn", cell: float = 1.0) -> DataFrame:
    """(r, c, slope) in degrees or percent, from Horn's or central differences."""
    if units not in ("degrees", "percent") or method not in ("horn", "finite_difference") or not cell > 0:
        raise ValueError(f"no such slope: {units}, {method}, cell {cell}")

    def kernel(b: Block) -> dict[str, np.ndarray]:
        steep = np.hypot(*gradient(b, cell, method))
        return {"slope": np.degrees(np.arctan(steep)) if units == "degrees" else steep * 100}

    return over_tiles(cells, 1, kernel, ["slope"])


def hillshade(cells: DataFrame, azimuths: tuple[float, ...] = (315, 45, 135, 225, 270, 0), altitude: float = 45, cell: float = 1.0) -> DataFrame:
    """(r, c, hillshade): the mean over azimuths, 0..255."""
    if not azimuths or not 0 <= altitude <= 90:
        raise ValueError("azimuths and an altitude of 0 to 90 are needed")

    def kernel(b: Block) -> dict[str, np.ndarray]:
        steps = gradient(b, cell)
        return {"hillshade": sum(shade(steps, a, altitude) for a in azimuths) / len(azimuths) * 255}

    return over_tiles(cells, 1, kernel, ["hillshade"])


def hillshade_bands(cells: DataFrame, n: int = 16, altitude: float = 35, cell: float = 1.0) -> DataFrame:
    """(r, c, bands): one illumination in 0..1 for each of n evenly spread azimuths."""
    if not 4 <= n <= 64:
        raise ValueError("4 to 64 directions")
    names = [f"b{i}" for i in range(n)]

    def kernel(b: Block) -> dict[str, np.ndarray]:
        steps = gradient(b, cell)
        return {name: shade(steps, 360 * i / n, altitude) for i, name in enumerate(names)}

    out = over_tiles(cells, 1, kernel, names)
    return out.select(*keys(cells), "r", "c", F.when(F.col("b0").isNotNull(), F.array(*names)).alias("bands"))


def ruggedness(cells: DataFrame) -> DataFrame:
    """(r, c, tri): the root of the summed squared differences to the eight neighbours; nodata neighbours add nothing."""

    def kernel(b: Block) -> dict[str, np.ndarray]:
        at = surroundings(b, fill=False)
        return {"tri": np.sqrt(sum(np.nan_to_num((x - at[0, 0]) ** 2) for k, x in at.items() if k != (0, 0)))}

    return over_tiles(cells, 1, kernel, ["tri"])
