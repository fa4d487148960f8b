"""Places of one CRS in another as Column expressions: longitudes and latitudes, transverse Mercator zones, web Mercator.

Transverse Mercator follows Krueger's series in the third flattening to its fourth order: about a micrometre within a zone.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ellipsoid of WGS 84 and the scale, false easting and southern false northing of its zones (fixed values).
RADIUS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, EAST, SOUTH = 0.9996, 500_000.0, 10_000_000.0

_N = FLATTENING / (2 - FLATTENING)
_MERIDIAN = RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64) * SCALE
_ECCENTRICITY = 2 * math.sqrt(_N) / (1 + _N)


def _series(*rows: tuple[float, ...]) -> list[float]:
    """Coefficients: row j holds the factors of n^j, n^(j+1), ... up to n^4."""
    return [sum(c * _N ** (j + i) for i, c in enumerate(row)) for j, row in enumerate(rows, 1)]


#: Krueger's coefficients (fixed values): to the plane, back from it, and from conformal to geodetic latitude.
TO_PLANE = _series((1 / 2, -2 / 3, 5 / 16, 41 / 180), (13 / 48, -3 / 5, 557 / 1440), (61 / 240, -103 / 140), (49561 / 161280,))
FROM_PLANE = _series((1 / 2, -2 / 3, 37 / 96, -1 / 360), (1 / 48, 1 / 15, -437 / 1440), (17 / 480, -37 / 840), (4397 / 161280,))
TO_GEODETIC = _series((2, -2 / 3, -2, 116 / 45), (7 / 3, -8 / 5, -227 / 45), (56 / 15, -136 / 35), (4279 / 630,))


def zone(crs: str) -> tuple[float, float] | None:
    """(central longitude, false northing) of EPSG:32601 to 32660 and 32701 to 32760, None for other codes."""
    m = re.fullmatch(r"EPSG:32([67])(\d\d)", crs)
    return (math.radians(int(m[2]) * 6 - 183), SOUTH if m[1] == "7" else 0.0) if m and 1 <= int(m[2]) <= 60 else None


def to_degrees(places: DataFrame, crs: str, x: str = "x", y: str = "y", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds longitude and latitude in degrees of places in EPSG:4326, EPSG:3857 or a zone.

    Each step is a column of its own: Catalyst keeps such steps apart, where one nested expression would hold the series
    many times over.
    """
    if crs == "EPSG:4326":
        return places.withColumns({lon: F.col(x), lat: F.col(y)})
    if crs == "EPSG:3857":
        return places.withColumns({lon: F.degrees(F.col(x) / RADIUS), lat: F.degrees(2 * F.atan(F.exp(F.col(y) / RADIUS)) - math.pi / 2)})
    if not (own := zone(crs)):
        raise ValueError(f"places of {crs} can't be turned; there are EPSG:4326, EPSG:3857, EPSG:326zz and EPSG:327zz")
    out = places.withColumns({"_up": (F.col(y) - own[1]) / _MERIDIAN, "_out": (F.col(x) - EAST) / _MERIDIAN})
    out = out.withColumns(_moved("_up", "_out", [-b for b in FROM_PLANE]))
    out = out.withColumn("_chi", F.asin(F.sin("_xi") / F.cosh("_eta")))
    phi = sum((d * F.sin(2 * j * F.col("_chi")) for j, d in enumerate(TO_GEODETIC, 1)), F.col("_chi"))
    return out.withColumns({lon: F.degrees(own[0] + F.atan2(F.sinh("_eta"), F.cos("_xi"))), lat: F.degrees(phi)}).drop("_up", "_out", "_xi", "_eta", "_chi")


def _moved(up: str, out: str, series: list[float]) -> dict[str, Column]:
    u, o = F.col(up), F.col(out)
    xi = sum((a * F.sin(2 * j * u) * F.cosh(2 * j * o) for j, a in enumerate(series, 1)), u)
    return {"_xi": xi, "_eta": sum((a * F.cos(2 * j * u) * F.sinh(2 * j * o) for j, a in enumerate(series, 1)), o)}


def from_degrees(places: DataFrame, crs: str, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y") -> DataFrame:
    """Adds the place in EPSG:4326, EPSG:3857 or a zone of longitudes and latitudes in degrees, by steps as `to_degrees`."""
    if crs == "EPSG:4326":
        return places.withColumns({x: F.col(lon), y: F.col(lat)})
    if crs == "EPSG:3857":
        return places.withColumns({x: F.radians(lon) * RADIUS, y: F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * RADIUS})
    if not (own := zone(crs)):
        raise ValueError(f"places can't be turned to {crs}; there are EPSG:4326, EPSG:3857, EPSG:326zz and EPSG:327zz")
    out = places.withColumns({"_s": F.sin(F.radians(lat)), "_d": F.radians(lon) - own[0]})
    out = out.withColumn("_t", F.sinh(F.atanh("_s") - _ECCENTRICITY * F.atanh(_ECCENTRICITY * F.col("_s"))))
    out = out.withColumns({"_up": F.atan2(F.col("_t"), F.cos("_d")), "_out": F.atanh(F.sin("_d") / F.sqrt(1 + F.col("_t") * F.col("_t")))})
    out = out.withColumns(_moved("_up", "_out", TO_PLANE))
    return out.withColumns({x: EAST + _MERIDIAN * F.col("_eta"), y: own[1] + _MERIDIAN * F.col("_xi")}).drop("_s", "_d", "_t", "_up", "_out", "_xi", "_eta")


def turned(places: DataFrame, source: str, target: str, x: str = "x", y: str = "y") -> DataFrame:
    """Places (columns x and y) of one CRS in another, all on one datum; other columns stay."""
    if source == target:
        return places
    return from_degrees(to_degrees(places, source, x, y, "_lon", "_lat").drop(x, y), target, "_lon", "_lat", x, y).drop("_lon", "_lat")
