"""Point clouds (x, y, z): gridding, ground filters, outliers."""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellur.operators.cloth import cloth_of
from tellur.operators.distance import inverse_distance
from tellur.operators.stages import CHANGES, low_noise
from tellur.operators.tiles import Block, over_tiles
from tellur.sources.cells import keys
from tellur.sources.durable import durable, sent_whole

#: Parameters of the progressive morphological filter by terrain (fixed values): largest window, slope, first and largest distance, cell.
GROUND = {"fine": (20, 0.15, 0.15, 0.5, 0.5), "standard": (33, 0.25, 0.3, 1.0, 1.0), "forested": (50, 0.5, 0.5, 2.0, 2.0)}


def binned(points: DataFrame, cell: float) -> DataFrame:
    return points.withColumns({"r": F.floor(F.col("y") / cell).cast("int"), "c": F.floor(F.col("x") / cell).cast("int")})


def lowest(points: DataFrame, cell: float = 1.0) -> DataFrame:
    """([raster_id,] r, c, z, n): the lowest point and the number of points in each cell of each cloud."""
    return binned(points, cell).groupBy(*keys(points), "r", "c").agg(F.min("z").alias("z"), F.count("*").alias("n"))


def nearby_distance(points: DataFrame, cell: float = 1.0, reach: int = 2, power: float = 2.0, smoothing: float = 1.0) -> DataFrame:
    """([raster_id,] r, c, z): weighed means at cell centres of all points within `reach` cells; a point is sent to the centres it reaches, sums combine first."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    b = binned(points, cell).withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps)).withColumns({"r": F.col("r") + F.col("dr"), "c": F.col("c") + F.col("dc")})
    dx, dy = F.col("x") - (F.col("c") + 0.5) * cell, F.col("y") - (F.col("r") + 0.5) * cell
    w = F.pow(dx * dx + dy * dy + smoothing * smoothing, F.lit(-power / 2))
    return b.withColumn("w", w).groupBy(*keys(points), "r", "c").agg((F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("z"))


def running(z: np.ndarray, radius: int, f: np.ufunc, empty: float) -> np.ndarray:
    """The least or greatest value (`f`) of the square around each cell, `empty` beyond the array.

    Along each axis the array is cut into blocks as wide as the square; the value of a span is that of the end of one
    block, running backward, and of the start of the next, running forward: two values a cell, whatever the radius.
    """
    wide = 2 * radius + 1
    for _ in range(2):
        n = z.shape[1]
        blocks = -(-(n + 2 * radius) // wide)
        p = np.full((z.shape[0], blocks * wide), empty)
        p[:, radius : radius + n] = z
        p = p.reshape(len(z), blocks, wide)
        forward = f.accumulate(p, axis=2).reshape(len(z), -1)
        backward = f.accumulate(p[:, :, ::-1], axis=2)[:, :, ::-1].reshape(len(z), -1)
        z = f(backward[:, :n], forward[:, wide - 1 : wide - 1 + n]).T
    return z


def opened(z: np.ndarray, radius: int) -> np.ndarray:
    """The greatest of the least values in squares of the given radius; missing cells (NaN) take no part and stay missing."""
    none = np.isnan(z)
    low = running(np.where(none, np.inf, z), radius, np.minimum, np.inf)
    return np.where(none, np.nan, running(np.where(none, -np.inf, low), radius, np.maximum, -np.inf))


def numbers(kind: str | tuple) -> tuple[float, float, float, float, float]:
    """The parameters of a terrain, or those given as they are."""
    if isinstance(kind, tuple):
        return kind
    if kind not in GROUND:
        raise ValueError(f"no such terrain: {kind}")
    return GROUND[kind]


def steps(kind: str | tuple) -> list[tuple[int, float]]:
    """(radius, limit) of the growing windows of a terrain: how far a point may lie above the surface that each leaves."""
    window, slope, first, most, cell = numbers(kind)
    out, last, k = [], 1, 1
    while 2 * k + 1 <= window:
        out.append((k, min(most, first + slope * (2 * k + 1 - last) * cell)))
        last, k = 2 * k + 1, 2 * k
    return out


def ground(points: DataFrame, kind: str | tuple = "standard") -> DataFrame:
    """Adds `ground`: whether a point lies near the surface that openings of growing windows leave (Zhang et al., 2003).

    All windows are opened one after the other within tiles whose halo holds them all, so the lowest heights are sent
    once; a cell keeps one number, the least height that a window bounds its points by. Each raster_id is a cloud.
    """
    plan, by = steps(kind), [*keys(points), "r", "c"]
    cell = numbers(kind)[4]

    def kernel(b: Block) -> dict[str, np.ndarray]:
        z, most = b.z, np.full(b.z.shape, np.inf)
        for k, limit in plan:
            z = opened(z, k)
            most = np.fmin(most, z + limit)
        return {"most": b.cut(most)}

    surface = durable(lowest(points, cell).select(*by, "z"))
    bounds = over_tiles(surface, 2 * sum(k for k, _ in plan), kernel, ["most"]).where("most IS NOT NULL")
    return binned(points, cell).join(bounds, by).select(*points.columns, (F.col("z") <= F.col("most")).alias("ground"))


def nearest_means(own: np.ndarray, at: np.ndarray, places: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of `own` (which are the rows `at` of `places`): the mean distance to its k nearest points and the greatest of them, infinite where there are fewer.

    A place stands for as many points as `times` says; the others at one's own place are at distance 0.
    """
    mean, far = np.empty(len(own)), np.empty(len(own))
    for i in range(0, len(own), 256):
        d = (own[i : i + 256, None, 0] - places[:, 0]) ** 2
        for axis in (1, 2):
            one = own[i : i + 256, None, axis] - places[:, axis]
            d += np.multiply(one, one, out=one)
        near = np.argpartition(d, min(k, len(places) - 1), axis=1)[:, : k + 1]
        d = np.sqrt(np.take_along_axis(d, near, axis=1))
        order = np.argsort(d, axis=1, kind="stable")
        d, near = np.take_along_axis(d, order, axis=1), np.take_along_axis(near, order, axis=1)
        n = times[near] - (near == at[i : i + 256, None])
        took = np.clip(k - (np.cumsum(n, axis=1) - n), 0, n)
        whole = took.sum(axis=1) == k
        mean[i : i + 256] = np.where(whole, (took * d).sum(axis=1) / k, np.inf)
        far[i : i + 256] = np.where(whole, np.where(took > 0, d, 0).max(axis=1), np.inf)
    return mean, far


def nearest_by_cubes(cubes: np.ndarray, own: np.ndarray, places: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """`nearest_means` of the rows `own`, two by two by two cubes at once, among the places of those and of the cubes around.

    What lies within a cube's side is there; where the greatest distance is more, it needn't be that of the nearest.
    """
    mean, far = np.empty(len(own)), np.empty(len(own))
    corners, which = np.unique(cubes[own] // 2, axis=0, return_inverse=True)
    which = which.ravel()
    for g, corner in enumerate(corners):
        at = np.flatnonzero(((cubes >= 2 * corner - 1) & (cubes <= 2 * corner + 2)).all(axis=1))
        mine = np.flatnonzero(which == g)
        mean[mine], far[mine] = nearest_means(places[own[mine]], np.searchsorted(at, own[mine]), places[at], times[at], k)
    return mean, far


def outliers(points: DataFrame, neighbours: int = 8, factor: float = 2.0) -> DataFrame:
    """Adds `outlier`: points whose mean distance to their nearest `neighbours` points is over the mean of all such by more than `factor` sample deviations.

    Points of equal place are one place with their number, so repeated points make no larger groups. Places meet in blocks
    of 4 x 4 x 4 cubes and the cubes around, and are compared by 2 x 2 x 2 cubes; a place whose nearest lie farther than a cube's side meets those of cubes
    twice as wide in the next round, until none is left, so the nearest are exact. With no more points than neighbours
    there are no outliers.
    """
    names = ["x", "y", "z"]
    places = durable(points.groupBy(*(F.col(x).cast("double").alias(x) for x in names)).agg(F.count("*").alias("n")))
    said = places.agg(F.sum("n").alias("n"), F.count("*").alias("m"), *(f(x).alias(f"{f.__name__}_{x}") for x in names for f in (F.min, F.max))).first()
    if (said.n or 0) <= neighbours:
        return points.withColumn("outlier", F.lit(False))
    sides = [said[f"max_{x}"] - said[f"min_{x}"] for x in names]
    live = [x for x in sides if x > 0]
    cell = (math.prod(live) * neighbours / said.m) ** (1 / len(live)) if live else 1.0
    left, done = places.withColumn("left", F.lit(True)), None
    schema = "x double, y double, z double, n bigint, d double, far double"
    while True:
        last = cell >= max(sides)
        cubes = left
        for x in names:
            k = F.floor((F.col(x) - said[f"min_{x}"]) / cell)
            blocks = F.array_distinct(F.array(F.floor((k - 1) / 4), F.floor(k / 4), F.floor((k + 1) / 4)))
            cubes = cubes.withColumns({f"k{x}": k, f"o{x}": F.floor(k / 4), f"b{x}": F.explode(blocks)})
        cubes = cubes.withColumn("own", F.col("left") & (F.col("ox") == F.col("bx")) & (F.col("oy") == F.col("by")) & (F.col("oz") == F.col("bz")))

        def work(f: pd.DataFrame) -> pd.DataFrame:
            at, xyz = np.flatnonzero(f.own.to_numpy()), f[names].to_numpy()
            mean, far = nearest_by_cubes(f[["kx", "ky", "kz"]].to_numpy(), at, xyz, f.n.to_numpy(), neighbours)
            return pd.DataFrame({"x": xyz[at, 0], "y": xyz[at, 1], "z": xyz[at, 2], "n": f.n.to_numpy()[at], "d": mean, "far": far})

        if done is not None:  # blocks with places left
            open_ = durable(cubes.where("own").select("bx", "by", "bz").distinct())
            cubes = cubes.join(sent_whole(open_), ["bx", "by", "bz"], "left_semi")
        met = cubes.select(*names, "n", "own", "kx", "ky", "kz", "bx", "by", "bz").groupBy("bx", "by", "bz").applyInPandas(work, schema)
        best = durable(met.where(F.lit(last) | (F.col("far") <= cell)).select(*names, "n", "d"))
        done = best if done is None else done.unionByName(best)
        if last:
            break
        known = best.select(*names, F.lit(False).alias("known"))
        left = durable(left.join(known, names, "left").select(*names, "n", (F.col("left") & F.col("known").isNull()).alias("left")))
        if not left.where("left").limit(1).count():
            break
        cell *= 2
    m = done.agg((F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("m"), F.sum("n").alias("n")).first()
    sd = math.sqrt(done.agg(F.sum((F.col("d") - m.m) * (F.col("d") - m.m) * F.col("n"))).first()[0] / (m.n - 1))
    flags = done.select(*(F.col(x).alias(f"_{x}") for x in names), (F.col("d") > m.m + factor * sd).alias("outlier"))
    same = [F.col(x).cast("double") == F.col(f"_{x}") for x in names]
    return points.join(flags, same[0] & same[1] & same[2]).select(*points.columns, "outlier")


#: Parameters of the cloth by terrain (fixed values): cell, threshold, rigidness, time step, smoothing of slopes.
CLOTH = {
    "archaeology_fine": (0.5, 0.5, 1, 0.65, False),
    "archaeology_standard": (1.0, 0.8, 2, 0.65, True),
    "forested": (2.0, 1.2, 3, 0.50, True),
    "urban": (1.0, 0.5, 1, 0.65, True),
}


def cloth_ground(points: DataFrame, kind: str = "archaeology_standard", iterations: int = 500, tile: int = 512, halo: int = 128) -> DataFrame:
    """Adds `ground`: whether a point lies within the threshold of a cloth draped over the points of its cloud from below (see `cloth_of`).

    The cloth is one for each raster_id, whatever the tiles. An unknown kind is the standard one.
    """
    cell, threshold, rigidness, time_step, slopes = CLOTH.get(kind, CLOTH["archaeology_standard"])
    by = [*keys(points), "r", "c"]
    hung = cloth_of(lowest(points, cell).select(*by, "z"), rigidness, time_step, slopes, iterations, tile, halo)
    near = binned(points, cell).join(hung, by)
    return near.select(*points.columns, (F.abs(F.col("z") - F.col("cloth")) <= threshold).alias("ground"))


def crs_of(meta: DataFrame) -> Column:
    """The CRS of a cloud's metadata (epsg, compoundwkt, wkt, proj4; all optional), the first that is there; empty text counts as missing."""
    names = [n for n in ("compoundwkt", "wkt", "proj4") if n in meta.columns]
    code = [F.concat(F.lit("EPSG:"), F.nullif(F.trim(F.col("epsg").cast("string")), F.lit("")))] if "epsg" in meta.columns else []
    return F.coalesce(*code, *(F.nullif(F.trim(n), F.lit("")) for n in names), F.lit(None).cast("string"))


def to_dem(points: DataFrame, crs: str | None, kind: str = "archaeology_standard", cell: float = 1.0, least: int = 10) -> tuple[DataFrame, dict]:
    """((r, c, z) of the ground, counts): cloth filter, then inverse distances. Raises without a CRS or with fewer than `least` ground points."""
    if not crs:
        raise ValueError("the cloud has no CRS; give one")
    flagged = durable(cloth_ground(points, kind))
    said = flagged.agg(F.count("*").alias("n"), F.count_if("ground").alias("ground")).first()
    if said.ground < least:
        raise ValueError(f"only {said.ground} ground points")
    return inverse_distance(flagged.where("ground"), cell), {"points": said.n, "ground": said.ground, "off_ground": said.n - said.ground, "crs": crs}


def in_range(points: DataFrame, limits: str) -> DataFrame:
    """Points within limits such as 'Classification[2:2], z[0:]': all of them, ends included; an exclamation mark turns one round."""
    for part in limits.split(","):
        m = re.fullmatch(r"\s*(\w+)(!?)\[([-+.\deE]*):([-+.\deE]*)\]\s*", part)
        if not m or m[1].lower() not in {c.lower() for c in points.columns}:
            raise ValueError(f"no such limits: {part.strip()!r}")
        x = F.col(m[1])
        inside = (F.lit(True) if not m[3] else x >= float(m[3])) & (F.lit(True) if not m[4] else x <= float(m[4]))
        points = points.where(x.isNotNull() & (~inside if m[2] else inside))
    return points


def ferried(points: DataFrame, dimensions: str) -> DataFrame:
    """Copies dimensions, as 'Classification=>UserData, z=>height' says."""
    for part in dimensions.split(","):
        m = re.fullmatch(r"\s*(\w+)\s*=>\s*(\w+)\s*", part)
        if not m:
            raise ValueError(f"no such copy: {part.strip()!r}")
        points = points.withColumn(m[2], F.col(m[1]))
    return points


#: Stages that a pipeline may have (fixed values).
STAGES = frozenset(
    "readers.las readers.laz readers.copc readers.pcd readers.optech writers.las writers.laz writers.gdal writers.copc filters.pmf filters.smrf filters.outlier filters.range filters.ferry filters.assign "
    "filters.reprojection filters.transformation filters.crop filters.merge filters.splitter filters.sample filters.voxelcentroid filters.cluster filters.hag_nn filters.hag_delaunay filters.elm filters.returns "
    "filters.stats filters.expression".split()
)


def checked(pipeline: str) -> list[dict]:
    """The stages of a pipeline's JSON; raises for anything but a list of objects with a type of STAGES."""
    stages = json.loads(pipeline).get("pipeline", [])
    if not isinstance(stages, list):
        raise ValueError("a pipeline is a list")
    for i, stage in enumerate(stages):
        if not isinstance(stage, dict) or not stage.get("type"):
            raise ValueError(f"stage {i} isn't an object with a type")
        if stage["type"] not in STAGES:
            raise ValueError(f"stage {i} is {stage['type']!r}, which isn't allowed")
    return stages


def pipeline(source: str, target: str, kind: str = "standard", cell: float = 1.0, output: str = "grid") -> str:
    """JSON of a ground pipeline: read, drop outliers, classify, keep ground, write a grid or points."""
    if kind not in GROUND:
        raise ValueError(f"no such terrain: {kind}")
    writer = {"type": "writers.gdal", "filename": target, "resolution": cell} if output == "grid" else {"type": "writers.las", "filename": target}
    return json.dumps({"pipeline": [{"type": "readers.las", "filename": source}, {"type": "filters.outlier", "mean_k": 8, "multiplier": 2.0}, {"type": "filters.pmf", "terrain": kind}, {"type": "filters.range", "limits": "Classification[2:2]"}, writer]}, indent=2)


def run(points: DataFrame, stages: str) -> tuple[DataFrame, dict]:
    """(points or cells, counts) by a pipeline's stages over a table in place of its reader; classes are 7 for noise, 2 for ground, 1 for others.

    The ground filter takes its numbers from the stage, those of the standard terrain (or of `terrain`) where the stage has none. `stats` in the
    counts are those of filters.stats: least, greatest and mean value of each dimension. Readers and merges take the table as it is.
    """
    parts, stats = checked(stages), {}
    for stage in parts:
        kind = stage["type"]
        if kind == "filters.outlier":
            points = outliers(points, stage.get("mean_k", 8), stage.get("multiplier", 2.0)).withColumn("Classification", F.when(F.col("outlier"), 7).otherwise(1)).drop("outlier")
        elif kind == "filters.elm":
            own = F.col("Classification") if "Classification" in points.columns else F.lit(1)
            points = low_noise(points, stage.get("cell", 10.0), stage.get("threshold", 1.0)).withColumn("Classification", F.when(F.col("low"), 7).otherwise(own)).drop("low")
        elif kind == "filters.pmf":
            seen = points.where("Classification IS NULL OR Classification <> 7") if "Classification" in points.columns else points
            names = ("max_window_size", "slope", "initial_distance", "max_distance", "cell_size")
            own = tuple(stage.get(n, v) for n, v in zip(names, numbers(stage.get("terrain", "standard")), strict=True))
            points = ground(seen, own).withColumn("Classification", F.when(F.col("ground"), 2).otherwise(1)).drop("ground")
        elif kind == "filters.range":
            points = in_range(points, stage["limits"])
        elif kind == "filters.ferry":
            points = ferried(points, stage["dimensions"])
        elif kind == "filters.stats":
            seen = [c for c, t in points.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
            said = points.select(F.struct(F.lit(0), *(F.struct(F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean")).alias(c) for c in seen)).alias("s")).first().s
            stats |= {c: said[c].asDict() for c in seen}
        elif kind in CHANGES:
            points = CHANGES[kind](points, stage)
        elif kind == "writers.gdal":
            points = inverse_distance(points, stage.get("resolution", 1.0))
        elif not kind.startswith(("readers.", "writers.")):
            raise ValueError(f"{kind} isn't built")
    points = durable(points)
    counts = {"point_count": points.count(), "stage_count": len(parts), "first_stage_type": parts[0]["type"] if parts else None}
    return points, counts | ({"stats": stats} if stats else {})
