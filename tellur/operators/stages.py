"""Stages of point pipelines: cuts, moves, classes, noise below, thinning. Each raster_id is a cloud by itself."""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellur.functions.projection import turned
from tellur.sources.cells import keys
from tellur.sources.durable import durable

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_AXES = ("x", "y", "z")


def _other(df: DataFrame) -> DataFrame:
    """Its columns under other names, so that both sides of a join of a table with what comes of it have names of their own."""
    return df.select(*(F.col(c).alias(f"o_{c}") for c in df.columns))


def _alike(names: list[str]) -> Column:
    return functools.reduce(Column.__and__, (F.col(b).eqNullSafe(F.col(f"o_{b}")) for b in names))


def cropped(points: DataFrame, bounds: str, outside: bool = False) -> DataFrame:
    """Points within bounds such as '([0, 10], [5, 20])', two or three axes, ends included; `outside` takes the others. A missing coordinate is in neither."""
    if not re.fullmatch(rf"\s*\(\s*(\[\s*{_NUMBER}\s*,\s*{_NUMBER}\s*\]\s*,?\s*){{2,3}}\)\s*", bounds):
        raise ValueError(f"no such bounds: {bounds!r}")
    spans = re.findall(rf"\[\s*({_NUMBER})\s*,\s*({_NUMBER})\s*\]", bounds)
    inside = functools.reduce(Column.__and__, (F.col(a).between(float(low), float(high)) for a, (low, high) in zip(_AXES, spans, strict=False)))
    return points.where(~inside if outside else inside)


def transformed(points: DataFrame, matrix: str) -> DataFrame:
    """x, y, z by a 4 x 4 matrix of 16 numbers, row by row, the last row being 0 0 0 1."""
    m = [float(v) for v in re.split(r"[\s,]+", matrix.strip())]
    if len(m) != 16 or m[12:] != [0, 0, 0, 1]:
        raise ValueError("a matrix has 16 numbers and ends in 0 0 0 1")
    return points.withColumns({a: F.col("x") * m[4 * i] + F.col("y") * m[4 * i + 1] + F.col("z") * m[4 * i + 2] + m[4 * i + 3] for i, a in enumerate(_AXES)})


def assigned(points: DataFrame, assignment: str) -> DataFrame:
    """Sets a dimension where it lies within limits: 'Classification[7:9]=1', 'Classification[:]=0' for all; one that isn't there is added by the latter."""
    m = re.fullmatch(rf"\s*(\w+)\[({_NUMBER})?:({_NUMBER})?\]\s*=\s*({_NUMBER})\s*", assignment)
    if not m:
        raise ValueError(f"no such assignment: {assignment!r}")
    name, low, high, value = m.groups()
    known = {c.lower(): points.schema[c].dataType for c in points.columns}
    new = F.lit(float(value)).cast(known.get(name.lower(), "int" if float(value).is_integer() else "double"))
    if low is None and high is None:
        return points.withColumn(name, new)
    if name.lower() not in known:
        raise ValueError(f"no dimension {name}")
    x = F.col(name)
    inside = (F.lit(True) if low is None else x >= float(low)) & (F.lit(True) if high is None else x <= float(high))
    return points.withColumn(name, F.when(inside, new).otherwise(x))


def returned(points: DataFrame, groups: str = "last") -> DataFrame:
    """Points of groups of returns: first, intermediate, last (of several), only (of one), by ReturnNumber and NumberOfReturns."""
    of, n = F.col("ReturnNumber"), F.col("NumberOfReturns")
    kinds = {"first": (of == 1) & (n > 1), "intermediate": (of > 1) & (of < n), "last": (of == n) & (n > 1), "only": n == 1}
    named = [g.strip() for g in groups.split(",")]
    if unknown := set(named) - set(kinds):
        raise ValueError(f"no such returns: {sorted(unknown)}")
    return points.where(functools.reduce(Column.__or__, (kinds[g] for g in named)))


def low_noise(points: DataFrame, cell: float = 10.0, threshold: float = 1.0) -> DataFrame:
    """Adds `low`: points at the bottom of their cell, one after the other as long as the next lies more than `threshold` above.

    Of such points no two share a layer as high as the threshold, so a cell's layers say it, each with its number of
    points, its least height and nothing else; a cell with a large part of all points is a few layers too. Points of equal height aren't
    apart, and the highest of a cell is never low. A point without a place or height isn't low.
    """
    by = [*keys(points), "_r", "_c"]
    at = points.withColumns({"_r": F.floor(F.col("y") / cell), "_c": F.floor(F.col("x") / cell)})
    layers = at.where("z IS NOT NULL AND _r IS NOT NULL AND _c IS NOT NULL").groupBy(*by, F.floor(F.col("z") / threshold).alias("_layer")).agg(F.min("z").alias("_z"), F.count("*").alias("_n"))
    up = Window.partitionBy(*by).orderBy("_layer")
    joined = F.when((F.col("_n") == 1) & (F.lead("_z").over(up) - F.col("_z") > threshold), 0).otherwise(1)
    ends = layers.withColumn("_joined", joined).withColumn("_joined", F.sum("_joined").over(up)).where("_joined = 0").groupBy(*by).agg(F.max("_z").alias("_end"))
    return at.join(_other(ends), _alike(by), "left").select(*points.columns, F.coalesce(F.col("z") <= F.col("o__end"), F.lit(False)).alias("low"))


def centroids(points: DataFrame, cell: float) -> DataFrame:
    """([raster_id,] x, y, z, n): the mean place of the points of each cube of side `cell`, and their number; points that miss a coordinate take no part."""
    known = points.where(" AND ".join(f"{a} IS NOT NULL" for a in _AXES))
    cubes = [F.floor(F.col(a) / cell).alias(f"_{a}") for a in _AXES]
    return known.groupBy(*keys(points), *cubes).agg(*(F.avg(a).alias(a) for a in _AXES), F.count("*").alias("n")).drop(*(f"_{a}" for a in _AXES))


def sampled(points: DataFrame, radius: float) -> DataFrame:
    """Points of which no two are closer than `radius`, and to one of which each point left out is closer.

    In each round a cube whose diagonal is the radius, which can give one point at most, puts forward its first point by a hash
    of the place, then by place. Those that no earlier one put forward is closer to are taken, and what is close to them
    goes. So no round pairs the points of a cube, however many, and a point meets one of each of the 124 cubes around at most.
    Of rows of equal place that with the least other columns counts. Points that miss a coordinate are left out.
    """
    if not radius > 0:
        raise ValueError("a radius is above 0")
    by, side = keys(points), radius / math.sqrt(3)
    rest = [c for c in points.columns if c not in (*by, *_AXES)]
    cube, order = [f"_{a}" for a in _AXES], F.struct(F.xxhash64(*_AXES).alias("h"), *_AXES)
    known = points.where(" AND ".join(f"{a} IS NOT NULL" for a in _AXES))
    left = known.groupBy(*by, *_AXES).agg(F.min(F.struct(*rest)).alias("_rest")) if rest else known.select(*by, *_AXES).distinct()
    left = left.withColumns({f"_{a}": F.floor(F.col(a) / side) for a in _AXES})
    shift = F.sequence(F.lit(-2), F.lit(2))

    close = functools.reduce(Column.__add__, ((F.col(f"p.{a}") - F.col(f"o_p.{a}")) * (F.col(f"p.{a}") - F.col(f"o_p.{a}")) for a in _AXES)) < radius * radius

    def around(taken: DataFrame) -> DataFrame:
        for a in cube:
            taken = taken.withColumn("_s", F.explode(shift)).withColumn(a, F.col(a) + F.col("_s")).drop("_s")
        return _other(taken)

    left, where, out = left.withColumn("p", order), [*by, *cube], None
    every = left = durable(left)
    while left.limit(1).count():
        firsts = durable(left.groupBy(*where).agg(F.min("p").alias("p")))
        kept = durable(firsts.join(around(firsts), _alike(where) & close & (F.col("o_p") < F.col("p")), "left_anti"))
        out = kept if out is None else out.unionByName(kept)
        left = durable(left.join(around(kept), _alike(where) & close, "left_anti"))
    if out is None:
        return points.limit(0)
    taken = every.join(_other(out), _alike(where) & (F.col("p") == F.col("o_p")), "left_semi")
    return taken.select(*(F.col(f"_rest.{c}").alias(c) if c in rest else F.col(c) for c in points.columns))


def split(points: DataFrame, length: float) -> DataFrame:
    """Each square of side `length` as a cloud of its own: raster_id becomes its row and column, behind the id before, if any."""
    tile = [F.floor(F.col(a) / length).cast("string") for a in ("y", "x")]
    return points.withColumn("raster_id", F.concat_ws("/", *(F.col(k).cast("string") for k in keys(points)), *tile))


#: Stages of one table each that change points, by name, as functions of the points and the stage's options.
CHANGES = {
    "filters.crop": lambda p, o: cropped(p, o["bounds"], o.get("outside", False)),
    "filters.transformation": lambda p, o: transformed(p, o["matrix"]),
    "filters.reprojection": lambda p, o: turned(p, o["in_srs"], o["out_srs"]),
    "filters.assign": lambda p, o: assigned(p, o["assignment"]),
    "filters.returns": lambda p, o: returned(p, o.get("groups", "last")),
    "filters.voxelcentroid": lambda p, o: centroids(p, o.get("cell", 1.0)),
    "filters.sample": lambda p, o: sampled(p, o.get("radius", 1.0)),
    "filters.splitter": lambda p, o: split(p, o.get("length", 1000.0)),
    "filters.merge": lambda p, o: p,
}
