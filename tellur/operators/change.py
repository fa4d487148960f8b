"""Raster statistics, change between two epochs, resampling, overviews and stacks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellur.functions.projection import turned
from tellur.operators.ranges import attached, quantiles_of, with_bounds
from tellur.sources.cells import keys


#: Values whose percentiles one aggregate may hold; of more, bins are refined until those with the ranks hold so few.
AT_ONCE = 1_000_000
BINS = 4_096


def quantiles(table: DataFrame, name: str, shares: list[float], most: int = AT_ONCE) -> list[float] | None:
    """Exact percentiles of a column, interpolated between the two values beside a rank; None without values.

    Up to `most` values an aggregate finds them. Beyond, values are counted in bins, and the bins that hold the wanted ranks
    are divided again until they hold `most` values at most or one value: a few counts reach the driver in each pass.
    """
    x = table.where(F.col(name).isNotNull()).select(F.col(name).cast("double").alias("x"))
    said = x.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if not said.n:
        return None
    if said.n <= most:
        return list(x.agg(F.percentile("x", F.array(*map(F.lit, shares)))).first()[0])

    def at(rank: int) -> float:
        """The value of a rank: bins are narrowed around it."""
        lo, hi, before, inside = said.lo, said.hi, 0, said.n
        while inside > most and hi > lo and (wide := (hi - lo) / BINS) > 0:
            own = x.where((F.col("x") >= lo) & (F.col("x") <= hi))
            bins = own.groupBy(F.least(F.lit(BINS - 1), F.floor((F.col("x") - lo) / wide)).alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            for b in sorted(bins.collect(), key=lambda r: r.b):
                if rank < before + b.n:
                    break
                before += b.n
            if (b.lo, b.hi, b.n) == (lo, hi, inside):
                break
            lo, hi, inside = b.lo, b.hi, b.n
        if lo == hi:
            return lo
        own = x.where((F.col("x") >= lo) & (F.col("x") <= hi)).groupBy("x").count().orderBy("x").limit(rank - before + 1).collect()
        for r in own:
            before += r["count"]
            if rank < before:
                return r.x
        return hi

    out = []
    for share in shares:
        place = share * (said.n - 1)
        low = at(math.floor(place))
        high = at(math.ceil(place)) if place % 1 else low
        out.append(low + (high - low) * (place % 1))
    return out


def statistics(cells: DataFrame) -> DataFrame:
    """One row: least, greatest, mean, population deviation, percentiles 5 to 95 and counts of valid and nodata cells; one for each raster_id."""
    shares, by = (5, 25, 50, 75, 95), keys(cells)
    out = [F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.avg("z").alias("z_mean"), F.stddev_pop("z").alias("z_std")]
    counts = [F.count("z").alias("n_valid"), F.count_if(F.col("z").isNull()).alias("n_nodata")]
    if by:
        said = attached(cells.groupBy(*by).agg(*out, *counts), quantiles_of(cells, "z", [p / 100 for p in shares]))
        return said.select(*by, "z_min", "z_max", "z_mean", "z_std", *(F.col(f"q{i}").alias(f"p{p}") for i, p in enumerate(shares)), "n_valid", "n_nodata")
    if cells.where("z IS NOT NULL").count() <= AT_ONCE:
        return cells.groupBy(*by).agg(*out, *(F.percentile("z", F.lit(p / 100)).alias(f"p{p}") for p in shares), *counts)
    q = quantiles(cells, "z", [p / 100 for p in shares])
    one = cells.agg(*out, *counts)
    return one.select("z_min", "z_max", "z_mean", "z_std", *(F.lit(v).alias(f"p{p}") for p, v in zip(shares, q, strict=True)), "n_valid", "n_nodata")


def histogram(cells: DataFrame, bins: int = 100) -> DataFrame:
    """([raster_id,] bin, n, height): of each raster, equal widths from its least to its greatest value, the last closed; height is relative to its fullest bin."""
    by = keys(cells)
    x = with_bounds(cells.select(*by, "z"), ["z"], write=False).where("z IS NOT NULL")
    wide = F.when(F.col("z_high") > F.col("z_low"), F.col("z_high") - F.col("z_low")).otherwise(1.0)
    n = x.groupBy(*by, F.least(F.lit(bins - 1), F.floor((F.col("z") - F.col("z_low")) / wide * bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return n.select(*by, "bin", "n", (F.col("n") / F.max("n").over(Window.partitionBy(*by))).alias("height"))  # `bins` rows of a raster


def display_range(cells: DataFrame, deviations: float | None = 2.0) -> DataFrame:
    """([raster_id,] low, high): each raster's range, cut to the mean plus and minus so many deviations if given."""
    by = keys(cells)
    s = cells.groupBy(*by).agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.avg("z").alias("z_mean"), F.stddev_pop("z").alias("z_std"))
    if deviations is None:
        return s.select(*by, F.col("z_min").alias("low"), F.col("z_max").alias("high"))
    return s.select(*by, F.greatest("z_min", F.col("z_mean") - deviations * F.col("z_std")).alias("low"), F.least("z_max", F.col("z_mean") + deviations * F.col("z_std")).alias("high"))


def detection_level(rmse_old: float = 0.15, rmse_new: float = 0.15, z: float = 1.96) -> float:
    return z * math.sqrt(rmse_old**2 + rmse_new**2)


def difference(old: DataFrame, new: DataFrame, level: float | None = None) -> DataFrame:
    """(r, c, dod, mask): new minus old on the old raster's cells; 1 lower, 2 higher beyond the level of detection, 0 within, 255 nodata."""
    level = detection_level() if level is None else level
    by = [*keys(old), "r", "c"]
    d = old.select(*by, F.col("z").alias("a")).join(new.select(*by, F.col("z").alias("b")), by, "left").withColumn("dod", F.col("b") - F.col("a"))
    mask = F.when(F.col("dod").isNull(), 255).when(F.col("dod") < -level, 1).when(F.col("dod") > level, 2).otherwise(0)
    return d.select(*by, "dod", mask.alias("mask"))


def report(dod: DataFrame, area: float = 1.0) -> DataFrame:
    """One row of counts and volumes; volumes are those of significant cells only."""
    d, m = F.col("dod"), F.col("mask")
    cut, fill = F.coalesce(F.sum(F.when(m == 1, -d * area)), F.lit(0.0)), F.coalesce(F.sum(F.when(m == 2, d * area)), F.lit(0.0))
    return dod.groupBy(*keys(dod)).agg(
        F.count_if(m != 255).alias("n_valid"), F.count_if(m.isin(1, 2)).alias("n_significant"), F.count_if(m == 1).alias("n_lower"), F.count_if(m == 2).alias("n_higher"), F.round(cut, 4).alias("cut"), F.round(fill, 4).alias("fill"), F.round(fill - cut, 4).alias("net")
    )


RESAMPLE = {
    "average": F.avg,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "med": F.median,
    "q1": lambda z: F.percentile(z, F.lit(0.25)),
    "q3": lambda z: F.percentile(z, F.lit(0.75)),
    "rms": lambda z: F.sqrt(F.avg(F.col(z) * F.col(z))),
    "mode": lambda z: F.mode(z, True),
}


def nearest(factor: int) -> Column:
    """The value of the block's cell nearest to its centre, of equal ones the last."""
    off = [F.col(x) - F.floor(F.col(x) / factor) * factor - (factor - 1) / 2 for x in "rc"]
    return F.min_by("z", F.struct(off[0] * off[0] + off[1] * off[1], -F.col("r"), -F.col("c")))


def resample(cells: DataFrame, factor: int, kind: str = "average") -> DataFrame:
    """(r, c, z) on a lattice `factor` times coarser; 'nearest' takes the cell nearest to the centre of each block."""
    if kind not in RESAMPLE and kind != "nearest":
        raise ValueError(f"no resampling {kind!r}; there are nearest, {', '.join(RESAMPLE)}")
    by = keys(cells)
    out = cells.groupBy(*by, F.floor(F.col("r") / factor).cast("int").alias("r2"), F.floor(F.col("c") / factor).cast("int").alias("c2")).agg((nearest(factor) if kind == "nearest" else RESAMPLE[kind]("z")).alias("z"))
    return out.withColumnsRenamed({"r2": "r", "c2": "c"})


def overview_levels(rows: int, cols: int) -> int:
    """Levels of a pyramid: none up to 512 cells a side, else until a side fits into 256."""
    side = max(rows, cols)
    return max(1, (side // 256).bit_length() - 1) if side > 512 else 0


#: What a level of a pyramid keeps of each cell so that the next can be made of it, and the value that they give.
LEVELS = {
    "average": ({"s": lambda: F.sum("z"), "n": lambda: F.count("z")}, lambda: F.try_divide("s", "n")),
    "rms": ({"s": lambda: F.sum(F.col("z") * F.col("z")), "n": lambda: F.count("z")}, lambda: F.sqrt(F.try_divide("s", "n"))),
    "sum": ({"s": lambda: F.sum("z")}, lambda: F.col("s")),
    "min": ({"s": lambda: F.min("z")}, lambda: F.col("s")),
    "max": ({"s": lambda: F.max("z")}, lambda: F.col("s")),
}


def pyramid(cells: DataFrame, levels: int, kind: str = "average") -> DataFrame:
    """(level, r, c, z) of levels 1..n. Sums, counts and extremes of a level are made of the one below it; other kinds of the raster itself."""
    by = keys(cells)
    half = [F.floor(F.col(x) / 2).cast("int").alias(x) for x in "rc"]
    out, level = None, cells
    for i in range(1, levels + 1):
        if kind in LEVELS:
            parts, value = LEVELS[kind]
            again = {k: (F.min if kind == "min" else F.max if kind == "max" else F.sum)(k) for k in parts}
            level = level.select(*by, *half, *(["z"] if i == 1 else parts)).groupBy(*by, "r", "c").agg(*((f() if i == 1 else again[k]).alias(k) for k, f in parts.items()))
            own = level.select(*by, F.lit(i).alias("level"), "r", "c", value().alias("z"))
        else:
            own = resample(cells, 2**i, kind).select(*by, F.lit(i).alias("level"), "r", "c", "z")
        out = own if out is None else out.unionByName(own)
    return out


def bilinear(cells: DataFrame, step: float, r0: float = 0.0, c0: float = 0.0, last: tuple[int, int] | None = None) -> DataFrame:
    """(r, c, z) at centres r0 + r step, c0 + c step of the source lattice, to its end or to the target (r, c) `last`: the four cells around each, those that exist weighed anew."""
    return interpolate(cells, step, "triangle", r0, c0, 0.0, widen=False, last=last)


def aligned(cells: DataFrame, grid: dict, to: dict, kind: str = "bilinear") -> DataFrame:
    """(r, c, z) of a raster on `grid` at the cells of the grid `to` that it covers; grids are dicts of x0, y0, px_w, px_h (a side of either sign), rows, cols.

    Both are of one CRS. An interpolating kind takes the centres of the target's cells; any other takes all source cells
    whose centres lie in a target cell.
    """
    if kind not in KERNELS and kind not in RESAMPLE and kind not in ("bilinear", "nearest"):
        raise ValueError(f"no resampling {kind!r}")
    step = [to["px_h"] / grid["px_h"], to["px_w"] / grid["px_w"]]
    off = [(to[k] - grid[k]) / grid[p] for k, p in (("y0", "px_h"), ("x0", "px_w"))]  # the target's corner, in source cells
    if min(step) <= 0:
        raise ValueError("the grids run in other directions")
    by, inside = keys(cells), (F.col("r") >= 0) & (F.col("r") < to["rows"]) & (F.col("c") >= 0) & (F.col("c") < to["cols"])
    if kind in KERNELS or kind == "bilinear":
        first = [o + s / 2 - 0.5 for o, s in zip(off, step, strict=True)]
        out = interpolate(cells, tuple(step), "triangle" if kind == "bilinear" else kind, *first, *((0.0,) if kind == "bilinear" else ()), widen=kind != "bilinear", last=(to["rows"] - 1, to["cols"] - 1))
        return out.where(inside)
    at = [((F.col(x) + 0.5 - o) / s) for x, o, s in zip("rc", off, step, strict=True)]
    cell = [F.floor(x).cast("int").alias(f"{n}2") for x, n in zip(at, "rc", strict=True)]
    far = [x - F.floor(x) - 0.5 for x in at]
    value = F.min_by("z", F.struct("far", -F.col("r"), -F.col("c"))) if kind == "nearest" else RESAMPLE[kind]("z")
    out = cells.select(*by, "r", "c", "z", *cell, (far[0] * far[0] + far[1] * far[1]).alias("far")).groupBy(*by, "r2", "c2").agg(value.alias("z"))
    return out.withColumnsRenamed({"r2": "r", "c2": "c"}).where(inside)


def warped(cells: DataFrame, grid: dict, crs: str, to: dict, to_crs: str, kind: str = "bilinear") -> DataFrame:
    """([raster_id,] r, c, z) of a raster on `grid` in one CRS at the cells of the grid `to` in another; grids as in `aligned`.

    The centre of each target cell is turned into the source's CRS, and takes the cell it lies in ('nearest') or the four
    around it by their distances, those that exist weighed anew ('bilinear'). Each target asks for its cells by a key, so
    the raster is shuffled once and sums combine before theirs. In one CRS it is `aligned`, whose every kind can be had.
    """
    if crs == to_crs:
        return aligned(cells, grid, to, kind)
    if kind not in ("nearest", "bilinear"):
        raise ValueError(f"between CRS there are nearest and bilinear, not {kind!r}")
    by, spark = keys(cells), cells.sparkSession
    row = spark.range(to["rows"]).select(F.col("id").cast("int").alias("r"))
    targets = row.select("r", F.explode(F.sequence(F.lit(0), F.lit(to["cols"] - 1))).alias("c"))
    at = targets.withColumns({x: F.lit(float(to[o])) + (F.col(k) + 0.5) * float(to[p]) for x, o, k, p in (("x", "x0", "c", "px_w"), ("y", "y0", "r", "px_h"))})
    # Where the centre lies in source cells. What it asks for is generated, empty where it lies outside, so no filter repeats the series.
    at = turned(at, to_crs, crs).select(F.col("r").alias("_r"), F.col("c").alias("_c"), ((F.col("y") - float(grid["y0"])) / float(grid["px_h"])).alias("_u"), ((F.col("x") - float(grid["x0"])) / float(grid["px_w"])).alias("_v"))
    inside = (F.col("_u") > -1) & (F.col("_u") < grid["rows"] + 1) & (F.col("_v") > -1) & (F.col("_v") < grid["cols"] + 1)
    if kind == "nearest":
        cells_of = F.array(F.struct(F.floor("_u").cast("int").alias("r"), F.floor("_v").cast("int").alias("c"), F.lit(1.0).alias("w")))
    else:
        at = at.withColumns({"_lr": F.floor(F.col("_u") - 0.5), "_lc": F.floor(F.col("_v") - 0.5)})
        part = {"r": F.col("_u") - 0.5 - F.col("_lr"), "c": F.col("_v") - 0.5 - F.col("_lc")}
        cells_of = F.array(*(F.struct((F.col("_lr") + i).cast("int").alias("r"), (F.col("_lc") + j).cast("int").alias("c"), ((part["r"] if i else 1 - part["r"]) * (part["c"] if j else 1 - part["c"])).alias("w")) for i in (0, 1) for j in (0, 1)))
    asked = at.select("_r", "_c", F.inline(F.when(inside, cells_of))).where("w > 0")
    found = asked.join(cells.where("z IS NOT NULL").select(*by, "r", "c", "z"), ["r", "c"])
    out = found.groupBy(*by, F.col("_r").alias("to_r"), F.col("_c").alias("to_c")).agg((F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("z"))
    return out.select(*by, F.col("to_r").alias("r"), F.col("to_c").alias("c"), "z")


def stack(layers: list[DataFrame]) -> DataFrame:
    """([raster_id,] r, c, bands): co-located rasters as one array for each cell; a cell that a layer lacks has NULL there."""
    by = [*keys(layers[0]), "r", "c"]
    out = layers[0].select(*by, F.col("z").alias("b0"))
    for i, x in enumerate(layers[1:], 1):
        out = out.join(x.select(*by, F.col("z").alias(f"b{i}")), by, "full")
    return out.select(*by, F.array(*(f"b{i}" for i in range(len(layers)))).alias("bands"))


def mosaic(layers: list[DataFrame]) -> DataFrame:
    """([raster_id,] r, c, z): the last layer with a value wins in each cell."""
    by = [*keys(layers[0]), "r", "c"]
    parts = [x.select(*by, "z", F.lit(i).alias("n")) for i, x in enumerate(layers)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.groupBy(*by).agg(F.max_by("z", F.when(F.col("z").isNotNull(), F.col("n"))).alias("z"))


#: How a relief and bands are fused: relief, bands as red, green and blue, mode, opacity (fixed values).
RECIPES = {
    "terrain_cir": ("svf", ("B8", "B4", "B3"), "luminance", 0.6),
    "crop_marks": ("local_dominance", ("B4", "B3", "B2"), "overlay", 0.5),
    "erosion_risk": ("slope", ("B11", "B8", "B4"), "multiply", 0.7),
    "bare_earth": ("slrm", ("B11", "B12", "B4"), "screen", 0.5),
}


def fuse(relief: DataFrame, bands: DataFrame, names: tuple[str, str, str], mode: str, opacity: float) -> DataFrame:
    """(r, c, red, green, blue): a relief (r, c, z) blended into three bands, all stretched to 0..1; mixed with the bands by opacity. Nodata is 0."""
    from tellur.operators.blend import blended, stretched
    from tellur.operators.windows import byte

    if missing := [n for n in names if n not in bands.columns]:
        raise ValueError(f"bands are missing: {missing}")
    by = [*keys(relief), "r", "c"]
    x = relief.select(*by, F.col("z").alias("relief")).join(bands.select(*by, *dict.fromkeys(names)), by)
    x = with_bounds(x, ["relief", *dict.fromkeys(names)])
    light = stretched("relief", least=1e-10)

    def channel(n: str) -> Column:
        s = stretched(n, least=1e-10)
        if mode == "luminance":
            out = light * (1 - opacity) + light * s * opacity
        else:
            out = (1 - opacity) * s + opacity * blended(light, s, mode)
        return F.coalesce(byte(out * 255), F.lit(0))

    return x.select(*by, *(channel(n).alias(k) for n, k in zip(names, ("red", "green", "blue"), strict=True)))


def fused(cells: DataFrame, bands: DataFrame, recipe: str, options: dict | None = None) -> DataFrame:
    """(r, c, red, green, blue) by a recipe of RECIPES: its relief, made of the heights, with its bands. `options` are those of the relief's operator."""
    from tellur.operators import horizon, stencil, windows

    if recipe not in RECIPES:
        raise ValueError(f"no recipe {recipe!r}; there are {', '.join(RECIPES)}")
    kind, names, mode, opacity = RECIPES[recipe]
    make = {"svf": horizon.sky_view, "local_dominance": horizon.local_dominance, "slope": stencil.slope, "slrm": windows.local_relief}[kind]
    relief = make(cells, **(options or {}))
    return fuse(relief.withColumnRenamed(relief.columns[-1], "z"), bands, names, mode, opacity)


def _cubic(x: Column) -> Column:
    return F.when(x < 1, 1.5 * x * x * x - 2.5 * x * x + 1).when(x < 2, -0.5 * x * x * x + 2.5 * x * x - 4 * x + 2).otherwise(0.0)


def _spline(x: Column) -> Column:
    return F.when(x < 1, (4 - 6 * x * x + 3 * x * x * x) / 6).when(x < 2, (2 - x) * (2 - x) * (2 - x) / 6).otherwise(0.0)


def _lanczos(x: Column) -> Column:
    y = math.pi * x
    return F.when(x < 1e-9, 1.0).when(x < 3, 3 * F.sin(y) * F.sin(y / 3) / (y * y)).otherwise(0.0)


#: Kernels of the interpolating resamplers and how far each reaches.
KERNELS = {"triangle": (lambda x: F.greatest(F.lit(0.0), 1 - x), 1), "cubic": (_cubic, 2), "cubic_spline": (_spline, 2), "lanczos": (_lanczos, 3)}


#: Cells that one task interpolates, about, and rows of a strip.
CELLS, ROWS = 250_000, 64


def interpolate(cells: DataFrame, step: float | tuple[float, float], kind: str = "cubic", r0: float = 0.0, c0: float = 0.0, least: float = 0.1, widen: bool = True, last: tuple[int, int] | None = None) -> DataFrame:
    """(r, c, z) at centres r0 + r step, c0 + c step of the source lattice, up to each raster's last row and column, or to the target (r, c) `last`.

    The kernel is separable, so each source cell adds its value and weight to the target columns that it reaches, and
    each of those sums to the target rows: two groupings and no join. More than CELLS cells are dealt by strips of whole
    rows, so that sums along rows need no shuffle of their own and those along columns combine before theirs; of rows
    longer than CELLS, both combine as they come. A step over 1
    widens the kernel, unless `widen` is off; a pair is the steps along a column and along a row. Nodata cells weigh nothing; a target whose weights sum to `least` or less has none.
    """
    if kind not in KERNELS:
        raise ValueError(f"no kernel {kind!r}; there are {', '.join(KERNELS)}")
    kernel, reach = KERNELS[kind]
    steps = dict(zip("rc", step if isinstance(step, tuple) else (step, step), strict=True))
    by = keys(cells)
    ends = {"r": F.lit(last[0]), "c": F.lit(last[1])} if last else {"r": F.col("_last_r"), "c": F.col("_last_c")}
    own = [] if last else ["_last_r", "_last_c"]
    if not last:  # each raster ends at its own last row and column
        said = cells.groupBy(*by).agg(*(F.floor((F.max(x) - o) / steps[x]).cast("int").alias(f"_last_{x}") for x, o in (("r", r0), ("c", c0))))
        cells = attached(cells, said)

    def spread(df: DataFrame, axis: str, origin: float, other: str) -> DataFrame:
        step = steps[axis]
        scale = max(1.0, step) if widen else 1.0
        first = F.greatest(F.lit(0), F.ceil((F.col(axis) - reach * scale - origin) / step).cast("int"))
        end = F.least(ends[axis], F.floor((F.col(axis) + reach * scale - origin) / step).cast("int"))
        rest = [n for n in ("_strip",) if n in df.columns and axis == "c"]
        out = df.select(*by, *own, *rest, axis, other, "v", "w", F.explode(F.when(first <= end, F.sequence(first, end))).alias("t"))
        k = kernel(F.abs(F.col(axis) - (F.lit(float(origin)) + F.col("t") * step)) / scale)
        return out.groupBy(*by, *own, *rest, "t", other).agg(F.sum(F.col("v") * k).alias("v"), F.sum(F.col("w") * k).alias("w")).withColumnRenamed("t", f"to_{axis}")

    known = cells.where("z IS NOT NULL").select(*by, *own, "r", "c", F.col("z").alias("v"), F.lit(1.0).alias("w"))
    n, across = known.agg(F.count("*"), F.max("c") - F.min("c") + 1).first()
    if n > CELLS >= across:
        known = known.withColumn("_strip", F.floor(F.col("r") / min(ROWS, CELLS // across))).repartition(math.ceil(n / CELLS), *by, "_strip")
    wide = spread(known, "c", c0, "r")
    out = spread(wide, "r", r0, "to_c").where(F.col("w") > least)
    return out.select(*by, F.col("to_r").alias("r"), F.col("to_c").alias("c"), (F.col("v") / F.col("w")).alias("z"))
