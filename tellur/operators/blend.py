"""Stretches, blends and composites: a few numbers of each raster, then one expression for each cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellur.operators.ranges import attached, quantiles_of, with_bounds
from tellur.operators.windows import byte
from tellur.sources.cells import keys
from tellur.sources.durable import durable

MODES = ("multiply", "screen", "overlay", "soft_light")


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def stretch(x: Column, low: Column, high: Column, constant: float = 0.5, least: float = 0.0) -> Column:
    """Min-max to 0..1; a column without range is `constant`."""
    return F.when(x.isNull(), None).when(high - low > least, (x - low) / (high - low)).otherwise(F.lit(constant))


def stretched(name: str, constant: float = 0.5, least: float = 0.0) -> Column:
    """A column of a table `with_bounds` by its raster's range."""
    return stretch(F.col(name), F.col(f"{name}_low"), F.col(f"{name}_high"), constant, least)


def blended(a: Column, b: Column, mode: str) -> Column:
    """Two layers in 0..1; a is the base."""
    if mode == "multiply":
        return a * b
    if mode == "screen":
        return 1 - (1 - a) * (1 - b)
    if mode == "overlay":
        return F.when(a < 0.5, 2 * a * b).otherwise(1 - 2 * (1 - a) * (1 - b))
    if mode == "soft_light":
        return (1 - 2 * b) * a * a + 2 * a * b
    raise ValueError(f"no blend mode {mode!r}; there are {', '.join(MODES)}")


def over(a: Column, b: Column, mode: str, opacity: float = 1.0) -> Column:
    """Two layers in 0..255 blended, then mixed with the base by opacity; NULL if either is."""
    x, y = clip(a / 255), clip(b / 255)
    return F.when(a.isNotNull() & b.isNotNull(), clip(blended(x, y, mode) * opacity + (1 - opacity) * x) * 255)


def blend(a: DataFrame, b: DataFrame, mode: str, opacity: float = 1.0) -> DataFrame:
    """([raster_id,] r, c, blend) of two rasters (r, c, z) on one lattice; raises if the cells aren't the same, each once."""
    by = [*keys(a), "r", "c"]
    layers = a.select(*by, F.col("z").alias("a"), F.lit(None).cast("double").alias("b"), F.lit(1).alias("of")).unionByName(b.select(*by, F.lit(None).cast("double").alias("a"), F.col("z").alias("b"), F.lit(2).alias("of")))
    both = layers.groupBy(*by).agg(F.max("a").alias("a"), F.max("b").alias("b"), F.count_if(F.col("of") == 1).alias("na"), F.count_if(F.col("of") == 2).alias("nb"))
    if both.where("na <> 1 OR nb <> 1").limit(1).count():
        raise ValueError("the rasters have other shapes")
    return both.select(*by, over(F.col("a"), F.col("b"), mode, opacity).alias("blend"))


def same_place(metas: DataFrame) -> DataFrame:
    """Adds `error` to pairs of rasters (crs_a, crs_b, x0_a, ..., y1_b): what keeps them from being blended, or NULL.

    Their CRS must be the same, and their extents within a millionth of the greater side.
    """
    side = F.greatest(*(F.abs(F.col(f"{k}1_{r}") - F.col(f"{k}0_{r}")) for k in "xy" for r in "ab"))
    far = [F.abs(F.col(f"{k}_a") - F.col(f"{k}_b")) > side * 1e-6 for k in ("x0", "y0", "x1", "y1")]
    return metas.withColumn("error", F.when(~F.col("crs_a").eqNullSafe(F.col("crs_b")), "other CRS").when(far[0] | far[1] | far[2] | far[3], "other extent"))


def prescale(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables of rasters (r, c, z) as layers of 0..255, by each raster's range: `a` is the base (see `prescaled`)."""
    out = []
    for x, base in ((a, True), (b, False)):
        out.append(with_bounds(x, ["z"], write=False).withColumn("z", prescaled(F.col("z"), F.col("z_low"), F.col("z_high"), base)).drop("z_low", "z_high"))
    return out[0], out[1]


def prescaled(x: Column, low: Column, high: Column, base: bool) -> Column:
    """A layer in 0..1 times 255; for the upper layer also min-max to 0..255 if it goes below 0 (127 if constant)."""
    out = F.when((low >= 0) & (high <= 1) & (high > 0), x * 255)
    if not base:
        out = out.when((low < 0) & x.isNotNull(), F.when(high > low, (x - low) / (high - low) * 255).otherwise(127.0))
    return out.otherwise(x)


def overlaid(table: DataFrame, name: str, a: Column, b: Column, mode: str, opacity: float = 1.0) -> DataFrame:
    """Adds `name`, which is `over`, to a table: one column for each step.

    Catalyst keeps such steps apart and computes each once. As one expression the layers are computed at each of their
    uses, and the method that Spark generates grows beyond the 8,000 bytes up to which the JVM compiles it.
    """
    x, y, z = (F.col(f"_{k}_{name}") for k in "xyz")
    out = table.withColumns({f"_x_{name}": a / 255, f"_y_{name}": b / 255})
    out = out.withColumns({f"_x_{name}": clip(x), f"_y_{name}": clip(y)})
    out = out.withColumn(f"_z_{name}", blended(x, y, mode) * opacity + (1 - opacity) * x)  # NULL if either is
    return out.withColumn(name, clip(z) * 255).drop(*(f"_{k}_{name}" for k in "xyz"))


def red_relief(relief: DataFrame, steep: DataFrame | None = None, opacity: float = 0.5) -> DataFrame:
    """(r, c, red) from (r, c, slrm) and (r, c, slope), or one table of both: stretched relief times inverted slope; layers without range are 0."""
    by = [*keys(relief), "r", "c"]
    layers = relief if steep is None else relief.join(steep, by)
    return red_of(with_bounds(layers, ["slrm", "slope"]), "red", opacity).select(*by, "red")


def red_of(layers: DataFrame, name: str, opacity: float = 0.5) -> DataFrame:
    """Adds the red relief as `name` to a table `with_bounds` of slrm and slope."""
    base, steep = (F.col(f"_{k}_{name}") for k in ("slrm", "slope"))
    x = layers.withColumns({f"_slrm_{name}": stretched("slrm", 0.0) * 255, f"_slope_{name}": stretched("slope", 0.0)})
    inverted = F.when(F.col("slope_high") > F.col("slope_low"), 1 - steep).otherwise(steep) * 255
    return overlaid(x, name, base, inverted, "multiply", opacity).drop(f"_slrm_{name}", f"_slope_{name}")


def vat(layers: DataFrame) -> DataFrame:
    """(r, c, vat) from (r, c, hillshade, slope, openness, svf): shade times inverted slope, openness overlaid, times sky view, each by half."""
    return vat_of(with_bounds(layers, list(VAT))).select(*keys(layers), "r", "c", "vat")


#: The layers of a VAT (fixed values).
VAT = ("hillshade", "slope", "openness", "svf")


def vat_of(layers: DataFrame) -> DataFrame:
    """Adds `vat` to a table `with_bounds` of its layers."""
    x = layers.withColumns({k: stretched(k) * 255 for k in VAT})
    x = overlaid(x, "vat", F.col("hillshade"), 255 - F.col("slope"), "multiply", 0.5)
    x = overlaid(x, "vat", F.col("vat"), F.col("openness"), "overlay", 0.5)
    return overlaid(x, "vat", F.col("vat"), F.col("svf"), "multiply", 0.5)


def e4mstp(layers: DataFrame) -> DataFrame:
    """(r, c, red, green, blue) from (r, c, z, pos, neg, ld, slope, svf_small, svf_large in 0..1, mstp_red.. in 0..255).

    Texture is the product of both opennesses and dominance; red is slope, green and blue the texture on gentle ground.
    Both sky views darken by a quarter, the topographic position is overlaid at nine tenths. Nodata is 0; a missing sky view is 1.
    """
    s, tex = F.col("slope"), F.col("pos") * F.col("neg") * F.col("ld")
    sky = (clip((F.coalesce("svf_large", F.lit(1.0)) - 0.9) / 0.1) + 0.5 * clip((F.coalesce("svf_small", F.lit(1.0)) - 0.7) / 0.3)) / 1.5
    out = {}
    for name, x in (("red", s), ("green", tex * (1 - s)), ("blue", tex * (1 - s))):
        x = clip(F.coalesce(x, F.lit(0.0)))
        x = x * sky * 0.25 + x * 0.75
        x = blended(x, F.col(f"mstp_{name}") / 255, "overlay") * 0.9 + x * 0.1
        out[name] = byte(x * 255)
    return layers.select(*keys(layers), "r", "c", *(v.alias(k) for k, v in out.items()))


def loadings(said: DataFrame, n: int) -> DataFrame:
    """([raster_id,] mean, sd, v): of each raster's moments (mean, sd, and the n x n covariances cov) the loadings of three components, one after the other."""
    by = keys(said)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            whole = [np.nan_to_num(np.array([*f[c]], float)) for c in ("mean", "sd", "cov")]
            mean, sd, cov = whole[0], np.maximum(whole[1], 1e-10), whole[2].reshape(-1, n, n)
            vectors = np.linalg.eigh(cov / (sd[:, :, None] * sd[:, None, :]))[1][:, :, ::-1][:, :, :3]
            top = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None], axis=1)
            yield f[by].assign(mean=[*mean], sd=[*sd], v=[x.T.ravel() for x in vectors * np.sign(top)])

    return said.mapInPandas(work, "".join(f"`{b}` {said.schema[b].dataType.simpleString()}, " for b in by) + "mean array<double>, sd array<double>, v array<double>")


def principal(metrics: DataFrame, names: list[str]) -> DataFrame:
    """(r, c, pc1, pc2, pc3): the first three components of each raster's z-scored metrics, each stretched from its 2nd to 98th percentile to 0..255.

    The sign of a component makes its largest loading positive. Cells with a missing metric are NULL.
    """
    by, n = keys(metrics), len(names)
    metrics = durable(metrics.select(*by, "r", "c", *names))
    whole = metrics.dropna(subset=names)
    said = whole.groupBy(*by).agg(F.array(*map(F.avg, names)).alias("mean"), F.array(*map(F.stddev_pop, names)).alias("sd"), F.array(*(F.covar_samp(a, b) for a in names for b in names)).alias("cov"))
    x = attached(metrics, loadings(said, n))
    z = [(F.col(c) - F.col("mean")[i]) / F.col("sd")[i] for i, c in enumerate(names)]
    scores = durable(x.select(*by, "r", "c", *(sum((z[i] * F.col("v")[k * n + i] for i in range(1, n)), z[0] * F.col("v")[k * n]).alias(f"pc{k + 1}") for k in range(min(n, 3)))))
    pcs = scores.columns[-min(n, 3) :]
    long = scores.select(*by, F.explode(F.array(*(F.struct(F.lit(pc).alias("pc"), F.col(pc).alias("x")) for pc in pcs))).alias("own")).select(*by, "own.pc", "own.x")
    ends = quantiles_of(long, "x", [0.02, 0.98], by=[*by, "pc"])
    ends = ends.groupBy(*by).agg(*(F.coalesce(F.max(F.when(F.col("pc") == pc, F.col(q))), F.lit(0.0)).alias(f"{pc}_{k}") for pc in pcs for k, q in (("low", "q0"), ("high", "q1"))))
    return attached(scores, ends).select(*by, "r", "c", *((clip(stretched(pc, 0.0, 1e-10)) * 255).alias(pc) for pc in pcs))
