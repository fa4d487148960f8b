"""Inverse distances of all points at every cell: near points one by one, far ones by the moments of the cells they lie in.

Cells of SIDE x SIDE targets and their parents, each twice as wide, form a pyramid; a cell keeps how many points it has,
their heights, and both once and twice multiplied by the points' offsets from its centre. A target meets a cell of the
pyramid where neither the cell nor its parent's neighbours have been met: at each level those whose parents are within
NEAR cells of its own and that aren't themselves, so each point counts once, and the points of cells within NEAR of its
own count exactly. A cell's weights are developed about its centre to the second order of the offsets. The points of a
cell lie within a share q = sqrt(1/2) / (NEAR + 1/2) of its distance, so by the expansion of d^-p in powers of q what is
left out is at most (1 - q)^-p less its first three terms, as a share of the cell's weight: 2 % for p = 2 at 4, of either
sign from cell to cell. A mean errs by no more than about twice that share of the range of heights; a tenth of a percent
of the range was the most in tests, where a fifth of the points lay in one cell.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellur.operators.ranges import attached
from tellur.sources.cells import keys
from tellur.sources.durable import durable

#: Cells within which points count one by one, targets along a side of the finest cells and of a task's block, and places of a block that one task takes.
NEAR, SIDE, BLOCK, POINTS = 4, 4, 64, 20_000

#: Moments: powers of the offsets along x and y, each for the points and for their heights.
POWERS = [(0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2)]
NAMES = [f"{k}{a}{b}" for k in "nz" for a, b in POWERS]


def bound(near: int = NEAR, power: float = 2.0) -> float:
    """The greatest share of a far cell's weight that its moments leave out."""
    q = math.sqrt(0.5) / (near + 0.5)
    return (1 - q) ** -power - 1 - power * q - power * (power + 1) / 2 * q * q


def dealt(placed: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """Adds `part` to places in cells (i, j): blocks with more than POINTS places, as `cells` count them, have several parts of about so many."""
    home = [F.floor(F.col(k) * SIDE / BLOCK).alias(f"_{k}") for k in "ij"]
    full = cells.select(*by, *home, "places").groupBy(*by, "_i", "_j").agg(F.ceil(F.sum("places") / POINTS).alias("k")).where("k > 1")
    crowd = cells.select(*by, "i", "j", *home).join(full, [*by, "_i", "_j"]).drop("_i", "_j")
    return placed.join(crowd, [*by, "i", "j"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("x", "y"), F.col("k")), F.lit(0))).drop("k")


def inverse_distance(points: DataFrame, cell: float = 1.0, power: float = 2.0, smoothing: float = 1.0, near: int = NEAR) -> DataFrame:
    """([raster_id,] r, c, z): at the centre of each cell of a cloud's box the mean height of all its points, weighed by (d^2 + smoothing^2)^(-power / 2).

    A point on a centre without smoothing decides there. Points with a null coordinate or height take no part. Points of
    equal x and y are one place with their number and the sum of their heights. The places of crowded blocks are dealt
    over several tasks, whose sums are added up, so that no task takes more than those of the blocks around it leave to
    one part: nine times POINTS at most, however many points lie in a block.
    """
    by = keys(points)
    p = points.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").select(*by, *(F.col(k).cast("double").alias(k) for k in "xyz"))
    p = p.withColumns({"r": F.floor(F.col("y") / cell), "c": F.floor(F.col("x") / cell)})
    box = durable(p.groupBy(*by).agg(*(f(k).alias(f"{k}{i}") for k in "rc" for i, f in ((0, F.min), (1, F.max))), F.count("*").alias("n")).where("n > 0").drop("n"))
    wide = box.agg(F.max(F.greatest(F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")))).first()[0]
    ends = ["r0", "r1", "c0", "c1"]
    if wide is None:
        return points.sparkSession.createDataFrame([], "".join(f"`{b}` {points.schema[b].dataType.simpleString()}, " for b in by) + "r int, c int, z double")
    top = max(0, math.ceil(math.log2(max(1, (wide + 1) / (SIDE * near)))))

    # The pyramid: sums over points, then over the four cells below, their offsets moved to the new centre.
    at = {k: F.floor(F.col(k) / SIDE).alias(i) for k, i in (("r", "i"), ("c", "j"))}
    off = [F.col(k) / cell - (F.col(i) + 0.5) * SIDE for k, i in (("x", "j"), ("y", "i"))]
    placed = durable(p.groupBy(*by, "x", "y", "r", "c").agg(F.count("*").alias("n"), F.sum("z").alias("z")).select(*by, "x", "y", "n", "z", *at.values()))
    power_of = lambda o, a, b: math.prod([o[0]] * a + [o[1]] * b, start=F.lit(1.0))
    level = placed.groupBy(*by, "i", "j").agg(*(F.sum(power_of(off, a, b) * F.col(k)).alias(f"{k}{a}{b}") for k in "nz" for a, b in POWERS), F.count("*").alias("places"))
    levels = [durable(level)]
    for up in range(1, top + 1):
        h = [(F.col(x) - F.floor(F.col(x) / 2) * 2 - 0.5) * (SIDE * 2.0 ** (up - 1)) for x in ("j", "i")]
        m = lambda k, a, b: F.col(f"{k}{a}{b}")
        moved = {f"{k}{a}{b}": sum((math.comb(a, s) * math.comb(b, t) * power_of(h, a - s, b - t) * m(k, s, t) for s in range(a + 1) for t in range(b + 1)), F.lit(0.0)) for k in "nz" for a, b in POWERS}
        parent = levels[-1].select(*by, F.floor(F.col("i") / 2).alias("i"), F.floor(F.col("j") / 2).alias("j"), *(v.alias(k) for k, v in moved.items()))
        levels.append(durable(parent.groupBy(*by, "i", "j").agg(*(F.sum(n).alias(n) for n in NAMES))))

    def to_blocks(df: DataFrame, side: float | None, reach: float) -> DataFrame:
        """Each row to the blocks whose targets may meet it: those within `reach` of its cell of so many targets a side, or all."""
        df = attached(df, box)
        for x, k, b in (("i", "r", "br"), ("j", "c", "bc")):
            first, last = F.floor(F.col(f"{k}0") / BLOCK), F.floor(F.col(f"{k}1") / BLOCK)
            if side is not None:
                first = F.greatest(first, F.floor((F.col(x) - reach) * side / BLOCK))
                last = F.least(last, F.floor((F.col(x) + 1 + reach) * side / BLOCK))
            df = df.withColumn(b, F.explode(F.when(first <= last, F.sequence(first, last))))
        return df

    held = dealt(placed, levels[0], by)
    sent = to_blocks(held, SIDE, near + 1).select(*by, "br", "bc", "part", *ends, F.lit(-1).alias("level"), "i", "j", *(F.col(k).alias(n) for k, n in zip("xynz", NAMES, strict=False)), *(F.lit(0.0).alias(n) for n in NAMES[4:]))
    for up, df in enumerate(levels):
        x = to_blocks(df, None if up == top else SIDE * 2.0**up, 2 * near + 3)
        sent = sent.unionByName(x.select(*by, "br", "bc", F.lit(0).cast("bigint").alias("part"), *ends, F.lit(up).alias("level"), "i", "j", *NAMES))

    def work(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        br, bc = key[-3:-1]
        r0, r1, c0, c1 = (int(f[e].iloc[0]) for e in ends)
        rr, cc = np.meshgrid(np.arange(max(br * BLOCK, r0), min(br * BLOCK + BLOCK - 1, r1) + 1), np.arange(max(bc * BLOCK, c0), min(bc * BLOCK + BLOCK - 1, c1) + 1), indexing="ij")
        rr, cc = rr.ravel(), cc.ravel()
        ty, tx = rr + 0.5, cc + 0.5  # in cells
        total = np.zeros((2, len(rr)))
        s2, e = (smoothing / cell) ** 2, power / 2
        for up, own in f.groupby("level"):
            side = SIDE * 2 ** max(up, 0)
            m, i, j = own[NAMES].to_numpy(), own.i.to_numpy(), own.j.to_numpy()
            a, b = rr // side, cc // side
            _, first, which = np.unique(np.stack([a, b]), axis=1, return_index=True, return_inverse=True)
            for g, t in enumerate(first):
                far = np.maximum(np.abs(i - a[t]), np.abs(j - b[t])) > near
                if up < 0:
                    take = ~far
                elif up == top:
                    take = far
                else:
                    take = far & (np.maximum(np.abs(i // 2 - a[t] // 2), np.abs(j // 2 - b[t] // 2)) <= near)
                if not take.any():
                    continue
                here = np.flatnonzero(which.ravel() == g)
                if up < 0:
                    q = (tx[here, None] - m[take, 0] / cell) ** 2 + (ty[here, None] - m[take, 1] / cell) ** 2 + s2
                    w = np.maximum(q, 1e-24) ** -e
                    total[0, here] += w @ m[take, 2]
                    total[1, here] += w @ m[take, 3]
                    continue
                dx, dy = tx[here, None] - (j[take] + 0.5) * side, ty[here, None] - (i[take] + 0.5) * side
                q = dx * dx + dy * dy + s2
                f0 = q**-e
                f1, f2 = -e * f0 / q, e * (e + 1) * f0 / (q * q)
                for k in (0, 1):
                    n, x, y, xx, xy, yy = m[take, 6 * k : 6 * k + 6].T
                    total[k, here] += (f0 * n - 2 * f1 * (dx * x + dy * y) + f1 * (xx + yy) + 2 * f2 * (dx * dx * xx + 2 * dx * dy * xy + dy * dy * yy)).sum(axis=1)
        return pd.DataFrame({k: v for k, v in zip(by, key, strict=False)} | {"r": rr, "c": cc, "w": total[0], "wz": total[1]})

    kind = "".join(f"`{b}` {points.schema[b].dataType.simpleString()}, " for b in by) + "r int, c int, w double, wz double"
    sums = sent.groupBy(*by, "br", "bc", "part").applyInPandas(work, kind).groupBy(*by, "r", "c").agg(F.sum("w").alias("w"), F.sum("wz").alias("wz"))
    return sums.select(*by, "r", "c", (F.col("wz") / F.col("w")).alias("z"))
