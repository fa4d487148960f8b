"""Neighbourhood kernels over tiles with a halo: each cell goes to every tile that needs it, a tile is one numpy call."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellur.sources.cells import keys
from tellur.sources.durable import durable, sent_whole


@dataclass
class Block:
    """A tile's heights with `halo` cells around it: NaN where the raster has none or ends."""

    z: np.ndarray
    halo: int
    mean: float
    #: Rows and columns of the raster's box, counted from the block's corner: first and last of each.
    box: tuple[int, int, int, int]
    #: Cells around the tile along a row, if not as many as along a column.
    halo_c: int | None = None

    def filled(self) -> np.ndarray:
        """Nodata, and what lies outside the raster, as the raster's mean."""
        return np.where(np.isnan(self.z), self.mean, self.z)

    def _at(self, rows, cols) -> np.ndarray:
        return self.z[np.ix_(rows, cols)]

    def repeated(self) -> np.ndarray:
        """Outside the raster the nearest border cell; nodata stays NaN."""
        r0, r1, c0, c1 = self.box
        return self._at(np.clip(np.arange(self.z.shape[0]), r0, r1), np.clip(np.arange(self.z.shape[1]), c0, c1))

    def reflected(self) -> np.ndarray:
        """Outside the raster the cells mirrored at its border, which isn't repeated; nodata stays NaN.

        A cell at most `halo` outside is mirrored to one at most `halo` inside, so the block holds it.
        """

        def mirror(n: int, low: int, high: int) -> np.ndarray:
            period = max(1, 2 * (high - low))
            at = np.mod(np.arange(n) - low, period)
            return low + np.minimum(at, period - at)

        r0, r1, c0, c1 = self.box
        return self._at(mirror(self.z.shape[0], r0, r1), mirror(self.z.shape[1], c0, c1))

    def mirrored(self) -> np.ndarray:
        """Outside the raster the cells mirrored at its border, which is repeated, over and over if the raster is narrow; nodata stays NaN."""

        def mirror(n: int, low: int, high: int) -> np.ndarray:
            side = high - low + 1
            at = np.mod(np.arange(n) - low, 2 * side)
            return low + np.minimum(at, 2 * side - 1 - at)

        r0, r1, c0, c1 = self.box
        return self._at(mirror(self.z.shape[0], r0, r1), mirror(self.z.shape[1], c0, c1))

    def box_sums(self, z: np.ndarray, radius: int) -> np.ndarray:
        """Sums over the square around each cell of the tile, by prefix sums along both axes of the block."""
        s = np.zeros((z.shape[0] + 1, z.shape[1] + 1))
        np.cumsum(np.cumsum(z, axis=0), axis=1, out=s[1:, 1:])
        low, high = self.halo - radius, self.halo + radius + 1
        h, w = z.shape[0] - 2 * self.halo, z.shape[1] - 2 * self.halo
        ends = lambda a, b: s[a : a + h, b : b + w]
        return ends(high, high) - ends(low, high) - ends(high, low) + ends(low, low)

    def cut(self, z: np.ndarray, dr: int = 0, dc: int = 0) -> np.ndarray:
        """The tile, moved by so many cells within the halo."""
        h, w = self.halo, self.halo if self.halo_c is None else self.halo_c
        return z[h + dr : z.shape[0] - h + dr, w + dc : z.shape[1] - w + dc]


Kernel = Callable[[Block], dict[str, np.ndarray]]

#: Cells with those of halos that a task of tiles gets on average, before there are more tasks, and that are packed at once.
DEALT, PACKED = 500_000, 100_000


def packed(sent: DataFrame, by: list[str]) -> DataFrame:
    """The other columns as arrays, one row for each value of `by` among PACKED rows or more of a task.

    A cell takes 16 bytes so, and about 110 as a row of its own: a shuffle for more than 200 tasks holds what a task
    sends and sorts it, so a task's memory would be that of all rows of its part of a file.
    """
    most, others = PACKED, [x for x in sent.columns if x not in by]
    kind = ", ".join(f"`{x}` {sent.schema[x].dataType.simpleString()}" for x in by) + "".join(f", `{x}` array<{sent.schema[x].dataType.simpleString()}>" for x in others)

    def grouped(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        f = pa.Table.from_batches(held).group_by(by, use_threads=False).aggregate([(x, "list") for x in others])
        return f.select([*by, *(f"{x}_list" for x in others)]).rename_columns([*by, *others]).to_batches()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n >= most:
                yield from grouped(held)
                held, n = [], 0
        if n:
            yield from grouped(held)

    return sent.select(*by, *others).mapInArrow(pack, kind)


def dealt(sent: DataFrame, rows: float, by: list[str]) -> DataFrame:
    """Cells of tiles over as many tasks as they need, DEALT cells each, so that memory and seconds of a task don't grow with the rasters.

    Without it there are as many tasks as the session's shuffle partitions or fewer, since heights pack well and Spark
    joins small partitions by their bytes. Tables of one task stay as they are.
    """
    tasks = math.ceil(rows / DEALT)
    return sent if tasks < 2 else sent.repartition(max(tasks, sent.sparkSession.sparkContext.defaultParallelism), *by)


def over_tiles(cells: DataFrame, halo: int | tuple[int, int], kernel: Kernel, names: list[str], tile: int | tuple[int, int] = 256) -> DataFrame:
    """([raster_id,] r, c, *names): what a kernel makes of every tile of every raster.

    The kernel gets a block and returns an array of the tile's size for each name. `halo` and `tile` are cells along both
    axes, or along a column and along a row. A task holds one block, (tile + 2 halo)^2
    cells; cells in several halos are sent to each, packed by tiles if there are cells for several tasks. Rasters may begin
    anywhere; cells that a raster's box lacks are nodata. Nodata cells have no values.
    """
    by = keys(cells)
    halos, tiles = (x if isinstance(x, tuple) else (x, x) for x in (halo, tile))
    stats = cells.groupBy(*by).agg(F.count("*").alias("_n"), F.avg("z").alias("_mean"), *(f(x).alias(f"_{f.__name__}_{x}") for x in "rc" for f in (F.min, F.max)))
    own = ["_mean", "_min_r", "_max_r", "_min_c", "_max_c"]
    if by:
        stats = durable(stats)
        n = stats.agg(F.sum("_n")).first()[0]
        said, fixed = sent_whole(stats.drop("_n")), None
        sent = cells.select(*by, "r", "c", F.col("z").cast("double").alias("z")).join(said, by)
    else:
        fixed = stats.first()  # six numbers of the one raster
        n = fixed["_n"]
        sent = cells.select("r", "c", F.col("z").cast("double").alias("z"), *(F.lit(fixed[x]).alias(x) for x in own))

    def spans(x: str):
        halo, tile = halos["rc".index(x)], tiles["rc".index(x)]
        low, last = F.col(f"_min_{x}"), F.floor((F.col(f"_max_{x}") - F.col(f"_min_{x}")) / tile)
        return F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(x) - low - halo) / tile)).cast("int"), F.least(last, F.floor((F.col(x) - low + halo) / tile)).cast("int")))

    sent = sent.withColumn("tr", spans("r")).withColumn("tc", spans("c")).select(*by, "tr", "tc", *(F.col(x).cast("int").alias(x) for x in "rc"), "z")
    rows = (n or 0) * math.prod(1 + 2 * h / t for h, t in zip(halos, tiles, strict=True))
    many = rows > DEALT
    sent = packed(sent, [*by, "tr", "tc"]) if many else sent
    sent = sent.join(said, by) if by else sent

    def work(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        mean, r_min, r_max, c_min, c_max = (fixed[x] if fixed else f[x].iloc[0] for x in own)
        r0, c0 = int(r_min) + key[-2] * tiles[0], int(c_min) + key[-1] * tiles[1]
        h, w = min(tiles[0], int(r_max) + 1 - r0), min(tiles[1], int(c_max) + 1 - c0)
        z = np.full((h + 2 * halos[0], w + 2 * halos[1]), np.nan)
        r, c, held = (np.concatenate(f[x].to_numpy()) if many else f[x].to_numpy() for x in "rcz")
        z[r - r0 + halos[0], c - c0 + halos[1]] = held.astype(float)
        box = (int(r_min) - r0 + halos[0], int(r_max) - r0 + halos[0], int(c_min) - c0 + halos[1], int(c_max) - c0 + halos[1])
        block = Block(z, halos[0], float(mean) if mean is not None and mean == mean else 0.0, box, halos[1])
        out = kernel(block)
        ok = ~np.isnan(block.cut(z))
        rr, cc = np.mgrid[r0 : r0 + h, c0 : c0 + w]
        at = {"r": rr.ravel(), "c": cc.ravel()} | {n: np.where(ok, out[n], np.nan).ravel() for n in names}
        return pd.DataFrame(({by[0]: key[0]} if by else {}) | at)

    schema = "".join(f"`{b}` {cells.schema[b].dataType.simpleString()}, " for b in by) + "r int, c int, " + ", ".join(f"{n} double" for n in names)
    out = dealt(sent, rows, [*by, "tr", "tc"]).groupBy(*by, "tr", "tc").applyInPandas(work, schema)
    return out.select(*by, "r", "c", *(F.when(~F.isnan(n), F.col(n)).alias(n) for n in names))
