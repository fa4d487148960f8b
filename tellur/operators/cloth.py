"""A cloth draped over heights from below (Zhang et al., 2016), one for each raster, in tiles that exchange their borders.

A particle of the cloth depends on its four neighbours only, so what lies `halo` cells beyond a tile can't reach it within
halo / rigidness falls: for so many falls a tile goes on alone, then each sends the strips along its borders to its eight
neighbours. So the cloth is the same, to the last bit, for any tile. A tile is one row of packed numbers; a round writes
them and tells the driver the greatest move in each fall of each raster, by which the cloth comes to rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellur.operators.ranges import attached
from tellur.sources.cells import keys
from tellur.sources.durable import durable

#: A fall in which no particle moves so far is the last.
STILL = 1e-3
#: Heights within which a particle beside a fixed one is laid down.
BESIDE = 0.3
_NEAR = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def fall(under: np.ndarray, cloth: np.ndarray, before: np.ndarray, fixed: np.ndarray, rigidness: int, time_step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One fall: gravity, then neighbours pull a particle to their mean as often as it is rigid, then it stops where it meets a height. (cloth, before, fixed)"""
    now = np.where(fixed, cloth, cloth + (cloth - before) * 0.99 - 0.2 * time_step * time_step)
    for _ in range(rigidness):
        p = np.pad(now, 1, mode="edge")
        mean = (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]) / 4
        now = np.where(fixed, now, now + (mean - now) / 2)
    hit = ~fixed & (now <= under)
    return np.where(hit, under, now), cloth, fixed | hit


def laid(under: np.ndarray, cloth: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Particles beside fixed ones of nearly their height are laid down and fixed, until none is left: (cloth, fixed). The order makes no difference."""
    while True:
        p, f = np.pad(cloth, 1, mode="edge"), np.pad(fixed, 1)
        beside = np.zeros(under.shape, bool)
        for r, c in ((0, 1), (2, 1), (1, 0), (1, 2)):
            at = np.s_[r : r + under.shape[0], c : c + under.shape[1]]
            beside |= f[at] & (np.abs(p[at] - under) < BESIDE)
        new = ~fixed & beside & np.isfinite(under)
        if not new.any():
            return cloth, fixed
        cloth, fixed = np.where(new, under, cloth), fixed | new


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a, float).tobytes() for a in arrays)


def unpack(data: bytes, h: int, w: int) -> tuple[np.ndarray, ...]:
    """under, cloth, before, fixed."""
    a = np.frombuffer(data).reshape(4, h, w)
    return a[0], a[1], a[2], a[3] > 0


def cloth_of(low: DataFrame, rigidness: int = 2, time_step: float = 0.65, slopes: bool = True, iterations: int = 500, tile: int = 512, halo: int = 128) -> DataFrame:
    """([raster_id,] r, c, cloth): the cloth at the cells of lowest heights (r, c, z); cells between them are cloth without a height.

    It hangs over the heights turned upside down and falls until it rests, `iterations` times at most. With `slopes`,
    particles beside fixed ones of nearly their height are laid down at the end.
    """
    by, halo = keys(low), min(halo, tile)
    halo = max(halo, rigidness)
    names = "".join(f"`{b}` {low.schema[b].dataType.simpleString()}, " for b in by)
    low = durable(low.where("z IS NOT NULL").select(*by, "r", "c", F.col("z").cast("double").alias("z")))
    box = durable(low.groupBy(*by).agg(*(f(x).alias(f"{x}{k}") for x in "rc" for k, f in ((0, F.min), (1, F.max))), (1 - F.min("z")).alias("top")).where("top IS NOT NULL"))
    ends = ["r0", "r1", "c0", "c1", "top"]
    at = lambda x: F.floor((F.col(x) - F.col(f"{x}0")) / tile).cast("int")
    every = box.withColumn("tr", F.explode(F.sequence(F.lit(0), F.floor((F.col("r1") - F.col("r0")) / tile).cast("int")))).withColumn("tc", F.explode(F.sequence(F.lit(0), F.floor((F.col("c1") - F.col("c0")) / tile).cast("int"))))
    none = lambda *cs: [F.lit(None).cast(t).alias(c) for c, t in cs]
    cells = attached(low, box) if by or box.count() else low.limit(0).withColumns({e: F.lit(None).cast("double" if e == "top" else "int") for e in ends})
    cells = cells.withColumns({"tr": at("r"), "tc": at("c")})
    sent = cells.select(*by, "tr", "tc", *ends, "r", "c", "z").unionByName(every.select(*by, "tr", "tc", *ends, *none(("r", "int"), ("c", "int"), ("z", "double"))))

    def hang(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        tr, tc = key[-2:]
        r0, r1, c0, c1, top = (f[e].iloc[0] for e in ends)
        h, w = int(min(tile, r1 + 1 - r0 - tr * tile)), int(min(tile, c1 + 1 - c0 - tc * tile))
        under = np.full((h, w), -np.inf)
        own = f[f.r.notna()]
        under[(own.r - r0 - tr * tile).to_numpy(int), (own.c - c0 - tc * tile).to_numpy(int)] = -own.z
        cloth = np.full((h, w), top)
        return pd.DataFrame([(*key, h, w, pack(under, cloth, cloth, np.zeros((h, w))))], columns=[*by, "tr", "tc", "h", "w", "state"])

    kind = names + "tr int, tc int, h int, w int, state binary"
    tiles = durable(sent.groupBy(*by, "tr", "tc").applyInPandas(hang, kind))

    def strips(width: int):
        """Sends each tile to itself and the strips along its borders to the tiles beside."""

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for r in f.itertuples():
                    own = np.frombuffer(r.state).reshape(4, r.h, r.w)
                    out = []
                    for a, b in _NEAR:
                        rows, cols = (slice(None) if k == 0 else slice(max(0, n - width), n) if k > 0 else slice(0, width) for k, n in ((a, r.h), (b, r.w)))
                        part = own[:, rows, cols]
                        out.append((*(getattr(r, k) for k in by), r.tr + a, r.tc + b, -a, -b, part.shape[1], part.shape[2], pack(part), r.falls))
                    yield pd.DataFrame(out, columns=[*by, "tr", "tc", "dr", "dc", "h", "w", "state", "falls"])

        return work

    def met(group: pd.DataFrame) -> tuple | None:
        """(the block of a tile and the strips around it, the place of the tile in it), or None beyond the raster."""
        parts = {(r.dr, r.dc): np.frombuffer(r.state).reshape(4, r.h, r.w) for r in group.itertuples()}
        if (0, 0) not in parts:
            return None
        _, h, w = parts[0, 0].shape
        up, left = (parts[k].shape[i] if k in parts else 0 for k, i in (((-1, 0), 1), ((0, -1), 2)))
        down, right = (parts[k].shape[i] if k in parts else 0 for k, i in (((1, 0), 1), ((0, 1), 2)))
        block = np.empty((4, up + h + down, left + w + right))
        rows, cols = {-1: slice(0, up), 0: slice(up, up + h), 1: slice(up + h, None)}, {-1: slice(0, left), 0: slice(left, left + w), 1: slice(left + w, None)}
        for (a, b), p in parts.items():
            block[:, rows[a], cols[b]] = p
        return block, np.s_[up : up + h, left : left + w]

    def drop(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        columns = [*by, "tr", "tc", "h", "w", "state", "moves"]
        if (found := met(group)) is None:
            return pd.DataFrame([], columns=columns)
        (under, cloth, before, fixed), own = found
        fixed, moves = fixed > 0, []
        for _ in range(int(group.falls.iloc[0])):
            cloth, before, fixed = fall(under, cloth, before, fixed, rigidness, time_step)
            moves.append(float(np.abs(cloth - before)[own].max()))
        return pd.DataFrame([(*key, *cloth[own].shape, pack(under[own], cloth[own], before[own], fixed[own]), moves)], columns=columns)

    def lay(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        columns = [*by, "tr", "tc", "h", "w", "state", "moved"]
        if (found := met(group)) is None:
            return pd.DataFrame([], columns=columns)
        (under, cloth, before, fixed), own = found
        was = (fixed > 0)[own].sum()
        cloth, fixed = laid(under, cloth, fixed > 0)
        return pd.DataFrame([(*key, *cloth[own].shape, pack(under[own], cloth[own], before[own], fixed[own]), bool(fixed[own].sum() > was))], columns=columns)

    sendable = names + "tr int, tc int, dr int, dc int, h int, w int, state binary, falls int"

    def round_of(tiles: DataFrame, width: int, work, more: str) -> DataFrame:
        return durable(tiles.mapInPandas(strips(width), sendable).groupBy(*by, "tr", "tc").applyInPandas(work, f"{kind}, {more}"))

    plain = [*by, "tr", "tc", "h", "w", "state"]
    left, rested, done = iterations, None, 0
    alone = tiles.where("tr > 0 OR tc > 0").limit(1).count() == 0  # a raster in one tile has no borders to exchange
    while done < iterations:
        n = min(left, iterations if alone else max(1, halo // rigidness))
        now = round_of(tiles.withColumn("falls", F.lit(n)), halo, drop, "moves array<double>")
        most = now.select(*by, F.posexplode("moves").alias("i", "move")).groupBy(*by, "i").agg(F.max("move").alias("move"))
        rest = durable(most.where(F.col("move") < STILL).groupBy(*by).agg((F.min("i") + 1).cast("int").alias("falls")).where("falls IS NOT NULL"))
        done, left = done + n, left - n
        if rest.limit(1).count():  # these rasters rest within this round: their last fall is known, and they are taken there
            part = attached(tiles, rest).where("falls IS NOT NULL")
            last = round_of(part, halo, drop, "moves array<double>").select(*plain)
            rested = last if rested is None else rested.unionByName(last)
            now = attached(now, rest).where("falls IS NULL") if by else now.limit(0)
        tiles = now.select(*plain)
        if not tiles.limit(1).count():
            break
    tiles = tiles.select(*plain) if rested is None else tiles.unionByName(rested)
    while slopes:
        now = round_of(tiles.withColumn("falls", F.lit(0)), 1, lay, "moved boolean")
        tiles, moved = now.select(*plain), now.where("moved").limit(1).count()
        if not moved:
            break

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                under, cloth, _, _ = unpack(r.state, r.h, r.w)
                rr, cc = np.nonzero(np.isfinite(under))
                yield pd.DataFrame({k: getattr(r, k) for k in by} | {"r": rr + r.tr * tile, "c": cc + r.tc * tile, "cloth": -cloth[rr, cc]})

    out = tiles.mapInPandas(read, names + "r int, c int, cloth double")
    out = attached(out, box.select(*by, "r0", "c0")) if by or box.limit(1).count() else out.withColumns({"r0": F.lit(0), "c0": F.lit(0)})
    return out.select(*by, (F.col("r") + F.col("r0")).alias("r"), (F.col("c") + F.col("c0")).alias("c"), "cloth")
