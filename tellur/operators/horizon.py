"""Sky-view factor, openness, their anisotropic and filtered variants, and local dominance."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from tellur.operators.stencil import gradient, shade
from tellur.operators.tiles import Block, over_tiles
from tellur.operators.windows import mean_of

#: Degrees by which a sample may lie under a rise and still confirm it, in the filter of the sky view by direction (fixed value).
TOLERANCE = 2.0


def rays(directions: int, radius: int) -> list[list[tuple[int, int, float]]]:
    """(row step, column step, distance) of each direction's samples.

    Distances run from 1 to the radius by thirds; a pixel is sampled once, at the distance that reaches it first. Steps are
    those to the cell that is read: direction 0 reads southward, as the compatible variant has it.
    """
    out = []
    for i in range(directions):
        a, seen, ray = 2 * math.pi * i / directions, set(), []
        for t in range(3 * (radius - 1) + 1):
            d = 1 + t / 3
            at = round(math.cos(a) * d), round(-math.sin(a) * d)
            if at != (0, 0) and at not in seen:
                seen.add(at)
                ray.append((*at, math.hypot(math.cos(a) * d, math.sin(a) * d)))
        out.append(ray)
    return out


def sines(block: Block, z: np.ndarray, directions: int, radius: int, cell: float):
    """For each direction the samples' sines of elevation, nearest first."""
    z0 = block.cut(z)
    for ray in rays(directions, radius):

        def samples(ray=ray):
            for dr, dc, d in ray:
                dz = block.cut(z, dr, dc) - z0
                yield dz / np.hypot(dz, d * cell)

        yield samples()


def highest(samples, shape: tuple[int, int], floor: float) -> np.ndarray:
    top = np.full(shape, floor)
    for s in samples:
        np.maximum(top, s, out=top)
    return top


def confirmed(samples, shape: tuple[int, int], noise: int, tolerance: float | None = None) -> np.ndarray:
    """The horizon's sine, at least 0, where lone rises don't count.

    A rise above all before is held, and `noise` more samples are waited for. It is confirmed by one that reaches it, or
    with a `tolerance` (degrees) by one so far under it. When the wait ends, a confirmed rise becomes the horizon and
    another one is forgotten; at the end of the ray one still waited for counts too. A higher rise while one is held
    makes that one the horizon: always, or with a tolerance only if it was confirmed. With a tolerance the rise itself
    counts as the first sample of the wait.
    """
    lenient = tolerance is not None
    slack = math.sin(math.radians(tolerance)) if lenient else 0.0
    top, held = np.zeros(shape), np.zeros(shape)
    left, sure = np.zeros(shape, int), np.zeros(shape, bool)
    for s in samples:
        waiting = left > 0
        sure |= waiting & (s >= held - slack)
        rise = s > np.maximum(top, held)
        top = np.where(rise & (sure if lenient else waiting), held, top)
        held = np.where(rise, s, held)
        sure &= ~rise
        left = np.where(rise, noise - lenient, np.maximum(0, left - 1))
        ended = left == 0
        top = np.where(ended & sure, np.maximum(top, held), top)
        held = np.where(ended, top, held)
        sure &= ~ended
    return np.where(sure | (left > 0), np.maximum(top, held), top)


def sky_of(block: Block, z: np.ndarray, directions: int, radius: int, noise: int, cell: float, weights: list[float] | None = None) -> np.ndarray:
    shape, total = block.cut(z).shape, 0.0
    w = weights or [1.0] * directions
    for k, samples in zip(w, sines(block, z, directions, radius, cell), strict=True):
        top = confirmed(samples, shape, noise, TOLERANCE if weights else None) if noise else highest(samples, shape, 0.0)
        total = total + (1 - top) * k
    return np.clip(total / sum(w), 0, 1)


def sky_view(cells: DataFrame, directions: int = 16, radius: int = 10, noise: int = 0, cell: float = 1.0) -> DataFrame:
    """(r, c, svf): 1 - the mean over directions of the horizon's sine, not below 0; `noise` (0 to 3) as in `confirmed`."""
    return over_tiles(cells, radius, lambda b: {"svf": sky_of(b, b.filled(), directions, radius, noise, cell)}, ["svf"])


def directional(directions: int, azimuth: float, strength: float) -> list[float]:
    return [1 + strength * math.cos(math.radians(azimuth) - 2 * math.pi * i / directions) for i in range(directions)]


def anisotropic_sky_view(cells: DataFrame, directions: int = 16, radius: int = 10, azimuth: float = 315, strength: float = 0.5, noise: int = 0, cell: float = 1.0) -> DataFrame:
    """(r, c, asvf): the sky view weighed by 1 + strength cos(azimuth - direction); `noise` as in `confirmed` with a tolerance."""
    w = directional(directions, azimuth, strength)
    return over_tiles(cells, radius, lambda b: {"asvf": sky_of(b, b.filled(), directions, radius, noise, cell, w)}, ["asvf"])


def openness_of(block: Block, z: np.ndarray, directions: int, radius: int, cell: float) -> np.ndarray:
    shape = block.cut(z).shape
    return 90 - np.degrees(sum(np.arcsin(highest(s, shape, -1.0)) for s in sines(block, z, directions, radius, cell))) / directions


def openness(cells: DataFrame, negative: bool = False, directions: int = 16, radius: int = 20, cell: float = 1.0, edge: str = "mean") -> DataFrame:
    """(r, c, openness): the mean zenith (negative: nadir) angle to the horizon in degrees.

    Beyond the border lies the raster's mean, or with edge='reflect' the raster mirrored, as a common toolbox has it;
    nodata counts as the mean either way.
    """
    if edge not in ("mean", "reflect"):
        raise ValueError(f"no edge {edge!r}; there are mean and reflect")

    def kernel(b: Block):
        z = b.filled() if edge == "mean" else np.nan_to_num(b.reflected(), nan=b.mean)
        return {"openness": openness_of(b, -z if negative else z, directions, radius, cell)}

    return over_tiles(cells, radius, kernel, ["openness"])


def dominance_offsets(least: int, most: int, step: float, angle: float) -> list[tuple[int, int, float]]:
    n = max(1, math.ceil(360 / angle))
    radii = [q for q in np.arange(least, most + step, step).tolist() if q <= most]
    return [(round(-q * math.cos(2 * math.pi * i / n)), round(q * math.sin(2 * math.pi * i / n)), q) for i in range(n) for q in radii]


def dominance_of(block: Block, least: int, most: int, step: float, angle: float, height: float, cell: float) -> np.ndarray:
    z = block.repeated()
    z0, total, n = block.cut(z), 0.0, 0
    for dr, dc, q in dominance_offsets(least, most, step, angle):
        s = np.arctan((z0 + height - block.cut(z, dr, dc)) / (q * cell))
        total, n = total + np.nan_to_num(s), n + ~np.isnan(s)
    return np.clip((total / np.maximum(1, n) - 0.5) / 1.3 * 255, 0, 255)


def local_dominance(cells: DataFrame, least: int = 10, most: int = 20, step: float = 1, angle: float = 15, height: float = 1.7, cell: float = 1.0) -> DataFrame:
    """(r, c, dominance): the mean angle at which an observer's eyes look down on the surroundings, stretched to 0..255. Nodata is skipped."""
    return over_tiles(cells, most, lambda b: {"dominance": dominance_of(b, least, most, step, angle, height, cell)}, ["dominance"])


#: Measures of a tile by name: parameters with their defaults, the halo that they need, and what makes them of a block.
MEASURES = {
    "hillshade": ({"azimuths": (315, 45, 135, 225, 270, 0), "altitude": 45}, lambda p: 1, lambda b, cell, p: sum(shade(gradient(b, cell), a, p["altitude"]) for a in p["azimuths"]) / len(p["azimuths"]) * 255),
    "slope": ({}, lambda p: 1, lambda b, cell, p: np.degrees(np.arctan(np.hypot(*gradient(b, cell))))),
    "svf": ({"directions": 16, "radius": 10, "noise": 0}, lambda p: p["radius"], lambda b, cell, p: sky_of(b, b.filled(), p["directions"], p["radius"], p["noise"], cell)),
    "asvf": (
        {"directions": 16, "radius": 10, "azimuth": 315, "strength": 0.5, "noise": 0},
        lambda p: p["radius"],
        lambda b, cell, p: sky_of(b, b.filled(), p["directions"], p["radius"], p["noise"], cell, directional(p["directions"], p["azimuth"], p["strength"])),
    ),
    "openness": ({"directions": 16, "radius": 20, "negative": False}, lambda p: p["radius"], lambda b, cell, p: openness_of(b, b.filled() * (-1 if p["negative"] else 1), p["directions"], p["radius"], cell)),
    "slrm": ({"radius": 20}, lambda p: p["radius"], lambda b, cell, p: b.cut(b.z) - mean_of(b, p["radius"])),
    "dominance": ({"least": 10, "most": 20, "step": 1, "angle": 15, "height": 1.7}, lambda p: p["most"], lambda b, cell, p: dominance_of(b, p["least"], p["most"], p["step"], p["angle"], p["height"], cell)),
}


def measures(cells: DataFrame, asked: dict[str, tuple[str, dict]], cell: float = 1.0) -> DataFrame:
    """(r, c, *asked): several measures by one pass over the tiles, so that heights are sent once.

    `asked` maps a column to a name of MEASURES and the parameters that differ from the defaults. An openness and a sky
    view along the same rays share their horizons.
    """
    plans = {}
    for column, (kind, own) in asked.items():
        if kind not in MEASURES:
            raise ValueError(f"no measure {kind!r}; there are {', '.join(MEASURES)}")
        defaults, halo, make = MEASURES[kind]
        if unknown := own.keys() - defaults.keys():
            raise ValueError(f"{kind} has no {', '.join(sorted(unknown))}")
        plans[column] = (kind, defaults | own, halo(defaults | own), make)
    shared = {}
    for column, (kind, p, _, _) in plans.items():
        if kind in ("svf", "openness") and not p.get("noise") and not p.get("negative"):
            shared.setdefault((p["directions"], p["radius"]), []).append((column, kind))
    shared = {k: v for k, v in shared.items() if {x for _, x in v} == {"svf", "openness"}}
    done = {c for v in shared.values() for c, _ in v}

    def kernel(b: Block) -> dict[str, np.ndarray]:
        out = {c: make(b, cell, p) for c, (_, p, _, make) in plans.items() if c not in done}
        for (directions, radius), columns in shared.items():
            z = b.filled()
            shape, sky, opened = b.cut(z).shape, 0.0, 0.0
            for samples in sines(b, z, directions, radius, cell):
                top = highest(samples, shape, -1.0)
                sky, opened = sky + 1 - np.maximum(top, 0), opened + 90 - np.degrees(np.arcsin(top))
            out |= {c: (sky if kind == "svf" else opened) / directions for c, kind in columns}
        return out

    return over_tiles(cells, max(h for _, _, h, _ in plans.values()), kernel, list(plans))
