"""Many reliefs of each raster at once: measures of tiles come from one pass, are written once, and composites are made of their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellur.functions.recipes import preset
from tellur.operators import blend, horizon, stencil, windows
from tellur.operators.ranges import with_bounds
from tellur.sources.cells import keys
from tellur.sources.durable import durable

#: Options where no preset says otherwise (fixed values).
DEFAULTS = {
    "svf": {"radius": 10, "directions": 16, "noise": 0},
    "openness": {"radius": 20, "directions": 16},
    "slrm": {"radius": 20},
    "local_dominance": {"least": 10, "most": 20, "height": 1.7},
    "mstp": {"local": 3, "meso": 20, "broad": 100},
    "vat": {"svf": 50, "openness": 50},
}
NAMES = ("hillshade", "slope", "tri", "svf", "asvf", "openness_positive", "openness_negative", "local_dominance", "slrm", "mstp", "vat", "red_relief", "e4mstp")
MIX = {"azimuths": (315, 45, 135, 225), "altitude": 45}


def batch(cells: DataFrame, asked: list[str], context: str | None = None, cell: float = 1.0) -> DataFrame:
    """([raster_id,] r, c, ...): each relief of `asked` as a column; topographic position and e4mstp as _red, _green and _blue.

    `context` names a preset. The sky view by direction takes the sky view's options, VAT its and the openness's radius.
    """
    if unknown := [n for n in asked if n not in NAMES]:
        raise ValueError(f"no such relief: {', '.join(unknown)}")
    own = preset(context) if context else {}
    p = {k: v | own.get(k, {}) for k, v in DEFAULTS.items()}
    if context:
        p["vat"] = {"svf": p["svf"]["radius"], "openness": p["openness"]["radius"]}
    by = [*keys(cells), "r", "c"]
    need = {
        "hillshade": {"hillshade": ("hillshade", {})},
        "slope": {"slope": ("slope", {})},
        "svf": {"svf": ("svf", p["svf"])},
        "asvf": {"asvf": ("asvf", p["svf"])},
        "openness_positive": {"openness_positive": ("openness", p["openness"])},
        "openness_negative": {"openness_negative": ("openness", p["openness"] | {"negative": True})},
        "local_dominance": {"local_dominance": ("dominance", p["local_dominance"])},
        "vat": {"_hillshade": ("hillshade", MIX), "slope": ("slope", {}), "_openness": ("openness", {"radius": p["vat"]["openness"], "directions": 16}), "_svf": ("svf", {"radius": p["vat"]["svf"], "directions": 16})},
        "slrm": {"slrm": ("slrm", p["slrm"])},
        "red_relief": {"slope": ("slope", {}), "slrm": ("slrm", p["slrm"])},
        "e4mstp": E4,
    }
    tiles: dict[str, tuple[str, dict]] = {}
    for name in asked:
        tiles |= need.get(name, {})
    out = cells.select(*by, "z")
    if tiles:
        out = out.join(horizon.measures(cells, tiles, cell), by)
    if "tri" in asked:
        out = out.join(stencil.ruggedness(cells), by)
    if "mstp" in asked:
        out = out.join(windows.topographic_position(cells, **p["mstp"]).withColumnsRenamed({k: f"mstp_{k}" for k in COLOURS}), by)
    if "e4mstp" in asked:
        out = durable(out)
        out = out.join(e4(cells, out.select(*by, "z", *E4)).withColumnsRenamed({k: f"e4mstp_{k}" for k in COLOURS}), by)
    ranged = {"red_relief": {"slrm": "slrm", "slope": "slope"}, "vat": {"_hillshade": "hillshade", "slope": "slope", "_openness": "openness", "_svf": "svf"}}
    ranged = {k: v for k, v in ranged.items() if k in asked}
    if ranged:  # each layer's range in each raster, taken from the written layers
        out = with_bounds(out, list(dict.fromkeys(c for v in ranged.values() for c in v)))
    if "red_relief" in asked:
        out = blend.red_of(out, "red_relief")
    if "vat" in asked:
        layers = {f"{v}{e}": F.col(f"{k}{e}") for k, v in ranged["vat"].items() for e in ("", "_low", "_high")}
        made = blend.vat_of(out.select(F.struct(*out.columns).alias("_own"), *(x.alias(n) for n, x in layers.items())))
        out = made.select(*(F.col("_own")[c].alias(c) for c in out.columns), "vat")
    return out.select(*by, *(c for n in asked for c in ([f"{n}_{k}" for k in COLOURS] if n in ("mstp", "e4mstp") else [n])))


COLOURS = ("red", "green", "blue")
#: Measures of the composite by four scales (fixed values).
E4 = {
    "pos": ("openness", {"radius": 10}),
    "neg": ("openness", {"radius": 10, "negative": True}),
    "ld": ("dominance", {}),
    "steep": ("slope", {}),
    "svf_small": ("svf", {"radius": 10}),
    "svf_large": ("svf", {"radius": 50}),
}


def e4(cells: DataFrame, layers: DataFrame | None = None, radii: tuple[int, int, int] = (3, 20, 100), measures: dict | None = None, cell: float = 1.0) -> DataFrame:
    """(r, c, red, green, blue) of e4MSTP from heights, or from heights and their `layers` (r, c, z, pos, neg, ld, steep, svf_small, svf_large)."""
    by = [*keys(cells), "r", "c"]
    if layers is None:
        layers = cells.select(*by, "z").join(horizon.measures(cells, measures or E4, cell), by)
    scaled = layers.select(*by, "z", (F.col("pos") / 90).alias("pos"), (F.col("neg") / 90).alias("neg"), (F.col("ld") / 255).alias("ld"), (F.col("steep") / 90).alias("slope"), "svf_small", "svf_large")
    places = windows.topographic_position(cells, *radii).withColumnsRenamed({k: f"mstp_{k}" for k in COLOURS})
    return blend.e4mstp(scaled.join(places, by))
