"""The registered terrain queries, each over a whole driver table, and the SQL that DuckDB checks them by."""

from __future__ import annotations

import json
import math
import os
import uuid

import numpy as np
from pyspark.sql import functions as F

from tellur.functions import projection as J
from tellur.functions import recipes
from tellur.operators import batch
from tellur.operators import blend as B
from tellur.operators import change as C
from tellur.operators import detect as D
from tellur.operators import field as L
from tellur.operators import horizon as H
from tellur.operators import points as P
from tellur.operators import stages
from tellur.operators import stencil as S
from tellur.operators import windows as W
from tellur.operators.ranges import with_bounds
from tellur.registry import oracle_sql, query
from tellur.sinks import geopackage, rasters
from tellur.sources import cells as X
from tellur.sources import geotiff, las
from tellur.sources.durable import shared_folder


def rounded(df, digits: int = 6):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def register(name: str, sql: str | None, make, digits: int = 6):
    query(name, sql)(lambda spark, sf_dir: rounded(make(spark, sf_dir), digits))


# --- 3x3 stencils ---------------------------------------------------------------------------------------------------

STENCIL = f"""WITH {X.SQL},
m AS (SELECT avg(z) AS mean FROM {{table}}),
f AS (SELECT r, c, z, {{fill}} AS x FROM {{table}}, m),
a AS (SELECT r, c, z, x AS m, coalesce(lag(struct_pack(v := x)) OVER h, struct_pack(v := x)).v AS w, coalesce(lead(struct_pack(v := x)) OVER h, struct_pack(v := x)).v AS e
      FROM f WINDOW h AS (PARTITION BY r ORDER BY c)),
s AS (SELECT r, c, z, struct_pack(w := w, m := m, e := e) AS k FROM a),
u AS (SELECT r, c, z, k, coalesce(lag(k) OVER v, k) AS u, coalesce(lead(k) OVER v, k) AS d FROM s WINDOW v AS (PARTITION BY c ORDER BY r)),
nb AS (SELECT r, c, z, u.w AS nw, u.m AS n, u.e AS ne, k.w AS w, k.m AS m, k.e AS e, d.w AS sw, d.m AS s, d.e AS se FROM u),
g AS (SELECT *, ((ne + 2 * e + se) - (nw + 2 * w + sw)) / 8.0::DOUBLE AS dx, ((sw + 2 * s + se) - (nw + 2 * n + ne)) / 8.0::DOUBLE AS dy,
      (e - w) / 2.0::DOUBLE AS fx, (s - n) / 2.0::DOUBLE AS fy FROM nb)
"""


def stencil_sql(value: str, name: str, table: str = "dem_nd", fill: str = "coalesce(z, mean)") -> str:
    return STENCIL.format(table=table, fill=fill) + f"SELECT r, c, CASE WHEN z IS NOT NULL THEN round({value}, 6) END AS {name} FROM g"


def shade_sql(azimuth: float, altitude: float) -> str:
    zenith, az = math.radians(90 - altitude), math.radians((360 - azimuth % 360 + 90) % 360)
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, cos(atan(sqrt(dx*dx+dy*dy))) * {math.cos(zenith)!r}::DOUBLE + sin(atan(sqrt(dx*dx+dy*dy))) * {math.sin(zenith)!r}::DOUBLE * cos({az!r}::DOUBLE - atan2(-dy, dx))))"


SLOPE = "degrees(atan(sqrt(dx * dx + dy * dy)))"
AZIMUTHS = (315, 45, 135, 225, 270, 0)
SHADE = f"({' + '.join(shade_sql(a, 45) for a in AZIMUTHS)}) / 6 * 255"
TRI = "sqrt(" + " + ".join(f"coalesce(({x} - m) * ({x} - m), 0)" for x in ("nw", "n", "ne", "w", "e", "sw", "s", "se")) + ")"

register("slope", stencil_sql(SLOPE, "slope"), lambda s, d: S.slope(X.dem_nd(s, d)))
register("slope_percent", stencil_sql("sqrt(dx * dx + dy * dy) * 100", "slope"), lambda s, d: S.slope(X.dem_nd(s, d), "percent"))
register("slope_finite_difference", stencil_sql("degrees(atan(sqrt(fx * fx + fy * fy)))", "slope"), lambda s, d: S.slope(X.dem_nd(s, d), method="finite_difference"))
register("hillshade", stencil_sql(SHADE, "hillshade"), lambda s, d: S.hillshade(X.dem_nd(s, d)))
register("hillshade_single", stencil_sql(shade_sql(315, 45) + " * 255", "hillshade"), lambda s, d: S.hillshade(X.dem_nd(s, d), (315,)))
register(
    "hillshade_bands",
    STENCIL.format(table="dem", fill="z") + f"SELECT r, c, {', '.join(f'round({shade_sql(360 * i / 8, 35)}, 6) AS b{i}' for i in range(8))} FROM g",
    lambda s, d: S.hillshade_bands(X.dem(s, d), 8).select("r", "c", *(F.col("bands")[i].alias(f"b{i}") for i in range(8))),
)
register("ruggedness", stencil_sql(TRI, "tri", fill="z"), lambda s, d: S.ruggedness(X.dem_nd(s, d)))

# --- windows --------------------------------------------------------------------------------------------------------

_N = "(SELECT max(r) AS r, max(c) AS c FROM {t})"


def relief_sql(table: str, radius: int) -> str:
    """The box mean by prefix sums along each axis, mirrored at the ends."""
    return f"""
mm AS (SELECT avg(z) AS mean, max(r) AS lr, max(c) AS lc FROM {table}),
ff AS (SELECT r, c, z, coalesce(z, mean) AS x FROM {table}, mm),
o AS (SELECT unnest(range(-{radius}, {radius + 1})) AS k),
bx AS (SELECT f.r, f.c, sum(g.x) AS x FROM ff f, o, mm, ff g WHERE g.r = f.r AND g.c = CASE WHEN f.c + k < 0 THEN -1 - f.c - k WHEN f.c + k > lc THEN 2 * lc + 1 - f.c - k ELSE f.c + k END GROUP BY 1, 2),
by_ AS (SELECT f.r, f.c, sum(g.x) / {(2 * radius + 1) ** 2}::DOUBLE AS mean FROM bx f, o, mm, bx g WHERE g.c = f.c AND g.r = CASE WHEN f.r + k < 0 THEN -1 - f.r - k WHEN f.r + k > lr THEN 2 * lr + 1 - f.r - k ELSE f.r + k END GROUP BY 1, 2),
slrm AS (SELECT r, c, ff.z - mean AS slrm FROM ff JOIN by_ USING (r, c))"""


register("local_relief", f"WITH {X.SQL}, {relief_sql('dem_nd', 5)} SELECT r, c, round(slrm, 6) AS slrm FROM slrm", lambda s, d: W.local_relief(X.dem_nd(s, d), 5))


def position_sql(radii: tuple[int, int, int]) -> str:
    def sums(of: str, q: int, by: str, along: str) -> str:
        return f"sum({of}) OVER (PARTITION BY {by} ORDER BY {along} ROWS BETWEEN {q} PRECEDING AND {q} FOLLOWING)"

    first = ", ".join(f"{sums('x', q, 'r', 'c')} AS s{q}, {sums('x * x', q, 'r', 'c')} AS q{q}, {sums('1.0::DOUBLE', q, 'r', 'c')} AS n{q}" for q in radii)
    second = ", ".join(f"{sums(f'{k}{q}', q, 'c', 'r')} AS {k}{q}" for q in radii for k in "sqn")
    dev = lambda q: f"CASE WHEN sqrt(greatest(0, q{q}/n{q} - (s{q}/n{q})*(s{q}/n{q}))) < 0.001 THEN 0 ELSE (x - s{q}/n{q}) / sqrt(greatest(0, q{q}/n{q} - (s{q}/n{q})*(s{q}/n{q}))) END"
    rgb = ", ".join(f"CASE WHEN z IS NULL THEN 0 ELSE floor(round(least(255.0::DOUBLE, greatest(0.0::DOUBLE, 127 + ({dev(q)}) * 50)), 4))::INT END AS {n}" for n, q in zip(("blue", "green", "red"), radii, strict=True))
    return f"""pm AS (SELECT avg(z) AS mean FROM dem_nd), p0 AS (SELECT r, c, z, coalesce(z, mean) AS x FROM dem_nd, pm), p1 AS (SELECT r, c, z, x, {first} FROM p0), p2 AS (SELECT r, c, z, x, {second} FROM p1),
mstp AS (SELECT r, c, {rgb} FROM p2)"""


register("topographic_position", f"WITH {X.SQL}, {position_sql((3, 10, 40))} SELECT r, c, red, green, blue FROM mstp", lambda s, d: W.topographic_position(X.dem_nd(s, d), 3, 10, 40))

#: The layers of the red relief, by one pass.
_RELIEF = {"slrm": ("slrm", {"radius": 5}), "slope": ("slope", {})}

_G = STENCIL.format(table="dem_nd", fill="coalesce(z, mean)")
register(
    "red_relief",
    f"""{_G}, {relief_sql('dem_nd', 5)},
l AS (SELECT r, c, slrm, CASE WHEN g.z IS NOT NULL THEN {SLOPE} END AS slope FROM g JOIN slrm USING (r, c)),
b AS (SELECT min(slrm) AS a0, max(slrm) AS a1, min(slope) AS b0, max(slope) AS b1 FROM l),
n AS (SELECT r, c, (slrm - a0) / (a1 - a0) AS a, 1 - (slope - b0) / (b1 - b0) AS b FROM l, b)
SELECT r, c, round((a * b * 0.5 + 0.5 * a) * 255, 6) AS red FROM n""",
    lambda s, d: B.red_relief(H.measures(X.dem_nd(s, d), _RELIEF)),
)

# --- horizons -------------------------------------------------------------------------------------------------------


def horizon_sql(name: str, directions: int, radius: int, floor: int, sign: str = "") -> str:
    """Each cell against each sample of each direction, out of the raster as the mean."""
    v = ", ".join(f"({i}, {a}, {b}, {d!r}::DOUBLE)" for i, ray in enumerate(H.rays(directions, radius)) for a, b, d in ray)
    return f"""
{name}_o(dir, dr, dc, dist) AS (VALUES {v}),
{name}_m AS (SELECT avg(z) AS mean FROM dem_nd),
{name}_f AS (SELECT r, c, z, {sign}coalesce(z, mean) AS x, {sign}mean AS mean FROM dem_nd, {name}_m),
{name}_j AS (SELECT f.r, f.c, o.dir, greatest({floor}, max((coalesce(g.x, f.mean) - f.x) / sqrt((coalesce(g.x, f.mean) - f.x) * (coalesce(g.x, f.mean) - f.x) + o.dist * o.dist))) AS s
  FROM {name}_f f CROSS JOIN {name}_o o LEFT JOIN {name}_f g ON g.r = f.r + o.dr AND g.c = f.c + o.dc WHERE f.z IS NOT NULL GROUP BY 1, 2, 3)"""


def with_nodata(inner: str, value: str, name: str) -> str:
    return f"SELECT d.r, d.c, round(v.{value}, 6) AS {name} FROM dem_nd d LEFT JOIN ({inner}) v USING (r, c)"


register("sky_view", f"WITH {X.SQL}, {horizon_sql('h', 16, 10, 0)} " + with_nodata("SELECT r, c, 1 - avg(s) AS v FROM h_j GROUP BY 1, 2", "v", "svf"), lambda s, d: H.sky_view(X.dem_nd(s, d)))
_w = " + ".join(f"CASE WHEN dir = {i} THEN {1 + 0.5 * math.cos(math.radians(315) - 2 * math.pi * i / 16)!r}::DOUBLE ELSE 0 END" for i in range(16))
register("sky_view_anisotropic", f"WITH {X.SQL}, {horizon_sql('h', 16, 10, 0)} " + with_nodata(f"SELECT r, c, sum((1 - s) * ({_w})) / sum({_w}) AS v FROM h_j GROUP BY 1, 2", "v", "asvf"), lambda s, d: H.anisotropic_sky_view(X.dem_nd(s, d)))
for _name, _sign in (("openness_positive", ""), ("openness_negative", "-")):
    register(
        _name,
        f"WITH {X.SQL}, {horizon_sql('h', 8, 10, -1, _sign)} " + with_nodata("SELECT r, c, avg(90 - degrees(asin(s))) AS v FROM h_j GROUP BY 1, 2", "v", "openness"),
        lambda s, d, neg=bool(_sign): H.openness(X.dem_nd(s, d), neg, 8, 10),
    )
register("sky_view_filtered", None, lambda s, d: H.sky_view(X.dem_nd(s, d), noise=2))
_ld = ", ".join(f"({a}, {b}, {float(q)!r}::DOUBLE)" for a, b, q in H.dominance_offsets(5, 10, 1, 30))
register(
    "local_dominance",
    f"""WITH {X.SQL}, o(dr, dc, q) AS (VALUES {_ld}), e AS (SELECT max(r) AS lr, max(c) AS lc FROM dem_nd),
v AS (SELECT f.r, f.c, avg(atan((f.z + 1.7::DOUBLE - g.z) / q)) AS v FROM dem_nd f CROSS JOIN o CROSS JOIN e JOIN dem_nd g ON g.r = least(lr, greatest(0, f.r + dr)) AND g.c = least(lc, greatest(0, f.c + dc))
  WHERE f.z IS NOT NULL AND g.z IS NOT NULL GROUP BY 1, 2)
SELECT d.r, d.c, CASE WHEN v IS NOT NULL THEN round(least(255.0::DOUBLE, greatest(0.0::DOUBLE, (v - 0.5) / 1.3::DOUBLE * 255)), 6) END AS dominance FROM dem_nd d LEFT JOIN v USING (r, c)""",
    lambda s, d: H.local_dominance(X.dem_nd(s, d), 5, 10, 1, 30),
)


def _layers(s, d, directions: int = 8, radius: int = 10):
    """Shade, slope, openness and sky view of the raster with nodata, by one pass over its tiles."""
    rays = {"directions": directions, "radius": radius}
    return H.measures(X.dem_nd(s, d), {"hillshade": ("hillshade", {"azimuths": (315, 45, 135, 225)}), "slope": ("slope", {}), "openness": ("openness", rays), "svf": ("svf", rays)})


_SHADE4 = f"({' + '.join(shade_sql(a, 45) for a in (315, 45, 135, 225))}) / 4 * 255"


def _over(a: str, b: str, blended: str, opacity: float) -> str:
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({blended.format(a=a, b=b)}) * {opacity} + {1 - opacity} * {a}))"


def vat_sql(directions: int, radius: int) -> str:
    return f"""{_G}, {horizon_sql('h', directions, radius, 0)}, {horizon_sql('p', directions, radius, -1)},
l AS (SELECT g.r, g.c, CASE WHEN g.z IS NOT NULL THEN {_SHADE4} END AS hs, CASE WHEN g.z IS NOT NULL THEN {SLOPE} END AS sl, o.o, v.v FROM g
  LEFT JOIN (SELECT r, c, avg(90 - degrees(asin(s))) AS o FROM p_j GROUP BY 1, 2) o USING (r, c) LEFT JOIN (SELECT r, c, 1 - avg(s) AS v FROM h_j GROUP BY 1, 2) v USING (r, c)),
b AS (SELECT min(hs) h0, max(hs) h1, min(sl) s0, max(sl) s1, min(o) o0, max(o) o1, min(v) v0, max(v) v1 FROM l),
n AS (SELECT r, c, (hs-h0)/(h1-h0) AS h, 1-(sl-s0)/(s1-s0) AS s, (o-o0)/(o1-o0) AS o, (v-v0)/(v1-v0) AS v FROM l, b),
x AS (SELECT *, {_over('h', 's', '{a} * {b}', 0.5)} AS x FROM n),
y AS (SELECT *, {_over('x', 'o', 'CASE WHEN {a} < 0.5 THEN 2 * {a} * {b} ELSE 1 - 2 * (1 - {a}) * (1 - {b}) END', 0.5)} AS y FROM x)
SELECT r, c, CASE WHEN h IS NOT NULL THEN round(({_over('y', 'v', '{a} * {b}', 0.5)}) * 255, 6) END AS vat FROM y"""


register("vat", vat_sql(8, 10), lambda s, d: B.vat(_layers(s, d)))
register("vat_full", vat_sql(16, 50), lambda s, d: B.vat(_layers(s, d, 16, 50)))
register("principal_components", None, lambda s, d: B.principal(_layers(s, d), ["hillshade", "slope", "openness", "svf"]))



def dominance_sql(name: str, least: int, most: int, angle: float, height: float = 1.7) -> str:
    v = ", ".join(f"({a}, {b}, {float(q)!r}::DOUBLE)" for a, b, q in H.dominance_offsets(least, most, 1, angle))
    return f"""
{name}_o(dr, dc, q) AS (VALUES {v}), {name}_e AS (SELECT max(r) AS lr, max(c) AS lc FROM dem_nd),
{name}_k AS MATERIALIZED (SELECT f.r, f.c, f.z, q, least(lr, greatest(0, f.r + dr)) AS gr, least(lc, greatest(0, f.c + dc)) AS gc FROM dem_nd f, {name}_o, {name}_e WHERE f.z IS NOT NULL),
{name}_v AS (SELECT k.r, k.c, avg(atan((k.z + {height}::DOUBLE - g.z) / q)) AS v FROM {name}_k k JOIN dem_nd g ON g.r = gr AND g.c = gc WHERE g.z IS NOT NULL GROUP BY 1, 2),
{name} AS (SELECT d.r, d.c, least(255.0::DOUBLE, greatest(0.0::DOUBLE, (v - 0.5) / 1.3::DOUBLE * 255)) AS dominance FROM dem_nd d JOIN {name}_v v USING (r, c))"""


_unit = lambda x: f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {x}))"
_sky = f"({_unit('(coalesce(f.v, 1) - 0.9) / 0.1')} + 0.5 * {_unit('(coalesce(n.v, 1) - 0.7) / 0.3')}) / 1.5"
_E4 = ", ".join(
    f"floor(round(least(255.0::DOUBLE, greatest(0.0::DOUBLE, ((CASE WHEN {x} < 0.5 THEN 2 * {x} * {m} / 255 ELSE 1 - 2 * (1 - {x}) * (1 - {m} / 255) END) * 0.9 + {x} * 0.1) * 255)), 6))::INT AS {k}"
    for k, x, m in (("red", "x1", "mr"), ("green", "x2", "mg"), ("blue", "x2", "mb"))
)
register(
    "e4mstp",
    f"""{_G}, {position_sql((3, 20, 100))}, {horizon_sql('p', 16, 10, -1)}, {horizon_sql('n', 16, 10, -1, '-')}, {horizon_sql('l', 16, 50, 0)}, {dominance_sql('ld', 10, 20, 15)},
po AS (SELECT r, c, avg(90 - degrees(asin(s))) AS v FROM p_j GROUP BY 1, 2), ne AS (SELECT r, c, avg(90 - degrees(asin(s))) AS v FROM n_j GROUP BY 1, 2),
near AS (SELECT r, c, 1 - avg(greatest(0, s)) AS v FROM p_j GROUP BY 1, 2), far AS (SELECT r, c, 1 - avg(s) AS v FROM l_j GROUP BY 1, 2),
k AS (SELECT g.r, g.c, CASE WHEN g.z IS NOT NULL THEN {SLOPE} / 90 END AS s, po.v / 90 * (ne.v / 90) * (ld.dominance / 255) AS tex, {_sky} AS sky, m.red AS mr, m.green AS mg, m.blue AS mb
  FROM g JOIN mstp m USING (r, c) LEFT JOIN po USING (r, c) LEFT JOIN ne USING (r, c) LEFT JOIN ld USING (r, c) LEFT JOIN near n USING (r, c) LEFT JOIN far f USING (r, c)),
x AS (SELECT *, {_unit('coalesce(s, 0)')} * (sky * 0.25 + 0.75) AS x1, {_unit('coalesce(tex * (1 - s), 0)')} * (sky * 0.25 + 0.75) AS x2 FROM k)
SELECT r, c, {_E4} FROM x""",
    lambda s, d: batch.e4(X.dem_nd(s, d)),
)
for _name, _sign in (("openness_positive_full", ""), ("openness_negative_full", "-")):
    register(_name, f"WITH {X.SQL}, {horizon_sql('h', 16, 20, -1, _sign)} " + with_nodata("SELECT r, c, avg(90 - degrees(asin(s))) AS v FROM h_j GROUP BY 1, 2", "v", "openness"), lambda s, d, neg=bool(_sign): H.openness(X.dem_nd(s, d), neg))
register("local_dominance_full", f"WITH {X.SQL}, {dominance_sql('ld', 10, 20, 15)} SELECT d.r, d.c, round(dominance, 6) AS dominance FROM dem_nd d LEFT JOIN ld USING (r, c)", lambda s, d: H.local_dominance(X.dem_nd(s, d)))
register("local_relief_full", f"WITH {X.SQL}, {relief_sql('dem_nd', 20)} SELECT r, c, round(slrm, 6) AS slrm FROM slrm", lambda s, d: W.local_relief(X.dem_nd(s, d)))
register("topographic_position_full", f"WITH {X.SQL}, {position_sql((5, 50, 500))} SELECT r, c, red, green, blue FROM mstp", lambda s, d: W.topographic_position(X.dem_nd(s, d)))
register("sky_view_anisotropic_filtered", None, lambda s, d: H.anisotropic_sky_view(X.dem_nd(s, d), noise=2))
_mirror = lambda x, last: f"least((({x}) % (2 * {last}) + 2 * {last}) % (2 * {last}), 2 * {last} - (({x}) % (2 * {last}) + 2 * {last}) % (2 * {last}))"
register(
    "openness_reflected",
    f"""WITH {X.SQL}, o(dir, dr, dc, dist) AS (VALUES {", ".join(f"({i}, {a}, {b}, {q!r}::DOUBLE)" for i, ray in enumerate(H.rays(8, 10)) for a, b, q in ray)}),
e AS (SELECT avg(z) AS mean, max(r) AS lr, max(c) AS lc FROM dem_nd), f AS (SELECT r, c, z, coalesce(z, mean) AS x, lr, lc FROM dem_nd, e),
j AS (SELECT f.r, f.c, o.dir, max((g.x - f.x) / sqrt((g.x - f.x) * (g.x - f.x) + o.dist * o.dist)) AS s FROM f CROSS JOIN o
  JOIN f g ON g.r = {_mirror('f.r + o.dr', 'f.lr')} AND g.c = {_mirror('f.c + o.dc', 'f.lc')} WHERE f.z IS NOT NULL GROUP BY 1, 2, 3) """
    + with_nodata("SELECT r, c, avg(90 - degrees(asin(s))) AS v FROM j GROUP BY 1, 2", "v", "openness"),
    lambda s, d: H.openness(X.dem_nd(s, d), False, 8, 10, edge="reflect"),
)
_S = {"s": ("0.7", "0.3"), "l": ("0.9", "0.1")}
register(
    "sky_view_stretched",
    f"""WITH {X.SQL}, {horizon_sql('h', 16, 10, 0)}, v AS (SELECT r, c, 1 - avg(s) AS v FROM h_j GROUP BY 1, 2)
SELECT d.r, d.c, {', '.join(f"CASE WHEN v IS NOT NULL THEN round({_unit(f'(v - {a}) / {b}')}, 6) END AS {k}" for k, (a, b) in _S.items())} FROM dem_nd d LEFT JOIN v USING (r, c)""",
    lambda s, d: H.sky_view(X.dem_nd(s, d)).select("r", "c", *(B.clip((F.col("svf") - float(a)) / float(b)).alias(k) for k, (a, b) in _S.items())),
)

register(
    "batch_relief",
    f"""{_G}, {relief_sql('dem_nd', 8)}, {horizon_sql('p', 16, 5, -1)}, {dominance_sql('ld', 5, 10, 15, 1.0)},
po AS (SELECT r, c, avg(90 - degrees(asin(s))) AS v FROM p_j GROUP BY 1, 2),
k AS (SELECT g.r, g.c, CASE WHEN g.z IS NOT NULL THEN {SHADE} END AS hillshade, CASE WHEN g.z IS NOT NULL THEN {SLOPE} END AS slope, po.v AS openness_positive, ld.dominance AS local_dominance, slrm.slrm
  FROM g JOIN slrm USING (r, c) LEFT JOIN po USING (r, c) LEFT JOIN ld USING (r, c)),
b AS (SELECT min(slrm) AS a0, max(slrm) AS a1, min(slope) AS b0, max(slope) AS b1 FROM k),
n AS (SELECT k.*, (slrm - a0) / (a1 - a0) AS a, 1 - (slope - b0) / (b1 - b0) AS b FROM k, b)
SELECT r, c, {', '.join(f'round({x}, 6) AS {x}' for x in ('hillshade', 'slope', 'openness_positive', 'local_dominance', 'slrm'))}, round((a * b * 0.5 + 0.5 * a) * 255, 6) AS red_relief FROM n""",
    lambda s, d: batch.batch(X.dem_nd(s, d), ["hillshade", "slope", "openness_positive", "local_dominance", "slrm", "red_relief"], "upland_steep"),
)
register("batch_everything", None, lambda s, d: batch.batch(X.dem_nd(s, d), list(batch.NAMES), "forested"))

# --- statistics, blends, change -------------------------------------------------------------------------------------

register(
    "statistics",
    f"""WITH {X.SQL} SELECT round(min(z), 6) AS z_min, round(max(z), 6) AS z_max, round(avg(z), 6) AS z_mean, round(stddev_pop(z), 6) AS z_std,
{', '.join(f'round(quantile_cont(z, {p / 100}), 6) AS p{p}' for p in (5, 25, 50, 75, 95))}, count(z) AS n_valid, count(*) - count(z) AS n_nodata FROM dem_nd""",
    lambda s, d: C.statistics(X.dem_nd(s, d)),
)
register(
    "histogram",
    f"""WITH {X.SQL}, b AS (SELECT min(z) AS lo, max(z) AS hi FROM dem_nd),
h AS (SELECT least(99, floor((z - lo) / (hi - lo) * 100))::INT AS bin, count(*) AS n FROM dem_nd, b WHERE z IS NOT NULL GROUP BY 1)
SELECT bin, n, round(n / (SELECT max(n) FROM h)::DOUBLE, 6) AS height FROM h""",
    lambda s, d: C.histogram(X.dem_nd(s, d)),
)
register("display_range", f"WITH {X.SQL} SELECT round(greatest(min(z), avg(z) - 2 * stddev_pop(z)), 6) AS low, round(least(max(z), avg(z) + 2 * stddev_pop(z)), 6) AS high FROM dem_nd", lambda s, d: C.display_range(X.dem_nd(s, d)))


def _two(s, d):
    """Both epochs stretched to 0..255, as layers to blend."""
    out = []
    for z in (X.dem_nd(s, d), X.dem_new(s, d)):
        out.append(with_bounds(z, ["z"], write=False).select("r", "c", (B.stretched("z") * 255).alias("z")))
    return out


_BLEND = {
    "multiply": "a * b",
    "screen": "1 - (1 - a) * (1 - b)",
    "overlay": "CASE WHEN a < 0.5 THEN 2 * a * b ELSE 1 - 2 * (1 - a) * (1 - b) END",
    "soft_light": "(1 - 2 * b) * a * a + 2 * a * b",
}
for _mode, _sql in _BLEND.items():
    register(
        f"blend_{_mode}",
        f"""WITH {X.SQL}, p AS (SELECT min(z) lo, max(z) hi FROM dem_nd), q AS (SELECT min(z) lo, max(z) hi FROM dem_new),
x AS (SELECT r, c, (n.z - p.lo) / (p.hi - p.lo) AS a, (w.z - q.lo) / (q.hi - q.lo) AS b FROM dem_nd n JOIN dem_new w USING (r, c), p, q)
SELECT r, c, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({_sql}) * 0.7 + 0.3 * a)) * 255, 6) END AS blend FROM x""",
        lambda s, d, m=_mode: B.blend(*_two(s, d), m, 0.7),
    )

_DOD = f"""WITH {X.SQL}, d AS (SELECT o.r, o.c, n.z - o.z AS dod FROM dem_nd o LEFT JOIN dem_new n USING (r, c)),
k AS (SELECT r, c, dod, CASE WHEN dod IS NULL THEN 255 WHEN dod < -{C.detection_level()!r}::DOUBLE THEN 1 WHEN dod > {C.detection_level()!r}::DOUBLE THEN 2 ELSE 0 END AS mask FROM d) """
register("difference", _DOD + "SELECT r, c, round(dod, 6) AS dod, mask FROM k", lambda s, d: C.difference(X.dem_nd(s, d), X.dem_new(s, d)))
register(
    "difference_report",
    _DOD
    + """SELECT count(*) FILTER (mask <> 255) AS n_valid, count(*) FILTER (mask IN (1, 2)) AS n_significant, count(*) FILTER (mask = 1) AS n_lower, count(*) FILTER (mask = 2) AS n_higher,
round(coalesce(sum(-dod) FILTER (mask = 1), 0), 4) AS cut, round(coalesce(sum(dod) FILTER (mask = 2), 0), 4) AS fill,
round(coalesce(sum(dod) FILTER (mask = 2), 0) - coalesce(sum(-dod) FILTER (mask = 1), 0), 4) AS net FROM k""",
    lambda s, d: C.report(C.difference(X.dem_nd(s, d), X.dem_new(s, d))),
)

_KINDS = {
    "average": "avg(z)", "min": "min(z)", "max": "max(z)", "sum": "sum(z)", "med": "quantile_cont(z, 0.5)", "q1": "quantile_cont(z, 0.25)", "q3": "quantile_cont(z, 0.75)", "rms": "sqrt(avg(z * z))", "nearest": "arg_min(z, (power(r % 4 - 1.5, 2) + power(c % 4 - 1.5, 2)) * 1000 - r % 4 * 4 - c % 4)",
}
for _kind, _sql in _KINDS.items():
    register(f"resample_{_kind}", f"WITH {X.SQL} SELECT (r // 4)::INT AS r, (c // 4)::INT AS c, round({_sql}, 6) AS z FROM dem GROUP BY 1, 2".replace("GROUP BY 1, 2", "GROUP BY dem.r // 4, dem.c // 4"), lambda s, d, k=_kind: C.resample(X.dem(s, d), 4, k))
register(
    "resample_mode",
    f"WITH {X.SQL}, k AS (SELECT r // 4 AS r, c // 4 AS c, floor(z / 10) AS z, count(*) AS n FROM dem GROUP BY 1, 2, 3) SELECT r::INT AS r, c::INT AS c, z FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY n DESC, z) AS q FROM k) WHERE q = 1".replace("GROUP BY 1, 2, 3", "GROUP BY dem.r // 4, dem.c // 4, floor(dem.z / 10)"),
    lambda s, d: C.resample(X.dem(s, d).withColumn("z", F.floor(F.col("z") / 10).cast("double")), 4, "mode"),
)
register(
    "pyramid",
    " UNION ALL ".join(f"SELECT {i} AS level, ((event_id // 100) // {2**i})::INT AS r, ((event_id % 100) // {2**i})::INT AS c, round(avg(value), 9) AS z FROM events GROUP BY ALL" for i in (1, 2, 3)),
    lambda s, d: C.pyramid(X.dem(s, d), 3),
    9,
)


def bilinear_sql(table: str, step: str, r0: str, c0: str, rows: str, cols: str, z: str = "z") -> str:
    """(r, c, v): the four cells around each target, those that exist weighed anew."""
    return f"""
t AS (SELECT a.r, b.c, {r0} + {step} * a.r AS y, {c0} + {step} * b.c AS x FROM (SELECT unnest(range(0, {rows})) AS r) a, (SELECT unnest(range(0, {cols})) AS c) b),
k AS (SELECT r, c, floor(y)::INT + i AS sr, floor(x)::INT + j AS sc, (CASE WHEN i = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN j = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w
  FROM t, (VALUES (0), (1)) i(i), (VALUES (0), (1)) j(j)),
bl AS (SELECT k.r::INT AS r, k.c::INT AS c, sum(w * {z})::DOUBLE / sum(w)::DOUBLE AS v FROM k JOIN {table} g ON g.r = sr AND g.c = sc WHERE {z} IS NOT NULL AND w > 0 GROUP BY 1, 2)"""


_last = lambda axis, step, o: f"(SELECT floor((max({axis}) - {o}) / {step})::BIGINT + 1 FROM dem_nd)"
register(
    "resample_bilinear",
    f"WITH {X.SQL}, {bilinear_sql('dem_nd', '1.5', '0.25', '0.25', _last('r', 1.5, 0.25), _last('c', 1.5, 0.25))} SELECT r, c, round(v, 6) AS z FROM bl",
    lambda s, d: C.bilinear(X.dem_nd(s, d), 1.5, 0.25, 0.25),
)


def _grid(s, d, x0: float = 0.0, y0: float = 0.0, px: float = 1.0, table=X.dem_nd) -> dict:
    """A grid of the raster's rows and columns, its corner at (x0, y0), rows running down."""
    said = table(s, d).agg(F.max("r").alias("r"), F.max("c").alias("c")).first()
    return {"x0": x0, "y0": y0, "px_w": px, "px_h": -px, "rows": (said.r or 0) + 1, "cols": (said.c or 0) + 1}


register(
    "difference_shifted",
    f"""WITH {X.SQL}, {bilinear_sql('dem_new', '1', '-0.25', '0.5', '(SELECT max(r) + 1 FROM dem_nd)', '(SELECT max(c) + 1 FROM dem_nd)')},
d AS (SELECT o.r, o.c, b.v - o.z AS dod FROM dem_nd o LEFT JOIN bl b USING (r, c))
SELECT r, c, round(dod, 6) AS dod, CASE WHEN dod IS NULL THEN 255 WHEN dod < -{C.detection_level()!r}::DOUBLE THEN 1 WHEN dod > {C.detection_level()!r}::DOUBLE THEN 2 ELSE 0 END AS mask FROM d""",
    lambda s, d: C.difference(X.dem_nd(s, d), C.aligned(X.dem_new(s, d), _grid(s, d, -0.5, -0.25), _grid(s, d))),
)
#: A corner in zone 31 near its eastern border, and the same place in zone 32, for the reprojected epoch.
_CORNER = {"EPSG:32631": (700_000.0, 5_000_000.0), "EPSG:32632": (228_120.0, 5_002_670.0)}


def _turned_sql(source: str, target: str, x: str, y: str) -> str:
    """(lon, lat), then (x, y) of the target, as a chain of FROM clauses over a relation `t` with columns r, c and the expressions x, y."""
    (lon0, _), (lon1, _) = J.zone(source), J.zone(target)
    k = repr(J._MERIDIAN) + "::DOUBLE"
    sums = lambda cs, f, g, u, v, sign: "".join(f" {sign} {c!r}::DOUBLE * {f}({2 * j} * {u}) * {g}({2 * j} * {v})" for j, c in enumerate(cs, 1))
    return f"""
t1 AS (SELECT *, ({y}) / {k} AS up, (({x}) - 500000) / {k} AS outw FROM t),
t2 AS (SELECT *, up{sums(J.FROM_PLANE, 'sin', 'cosh', 'up', 'outw', '-')} AS xi, outw{sums(J.FROM_PLANE, 'cos', 'sinh', 'up', 'outw', '-')} AS eta FROM t1),
t3 AS (SELECT *, asin(sin(xi) / cosh(eta)) AS chi FROM t2),
t4 AS (SELECT *, degrees({lon0!r}::DOUBLE + atan2(sinh(eta), cos(xi))) AS lon, degrees(chi{''.join(f' + {d!r}::DOUBLE * sin({2 * j} * chi)' for j, d in enumerate(J.TO_GEODETIC, 1))}) AS lat FROM t3),
t5 AS (SELECT *, sin(radians(lat)) AS s, radians(lon) - {lon1!r}::DOUBLE AS d FROM t4),
t6 AS (SELECT *, sinh(atanh(s) - {J._ECCENTRICITY!r}::DOUBLE * atanh({J._ECCENTRICITY!r}::DOUBLE * s)) AS q FROM t5),
t7 AS (SELECT *, atan2(q, cos(d)) AS up2, atanh(sin(d) / sqrt(1 + q * q)) AS out2 FROM t6),
t8 AS (SELECT r, c, 500000 + {k} * (out2{sums(J.TO_PLANE, 'cos', 'sinh', 'up2', 'out2', '+')}) AS x, {k} * (up2{sums(J.TO_PLANE, 'sin', 'cosh', 'up2', 'out2', '+')}) AS y FROM t7)"""


_OLD, _NEW = _CORNER["EPSG:32631"], _CORNER["EPSG:32632"]
register(
    "difference_reprojected",
    f"""WITH {X.SQL}, g AS (SELECT max(r) + 1 AS rows, max(c) + 1 AS cols FROM dem_nd), t AS (SELECT r, c FROM dem_nd),
{_turned_sql('EPSG:32631', 'EPSG:32632', f'{_OLD[0]!r}::DOUBLE + (c + 0.5) * 2', f'{_OLD[1]!r}::DOUBLE - (r + 0.5) * 2')},
w AS (SELECT r, c, (y - {_NEW[1]!r}::DOUBLE) / -2.05::DOUBLE - 0.5 AS u, (x - {_NEW[0]!r}::DOUBLE) / 2.2::DOUBLE - 0.5 AS v FROM t8),
k AS (SELECT r, c, floor(u)::INT + i AS sr, floor(v)::INT + j AS sc, (CASE WHEN i = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN j = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) AS wt
  FROM w, (VALUES (0), (1)) i(i), (VALUES (0), (1)) j(j)),
b AS (SELECT k.r, k.c, sum(wt * z) / sum(wt) AS z FROM k JOIN dem_new n ON n.r = sr AND n.c = sc WHERE z IS NOT NULL AND wt > 0 GROUP BY k.r, k.c),
d AS (SELECT o.r, o.c, b.z - o.z AS dod FROM dem_nd o LEFT JOIN b USING (r, c))
SELECT r, c, round(dod, 3) AS dod, CASE WHEN dod IS NULL THEN 255 WHEN dod < -{C.detection_level()!r}::DOUBLE THEN 1 WHEN dod > {C.detection_level()!r}::DOUBLE THEN 2 ELSE 0 END AS mask FROM d""",
    lambda s, d: C.difference(X.dem_nd(s, d), C.warped(X.dem_new(s, d), {"x0": _NEW[0], "y0": _NEW[1], "px_w": 2.2, "px_h": -2.05} | {k: v for k, v in _grid(s, d).items() if k in ("rows", "cols")}, "EPSG:32632", _grid(s, d, *_OLD, px=2.0), "EPSG:32631")),
    3,
)
register(
    "bands_coregistered",
    f"""WITH {X.SQL}, {bilinear_sql('bands', '0.5', '-0.25', '-0.25', '(SELECT max(r) + 1 FROM dem_nd)', '(SELECT max(c) + 1 FROM dem_nd)', 'b1')} SELECT r, c, round(v, 6) AS z FROM bl""",
    lambda s, d: C.aligned(X.bands(s, d).select("r", "c", F.col("b1").alias("z")), _grid(s, d, px=2.0, table=X.bands), _grid(s, d)),
)
register("stack", f"WITH {X.SQL} SELECT r, c, a.z AS b0, b.z AS b1, round(x.b1, 6) AS b2 FROM dem_nd a FULL JOIN dem_new b USING (r, c) FULL JOIN bands x USING (r, c)".replace("a.z AS b0, b.z AS b1", "round(a.z, 6) AS b0, round(b.z, 6) AS b1"),
    lambda s, d: C.stack([X.dem_nd(s, d), X.dem_new(s, d), X.bands(s, d).select("r", "c", F.col("b1").alias("z"))]).select("r", "c", *(F.col("bands")[i].alias(f"b{i}") for i in range(3))))
register(
    "mosaic",
    f"WITH {X.SQL} SELECT r, c, round(coalesce(a.z, b.b2), 6) AS z FROM dem_nd a FULL JOIN bands b USING (r, c)",
    lambda s, d: C.mosaic([X.bands(s, d).select("r", "c", F.col("b2").alias("z")), X.dem_nd(s, d)]),
)
_RELIEFS = {
    "svf": f"{_G}, {horizon_sql('h', 16, 10, 0)}, rel AS (SELECT r, c, 1 - avg(s) AS v FROM h_j GROUP BY 1, 2)",
    "local_dominance": f"{_G}, {dominance_sql('ld', 10, 20, 15)}, rel AS (SELECT r, c, dominance AS v FROM ld)",
    "slope": f"{_G}, rel AS (SELECT r, c, {SLOPE} AS v FROM g WHERE z IS NOT NULL)",
    "slrm": f"{_G}, {relief_sql('dem_nd', 20)}, rel AS (SELECT r, c, slrm AS v FROM slrm)",
}
_LIGHT = {
    "luminance": "l * (1 - {o}) + l * s * {o}",
    "overlay": "(1 - {o}) * s + {o} * (CASE WHEN l < 0.5 THEN 2 * l * s ELSE 1 - 2 * (1 - l) * (1 - s) END)",
    "multiply": "(1 - {o}) * s + {o} * (l * s)",
    "screen": "(1 - {o}) * s + {o} * (1 - (1 - l) * (1 - s))",
}
for _recipe, (_relief, _names, _mode, _opacity) in C.RECIPES.items():
    _light = _LIGHT[_mode].format(o=_opacity)
    _rgb = ", ".join(f"coalesce(floor(round(least(255.0::DOUBLE, greatest(0.0::DOUBLE, ({_light.replace('s', f's{i}')}) * 255)), 6))::INT, 0) AS {n}" for i, n in ((1, "red"), (2, "green"), (3, "blue")))
    register(
        f"fusion_{_recipe}",
        f"""{_RELIEFS[_relief]}, x AS (SELECT d.r, d.c, rel.v AS z, b1, b2, b3 FROM dem_nd d JOIN bands USING (r, c) LEFT JOIN rel USING (r, c)),
b AS (SELECT min(z) z0, max(z) z1, min(b1) a0, max(b1) a1, min(b2) c0, max(b2) c1, min(b3) d0, max(b3) d1 FROM x),
n AS (SELECT r, c, (z - z0) / (z1 - z0) AS l, (b1 - a0) / (a1 - a0) AS s1, (b2 - c0) / (c1 - c0) AS s2, (b3 - d0) / (d1 - d0) AS s3 FROM x, b)
SELECT r, c, {_rgb} FROM n""",
        lambda s, d, r=_recipe, n=_names: C.fused(X.dem_nd(s, d), X.bands(s, d).select("r", "c", *(F.col(b).alias(k) for b, k in zip(("b1", "b2", "b3"), n, strict=True))), r),
    )

# --- detections -----------------------------------------------------------------------------------------------------


def _outputs(s, d):
    """Orders as a detector's raw outputs, a scene of 1000 x 1000 pixels for each eight thousand, so that boxes overlap and pairs grow with the rows: centre, size, objectness, two class scores."""
    k, o = F.col("o_orderkey"), s.read.parquet(f"{d}/orders.parquet")
    v = [(k * 37 % 1000 + F.floor(k / 1000) % 8 * 2).cast("double"), (k * 91 % 1000).cast("double"), (k % 53 + 4).cast("double"), (k % 31 + 4).cast("double"), F.col("o_totalprice") / 500000, (k % 7) / F.lit(7.0), (k % 5) / F.lit(5.0)]
    return o.select(k.alias("id"), F.floor(k / 8000).alias("scene"), F.array(*v).alias("out"))


def _boxes(s, d):
    return D.decode(_outputs(s, d), 0.1).drop("scene")


_DETS = """WITH v AS (SELECT o_orderkey AS id, (o_orderkey * 37 % 1000 + o_orderkey // 1000 % 8 * 2)::DOUBLE AS cx, (o_orderkey * 91 % 1000)::DOUBLE AS cy, (o_orderkey % 53 + 4)::DOUBLE AS w, (o_orderkey % 31 + 4)::DOUBLE AS h,
  o_totalprice / 500000 AS o, (o_orderkey % 7) / 7.0::DOUBLE AS s0, (o_orderkey % 5) / 5.0::DOUBLE AS s1 FROM orders),
d AS (SELECT id, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2, o * greatest(s0, s1) AS confidence, CASE WHEN s0 >= s1 THEN 0 ELSE 1 END AS class_id FROM v),
k AS (SELECT * FROM d WHERE confidence >= 0.1 AND x2 > x1 AND y2 > y1) """
register("detections_decode", _DETS + "SELECT id, x1, y1, x2, y2, round(confidence, 9) AS confidence, class_id FROM k", _boxes, 9)
register(
    "detections_rescale",
    _DETS
    + """SELECT id, round(least(640, greatest(0, x1 * 640 / 1000)) + 100, 2) AS x1, round(least(480, greatest(0, y1 * 480 / 1000)) + 200, 2) AS y1, round(least(640, greatest(0, x2 * 640 / 1000)) + 100, 2) AS x2,
round(least(480, greatest(0, y2 * 480 / 1000)) + 200, 2) AS y2, round(confidence, 4) AS confidence, class_id, CASE class_id WHEN 0 THEN 'mound' ELSE 'class_1' END AS class_name FROM k""",
    lambda s, d: D.rescale(_boxes(s, d), 1000, F.lit(640.0), F.lit(480.0), F.lit(100.0), F.lit(200.0)).withColumn("class_name", D.label(F.col("class_id"), ["mound"])),
)
register(
    "detections_overlap",
    _DETS
    + """, p AS (SELECT a.id AS a, b.id AS b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2-a.x1)*(a.y2-a.y1) + (b.x2-b.x1)*(b.y2-b.y1) AS u
  FROM k a JOIN k b ON a.class_id = b.class_id AND a.id // 8000 = b.id // 8000 AND a.id < b.id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2)
SELECT a, b, round(i / (u - i), 6) AS iou FROM p WHERE i / (u - i) >= 0.3""",
    lambda s, d: D.overlaps(D.decode(_outputs(s, d), 0.1), 0.3, 32, by=("class_id", "scene")),
)
register("detections_suppress", None, lambda s, d: D.suppress(D.decode(_outputs(s, d), 0.1), 0.45, ("class_id", "scene")))
register(
    "detections_overlap_dense",
    _DETS
    + """, p AS (SELECT a.id AS a, b.id AS b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2-a.x1)*(a.y2-a.y1) + (b.x2-b.x1)*(b.y2-b.y1) AS u
  FROM k a JOIN k b ON a.class_id = b.class_id AND a.id < b.id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2)
SELECT a, b, round(i / (u - i), 6) AS iou FROM p WHERE i / (u - i) >= 0.3""",
    lambda s, d: D.overlaps(_boxes(s, d), 0.3, 32),
)
register("detections_suppress_dense", None, lambda s, d: D.suppress(_boxes(s, d), 0.45))
register(
    "detections_to_map",
    _DETS + "SELECT id, 500000 + x1 * 0.5 AS x1, 6000000 - y2 * 0.5 AS y1, 500000 + x2 * 0.5 AS x2, 6000000 - y1 * 0.5 AS y2, round(confidence, 9) AS confidence, class_id FROM k",
    lambda s, d: D.to_map(_boxes(s, d), (500000, 0.5, 0, 6000000, 0, -0.5)),
    9,
)

# --- points ---------------------------------------------------------------------------------------------------------


def _points(s, d):
    x = s.read.parquet(f"{d}/lineitem.parquet")
    return x.select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 100 + F.col("l_discount")).alias("x"), (F.col("l_suppkey") % 100 + F.col("l_tax")).alias("y"), (F.col("l_extendedprice") / 1000).alias("z"))


_POINTS = "WITH p AS (SELECT l_orderkey AS id, l_partkey % 100 + l_discount AS x, l_suppkey % 100 + l_tax AS y, l_extendedprice / 1000 AS z FROM lineitem), b AS (SELECT *, floor(y / 2)::INT AS r, floor(x / 2)::INT AS c FROM p) "
register("points_lowest", _POINTS + "SELECT r, c, round(min(z), 6) AS z, count(*) AS n FROM b GROUP BY 1, 2".replace("GROUP BY 1, 2", "GROUP BY b.r, b.c"), lambda s, d: P.lowest(_points(s, d), 2.0))
register(
    "points_inverse_distance",
    _POINTS
    + """, k AS (SELECT r + i AS r, c + j AS c, x, y, z FROM b, (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j)),
w AS (SELECT r, c, z, 1 / ((x - (c + 0.5) * 2) * (x - (c + 0.5) * 2) + (y - (r + 0.5) * 2) * (y - (r + 0.5) * 2) + 1) AS w FROM k)
SELECT r::INT AS r, c::INT AS c, round(sum(w * z) / sum(w), 6) AS z FROM w GROUP BY w.r, w.c""",
    lambda s, d: P.nearby_distance(_points(s, d), 2.0),
)
register("points_inverse_distance_all", None, lambda s, d: P.inverse_distance(_points(s, d), 2.0))


def ground_sql(kind: str) -> str:
    """Openings of growing windows on the dense grid of lowest points, by frames along both axes; missing cells take no part."""
    cell = P.GROUND[kind][4]
    parts, last = [], "s0"
    for n, (k, _) in enumerate(P.steps(kind), 1):
        for step, (f, of) in enumerate((("min", last), ("max", f"e{n}"))):
            frame = f"ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING"
            parts.append(f"{f[:2]}{n} AS (SELECT r, c, z0, {f}(z) OVER (PARTITION BY r ORDER BY c {frame}) AS z FROM {of})")
            parts.append(f"{'es'[step]}{n} AS (SELECT r, c, z0, CASE WHEN z0 IS NOT NULL THEN {f}(z) OVER (PARTITION BY c ORDER BY r {frame}) END AS z FROM {f[:2]}{n})")
        last = f"s{n}"
    most = ", ".join(f"s{n}.z + {limit!r}::DOUBLE" for n, (_, limit) in enumerate(P.steps(kind), 1))
    joins = " ".join(f"JOIN s{n} USING (r, c)" for n in range(2, len(P.steps(kind)) + 1))
    return f"""{_POINTS.replace("/ 2)", f"/ {cell}::DOUBLE)")}, low AS (SELECT r, c, min(z) AS z FROM b GROUP BY b.r, b.c), x AS (SELECT min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM low),
g AS (SELECT a.r, c FROM (SELECT unnest(range(r0, r1 + 1))::INT AS r FROM x) a, (SELECT unnest(range(c0, c1 + 1))::INT AS c FROM x) b),
s0 AS (SELECT g.r, g.c, low.z AS z0, low.z FROM g LEFT JOIN low USING (r, c)), {', '.join(parts)},
m AS (SELECT r, c, least({most}) AS most FROM s1 {joins} WHERE s1.z IS NOT NULL)
SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(b.z, 6) AS z, b.z <= most AS ground FROM b JOIN m USING (r, c)"""


register("points_ground", ground_sql("standard"), lambda s, d: P.ground(_points(s, d)))
register("points_cloth", None, lambda s, d: P.cloth_ground(_points(s, d)))
register("points_outliers", None, lambda s, d: P.outliers(_points(s, d)))
register("points_range", _POINTS + "SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM p WHERE z BETWEEN 5 AND 40 AND NOT x BETWEEN 20 AND 30", lambda s, d: P.in_range(_points(s, d), "z[5:40], x![20:30]"))
register("points_ferry", _POINTS + "SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(z, 6) AS height FROM p", lambda s, d: P.ferried(_points(s, d), "z=>height"))
register(
    "points_crs",
    "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'EPSG:' || (32600 + p_size) WHEN p_size % 5 = 0 THEN p_type WHEN p_size % 7 <> 0 THEN p_name END AS crs FROM part",
    lambda s, d: (lambda m: m.select("p_partkey", P.crs_of(m).alias("crs")))(
        s.read.parquet(f"{d}/part.parquet").select(
            "p_partkey", F.when(F.col("p_size") % 3 == 0, F.col("p_size") + 32600).alias("epsg"), F.when(F.col("p_size") % 5 == 0, F.col("p_type")).otherwise("").alias("wkt"), F.when(F.col("p_size") % 7 != 0, F.col("p_name")).alias("proj4")
        )
    ),
)
register("points_pipeline", None, lambda s, d: P.run(_points(s, d).select("x", "y", "z"), P.pipeline("lineitem", "dem", cell=2.0))[0])
register(
    "points_low_noise",
    _POINTS
    + """, o AS (SELECT *, floor(y / 4)::INT AS cr, floor(x / 4)::INT AS cc FROM p), n AS (SELECT *, lead(z) OVER (PARTITION BY cr, cc ORDER BY z) - z AS gap FROM o),
e AS (SELECT *, max(CASE WHEN gap > 0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY cr, cc ORDER BY z ROWS UNBOUNDED PRECEDING) = 0 AS low FROM n)
SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, low FROM e""",
    lambda s, d: stages.low_noise(_points(s, d), 4.0, 0.5),
)
register(
    "points_centroids",
    _POINTS + "SELECT round(sum(x), 6) AS x, round(sum(y), 6) AS y, round(sum(z), 6) AS z, count(*) AS n FROM p GROUP BY floor(x / 5), floor(y / 5), floor(z / 5)",
    # Sums have five digits at most, so rounding agrees; means would end in halves of the last digit kept.
    lambda s, d: stages.centroids(_points(s, d), 5.0).withColumns({a: F.col(a) * F.col("n") for a in "xyz"}),
)
register("points_sampled", None, lambda s, d: stages.sampled(_points(s, d), 4.0))
register(
    "points_stages",
    _POINTS
    + """, t AS (SELECT id, 2 * x - y + 1 AS x, y + 0.5 AS y, z / 2 AS z FROM p WHERE x BETWEEN 10 AND 60 AND y BETWEEN 0 AND 80)
SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, CASE WHEN id <= 1000 THEN 2 ELSE 1 END::BIGINT AS Classification, id AS source,
floor(y / 20)::INT || '/' || floor(x / 20)::INT AS raster_id FROM t""",
    lambda s, d: P.run(_points(s, d), json.dumps({"pipeline": [
        {"type": "readers.las"},
        {"type": "filters.crop", "bounds": "([10, 60], [0, 80])"},
        {"type": "filters.transformation", "matrix": "2 -1 0 1  0 1 0 0.5  0 0 0.5 0  0 0 0 1"},
        {"type": "filters.ferry", "dimensions": "id=>source, id=>Classification"},
        {"type": "filters.assign", "assignment": "Classification[:1000]=0"},
        {"type": "filters.assign", "assignment": "Classification[1:]=1"},
        {"type": "filters.assign", "assignment": "Classification[0:0]=2"},
        {"type": "filters.splitter", "length": 20},
    ]}))[0],
)
register("points_dem", None, lambda s, d: P.to_dem(_points(s, d), "EPSG:32630", cell=2.0)[0])

# --- names and recipes ----------------------------------------------------------------------------------------------

register(
    "names_slug",
    r"""WITH x AS (SELECT p_partkey, trim(regexp_replace(p_name || '/' || p_type, '[^A-Za-z0-9 _\-.]', '_', 'g')) AS x FROM part)
SELECT p_partkey, regexp_replace(regexp_replace(x, '^[._/\\]+', ''), '\s+', '_', 'g') AS slug FROM x""",
    lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", recipes.slug(F.concat_ws("/", "p_name", "p_type")).alias("slug")),
)


def _recipes(s, d):
    """Parts as recipes of many kinds, right and wrong."""
    part, k = s.read.parquet(f"{d}/part.parquet"), F.col("p_partkey")
    version = F.when(k % 5 == 0, F.lit("1.0")).otherwise(F.concat(F.lit("1."), (k % 9).cast("string"), F.lit(".0")))
    radius = F.when(k % 4 == 1, F.lit("5.5")).when(k % 4 == 2, F.lit('"7"')).otherwise(F.col("p_size").cast("string"))
    name = F.when(k % 6 == 0, F.lit("moon")).otherwise("svf")
    place = F.when(k % 7 == 0, F.lit("lunar")).when(k % 7 == 1, F.lit("coastal")).otherwise("")
    body = F.format_string('{"recipe_version":"%s","algorithms":{"%s":{"enabled":%s,"search_radius":%s,"_own":1},"slope":{"units":"%s"}},"landscape_type":"%s"}', version, name, F.when(k % 3 == 0, F.lit("1")).otherwise("true"), radius, F.col("p_brand"), place)
    return part.select("p_partkey", F.when(k % 11 == 0, F.lit("[]")).when(k % 11 == 1, F.lit('{"algorithms":[]}')).otherwise(body).alias("recipe"))


_RECIPES = r"""WITH v AS (SELECT p_partkey, p_partkey AS k, p_brand, CASE WHEN p_partkey % 4 = 1 THEN '5.5' WHEN p_partkey % 4 = 2 THEN '"7"' ELSE p_size::VARCHAR END AS radius FROM part),
j AS (SELECT p_partkey, (CASE WHEN k % 11 = 0 THEN '[]' WHEN k % 11 = 1 THEN '{"algorithms":[]}' ELSE '{"recipe_version":"' || CASE WHEN k % 5 = 0 THEN '1.0' ELSE '1.' || (k % 9) || '.0' END || '","algorithms":{"' || CASE WHEN k % 6 = 0 THEN 'moon' ELSE 'svf' END || '":{"enabled":'
  || CASE WHEN k % 3 = 0 THEN '1' ELSE 'true' END || ',"search_radius":' || radius || ',"_own":1},"slope":{"units":"' || p_brand || '"}},"landscape_type":"' || CASE WHEN k % 7 = 0 THEN 'lunar' WHEN k % 7 = 1 THEN 'coastal' ELSE '' END || '"}' END)::JSON AS j FROM v)
"""
register(
    "recipes_check",
    _RECIPES
    + r"""SELECT p_partkey, (CASE WHEN json_type(j) <> 'OBJECT' THEN 1 ELSE (NOT regexp_matches(coalesce(j->>'$.recipe_version', ''), '^\d+\.\d+\.\d+$'))::INT + (coalesce(json_type(j, '$.algorithms'), '') <> 'OBJECT')::INT
  + coalesce((json_type(j, '$.algorithms.svf.enabled') <> 'BOOLEAN')::INT, 0) + coalesce((json_type(j, '$.algorithms.svf.search_radius') NOT IN ('UBIGINT', 'BIGINT', 'BOOLEAN'))::INT, 0)
  + (coalesce(j->>'$.landscape_type', '') NOT IN ('', 'flat_agricultural', 'forested', 'upland_steep', 'coastal'))::INT END)::INT AS n_errors,
CASE WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.algorithms.moon') IS NOT NULL THEN 1 ELSE 0 END AS n_warnings FROM j""",
    lambda s, d: recipes.check(_recipes(s, d)).select("p_partkey", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings")),
)
register(
    "recipes_presets",
    _RECIPES + """SELECT p_partkey, CASE WHEN json_type(j, '$.algorithms') = 'OBJECT' THEN coalesce(j->>'$.algorithms.svf.search_radius', j->>'$.algorithms.moon.search_radius') END AS radius, j->>'$.algorithms.slope.units' AS units,
CASE WHEN json_type(j, '$.algorithms') = 'OBJECT' THEN 2 ELSE 0 END AS n FROM j""",
    lambda s, d: _recipes(s, d)
    .select("p_partkey", recipes.presets_of().alias("p"))
    .select("p_partkey", F.coalesce(F.col("p")["svf"]["search_radius"], F.col("p")["moon"]["search_radius"]).alias("radius"), F.col("p")["slope"]["units"].alias("units"), F.coalesce(F.size("p"), F.lit(0)).alias("n"))
    .withColumn("n", F.greatest(F.col("n"), F.lit(0))),
)
register(
    "recipes_export",
    """SELECT o_orderkey, '{"recipe_version":"1.0.0","name":"' || o_orderpriority || '","author":"' || o_custkey || '","created":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '","algorithms":{"svf":{"radius":' || (o_orderkey % 20) || '}}}' AS recipe FROM orders""",
    lambda s, d: s.read.parquet(f"{d}/orders.parquet").select(
        "o_orderkey", recipes.exported(F.col("o_orderpriority"), F.col("o_custkey").cast("string"), F.col("o_orderdate"), F.struct(F.struct((F.col("o_orderkey") % 20).alias("radius")).alias("svf"))).alias("recipe")
    ),
)

# --- interpolating resamplers ---------------------------------------------------------------------------------------

_KERNEL_SQL = {
    "triangle": (1, "greatest(0.0::DOUBLE, 1 - x)"),
    "cubic": (2, "CASE WHEN x < 1 THEN 1.5 * x * x * x - 2.5 * x * x + 1 WHEN x < 2 THEN -0.5 * x * x * x + 2.5 * x * x - 4 * x + 2 ELSE 0 END"),
    "cubic_spline": (2, "CASE WHEN x < 1 THEN (4 - 6 * x * x + 3 * x * x * x) / 6 WHEN x < 2 THEN (2 - x) * (2 - x) * (2 - x) / 6 ELSE 0 END"),
    "lanczos": (3, "CASE WHEN x < 1e-9 THEN 1 WHEN x < 3 THEN 3 * sin(pi() * x) * sin(pi() * x / 3) / (pi() * x * pi() * x) ELSE 0 END"),
}
for _kind, (_reach, _k) in _KERNEL_SQL.items():
    _axis = "SELECT t, {a}, (" + _k + ")::DOUBLE AS w FROM (SELECT t, {a}, abs({a} - ({o} + t * 0.70710678118))::DOUBLE AS x FROM (SELECT DISTINCT {a} FROM dem_nd), (SELECT unnest(range(0, (SELECT floor((max({a}) - {o}) / 0.70710678118)::BIGINT + 1 FROM dem_nd))) AS t)) WHERE x < " + str(_reach)
    register(
        f"interpolate_{_kind}",
        f"""WITH {X.SQL}, wr AS ({_axis.format(a="r", o="0.23712345678")}), wc AS ({_axis.format(a="c", o="0.51131357911")}),
s AS (SELECT wr.t AS r, wc.t AS c, sum(wr.w * wc.w * z) AS v, sum(wr.w * wc.w) AS w FROM dem_nd d JOIN wr ON d.r = wr.r JOIN wc ON d.c = wc.c WHERE z IS NOT NULL GROUP BY wr.t, wc.t)
SELECT r::INT AS r, c::INT AS c, round(v / w, 6) AS z FROM s WHERE w > 0.1""",
        lambda s, d, k=_kind: C.interpolate(X.dem_nd(s, d), 0.70710678118, k, 0.23712345678, 0.51131357911),
    )

# --- field records, viewers, detector tiles -------------------------------------------------------------------------

register(
    "anomalies_read",
    """WITH x AS (SELECT o_orderkey AS fid, o_totalprice AS x, (o_custkey * 2)::DOUBLE AS y, CASE WHEN o_orderkey % 3 = 0 THEN 'A-' || o_orderkey END AS a,
  CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 1000000 END AS f, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS m FROM orders WHERE o_orderstatus <> 'P')
SELECT fid, round(x, 6) AS x, y, coalesce(a, printf('ANOM-%04d', row_number() OVER (ORDER BY fid))) AS anomaly_id, round(coalesce(f, 0.5), 6) AS confidence, coalesce(m, 'manual') AS detection_method, 'unknown' AS feature_type, 'pending' AS field_status, '' AS observer, '' AS photo_path, '' AS notes FROM x""",
    lambda s, d: L.anomalies(
        s.read.parquet(f"{d}/orders.parquet").select(
            F.col("o_orderkey").alias("fid"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("x"),
            (F.col("o_custkey") * 2).cast("double").alias("y"),
            F.expr("CASE WHEN o_orderkey % 3 = 0 THEN concat('A-', o_orderkey) END AS anomaly_id"),
            F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 1000000 END AS confidence"),
            F.expr("CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS detection_method"),
        ),
        "fid",
    ).drop("timestamp"),
)
register(
    "detections_footprints",
    _DETS
    + """SELECT id, x1, y1, x2, y2, round(confidence, 9) AS confidence, class_id, printf('%.2f,%.2f,%.2f,%.2f', x1, y1, x2, y2) AS bbox,
printf('POLYGON ((%.2f %.2f, %.2f %.2f, %.2f %.2f, %.2f %.2f, %.2f %.2f))', x1, y1, x2, y1, x2, y2, x1, y2, x1, y1) AS wkt FROM k""",
    lambda s, d: L.footprints(_boxes(s, d)),
    9,
)
register(
    "viewer_settings",
    """WITH m AS (SELECT o_custkey AS raster_id, min(o_totalprice) AS x0, min(o_orderkey)::DOUBLE AS y0, max(o_totalprice) AS x1, max(o_orderkey)::DOUBLE AS y1, avg(o_totalprice) / 200000 AS opacity FROM orders GROUP BY 1)
SELECT raster_id, round((x0 + x1) / 2, 6) AS lon, round((y0 + y1) / 2, 6) AS lat, greatest(1, least(16, trunc(14 - (x1 - x0) / 5000)::INT)) AS zoom, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, opacity)), 6) AS opacity FROM m""",
    lambda s, d: L.viewer(
        s.read.parquet(f"{d}/orders.parquet")
        .groupBy(F.col("o_custkey").alias("raster_id"))
        .agg(F.min("o_totalprice").alias("x0"), F.min("o_orderkey").cast("double").alias("y0"), F.max("o_totalprice").alias("x1"), F.max("o_orderkey").cast("double").alias("y1"), (F.avg("o_totalprice") / 200000).alias("opacity"))
    ),
)
register(
    "cloud_rasters",
    """WITH m AS (SELECT p_partkey AS raster_id, p_size * 90 AS rows, p_partkey % 77 * 64 AS cols, p_partkey % 5 * 32 AS block, p_partkey % 3 AS overviews FROM part)
SELECT *, CASE WHEN greatest(rows, cols) > 512 THEN greatest(1, length(ltrim(bin(greatest(rows, cols) // 256), '0')) - 1) ELSE 0 END::INT AS level, block >= 64 AND (greatest(rows, cols) <= 1024 OR overviews > 0) AS valid FROM m""",
    lambda s, d: L.cloud_check(
        s.read.parquet(f"{d}/part.parquet").select(
            F.col("p_partkey").alias("raster_id"), (F.col("p_size") * 90).alias("rows"), (F.col("p_partkey") % 77 * 64).alias("cols"), (F.col("p_partkey") % 5 * 32).alias("block"), (F.col("p_partkey") % 3).alias("overviews")
        )
    ),
)
register(
    "detector_tiles",
    f"""WITH {X.SQL}, n AS (SELECT greatest(1, ceil((max(r) + 1 - 4) / 28.0::DOUBLE))::INT AS nr FROM dem_nd), k AS (SELECT unnest(range(0, 5000))::INT AS t),
s AS (SELECT a.t AS tr, b.t AS tc, r, c, z FROM dem_nd JOIN k a ON r >= a.t * 28 AND r < a.t * 28 + 32 JOIN k b ON c >= b.t * 28 AND c < b.t * 28 + 32, n WHERE a.t < nr AND b.t < 4),
g AS (SELECT tr, tc, min(z) AS lo, max(z) AS hi FROM s GROUP BY 1, 2)
SELECT tr, tc, r, c, coalesce(round(CASE WHEN hi - lo > 1e-6 THEN (z - lo) / (hi - lo) END, 6), 0) AS x FROM s JOIN g USING (tr, tc)""",
    lambda s, d: (lambda x: L.detector_tiles(x, (x.agg(F.max("r")).first()[0] or 0) + 1, X.WIDTH, 32, 4))(X.dem_nd(s, d)),
)

# --- models over tiles, sinks, places, bands -------------------------------------------------------------------------


def brightest(x: np.ndarray) -> list[np.ndarray]:
    """A model that frames the brightest part of each eighth of its input, by corners, confidence and class."""
    n = x.shape[-1] // 8
    parts = x[0, 0, : n * 8, : n * 8].reshape(8, n, 8, n).transpose(0, 2, 1, 3).reshape(64, n * n)
    at = parts.argmax(axis=1)
    r, c = np.stack(np.divmod(np.arange(64), 8)) * n + np.stack(np.divmod(at, n))
    return [np.stack([c, r, c + 1, r + 1, parts.max(axis=1), np.arange(64) % 2], axis=1)[None]]


register("detections_model", None, lambda s, d: D.detect(X.dem_nd(s, d), brightest, ["mound", "pit"], 64, 8, 64, 0.5))
register(
    "detections_decode_parts",
    """WITH p AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS n, l_partkey % 100 + 0.0::DOUBLE AS x1, l_suppkey % 50 + 0.0::DOUBLE AS y1, l_quantity - 5 AS w, l_discount * 10 AS c, l_linenumber AS k FROM lineitem)
SELECT l_orderkey, n::INT AS n, x1, y1, x1 + w AS x2, y1 + w AS y2, round(c, 9) AS confidence, k::INT AS class_id FROM p WHERE n < l_orderkey % 5 AND c >= 0.25 AND w > 0""",
    lambda s, d: D.decode_parts(
        s.read.parquet(f"{d}/lineitem.parquet")
        .groupBy("l_orderkey")
        .agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount"))).alias("v"))
        .select(
            "l_orderkey",
            (F.col("l_orderkey") % 5).alias("num"),
            F.transform("v", lambda x: (lambda a, b, w: F.array(a, b, a + w, b + w))((x["l_partkey"] % 100).cast("double"), (x["l_suppkey"] % 50).cast("double"), x["l_quantity"] - 5)).alias("boxes"),
            F.transform("v", lambda x: x["l_discount"] * 10).alias("scores"),
            F.transform("v", lambda x: x["l_linenumber"]).alias("classes"),
        ),
        0.25,
    ),
    9,
)


def _new(s) -> str:
    return f"{shared_folder(s)}/raster-{uuid.uuid4().hex}"


def _written(write, read):
    """What is read back of what was written under a new path in the shared folder."""

    def make(s, d):
        write(s, d, path := _new(s))
        return read(s, path)

    return make


def _las_points(s, d):
    """Points to the millimetre, with a strength and a class."""
    x = s.read.parquet(f"{d}/lineitem.parquet")
    z = F.floor("l_extendedprice") / 1000
    return x.select((F.col("l_partkey") % 100 + F.col("l_discount")).alias("x"), (F.col("l_suppkey") % 100 + F.col("l_tax")).alias("y"), z.alias("z"), F.col("l_quantity").cast("int").alias("intensity"), F.col("l_linenumber").alias("classification"))


register(
    "points_las",
    "SELECT round(l_partkey % 100 + l_discount, 3) AS x, round(l_suppkey % 100 + l_tax, 3) AS y, round(floor(l_extendedprice) / 1000, 3) AS z, l_quantity::INT AS intensity, l_linenumber::INT AS classification FROM lineitem",
    _written(lambda s, d, p: las.write_points(_las_points(s, d), p, 32630), las.read_points),
    3,
)
register("raster_written", f"WITH {X.SQL} SELECT r, c, round(z, 6) AS z FROM dem_nd", _written(lambda s, d, p: rasters.write_raster(X.dem_nd(s, d), p), rasters.read_raster))
register("raster_window", f"WITH {X.SQL} SELECT r, c, round(z, 6) AS z FROM dem_nd WHERE r BETWEEN 5 AND 40 AND c BETWEEN 10 AND 70", _written(lambda s, d, p: rasters.write_raster(X.dem_nd(s, d), p, 32), lambda s, p: rasters.read_raster(s, p, (5, 40, 10, 70), 32)))
_TIFF = {"x0": 500_000.0, "y0": 6_000_000.0, "px_w": 2.0, "px_h": -2.0}
register("geotiff_written", f"WITH {X.SQL} SELECT r, c, round(z, 6) AS z FROM dem_nd", _written(lambda s, d, p: geotiff.write_geotiff(X.dem_nd(s, d), p, _TIFF, 32630, tile=64), lambda s, p: geotiff.read_geotiff(s, p, grid=_TIFF).select("r", "c", "z")))
register("geotiff_window", f"WITH {X.SQL} SELECT r, c, round(z, 6) AS z FROM dem_nd WHERE r BETWEEN 5 AND 40 AND c BETWEEN 10 AND 70", _written(lambda s, d, p: geotiff.write_geotiff(X.dem_nd(s, d), p, _TIFF, 32630, tile=16), lambda s, p: geotiff.read_geotiff(s, p, (5, 40, 10, 70), grid=_TIFF).select("r", "c", "z")))
register(
    "geotiff_overview",
    "SELECT ((event_id // 100) // 4)::INT AS r, ((event_id % 100) // 4)::INT AS c, round(avg(value), 6) AS z FROM events GROUP BY ALL",
    _written(lambda s, d, p: geotiff.write_geotiff(X.dem(s, d), p, _TIFF, 32630, tile=16, levels=2), lambda s, p: geotiff.read_geotiff(s, p, level=2, grid=_TIFF).select("r", "c", "z")),
)
register(
    "geotiff_bands",
    f"""WITH {X.SQL}, m AS (SELECT max(r) + 1 AS rows, max(c) + 1 AS cols FROM bands)
SELECT band, r, c, round(z, 6) AS z, 500000.0::DOUBLE AS x0, 6000000.0::DOUBLE AS y0, 32630 AS epsg, rows::BIGINT AS rows, cols::BIGINT AS cols FROM
(SELECT 1 AS band, r, c, b1 AS z FROM bands UNION ALL SELECT 2, r, c, b2 FROM bands UNION ALL SELECT 3, r, c, b3 FROM bands), m""",
    _written(lambda s, d, p: geotiff.write_geotiff(X.bands(s, d), p, _TIFF, 32630, tile=64), lambda s, p: geotiff.read_geotiff(s, p, grid=_TIFF).join(geotiff.mosaic(geotiff.read_meta(s, p)), "file").select("band", "r", "c", "z", "x0", "y0", "epsg", "rows", "cols")),
)
register("change_written", _DOD + "SELECT r, c, mask AS z FROM k", _written(lambda s, d, p: rasters.write_change(C.difference(X.dem_nd(s, d), X.dem_new(s, d)), p), lambda s, p: rasters.read_raster(s, f"{p}/mask")))
register("colours_written", f"WITH {X.SQL}, {position_sql((3, 10, 40))} SELECT r, c, red, green, blue FROM mstp", _written(lambda s, d, p: rasters.write_colours(W.topographic_position(X.dem_nd(s, d), 3, 10, 40), p), rasters.read_raster))


def _anomalies(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").where("o_orderstatus <> 'P'")
    return o.select(F.col("o_orderkey").alias("fid"), F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"), F.lit(None).cast("string").alias("anomaly_id"), (F.col("o_totalprice") / 1000000).alias("confidence"), F.lit("survey").alias("detection_method"))


register(
    "field_package",
    """SELECT printf('ANOM-%04d', row_number() OVER (ORDER BY o_orderkey)) AS anomaly_id, round(o_totalprice / 1000000, 6) AS confidence, 'survey' AS detection_method, round(o_totalprice, 6) AS x, o_custkey::DOUBLE AS y FROM orders WHERE o_orderstatus <> 'P'""",
    lambda s, d: s.read.parquet(rasters.write_package(L.anomalies(_anomalies(s, d), "fid"), s.read.parquet(f"{d}/nation.parquet").select("n_name", F.lit("EPSG:32630").alias("crs")), _new(s), "survey of the field") + "/anomalies").select("anomaly_id", "confidence", "detection_method", "x", "y"),
)


def _package(s, path: str, names: list[str], at_once: int = 10_000):
    """The features of written GeoPackages, read by SQLite in tasks of a file each, `at_once` at a time."""

    def work(frames):
        import sqlite3
        import struct

        import pandas as pd

        for f in frames:
            for file in f.file:
                db = sqlite3.connect(f"file:{file}?mode=ro", uri=True)
                found = db.execute(f"SELECT geom, {', '.join(names)} FROM anomalies")
                while rows := found.fetchmany(at_once):
                    yield pd.DataFrame([(*struct.unpack("<2d", g[13:29]), struct.unpack("<i", g[4:8])[0], *r) for g, *r in rows], columns=["x", "y", "srs", *names])
                db.close()

    folder = geotiff.local(path)
    files = [(os.path.join(folder, n),) for n in sorted(os.listdir(folder)) if n.endswith(".gpkg")]
    return s.createDataFrame(files, "file string").repartition(max(1, len(files))).mapInPandas(work, "x double, y double, srs int, " + ", ".join(f"{n} {'double' if n == 'confidence' else 'string'}" for n in names))


register(
    "geopackage_written",
    """SELECT printf('ANOM-%04d', row_number() OVER (ORDER BY o_orderkey)) AS anomaly_id, round(o_totalprice / 1000000, 6) AS confidence, 'survey' AS detection_method, 'unknown' AS feature_type, 'pending' AS field_status, '' AS notes,
round(o_totalprice, 6) AS x, o_custkey::DOUBLE AS y, 32630 AS srs FROM orders WHERE o_orderstatus <> 'P'""",
    _written(lambda s, d, p: geopackage.write_geopackage(L.anomalies(_anomalies(s, d), "fid").drop("fid"), p, "anomalies", "EPSG:32630"), lambda s, p: _package(s, p, ["anomaly_id", "confidence", "detection_method", "feature_type", "field_status", "notes"])),
)
register(
    "raster_extents",
    """SELECT p_partkey, p_size * 9 AS rows, p_size * 7 AS cols, p_retailprice AS x0, p_retailprice * 2 AS y0, 0.5 AS px_w, -(p_size % 4 + 1) / 2.0::DOUBLE AS px_h, CASE WHEN p_size % 3 > 0 THEN p_brand END AS crs, (0.5 + (p_size % 4 + 1) / 2.0::DOUBLE) / 2 AS cell_size,
round(p_retailprice, 6) AS x_min, round(p_retailprice * 2 - p_size * 9 * (p_size % 4 + 1) / 2.0::DOUBLE, 6) AS y_min, round(p_retailprice + p_size * 7 * 0.5, 6) AS x_max, round(p_retailprice * 2, 6) AS y_max FROM part""".replace("p_retailprice AS x0, p_retailprice * 2 AS y0, 0.5 AS px_w", "round(p_retailprice, 6) AS x0, round(p_retailprice * 2, 6) AS y0, 0.5::DOUBLE AS px_w"),
    lambda s, d: X.extents(
        s.read.parquet(f"{d}/part.parquet").select(
            "p_partkey", (F.col("p_size") * 9).alias("rows"), (F.col("p_size") * 7).alias("cols"), F.col("p_retailprice").alias("x0"), (F.col("p_retailprice") * 2).alias("y0"), F.lit(0.5).alias("px_w"), (-(F.col("p_size") % 4 + 1) / 2).alias("px_h"), F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).otherwise(" ").alias("crs")
        )
    ),
)
register(
    "rasters_same_place",
    """WITH m AS (SELECT p_partkey, p_brand AS crs_a, CASE WHEN p_partkey % 9 = 0 THEN 'EPSG:1' ELSE p_brand END AS crs_b, p_retailprice AS x0, p_retailprice + p_size AS x1, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1e-9 ELSE 0.5 END AS off FROM part)
SELECT p_partkey, CASE WHEN crs_a <> crs_b THEN 'other CRS' WHEN off > 1e-3 THEN 'other extent' END AS error FROM m""",
    lambda s, d: B.same_place(
        s.read.parquet(f"{d}/part.parquet").select(
            "p_partkey", F.col("p_brand").alias("crs_a"), F.when(F.col("p_partkey") % 9 == 0, "EPSG:1").otherwise(F.col("p_brand")).alias("crs_b"),
            *(x.alias(f"{k}_a") for k, x in (("x0", F.col("p_retailprice")), ("y0", F.lit(0.0)), ("x1", F.col("p_retailprice") + F.col("p_size")), ("y1", F.lit(10.0)))),
            *((x + F.when(F.col("p_partkey") % 3 == 0, 0.0).when(F.col("p_partkey") % 3 == 1, 1e-9).otherwise(0.5)).alias(f"{k}_b") for k, x in (("x0", F.col("p_retailprice")), ("y0", F.lit(0.0)), ("x1", F.col("p_retailprice") + F.col("p_size")), ("y1", F.lit(10.0)))),
        )
    ).select("p_partkey", "error"),
)
register(
    "blend_prescaled",
    f"""WITH {X.SQL}, q AS (SELECT min(z - 50) lo, max(z - 50) hi FROM dem_nd), p AS (SELECT max(z) hi FROM dem_nd)
SELECT r, c, round(z / p.hi * 255, 6) AS base, round((z - 50 - q.lo) / (q.hi - q.lo) * 255, 6) AS upper FROM dem_nd, p, q""",
    lambda s, d: (lambda a, b: a.select("r", "c", F.col("z").alias("base")).join(b.select("r", "c", F.col("z").alias("upper")), ["r", "c"]))(
        *B.prescale((lambda z: z.withColumn("z", F.col("z") / z.agg(F.max("z")).first()[0]))(X.dem_nd(s, d)), X.dem_nd(s, d).withColumn("z", F.col("z") - 50))
    ),
)
register(
    "bands_described",
    "SELECT p_partkey, 'B' || (p_size % 14) AS band, " + ", ".join(f"CASE 'B' || (p_size % 14) {' '.join(f'WHEN {k!r} THEN {v[i]!r}' for k, v in X.SENTINEL.items())} END AS {n}" for i, n in enumerate(("description", "resolution", "center_nm"))) + " FROM part",
    lambda s, d: X.described(s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(F.lit("B"), (F.col("p_size") % 14).cast("string")).alias("band"))),
)
register("raster_band", f"WITH {X.SQL} SELECT r, c, round(b2, 6) AS z FROM bands", lambda s, d: X.band(X.bands(s, d).select("r", "c", F.posexplode(F.array("b1", "b2", "b3")).alias("band", "z")).withColumn("band", F.col("band") + 1), 2))
register("raster_shifted", f"WITH {X.SQL} SELECT d.r, d.c, CASE WHEN m.r IS NULL THEN -1 ELSE round(m.z, 6) END AS z FROM dem_nd d LEFT JOIN dem_nd m ON m.r = d.r - 2 AND m.c = d.c + 3", lambda s, d: X.shifted(X.dem_nd(s, d), 2, -3, -1.0))
register(
    "viewer_pages",
    """WITH t AS (SELECT p_partkey, p_name || ' <' || p_brand || ' & "co">' AS t FROM part)
SELECT p_partkey, '<!DOCTYPE html><html><head><meta charset=''utf-8''><title>' || replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</title></head><body><div id=''map''></div><script src=''viewer.js'' data-config=''config.json''></script></body></html>' AS html FROM t""",
    lambda s, d: L.pages(
        s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat("p_name", F.lit(" <"), "p_brand", F.lit(' & "co">')).alias("title"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"), F.lit(8).alias("zoom"), F.lit(1.0).alias("opacity"))
    ).select("p_partkey", "html"),
)

# --- two rasters in one table: each as if it were alone ---------------------------------------------------------------


def _by_raster(name: str, make, digits: int = 6):
    """The query `name` over both rasters of `dems`: its SQL, run on each by itself."""
    sql = oracle_sql()[name].replace(", 6)", f", {digits})")
    register(f"{name}_rasters", f"SELECT 1 AS raster_id, * FROM ({sql}) UNION ALL SELECT 2, * FROM ({sql.replace(X.SQL_ND, X.SQL_TALL)})", make, digits)


def _bands_of_rasters(s, d, names):
    own = X.bands(s, d).select("r", "c", *(F.col(b).alias(k) for b, k in zip(("b1", "b2", "b3"), names, strict=True)))
    return own.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("raster_id"), "*")


_by_raster("slope", lambda s, d: S.slope(X.dems(s, d)))
_by_raster("local_relief", lambda s, d: W.local_relief(X.dems(s, d), 5))
_by_raster("topographic_position", lambda s, d: W.topographic_position(X.dems(s, d), 3, 10, 40))
_by_raster("red_relief", lambda s, d: B.red_relief(H.measures(X.dems(s, d), _RELIEF)))
_by_raster("vat", lambda s, d: B.vat(H.measures(X.dems(s, d), {"hillshade": ("hillshade", {"azimuths": (315, 45, 135, 225)}), "slope": ("slope", {}), "openness": ("openness", {"directions": 8, "radius": 10}), "svf": ("svf", {"directions": 8, "radius": 10})})))
_by_raster("batch_relief", lambda s, d: batch.batch(X.dems(s, d), ["hillshade", "slope", "openness_positive", "local_dominance", "slrm", "red_relief"], "upland_steep"))
_by_raster("statistics", lambda s, d: C.statistics(X.dems(s, d)))
_by_raster("histogram", lambda s, d: C.histogram(X.dems(s, d)))
_by_raster("display_range", lambda s, d: C.display_range(X.dems(s, d)))
_by_raster("interpolate_cubic", lambda s, d: C.interpolate(X.dems(s, d), 0.70710678118, "cubic", 0.23712345678, 0.51131357911), 4)
_by_raster("fusion_erosion_risk", lambda s, d: C.fused(X.dems(s, d), _bands_of_rasters(s, d, C.RECIPES["erosion_risk"][1]), "erosion_risk"))
_by_raster("detector_tiles", lambda s, d: L.detector_tiles(X.dems(s, d), tile=32, overlap=4))
