"""Operators on small rasters with known answers."""

import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tellur.functions import recipes
from tellur.operators import batch, blend, change, detect, field, horizon, points, stages, stencil, tiles, windows
from tellur.sources import cells


def raster(spark, f, rows=12, cols=12):
    return spark.createDataFrame([(r, c, f(r, c)) for r in range(rows) for c in range(cols)], "r int, c int, z double")


def grid(df, name):
    return {(x.r, x.c): x[name] for x in df.collect()}


def test_plane_has_45_degrees_inside(spark):
    z = raster(spark, lambda r, c: float(c))
    got = grid(stencil.slope(z), "slope")
    assert all(abs(v - 45) < 1e-9 for (r, c), v in got.items() if 0 < c < 11)
    assert all(abs(v - 100) < 1e-9 for (r, c), v in grid(stencil.slope(z, "percent", "finite_difference"), "slope").items() if 0 < c < 11)
    with pytest.raises(ValueError):
        stencil.slope(z, "radians")


def test_flat_raster(spark):
    z = raster(spark, lambda r, c: 100.0)
    assert set(grid(stencil.slope(z), "slope").values()) == {0.0}
    assert all(abs(v - 255 * math.cos(math.pi / 4)) < 1e-9 for v in grid(stencil.hillshade(z, (315,)), "hillshade").values())
    assert all(abs(v - 1) < 1e-12 for v in grid(horizon.sky_view(z, 8, 3), "svf").values())
    assert all(abs(v - 90) < 1e-9 for v in grid(horizon.openness(z, False, 8, 3), "openness").values())
    assert {(x.red, x.green, x.blue) for x in windows.topographic_position(z, 1, 2, 3).collect()} == {(127, 127, 127)}


def test_ruggedness_of_a_peak_and_of_nodata(spark):
    peak = grid(stencil.ruggedness(raster(spark, lambda r, c: 2.0 if (r, c) == (1, 1) else 0.0, 3, 3)), "tri")
    assert abs(peak[1, 1] - math.sqrt(32)) < 1e-12
    holed = grid(stencil.ruggedness(raster(spark, lambda r, c: None if (r, c) == (0, 0) else 1.0, 3, 3)), "tri")
    assert holed[0, 0] is None and holed[0, 1] == 0


def test_noise_filter_ignores_a_spike(spark):
    z = raster(spark, lambda r, c: 100.0 if (r, c) == (10, 10) else 0.0, 20, 20)
    plain, filtered = (grid(horizon.sky_view(z, 16, 5, noise=n), "svf")[10, 11] for n in (0, 3))
    assert filtered > plain and filtered > 0.9


def test_tiles_agree_with_one_tile(spark):
    from tellur.operators.tiles import over_tiles

    z = raster(spark, lambda r, c: math.sin(r) * 10 + c if (r + c) % 17 else None, 30, 25)

    def kernel(b):
        return {"s": sum(b.cut(b.filled(), i, j) for i in range(-2, 3) for j in range(-2, 3))}

    a, b = (grid(over_tiles(z, 2, kernel, ["s"], tile=t), "s") for t in (7, 64))
    assert a.keys() == b.keys() and all((a[k] is None) == (b[k] is None) and (a[k] is None or abs(a[k] - b[k]) < 1e-9) for k in a)


def plain_ray(samples, noise, lenient):
    """The horizon of one ray with the filter, sample by sample."""
    best = candidate = 0.0
    wait, good = 0, False
    for s in samples:
        if wait > 0 and s >= candidate - (math.sin(math.radians(2)) if lenient else 0):
            good = True
        if s > max(best, candidate):
            if good if lenient else wait > 0:
                best = candidate
            candidate, good, wait = s, False, noise - 1 if lenient else noise
        elif wait > 0:
            wait -= 1
        if wait == 0:
            if good:
                best = max(best, candidate)
            candidate, good = best, False
    return max(best, candidate) if good or wait > 0 else best


@pytest.mark.parametrize("noise", [1, 2, 3])
def test_noise_filters_against_a_loop_for_each_ray(spark, noise):
    import random

    rng = random.Random(noise)
    h = {(r, c): rng.choice([0.0, 0.0, rng.uniform(0, 6)]) for r in range(14) for c in range(11)}
    z, mean = raster(spark, lambda r, c: h[r, c], 14, 11), sum(h.values()) / len(h)
    w = horizon.directional(8, 315, 0.5)
    sky, asky = grid(horizon.sky_view(z, 8, 5, noise), "svf"), grid(horizon.anisotropic_sky_view(z, 8, 5, noise=noise), "asvf")
    for (r, c), own in h.items():
        tops = {True: [], False: []}
        for ray in horizon.rays(8, 5):
            s = [(x := h.get((r + dr, c + dc), mean) - own) / math.hypot(x, d) for dr, dc, d in ray]
            for lenient in tops:
                tops[lenient].append(max(0.0, plain_ray(s, noise, lenient)))
        assert sky[r, c] == pytest.approx(1 - sum(tops[False]) / 8) and asky[r, c] == pytest.approx(sum((1 - t) * k for t, k in zip(tops[True], w, strict=True)) / sum(w))
    assert plain_ray([0.3, 0.5, 0, 0], 2, False) == 0.3 and plain_ray([0.3, 0.5], 2, False) == 0.5 and plain_ray([0.5, 0, 0, 0], 2, False) == 0


def test_rasters_are_kept_apart(spark):
    """Two rasters of other shapes, origins and holes, in one table: each gets what it gets alone."""
    from tellur.operators import tiles

    a = raster(spark, lambda r, c: float(r * 3 + c % 4), 9, 8).withColumn("r", F.col("r") + 5)
    b = raster(spark, lambda r, c: float((r - c) % 5) * 10, 7, 12).withColumn("c", F.col("c") - 3).where("NOT (r = 3 AND c = 2)")
    both = a.withColumn("raster_id", F.lit("a")).unionByName(b.withColumn("raster_id", F.lit("b")))
    for make, name in ((lambda x: horizon.sky_view(x, 8, 3), "svf"), (stencil.slope, "slope"), (lambda x: windows.local_relief(x, 2), "slrm"), (lambda x: horizon.openness(x, True, 8, 3, edge="reflect"), "openness"), (lambda x: horizon.local_dominance(x, 2, 4, 1, 45), "dominance")):
        got = {(r.raster_id, r.r, r.c): r[name] for r in make(both).collect()}
        alone = {(k, r.r, r.c): r[name] for k, x in (("a", a), ("b", b)) for r in make(x).collect()}
        assert got.keys() == alone.keys() and all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-9) for k, v in alone.items()), name
    assert len(grid(tiles.over_tiles(a, 1, lambda t: {"m": t.cut(t.filled())}, ["m"], tile=4), "m")) == 72


def test_a_missing_cell_is_nodata(spark):
    z = raster(spark, lambda r, c: float(c)).where("NOT (r = 5 AND c = 5)")
    got = grid(stencil.slope(z), "slope")
    filled = grid(stencil.slope(raster(spark, lambda r, c: None if (r, c) == (5, 5) else float(c))), "slope")
    assert len(got) == 144 and all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-9) for k, v in filled.items())


def test_a_radius_beyond_the_raster(spark):
    flat = grid(windows.local_relief(raster(spark, lambda r, c: 4.0, 6, 6), 20), "slrm")
    assert all(abs(v) < 1e-9 for v in flat.values())
    h = [[float((3 * r + 5 * c) % 7) for c in range(3)] for r in range(4)]
    fold = lambda i, n: (i % (2 * n)) if (i % (2 * n)) < n else 2 * n - 1 - i % (2 * n)
    got = grid(windows.box_mean(raster(spark, lambda r, c: h[r][c], 4, 3), 5), "mean")
    for r in range(4):
        for c in range(3):
            assert got[r, c] == pytest.approx(sum(h[fold(r + i, 4)][fold(c + j, 3)] for i in range(-5, 6) for j in range(-5, 6)) / 121)


def test_openness_with_a_mirrored_border(spark):
    h = {(r, c): float((7 * r + 3 * c * c) % 11) for r in range(8) for c in range(9)}
    got = grid(horizon.openness(raster(spark, lambda r, c: h[r, c], 8, 9), False, 8, 4, edge="reflect"), "openness")
    fold = lambda i, n: min(i % (2 * n - 2), 2 * n - 2 - i % (2 * n - 2))
    for (r, c), own in h.items():
        angles = [90 - math.degrees(math.asin(max((x := h[fold(r + dr, 8), fold(c + dc, 9)] - own) / math.hypot(x, d) for dr, dc, d in ray))) for ray in horizon.rays(8, 4)]
        assert got[r, c] == pytest.approx(sum(angles) / 8)
    with pytest.raises(ValueError):
        horizon.openness(raster(spark, lambda r, c: 1.0), edge="wrap")


def test_measures_in_one_pass(spark):
    z = raster(spark, lambda r, c: math.sin(r) * 5 + c if (r + c) % 13 else None, 20, 15)
    asked = {"ma": ("svf", {"directions": 8, "radius": 4}), "mb": ("openness", {"directions": 8, "radius": 4}), "mc": ("slope", {}), "md": ("hillshade", {"azimuths": (315,)}), "me": ("dominance", {"least": 2, "most": 3}), "mf": ("openness", {"radius": 3, "negative": True})}
    got = {(r.r, r.c): r for r in horizon.measures(z, asked).collect()}
    alone = {"ma": (horizon.sky_view(z, 8, 4), "svf"), "mb": (horizon.openness(z, False, 8, 4), "openness"), "mc": (stencil.slope(z), "slope"), "md": (stencil.hillshade(z, (315,)), "hillshade"), "me": (horizon.local_dominance(z, 2, 3), "dominance"), "mf": (horizon.openness(z, True, 16, 3), "openness")}
    for k, (x, name) in alone.items():
        assert all((got[at][k] is None) == (v is None) and (v is None or abs(got[at][k] - v) < 1e-6) for at, v in grid(x, name).items()), k
    with pytest.raises(ValueError):
        horizon.measures(z, {"ma": ("svf", {"depth": 1})})


def test_box_mean_is_mirrored(spark):
    got = grid(windows.box_mean(raster(spark, lambda r, c: float(c), 4, 4), 1), "mean")
    assert abs(got[0, 0] - 1 / 3) < 1e-12 and abs(got[2, 3] - 8 / 3) < 1e-12


@pytest.mark.parametrize("mode, a, b, want", [("multiply", 255.0, 128.0, 128.0), ("overlay", 128.0, 128.0, 128.5), ("screen", 0.0, 64.0, 64.0), ("soft_light", 128.0, 128.0, 128.2)])
def test_blends(spark, mode, a, b, want):
    x, y = (spark.createDataFrame([(0, 0, v)], "r int, c int, z double") for v in (a, b))
    assert abs(blend.blend(x, y, mode).first().blend - want) < 1
    with pytest.raises(ValueError):
        blend.blend(x, y.where("r > 0"), mode)
    with pytest.raises(ValueError):
        blend.blend(x, y, "burn")


def test_constant_red_relief_is_zero(spark):
    z = raster(spark, lambda r, c: 5.0)
    assert set(grid(blend.red_relief(windows.local_relief(z, 2), stencil.slope(z)), "red").values()) == {0.0}


def test_change_of_a_mound(spark):
    old, new = raster(spark, lambda r, c: 50.0), raster(spark, lambda r, c: 52.0 if (r, c) == (5, 5) else None if r == 0 else 50.0)
    d = change.difference(old, new)
    got = change.report(d).first()
    assert (got.n_valid, got.n_higher, got.n_lower, got.fill, got.cut) == (132, 1, 0, 2.0, 0.0)
    assert grid(d, "mask")[0, 3] == 255
    same = change.report(change.difference(old, old)).first()
    assert same.n_significant == 0 and same.net == 0


def test_resampling_and_stacks(spark):
    z = raster(spark, lambda r, c: float(r * 4 + c), 4, 4)
    assert grid(change.resample(z, 2), "z")[0, 0] == 2.5
    assert change.resample(z, 4, "rms").first().z == pytest.approx(math.sqrt(sum(i * i for i in range(16)) / 16))
    assert change.overview_levels(512, 300) == 0 and change.overview_levels(2000, 2000) == 2
    assert grid(change.bilinear(z, 1.0, 0.5, 0.5), "z")[0, 0] == 2.5
    assert grid(change.mosaic([z, z.where("r = 0").withColumn("z", F.lit(9.0))]), "z")[0, 1] == 9.0
    with pytest.raises(ValueError):
        change.resample(z, 2, "lanczos7")
    with pytest.raises(ValueError):
        change.fuse(z, z, ("B8", "B4", "B3"), "multiply", 0.5)


def test_quantiles_by_refined_bins(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    for x in (rng.normal(size=3000), rng.integers(0, 5, 3000).astype(float), np.concatenate([rng.normal(size=2000) * 1e-9, [1e9] * 500]), np.full(2000, 7.0)):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "z double")
        assert change.quantiles(df, "z", [0.02, 0.25, 0.5, 0.98], most=100) == pytest.approx(list(np.percentile(x, [2, 25, 50, 98])))
    assert change.quantiles(df.where("z IS NULL"), "z", [0.5]) is None


def test_pyramids_of_sums(spark):
    z = raster(spark, lambda r, c: None if r == 3 and c < 4 else float(r * r + c), 13, 10)
    for kind in (*change.RESAMPLE, "nearest"):
        got = {(r.level, r.r, r.c): r.z for r in change.pyramid(z, 3, kind).collect()}
        for level in (1, 2, 3):
            for k, v in grid(change.resample(z, 2**level, kind), "z").items():
                assert got[(level, *k)] == pytest.approx(v) if v is not None else got[(level, *k)] is None
    assert grid(change.resample(z, 4, "nearest"), "z")[0, 0] == 6.0 and grid(change.resample(z, 4, "nearest"), "z")[3, 2] == 144.0 + 9.0


def test_aligned_grids(spark):
    z = raster(spark, lambda r, c: 2.0 * r + c, 20, 20)
    grid_a = {"x0": 100.0, "y0": 500.0, "px_w": 1.0, "px_h": -1.0, "rows": 20, "cols": 20}
    same = grid(change.aligned(z, grid_a, grid_a), "z")
    assert len(same) == 400 and all(v == 2.0 * r + c for (r, c), v in same.items())
    shifted = grid_a | {"x0": 102.25, "y0": 499.5, "rows": 10, "cols": 9}
    for kind in ("bilinear", "cubic"):
        got = grid(change.aligned(z, grid_a, shifted, kind), "z")
        assert len(got) == 90 and all(abs(got[r, c] - (2 * (r + 0.5) + c + 2.25)) < 1e-9 for r, c in got if kind == "bilinear" or r > 1)
    coarse = grid_a | {"px_w": 4.0, "px_h": -4.0, "rows": 5, "cols": 5}
    assert grid(change.aligned(z, grid_a, coarse, "average"), "z") == grid(change.resample(z, 4), "z")
    assert grid(change.aligned(z, grid_a, coarse, "nearest"), "z") == grid(change.resample(z, 4, "nearest"), "z")
    with pytest.raises(ValueError):
        change.aligned(z, grid_a, shifted | {"px_h": 1.0})
    with pytest.raises(ValueError):
        change.aligned(z, grid_a, shifted, "moon")


def test_blend_conditions(spark):
    twice = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0)], "r int, c int, z double")
    with pytest.raises(ValueError):
        blend.blend(twice, twice.limit(1), "multiply")
    a, b = (spark.createDataFrame([(0, i, v) for i, v in enumerate(x)], "r int, c int, z double") for x in ([0.0, 0.5, 1.0], [-1.0, 0.0, 3.0]))
    p, q = (grid(x, "z") for x in blend.prescale(a, b))
    assert [p[0, i] for i in range(3)] == [0, 127.5, 255] and [q[0, i] for i in range(3)] == [0, 63.75, 255]
    row = ("EPSG:1", "EPSG:1", *[0.0, 0.0, 10.0, 10.0] * 2)
    names = "crs_a string, crs_b string, " + ", ".join(f"{k}_{r} double" for r in "ab" for k in ("x0", "y0", "x1", "y1"))
    pairs = spark.createDataFrame([row, (row[0], "EPSG:2", *row[2:]), (*row[:-1], 10.1), (*row[:-1], 10.000001), (None, None, *row[2:])], names)
    assert [r.error for r in blend.same_place(pairs).collect()] == [None, "other CRS", "other extent", None, None]


def test_detections(spark):
    rows = [(1, [0.0, 0.0, 10.0, 10.0, 0.9, 0.0]), (2, [1.0, 1.0, 11.0, 11.0, 0.8, 0.0]), (3, [50.0, 50.0, 10.0, 10.0, 0.9, 0.1, 0.9]), (4, [5.0, 5.0, 4.0, 9.0, 0.9, 0.0]), (5, [0.0, 0.0, 5.0, 5.0, 0.1, 0.0])]
    boxes = detect.decode(spark.createDataFrame(rows, "id bigint, out array<double>"), 0.25)
    got = {x.id: x for x in boxes.collect()}
    assert set(got) == {1, 2, 3} and (got[3].x1, got[3].x2, got[3].class_id) == (45.0, 55.0, 1)
    assert {x.id for x in detect.suppress(boxes, 0.5).collect()} == {1, 3}
    assert detect.overlaps(boxes, 0.1, 4.0).first().iou == pytest.approx(81 / 119)
    assert detect.to_map(boxes.where("id = 1"), (100, 1, 0, 200, 0, -1)).first().y1 == 190


def test_points(spark):
    pts = spark.createDataFrame([(x + 0.5, y + 0.5, 10.0 if (x, y) != (5, 5) else 30.0) for x in range(12) for y in range(12)], "x double, y double, z double")
    flags = {(r.x, r.y): r.ground for r in points.ground(pts, "standard").collect()}
    assert not flags[5.5, 5.5] and sum(flags.values()) == 143
    assert {(r.x, r.y) for r in points.outliers(pts).where("outlier").collect()} == {(5.5, 5.5)}
    assert points.lowest(pts, 4.0).count() == 9


def test_outliers_by_exact_neighbours(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(150, 3)), rng.normal(size=(40, 3)) * 0.01 + 5, [[30, 0, 0], [0, 0, 9]], np.zeros((12, 3))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    mean = np.sort(d, axis=1)[:, :8].mean(axis=1)
    want = mean > mean.mean() + 2 * mean.std(ddof=1)
    got = {r.i: r.outlier for r in points.outliers(spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "i int, x double, y double, z double")).collect()}
    assert want.any() and [got[i] for i in range(len(x))] == want.tolist()
    few = spark.createDataFrame([(0.0, 0.0, 0.0)] * 3, "x double, y double, z double")
    assert [r.outlier for r in points.outliers(few).collect()] == [False] * 3


def test_nearest_by_groups_of_cubes():
    """Where the nearest lie within a cube's side, groups of cubes give what all places of a block give; elsewhere the distance tells."""
    rng = np.random.default_rng(3)
    xyz, times = rng.uniform(-1, 5, (350, 3)), rng.integers(1, 3, 350)
    cubes = np.floor(xyz).astype(int)
    own = np.flatnonzero(((cubes >= 0) & (cubes < 4)).all(axis=1))
    mean, far = points.nearest_by_cubes(cubes, own, xyz, times, 8)
    want_mean, want_far = points.nearest_means(xyz[own], own, xyz, times, 8)
    near = want_far <= 1
    assert 20 < near.sum() < len(own) and (far[~near] > 1).all()
    assert (mean[near] == want_mean[near]).all() and (far[near] == want_far[near]).all()


def test_cloth(spark):
    import numpy as np

    rng = np.random.default_rng(42)
    df = lambda x: spark.createDataFrame([tuple(map(float, p)) for p in x], "x double, y double, z double")
    flat = np.column_stack([rng.uniform(0, 10, (200, 2)), 100 + rng.normal(0, 0.01, 200)])
    assert points.cloth_ground(df(flat)).where("ground").count() > 160
    xy = rng.uniform(0, 40, (3000, 2))
    roof = (np.abs(xy - 20) < 5).all(axis=1)
    got = {(r.x, r.y): r.ground for r in points.cloth_ground(df(np.column_stack([xy, np.where(roof, 8.0, 0.0) + xy[:, 0] * 0.05]))).collect()}
    on = np.array([got[tuple(p)] for p in xy])
    assert len(got) == 3000 and on[~roof].mean() > 0.95 and on[roof].mean() < 0.2
    assert points.cloth_ground(df(flat).limit(0)).count() == 0
    dem, said = points.to_dem(df(flat), "EPSG:1", "moon")
    assert said["points"] == 200 and said["ground"] + said["off_ground"] == 200 and abs(dem.agg(F.avg("z")).first()[0] - 100) < 0.1
    with pytest.raises(ValueError):
        points.to_dem(df(flat), None)
    with pytest.raises(ValueError):
        points.to_dem(df(flat[:5]), "EPSG:1")


def test_las_files(spark, tmp_path, monkeypatch):
    import struct

    from tellur.sources import las

    rows = [(500000.123 + i, 6000000.5 - i, i / 8, i * 300, i % 40) for i in range(250)] + [(None, 1.0, 1.0, 1, 1)]
    df = spark.createDataFrame(rows, "x double, y double, z double, intensity int, classification int").coalesce(2)
    las.write_points(df, str(tmp_path / "a"), 32630)
    got = sorted(las.read_points(spark, str(tmp_path / "a")).collect())
    assert len(got) == 250 and all(abs(a - b) < 0.00051 for r, w in zip(got, rows, strict=False) for a, b in zip(r[:3], w[:3], strict=True))
    assert [(r.intensity, r.classification) for r in got] == [(min(65535, w[3]), min(31, w[4])) for w in rows[:250]]
    meta = las.read_meta(spark, str(tmp_path / "a"))
    assert sum(r.n for r in meta.collect()) == 250 and {r[0] for r in meta.select(points.crs_of(meta)).collect()} == {"EPSG:32630"}
    with pytest.raises(ValueError):
        las.write_points(df, str(tmp_path / "a"))
    # Files of a few points, partitions of fewer, and a box that passes over files by their heads.
    las.write_points(df, str(tmp_path / "small"), 32630, 40)
    assert len(las.files(str(tmp_path / "small"))) >= 7
    spark.dataSource.register(las.Las)
    fine = spark.read.format("las").option("points", 7).load(str(tmp_path / "small"))
    assert sorted(fine.collect()) == got and fine.rdd.getNumPartitions() >= 36
    box = (500010.0, 5999900.0, 500060.5, 5999980.0)
    assert sorted(las.read_points(spark, str(tmp_path / "small"), box).collect()) == [r for r in got if box[0] <= r.x <= box[2] and box[1] <= r.y <= box[3]]
    asked = las.Reader({"path": str(tmp_path / "small"), "box": ",".join(map(str, box))}).partitions()
    assert 0 < len(asked) < len(las.files(str(tmp_path / "small")))
    las.write_points(df.limit(0), str(tmp_path / "none"))
    assert las.read_points(spark, str(tmp_path / "none")).count() == 0
    # A file of version 1.4 and format 6, by hand, with its CRS as text and an end cut off.
    wkt = b'PROJCS["x"]\0'
    head = bytearray(375)
    head[:4], head[24], head[25] = b"LASF", 1, 4
    struct.pack_into("<HII", head, 94, 375, 375 + 54 + len(wkt), 1)
    struct.pack_into("<BHI", head, 104, 6, 30, 0)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 10, 20, 30)
    struct.pack_into("<Q", head, 247, 3)
    body = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(wkt), b"") + wkt + struct.pack("<iiiHBBB13x", 100, 200, 300, 7, 0, 0, 9) * 2
    (tmp_path / "b.las").write_bytes(bytes(head) + body + b"cut off")
    (r, _), m = las.read_points(spark, str(tmp_path / "b.las")).collect(), las.read_meta(spark, str(tmp_path / "b.las")).first()
    assert tuple(r) == (11.0, 22.0, 33.0, 7, 9) and m.wkt == 'PROJCS["x"]' and m.n == 3
    head[104] |= 0x80
    for bad in (bytes(head), b"LASF", b"other" * 100):
        with pytest.raises(ValueError):
            las.header(bad)


def test_stages_of_pipelines(spark):
    rows = [(1.0, 1.0, 0.0, 1, 1), (2.0, 1.0, 3.0, 1, 2), (3.0, 2.0, 3.5, 2, 2), (4.0, 9.0, 5.0, 1, 3), (25.0, 25.0, 7.0, 2, 3), (None, 1.0, 2.0, 3, 3)]
    pts = spark.createDataFrame(rows, "x double, y double, z double, ReturnNumber int, NumberOfReturns int").withColumn("Classification", F.col("ReturnNumber"))
    xs = lambda df: sorted((r.x for r in df.collect()), key=str)
    assert xs(stages.cropped(pts, "([1, 3], [0, 1.5])")) == [1.0, 2.0] and xs(stages.cropped(pts, "([1, 3], [0, 1.5])", True)) == [25.0, 3.0, 4.0]
    assert xs(stages.cropped(pts, "([0, 30], [0, 30], [3, 5])")) == [2.0, 3.0, 4.0]
    r = stages.transformed(pts, "0 -1 0 10 1 0 0 20 0 0 2 0 0 0 0 1").where("z = 14").first()
    assert (r.x, r.y, r.z) == (-15.0, 45.0, 14.0)
    there = stages.transformed(pts, "1 0 0 500000 0 1 0 6000000 0 0 1 0 0 0 0 1")
    back, _ = points.run(there, json.dumps({"pipeline": [{"type": "filters.reprojection", "in_srs": a, "out_srs": b} for a, b in (("EPSG:32630", "EPSG:4326"), ("EPSG:4326", "EPSG:32630"))]}))
    assert xs(back)[:5] == pytest.approx([500001.0, 500002.0, 500003.0, 500004.0, 500025.0], abs=1e-3)
    assert [r.Classification for r in stages.assigned(pts, "Classification[2:3]=9").orderBy("z").collect()] == [1, 9, 1, 9, 1, 9]
    assert {r.UserData for r in stages.assigned(pts, "UserData[:]=4").collect()} == {4}
    assert [xs(stages.returned(pts, g)) for g in ("first", "intermediate", "last", "only", "first, only")] == [[2.0, 4.0], [25.0], [3.0, None], [1.0], [1.0, 2.0, 4.0]]
    assert {(r.x, r.n) for r in stages.centroids(pts, 5.0).collect()} == {(2.0, 3), (4.0, 1), (25.0, 1)}
    assert {(r.x, r.raster_id) for r in stages.split(pts.where("x > 3"), 20.0).collect()} == {(4.0, "0/0"), (25.0, "1/1")}
    assert xs(stages.low_noise(pts, 10.0, 1.0).where("low")) == [1.0] and xs(stages.low_noise(pts, 10.0, 0.4).where("low")) == [1.0, 2.0, 3.0]
    out, said = points.run(pts, json.dumps({"pipeline": [{"type": "readers.las"}, {"type": "filters.elm"}, {"type": "filters.merge"}, {"type": "filters.stats"}]}))
    assert sorted(r.Classification for r in out.collect()) == [1, 1, 2, 2, 3, 7] and said["stats"]["z"] == {"min": 0.0, "max": 7.0, "mean": pytest.approx(20.5 / 6)}
    for bad in (lambda: stages.cropped(pts, "1, 2"), lambda: stages.transformed(pts, "1 2 3"), lambda: stages.assigned(pts, "z=1"), lambda: stages.assigned(pts, "no[1:2]=1"), lambda: stages.returned(pts, "third"), lambda: stages.sampled(pts, 0)):
        with pytest.raises(ValueError):
            bad()
    none = pts.limit(0)
    assert not any(f(none).count() for f in (stages.low_noise, lambda p: stages.sampled(p, 1.0), lambda p: stages.centroids(p, 1.0), lambda p: stages.split(p, 1.0)))


def test_low_noise_by_a_plain_loop(spark):
    rng = np.random.default_rng(8)
    rows = [(str(k % 2), *map(float, p)) for k, p in enumerate(np.column_stack([rng.uniform(0, 30, (300, 2)), rng.normal(0, 3, 300).round(1)]))] + [(None, 1.0, 1.0, -50.0), (None, 1.0, 1.0, 0.0)]
    got = sorted(map(tuple, stages.low_noise(spark.createDataFrame(rows, "raster_id string, x double, y double, z double"), 10.0, 0.5).collect()), key=str)
    cells = {}
    for r in rows:
        cells.setdefault((r[0], r[1] // 10, r[2] // 10), []).append(r)
    want = []
    for own in cells.values():
        own.sort(key=lambda r: r[3])
        low = True
        for a, b in zip(own, [*own[1:], None], strict=True):
            low = low and b is not None and b[3] - a[3] > 0.5
            want.append((*a, low))
    assert got == sorted(want, key=str) and 10 < sum(r[4] for r in want)


def test_sampled_points(spark):
    """As by loops in rounds, no two close and none left out without one close; repeated places and a cube with most of the points too."""
    rng = np.random.default_rng(9)
    places = [*rng.uniform(0, 6, (250, 3)).round(2), *rng.uniform(0, 0.3, (250, 3)).round(2)]
    rows = [(None if k % 3 else "b", *map(float, p), k) for k, p in enumerate([*places, *places[:20]])] + [("b", None, 1.0, 1.0, -1)]
    pts = spark.createDataFrame(rows, "raster_id string, x double, y double, z double, i int")
    hashed = pts.where("x IS NOT NULL").withColumn("h", F.xxhash64("x", "y", "z")).collect()
    first = {}
    for r in sorted(hashed, key=lambda r: (r.h, r.x, r.y, r.z, r.i)):
        first.setdefault((r.raster_id, r.x, r.y, r.z), r)
    close = lambda a, b: a.raster_id == b.raster_id and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 < 1
    left, want = [*first.values()], []
    while left:
        firsts = {}
        for r in left:
            firsts.setdefault((r.raster_id, *(v // (1 / math.sqrt(3)) for v in (r.x, r.y, r.z))), r)
        firsts = [*firsts.values()]
        kept = [r for k, r in enumerate(firsts) if not any(close(r, o) for o in firsts[:k])]
        want += kept
        left = [r for r in left if not any(close(r, o) for o in kept)]
    got = stages.sampled(pts, 1.0)
    assert got.columns == pts.columns and {r.i for r in got.collect()} == {r.i for r in want}
    assert not any(close(a, b) for k, a in enumerate(want) for b in want[:k]) and all(any(close(r, o) for o in want) for r in hashed)


def test_ground_by_numbers_of_a_stage(spark):
    pts = spark.createDataFrame([(x + 0.5, y + 0.5, 0.3 if (x, y) == (5, 5) else 0.0) for x in range(12) for y in range(12)], "x double, y double, z double")
    stage = {"type": "filters.pmf", "max_window_size": 9, "slope": 0.01, "max_distance": 0.1, "initial_distance": 0.1, "cell_size": 1.0}
    classes = lambda s: points.run(pts, json.dumps({"pipeline": [s]}))[0].where("Classification = 2").count()
    assert classes(stage) == 143 and classes({"type": "filters.pmf", "terrain": "forested"}) == 144


def test_pipelines_of_points(spark):
    pts = spark.createDataFrame([(x + 0.5, y + 0.5, 10.0 if (x, y) != (5, 5) else 300.0) for x in range(12) for y in range(12)], "x double, y double, z double")
    cells, said = points.run(pts, points.pipeline("a.las", "b.tif"))
    assert said == {"point_count": cells.count(), "stage_count": 5, "first_stage_type": "readers.las"} and cells.agg(F.max("z")).first()[0] == pytest.approx(10)
    for bad in ('{"pipeline": {}}', '{"pipeline": [1]}', '{"pipeline": [{}]}', '{"pipeline": [{"type": "filters.shell"}]}'):
        with pytest.raises(ValueError):
            points.checked(bad)
    assert len(points.STAGES) == 29
    some = spark.createDataFrame([(1, 0.5), (2, 1.5), (2, None), (3, 2.5)], "Classification int, z double")
    assert points.in_range(some, "Classification[2:2]").count() == 2 and points.in_range(some, "Classification![2:2], z[1:]").count() == 1
    assert points.ferried(some, "Classification=>UserData").columns[-1] == "UserData"
    for bad in ("moon[1:2]", "z(1)"):
        with pytest.raises(ValueError):
            points.in_range(some, bad)
    meta = spark.createDataFrame([(4326, None, "w", "p"), (None, "", "w", "p"), (None, None, None, "p"), (None, None, None, None)], "epsg int, compoundwkt string, wkt string, proj4 string")
    assert [r[0] for r in meta.select(points.crs_of(meta)).collect()] == ["EPSG:4326", "w", "p", None]


def test_models_over_tiles(spark):
    """A model that frames the brightest cell of its input, over overlapping tiles."""
    import numpy as np

    def brightest(x):
        at = np.unravel_index(np.nanargmax(x[0, 0]), x.shape[2:])
        return [np.array([[[at[1], at[0], at[1] + 1, at[0] + 1, float(x[0, 0][at]), 0]]])]

    z = raster(spark, lambda r, c: None if (r, c) == (0, 0) else float((r * 37 + c * 101) % 997), 20, 24)
    got = detect.detect(z, brightest, ["peak"], 8, 2, 8, 0.5, most=None).collect()
    h = {(r.r, r.c): r.z for r in z.collect()}
    assert len(got) == 3 * 4 and {r.label for r in got} == {"peak"}
    for r in got:
        own = {k: v for k, v in h.items() if v is not None and r.tr * 6 <= k[0] < r.tr * 6 + 8 and r.tc * 6 <= k[1] < r.tc * 6 + 8}
        if len(own) >= 63:  # tiles at the end are smaller and resized
            assert (r.y1, r.x1) == max(own, key=own.get)
    four = lambda x: [np.array([2]), np.array([[[0, 0, 4, 4], [1, 1, 1, 5], [0, 0, 8, 8]]]), np.array([[0.9, 0.9, 0.9]]), np.array([[1, 0, 0]])]
    boxes = detect.detect(z, four, ["a"], 24, 0, 8, most=None).collect()
    assert [(r.x2, r.y2, r.label) for r in boxes] == [(12.0, 10.0, "class_1")]
    assert detect.detect(z, lambda x: [np.zeros((1, 8, 8))], []).count() == 0
    whole = detect.model_input(np.array([[[0, 255], [51, 102]]]), 2)
    assert whole.shape == (1, 3, 2, 2) and whole[0, 2].tolist() == [[0.0, 1.0], [pytest.approx(0.2), pytest.approx(0.4)]]
    odd = detect.model_input(np.array([[[np.nan, np.inf], [-np.inf, 3.0]]]), 2)
    assert odd[0, 0].tolist() == [[0.0, 1.0], [0.0, 0.0]]
    assert detect.resized(np.array([[0.0, 4.0]]), 1, 4).tolist() == [[0.0, 1.0, 3.0, 4.0]]


def test_boxes_of_four_outputs(spark):
    rows = [(1, 2, [[0.0, 0.0, 1.0, 1.0], [0.0, 0.0, 2.0, 2.0], [0.0, 0.0, 3.0, 3.0]], [0.9, 0.1, 0.9], [4, 5, 6]), (2, 9, [[5.0, 5.0, 4.0, 9.0], [1.0, 1.0, 3.0, 3.0]], [0.9, 0.8], [0, 1]), (3, None, None, None, None), (4, 0, [[0.0, 0.0, 1.0, 1.0]], [0.9], [1])]
    got = detect.decode_parts(spark.createDataFrame(rows, "id int, num int, boxes array<array<double>>, scores array<double>, classes array<int>"), 0.25).collect()
    assert [(r.id, r.n, r.x2, r.class_id) for r in got] == [(1, 0, 1.0, 4), (2, 1, 3.0, 1)]


@pytest.mark.parametrize("kind", list(change.KERNELS))
def test_interpolation_keeps_planes_and_skips_nodata(spark, kind):
    z = raster(spark, lambda r, c: None if (r, c) == (6, 6) else 2.0 * r + c)
    got = grid(change.interpolate(z, 0.5, kind), "z")
    inside = {k: v for k, v in got.items() if 6 <= k[0] <= 16 and 6 <= k[1] <= 16 and max(abs(k[0] - 12), abs(k[1] - 12)) > 6 - 1}
    exact = 1e-9 if kind != "lanczos" else 0.2  # the window's weights don't reproduce planes exactly
    assert inside and all(abs(v - (k[0] + k[1] / 2)) < exact for k, v in inside.items() if max(abs(k[0] - 12), abs(k[1] - 12)) >= 6)
    flat = grid(change.interpolate(z.where("z IS NULL"), 0.5, kind), "z")
    assert flat == {}
    with pytest.raises(ValueError):
        change.interpolate(z, 0.5, "moon")


def test_field_records(spark):
    rows = [(5, 1.0, 2.0, None, None, None), (200_000, 1.0, 2.0, None, 0.9, "auto"), (7, None, 2.0, "x", None, None), (9, 3.0, 4.0, "mine", None, None)]
    found = field.anomalies(spark.createDataFrame(rows, "k bigint, x double, y double, anomaly_id string, confidence double, detection_method string"), "k").collect()
    assert {r.k: (r.anomaly_id, r.confidence, r.detection_method) for r in found} == {5: ("ANOM-0001", 0.5, "manual"), 9: ("mine", 0.5, "manual"), 200_000: ("ANOM-0003", 0.9, "auto")}
    assert {(r.feature_type, r.field_status, r.observer, r.photo_path, r.notes) for r in found} == {("unknown", "pending", "", "", "")} and all(r.timestamp[10] == "T" for r in found)
    box = field.footprints(spark.createDataFrame([(0.0, 0.0, 2.0, 1.5), (1.0, 1.0, 1.0, 5.0), (None, 0.0, 1.0, 1.0)], "x1 double, y1 double, x2 double, y2 double")).collect()
    assert [r.bbox for r in box] == ["0.00,0.00,2.00,1.50"] and box[0].wkt.startswith("POLYGON ((0.00 0.00, 2.00 0.00, 2.00 1.50")


def test_viewer_and_cloud_rasters(spark):
    rows = [(1, 0.0, 0.0, 10_000.0, 4.0, 2.0), (2, 0.0, 0.0, math.nan, 4.0, None), (3, 0.0, 0.0, 1e6, 4.0, -1.0)]
    got = {r.raster_id: (r.lon, r.zoom, r.opacity) for r in field.viewer(spark.createDataFrame(rows, "raster_id int, x0 double, y0 double, x1 double, y1 double, opacity double")).collect()}
    assert got == {1: (5000.0, 12, 1.0), 2: (0.0, 8, 1.0), 3: (500_000.0, 1, 0.0)}
    meta = spark.createDataFrame([(200, 200, 512, 0), (2000, 2000, 512, 0), (2000, 2000, 512, 2), (600, 9, 32, 1)], "rows int, cols int, block int, overviews int")
    assert [(r.level, r.valid) for r in field.cloud_check(meta).collect()] == [(0, True), (2, False), (2, True), (1, False)]
    assert [change.overview_levels(r, c) for r, c in ((200, 200), (2000, 2000), (600, 9))] == [0, 2, 1]


def test_detector_tiles_cover_the_raster(spark):
    z = raster(spark, lambda r, c: None if (r, c) == (0, 0) else float(c), 12, 20)
    got = field.detector_tiles(z, 12, 20, 8, 2).collect()
    assert {(r.tr, r.tc) for r in got} == {(a, b) for a in range(2) for b in range(3)}
    assert {(r.r, r.c) for r in got} == {(r, c) for r in range(12) for c in range(20)}
    one = {(r.r, r.c): r.x for r in got if (r.tr, r.tc) == (0, 0)}
    assert len(one) == 64 and one[0, 0] == 0 and one[1, 7] == 1 and abs(one[3, 3] - 3 / 7) < 1e-12


def test_names_and_recipes(spark):
    df = spark.createDataFrame([(" ../my  site*1 ",), ("",), (None,)], "n string")
    assert [r[0] for r in df.select(recipes.slug("n")).collect()] == ["my_site_1", "untitled", "untitled"]
    rows = [
        ('{"recipe_version":"1.0","algorithms":{}}', 1, 0),
        (recipes.export({"svf": {"search_radius": 5, "enabled": True, "moon": "x"}}, landscape_type="coastal"), 0, 0),
        ("[]", 1, 0),
        (None, 1, 0),
        ("{", 1, 0),
        ("{}", 2, 0),
        ('{"recipe_version":"1.0.0","algorithms":[]}', 1, 0),
        ('{"recipe_version":1,"algorithms":{"moon":{},"svf":3}}', 2, 1),
        ('{"recipe_version":"1.0.0","algorithms":{"svf":{"enabled":1,"search_radius":5.5,"noise_level":true},"hillshade":{"azimuths":3,"altitude":"4"},"asvf":{"azimuth":3}}}', 4, 0),
        ('{"recipe_version":"1.0.0","algorithms":{},"landscape_type":"lunar"}', 1, 0),
        ('{"recipe_version":"1.0.0","algorithms":{},"landscape_type":""}', 0, 0),
    ]
    got = recipes.check(spark.createDataFrame([(i, x) for i, (x, _, _) in enumerate(rows)], "i int, recipe string")).orderBy("i").collect()
    assert [(len(r.errors), len(r.warnings)) for r in got] == [(a, b) for _, a, b in rows]
    some = '{"algorithms":{"svf":{"enabled":true,"_x":1,"radius":5},"vat":{"enabled":true},"odd":7}}'
    assert recipes.to_presets(some) == {"svf": {"radius": 5}}
    assert spark.createDataFrame([(some,)], "recipe string").select(recipes.presets_of()).first()[0] == {"svf": {"radius": "5"}}
    assert recipes.preset("coastal")["slrm"] == {"radius": 25}
    with pytest.raises(ValueError):
        recipes.preset("moon")


def test_recipes_are_dealt_over_tasks(spark):
    """Recipes of one small file are checked by many tasks, and only what each has is looked into."""
    head = '{"recipe_version":"1.0.0","algorithms":'
    rows = [(0, head + '{"svf":null}}'), (1, head + '{"svf":{"enabled":null,"noise_level":1e3},"slope":3,"zeta":{}},"landscape_type":3}'), (2, None), (3, head + '{"mstp":{"local_radius":5000000000}}}')]
    rows += [(i, head + "{}}") for i in range(4, 400)]
    out = recipes.check(spark.createDataFrame(rows, "i int, recipe string").coalesce(1)).select("*", F.spark_partition_id().alias("task")).collect()
    assert len(out) == 400 and len({r.task for r in out}) > 4
    got = {r.i: (r.errors, r.warnings) for r in out}
    kind = "is of another kind"
    assert got[0] == (["svf isn't an object"], []) and got[2] == (["not an object"], []) and got[3] == got[9] == ([], [])
    assert got[1] == ([f"svf.enabled {kind}", f"svf.noise_level {kind}", "slope isn't an object", "landscape_type is unknown"], ["zeta is unknown"])


def test_batch_is_what_each_relief_is(spark):
    from tellur.operators import batch

    z = raster(spark, lambda r, c: math.sin(r * 0.7) * 5 + (c * c) % 7 if (r, c) != (4, 4) else None, 15, 14)
    got = {(r.r, r.c): r for r in batch.batch(z, list(batch.NAMES), "upland_steep").collect()}
    alone = {
        "hillshade": stencil.hillshade(z), "slope": stencil.slope(z), "tri": stencil.ruggedness(z), "svf": horizon.sky_view(z, 16, 5, 2), "asvf": horizon.anisotropic_sky_view(z, 16, 5, noise=2), "openness_negative": horizon.openness(z, True, 16, 5),
        "local_dominance": horizon.local_dominance(z, 5, 10, height=1.0), "slrm": windows.local_relief(z, 8), "red_relief": blend.red_relief(windows.local_relief(z, 8), stencil.slope(z)),
    }
    for name, x in alone.items():
        for k, v in grid(x, x.columns[-1]).items():
            assert (got[k][name] is None) == (v is None) and (v is None or abs(got[k][name] - v) < 1e-6), name
    assert len(got) == 210 and all(0 <= r.vat <= 255 and 0 <= r.e4mstp_red <= 255 for k, r in got.items() if k != (4, 4)) and got[4, 4].e4mstp_red == 0
    with pytest.raises(ValueError):
        batch.batch(z, ["moon"])


def test_principal_components_against_numpy(spark):
    import numpy as np

    from tellur import registry
    from tellur.plans import queries as Q

    got = registry.queries()["principal_components"](spark, "/root/testdata/sf0.001").toPandas().sort_values(["r", "c"])
    x = Q._layers(spark, "/root/testdata/sf0.001").toPandas().sort_values(["r", "c"])
    m = x[["hillshade", "slope", "openness", "svf"]].to_numpy()
    ok = ~np.isnan(m).any(axis=1)
    v = m[ok]
    z = (v - v.mean(axis=0)) / v.std(axis=0)
    values, vectors = np.linalg.eigh(np.cov(z, rowvar=False))
    vectors = vectors[:, np.argsort(-values)[:3]]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), range(3)])
    scores = z @ vectors
    low, high = np.percentile(scores, [2, 98], axis=0)
    want = np.clip((scores - low) / (high - low), 0, 1) * 255
    assert np.allclose(got[["pc1", "pc2", "pc3"]].to_numpy()[ok], want, atol=1e-4) and np.isnan(got[["pc1"]].to_numpy()[~ok]).all()


def test_ground_against_windows_by_numpy(spark):
    """The morphological filter over a rough surface with objects, against openings of whole arrays."""
    import numpy as np

    rng = np.random.default_rng(6)
    rows, cols = 30, 26
    h = np.add.outer(np.arange(rows) * 0.1, np.arange(cols) * 0.05) + rng.normal(0, 0.05, (rows, cols))
    h[8:12, 5:9] += 6
    h[20, 20] += 3
    window, slope, first, most, cell = points.GROUND["standard"]

    def sweep(z, k, f):
        p = np.pad(z, k, constant_values=np.nan)
        return f([p[i : i + rows, j : j + cols] for i in range(2 * k + 1) for j in range(2 * k + 1)], axis=0)

    surface, ok, last, k = h, np.ones(h.shape, bool), 1, 1
    while 2 * k + 1 <= window:
        surface = sweep(sweep(surface, k, np.nanmin), k, np.nanmax)
        ok &= h - surface <= min(most, first + slope * (2 * k + 1 - last) * cell)
        last, k = 2 * k + 1, 2 * k
    df = spark.createDataFrame([(c + 0.5, r + 0.5, float(h[r, c])) for r in range(rows) for c in range(cols)], "x double, y double, z double")
    got = {(int(p.y), int(p.x)): p.ground for p in points.ground(df).collect()}
    assert [got[r, c] for r in range(rows) for c in range(cols)] == ok.ravel().tolist() and not ok[9, 6]


def test_sinks(spark, tmp_path):
    from tellur.sinks import rasters
    from tellur.sources import cells as X

    z = raster(spark, lambda r, c: float(r * 100 + c), 20, 30)
    rasters.write_raster(z, str(tmp_path / "z"), 8)
    assert grid(rasters.read_raster(spark, str(tmp_path / "z")), "z") == grid(z, "z")
    part = rasters.read_raster(spark, str(tmp_path / "z"), (7, 9, 10, 20), 8)
    assert set(grid(part, "z")) == {(r, c) for r in range(7, 10) for c in range(10, 21)} and "PartitionFilters: [isnotnull(tile_r" in part._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="exists"):
        rasters.write_raster(z, str(tmp_path / "z"))
    rgb = z.select("r", "c", *(F.col("c").cast("int").alias(k) for k in ("red", "green", "blue")))
    rasters.write_colours(rgb, str(tmp_path / "rgb"))
    with pytest.raises(ValueError):
        rasters.write_colours(z, str(tmp_path / "rgb2"))
    rasters.write_change(change.difference(z, z.where("r > 0")), str(tmp_path / "dod"))
    assert {r.z for r in rasters.read_raster(spark, str(tmp_path / "dod/mask")).collect()} == {0, 255}
    found = field.anomalies(spark.createDataFrame([(1, 1.0, 2.0, None, None, None)], "k bigint, x double, y double, anomaly_id string, confidence double, detection_method string"), "k")
    layers = spark.createDataFrame([("a", "EPSG:1"), ("b", "")], "name string, crs string")
    path = rasters.write_package(found, layers, str(tmp_path), "My site!")
    assert path.endswith("/My_site_") and spark.read.parquet(f"{path}/project").first().crs == "EPSG:1" and spark.read.parquet(f"{path}/anomalies").columns[:9] == field.template(spark).columns
    with pytest.raises(Exception, match="exists"):
        rasters.write_package(found, layers, str(tmp_path), "My site!")
    with pytest.raises(ValueError):
        rasters.write_package(found, layers.where("crs = ''"), str(tmp_path), "other")
    moved = grid(X.shifted(z, 1, -2, -1.0), "z")
    assert moved[0, 0] == -1.0 and moved[1, 0] == 2.0 and moved[1, 29] == -1.0


def test_nodata_and_density(spark):
    df = spark.createDataFrame([(0, 0, -9999.0), (1, 1, float("nan")), (2, 1, 3.0)], "r int, c int, z double")
    assert [r[0] for r in df.select(cells.nodata(F.col("z"), -9999)).collect()] == [None, None, 3.0]
    assert cells.densify(df).count() == 6


def test_the_shared_folder_is_the_clusters(spark):
    from tellur.sources.durable import durable, shared_folder

    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert durable(spark.range(5)).count() == 5 and shared_folder(spark) in spark.sparkContext._jsc.sc().getCheckpointDir().get()


def test_entry_points_agree(spark):
    import __spark_entry__ as e

    q = e.queries()
    assert set(e.oracle_sql()) <= set(q) and "slope" in q


def plain_suppression(boxes, by, threshold=0.45):
    """The ids that the greedy rule keeps over all boxes of a group, wherever they lie."""
    want, kept = [], {}
    for r in sorted(boxes, key=lambda r: (-r.confidence, r.id)):
        held = kept.setdefault(tuple(r[k] for k in by), [])
        x1, y1, x2, y2 = np.array(held).reshape(-1, 4).T
        both = np.maximum(0, np.minimum(r.x2, x2) - np.maximum(r.x1, x1)) * np.maximum(0, np.minimum(r.y2, y2) - np.maximum(r.y1, y1))
        if not (both / ((r.x2 - r.x1) * (r.y2 - r.y1) + (x2 - x1) * (y2 - y1) - both) >= threshold).any():
            held.append((r.x1, r.y1, r.x2, r.y2))
            want.append(r.id)
    return sorted(want)


@pytest.mark.parametrize("at_once", [100_000, 300])
@pytest.mark.parametrize("name, by", [("detections_suppress", ("class_id", "scene")), ("detections_suppress_dense", ("class_id",))])
def test_suppression_of_a_whole_class(spark, monkeypatch, name, by, at_once):
    """The queries against the greedy rule, in scenes and in one dense field, in one task and in many fields."""
    from tellur import registry
    from tellur.plans import queries as Q

    monkeypatch.setattr(detect, "AT_ONCE", at_once)
    boxes = Q.D.decode(Q._outputs(spark, "/root/testdata/sf0.01"), 0.1).collect()
    want = plain_suppression(boxes, by)
    got = [r.id for r in registry.queries()[name](spark, "/root/testdata/sf0.01").collect()]
    assert sorted(got) == want and len(want) < len(boxes)


def test_suppression_in_bands(spark, monkeypatch):
    """Dense groups by bands of confidence against the greedy rule, with equal, missing and NaN confidences; groups of few boxes and null classes beside them."""
    monkeypatch.setattr(detect, "DENSE", 3)
    monkeypatch.setattr(detect, "BAND", 2)
    rng = np.random.default_rng(7)
    at, side = rng.uniform(0, 60, (300, 2)), rng.uniform(15, 25, (300, 2))
    sure = [None, math.nan, *rng.integers(1, 40, 298).tolist()]
    rows = [(i, *map(float, a), *map(float, a + b), None if c is None else float(c), i % 2) for i, (a, b, c) in enumerate(zip(at, side, sure, strict=True))]
    rows += [(1000 + i, 0.0, 0.0, 9.0, 9.0, float(i), 2 if i < 2 else None) for i in range(4)]
    boxes = spark.createDataFrame(rows, "id int, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int")
    assert detect.banded(boxes, ("class_id",), 32)[1] > 2
    as_rank = lambda r: Row(**(r.asDict() | {"confidence": math.inf if r.confidence is None else -math.inf if r.confidence != r.confidence else r.confidence}))
    want = plain_suppression([as_rank(r) for r in boxes.where("class_id IS NOT NULL").collect()], ("class_id",))
    assert sorted(r.id for r in detect.suppress(boxes).collect()) == [*want, 1002, 1003]


def test_what_is_left_of_a_band_is_divided(spark, monkeypatch):
    """A band whose boxes gather where nothing stayed before doesn't make the square of its boxes in overlaps."""
    rows = [(i, x := 0.0 if i >= 900 else 400.0, x, x + 20.0, x + 20.0, float(i), 0) for i in range(2000)]
    boxes = spark.createDataFrame(rows, "id int, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int")
    met, real = [], detect.overlaps
    monkeypatch.setattr(detect, "overlaps", lambda *a: met.append((x := real(*a)).count()) or x)
    assert sorted(r.id for r in detect.suppress(boxes).collect()) == [899, 1999] and sum(met) < 10_000


@pytest.mark.parametrize("held, by", [(500_000, ("class_id",)), (40, ("class_id",)), (500_000, ())])
def test_suppression_by_boxes_sent_or_joined(spark, monkeypatch, held, by):
    """Boxes kept are sent to all tasks, or joined beyond HELD, to the same end; those of null classes stay."""
    monkeypatch.setattr(detect, "DENSE", 3)
    monkeypatch.setattr(detect, "BAND", 2)
    monkeypatch.setattr(detect, "HELD", held)
    rng = np.random.default_rng(13)
    at, side = rng.uniform(-90, 90, (400, 2)).round(1), rng.uniform(10, 40, (400, 2)).round(1)
    rows = [(i, *map(float, a), *map(float, a + b), i * 7 % 50 / 50, i % 2 if i < 390 or not by else None) for i, (a, b) in enumerate(zip(at, side, strict=True))]
    boxes = spark.createDataFrame(rows, "id bigint, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int")
    want = plain_suppression([r for r in boxes.collect() if r.class_id is not None], by) + [*range(390, 400)] * bool(by)
    assert sorted(r.id for r in detect.suppress(boxes, by=by).collect()) == want
    stay, group = rng.uniform(-60, 60, (30, 2)), F.xxhash64(*by) if by else F.lit(0).cast("bigint")
    stay = np.concatenate([stay, stay + 30], axis=1)
    code = boxes.where("class_id = 1").select(group).first()[0]
    found = {most: sorted(r.id for r in detect.untaken(boxes, stay, np.full(30, code), 0.3, by, 16, most).collect()) for most in (5, 1 << 20)}
    x, y = (np.minimum((at + side)[:, None, k], stay[:, k + 2]) - np.maximum(at[:, None, k], stay[:, k]) for k in (0, 1))
    both = np.maximum(x, 0) * np.maximum(y, 0)
    taken = (both / (side.prod(axis=1)[:, None] + 900 - both) >= 0.3).any(axis=1)
    left = [r[0] for r in rows if not taken[r[0]] or by and r[-1] != 1]
    assert found[5] == found[1 << 20] == left and len(left) < 390


@pytest.mark.parametrize("crowd, part", [(100, 2_048), (3, 7), (0, 50)])
def test_overlaps_of_crowded_cells(spark, monkeypatch, crowd, part):
    """All pairs against a plain loop, whether cells are joined by rows or compared by arrays in parts; null classes meet nothing."""
    monkeypatch.setattr(detect, "CROWD", crowd)
    monkeypatch.setattr(detect, "PART", part)
    rng = np.random.default_rng(5)
    at, side = rng.uniform(-40, 40, (150, 2)).round(1), rng.uniform(4, 50, (150, 2)).round(1)
    rows = [(i, *map(float, a), *map(float, a + s), i % 3 if i % 3 < 2 else None) for i, (a, s) in enumerate(zip(at, side, strict=True))]
    boxes = spark.createDataFrame(rows, "id bigint, x1 double, y1 double, x2 double, y2 double, class_id int")
    want = {}
    for a in rows:
        for b in rows[a[0] + 1 :]:
            both = max(0.0, min(a[3], b[3]) - max(a[1], b[1])) * max(0.0, min(a[4], b[4]) - max(a[2], b[2]))
            iou = both / ((a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - both)
            if a[5] is not None and a[5] == b[5] and iou >= 0.3:
                want[a[0], b[0]] = iou
    got = [(r.a, r.b, r.iou) for r in detect.overlaps(boxes, 0.3, 32).collect()]
    assert len(got) == len(want) > 50 and {(a, b): x for a, b, x in got} == pytest.approx(want, abs=1e-12)
    named = detect.overlaps(boxes.withColumn("id", F.format_string("b%03d", "id")), 0.3, 32).collect()
    assert {(int(r.a[1:]), int(r.b[1:])) for r in named} == set(want)


def test_boxes_of_a_crowded_cell_are_sent_once(spark, monkeypatch):
    """3,000 boxes that begin their overlaps in one cell go to one task once each, and their pairs come in pieces."""
    rng = np.random.default_rng(11)
    xy = rng.uniform(0, 15, (3000, 2))
    xy = np.concatenate([xy, xy + rng.uniform(18, 24, (3000, 2))], axis=1)
    boxes = spark.createDataFrame([(i, *map(float, x), 0) for i, x in enumerate(xy)], "id bigint, x1 double, y1 double, x2 double, y2 double, class_id int")
    sent, kind = [], type(boxes)
    real = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *a: sent.append(self) or real(self, *a))
    found = detect.overlaps(boxes, 0.3, 32)
    assert [x.count() for x in sent] == [3000]
    x, y = (np.minimum(xy[:, None, k + 2], xy[:, k + 2]) - np.maximum(xy[:, None, k], xy[:, k]) for k in (0, 1))
    area = (xy[:, 2] - xy[:, 0]) * (xy[:, 3] - xy[:, 1])
    both = np.maximum(x, 0) * np.maximum(y, 0)
    want = np.triu(both / (area[:, None] + area - both) >= 0.3, 1)
    assert found.count() == want.sum() > 1_000_000
    monkeypatch.setattr(detect, "PAIRS", 10_000)
    pieces = [*detect.near(xy, None, 0.3, 32, (0, 0))]
    assert max(len(p[0]) for p in pieces) < 10_000 + 64 * 1024 and sum(len(p[0]) for p in pieces) == want.sum()
    assert {(min(p), max(p)) for p in zip(*(x.tolist() for x in pieces[0][:2]), strict=True)} <= set(zip(*(x.tolist() for x in np.nonzero(want)), strict=True))


@pytest.mark.parametrize("at_once", [100_000, 300])
def test_suppression_along_a_chain(spark, monkeypatch, at_once):
    """Boxes of which each overlaps the next and is stronger: every second one stays, however many depend on each other."""
    monkeypatch.setattr(detect, "AT_ONCE", at_once)
    boxes = spark.createDataFrame([(i, i * 30.0, 0.0, i * 30.0 + 100, 50.0, 1 - i / 2000, 0) for i in range(1000)], "id int, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int")
    began = time.time()
    assert sorted(r.id for r in detect.suppress(boxes).collect()) == [*range(0, 1000, 2)]
    assert time.time() - began < (10 if at_once > 1000 else 60)
    few = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, 0.5, 0), (1, 0.0, 0.0, 1.0, 1.0, 0.5, 0), (None, 0.0, 0.0, 1.0, 1.0, 0.9, 1)], boxes.schema)
    assert detect.suppress(few).count() == 2 and detect.suppress(boxes.limit(0)).count() == 0


def test_detector_suppresses_over_tiles(spark):
    """A box in the overlap of two tiles is found twice and stays once, in each of two rasters."""

    def bright(x):
        at = np.argwhere(x[0, 0] >= 1)
        return [np.array([[[c, r, c + 1, r + 1, 0.9, 0] for r, c in at]]).reshape(1, -1, 6)]

    z = raster(spark, lambda r, c: 1.0 if (r, c) in ((7, 7), (2, 11)) else 0.0, 14, 14).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("raster_id"), "*")
    got = detect.detect(z, bright, ["peak"], 8, 2, 8, 0.5)
    assert sorted((r.raster_id, r.x1, r.y1) for r in got.collect()) == [(k, *at) for k in (1, 2) for at in ((7.0, 7.0), (11.0, 2.0))]
    assert detect.detect(z, bright, ["peak"], 8, 2, 8, 0.5, most=None).count() == 2 * 5


COMPANY = {
    "slrm": lambda x: windows.local_relief(x, 3),
    "slope": stencil.slope,
    "mstp": lambda x: windows.topographic_position(x, 1, 2, 4),
    "red_relief": lambda x: blend.red_relief(windows.local_relief(x, 2), stencil.slope(x)),
    "vat": lambda x: blend.vat(horizon.measures(x, {"hillshade": ("hillshade", {}), "slope": ("slope", {}), "openness": ("openness", {"directions": 4, "radius": 2}), "svf": ("svf", {"directions": 4, "radius": 2})})),
    "principal": lambda x: blend.principal(horizon.measures(x, {"m0": ("hillshade", {}), "m1": ("slope", {}), "m2": ("svf", {"directions": 4, "radius": 2}), "m3": ("slrm", {"radius": 2})}), ["m0", "m1", "m2", "m3"]),
    "fuse": lambda x: change.fuse(x, x.select(*[k for k in ("raster_id",) if k in x.columns], "r", "c", F.col("z").alias("p"), (F.col("z") * F.col("c")).alias("q"), F.col("r").cast("double").alias("s")), ("p", "q", "s"), "luminance", 0.6),
    "prescale": lambda x: blend.prescale(x, x.withColumn("z", F.col("z") - 4))[1],
    "histogram": lambda x: change.histogram(x, 7),
    "range": change.display_range,
    "statistics": change.statistics,
    "interpolate": lambda x: change.interpolate(x, 0.7, "cubic", 0.2, 0.3),
    "bilinear": lambda x: change.bilinear(x, 1.5),
    "tiles": lambda x: field.detector_tiles(x, tile=6, overlap=2),
    "batch": lambda x: batch.batch(x, ["slrm", "vat", "red_relief", "tri", "mstp"]),
}


@pytest.mark.parametrize("name", COMPANY)
def test_a_raster_is_what_it_is_alone(spark, name):
    """Beside one of another shape that is fifty times as high."""
    make = COMPANY[name]
    low = raster(spark, lambda r, c: None if (r + c) % 11 == 5 else float((r * 37 + c * 101) % 97) / 9, 13, 17)
    high = raster(spark, lambda r, c: None if (r, c) == (2, 2) else float((r * 53 + c * 19) % 89) * 50 + 300, 22, 9)
    named = lambda x, k: x.select(F.lit(k).cast("int").alias("raster_id"), "*")
    both = make(named(low, 1).unionByName(named(high, 2)))
    for k, x in ((1, low), (2, high)):
        alone = make(x)
        rows = lambda df: sorted((tuple(None if v is None else round(v, 7) for v in r) for r in df.select(*alone.columns).collect()), key=str)  # noqa: B023, E731
        assert rows(both.where(F.col("raster_id") == k)) == rows(alone), k


def test_quantiles_of_many_rasters(spark, monkeypatch):
    """Large and small rasters at once, by bins of a few, against numpy."""
    from tellur.operators import ranges

    monkeypatch.setattr(ranges, "BINS", 8)
    rng = np.random.default_rng(5)
    sets = {1: rng.normal(size=900), 2: rng.integers(0, 3, 700) * 1.0, 3: np.concatenate([rng.normal(size=400) * 1e-9, [1e9] * 200]), 4: np.full(500, 7.0), 5: rng.normal(size=20), None: rng.normal(size=300) * 1e300}
    rows = [(k, float(v)) for k, x in sets.items() for v in x] + [(6, None), (1, None)]
    shares = [0.0, 0.02, 0.25, 0.5, 0.98, 1.0]
    got = {r[0]: r[1:] for r in ranges.quantiles_of(spark.createDataFrame(rows, "raster_id int, z double"), "z", shares, most=100, left=30).collect()}
    assert set(got) == set(sets)
    for k, x in sets.items():
        assert got[k] == pytest.approx(np.quantile(x, shares)), k
    alone = spark.createDataFrame([(float(v),) for v in sets[1]], "z double")
    for most in (100, 10_000):
        assert list(ranges.quantiles_of(alone, "z", shares, most=most, left=30).first()) == pytest.approx(np.quantile(sets[1], shares))
    assert ranges.quantiles_of(alone.limit(0), "z", shares).count() == 0


@pytest.mark.parametrize("radius", [2, 5, 30])
def test_wide_windows_by_strips(spark, monkeypatch, radius):
    """Windows summed axis by axis in strips are those of square blocks, and those of a plain loop."""
    z = raster(spark, lambda r, c: None if (r * c) % 7 == 3 else float((r * 37 + c * 101) % 97) + 1e6, 21, 33)
    two = z.withColumn("raster_id", F.lit(1)).unionByName(z.where("r < 9").withColumn("z", F.col("z") * 3).withColumn("raster_id", F.lit(2)))
    near = {k: {(r.raster_id, r.r, r.c): r[k] for r in make(two).collect()} for k, make in (("mean", lambda x: windows.box_mean(x, radius)), (f"dev_{radius}", lambda x: windows.deviations(x, (1, radius))))}
    monkeypatch.setattr(windows, "WIDE", 1)
    monkeypatch.setattr(windows, "STRIP", 4)
    for k, make in (("mean", lambda x: windows.box_mean(x, radius)), (f"dev_{radius}", lambda x: windows.deviations(x, (1, radius)))):
        far = {(r.raster_id, r.r, r.c): r[k] for r in make(two).collect()}
        assert far.keys() == near[k].keys()
        assert all((far[at] is None) == (v is None) and (v is None or abs(far[at] - v) < 1e-6) for at, v in near[k].items())
    x = np.array([[np.nan if (r * c) % 7 == 3 else float((r * 37 + c * 101) % 97) + 1e6 for c in range(33)] for r in range(21)])
    x = np.where(np.isnan(x), np.nanmean(x), x)
    padded = np.pad(x, radius, mode="symmetric")
    for (k, r, c), v in near["mean"].items():
        if k == 1 and v is not None:
            assert abs(v - padded[r : r + 2 * radius + 1, c : c + 2 * radius + 1].mean()) < 1e-6
            own = x[max(0, r - radius) : r + radius + 1, max(0, c - radius) : c + radius + 1]
            assert abs(near[f"dev_{radius}"][k, r, c] - (x[r, c] - own.mean()) / own.std()) < 1e-6


def test_running_extremes_and_openings():
    rng = np.random.default_rng(2)
    z = rng.normal(size=(17, 23))
    z[rng.random(z.shape) < 0.3] = np.nan
    for k in (1, 2, 5, 30):
        p = np.pad(z, k, constant_values=np.nan)
        near = lambda p, f: np.array([[f(p[r : r + 2 * k + 1, c : c + 2 * k + 1]) for c in range(23)] for r in range(17)])  # noqa: B023, E731
        assert np.array_equal(points.running(np.where(np.isnan(z), np.inf, z), k, np.minimum, np.inf), near(p, np.nanmin))
        low = np.where(np.isnan(z), np.nan, near(p, np.nanmin))
        want = np.where(np.isnan(z), np.nan, near(np.pad(low, k, constant_values=np.nan), np.nanmax))
        assert np.array_equal(points.opened(z, k), want, equal_nan=True)


def plain_cloth(low, rigidness, time_step, slopes, iterations):
    """One whole cloth over a dense array."""
    from tellur.operators import cloth

    under = np.where(np.isnan(low), -np.inf, -low)
    now = before = np.full(low.shape, np.nanmax(-low) + 1.0)
    fixed = np.zeros(low.shape, bool)
    for _ in range(iterations):
        now, before, fixed = cloth.fall(under, now, before, fixed, rigidness, time_step)
        if np.abs(now - before).max() < cloth.STILL:
            break
    return -(cloth.laid(under, now, fixed)[0] if slopes else now)


@pytest.mark.parametrize("tile, halo", [(512, 128), (16, 16), (11, 4)])
def test_a_cloth_is_the_same_for_any_tiles(spark, tile, halo):
    """Two clouds of other size and rest, with holes and a house wider than a tile."""
    from tellur.operators import cloth

    rng = np.random.default_rng(4)
    clouds = {}
    for k, (h, w) in {1: (30, 41), 2: (9, 23)}.items():
        z = np.add.outer(np.arange(h) * 0.1, np.arange(w) * 0.05) + rng.normal(0, 0.05, (h, w)) + k
        z[5 : h // 2, 6 : w // 2] += 5
        z[rng.random((h, w)) < 0.2] = np.nan
        z[0, 0] = z[-1, -1] = k
        clouds[k] = z
    low = spark.createDataFrame([(k, r - 4, c + 9, float(z[r, c])) for k, z in clouds.items() for r, c in np.argwhere(~np.isnan(z)).tolist()], "raster_id int, r int, c int, z double")
    got = {(x.raster_id, x.r, x.c): x.cloth for x in cloth.cloth_of(low, 2, 0.65, True, 24, tile, halo).collect()}
    want = {(k, r - 4, c + 9): plain_cloth(z, 2, 0.65, True, 24)[r, c] for k, z in clouds.items() for r, c in np.argwhere(~np.isnan(z)).tolist()}
    assert got == want
    if tile != 16:
        alone = low.where("raster_id = 2").drop("raster_id")
        assert {(2, x.r, x.c): x.cloth for x in cloth.cloth_of(alone, 3, 0.65, False, 400 if tile == 512 else 10, tile, halo).collect()} == {(2, r - 4, c + 9): plain_cloth(clouds[2], 3, 0.65, False, 400 if tile == 512 else 10)[r, c] for r, c in np.argwhere(~np.isnan(clouds[2])).tolist()}
        assert cloth.cloth_of(alone.limit(0)).count() == 0


@pytest.mark.parametrize("power, smoothing", [(2.0, 1.0), (3.0, 0.5)])
def test_inverse_distances_of_all_points(spark, monkeypatch, power, smoothing):
    """Every cell against all points: within the stated bound, and far closer; crowded cells in parts; clouds apart."""
    from tellur.operators import distance

    monkeypatch.setattr(distance, "BLOCK", 32)
    monkeypatch.setattr(distance, "POINTS", 300)
    rng = np.random.default_rng(7)
    clouds = {1: np.column_stack([rng.uniform(-40, 110, (2500, 2)), rng.uniform(0, 50, 2500)]), 2: np.column_stack([rng.uniform(0, 12, (40, 2)), rng.uniform(90, 99, 40)])}
    clouds[1] = np.concatenate([clouds[1], np.column_stack([rng.uniform(3, 4, (1200, 2)), np.full(1200, 80.0)])])
    df = spark.createDataFrame([(k, *map(float, p)) for k, x in clouds.items() for p in x] + [(1, None, 0.0, 1.0)], "raster_id int, x double, y double, z double")
    got = {(x.raster_id, x.r, x.c): x.z for x in points.inverse_distance(df, 1.0, power, smoothing).collect()}
    worst = 0.0
    for k, x in clouds.items():
        (c0, r0), (c1, r1) = np.floor(x[:, :2].min(axis=0)).astype(int), np.floor(x[:, :2].max(axis=0)).astype(int)
        cells = [(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)]
        assert {at for at in got if at[0] == k} == {(k, *at) for at in cells}
        t = np.array(cells)[:, ::-1] + 0.5
        for i in range(0, len(t), 2000):
            w = (((t[i : i + 2000, None] - x[None, :, :2]) ** 2).sum(axis=2) + smoothing**2) ** (-power / 2)
            want = (w @ x[:, 2]) / w.sum(axis=1)
            worst = max(worst, np.abs(want - [got[(k, *at)] for at in cells[i : i + 2000]]).max())
    assert worst < 2 * distance.bound(power=power) * 80 and worst < 0.0015 * 80, worst
    assert points.inverse_distance(df.limit(0)).count() == 0


def test_places_in_other_crs(spark):
    """A known place, and there and back again within a millimetre over whole zones, both hemispheres and the plane of the web."""
    from tellur.functions import projection

    rows = [(float(lon), float(lat)) for lon in np.linspace(3, 9, 7) for lat in (-79, -33.3, -0.001, 0, 12.5, 48.8583, 83)] + [(2.2945, 48.8583)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    for crs in ("EPSG:32631", "EPSG:32632", "EPSG:32731", "EPSG:3857", "EPSG:4326"):
        there = projection.from_degrees(df, crs)
        for r in projection.to_degrees(there, crs, lon="lon2", lat="lat2").collect():
            assert abs(r.lon - r.lon2) * 111_320 * math.cos(math.radians(r.lat)) < 1e-3 and abs(r.lat - r.lat2) * 111_320 < 1e-3
            if crs == "EPSG:32631" and r.lon == 2.2945:
                assert abs(r.x - 448_251.9) < 0.05 and abs(r.y - 5_411_943.8) < 0.05
    with pytest.raises(ValueError):
        projection.turned(df, "EPSG:27700", "EPSG:4326", "lon", "lat")


@pytest.mark.parametrize("kind", ["bilinear", "nearest"])
def test_rasters_between_crs(spark, kind):
    """A plane over the ground, seen from the next zone, is the plane there; two rasters at once; holes stay holes; one CRS is an alignment."""
    from tellur.functions import projection

    old = {"x0": 700_000.0, "y0": 5_000_000.0, "px_w": 10.0, "px_h": -10.0, "rows": 12, "cols": 15}
    new = {"x0": 228_100.0, "y0": 5_002_700.0, "px_w": 6.0, "px_h": -7.5, "rows": 40, "cols": 45}
    at = spark.range(new["rows"] * new["cols"]).select((F.col("id") / new["cols"]).cast("int").alias("r"), (F.col("id") % new["cols"]).cast("int").alias("c"))
    at = at.withColumns({"x": new["x0"] + (F.col("c") + 0.5) * new["px_w"], "y": new["y0"] + (F.col("r") + 0.5) * new["px_h"]})
    plane = projection.turned(at, "EPSG:32632", "EPSG:32631").select("r", "c", ((F.col("x") - 700_000) * 0.3 + (F.col("y") - 5_000_000) * 0.7).alias("z"))
    plane = spark.createDataFrame(plane.collect(), plane.schema)
    holed = plane.withColumn("z", F.when((F.col("r") - 20) * (F.col("r") - 20) + (F.col("c") - 20) * (F.col("c") - 20) > 60, F.col("z")))
    two = plane.withColumn("raster_id", F.lit(1)).unionByName(holed.withColumn("raster_id", F.lit(2)))
    got = {(r.raster_id, r.r, r.c): r.z for r in change.warped(two, new, "EPSG:32632", old, "EPSG:32631", kind).collect()}
    for r in range(12):
        for c in range(15):
            assert abs(got[1, r, c] - ((c + 0.5) * 3 - (r + 0.5) * 7)) < (0.05 if kind == "bilinear" else 4.0)  # a plane in one zone bends a little in the other
    assert 0 < 180 - sum(k[0] == 2 for k in got) < 60
    z = raster(spark, lambda r, c: r * 2.0 + c, 8, 8)
    grid_a, grid_b = {"x0": 0.0, "y0": 0.0, "px_w": 1.0, "px_h": -1.0, "rows": 8, "cols": 8}, {"x0": 1.0, "y0": -1.0, "px_w": 2.0, "px_h": -0.5, "rows": 6, "cols": 3}
    for r in change.warped(z, grid_a, "EPSG:32631", grid_b, "EPSG:32631").collect():  # cells of other shape, each axis by its own step
        assert abs(r.z - (2 * (1 + (r.r + 0.5) * 0.5 - 0.5) + 1 + (r.c + 0.5) * 2 - 0.5)) < 1e-9
    with pytest.raises(ValueError):
        change.warped(z, grid_a, "EPSG:32631", grid_b, "EPSG:4326", "cubic")


def test_geopackages(spark, tmp_path):
    """Points and outlines read back by SQLite, with the tables that the format asks for; no CRS, no file."""
    import sqlite3
    import struct

    from tellur.sinks import geopackage

    found = field.anomalies(spark.createDataFrame([(1, 1.5, 2.5, "it's"), (2, -4.0, 8.0, None), (3, None, 1.0, None)], "k bigint, x double, y double, notes string"), "k").drop("k").repartition(1)
    geopackage.write_geopackage(found, str(tmp_path / "a"), "anomalies", "EPSG:32630")
    db = sqlite3.connect(next(iter((tmp_path / "a").glob("*.gpkg"))))
    rows = db.execute("SELECT geom, anomaly_id, detection_method, confidence, feature_type, field_status, notes FROM anomalies ORDER BY anomaly_id").fetchall()
    assert [(struct.unpack("<iBI2d", g[4:]), *r) for g, *r in rows] == [((32630, 1, 1, 1.5, 2.5), "ANOM-0001", "manual", 0.5, "unknown", "pending", "it's"), ((32630, 1, 1, -4.0, 8.0), "ANOM-0002", "manual", 0.5, "unknown", "pending", "")]
    assert db.execute("SELECT min_x, min_y, max_x, max_y, srs_id FROM gpkg_contents").fetchall() == [(-4.0, 2.5, 1.5, 8.0, 32630)] and db.execute("PRAGMA application_id").fetchone()[0] == 0x47504B47
    assert db.execute("SELECT geometry_type_name FROM gpkg_geometry_columns").fetchall() == [("POINT",)] and db.execute("SELECT organization_coordsys_id FROM gpkg_spatial_ref_sys WHERE srs_id = 32630").fetchone() == (32630,)
    boxes = spark.createDataFrame([(0.0, 0.0, 2.0, 1.0, 0.9, 3, True)], "x1 double, y1 double, x2 double, y2 double, confidence double, class_id int, sure boolean")
    geopackage.write_geopackage(boxes, str(tmp_path / "b"), "finds", "EPSG:4326")
    files = [sqlite3.connect(f).execute("SELECT geom, confidence, class_id FROM finds").fetchall() for f in (tmp_path / "b").glob("*.gpkg")]
    (g, confidence, class_id), = (r for f in files for r in f)
    assert struct.unpack("<BIII10d", g[8:])[:4] == (1, 3, 1, 5) and struct.unpack("<10d", g[21:]) == (0, 0, 2, 0, 2, 1, 0, 1, 0, 0) and (confidence, class_id) == (0.9, 3)
    geopackage.write_geopackage(boxes.limit(0), str(tmp_path / "c"), "finds", "EPSG:4326")
    for bad in (None, "", "WGS 84"):
        with pytest.raises(ValueError):
            geopackage.write_geopackage(boxes, str(tmp_path / "d"), "finds", bad)
    with pytest.raises(ValueError):
        geopackage.write_geopackage(boxes, str(tmp_path / "b"), "finds", "EPSG:4326")


def test_geotiffs(spark, tmp_path):
    """Rasters of several types, places and files there and back; a window opens its tiles only; overviews are the pyramid's."""
    from tellur.sources import geotiff

    at = {"x0": 500_000.0, "y0": 6_000_000.0, "px_w": 0.5, "px_h": -2.0}
    z = raster(spark, lambda r, c: None if (r * c) % 13 == 5 else r * 100 + c / 8, 70, 45).withColumns({"r": F.col("r") - 6, "c": F.col("c") + 9})
    two = z.select(F.lit("a").alias("raster_id"), "*").unionByName(z.where("r < 10").select(F.lit("b").alias("raster_id"), "r", "c", (-F.col("z")).alias("z")))
    for dtype in ("float64", "float32"):
        geotiff.write_geotiff(two, path := str(tmp_path / dtype), at, 32630, dtype, tile=16, side=32, levels=1)
        meta = {r.file.rsplit("/")[-1]: r for r in geotiff.read_meta(spark, path).collect()}
        assert len(meta) == 3 * 2 + 2 and meta["a_1_1.tif"][1:11] == (32, 13, 1, 500_000 + (9 + 32) * 0.5, 6_000_000 + (32 - 6) * -2.0, 0.5, -2.0, 32630, -9999.0, 16)
        named = geotiff.read_geotiff(spark, path).withColumn("_p", F.regexp_extract("file", r"/(\w)_(\d+)_(\d+)\.tif", 0))
        place = F.split(F.regexp_replace("_p", r"[/]|\.tif", ""), "_")
        back = named.select(place[0].alias("raster_id"), (F.col("r") + place[1].cast("int") * 32 - 6).alias("r"), (F.col("c") + place[2].cast("int") * 32 + 9).alias("c"), "z")
        assert {(r.raster_id, r.r, r.c): r.z for r in back.collect()} == {(r.raster_id, r.r, r.c): r.z for r in two.collect()}
        over = geotiff.read_geotiff(spark, f"{path}/a_0_0.tif", level=1)
        want = grid(change.pyramid(z.select(F.col("r") + 6, F.col("c") - 9, "z").toDF("r", "c", "z"), 1), "z")
        assert all(v is None or abs(v - want[k]) < 1e-2 for k, v in grid(over, "z").items()) and over.where("z IS NOT NULL").count() == 256
    with pytest.raises(ValueError):
        geotiff.write_geotiff(z, path, at)
    bands = z.where("z IS NOT NULL").select("r", "c", (F.col("r") % 200 + 6).alias("red"), F.col("c").alias("green"))
    geotiff.write_geotiff(bands, path := str(tmp_path / "bytes"), at, 4326, "uint8", 255, tile=16, levels=0)
    got = {(r.band, r.r, r.c): r.z for r in geotiff.read_geotiff(spark, path).where("z IS NOT NULL").collect()}
    assert got == {(b, r.r + 6, r.c - 9): float(v) for r in bands.collect() for b, v in ((1, r.red), (2, r.green))}
    # Bytes of all tiles but those of the window are spoilt: the window doesn't touch them.
    name = f"{tmp_path}/bytes/raster_0_0.tif"
    d = geotiff.read_head(name)[0]
    with open(name, "r+b") as f:
        for t, (o, n) in enumerate(zip(d["offsets"], d["counts"], strict=True)):
            if t % 15 not in (4, 5):  # 3 tiles across, 5 down, two bands
                f.seek(o)
                f.write(b"\xff" * n)
    part = geotiff.read_geotiff(spark, path, (17, 31, 20, 44))
    assert {(r.band, r.r, r.c) for r in part.collect()} == {(b, r, c) for b in (1, 2) for r in range(17, 32) for c in range(20, 45)}
    with pytest.raises(Exception, match="decompress|header"):
        geotiff.read_geotiff(spark, path).collect()


def test_geotiffs_of_other_makers(spark, tmp_path):
    """Strips, bands together, big-endian classic files, differences of integers; others are refused."""
    import struct
    import zlib

    from tellur.sources import geotiff

    x = np.arange(5 * 4 * 2).reshape(5, 4, 2) * 37 % 256

    def tiff(order, bits, compression, predictor):
        kind = np.dtype(f"{order}u{bits // 8}")
        y = np.diff(x.astype(kind), axis=1, prepend=kind.type(0)) if predictor == 2 else x
        strips = [y[i : i + 2].astype(kind).tobytes() for i in range(0, 5, 2)]
        strips = [zlib.compress(s) for s in strips] if compression == 8 else strips
        fields = [(256, 3, [4]), (257, 3, [5]), (258, 3, [bits, bits]), (259, 3, [compression]), (273, 4, None), (277, 3, [2]), (278, 3, [2]), (279, 4, [len(s) for s in strips]), (317, 3, [predictor])]
        start = 8 + 2 + 12 * len(fields) + 4
        more, entries, places = b"", b"", start + 24
        for tag, t, v in fields:
            v = v or [places + sum(map(len, strips[:i])) for i in range(len(strips))]
            raw = struct.pack(f"{order}{len(v)}{'H' if t == 3 else 'I'}", *v)
            if len(raw) > 4:
                entries += struct.pack(f"{order}HHII", tag, t, len(v), start + len(more))
                more += raw
            else:
                entries += struct.pack(f"{order}HHI", tag, t, len(v)) + raw.ljust(4, b"\0")
        return (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 8) + struct.pack(f"{order}H", len(fields)) + entries + bytes(4) + more.ljust(24, b"\0") + b"".join(strips)

    for i, how in enumerate((("<", 8, 1, 1), (">", 16, 8, 1), ("<", 16, 8, 2), (">", 8, 8, 2))):
        name = tmp_path / f"{i}.tif"
        name.write_bytes(tiff(*how))
        assert {(r.band, r.r, r.c): r.z for r in geotiff.read_geotiff(spark, str(name)).collect()} == {(b + 1, r, c): float(x[r, c, b]) for r in range(5) for c in range(4) for b in range(2)}, how
    (tmp_path / "lzw.tif").write_bytes(tiff("<", 8, 5, 1))
    (tmp_path / "text.tif").write_bytes(b"no raster")
    for bad in ("lzw.tif", "text.tif"):
        with pytest.raises(Exception, match="can't be read|isn't a TIFF"):
            geotiff.read_geotiff(spark, str(tmp_path / bad)).collect()


def divided(spark, tmp_path, rows=150, cols=40):
    """A raster of several files, where it lies, and what is written."""
    from tellur.sources import geotiff

    grid_ = {"x0": 500.0, "y0": 6000.0, "px_w": 2.0, "px_h": -2.0}
    z = raster(spark, lambda r, c: r * 100.0 + c, rows, cols)
    geotiff.write_geotiff(z, path := str(tmp_path / "divided"), grid_, 32630, tile=16, side=64, levels=2)
    return path, grid_, {(r, c): r * 100.0 + c for r in range(rows) for c in range(cols)}


def test_rasters_of_several_files_keep_their_rows(spark, tmp_path):
    from tellur.sources import geotiff

    path, at, whole = divided(spark, tmp_path)
    assert len(geotiff.files(path)) == 3
    got = geotiff.read_geotiff(spark, path, grid=at).collect()
    assert len(got) == len(whole) and {(x.r, x.c): x.z for x in got} == whole
    moved = geotiff.read_geotiff(spark, path, grid=at | {"x0": at["x0"] - 6.0, "y0": at["y0"] + 4.0})
    assert {(x.r - 2, x.c - 3): x.z for x in moved.collect()} == whole


def test_windows_of_several_files(spark, tmp_path):
    from tellur.sources import geotiff

    path, at, whole = divided(spark, tmp_path)
    for r0, r1, c0, c1 in ((5, 40, 10, 20), (60, 70, 3, 9), (130, 140, 0, 39)):
        got = geotiff.read_geotiff(spark, path, (r0, r1, c0, c1), grid=at).collect()
        inside = {k: v for k, v in whole.items() if r0 <= k[0] <= r1 and c0 <= k[1] <= c1}
        assert len(got) == len(inside) and {(x.r, x.c): x.z for x in got} == inside


def test_overviews_of_several_files(spark, tmp_path):
    from tellur.sources import geotiff

    path, at, whole = divided(spark, tmp_path)
    got = geotiff.read_geotiff(spark, path, level=2, grid=at).collect()
    mean = {}
    for (r, c), v in whole.items():
        mean.setdefault((r // 4, c // 4), []).append(v)
    assert len(got) == len(mean)
    assert all(abs(x.z - sum(v) / len(v)) < 1e-9 for x in got for v in [mean[x.r, x.c]])


def test_extent_of_several_files(spark, tmp_path):
    from tellur.sources import geotiff

    path, at, _ = divided(spark, tmp_path, 150, 70)
    meta = geotiff.mosaic(geotiff.read_meta(spark, path)).collect()
    assert len(meta) == 6
    assert {(x.rows, x.cols, x.x0, x.y0, x.px_w, x.px_h, x.epsg) for x in meta} == {(150, 70, at["x0"], at["y0"], 2.0, -2.0, 32630)}


def test_crowded_blocks_are_dealt_by_their_places(spark, monkeypatch):
    from tellur.operators import distance

    monkeypatch.setattr(distance, "POINTS", 100)
    rng = np.random.default_rng(8)
    xy = [(int(k) // 16 * 4 + float(u), int(k) % 16 * 4 + float(v)) for k in range(256) for u, v in rng.uniform(0, 4, (8, 2))]
    placed = spark.createDataFrame([(x, y, int(y // 4), int(x // 4)) for x, y in xy], "x double, y double, i bigint, j bigint")
    held = distance.dealt(placed, placed.groupBy("i", "j").agg(F.count("*").alias("places")), [])
    sizes = [r["count"] for r in held.groupBy("part").count().collect()]
    assert sum(sizes) == len(xy) and len(sizes) == 21 and max(sizes) < 200  # no cell has more than 100
    once = spark.createDataFrame([(x, y, x * 2 - y) for x, y in xy], "x double, y double, z double")
    often = once.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5)))).drop("k")
    a, b = (grid(distance.inverse_distance(p, 2.0), "z") for p in (once, often))
    assert len(a) == 1024 and a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_geopackages_are_read_in_lots(spark, tmp_path):
    from tellur.plans import queries
    from tellur.sinks import geopackage

    found = spark.range(25).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"), F.col("id").cast("string").alias("name")).coalesce(1)
    geopackage.write_geopackage(found, path := str(tmp_path / "lots"), "anomalies", "EPSG:32630")
    assert len(list((tmp_path / "lots").glob("*.gpkg"))) == 1
    for at_once in (7, 25, 10_000):
        got = queries._package(spark, path, ["name"], at_once).collect()
        assert sorted((x.x, x.y, x.srs, x.name) for x in got) == sorted((float(k), 2.0 * k, 32630, str(k)) for k in range(25))


def test_a_rasters_cells_dont_meet_in_one_task(spark, monkeypatch):
    from tellur.operators import ranges, tiles
    from tellur.sources import durable

    z = spark.range(0, 4000, 1, 8).select((F.col("id") % 2).cast("int").alias("raster_id"), F.floor(F.col("id") / 40).cast("int").alias("r"), F.floor(F.col("id") % 40 / 2).cast("int").alias("c"), (F.col("id") % 17).cast("double").alias("z"))
    said = z.groupBy("raster_id").agg(F.max("z").alias("top"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spread = lambda x: x.groupBy(F.spark_partition_id().alias("p")).count().count()
        assert spread(ranges.attached(z, said)) == 8
        assert spread(cells.whole(z)) == 8
        plan = tiles.over_tiles(z, 1, lambda b: {"z": b.cut(b.z)}, ["z"])._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        want = sorted(ranges.quantiles_of(z, "z", [0.3, 0.5]).collect())
        assert want == sorted(ranges.quantiles_of(z, "z", [0.3, 0.5], most=10, left=5).collect())
        monkeypatch.setattr(durable, "FEW", 1)  # many rasters are joined by their ids
        assert sorted(ranges.attached(z, said).collect()) == sorted(z.join(said, "raster_id").select("raster_id", "r", "c", "z", "top").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("step", [0.7, (1.9, 0.6)])
def test_strips_dont_change_what_is_interpolated(spark, monkeypatch, step):
    z = raster(spark, lambda r, c: math.sin(r) * 10 + c if (r + c) % 13 else None, 70, 9)
    both = z.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("raster_id"), "r", "c", (F.col("z") * F.col("raster_id")).alias("z"))
    want = {(x.raster_id, x.r, x.c): x.z for x in change.interpolate(both, step, "lanczos", 0.2, 0.3).collect()}
    assert len(want) > 300
    for most, rows in ((100, 64), (100, 3), (5, 64)):
        monkeypatch.setattr(change, "CELLS", most)
        monkeypatch.setattr(change, "ROWS", rows)
        got = change.interpolate(both, step, "lanczos", 0.2, 0.3)
        assert (most > 9) == ("REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString())
        got = {(x.raster_id, x.r, x.c): x.z for x in got.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_tiles_are_dealt_by_their_cells(spark, monkeypatch):
    z = spark.range(2 * 600 * 20).selectExpr("cast(id % 2 as int) AS raster_id", "cast(id div 40 as int) AS r", "cast(id div 2 % 20 as int) AS c", "cast(hash(id) % 100 as double) AS z")
    make = lambda x: tiles.over_tiles(x, 2, lambda b: {"z": b.cut(b.filled(), 1, 2)}, ["z"], 8)
    rows = lambda x: sorted(tuple(r) for r in x.collect())
    for cells in (z, z.where("raster_id = 0").drop("raster_id")):
        want = rows(make(cells))
        with monkeypatch.context() as m:
            m.setattr(tiles, "DEALT", 1000)
            dealt = make(cells)
            most = dealt.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
            assert most < len(want) / 8 and rows(dealt) == want  # the session has four shuffle partitions


def test_blends_are_compiled_and_equal_one_expression(spark):
    layers = spark.range(200).selectExpr("id AS r", "id AS c", *(f"if(id % 7 = {i}, null, rand({i}) * 100 - 20) AS {k}" for i, k in enumerate((*blend.VAT, "slrm"))))
    layers = layers.withColumns({f"{k}_{e}": F.col("r") * 0 + v for k in (*blend.VAT, "slrm") for e, v in (("low", 1.5), ("high", 60.0))}).localCheckpoint()
    once = layers.select("r", *((blend.stretched(k) * 255).alias(k) for k in blend.VAT), blend.stretched("slrm", 0.0).alias("a"), (1 - blend.stretched("slope", 0.0)).alias("b"))
    for mode, a, b in (("multiply", "hillshade", 255 - F.col("slope")), ("overlay", "vat", F.col("openness")), ("multiply", "vat", F.col("svf"))):
        once = once.withColumn("vat", blend.over(F.col(a), b, mode, 0.5)).localCheckpoint()
    want = {r.r: (r.vat, r.red) for r in once.withColumn("red", blend.over(F.col("a") * 255, F.col("b") * 255, "multiply", 0.5)).collect()}
    both = blend.red_of(blend.vat_of(layers.withColumn("own", F.struct(*layers.columns))).select("own.*", "vat"), "red")
    assert {r.r: (r.vat, r.red) for r in both.collect()} == want and any(v is None for v, _ in want.values())
    for x in (blend.vat_of(layers).select("r", F.round("vat", 6)), blend.red_of(layers, "red").select("r", F.round("red", 6))):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(x._jdf.queryExecution().executedPlan())
        spark.conf.unset("spark.sql.adaptive.enabled")
        assert max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) < 8000  # the JVM compiles no longer method


def test_red_relief_of_one_table(spark):
    z = spark.range(900).selectExpr("cast(id div 30 as int) AS r", "cast(id % 30 as int) AS c", "cast(hash(id) % 100 as double) AS z")
    apart = blend.red_relief(windows.local_relief(z, 5), stencil.slope(z))
    assert grid(blend.red_relief(horizon.measures(z, {"slrm": ("slrm", {"radius": 5}), "slope": ("slope", {})})), "red") == grid(apart, "red")


def test_cells_of_many_tasks_are_packed_by_tiles(spark, monkeypatch):
    """A shuffle for more than 200 tasks holds all rows that a task sends: a row for each cell took seven times the memory."""
    z = spark.range(2 * 600 * 20).selectExpr("if(id % 2 = 0, 'a', 'b') AS raster_id", "cast(id div 40 as int) AS r", "cast(id div 2 % 20 as int) AS c", "if(id div 40 < 40 OR id % 7 = 3, NULL, cast(hash(id) % 100 as double)) AS z")
    z = z.unionByName(spark.sql("SELECT CAST(NULL AS string) AS raster_id, 1 AS r, 1 AS c, 1D AS z"))
    make = lambda x: tiles.over_tiles(x, 2, lambda b: {"z": b.cut(b.filled(), 1, 2)}, ["z"], 8)
    rows = lambda x: sorted(tuple((v is None, v) for v in r) for r in x.collect())
    one = z.where("raster_id = 'a'").drop("raster_id")
    for cells, ragged in ((z, z.orderBy(F.hash("r", "c"))), (one, one.orderBy(F.hash("r", "c")))):
        want, sent = rows(make(cells)), []
        keep = tiles.dealt
        with monkeypatch.context() as m:
            m.setattr(tiles, "DEALT", 1000)
            m.setattr(tiles, "dealt", lambda x, *a: sent.append(x) or keep(x, *a))
            assert rows(make(cells)) == want
            assert sent[0].count() < len(want) / 8  # rows before the shuffle
            m.setattr(tiles, "PACKED", 100)
            assert rows(make(cells)) == want and rows(make(ragged)) == want
