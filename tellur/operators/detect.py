"""Detections: decoding model outputs, rescaling boxes, overlap, suppression and map coordinates."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellur.sources.cells import keys
from tellur.sources.durable import durable, sent_whole, shared_folder


def decode(rows: DataFrame, threshold: float, column: str = "out") -> DataFrame:
    """Adds x1, y1, x2, y2, confidence, class_id to rows with an array of a detector's numbers.

    Six numbers are corners, confidence, class; more are centre, size, objectness and class scores. Rows under the
    threshold and boxes without area are left out.
    """
    v = F.col(column)
    best = F.array_max(F.slice(v, 6, F.greatest(F.lit(1), F.size(v) - 5)))
    six = F.size(v) == 6
    corner = lambda i, sign, j: F.when(six, v[j]).otherwise(v[i] + sign * v[i + 2] / 2)
    box = F.struct(
        corner(0, -1, 0).alias("x1"),
        corner(1, -1, 1).alias("y1"),
        corner(0, 1, 2).alias("x2"),
        corner(1, 1, 3).alias("y2"),
        F.when(six, v[4]).otherwise(v[4] * best).alias("confidence"),
        F.when(six, v[5].cast("int")).otherwise((F.array_position(F.slice(v, 6, F.size(v) - 5), best) - 1).cast("int")).alias("class_id"),
    )
    # A generator, so that each number is computed once a row and not wherever a later step uses it.
    out = rows.where(F.size(v) >= 6).select(*(c for c in rows.columns if c != column), F.inline(F.array(box)))
    return out.where((F.col("confidence") >= threshold) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def decode_parts(rows: DataFrame, threshold: float) -> DataFrame:
    """Boxes of models with four outputs: rows with num, boxes (arrays of corners), scores and classes give one row for each of the first num boxes.

    Rows under the threshold and boxes without area are left out, as by `decode`; a num beyond the arrays gives what there is.
    """
    each = F.posexplode(F.slice(F.arrays_zip("boxes", "scores", "classes"), 1, F.greatest(F.lit(0), F.least(F.col("num").cast("int"), F.size("boxes")))))
    out = rows.where("num IS NOT NULL AND boxes IS NOT NULL").select(*(c for c in rows.columns if c not in ("num", "boxes", "scores", "classes")), each.alias("n", "d"))
    v = F.col("d.boxes")
    out = out.select(*(c for c in out.columns if c != "d"), *(F.get(v, i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))), F.col("d.scores").alias("confidence"), F.col("d.classes").cast("int").alias("class_id"))
    return out.where((F.col("confidence") >= threshold) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def rescale(boxes: DataFrame, model: int, tile_w: Column, tile_h: Column, x0: Column, y0: Column) -> DataFrame:
    """Boxes from model to raster pixels, kept within their tile; two decimals for corners, four for confidence."""
    at = lambda n, side, off: F.round(F.least(side, F.greatest(F.lit(0.0), F.col(n) * side / model)) + off, 2)
    return boxes.withColumns({"x1": at("x1", tile_w, x0), "y1": at("y1", tile_h, y0), "x2": at("x2", tile_w, x0), "y2": at("y2", tile_h, y0), "confidence": F.round("confidence", 4)})


def label(class_id: Column, names: list[str] | dict[int, str]) -> Column:
    """A class's name, or class_<id>."""
    known = dict(enumerate(names)) if isinstance(names, list) else names
    if not known:
        return F.concat(F.lit("class_"), class_id.cast("string"))
    pairs = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    return F.coalesce(F.element_at(pairs, class_id), F.concat(F.lit("class_"), class_id.cast("string")))


def overlap(a: str, b: str) -> Column:
    """Intersection over union of two boxes with the given prefixes."""
    x = F.greatest(F.lit(0.0), F.least(f"{a}x2", f"{b}x2") - F.greatest(f"{a}x1", f"{b}x1"))
    y = F.greatest(F.lit(0.0), F.least(f"{a}y2", f"{b}y2") - F.greatest(f"{a}y1", f"{b}y1"))
    area = lambda p: (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))
    both = x * y
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


#: Boxes of one cell that a join compares row by row; those of fuller cells are compared by arrays, in parts of PART boxes and pieces of LEAF, whose pairs go on by about PAIRS; a task
#: gets cells of about DEALT pairs of boxes, as far as 2,000 tasks go.
CROWD, PART, LEAF, PAIRS, DEALT = 100, 65_536, 64, 500_000, 100_000_000


def leaves(sides: np.ndarray) -> list[np.ndarray]:
    """Positions of boxes in pieces of up to LEAF that lie and measure alike: halves by the side that differs most, again and again."""
    out, left = [], [np.arange(len(sides))]
    while left:
        at = left.pop()
        if len(at) <= LEAF:
            out.append(at)
            continue
        own = sides[at]
        axis = np.argmax(np.fmax.reduce(own) - np.fmin.reduce(own))
        half = np.argpartition(own[:, axis], len(at) // 2)
        left += [at[half[len(at) // 2 :]], at[half[: len(at) // 2]]]
    return out


def near(one: np.ndarray, other: np.ndarray | None, threshold: float, cell: float, at: tuple[float, float]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, iou), about PAIRS at a time: boxes of `one` and `other` (columns x1, y1, x2, y2; None: two of `one`, once) with iou >= threshold whose first shared cell is `at`.

    An iou of t needs a shared part of t times each box's area, width and height. A piece of boxes is compared only with
    those that can have it with one of the piece.
    """
    same, slack = other is None, threshold * (1 - 1e-6)

    def figures(b: np.ndarray) -> tuple[np.ndarray, ...]:
        size = b[:, 2:] - b[:, :2]
        first = (np.floor(b[:, :2] / cell) == at).astype(np.uint8)
        return b, np.concatenate([b[:, :2] + slack * size, b[:, 2:] - slack * size], axis=1), size[:, 0] * size[:, 1], first[:, 0] | first[:, 1] << 1

    pieces = leaves(one)
    order = np.concatenate(pieces)
    a = figures(one[order])
    b = a if same else figures(other)
    # (least, most): the innermost left and right, top and bottom edges of a shared part that suffices.
    sides, inner, areas = (np.ascontiguousarray(x.T) for x in b[:3])
    found, n, done = [], 0, 0
    for piece in pieces:
        lo, hi = done, done + len(piece)
        p, q, area, first = (x[lo:hi] for x in a)
        done, start = hi, lo if same else 0
        can = (areas[start:] >= slack * np.fmin.reduce(area)) & (areas[start:] * slack <= np.fmax.reduce(area))
        for axis in (0, 1):
            can &= (sides[axis, start:] <= np.fmax.reduce(q[:, axis + 2])) & (inner[axis + 2, start:] >= np.fmin.reduce(p[:, axis]))
            can &= (sides[axis + 2, start:] >= np.fmin.reduce(q[:, axis])) & (inner[axis, start:] <= np.fmax.reduce(p[:, axis + 2]))
        can = np.flatnonzero(can) + start
        for k in range(0, len(can), 1024):
            c = can[k : k + 1024]
            x, y = (np.minimum(p[:, i + 2, None], sides[i + 2, c]) - np.maximum(p[:, i, None], sides[i, c]) for i in (0, 1))
            both = np.maximum(x, 0, out=x)
            both *= np.maximum(y, 0, out=y)
            total = area[:, None] + areas[c]
            ok = (both > 0) & (both * (1 + threshold) >= total * (threshold * (1 - 1e-9))) & ((first[:, None] | b[3][c]) == 3)
            if same:
                ok &= np.arange(lo, hi)[:, None] < c
            hit = np.flatnonzero(ok)
            both = both.ravel()[hit]
            iou = both / (total.ravel()[hit] - both)
            sure = iou >= threshold
            hit, iou = hit[sure], iou[sure]
            row = hit // len(c)
            found.append((piece[row], order[c][hit - row * len(c)] if same else c[hit - row * len(c)], iou))
            if (n := n + len(iou)) >= PAIRS:
                yield tuple(np.concatenate(z) for z in zip(*found, strict=True))
                found, n = [], 0
    if n:
        yield tuple(np.concatenate(z) for z in zip(*found, strict=True))


def in_cells(boxes: DataFrame, cell: float, id_col: str, by: tuple[str, ...], threshold: float) -> DataFrame:
    """(id, _k0.., x1, y1, x2, y2, area, gx, gy): each box in the grid cells of side `cell` where a part shared by an iou of `threshold` can begin.

    Such a part has `threshold` times the box's width and height at least, so it begins no nearer to the box's end.
    """
    last = lambda lo, hi: F.greatest(F.col(lo), F.col(hi) - (F.col(hi) - F.col(lo)) * (threshold * (1 - 1e-6)))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(last(lo, hi) / cell))
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    g = boxes.select(F.col(id_col).alias("id"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), "x1", "y1", "x2", "y2", area.alias("area"), F.explode(span("x1", "x2")).alias("gx"), span("y1", "y2").alias("ys"))
    return g.withColumn("gy", F.explode("ys")).drop("ys")


def overlaps(boxes: DataFrame, threshold: float, cell: float, id_col: str = "id", by: tuple[str, ...] = ("class_id",)) -> DataFrame:
    """(a, b, iou): pairs with the same `by` (class, scene) and iou >= threshold > 0, a < b; ids are numbers or text.

    Boxes meet in the grid cells of side `cell` that they cover, and are counted in the first they share. An iou of t
    needs areas within a factor t, which is asked before boxes are compared. A cell near the usual box keeps cells small;
    the boxes of cells with more than CROWD are compared by arrays in one task, beyond PART by each two parts of them, and
    pairs are passed on as they are found. Boxes are shuffled by their cells: sent whole, all pairs of a file's part would
    be one task's.
    """
    keys, sides = [f"_k{i}" for i in range(len(by))], ["x1", "y1", "x2", "y2"]
    at = ["gx", "gy", *keys]
    g = in_cells(boxes, cell, id_col, by, threshold)
    g = g.dropna(subset=["id", *keys])
    full = durable(g.groupBy(*at).agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select(*at, "n", F.ceil(F.col("n") / PART).cast("int").alias("k")))
    crowded = full.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0]
    full = full.drop("n")
    sparse = g.join(sent_whole(full), at, "left_anti") if crowded else g
    a, b = (sparse.select("gx", "gy", *keys, *(F.col(c).alias(p + c) for c in ("id", *sides, "area"))) for p in "ab")
    p = a.join(b.hint("merge"), at).where("aid < bid AND ax1 < bx2 AND bx1 < ax2 AND ay1 < by2 AND by1 < ay2")
    p = p.where((F.least("aarea", "barea") >= threshold * F.greatest("aarea", "barea") * (1 - 1e-12)) & (F.col("gx") == F.floor(F.greatest("ax1", "bx1") / cell)) & (F.col("gy") == F.floor(F.greatest("ay1", "by1") / cell)))
    out = p.select(F.col("aid").alias("a"), F.col("bid").alias("b"), overlap("a", "b").alias("iou")).where(F.col("iou") >= threshold)
    if not crowded:
        return out

    def work(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = pd.concat(frames)
        part, ids, xy = f.part.to_numpy(), f.id.to_numpy(), f[sides].to_numpy(float)
        one, other = (np.flatnonzero(part == k) for k in key[-2:])
        for i, j, iou in near(xy[one], None if key[-2] == key[-1] else xy[other], threshold, cell, key[:2]):
            a, b = ids[one[i]], ids[other[j]]
            first, ok = a < b, a != b
            yield pd.DataFrame({"a": np.where(first, a, b)[ok], "b": np.where(first, b, a)[ok], "iou": iou[ok]})

    dense = g.join(sent_whole(full), at).withColumn("part", F.pmod(F.hash("id", "x1", "y1"), F.col("k")))
    dense = dense.select(*at, "id", *(F.col(c).cast("double").alias(c) for c in sides), "part", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("q"))
    kind = boxes.schema[id_col].dataType.simpleString()
    dense = dense.withColumns({"low": F.least("part", "q"), "high": F.greatest("part", "q")})
    # Numbered, since what is sent says little about what is found.
    dense = dense.repartition(max(1, min(2_000, round(crowded / DEALT))), *at, "low", "high")
    met = dense.groupBy(*at, "low", "high").applyInPandas(work, f"a {kind}, b {kind}, iou double")
    return out.unionByName(met)


#: Overlaps that one task resolves at once, and the side of the fields that more are divided into, in cells of the grid.
AT_ONCE, FIELD = 100_000, 32

#: Boxes in the usual cell beyond which a group is gone through in bands of falling confidence, those of the first band, and the boxes kept that are sent to all tasks.
DENSE, BAND, HELD = 100, 16, 500_000


def resolved(strong: np.ndarray, weak: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of overlaps (a stronger and a weaker node each) the nodes that are decided, and whether they stay.

    All overlaps of the nodes `own` are there; of others some are. A node stays once nothing stronger is left that could
    take it, and takes what is weaker; a node of others can only go.
    """
    names, codes = np.unique(np.concatenate([strong, weak]), return_inverse=True)
    a, b = codes[: len(strong)], codes[len(strong) :]
    order = np.argsort(a, kind="stable")
    b = b[order]
    starts = np.searchsorted(a[order], np.arange(len(names) + 1))
    over = np.bincount(b, minlength=len(names))
    mine = np.isin(names, own)
    stays = np.full(len(names), -1)
    ready = np.flatnonzero(mine & (over == 0)).tolist()
    stays[ready] = 1
    while ready:
        u = ready.pop()
        for w in b[starts[u] : starts[u + 1]].tolist():
            if stays[u] == 1 and stays[w] < 0:
                stays[w] = 0
                ready.append(w)
            elif stays[u] == 0:
                over[w] -= 1
                if over[w] == 0 and mine[w] and stays[w] < 0:
                    stays[w] = 1
                    ready.append(w)
    known = stays >= 0
    return names[known], stays[known] == 1


def banded(boxes: DataFrame, by: tuple[str, ...], cell: float, dense: int | None = None) -> tuple[DataFrame, int]:
    """Adds `band` (0 for the most confident), and how many there are: each group whose boxes lie over `dense` (DENSE) in a cell is halved, down to about BAND in a cell."""
    group = (F.xxhash64(*by) if by else F.lit(0).cast("bigint")).alias("_g")
    held = boxes.dropna(subset=[*by]).groupBy(group, F.floor(F.col("x1") / cell), F.floor(F.col("y1") / cell)).agg(F.count("*").alias("n"))
    full = held.groupBy("_g").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("n")).where(F.col("n") > (DENSE if dense is None else dense))
    full = durable(full.select("_g", F.ceil(F.log2(F.col("n") / BAND)).cast("int").alias("k")))
    most = full.agg(F.max("k")).first()[0]
    if not most or most < 1:
        return boxes.withColumn("band", F.lit(0)), 1
    x = boxes.withColumn("_c", F.col("confidence").cast("double"))
    cuts = x.select(group, "_c").join(sent_whole(full), "_g").groupBy("_g", "k").agg(F.percentile_approx("_c", [1 - 2.0**-i for i in range(1, most + 1)], 10_000).alias("q"))
    cuts = sent_whole(durable(cuts.select(F.col("_g").alias("_of"), F.slice("q", 1, F.greatest("k", F.lit(1))).alias("q"))))
    # A missing confidence comes first and NaN last, as in the order of suppression.
    band = F.when(F.isnan("_c"), F.size("q")).otherwise(F.size(F.filter("q", lambda c: c > F.col("_c"))))
    x = x.withColumn("_g", group).join(cuts, F.col("_g") == F.col("_of"), "left").withColumn("band", F.when(F.col("q").isNull(), 0).otherwise(band))
    return x.select(*boxes.columns, "band"), most + 1


def cells_of(box: np.ndarray, group: np.ndarray, threshold: float, cell: float) -> tuple[np.ndarray, np.ndarray]:
    """(positions, keys): the boxes (columns x1, y1, x2, y2) in the cells of `in_cells`; a key stands for a group and cell, seldom for two."""
    last = np.maximum(box[:, :2], box[:, 2:] - (box[:, 2:] - box[:, :2]) * (threshold * (1 - 1e-6)))
    at = np.floor(box[:, :2] / cell).astype(np.int64)
    n = np.floor(last / cell).astype(np.int64) - at + 1
    times = n[:, 0] * n[:, 1]
    i = np.repeat(np.arange(len(box)), times)
    k = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
    x, y = at[i, 0] + k % n[i, 0], at[i, 1] + k // n[i, 0]
    mixed = [v.astype(np.int64).view(np.uint64) * np.uint64(m) for v, m in ((group[i], 0x9E3779B97F4A7C15), (x, 0xBF58476D1CE4E5B9), (y, 0x94D049BB133111EB))]
    return i, mixed[0] ^ mixed[1] ^ mixed[2]


def placed(boxes: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The boxes with `_g` (a hash of the group, null if that is in part) and their sides as doubles, `_x1`, `_y1`, `_x2`, `_y2`."""
    known = F.lit(True)
    for k in by:
        known &= F.col(k).isNotNull()
    group = F.xxhash64(*by) if by else F.lit(0).cast("bigint")
    return boxes.withColumns({"_g": F.when(known, group), **{f"_{c}": F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")}})


def untaken(boxes: DataFrame, stay: np.ndarray, groups: np.ndarray, threshold: float, by: tuple[str, ...], cell: float, most: int = 1 << 20) -> DataFrame:
    """The boxes whose overlap with each of those that `stay` (columns x1, y1, x2, y2; their `groups` as `placed` names them) is under the threshold.

    What stays is sent to all tasks, so boxes are neither shuffled nor sorted; about `most` pairs are compared at a time.
    """
    i, key = cells_of(stay, groups, threshold, cell)
    order = np.argsort(key, kind="stable")
    sent = boxes.sparkSession.sparkContext.broadcast((stay, groups, i[order], key[order]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stay, groups, of, keys = sent.value
        area = lambda b: (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        areas = area(stay)
        for batch in batches:
            group = batch.column("_g").fill_null(0).to_numpy(zero_copy_only=False)
            box = np.stack([batch.column(f"_{c}").to_numpy(zero_copy_only=False).astype(float) for c in ("x1", "y1", "x2", "y2")], axis=1)
            own = np.flatnonzero(np.isfinite(box).all(axis=1) & batch.column("_g").is_valid().to_numpy(zero_copy_only=False))
            i, key = cells_of(box[own], group[own], threshold, cell)
            i, taken, mine = own[i], np.zeros(len(box), bool), area(box)
            first, last = (np.searchsorted(keys, key, side) for side in ("left", "right"))
            ends, k = np.cumsum(last - first), 0
            while k < len(i):
                done = int(ends[k - 1]) if k else 0
                to = max(k + 1, int(np.searchsorted(ends, done + most, "right")))
                times = np.diff(ends[k:to], prepend=done)
                u = np.repeat(i[k:to], times)
                v = of[np.arange(len(u)) + np.repeat(first[k:to] - (ends[k:to] - times - done), times)]
                x, y = (np.minimum(box[u, c + 2], stay[v, c + 2]) - np.maximum(box[u, c], stay[v, c]) for c in (0, 1))
                meet = np.flatnonzero((x > 0) & (y > 0) & (group[u] == groups[v]))
                u, v, both = u[meet], v[meet], x[meet] * y[meet]
                taken[u[both / (mine[u] + areas[v] - both) >= threshold]] = True
                k = to
            yield batch.select(names).filter(pa.array(~taken))

    names = boxes.columns
    return placed(boxes, by).mapInArrow(work, boxes.schema)


def suppress(boxes: DataFrame, threshold: float = 0.45, by: tuple[str, ...] = ("class_id",), id_col: str = "id", cell: float = 32) -> DataFrame:
    """Greedy suppression within each group: by falling confidence (ties by id), a box stays if its overlap with all kept is under the threshold (above 0).

    Dense groups are gone through in bands of falling confidence: what boxes kept before take is left out before a band's
    own overlaps are sought. What is left of a band gathers where nothing stayed before, so if it is still dense it is
    gone through in bands of its own. Few boxes stay in a cell, so overlaps don't grow with the square of the boxes. Boxes
    kept are sent to all tasks up to HELD, more are joined by their cells. Bands are written once, each in a folder of its own.
    """
    names = [f.name for f in boxes.schema.fields if f.name in {*by, id_col, "x1", "y1", "x2", "y2", "confidence"}]
    boxes = durable(boxes.select(*names, F.monotonically_increasing_id().alias("node")))
    boxes, bands = banded(boxes, by, cell)
    if bands == 1:
        return kept(boxes.drop("band"), threshold, by, id_col, cell).select(*names)
    spark, done, at = boxes.sparkSession, None, ["gx", "gy", *(f"_k{i}" for i in range(len(by)))]
    boxes.write.partitionBy("band").parquet(folder := f"{shared_folder(spark)}/bands-{uuid.uuid4().hex}")
    boxes, held, n = spark.read.parquet(folder), [], 0
    # Each band, whether it may be divided once more (boxes that don't overlap would be without end), and how many of `held` it was compared with.
    todo = [(boxes.where(F.col("band") == band).select(*names, "node"), True, 0) for band in range(bands)]
    while todo:
        own, whole, since = todo.pop(0)
        if n <= HELD:
            if held[since:]:
                own = untaken(own, *(np.concatenate(x) for x in zip(*held[since:], strict=True)), threshold, by, cell)
            own = durable(own)
        elif done is not None:
            a, b = (in_cells(x, cell, "node", by, threshold).select(*at, *(F.col(c).alias(p + c) for c in ("id", "x1", "y1", "x2", "y2"))) for p, x in (("a", own), ("b", done)))
            same = F.lit(True)
            for k in at:
                same &= F.col(f"a.{k}") == F.col(f"b.{k}")
            taken = a.alias("a").join(b.alias("b").hint("merge"), same & (overlap("a", "b") >= threshold), "left_semi").select(F.col("aid").alias("node"))
            own = durable(own.join(taken, "node", "left_anti"))
        if whole:
            parts, k = banded(own, by, cell, 2 * BAND)
            if k > 1:
                parts = durable(parts)
                todo[:0] = [(parts.where(F.col("band") == i).drop("band"), False, len(held)) for i in range(k)]
                continue
        stay = durable(kept(own, threshold, by, id_col, cell))
        done = stay if done is None else done.unionByName(stay)
        if n <= HELD and (n := n + stay.count()) <= HELD:
            rows = placed(stay, by).where("_g IS NOT NULL").select("_g", "_x1", "_y1", "_x2", "_y2").toArrow()
            sides = np.stack([rows.column(i).to_numpy() for i in range(1, 5)], axis=1).astype(float).reshape(-1, 4)
            ok = np.isfinite(sides).all(axis=1)
            held.append((sides[ok], rows.column(0).to_numpy().astype(np.int64)[ok]))
    return done.select(*names)


def kept(boxes: DataFrame, threshold: float, by: tuple[str, ...], id_col: str, cell: float) -> DataFrame:
    """The boxes (with a number `node`) that greedy suppression keeps.

    The rule is resolved over the graph of overlaps. AT_ONCE overlaps or fewer are one task's. More are divided by fields
    of the plane, as wide as hold so few; a task resolves what depends on its own boxes only, decided boxes leave the
    graph, and fields twice as wide follow, moved by half a field. The strongest box left is decided in each round, and
    whatever depends on boxes of one field.
    """
    pairs = overlaps(boxes, threshold, cell, "node", by)
    group = F.xxhash64(*by) if by else F.lit(0).cast("bigint")
    end = lambda p: boxes.select(F.col("node").alias(p), F.struct(-F.col("confidence"), id_col, "node").alias(f"{p}rank"), F.struct("node", group.alias("g"), "x1", "y1").alias(f"{p}end"))
    pairs = pairs.join(end("a"), "a").join(end("b"), "b")
    first = F.col("arank") < F.col("brank")
    left = durable(pairs.select(F.when(first, F.col("aend")).otherwise(F.col("bend")).alias("s"), F.when(first, F.col("bend")).otherwise(F.col("aend")).alias("w")))
    gone, turn = None, 0

    def fields(x: DataFrame, turn: int) -> DataFrame:
        """The lots of both ends: the fields of this turn, finer ones where they are crowded, and where cells are, parts by the box."""

        def place(e: str, level: int) -> Column:
            side = cell * FIELD * 2.0**level
            return F.xxhash64(F.lit(level), F.col(e)["g"], *(F.floor(F.col(e)[k] / side + (turn % 2) / 2) for k in ("x1", "y1")))

        x = x.withColumns({f"{e}_lot": place(e, turn) for e in "sw"})
        for level in range(turn - 1, -7, -1):
            crowd = durable(x.select(F.explode(F.array_distinct(F.array("s_lot", "w_lot"))).alias("lot")).groupBy("lot").agg(F.ceil(F.count("*") / AT_ONCE).alias("k")).where("k > 1"))
            if not crowd.limit(1).count():
                break
            for e, node in (("s", "strong"), ("w", "weak")):
                finer = place(e, level) if level > -6 else F.xxhash64(f"{e}_lot", F.pmod(F.xxhash64(node), F.col("k")))
                x = x.join(crowd.withColumnRenamed("lot", f"{e}_lot"), f"{e}_lot", "left").withColumn(f"{e}_lot", F.when(F.col("k").isNull(), F.col(f"{e}_lot")).otherwise(finer)).drop("k")
        return x

    def work(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        own = np.concatenate([f.strong[f.s_lot == key[0]], f.weak[f.w_lot == key[0]]])
        nodes, stays = resolved(f.strong.to_numpy(), f.weak.to_numpy(), own)
        return pd.DataFrame({"node": nodes, "stays": stays})

    while n := left.count():
        x = left.select(F.col("s.node").alias("strong"), F.col("w.node").alias("weak"), "s", "w", *(F.lit(0).cast("bigint").alias(f"{e}_lot") for e in "sw"))
        if n > AT_ONCE:
            x = fields(x, turn)
        sent = x.select("strong", "weak", "s_lot", "w_lot", F.explode(F.array_distinct(F.array("s_lot", "w_lot"))).alias("lot"))
        known = durable(sent.groupBy("lot").applyInPandas(work, "node bigint, stays boolean"))
        lost = known.where("NOT stays").select("node")
        gone = lost if gone is None else gone.union(lost)
        for e in "sw":
            left = left.join(known.select(F.col("node").alias("_n")), F.col(e)["node"] == F.col("_n"), "left_anti")
        left, turn = durable(left), min(turn + 1, 20)
    return boxes if gone is None else boxes.join(gone, "node", "left_anti")


def to_map(boxes: DataFrame, transform: tuple[float, float, float, float, float, float]) -> DataFrame:
    """Corners from pixels to map coordinates by an affine transform (x0, px_w, rot_x, y0, rot_y, px_h), sorted."""
    x0, a, b, y0, d, e = map(float, transform)
    at = lambda x, y: (x0 + F.col(x) * a + F.col(y) * b, y0 + F.col(x) * d + F.col(y) * e)
    p = [at(x, y) for x in ("x1", "x2") for y in ("y1", "y2")]
    xs, ys = [q[0] for q in p], [q[1] for q in p]
    return boxes.withColumns({"x1": F.least(*xs), "y1": F.least(*ys), "x2": F.greatest(*xs), "y2": F.greatest(*ys)})


def resized(x: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """A band on another number of cells: bilinear between half-cell centres, borders repeated."""
    at = []
    for n, m in ((rows, x.shape[0]), (cols, x.shape[1])):
        p = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        low = np.floor(p).astype(int)
        at.append((low, np.minimum(low + 1, m - 1), p - low))
    (r0, r1, fr), (c0, c1, fc) = at
    top, low = (x[r][:, c0] * (1 - fc) + x[r][:, c1] * fc for r in (r0, r1))
    return top * (1 - fr[:, None]) + low * fr[:, None]


def model_input(bands: np.ndarray, size: int) -> np.ndarray:
    """(1, bands, size, size) floats of a tile (bands, rows, cols): one band becomes three; integers are divided by 255, others stretched to 0..1 by the tile's range.

    NaN and -inf are 0, +inf is 1; a tile without range is 0.
    """
    x = np.repeat(bands, 3, axis=0) if len(bands) == 1 else bands
    whole = np.issubdtype(x.dtype, np.integer)
    if x.shape[1:] != (size, size):
        x = np.stack([resized(b.astype(float), size, size) for b in x])
    if whole:
        return (x / 255.0)[None].astype(np.float32)
    known = np.isfinite(x)
    low, high = (x[known].min(), x[known].max()) if known.any() else (0.0, 0.0)
    with np.errstate(invalid="ignore"):
        out = (x - low) / (high - low) if high - low > 1e-6 else np.where(known, 0.0, x)
    return np.nan_to_num(out, nan=0.0, posinf=1.0, neginf=0.0)[None].astype(np.float32)


def onnx_model(data: bytes):
    """A function of one array, from an ONNX model's bytes; loaded once in a worker."""
    held = []

    def run(x: np.ndarray) -> list[np.ndarray]:
        if not held:
            import onnxruntime

            held.append(onnxruntime.InferenceSession(data))
        return held[0].run(None, {held[0].get_inputs()[0].name: x})

    return run


def detect(cells: DataFrame, model, names: list[str], tile: int = 640, overlap: int = 32, size: int = 640, threshold: float = 0.25, most: float | None = 0.45) -> DataFrame:
    """([raster_id,] tr, tc, x1, y1, x2, y2, confidence, class_id, label): a model's detections over overlapping tiles, in raster pixels.

    `cells` have bands z, or b0, b1, ...; `model` takes (1, bands, size, size) floats and returns its outputs: one array of
    rows as `decode` takes them, or num, boxes, scores and classes. Other outputs, label maps among them, give no boxes.
    Tile k begins at k times (tile - overlap). A task holds one tile; a cell is sent to the few tiles that hold it. Of the
    boxes of a raster and class that overlap by `most` or more, the most confident stays, of equal ones that of the first
    tile (None: all stay).
    """
    by, step = keys(cells), tile - overlap
    bands = [c for c in cells.columns if c not in (*by, "r", "c")]
    ends = cells.groupBy(*by).agg(F.max("r").alias("_r"), F.max("c").alias("_c"))
    sent = cells.join(ends, by) if by else cells.crossJoin(F.broadcast(ends))  # one row for each raster

    def tiles(axis: str) -> Column:
        count = F.greatest(F.lit(1), F.ceil((F.col(f"_{axis}") + 1 - overlap) / step))
        first = F.greatest(F.lit(0), F.floor((F.col(axis) - tile) / step).cast("int") + 1)
        return F.explode(F.sequence(first, F.least(count - 1, F.floor(F.col(axis) / step)).cast("int")))

    sent = sent.select(*cells.columns, "_r", "_c", tiles("r").alias("tr")).select("*", tiles("c").alias("tc"))

    def work(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = key[-2] * step, key[-1] * step
        h, w = min(tile, int(f._r.iloc[0]) + 1 - r0), min(tile, int(f._c.iloc[0]) + 1 - c0)
        whole = all(np.issubdtype(f[b].dtype, np.integer) for b in bands)
        x = np.full((len(bands), h, w), 0 if whole else np.nan, np.int64 if whole else float)
        for i, b in enumerate(bands):
            x[i, f.r.to_numpy() - r0, f.c.to_numpy() - c0] = f[b].to_numpy()
        out = [np.asarray(o, float) for o in model(model_input(x, size))]
        one, four = [], [None] * 4
        if len(out) == 1 and out[0].ndim == 3 and out[0].shape[-1] >= 6:
            one = [row.tolist() for row in out[0][0]]
        elif len(out) >= 4:
            strip = lambda o, n: o[0] if o.ndim > n else o
            four = [int(out[0].ravel()[0]) if out[0].size else 0, strip(out[1], 2).tolist(), strip(out[2], 1).tolist(), [int(k) for k in strip(out[3], 1)]]
        rows = [(*key, w, h, v, None, None, None, None) for v in one] + ([(*key, w, h, None, *four)] if four[0] is not None else [])
        return pd.DataFrame(rows, columns=[*by, "tr", "tc", "w", "h", "out", "num", "boxes", "scores", "classes"])

    schema = "".join(f"`{b}` {cells.schema[b].dataType.simpleString()}, " for b in by) + "tr int, tc int, w int, h int, out array<double>, num int, boxes array<array<double>>, scores array<double>, classes array<int>"
    found = sent.groupBy(*by, "tr", "tc").applyInPandas(work, schema)
    boxes = decode(found.where("out IS NOT NULL").drop("num", "boxes", "scores", "classes"), threshold)
    boxes = boxes.unionByName(decode_parts(found.where("num IS NOT NULL").drop("out"), threshold).drop("n"))
    boxes = rescale(boxes, size, F.col("w"), F.col("h"), F.col("tc") * step, F.col("tr") * step).where("x2 > x1 AND y2 > y1")
    out = [*by, "tr", "tc", "x1", "y1", "x2", "y2", "confidence", "class_id"]
    if most is not None:
        boxes = boxes.withColumn("_at", F.struct("tr", "tc", "y1", "x1", "y2", "x2"))
        boxes = suppress(boxes, most, (*by, "class_id"), "_at").select("*", "_at.tr", "_at.tc")
    return boxes.select(*out, label(F.col("class_id"), names).alias("label"))
