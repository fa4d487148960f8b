"""Hard negatives by a threshold join over inverted indexes in the manner of L2AP.

Anchors come in lots and all rows in blocks; a lot meets a few blocks at a time in a task. Each dimension of a block has a
list of the rows that are indexed in it. At a threshold, a row is indexed in its first dimensions only: the rest, whose
suffix norm times the query's length stays under the threshold, is left out of the lists, since a row that shares only
such dimensions with the query cannot reach it. Partial scores are added up list by list, dimensions of most variance
first, and a pair is scored exactly only if its partial score plus the product of both remaining norms reaches the
threshold. Thresholds start near a window's upper end and are lowered, lists growing by the dimensions then needed, until
each window holds its k best or its lower end is reached. The windows' fills carry over from block to block.

The same join finds the positives: their window is open at both ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellur.llm.common import durable, read
from tellur.llm.topk import _matrix, exact_scores, packs, slices
from tellur.llm.whitening import sound

#: Rows in a block, anchors in a lot, blocks that a task takes at once, blocks in a range partition.
BLOCK, LOT, RUN, PARTS = 4_096, 512, 4, 32
#: Most bytes of a block's numbers; blocks of very long vectors hold fewer.
BLOCK_BYTES = 1 << 24
#: Dimensions whose lists are added up at once, and the shares of a window's width at which thresholds are tried.
STEP, TRIES = 8, (0.1, 0.4, 1.0)


class Index:
    """The lists of one block: its rows' dimensions in the given order, each row as far as a threshold needs."""

    def __init__(self, m: np.ndarray, order: np.ndarray):
        self.rows, self.order, self.m = len(m), order, m[:, order]
        self.steps = range(0, m.shape[1], STEP)
        # Suffix norms at the steps: what a row's dimensions from there on can add to a score.
        self.rest = np.sqrt(np.maximum(np.stack([(self.m[:, i:] ** 2).sum(axis=1) for i in self.steps] + [np.zeros(self.rows)], axis=1), 0))

    def cuts(self, threshold: float) -> np.ndarray:
        """For each row the first step whose suffix norm is under the threshold (a score by a query of length 1): from there on it is in no list."""
        return (self.rest[:, :-1] >= threshold).sum(axis=1)


class Join:
    """Partial scores of some queries with one block."""

    def __init__(self, index: Index, q: np.ndarray):
        self.index, self.q = index, q[:, index.order]
        self.rest = np.sqrt(np.stack([(self.q[:, i:] ** 2).sum(axis=1) for i in index.steps] + [np.zeros(len(q))], axis=1))
        self.sums = np.zeros((len(q), index.rows))
        self.cut = np.zeros(index.rows, np.int64)
        self.scored = np.zeros((len(q), index.rows), bool)

    def reach(self, live: np.ndarray, thresholds: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(query, rows) of the pairs of `live` queries that can reach their thresholds and weren't given before."""
        ix = self.index
        size = np.maximum(self.rest[live, 0], 1e-300)
        slack = 1e-9 * (1 + size * ix.rest[:, 0].max(initial=0))
        cut = np.maximum(self.cut, ix.cuts(float(((thresholds - slack) / size).min())))
        for s, i in enumerate(ix.steps):
            own = np.flatnonzero((cut > s) & (self.cut <= s))
            if len(own):
                self.sums[:, own] += self.q[:, i : i + STEP] @ ix.m[own, i : i + STEP].T
        self.cut = cut
        bound = self.sums[live] + self.rest[np.ix_(live, cut)] * ix.rest[np.arange(ix.rows), cut]
        for a, can in zip(live, (bound >= (thresholds - slack)[:, None]) & ~self.scored[live], strict=True):
            if len(at := np.flatnonzero(can)):
                self.scored[a, at] = True
                yield a, at


class Fill:
    """The windows of some queries: of the rows with low <= score <= high, the k of the highest scores, ties to the smaller id."""

    def __init__(self, low: list[np.ndarray], high: list[np.ndarray], k: int):
        self.low, self.high, self.k = low, high, k
        self.held = [[(np.empty(0, np.int64),) * 3 for _ in x] for x in low]

    def floors(self, a: int) -> np.ndarray:
        """The least score that a further row of each window must have."""
        return np.array([max(lo, float(s[-1])) if len(s) == self.k else lo for lo, (s, _, _) in zip(self.low[a], self.held[a], strict=True)])

    def add(self, a: int, scores: np.ndarray, ids: np.ndarray, numbers: np.ndarray) -> None:
        for w, (lo, hi) in enumerate(zip(self.low[a], self.high[a], strict=True)):
            ok = (scores >= lo) & (scores <= hi)
            if ok.any():
                s, i, n = (np.concatenate([x, y[ok]]) for x, y in zip(self.held[a][w], (scores, ids, numbers), strict=True))
                best = np.lexsort((n, i, -s.astype(object) if s.min() == -(2**63) else -s))[: self.k]
                self.held[a][w] = (s[best], i[best], n[best])


def fill(fills: Fill, q: np.ndarray, no: np.ndarray, labels: np.ndarray, m: np.ndarray, ids: np.ndarray, numbers: np.ndarray, own: np.ndarray, order: np.ndarray, same: bool) -> None:
    """Takes one block into the windows: rows of the queries' label (`same`) or of others, never the query's own row."""
    index = Index(m, order)
    join = Join(index, q)
    top = join.rest[:, 0] * index.rest[:, 0].max(initial=0)  # no score exceeds the product of lengths
    live, tried = np.arange(len(q)), np.full(len(q), np.inf)
    for share in TRIES:
        thresholds, on = [], []
        for a in live:
            need, high = fills.floors(a), np.minimum(fills.high[a], top[a])
            ok = need <= high
            if ok.any() and (least := max(float(need[ok].min()), -top[a])) < tried[a]:
                upper = float(high[ok].min())
                tried[a] = least if share == TRIES[-1] else max(least, upper - share * (upper - least))
                on.append(a)
                thresholds.append(tried[a])
        live = np.array(on, np.int64)
        if not len(live):
            return
        for a, at in join.reach(live, np.array(thresholds)):
            at = at[((own[at] == labels[a]) == same) & (numbers[at] != no[a])]
            if len(at):
                fills.add(a, exact_scores(q[a], m[at]), ids[at], numbers[at])


def matched(lots: DataFrame, blocks: DataFrame, dim: int, order: np.ndarray, k: int, same: bool) -> DataFrame:
    """(no, anchor_id, window, score, id): what each task finds for each window, k rows at most, of the rows of the anchor's label (`same`) or of others.

    Lots are (lot, first, last, n, heads, m, ends), blocks (block, first, last, ids, labels, m); `first` and `last` are
    their least and greatest labels. A lot is sent to the runs of blocks that can hold rows it asks for.
    """
    spark = lots.sparkSession
    bands = blocks.groupBy(F.expr(f"block div {RUN}").alias("band")).agg(F.min("first").alias("first"), F.max("last").alias("last")).collect()  # three numbers for each RUN blocks
    known = lots.select("lot", "first", "last").collect()  # three numbers for each lot
    meet = lambda a, z, b, y: (a <= y and b <= z) if same else not (a == z == b == y)
    kind = "lot bigint, band bigint, block bigint, heads binary, m binary"

    def send_lots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                for to in slices(np.array([b.band for b in bands if meet(r.first, r.last, b.first, b.last)], np.int64), len(r.m) + len(r.heads)):
                    yield pd.DataFrame({"lot": r.lot, "band": to, "block": -1, "heads": [r.heads] * len(to), "m": [r.m] * len(to)})

    def send_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                b = of_band[r.block // RUN]
                for to in slices(np.array([x.lot for x in known if meet(x.first, x.last, b.first, b.last)], np.int64), len(r.m)):
                    yield pd.DataFrame({"lot": to, "band": r.block // RUN, "block": r.block, "heads": [r.ids + r.labels] * len(to), "m": [r.m] * len(to)})

    of_band = {b.band: b for b in bands}

    def work(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in group[group.block < 0].itertuples():
            q = np.frombuffer(r.m).reshape(-1, dim)
            no, qid, label, count = np.frombuffer(r.heads[: 32 * len(q)], np.int64).reshape(4, -1)
            ends = np.frombuffer(r.heads[32 * len(q) :]).reshape(2, -1)
            at = np.cumsum(count)[:-1]
            fills = Fill(np.split(ends[0], at), np.split(ends[1], at), k)
            for b in group[group.block >= 0].sort_values("block").itertuples():
                m = np.frombuffer(b.m).reshape(-1, dim)
                ids, own = np.frombuffer(b.heads, np.int64).reshape(2, -1)
                fill(fills, q, no, label, m, ids, b.block * BLOCK + np.arange(len(m)), own, order, same)
            out += [(n, i, w, s, x) for n, i, held in zip(no, qid, fills.held, strict=True) for w, (ss, ids, _) in enumerate(held) for s, x in zip(ss, ids, strict=True)]
        return pd.DataFrame(out, columns=["no", "anchor_id", "window", "score", "id"])

    if not bands or not known:
        return spark.createDataFrame([], "no bigint, anchor_id bigint, window int, score bigint, id bigint")
    met = lots.select("lot", "first", "last", "heads", "m").mapInPandas(send_lots, kind).unionByName(blocks.mapInPandas(send_blocks, kind))
    return met.groupBy("lot", "band").applyInPandas(work, "no bigint, anchor_id bigint, window int, score bigint, id bigint")


def packed(anchors: DataFrame, dim: int, size: int) -> DataFrame:
    """Lots of anchors (no, id, label, x, low, high: the ends of their windows), those of a label together."""

    def lots_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        for i, f in enumerate(packs(frames, size)):
            heads = np.stack([f.no, f.id, f.label, f.low.map(len)]).astype(np.int64).tobytes() + np.stack([np.concatenate([*f.low]), np.concatenate([*f.high])]).astype(float).tobytes()
            yield pd.DataFrame([(TaskContext.get().partitionId() << 32 | i, int(f.label.min()), int(f.label.max()), heads, _matrix(f.x, dim).tobytes())], columns=["lot", "first", "last", "heads", "m"])

    parts = max(1, math.ceil(anchors.count() / (size * PARTS)))
    return durable(anchors.repartitionByRange(parts, "label", "no").sortWithinPartitions("label", "no").mapInPandas(lots_of, "lot bigint, first bigint, last bigint, heads binary, m binary"))


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and positive the first rows of other labels in the positive's window.

    A row's score is its integer inner product with the anchor, of components floor(scale * x); higher scores come first,
    ties by smaller id. An anchor's positives are its first other rows of the same label; negatives have
    low * positive_score <= 100 * score <= high * positive_score, so a negative or too narrow window gives none.
    `is_anchor` is a Column over the id as `id`. Rows with a null label, a null vector, or a null or non-finite component
    take no part, and neither do null ids, which can name no row. Rows that repeat an id are rows each, as anchors too.
    Shorter vectors count as padded by zeros; scores beyond 64 bits are given as the nearest such number, and windows of scores
    beyond 53 bits have ends rounded to doubles. Other columns
    take no part. Empty input, or no anchor, gives no rows.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col(id_col).cast("bigint").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("bigint").alias("label"), F.col(vec_col).cast("array<double>").alias("x"))
    rows = sound(named.where("id IS NOT NULL AND label IS NOT NULL"), "x").withColumn("x", F.transform("x", lambda v: F.floor(v * scale).cast("double"))).withColumn("asks", F.coalesce(is_anchor, F.lit(False)))
    said = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dim")).first()
    kind = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not said.n:
        return spark.createDataFrame([], kind)
    dim = max(1, said.dim)
    size, lot = (max(1, min(most, BLOCK_BYTES // (8 * dim))) for most in (BLOCK, LOT))

    def blocks_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        for i, f in enumerate(packs(frames, size)):
            m = _matrix(f.x, dim)
            yield pd.DataFrame({
                "block": [TaskContext.get().partitionId() << 24 | i], "first": [int(f.label.min())], "last": [int(f.label.max())],
                "ids": [f.id.to_numpy(np.int64).tobytes()], "labels": [f.label.to_numpy(np.int64).tobytes()], "asks": [f.asks.to_numpy(bool).tobytes()], "m": [m.tobytes()], "squares": [(m**2).sum(axis=0).tolist()],
            })

    ranged = rows.repartitionByRange(max(1, math.ceil(said.n / (size * PARTS))), "label", "id").sortWithinPartitions("label", "id")
    blocks = durable(ranged.mapInPandas(blocks_of, "block bigint, first bigint, last bigint, ids binary, labels binary, asks binary, m binary, squares array<double>"))
    # Dimensions by falling weight: the lists of the first ones hold most of a score.
    weight = blocks.agg(*(F.sum(F.col("squares")[i]).alias(f"s{i}") for i in range(dim))).first()
    order = np.argsort([-w for w in weight], kind="stable")
    blocks = blocks.drop("squares")

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                m = np.frombuffer(r.m).reshape(-1, dim)
                for i in slices(np.flatnonzero(np.frombuffer(r.asks, bool)), 8 * dim):
                    yield pd.DataFrame({"no": r.block * BLOCK + i, "id": np.frombuffer(r.ids, np.int64)[i], "label": np.frombuffer(r.labels, np.int64)[i], "x": [*m[i]]})

    anchors = durable(blocks.mapInPandas(numbered, "no bigint, id bigint, label bigint, x array<double>"))
    blocks = blocks.drop("asks")
    open_ended = anchors.withColumn("low", F.array(F.lit(float("-inf")))).withColumn("high", F.array(F.lit(float("inf"))))
    near = matched(packed(open_ended, dim, lot), blocks, dim, order, positives, True)
    first = Window.partitionBy("no").orderBy(F.desc("score"), "id")
    found = durable(near.withColumn("at", F.row_number().over(first)).where(F.col("at") <= positives).select("no", "at", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # A window by whole scores: from the least to the greatest that the positive allows.
    score = F.col("positive_score").cast("decimal(38,0)")
    ends = found.select("no", "at", F.ceil(score * low / 100).cast("double").alias("low"), F.floor(score * high / 100).cast("double").alias("high"))
    windows = ends.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("w"))  # `positives` windows at most
    asked = anchors.join(windows, "no").select("no", "id", "label", "x", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    other = matched(packed(durable(asked), dim, lot), blocks, dim, order, negatives, False)
    ranks = Window.partitionBy("no", "window").orderBy(F.desc("score"), "id")
    other = other.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= negatives).select("no", (F.col("window") + 1).alias("at"), "anchor_id", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return other.join(found, ["no", "at"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every row of `embeddings` whose vec_id is divisible by 100; labels of rows divisible by 7 are moved by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.n, a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, list_inner_product(a.x, c.x)::BIGINT AS score
  FROM v a JOIN v c ON a.n <> c.n WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS at FROM s WHERE same),
q AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.n, p.at ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.n = p.n AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score WHERE p.at <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM q WHERE rank <= 5
"""
