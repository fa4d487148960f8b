"""Exact top-k inner-product search over norm-sorted blocks with Cauchy-Schwarz pruning.

Candidates are range-partitioned by descending length and packed into blocks, each rotated by the right singular vectors
of the whole table, so that the first rotated coordinates hold most of an inner product. The block of the longest vectors
gives each query a first floor, its k-th best score there, and so the least length of a vector that can be a result.
Queries are dealt into lots by that length; a lot and a band of blocks are sent to each other only where the band's
vectors are long enough. There, the longest block first, blocks whose greatest length times the query's length stays
under the floor are skipped, and of the rest only vectors whose partial sum plus the product of the residual lengths
reaches the floor are scored exactly. Vectors stay on the executors; the driver sees a few numbers for each partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tellur.llm.common import durable, read

#: Most candidates and queries in a block, candidate blocks that one task takes against one lot of queries, and blocks in a range partition.
BLOCK, QUERIES, RUN, PARTS = 2_048, 2_048, 4, 32
#: Most bytes of a block's numbers; blocks of very long vectors hold fewer.
BLOCK_BYTES = 1 << 24


def integers(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): components floor(scale * x) as doubles; vectors that are null or hold null or non-finite components are left out, as are null ids."""
    x = F.transform(F.col(vec_col), lambda v: F.floor(v.cast("double") * scale).cast("double"))
    sound = F.forall(F.col(vec_col), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & sound).select(F.col(id_col).cast("bigint").alias("id"), x.alias("x"))


def _matrix(xs, dim: int) -> np.ndarray:
    """Rows padded by zeros to `dim`: vectors of other lengths meet on the components that both have."""
    out = np.zeros((len(xs), dim))
    for i, x in enumerate(xs):
        out[i, : len(x)] = x
    return out


def gram(rows: DataFrame, dim: int) -> np.ndarray:
    """The dim x dim sum of outer products, from one such sum for each partition."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for f in frames:
            m = _matrix(f.x, dim)
            total += m.T @ m
        yield pd.DataFrame({"at": np.arange(dim * dim), "s": total.ravel()})

    sums = rows.select("x").mapInPandas(work, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(dim * dim)
    out[[r.at for r in sums]] = [r.s for r in sums]
    return out.reshape(dim, dim)


def exact_scores(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Integer inner products of every row of m with q; beyond the integers that doubles hold, by Python's own integers."""
    if float(np.abs(m).sum(axis=1).max(initial=0)) * float(np.abs(q).max(initial=0)) < 2**53:
        return (m @ q).astype(np.int64)
    ints = [int(x) for x in q]
    scores = [sum(int(a) * b for a, b in zip(row, ints, strict=True)) for row in m]
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in scores], np.int64)


class Best:
    """The k best (score, id) of one query so far, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def floor(self) -> float:
        return float(self.score[-1]) if len(self.score) == self.k else -math.inf

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        order = np.lexsort((i, -s.astype(object) if len(s) and s.min() == -(2**63) else -s))[: self.k]
        self.score, self.ids = s[order], i[order]


def scan(best: list[Best], floors: np.ndarray, qno: np.ndarray, q: np.ndarray, qr: np.ndarray, no: np.ndarray, ids: np.ndarray, m: np.ndarray, mr: np.ndarray, lead: int) -> None:
    """Takes one block into the best of each query; floors are scores known from elsewhere that a result must reach, numbers those of rows."""
    qn, mn = np.linalg.norm(q, axis=1), np.linalg.norm(m, axis=1)
    q_rest, m_rest = np.linalg.norm(qr[:, lead:], axis=1), np.linalg.norm(mr[:, lead:], axis=1)
    slack = 1e-9 * (1 + qn[:, None] * mn.max(initial=0))
    need = np.maximum(floors, [b.floor() for b in best])
    live = np.flatnonzero(qn * mn.max(initial=0) + slack[:, 0] >= need)  # the whole block by lengths
    if not len(live) or not len(ids):
        return
    bound = qr[live, :lead] @ mr[:, :lead].T + np.outer(q_rest[live], m_rest)
    for i, ok in zip(live, bound + slack[live] >= need[live, None], strict=True):
        at = np.flatnonzero(ok & (no != qno[i]))
        if len(at):
            best[i].add(exact_scores(q[i], m[at]), ids[at])


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest integer inner products of each query row with every other row.

    `is_query` is a Column over the id as `id`. Ties go to the smaller id; fewer than k candidates give all. A query is a
    row: rows that repeat an id are queries each, with ranks of their own, and candidates for each other. Vectors with
    null or non-finite components, null vectors and null ids take no part; shorter vectors count as padded by zeros.
    Scores beyond 64 bits are given as the nearest such number and tie there. Other columns take no part. Empty input, or
    no query, gives no rows.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, scale, id_col, vec_col).withColumn("asks", F.coalesce(is_query, F.lit(False)))
    said = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dim"), F.count_if("asks").alias("nq")).first()
    dim = max(1, said.dim or 1)
    size = max(1, min(BLOCK, BLOCK_BYTES // (8 * dim)))
    turn = np.linalg.eigh(gram(rows, dim))[1][:, ::-1]  # right singular vectors, the greatest first
    lead = max(1, dim // 4)
    length = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)

    def blocks_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for i, f in enumerate(packs(frames, size)):
            m = _matrix(f.x, dim)
            yield pd.DataFrame({"part": [_part()], "i": [i], "longest": [float(np.linalg.norm(m, axis=1).max())], "ids": [f.id.to_numpy(np.int64).tobytes()], "asks": [f.asks.to_numpy(bool).tobytes()], "m": [m.tobytes()]})

    ranged = rows.repartitionByRange(max(1, math.ceil(said.n / (size * PARTS))), length.desc(), F.col("id")).sortWithinPartitions(length.desc(), "id")
    blocks = durable(ranged.mapInPandas(blocks_of, "part int, i int, longest double, ids binary, asks binary, m binary"))
    # Two numbers for each PARTS blocks: how far their vectors reach, and how many bands of RUN blocks they are.
    ends = sorted((r.part, r.longest, r.i // RUN + 1) for r in blocks.groupBy("part").agg(F.max("longest").alias("longest"), F.max("i").alias("i")).collect())
    none = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if not ends or not said.nq:
        return none
    top = max(ends, key=lambda e: (e[1], -e[0]))[0]
    head = blocks.where((F.col("part") == top) & (F.col("i") == 0)).select("part", "i", "ids", "m").first()  # one block of BLOCK_BYTES at most
    sent = spark.sparkContext.broadcast((head.part << 32 | head.i, bytes(head.ids), bytes(head.m)))

    def queries_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, m = sent.value[0], np.frombuffer(sent.value[1], np.int64), np.frombuffer(sent.value[2]).reshape(-1, dim)
        for f in frames:
            for r in f.itertuples():
                own = np.flatnonzero(np.frombuffer(r.asks, bool))
                if not len(own):
                    continue
                q, no = np.frombuffer(r.m).reshape(-1, dim)[own], (r.part << 32 | r.i) * BLOCK + own
                best = [Best(k) for _ in own]
                scan(best, np.full(len(own), -np.inf), no, q, q @ turn, at * BLOCK + np.arange(len(ids)), ids, m, m @ turn, lead)
                floors, norm = np.array([b.floor() for b in best]), np.linalg.norm(q, axis=1)
                reach = np.where(floors > 0, floors / np.maximum(norm, 1e-9) * (1 - 1e-9) - 1e-9, 0.0)  # no shorter vector can be a result
                yield pd.DataFrame({"no": no, "id": np.frombuffer(r.ids, np.int64)[own], "q": [x.tobytes() for x in q], "floor": floors, "reach": reach})

    asked = durable(blocks.select("part", "i", "ids", "asks", "m").mapInPandas(queries_of, "no bigint, id bigint, q binary, floor double, reach double"))
    lot_size = max(1, min(QUERIES, BLOCK_BYTES // (8 * dim)))

    def lots_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for i, f in enumerate(packs(frames, lot_size)):
            heads = (x.to_numpy().tobytes() for x in (f.no, f.id, f.floor))
            yield pd.DataFrame([(_part() << 32 | i, float(f.reach.min()), b"".join(heads), b"".join(f.q))], columns=["lot", "reach", "heads", "m"])

    by_reach = asked.repartitionByRange(max(1, math.ceil(said.nq / (lot_size * PARTS))), "reach", "no").sortWithinPartitions("reach", "no")
    lots = durable(by_reach.mapInPandas(lots_of, "lot bigint, reach double, heads binary, m binary"))
    known = sorted((r.reach, r.lot) for r in lots.select("reach", "lot").collect())  # two numbers for each `lot_size` queries
    reaches, numbers = np.array([x for x, _ in known]), np.array([x for _, x in known], np.int64)

    def send_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                for own in slices(numbers[: np.searchsorted(reaches, r.longest, "right")], len(r.m)):
                    heads = [np.int64(r.part << 32 | r.i).tobytes() + r.ids] * len(own)
                    yield pd.DataFrame({"lot": own, "band": (r.part << 32) + r.i // RUN, "longest": r.longest, "heads": heads, "m": [r.m] * len(own)})

    def send_lots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                bands = np.array([(part << 32) + b for part, longest, n in ends if longest >= r.reach for b in range(n)], np.int64)
                for own in slices(bands, len(r.m)):
                    yield pd.DataFrame({"lot": r.lot, "band": own, "longest": -1.0, "heads": [r.heads] * len(own), "m": [r.m] * len(own)})

    def meet(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in group[group.longest < 0].itertuples():
            q = np.frombuffer(r.m).reshape(-1, dim)
            no, qid, floors = (np.frombuffer(r.heads[8 * len(q) * i : 8 * len(q) * (i + 1)], kind) for i, kind in enumerate((np.int64, np.int64, np.float64)))
            best, qr = [Best(k) for _ in no], q @ turn
            for c in group[group.longest >= 0].sort_values("longest", ascending=False, kind="stable").itertuples():
                m, ids = np.frombuffer(c.m).reshape(-1, dim), np.frombuffer(c.heads[8:], np.int64)
                scan(best, floors, no, q, qr, int(np.frombuffer(c.heads[:8], np.int64)[0]) * BLOCK + np.arange(len(ids)), ids, m, m @ turn, lead)
            out += [(n, a, i, s) for n, a, b in zip(no, qid, best, strict=True) for i, s in zip(b.ids, b.score, strict=True)]
        return pd.DataFrame(out, columns=["no", "query_id", "vec_id", "score"])

    packed = "lot bigint, band bigint, longest double, heads binary, m binary"
    met = lots.mapInPandas(send_lots, packed).unionByName(blocks.select("part", "i", "longest", "ids", "m").mapInPandas(send_blocks, packed))
    found = met.groupBy("lot", "band").applyInPandas(meet, "no bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("no").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def packs(frames: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """The rows in order, `most` in each frame but the last."""
    held, n = [], 0
    for f in frames:
        held.append(f)
        n += len(f)
        if n >= most:
            whole = pd.concat(held)
            for i in range(0, n - most + 1, most):
                yield whole.iloc[i : i + most]
            held, n = [whole.iloc[n // most * most :]], n % most
    if n:
        yield pd.concat(held)


def slices(x: np.ndarray, weight: int) -> Iterator[np.ndarray]:
    """Parts of an array, so many in each that rows of `weight` bytes make a frame of some megabytes."""
    step = max(1, (1 << 25) // max(1, weight))
    return (x[i : i + step] for i in range(0, len(x), step))


def op2_topk(spark, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 5 best of every query whose vec_id is divisible by 50."""
    return top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
