"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

Sources share a budget of words by weight. A source stops at `epochs` times its size; what it can't take is shared again
by weight among the rest until none is above. Sorted by cap over weight, the sources below some rank are those that stop,
so prefix sums over the sources give the final level at once. A source's target is whole repetitions of all its documents
and one more repetition of some: documents are dealt into buckets by a seeded hash, buckets under the remaining target
are repeated whole, the bucket that crosses it by the fraction that is left, the rest not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tellur.llm.common import WORD, durable, read

#: Hash buckets of a source: 16 ** DIGITS.
DIGITS = 3
#: Rows of buckets that are broadcast, about 100 bytes each; those of more sources are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Columns that the mix adds to documents.
ADDED = ("size", "source_size", "target", "taken")


def targets(sources: DataFrame, share: float = 1.5, epochs: float = 2.0, weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row for each source, by code point with null last, weighed by `weights` in turn.

    The levels need all sources in order, so these rows, one a source, meet in one task.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), F.pmod(turn, F.lit(len(weights))) + 1)
    s = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    level = F.greatest(F.lit(0.0), budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level)
    # Levels rise while sources stop at their caps and fall from the first that doesn't: its level is final. With a budget beyond all caps there is none.
    final = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    return s.select("source", "source_size", F.coalesce(F.least(F.col("cap"), final * F.col("weight")), F.col("cap")).alias("target"))


def _rows(seed: str, id_col: str, text_col: str, source_col: str) -> dict:
    """What the mix needs of a row, as columns."""
    return {
        "doc_id": F.col(id_col).cast("bigint"),
        "source": F.col(source_col).cast("string"),
        "size": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint"),
        "bucket": F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, DIGITS),
    }


def _lots(rows: DataFrame, share: float, epochs: float, weights: tuple[float, ...]) -> DataFrame:
    """(s, b, source_size, target, whole, part) of each source and bucket of rows (source, bucket, size): repetitions, whole and in part."""
    lots = rows.groupBy("source", "bucket").agg(F.sum("size").alias("lot"))
    goal = targets(lots.groupBy("source").agg(F.sum("lot").alias("source_size")), share, epochs, weights).withColumnRenamed("source", "of")
    lots = lots.join(goal, F.col("source").eqNullSafe(F.col("of")))
    order = Window.partitionBy("source").orderBy("bucket")  # 16 ** DIGITS rows of a source at most
    whole = F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))
    start = F.sum("lot").over(order) - F.col("lot")
    part = F.when(F.col("source_size") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("target") - whole * F.col("source_size") - start) / F.nullif(F.col("lot"), F.lit(0)))))
    lots = lots.withColumns({"whole": F.coalesce(whole, F.lit(0)), "part": F.coalesce(part, F.lit(0.0))})
    lots = durable(lots.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "source_size", "target", "whole", "part"))
    return F.broadcast(lots) if lots.count() <= BROADCAST_ROWS else lots


def _taken(size) -> F.Column:
    return (F.col("whole") * size + F.floor(F.col("part") * size)).cast("bigint")


def mix(docs: DataFrame, share: float = 1.5, epochs: float = 2.0, weights: tuple[float, ...] = (5, 2, 1), seed: str = "mix-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for each row of `docs`; taken: words the mix takes, repeats counted.

    Null and empty texts have size 0 and nothing taken. A null source is a source, sorted last. Repeated rows count each;
    rows with equal ids share a bucket, a null id counts as the empty string. Other columns take no part. An empty table
    gives none. Reruns agree, however rows are partitioned: bucket and fraction depend on id, source and sums only.
    Words are counted once, into a written table of ids, sources and sizes.
    """
    rows = durable(docs.select(*(x.alias(n) for n, x in _rows(seed, id_col, text_col, source_col).items())))
    lots = _lots(rows, share, epochs, weights)
    out = rows.join(lots, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return out.select("doc_id", "size", "source_size", "target", _taken(F.col("size")).alias("taken"), "source")


def mixed(docs: DataFrame, share: float = 1.5, epochs: float = 2.0, weights: tuple[float, ...] = (5, 2, 1), seed: str = "mix-1") -> DataFrame:
    """The rows of `docs`, all columns, that the mix takes words of, with `size`, `source_size`, `target` and `taken` beside them.

    Each row has its own size, whatever ids repeat or are null. Columns of `docs` with these names get underscores before
    them, as many as are needed. Nulls, empty texts and empty tables as in `mix`.
    """
    own, new = {c.lower() for c in docs.columns}, {}
    for c in docs.columns:
        if (to := c).lower() in ADDED:
            while to.lower() in own:
                to = f"_{to}"
            own.add(to.lower())
            new[c] = to
    docs = docs.withColumnsRenamed(new)
    names = docs.columns
    of = {k: x.alias(k) for k, x in _rows(seed, "doc_id", "text", "source").items()}
    lots = _lots(docs.select(of["source"], of["bucket"], of["size"]), share, epochs, weights)
    # The document stays one column beside what the mix needs, so that no name of it clashes.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc"), *of.values())
    out = rows.join(lots, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    out = out.withColumn("taken", _taken(F.col("size"))).where("taken > 0")
    return out.select(*(F.col("doc")[c].alias(c) for c in names), *ADDED)


def op6_mix(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of all `documents`."""
    return mix(read(spark, sf_dir, "documents")).drop("source")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 3) AS bucket FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
l AS (
  SELECT *, greatest(0.0::DOUBLE, 1.5::DOUBLE * (SELECT sum(source_size)::DOUBLE FROM s)
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT max(level) FROM l WHERE level * weight <= cap) * weight), cap) AS target FROM l),
b AS (SELECT source, bucket, sum(size)::BIGINT AS lot FROM d GROUP BY 1, 2),
c AS (
  SELECT b.source, b.bucket, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
    CASE WHEN b.lot > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, (t.target - floor(t.target / t.source_size) * t.source_size
      - (sum(b.lot) OVER (PARTITION BY b.source ORDER BY b.bucket) - b.lot)) / b.lot)) ELSE 0 END AS part
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source)
SELECT d.doc_id, d.size, c.source_size, c.target, (c.whole * d.size + floor(c.part * d.size))::BIGINT AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.bucket = c.bucket
"""
