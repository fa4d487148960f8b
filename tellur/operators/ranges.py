"""Statistics of each raster as a table with one row for each raster, and joined back to the rasters' cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellur.sources.cells import keys
from tellur.sources.durable import durable, sent_whole

#: Values of a raster whose percentiles one aggregate may hold, bins of a pass over larger ones, and values left around a rank at the end.
AT_ONCE, BINS, LEFT = 1_000_000, 4_096, 65_536


def attached(cells: DataFrame, said: DataFrame) -> DataFrame:
    """`said`, a row for each raster, written and sent to its cells, a null raster_id too; of a table without ids its only row as constants."""
    by = keys(cells)
    if not by:
        one = said.first()
        return cells.withColumns({c: F.lit(one[c]).cast(t) for c, t in said.dtypes})
    other = sent_whole(durable(said).withColumnsRenamed({k: f"_of_{k}" for k in by}))
    on = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in by))
    return cells.join(other, on, "left").drop(*(f"_of_{k}" for k in by))


def with_bounds(table: DataFrame, names: list[str], write: bool = True) -> DataFrame:
    """The table with <name>_low and <name>_high, each raster's least and greatest value of a column (0 without values).

    What makes the table runs once: it is written before its bounds are taken, unless `write` is off.
    """
    table = durable(table) if write else table
    said = table.groupBy(*keys(table)).agg(*(F.coalesce(f(n), F.lit(0.0)).alias(f"{n}_{k}") for n in names for k, f in (("low", F.min), ("high", F.max))))
    return attached(table, said)


def quantiles_of(table: DataFrame, name: str, shares: list[float], most: int = AT_ONCE, left: int = LEFT, by: list[str] | None = None) -> DataFrame:
    """([raster_id,] q0, q1, ...): exact percentiles of a column in each raster (or each of `by`), interpolated between the two values beside a rank; no row without values.

    Rasters of up to `most` values go by an aggregate. Of all larger ones at once, the values around each wanted rank are
    counted in bins, and the bin that holds the rank is divided again, until it holds `left` values or one: a raster has
    BINS counts a rank in each pass, and no raster meets in one task.
    """
    by = keys(table) if by is None else by
    x = durable(table.where(F.col(name).isNotNull()).select(F.struct(*by).alias("k") if by else F.lit(0).alias("k"), F.col(name).cast("double").alias("x")))
    said = durable(x.groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")))
    exact = F.percentile("x", F.array(*map(F.lit, shares))).alias("q")
    named = lambda q: q.select(*(F.col(f"k.{c}").alias(c) for c in by), *(F.col("q")[i].alias(f"q{i}") for i in range(len(shares))))
    if not said.where(F.col("n") > most).limit(1).count():
        return named(x.groupBy("k").agg(exact))
    few = x.join(sent_whole(said.where(F.col("n") <= most).select("k")), "k", "left_semi").groupBy("k").agg(exact)
    places = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(p), F.ceil(p)) for p in places))))
    rank = said.where(F.col("n") > most).select("k", F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("bigint").alias("before"), F.col("n").alias("inside"))
    rank = durable(rank)
    wide = F.col("hi") / BINS - F.col("lo") / BINS
    while (open_ := rank.where((F.col("inside") > left) & (wide > 0))).limit(1).count():
        own = x.join(sent_whole(open_.select("k", "rank", "lo", "hi", "before", wide.alias("wide"))), "k").where("x >= lo AND x <= hi")
        at = F.least(F.lit(BINS - 1), F.floor((F.col("x") - F.col("lo")) / F.col("wide")))
        bins = own.groupBy("k", "rank", "before", at.alias("b")).agg(F.count("*").alias("inside"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = F.sum("inside").over(Window.partitionBy("k", "rank").orderBy("b"))  # BINS rows at most
        found = bins.withColumn("upto", F.col("before") + upto).where("rank < upto AND rank >= upto - inside")
        found = found.select("k", "rank", "lo", "hi", (F.col("upto") - F.col("inside")).alias("before"), "inside")
        rank = durable(rank.where(~((F.col("inside") > left) & (wide > 0))).unionByName(found))
    own = x.join(sent_whole(rank), "k").where("x >= lo AND x <= hi").groupBy("k", "rank", "before", "x").agg(F.count("*").alias("times"))
    upto = F.col("before") + F.sum("times").over(Window.partitionBy("k", "rank").orderBy("x"))  # `left` values at most
    value = own.withColumn("upto", upto).where("rank < upto AND rank >= upto - times").groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("v"))
    at = lambda f, p: F.element_at("v", f(p))
    many = value.join(said, "k").select("k", F.array(*(at(F.floor, p) + (at(F.ceil, p) - at(F.floor, p)) * (p - F.floor(p)) for p in places)).alias("q"))
    return named(few.unionByName(many))
