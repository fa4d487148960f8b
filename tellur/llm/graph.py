"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellur.llm.common import durable


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, label) for every node of `edges` (u, v: bigint): label is the smallest node that it reaches.

    Each round gives a node the least label among its neighbours and then the label of that label, so labels cross a
    component in about the logarithm of its width. Both joins read written tables on either side, so adaptive execution
    can split a hub's rows; minima are combined before each shuffle. Labels never leave the executors: the driver sees
    one sum a round, which stops falling at the end. Empty input gives an empty table.
    """
    both = durable(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label"))
    labels, total = durable(labels), None
    for _ in range(most):
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now
        near = both.join(labels, both.u == labels.node).select(F.col("v").alias("node"), "label")
        least = durable(near.union(labels).groupBy("node").agg(F.min("label").alias("label")))
        far = least.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = durable(least.join(far, "label").select("node", F.col("next").alias("label")))
    raise RuntimeError(f"labels still change after {most} rounds")
