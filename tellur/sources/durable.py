"""Written intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that is sent to all tasks.
FEW = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or the context's checkpoint folder. Only a local session without one, as in tests, gets a temporary folder."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if (set_by_hand := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        return set_by_hand.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    spark.conf.set("spark.checkpoint.dir", folder := tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def sent_whole(said: DataFrame) -> DataFrame:
    """A table with a row or a few for each raster, sent to all tasks up to FEW rows: joined by ids, each large raster would meet in one task. More rows are many rasters and stay as they are."""
    return F.broadcast(said) if said.limit(FEW + 1).count() <= FEW else said
