"""What operators share that need tables between steps or Python workers: the shared folder, cut lineage, small batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch of whole texts, so that a worker's memory stays bounded.
TEXT_ROWS = 256
#: Rows of a side that is measured and then broadcast; with more a join is left to Spark.
SMALL_ROWS = 10_000


def few(df: DataFrame, most: int = SMALL_ROWS) -> list | None:
    """The rows of df if there are at most so many; the driver never holds more than one row over that."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def small_side(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df to be broadcast if it has at most so many rows; else as it is."""
    rows = few(df, most)
    return df if rows is None else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; where it is unset (tests on one machine), a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """Cut lineage: a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage where a table is used more than once: Parquet in the shared folder, read back."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, label: str) -> str:
    """A name in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """For every operator that hands whole texts to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
