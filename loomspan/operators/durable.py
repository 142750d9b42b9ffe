"""Results that outlive the executors which made them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Most rows of a table that is broadcast, and most edges of a graph that one task works on.
BROADCAST_ROWS, LOCAL_EDGES = 100_000, 500_000


def checkpoint_dir(spark: SparkSession) -> None:
    """Have the session write checkpoints to the folder that its spark.checkpoint.dir names.

    Where it names none, a private folder will do on one machine, and goes at exit; a cluster is refused,
    as its executors would not share the folder.
    """
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="loomspan-")
        atexit.register(shutil.rmtree, named, True)
    spark.sparkContext.setCheckpointDir(named)


def pin(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and go on from the files."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As `pin`, in columns and compressed: for many rows. The order of the rows is not kept."""
    checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows (counted), else as it is."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
