"""Shared helpers: durable intermediate results and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a table that is broadcast; anything larger is joined by a shuffle.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the one that the session names.

    Where it names none, a private one will do on one machine, and goes at exit; a cluster is refused, as its
    executors would not share the folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = None
        if not named:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            own = tempfile.mkdtemp(prefix="loomspan-")
            atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(named or own)
    return named or sc.getCheckpointDir()


def pin(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from the files, so a lost executor costs no rerun.

    Spark's context cleaner removes the files once the result is no longer referenced.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Write `df` as Parquet below the shared folder and read it again; removed at exit.

    For wide rows, where Parquet's encodings are worth more than a checkpoint's plain rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)

    def remove() -> None:
        if spark.sparkContext._jsc is None:
            return
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    atexit.register(remove)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows (counted), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, since one text may be very long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named input columns under our own names, so other columns cannot clash."""
    return df.select(*(df[old].alias(new) for new, old in columns.items()))


def columns(df: DataFrame) -> list[Column]:
    """All columns of `df`, whatever their names."""
    return [F.col(f"`{n.replace('`', '``')}`") for n in df.columns]
