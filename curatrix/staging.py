"""Tables written to the folder that all executors share, to cut lineage and survive lost executors.

Scratch tables are lazily read by what is built on them, so they outlive the call that writes them. They
go when the application ends, when a `scratch` block they were made in ends, or by remove_tree().
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL = "file:///tmp/curatrix-shared"
#: Scratch folders made so far inside open scratch blocks, the innermost block last.
_OPEN: list[list[str]] = []


def shared_base(checkpoint_dir: str | None, master: str) -> str:
    """The folder that driver and executors share; a folder of this machine only where all of Spark runs on it."""
    if checkpoint_dir:
        return checkpoint_dir.rstrip("/")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    return _LOCAL


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir."""
    path = f"{shared_base(spark.conf.get('spark.checkpoint.dir', None), spark.sparkContext.master)}/curatrix-{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def write_staged(df: DataFrame, name: str, **options: str) -> str:
    """Writes df to a fresh shared folder, with options of the writer. A write that fails raises, and so does one that the driver can't see."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").options(**options).parquet(path)
    fs, p = _file_system(spark, path)
    if not any(s.getPath().getName().startswith("part-") for s in fs.listStatus(p)):
        raise RuntimeError(f"no part of {path} is visible to the driver: spark.checkpoint.dir is not a shared folder")
    fs.deleteOnExit(p)
    return path


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back."""
    path = write_staged(df, name, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove_tree(spark: SparkSession, path: str) -> None:
    """Deletes a folder by whatever file system holds it."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


@contextmanager
def scratch(spark: SparkSession):
    """Removes the scratch tables made inside the block at its end: results must be written or collected before."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove_tree(spark, path)


def small_side(df: DataFrame, most_bytes: int = 32 << 20, size: str = "0") -> DataFrame:
    """df as the side to broadcast if it has been measured to be small, as it is otherwise: a shuffle then joins it.

    The measure is 16 bytes a row and what size, an SQL expression, says of each. df should be cheap to read.
    """
    n = df.agg(F.coalesce(F.sum(F.expr(f"16 + {size}").cast("bigint")), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= most_bytes else df
