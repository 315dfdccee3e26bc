"""Files of tables: sizes, listings and replacement, through Hadoop's file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def size(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def folders(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def replace_folder(df: DataFrame, path: str, by: list[str]) -> None:
    """Write beside the folder, then put the new one in its place."""
    spark = df.sparkSession
    beside = f"{path}.{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(beside) if by else df.write.parquet(beside)
    fs, p = _fs(spark, path)
    fs.delete(p, True)
    if not fs.rename(_fs(spark, beside)[1], p):
        raise OSError(f"can't put {beside} in place of {path}")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder; a local session without one gets a temporary one, any other is refused."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="wirelake-"))
    return df.checkpoint()


def drop_checkpoint(df: DataFrame) -> None:
    """Delete the files of a checkpointed table that nothing reads any more."""
    path = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if path.isDefined():
        delete(df.sparkSession, path.get())
