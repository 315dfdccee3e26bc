"""Things that several operators of this subpackage share.

Lineage is cut only by written tables in the folder that the cluster names in
``spark.checkpoint.dir`` (shared by the driver and all executors), so that a lost
executor costs the repetition of the running stage and nothing else.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words in every contract of this subpackage, inside a Java character class.
SPACE = r"\x20\x09-\x0D"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only in a local session (tests) may the setting be absent, which then gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="wirelake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/wirelake/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Within: Spark deletes an action's shuffle files as soon as the action is over."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stash(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and return the table that reads it; the plan's shuffle files go when it is written."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffles_end(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Delete the files of a stashed table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/wirelake/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(taken: list[str], name: str) -> str:
    """A column name that is none of those taken."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def fresh_prefix(taken: list[str]) -> str:
    """A start of column names that none of those taken has."""
    prefix = "_"
    while any(t.startswith(prefix) for t in taken):
        prefix += "_"
    return prefix


def text_bytes(col: str = "text"):
    """The UTF-8 bytes of a text column; null counts as the empty text."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def slices(batches, rows: int = 256):
    """Record batches cut into pieces of few rows, to keep few Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
