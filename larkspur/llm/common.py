"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.session import ship

#: Unicode white space as the contracts count it in words: space and \t \n \v \f \r.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Only where the setting is absent (local tests) a machine-local folder is used.
    """
    ship(spark)
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="larkspur-")
    return f"{base.rstrip('/')}/larkspur-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and reread it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of tables made by ``written`` that nothing reads any more; other tables are left alone."""
    for df in tables:
        path = getattr(df, "scratch_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def rest_worker() -> None:
    """Hand what a Python task has freed back to the system; workers live on between tasks, beside the JVM that needs the memory next."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referenced, without waiting for the driver's next collection."""
    for _ in range(2):  # what the first finds unreachable, the second clears
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever its columns are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while f"_{name}" in taken:
            name = f"_{name}"
        out.append(f"_{name}")
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8_size(column: str) -> F.Column:
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")
