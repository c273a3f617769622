"""Where stages are written: the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach. Where none is named, only a session whose one process is local gets one."""
    context = spark.sparkContext
    folder = spark.conf.get(SETTING, None) or context.getConf().get(SETTING, None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[0-9*, ]+\])?", context.master):
            raise ValueError(f"set {SETTING} to a folder that all executors can reach")
        folder = tempfile.mkdtemp(prefix="pairloom-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


_scratch: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    base = _scratch[-1] if _scratch else shared_folder(spark)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, on any file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession, name: str):
    """New folders go below one of their own, which is removed at the end."""
    _scratch.append(new_folder(spark, name))
    try:
        yield _scratch[-1]
    finally:
        remove(spark, _scratch.pop())


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or new_folder(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def laid_out(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """``stage`` as a table bucketed by ``columns``: joins on exactly these columns move only their other side."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    spread = df.repartition(buckets, *columns).write.bucketBy(buckets, *columns)
    spread.option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def travels_with_tasks(module: str) -> None:
    """Send what tasks use of a module along with them, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
