"""Tables written to the folder that all executors share, to cut lineage and to be read more than once.

A table that is written there survives the loss of any executor; nothing is cached on executors' own disks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset a local master gets a temporary folder of its own;
    any other master is refused, since executors would not see such a folder."""
    found = spark.conf.get(SHARED, None) or spark.sparkContext.getConf().get(SHARED)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{SHARED} must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set(SHARED, own)
    return own


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table that was written."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that are not needed any more: what was made of them has been written itself."""
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path:
            drop_path(df.sparkSession, path)


def delete_stale(spark: SparkSession, folder: str, keep: list[str], suffix: str = "") -> list[str]:
    """Delete what an earlier run left directly in a folder: names that end in ``suffix`` and are not to be kept. Returns the names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in store.listStatus(target) if store.exists(target) else []:
        name = status.getPath().getName()
        if name.endswith(suffix) and name not in keep:
            store.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`materialize` through Hadoop's file system, whatever the store."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
