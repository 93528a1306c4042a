"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Frees the shuffle files of a finished write; they would otherwise wait for the driver's garbage collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, one below the warehouse, or a temporary one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = getattr(spark, "_lodestone_scratch", None)
    if own is None:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            own = tempfile.mkdtemp(prefix="lodestone-")
            atexit.register(shutil.rmtree, own, True)
            own = f"file://{own}"
        else:
            own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lodestone_scratch"
        spark._lodestone_scratch = own
    return own


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table made by :func:`materialise` that nothing reads any more."""
    path = getattr(df, "_lodestone_path", None)
    if path is None:
        return
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
