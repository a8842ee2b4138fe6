"""Tables in the shared folder that the cluster names: lineage is cut, lost executors cost nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; a temporary one only where none is set and all runs on one machine (tests)."""
    app = spark.sparkContext.applicationId
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return f"{base.rstrip('/')}/abacora-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="abacora-")
    return _own[app]


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written once and read back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame | None) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        if df is not None:
            delete(df.sparkSession, df.scratch)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has stored; for when its results have been read or written elsewhere."""
    delete(spark, folder(spark))
