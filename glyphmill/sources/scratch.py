"""Folders for files that a query writes and reads back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """The name of a new folder, deleted when the session ends.

    It is below spark.checkpoint.dir, which all executors share. Where that is
    unset, as in tests, it is a temporary one, but only if driver and
    executors are one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="glyphmill-files-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = f"file://{_own[0]}"
    path = f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """df as a table in a new folder, computed once however often it is read; read as another schema if one is given."""
    to = folder(df.sparkSession)
    df.write.parquet(to)
    return df.sparkSession.read.schema(schema or df.schema).parquet(to)
