"""An extension: the batch functions over a stream of new files. The batch engine never uses it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphmill.functions.tokens import newlines
from glyphmill.sources.files import decoded


def new_texts(spark: SparkSession, folder: str, charset: str = "utf-8", a_batch: int = 1000) -> DataFrame:
    """(path, at, text) of files as they arrive in a folder; at is when a file was last written."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    arrived = files.option("maxFilesPerTrigger", a_batch).load(folder)
    return arrived.select("path", F.col("modificationTime").alias("at"), newlines(decoded(F.col("content"), charset)).alias("text"))


def word_counts_by_time(texts: DataFrame, tokens: Column, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window, token, cnt): word counts of each stretch of time; state is dropped once no file can be that late."""
    rows = texts.withWatermark("at", late).select("at", F.explode(tokens).alias("token"))
    return rows.groupBy(F.window("at", width), "token").agg(F.count(F.lit(1)).alias("cnt"))


def append(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream as Parquet, each row once; stops after all files that are there now."""
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
