"""Line scans over streams: the same expressions, stateless, on ``readStream`` frames; each file of a folder is scanned once, when it comes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from textloom.operators.lines import search
from textloom.operators.records import scan_secrets
from textloom.session import work_dir


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table's Parquet files (a folder's, or one file) as they come, under the schema that is there now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():  # streams read folders
        return reader.option("pathGlobFilter", hadoop.getName()).parquet(hadoop.getParent().toString())
    return reader.parquet(path)


def stream_search(files: DataFrame, key: str, text: str, query: str) -> DataFrame:
    return search(files, key, text, query)


def stream_secrets(spark: SparkSession, folder: str, schema: str, key: str, content: str) -> DataFrame:
    """Secrets in new files of lines in a folder."""
    return scan_secrets(spark.readStream.schema(schema).parquet(folder), key, content)


def drained(stream: DataFrame, label: str) -> DataFrame:
    """What a stream gives for all that is there now, as a table in the shared folder; its progress is kept next to it, so a restart goes on where it was."""
    spark = stream.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
