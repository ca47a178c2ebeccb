"""Sources and sinks: folders of raw files, rule files, JSON results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that a walk leaves out, and extensions that it takes (fixed values).
SKIPPED = ("node_modules", ".git", "dist", "build", ".next", ".cache")
SOURCES = ("ts", "tsx", "js", "jsx", "mjs", "cjs")


def read_folder(spark: SparkSession, folder: str, extensions=SOURCES) -> DataFrame:
    """path (relative), content of the text files under a folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").format("binaryFile").load(folder)
    skipped = "(^|/)(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")(/|$)"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).resolvePath(hadoop).toString().rstrip("/")
    bare = lambda c: F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")  # noqa: E731  # file:/x and file:///x are one folder
    relative = F.expr(f"substring(_bare, {len('/' + root.split(':', 1)[-1].lstrip('/')) + 2})")
    files = files.withColumn("_bare", bare(F.col("path")))
    return files.select(relative.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content")).filter(~F.col("path").rlike(skipped))


def read_rules(spark: SparkSession, file: str) -> DataFrame:
    """ord, pattern, rule of a JSON rule file; ``path`` is another name of pattern, entries without either are dropped."""
    rows = spark.read.option("multiLine", "true").schema("rules array<struct<path string, pattern string, rule string>>").json(file).select(F.posexplode("rules").alias("ord", "r"))
    return rows.select("ord", F.coalesce("r.pattern", "r.path").alias("pattern"), "r.rule").filter("pattern is not null and rule is not null")


def read_filters(spark: SparkSession, file: str) -> dict | None:
    """exclude and include of a JSON rule file (those that it has); None if it is missing, isn't JSON or has no filters."""
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    row = spark.read.option("multiLine", "true").schema("filters struct<exclude array<string>, include array<string>>").json(file).first()
    return {k: v for k, v in row["filters"].asDict().items() if v is not None} if row and row["filters"] else None


def read_patches(spark: SparkSession, folder: str) -> DataFrame:
    """file, diff: the whole text of each patch file."""
    return spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("diff"))


def read_log(spark: SparkSession, file: str, path: str) -> DataFrame:
    """path, hash, ts, subject of a commit log with a line for each commit: hash, ISO date and subject between tabs; other lines drop out."""
    part = F.split("value", "\t", 3)
    rows = spark.read.text(file).filter(F.size(part) == 3).select(F.lit(path).alias("path"), F.get(part, F.lit(0)).alias("hash"), F.try_to_timestamp(F.get(part, F.lit(1))).alias("ts"), F.get(part, F.lit(2)).alias("subject"))
    return rows.filter("hash <> ''")


def write_json(df: DataFrame, folder: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(folder)
