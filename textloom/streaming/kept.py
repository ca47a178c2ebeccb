"""Tables that streams keep up to date: the history of paths, and what links to what.

The state is a row for each key in Spark's own aggregation: how often a path was touched, or
the newest version of a file. Rows of a key are combined before they are shuffled, so a key
that a third of all rows has is one row of each task. A trigger hands on the keys that it
changed (update mode), which are written under the number of the trigger, over what a trigger
of that number may have left before it was lost; readers take committed triggers only. So a
row counts once, whatever fails when. ``fold`` merges what has come up to now into one table.

Late commits and late versions are no matter: counts don't depend on the order in which rows
come, and of a file the version of the greatest seq stays. Repeated rows of a commit are told
by state as well; where the log has the time at which a row arrived, that state can be bounded
by a watermark on it (``repeats_within``). It is on arrival, not on the commits' time, so an
old commit that comes late isn't dropped; rows must then come in about the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from textloom.operators.records import FIXES

#: The state store that keeps its rows outside the heap (fixed value).
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

HISTORY_KEY = ["repo", "path"]


def history_updates(log: DataFrame, ts: str = "ts", subject: str = "subject", arrived: str | None = None, repeats_within: str | None = None) -> DataFrame:
    """repo, path, total_commits, last (seq, ts), fixes of a stream of commits: repo, seq, path, and old_path where it renamed the path.

    A commit touches both names of a rename. Repeats of (repo, seq, path) count once, as they
    first come; a null path or seq takes no part; a null subject fixes nothing.
    """
    fix = F.coalesce(F.lower(subject).rlike("|".join(FIXES)), F.lit(False)).cast("long")
    both = F.array_distinct(F.array_compact(F.array("path", F.when(F.col("path").isNotNull(), F.col("old_path"))))) if "old_path" in log.columns else F.array_compact(F.array("path"))
    rows = log.filter("seq is not null")
    if repeats_within:
        rows = rows.withWatermark(arrived, repeats_within)
    rows = rows.select("repo", "seq", F.explode(both).alias("path"), F.col(ts).alias("ts"), fix.alias("fix"), *([F.col(arrived).alias("_arrived")] if repeats_within else []))
    unique = ["repo", "seq", "path"]
    once = rows.dropDuplicatesWithinWatermark(unique) if repeats_within else rows.dropDuplicates(unique)
    return once.groupBy("repo", "path").agg(F.count("*").alias("total_commits"), F.max(F.struct("seq", "ts")).alias("last"), F.sum("fix").alias("fixes"))


def link_updates(versions: DataFrame, importer: str, seq: str, targets: Column) -> DataFrame:
    """importer, newest (seq, targets) of a stream of files' versions; a deleted file's version has null or empty ``targets``.

    Of versions of one seq the one with the greater array stays, so repeats change nothing; a null importer or seq takes no part.
    """
    none = F.array().cast("array<string>")
    rows = versions.select(F.col(importer).alias("importer"), F.col(seq).alias("seq"), F.array_sort(F.array_distinct(F.array_compact(F.coalesce(targets, none)))).alias("targets"))
    return rows.filter("importer is not null and seq is not null").groupBy("importer").agg(F.max(F.struct("seq", "targets")).alias("newest"))


def keep(updates: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Start the stream, or go on where it was: changed keys go to ``folder``/updates. Without a ``trigger`` it takes what is there and ends."""
    spark = updates.sparkSession

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/updates/batch={batch}")

    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        return updates.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress").foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(PROVIDER[0], before) if before else spark.conf.unset(PROVIDER[0])


def _numbers(spark: SparkSession, folder: str, within: str | None = None) -> list[int]:
    """The numbers in the names of what is in a folder (that has a file ``within``)."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    path = hadoop(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
    found = [n for n in names if n.rpartition("=")[2].isdigit() and (within is None or system.exists(hadoop(f"{folder}/{n}/{within}")))]
    return sorted(int(n.rpartition("=")[2]) for n in found)


def kept(spark: SparkSession, folder: str, schema: StructType, key: list[str]) -> DataFrame:
    """The table as of the last committed trigger: the newest row of each key. ``schema``: of the updates. Empty before the first one."""
    done = max(_numbers(spark, f"{folder}/progress/commits"), default=-1)
    folded = max(_numbers(spark, f"{folder}/folded", "_SUCCESS"), default=-1)
    rows = spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
    numbered = StructType(list(schema.fields)).add("batch", "long")
    if folded >= 0:
        rows = rows.unionByName(spark.read.schema(schema).parquet(f"{folder}/folded/upto={folded}").withColumn("batch", F.lit(folded).cast("long")))
    if fresh := [f"{folder}/updates/batch={n}" for n in _numbers(spark, f"{folder}/updates") if folded < n <= done]:
        rows = rows.unionByName(spark.read.schema(numbered).option("basePath", f"{folder}/updates").parquet(*fresh))
    rest = [c for c in schema.names if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_of")).select(*key, *[F.col(f"_of.{c}").alias(c) for c in rest])


def fold(spark: SparkSession, folder: str, schema: StructType, key: list[str]) -> None:
    """Merge the committed triggers' tables into one; what was merged is deleted, so no reader may be on it."""
    done = max(_numbers(spark, f"{folder}/progress/commits"), default=-1)
    before = _numbers(spark, f"{folder}/folded", "_SUCCESS")
    if done < 0 or done in before:
        return
    kept(spark, folder, schema, key).write.mode("overwrite").parquet(f"{folder}/folded/upto={done}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    for old in [f"{folder}/folded/upto={n}" for n in before] + [f"{folder}/updates/batch={n}" for n in _numbers(spark, f"{folder}/updates") if n <= done]:
        path(old).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(old), True)


def kept_history(rows: DataFrame) -> DataFrame:
    """repo, path, total_commits, last_modified, fix_commit_ratio of a kept history."""
    return rows.select("repo", "path", "total_commits", F.col("last.ts").alias("last_modified"), (F.col("fixes") / F.col("total_commits")).alias("fix_commit_ratio"))


def reverse(rows: DataFrame) -> DataFrame:
    """target, importer: a row for each link of the newest versions; a target's importers are rows, so there may be any number."""
    return rows.select(F.explode("newest.targets").alias("target"), "importer")
