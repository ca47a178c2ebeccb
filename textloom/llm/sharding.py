"""Sharding by size-tiered compaction under a versioned manifest.

Arrivals are appended as runs of small immutable shards. A shard's tier is the power of
``FAN_IN`` that its size is of the smallest; as soon as a tier has ``FAN_IN`` shards they
are merged, without a shuffle, into as few files of the target size as hold them, and so
a row is rewritten once per tier at most. Every change is one new manifest: it is written
under a name of its own and then given the next version's, in one step that fails if another
writer was first (a hard link in a POSIX folder, elsewhere a rename that never replaces, which
the file system has to carry out as one step, as HDFS does; object stores don't). So readers
see either version whole. Old shards stay until ``vacuum``, which spares what the newest
versions name and whatever is younger than a lease: readers of these versions and writers that
have not committed yet.

Defined results: columns and rows are stored as they are (nulls, repeated rows, empty and
very long texts, columns of any names); a row larger than the target is in a shard of its own size;
shards of equal size are merged in order of their paths; an empty
arrival commits a version without new shards; an empty store reads as no rows of the
schema that was given first; a lost executor costs the files of its running tasks, which
no manifest names.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.session import shared_dir, table

#: Size of a full shard, size below which a shard is of tier 0, shards of a tier that are merged.
TARGET_BYTES, SMALL_BYTES, FAN_IN = 32 << 20, 2 << 20, 4
#: Arrivals that the registered query deals the table into.
ARRIVALS = 4
#: Versions that ``vacuum`` spares, and the age in seconds below which it spares anything.
VERSIONS, LEASE = 2, 3600.0


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    """Shards and manifests under one folder that the driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, small_bytes: int = SMALL_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.small, self.fan_in = spark, root.rstrip("/"), target_bytes, small_bytes, fan_in
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path(f"{self.root}/manifests"))

    def versions(self) -> list[int]:
        """The committed versions that are kept."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(f"{self.root}/manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self.fs.open(self.path(f"{self.root}/manifests/v{version:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: dict, shards: list[dict], schema: str) -> dict:
        """The version after ``base``, or Conflict."""
        made = {"version": base["version"] + 1, "schema": schema, "shards": sorted(shards, key=lambda s: s["path"])}
        temporary, final = self.path(f"{self.root}/manifests/.{uuid.uuid4().hex}"), self.path(f"{self.root}/manifests/v{made['version']:010d}.json")
        stream = self.fs.create(temporary, False)
        stream.write(bytearray(json.dumps(made).encode()))
        stream.close()
        try:
            self.publish(temporary, final)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {made['version']} is taken") from None
            raise
        finally:
            self.fs.delete(temporary, False)
        return made

    def publish(self, temporary, final) -> None:
        """Give a written file its final name, unless that is taken."""
        jvm = self.spark._jvm
        if final.toUri().getScheme() in (None, "file"):
            jvm.java.nio.file.Files.createLink(*(jvm.java.io.File(p.toUri().getPath()).toPath() for p in (final, temporary)))
            return
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(temporary, final, how)

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(1, size) / self.small, self.fan_in)) + 1) if size >= self.small else 0

    def write(self, df: DataFrame) -> list[dict]:
        """New shards, which no manifest names yet."""
        run = uuid.uuid4().hex
        df.write.option("maxRecordsPerFile", 0).parquet(f"{self.root}/data/{run}")
        files = self.fs.listStatus(self.path(f"{self.root}/data/{run}"))
        return [{"path": f"data/{run}/{s.getPath().getName()}", "bytes": s.getLen(), "tier": self.tier(s.getLen())} for s in files if s.getPath().getName().endswith(".parquet")]

    def append(self, df: DataFrame) -> dict:
        """Commit the rows as a run of small shards."""
        base = self.manifest()
        return self.commit(base, base["shards"] + self.write(df), base["schema"] or df.schema.json())

    def frame(self, shards: list[dict], schema: str) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(f"{self.root}/{s['path']}" for s in shards))

    def compact(self) -> dict:
        """Merge full tiers until none is left; each merge is a version."""
        now = self.manifest()
        while True:
            tiers: dict[int, list[dict]] = {}
            for s in now["shards"]:
                if s["bytes"] < self.target:
                    tiers.setdefault(s["tier"], []).append(s)
            files = {k: max(1, round(sum(s["bytes"] for s in found) / self.target)) for k, found in tiers.items()}
            full = [k for k in sorted(tiers) if len(tiers[k]) >= self.fan_in and files[k] < len(tiers[k])]
            if not full:  # also where a tier's shards are too near the target to become fewer
                return now
            merged, many = tiers[full[0]], files[full[0]]
            rows = self.frame(merged, now["schema"])
            made = self.write(rows.coalesce(many) if rows.rdd.getNumPartitions() >= many else rows.repartition(many))
            for s in made:  # a merge lifts its rows a tier at least, so that the loop ends
                s["tier"] = max(s["tier"], full[0] + 1)
            names = {s["path"] for s in merged}
            now = self.commit(now, [s for s in now["shards"] if s["path"] not in names] + made, now["schema"])

    def read(self, version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        if not found["schema"]:
            raise ValueError("nothing was ever committed")
        return self.frame(found["shards"], found["schema"])

    def vacuum(self, versions: int = VERSIONS, lease: float = LEASE) -> int:
        """Delete what is older than ``lease`` seconds and none of the newest ``versions`` needs, first manifests, then runs; returns how many."""
        last = self.version()
        kept = [v for v in range(max(1, last - versions + 1), last + 1)]
        data, names, gone, before = self.path(f"{self.root}/data"), {f"v{v:010d}.json" for v in kept}, 0, (time.time() - lease) * 1000
        for s in self.fs.listStatus(self.path(f"{self.root}/manifests")):
            if s.getPath().getName() not in names and s.getModificationTime() <= before:
                gone += self.fs.delete(s.getPath(), False)
        used = {s["path"].split("/")[1] for v in self.versions() for s in self.manifest(v)["shards"]}
        for s in self.fs.listStatus(data) if self.fs.exists(data) else []:
            if s.getPath().getName() not in used and s.getModificationTime() <= before:
                gone += self.fs.delete(s.getPath(), True)
        return gone


def ingest(spark: SparkSession, rows: DataFrame, key: str, arrivals: int = ARRIVALS, **options) -> ShardStore:
    """A store in the shared folder that the rows came to in ``arrivals`` parts, by a hash of ``key``, compacted after each. It is new and no one else's, so nothing in it needs a lease."""
    store = ShardStore(spark, f"{shared_dir(spark)}/textloom/shards-{uuid.uuid4().hex}", **options)
    for k in range(arrivals):
        store.append(rows.filter(F.pmod(F.xxhash64(key), F.lit(arrivals)) == k))
        store.compact()
        store.vacuum(lease=0.0)
    return store


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ingest(spark, table(spark, sf_dir, "documents"), "doc_id")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return store.read().select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"), name.alias("shard"), F.col("_metadata.file_size").alias("shard_bytes"), F.lit(store.version()).cast("long").alias("version"))
