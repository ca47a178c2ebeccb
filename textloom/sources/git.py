"""Snapshots and commits of a Git repository, read from its object store by tasks.

The packs' indexes are a data source (``index``: where each object lies), in parts of equal
numbers of objects. What is wanted of the objects is found by joins on their ids, dealt by
ranges of (file, offset), and read by seeking: a snapshot reads its own trees and texts and no
others, so its cost is its own size and not the history's. A delta is put on its base, which
is looked up where the pack says, however long the chain; a task keeps bases up to ``BASES``
bytes. A task's work is a list of places in files that don't change, so a lost one is done
again. The repository must lie in a folder that the driver and all executors see.

Trees are walked level by level, an equi-join each, so there are as many rounds as folders are
deep. ``changes`` compares the trees of every commit and its parent the same way and goes only
into folders that differ.

Defined results: an object in several packs is read once; a missing object is an error that
names it (except parents that a shallow clone lacks, which count as none); submodules have no
content and drop out; bytes that aren't UTF-8 become U+FFFD in texts and names, and ``binary``
tells texts with a zero byte in their first 8000. Objects with SHA-256 ids and indexes of
version 1 are errors.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from textloom.session import materialise

#: Objects of a part of an index, objects that a task reads, bytes of bases that a task keeps, bytes of a batch.
PART, PER_TASK, BASES, BATCH = 1_000_000, 4096, 64 << 20, 16 << 20
#: Numbers of kinds, and of deltas by offset and by id (fixed values of the format).
KINDS, BY_OFFSET, BY_ID = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}, 6, 7
FOLDER, SUBMODULE = "40000", "160000"


def git_dir(repo: str) -> str:
    """The folder with the repository's own files: of a bare one itself, else its .git, or what a file of that name says."""
    own = os.path.join(repo, ".git")
    if os.path.isfile(own):
        with open(own) as f:
            return os.path.normpath(os.path.join(repo, f.read().removeprefix("gitdir:").strip()))
    found = own if os.path.isdir(own) else repo
    if not os.path.isdir(os.path.join(found, "objects")):
        raise FileNotFoundError(f"not a git repository: {repo}")
    return found


def object_dirs(repo: str) -> list[str]:
    """The folders that objects are in: the repository's, and its alternates'."""
    found, asked = [], [os.path.join(git_dir(repo), "objects")]
    while asked:
        here = asked.pop()
        if here not in found:
            found.append(here)
            others = os.path.join(here, "info", "alternates")
            if os.path.exists(others):
                with open(others) as f:
                    asked += [os.path.normpath(os.path.join(here, x.strip())) for x in f if x.strip() and not x.startswith("#")]
    return found


def resolve(repo: str, ref: str) -> str:
    """The id that a branch, a tag, HEAD or another name of a ref stands for; a whole id is itself."""
    if len(ref) == 40 and not set(ref) - set("0123456789abcdef"):
        return ref
    folder, packed = git_dir(repo), {}
    if os.path.exists(os.path.join(folder, "packed-refs")):
        with open(os.path.join(folder, "packed-refs")) as f:
            packed = {x.split()[1]: x.split()[0] for x in f if x[0] not in "#^" and " " in x}
    for name in (ref, f"refs/{ref}", f"refs/tags/{ref}", f"refs/heads/{ref}", f"refs/remotes/{ref}"):
        file = os.path.join(folder, name)
        if os.path.isfile(file):
            with open(file) as f:
                to = f.read().strip()
            return resolve(repo, to.removeprefix("ref:").strip()) if to.startswith("ref:") else to
        if name in packed:
            return packed[name]
    raise ValueError(f"unknown ref: {ref}")


class Index:
    """A pack's index, version 2, read by seeking."""

    def __init__(self, file: str):
        self.file = file
        with open(file, "rb") as f:
            head = f.read(8 + 1024)
        if head[:8] != b"\xfftOc\0\0\0\x02":
            raise ValueError(f"not an index of version 2: {file}")
        self.fanout = np.frombuffer(head, ">u4", 256, 8)
        self.n = int(self.fanout[-1])
        if os.path.getsize(file) < 1032 + 28 * self.n + 40:
            raise ValueError(f"index is cut off: {file}")

    def ids(self, low: int, high: int) -> bytes:
        with open(self.file, "rb") as f:
            f.seek(1032 + 20 * low)
            return f.read(20 * (high - low))

    def offsets(self, low: int, high: int) -> np.ndarray:
        with open(self.file, "rb") as f:
            f.seek(1032 + 24 * self.n + 4 * low)
            found = np.frombuffer(f.read(4 * (high - low)), ">u4").astype(np.int64)
            for i in np.flatnonzero(found >> 31):  # places beyond 2 GB are in a table of their own
                f.seek(1032 + 28 * self.n + 8 * int(found[i] & 0x7FFFFFFF))
                found[i] = struct.unpack(">Q", f.read(8))[0]
        return found

    def find(self, sha: bytes) -> int:
        low, high = int(self.fanout[sha[0] - 1]) if sha[0] else 0, int(self.fanout[sha[0]])
        while low < high:
            mid = (low + high) // 2
            at = self.ids(mid, mid + 1)
            if at == sha:
                return int(self.offsets(mid, mid + 1)[0])
            low, high = (mid + 1, high) if at < sha else (low, mid)
        raise FileNotFoundError(f"missing object {sha.hex()} in {self.file}")


class Part(InputPartition):
    def __init__(self, file: str, low: int, high: int):
        self.file, self.low, self.high = file, low, high


class IndexReader(DataSourceReader):
    def __init__(self, repo: str, per_part: int):
        self.repo, self.per_part = repo, per_part

    def partitions(self):
        parts = []
        for folder in object_dirs(self.repo):
            packs = os.path.join(folder, "pack")
            for name in sorted(os.listdir(packs)) if os.path.isdir(packs) else []:
                if name.endswith(".idx"):
                    n = Index(os.path.join(packs, name)).n
                    parts += [Part(os.path.join(packs, name), i, min(i + self.per_part, n)) for i in range(0, n, self.per_part)]
            # loose objects: a part of each sixteenth of the first byte
            parts += [Part(folder, i, i + 16) for i in range(0, 256, 16) if any(os.path.isdir(os.path.join(folder, f"{b:02x}")) for b in range(i, i + 16))]
        return parts or [Part("", 0, 0)]

    def read(self, part: Part):
        if part.file.endswith(".idx"):
            index = Index(part.file)
            ids, offsets = index.ids(part.low, part.high), index.offsets(part.low, part.high)
            for i, offset in enumerate(offsets):
                yield ids[20 * i : 20 * i + 20].hex(), part.file[:-3] + "pack", int(offset)
            return
        for byte in range(part.low, part.high):
            folder = os.path.join(part.file, f"{byte:02x}")
            for name in os.listdir(folder) if os.path.isdir(folder) else []:
                if len(name) == 38:
                    yield f"{byte:02x}{name}", os.path.join(folder, name), -1


class IndexSource(DataSource):
    """sha, file, offset (-1: the file is the object) of every object."""

    @classmethod
    def name(cls):
        return "git_index"

    def schema(self):
        return "sha string, file string, offset long"

    def reader(self, schema):
        return IndexReader(self.options["path"], int(self.options.get("perpart", PART)))


def index(spark: SparkSession, repo: str, per_part: int = PART) -> DataFrame:
    """sha, file, offset of every object, each once."""
    spark.dataSource.register(IndexSource)
    found = spark.read.format("git_index").option("perpart", str(per_part)).load(os.path.abspath(repo))
    return found.groupBy("sha").agg(F.min(F.struct("file", "offset")).alias("_at")).select("sha", "_at.file", "_at.offset")


def _patched(base: bytes, delta: bytes) -> bytes:
    """What a delta makes of its base."""
    at = 0
    sizes = []
    for _ in range(2):
        size = shift = 0
        while True:
            byte = delta[at]
            at += 1
            size |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                break
        sizes.append(size)
    if sizes[0] != len(base):
        raise ValueError("a delta's base has another size")
    out = []
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 128:
            number = []
            for bits in (4, 3):
                value = 0
                for i in range(bits):
                    if op & 1:
                        value |= delta[at] << 8 * i
                        at += 1
                    op >>= 1
                number.append(value)
            out.append(base[number[0] : number[0] + (number[1] or 0x10000)])
        else:
            out.append(delta[at : at + op])
            at += op
    made = b"".join(out)
    if len(made) != sizes[1]:
        raise ValueError("a delta gives another size")
    return made


class Pack:
    """Objects of a pack by their offsets."""

    def __init__(self, file: str):
        self.name, self.file, self.index, self.kept, self.bytes = file, open(file, "rb"), None, OrderedDict(), 0

    def header(self, offset: int):
        """Kind's number, offset of the base (None: it is no delta), where the compressed bytes begin."""
        self.file.seek(offset)
        head = self.file.read(64)
        kind, at = head[0] >> 4 & 7, 0
        while head[at] & 128:
            at += 1
        at += 1
        if kind == BY_ID:
            self.index = self.index or Index(self.name[:-4] + "idx")
            return kind, self.index.find(head[at : at + 20]), offset + at + 20
        if kind == BY_OFFSET:
            back = head[at] & 127
            while head[at] & 128:
                at += 1
                back = (back + 1) << 7 | (head[at] & 127)
            return kind, offset - back, offset + at + 1
        return kind, None, offset + at

    def inflated(self, at: int) -> bytes:
        self.file.seek(at)
        stream, out = zlib.decompressobj(), []
        while not stream.eof:
            block = self.file.read(1 << 16)
            if not block:
                raise ValueError(f"pack is cut off: {self.name}")
            out.append(stream.decompress(block))
        return b"".join(out)

    def kind(self, offset: int) -> str:
        number, base, _ = self.header(offset)
        while base is not None:
            number, base, _ = self.header(base)
        return KINDS[number]

    def read(self, offset: int) -> tuple[str, bytes]:
        chain, found = [], None
        while found is None:
            if offset in self.kept:
                self.kept.move_to_end(offset)
                found = self.kept[offset]
                break
            number, base, at = self.header(offset)
            if base is None:
                found = KINDS[number], self.inflated(at)
                self.keep(offset, found)
            else:
                chain.append((offset, at))
                offset = base
        for offset, at in reversed(chain):
            found = found[0], _patched(found[1], self.inflated(at))
            self.keep(offset, found)
        return found

    def keep(self, offset: int, found: tuple[str, bytes]) -> None:
        self.kept[offset] = found
        self.bytes += len(found[1])
        while self.bytes > BASES and len(self.kept) > 1:
            self.bytes -= len(self.kept.popitem(last=False)[1][1])


def _loose(file: str, whole: bool) -> tuple[str, bytes | None]:
    with open(file, "rb") as f:
        raw = f.read() if whole else f.read(128)
    head, _, content = (zlib.decompress(raw) if whole else zlib.decompressobj().decompress(raw, 64)).partition(b"\0")
    return head.split()[0].decode(), content if whole else None


def _read(batches, whole: bool):
    pack = None
    rows, size = [], 0
    for batch in batches:
        for sha, file, offset in zip(batch["sha"], batch["file"], batch["offset"]):
            if file is None:
                raise FileNotFoundError(f"missing object {sha}")
            if offset < 0:
                kind, content = _loose(file, whole)
            else:
                pack = pack if pack and pack.name == file else Pack(file)
                kind, content = pack.read(int(offset)) if whole else (pack.kind(int(offset)), None)
            rows.append((sha, kind, content))
            size += 100 + len(content or b"")
            if size > BATCH:
                yield pd.DataFrame(rows, columns=["sha", "kind", "content"])
                rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=["sha", "kind", "content"])


def _dealt(located: DataFrame) -> DataFrame:
    located = materialise(located, "located")
    tasks = max(1, -(-located.count() // PER_TASK))
    return located.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")


def objects(wanted: DataFrame, at: DataFrame) -> DataFrame:
    """sha, kind, content of each of ``wanted`` (sha) where ``at`` (an ``index``) says."""
    located = wanted.select("sha").distinct().join(at, "sha", "left")
    return _dealt(located).mapInPandas(lambda batches: _read(batches, True), "sha string, kind string, content binary")


def kinds(at: DataFrame) -> DataFrame:
    """sha, kind of every object, from their headers only."""
    return _dealt(at).mapInPandas(lambda batches: _read(batches, False), "sha string, kind string, content binary").drop("content")


def _entries(batches):
    for batch in batches:
        rows = []
        for sha, content in zip(batch["sha"], batch["content"]):
            at = 0
            while at < len(content):
                end = content.index(b"\0", at)
                mode, _, name = bytes(content[at:end]).partition(b" ")
                rows.append((sha, mode.decode(), name.decode("utf-8", "replace"), bytes(content[end + 1 : end + 21]).hex()))
                at = end + 21
        yield pd.DataFrame(rows, columns=["tree", "mode", "name", "sha"])


def entries(trees: DataFrame, at: DataFrame) -> DataFrame:
    """tree, mode, name, sha of what is in each of ``trees`` (sha)."""
    return materialise(objects(trees, at).select("sha", "content").mapInPandas(_entries, "tree string, mode string, name string, sha string"), "entries")


def commit_columns(found: DataFrame) -> DataFrame:
    """sha, tree, parents, committed (seconds), author, subject of commits (sha, content)."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    rows = found.select("sha", F.substring_index(text, "\n\n", 1).alias("head"), text.alias("text"))
    message = F.regexp_replace(F.expr("substring(text, length(head) + 3)"), r"^\s+", "")
    subject = F.regexp_replace(F.rtrim(F.substring_index(message, "\n\n", 1)), r"\s*\n\s*", " ")
    one = lambda pattern: F.regexp_extract("head", pattern, 1)
    return rows.select(
        "sha", one("^tree ([0-9a-f]{40})").alias("tree"), F.regexp_extract_all("head", F.lit("(?m)^parent ([0-9a-f]{40})$"), F.lit(1)).alias("parents"),
        one("(?m)^committer .*> (-?[0-9]+) [+-][0-9]+$").cast("long").alias("committed"), one("(?m)^author (.*?) ?<").alias("author"), F.regexp_replace(subject, r"\s+$", "").alias("subject"),
    )


def commits(at: DataFrame) -> DataFrame:
    """Every commit of the repository, whatever ref reaches it."""
    return commit_columns(objects(kinds(at).filter("kind = 'commit'"), at))


def _wanted(path, paths: list[str] | None):
    """Whether a path is one of ``paths``, in one of them, or a folder on the way to one."""
    if paths is None:
        return F.lit(True)
    clean = [p.strip("/") for p in paths]
    tests = [(path == p) | path.startswith(p + "/") | F.lit(p + "/").startswith(F.concat(path, F.lit("/"))) for p in clean if p]
    return F.lit(True) if "" in clean else F.lit(False) if not tests else F.exists(F.array(*tests), lambda x: x)


def tree_of_refs(spark: SparkSession, repo: str, refs: list[str], at: DataFrame) -> DataFrame:
    """ref, tree of each ref; a tag that is an object of its own is followed."""
    asked, found = [(r, resolve(repo, r)) for r in refs], []
    while asked:
        names = spark.createDataFrame(asked, "ref string, sha string")
        met = names.join(objects(names, at), "sha").select("ref", "sha", "kind", F.regexp_extract(F.make_valid_utf8(F.col("content").cast("string")), "^(?:tree|object) ([0-9a-f]{40})", 1).alias("to")).collect()
        found += [(r.ref, r.sha if r.kind == "tree" else r.to) for r in met if r.kind in ("commit", "tree")]
        asked = [(r.ref, r.to) for r in met if r.kind == "tag"]
    return spark.createDataFrame(found, "ref string, tree string")


def files(spark: SparkSession, repo: str, refs: list[str], paths: list[str] | None = None, at: DataFrame | None = None) -> DataFrame:
    """ref, path, mode, sha of the files of each ref's snapshot; with ``paths``, of these files and folders only, and other folders aren't read."""
    at = at if at is not None else materialise(index(spark, repo), "index")
    level = tree_of_refs(spark, repo, list(dict.fromkeys(refs)), at).select("ref", F.lit("").alias("path"), "tree")
    out = spark.createDataFrame([], "ref string, path string, mode string, sha string")
    while True:
        inside = entries(level.select(F.col("tree").alias("sha")), at)
        path = F.concat(F.when(F.col("path") != "", F.concat("path", F.lit("/"))).otherwise(""), F.col("name"))
        step = materialise(level.join(inside, "tree").select("ref", path.alias("path"), "mode", "sha").filter(_wanted(F.col("path"), paths)), "level")
        # a folder on the way to a wanted path is no result, and neither is a file of that name
        own = step.filter(~F.col("mode").isin(FOLDER, SUBMODULE))
        if paths is not None:
            own = own.filter(F.exists(F.array(*[(F.col("path") == p.strip("/")) | F.col("path").startswith(p.strip("/") + "/") | F.lit(not p.strip("/")) for p in paths]), lambda x: x) if paths else F.lit(False))
        out = out.unionByName(own)
        level = step.filter(F.col("mode") == FOLDER).select("ref", "path", F.col("sha").alias("tree"))
        if not level.head(1):
            return out


def snapshot(spark: SparkSession, repo: str, refs: list[str], paths: list[str] | None = None) -> DataFrame:
    """ref, path, content, binary: the files of each ref; equal contents are read once."""
    at = materialise(index(spark, repo), "index")
    of = files(spark, repo, refs, paths, at)
    text = objects(of, at).select("sha", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), (F.locate("\0", F.decode(F.substring("content", 1, 8000), "ISO-8859-1")) > 0).alias("binary"))
    return of.join(text, "sha").select("ref", "path", "content", "binary")


def changes(spark: SparkSession, repo: str) -> DataFrame:
    """commit, path, status (added, deleted, modified), before, after (ids): what each commit with at most one parent changes; merges change nothing of their own."""
    at = materialise(index(spark, repo), "index")
    known = materialise(commits(at), "commits")
    tree = known.select(F.col("sha").alias("parent"), F.col("tree").alias("before"))
    one = known.filter(F.size("parents") <= 1).select(F.col("sha").alias("commit"), F.get("parents", F.lit(0)).alias("parent"), F.col("tree").alias("after"))
    level = one.join(tree, "parent", "left").select("commit", F.lit("").alias("path"), "before", "after").filter("not (before <=> after)")
    out = spark.createDataFrame([], "commit string, path string, before string, after string")
    while True:
        level = materialise(level, "level")
        if not level.head(1):
            break
        inside = entries(level.select(F.explode(F.array("before", "after")).alias("sha")).filter("sha is not null"), at)
        side = lambda c: level.join(inside.withColumnRenamed("tree", c), c).select("commit", "path", "name", F.col("mode").alias(f"{c}_mode"), F.col("sha").alias(c))  # noqa: E731,B023
        path = F.concat(F.when(F.col("path") != "", F.concat("path", F.lit("/"))).otherwise(""), F.col("name"))
        met = side("before").join(side("after"), ["commit", "path", "name"], "full").filter("not (before <=> after and before_mode <=> after_mode)").withColumn("path", path)
        met = materialise(met, "changed")
        file = lambda c: F.when(~F.col(f"{c}_mode").isin(FOLDER, SUBMODULE), F.col(c))
        folder = lambda c: F.when(F.col(f"{c}_mode") == FOLDER, F.col(c))
        out = out.unionByName(met.select("commit", "path", file("before").alias("before"), file("after").alias("after")).filter("before is not null or after is not null"))
        level = met.select("commit", "path", folder("before").alias("before"), folder("after").alias("after")).filter("not (before <=> after)")
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").otherwise("modified")
    return out.select("commit", "path", status.alias("status"), "before", "after")


def log(spark: SparkSession, repo: str) -> DataFrame:
    """repo, seq, path, old_path (null), ts, subject, status: the changes as ``history`` takes them; seq orders commits by their time, then id. ``history.with_renames`` finds renames."""
    found = changes(spark, repo)
    at = materialise(index(spark, repo), "index")
    seq = F.concat(F.lpad(F.greatest("committed", F.lit(0)).cast("string"), 12, "0"), F.lit(" "), "sha")
    of = commits(at).select(F.col("sha").alias("commit"), seq.alias("seq"), F.timestamp_seconds("committed").alias("ts"), "subject")
    return found.join(of, "commit").select(F.lit(repo).alias("repo"), "seq", "path", F.lit(None).cast("string").alias("old_path"), "ts", "subject", "status")
