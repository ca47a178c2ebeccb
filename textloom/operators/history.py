"""History of files across renames: each name counts for the time in which it was the file's.

A log has a row for each path that a commit touches: repo, seq (the commits' order), path, and
old_path where the commit renamed it. A file that is called P now was P since the latest
rename to P; before that commit it had the old name, since the latest earlier rename to that;
and so on. Names may be reused, swapped in one commit, or given away several times: going back
is strictly in time, so nothing goes in a circle.

Which rename came before another is found once for all renames, by the last one before in
order of seq (an as-of join as a window). The asked paths then walk back generation by
generation, an equi-join each, until nobody goes further; a walk is as long as the file has
names. What a path had as names are intervals [low, high) of commits, and a row of the log is
the path's if it is of the name within the interval.

Defined results: repeated rows of a path in a commit count once; of two renames to one name in
one commit the smaller old path counts; a rename to itself is no rename; a null path or seq
takes no part; a path that nothing touched has no commits, and a reason; so has one in a
repository that isn't known. A commit that renames a path away touches it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import slashes
from textloom.operators import linediff
from textloom.operators.records import FIXES
from textloom.session import discard, materialise

#: Reasons (fixed values).
NO_REPOSITORY, NO_HISTORY = "not a git repository", "no commit history for this path"


def renames_of(log: DataFrame) -> DataFrame:
    """repo, seq, old, new of the renames that the log states, and prior: the seq of the latest earlier rename to the old name."""
    told = log.filter("seq is not null and path is not null and old_path is not null and old_path <> path").groupBy("repo", "seq", F.col("path").alias("new")).agg(F.min("old_path").alias("old"))
    # at its seq a rename asks for its old name, and only those before it answer
    asks = told.select("repo", F.col("old").alias("name"), "seq", F.lit(0).alias("side"), F.col("new").alias("other"))
    answers = told.select("repo", F.col("new").alias("name"), "seq", F.lit(1).alias("side"), F.col("old").alias("other"))
    before = Window.partitionBy("repo", "name").orderBy("seq", "side").rowsBetween(Window.unboundedPreceding, -1)
    met = asks.unionByName(answers).withColumn("prior", F.last(F.when(F.col("side") == 1, F.col("seq")), ignorenulls=True).over(before))
    return met.filter("side = 0").select("repo", "seq", F.col("name").alias("old"), F.col("other").alias("new"), "prior")


def names(paths: DataFrame, log: DataFrame) -> DataFrame:
    """repo, path, name, low, high: what each of ``paths`` (repo, path) was called, from commit low (null: ever) to before commit high (null: now)."""
    told = materialise(renames_of(log), "renames")
    last = told.groupBy("repo", F.col("new").alias("name")).agg(F.max("seq").alias("low"))
    none = F.lit(None).cast(log.schema["seq"].dataType)
    now = materialise(paths.select("repo", "path").distinct().withColumns({"name": F.col("path"), "high": none}).join(last, ["repo", "name"], "left").select("repo", "path", "name", "low", "high"), "names")
    found = [now]
    while True:
        step = found[-1].filter("low is not null").select("repo", "path", F.col("name").alias("new"), F.col("low").alias("seq"))
        found.append(materialise(step.join(told, ["repo", "new", "seq"]).select("repo", "path", F.col("old").alias("name"), F.col("prior").alias("low"), F.col("seq").alias("high")), "names"))
        if not found[-1].head(1):
            break
    out = found[0]
    for generation in found[1:-1]:
        out = out.unionByName(generation)
    discard(told)
    discard(found[-1])
    return out


def touched(log: DataFrame) -> DataFrame:
    """The log with a row for each name that a commit touches, old names of renames as well; each once in a commit."""
    rest = [c for c in log.columns if c not in ("repo", "seq", "path", "old_path")]
    there = log.filter("seq is not null and path is not null")
    away = there.filter("old_path is not null").select("repo", "seq", F.col("old_path").alias("path"), *rest)
    first = F.min(F.struct(*rest)).alias("of") if rest else F.lit(1).alias("of")
    one = there.select("repo", "seq", "path", *rest).unionByName(away).groupBy("repo", "seq", "path").agg(first)
    return one.select("repo", "seq", "path", *[F.col(f"of.{c}").alias(c) for c in rest])


def commits_of(paths: DataFrame, log: DataFrame) -> DataFrame:
    """repo, path, name, and the log's rows of each path under all its names."""
    spans = names(paths, log)
    rows = touched(log).withColumnRenamed("path", "name")
    within = (F.col("low").isNull() | (F.col("seq") >= F.col("low"))) & (F.col("high").isNull() | (F.col("seq") < F.col("high")))
    return spans.join(rows, ["repo", "name"]).filter(within).drop("low", "high")


def history(paths: DataFrame, log: DataFrame, repos: DataFrame | None = None, ts: str = "ts", subject: str = "subject") -> DataFrame:
    """repo, path, total_commits, last_modified, fix_commit_ratio, reason of each of ``paths`` (repo, path), over all names that a file had.

    ``repos`` (repo): those that are known; None: those that the log has. Subjects with a word of ``FIXES`` fix.
    """
    asked = paths.select("repo", slashes(F.col("path")).alias("path")).distinct()
    fix = F.coalesce(F.lower(subject).rlike("|".join(FIXES)), F.lit(False)).cast("double")
    counts = commits_of(asked, log).groupBy("repo", "path").agg(F.count("*").alias("_n"), F.max_by(ts, "seq").alias("last_modified"), F.avg(fix).alias("_ratio"))
    known = (repos if repos is not None else log).select("repo").distinct().withColumn("_known", F.lit(True))
    out = asked.join(counts, ["repo", "path"], "left").join(known, "repo", "left")
    reason = F.when(F.col("_known").isNull(), NO_REPOSITORY).when(F.col("_n").isNull(), NO_HISTORY)
    return out.select("repo", "path", F.coalesce("_n", F.lit(0)).alias("total_commits"), "last_modified", F.coalesce("_ratio", F.lit(0.0)).alias("fix_commit_ratio"), reason.alias("reason"))


def with_renames(log: DataFrame, contents: DataFrame, least: float = linediff.SIMILAR) -> DataFrame:
    """``log`` with old_path filled in where a commit that states none has a deleted path of similar content.

    ``log`` has status (added, deleted, or another), ``contents``: repo, seq, path, content of what a commit added or deleted. A deleted path that was renamed keeps its row.
    """
    stated = log.filter("old_path is not null").select("repo", "seq", F.col("old_path").alias("path")).distinct()
    keyed = lambda status: contents.join(log.filter((F.col("status") == status) & F.col("old_path").isNull()).select("repo", "seq", "path").distinct(), ["repo", "seq", "path"]).select(F.struct("repo", "seq").alias("within"), "path", "content")
    gone = keyed("deleted").join(stated.select(F.struct("repo", "seq").alias("within"), "path"), ["within", "path"], "left_anti")
    found = linediff.renames(gone, keyed("added"), least, within="within").select("within.repo", "within.seq", F.col("old").alias("_old"), F.col("new").alias("path"))
    return log.join(found, ["repo", "seq", "path"], "left").withColumn("old_path", F.coalesce("old_path", F.when(F.col("status") == "added", F.col("_old")))).select(*log.columns)
