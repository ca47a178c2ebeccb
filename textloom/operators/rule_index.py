"""Rules as data: paths meet the globs of a table by key.

Every glob tells something that the paths it matches have in common: the whole path, the name,
all that the path ends or begins with before a wildcard, the name's beginning
(``patterns.literal_key``). Paths are filed under all of theirs, of the kinds and lengths that
the rules have, met with the rules by equality, and only then checked against the
glob's expression; rows come in order of expression, so each is compiled once for a run of
paths. Globs that tell nothing meet every path, dealt over ``SALTS`` tasks. Where only the
first rule is asked for, equal globs are one.

Defined results: a null path or glob meets nothing; backslashes in paths are slashes; a glob
that is no valid expression matches nothing; of rules with equal layer and order the smaller
text counts; repeated paths are rows of their own; without rules no path has one.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.patterns import HEAD, LITERAL, LOWER, UPPER, expand_braces, glob_regex, literal_key
from textloom.functions.text import slashes
from textloom.session import materialise, spread

#: Tasks that the paths which meet keyless globs are dealt over.
SALTS = 32


def _compiled(batches):
    for batch in batches:
        rows = []
        for i, glob in enumerate(batch.column("glob").to_pylist()):
            for one in dict.fromkeys(expand_braces(glob)) if glob is not None else ():
                try:
                    re.compile(regex := glob_regex(one))
                except re.error:
                    continue
                rows.append((i, regex, *literal_key(one)))
        at, regex, kind, key = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
        at = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("layer", "ord", "rule")], pa.array(regex, pa.string()), pa.array(kind, pa.string()), pa.array(key, pa.string())], names=["layer", "ord", "rule", "regex", "kind", "key"])


def compiled(rules: DataFrame) -> DataFrame:
    """layer, ord, rule, regex, kind, key: a row for each alternative of each glob. ``rules``: layer, ord, glob, rule."""
    own = rules.select(F.col("layer").cast("int").alias("layer"), F.col("ord").cast("long").alias("ord"), F.col("rule").cast("string").alias("rule"), "glob")
    return own.mapInArrow(_compiled, "layer int, ord long, rule string, regex string, kind string, key string")


def path_keys(path: Column, used: set[tuple[str, int]]) -> Column:
    """array<struct<kind, key>> of a path with slashes. ``used``: kinds of keys, and the lengths of those that are a path's beginning or end."""
    low = F.translate(path, UPPER, LOWER)
    name = F.element_at(F.split(low, "/"), -1)
    item = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    whole = {"path": low, "name": name, "head": F.substring(name, 1, HEAD), "any": F.pmod(F.xxhash64(path), F.lit(SALTS)).cast("string")}
    cut = {"tail": lambda n: F.right(low, F.lit(n)), "start": lambda n: F.left(low, F.lit(n))}
    found = [item(kind, whole[kind]) if kind in whole else F.when(F.length(low) >= n, item(kind, cut[kind](n))) for kind, n in sorted(used)]
    return F.array_compact(F.array(*found))


def matched(paths: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """path, layer, ord, rule: all rules that hold for each distinct path."""
    known = materialise(compiled(rules), "rules")
    # at most 2 * LITERAL + 4 rows, whatever the rules
    length = F.when(F.col("kind").isin("tail", "start"), F.least(F.length("key"), F.lit(LITERAL))).otherwise(0)
    used = {(r["kind"], r["n"]) for r in known.select("kind", length.alias("n")).distinct().collect()}
    distinct = paths.filter(F.col(path).isNotNull()).select(F.col(path).alias("_path")).distinct()
    if not used:
        return distinct.join(known, F.lit(False)).select(F.col("_path").alias(path), "layer", "ord", "rule")
    salted = F.when(F.col("kind") == "any", F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: i.cast("string"))).otherwise(F.array("key"))
    known = known.withColumn("key", F.explode(salted))
    keyed = distinct.select("_path", F.explode(path_keys(slashes(F.col("_path")), used)).alias("k")).select("_path", "k.kind", "k.key")
    met = keyed.join(known, ["kind", "key"]).sortWithinPartitions("regex").filter(F.regexp(slashes(F.col("_path")), F.col("regex")))
    return met.select(F.col("_path").alias(path), "layer", "ord", "rule").distinct()


def glob_join(paths: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """``paths`` with rule: that of the first glob, by layer and order, that matches; null if none does."""
    first_of = F.min(F.struct(F.col("layer").cast("int").alias("layer"), F.col("ord").cast("long").alias("ord"), F.col("rule").cast("string").alias("rule")))
    rules = spread(rules.select("layer", "ord", "glob", "rule"), "glob").groupBy("glob").agg(first_of.alias("_r")).select("_r.*", "glob")
    first = matched(paths, rules, path).groupBy(F.col(path).alias("_path")).agg(F.min(F.struct("layer", "ord", "rule"))["rule"].alias("_rule"))
    return paths.join(first, F.col(path) == F.col("_path"), "left").select(*[paths[c] for c in paths.columns], F.col("_rule").alias("rule"))
