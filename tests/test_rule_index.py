"""Rules as data against every glob and path."""

import random

from pyspark.sql import functions as F

from textloom.functions import patterns
from textloom.operators import rule_index

GLOBS = ["src/a.py", "**/Dockerfile*", "**/*.ts", "**/*.{ts,TSX}", "*.min.js", "src/**", "src/*/x?.go", "**/*", "*", ".github/**", "**/test_*", "**/[ab].c", "a[", "{src,lib}/**/*.test.ts", "**/é.txt", "**/package.json", "Src/B.py", "**/*e", "", "**"]
PATHS = ["src/a.py", "SRC\\b.PY", "Dockerfile", "x/dockerfile.dev", "lib/x/y.test.ts", "a.min.js", "x/a.min.js", "src/m/x1.go", ".github/workflows/ci.yml", "b.c", "x/É.txt", "x/é.txt", "deep/er/package.json", "noext", "test_a", "x/.hidden", "src/", "", "lib/one"]


def test_every_path_and_glob(spark):
    rnd = random.Random(1)
    rules = [(rnd.randrange(3), i, g, f"rule {i}") for i, g in enumerate(GLOBS)] + [(0, 99, None, "null")]
    paths = [(i, p) for i, p in enumerate([*PATHS, *PATHS[:3], None])]
    r, p = spark.createDataFrame(rules, "layer int, ord int, glob string, rule string"), spark.createDataFrame(paths, "i int, path string")
    every = p.crossJoin(spark.createDataFrame([(i, patterns.glob_regex(g)) for i, g in enumerate(GLOBS) if g != "a["], "ord int, regex string"))
    want = {(x.path, x.ord) for x in every.filter(F.regexp(F.translate("path", "\\", "/"), F.col("regex"))).collect()}
    assert {(x.path, x.ord) for x in rule_index.matched(p, r).collect()} == want and len(want) > 40
    layer = {i: rules[i][0] for i in range(len(GLOBS))}
    got = {x.i: x.rule for x in rule_index.glob_join(p, r).collect()}
    for i, path in paths:
        own = sorted((layer[o], o) for q, o in want if q == path)
        assert got[i] == (f"rule {own[0][1]}" if own else None)
    assert rule_index.glob_join(p, r.limit(0)).filter("rule is not null").count() == 0 and rule_index.glob_join(p.limit(0), r).count() == 0


def test_keys():
    assert [patterns.glob_key(g) for g in ("src/a.py", "**/Makefile", "**/*.d.TS", "src/**", "**/Doc*", "*", "a/[b].c", "**/x*y")] == [("path", "src/a.py"), ("name", "makefile"), ("ending", "d.ts"), ("folder", "src"), ("head", "doc"), ("any", ""), ("ending", "c"), ("any", "")]


def test_keys_tell_what_ends_and_begins_a_path():
    assert [patterns.literal_key(g) for g in ("en/*123", "**/*12.HTML", "en/1*", "**/Doc*", "*", "src/a.py", "a[", "x/[ab]", "src/**/y?.go", "**/" + "*" + "z" * 30)] == [("tail", "123"), ("tail", "12.html"), ("start", "en/1"), ("head", "doc"), ("any", ""), ("path", "src/a.py"), ("tail", "a["), ("start", "x/"), ("start", "src/"), ("tail", "z" * 24)]


def test_rules_that_share_a_folder_or_an_ending_do_not_meet_all_its_paths(spark):
    n = 400
    paths = spark.range(n).select(F.concat(F.lit("en/"), F.col("id") + 1000, F.lit(".html")).alias("path"))
    rules = spark.range(n).select(F.lit(0).alias("layer"), F.col("id").alias("ord"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("en/*"), F.col("id") + 1000, F.lit(".html"))).otherwise("**/*7.html").alias("glob"), F.concat(F.lit("r"), "id").alias("rule"))
    got = rule_index.glob_join(paths, rules).collect()
    assert {r.path: r.rule for r in got} == {f"en/{i + 1000}.html": "r1" if i % 10 == 7 else f"r{i}" if i % 2 == 0 else None for i in range(n)}
    keys = rule_index.compiled(rules).select("kind", "key").collect()
    assert sum(f"en/{i + 1000}.html".endswith(k.key) for k in set(keys) for i in range(n)) == 200 + 40
