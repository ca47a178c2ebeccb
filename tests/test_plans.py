"""What plans carry and how their tables meet: rows made from texts are more than a plan's estimate."""

from pyspark.sql import functions as F

from textloom.operators import bundles, locate, records


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_importers_meet_by_shuffle_and_as_by_every_path_that_is_meant(spark):
    stated = [("src/a.ts", "./b"), ("src/a.ts", "./b.ts"), ("src/c.js", "../src/b"), ("src/c.js", "./d"), ("src/d/index.ts", ".."), ("x.ts", "./src/d"), ("x.ts", "react"), ("y.ts", "./"), ("y.ts", "./none.css"), ("src/z.ts", "./b.js")]
    paths = ["src/a.ts", "src/b.ts", "src/b.js", "src/b.js.tsx", "src/b", "src/d/index.ts", "src/d.mjs", "src/index.js", "none.css", "index.ts", ".ts", "react", None, "src/b.ts"]
    edges, targets = spark.createDataFrame(stated, "importer string, specifier string"), spark.createDataFrame([(p,) for p in paths], "path string")
    got = records.importers(targets, edges, "path")
    met = targets.select(F.col("path").alias("target")).join(records.module_paths(edges), "target", "left").groupBy("target").agg(F.array_sort(F.collect_set("importer")).alias("importers"))
    assert sorted(map(str, got.collect())) == sorted(map(str, met.collect())) and "BroadcastHashJoin" not in plan(got)
    assert {r["target"]: r["importers"] for r in got.collect()}["src/b.ts"] == ["src/a.ts", "src/c.js"]


def test_findings_meet_the_files_by_shuffle_without_telling_these_apart(spark):
    found = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "path string, line int")
    files = spark.createDataFrame([("a",), ("a",), ("c",)], "path string")
    got = records.findings_of(found, files)
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("a", 3)]
    assert "HashAggregate" not in plan(got) and "BroadcastHashJoin" not in plan(got)


def test_bundles_of_kept_columns_do_not_carry_diffs(spark):
    rows = [(i, f"p{i // 2}{('.ts', '.test.ts')[i % 2]}", "+" * (3000 + 997 * i), i % 3, i % 2) for i in range(30)] + [(99, "n.ts", None, 1, 1)]
    files = spark.createDataFrame(rows, "position int, path string, diff string, additions int, deletions int")
    narrow, whole = bundles.file_bundles(files, keep=["position", "path"]), bundles.file_bundles(files)
    assert narrow.columns == ["position", "path", "group_id", "reason", "bin", "total_chars"] and "diff" in whole.columns
    assert sorted(narrow.collect()) == sorted(whole.select(narrow.columns).collect())
    assert "diff" not in plan(narrow)


def test_lines_are_indexed_where_snippets_ask_with_the_same_windows(spark, monkeypatch):
    files = spark.createDataFrame([(1, p, line) for p, line in enumerate(["x", "alpha beta gamma delta", "", "wholly other text here", "alpha beta gamme delta"])] + [(2, 1, "alpha beta gamma delta")], "f int, p int, line string")
    wanted = spark.createDataFrame([(1, 7, ["alpha beta gamma deltas"]), (1, 8, ["x"]), (2, 9, ["nowhere"])], "f int, _s long, _target array<string>")
    few = sorted(map(tuple, locate.near_lines(wanted, files, ["f"]).collect()))
    monkeypatch.setattr(locate, "ASKED", 0)  # every character
    assert few == sorted(map(tuple, locate.near_lines(wanted, files, ["f"]).collect())) == [(7, 1), (7, 4)]
