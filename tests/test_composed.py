"""Whole tools and sources against small cases, and that each checked query has rows of the cases that it is there for."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import text
from textloom.operators import bundles, diffs, lines, locate, records, review, selection
from textloom.plans import catalogue, changes, composed
from textloom.sources import corpus
from textloom.streaming import scan

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("query", "condition"),
    [
        (composed.file_bundles, "reason = 'i18n_variants' and bin > 0"), (composed.file_bundles, "reason = 'test_source_pair'"), (composed.bundle_keys, "missing <> '' and extra <> ''"), (composed.bundle_keys, "reason <> ''"),
        (composed.dependency_changes, "change = 'added' and unpinned = 'true'"), (composed.dependency_changes, "change = 'removed'"), (composed.dependency_changes, "reason like 'unsupported%'"), (composed.dependency_changes, "reason like 'could not%'"),
        *[(composed.lint_all, f"tool = '{t}'") for t in ("eslint", "ruff", "tsc", "go_vet", "clippy")], *[(composed.added_secrets, f"pattern = '{k}'") for k in ("cloud_access_key", "private_key", "json_web_token", "assigned_secret", "high_entropy")],
        *[(composed.configured_paths, f"outcome = '{o}'") for o in ("binary", "excluded", "not_included", "kept")], (composed.prompt_sections, "first = 'own'"), (composed.search_skips_binary, "doc_id % 5 = 1"),
        (composed.linters_in_use, "tools like '%,%'"), (composed.linters_in_use, "tools <> ''"), *[(composed.declared_tests, f"reason like '{r}%'") for r in ("-", "no package.json", "package.json is", "no scripts")],
        (composed.search_outcome, "reason = 'empty query'"), (composed.search_outcome, "total_matches > 0"), (composed.snapshots_of_refs, "search <> post"), (composed.work_tree_status, "status = 'modified'"),
        *[(composed.status_derivation, f"status = '{s}'") for s in ("added", "deleted", "renamed", "modified")], (catalogue.locate_exact, "item_id <> doc_id"), *[(catalogue.locate_cascade, f"located_by = '{b}'") for b in ("text_match", "fuzzy_match", "failed")],
        (catalogue.locate_cascade, "located_by = 'fuzzy_match' and at > 3"), (changes.go_mod_parse, "name = 'x/b' and constraint = 'v2.0.0'"),
    ],
)
def test_queries_have_the_cases_that_they_check(spark, query, condition):
    assert query(spark, SMALL).filter(condition).count() > 0


def test_untracked_files_change_verdicts(spark):
    both = [f(spark, "/root/testdata/sf0.01") for f in (changes.reflect_comments, changes.reflect_untracked)]
    assert both[1].exceptAll(both[0]).filter("verdict = 'keep'").count() > 0


def test_go_mod_goes_by_the_order_of_lines(spark):
    text = "require a/b v3\nrequire (\n\ta/b v1\n  c/d v1 // x\n  )\nrequire c/d v2\nrequire lonely\nrequire(e/f v1)\nrequire (\nlast v9"
    got = {r["name"]: r["constraint"] for r in records.go_mod(F.lit("g"), F.col("t"), spark.createDataFrame([(text,)], ["t"])).collect()}
    assert got == {"a/b": "v1", "c/d": "v2", "last": "v9"}


def test_lint_formats(spark):
    said = {"go_vet": ["a.go:3:5: bad", "C:/x/a.go:3: bad", "# pkg", "no"], "clippy": ["a.rs:3:1: note: n", "a.rs:3:1: error: e", "a\\b.rs:4:2: warning: w"], "tsc": ["a\\b.ts(3,4):  error  TS1:  bad", "x.ts(1,1): fatal TS1: no"]}
    rows = spark.createDataFrame([(t, "\n".join(x)) for t, x in said.items()], ["tool", "content"])
    got = {(r["tool"], r["path"], r["line"], r["severity"], r["message"]) for r in records.lint_findings(rows).collect()}
    assert got == {("go_vet", "a.go:3", 5, "warning", "bad"), ("go_vet", "C:/x/a.go", 3, "warning", "bad"), ("clippy", "a.rs", 3, "error", "e"), ("clippy", "a/b.rs", 4, "warning", "w"), ("tsc", "a/b.ts", 3, "error", "bad")}


def test_import_forms(spark):
    text = "import a from './a'\nimport './side.css'\nexport {b,\n c} from \"../b\"\nexport * from './c'\nconst d = require( './d' )\nawait import('./e')\nrequire('./f' + x)\nlet s = 'from'; y('./g')\nimport {h} from './h'; // './i'"
    got = records.import_edges(spark.createDataFrame([("x", text)], ["p", "t"]), "p", "t")
    assert [r["specifier"] for r in got.collect()] == ["./a", "./side.css", "../b", "./c", "./d", "./e", "./h"]


def test_search_looks_where_a_bare_ref_says(spark):
    refs = spark.createDataFrame([("HEAD",), ("a..b",), ("v1",), ("c^..c",)], ["r"])
    assert [r[0] for r in refs.select(diffs.search_snapshot(F.col("r"))).collect()] == ["WORKTREE", "b", "v1", "c"]


def test_search_reasons_and_paths(spark):
    files = spark.createDataFrame([("src/a.py", "one\ntwo"), ("lib/a.py", "two"), ("bin", "two\0")], ["p", "t"])
    ask = lambda *a, **k: tuple(lines.outcome(files, "p", "t", *a, **k).first())
    assert ask("") == ("", 0, False, "empty query") and ask("three") == ("three", 0, False, "no matches or invalid pattern")
    assert ask("two", include=("src/**",)) == ("two", 1, False, None) and ask("two", exclude=("**/*.py",)) == ("two", 0, False, None) and ask("two", most=1)[2]


def test_bundles(spark):
    rows = [(1, "m_en.json", "x" * 15000, 1, 0, '{"a": 1, "b": 2}'), (2, "m_fr.json", "x" * 4000, 9, 0, '{"a": 1}'), (3, "m_de.json", "x" * 4000, 5, 0, "[7, 8]"), (4, "m.json", "x" * 100, 0, 0, "nonsense"), (5, "z.ts", None, 0, 0, "")]
    files = spark.createDataFrame(rows, "position int, path string, diff string, additions int, deletions int, content string")
    packed = bundles.file_bundles(files, cap=10_000)
    assert {(r["position"], r["bin"], r["total_chars"]) for r in packed.collect()} == {(2, 0, 8000), (3, 0, 8000), (1, 1, 15000), (4, 2, 100)}
    whole = bundles.file_bundles(files, cap=100_000)
    keys = {r["path"]: (r["missing"], r["extra"], r["reason"]) for r in bundles.bundle_keys(whole, files.select("path", "content")).collect()}
    assert keys == {"m_en.json": (["0", "1"], ["a", "b"], None), "m_fr.json": (["0", "1", "b"], ["a"], None), "m_de.json": (["a", "b"], ["0", "1"], None), "m.json": ([], [], "not parseable as JSON")}


def test_fuzzy_windows_against_brute_force(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    texts = [["alpha beta gamma", "delta epsilon", "zeta eta theta", "iota kappa", "alpha beta gamma delta"], ["short", "shorts", "longer line here"], []]
    wanted = [["zeta eta thetA"], ["delta epsilom", "zeta eta theta!"], ["shorts!"], ["nothing like it"], ["alpha beta gamma delt"], []]
    rows = [(t, w) for t in texts for w in wanted]
    found = spark.createDataFrame(rows, "t array<string>, w array<string>").select(locate.locate_fuzzy(F.col("t"), F.col("w"))).collect()
    for (t, w), (at,) in zip(rows, found, strict=True):
        near = [i + 1 for i in range(len(t) - len(w) + 1) if w and sum(distance(a, b) for a, b in zip(t[i:], w, strict=False)) / sum(max(len(a), len(b)) for a, b in zip(t[i:], w, strict=False)) < locate.FUZZY]
        assert at == (near[0] if near else None)


def test_front_matter(spark):
    texts = {"---\na: 1\n---\nbody\n": "body\n", "---\na\n...\nb": "b", "---\nopen": "---\nopen", "x\n---\n": "x\n---\n", "---\n---": "", "--- \na\n---\n": "--- \na\n---\n"}
    got = spark.createDataFrame([(t,) for t in texts], ["t"]).select("t", text.strip_front_matter(F.col("t")).alias("b")).collect()
    assert {r["t"]: r["b"] for r in got} == texts


def test_statuses(spark):
    rows = [("HEAD", "a", "1"), ("HEAD", "b", "1"), ("HEAD", "c", "1"), ("WORKTREE", "a", "1"), ("WORKTREE", "b", "2"), ("WORKTREE", "d", "1")]
    got = {tuple(r) for r in review.statuses(spark.createDataFrame(rows, ["snapshot", "path", "content"])).collect()}
    assert got == {("b", "modified"), ("c", "modified"), ("d", "untracked")}


def test_sources_and_sinks(spark, tmp_path):
    root = tmp_path / "src" / "x" / "src"
    for name, text in {"a.ts": "one", "deep/b.js": "two", "node_modules/c.ts": "no", "d.txt": "no", "src/e.ts": "three"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    for given in (str(root), f"file://{root}/"):
        assert {tuple(r) for r in corpus.read_folder(spark, given).collect()} == {("a.ts", "one"), ("deep/b.js", "two"), ("src/e.ts", "three")}
    (tmp_path / "rules.json").write_text('{"rules": [{"path": "a/*", "rule": "A"}, {"pattern": "b", "path": "c", "rule": "B"}, {"rule": "none"}]}')
    assert [tuple(r) for r in corpus.read_rules(spark, f"{tmp_path}/rules.json").collect()] == [(0, "a/*", "A"), (1, "b", "B")]
    (tmp_path / "filters.json").write_text('{"filters": {"exclude": ["gen/**"]}, "rules": []}')
    own = corpus.read_filters(spark, f"{tmp_path}/filters.json")
    assert own == {"exclude": ["gen/**"]} and corpus.read_filters(spark, f"{tmp_path}/none.json") is None and corpus.read_filters(spark, f"{tmp_path}/rules.json") is None
    exclude, include = selection.merge_config(own, {"exclude": ["x", "gen/**"], "include": ["y"]})
    assert exclude == [*selection.LEFT_OUT, "x", "gen/**"] and include == ["y"] and selection.merge_config({"include": []}, {"include": ["y"]})[1] == []
    corpus.write_json(spark.createDataFrame([(1, "x")], ["a", "b"]), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").first().asDict() == {"a": 1, "b": "x"}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "one.patch").write_text("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n")
    patches = corpus.read_patches(spark, f"{tmp_path}/p")
    assert [(r["file"], r["new_path"], r["insertions"]) for r in diffs.summary(diffs.parse(patches, "file", "diff"), "file").collect()] == [("one.patch", "x", 1)]
    (tmp_path / "log").write_text("h1\t2024-01-02T03:04:05+00:00\tfix: a\tb\nnoise\nh2\t2024-01-03T03:04:05+00:00\tadd\n")
    log = corpus.read_log(spark, f"{tmp_path}/log", "x.py")
    assert [(r["total_commits"], r["fix_commit_ratio"]) for r in records.history_stats(log, "path", "ts", "subject").collect()] == [(2, 0.5)]


def test_streams_scan_like_tables(spark, tmp_path):
    rows = spark.createDataFrame([("f1", 1, "token = abcdefgh12345"), ("f1", 2, "nothing"), ("f2", 1, "AKIA" + "A1" * 8)], "path string, line int, content string")
    rows.write.parquet(f"{tmp_path}/in")

    def drained(frame, name):
        frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.table(name).collect()))

    found = scan.stream_secrets(spark, f"{tmp_path}/in", "path string, line int, content string", "path", "content")
    assert drained(found, "secrets") == sorted(map(tuple, records.scan_secrets(rows, "path").collect()))
    files = spark.readStream.schema("path string, line int, content string").parquet(f"{tmp_path}/in")
    assert sorted(map(tuple, scan.drained(found, "secrets").collect())) == sorted(map(tuple, records.scan_secrets(rows, "path").collect()))
    assert drained(scan.stream_search(files, "path", "content", "AKIA"), "lines") == [("f2", 1, "AKIA" + "A1" * 8)]


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    from textloom import session

    class Cluster:
        class conf:
            get = staticmethod(lambda name, default=None: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        session.shared_dir(Cluster)
