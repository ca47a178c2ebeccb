"""Whole tools as one plan each: bundles of changed files, dependency changes, findings of all linters, added secrets, bounded search with its reason; and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.patterns import glob_regex
from textloom.operators import bundles, diffs, lines, records, review, selection, similar
from textloom.plans import catalogue
from textloom.plans.catalogue import TOKENS, L
from textloom.session import spread, table
from textloom.streaming import scan


def pick(index, *values):
    """The value at a place from 0."""
    return F.get(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), index.cast("int"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), F.col("p_size").alias("n")), "p")


def changed_files(spark, sf_dir) -> DataFrame:
    """position, path, diff, additions, deletions, content: pairs of tests and sources, locale variants with keys that differ, and single files."""
    own = parts(spark, sf_dir).withColumns({"g": F.floor(F.col("p") / 4), "r": F.col("p") % 4})
    name = lambda *bits: F.concat(*[F.lit(b) if isinstance(b, str) else b.cast("string") for b in bits])
    g = F.col("g")
    pairs = pick(F.col("r"), name("p", g, ".ts"), name("p", g, ".test.ts"), name("q", g, "_spec.py"), name("q", g, ".py"))
    variants = pick(F.col("r"), name("m", g, "_en.json"), name("m", g, "-fr.json"), name("m", g, ".json"), name("m", g, "_de_AT.json"))
    path = pick(g % 3, pairs, variants, name("s", F.col("p"), ".txt"))
    keys = F.concat(F.lit('{"all": 1, "k'), F.col("r"), F.lit('": 2'), F.when(F.col("r") < 2, ', "half": 3').otherwise(""), F.lit("}"))
    return own.select(
        F.col("p").alias("position"), path.alias("path"), F.repeat(F.lit("+"), ((F.col("p") % 9 + 1) * 1500).cast("int")).alias("diff"), F.col("n").alias("additions"), (F.col("p") % 7).alias("deletions"),
        F.when(F.col("p") % 11 == 0, "{broken").otherwise(keys).alias("content"),
    )


def file_bundles(spark, sf_dir):
    return bundles.file_bundles(changed_files(spark, sf_dir), keep=["position", "path"]).select("position", "path", "reason", "group_id", "bin", F.col("total_chars").cast("long").alias("total_chars"))


def bundle_keys(spark, sf_dir):
    files = changed_files(spark, sf_dir)
    found = bundles.bundle_keys(bundles.file_bundles(files, keep=["position", "path"]), files.select("path", "content"))
    return found.select("group_id", "path", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"), F.coalesce("reason", F.lit("")).alias("reason"))


def dependency_changes(spark, sf_dir):
    own, n = parts(spark, sf_dir), F.col("n").cast("string")
    path = F.concat(F.lit("x"), "p", pick(F.col("p") % 5, "\\package.json", "/requirements.txt", "/go.mod", "/Cargo.toml", "/web/package.json"))
    before = pick(F.col("p") % 5, '{"dependencies": {"a": "1", "gone": "2"}}', "a==1\ngone\n", "module m\nrequire (\n\ta/b v1\n\tgone/g v1\n)\n", "x", F.lit(None).cast("string"))
    after = pick(
        F.col("p") % 5, F.concat(F.lit('{"dependencies": {"a": "'), n, F.lit('", "new": "^1"}, "devDependencies": {"loose": ">=1", "new": "*"}}')),
        F.concat(F.lit("# pins\na=="), n, F.lit("\nnew[x] >=2 ; python\nloose\nloose >1\nfree\n-r more\n")),
        F.concat(F.lit("module m\nrequire c/d v0\nrequire (\n\ta/b v"), n, F.lit(" // indirect\n\t// e/f v1\n\tc/d latest\n\t)\nrequire c/d v9\nrequire lonely\nrequire new/n latest\n")),
        "x", F.when(F.col("p") % 2 == 0, "").otherwise('{"dependencies": {"only": "latest"}}'),
    )
    found = records.dependency_diff(own.select(path.alias("path"), before.alias("before"), after.alias("after")))
    return found.select("path", *[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in ("name", "change", "constraint", "unpinned", "reason")])


def lint_all(spark, sf_dir):
    """Five tools' output, with lines that are none of their findings, restricted to the files asked for."""
    own, p, n = parts(spark, sf_dir), F.col("p").cast("string"), F.col("n").cast("string")
    said = pick(
        F.col("p") % 5, F.concat(F.lit('[{"filePath": "a\\\\'), p, F.lit('", "messages": [{"line": '), n, F.lit(', "severity": 2, "message": "bad", "ruleId": "no-x"}, {"severity": 0, "message": "odd"}]}]')),
        F.concat(F.lit('[{"filename": "b/'), p, F.lit('", "code": "E1", "message": "worse", "location": {"row": '), n, F.lit("}}]")),
        F.concat(F.lit("starting\nc\\"), p, F.lit("("), n, F.lit(",5):  error  TS12:  type (x): y\nc/"), p, F.lit("(7,1): note TS1: none\nc/"), p, F.lit("(8,1): warning TS1: soft")),
        F.concat(F.lit("# pkg\nd/"), p, F.lit(":"), n, F.lit(":5: col\n#d/"), p, F.lit(":1: not\nC:/d/"), p, F.lit(":3: drive")),
        F.concat(F.lit("e/"), p, F.lit(":"), n, F.lit(":1: error: E\ne/"), p, F.lit(":2:1: note: N\ne/"), p, F.lit(":3:1: warning: W")),
    )
    output = own.select(pick(F.col("p") % 5, "eslint", "ruff", "tsc", "go_vet", "clippy").alias("tool"), said.alias("content"))
    asked = own.select(F.explode(F.array(*[F.concat(F.lit(c), p) for c in ("a/", "b/", "c/", "e/", "C:/d/")], F.concat(F.lit("d/"), p, F.lit(":"), n))).alias("path"))
    return records.lint_findings(output, asked)


def added_secrets(spark, sf_dir):
    """Secrets of every kind in added lines; the same in deleted and unchanged lines are not reported."""
    h = F.md5(F.col("p").cast("string"))
    secret = pick(
        F.col("p") % 6, F.concat(F.lit("key AKIA"), F.upper(F.left(h, F.lit(16)))), F.lit("-----BEGIN RSA PRIVATE KEY-----"), F.concat(F.lit("x eyJ"), h, F.lit("."), h, F.lit("."), h, F.lit(" y")),
        F.concat(F.lit('Password: "'), h, F.lit('"')), F.concat(F.lit("s = 'abcdefghijklmnopqrstuvwxyz"), "p", F.lit("'")), F.lit("nothing = 'aaaaaaaaaaaaaaaaaaaaaaaaaaaa'"),
    )
    path = F.concat(F.lit("f"), "p", F.lit(".py"))
    diff = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -3,2 +3,2 @@\n "), secret, F.lit("\n-"), secret, F.lit("\n+"), secret)
    found = records.added_lines(parts(spark, sf_dir).select("p", diff.alias("diff")), "p", "diff")
    return records.scan_secrets(found.select("path", "line", "content"), "path")


def search_outcome(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("/"), "doc_id").alias("path"), "text")
    calls = (("", (), ()), ("[[:digit:]]{3}", ("en/*", "fr/*"), ("**/*7",)), ("no such line anywhere", (), ()), ("er", (), ("**/*",)))
    found = [lines.outcome(docs, "path", "text", query, include, exclude) for query, include, exclude in calls]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.withColumn("reason", F.coalesce("reason", F.lit("")))


def configured_paths(spark, sf_dir):
    """Paths, some with backslashes, under the exclusions of both configurations and the inclusions of the nearer one."""
    exclude, include = selection.merge_config({"exclude": ["gen/**"], "include": ["**/*.py", "src/**"]}, {"exclude": ["**/*_pb.py"], "include": ["nothing"]})
    path = F.concat(pick(F.col("p") % 4, "gen/", "src\\", "lib/a/", "src/x/"), F.lit("f"), "p", pick(F.col("p") % 7, ".py", "_pb.py", ".PNG", ".lock", ".txt", ".min.js", ".ts"))
    return parts(spark, sf_dir).select("p", F.coalesce(selection.drop_reason(path, exclude, include), F.lit("kept")).alias("outcome"))


def prompt_sections(spark, sf_dir):
    """For each path the text of all rules that apply to it, from rules as data."""
    paths = parts(spark, sf_dir).select("p", F.concat(F.lit("src/f"), "p", pick(F.col("p") % 3, ".py", ".test.py", ".md")).alias("path"))
    known = ((0, 0, "own", "**/*.test.py"), (1, 0, "python", "**/*.py"), (1, 1, "source", "src/**"))
    rules = spark.createDataFrame([(layer, i, rule, glob_regex(pattern)) for layer, i, rule, pattern in known], ["layer", "ord", "rule", "regex"])
    first = selection.rule_join(paths, rules, "path").withColumnRenamed("rule", "first")
    met = paths.join(rules, F.expr("path rlike regex")).groupBy("p").agg(F.array_sort(F.collect_list(F.struct("layer", "ord", "rule"))).alias("r"))
    return met.join(first, "p").select("p", "path", "first", X.bulleted(F.transform("r", lambda x: x["rule"])).alias("section"))


def search_skips_binary(spark, sf_dir):
    """Matches in texts of which some have a NUL near the beginning, and some far behind it."""
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("a\0"), "text")).when(F.col("doc_id") % 5 == 1, F.concat(F.col("text"), F.repeat(F.lit(" "), 8000), F.lit("\0"))).otherwise(F.col("text"))
    found = lines.search(docs.select("doc_id", text.alias("text")), "doc_id", "text", "[[:alpha:]]er")
    return found.groupBy("doc_id").agg(F.count("*").alias("n"))


def streamed_search(spark, sf_dir):
    """The documents as a stream of files, searched as they come."""
    docs = scan.stream_table(spark, f"{sf_dir}/documents.parquet")
    return scan.drained(scan.stream_search(docs, "doc_id", "text", "[[:digit:]]{3}"), "search")


def streamed_secrets(spark, sf_dir):
    docs = scan.stream_table(spark, f"{sf_dir}/documents.parquet")
    return scan.drained(records.scan_secrets(lines.lines(docs, "doc_id", "text"), "doc_id"), "secrets")


def front_matter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    head = pick(F.col("doc_id") % 5, "---\ntitle: x\n---\n", "---\ntitle: x\n...\n", "--- \nno\n---\n", "---\nnever closed\n", "")
    return docs.select("doc_id", F.md5(X.strip_front_matter(F.concat(head, "text"))).alias("body_md5"))


def linters_in_use(spark, sf_dir):
    name = pick(F.col("p") % 8, "eslint.config.mjs", "tsconfig.json", "pyproject.toml", "go.mod", "Cargo.toml", "README", "sub/go.mod", "main.rs")
    files = parts(spark, sf_dir).select(F.floor(F.sqrt("p")).alias("repo"), name.alias("path"))
    return records.applicable_linters(files, "repo", "path").select("repo", F.array_join("tools", ",").alias("tools"), F.coalesce("reason", F.lit("")).alias("reason"))


def declared_tests(spark, sf_dir):
    text = pick(F.col("p") % 5, F.lit('{"scripts": {"test": "vitest run"}}'), F.lit("{nope"), F.lit(None).cast("string"), F.lit('{"scripts": {}}'), F.lit('{"scripts": {"test": ""}}'))
    found = records.test_scripts(parts(spark, sf_dir).select("p", text.alias("content")), "p", "content")
    return found.select("p", F.coalesce("script", F.lit("-")).alias("script"), F.coalesce("reason", F.lit("-")).alias("reason"))


def snapshots_of_refs(spark, sf_dir):
    ref = pick(F.col("p") % 4, F.lit("HEAD"), F.concat(F.lit("a..b"), "p"), F.concat(F.lit("v"), "p"), F.lit("x^..x"))
    return parts(spark, sf_dir).select("p", diffs.search_snapshot(ref).alias("search"), diffs.post_snapshot(ref).alias("post"), diffs.pre_snapshot(ref).alias("pre"))


def work_tree_status(spark, sf_dir):
    own = parts(spark, sf_dir).select("p", F.concat(F.lit("f"), "p").alias("path"), F.md5(F.col("p").cast("string")).alias("content"))
    head = own.filter("p % 2 = 0").select(F.lit("HEAD").alias("snapshot"), "path", "content")
    tree = own.filter("p % 10 <> 4").select(F.lit("WORKTREE").alias("snapshot"), "path", F.when(F.col("p") % 6 == 0, "edited").otherwise(F.col("content")).alias("content"))
    return review.statuses(head.unionByName(tree))


def status_derivation(spark, sf_dir):
    """Statuses of files from the headers of their diffs."""
    own, p = parts(spark, sf_dir), F.col("p").cast("string")
    git = F.concat(F.lit("diff --git a/f"), p, F.lit(" b/"), F.when(F.col("p") % 4 == 2, "g").otherwise("f"), p, F.lit("\n"))
    body = pick(F.col("p") % 4, F.concat(F.lit("new file mode 100644\n--- /dev/null\n+++ b/f"), p, F.lit("\n@@ -0,0 +1 @@\n+x")), F.concat(F.lit("deleted file mode 100644\n--- a/f"), p, F.lit("\n+++ /dev/null\n@@ -1 +0,0 @@\n-x")), F.concat(F.lit("rename from f"), p, F.lit("\nrename to g"), p), F.concat(F.lit("--- a/f"), p, F.lit("\n+++ b/f"), p, F.lit("\n@@ -1 +1 @@\n-x\n+y")))
    found = diffs.summary(diffs.parse(own.select("p", F.concat(git, body).alias("diff")), "p", "diff"), "p")
    return found.select("p", "old_path", "new_path", diffs.status(F.col("is_new"), F.col("is_deleted"), F.col("is_renamed")).alias("status"), "insertions", "deletions")


def comments_with_code(spark, sf_dir) -> DataFrame:
    code = pick(F.col("doc_id") % 4, F.lit(None).cast("string"), F.lit("x = 1"), F.lit("if  X = 1:"), F.lit("y"))
    return table(spark, sf_dir, "documents").select("doc_id", "text", code.alias("code"))


def near_dup_code(spark, sf_dir):
    return similar.similar_pairs(comments_with_code(spark, sf_dir), "doc_id", "text", code="code").select("a", "b", F.round("similarity", 6).alias("similarity"))


def near_dup_code_groups(spark, sf_dir):
    return similar.near_groups(comments_with_code(spark, sf_dir), "doc_id", "text", code="code")


def code_normalise(spark, sf_dir):
    return comments_with_code(spark, sf_dir).select("doc_id", X.norm_code(F.col("code")).alias("code"), F.md5(X.norm_code(F.col("text"))).alias("text_md5"))


def queries() -> dict:
    found = (file_bundles, bundle_keys, dependency_changes, lint_all, added_secrets, search_outcome, configured_paths, prompt_sections, search_skips_binary, streamed_search, streamed_secrets, front_matter, linters_in_use, declared_tests, snapshots_of_refs, work_tree_status, status_derivation, near_dup_code, near_dup_code_groups, code_normalise)
    return {f.__name__: f for f in found}


BUNDLES = f"""f AS (SELECT p_partkey AS position, p_partkey // 4 AS g, p_partkey % 4 AS r, (p_partkey % 9 + 1) * 1500 AS size, p_size AS additions, p_partkey % 7 AS deletions, (SELECT max(p_partkey) FROM part) AS most FROM part),
k AS (SELECT *, CASE g % 3 WHEN 0 THEN ['p' || g || '.ts', 'p' || g || '.test.ts', 'q' || g || '_spec.py', 'q' || g || '.py'][r + 1] WHEN 1 THEN 'm' || g || ['_en.json', '-fr.json', '.json', '_de_AT.json'][r + 1] ELSE 's' || position || '.txt' END AS path,
 CASE WHEN g % 3 = 0 AND position - r % 2 + 1 <= most THEN 'test_source_pair' WHEN g % 3 = 1 AND count(*) OVER (PARTITION BY g) > 1 THEN 'i18n_variants' ELSE 'single_file' END AS reason FROM f),
m AS (SELECT *, CASE reason WHEN 'test_source_pair' THEN position - r % 2 WHEN 'i18n_variants' THEN min(position) OVER (PARTITION BY g, reason) ELSE position END AS group_id FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY (additions + deletions) / size DESC, position) AS i FROM m),
b AS (SELECT position, group_id, i, size, 0 AS bin, size AS used FROM o WHERE i = 1 UNION ALL SELECT o.position, o.group_id, o.i, o.size, CASE WHEN b.used + o.size > {bundles.CAP} THEN b.bin + 1 ELSE b.bin END, CASE WHEN b.used + o.size > {bundles.CAP} THEN o.size ELSE b.used + o.size END FROM b JOIN o ON o.group_id = b.group_id AND o.i = b.i + 1),
v AS (SELECT o.*, b.bin, CAST(sum(o.size) OVER (PARTITION BY o.group_id, b.bin) AS BIGINT) AS total_chars FROM o JOIN b USING (position))"""
KEYS = """w AS (SELECT * FROM v WHERE reason = 'i18n_variants' QUALIFY bin = max(bin) OVER (PARTITION BY group_id)),
c AS (SELECT group_id, path, CASE WHEN position % 11 <> 0 THEN list_filter(['all', CASE WHEN r < 2 THEN 'half' END, 'k' || r], lambda x: x IS NOT NULL) END AS ks FROM w),
e AS (SELECT group_id, path, unnest(ks) AS x FROM c), a AS (SELECT group_id, x, count(*) AS n FROM e GROUP BY ALL), s AS (SELECT group_id, count(*) AS total FROM c WHERE ks IS NOT NULL GROUP BY group_id)"""
CODE = "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'x = 1' WHEN 2 THEN 'if x = 1:' ELSE 'y' END"
NEAR_CODE = f"""t AS (SELECT doc_id, {CODE} AS code, {TOKENS} AS ts FROM documents), w AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS w FROM t),
q AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) / (a.n + b.n - count(*)) AS similarity FROM w a JOIN w b ON a.w = b.w AND a.doc_id < b.doc_id AND a.n >= 0.6 * b.n AND b.n >= 0.6 * a.n GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.6
 UNION ALL SELECT a.doc_id, b.doc_id, 1.0 FROM t a JOIN t b ON len(a.ts) = 0 AND len(b.ts) = 0 AND a.doc_id < b.doc_id),
p AS (SELECT q.* FROM q JOIN t x ON q.a = x.doc_id JOIN t y ON q.b = y.doc_id WHERE x.code = y.code OR (x.code <> '' AND y.code <> '' AND (contains(x.code, y.code) OR contains(y.code, x.code))))"""


def dependency_rows() -> str:
    """Expected rows of each kind of manifest: name, change, constraint, unpinned."""
    kinds = {
        0: ("'x' || p || '/package.json'", [("gone", "removed", "'-'", "-"), ("loose", "added", "'>=1'", "true"), ("new", "added", "'*'", "true")]),
        1: ("'x' || p || '/requirements.txt'", [("gone", "removed", "'-'", "-"), ("new", "added", "'>=2'", "false"), ("loose", "added", "'>1'", "false"), ("free", "added", "''", "true")]),
        2: ("'x' || p || '/go.mod'", [("gone/g", "removed", "'-'", "-"), ("c/d", "added", "'v9'", "false"), ("new/n", "added", "'latest'", "true")]),
    }
    rows = [f"SELECT {path} AS path, '{name}' AS name, '{change}' AS change, {constraint} AS \"constraint\", '{loose}' AS unpinned, '-' AS reason FROM d WHERE p % 5 = {k}" for k, (path, found) in kinds.items() for name, change, constraint, loose in found]
    rows.append("SELECT 'x' || p || '/Cargo.toml', '-', '-', '-', '-', 'unsupported dependency manifest: x' || p || '/Cargo.toml' FROM d WHERE p % 5 = 3")
    rows.append("SELECT 'x' || p || '/web/package.json', CASE WHEN p % 2 = 0 THEN '-' ELSE 'only' END, CASE WHEN p % 2 = 0 THEN '-' ELSE 'added' END, CASE WHEN p % 2 = 0 THEN '-' ELSE 'latest' END, CASE WHEN p % 2 = 0 THEN '-' ELSE 'true' END, CASE WHEN p % 2 = 0 THEN 'could not read x' || p || '/web/package.json' ELSE '-' END FROM d WHERE p % 5 = 4")
    return "WITH d AS (SELECT p_partkey AS p FROM part) " + " UNION ALL ".join(rows)


def oracle_sql() -> dict:
    finding = "SELECT {} AS path, CAST({} AS INT) AS line, '{}' AS severity, '{}' AS message, '{}' AS tool FROM part WHERE p_partkey % 5 = {}".format
    masked = "left({0}, 4) || repeat('*', len({0}) - 4)".format
    secret = "SELECT 'f' || p_partkey || '.py' AS path, 4 AS line, '{}' AS pattern, {} AS matched FROM part WHERE p_partkey % 6 = {}".format
    h = "md5(CAST(p_partkey AS VARCHAR))"
    where = f"SELECT lang || '/' || doc_id AS path, content FROM {L} JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)"
    return {
        "file_bundles": f"WITH RECURSIVE {BUNDLES} SELECT position, path, reason, group_id, bin, total_chars FROM v",
        "bundle_keys": f"WITH RECURSIVE {BUNDLES}, {KEYS} SELECT c.group_id, c.path, CASE WHEN ks IS NULL THEN '' ELSE coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM a WHERE a.group_id = c.group_id AND NOT list_contains(ks, x)), '') END AS missing, CASE WHEN ks IS NULL THEN '' ELSE coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM a JOIN s USING (group_id) WHERE a.group_id = c.group_id AND list_contains(ks, x) AND n < total), '') END AS extra, CASE WHEN ks IS NULL THEN 'not parseable as JSON' ELSE '' END AS reason FROM c",
        "dependency_changes": dependency_rows(),
        "lint_all": " UNION ALL ".join([
            finding("'a/' || p_partkey", "p_size", "error", "bad (no-x)", "eslint", 0), finding("'a/' || p_partkey", "0", "info", "odd", "eslint", 0), finding("'b/' || p_partkey", "p_size", "warning", "worse (E1)", "ruff", 1),
            finding("'c/' || p_partkey", "p_size", "error", "type (x): y", "tsc", 2), finding("'c/' || p_partkey", "8", "warning", "soft", "tsc", 2), finding("'d/' || p_partkey || ':' || p_size", "5", "warning", "col", "go_vet", 3),
            finding("'C:/d/' || p_partkey", "3", "warning", "drive", "go_vet", 3), finding("'e/' || p_partkey", "p_size", "error", "E", "clippy", 4), finding("'e/' || p_partkey", "3", "warning", "W", "clippy", 4),
        ]),
        "added_secrets": " UNION ALL ".join([
            secret("cloud_access_key", masked(f"('AKIA' || upper(left({h}, 16)))"), 0), secret("private_key", masked("'-----BEGIN RSA PRIVATE KEY-----'"), 1), secret("json_web_token", masked(f"('eyJ' || {h} || '.' || {h} || '.' || {h})"), 2),
            secret("assigned_secret", masked(h), 3), secret("high_entropy", masked("('abcdefghijklmnopqrstuvwxyz' || p_partkey)"), 4),
        ]),
        "search_outcome": rf"""WITH x AS ({where}), y AS (SELECT count(*) AS n FROM x WHERE regexp_matches(content, '[0-9]{{3}}') AND regexp_matches(path, '^(en|fr)/[^/]*$') AND NOT path LIKE '%7')
SELECT '' AS query, CAST(0 AS BIGINT) AS total_matches, false AS truncated, 'empty query' AS reason UNION ALL SELECT '[[:digit:]]{{3}}', n, n > 50, '' FROM y
UNION ALL SELECT 'no such line anywhere', 0, false, 'no matches or invalid pattern' UNION ALL SELECT 'er', 0, false, CASE WHEN (SELECT count(*) FROM x WHERE contains(content, 'er')) = 0 THEN 'no matches or invalid pattern' ELSE '' END""",
        "configured_paths": """SELECT p, CASE WHEN e = '.PNG' THEN 'binary' WHEN d = 'gen/' OR e IN ('_pb.py', '.lock', '.min.js') THEN 'excluded' WHEN e <> '.py' AND d NOT LIKE 'src/%' THEN 'not_included' ELSE 'kept' END AS outcome
 FROM (SELECT p_partkey AS p, ['gen/', 'src/', 'lib/a/', 'src/x/'][p_partkey % 4 + 1] AS d, ['.py', '_pb.py', '.PNG', '.lock', '.txt', '.min.js', '.ts'][p_partkey % 7 + 1] AS e FROM part)""",
        "prompt_sections": "SELECT p_partkey AS p, 'src/f' || p_partkey || ['.py', '.test.py', '.md'][p_partkey % 3 + 1] AS path, ['python', 'own', 'source'][p_partkey % 3 + 1] AS first, ['- python' || chr(10) || '- source', '- own' || chr(10) || '- python' || chr(10) || '- source', 'source'][p_partkey % 3 + 1] AS section FROM part",
        "search_skips_binary": f"SELECT doc_id, count(*) AS n FROM {L} WHERE doc_id % 5 <> 0 AND regexp_matches(content, '[A-Za-z]er') GROUP BY doc_id",
        "streamed_search": f"SELECT doc_id, CAST(line AS INT) AS line, content FROM {L} WHERE regexp_matches(content, '[0-9]{{3}}')",
        "streamed_secrets": catalogue.oracle_sql()["secret_scan"],
        "front_matter": "SELECT doc_id, md5(CASE doc_id % 5 WHEN 2 THEN '--- ' || chr(10) || 'no' || chr(10) || '---' || chr(10) || text WHEN 3 THEN CASE WHEN regexp_matches(chr(10) || text || chr(10), chr(10) || '(---|[.]{3})' || chr(10)) THEN regexp_replace(chr(10) || text, '^(?s:.*?)' || chr(10) || '(---|[.]{3})(' || chr(10) || '|$)', '') ELSE '---' || chr(10) || 'never closed' || chr(10) || text END ELSE text END) AS body_md5 FROM documents WHERE text IS NOT NULL",
        "linters_in_use": """SELECT repo, array_to_string(t, ',') AS tools, CASE WHEN len(t) = 0 THEN 'no known lint/typecheck configuration detected' ELSE '' END AS reason FROM (SELECT CAST(floor(sqrt(p_partkey)) AS BIGINT) AS repo,
 list_filter([CASE WHEN bool_or(p_partkey % 8 = 0) THEN 'eslint' END, CASE WHEN bool_or(p_partkey % 8 = 1) THEN 'tsc' END, CASE WHEN bool_or(p_partkey % 8 = 2) THEN 'ruff' END, CASE WHEN bool_or(p_partkey % 8 = 3) THEN 'go_vet' END, CASE WHEN bool_or(p_partkey % 8 = 4) THEN 'clippy' END], lambda x: x IS NOT NULL) AS t FROM part GROUP BY ALL)""",
        "declared_tests": "SELECT p_partkey AS p, CASE WHEN p_partkey % 5 = 0 THEN 'vitest run' ELSE '-' END AS script, ['-', 'package.json is not valid JSON', 'no package.json found in repo root', 'no scripts.test defined in package.json', 'no scripts.test defined in package.json'][p_partkey % 5 + 1] AS reason FROM part",
        "snapshots_of_refs": "SELECT p_partkey AS p, CASE p_partkey % 4 WHEN 0 THEN 'WORKTREE' WHEN 1 THEN 'b' || p_partkey WHEN 2 THEN 'v' || p_partkey ELSE 'x' END AS search, CASE p_partkey % 4 WHEN 1 THEN 'b' || p_partkey WHEN 3 THEN 'x' ELSE 'WORKTREE' END AS post, CASE p_partkey % 4 WHEN 1 THEN 'a' WHEN 3 THEN 'x^' ELSE 'HEAD' END AS pre FROM part",
        "work_tree_status": "SELECT 'f' || p_partkey AS path, CASE WHEN p_partkey % 2 = 1 THEN 'untracked' ELSE 'modified' END AS status FROM part WHERE p_partkey % 2 = 1 OR (p_partkey % 6 = 0 AND p_partkey % 10 <> 4) OR p_partkey % 10 = 4",
        "status_derivation": "SELECT p_partkey AS p, CASE p_partkey % 4 WHEN 0 THEN '' ELSE 'f' || p_partkey END AS old_path, CASE p_partkey % 4 WHEN 1 THEN '' WHEN 2 THEN 'g' || p_partkey ELSE 'f' || p_partkey END AS new_path, ['added', 'deleted', 'renamed', 'modified'][p_partkey % 4 + 1] AS status, CAST([1, 0, 0, 1][p_partkey % 4 + 1] AS BIGINT) AS insertions, CAST([0, 1, 0, 1][p_partkey % 4 + 1] AS BIGINT) AS deletions FROM part",
        "near_dup_code": f"WITH {NEAR_CODE} SELECT a, b, round(similarity, 6) AS similarity FROM p",
        "near_dup_code_groups": f"WITH RECURSIVE {NEAR_CODE}, l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r(n, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.n, l.b FROM r JOIN l ON r.m = l.a) SELECT n AS doc_id, min(m) AS duplicate_of, min(m) = n AS is_kept FROM r GROUP BY n",
        "code_normalise": f"SELECT doc_id, {CODE} AS code, md5(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))) AS text_md5 FROM documents",
    }
