"""Queries over changed files: targets, positions and verdicts of comments, manifests, imports, snapshots; and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import diffs, records, review
from textloom.session import spread, table

NORM = r"regexp_replace({}, '^[\s\x{{FEFF}}\x{{A0}}\x{{85}}\x0B\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+|[\s\x{{FEFF}}\x{{A0}}\x{{85}}\x0B\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+$', '', 'g')"
EXTENSIONS = (".txt", ".py", ".min.js", ".png")


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, ls, edit, content, diff: every document as a file whose second line, if there is one, was changed in the work tree."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", diffs.file_lines(F.col("text")).alias("ls"))
    path = F.concat(F.lit("d/"), F.col("doc_id"), F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 4 + 1).cast("int")))
    docs = docs.withColumns({"path": path, "edit": F.concat(F.lit("changed "), F.col("doc_id")), "n": F.size("ls")})
    rest = F.slice("ls", 3, F.greatest(F.col("n") - 2, F.lit(0)))
    first = F.slice("ls", 1, 1)
    mark = lambda sign, x: F.transform(x, lambda y: F.concat(F.lit(sign), y))
    body = F.concat(mark(" ", first), mark("-", F.slice("ls", 2, 1)), F.array(F.concat(F.lit("+"), F.col("edit"))), mark(" ", rest))
    size = F.col("n").cast("string")
    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -1,"), size, F.lit(" +1,"), size, F.lit(" @@\n"))
    more = F.col("n") > 1
    return docs.withColumns({"content": F.when(more, F.array_join(F.concat(first, F.array("edit"), rest), "\n")).otherwise(F.array_join("ls", "\n")), "diff": F.when(more, F.concat(head, F.array_join(body, "\n")))})


def comments(files: DataFrame) -> DataFrame:
    """Of every kind in turn: the new line, the old one, two lines after it, a hint, and a line that is nowhere."""
    kind = F.col("doc_id") % 5
    code = F.when(kind == 0, F.col("edit")).when(kind == 1, F.get("ls", F.lit(1))).when(kind == 2, F.array_join(F.slice("ls", 3, 2), "\n")).when(kind == 4, "no such line stands anywhere here")
    return files.select("doc_id", "path", code.alias("existing_code"), F.when(kind == 3, 7).alias("hint_line"))


def review_targets(spark, sf_dir):
    files = edited(spark, sf_dir)
    fresh = files.filter("diff is null").select("path", "content")
    tracked = files.filter("diff is not null").select("path", "diff")
    changed = review.workspace_diffs(tracked, fresh).withColumnRenamed("path", "file")
    return review.targets(changed, "file", "diff").select("path", F.md5("diff").alias("diff_md5"), "additions", "deletions", "status", "outcome")


def review_totals(spark, sf_dir):
    return review.target_totals(review_targets(spark, sf_dir))


def position_comments(spark, sf_dir):
    files = edited(spark, sf_dir)
    changes = review.change_sets(files.filter("diff is not null"), "path", "diff")
    return review.position(comments(files), changes, files.select("path", "content")).select("doc_id", "start_line", "end_line", "located_by")


def reflected(files: DataFrame, texts: DataFrame) -> DataFrame:
    changes = review.change_sets(files.filter("diff is not null"), "path", "diff")
    ref = lambda path, snippet: F.array(F.struct(path.alias("path"), snippet.alias("snippet")))
    kind = F.col("doc_id") % 6
    evidence = F.when(kind == 0, ref(F.col("path"), F.col("edit"))).when(kind == 1, ref(F.col("path"), F.coalesce(F.get("ls", F.lit(1)), F.lit("")))).when(kind == 2, ref(F.lit("missing"), F.lit("x")))
    claims = comments(files).join(files.select("doc_id", evidence.alias("evidence")), "doc_id").withColumn("start_line", F.col("doc_id") % 4).withColumn("end_line", F.col("start_line") + F.col("doc_id") % 3)
    return review.reflect(claims, changes, texts, "doc_id").select("doc_id", "verdict", "reason")


def reflect_comments(spark, sf_dir):
    files = edited(spark, sf_dir)
    return reflected(files, files.select("path", "content"))


def reflect_untracked(spark, sf_dir):
    """The same, where every second file is known to be untracked: without a diff it is new."""
    files = edited(spark, sf_dir)
    return reflected(files, files.select("path", "content", (F.col("doc_id") % 2 == 0).alias("untracked")))


def snapshots(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), "doc_id").alias("path"), "doc_id", F.md5("text").alias("content"))
    rows = [docs.filter("doc_id % 2 = 0").withColumn("snapshot", F.lit("HEAD")), docs.withColumn("snapshot", F.lit("WORKTREE")), docs.filter("doc_id % 3 = 0").select("path", "doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("b"), "doc_id")).otherwise("").alias("content")).withColumn("snapshot", F.lit("b"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).select("snapshot", "path", "content")


def untracked_files(spark, sf_dir):
    return review.untracked(snapshots(spark, sf_dir))


def content_fallback(spark, sf_dir):
    wanted = table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), "doc_id").alias("path"), diffs.post_snapshot(F.lit("a..b")).alias("snapshot"), diffs.pre_snapshot(F.lit("a..b")).alias("before"))
    return review.content_at(wanted, snapshots(spark, sf_dir))


def requirements_parse(spark, sf_dir):
    line = F.concat(F.lit("pkg_"), "p_partkey", F.lit(" <1\npkg_"), "p_partkey", F.lit("[extra] >=1."), "p_size", F.lit(" ; python_version"))
    files = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 50).alias("g")).agg(F.concat(F.lit("# pins\n-r base\n\n"), F.array_join(F.collect_list(line), "\n")).alias("text"))
    return records.requirements_txt(F.col("g"), F.col("text"), files)


def package_json_parse(spark, sf_dir):
    key, size = F.concat(F.lit("p"), "p_partkey"), F.col("p_size").cast("string")
    text = F.to_json(F.struct(F.create_map(F.lit("both"), F.lit("1"), key, size).alias("dependencies"), F.create_map(F.lit("both"), size).alias("devDependencies")))
    files = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, "{broken").otherwise(text).alias("text"))
    return records.package_json(F.col("p_partkey"), F.col("text"), files)


def go_mod_parse(spark, sf_dir):
    text = F.concat(F.lit("module m\nrequire x/b v0\n\nrequire (\n\tx/a v1."), "p_size", F.lit(" // indirect\n\tx/b v2.0.0\n  )\nrequire lonely\nrequire y/"), "p_partkey", F.lit(" v3\n"))
    return records.go_mod(F.col("p_partkey"), F.col("text"), table(spark, sf_dir, "part").select("p_partkey", text.alias("text")))


def lint_json_parse(spark, sf_dir):
    message = F.struct(F.col("p_size").alias("line"), (F.col("p_partkey") % 3).alias("severity"), F.col("p_name").alias("message"), F.when(F.col("p_partkey") % 2 == 0, "no-x").alias("ruleId"))
    text = F.to_json(F.array(F.struct(F.concat(F.lit("f"), "p_partkey").alias("filePath"), F.array(message).alias("messages"))))
    found = records.lint_json(table(spark, sf_dir, "part").select(text.alias("text")), "eslint", "text")
    asked = table(spark, sf_dir, "part").filter("p_size < 25").select(F.concat(F.lit("f"), "p_partkey").alias("path"))
    return records.findings_of(found, asked).select("path", F.col("line").cast("int").alias("line"), "severity", "message", "tool")


def module_importers(spark, sf_dir):
    part = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", F.concat(F.lit("src/m"), "p_partkey", F.lit(".ts")).alias("path"))
    text = F.concat(F.lit("import a from '../src/./m"), F.floor(F.col("p_partkey") / 3), F.lit("'\nimport b from 'react'\nexport * from './none.css'\n"))
    edges = records.import_edges(part.withColumn("text", text), "path", "text")
    return records.importers(part, edges, "path").select("target", F.array_join("importers", ",").alias("importers"))


def queries() -> dict:
    found = (review_targets, review_totals, position_comments, reflect_comments, reflect_untracked, untracked_files, content_fallback, requirements_parse, package_json_parse, go_mod_parse, lint_json_parse, module_importers)
    return {f.__name__: f for f in found}


EXT = "['.txt', '.py', '.min.js', '.png'][doc_id % 4 + 1]"
FILES = f"""f AS (SELECT doc_id, 'd/' || doc_id || {EXT} AS path, 'changed ' || doc_id AS edit, len(ls) AS n, ls FROM (SELECT doc_id, CASE WHEN ls[-1] = '' THEN ls[1:len(ls) - 1] ELSE ls END AS ls FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
g AS (SELECT *, CASE WHEN n > 1 THEN ls[1:1] || [edit] || ls[3:] ELSE ls END AS post, CASE doc_id % 5 WHEN 0 THEN [edit] WHEN 1 THEN ls[2:2] WHEN 2 THEN ls[3:4] WHEN 4 THEN ['no such line stands anywhere here'] ELSE [] END AS code FROM f),
h AS (SELECT *, list_filter(list_transform(code, lambda x: {NORM.format('x')}), lambda x: x <> '') AS t, list_filter(list_transform(post, lambda x, i: {{'n': i, 'l': {NORM.format('x')}}}), lambda x: x.l <> '') AS a, list_filter(list_transform(ls, lambda x, i: {{'n': i, 'l': {NORM.format('x')}}}), lambda x: x.l <> '') AS b FROM g),
p AS (SELECT *, CASE WHEN len(t) > 0 THEN list_filter(range(1, len(a) - len(t) + 2), lambda i: list_transform(a[i:i + len(t) - 1], lambda x: x.l) = t)[1] END AS pa, CASE WHEN len(t) > 0 THEN list_filter(range(1, len(b) - len(t) + 2), lambda i: list_transform(b[i:i + len(t) - 1], lambda x: x.l) = t)[1] END AS pb FROM h)"""
#: A file without a diff has no text match, but its window at distance 0 is a fuzzy one.
PLACED = "p2 AS (SELECT *, CASE WHEN pa IS NOT NULL THEN a[pa].n WHEN n > 1 AND pb IS NOT NULL THEN b[pb].n END AS s, CASE WHEN pa IS NOT NULL THEN a[pa + len(t) - 1].n WHEN n > 1 AND pb IS NOT NULL THEN b[pb + len(t) - 1].n END AS e FROM p)"
TARGETS = f"""WITH {FILES} SELECT path, md5('diff --git a/' || path || ' b/' || path || CASE WHEN n > 1 THEN chr(10) || '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -1,' || n || ' +1,' || n || ' @@' || chr(10) || ' ' || ls[1] || chr(10) || '-' || ls[2] || chr(10) || '+' || edit || array_to_string(list_transform(ls[3:], lambda x: chr(10) || ' ' || x), '')
 ELSE chr(10) || 'new file mode 100644' || chr(10) || '--- /dev/null' || chr(10) || '+++ b/' || path || chr(10) || '@@ -0,0 +1,' || n || ' @@' || chr(10) || array_to_string(list_transform(ls, lambda x: '+' || x), chr(10)) END) AS diff_md5,
 CASE WHEN n > 1 THEN 1 ELSE n END AS additions, CASE WHEN n > 1 THEN 1 ELSE 0 END AS deletions, CASE WHEN n > 1 THEN 'modified' ELSE 'added' END AS status, CASE doc_id % 4 WHEN 3 THEN 'binary' WHEN 2 THEN 'excluded' ELSE 'kept' END AS outcome FROM f WHERE n > 1 OR doc_id % 4 <> 3"""


NEW = "(n <= 1 AND doc_id % 2 = 0)"


def oracle_sql() -> dict:
    found = checked()
    reflect = found["reflect_comments"]
    # an untracked file without a diff passes what is asked of the change, if the claim has lines at all
    found["reflect_untracked"] = reflect.replace("n > 1 AND doc_id % 4 > 0 AND 2 BETWEEN doc_id % 4 AND doc_id % 4 + doc_id % 3 AS c1", f"doc_id % 4 > 0 AND ((n > 1 AND 2 BETWEEN doc_id % 4 AND doc_id % 4 + doc_id % 3) OR {NEW}) AS c1").replace("len(t) = 0 OR (n > 1 AND (", f"len(t) = 0 OR {NEW} OR (n > 1 AND (")
    return found


def checked() -> dict:
    return {
        "review_targets": TARGETS,
        "review_totals": f"SELECT count(*) FILTER (outcome = 'kept') AS total_files, count(*) FILTER (outcome <> 'kept') AS filtered_out FROM ({TARGETS})",
        "position_comments": f"WITH {FILES}, {PLACED} SELECT doc_id, CAST(CASE WHEN doc_id % 5 = 3 AND n > 1 THEN least(7, n) ELSE coalesce(s, 0) END AS INT) AS start_line, CAST(CASE WHEN doc_id % 5 = 3 AND n > 1 THEN least(7, n) ELSE coalesce(e, 0) END AS INT) AS end_line, CASE WHEN doc_id % 5 = 3 AND n > 1 THEN 'hunk_align' WHEN s IS NULL THEN 'failed' WHEN n > 1 THEN 'text_match' ELSE 'fuzzy_match' END AS located_by FROM p2",
        "reflect_comments": f"""WITH {FILES}, c AS (SELECT doc_id, len(a) > 0 OR len(post) > 1 OR coalesce(post[1], '') <> '' AS there, n > 1 AND doc_id % 4 > 0 AND 2 BETWEEN doc_id % 4 AND doc_id % 4 + doc_id % 3 AS c1, len(t) = 0 OR pa IS NOT NULL AS c2, len(t) = 0 OR (n > 1 AND (list_contains(t, edit) OR list_contains(t, {NORM.format('ls[2]')}))) AS c3,
 CASE doc_id % 6 WHEN 0 THEN n > 1 WHEN 1 THEN coalesce(trim(ls[2]), '') <> '' AND (list_contains(list_transform(a, lambda x: x.l), {NORM.format('ls[2]')}) OR {NORM.format('ls[2]')} = '') WHEN 2 THEN false ELSE true END AS c4 FROM p)
 SELECT doc_id, CASE WHEN there AND c1 AND c2 AND c3 AND c4 THEN 'keep' ELSE 'drop' END AS verdict, CASE WHEN NOT there THEN 'file not found' WHEN c1 AND c2 AND c3 AND c4 THEN 'passed all checks' ELSE 'failed: ' || concat_ws(', ', CASE WHEN NOT c1 THEN 'line_in_hunk' END, CASE WHEN NOT c2 THEN 'existing_code_found' END, CASE WHEN NOT c3 THEN 'existing_code_in_diff' END, CASE WHEN NOT c4 THEN 'evidence_valid' END) END AS reason FROM c""",
        "untracked_files": "SELECT 'd/' || doc_id AS path, md5(text) AS content FROM documents WHERE doc_id % 2 <> 0",
        "content_fallback": "SELECT 'd/' || doc_id AS path, 'b' AS snapshot, 'a' AS before, CASE WHEN doc_id % 6 = 0 THEN 'b' || doc_id ELSE md5(text) END AS content FROM documents",
        "requirements_parse": "SELECT p_partkey % 50 AS path, 'pkg_' || p_partkey AS name, '>=1.' || p_size AS \"constraint\" FROM part",
        "package_json_parse": "SELECT p_partkey AS path, 'both' AS name, CAST(p_size AS VARCHAR) AS \"constraint\", CAST(NULL AS VARCHAR) AS reason FROM part WHERE p_partkey % 10 <> 0 UNION ALL SELECT p_partkey, 'p' || p_partkey, CAST(p_size AS VARCHAR), NULL FROM part WHERE p_partkey % 10 <> 0 UNION ALL SELECT p_partkey, NULL, NULL, 'manifest can''t be parsed' FROM part WHERE p_partkey % 10 = 0",
        "go_mod_parse": "SELECT p_partkey AS path, 'x/a' AS name, 'v1.' || p_size AS \"constraint\" FROM part UNION ALL SELECT p_partkey, 'x/b', 'v2.0.0' FROM part UNION ALL SELECT p_partkey, 'y/' || p_partkey, 'v3' FROM part",
        "lint_json_parse": "SELECT 'f' || p_partkey AS path, CAST(p_size AS INT) AS line, ['info', 'warning', 'error'][p_partkey % 3 + 1] AS severity, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' (no-x)' ELSE '' END AS message, 'eslint' AS tool FROM part WHERE p_size < 25",
        "module_importers": "SELECT 'src/m' || t.p_partkey || '.ts' AS target, coalesce(string_agg('src/m' || i.p_partkey || '.ts', ',' ORDER BY 'src/m' || i.p_partkey || '.ts'), '') AS importers FROM part t LEFT JOIN part i ON i.p_partkey // 3 = t.p_partkey GROUP BY t.p_partkey",
    }
