"""The catalogue of the engine's own queries, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import bundles, diffs, lines, locate, records, selection, similar
from textloom.session import table

L = "(SELECT doc_id, unnest(ls) AS content, generate_subscripts(ls, 1) AS line FROM (SELECT doc_id, CASE WHEN ls[-1] = '' THEN ls[1:len(ls) - 1] ELSE ls END AS ls FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"
NORM = r"regexp_replace(x, '^[\s\x{FEFF}\x{A0}\x{85}\x0B\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{FEFF}\x{A0}\x{85}\x0B\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g')"
EXT = "|".join(e[1:] for e in selection.BINARY)
TOKENS = r"list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^\w\s]', ' ', 'g'), '\s+'), lambda t: t <> ''))"


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def path_of(url):
    return F.regexp_replace(F.regexp_replace(url, "^[a-z]+://[^/]+/?", ""), r"[?#].*$", "")


PATH_SQL = "regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+/?', ''), '[?#].*$', '')"


def search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.search(documents(spark, sf_dir), "doc_id", "text", r"[[:digit:]]{3}")
    return lines.first_matches(found, "doc_id")


def search_totals(spark, sf_dir):
    return lines.totals(lines.search(documents(spark, sf_dir), "doc_id", "text", r"[[:digit:]]{3}"))


def context_slice(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return lines.around(docs, "text", F.lit(12), 10, 10).select("doc_id", "start_line", "end_line", "content", "truncated", F.coalesce("reason", F.lit("")).alias("reason"))


def context_truncation(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return lines.context(docs, "text", F.lit(2), F.lit(1000), most=5).select("doc_id", "start_line", "end_line", "truncated")


def filter_paths(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", path_of(F.col("url")).alias("path"))
    reason = selection.drop_reason(F.col("path"), include=("**/*.html", "en/**", "fr/*"))
    return pages.select("page_id", "path", F.coalesce(reason, F.lit("kept")).alias("outcome"))


def rule_first_match(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", path_of(F.col("url")).alias("path"))
    return pages.select("page_id", selection.rule_for(F.col("path"), repo=(("en/*.html", "english page"), ("en/**", "english")), home=(("**/*.html", "page"),), generic="any").alias("rule"))


def line_normalise(spark, sf_dir):
    found = X.norm_lines(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.size(found).alias("n_lines"), F.md5(F.array_join(found, "\n")).alias("md5"))


def synth_diff_stats(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", diffs.synthesize(F.col("doc_id").cast("string"), F.col("text")).alias("diff"))
    changed = diffs.parse(docs, "doc_id", "diff")
    return diffs.summary(changed, "doc_id").select("doc_id", "new_path", "is_new", "insertions", "deletions")


def diff_side_numbers(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", diffs.synthesize(F.col("doc_id").cast("string"), F.col("text")).alias("diff"))
    changed = diffs.parse(docs, "doc_id", "diff")
    return changed.filter("content <> ''").select("doc_id", F.col("new_no").cast("int").alias("new_no"), F.md5("content").alias("content_md5"))


def snapshots(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("name"), F.year("l_shipdate").alias("y"), "l_suppkey")
    pick = lambda y: items.filter(F.col("y") == y).select("name", (F.col("l_suppkey") % 3).alias("v"))
    return pick(1995), pick(1996)


def snapshot_added_removed(spark, sf_dir):
    return records.snapshot_diff(*snapshots(spark, sf_dir), ["name", "v"])


def unpinned_constraints(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    constraint = F.element_at(F.array(*map(F.lit, ("*", "latest", ">=1.0", ">=1.0 <2", "^1.2.3", "", " "))), (F.col("p_partkey") % 7 + 1).cast("int"))
    return part.select("p_partkey", records.unpinned(constraint).alias("unpinned"))


def history_stats(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("subject", F.concat(F.col("event_type"), F.when(F.col("event_id") % 5 == 0, " hotfix").otherwise("")))
    out = records.history_stats(events, "user_id", "ts", "subject")
    return out.select("user_id", "total_commits", F.col("last_modified").cast("string").alias("last_modified"), F.round("fix_commit_ratio", 6).alias("fix_commit_ratio"))


def key_consistency(spark, sf_dir):
    keys = table(spark, sf_dir, "events").select("user_id", "event_type", F.month("ts").alias("m"), (F.dayofmonth("ts") % 4).alias("g"))
    return bundles.key_consistency(keys, ["g"], "user_id", "event_type")


def link_importers(spark, sf_dir):
    found = records.links(table(spark, sf_dir, "pages"), "page_id", "html")
    return found.groupBy("target").agg(F.count("*").alias("n"), F.min("page_id").alias("first"), F.max("page_id").alias("last"))


def variant_groups(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("page"), F.col("page_id") % 40, F.element_at(F.array(*map(F.lit, ("_en", "-fr", "", "_de_AT"))), (F.col("page_id") % 4 + 1).cast("int")), F.lit(".json")).alias("path"))
    return bundles.variant_groups(pages, "path")


def test_pairs(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p"), F.floor(F.col("page_id") / 3), F.element_at(F.array(*map(F.lit, ("", ".test", "_spec"))), (F.col("page_id") % 3 + 1).cast("int")), F.lit(".ts")).alias("path"))
    return bundles.pairing_groups(pages, "path", "page_id")


def pack_bundles(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 25)).alias("grp"), F.col("n_chars").alias("size"))
    return bundles.pack(docs, ["grp"], "size", [F.col("doc_id")])


def locate_exact(spark, sf_dir):
    """The second and third line of every document in all documents."""
    docs = documents(spark, sf_dir)
    snippets = docs.select(F.col("doc_id").alias("item_id"), F.array_join(F.slice(X.norm_lines(F.col("text")), 2, 2), "\n").alias("snippet"))
    found = locate.search_snippets(snippets, docs, "item_id", "snippet", "doc_id", "text")
    return found.select("item_id", "doc_id", F.col("at").cast("int").alias("at"))


def locate_cascade(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = X.norm_lines(F.col("text"))
    ls, n = F.col("ls"), F.size("ls")
    changed = lambda i: F.transform(F.slice(ls, F.greatest(i, F.lit(1)).cast("int"), 1), lambda x: F.concat(x, F.lit("!")))
    kind = F.col("doc_id") % 4
    code = F.when(kind == 0, F.slice(ls, 2, 2)).when(kind == 1, changed(F.floor(n / 2))).when(kind == 2, changed(n)).otherwise(F.array(F.lit("nowhere to be found")))
    wanted = docs.select("doc_id", found.alias("ls")).select("doc_id", "ls", code.alias("code"))
    at = F.coalesce(locate.run_at(ls, F.col("code")), F.lit(0))
    near = F.when(at > 0, 0).otherwise(F.coalesce(locate.locate_fuzzy(ls, F.col("code")), F.lit(0)))  # only where the text itself isn't found
    return wanted.select("doc_id", locate.cascade(at, F.lit(0), near).alias("located_by"), F.greatest(at, near).alias("at"))


def hunk_align_nearest(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    hunks = events.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("number"), (F.col("event_id") % 500).alias("start"), (F.col("event_id") % 500 + 5).alias("end"))
    hints = events.filter("event_type = 'signup'").select("user_id", "event_id", (F.col("event_id") % 400).alias("hint"))
    return locate.align(hints, hunks, ["user_id"], "hint", "start", "end", "number").select("event_id", "hunk", "line")


def line_in_range(spark, sf_dir):
    claims = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 7 + 1).alias("a"), (F.col("doc_id") % 7 + 3).alias("b"))
    changed = lines.lines(documents(spark, sf_dir), "doc_id", "text").filter(F.col("content").contains("er"))
    return locate.lines_in_range(claims, changed, ["doc_id"], "a", "b", "line").select("doc_id", "a", "b")


def validate_all(spark, sf_dir):
    docs = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    keep, why = locate.verdict({"line_in_hunk": F.col("n_chars") > 500, "existing_code_found": F.col("text").contains("the"), "existing_code_in_diff": F.col("quality") == 1, "evidence_valid": F.col("lang") == "en"})
    return docs.select("doc_id", keep.alias("verdict"), why.alias("reason"))


def near_dup_pairs(spark, sf_dir):
    return similar.similar_pairs(documents(spark, sf_dir), "doc_id", "text").select("a", "b", F.round("similarity", 6).alias("similarity"))


def near_dup_groups(spark, sf_dir):
    return similar.near_groups(documents(spark, sf_dir), "doc_id", "text")


def secret_scan(spark, sf_dir):
    return records.scan_secrets(lines.lines(documents(spark, sf_dir), "doc_id", "text"), "doc_id")


def high_entropy(spark, sf_dir):
    words = documents(spark, sf_dir).select(F.explode(F.array_distinct(F.split("text", " "))).alias("w")).distinct().filter(F.length("w") >= records.LITERAL)
    return words.select("w", F.round(X.entropy(F.col("w")), 4).alias("bits"))


def lint_parse(spark, sf_dir):
    said = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("src/"), F.col("source"), F.lit(".rs:"), F.col("doc_id") + 1, F.lit(":7: "), F.element_at(F.array(*map(F.lit, ("error", "warning", "note"))), (F.col("doc_id") % 3 + 1).cast("int")), F.lit(": "), F.col("lang")).alias("content"))
    return records.lint_lines(said, "clippy").select("doc_id", "path", "line", "severity", "message", "tool")


def queries() -> dict:
    found = (search_lines, search_totals, context_slice, context_truncation, filter_paths, rule_first_match, line_normalise, synth_diff_stats, diff_side_numbers, snapshot_added_removed, unpinned_constraints, history_stats, key_consistency, link_importers, variant_groups, test_pairs, pack_bundles, locate_exact, locate_cascade, hunk_align_nearest, line_in_range, validate_all, near_dup_pairs, near_dup_groups, secret_scan, high_entropy, lint_parse)
    return {f.__name__: f for f in found}


SNAP = "(SELECT l_partkey AS name, l_suppkey % 3 AS v FROM lineitem WHERE year(l_shipdate) = {})"
NEAR = f"""t AS (SELECT doc_id, {TOKENS} AS ts FROM documents), w AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS w FROM t),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) / (a.n + b.n - count(*)) AS similarity FROM w a JOIN w b ON a.w = b.w AND a.doc_id < b.doc_id AND a.n >= 0.6 * b.n AND b.n >= 0.6 * a.n GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.6
 UNION ALL SELECT a.doc_id, b.doc_id, 1.0 FROM t a JOIN t b ON len(a.ts) = 0 AND len(b.ts) = 0 AND a.doc_id < b.doc_id)"""


def oracle_sql() -> dict:
    return {
        "search_lines": rf"SELECT doc_id, CAST(line AS INT) AS line, content FROM {L} WHERE regexp_matches(content, '[0-9]{{3}}') ORDER BY doc_id, line LIMIT 50",
        "search_totals": rf"SELECT count(*) AS total_matches, count(*) > 50 AS truncated FROM {L} WHERE regexp_matches(content, '[0-9]{{3}}')",
        "context_slice": "SELECT doc_id, CASE WHEN n < 2 THEN 0 ELSE 2 END AS start_line, CASE WHEN n < 2 THEN 0 ELSE CAST(least(n, 22) AS INT) END AS end_line, CASE WHEN n < 2 THEN '' ELSE array_to_string(ls[2:22], chr(10)) END AS content, false AS truncated, CASE WHEN text = '' OR text IS NULL THEN 'file not found' WHEN n < 2 THEN 'range is outside the file' ELSE '' END AS reason FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls, len(string_split(text, chr(10))) AS n FROM documents)",
        "context_truncation": "SELECT doc_id, CASE WHEN n < 2 THEN 0 ELSE 2 END AS start_line, CAST(CASE WHEN n < 2 THEN 0 ELSE least(n, 6) END AS INT) AS end_line, n > 6 AS truncated FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)",
        "filter_paths": f"SELECT page_id, path, CASE WHEN regexp_matches(lower(path), '\\.({EXT})$') THEN 'binary' WHEN regexp_matches(path, '(?i)(^|/)[^/]*(\\.lock|\\.min\\.js|\\.min\\.css|\\.map)$|(^|/)(package-lock\\.json|yarn\\.lock|pnpm-lock\\.yaml)$') THEN 'excluded' WHEN regexp_matches(path, '(?i)^([^/]+/)*[^/]*\\.html$|^en/[^/]+(/[^/]+)*$|^fr/[^/]+$') THEN 'kept' ELSE 'not_included' END AS outcome FROM (SELECT page_id, {PATH_SQL} AS path FROM pages)",
        "rule_first_match": f"SELECT page_id, CASE WHEN regexp_matches(path, '(?i)^en/[^/]*\\.html$') THEN 'english page' WHEN regexp_matches(path, '(?i)^en/[^/]+(/[^/]+)*$') THEN 'english' WHEN regexp_matches(path, '(?i)^([^/]+/)*[^/]*\\.html$') THEN 'page' ELSE 'any' END AS rule FROM (SELECT page_id, {PATH_SQL} AS path FROM pages)",
        "line_normalise": f"SELECT doc_id, CAST(len(ls) AS INT) AS n_lines, md5(array_to_string(ls, chr(10))) AS md5 FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {NORM}), lambda x: x <> '') AS ls FROM documents)",
        "synth_diff_stats": f"SELECT doc_id, CAST(doc_id AS VARCHAR) AS new_path, true AS is_new, count(line) AS insertions, CAST(0 AS BIGINT) AS deletions FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) LEFT JOIN {L} USING (doc_id) GROUP BY doc_id",
        "diff_side_numbers": f"SELECT doc_id, CAST(line AS INT) AS new_no, md5(content) AS content_md5 FROM {L} WHERE content <> ''",
        "snapshot_added_removed": f"SELECT *, 'added' AS change FROM (SELECT * FROM {SNAP.format(1996)} EXCEPT SELECT * FROM {SNAP.format(1995)}) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM {SNAP.format(1995)} EXCEPT SELECT * FROM {SNAP.format(1996)})",
        "unpinned_constraints": "SELECT p_partkey, p_partkey % 7 IN (0, 1, 2, 5, 6) AS unpinned FROM part",
        "history_stats": "SELECT user_id, count(*) AS total_commits, strftime(max(ts), '%Y-%m-%d %H:%M:%S') || CASE WHEN microsecond(max(ts)) % 1000000 = 0 THEN '' ELSE rtrim('.' || lpad(CAST(microsecond(max(ts)) % 1000000 AS VARCHAR), 6, '0'), '0') END AS last_modified, round(avg(CASE WHEN event_id % 5 = 0 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS fix_commit_ratio FROM events GROUP BY user_id",
        "key_consistency": "WITH k AS (SELECT DISTINCT CAST(day(ts) % 4 AS INT) AS g, user_id, event_type FROM events), m AS (SELECT DISTINCT g, user_id FROM k), c AS (SELECT g, event_type, count(*) AS has FROM k GROUP BY g, event_type), n AS (SELECT g, count(*) AS total FROM m GROUP BY g) SELECT m.g, m.user_id, c.event_type, k.event_type IS NULL AS missing, k.event_type IS NOT NULL AND has < total AS extra FROM m JOIN c ON m.g = c.g JOIN n ON m.g = n.g LEFT JOIN k ON k.g = m.g AND k.user_id = m.user_id AND k.event_type = c.event_type",
        "link_importers": """SELECT target, count(*) AS n, min(page_id) AS "first", max(page_id) AS "last" FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS target FROM pages) GROUP BY target""",
        "variant_groups": "SELECT page_id, 'page' || page_id % 40 || ['_en', '-fr', '', '_de_AT'][page_id % 4 + 1] || '.json' AS path, 'page' || page_id % 40 || '.json' AS variant_of, count(*) OVER (PARTITION BY page_id % 40) AS variants FROM pages",
        "test_pairs": "SELECT page_id, 'p' || page_id // 3 || ['', '.test', '_spec'][page_id % 3 + 1] || '.ts' AS path, CASE WHEN page_id % 3 < 2 AND page_id // 3 * 3 + 1 <= (SELECT max(page_id) FROM pages) THEN page_id // 3 * 3 ELSE page_id END AS group_id, CASE WHEN page_id % 3 < 2 AND page_id // 3 * 3 + 1 <= (SELECT max(page_id) FROM pages) THEN 'test_source_pair' ELSE 'single_file' END AS reason FROM pages",
        "pack_bundles": f"WITH RECURSIVE d AS (SELECT doc_id, source || '/' || doc_id // 25 AS grp, n_chars AS size, row_number() OVER (PARTITION BY source || '/' || doc_id // 25 ORDER BY doc_id) AS i FROM documents), r AS (SELECT doc_id, grp, size, i, 0 AS bin, size AS used FROM d WHERE i = 1 UNION ALL SELECT d.doc_id, d.grp, d.size, d.i, CASE WHEN r.used + d.size > {bundles.CAP} THEN r.bin + 1 ELSE r.bin END, CASE WHEN r.used + d.size > {bundles.CAP} THEN d.size ELSE r.used + d.size END FROM r JOIN d ON d.grp = r.grp AND d.i = r.i + 1) SELECT doc_id, grp, size, bin, CAST(sum(size) OVER (PARTITION BY grp, bin) AS BIGINT) AS bin_size FROM r",
        "locate_exact": f"WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {NORM}), lambda x: x <> '') AS l FROM documents), s AS (SELECT doc_id AS item_id, l[2:3] AS t FROM d WHERE len(l) > 1), e AS (SELECT doc_id, l, unnest(l) AS line, generate_subscripts(l, 1) AS p FROM d) SELECT item_id, doc_id, CAST(min(p) AS INT) AS at FROM e JOIN s ON e.line = s.t[1] WHERE l[p:p + len(t) - 1] = t GROUP BY item_id, doc_id",
        "hunk_align_nearest": "WITH h AS (SELECT user_id, event_id AS number, event_id % 500 AS s, event_id % 500 + 5 AS e FROM events WHERE event_type = 'error'), q AS (SELECT user_id, event_id, event_id % 400 AS hint FROM events WHERE event_type = 'signup'), j AS (SELECT event_id, hint, min(number) FILTER (hint BETWEEN s AND e) AS inside, min(number) AS first, arg_min(s, number) AS fs, max(number) AS last, arg_max(e, number) AS le, arg_min(struct_pack(number := number, s := s), struct_pack(d := abs(hint - s), number := number)) AS near FROM q JOIN h USING (user_id) GROUP BY ALL) SELECT event_id, CASE WHEN inside IS NOT NULL THEN inside WHEN hint < fs THEN first WHEN hint > le THEN last ELSE near.number END AS hunk, CASE WHEN inside IS NOT NULL THEN hint WHEN hint < fs THEN fs WHEN hint > le THEN le ELSE near.s END AS line FROM j",
        "line_in_range": f"SELECT doc_id, doc_id % 7 + 1 AS a, doc_id % 7 + 3 AS b FROM labels l WHERE EXISTS (SELECT 1 FROM {L} x WHERE x.doc_id = l.doc_id AND contains(x.content, 'er') AND x.line BETWEEN l.doc_id % 7 + 1 AND l.doc_id % 7 + 3)",
        "validate_all": "SELECT doc_id, CASE WHEN len(f) = 0 THEN 'keep' ELSE 'drop' END AS verdict, array_to_string(f, ', ') AS reason FROM (SELECT d.doc_id, list_filter([CASE WHEN coalesce(n_chars > 500, false) THEN '' ELSE 'line_in_hunk' END, CASE WHEN coalesce(contains(text, 'the'), false) THEN '' ELSE 'existing_code_found' END, CASE WHEN coalesce(quality = 1, false) THEN '' ELSE 'existing_code_in_diff' END, CASE WHEN coalesce(lang = 'en', false) THEN '' ELSE 'evidence_valid' END], lambda x: x <> '') AS f FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)",
        "near_dup_pairs": f"WITH {NEAR} SELECT a, b, round(similarity, 6) AS similarity FROM p",
        "near_dup_groups": f"WITH RECURSIVE {NEAR}, l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r(n, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.n, l.b FROM r JOIN l ON r.m = l.a) SELECT n AS doc_id, min(m) AS duplicate_of, min(m) = n AS is_kept FROM r GROUP BY n",
        "secret_scan": rf"""WITH k AS (SELECT doc_id, line, content, regexp_extract_all(content, '\b(AKIA[0-9A-Z]{{16}})\b', 1) AS a, regexp_extract_all(content, '(-----BEGIN [A-Z ]*PRIVATE KEY-----)', 1) AS b,
 regexp_extract_all(content, '\b(eyJ[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}})', 1) AS c, regexp_extract_all(content, '(?i:api_key|token|password|secret)\s*[=:]\s*["'']?([A-Za-z0-9_\-./+=]{{8,}})', 1) AS d FROM {L}),
e AS (SELECT row_number() OVER () AS i, doc_id, line, unnest(regexp_extract_all(content, '["'']([^"''\s]{{{records.LITERAL},}})["'']', 1)) AS s FROM k WHERE len(a) + len(b) + len(c) + len(d) = 0),
u AS (SELECT i, s, unnest(string_split(s, '')) AS x FROM e), w AS (SELECT i, s, -sum(p * log2(p)) AS bits FROM (SELECT i, s, x, count(*) / any_value(n) AS p FROM (SELECT i, s, x, count(*) OVER (PARTITION BY i, s) AS n FROM u) GROUP BY i, s, x) GROUP BY i, s),
f AS (SELECT doc_id, line, 'cloud_access_key' AS pattern, unnest(a) AS s FROM k UNION ALL SELECT doc_id, line, 'private_key', unnest(b) FROM k UNION ALL SELECT doc_id, line, 'json_web_token', unnest(c) FROM k UNION ALL SELECT doc_id, line, 'assigned_secret', unnest(d) FROM k UNION ALL SELECT doc_id, line, 'high_entropy', e.s FROM e JOIN w ON e.i = w.i AND e.s = w.s WHERE bits > {records.BITS})
SELECT doc_id, CAST(line AS INT) AS line, pattern, left(s, 4) || repeat('*', greatest(len(s) - 4, 0)) AS matched FROM f""",
        "high_entropy": f"WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents), c AS (SELECT w, unnest(string_split(w, '')) AS c FROM w WHERE len(w) >= {records.LITERAL}), n AS (SELECT w, c, count(*) / len(w) AS p FROM c GROUP BY w, c) SELECT w, round(-sum(p * log2(p)), 4) AS bits FROM n GROUP BY w",
        "lint_parse": "SELECT doc_id, 'src/' || source || '.rs' AS path, CAST(doc_id + 1 AS INT) AS line, ['error', 'warning'][doc_id % 3 + 1] AS severity, lang AS message, 'clippy' AS tool FROM documents WHERE doc_id % 3 < 2",
    }
