"""Queries over versions of files and expressions over their lines: diffs of snapshots, renames over time, search with an index; and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import norm_lines
from textloom.operators import bundles, diffs, history, lines, linediff, locate, rule_index, text_index
from textloom.session import materialise, table, work_dir
from textloom.streaming.kept import HISTORY_KEY, history_updates, keep, kept, kept_history, link_updates, reverse
from textloom.streaming.scan import stream_table


def versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two snapshots (path, content) of all documents, whose lines begin with the document's id.

    Of each version's lines every 7th or so goes, others are changed or followed by a new one; by
    its id a document is moved, deleted, added, left alone, or stays where it is.
    """
    docs = table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", F.transform(diffs.file_lines(F.col("text")), lambda x: F.concat("doc_id", F.lit("|"), x)).alias("ls"))

    def edit(x: Column, i: Column) -> Column:
        n, own = i + 1, lambda word: F.concat(F.lit(word), "doc_id", F.lit(" "), (i + 1).cast("string"))
        return F.when(n % 7 == 3, F.array().cast("array<string>")).when(n % 11 == 5, F.array(own("edited "))).when(n % 13 == 6, F.array(x, own("new "))).otherwise(F.array(x))

    text = lambda ls: F.concat(F.array_join(ls, "\n"), F.when(F.size(ls) > 0, "\n").otherwise(""))
    kind = F.col("doc_id") % 10
    at = lambda folder: F.concat(F.lit(folder), F.col("doc_id"), F.lit(".txt"))
    before = docs.filter(kind != 6).select(at("d/").alias("path"), text(F.col("ls")).alias("content"))
    after = docs.filter(kind != 5).select(F.when(kind == 4, at("moved/")).otherwise(at("d/")).alias("path"), F.when(kind.isin(6, 7), text(F.col("ls"))).otherwise(text(F.flatten(F.transform("ls", edit)))).alias("content"))
    return before, after


def snapshot_line_diffs(spark, sf_dir):
    """Each changed path with its counts as the diff's parser finds them, and the md5 of what the diff makes of the old content."""
    before, after = versions(spark, sf_dir)
    found = materialise(linediff.snapshot_diffs(before, after), "diffs")
    keyed = found.select(F.coalesce("new_path", "old_path").alias("path"), "old_path", "diff", F.col("new_path").isNull().alias("gone"))
    counts = diffs.summary(diffs.parse(keyed, "path", "diff"), "path")
    # a diff without hunks has no row in the parser's counts but its header's
    counts = counts.select("path", diffs.status(F.col("is_new"), F.col("is_deleted"), F.col("is_renamed")).alias("status"), "insertions", "deletions")
    made = linediff.patched(keyed.join(before.withColumnRenamed("path", "old_path"), "old_path", "left"), F.col("content"), F.col("diff"))
    made = made.select("path", "old_path", F.md5("patched").alias("patched_md5"), "patch_error")
    return counts.join(made, "path").select("path", F.when(F.col("status") == "renamed", F.col("old_path")).alias("moved_from"), "status", "insertions", "deletions", "patched_md5", "patch_error")


NORM = r"regexp_replace(x, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"
#: Expressions of every kind; those of the second line are none, or need what only POSIX or the GNU extensions have.
EXPRESSIONS = ["[[:digit:]]{3}", "(the|der|les) .*(and|und|et)", "Permission is hereby granted", "colou?r", "password|api_key", "[A-Z]{12}", "nowhere to be found", "(ab){2}", "^[^ ]+$", "q"]
ODD = ["x{2", "[[:nope:]]", "(a", "a\\", "*a", "", r"[\d]7", r"\<th", r"ing\>", "a)b"]


def search_expressions(spark, sf_dir):
    """What each expression finds, and why it finds nothing, in one pass over all documents."""
    return lines.outcomes(table(spark, sf_dir, "documents"), "doc_id", "text", EXPRESSIONS + ODD)


def text_indexed(spark, sf_dir) -> str:
    folder = f"{work_dir(spark)}/index-{uuid.uuid4().hex}"
    text_index.build(table(spark, sf_dir, "documents"), "doc_id", "text", folder)
    return folder


def indexed_search(spark, sf_dir):
    """The lines that the index finds for each expression."""
    folder, out = text_indexed(spark, sf_dir), None
    for query in EXPRESSIONS[1:8]:
        found = text_index.indexed_search(spark, folder, query).select(F.lit(query).alias("query"), F.col("key").alias("doc_id"), "line", F.md5("content").alias("content_md5"))
        out = found if out is None else out.unionByName(found)
    return out


def indexed_reads(spark, sf_dir):
    """How many texts each search verifies."""
    return text_index.reads(spark, text_indexed(spark, sf_dir), EXPRESSIONS[1:8])


def event_log(spark, sf_dir) -> DataFrame:
    """The events as commits of few files: one in nine gives a name away, one in 45 swaps two, and half of the subjects fix."""
    log = table(spark, sf_dir, "events").filter("user_id is not null")
    files = F.greatest(F.floor(F.lit(log.count()) / 12), F.lit(7))
    name = lambda n: F.concat(F.lit("f"), F.pmod(n, files))
    seq, moves, swaps = F.col("event_id"), F.col("event_id") % 9 == 4, F.col("event_id") % 45 == 13
    a, b = name(seq * 37 + F.col("user_id")), name(seq * 101 + 5)
    subject = F.when(seq % 2 == 0, F.concat("event_type", F.lit(" Hotfix"))).otherwise(F.col("event_type"))
    of = lambda path, old: (F.lit("r").alias("repo"), seq.alias("seq"), path.alias("path"), old.alias("old_path"), F.col("ts").cast("string").alias("ts"), subject.alias("subject"))
    return materialise(log.select(*of(a, F.when(moves | swaps, b))).unionByName(log.filter(swaps).select(*of(b, a))), "log")


def history_renames(spark, sf_dir):
    """Every name's history across renames, where the events are commits."""
    rows = event_log(spark, sf_dir)
    paths = rows.select("repo", "path").unionByName(rows.filter("old_path is not null").select("repo", F.col("old_path").alias("path"))).unionByName(rows.limit(1).select("repo", F.lit("never").alias("path")))
    return history.history(paths, rows).select("path", "total_commits", "last_modified", F.round("fix_commit_ratio", 6).alias("fix_commit_ratio"), "reason")


def arrivals(spark, rows: DataFrame, part: Column, updates) -> tuple[DataFrame, str]:
    """``rows`` come in three parts; after each one the stream is started again and goes on. Returns the updates and their folder."""
    folder = f"{work_dir(spark)}/kept-{uuid.uuid4().hex}"
    for i in range(3):
        rows.filter(part == i).write.mode("append").parquet(f"{folder}/arrived")
        found = updates(stream_table(spark, f"{folder}/arrived"))
        keep(found, f"{folder}/table").awaitTermination()
    return found, f"{folder}/table"


def streamed_history(spark, sf_dir):
    """Every name's own history from a stream of the commits; a tenth comes twice, in different parts, and the oldest commits come last."""
    rows = event_log(spark, sf_dir)
    twice = rows.withColumn("part", 2 - F.pmod("seq", F.lit(3))).unionByName(rows.filter("seq % 10 = 0").withColumn("part", F.pmod("seq", F.lit(3))))
    found, folder = arrivals(spark, twice, F.col("part"), lambda log: history_updates(log))
    return kept_history(kept(spark, folder, found.schema, HISTORY_KEY)).select("path", "total_commits", "last_modified", F.round("fix_commit_ratio", 6).alias("fix_commit_ratio"))


def streamed_links(spark, sf_dir):
    """Pages by what they link to, from a stream of the pages' versions: of some the newer version comes first, some change their links, some go."""
    html = F.col("html")
    first = table(spark, sf_dir, "pages").select("page_id", F.lit(1).alias("seq"), html.alias("html"))
    second = first.filter("page_id % 3 <> 0").withColumns({"seq": F.lit(2), "html": F.when(F.col("page_id") % 3 == 1, F.replace(html, F.lit('href="'), F.lit('href="new:')))})
    part = F.when(F.col("page_id") % 2 == 0, F.col("seq") - 1).otherwise(2 - F.col("seq") + F.when(F.col("page_id") % 5 == 0, 1).otherwise(0))
    versions = first.unionByName(second).withColumn("part", part)
    targets = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    found, folder = arrivals(spark, versions, F.col("part"), lambda rows: link_updates(rows, "page_id", "seq", targets))
    return reverse(kept(spark, folder, found.schema, ["importer"])).select("target", F.col("importer").alias("page_id"))


def fuzzy_positions(spark, sf_dir):
    """Two lines from the middle of every document, edited, are looked for in it; letters outside ASCII are question marks, since the checking SQL counts bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("text"))
    kind, ls = F.col("doc_id") % 4, F.slice(norm_lines(F.col("text")), F.floor(F.size(norm_lines(F.col("text"))) / 2).cast("int") + 1, 2)
    edit = lambda x: F.when(kind == 0, F.concat(F.substring(x, 1, 2), F.lit("Z"), F.substring(x, 3, 1 << 30))).when(kind == 1, F.substring(x, 2, 1 << 30)).when(kind == 2, F.concat(x, F.lit(" end")))
    code = F.when(kind == 3, "nowhere to be found").otherwise(F.array_join(F.transform(ls, edit), "\n"))
    wanted = docs.select("doc_id", code.alias("code"))
    return locate.fuzzy_join(wanted, docs, ["doc_id"], "code", "text").select("doc_id", "at")


def page_paths(spark, sf_dir) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]+/?", ""), r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


def rules_from_table(spark, sf_dir):
    """The first rule of every page's path, where every page has made a rule of its own path: by its page_id an exact one, one of a name or its end, of an ending, of a folder."""
    pages = page_paths(spark, sf_dir)
    kind, folder, stem = F.col("page_id") % 6, F.regexp_extract("path", "^[^/]*", 0), F.regexp_extract("path", "/([0-9]+)", 1)
    of = F.when(kind == 0, F.col("path")).when(kind == 1, F.concat(folder, F.lit("/*"), stem)).when(kind == 2, F.concat(F.lit("**/"), stem))
    of = of.when(kind == 3, F.concat(F.lit("**/*"), F.substring(stem, -2, 2), F.lit(".html"))).when(kind == 4, F.concat(folder, F.lit("/"), F.substring(stem, 1, 1), F.lit("*"))).otherwise(F.concat(F.lit("**/"), stem, F.lit(".{html,htm}")))
    rules = pages.select((F.col("page_id") % 3).alias("layer"), F.col("page_id").alias("ord"), of.alias("glob"), F.concat(F.lit("rule "), "page_id").alias("rule"))
    return rule_index.glob_join(pages, rules)


def pack_one_group(spark, sf_dir):
    """All documents as one group, whose bins are found in parallel."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("all").alias("grp"), F.col("n_chars").alias("size"))
    return bundles.pack(docs, ["grp"], "size", [F.desc("size"), F.col("doc_id")], hot=500, block=4096)


def queries() -> dict:
    return {f.__name__: f for f in (snapshot_line_diffs, history_renames, fuzzy_positions, rules_from_table, pack_one_group, streamed_history, streamed_links, search_expressions, indexed_search, indexed_reads)}


VERSIONS = """d AS (SELECT doc_id, list_transform(CASE WHEN ls[-1] = '' THEN ls[1:len(ls) - 1] ELSE ls END, lambda x: doc_id || '|' || x) AS ls FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> '')),
e AS (SELECT doc_id, doc_id % 10 AS kind, ls, flatten(list_transform(ls, lambda x, i: CASE WHEN i % 7 = 3 THEN CAST([] AS VARCHAR[]) WHEN i % 11 = 5 THEN ['edited ' || doc_id || ' ' || i] WHEN i % 13 = 6 THEN [x, 'new ' || doc_id || ' ' || i] ELSE [x] END)) AS edited FROM d),
v AS (SELECT *, len(list_filter(range(1, len(ls) + 1), lambda i: i % 7 = 3)) AS cut, len(list_filter(range(1, len(ls) + 1), lambda i: i % 7 <> 3 AND i % 11 = 5)) AS changed, len(list_filter(range(1, len(ls) + 1), lambda i: i % 7 <> 3 AND i % 11 <> 5 AND i % 13 = 6)) AS more,
  list_sum(list_transform(list_filter(ls, lambda x, i: i % 7 <> 3 AND i % 11 <> 5), lambda x: len(x) + 1)) AS same, list_sum(list_transform(ls, lambda x: len(x) + 1)) AS before, list_sum(list_transform(edited, lambda x: len(x) + 1)) AS after, array_to_string(list_transform(edited, lambda x: x || chr(10)), '') AS post, array_to_string(list_transform(ls, lambda x: x || chr(10)), '') AS pre FROM e)"""


LOG = """c AS (SELECT greatest(count(*) // 12, 7) AS files FROM events WHERE user_id IS NOT NULL),
e AS (SELECT event_id AS seq, 'f' || (event_id * 37 + user_id) % files AS a, 'f' || (event_id * 101 + 5) % files AS b, event_id % 9 = 4 AS moves, event_id % 45 = 13 AS swaps, ts, event_type || CASE WHEN event_id % 2 = 0 THEN ' Hotfix' ELSE '' END AS subject FROM events, c WHERE user_id IS NOT NULL),
l AS (SELECT seq, a AS path, CASE WHEN moves OR swaps THEN b END AS old_path FROM e UNION ALL SELECT seq, b, a FROM e WHERE swaps),
t AS (SELECT DISTINCT seq, path FROM (SELECT seq, path FROM l UNION ALL SELECT seq, old_path FROM l WHERE old_path IS NOT NULL))"""
LAST = "strftime(max_by(ts, seq), '%Y-%m-%d %H:%M:%S') || CASE WHEN microsecond(max_by(ts, seq)) % 1000000 = 0 THEN '' ELSE rtrim('.' || lpad(CAST(microsecond(max_by(ts, seq)) % 1000000 AS VARCHAR), 6, '0'), '0') END AS last_modified"


LINES = "(SELECT doc_id, unnest(ls) AS content, generate_subscripts(ls, 1) AS line FROM (SELECT doc_id, CASE WHEN ls[-1] = '' THEN ls[1:len(ls) - 1] ELSE ls END AS ls FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"
#: The odd expressions as SQL conditions on a line; the first five aren't expressions.
ODD_SQL = {5: "false", 6: r"regexp_matches(content, '[\\d]7')", 7: r"regexp_matches(content, '(^|[^A-Za-z0-9_])th')", 8: r"regexp_matches(content, 'ing($|[^A-Za-z0-9_])')", 9: "contains(content, 'a)b')"}
#: What a text must hold for the expressions that the index is asked, written out by hand.
NEEDED = {1: [["the ", "der ", "les "]], 2: [["Permission is hereby granted"]], 3: [["color", "colour"]], 4: [["password", "api_key"]], 6: [["nowhere to be found"]], 7: [["abab"]]}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql() -> dict:
    matches = {i: f"regexp_matches(content, {quoted(p)})" for i, p in enumerate(EXPRESSIONS)}
    count = lambda query, where, empty="NULL": f"SELECT {quoted(query)} AS query, count(*) FILTER ({where}) AS total_matches, count(*) FILTER ({where}) > 50 AS truncated, CASE WHEN {empty} IS NOT NULL THEN {empty} WHEN count(*) FILTER ({where}) = 0 THEN '{lines.NO_MATCHES}' END AS reason FROM x"
    outcomes = [count(q, matches[i]) for i, q in enumerate(EXPRESSIONS)] + [count(q, ODD_SQL.get(i, "false"), "'empty query'" if not q else "CAST(NULL AS VARCHAR)") for i, q in enumerate(ODD)]
    grams = lambda s: " AND ".join(f"contains(text, {quoted(s[i:i + 3])})" for i in range(len(s) - 2))
    row = lambda path, moved, status, ins, dels, post: f"{path} AS path, {moved} AS moved_from, '{status}' AS status, CAST({ins} AS BIGINT) AS insertions, CAST({dels} AS BIGINT) AS deletions, {post} AS patched_md5, CAST(NULL AS VARCHAR) AS patch_error"
    here, there, none = "'d/' || doc_id || '.txt'", "'moved/' || doc_id || '.txt'", "CAST(NULL AS VARCHAR)"
    moved = f"kind = 4 AND coalesce(same, 0) >= {linediff.SIMILAR} * greatest(before, after)"
    return {
        "snapshot_line_diffs": f"""WITH {VERSIONS}
SELECT {row(here, none, 'modified', 'changed + more', 'cut + changed', 'md5(post)')} FROM v WHERE kind NOT IN (4, 5, 6, 7) AND pre <> post
UNION ALL SELECT {row(there, here, 'renamed', 'changed + more', 'cut + changed', 'md5(post)')} FROM v WHERE {moved}
UNION ALL SELECT {row(there, none, 'added', 'len(edited)', '0', 'md5(post)')} FROM v WHERE kind = 4 AND NOT ({moved})
UNION ALL SELECT {row(here, none, 'deleted', '0', 'len(ls)', none)} FROM v WHERE kind = 5 OR (kind = 4 AND NOT ({moved}))
UNION ALL SELECT {row(here, none, 'added', 'len(ls)', '0', 'md5(pre)')} FROM v WHERE kind = 6""",
        "streamed_history": f"""WITH {LOG}
SELECT path, count(*) AS total_commits, {LAST}, round(avg(CASE WHEN lower(subject) LIKE '%hotfix%' THEN 1.0 ELSE 0.0 END), 6) AS fix_commit_ratio FROM t JOIN e USING (seq) GROUP BY path""",
        "streamed_links": """WITH p AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS urls FROM pages)
SELECT DISTINCT CASE WHEN page_id % 3 = 1 THEN 'new:' ELSE '' END || url AS target, page_id FROM (SELECT page_id, unnest(urls) AS url FROM p WHERE page_id % 3 <> 2)""",
        "history_renames": f"""WITH RECURSIVE {LOG},
r AS MATERIALIZED (SELECT seq, path AS new, min(old_path) AS old FROM l WHERE old_path <> path GROUP BY ALL),
p AS (SELECT r.*, (SELECT max(q.seq) FROM r q WHERE q.new = r.old AND q.seq < r.seq) AS prior FROM r),
n AS (SELECT path FROM l UNION SELECT old_path FROM l WHERE old_path IS NOT NULL UNION SELECT 'never'),
s AS (SELECT n.path, n.path AS name, max(r.seq) AS low, CAST(NULL AS BIGINT) AS high FROM n LEFT JOIN r ON r.new = n.path GROUP BY n.path
  UNION ALL SELECT s.path, p.old, p.prior, p.seq FROM s JOIN p ON s.name = p.new AND s.low = p.seq),
h AS (SELECT s.path, e.seq, e.ts, e.subject FROM s JOIN t ON s.name = t.path AND (s.low IS NULL OR t.seq >= s.low) AND (s.high IS NULL OR t.seq < s.high) JOIN e ON t.seq = e.seq)
SELECT n.path, count(h.seq) AS total_commits, {LAST},
  round(coalesce(avg(CASE WHEN h.seq IS NULL THEN NULL WHEN lower(subject) LIKE '%hotfix%' THEN 1.0 ELSE 0.0 END), 0), 6) AS fix_commit_ratio, CASE WHEN count(h.seq) = 0 THEN '{history.NO_HISTORY}' END AS reason FROM n LEFT JOIN h USING (path) GROUP BY n.path""",
        "fuzzy_positions": f"""WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g'), chr(10)), lambda x: {NORM}), lambda x: x <> '') AS ls FROM documents),
c AS (SELECT doc_id, ls, CASE WHEN doc_id % 4 = 3 THEN ['nowhere to be found'] ELSE list_transform(ls[len(ls) // 2 + 1:len(ls) // 2 + 2], lambda x: CASE doc_id % 4 WHEN 0 THEN x[1:2] || 'Z' || x[3:] WHEN 1 THEN x[2:] ELSE x || ' end' END) END AS raw FROM d),
t AS (SELECT doc_id, ls, list_filter(list_transform(raw, lambda x: {NORM}), lambda x: x <> '') AS t FROM c)
SELECT doc_id, CAST(list_filter(range(1, CASE WHEN len(t) > 0 THEN len(ls) - len(t) + 2 ELSE 1 END), lambda i: list_sum(list_transform(range(1, len(t) + 1), lambda k: levenshtein(ls[i + k - 1], t[k]))) < {locate.FUZZY} * list_sum(list_transform(range(1, len(t) + 1), lambda k: greatest(len(ls[i + k - 1]), len(t[k])))))[1] AS INT) AS at FROM t""",
        "rules_from_table": r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+/?', ''), '[?#].*$', '') AS path FROM pages),
r AS (SELECT page_id, page_id % 3 AS layer, path AS own, page_id % 6 AS kind, regexp_extract(path, '^[^/]*') AS folder, regexp_extract(path, '/([0-9]+)', 1) AS stem FROM p),
q AS (SELECT DISTINCT path FROM p),
m AS (SELECT path, page_id, layer FROM q JOIN r ON CASE kind WHEN 0 THEN path = own WHEN 1 THEN regexp_matches(path, '^' || folder || '/[^/]*' || stem || '$') WHEN 2 THEN regexp_matches(path, '(^|/)' || stem || '$')
  WHEN 3 THEN regexp_matches(path, right(stem, 2) || '\.html$') WHEN 4 THEN regexp_matches(path, '^' || folder || '/' || left(stem, 1) || '[^/]*$') ELSE regexp_matches(path, '(^|/)' || stem || '\.html?$') END),
f AS (SELECT path, 'rule ' || arg_min(page_id, layer * 1000000000 + page_id) AS rule FROM m GROUP BY path)
SELECT page_id, path, rule FROM p LEFT JOIN f USING (path)""",
        "pack_one_group": f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, n_chars AS size, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id) AS i FROM documents),
r AS (SELECT doc_id, size, i, 0 AS bin, coalesce(size, 0) AS used FROM d WHERE i = 1 UNION ALL SELECT d.doc_id, d.size, d.i, CASE WHEN r.used + coalesce(d.size, 0) > {bundles.CAP} THEN r.bin + 1 ELSE r.bin END, CASE WHEN r.used + coalesce(d.size, 0) > {bundles.CAP} THEN coalesce(d.size, 0) ELSE r.used + coalesce(d.size, 0) END FROM r JOIN d ON d.i = r.i + 1)
SELECT doc_id, 'all' AS grp, size, bin, CAST(sum(coalesce(size, 0)) OVER (PARTITION BY bin) AS BIGINT) AS bin_size FROM r""",
        "search_expressions": f"WITH x AS MATERIALIZED (SELECT content FROM {LINES}) " + " UNION ALL ".join(outcomes),
        "indexed_search": f"WITH x AS MATERIALIZED (SELECT * FROM {LINES}) " + " UNION ALL ".join(f"SELECT {quoted(q)} AS query, doc_id, CAST(line AS INT) AS line, md5(content) AS content_md5 FROM x WHERE {matches[i]}" for i, q in enumerate(EXPRESSIONS) if 1 <= i <= 7),
        "indexed_reads": " UNION ALL ".join(
            f"SELECT {quoted(EXPRESSIONS[i])} AS query, count(*) FILTER ({' AND '.join('(' + ' OR '.join('(' + grams(s) + ')' for s in some) + ')' for some in NEEDED[i]) if i in NEEDED else 'true'}) AS files_read, count(*) AS files FROM documents" for i in range(1, 8)
        ),
    }
