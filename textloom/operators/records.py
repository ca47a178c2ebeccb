"""Manifests, history, links, secrets and linter output: text turned into rows, and what is asked of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import entropy, mask, norm_line, slashes
from textloom.operators import diffs

#: Words in a subject that make a commit a fix (fixed values).
FIXES = ("fix", "bug", "hotfix", "patch", "regression")
#: Extensions that a module's name may lack (fixed values).
MODULE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
#: Secrets by name; group 1 is the secret.
SECRETS = (
    ("cloud_access_key", r"\b(AKIA[0-9A-Z]{16})\b"),
    ("private_key", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)"),
    ("json_web_token", r"\b(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
    ("assigned_secret", r"(?i:api_key|token|password|secret)\s*[=:]\s*[\"']?([A-Za-z0-9_\-./+=]{8,})"),
)
#: String literals of at least this length and entropy (bits a character) are reported.
LITERAL, BITS = 20, 4.0


def package_json(path: Column, text: Column, files: DataFrame) -> DataFrame:
    """path, name, constraint: the four dependency sections, a later one overriding. A manifest that doesn't parse gives one row with a reason."""
    sections = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    parsed = F.from_json(text, ", ".join(f"{s} map<string,string>" for s in sections))
    none = F.array().cast("array<struct<key:string,value:string>>")

    def section(i: int) -> Column:
        return F.transform(F.coalesce(F.map_entries(parsed[sections[i]]), none), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("constraint"), F.lit(i).alias("ord")))

    entries = F.flatten(F.array(*[section(i) for i in range(len(sections))]))
    rows = files.select(path.alias("path"), F.explode(entries).alias("e")).select("path", "e.*")
    found = rows.groupBy("path", "name").agg(F.max_by("constraint", "ord").alias("constraint")).withColumn("reason", F.lit(None).cast("string"))
    bad = files.filter(F.try_parse_json(text).isNull()).select(path.alias("path"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("constraint"), F.lit("manifest can't be parsed").alias("reason"))
    return found.unionByName(bad)


#: A distribution's name: letters and digits at its ends, also ``-``, ``_`` and ``.`` between.
DISTRIBUTION = r"^[0-9A-Za-z](?:[-_.0-9A-Za-z]*[0-9A-Za-z])?"


def requirement(line: Column) -> Column:
    """struct<name, constraint> of a line of pip's requirement format; null for blank lines, comments, options and what has no name.

    A comment begins the line or follows white space; a marker follows a semicolon; extras are in
    brackets after the name. What is left is the constraint: versions, in parentheses or not, or ``@`` and an address.
    """
    bare = norm_line(F.get(F.split(norm_line(F.regexp_replace(line, r"(^|\s)#.*", "")), ";"), F.lit(0)))

    def of(l: Column) -> Column:
        name = F.regexp_extract(l, DISTRIBUTION, 0)
        rest = F.ltrim(F.substring(l, F.length(name) + 1, F.length(l)))
        extras = F.when(rest.startswith("["), F.locate("]", rest)).otherwise(0)
        said = F.when(rest.startswith("[") & (extras == 0), None).otherwise(norm_line(F.substring(rest, extras + 1, F.length(rest))))
        return F.when((name != "") & said.isNotNull(), F.struct(name.alias("name"), said.alias("constraint")))

    return F.get(F.transform(F.array(bare), of), F.lit(0))


def requirements_txt(path: Column, text: Column, files: DataFrame) -> DataFrame:
    """path, name, constraint of pip requirements; the last line of a name wins."""
    lines = files.select(path.alias("path"), F.posexplode(F.split(text, "\n", -1)).alias("p", "l"))
    return lines.select("path", "p", requirement(F.col("l")).alias("r")).filter("r is not null").groupBy("path", F.col("r.name").alias("name")).agg(F.max_by("r.constraint", "p").alias("constraint"))


def go_mod(path: Column, text: Column, files: DataFrame) -> DataFrame:
    """path, name, constraint of require lines and blocks; the last line of a module wins, lines of less than two words drop out.

    Whether a line is in a block is what the last opening or closing line before it says.
    """
    lines = files.select(path.alias("path"), F.posexplode(F.split(text, "\n", -1)).alias("p", "l")).withColumn("l", norm_line(F.col("l")))
    opens, closes = F.col("l").startswith("require ("), F.col("l") == ")"
    before = Window.partitionBy("path").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(before), F.lit(False))
    said = lines.withColumn("inside", inside).filter(~opens & ~(closes & F.col("inside")) & (F.col("inside") | F.col("l").startswith("require ")))
    words = F.split(norm_line(F.regexp_replace(F.when(F.col("inside"), F.col("l")).otherwise(F.expr("substring(l, 9)")), r"\s*//.*$", "")), r"\s+")
    return said.select("path", "p", words.alias("w")).filter("size(w) > 1").groupBy("path", F.get("w", F.lit(0)).alias("name")).agg(F.max_by(F.get("w", F.lit(1)), "p").alias("constraint"))


def manifest_format(path: Column) -> Column:
    """npm, pip or go by the file's name; null for others."""
    return F.when(path.endswith("package.json"), "npm").when(path.endswith("requirements.txt"), "pip").when(path.endswith("go.mod"), "go")


def manifest_entries(files: DataFrame) -> DataFrame:
    """path, name, constraint of manifests of any known format. ``files``: path, content."""
    own = lambda kind: files.filter(manifest_format(F.col("path")) == kind)
    parsed = [package_json(F.col("path"), F.col("content"), own("npm")).filter("name is not null").drop("reason"), requirements_txt(F.col("path"), F.col("content"), own("pip")), go_mod(F.col("path"), F.col("content"), own("go"))]
    return parsed[0].unionByName(parsed[1]).unionByName(parsed[2])


def dependency_diff(manifests: DataFrame) -> DataFrame:
    """path, name, change (added or removed), constraint and unpinned (of added names), reason.

    ``manifests``: path, before, after (contents; null or empty: not there). What has another
    constraint only is no change. A path of no known format, or without content after the
    change, is one row with a reason.
    """
    files = manifests.withColumn("path", slashes(F.col("path")))
    kind = manifest_format(F.col("path"))
    why = F.when(kind.isNull(), F.concat(F.lit("unsupported dependency manifest: "), "path")).when(F.coalesce(F.col("after"), F.lit("")) == "", F.concat(F.lit("could not read "), "path"))
    fine = files.filter(why.isNull())
    sides = [manifest_entries(fine.select("path", F.col(side).alias("content"))) for side in ("before", "after")]
    changed = snapshot_diff(*sides, ["path", "name"]).join(sides[1], ["path", "name"], "left")
    none = F.lit(None).cast("string")
    loose = F.when(F.col("change") == "added", F.coalesce(*[F.when(manifest_format(F.col("path")) == k, unpinned(F.col("constraint"), k)) for k in ("npm", "pip", "go")]))
    found = changed.select("path", "name", "change", "constraint", loose.alias("unpinned"), none.alias("reason"))
    return found.unionByName(files.filter(why.isNotNull()).select("path", none.alias("name"), none.alias("change"), none.alias("constraint"), F.lit(None).cast("boolean").alias("unpinned"), why.alias("reason")))


def unpinned(constraint: Column, kind: str = "npm") -> Column:
    v = F.trim(constraint)
    if kind == "npm":
        return v.isin("", "*", "latest") | (v.startswith(">=") & ~v.rlike("[<~^]"))
    return v == ("" if kind == "pip" else "latest")


def snapshot_diff(before: DataFrame, after: DataFrame, on: list[str]) -> DataFrame:
    """on, change (added or removed): what one snapshot has and the other hasn't."""
    a, b = before.select(*on).distinct(), after.select(*on).distinct()
    added = b.join(a, on, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(a.join(b, on, "left_anti").withColumn("change", F.lit("removed")))


def history_stats(commits: DataFrame, key: str, ts: str, subject: str) -> DataFrame:
    """key, total_commits, last_modified, fix_commit_ratio."""
    fix = F.lower(subject).rlike("|".join(FIXES))
    return commits.groupBy(key).agg(F.count("*").alias("total_commits"), F.max(ts).alias("last_modified"), F.avg(F.coalesce(fix, F.lit(False)).cast("double")).alias("fix_commit_ratio"))


def specifiers(text: Column) -> Column:
    """What stands between two quotes after an import, an export, their ``from``, or the parenthesis of a call to require or import; each once, as an array."""
    pieces = F.split(text, "[\"']", -1)
    stated = lambda before: before.rlike(r"(?s)(import|export)\s+([^\s].*\s+from\s+)?$")
    called = lambda before, after: before.rlike(r"(require|import)\s*\($|(require|import)\s*\(\s+$") & after.rlike(r"^\s*\)")

    def specifier(piece, i):
        before, after = F.get(pieces, i - 1), F.get(pieces, i + 1)
        return F.when((i > 0) & (piece != "") & after.isNotNull() & (stated(before) | called(before, after)), piece)

    return F.array_distinct(F.filter(F.transform(pieces, specifier), lambda x: x.isNotNull()))


def import_edges(files: DataFrame, path: str, text: str) -> DataFrame:
    """importer, specifier: each of ``specifiers`` of a file."""
    return files.select(F.col(path).alias("importer"), F.explode(specifiers(F.col(text))).alias("specifier"))


def module_place(importer: Column, specifier: Column) -> tuple[Column, Column]:
    """(the path that a relative specifier names, whether it may lack an extension)."""
    folder = F.regexp_replace(importer, r"/?[^/]*$", "")
    joined = F.concat_ws("/", F.when(folder != "", folder), specifier)
    parts = F.filter(F.split(joined, "/"), lambda x: ~x.isin("", "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when((x == "..") & (F.size(done) > 0), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))))
    return F.array_join(folded, "/"), ~specifier.rlike(r"\.[^./]+$")


def is_relative(specifier: Column) -> Column:
    return specifier.rlike(r"^\.{1,2}(/|$)")


def module_targets(importer: Column, specifier: Column) -> Column:
    """Every file that a relative specifier can mean; bare names are packages and have none."""
    whole, lacks = module_place(importer, specifier)
    variants = F.when(lacks, F.concat(F.array(whole), *[F.array(F.concat(whole, F.lit(e)), F.concat(whole, F.lit("/index" + e))) for e in MODULE_EXTENSIONS])).otherwise(F.array(whole))
    return F.when(is_relative(specifier), variants).otherwise(F.array().cast("array<string>"))


def module_paths(edges: DataFrame) -> DataFrame:
    """importer, target: every file that a relative specifier can mean."""
    return edges.select("importer", F.explode(module_targets(F.col("importer"), F.col("specifier"))).alias("target"))


def importers(targets: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """path, importers: sorted files that mean each target.

    A target is met by its path and, by specifiers that may lack an extension, by its path
    without one or without an index file's name: a row for each edge, not for each file that it
    can mean. Rows made from texts are more than a plan's estimate, so nothing may be broadcast.
    """
    whole, lacks = module_place(F.col("importer"), F.col("specifier"))
    named = edges.filter(is_relative(F.col("specifier"))).select("importer", whole.alias("_key"), lacks.alias("_lacks"))
    own, less = F.col(path), lambda end: F.substring(F.col(path), F.lit(1), F.length(path) - len(end))
    bare = [F.when(own.endswith(end), less(end)) for e in MODULE_EXTENSIONS for end in (e, "/index" + e)]
    known = F.concat(F.array(F.struct(own.alias("key"), F.lit(False).alias("bare"))), F.transform(F.array_compact(F.array(*bare)), lambda x: F.struct(x.alias("key"), F.lit(True).alias("bare"))))
    keyed = targets.select(own.alias("target"), F.explode(known).alias("_k"))
    met = keyed.join(named.hint("merge"), (F.col("_k.key") == F.col("_key")) & (~F.col("_k.bare") | F.col("_lacks")), "left")
    return met.groupBy("target").agg(F.array_sort(F.collect_set("importer")).alias("importers"))


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    return pages.select(key, F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1)))).alias("target"))


def added_lines(changes: DataFrame, key: str, diff: str) -> DataFrame:
    """key, path, line, content of the lines that diffs add."""
    rows = diffs.parse(changes, key, diff).filter("type = 'added'")
    return rows.select(key, F.col("new_path").alias("path"), F.col("new_no").cast("int").alias("line"), "content")


def scan_secrets(lines: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, line, pattern, matched (masked): known patterns, then literals of high entropy on lines without one."""

    def named(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(content, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(name).alias("pattern"), x.alias("secret")))

    known = F.flatten(F.array(*[named(*s) for s in SECRETS]))
    literals = F.filter(F.regexp_extract_all(content, F.lit(rf"[\"']([^\"'\s]{{{LITERAL},}})[\"']"), F.lit(1)), lambda x: entropy(x) > BITS)
    all_of = F.when(F.size(known) > 0, known).otherwise(F.transform(literals, lambda x: F.struct(F.lit("high_entropy").alias("pattern"), x.alias("secret"))))
    return lines.select(key, "line", F.explode(all_of).alias("s")).select(key, "line", "s.pattern", mask(F.col("s.secret")).alias("matched"))


#: Of each tool that writes lines: the severities that it names (none: all are warnings).
SEVERITIES = {"tsc": ("error", "warning", "info"), "go_vet": (), "clippy": ("error", "warning")}
FINDING = "array<struct<path: string, line: int, severity: string, message: string>>"


def lint_line(tool: str, text: Column) -> Column:
    """struct<path, line, severity, message> of a line; null if it isn't a finding.

    A finding's parts are divided by a colon and white space: the place, the severity (with a
    code, of tsc) where the tool names one, the message. The numbers end the place: after
    the last parenthesis for tsc, after the last colons for the others. Lines that begin with # are notes.
    """
    named = SEVERITIES[tool]
    part = F.split(text, r":\s+", 3 if named else 2)
    place, kind, message = F.get(part, F.lit(0)), F.split(F.get(part, F.lit(1)), r"\s+"), F.get(part, F.lit(2 if named else 1))
    if tool == "tsc":
        last = F.substring_index(place, "(", -1)
        number, ends = F.get(F.split(last, ","), F.lit(0)), last.rlike(r"^\d+,\d+\)$")
    elif tool == "clippy":
        last = F.substring_index(place, ":", -2)
        number, ends = F.get(F.split(last, ":"), F.lit(0)), last.rlike(r"^\d+:\d+$")
    else:
        last = F.substring_index(place, ":", -1)
        number, ends = last, last.rlike(r"^\d+$")
    path = F.substring(place, F.lit(1), F.length(place) - F.length(last) - 1)
    coded = (F.size(kind) == 2) & F.get(kind, F.lit(1)).rlike(r"^TS\d+$") if tool == "tsc" else F.size(kind) == 1
    fine = ends & (path != "") & ~path.startswith("#") & (message != "") & (coded & F.get(kind, F.lit(0)).isin(*named) if named else F.lit(True))
    severity = F.get(kind, F.lit(0)) if named else F.lit("warning")
    return F.when(F.coalesce(fine, F.lit(False)), F.struct(slashes(path).alias("path"), number.cast("int").alias("line"), severity.alias("severity"), message.alias("message")))


def lint_lines(output: DataFrame, tool: str, content: str = "content") -> DataFrame:
    """``output`` (a line each) with path, line, severity, message, tool of the lines in the tool's format."""
    found = output.withColumn("_f", lint_line(tool, F.col(content))).filter("_f is not null")
    return found.withColumns({c: F.col(f"_f.{c}") for c in ("path", "line", "severity", "message")} | {"tool": F.lit(tool)}).drop("_f")


def lint_items(tool: str, content: Column) -> Column:
    """All findings of what a tool said, as an array; text that doesn't parse gives none."""
    text = lambda message, code: F.concat(F.coalesce(message, F.lit("")), F.coalesce(F.concat(F.lit(" ("), F.when(code != "", code), F.lit(")")), F.lit("")))
    item = lambda path, line, severity, message: F.struct(slashes(F.coalesce(path, F.lit(""))).alias("path"), F.coalesce(line, F.lit(0)).alias("line"), severity.alias("severity"), message.alias("message"))
    if tool == "eslint":
        files = F.from_json(content, "array<struct<filePath string, messages array<struct<line int, severity int, message string, ruleId string>>>>")
        level = lambda m: F.when(m["severity"] == 2, "error").when(m["severity"] == 1, "warning").otherwise("info")
        return F.flatten(F.transform(files, lambda f: F.transform(F.coalesce(f["messages"], F.array()), lambda m: item(f["filePath"], m["line"], level(m), text(m["message"], m["ruleId"])))))
    if tool == "ruff":
        found = F.from_json(content, "array<struct<filename string, code string, message string, location struct<row int>>>")
        return F.transform(found, lambda m: item(m["filename"], m["location"]["row"], F.lit("warning"), text(m["message"], m["code"])))
    return F.filter(F.transform(F.split(content, "\n", -1), lambda x: lint_line(tool, x)), lambda x: x.isNotNull())


def lint_json(output: DataFrame, tool: str, content: str) -> DataFrame:
    """path, line, severity, message, tool of eslint's or ruff's JSON; text that doesn't parse gives no rows."""
    return output.select(F.explode(lint_items(tool, F.col(content))).alias("f")).select("f.*", F.lit(tool).alias("tool"))


def lint_findings(output: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """path, line, severity, message, tool of all tools' output, in one pass. ``output``: tool, content (all that it said); unknown tools give nothing."""
    items = F.coalesce(*[F.when(F.col("tool") == t, lint_items(t, F.col("content")).cast(FINDING)) for t in ("eslint", "ruff", *SEVERITIES)])
    return findings_of(output.select("tool", F.explode(items).alias("f")).select("f.*", "tool"), files)


#: Files at the root of a repository that tell which linters it uses (fixed values).
LINTER_FILES = {
    "eslint": ("eslint.config.js", "eslint.config.mjs", "eslint.config.cjs", ".eslintrc.js", ".eslintrc.cjs", ".eslintrc.json", ".eslintrc.yml", ".eslintrc.yaml"),
    "tsc": ("tsconfig.json",), "ruff": ("ruff.toml", ".ruff.toml", "pyproject.toml"), "go_vet": ("go.mod",), "clippy": ("Cargo.toml",),
}


def applicable_linters(files: DataFrame, repo: str, path: str) -> DataFrame:
    """repo, tools (in fixed order), reason (why there is none) of each repository with files."""
    has = [F.bool_or(F.col(path).isin(*names)).alias(tool) for tool, names in LINTER_FILES.items()]
    tools = F.array_compact(F.array(*[F.when(F.col(t), t) for t in LINTER_FILES]))
    return files.groupBy(repo).agg(*has).select(repo, tools.alias("tools"), F.when(F.size(tools) == 0, "no known lint/typecheck configuration detected").alias("reason"))


def test_scripts(manifests: DataFrame, repo: str, content: str) -> DataFrame:
    """repo, script, reason: the test script that a package.json declares, or why there is none. Null content: no such file."""
    text = F.col(content)
    script = F.get_json_object(text, "$.scripts.test")
    reason = F.when(text.isNull(), "no package.json found in repo root").when(F.try_parse_json(text).isNull(), "package.json is not valid JSON").when(F.coalesce(script, F.lit("")) == "", "no scripts.test defined in package.json")
    return manifests.select(repo, F.when(reason.isNull(), script).alias("script"), reason.alias("reason"))


def findings_of(findings: DataFrame, files: DataFrame | None) -> DataFrame:
    """Only findings in the files asked for; all, if none are asked for. The files meet by shuffle, repeated as they are: to tell them apart before it would be a table of all in one task's memory."""
    return findings if files is None else findings.join(files.select("path").hint("merge"), "path", "left_semi")
