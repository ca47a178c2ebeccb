"""Which files are looked at, and which rule holds for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.patterns import any_glob, glob_regex
from textloom.functions.text import slashes

#: Extensions of binary files (fixed values).
BINARY = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg",
    ".zip", ".tar", ".gz", ".tgz", ".bz2", ".7z", ".rar",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".exe", ".dll", ".so", ".dylib", ".class", ".jar", ".war", ".wasm",
    ".mp3", ".mp4", ".avi", ".mov", ".webp",
    ".ttf", ".otf", ".woff", ".woff2", ".eot",
)
#: Globs that are left out by default: these (fixed values) and the binary extensions.
LEFT_OUT = ("**/*.lock", "**/package-lock.json", "**/yarn.lock", "**/pnpm-lock.yaml", "**/*.min.js", "**/*.min.css", "**/*.map", *(f"**/*{e}" for e in BINARY))
#: Files by language or format (fixed patterns), with texts of our own.
LANGUAGE_RULES = (
    ("**/*.{ts,tsx,js,jsx,mjs,cjs}", "scripts: check awaited calls, nullish values and equality"),
    ("**/package.json", "package manifest: check added and unpinned dependencies"),
    ("**/*.json", "data file: check syntax and duplicate keys"),
    ("**/*.{yaml,yml}", "settings: check indentation, types and anchors"),
    (".github/workflows/**", "workflow: check permissions, pinned steps and secrets"),
    ("**/*.py", "python: check mutable defaults, exceptions and resource use"),
    ("**/*.go", "go: check errors, goroutines and contexts"),
    ("**/*.java", "java: check nulls, streams and locks"),
    ("**/*.{c,h,cpp,cc,cxx,c++,hpp,hh,hxx,h++}", "native code: check bounds, ownership and overflow"),
    ("**/*.rs", "rust: check unsafe blocks, unwraps and lifetimes"),
    ("**/*.qml", "interface: check bindings and signals"),
    ("**/*.xml", "markup: check namespaces and entities"),
    ("**/Dockerfile*", "image: check base images, users and layers"),
)
GENERIC_RULE = "any file: check correctness, clarity and tests"


def is_binary_path(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(?:" + "|".join(e[1:] for e in BINARY) + ")$")


def drop_reason(path: Column, exclude=LEFT_OUT, include=()) -> Column:
    """binary, excluded, not_included, or null for a file that stays; tested in that order."""
    path = slashes(path)
    reason = F.when(is_binary_path(path), "binary").when(path.rlike(any_glob(exclude)), "excluded")
    return reason.when(~path.rlike(any_glob(include)), "not_included") if include else reason


def merge_config(repo: dict | None, home: dict | None) -> tuple[list[str], list[str]]:
    """(exclude, include): default, home and own exclusions together; own inclusions, else those of home."""
    repo, home = repo or {}, home or {}
    exclude = list(dict.fromkeys([*LEFT_OUT, *home.get("exclude", []), *repo.get("exclude", [])]))
    return exclude, list(repo.get("include") if repo.get("include") is not None else home.get("include") or [])


def rule_for(path: Column, repo=(), home=(), language=LANGUAGE_RULES, generic: str = GENERIC_RULE) -> Column:
    """The rule of the first pattern that matches: own rules, then those of home, of the language, and the generic one."""
    path = slashes(path)
    found = [F.when(path.rlike(glob_regex(pattern)), F.lit(rule)) for pattern, rule in [*repo, *home, *language]]
    return F.coalesce(*found, F.lit(generic))


def rule_join(paths: DataFrame, rules: DataFrame, path: str) -> DataFrame:
    """Rules as data: ``rules`` has layer, ord, regex, rule; the first by (layer, ord) wins. A rule table is small by nature; its size decides how it is joined."""
    joined = paths.join(rules, F.expr(f"replace({path}, '\\\\', '/') rlike regex"), "left")
    return joined.groupBy(*paths.columns).agg(F.min_by("rule", F.struct("layer", "ord")).alias("rule"))
