"""Line dedup by site-relative frequency (native: no Python on the executors).

Pages are grouped by host. A line's frequency is the number of the host's pages that
contain it over all pages of the host; a line above the boilerplate ratio, on at least
``min_pages`` pages, is dropped from every page of that host.

Only (host, hash of line) pairs are shuffled, summed on the map side first, so a host
with a third of all pages costs no task more than its share. A host's boilerplate lines
number at most (mean distinct lines of its pages) / ratio, so they fit in an array; pages
never move unless the arrays of all hosts together outgrow ``broadcast_bytes``.

Defined results: a null or empty text has no lines and stays as it is; blank lines are
neither counted nor dropped; a line repeated within a page counts once; a line exactly at
the ratio stays; repeated rows are pages of their own; a null host is a host of its own,
another than the empty one; a very long text is one array of lines in its row's task; an
empty table gives an empty table; columns named n_lines and n_removed are replaced, all
others come back as they were, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import materialise, table

#: Share of a host's pages above which a line is boilerplate.
RATIO = 0.3
#: Pages on which a line must stand to be boilerplate at all: two, the fewest that have it in common.
MIN_PAGES = 2
#: The hosts' arrays of boilerplate lines are broadcast up to this size, joined by shuffle beyond it.
BROADCAST_BYTES = 16 << 20
#: Parts that the pages of one host are dealt over if they have to be shuffled.
SALTS = 64

#: Elements after whose end tag a line of HTML ends.
BLOCKS = ("title", "style", "script", "head", "p", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "div", "nav", "article", "section", "header", "footer", "tr", "table", "body")
BREAK = rf"(</(?:{'|'.join(BLOCKS)})>|<br ?/?>)"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
BLANK = r"^[\x20\x09-\x0D]*$"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def html_lines(html: Column) -> Column:
    """One line per block element."""
    return F.regexp_replace(html, BREAK, "$1\n")


def drop_boilerplate(pages: DataFrame, text: str, host: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with ``text`` cleaned, and with n_lines and n_removed (blank lines not counted)."""
    names = [c for c in pages.columns if c not in ("n_lines", "n_removed")]
    lines = lambda c: F.split(c, "\n", -1)
    full = lambda c: F.filter(c, lambda x: ~x.rlike(BLANK))
    # the host is read before the columns go into a struct, where no name of theirs can clash with the operator's own;
    # a letter before it tells a null host from an empty one
    own = pages.select(F.coalesce(F.concat(F.lit("h"), host), F.lit("")).alias("_host"), F.col(text).alias("_text"), F.struct(F.lit(0).alias("none"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(names) if c != text]).alias("_row"))
    totals = own.groupBy("_host").agg(F.count("*").alias("_pages"))
    found = (
        own.select("_host", F.explode(F.array_distinct(F.transform(full(lines(F.col("_text"))), lambda x: F.xxhash64(x)))).alias("_line"))
        .groupBy("_host", "_line").agg(F.count("*").alias("_on"))
        .filter(F.col("_on") >= min_pages)
    )
    hosts = materialise(
        found.join(totals, "_host").filter(F.col("_on") > F.col("_pages") * F.lit(ratio)).groupBy("_host").agg(F.collect_list("_line").alias("_drop")),
        "boilerplate",
    )
    weight = hosts.agg(F.sum(F.size("_drop") * 8 + F.length("_host") + 64)).first()[0] or 0
    if weight <= broadcast_bytes:
        joined = own.join(F.broadcast(hosts), "_host", "left")
    else:
        salted = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = own.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, ["_host", "_salt"], "left")
    gone = lambda x: F.array_contains(F.col("_drop"), F.xxhash64(x)) & ~x.rlike(BLANK)
    touched = F.col("_drop").isNotNull() & F.col("_text").isNotNull()
    out = (
        joined.withColumn("_kept", F.when(touched, F.filter(lines(F.col("_text")), lambda x: ~gone(x))))
        .withColumn("_lines", F.when(F.col("_text").isNull(), 0).otherwise(F.size(full(lines(F.col("_text"))))).cast("long"))
        .withColumn("_removed", F.when(touched, F.col("_lines") - F.size(full(F.col("_kept")))).otherwise(0).cast("long"))
        .withColumn("_clean", F.when(touched, F.array_join("_kept", "\n")).otherwise(F.col("_text")))
    )
    return out.select(*[(F.col("_clean") if c == text else F.col("_row")[f"c{i}"]).alias(c) for i, c in enumerate(names)], F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html_lines(F.col("html")).alias("html"))
    host = host_of(F.col("url"))
    return drop_boilerplate(pages, "html", host).select("page_id", host.alias("host"), "n_lines", "n_removed", F.md5("html").alias("kept_md5"))


def oracle_sql() -> str:
    blank = BLANK
    return rf"""
WITH p AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host, regexp_replace(html, '{BREAK}', '\1' || chr(10), 'g') AS html, row_number() OVER () AS r FROM pages),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
l AS (SELECT r, host, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS i FROM p),
f AS (SELECT host, line, count(DISTINCT r) AS n FROM l WHERE NOT regexp_matches(line, '{blank}') GROUP BY host, line),
b AS (SELECT host, line FROM f JOIN t USING (host) WHERE n >= {MIN_PAGES} AND n > pages * {RATIO}::DOUBLE),
k AS (SELECT r, count(*) FILTER (NOT regexp_matches(l.line, '{blank}')) AS n_lines, count(b.line) AS n_removed,
  coalesce(string_agg(l.line, chr(10) ORDER BY i) FILTER (b.line IS NULL), '') AS kept FROM l LEFT JOIN b ON l.host = b.host AND l.line = b.line GROUP BY r)
SELECT page_id, host, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CASE WHEN html IS NULL THEN NULL ELSE md5(kept) END AS kept_md5 FROM p LEFT JOIN k USING (r)"""
