"""Mixing sources to target weights by systematic sampling (native: no Python on the executors).

Every document expects ``target / source_size`` copies. Within its source the expected
copies are summed in a fixed order, one random offset is added, and a document comes out
once for each integer that its step of the running sum crosses. The order is by size
class, so the sampled words follow the target closely at every size.

The running sum needs no task that holds a whole source: a source is cut into buckets
(size class, hash), counts per bucket are summed first, and each bucket then continues
from its own start.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; documents of equal size are ordered by a hash of their id, then the id; repeated
rows each have their own step; a null doc_id is taken for 0 in the order; a very long text
only moves as part of its row; an empty table gives an empty table; ``mix_documents`` carries
all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.session import materialise, table

#: Weights of the sources in order of their name, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a multiple of all words.
SHARE = 1.5
#: Copies of a source, and so of a document, at most.
MOST = 2
#: Hash buckets of one size class of a source.
BUCKETS = 64
SEED = 20_011
#: Modulus and multipliers of the Lehmer generators used as hashes; both SQL dialects can compute them.
PRIME, STEP, STEP2 = 2_147_483_647, 48_271, 16_807

WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "source_size", "target", "copies", "taken")


def id_hash(doc_id: Column) -> Column:
    return F.pmod(F.pmod(F.coalesce(doc_id, F.lit(0)).cast("long"), F.lit(PRIME)) * F.lit(STEP) + F.lit(SEED), F.lit(PRIME))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Targets of all sources: ``least(most * source_size, level * weight)`` with the level that makes them sum to the share.

    Sharing the excess of capped sources by weight, until none is above its cap, ends at
    that level; it is found by going through the sources in order of cap / weight.
    ``sizes``: source, source_size.
    """
    every = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("ord") - 1, F.lit(len(weights))) + 1).cast("int"))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("ratio", "ord").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("ord", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())).cast("long"))
        .withColumn("weight", weight.cast("double"))
        .withColumn("cap", (F.col("source_size") * most).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(every))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("level", (F.col("all_words") * F.lit(float(share)) - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))))
        .withColumn("level", F.coalesce(F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "ord", "level"))).over(every)["level"], F.max("ratio").over(every)))
        .withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
        .withColumn("offset", F.pmod(F.pmod(F.col("ord") + F.lit(seed), F.lit(PRIME)) * F.lit(STEP * STEP2 % PRIME), F.lit(PRIME)) / F.lit(float(PRIME)))
        .select("source", "source_size", "target", "offset")
    )


def mix_counts(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, keep: tuple = ()) -> DataFrame:
    """One row per document: doc_id, source, ``keep``, size, source_size, target, copies, taken."""
    bits = F.length(F.bin("size"))
    rows = materialise(
        docs.select("doc_id", "source", *keep, F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"))
        .withColumn("size", F.coalesce("size", F.lit(0).cast("long")))
        .withColumn("src", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")))  # never null, so that rows are dealt by it once for the window and the join
        .withColumn("h", id_hash(F.col("doc_id")))
        .withColumn("cls", bits * 8 + F.expr("shiftright(size * 8, length(bin(size)))").cast("int"))
        .withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int")),
        "mix",
    )
    cells = rows.groupBy("source", "src", "cls", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    targets = source_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most, seed)
    before = Window.partitionBy("src").orderBy("cls", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        cells.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .select("src", "cls", "bucket", "start")
        .join(targets.withColumn("src", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))).drop("source"), "src")
    )
    within = Window.partitionBy("src", "cls", "bucket").orderBy("size", "h", "doc_id")
    step = F.col("target") / F.col("source_size")
    crossed = lambda i: F.floor(i * F.col("step") + F.col("offset"))
    return (
        rows.withColumn("i", F.row_number().over(within))
        .join(cells, ["src", "cls", "bucket"])
        .withColumn("i", F.col("i") + F.col("start"))
        .withColumn("step", F.when(F.col("source_size") > 0, step).otherwise(0.0))
        .withColumn("copies", F.least(crossed(F.col("i")) - crossed(F.col("i") - 1), F.lit(most)).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("doc_id", "source", *keep, "size", "source_size", "target", "copies", "taken")
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as it has copies, with the columns of ``docs``."""
    names = [c for c in docs.columns if c not in ("doc_id", "source")]
    safe = {c: f"_{i}_{c}" for i, c in enumerate(names)}
    held = docs.select("doc_id", "source", "text", *[F.col(c).alias(safe[c]) for c in names if c != "text"]) if "text" in names else docs
    out = mix_counts(held, keep=tuple(("text" if c == "text" else safe[c]) for c in names), **options)
    out = out.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(c if c in ("doc_id", "source", "text") else safe[c]).alias(c) for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def counts_sql(documents: str = "documents") -> str:
    """DuckDB: doc_id, source, size, source_size, target, copies, taken of every row of ``documents``."""
    return rf"""
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM (
 SELECT *, least(CAST(floor(i * step + u) - floor((i - 1) * step + u) AS BIGINT), {MOST}) AS copies FROM (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.u,
   CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS step,
   CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.cls, d.h % {BUCKETS}, d.size, d.h, d.doc_id) AS DOUBLE) AS i
  FROM (
   SELECT doc_id, source, size, length(bin(size)) * 8 + ((size * 8) >> CAST(length(bin(size)) AS BIGINT)) AS cls,
    ((((coalesce(doc_id, 0) % {PRIME} + {PRIME}) % {PRIME}) * {STEP} + {SEED}) % {PRIME}) AS h
   FROM (SELECT doc_id, source, coalesce(CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT), 0) AS size FROM {documents})
  ) d JOIN (
   SELECT source, CAST(source_size AS BIGINT) AS source_size, u, least(cap, weight * coalesce((SELECT arg_min(level, (ratio, ord)) FROM lv WHERE ratio > level), (SELECT max(ratio) FROM lv))) AS target
   FROM (SELECT * FROM lv)
  ) t ON d.source IS NOT DISTINCT FROM t.source
 )
)"""


def levels_sql(documents: str = "documents") -> str:
    """DuckDB: the CTE ``lv`` that ``counts_sql`` reads."""
    return rf"""lv AS (
 SELECT *, (all_words * {SHARE}::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (all_weight - coalesce(sum(weight) OVER (ORDER BY ratio, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
 FROM (SELECT *, cap / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) AS all_words, sum(weight) OVER () AS all_weight,
   (((ord + {SEED}) % {PRIME}) * {STEP * STEP2 % PRIME}) % {PRIME} / {PRIME}.0::DOUBLE AS u
  FROM (SELECT source, source_size, CAST(source_size * {MOST} AS DOUBLE) AS cap, ord, CAST(list_extract([{", ".join(map(str, WEIGHTS))}], (ord - 1) % {len(WEIGHTS)} + 1) AS DOUBLE) AS weight
   FROM (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS ord
    FROM (SELECT source, coalesce(CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT), 0) AS size FROM {documents}) GROUP BY source))))"""


def oracle_sql() -> str:
    return f"WITH {levels_sql()} SELECT doc_id, size, source_size, target, taken FROM ({counts_sql()})"
