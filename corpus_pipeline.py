"""The corpus pipeline: language ID, line dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next one's docs; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import language_id, line_dedup, mixing, ngram_join, packing
from textloom.session import discard, materialise, table

#: Near-duplicate stage: words of a shingle, and the least similarity.
SHINGLE, SIMILAR = 5, (80, 100)


#: Columns that operators add, which a document's own of such a name must not meet.
ADDED = {*language_id.ADDED, "n_lines", "n_removed"}


def apart(docs: DataFrame) -> DataFrame:
    """``docs`` whose columns of operators' names are called something else meanwhile."""
    return docs.withColumnsRenamed({c: f"own {c}" for c in docs.columns if c in ADDED})


def back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from what an operator made of ``apart``."""
    return rows.select(*[F.col(f"`own {c}`").alias(c) if c in ADDED else F.col(c) for c in docs.columns])


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language ID rejects."""
    return back(language_id.identify(apart(docs)).filter("not rejected"), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines above the boilerplate ratio within their source; every document stays."""
    return back(line_dedup.drop_boilerplate(apart(docs), "text", F.col("source")).withColumn("n_chars", F.length("text").cast("long")), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked ones: that of the smallest id."""
    return ngram_join.keep_one(docs, SIMILAR, SHINGLE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length."""
    return packing.pieces(docs)


STAGES = [("language_id", detect_language), ("line_dedup", drop_lines), ("ngram_join", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]

#: Language models and the subword vocabulary can't be expressed in SQL; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:  # nothing reads it any more
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
