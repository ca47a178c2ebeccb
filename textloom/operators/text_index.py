"""Search of a corpus through an index of three-byte grams.

Files are numbered and kept in blocks of ``BLOCK``, a folder each. For every block and gram
of UTF-8 bytes the index holds which of its files have the gram (a posting list; runs of one
block that different tasks saw have lists of their own). A search asks the expression's tree
what every match must hold, turns that into a boolean query of grams, answers it within each
block by intersections and unions of lists, and verifies the candidates as a scan would: the
same rows, from fewer texts. Only lists of the query's grams are read (the filter goes down to
the Parquet files, which are in order of gram), and only the folders of blocks that have
candidates, where Spark can prune them while it runs.

Defined results: a null, empty or binary text (a NUL in its first 8000 characters) is in the
index as a file that has no match; an expression that asks for no gram is a scan; an invalid
or empty one has no rows; repeated rows are files of their own; an empty table is an index
without matches. The index is written once, and is complete when ``build`` returns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import ere
from textloom.operators import lines
from textloom.session import materialise

#: Files of a block; bytes of text whose grams one step holds.
BLOCK, STEP_BYTES = 16_384, 8 << 20


def _grams(text: bytes) -> np.ndarray:
    """The distinct grams of a text's lines."""
    b = np.frombuffer(text, np.uint8).astype(np.int32)
    found = np.unique((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) if len(b) > 2 else np.empty(0, np.int32)
    return found[((found & 0xFF) != 10) & ((found >> 8 & 0xFF) != 10) & (found >> 16 != 10)]


def _postings(batches):
    def lists(block: int, rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        gram = np.concatenate([g for _, g in rows])
        place = np.repeat(np.array([p for p, _ in rows], np.int32), [len(g) for _, g in rows])
        order = np.argsort(gram, kind="stable")
        gram, place = gram[order], place[order]
        start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.empty(0, np.int64)
        offsets = pa.array(np.concatenate([start, [len(gram)]]).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(start), block, np.int64)), pa.array(gram[start]), pa.ListArray.from_arrays(offsets, pa.array(place))], names=["block", "gram", "places"])

    rows, block, held = [], None, 0
    for batch in batches:
        texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
        for own, place, text in zip(batch.column("block").to_pylist(), batch.column("place").to_pylist(), texts, strict=True):
            if rows and (own != block or held > STEP_BYTES):
                yield lists(block, rows)
                rows, held = [], 0
            data = text.as_py()
            block, held = own, held + len(data)
            rows.append((place, _grams(data)))
    if rows:
        yield lists(block, rows)


def build(files: DataFrame, key: str, text: str, folder: str, block: int = BLOCK) -> None:
    """Writes the index of ``files`` into a folder that all executors share. What the index is searched for is ``key``."""
    numbered = materialise(files.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("id", F.monotonically_increasing_id()), "numbered")
    numbered = numbered.select(F.floor(F.col("id") / block).alias("block"), (F.col("id") % block).cast("int").alias("place"), "key", "text")
    numbered.limit(0).write.parquet(f"{folder}/columns")
    # blocks are runs of numbers, which tasks read in order: a task writes to few folders
    numbered.write.partitionBy("block").parquet(f"{folder}/files")
    told = numbered.select("block", "place", F.when(lines.is_text(F.col("text")), F.col("text")).alias("text"))
    told.mapInArrow(_postings, "block long, gram int, places array<int>").sortWithinPartitions("gram").write.parquet(f"{folder}/grams")


def indexed_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{folder}/columns").schema).parquet(f"{folder}/files")


def _leaves(query: tuple) -> set[int]:
    return {query[1]} if query[0] == "gram" else set().union(*[_leaves(x) for x in query[1:]])


def candidates(spark: SparkSession, folder: str, query: str) -> DataFrame | None:
    """block, place of the files that hold all that a match needs; None if that is all files. ``query`` is a valid expression."""
    wanted = ere.grams(ere.held(ere.parse(query)))
    if wanted == ere.ANYTHING:
        return None
    leaves = sorted(_leaves(wanted))

    def of(node: tuple) -> Column:
        if node[0] == "gram":
            return F.col(f"g{leaves.index(node[1])}")
        out = of(node[1])
        for part in node[2:]:
            out = F.array_intersect(out, of(part)) if node[0] == "and" else F.array_union(out, of(part))
        return out

    told = spark.read.parquet(f"{folder}/grams").filter(F.col("gram").isin(leaves))
    held = told.groupBy("block").agg(*[F.flatten(F.collect_list(F.when(F.col("gram") == g, F.col("places")))).alias(f"g{i}") for i, g in enumerate(leaves)])
    return held.select("block", F.explode(of(wanted)).alias("place"))


def indexed_search(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """key, line, content: what ``lines.search`` finds in the files, from the candidates alone."""
    files = indexed_files(spark, folder)
    if not query or ere.compile_ere(query)[0] is None:
        return lines.search(files, "key", "text", query)
    found = candidates(spark, folder, query)
    if found is not None:  # as a table, whose size Spark knows when it chooses the join and prunes folders
        files = files.join(materialise(found, "candidates").filter("place >= 0"), ["block", "place"])
    return lines.search(files, "key", "text", query)


def reads(spark: SparkSession, folder: str, queries: list[str]) -> DataFrame:
    """query, files_read, files: how many texts each search verifies, of how many."""
    every = indexed_files(spark, folder).agg(F.count("*").alias("files"))
    out = None
    for query in queries:
        valid = query and ere.compile_ere(query)[0] is not None
        found = candidates(spark, folder, query) if valid else None
        one = found.agg(F.count("*").alias("files_read")) if found is not None else None
        row = every.select(F.lit(query).alias("query"), (F.col("files") if valid else F.lit(0).cast("long")).alias("files_read"), "files") if one is None else one.withColumn("k", F.lit(1)).join(every.withColumn("k", F.lit(1)), "k").select(F.lit(query).alias("query"), "files_read", "files")
        out = row if out is None else out.unionByName(row)
    return out
