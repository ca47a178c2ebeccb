"""Joins by order and by range: the last row before, and all points within ranges.

Neither gathers a key's rows. The as-of join cuts each key's positions into bins: within a bin
a window finds the last answer, and what a bin has from earlier bins is a running value over
one row per bin. The range join files each range under the smallest bin size that is at least
its length, so it lies in two bins at most, and each point under one bin of every size; they
meet by equality and are checked exactly, and no pair comes twice.

Defined results: a null key or position meets nothing; of answers at one position the smallest
value counts; an ask without an answer comes back with null; a range whose end is before its
start holds nothing; repeated rows are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a bin of the as-of join; bin sizes of the range join.
WIDTH, SIZES = 4096, (1 << 6, 1 << 11, 1 << 16, 1 << 24, 1 << 62)


def asof(asks: DataFrame, answers: DataFrame, on: list[str], ask_at: str, at: str, value: str, name: str, strict: bool = False, forward: bool = False, width: int = WIDTH) -> DataFrame:
    """``asks`` with ``name``: the value of the last of the answers with equal keys at or before the ask (``strict``: before); ``forward``: the first at or after."""
    keys = [f"_k{i}" for i in range(len(on))]
    place = lambda c: (-F.col(c) if forward else F.col(c)).cast("long").alias("_at")
    kind = answers.select(value).schema[0].dataType
    told = answers.filter(F.col(at).isNotNull()).groupBy(*[F.col(c).alias(k) for c, k in zip(on, keys, strict=True)], place(at)).agg(F.min(value).alias("_value"))
    rows = asks.select(*[F.col(c).alias(k) for c, k in zip(on, keys, strict=True)], place(ask_at), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(asks.columns)]).alias("_ask"))
    none = F.lit(None)
    both = rows.withColumn("_value", none.cast(kind)).unionByName(told.withColumn("_ask", none.cast(rows.schema["_ask"].dataType)).select(*keys, "_at", "_ask", "_value"))
    both = both.withColumn("_bin", F.floor(F.col("_at") / width)).withColumn("_side", (F.col("_ask").isNull() if strict else F.col("_ask").isNotNull()).cast("int"))
    own = both.withColumn("_own", F.last("_value", ignorenulls=True).over(Window.partitionBy(*keys, "_bin").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)))
    bins = both.groupBy(*keys, "_bin").agg(F.max_by("_value", F.when(F.col("_ask").isNull(), F.col("_at"))).alias("_last"))
    bins = bins.withColumn("_carried", F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    found = own.filter("_ask is not null").join(bins, [*keys, "_bin"], "left").withColumn("_found", F.when(known & F.col("_at").isNotNull(), F.coalesce("_own", "_carried")))
    return found.select(*[F.col("_ask")[f"c{i}"].alias(c) for i, c in enumerate(asks.columns)], F.col("_found").alias(name))


def range_join(points: DataFrame, ranges: DataFrame, on: list[str], at: str, low: str, high: str, sizes: tuple = SIZES) -> DataFrame:
    """point, range: a struct each, of every pair with equal keys and the point within the range, ends included."""
    keys = [f"_k{i}" for i in range(len(on))]
    of = lambda df, name, *more: df.select(*[F.col(c).alias(k) for c, k in zip(on, keys, strict=True)], F.struct(*df.columns).alias(name), *more)
    p = of(points, "point", F.col(at).cast("long").alias("_at"), F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.floor(F.col(at).cast("long") / s).alias("bin")) for i, s in enumerate(sizes)])).alias("_b"))
    length, level = F.col(high) - F.col(low), None
    for i, s in reversed(list(enumerate(sizes))):
        own = F.struct(F.lit(i).alias("level"), F.lit(s).alias("size"))
        level = own if level is None else F.when(length < s, own).otherwise(level)
    r = of(ranges.filter(F.col(low) <= F.col(high)), "range", F.col(low).cast("long").alias("_low"), F.col(high).cast("long").alias("_high"), level.alias("_l"))
    r = r.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_low") / F.col("_l.size")), F.floor(F.col("_high") / F.col("_l.size")))))
    met = p.select(*keys, "point", "_at", F.col("_b.level").alias("_level"), F.col("_b.bin").alias("_bin")).join(r.select(*keys, "range", "_low", "_high", F.col("_l.level").alias("_level"), "_bin"), [*keys, "_level", "_bin"])
    return met.filter(F.col("_at").between(F.col("_low"), F.col("_high"))).select("point", "range")
