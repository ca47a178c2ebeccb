"""Grouping of files into bundles of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import change_density, get_ext, strip_ext, strip_locale
from textloom.operators import ranges
from textloom.operators.running import placed
from textloom.session import materialise

#: Characters of a bundle.
CAP = 20_000
#: Files of a group up to which it is folded as an array; files of a block of a larger one.
HOT, BLOCK = 2000, 32_768
#: No bin follows.
END = 1 << 62


def fold_bins(sizes: Column, cap: int = CAP) -> Column:
    """Bin of each size, in order: a bin that isn't empty closes when the next would not fit; a larger one is alone."""
    start = F.struct(F.lit(-1).alias("bin"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("bins"))

    def step(state, size):
        opens = (state["bin"] < 0) | (state["used"] + size > cap)
        number = F.when(opens, state["bin"] + 1).otherwise(state["bin"])
        return F.struct(number.alias("bin"), F.when(opens, size).otherwise(state["used"] + size).cast("long").alias("used"), F.concat(state["bins"], F.array(number)).alias("bins"))

    return F.aggregate(F.transform(sizes, lambda x: x.cast("long")), start, step, lambda s: s["bins"])


def _folded(files: DataFrame, group: list[str], size: str, order: list[Column], cap: int) -> DataFrame:
    """c0, c1 ... (the columns of ``files``), _size, _g, bin of groups that fit in an array: the fold goes through order and size of each file, which are then known by their place.

    Columns stay columns, so that what a caller doesn't read isn't carried.
    """
    keys = [f"_g{i}" for i in range(len(group))]
    amount = F.coalesce(F.col(size), F.lit(0)).cast("long")
    # found twice, for the sizes and for the rows: of equal order, files of equal size can stand for each other
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order, amount))
    own = [F.col(c).alias(f"c{i}") for i, c in enumerate(files.columns)]
    placed = files.select(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], *own, amount.alias("_size"), at.alias("_at"))
    sizes = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", F.col("_size").alias("size")))).alias("_items"))
    folded = sizes.select(*[F.col(k).alias(f"{k}_") for k in keys], F.explode(F.arrays_zip(F.transform("_items", lambda x: x["_at"]).alias("at"), fold_bins(F.transform("_items", lambda x: x["size"]), cap).alias("bin"))).alias("x"))
    same = F.col("_at") == F.col("x.at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return placed.join(folded, same).select(*[f"c{i}" for i in range(len(own))], "_size", F.struct(*[F.col(k).alias(f"g{i}") for i, k in enumerate(keys)]).alias("_g"), F.col("x.bin").cast("int").alias("bin"))


def _exits(group: pa.Table) -> pa.Table:
    """Where the bins that begin at a block's entries leave the block: the first bin after it."""
    group = group.sort_by("_at").combine_chunks()
    at, after = group.column("_at").to_numpy(), pc.fill_null(group.column("_next"), END).to_numpy()
    end = at[-1] + 1
    out = after.copy()
    for i in np.flatnonzero(after < end)[::-1]:
        out[i] = out[after[i] - at[0]]
    own = group.filter(group.column("_entry"))
    where = np.flatnonzero(group.column("_entry").to_numpy())
    return pa.table({"_g": own.column("_g"), "_at": own.column("_at"), "_exit": pa.array(out[where], pa.int64())})


def _chain(group: pa.Table) -> pa.Table:
    """The entries that are reached from a group's first file."""
    leave, at, met = dict(zip(group.column("_at").to_pylist(), group.column("_exit").to_pylist(), strict=True)), 1, []
    while at != END:
        met.append(at)
        at = leave[at]
    return pa.table({"_g": group.column("_g").take(pa.array([0] * len(met), pa.int64())), "_in": pa.array(met, pa.int64())})


def _starts(group: pa.Table) -> pa.Table:
    """How many bins have begun in the block, up to and with each file."""
    group = group.sort_by("_at").combine_chunks()
    at, after, entry = group.column("_at").to_numpy(), pc.fill_null(group.column("_next"), END).to_numpy(), group.column("_in")[0].as_py()
    begun = np.zeros(len(at), np.int64)
    while entry is not None and entry <= at[-1]:
        begun[entry - at[0]] = 1
        entry = int(after[entry - at[0]])
    return pa.table({"_g": group.column("_g"), "_at": group.column("_at"), "_begun": pa.array(np.cumsum(begun))})


def _packed(files: DataFrame, group: list[str], size: str, order: list[Column], cap: int, block: int) -> DataFrame:
    """_row, bin of groups of any size.

    A bin that begins at a file ends before the first one whose running size exceeds what
    stood before the bin by more than the cap: an as-of join on running sizes tells each
    file's next bin. Groups are cut into blocks; few files can be the first of a bin in their
    block, and where a bin from there leaves the block is found within it. These few pointers
    are followed from block to block, and each block then marks its own bins.
    """
    rows = placed(files, group, order, size)
    asks = rows.select("_g", "_at", (F.col("_sum") - F.col("_size") + cap).alias("_most"))
    found = ranges.asof(asks, rows.select("_g", "_sum", F.col("_at").alias("_place")), ["_g"], "_most", "_sum", "_place", "_found", strict=True, forward=True, width=64 * max(1, cap))
    of = lambda c: F.floor((F.col(c) - 1) / block)
    last = rows.groupBy("_g").agg(F.max("_at").alias("_last"))
    nexts = found.join(last, "_g").select("_g", "_at", F.greatest("_found", F.when(F.col("_found").isNotNull(), F.col("_at") + 1)).alias("_next"), "_last").withColumn("_next", F.when(F.col("_next") <= F.col("_last"), F.col("_next"))).drop("_last")
    nexts = materialise(nexts.withColumn("_block", of("_at")), "next")
    enter = nexts.filter(of("_next") > F.col("_block")).select("_g", F.col("_next").alias("_at")).unionByName(nexts.select("_g", F.lit(1).cast("long").alias("_at"))).distinct().withColumn("_entry", F.lit(True))
    flagged = nexts.join(enter, ["_g", "_at"], "left").withColumn("_entry", F.coalesce("_entry", F.lit(False)))
    kind = rows.select("_g").schema[0].dataType.simpleString()
    exits = flagged.groupBy("_g", "_block").applyInArrow(_exits, f"_g {kind}, _at long, _exit long")
    reached = exits.groupBy("_g").applyInArrow(_chain, f"_g {kind}, _in long").withColumn("_block", of("_in"))
    begun = materialise(nexts.join(reached, ["_g", "_block"], "left").groupBy("_g", "_block").applyInArrow(_starts, f"_g {kind}, _at long, _begun long").withColumn("_block", of("_at")), "begun")
    before = begun.groupBy("_g", "_block").agg(F.max("_begun").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_g").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bins = begun.join(before, ["_g", "_block"]).select("_g", "_at", (F.col("_before") + F.col("_begun") - 1).cast("int").alias("bin"))
    return rows.join(bins, ["_g", "_at"]).select("_row", "_size", "_g", "bin")


def pack(files: DataFrame, group: list[str], size: str, order: list[Column], cap: int = CAP, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """``files`` with bin and bin_size: a greedy fold within each group, in order.

    Groups of up to ``hot`` files are folded as arrays; the bins of larger ones are found in
    parallel, with the same result. A null size is 0; null keys are a group; files of equal
    order are taken in an order that is found once.
    """
    keyed = files.select("*", F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)]).alias("_group"))
    large = keyed.groupBy("_group").agg(F.count("*").alias("_n")).filter(F.col("_n") > hot).select(F.col("_group").alias("_hot"))
    large = materialise(large, "large")
    if large.head(1):
        there = F.col("_group").eqNullSafe(F.col("_hot"))
        small = keyed.join(large, there, "left_anti").drop("_group")
        packed = _folded(small, group, size, order, cap)
        hot_ones = _packed(keyed.join(large, there, "left_semi").drop("_group"), group, size, order, cap, block)
        packed = packed.unionByName(hot_ones.select("_row.*", "_size", "_g", "bin"))
    else:
        packed = _folded(files, group, size, order, cap)
    out = packed.withColumn("bin_size", F.sum("_size").over(Window.partitionBy("_g", "bin")))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(files.columns)], "bin", "bin_size")


def file_bundles(files: DataFrame, path: str = "path", position: str = "position", cap: int = CAP, keep: list[str] | None = None) -> DataFrame:
    """``files`` (path, position, diff, additions, deletions) with reason, group_id, bin and total_chars: grouped, the densest change of a group first, packed up to the cap. Files without a diff drop out.

    ``keep``: the columns of ``files`` that come back. Without a diff among them, diffs are read once, to be measured, and what follows handles narrow rows.
    """
    # measured before anything is shuffled: a diff itself goes along only if it is read afterwards
    sized = files.filter(F.col("diff").isNotNull()).withColumns({"_size": F.length("diff"), "_density": change_density(F.col("additions"), F.col("deletions"), F.col("diff"))})
    if keep is not None:
        sized = materialise(sized.select(*dict.fromkeys([*keep, path, position]), "_size", "_density"), "sized")
    grouped = pairing_groups(sized, path, position)
    if keep is not None:
        grouped = materialise(grouped, "grouped")
    return pack(grouped, ["group_id"], "_size", [F.desc("_density"), F.col(position)], cap).withColumnRenamed("bin_size", "total_chars").drop("_size", "_density")


def json_keys(files: DataFrame, path: str, text: str) -> DataFrame:
    """path, keys: the top-level keys of a JSON object, the places of an array; null for any other text."""
    value = F.try_parse_json(F.col(text))
    places = F.transform(F.sequence(F.lit(1), F.json_array_length(text)), lambda i: (i - 1).cast("string"))
    listed = F.when(F.json_array_length(text) > 0, places).when(F.json_array_length(text) == 0, F.array().cast("array<string>"))
    return files.select(path, F.when(value.isNotNull(), F.array_distinct(F.coalesce(F.json_object_keys(text), listed))).alias("keys"))


def bundle_keys(bundled: DataFrame, contents: DataFrame, path: str = "path") -> DataFrame:
    """Of locale variants' last bundle in each group: group_id, path, missing and extra keys (sorted), and a reason where a file holds no JSON keys.

    ``bundled``: of ``file_bundles``; ``contents``: path, content. A key is extra if another file of the bundle lacks it.
    """
    last = bundled.filter("reason = 'i18n_variants'").select("group_id", "bin", path).withColumn("_last", F.max("bin").over(Window.partitionBy("group_id"))).filter("bin = _last")
    held = materialise(last.select("group_id", path).join(json_keys(contents, path, "content"), path, "left"), "held")  # read three times
    per = key_consistency(held.select("group_id", path, F.explode("keys").alias("key")), ["group_id"], path, "key").groupBy("group_id", path).agg(
        F.sort_array(F.collect_list(F.when(F.col("missing"), F.col("key")))).alias("missing"), F.sort_array(F.collect_list(F.when(F.col("extra"), F.col("key")))).alias("extra")
    )
    none = F.array().cast("array<string>")
    unions = held.groupBy("group_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("_all"))
    out = held.join(per, ["group_id", path], "left").join(unions, "group_id")  # a file without any key lacks all of them
    empty = F.col("keys").isNotNull() & (F.size("keys") == 0)
    return out.select("group_id", path, F.when(empty, F.col("_all")).otherwise(F.coalesce("missing", none)).alias("missing"), F.coalesce("extra", none).alias("extra"), F.when(F.col("keys").isNull(), "not parseable as JSON").alias("reason"))


def test_key(path: Column) -> tuple[Column, Column]:
    """(what a test's source would be called without extension, whether the path is a test): foo.test, foo_spec; FooTest and TestFoo for Java."""
    base, java = strip_ext(path), get_ext(path) == "java"
    marked = base.rlike(r"(?i)^.+[._](?:test|spec)$")
    name = F.when(marked, F.regexp_replace(base, r"(?i)[._](?:test|spec)$", "")).when(java & base.rlike("^Test.+$"), F.regexp_replace(base, "^Test", "")).when(java & base.rlike("^.+Test$"), F.regexp_replace(base, "Test$", "")).otherwise(base)
    return name, marked | (java & (base.rlike("^Test.+$") | base.rlike("^.+Test$")))


def pair_tests(files: DataFrame, path: str, position: str) -> DataFrame:
    """``files`` with pair_id: the first source by position with its first test; null for others."""
    name, is_test = test_key(F.col(path))
    keyed = files.withColumns({"_name": name, "_ext": get_ext(F.col(path)), "_test": is_test})
    first = keyed.groupBy("_name", "_ext").agg(F.min(F.when(F.col("_test"), F.col(position))).alias("_t"), F.min(F.when(~F.col("_test"), F.col(position))).alias("_s"))
    out = keyed.join(first, ["_name", "_ext"], "left").withColumn("pair_id", F.when(F.col("_t").isNotNull() & F.col("_s").isNotNull() & F.col(position).isin(F.col("_t"), F.col("_s")), F.least("_t", "_s")))
    return out.select(*files.columns, "pair_id")


def variant_groups(files: DataFrame, path: str) -> DataFrame:
    """``files`` with variant_of (path without locale) and variants (files that share it)."""
    base = F.struct(strip_locale(strip_ext(F.col(path))).alias("base"), get_ext(F.col(path)).alias("ext"))
    return files.withColumn("variant_of", strip_locale(F.col(path))).withColumn("variants", F.count("*").over(Window.partitionBy(base)))


def pairing_groups(files: DataFrame, path: str, position: str) -> DataFrame:
    """``files`` with reason and group_id, each file in one group: test pairs, then locale variants, then alone."""
    paired = pair_tests(files, path, position)
    rest = variant_groups(paired.filter("pair_id is null"), path)
    window = Window.partitionBy("variant_of")
    left = rest.withColumn("group_id", F.min(position).over(window)).withColumn("reason", F.when(F.count("*").over(window) > 1, "i18n_variants").otherwise("single_file"))
    done = paired.filter("pair_id is not null").withColumn("group_id", F.col("pair_id")).withColumn("reason", F.lit("test_source_pair"))
    names = [*files.columns, "group_id", "reason"]
    return done.select(*names).unionByName(left.select(*names))


def key_consistency(keys: DataFrame, group: list[str], member: str, key: str) -> DataFrame:
    """Per group, member and key of the group: whether it is missing there, or extra (present, but not everywhere)."""
    keys = keys.select(*group, member, key).distinct()
    members = keys.select(*group, member).distinct()
    counts = keys.groupBy(*group, key).agg(F.count("*").alias("_has"))
    sizes = members.groupBy(*group).agg(F.count("*").alias("_all"))
    own = keys.withColumn("_own", F.lit(True))
    if group:
        every = members.join(counts, group).join(sizes, group)
    else:  # one group: its keys' counts are as many as there are keys, joined on a constant
        every = members.withColumn("_g", F.lit(1)).join(counts.withColumn("_g", F.lit(1)), "_g").join(sizes.withColumn("_g", F.lit(1)), "_g").drop("_g")
    every = every.join(own, [*group, member, key], "left")
    return every.select(*group, member, key, F.col("_own").isNull().alias("missing"), (F.col("_own").isNotNull() & (F.col("_has") < F.col("_all"))).alias("extra"))
