"""Target encoding in order of time: what was known of a value before a row's own time, from other folds only.

Each row asks, for each of its levels (a value of a column, or all rows), how many rows of
that value and of other folds lie more than ``gap`` before it, and how many of these are
hits. That is the value's running count minus its fold's own. Rows are dealt into shards by
ranges of (level, value, time), so a value with a third of all rows is many shards. Within a
shard (one Arrow task) the running counts of values, and of values and folds, stand at
time + gap, and DuckDB's ASOF joins look up the last one strictly before each row. Only a
shard's first value can have begun in earlier shards: each shard tells the totals of its first
and last value, prefix sums of these are the shards' opening balances, and what a shard's
first value was answered is raised by them. Nothing is collected and no table is broadcast by
hand; edges are a few rows per shard, and a shard has some ``SHARD_ROWS`` rows.

Rows of equal value and time may be cut between two shards. The edges therefore tell apart
what stands at the shard's last time, which isn't before a row of that same time.

Defined results: a null value is a value of its own at each level; a null fold is a fold of its
own; rows with a null time take no part and are answered with no row; repeated rows count and
are answered each; a null hit or count is 0; an empty table gives an empty table; further
columns, whatever their names, are not read. Values are whole numbers or strings, compared
exactly. Above ``MOST_SHARDS`` shards become larger, and DuckDB spills to the task's own
scratch folder, as Spark's sorts do.
"""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm._text import release
from textloom.session import materialise, table

#: Rows of a shard, about; shards at most.
SHARD_ROWS, MOST_SHARDS = 600_000, 50_000
#: Folds, the weight of a prior in rows, and the rate of no history at all, of 1,000,000.
FOLDS, WEIGHT, PRIOR = 5, 50, 500_000
#: How little history is none.
LEAST = 1

ANSWER = "level int, row long, n long, s long, shard int, first boolean, fold int, tie boolean, tie_fold boolean, side int, key long, name string, low long, high long, tail_n long, tail_s long"
#: Sides: an answer, a shard's first value, its last one.
ANSWERED, FIRST, LAST = 0, 1, 2
#: The fold of totals over all folds, and that of null.
EVERY, NONE = -2, -1


def levelled(rows: DataFrame, levels: dict[str, Column | None], codes: dict[str, int], row: str | None = "row") -> DataFrame:
    """One row per row and level: level, key, name, at, fold, n, s, row. A level's value is a whole number (key), a string (name) or none. ``row`` None: these rows only count and don't ask."""
    kinds = dict(rows.select(*[v.alias(k) for k, v in levels.items() if v is not None]).dtypes)

    def item(name: str, value: Column | None) -> Column:
        text = kinds.get(name) == "string"
        key = F.lit(None).cast("long") if value is None or text else value.cast("long")
        return F.struct(F.lit(codes[name]).alias("level"), key.alias("key"), (value if text else F.lit(None).cast("string")).alias("name"))

    asked = F.col(row) if row else F.lit(None)
    found = rows.filter("at is not null").select(F.explode(F.array(*[item(k, v) for k, v in levels.items()])).alias("v"), "at", "fold", "n", "s", asked.cast("long").alias("row"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.select("v.*", "at", F.coalesce(F.col("fold").cast("int"), F.lit(NONE)).alias("fold"), zero("n"), zero("s"), "row")


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _running(group: np.ndarray, at: np.ndarray, n: np.ndarray, s: np.ndarray) -> pa.Table:
    """Running counts of sorted rows: one row for each time of each group, all of that time included."""
    start = np.flatnonzero(_runs(group))
    which = np.cumsum(_runs(group)) - 1
    last = np.flatnonzero(np.append(_runs(group, at)[1:], True))
    total = lambda x: (np.cumsum(x) - (np.cumsum(x)[start] - x[start])[which])[last]
    return pa.table({"g": group[last], "ts": at[last], "n": total(n), "s": total(s)})


def _edges(side: int, rows: slice, shard: int, table: pa.Table, at, fold, n, s) -> list[tuple]:
    """What a shard's first or last value holds, for all folds together and for each."""
    at, fold, n, s = at[rows], fold[rows], n[rows], s[rows]
    value = [table.column(c)[rows.start].as_py() for c in ("level", "key", "name")]
    out = []
    for f in [EVERY, *np.unique(fold).tolist()]:
        own = slice(None) if f == EVERY else fold == f
        tail = at[own] == at[own][-1]
        out.append((value[0], None, int(n[own].sum()), int(s[own].sum()), shard, None, f, None, None, side, value[1], value[2], int(at[own][0]), int(at[own][-1]), int(n[own][tail].sum()), int(s[own][tail].sum())))
    return out


def _answer(batches):
    """Answers of one shard, whose rows come sorted by level, value and time, and its edges."""
    shard, schema = TaskContext.get().partitionId(), pa.schema([(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[x.split()[1]]) for x in ANSWER.split(", ")])
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    rows = pa.Table.from_batches(batches).combine_chunks()
    whole = lambda c: rows.column(c).to_numpy()
    key, named = rows.column("key"), rows.column("name").combine_chunks().dictionary_encode().indices
    named = pc.fill_null(named, -1).to_numpy(zero_copy_only=False)
    at, fold, n, s = whole("at"), whole("fold"), whole("n"), whole("s")
    new = _runs(whole("level"), pc.fill_null(key, 0).to_numpy(), pc.is_null(key).to_numpy(), named)
    group = np.cumsum(new) - 1
    first = slice(0, int(np.searchsorted(group, 1)))
    edges = _edges(FIRST, first, shard, rows, at, fold, n, s) + _edges(LAST, slice(int(np.searchsorted(group, group[-1])), len(group)), shard, rows, at, fold, n, s)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*edges, strict=True), schema.types, strict=True)], schema=schema)
    # a group and fold as one number
    codes, of = np.unique(fold, return_inverse=True)
    folded = group * len(codes) + of
    order = np.argsort(folded, kind="stable")
    asks = np.flatnonzero(rows.column("row").is_valid().to_numpy())
    with duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "preserve_insertion_order": False}) as con:
        con.register("q", pa.table({"i": asks, "g": group[asks], "f": folded[asks], "ts": at[asks]}))
        con.register("k", _running(group, at, n, s))
        con.register("kf", _running(folded[order], at[order], n[order], s[order]))
        found = con.sql("""
SELECT q.i, coalesce(k.n, 0) - coalesce(kf.n, 0) AS n, coalesce(k.s, 0) - coalesce(kf.s, 0) AS s
FROM q ASOF LEFT JOIN k ON q.g = k.g AND q.ts > k.ts ASOF LEFT JOIN kf ON q.f = kf.g AND q.ts > kf.ts""").to_arrow_table().combine_chunks()
    i = found.column("i").to_numpy()
    begun = dict((e[6], e[12]) for e in edges if e[9] == FIRST)
    in_first = i < first.stop
    tie = in_first & (at[i] == begun[EVERY])
    tie_fold = in_first & (at[i] == np.array([begun.get(f, 0) for f in codes.tolist()])[of[i]])
    size = len(i)
    none = lambda t: pa.nulls(size, t)
    out = pa.RecordBatch.from_arrays(
        [pa.array(whole("level")[i]), rows.column("row").combine_chunks().take(pa.array(i)), found.column("n").combine_chunks(), found.column("s").combine_chunks(), pa.array(np.full(size, shard, np.int32)), pa.array(in_first), pa.array(fold[i]), pa.array(tie), pa.array(tie_fold), pa.array(np.full(size, ANSWERED, np.int32)), none(pa.int64()), none(pa.string()), *[none(pa.int64())] * 4],
        schema=schema,
    )
    del rows, found
    for start in range(0, size, 50_000):
        yield out.slice(start, 50_000)
    release()


def opening_balances(edges: DataFrame) -> DataFrame:
    """shard, fold and what the shard's first value had before the shard: of all folds less that fold's own (more_n, more_s), and what of it stands at the first time itself."""
    value = ["level", "key", "name", "fold"]
    tied = F.when(F.col("side") == FIRST, F.col("low")).otherwise(F.col("high"))
    before = lambda *keys: Window.partitionBy(*keys).orderBy("shard", "side").rowsBetween(Window.unboundedPreceding, -1)
    told = lambda c, *keys: F.coalesce(F.sum(F.when(F.col("side") == LAST, F.col(c))).over(before(*value, *keys)), F.lit(0))
    found = edges.withColumn("tied", tied).select("shard", "fold", "side", *[told(c).alias(f"all_{c}") for c in ("n", "s")], *[told(f"tail_{c}", "tied").alias(f"at_{c}") for c in ("n", "s")]).filter(F.col("side") == FIRST)
    every = found.filter(F.col("fold") == EVERY).select("shard", *[F.col(f"{p}_{c}").alias(f"{p}_every_{c}") for p in ("all", "at") for c in ("n", "s")])
    own = found.filter(F.col("fold") != EVERY).join(every, "shard")
    return own.select("shard", "fold", *[(F.col(f"all_every_{c}") - F.col(f"all_{c}")).alias(f"more_{c}") for c in ("n", "s")], *[F.col(f"at_every_{c}").alias(f"tie_{c}") for c in ("n", "s")], *[F.col(f"at_{c}").alias(f"tie_fold_{c}") for c in ("n", "s")])


def history(rows: DataFrame, count: int, gap: int = 0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """level, row, n, s of every row of ``levelled`` that asks: rows of its value and other folds more than ``gap`` before it.

    ``count``: about how many rows there are, which only decides the number of shards; times and ``gap`` are whole numbers of one unit.
    """
    if gap < 0:
        raise ValueError("a gap can't be negative")
    if gap:  # what a row adds stands later than what it asks
        adds, asks = F.struct((F.col("at") + gap).alias("at"), F.col("n"), F.col("s"), F.lit(None).cast("long").alias("row")), F.struct(F.col("at"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"), F.col("row"))
        rows = rows.select("level", "key", "name", "fold", F.explode(F.array(adds, asks)).alias("x")).select("level", "key", "name", "x.at", "fold", "x.n", "x.s", "x.row")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = min(max(-(-count * (2 if gap else 1) // shard_rows), parts), MOST_SHARDS)
    dealt = rows.repartitionByRange(shards, "level", "key", "name", "at", "row").sortWithinPartitions("level", "key", "name", "at")
    answers = materialise(dealt.mapInArrow(_answer, ANSWER), "history")
    openings = materialise(opening_balances(answers.filter(F.col("side") != ANSWERED)), "openings")
    own = answers.filter(F.col("side") == ANSWERED)
    # every row is joined, though only those of first values are raised: then the join makes as many rows as there are
    raised = lambda c: F.when(F.col("first"), F.col(c) + F.col(f"more_{c}") - F.when(F.col("tie"), F.col(f"tie_{c}")).otherwise(0) + F.when(F.col("tie_fold"), F.col(f"tie_fold_{c}")).otherwise(0)).otherwise(F.col(c)).alias(c)
    return own.join(openings, ["shard", "fold"], "left").select("level", "row", raised("n"), raised("s"))


def wide(found: DataFrame, codes: dict[str, int], row: str = "row") -> DataFrame:
    """row and, of each level, <level>_n and <level>_s."""
    of = lambda c, name: F.max(F.when(F.col("level") == codes[name], F.col(c))).alias(f"{name}_{c}")
    return found.filter(F.col("level").isin(*codes.values())).groupBy(F.col("row").alias(row)).agg(*[of(c, name) for name in codes for c in ("n", "s")])


def rate(n: Column, s: Column, prior: Column, weight: int = WEIGHT, least: int = LEAST) -> Column:
    """Hits of a million, drawn to the prior as if by ``weight`` more rows; the prior itself without history."""
    return F.when(n < least, prior).otherwise(F.floor((s * 1_000_000 + prior * weight - F.pmod(s * 1_000_000 + prior * weight, n + weight)) / (n + weight))).cast("long")


def counts_before(rows: DataFrame, levels: dict[str, Column | None], at: str, fold: Column, hit: Column, gap: int = 0) -> DataFrame:
    """``rows`` with <level>_n and <level>_s: for each row, how many rows of its value and of other folds lie more than ``gap`` (units of ``at``, a whole number) before it, and how many of these hit.

    Rows with a null time come back with nulls. ``levels``: name and value; None for all rows.
    """
    names = rows.columns
    kept = rows.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("_kept"), F.col(at).cast("long").alias("at"), fold.cast("int").alias("fold"), F.lit(1).cast("long").alias("n"), hit.cast("long").alias("s"), *[v.alias(f"_v{i}") for i, v in enumerate(levels.values()) if v is not None])
    kept = materialise(kept.withColumn("row", F.monotonically_increasing_id()), "rows")
    codes = {name: i for i, name in enumerate(levels)}
    asked = levelled(kept, {k: None if v is None else F.col(f"_v{i}") for i, (k, v) in enumerate(levels.items())}, codes)
    found = wide(history(asked, kept.count() * len(levels), gap), codes)
    return kept.join(found, "row", "left").select(*[F.col("_kept")[f"c{i}"].alias(c) for i, c in enumerate(names)], *[f"{k}_{c}" for k in levels for c in ("n", "s")])


def micros(time: str) -> Column:
    """Microseconds since 1970 of a time without a zone, whatever the session's zone; a time with one counts as the session shows it."""
    return F.expr(f"cast(cast(cast({time} as timestamp_ntz) - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(18, 6)) * 1000000").cast("long")


def sold_lines(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Lines of sales with a time, one row per sale_id, item_id and vendor_id (and client_id and time, should a sale have several): n and s count lines and returned ones.

    kind, nation and segment are those of the ids; of an id that stands several times in its table, the smallest.
    """
    # as tables, so that a hot id's rows on the other side of a join can be dealt over tasks
    one = lambda rows, key, value: materialise(rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias(key)).agg(F.min(value).alias(value)), value)
    own = lines.filter("sale_id is not null").groupBy("sale_id", F.coalesce("item_id", F.lit(-1)).cast("long").alias("item_id"), F.col("vendor_id").cast("long").alias("vendor_id"))
    own = own.agg(F.count("*").alias("n"), F.count_if(F.col("flag") == "returned").alias("s"))
    sold = sales.filter("sale_id is not null and sold_at is not null").select("sale_id", F.coalesce("client_id", F.lit(-1)).cast("long").alias("client_id"), micros("sold_at").alias("at"))
    # equal rows of a sale are repeats of its lines
    sold = sold.groupBy("sale_id", "client_id", "at").agg(F.count("*").alias("copies"))
    sold = sold.withColumn("fold", (F.crc32(F.col("sale_id").cast("string")) % folds).cast("int")).join(one(clients, "client_id", "segment"), "client_id", "left")
    met = own.join(sold, "sale_id").withColumns({"n": F.col("n") * F.col("copies"), "s": F.col("s") * F.col("copies")}).drop("copies")
    return met.join(one(items, "item_id", "kind"), "item_id", "left").join(one(vendors, "vendor_id", "nation_id"), "vendor_id", "left")


def encode_sales(rows: DataFrame, gap: int = 0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``rows`` of ``sold_lines`` with item_n, item_rate, vendor_n, vendor_rate, client_n, client_rate.

    What a sale's lines have in common (all history, segment, client) is asked once per sale; ``gap`` in microseconds.
    """
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "lines")
    sales = materialise(rows.groupBy("sale_id", "client_id", "at", "fold", "segment").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("row", F.monotonically_increasing_id()), "sales")
    of_line, of_sale = {"kind": 0, "item": 1, "nation": 2, "vendor": 3}, {"every": 4, "segment": 5, "client": 6}
    asked = levelled(rows, {"kind": F.col("kind"), "item": F.col("item_id"), "nation": F.col("nation_id"), "vendor": F.col("vendor_id")}, of_line)
    asked = asked.unionByName(levelled(sales, {"every": None, "segment": F.col("segment"), "client": F.col("client_id")}, of_sale))
    found = history(asked, 4 * rows.count() + 3 * sales.count(), gap, shard_rows)
    line_counts, sale_counts = wide(found, of_line), wide(found, of_sale)
    c = F.col
    by_sale = sales.select("row", "sale_id", "client_id", "at").join(sale_counts, "row").withColumn("every_rate", rate(c("every_n"), c("every_s"), F.lit(PRIOR)))
    by_sale = by_sale.withColumn("client_rate", rate(c("client_n"), c("client_s"), rate(c("segment_n"), c("segment_s"), c("every_rate")))).select("sale_id", "client_id", "at", "every_rate", "client_n", "client_rate")
    out = rows.join(line_counts, "row").join(by_sale, ["sale_id", "client_id", "at"])
    out = out.withColumn("item_rate", rate(c("item_n"), c("item_s"), rate(c("kind_n"), c("kind_s"), c("every_rate"))))
    out = out.withColumn("vendor_rate", rate(c("vendor_n"), c("vendor_s"), rate(c("nation_n"), c("nation_s"), c("every_rate"))))
    return out.select(*[x for x in rows.columns if x != "row"], "item_n", "item_rate", "vendor_n", "vendor_rate", "client_n", "client_rate")


def op13_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, sales, items, vendors, clients = (table(spark, sf_dir, t) for t in ("sale_lines", "sales", "items", "vendors", "clients"))
    found = encode_sales(sold_lines(lines, sales, items, vendors, clients))
    return found.select("sale_id", "item_id", "vendor_id", F.col("n").alias("n_lines"), F.col("s").alias("n_returned"), "item_n", "item_rate", "vendor_n", "vendor_rate", "client_n", "client_rate")


#: The 8 steps of a byte of a CRC-32, in SQL.
BIT = "CASE WHEN {0} % 2 = 1 THEN xor({0} // 2, 3988292384) ELSE {0} // 2 END"


def oracle_sql() -> str:
    """Counts by windows over time that leave out a row's own time; nothing of the operator's own plan."""
    crc = "list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda c, d: " + BIT.format("c") + "))"
    rate = lambda level, prior: f"CASE WHEN {level}_n < {LEAST} THEN {prior} ELSE (1000000 * {level}_s + {WEIGHT} * {prior}) // ({level}_n + {WEIGHT}) END"
    levels = {"every": "1", "kind": "kind", "nation": "nation_id", "segment": "segment", "item": "item_id", "vendor": "vendor_id", "client": "client_id"}
    tables, joins = [], []
    for name, value in levels.items():
        window = lambda more: f"OVER (PARTITION BY v{more} ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP)"
        less = lambda c: f"CAST(coalesce(sum({c}) {window('')}, 0) - coalesce(sum({c}) {window(', fold')}, 0) AS BIGINT) AS {name}_{c}"
        tables.append(f"{name} AS (SELECT v, fold, ts, {less('n')}, {less('s')} FROM (SELECT {value} AS v, fold, ts, sum(n) AS n, sum(s) AS s FROM r GROUP BY ALL))")
        joins.append(f"JOIN {name} AS t{name} ON r.{value} IS NOT DISTINCT FROM t{name}.v AND r.fold = t{name}.fold AND r.ts = t{name}.ts" if name != "every" else "JOIN every AS tevery ON r.fold = tevery.fold AND r.ts = tevery.ts")
    return f"""
WITH d AS (SELECT sale_id, coalesce(item_id, -1) AS item_id, vendor_id, count(*) AS n, count(*) FILTER (flag = 'returned') AS s FROM sale_lines GROUP BY ALL),
o AS (SELECT sale_id, coalesce(client_id, -1) AS client_id, sold_at AS ts, count(*) AS copies, CAST(xor({crc}, 4294967295) % {FOLDS} AS INT) AS fold FROM sales WHERE sold_at IS NOT NULL AND sale_id IS NOT NULL GROUP BY ALL),
i AS (SELECT item_id, min(kind) AS kind FROM items GROUP BY item_id), w AS (SELECT vendor_id, min(nation_id) AS nation_id FROM vendors GROUP BY vendor_id), c AS (SELECT client_id, min(segment) AS segment FROM clients GROUP BY client_id),
r AS MATERIALIZED (SELECT d.sale_id, d.item_id, d.vendor_id, o.client_id, o.ts, o.fold, kind, nation_id, segment, n * copies AS n, s * copies AS s FROM d JOIN o ON d.sale_id = o.sale_id LEFT JOIN i ON d.item_id = i.item_id LEFT JOIN w ON d.vendor_id = w.vendor_id LEFT JOIN c ON o.client_id = c.client_id),
{", ".join(tables)},
x AS (SELECT r.*, COLUMNS('(every|kind|nation|segment|item|vendor|client)_[ns]') FROM r {" ".join(joins)}),
y AS (SELECT *, {rate('every', PRIOR)} AS every_rate FROM x)
SELECT sale_id, item_id, vendor_id, CAST(n AS BIGINT) AS n_lines, CAST(s AS BIGINT) AS n_returned, item_n, CAST({rate('item', 'kind_rate')} AS BIGINT) AS item_rate, vendor_n, CAST({rate('vendor', 'nation_rate')} AS BIGINT) AS vendor_rate, client_n, CAST({rate('client', 'segment_rate')} AS BIGINT) AS client_rate
FROM (SELECT *, {rate('kind', 'every_rate')} AS kind_rate, {rate('nation', 'every_rate')} AS nation_rate, {rate('segment', 'every_rate')} AS segment_rate FROM y)"""
