"""Target encoding in order of time against a loop over rows."""

import datetime
import random
import zlib

import pytest
from pyspark.sql import functions as F

from textloom.llm import target_encoding as T


def plain(rows, levels, gap):
    """Per row and level: (rows, hits) of the same value, other folds, more than gap before."""
    out = []
    for at, fold, hit, values in rows:
        own = [(sum(1 for b in found), sum(b[2] for b in found)) for i in range(levels) for found in [[b for b in rows if b[3][i] == values[i] and b[1] != fold and b[0] + gap < at]]]
        out.append(own)
    return out


@pytest.mark.parametrize("gap", [0, 3])
@pytest.mark.parametrize("times", [6, 60])
def test_counts_before_in_tiny_shards(spark, gap, times):
    """Shards of some 15 rows: values go over many shards, and equal times are cut between them."""
    rnd = random.Random(gap * 100 + times)
    rows = [(rnd.randrange(times), rnd.randrange(3), rnd.randrange(2), (0, rnd.choice([1, 1, 1, 2, None]), rnd.choice(["a", "", None, "b", "b"]))) for _ in range(180)]
    df = spark.createDataFrame([(i, a, f, h, k, w, "kept") for i, (a, f, h, (_, k, w)) in enumerate(rows)], "i int, t int, f int, h int, level int, name string, n string")
    found = T.counts_before(df, {"every": None, "k": F.col("level"), "w": F.col("name")}, "t", F.col("f"), F.col("h"), gap)
    small = T.SHARD_ROWS
    assert small > 180
    got = {r.i: [(r[f"{x}_n"], r[f"{x}_s"]) for x in ("every", "k", "w")] for r in found.collect()}
    assert [got[i] for i in range(len(rows))] == plain(rows, 3, gap)
    assert found.columns[:7] == df.columns
    kept = df.selectExpr("cast(i as long) row", "cast(t as long) at", "f fold", "1 n", "h s", "level", "name")
    codes = {"every": 0, "k": 1, "w": 2}
    tiny = T.wide(T.history(T.levelled(kept, {"every": None, "k": F.col("level"), "w": F.col("name")}, codes), 540, gap, shard_rows=15), codes)
    assert {r.row: [(r[f"{x}_n"], r[f"{x}_s"]) for x in codes] for r in tiny.collect()} == got


def test_null_times_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, 0, 1), (2, 5, None, None), (3, 6, 0, 1), (3, 6, 0, 1), (4, 7, None, 1), (5, 8, 1, 0)], "i int, t long, f int, h int")
    got = sorted((r.i, r.every_n, r.every_s) for r in T.counts_before(df, {"every": None}, "t", F.col("f"), F.col("h")).collect() if r.i > 1)
    assert got == [(2, 0, 0), (3, 1, 0), (3, 1, 0), (4, 2, 2), (5, 4, 3)]  # a null fold is one of its own
    none = T.counts_before(df.limit(0), {"every": None}, "t", F.col("f"), F.col("h"))
    assert none.count() == 0 and none.columns[-2:] == ["every_n", "every_s"]
    with pytest.raises(ValueError):
        T.counts_before(df, {"every": None}, "t", F.col("f"), F.col("h"), gap=-1)


def test_sales_against_a_loop(spark):
    rnd = random.Random(5)
    day = lambda i: datetime.datetime(2024, 3, 30, 23) + datetime.timedelta(hours=i)
    sales = [(s, rnd.choice([7, 7, 8, None, 99]), day(rnd.randrange(12)) if s % 9 else None) for s in range(40)]
    lines = [(rnd.choice([*range(45), None]), rnd.choice([1, 1, 2, None, 50]), rnd.choice([3, 4, None]), rnd.choice(["returned", "kept", None])) for _ in range(300)]
    items, vendors, clients = [(1, "a"), (2, None), (2, "c"), (None, "x"), (-1, "b")], [(3, 1), (4, 1)], [(7, "p"), (8, "q"), (-1, None)]
    frames = (
        spark.createDataFrame(lines, "sale_id long, item_id long, vendor_id long, flag string"), spark.createDataFrame(sales, "sale_id long, client_id long, sold_at timestamp_ntz"),
        spark.createDataFrame(items, "item_id long, kind string"), spark.createDataFrame(vendors, "vendor_id long, nation_id int"), spark.createDataFrame(clients, "client_id long, segment string"),
    )
    got = {(r.sale_id, r.item_id, r.vendor_id): (r.n, r.s, r.item_n, r.item_rate, r.vendor_n, r.vendor_rate, r.client_n, r.client_rate) for r in T.encode_sales(T.sold_lines(*frames), shard_rows=20).collect()}
    of_sale = {s: (-1 if c is None else c, t) for s, c, t in sales if t}
    kind, nation, segment = {1: "a", 2: "c", -1: "b"}, dict(vendors), dict(clients)
    all_of = [(s, -1 if i is None else i, v, of_sale[s][0], of_sale[s][1], zlib.crc32(str(s).encode()) % 5, f == "returned") for s, i, v, f in lines if s in of_sale]
    want = {}

    def rate(n, s, p):
        return p if n < 1 else (1_000_000 * s + 50 * p) // (n + 50)

    for s, i, v, c, t, fold, _ in all_of:
        before = [x for x in all_of if x[5] != fold and x[4] < t]
        count = lambda test: (sum(1 for x in before if test(x)), sum(x[6] for x in before if test(x)))  # noqa: B023, E731
        every = rate(*count(lambda x: True), 500_000)
        item, vendor, client = count(lambda x: x[1] == i), count(lambda x: x[2] == v), count(lambda x: x[3] == c)  # noqa: B023
        rates = (rate(*item, rate(*count(lambda x: kind.get(x[1]) == kind.get(i)), every)), rate(*vendor, rate(*count(lambda x: nation.get(x[2]) == nation.get(v)), every)), rate(*client, rate(*count(lambda x: segment.get(x[3]) == segment.get(c)), every)))  # noqa: B023
        own = [x for x in all_of if x[:3] == (s, i, v)]
        want[s, i, v] = (len(own), sum(x[6] for x in own), item[0], rates[0], vendor[0], rates[1], client[0], rates[2])
    assert got == want
