"""As-of and range joins against loops, and a hot file over many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import locate, ranges


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("forward", [False, True])
def test_asof(spark, strict, forward):
    rnd = random.Random(4)
    key = lambda: rnd.choice(["a", "a", "b", "c", None])
    asks = [(i, key(), rnd.choice([rnd.randrange(-40, 60), None])) for i in range(150)]
    answers = [(key(), rnd.choice([rnd.randrange(-40, 60), None]), rnd.randrange(9)) for _ in range(40)]
    a, b = spark.createDataFrame(asks, "i int, k string, t long"), spark.createDataFrame(answers, "k string, u int, v int")
    got = {r.i: r.found for r in ranges.asof(a, b, ["k"], "t", "u", "v", "found", strict, forward, width=7).collect()}
    for i, k, t in asks:
        met = [(u, v) for kk, u, v in answers if kk == k and k is not None and None not in (t, u) and (u >= t if forward else u <= t) and not (strict and u == t)]
        best = (min if forward else max)((u for u, _ in met), default=None)
        assert got[i] == min((v for u, v in met if u == best), default=None)
    assert len(got) == 150 and ranges.asof(a, b.limit(0), ["k"], "t", "u", "v", "found").filter("found is not null").count() == 0


def test_range_join(spark):
    rnd = random.Random(5)
    points = [(i, rnd.choice("ab"), rnd.randrange(-300, 300)) for i in range(120)] + [(999, None, 1), (998, "a", None)]
    spans = [(i, rnd.choice("ab"), x := rnd.randrange(-300, 300), x + rnd.choice([-3, 0, 2, 9, 40, 600])) for i in range(60)] + [(99, None, 0, 5), (98, "a", None, 5)]
    p, r = spark.createDataFrame(points, "i int, k string, t int"), spark.createDataFrame(spans, "j int, k string, x int, y int")
    got = sorted((row.point.i, row.range.j) for row in ranges.range_join(p, r, ["k"], "t", "x", "y", sizes=(4, 32, 1 << 40)).collect())
    assert got == sorted((i, j) for i, k, t in points for j, kk, x, y in spans if k == kk and None not in (k, t, x) and x <= t <= y)


def test_align_and_lines_in_range_against_loops(spark):
    rnd = random.Random(6)
    hunks = [(f, n, s := rnd.randrange(1, 200), s + rnd.randrange(12)) for f in "ab" for n in rnd.sample(range(50), 15)]
    hints = [(i, rnd.choice("abc"), rnd.randrange(-5, 230)) for i in range(200)]
    h, q = spark.createDataFrame(hunks, "f string, number int, start int, end int"), spark.createDataFrame(hints, "i int, f string, hint int")
    got = {r.i: (r.hunk, r.line) for r in locate.align(q, h, ["f"], "hint", "start", "end", "number").collect()}
    for i, f, t in hints:
        own = sorted(x[1:] for x in hunks if x[0] == f)
        if not own:
            assert i not in got
            continue
        held = [x for x in own if x[1] <= t <= x[2]]
        want = (held[0][0], t) if held else (own[0][0], own[0][1]) if t < own[0][1] else (own[-1][0], own[-1][2]) if t > own[-1][2] else min((abs(t - s), n, s) for n, s, _ in own)[1:]
        assert got[i] == want
    claims = [(i, rnd.choice("ab"), x := rnd.randrange(200), x + rnd.randrange(-1, 9)) for i in range(100)]
    found = locate.lines_in_range(spark.createDataFrame(claims, "i int, f string, a int, b int"), spark.createDataFrame([(f, s) for f, _, s, _ in hunks], "f string, line int"), ["f"], "a", "b", "line")
    assert {r.i for r in found.collect()} == {i for i, f, a, b in claims if any(ff == f and a <= s <= b for ff, _, s, _ in hunks)}


def test_a_hot_file_is_many_tasks(spark):
    """10^5 hunks and as many hints of one file; no task gets more than a bin or two of it."""
    n = 100_000
    hunks = spark.range(n).selectExpr("'f' f", "cast(id as int) number", "id * 10 + 1 start", "id * 10 + 4 end")
    hints = spark.range(n).selectExpr("'f' f", "id i", "id * 10 + 7 hint")
    got = locate.align(hints, hunks, ["f"], "hint", "start", "end", "number")
    assert got.agg(F.count("*"), F.count_if(F.expr("hunk = i and line = i * 10 + 1 or hunk = i + 1 and line = (i + 1) * 10 + 1 or i = 99999"))).first()[:] == (n, n)
    assert got.filter("i = 5").first()["line"] == 61 and got.filter("i = 99999").first()["line"] == 999994


def test_fuzzy_join_against_every_window(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcde é") for _ in range(rnd.choice([1, 4, 6, 12, 30, 60]))).strip() or "x"
    files = {f: [word() for _ in range(rnd.randrange(25))] for f in range(30)}
    files[99] = ["same line of text"] * 40
    wanted = []
    for f, ls in files.items():
        for _ in range(4):
            at, n = rnd.randrange(len(ls) + 1), rnd.randrange(1, 4)
            own = list(ls[at : at + n]) or [word()]
            for _ in range(rnd.randrange(5)):
                k = rnd.randrange(len(own))
                i = rnd.randrange(len(own[k]) + 1)
                own[k] = own[k][:i] + rnd.choice(["", "z", "yz"]) + own[k][i + rnd.randrange(2) :]
            wanted.append((len(wanted), f, "\n".join(own)))
    wanted += [(1000, 5, None), (1001, 5, " \n "), (1002, 12345, "abc"), (1003, None, "abc")]
    fs = spark.createDataFrame([(f, "\n\n".join(ls)) for f, ls in files.items()] + [(500, None)], "f int, at string")
    got = {r.i: (r["at"], r.measured) for r in locate.fuzzy_join(spark.createDataFrame(wanted, "i int, f int, code string"), fs, ["f"], "code", "at").collect()}
    from textloom.functions.text import norm_lines

    pairs = fs.join(spark.createDataFrame(wanted, "i int, f int, code string"), "f").select("i", locate.locate_fuzzy(norm_lines(F.col("at")), norm_lines(F.col("code"))).alias("w"), F.size(norm_lines(F.col("at"))).alias("n"))
    plain = {r.i: r for r in pairs.collect()}
    assert len(got) == len(wanted) and sum(x.w is not None for x in plain.values()) > 40
    for i, (at, measured) in got.items():
        assert at == (plain[i].w if i in plain else None)
        assert measured <= (max(plain[i].n, 0) + 3 if i in plain else 0)
    assert sum(m for _, m in got.values()) < sum(max(x.n, 0) for x in plain.values()) / 2


@pytest.mark.parametrize("cap", [1, 100, 2500])
def test_bins_of_hot_groups_are_those_of_the_fold(spark, cap):
    from textloom.operators import bundles

    rnd = random.Random(cap)
    rows = [(i, rnd.choice(["hot", "hot", "hot", None, f"g{i % 5}"]), rnd.choice([0, 0, 1, 7, 60, 99, 100, 101, 3000, None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "id int, g string, size int").withColumn("bin_of", F.lit("kept"))
    got = {r.id: (r.bin, r.bin_size) for r in bundles.pack(df, ["g"], "size", [F.desc("id")], cap, hot=20, block=16).collect()}
    assert got == {r.id: (r.bin, r.bin_size) for r in bundles.pack(df, ["g"], "size", [F.desc("id")], cap).collect()}
    for group in ("hot", None, "g1"):
        number, used, want = -1, 0, {}
        for i, _, s in sorted((r for r in rows if r[1] == group), reverse=True):
            if number < 0 or used + (s or 0) > cap:
                number, used = number + 1, 0
            used += s or 0
            want[i] = number
        assert {i: got[i][0] for i in want} == want
    assert bundles.pack(df.limit(0), ["g"], "size", [F.col("id")], cap).count() == 0


def test_snippets_by_their_rarest_line(spark):
    files = {1: "a\nb\na\nc\na\nb", 2: "b\n\n a \nc", 3: None, 4: "x\nx\nx\ny", 5: ""}
    snippets = [("ab", "a\nb"), ("ac", "a\n\nc"), ("xxy", "x\nx\ny"), ("no", "a\nz"), ("none", None), ("blank", " "), ("one", "c"), ("two", "a\nb"), ("two", "c"), ("aba", "b\na\nc\na")]
    found = locate.search_snippets(spark.createDataFrame(snippets, "s string, t string"), spark.createDataFrame(list(files.items()), "k int, c string"), "s", "t", "k", "c")
    assert {(r.s, r.k, r["at"]) for r in found.collect()} == {("ab", 1, 1), ("ac", 1, 3), ("ac", 2, 2), ("xxy", 4, 2), ("one", 1, 4), ("one", 2, 3), ("two", 1, 1), ("two", 2, 3), ("aba", 1, 2)}


def test_equal_snippets_are_searched_as_one(spark, monkeypatch):
    """What is looked up grows with the snippets' different texts; before, each of n equal snippets met each of n files."""
    monkeypatch.setattr(locate, "SHARED", 7)
    rows, write = {}, locate.materialise

    def seen(df, label):
        out = write(df, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(locate, "materialise", seen)
    files = spark.createDataFrame([(i, f"own {i}\nsame\nlines") for i in range(40)], "k int, c string")
    snippets = spark.createDataFrame([(i, " same\n\nlines" if i % 2 else "same\nlines") for i in range(40)] + [(3, "own 5"), (None, "own 6\nsame")], "s int, t string")
    found = locate.search_snippets(snippets, files, "s", "t", "k", "c").collect()
    assert sorted((-1 if r.s is None else r.s, r.k, r["at"]) for r in found) == sorted([(i, k, 1 if (i, k) == (3, 5) else 2) for i in range(40) for k in range(40)] + [(-1, 6, 1)])
    assert rows["met"] == 42
