"""Long lines, and files asked for many or few lines, in the edit-distance join."""

import random
import time

from pyspark.sql import functions as F

from textloom.operators import locate


def test_edit_distances_against_the_whole_table():
    rnd = random.Random(2)
    text = lambda most: "".join(rnd.choice("abé ") for _ in range(rnd.randrange(most)))
    for _ in range(600):
        a = text(rnd.choice((2, 9, 90)))
        b = text(9) if rnd.random() < 0.3 else "".join(rnd.choice((c, c, c, c, "", "z", c + "z")) for c in a)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
        for most in (0, 3, row[-1], row[-1] - 1, 200):
            assert locate.edit_distance(a, b, most) == (row[-1] if row[-1] <= most else None)


def test_few_and_many_lines_asked_of_a_file_give_the_same_places(spark, monkeypatch):
    rnd = random.Random(3)
    line = lambda: "".join(rnd.choice("abcd é") for _ in range(rnd.choice((1, 5, 20, 60))))
    files = [(f, "\n".join(line() for _ in range(12))) for f in range(20)] + [(None, "abc")]
    wanted = [(i, f, "\n".join(x[:7] + "z" + x[7:] if len(x) > 9 else x for x in t.split("\n")[at : at + 2])) for i, (f, t, at) in enumerate((f, t, rnd.randrange(11)) for f, t in files * 3)]
    df = spark.createDataFrame(wanted, "i int, f int, code string")
    fs = spark.createDataFrame(files, "f int, text string")
    places = lambda: {r.i: r["at"] for r in locate.fuzzy_join(df, fs, ["f"], "code", "text").collect()}
    few = places()
    monkeypatch.setattr(locate, "TOLD", 4)
    assert few == places() and sum(x is not None for x in few.values()) > 40


def test_lines_of_many_thousand_characters(spark):
    """Before, every character was looked up among all pieces of the line asked for, and every distance walked its whole band."""
    rnd = random.Random(5)
    files = [(f, " ".join("".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(3500))) for f in range(6)]
    wanted = [(f, t[:9000] + "Z" + t[9000:-50] + " end") for f, t in files]
    fs, df = spark.createDataFrame(files, "f int, text string"), spark.createDataFrame(wanted, "f int, code string")
    began = time.time()
    assert [r["at"] for r in locate.fuzzy_join(df, fs, ["f"], "code", "text").collect()] == [1] * 6
    took = time.time() - began
    plain = df.join(fs, "f").select(F.length("text").alias("n")).collect()
    assert min(r.n for r in plain) > 25_000 and took < 25
