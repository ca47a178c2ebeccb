"""Extended expressions: hits, misses, errors as values, and what matches must hold."""

import itertools
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.functions import ere

#: expression, lines that match, lines that don't
TABLE = [
    (r"[\d]", ["a\\b", "d"], ["7", "x"]),  # a backslash in brackets is itself
    (r"\d", ["d"], ["7"]),
    (r"foo\>", ["foo", "foo bar", "a-foo)"], ["food", "foo_", ">"]),
    (r"\<foo", ["foo", "a foo", "<foo"], ["afoo", "_foo"]),
    (r"\bfoo\b", ["a foo b"], ["foos"]),
    (r"o\Bx", ["fox"], ["o x"]),
    (r"[]a]+b", ["]b", "ab"], ["b"]),
    (r"[^]a]b", ["xb"], ["]b", "ab", "b"]),
    (r"[a-]x", ["-x", "ax"], ["bx"]),
    (r"[[:digit:]]{3}", ["a123"], ["12"]),
    (r"[^[:space:][:punct:]]{2}", ["ab"], ["a b", ".."]),
    (r"[[=a=][.-.]]z", ["az", "-z"], ["bz"]),
    (r"a{,2}b", ["b", "aab"], ["c"]),
    (r"^a{2,}$", ["aa", "aaaa"], ["a", "aab"]),
    (r"a)b", ["a)b"], ["ab"]),  # alone, a closing parenthesis is itself
    (r"a\{2", ["a{2"], ["aa"]),
    (r"}", ["}"], ["{"]),
    (r"(ab|cd)+e", ["abcde"], ["ae"]),
    (r"(a)(b)\2", ["abb"], ["aba"]),
    (r"(x*)*y", ["xxy", "y"], ["x"]),
    (r"a+?b", ["aab", "b"], ["a"]),  # no lazy repetition: a+ or nothing
    (r"a||b", ["", "zzz"], []),
    (r"()x", ["x"], ["y"]),
    (r"a.c", ["abc", "a\rc", "a c", "a😀c"], ["ac"]),
    (r"\.\*\[\]\^\$\\\|", [".*[]^$\\|"], ["xyz"]),
    (r"#é😀\-/", ["#é😀-/"], ["#e"]),
    (r"\w\W\s\S", ["a- b"], ["ab c"]),
    (r"a$|^b", ["xa", "bx"], ["ax", "xb"]),
    (r"x^y|a$b", [], ["x^y", "a$b"]),
    (r"\`ab\'", ["ab"], ["abc"]),
    ("", ["", "x"], []),
]
INVALID = [
    "x{2", "x{", "x{}", "x{a}", "x{3,2}", "x{99999}", "[a", "[", "[]", "[^]", "[[:alpha:]", "[[:nope:]]", "[z-a]", "[[:digit:]-z]", "[[.xy.]]", "(a", "a(b|c", "a\\", "*a", "+", "?x", "{1}", "a|*b", "(*a)", "^*", "a$+", "\\1", "(a\\1)", "(a)\\2", "(" * 300 + ")" * 300
]


@pytest.fixture(scope="module")
def matched(spark):
    from pyspark.sql import functions as F

    pairs = [(i, s) for i, (_, hits, misses) in enumerate(TABLE) for s in hits + misses]
    rows = spark.createDataFrame(pairs, "i int, s string")
    found = F.coalesce(*[F.when(F.col("i") == i, F.col("s").rlike(ere.compile_ere(p)[0])) for i, (p, _, _) in enumerate(TABLE)])
    return {(r.i, r.s): r.hit for r in rows.withColumn("hit", found).collect()}


@pytest.mark.parametrize("i", range(len(TABLE)))
def test_hits_and_misses(matched, i):
    _, hits, misses = TABLE[i]
    assert all(matched[i, s] for s in hits) and not any(matched[i, s] for s in misses)


@pytest.mark.parametrize("pattern", INVALID)
def test_errors_are_values(pattern):
    found, reason = ere.compile_ere(pattern)
    assert found is None and reason


@settings(max_examples=2000, deadline=None)
@given(st.text("ab(){}[]*+?|^$\\.,1-:=é", max_size=12))
def test_any_text_is_an_expression_or_an_error(text):
    found, reason = ere.compile_ere(text)
    assert (found is None) != (reason is None)


def holds(query, text):
    data = text.encode()
    kind = query[0]
    if kind == "all":
        return True
    if kind == "has":
        return query[1] in text
    if kind == "gram":
        return query[1].to_bytes(3, "big") in data
    return (all if kind == "and" else any)(holds(x, text) for x in query[1:])


def test_what_matches_hold():
    get = lambda p: ere.held(ere.parse(p))
    assert get("abc") == ("has", "abc") and get("a.c") == ("and", ("has", "a"), ("has", "c")) and get("x*") == ere.ANYTHING
    assert get("(foo|bar).+") == ("or", ("has", "bar"), ("has", "foo")) and get("ab?c") == ("or", ("has", "abc"), ("has", "ac"))
    assert get("a|.*") == ere.ANYTHING and get("(ab){2}") == ("has", "abab") and get("(abc)+d") == ("and", ("has", "abc"), ("has", "d"))
    assert ere.grams(("has", "abcd")) == ("and", ("gram", 0x616263), ("gram", 0x626364)) and ere.grams(("has", "ab")) == ere.ANYTHING
    assert ere.grams(("or", ("has", "abc"), ("has", "ab"))) == ere.ANYTHING


@settings(max_examples=400, deadline=None)
@given(st.recursive(st.sampled_from(["a", "b", "ab", ".", "[ab]", "[^a]", "^", "$", "é"]), lambda x: st.one_of(st.tuples(x, x).map("".join), st.tuples(x, x).map(lambda p: f"({p[0]}|{p[1]})"), st.tuples(x, st.sampled_from(["*", "+", "?", "{2}", "{1,2}", "{0,3}"])).map(lambda p: f"({p[0]}){p[1]}")), max_leaves=8))
def test_no_match_is_lost_by_grams(pattern):
    tree = ere.parse(pattern)
    query = ere.held(tree)
    plain = re.compile(pattern.replace("$", r"\Z"))
    for n in range(5):
        for text in map("".join, itertools.product("abé", repeat=n)):
            if plain.search(text):
                assert holds(query, text) and holds(ere.grams(query), text)


QUERIES = ["benchmark", "colour|color", "[[:digit:]]{3}-x", "needle.*stack", "(foo|bar)baz", "x", "", "x{2", "^needle$", "é😀!", "nee(dle)+s?$", "a\\", "[nN]eedle", "zzz"]


def test_outcomes_and_index_give_what_the_scan_gives(spark, tmp_path):
    from textloom.operators import lines, text_index

    texts = ["a needle in a stack\nneedle", "colour\n123-x", "foobaz\nbarbaz é😀! x", "NEEDLE Needle", "needle\0binary", None, "", "needl\ne", "nee dle stack needle", "xé😀!y", "needles\nneedledles"] + [f"filler {i}" for i in range(60)]
    files = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").repartition(3)
    folder = f"file://{tmp_path}/index"
    text_index.build(files, "id", "t", folder, block=8)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    told = {r.query: r for r in lines.outcomes(files, "id", "t", QUERIES).collect()}
    read = {r["query"]: r for r in text_index.reads(spark, folder, QUERIES).collect()}
    for q in QUERIES:
        scanned = rows(lines.search(files, "id", "t", q))
        assert rows(text_index.indexed_search(spark, folder, q).select("key", "line", "content")) == scanned
        assert tuple(lines.outcome(files, "id", "t", q).first()) == tuple(told[q]) and told[q].total_matches == len(scanned)
        assert len({r[0] for r in scanned}) <= read[q].files_read <= read[q].files == len(texts)
    assert read["needle.*stack"].files_read == 2 and read["x"].files_read == len(texts) and read["x{2"].files_read == 0
    assert told["x{2"].reason == told["zzz"].reason == "no matches or invalid pattern" and told[""].reason == "empty query" and told["x"].reason is None
    text_index.build(files.limit(0), "id", "t", f"{folder}0")
    assert text_index.indexed_search(spark, f"{folder}0", "needle").count() == 0
    stream = spark.createDataFrame([(1, "x{2")], "id long, t string")
    assert lines.search(stream, "id", "t", "x{2").count() == 0 and lines.search(stream, "id", "t", r"x\{2").count() == 1
