"""Pattern rewriting, checked against an engine with RE2 syntax."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loglane.functions.regex import quote, replace_all, translate, translate_replacement

TEXTS = [
    "", "a", "b\n", "foo bar", "foo\nbar", "bar\n", "User=12 k=9", "Été à Paris", "caña", "x.y@z.org", "[tag] a]b",
    "a&&b", "tab\there", "vt\x0bhere", "AbC_9", "10.0.0.1", "{x}", "a{2}", "aa", "aaa", "\x1b[31mred\x1b[0m", "K", "line1\r\nline2",
    "ſ", "σς", "ZÜRICH zürich", "a^b", "-", "end\n\n",
]

PATTERNS = [
    "foo", "^foo", "bar$", "(?m)^bar$", "(?m)r$", "o.b", "(?s)o.b", "(?i)été", "(?i)zürich", "(?P<n>fo+) (?P<m>bar)", "(?<n>fo+)",
    "[[:alpha:]]+", "[[:digit:]_]", "[^[:space:]]", "[[:^alpha:]]", "[[:word:]]", r"\bbar\b", r"\bt\b", r"\Br", r"a\b", r"é\b",
    r"[&&]", "[a&&b]", "[[]", "[]a]", "[^]a]", r"[\]x]", "a{2}", "a{2,}", "a{1,2}?", "{x}", "a{", "x{,2}", r"\d+", r"\s", r"\S+", r"\v",
    r"[\s]", r"[^\S]", r"\Qa&&b\E", r"\Q[tag", r"\pL", r"\p{Lu}", r"\p{Greek}", r"\PL", r"\x41", r"\x{E9}", r"\.", r"a|", "|", "(a|b)*",
    "(?i:USER)=", "(?i)k", "(?-i)K", r"\Afoo", r"bar\z", "a*?", "x??", "(?m:^bar$)|q", "$", "^$", "(?m)^$", "a^b", r"a\^b", "[a^]", "-", "[a-c-]",
    r"\x1b\[[0-9;]*m", "[.]", "é|ñ", "(?i)[ä-ü]",
]


def test_matches_like_re2(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    cols = [F.col("t").rlike(translate(p).java).alias(f"p{n}") for n, p in enumerate(PATTERNS)]
    got = [tuple(r)[1:] for r in df.select("i", *cols).orderBy("i").collect()]
    con = duckdb.connect()
    wrong = []
    for i, t in enumerate(TEXTS):
        for n, p in enumerate(PATTERNS):
            # Option s: a dot matches newlines; off unless the pattern asks for it.
            want = con.execute("SELECT regexp_matches(?, ?, 'c')", [t, "(?-s)" + p.replace("(?<n>", "(?P<n>")]).fetchall()[0][0]
            if got[i][n] != want:
                wrong.append((p, t, got[i][n], want))
    assert not wrong


@pytest.mark.parametrize(
    "pattern",
    ["(", ")", "[a", "a**", "a++", "*a", "(?=a)", "(?!a)", "(?<=a)", r"\1", r"\Z", r"\k<n>", "(?x)a", "(?U)a", "a{3,2}", "a{1001}", "\\",
     "[[:nope:]]", "(?P<n>a)(?P<n>b)", r"\y", "a{2}{3}", "(?P=n)", "(?>a)"],
)
def test_rejected(pattern):
    with pytest.raises(ValueError):
        translate(pattern)


@pytest.mark.parametrize(
    "pattern,template,want",
    [
        (r"(\d+)", "<$1>", "a<12>b<3>"),
        (r"(\d+)", "<${1}x>", "a<12x>b<3x>"),
        (r"(\d+)", "<$1x>", "a<>b<>"),
        (r"(?P<num>\d+)", "<${num}>", "a<12>b<3>"),
        (r"(?P<the_num>\d)(\d)?", "$the_num", "a1b3"),
        (r"\d+", "$$", "a$b$"),
        (r"\d+", r"\1", r"a\1b\1"),
        (r"\d+", "$3", "ab"),
        (r"(\d)", "${1}0", "a1020b30"),
        (r"\d+", "[$0]", "a[12]b[3]"),
        (r"\d+", "é", "aébé"),
    ],
)
def test_replacements(spark, pattern, template, want):
    df = spark.createDataFrame([("a12b3",)], "t string")
    assert df.select(replace_all(F.col("t"), pattern, template)).first()[0] == want


def test_quote(spark):
    text = "a.b*[c](d){e}^$|?+\\ -&é"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.col("t").rlike(translate("^" + quote(text) + "$").java)).first()[0]


def test_groups():
    p = translate("(a)(?:b)(?P<c>d)")
    assert p.groups == 2 and p.names == {"c": 2}
    assert translate_replacement("$c-$1", p) == "$2-$1"


def test_empty_matches_are_refused_where_the_last_one_ended(spark):
    """Random patterns that can match nothing, against RE2."""
    rnd = random.Random(3)

    def pattern(depth):
        kind = rnd.randrange(7 if depth else 3)
        if kind < 3:
            return rnd.choice(["a", "b", "c", "^", "$", ".", r"\b", "[ab]", r"\Qab\E"])
        if kind == 3:
            return pattern(depth - 1) + pattern(depth - 1)
        if kind < 6:
            inner = pattern(depth - 1) + ("|" + pattern(depth - 1)) * (kind == 4)
            return rnd.choice(["(?:", "(", "(?i:", "(?P<n%d>" % rnd.randrange(10**9)]) + inner + ")" + rnd.choice(["", "?", "+", "{0,2}"])
        return rnd.choice("abc.") + rnd.choice(["*", "?", "*?", "+", "{0}", "{0,1}"])

    patterns = sorted({pattern(3) for _ in range(150)} | {"", "a*", "x?|b", r"\Qab\E*", "(|a)+"})
    texts = ["baac", "", "aab c", "𝄞a", "é\nz a", " cab", "abab"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for at in range(0, len(patterns), 40):
        some = patterns[at : at + 40]
        for row in df.select("t", *[replace_all(F.col("t"), p, "-").alias(f"c{i}") for i, p in enumerate(some)]).collect():
            for p, got in zip(some, row[1:], strict=True):
                assert got == duckdb.execute("SELECT regexp_replace(?, ?, '-', 'g')", [row[0], p]).fetchone()[0], (p, row[0])
    nullable = {"a*": True, "a+": False, "(a|)b": False, "(a|)b?": True, "a{0,3}": True, "a{1}": False, "^$": True, "(?i)(a?)*": True, "a|b*": True, "[a]|.": False}
    assert {p: translate(p).nullable for p in nullable} == nullable
