"""Alerts of a table of rules against alerts of a list, and literals that matches must contain."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loglane.functions.regex import required_literals
from loglane.operators import aggregates as ag
from loglane.operators import rules as ru
from loglane.plans.lineage import BROADCAST_BYTES


def test_literals_by_hand():
    want = {
        "abc": ["abc"], "ab?c": ["a"], "ab+cd": ["ab"], "ab{0}cde": ["cde"], "ab{2}c": ["ab"], "abc|de": ["abc", "de"], "abc|d*": [],
        r"x\.y\d+zzz": ["x.y"], r"^user=1\b k$": ["user=1 k"], "(abc)de": ["de"], "(a|b)": [], "[a-z]x[]y]": ["x"], r"\Qa.b|c\Ede": ["a.b|cde"],
        r"\Qab\E*c": ["a"], "(?i)abc": [], "ab(?i:c)": [], "(?s)a.bc": ["bc"], r"a\x41bc": ["bc"], r"a\pLbc\p{Greek}d": ["bc"], "": [], "ab**"[:3]: ["a"],
        r"(\)x)yy": ["yy"], r"([)]z)yy": ["yy"], "é{1,2}éa": ["éa"], "ab{,2}": ["ab{,2}"],
    }
    assert {p: required_literals(p) for p in want} == want


def test_matches_contain_a_literal():
    rnd = random.Random(7)

    def pattern(depth):
        kind = rnd.randrange(8 if depth else 4)
        if kind < 3:
            return rnd.choice(["a", "b", "c", "ab", "ca", r"\.", r"\b", "[ab]", ".", r"\d", r"\Qa\E", "^", "$"])
        if kind == 3:
            return rnd.choice("abc.") + rnd.choice(["*", "?", "+", "{0,2}", "{2}", "??", "{1,}"])
        if kind < 6:
            return pattern(depth - 1) + pattern(depth - 1)
        return rnd.choice(["(?:", "("]) + pattern(depth - 1) + rnd.choice(["", "|" + pattern(depth - 1)]) + ")" + rnd.choice(["", "?", "+"])

    texts = ["".join(rnd.choices("abc.1", k=rnd.randrange(9))) for _ in range(60)]
    found = 0
    for _ in range(400):
        p = "|".join(pattern(3) for _ in range(rnd.choice([1, 1, 2])))
        literals = required_literals(p)
        for t in texts:
            if literals and duckdb.execute("SELECT regexp_matches(?, ?)", [t, p]).fetchone()[0]:
                found += 1
                assert any(x in t for x in literals), (p, t, literals)
    assert found > 200


@pytest.mark.parametrize("most", [BROADCAST_BYTES, 0])
def test_a_table_of_rules_is_a_list_of_rules(spark, monkeypatch, most):
    """Broadcast or joined, in several passes over rules without a literal."""
    monkeypatch.setattr(ru, "broadcast_if_small", lambda df: F.broadcast(df) if most else df)
    monkeypatch.setattr(ru, "PASS_RULES", 2)
    rnd = random.Random(5)
    lines = [(i, rnd.choice(["a", "b", None]), " ".join(rnd.choices(["get", "user=12", "user=1", "Été", "x" * 40, "k=7", "", "𝄞"], k=4))) for i in range(80)]
    lines += [(90, "a", None), (91, "a", ""), (92, None, "y" * 5000 + "user=12")]
    df = spark.createDataFrame(lines, "seq long, service string, text string")
    rules = [("one", r"user=1\b"), ("two", "user=12 k=7|Été"), ("x", "x{40}"), ("long", "x" * 17 + "+ get"), ("any", "(user|k)=[0-9]"), ("low", "(?i)é"), ("end", "𝄞$"), ("empty", "^$"), ("none", "zzz")]
    got = ru.table_alerts(df, spark.createDataFrame([*rules, rules[0]], "rule string, pattern string"))
    want = ag.alerts(df, rules).select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    none = spark.createDataFrame([], "rule string, pattern string")
    assert ru.table_alerts(df, none).collect() == [] and ru.table_alerts(df.limit(0), spark.createDataFrame(rules, none.schema)).collect() == []
    for bad in [("", "a"), ("r", "(")]:
        with pytest.raises(Exception, match="alerts: rule name|invalid pattern"):
            ru.table_alerts(df, spark.createDataFrame([bad], none.schema)).collect()


def test_rules_that_share_a_piece_are_told_apart_in_the_join(spark):
    rules = [(f"r{k}", rf"user=12 [a-z]={k}\b") for k in range(30)] + [("two", "user=12 k=|a=1.b user=12 k="), ("alt", "ab.cd|ab.ef")]
    table = spark.createDataFrame(rules, "rule string, pattern string")
    others = {(r["rule"], r["literal"]): r["others"] for r in ru._parsed(table).collect()}
    assert others["r7", "user=12 "] == ["=7"] and others["two", "user=12 k="] == [] and others["two", "b user=12 k="] == ["a=1"]
    assert others["alt", "ab"] == []
    lines = [(i, "s", f"{'a=1xb ' if i % 3 else ''}user=12 k={i % 40} ab{'-' * (i % 2)}ef") for i in range(60)]
    df = spark.createDataFrame(lines, "seq long, service string, text string")
    got = ru.table_alerts(df, table)
    want = ag.alerts(df, rules).select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
