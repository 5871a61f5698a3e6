"""Filters, transforms and counts: literal cases, null text, parameter checks."""

import json
import random
from datetime import datetime, timedelta

import pytest
from helpers import T0, texts
from pyspark.sql import functions as F

import interpreters as it
from loglane.functions import text as tx
from loglane.functions.json_indent import indent_json
from loglane.operators import aggregates as ag
from loglane.operators import drift as dr
from loglane.operators import filters as fl
from loglane.operators import transforms as tf


def lines(logs, *texts_):
    return logs([("s", t) for t in texts_])


def one(op, logs, text):
    return texts(op(lines(logs, text)))[0]


def test_include_exclude(logs):
    df = lines(logs, "error a", "error b", "info", None)
    assert texts(fl.include_exclude(df)) == ["error a", "error b", "info", None]
    assert texts(fl.include_exclude(df, ["error"], ["b$"])) == ["error a"]
    assert texts(fl.include_exclude(df, exclude=["error"])) == ["info", None]


def test_grep(logs):
    df = lines(logs, "foo", "bar", None)
    assert texts(fl.grep(df, ["^f", "zzz"])) == ["foo"]
    assert texts(fl.grep(df, ["^f"], invert=True)) == ["bar", None]


def test_level(logs):
    df = lines(logs, "INFO WARN error", "Warning", "information", "x")
    assert [r[0] for r in df.orderBy("seq").select(fl.level(F.col("text"))).collect()] == [3, 2, 1, 0]
    assert texts(fl.level_filter(df, "Warn")) == ["INFO WARN error", "Warning"]
    assert len(texts(fl.level_filter(df, "debug"))) == 4


def test_since(logs):
    df = lines(
        logs, "2024-03-15 08:59:59 a", "2024-03-15 09:00:00 b", "2024-03-15 09:01:00", "2024-03-14 10:00:00 d", "no time", None
    )
    assert texts(fl.since(df, T0)) == ["2024-03-15 09:00:00 b", "2024-03-15 09:01:00", "no time", None]


def test_since_relative(logs):
    df = lines(logs, "2024-03-15 08:59:59 a", "2024-03-15 09:00:00 b", "no time")
    later = T0 + timedelta(hours=1, minutes=30)
    for span in ("1h30m", "90m", "5400s", "1.5h", "90 minutes", timedelta(minutes=90)):
        assert texts(fl.since(df, span, now=later)) == ["2024-03-15 09:00:00 b", "no time"]
    assert texts(fl.since(df, "1h")) == ["no time"]
    for bad in ("0s", "-5m", "5", "5x", "", None, 7):
        with pytest.raises(ValueError):
            fl.since(df, bad, now=later)


def test_since_layouts(logs):
    cutoff = datetime(2024, 1, 10)
    df = lines(
        logs, "2024-01-09T23:59:59Z rest of message", "2024-01-10T00:00:00Z", "2024-01-10T00:30:00+01:00 before in UTC",
        "2024-01-09T23:30:00-01:00 after in UTC", "2024-01-10T00:00:00.123456789Z frac", "Jan 9 10:00:00 old", "Jan 10 00:00:01 new", "Feb 30 00:00:00 none",
    )
    kept = texts(fl.since(df, cutoff))
    assert [k.split(" ")[0] for k in kept] == [
        "2024-01-10T00:00:00Z", "2024-01-09T23:30:00-01:00", "2024-01-10T00:00:00.123456789Z", "Jan", "Feb"
    ]
    assert texts(fl.since(lines(logs, "09/01/2024 x", "11/01/2024 y"), cutoff, ("02/01/2006",))) == ["11/01/2024 y"]


def test_route(logs):
    df = lines(logs, "ERROR: disk full", "WARN: low memory", "info: all good", None)
    rules = [("errors", "(?i)error"), ("warn", "WARN")]
    got = [r["bucket"] for r in fl.route(df, rules, "other").orderBy("seq").collect()]
    assert got == ["errors", "warn", "other", "other"]
    assert fl.route(df, rules).count() == 2
    assert fl.route(df, rules, "other", wanted=["warn"]).count() == 1


def test_plain_stamps(logs):
    assert one(lambda d: tf.prefix(d, "> "), logs, "x") == "> x"
    assert one(tf.indent, logs, "x") == "  x"
    assert one(lambda d: tf.bracket(d, "[", "]"), logs, "x") == "[x]"
    assert one(lambda d: tf.bracket(d, "", "!"), logs, "x") == "x!"
    assert one(lambda d: tf.prefix(d, "> "), logs, None) is None


def test_normalize_and_strip(logs):
    raw = " \t A\t  B \n　"
    assert one(lambda d: tf.normalize(d, trim=True), logs, raw) == "A\t  B"
    assert one(lambda d: tf.normalize(d, collapse_spaces=True), logs, raw) == " A   B 　"
    assert one(lambda d: tf.normalize(d, trim=True, lowercase=True), logs, raw) == "a\t  b"
    assert one(lambda d: tf.strip(d, ansi=True), logs, "\x1b[1;31mx\x1b[K ") == "x "
    assert one(lambda d: tf.strip(d, ansi=True, whitespace=True), logs, "\x1b[1;31m x\x1b[K ") == "x"
    assert one(tf.strip_colours, logs, "\x1b[31mx\x1b[K") == "x\x1b[K"


def test_mask_and_redact(logs):
    assert one(lambda d: tf.mask(d, [r"\d+"], "NUM"), logs, "got 42 errors") == "got NUM errors"
    assert one(lambda d: tf.mask(d, [r"\d+"], "NUM"), logs, "no digits here") == "no digits here"
    assert one(lambda d: tf.mask(d, [r"\d+"]), logs, "a1") == "a[MASKED]"
    assert one(lambda d: tf.mask(d, [r"\d+"], "$1"), logs, "a1") == "a"
    assert one(lambda d: tf.redact(d, [(r"(\w+)@\w+", "${1}@x"), ("x", "y")]), logs, "bob@corp") == "bob@y"
    assert one(lambda d: tf.redact(d, []), logs, "same") == "same"


@pytest.mark.parametrize(
    "text,size,want",
    [
        ("hello world", 5, "hello..."), ("hello", 5, "hello"), ("this is too long", 5, "this ..."), ("éééé", 5, "éé..."),
        ("a€€", 3, "a..."), ("a€€", 4, "a€..."), ("😀😀", 7, "😀..."), ("😀😀", 3, "..."), ("€", 1, "..."), ("aé", 2, "a..."), ("abé", 2, "ab..."),
    ],
)
def test_truncate(logs, text, size, want):
    assert one(lambda d: tf.truncate(d, size), logs, text) == want


def test_truncate_default(logs):
    assert one(lambda d: tf.truncate(d, 0, "!"), logs, "x" * 2000) == "x" * 1024 + "!"


def test_stamp_time(logs):
    df = logs([("s", "m", 3723.5)])
    assert texts(tf.stamp_time(df)) == ["2024-03-15T10:02:03Z m"]
    assert texts(tf.stamp_time(df, "unix")) == ["1710496923 m"]
    assert texts(tf.stamp_time(df, "kitchen")) == ["10:02AM m"]
    assert texts(tf.stamp_time(df, "relative", started=T0)) == ["+1h2m3.5s m"]


@pytest.mark.parametrize(
    "us,want",
    [(0, "0s"), (5_000, "5ms"), (999, "0s"), (1_500_000, "1.5s"), (60_000_000, "1m0s"), (3_600_000_000, "1h0m0s"), (-1_500_000, "-1.5s"),
     (90_061_001_000, "25h1m1.001s"), (-7_000, "-7ms"), (10_000_000, "10s"), (1_250_999, "1.25s")],
)
def test_duration_text(spark, us, want):
    assert spark.range(1).select(tx.duration_text(F.lit(us).cast("bigint"))).first()[0] == want


def test_line_format(logs):
    df = logs([("api", "a {time} b", 0)])
    assert texts(tf.line_format(df, "{service}|{text}")) == ["api|a 2024-03-15T09:00:00Z b"]
    assert texts(tf.line_format(df, "{time}")) == ["2024-03-15T09:00:00Z"]


def test_columns(logs):
    op = lambda d: tf.columns(d, " ", [10, 15])
    assert one(op, logs, "INFO starting") == "%-10s%-15s" % ("INFO", "starting")
    assert one(op, logs, "INFO starting x y") == "%-10s%-15s x y" % ("INFO", "starting")
    assert one(op, logs, "averyveryverylong") == "averyveryverylong"
    assert one(lambda d: tf.columns(d, "|", [3]), logs, "é|b") == "é  |b"


def test_highlight(logs):
    assert one(lambda d: tf.highlight(d, [("err", "31")]), logs, "err x err") == "\x1b[31merr\x1b[0m x \x1b[31merr\x1b[0m"
    assert one(lambda d: tf.highlight(d, [("a", "$1\\")], "$", codes=False), logs, "a") == "$1\\a$"


def test_extract_fields(logs):
    kv = lambda t, *f: tf.extract_fields(lines(logs, t), list(f)).first()["fields"]
    js = lambda t, *f: tf.extract_fields(lines(logs, t), list(f), json=True).first()["fields"]
    assert kv('level=info msg="hello world" ignored=yes', "level", "msg") == {"level": "info", "msg": "hello world"}
    assert kv('a=1 a=2 b="" c=""x""', "a", "b", "c") == {"a": "2", "b": "", "c": ""}
    assert kv("no fields", "a") == {}
    assert js('{"level":"warn","service":"api","other":"x"}', "level", "service") == {"level": "warn", "service": "api"}
    assert js("{bad", "a") == {} and js("[1]", "a") == {} and js('{"a":null}', "a") == {}
    assert js('{"a.b":1,"o":{"a":1}}', "a.b", "o") == {"a.b": "1", "o": '{"a":1}'}
    assert one(lambda d: tf.annotate_fields(d, ["b", "a"]), logs, "a=1 b=2") == "b=2 a=1 a=1 b=2"
    assert one(lambda d: tf.annotate_fields(d, ["a"]), logs, "no fields") == "no fields"


def test_json_pretty(logs):
    df = lines(logs, '{"level":"info","msg":"hello"}', "{bad json", "[1,2,3]", "plain", None, ' {"b":1.0,"a":[],"c":{ },"d":"x,{y"} ', "[NaN]")
    out = texts(tf.json_pretty(df))
    assert out[0] == '{\n  "level": "info",\n  "msg": "hello"\n}'
    assert out[1] == "{bad json" and out[3] == "plain" and out[4] is None and out[6] == "[NaN]"
    assert out[2] == "[\n  1,\n  2,\n  3\n]"
    assert out[5] == '{\n  "b": 1.0,\n  "a": [],\n  "c": {},\n  "d": "x,{y"\n}'
    assert indent_json("[[1]]", "\t") == "[\n\t[\n\t\t1\n\t]\n]"
    assert [r["is_json"] for r in tf.parse_json(df).orderBy("seq").collect()][:4] == [True, False, True, False]


def test_render(logs):
    df = logs([("api", "hello world\r\n", 0)])
    assert tf.render(df).first()["output"] == "2024-03-15T09:00:00Z api             hello world"
    assert tf.render(dr.drift(df)).first()["output"].endswith("hello world [DRIFT]")


@pytest.mark.parametrize(
    "a,b",
    [("hello", "hello"), ("", "hello"), ("a", "b"), ("night", "nacht"), ("aaaa", "aaaaaaaa"), ("éa", "éb"), ("abcabc", "abc"),
     ("connected to database at 10.0.0.1", "connected to database at 10.0.0.2")],
)
def test_dice(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(tx.dice(F.col("a"), F.col("b"))).first()[0] == it.dice(a, b)


def test_drift_literal_cases(logs):
    flags = lambda df: [r["drift"] for r in df.orderBy("seq").collect()]
    assert flags(dr.drift(logs([("a", "shared message"), ("b", "shared message")]))) == [True, False]
    assert flags(dr.drift(logs([("a", "INFO: ready"), ("b", " info: ready ")]))) == [True, False]
    near = logs([("a", "connected to database at 10.0.0.1"), ("b", "connected to database at 10.0.0.2")])
    assert flags(dr.drift(near, "fuzzy", 0.7)) == [True, False]
    far = logs([("a", "server started on port 8080"), ("b", "panic: nil pointer dereference")])
    assert flags(dr.drift(far, "fuzzy", 0)) == [True, True]


def test_baseline_and_two_services(logs):
    old = logs([("a", "x"), ("b", "y"), (None, "n")])
    new = logs([("a", "X "), ("a", "y"), (None, "n"), ("c", None)])
    assert texts(dr.baseline_drift(new, old)) == ["y", None]
    assert texts(dr.baseline_drift(old, new)) == ["y"]
    df = logs([("l", "a"), ("l", "A"), ("r", "a"), ("r", "b"), ("l", "c"), ("z", "d")])
    got = {(r["norm"], r["left_count"], r["right_count"], r["side"]) for r in dr.two_service_diff(df, "l", "r").collect()}
    assert got == {("a", 2, 1, "both"), ("b", 0, 1, "right"), ("c", 1, 0, "left")}


def test_counts(logs):
    df = logs([("api", "GET /health")] * 3 + [("api", "POST /login")] * 2 + [("api", "DELETE /item"), ("", "x"), (None, "y")], step=0)
    top = [(r["line"], r["count"], r["rank"]) for r in ag.top_lines(df.filter("service = 'api'"), 2).orderBy("rank").collect()]
    assert top == [("GET /health", 3, 1), ("POST /login", 2, 2)]
    assert [tuple(r) for r in ag.line_counts(df).collect()] == [("api", 6)]
    assert ag.line_count(df, "nope").first()[0] == 0
    two = logs([("api", "a"), ("api", "b"), ("worker", "c")])
    got = {(r["key"], r["count"]) for r in ag.window_counts(two, "10 seconds").collect()}
    assert got == {("api", 2), ("worker", 1)}


def test_window_count_at(logs):
    df = logs([("s", "a", 0), ("s", "b", 0), ("s", "c", 120), ("s", "later", 300)])
    assert ag.count_at(df, T0 + timedelta(seconds=120), "1 minute").first()["count"] == 1
    assert ag.count_at(df, T0 + timedelta(seconds=120), "2 minutes").first()["count"] == 3


def test_alerts(logs):
    df = logs([("api", "ERROR slow"), ("db", "slow"), ("db", None)])
    rules = [("err", "ERROR"), ("slow", "slow$")]
    got = {(r["rule"], r["service"], r["line"]) for r in ag.alerts(df, rules).collect()}
    assert got == {("err", "api", "ERROR slow"), ("slow", "api", "ERROR slow"), ("slow", "db", "slow")}
    got = {(r["rule"], r["service"], r["count"]) for r in ag.alert_counts(df, rules, "1 minute").collect()}
    assert got == {("err", "api", 1), ("slow", "api", 1), ("slow", "db", 1)}


@pytest.mark.parametrize(
    "call",
    [
        lambda d: fl.grep(d, []), lambda d: fl.grep(d, ["("]), lambda d: fl.include_exclude(d, ["["]), lambda d: fl.level_filter(d, "loud"),
        lambda d: fl.since(d, None), lambda d: fl.since(d, T0, ("zzz",)), lambda d: fl.route(d, []), lambda d: fl.route(d, [("", "a")]),
        lambda d: tf.label(d, ""), lambda d: tf.prefix(d, ""), lambda d: tf.bracket(d, "", ""), lambda d: tf.normalize(d), lambda d: tf.strip(d),
        lambda d: tf.mask(d, []), lambda d: tf.truncate(d, -1), lambda d: tf.stamp_time(d, "iso"), lambda d: tf.stamp_time(d, "relative"),
        lambda d: tf.line_format(d, ""), lambda d: tf.line_format(d, "{nope}"), lambda d: tf.columns(d, "", [1]), lambda d: tf.columns(d, " ", []),
        lambda d: tf.columns(d, " ", [0]), lambda d: tf.extract_fields(d, []), lambda d: ag.top_lines(d, 0), lambda d: ag.alerts(d, []),
        lambda d: ag.window_counts(d, 0), lambda d: dr.two_service_diff(d, "a", "a"), lambda d: ag.window_counts(d, "soon"),
    ],
)
def test_bad_parameters(logs, call):
    with pytest.raises(ValueError):
        call(logs([("s", "x")]))


def _is_json(t):
    """What the JSON of the standard says, by Python's parser; NaN and the like are refused."""

    def refuse(name):
        raise ValueError(name)

    body = t.strip(tx.WHITE_SPACE)
    if not body.startswith(("{", "[")):
        return False
    try:
        json.loads(body, parse_constant=refuse)
    except (ValueError, RecursionError):
        return False
    return True


def test_json_lines_may_repeat_keys_and_must_be_whole(spark):
    rnd = random.Random(3)
    texts = ['{"k":1,"k":2}', '{"k":1} x', "[1,2]\u00a0", '["a\\qb", "c"]', '["a\nb","c"]', "[v]", '{"a":01}', "[NaN]", "[1.]", "[-0,-1.5E+3]", "\x01", '["\x02"]']
    texts += ['{"k":"' + "x\\n" * 9000 + '"}', "[" * 300 + "]" * 300, "[[1]", "[1]]", '{"k":"\\u12"}', "", '{"a":{"k":5}, "k" : {"z":[]} }']
    texts += ["".join(rnd.choices(list('{}[],: 1') + ['"a"', '"k"', "true", '"\\n"'], k=rnd.randrange(1, 9))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "seq int, text string")
    got = tf.extract_fields(tf.parse_json(df), ["k", "none"], json=True).orderBy("seq").collect()
    for r in got:
        assert r.is_json == _is_json(r.text), r.text
        value = json.loads(r.text.strip(tx.WHITE_SPACE)).get("k") if r.is_json and r.text.strip().startswith("{") else None
        assert ("k" in r.fields) == (value is not None), r.text
    assert got[0].fields == {"k": "2"} and got[0].json is None and got[0].is_json
    assert got[18].fields == {"k": '{"z":[]}'}
    assert [r.is_json for r in tf.parse_json(spark.createDataFrame([(None,)], "text string")).collect()] == [False]
