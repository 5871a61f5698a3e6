"""Order-dependent operators against line-by-line interpreters, for several numbers of chunks."""

import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from helpers import SCHEMA, T0, texts
from pyspark.sql import functions as F

import interpreters as it
from loglane.operators import aggregates as ag
from loglane.operators import drift as dr
from loglane.operators import fuzzy
from loglane.operators import grouping as gr
from loglane.operators import ordered as od
from loglane.plans import chunks as ch

EPOCH = datetime(1970, 1, 1)


def random_lines(seed, n=120, ties=True):
    rnd = random.Random(seed)
    lines, us = [], int((T0 - EPOCH).total_seconds()) * 1_000_000
    seq = 0
    for _ in range(n):
        seq += rnd.choice([1, 1, 1, 50])
        us += rnd.choice([0, 0, 1, 1, 2, 3, 9]) * 500_000
        # One service holds most lines.
        service = rnd.choice(["a", "a", "a", "a", "b", "c", "", None])
        text = rnd.choice(["x", "x", "y", "START z", "end é", "x y", None])
        lines.append({"seq": seq, "service": service, "text": text, "us": us})
    return lines


def table(spark, lines):
    rows = [(r["seq"], r["service"], r["text"], EPOCH + timedelta(microseconds=r["us"])) for r in lines]
    return spark.createDataFrame(rows, SCHEMA)


def seqs(df):
    return sorted(r["seq"] for r in df.select("seq").collect())


@pytest.fixture(scope="module", params=[(1, 1), (2, 3), (3, 7)])
def case(request, spark):
    seed, chunks = request.param
    lines = random_lines(seed)
    return lines, table(spark, lines).cache(), chunks


def test_head_last_sample(case):
    lines, df, k = case
    assert seqs(od.head(df, 5, chunks=k)) == sorted(it.head(lines, 5))
    assert seqs(od.last_n(df, 6, chunks=k)) == it.last_n(lines, 6)
    assert seqs(od.sample_per_service(df, 3, chunks=k)) == sorted(it.every(lines, 3, True))
    assert seqs(od.sample_overall(df, 4, chunks=k)) == it.every(lines, 4, False)


def test_gate(case):
    lines, df, k = case
    for initially in (False, True):
        got = seqs(od.gate(df, "START", "x|z", initially_open=initially, chunks=k))
        assert got == it.gate(lines, "START", "x|z", initially)
    assert seqs(od.gate(df, "START", chunks=k)) == it.gate(lines, "START", None)
    assert seqs(od.gate(df, "x", "y", per_service=True, chunks=k)) == it.gate(lines, "x", "y", False, True)


def test_repeats(case):
    lines, df, k = case
    assert seqs(od.dedupe(df, chunks=k)) == it.suppress(lines, 1)
    assert seqs(od.suppress(df, 2, chunks=k)) == it.suppress(lines, 2)
    assert seqs(od.debounce(df, 1.5, chunks=k)) == it.debounce(lines, 1_500_000)


def test_stamps(case):
    lines, df, k = case
    got = [(r["seq"], r["offset"]) for r in od.with_byte_offset(df, chunks=k).orderBy("seq").collect()]
    assert got == it.offsets(lines)
    got = [r["text"] for r in od.sequence(df, chunks=k).orderBy("seq").collect()]
    assert got == [None if r["text"] is None else f"{r['text']} [#{i}]" for i, r in enumerate(lines, 1)]
    order = [r["service"] for r in od.service_order(df, chunks=k).orderBy("index").collect()]
    assert order == list(dict.fromkeys(r["service"] for r in lines))


def test_pace(case):
    lines, df, k = case
    for rate, per in ((1, False), (3, False), (1, True)):
        out = od.pace(df, rate, per_service=per, chunks=k)
        us = F.unix_micros(F.col("paced_ts").cast("timestamp"))
        got = [tuple(r) for r in out.select("seq", us).orderBy("seq").collect()]
        assert got == it.pace(lines, rate, per)


def test_reorder(case):
    lines, df, k = case
    base = int((T0 - EPOCH).total_seconds())
    extract = lambda t: F.when(t.startswith("x"), F.timestamp_seconds(F.lit(base) - F.length(t)))
    plain = lambda t: (base - len(t)) * 1_000_000 if t and t.startswith("x") else None
    out = od.reorder(df, 4.0, extract, chunks=k)
    got = [r["arrival_seq"] for r in out.orderBy("seq").collect()]
    assert got == it.reorder(lines, 4_000_000, plain)


def test_join_runs(case):
    lines, df, k = case
    for most in (2, 3, 10):
        out = gr.join_runs(df, "+", most, chunks=k).orderBy("seq")
        assert [(r["seq"], r["service"], r["text"]) for r in out.collect()] == it.join_runs(lines, "+", most)


def test_multiline(case):
    lines, df, k = case
    for timeout in (1.0, 4.0, 1000.0):
        out = gr.multiline(df, "START", timeout, chunks=k).orderBy("seq")
        got = [(r["service"], r["text"]) for r in out.collect()]
        assert got == it.multiline(lines, "START", int(timeout * 1e6))


def test_multiline_per_service(case):
    lines, df, k = case
    out = gr.multiline(df, "START", 3.0, per_service=True, chunks=k)
    got = sorted((repr(r["service"]), r["text"]) for r in out.collect())
    want = []
    for s in {r["service"] for r in lines}:
        part = it.multiline([r for r in lines if r["service"] == s], "START", 3_000_000)
        want += [(repr(s), text) for _, text in part]
    assert got == sorted(want)


def test_bursts(case):
    lines, df, k = case
    got = sorted((repr(r["service"]), r["text"]) for r in gr.coalesce_bursts(df, 2.0, chunks=k).collect())
    assert got == sorted((repr(s), t) for s, t in it.bursts(lines, 2_000_000))


@pytest.mark.parametrize("size,interval,block", [(5, None, 9), (5, 2.0, 5), (3, 4.0, 7), (50, 3.0, 60), (1, 1.0, 4)])
def test_batches(case, size, interval, block):
    lines, df, k = case
    out = gr.batches(df, size, interval, chunks=k, block_rows=block).orderBy("batch_id")
    got = [[x["seq"] for x in r["lines"]] for r in out.collect()]
    assert got == it.batches(lines, size, None if interval is None else int(interval * 1e6))


def test_batches_with_time_running_back(spark):
    rnd = random.Random(9)
    lines = random_lines(9)
    for r in lines:
        r["us"] += rnd.choice([-5, 0, 0, 4]) * 1_000_000
    out = gr.batches(table(spark, lines), 6, 3.0, chunks=3, block_rows=8).orderBy("batch_id")
    assert [[x["seq"] for x in r["lines"]] for r in out.collect()] == it.batches(lines, 6, 3_000_000)


def test_rolling_count(case):
    lines, df, k = case
    out = ag.rolling_count(df, 3.0, chunks=k).orderBy("seq")
    assert [(r["seq"], r["count"]) for r in out.collect()] == it.rolling(lines, 3_000_000)


def test_drift(case):
    lines, df, _ = case
    got = lambda d: sorted((r["seq"], r["drift"]) for r in d.collect())
    assert got(dr.drift(df)) == it.drift(lines)
    assert got(dr.drift(df, "unknown")) == it.drift(lines)
    assert got(dr.drift(df, scope="other_services")) == it.drift_other(lines)
    assert not any(d for _, d in got(dr.drift(df, "none")))


@pytest.mark.parametrize("seed,threshold", [(1, 0.8), (2, 0.5), (3, 1.0), (4, 0.3), (5, 0.65)])
def test_fuzzy_drift(spark, seed, threshold):
    rnd = random.Random(seed)
    lines = []
    for i in range(70):
        kind = rnd.random()
        if kind < 0.6:
            text = f"{rnd.choice(['GET', 'POST', 'put'])} /item/{rnd.randint(1, 999)} took {rnd.randint(1, 50)} ms"
        elif kind < 0.8:
            text = "".join(rnd.choice("abé ") for _ in range(rnd.randint(0, 40)))
        else:
            text = rnd.choice(["a" * rnd.randint(1, 60), "ab" * rnd.randint(1, 30), "x", "", None])
        lines.append({"seq": i * 3, "service": "s", "text": text, "us": i})
    out = dr.drift(table(spark, lines), "fuzzy", threshold)
    assert sorted((r["seq"], r["drift"]) for r in out.collect()) == it.drift(lines, threshold)


@pytest.mark.parametrize("short", [6, 25, 512])
def test_fuzzy_search_in_small_parts(spark, monkeypatch, short):
    """Without likely partners, with long texts, split tokens, split blocks and small matrices: nothing is lost."""
    for name, value in dict(SHORT=short, GROUP_ROWS=3, BUCKET_ROWS=8, BLOCK_TOKENS=60, CELLS=32, POSTINGS=5, SLICE=64).items():
        monkeypatch.setattr(fuzzy, name, value)
    monkeypatch.setattr(fuzzy, "_likely_pairs", lambda sets, norms: sets.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0))
    rnd = random.Random(short)
    stems = ["".join(rnd.choices("abcdeé ", k=rnd.choice([3, 12, 40]))) for _ in range(25)]
    lines = []
    for i in range(110):
        text = list(rnd.choice(stems))
        for _ in range(rnd.randrange(4)):
            text[rnd.randrange(len(text))] = rnd.choice("abcxyz")
        lines.append({"seq": i, "service": "s", "text": "".join(text) * rnd.choice([1, 1, 1, 2]), "us": i})
    lines += [{"seq": 200 + i, "service": "s", "text": t, "us": 200} for i, t in enumerate(["", None, "q", "ab" * 40, "ab" * 41, "ba" * 700])]
    for threshold in (0.55, 0.9):
        out = dr.drift(table(spark, lines), "fuzzy", threshold)
        assert sorted((r["seq"], r["drift"]) for r in out.collect()) == it.drift(lines, threshold)


@pytest.mark.parametrize("pivots", [(), (1, 2)])
def test_fuzzy_search_by_age(spark, monkeypatch, pivots):
    """Blocks of texts by age, with few pivots or none: nothing is lost, and no id or text twice."""
    for name, value in dict(PIVOTS=pivots, MANY=0, AGES=(0.1, 0.4), GROUP_ROWS=3, CELLS=64, CACHED=32).items():
        monkeypatch.setattr(fuzzy, name, value)
    rnd = random.Random(len(pivots))
    stems = ["".join(rnd.choices("abcdeé ", k=rnd.choice([5, 20, 90]))) for _ in range(12)]
    lines = []
    for i in range(90):
        text = list(rnd.choice(stems))
        text[rnd.randrange(len(text))] = rnd.choice("abcxyz")
        lines.append({"seq": i, "service": "s", "text": "".join(text), "us": i})
    out = dr.drift(table(spark, lines), "fuzzy", 0.85)
    assert sorted((r["seq"], r["drift"]) for r in out.collect()) == it.drift(lines, 0.85)


def test_texts_like_a_pivot_are_not_shuffled(spark, monkeypatch):
    """Neither pairs nor texts travel where a pivot is alike: only forms without a partner go on."""
    monkeypatch.setattr(fuzzy, "_likely_pairs", lambda sets, seekers: pytest.fail(f"{seekers.count()} sought") if seekers.count() > 1 else seekers.selectExpr("id a", "id b").limit(0))
    lines = [{"seq": i, "service": "s", "text": f"request number {i} of the day was served", "us": i} for i in range(400)]
    out = dr.drift(table(spark, lines), "fuzzy", 0.8)
    assert [r["seq"] for r in out.collect() if r["drift"]] == [0]
    sets = fuzzy.bigram_sets(spark.createDataFrame([("some text", 1), ("some texts", 2)], "norm string, first_seq long"))
    left = fuzzy._past_pivots(sets, fuzzy._pivots(sets, 4), 0.8)
    assert "Exchange" not in left._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert [r["id"] for r in left.collect()] == [1]


def test_forms_are_written_once_and_texts_stay_where_they_lie(spark, monkeypatch):
    """What disk is taken grows with the texts: seekers go to them a bounded number at a time, and no block is shuffled."""
    for name, value in dict(PIVOTS=(1,), MANY=0, AGES=(0.1, 0.4)).items():
        monkeypatch.setattr(fuzzy, name, value)
    for name, value in dict(SEEKERS=20, SEEKER_TOKENS=400, BUCKET_ROWS=16, BLOCK_ROWS=3).items():
        monkeypatch.setattr(fuzzy, name, value, raising=False)
    plans, sizes = [], []

    def cut(df, real=fuzzy.cut):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = real(df)
        sizes.append(out.count() if "norm" in out.columns else 0)
        return out

    monkeypatch.setattr(fuzzy, "cut", cut)
    rnd = random.Random(7)
    lines = [{"seq": i, "service": "s", "text": "".join(rnd.choices("abcdeé 12", k=rnd.choice([12, 30, 90]))), "us": i} for i in range(90)]
    for i in range(0, 90, 2):
        lines.append({"seq": 100 + i, "service": "s", "text": lines[i]["text"].replace("a", "x", 1), "us": 100 + i})
    out = dr.drift(table(spark, lines), "fuzzy", 0.8)
    assert sorted((r["seq"], r["drift"]) for r in out.collect()) == it.drift(lines, 0.8)
    assert not [p for p in plans if "CoGroup" in p]
    assert sizes.count(len({line["text"] for line in lines})) == 1


@pytest.mark.parametrize("threshold", [0.3, 0.8, 1.0])
def test_signatures_lose_no_similar_pair(threshold):
    """Not of texts that repeat a few bigrams very often, nor of those that have all bits."""
    rnd = random.Random(1)
    stems = ["".join(rnd.choices("abcdefghij ", k=k)) for k in (3, 20, 60, 300, 3000)] + ["ab" * 400, "a" * 700]
    texts = [bytes(x) for x in {bytes([rnd.choice(t.encode())]) + t.encode()[rnd.randrange(3) :] for t in stems for _ in range(9)}]
    owner, token = fuzzy.tokens_of(texts)
    sets = [{*token[owner == i].tolist()} for i in range(len(texts))]
    d = np.array([sum(t < 65_536 for t in x) for x in sets])
    sig = [x.tobytes() for x in fuzzy._signatures(owner, token, len(texts))]
    rows = pa.table({"id": range(len(texts)), "d": d, "m": [len(x) for x in sets], "sig": pa.array(sig, pa.binary()), "norm": [t.decode() for t in texts]})
    alike = np.array([[j < i and 2 * len(x & y) / (d[i] + d[j]) >= threshold for j, y in enumerate(sets)] for i, x in enumerate(sets)])
    a, every = fuzzy.Sets(rows), np.arange(len(texts))
    for some in np.split(every, [5, 30]):
        fits = fuzzy._fits(a, some, a, every, threshold)
        fuzzy._finely(a, some, a, every, fits, threshold)
        assert fits[alike[some]].all() and not fits.all()
    assert (fuzzy.partnered(a, every, a, every, threshold, finely=True) == alike.any(axis=1)).all()


def test_tokens_number_repeats():
    owner, token = fuzzy.tokens_of([b"abab", b"", b"a", b"aaa", "é".encode()])
    ab, ba, aa = (x[0] * 256 + x[1] for x in (b"ab", b"ba", b"aa"))
    assert list(zip(owner.tolist(), token.tolist())) == [(0, ab), (0, ab + 65_536), (0, ba), (3, aa), (3, aa + 65_536), (4, 0xC3A9)]


# --- chunks ---------------------------------------------------------------------------------------


def test_chunks_follow_the_order_and_cut_ties(spark):
    # Two thirds of the rows have one of two times.
    df = spark.range(30_000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 < 2, (F.col("id") % 3).cast("bigint") * 1000).otherwise(F.col("id")).alias("t"),
    )
    out = ch.add_chunks(df, ["t", "seq"], 10).cache()
    sizes = [r["count"] for r in out.groupBy(ch.CHUNK).count().collect()]
    assert max(sizes) < 30_000 / 10 * 2 and len(sizes) >= 10
    ranges = out.groupBy(ch.CHUNK).agg(F.min(F.struct("t", "seq")).alias("lo"), F.max(F.struct("t", "seq")).alias("hi"))
    ranges = ranges.orderBy(ch.CHUNK).collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(ranges, ranges[1:]))
    out.unpersist()


def test_number_of_chunks(spark):
    df = spark.range(1)
    assert ch.number_of_chunks(df, 999) == 1
    assert ch.number_of_chunks(df, 100_000) == 8
    assert ch.number_of_chunks(df, 10**9) == 1000
    assert ch.number_of_chunks(df, 10**15) == ch.MAX_CHUNKS


def test_hot_service_is_spread(spark):
    """The windows of a service that holds everything hash on (service, chunk)."""
    df = spark.range(20_000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") < 10**9, "s").alias("service"),
        F.lit("t").alias("text"),
        F.lit(T0).cast("timestamp_ntz").alias("ts"),
    )
    plan = od.dedupe(df, chunks=8)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__group" in plan and "__chunk" in plan
    assert "SinglePartition" not in plan


# --- the literal cases ---------------------------------------------------------------------------------


def test_literal_cases(logs):
    assert texts(od.suppress(logs([("s", t) for t in "xxxy"]), 2)) == ["x", "x", "y"]
    assert texts(od.suppress(logs([("s", t) for t in "aaba"]), 1)) == ["a", "b", "a"]
    assert texts(od.sample_per_service(logs([("s", t) for t in "1234"]), 2)) == ["2", "4"]
    assert texts(od.sample_per_service(logs([("a", "a1"), ("b", "b1"), ("a", "a2"), ("b", "b2")]), 2)) == ["a2", "b2"]
    burst = logs([("s", "burst", 0), ("s", "burst", 0), ("s", "burst", 0), ("s", "burst", 0.1)])
    assert len(texts(od.debounce(burst, timedelta(milliseconds=80)))) == 2
    assert texts(od.stamp_offset(logs([("s", "hello"), ("s", "world"), ("s", "!")]), "%d|%s")) == ["0|hello", "6|world", "12|!"]
    assert texts(gr.join_runs(logs([("svc", t) for t in "abc"]), " | ", 3)) == ["a | b | c"]
    assert texts(gr.join_runs(logs([("a", "x"), ("a", "y"), ("b", "z")]), "+", 10)) == ["x+y", "z"]
    assert texts(gr.join_runs(logs([("a", "1"), ("a", "2"), ("a", "3")]), "-", 2)) == ["1-2", "3"]
    start = [("s", "START first"), ("s", "one"), ("s", "two"), ("s", "START second"), ("s", "three")]
    assert texts(gr.multiline(logs(start, step=0.1), "^START")) == ["START first\none\ntwo", "START second\nthree"]
    assert texts(gr.coalesce_bursts(logs([("api", t) for t in "abc"], step=0.01), 0.06)) == ["a | b | c"]
    paced = od.throttle(logs([("s", str(i), 0) for i in range(5)]), 20).orderBy("seq").collect()
    assert paced[-1]["paced_ts"] - paced[0]["paced_ts"] >= timedelta(seconds=0.2)
    assert texts(od.line_number(logs([("a", "x"), ("b", "y"), ("a", "z")]))) == ["0001 x", "0001 y", "0002 z"]
    assert texts(od.line_number(logs([("a", "x")]), 0)) == ["0001 x"]


def test_gate_with_a_line_that_opens_and_closes(logs):
    df = logs([("s", t) for t in ["a", "open close", "b", "open", "c", "close", "d"]])
    assert texts(od.gate(df, "open", "close")) == ["open close", "open", "c", "close"]


def test_reorder_by_embedded_time(logs):
    df = logs([("s", "3 third", 0), ("s", "1 first", 0.001), ("s", "2 second", 0.002)])
    out = od.reorder(df, 0.05, lambda t: F.timestamp_seconds(F.substring(t, 1, 1).cast("bigint")))
    assert texts(out) == ["1 first", "2 second", "3 third"]


def test_mark_service_colours(logs):
    df = logs([(f"s{i}", "m") for i in range(8)])
    out = texts(od.mark_service(df))
    assert out[0] == "\x1b[36mm\x1b[0m" and out[0] == out[7] and out[0] != out[1]


def test_empty_input(logs, spark):
    df = logs([("s", "x")]).filter("false")
    for out in (
        od.head(df, 1), od.dedupe(df), od.suppress(df, 1), od.gate(df, "x"), od.pace(df, 1), gr.join_runs(df, "+", 2),
        gr.multiline(df, "x"), gr.coalesce_bursts(df, 1), gr.batches(df, 2), gr.batches(df, 2, 1.0), dr.drift(df),
        dr.drift(df, "fuzzy"), ag.rolling_count(df, 1),
    ):
        assert out.count() == 0


@pytest.mark.parametrize(
    "call",
    [
        lambda d: od.head(d, 0), lambda d: od.ceiling(d, -1), lambda d: od.last_n(d, -1), lambda d: od.sample_overall(d, 0),
        lambda d: od.sample_per_service(d, -2), lambda d: od.gate(d, ""), lambda d: od.gate(d, "("), lambda d: od.suppress(d, 0),
        lambda d: od.debounce(d, 0), lambda d: od.stamp_offset(d, "%d"), lambda d: od.pace(d, -1), lambda d: od.throttle(d, 0),
        lambda d: od.reorder(d, 1, None), lambda d: od.reorder(d, 0, lambda t: t), lambda d: od.mark_service(d, ()),
        lambda d: gr.join_runs(d, "", 2), lambda d: gr.join_runs(d, "-", 1), lambda d: gr.multiline(d, "("),
        lambda d: gr.coalesce_bursts(d, 0), lambda d: gr.batches(d, 0), lambda d: gr.batches(d, 1, 0),
        lambda d: dr.drift(d, "fuzzy", 1.5), lambda d: dr.drift(d, scope="x"), lambda d: ag.rolling_count(d, -1),
        lambda d: od.head(d.drop("seq"), 1),
    ],
)
def test_bad_parameters(logs, call):
    with pytest.raises(ValueError):
        call(logs([("s", "x")]))


def test_chunks_stay_small_as_lines_grow(spark):
    from loglane.plans.chunks import number_of_chunks

    rows = spark.range(1)
    assert 5_000_000 // number_of_chunks(rows, 5_000_000) <= 100_000


def test_lines_are_not_sent_through_the_driver_and_sorted_once(spark):
    lines = table(spark, random_lines(3, 60))
    for op in (lambda d: od.suppress(d, 2, chunks=3), lambda d: od.debounce(d, 2, chunks=3), lambda d: od.line_number(d, chunks=3), lambda d: od.with_byte_offset(d, chunks=3)):
        out = op(lines)
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        plan = plan[: plan.find("== Initial Plan")]
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
        left = plan[plan.index("SortMergeJoin") :]
        # From the join to the lines' own shuffle.
        assert left[: left.index("Exchange hashpartitioning")].count("Sort [") == 1
