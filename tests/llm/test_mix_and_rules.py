"""Mixing and quality rules against their SQL and plain Python, on small tables with odd rows."""

import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from loglane.llm import mixing, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [r.choice(["a", "Bé", "c#", "|", "long-word"]) + str(r.randrange(40)) for _ in range(r.choice([0, 1, 4, 5, 9, 30, 200]))]
        if r.random() < 0.3:
            words += words[:7] * r.randrange(3)
        text = "".join(w + r.choice([" ", "\n", "\n\n", "\t ", "\r\n"]) for w in words)
        rows.append((i, r.choice([text, text, text, None, ""]) if i % 9 == 0 else text, r.choice(["s0"] * 6 + ["s1", "s10", "s2", "é", None])))
    rows += [rows[3]] * 4 + [(None, "words without an id", "s1"), (None, None, None)]
    return rows


def against(sql, names, tables):
    con = duckdb.connect()
    for name, (columns, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({columns})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * (columns.count(',') + 1))})", rows)
    got = con.execute(sql)
    at = [[d[0] for d in got.description].index(n) for n in names]
    return sorted((tuple(r[i] for i in at) for r in got.fetchall()), key=repr)


def test_mix(spark):
    rows = documents(300)
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, source string, size string, target int")
    got = mixing.mixed(docs).withColumn("taken", F.col("size") * F.col("copies"))
    names = ["doc_id", "size", "source_size", "target", "taken"]
    plain = got.select("row.doc_id", *names[1:])
    want = against(mixing.SQL, names, {"documents": ("doc_id BIGINT, text VARCHAR, source VARCHAR", rows)})
    assert sorted(map(tuple, plain.collect()), key=repr) == want
    sums = got.groupBy("row.source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"), F.max("copies").alias("copies")).collect()
    assert all(abs(r.taken - r.target) <= 5 * r.most and r.copies <= 2 for r in sums)
    whole = sum(len(WORD.findall(t or "")) for _, t, _ in rows)
    assert math.isclose(sum(r.target for r in sums), 1.5 * whole)
    mix = mixing.mix_sources(docs)
    assert mix.columns == docs.columns and mix.count() == got.agg(F.sum("copies")).first()[0]
    assert sorted(map(tuple, mixing.mix_sources(docs).collect()), key=repr) == sorted(map(tuple, mix.collect()), key=repr)


def test_mix_of_little(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed(none).count() == 0
    bare = spark.createDataFrame([(1, None, None), (2, "", "a")], none.schema)
    assert {(r.size, r.target, r.copies) for r in mixing.mixed(bare).collect()} <= {(0, 0.0, 0), (0, 0.0, 1), (0, 0.0, 2)}
    one = spark.createDataFrame([(1, "a b c", "s")], none.schema)
    assert mixing.mixed(one).first().copies in (1, 2)
    with pytest.raises(ValueError):
        mixing.mixed(none, weights=())


def test_preferences(spark):
    """Preferred documents are taken more often, and the target still holds."""
    rows = [(i, "w " * 10, "s", 3.0 if i % 2 else 1.0) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, pull double")
    got = mixing.mixed(docs, share=0.5, weight="pull").groupBy("row.pull").agg(F.sum("copies").alias("n")).collect()
    n = {r.pull: r.n for r in got}
    assert sum(n.values()) == 1000 and 2.5 < n[3.0] / n[1.0] < 3.6


def plain_counts(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    again = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in again for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules(spark):
    rows = documents(500, 2) + [(9000 + i, f"plain words of document {i} that nobody would want to lose or repeat", "s") for i in range(900)]
    rows += [(20_000, "x y z w v " * 3000, "s"), (20_001, "one", "s"), (20_002, "a b c d e\nf g h i j", "s")]
    labels = [(9000 + i, 1, 0) for i in range(900)] + [(i, i % 2, 0) for i in range(40)] + [(5, None, None), (5, 1, 1), (None, 1, 0), (77_777, 1, 0)]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, row string, n_words string").select("doc_id", "text", "row", "n_words")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").select("doc_id", F.col("quality").alias("label"))
    got = rules.judge(docs, marks)
    names = ["doc_id", *rules.COLUMNS, "base_failed", "kept"]
    plain = sorted(map(tuple, got.select("row.doc_id", *names[1:]).collect()), key=repr)
    assert sorted((r[0], *r[1:6]) for r in plain if r[0] is not None) == sorted((d, *plain_counts(t)) for d, t, _ in rows if d is not None)
    tables = {"documents": ("doc_id BIGINT, text VARCHAR, source VARCHAR", rows), "labels": ("doc_id BIGINT, quality INTEGER, toxic INTEGER", labels)}
    assert plain == against(rules.SQL, names, tables)
    assert any(not r[-1] and not r[-2] for r in plain) and sum(r[-1] for r in plain) >= 900
    bare = rules.judge(docs, marks.limit(0))
    assert bare.filter("kept = base_failed").count() == 0
    assert rules.judge(docs.limit(0), marks).count() == 0


@pytest.mark.parametrize("n, k, p", [(1, 0, 0.05), (500, 0, 0.0167), (500, 3, 0.0167), (2000, 20, 0.0167), (50_000, 700, 0.0167), (10_000_000, 164_000, 0.0167), (40, 40, 0.5)])
def test_binomial_tail(spark, n, k, p):
    got = spark.range(1).select(rules.at_most(F.lit(k).cast("bigint"), F.lit(n).cast("bigint"), p)).first()[0]
    if k >= n * p:
        assert got == 1.0
        return
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    want = math.fsum(math.exp(log(i)) for i in range(max(0, k - 30_000), k + 1))
    assert got == pytest.approx(want, rel=1e-6)
