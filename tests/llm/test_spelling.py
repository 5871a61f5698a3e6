"""Spelling variants against all pairs of words, and counting against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from loglane.llm import spelling


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, factor):
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    forms = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= factor * n else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, len(near[w]), words.get(forms[w])))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(w, n, "x") for w, n in rows], "word string, n long, form string")
    return sorted(map(tuple, spelling.grouped(df, **options).collect()), key=repr)


@pytest.mark.parametrize("cells, rows", [(1 << 22, 10_000), (64, 7)])
def test_all_pairs(spark, monkeypatch, cells, rows):
    """Small batches cut the runs of equal signatures; nothing is lost."""
    monkeypatch.setattr(spelling, "CELLS", cells)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    r = random.Random(rows)
    words = {}
    for alphabet, longest in (("ab", 7), ("aáb", 5), ("abcdefgh", 12)):
        for _ in range(150):
            w = "".join(r.choices(alphabet, k=r.randrange(1, longest)))
            words[w] = 5 ** r.randrange(6) + r.randrange(2)
            at = r.randrange(len(w))
            words.setdefault(w[:at] + r.choice(alphabet) + w[at + r.randrange(2) :], 1)
    words |= {"𝄞" * 3: 4, "𝄞" * 4: 40, "q" * 3000: 2, "q" * 2999 + "r": 10, "q" * 2999: 10}
    try:
        for factor in (2, 5):
            assert run(spark, words.items(), factor=factor) == brute(words, factor)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_chain_ties_and_nothing(spark):
    words = {"a" * (i + 3): 5**i for i in range(12)} | {"baa": 5, "caa": 5}
    got = run(spark, words.items())
    assert got == brute(words, 5)
    assert {r[2] for r in got if r[0][0] == "a"} == {"a" * 14}
    assert run(spark, []) == []
    assert run(spark, [(None, 3), ("", 4), ("abc", None), ("abd", 0), ("xyz", 1)]) == [("xyz", None, "xyz", 1, 0, None)]
    with pytest.raises(ValueError):
        run(spark, [], factor=1)


def test_signatures_hold_for_any_change():
    """Words one change apart share a signature, whatever their length and the place of the change."""
    r = random.Random(1)
    for _ in range(3000):
        w = "".join(r.choices("abcdeé", k=r.randrange(2, 18)))
        at = r.randrange(len(w))
        for v in (w[:at] + w[at + 1 :], w[:at] + "z" + w[at + 1 :], w[:at] + "c" + w[at:], w + "b"):
            assert v == w or spelling.signatures(w) & spelling.signatures(v), (w, v)


def test_counts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "FLUSH", 3)
    r = random.Random(2)
    stems = ["Letter", "ÉCOLE", "École", "straße", "x×y÷zz", "naïveté", "Abcdefg", "short", "nineteen"]
    docs = [(i, r.choice([" ", ", ", "-", "1", "\n"]).join(r.choices(stems, k=40))) for i in range(60)]
    docs += [(None, "letter " * 30), (7, None), (8, ""), (9, "nineteen " * 40_000), (9, "letter"), (9, "letter")]
    want = Counter()
    for doc_id, text in docs:
        for run_ in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in run_)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 7 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            want[word] += len(word) >= 6
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n int")
    got = {r.word: r.n for r in spelling.counted(df, drop_every=7).collect()}
    assert got == {w: n for w, n in want.items() if n >= 5}
    assert spelling.counted(df.limit(0)).count() == 0
