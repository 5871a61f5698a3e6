"""N-gram Jaccard join and components against brute force."""

import random

import pytest
from brute import Groups, jaccard

from loglane.llm import jaccard as join
from loglane.llm.components import components
from loglane.llm.jaccard import jaccard_components, keep_one

SCHEMA = "doc_id long, text string, at string, key string, tokens string"


def families(seed: int) -> list[tuple]:
    """Families of near copies of all lengths, with exact copies, ties at the threshold, and a common passage."""
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(12)]
    rows = []
    for size in (1, 2, 3, 4, 9, 12, 20, 21, 45, 120, 400):
        base = [f"{r.choice('abcdefg')}{r.randrange(60)}" for _ in range(size)]
        for _ in range(r.randrange(2, 25)):
            words = list(base)
            for _ in range(r.randrange(0, max(2, size // 25))):
                words[r.randrange(size)] = f"x{r.randrange(99)}"
            if r.random() < 0.2:
                words += passage
            rows.append((len(rows), r.choice([" ", "\n", "\t "]).join(words)))
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "z", None, "q") for d, t in rows], SCHEMA)
    return sorted(map(tuple, jaccard_components(df).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_families(spark, seed):
    rows = families(seed)
    assert run(spark, rows) == sorted(jaccard(rows), key=repr)


def test_family_of_unlinked_copies(spark, monkeypatch):
    # Copies too far from each other to be linked share most segments: each may query a few blocks, not one for every leader.
    r = random.Random(4)
    base, rows = [f"w{r.randrange(5000)}" for _ in range(400)], []
    for i in range(400):
        words = list(base)
        for _ in range(r.choice([1, 3, 8, 10, 12])):
            words[r.randrange(len(words))] = f"z{i} {r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    stored, store = {}, join.store
    monkeypatch.setattr(join, "store", lambda df, name="llm": stored.setdefault(name, store(df, name)) if name == "asks" else store(df, name))
    assert run(spark, rows) == sorted(jaccard(rows), key=repr)
    asks, asking = stored["asks"].count(), stored["asks"].select("key").distinct().count()
    assert 100 < asking < 300 and asks <= 2 * asking


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Ä b c"), (4, "Ä b c"), (None, "ä b c"), (None, "a b c d"), (5, "A  B C D"), (6, "one"), (7, "ONE")]
    rows += [(8, "one\x1cone"), (9, "w " * 40_000), (10, "W\f" * 40_001), (None, None), (11, "x y"), (12, "x y z")]
    assert run(spark, rows) == sorted(jaccard(rows), key=repr)
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        jaccard_components(spark.createDataFrame([], SCHEMA), percent=100)


def test_keep_one(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (2, long + " end"), (2, long + " end"), (3, "other words here now"), (3, "other words here now"), (3, "quite another text"), (4, None), (4, None), (5, "")]
    df = spark.createDataFrame([(d, t, "z", "k", "q") for d, t in rows], SCHEMA)
    got = keep_one(df)
    assert got.columns == df.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    assert kept == sorted([(1, long), (3, "other words here now"), (3, "quite another text"), (4, None), (4, None), (5, "")], key=repr)


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(60, 90)] + [(200, r.randrange(300, 340)) for _ in range(50)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)]
    links += links[:5] + [(7, 7)]
    groups = Groups(400)
    for a, b in links:
        groups.join(a, b)
    ends = {x for a, b in links if a != b for x in (a, b)}
    got = {x.node: x.root for x in components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    assert got == {x: groups.root(x) for x in ends}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
