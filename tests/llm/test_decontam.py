"""Decontamination against all windows as tuples, and its edges."""

import random
import re

import numpy as np
import pytest

from loglane.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            k = min(width, len(v))
            windows = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    found.add(item_id)
        out.append((doc_id, len(w), len(hit), sorted((None if x is None else str(x) for x in found), key=lambda x: (x is None, x or ""))))
    return sorted(out, key=repr)


def run(spark, docs, items, width, **options):
    d = spark.createDataFrame([(i, t, "row", 1) for i, t in docs], "doc_id long, text string, row string, n_hit int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, spans string")
    rows = decontam.matches(d, b, width, **options).collect()
    for r in rows:
        covered = sum(r.spans[1::2]) - sum(r.spans[::2])
        assert covered == r.n_hit
        assert r.row.row == "row"
    return sorted(((r.row.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows), key=repr)


@pytest.mark.parametrize("part_words, lane", [(1 << 17, 256), (40, 5)])
def test_random_words(spark, monkeypatch, part_words, lane):
    """Few different words make many overlaps, between items too; small parts and lanes change nothing."""
    monkeypatch.setattr(decontam, "LANE", lane)
    if lane == 5:
        monkeypatch.setattr(decontam, "PIECE_WORDS", 7)
    r = random.Random(lane)
    pick = lambda n, k: " ".join(r.choices(["Ä", "b", "c9", "d"][:k], k=n))
    items = [(i, pick(r.choice([1, 2, 3, 5, 9, 30]) if i < 12 else 12, 4)) for i in range(25)]
    items = [x for x in items if len(words(x[1])) > 1] + [(7, "b c9 b"), (7, None), (None, "d d d d"), (40, ""), (41, "--"), (42, items[20][1])]
    docs = [(i, pick(r.randrange(80), 4)) for i in range(60)] + [(1, None), (None, "B, c9; b!"), (2, ""), (3, "the" * 9), (3, "the" * 9)]
    for width in (1, 4, 10):
        assert run(spark, docs, items, width, part_words=part_words) == brute(docs, items, width)


def test_long_and_none(spark):
    long = "x " * 150_000 + "One two, three FOUR five six seven eight nine ten" + " y" * 150_000
    item = [(5, "one two three four five six seven eight nine ten")]
    assert run(spark, [(1, long), (2, "a")], item, 10) == [(1, 300_010, 10, ["5"]), (2, 1, 0, [])]
    assert run(spark, [], item, 10) == []
    assert run(spark, [(1, "a b")], [], 10) == [(1, 2, 0, [])]
    with pytest.raises(ValueError):
        run(spark, [], [], 0)


def test_clean_texts(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = [(1, f"before {item.upper()}! after " + "z " * 30), (2, item), (3, "w1 w2 w3"), (4, None), (5, " ".join(item.split()[:15]) + " q" + " z" * 40)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.row.doc_id: r for r in decontam.decontaminate(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert rows[1].clean_text == "before ! after " + "z " * 30 and rows[1].kept and rows[1].n_hit == 20
    assert rows[2].clean_text == "" and not rows[2].kept
    assert rows[3].clean_text == "w1 w2 w3" and rows[3].kept and rows[4].clean_text is None and rows[4].kept
    assert rows[5].clean_text == " q" + " z" * 40 and rows[5].kept


def test_states_stand_for_the_runs_of_items():
    """Every run of an item is spelled by the moves, and nothing else is."""
    r = random.Random(4)
    texts = [[r.randrange(3) for _ in range(r.randrange(1, 9))] for _ in range(6)]
    a = decontam.Automaton([(i, np.array(t, np.uint64)) for i, t in enumerate(texts)], 3)
    a = decontam.Automaton.unpacked(a.packed())
    runs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    reached, here = set(), {(): 0}
    while here:
        there = {}
        for run, state in here.items():
            for code in range(a.n_words):
                to = a._moved(np.array([state]), np.array([code]))[0]
                if to >= 0:
                    there[(*run, code)] = int(to)
        reached |= set(there)
        here = there
    assert reached == runs
