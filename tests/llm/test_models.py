"""Language identification, quality classifier and LM scoring: exact sums on small cases, accuracy on held-out rows."""

import itertools
import math
import os
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loglane.llm import langid, mlm, quality
from loglane.llm.shared import table

FOLDER = "/root/testdata/sf0.001"
PIECES = langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))

needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def cuts(word):
    for marks in itertools.product((0, 1), repeat=len(word) - 1):
        at = [0, *[i + 1 for i, m in enumerate(marks) if m], len(word)]
        yield [word[a:b] for a, b in itertools.pairwise(at)]


def piece_id(piece):
    found = PIECES.find(np.array([langid._hash(piece)], np.uint64))[0]
    return found if found >= 0 else PIECES.size - 1 if len(piece) == 1 else None


def test_vocabulary():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = np.arange(300, sp.get_piece_size())
    hashes = np.array([langid._hash(sp.id_to_piece(int(i))) for i in ids], np.uint64)
    assert (PIECES.find(hashes) == ids).all() and (PIECES.find(hashes + np.uint64(1)) == -1).all()


def test_segmentations():
    table = np.random.default_rng(1).dirichlet(np.ones(PIECES.size), 2).T
    words = langid.words_of("The Größe, naïve 字x 12 a")
    assert words == ["the", "größe", "naïve", "字x", "a"]
    want, uses = [], np.zeros_like(table)
    for w in words:
        ways = [[piece_id(p) for p in c] for c in cuts(langid.MARK + w)]
        ways = [w for w in ways if None not in w]
        odds = np.array([table[w].prod(axis=0) for w in ways])
        want.append(np.log(odds.sum(axis=0)))
        for way, share in zip(ways, odds / odds.sum(axis=0), strict=True):
            for p in way:
                uses[p] += share
    assert np.allclose(langid.word_scores(words, PIECES, table), want)
    for k in range(2):
        assert np.allclose(langid.expected_counts(words, np.ones(len(words)), PIECES, table[:, k]), uses[:, k])
    assert np.isfinite(langid.word_scores(["字" * 90, "q" * 31, "q"], PIECES, table)).all()


def test_long_words_and_letters():
    assert langid.words_of("½ ² Ⅷ ③ 12") == []
    assert langid.words_of("हिन्दी x²y Éa") == ["हिन्दी", "x", "y", "éa"]
    table = np.random.default_rng(3).dirichlet(np.ones(PIECES.size), 2).T
    words = ["internationalisation" * 5, "ab" * 400, "q" * 17, "字" * 40]
    got = langid.word_scores(words, PIECES, table)
    for k, w in enumerate(words):
        w = langid.MARK + w
        # Plain sums in logarithms, span by span.
        best = np.full((len(w) + 1, 2), -np.inf)
        best[0] = 0.0
        for j in range(1, len(w) + 1):
            for i in range(max(0, j - PIECES.longest), j):
                if (piece := piece_id(w[i:j])) is not None:
                    best[j] = np.logaddexp(best[j], best[i] + np.log(table[piece]))
        assert np.allclose(got[k], best[-1])
    # Pieces of every segmentation cover the word, so lengths of the expected pieces add up to it.
    sizes = np.zeros(PIECES.size)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sizes[:-1], sizes[-1] = [len(sp.id_to_piece(i)) for i in range(PIECES.size - 1)], 1
    for w in words:
        assert langid.expected_counts([w], np.ones(1), PIECES, table[:, 0]) @ sizes == pytest.approx(len(w) + 1)
    # Rare pieces of a very large corpus.
    tiny = np.full((PIECES.size, 2), langid.SMOOTHING)
    tiny[5] = 1.0
    assert np.isfinite(langid.word_scores(["字" * 300, "z" * 31], PIECES, tiny)).all()


def test_strings_have_the_words_of_their_text():
    text = "It's ΟΔΟΣ ὈΔΥΣΣΕΎΣ\u2003a\u0301b x\u0338\u00a0y\u2028z1 Ⅷa\x1cb\x85İstanbul 日本\u3000語 a-b_c " * 3
    strings = langid.strings_of(text)
    assert len(strings) > 30 and [w for x in strings for w in langid._runs_of(x)] == langid.words_of(text)


def test_languages(spark):
    en, de = "the cat and the dog were with this thing", "der hund und die katze sind nicht mit dem ding"
    learn = [(en, "en"), (de, "de"), (None, "en"), ("x", None)]
    rows = [(1, en.upper(), "k"), (2, de, None), (3, None, "k"), (4, " 12 !", "k"), (5, "", "k"), (None, de + " ö" * 3000, "k"), (2, de, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = langid.identify(docs, spark.createDataFrame(learn, "text string, lang string"), public_tokenizers.path("piece_bpe_32k.model")).collect()
    found = sorted((repr(r.row.doc_id), r.lang_pred) for r in got)
    assert found == [("1", "en"), ("2", "de"), ("2", "de"), ("3", "und"), ("4", "und"), ("5", "und"), ("None", "de")]
    assert all(0 <= r.score <= 1 for r in got)
    none = langid.identify(docs, docs.select("text", F.lit(None).cast("string").alias("lang")), public_tokenizers.path("piece_bpe_32k.model"))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}
    assert langid.predict(docs.limit(0), PIECES, langid.Model(["a"], np.ones((PIECES.size, 1)))).count() == 0


def test_words_are_followed_as_long_as_a_piece_begins_like_them(monkeypatch):
    asked, begun = [], langid.Pieces.begun
    monkeypatch.setattr(langid.Pieces, "begun", lambda self, hashes: asked.append(len(hashes)) or begun(self, hashes))
    words = ["qxzjvkqxzjvk"] * 50
    table = np.random.default_rng(1).dirichlet(np.ones(PIECES.size), 2).T
    assert np.allclose(langid.word_scores(words, PIECES, table), langid.word_scores(words[:1], PIECES, table)[0])
    # There are 4,550 spans in the 50 words.
    assert sum(asked[: len(asked) // 2]) < 2500


@pytest.mark.parametrize("text", ["word", "(straße),", "don't", "aⅣb", "e\u0301a b", "\u0301a", "½x²", "𝐀𐍈1", "中文、字", "a_b", "", "…"])
def test_runs_of_letters(text):
    want = [""]
    for c in text:
        kind = unicodedata.category(c)[0]
        if kind == "L" or kind == "M" and want[-1]:
            want[-1] += c
        else:
            want.append("")
    assert langid._runs_of(text) == [w for w in want if w]


def test_trees():
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    trees = quality.grow(x[:2000], y[:2000])
    assert ((trees.scores(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97

    def walk(row):
        total = trees.base
        for f, c, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + 1 + (row[f[node]] > c[node])
            total += leaf[node - (2**quality.DEPTH - 1)]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(trees.scores(x[:50]), [walk(row) for row in x[:50]])
    assert np.allclose(quality.grow(x[:0], y[:0]).scores(x[:3]), 0.5)
    assert (quality.grow(x[:9], np.ones(9)).scores(x[:3]) > 0.9).all()


def test_quality_rows(spark):
    docs = [(1, "good text here. Fine words.", "s"), (2, None, "s"), (2, "", "t"), (None, "a", "u"), (3, "### " * 50_000, "v")]
    labels = [(1, 1), (1, 0), (2, None), (9, 1), (None, 1), (3, 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, stats string")
    got = quality.classify(df, spark.createDataFrame(labels, "doc_id long, label int")).collect()
    assert sorted(r.row.stats for r in got) == ["s", "s", "t", "u", "v"]
    assert all(r.score == pytest.approx(0.5) for r in got)
    assert quality.classify(df.limit(0), spark.createDataFrame([], "doc_id long, label int")).count() == 0


def test_equal_labelled_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "grow", lambda x, y: seen.append((x, y)))
    empty, other = [0.0] * len(quality.NAMES), [1.0] * len(quality.NAMES)
    rows = [(empty, 0)] * 2000 + [(other, 1)] * 1000 + [([float(i)] * len(quality.NAMES), 1) for i in range(2, 1002)]
    quality.fit(spark.createDataFrame(rows, "stats array<double>, label int"), 400)
    x, y = seen[0]
    assert (x[:, 0] == 0).sum() in (200, 201) and (x[:, 0] == 1).sum() in (100, 101)
    assert 60 < (x[:, 0] > 1).sum() < 140 and (y == (x[:, 0] > 0)).all()
    quality.fit(spark.createDataFrame(rows[:30], "stats array<double>, label int"), 400)
    assert len(seen[1][0]) == 30


def held_out_auc(rows):
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


@needs_tables
def test_queries_held_out(spark):
    from loglane.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    docs = table(spark, folder, "documents")
    got = QUERIES["op10_language_id"](spark, folder).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.98 * got.count()
    got = QUERIES["op1_quality_classifier"](spark, folder).join(table(spark, folder, "labels"), "doc_id").filter("held_out")
    rows = got.collect()
    assert len(rows) > 50 and held_out_auc(rows) > 0.95


END = mlm.VOCABULARY - 1


def test_gradients():
    """Training steps follow the loss: a few passes over one text beat its unigram entropy."""
    r = np.random.default_rng(3)
    text = np.tile([5, 40, 700, 5, 41, 701], 300).astype(np.uint16)
    text[r.integers(0, len(text), 20)] = 9
    context, target, sizes = mlm.windows([text.tobytes(), b"", text[:1].tobytes()])
    assert sizes.tolist() == [1800, 0, 1] and (context[0] == [END, END, 40, 700]).all() and (context[-1] == END).all()
    w = mlm.unflat(mlm.flat(mlm.initial()))
    past = {k: np.full(s, 1e-6, np.float32) for k, s in mlm.SHAPES.items()}
    before = mlm.log_probabilities(w, context, target).mean()
    for k in range(20):
        mlm.train_on(w, context, target, past, k)
    after = mlm.log_probabilities(w, context, target).mean()
    assert before == pytest.approx(-math.log(mlm.VOCABULARY), abs=0.3) and after > -0.8
    # Probabilities of all words in one context sum to one.
    every = np.arange(mlm.VOCABULARY)
    assert np.exp(mlm.log_probabilities(w, np.repeat(context[7:8], len(every), axis=0), every)).sum() == pytest.approx(1, abs=1e-4)


def test_logits_of_any_size():
    x = np.array([[0, 1, 2], [-500, 400, 399], [80, 80, 80]], np.float32)
    want = x - np.log(np.exp(x.astype(float) - x.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - x.max(axis=1, keepdims=True)
    for k in range(3):
        assert np.allclose(mlm._log_share(x.copy(), np.full(3, k)), want[:, k], rtol=1e-5)
    e, per = mlm._errors(x.copy(), np.array([2, 1, 0]))
    assert np.allclose(e * per[:, None], np.exp(want) - np.eye(3)[[2, 1, 0]], atol=1e-6)


def test_each_part_has_a_task_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(mlm, "PART_WORDS", 300)
    tasks, dealt = [], type(spark.range(0)).mapInArrow

    def seen(df, fn, schema):
        if "part" in df.columns:
            tasks.append([sorted({r.part for r in rows}) for rows in df.rdd.glom().collect()])
        return dealt(df, fn, schema)

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", seen)
    docs = spark.createDataFrame([(i, f"w{i % 7} b c d e f g h") for i in range(600)], "doc_id long, text string")
    mlm.train(mlm.with_ids(docs, mlm.frequent_words(docs)))
    assert len(tasks) == mlm.ROUNDS and all(len(parts) <= 1 for found in tasks for parts in found)


def test_scores(spark):
    rows = [(i, "the cat sat on the mat and the dog sat on the log " * 4, "a") for i in range(40)] + [(50, None, "b"), (51, " ", "c"), (None, "zebra", "d"), (52, "mat the on zz qq " * 9000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = mlm.pseudo_likelihood(docs).collect()
    by = {r.row.ids: r for r in got}
    assert len(got) == len(rows) and by["b"].n_tokens == by["c"].n_tokens == 0 and by["b"].log_likelihood == 0 and by["b"].score is None
    assert by["a"].n_tokens == 52 and by["a"].score == pytest.approx(by["a"].log_likelihood / 52) and by["a"].score > by["d"].score
    # The whole model again in plain Python, for one text.
    shape = mlm.with_ids(docs, mlm.frequent_words(docs))
    weights = mlm.train(shape)
    ids = np.frombuffer(shape.filter("row.ids = 'a'").first().ids, np.uint16)
    line, total = [END, END, *ids.tolist(), END, END], 0.0
    for i in range(2, len(line) - 2):
        x = np.concatenate([weights["embed"][line[k]] for k in (i - 2, i - 1, i + 1, i + 2)])
        h = np.tanh(x @ weights["inner"] + weights["bias"])
        a, b = h @ weights["to_class"] + weights["class_bias"], h @ weights["to_id"][line[i] // mlm.PER_CLASS] + weights["id_bias"][line[i] // mlm.PER_CLASS]
        total += a[line[i] // mlm.PER_CLASS] - np.log(np.exp(a).sum()) + b[line[i] % mlm.PER_CLASS] - np.log(np.exp(b).sum())
    assert by["a"].log_likelihood == pytest.approx(total, rel=1e-3)
    assert mlm.pseudo_likelihood(docs.limit(0)).count() == 0


def test_scores_do_not_depend_on_tasks(spark, monkeypatch):
    monkeypatch.setattr(mlm, "PART_WORDS", 4000)
    r = np.random.default_rng(6)
    rows = [(i, " ".join(r.choice(["ab", "cd", "ef", "gh", "ij"], 200))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for n in (1, 5):
        got = mlm.pseudo_likelihood(docs.repartition(n)).select("row.doc_id", "log_likelihood").collect()
        found.append([x.log_likelihood for x in sorted(got)])
    assert np.allclose(*found, rtol=1e-5)


@needs_tables
def test_better_than_unigrams(spark):
    folder = "/root/testdata/sf0.01"
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = mlm.with_ids(docs, mlm.frequent_words(docs)).cache()
    ids = np.concatenate([np.frombuffer(r.ids, np.uint16) for r in rows.select("ids").collect()])
    share = np.bincount(ids, minlength=mlm.VOCABULARY) / len(ids)
    unigram = (share[share > 0] * np.log(share[share > 0])).sum()
    got = mlm.scored(rows, mlm.train(rows)).agg(F.sum("log_likelihood"), F.sum("n_tokens")).first()
    assert got[1] == len(ids) and got[0] / got[1] > unigram
