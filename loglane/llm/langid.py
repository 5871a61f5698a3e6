"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The probability of a word is the sum,
over all ways to cut it into pieces, of the product of their probabilities; a forward pass computes it. A text's
score is the sum of the logarithms over its words.

Piece probabilities are learned by expectation maximisation. Words are counted per language over all training rows
first (one shuffle, summed up before it), so both learning and prediction run the passes once per distinct word, for
all languages and many words at a time.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections import Counter
from dataclasses import astuple, dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglane.llm.shared import TEXT_ROWS, arrow_rows, gathered, slices, store, texts_in, texts_of

ASCII_LETTERS, LETTERS_AND_MARKS = re.compile("[a-z]+"), re.compile("L[LM]*")
# Signs and digits, which are no letters and no marks.
SIGNS = string.punctuation + string.digits
MARK = "▁"
# Keeps products over some places within double range: about the inverse probability of a letter. Every so many places
# the sums are scaled anew, so that words may have any length.
SCALE, RESCALE = 30.0, 16
# Characters of words of one length that are worked on at a time.
BLOCK = 1 << 17
# Share of all uses of a language that each piece gets on top of its own.
SMOOTHING = 1e-7
HASH_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
# Words whose scores a task remembers, strings that it gathers before it sends counts on, and counted words that it
# learns from at once: each pass is over the words of one length, so it needs many.
REMEMBER = 300_000
GATHER = 300_000
LEARN_ROWS = 100_000
ROUNDS = 2
UNDETERMINED = "und"


@dataclass(frozen=True)
class Pieces:
    """The vocabulary as hashes in open slots; the last id stands for any single character that is no piece.

    A hash has one slot in each table, by bits of its own; what a slot taken before turns away lies in the next.
    Beginnings of pieces that are no pieces are there too, with the id ``size``.
    """

    keys: list[np.ndarray]
    ids: list[np.ndarray]
    longest: int
    size: int

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of pieces, or -1."""
        found = self.begun(hashes)
        found[found == self.size] = -1
        return found

    def begun(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of pieces, ``size`` for what only begins one, or -1."""
        out, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, (keys, ids) in enumerate(zip(self.keys, self.ids, strict=True)):
            slot = _slot(hashes, level)
            there = keys[slot]
            hit = there == hashes
            out[left[hit]] = ids[slot[hit]]
            # Only a taken slot turns a hash away.
            more = ~hit & (there != 0)
            left, hashes = left[more], hashes[more]
            if not len(left):
                break
        return out


SLOT_BITS = 17


def _slot(hashes: np.ndarray, level: int) -> np.ndarray:
    return ((hashes >> np.uint64(64 - SLOT_BITS - 11 * level)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def vocabulary(model_file: str) -> Pieces:
    """The pieces of a sentencepiece model file, without its control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    special = (sp.is_control, sp.is_unknown, sp.is_byte, sp.is_unused)
    names = [(i, sp.id_to_piece(i)) for i in range(sp.get_piece_size()) if not any(is_special(i) for is_special in special)]
    size = sp.get_piece_size() + 1
    found = {p[:k]: size for _, p in names for k in range(1, len(p))} | {p: i for i, p in names}
    left = (np.array([_hash(p) for p in found], np.uint64), np.array(list(found.values()), np.int64))
    keys, ids = [], []
    while len(left[0]):
        slots, first = np.unique(_slot(left[0], len(keys)), return_index=True)
        keys.append(np.zeros(1 << SLOT_BITS, np.uint64))
        ids.append(np.full(1 << SLOT_BITS, -1, np.int64))
        keys[-1][slots], ids[-1][slots] = left[0][first], left[1][first]
        left = tuple(np.delete(x, first) for x in left)
        if len(keys) > 5:
            raise ValueError("too many pieces for the slots")
    return Pieces(keys, ids, max(len(p) for _, p in names), size)


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = ((h + ord(c) + 1) * int(HASH_BASE)) % (1 << 64)
    return h


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters with their marks; numerals that are no digits are no letters."""
    return _runs_of(text.lower())


def strings_of(text: str) -> list[str]:
    """The lower-case strings of a text between white space, which no word goes over: its words are theirs, in order."""
    return text.lower().split()


def _runs_of(text: str) -> list[str]:
    # Most strings are one run of letters, maybe between signs.
    if text.isalpha():
        return [text]
    core = text.strip(SIGNS)
    if core.isalpha():
        return [core]
    if text.isascii():
        return ASCII_LETTERS.findall(text)
    # Letters (Unicode category L) with the marks (M) after them.
    kinds = "".join([unicodedata.category(c)[0] for c in text])
    return [text[x.start() : x.end()] for x in LETTERS_AND_MARKS.finditer(kinds)]


def _by_length(words: list[str]):
    """Indexes and code points (places x words) of the marked words of each length, a block of characters at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        step = max(1, min(4096, BLOCK // (int(lengths[order[a]]) + 1)))
        for at in range(a, b, step):
            few = order[at : min(at + step, b)]
            codes = np.frombuffer("".join([MARK + words[i] for i in few.tolist()]).encode("utf-32-le"), np.uint32)
            yield few, np.ascontiguousarray(codes.reshape(len(few), -1).T).astype(np.uint64)


def _spans(codes: np.ndarray, pieces: Pieces, backwards: bool = False):
    """``(i, j, at, ids)``: the words ``at`` have the pieces ``ids`` at characters i to j; for all spans with a piece.

    Spans come by rising i, or by falling i. A word is followed only as long as a piece begins like it.
    """
    n, m = codes.shape
    for i in range(n - 1, -1, -1) if backwards else range(n):
        at, h = np.arange(m), np.zeros(m, np.uint64)
        for j in range(i + 1, min(n, i + pieces.longest) + 1):
            with np.errstate(over="ignore"):
                h = (h + codes[j - 1, at] + np.uint64(1)) * HASH_BASE
            found = pieces.begun(h)
            if j == i + 1:
                # Any single character has a piece.
                yield i, j, at, np.where((found < 0) | (found == pieces.size), pieces.size - 1, found)
            else:
                whole = (found >= 0) & (found < pieces.size)
                if whole.any():
                    yield i, j, at[whole], found[whole]
            begun = found >= 0
            at, h = at[begun], h[begun]
            if not len(at):
                break


def _forward(codes: np.ndarray, spans, table: np.ndarray, longest: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Scaled forward sums, places x words x languages, and what the sums from a place on were divided by there."""
    alpha = np.zeros((len(codes) + 1, codes.shape[1], table.shape[1]))
    alpha[0] = 1.0
    divisors: dict[int, np.ndarray] = {}
    for i, j, at, found in spans:
        if i % RESCALE == 0 and i and i not in divisors:
            divisors[i] = alpha[i].copy()
            alpha[i : i + longest] /= divisors[i]
        if len(at) == codes.shape[1]:
            alpha[j] += alpha[i] * table[found] * SCALE ** (j - i)
        else:
            alpha[j, at] += alpha[i, at] * table[found] * SCALE ** (j - i)
    return alpha, divisors


def word_scores(words: list[str], pieces: Pieces, probabilities: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language, summed over all segmentations."""
    out = np.zeros((len(words), probabilities.shape[1]))
    for at, codes in _by_length(words):
        alpha, divisors = _forward(codes, _spans(codes, pieces), probabilities, pieces.longest)
        out[at] = np.log(alpha[-1]) - len(codes) * np.log(SCALE) + sum(map(np.log, divisors.values()))
    return out


def expected_counts(words: list[str], counts: np.ndarray, pieces: Pieces, probabilities: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in one language, over all segmentations of the counted words."""
    out, table = np.zeros(pieces.size), probabilities[:, None]

    def add(ids: list[np.ndarray], uses: list[np.ndarray]) -> None:
        np.add(out, np.bincount(np.concatenate(ids), np.concatenate(uses), minlength=pieces.size), out=out)

    for rows, codes in _by_length(words):
        # Spans of long words are found twice rather than kept.
        kept = list(_spans(codes, pieces)) if len(codes) <= 64 else None
        alpha, divisors = _forward(codes, kept or _spans(codes, pieces), table, pieces.longest)
        alpha = alpha[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[-1] = counts[rows] / alpha[-1]
        ids, uses = [], []
        for i, j, at, found in reversed(kept) if kept else _spans(codes, pieces, backwards=True):
            back = beta[j, at] * table[found, 0] * SCALE ** (j - i)
            # A place where sums were scaled lies inside the span or at its end.
            for k in range((i // RESCALE + 1) * RESCALE, j + 1, RESCALE):
                if k in divisors:
                    back = back / divisors[k][at, 0]
            beta[i, at] += back
            ids.append(found)
            uses.append(alpha[i, at] * back)
            if len(ids) >= 4096:
                add(ids, uses)
                ids, uses = [], []
        if ids:
            add(ids, uses)
    return out


def _listed(strings: pa.Array) -> list[str]:
    """As ``to_pylist``, but without a wrapper around each string."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def _word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, n``: how often each word occurs in the texts of each language."""

    def fn(batches):
        held: dict[str, Counter] = {}

        def flush():
            rows = []
            for k, c in held.items():
                words: Counter = Counter()
                for string, n in c.items():
                    for w in _runs_of(string):
                        words[w] += n
                rows += [(k, w, n) for w, n in words.items()]
            held.clear()
            if not rows:
                return pa.record_batch({"lang": pa.array([], pa.string()), "word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
            langs, words, counts = zip(*rows, strict=True)
            return pa.record_batch({"lang": pa.array(langs), "word": pa.array(words), "n": pa.array(counts, pa.int64())})

        for batch in batches:
            texts, langs = texts_of(batch, "text"), batch.column(batch.schema.get_field_index("lang"))
            for at, to in slices(texts):
                for text, lang in zip(texts[at:to].to_pylist(), langs[at:to].to_pylist(), strict=True):
                    held.setdefault(lang, Counter()).update(strings_of(text))
                if sum(map(len, held.values())) > GATHER:
                    yield flush()
        if any(held.values()):
            yield flush()

    rows = docs.mapInArrow(fn, "lang string, word string, n long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    probabilities: np.ndarray


def train(docs: DataFrame, pieces: Pieces, rounds: int = ROUNDS) -> Model:
    """Piece probabilities per language from all rows of ``docs`` (``text, lang``); null texts or languages are left out.

    What reaches the driver is a number per piece and language, whatever the input's size.
    """
    arrow_rows(docs, TEXT_ROWS)
    words = store(_word_counts(docs.select("text", "lang").filter("text is not null and lang is not null")), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").collect()
    languages = [r["lang"] for r in totals]
    if not languages:
        return Model([], np.zeros((pieces.size, 0)))
    probabilities = np.full((pieces.size, len(languages)), 1.0 / pieces.size)
    shared = docs.sparkSession.sparkContext
    for _ in range(rounds):
        now = shared.broadcast((astuple(pieces), probabilities))

        def fn(batches, now=now, languages=languages):
            vocab, table = Pieces(*now.value[0]), now.value[1]
            number = {k: i for i, k in enumerate(languages)}
            sums = np.zeros((vocab.size, len(languages)))
            for batch in gathered(batches, LEARN_ROWS):
                names = np.array([number[x] for x in _listed(batch.column(0))])
                words, counts = _listed(batch.column(1)), batch.column(2).to_numpy().astype(float)
                for k in np.unique(names):
                    at = np.flatnonzero(names == k)
                    sums[:, k] += expected_counts([words[i] for i in at], counts[at], vocab, table[:, k])
            at = np.nonzero(sums)
            if len(at[0]):
                yield pa.record_batch({"piece": pa.array(at[0]), "lang": pa.array(at[1]), "n": pa.array(sums[at])})

        found = words.mapInArrow(fn, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        got = found.toPandas()
        sums = np.zeros_like(probabilities)
        sums[got["piece"], got["lang"]] = got["n"]
        # Pieces that a language does not use keep a small share, at every size of the corpus.
        sums += SMOOTHING * sums.sum(axis=0)
        probabilities = sums / sums.sum(axis=0)
    return Model(languages, probabilities)


def predict(docs: DataFrame, pieces: Pieces, model: Model) -> DataFrame:
    """All columns of ``docs`` under ``row``, and ``lang_pred, score``; one row per row.

    ``score`` is the predicted language's share of the probability of the text, between 0 and 1. Texts that are null
    or have no letter, and all texts if no language was learned, get ``und`` and score 0. Ties go to the first
    language by code point.
    """
    arrow_rows(docs, TEXT_ROWS)
    shared = docs.sparkSession.sparkContext.broadcast((astuple(pieces), astuple(model)))  # plain values: workers need not have the package
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def fn(batches):
        vocab, model = Pieces(*shared.value[0]), Model(*shared.value[1])
        # Rows of words in ``scores``, and of strings in ``sums``: of their words' scores, with the number of words.
        known: dict[str, int] = {}
        numbers: dict[str, int] = {}
        scores = sums = np.zeros((0, len(model.languages)))
        sizes = np.zeros(0, np.int64)
        names = np.array([*model.languages, UNDETERMINED], object)
        for batch in batches:
            texts, best, share = texts_in(batch.column(0)), [], []
            for at, to in slices(texts):
                docs_strings = [strings_of(t) for t in _listed(texts[at:to])] if model.languages else [[]] * (to - at)
                if max(len(known), len(numbers)) > REMEMBER:
                    known.clear()
                    numbers.clear()
                    scores, sums, sizes = scores[:0], sums[:0], sizes[:0]
                met = pa.array(chain.from_iterable(docs_strings), pa.string()).dictionary_encode()
                distinct = _listed(met.dictionary)
                new = [x for x in distinct if x not in numbers]
                if new:
                    runs = [_runs_of(x) for x in new]
                    fresh = list(set().union(*runs).difference(known))
                    known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                    scores = np.vstack((scores, word_scores(fresh, vocab, model.probabilities)))
                    numbers.update(zip(new, range(len(numbers), len(numbers) + len(new)), strict=True))
                    n = np.fromiter(map(len, runs), np.int64, len(runs))
                    own = np.array([known[w] for ws in runs for w in ws], np.int64)
                    found = np.zeros((len(new), len(model.languages)))
                    if len(own):
                        found[n > 0] = np.add.reduceat(scores[own], (np.cumsum(n) - n)[n > 0], axis=0)
                    sums, sizes = np.vstack((sums, found)), np.concatenate((sizes, n))
                rows = np.array([numbers[x] for x in distinct], np.int64)[met.indices.to_numpy()]
                cuts = np.concatenate(([0], np.cumsum([len(p) for p in docs_strings])))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    own = rows[a:b]
                    if not sizes[own].any():
                        best.append(len(model.languages))
                        share.append(0.0)
                        continue
                    total = sums[own].sum(axis=0)
                    k = int(total.argmax())
                    best.append(k)
                    share.append(float(1.0 / np.exp(total - total[k]).sum()))
            yield pa.record_batch({"row": batch.column(0), "lang_pred": pa.array(names[best], pa.string()), "score": pa.array(share, pa.float64())})

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(fn, schema)


def identify(docs: DataFrame, training: DataFrame, model_file: str) -> DataFrame:
    """Learn from ``training`` (``text, lang``) and predict every row of ``docs`` (``text`` and any other columns).

    See :func:`predict` for the result. ``lang`` of ``docs`` is not read.
    """
    pieces = vocabulary(model_file)
    return predict(docs, pieces, train(training, pieces))
