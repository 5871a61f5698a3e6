"""LM scoring by masked pseudo-likelihood.

A small network sees the two words on either side of a place and predicts the word there; a document's score is the
sum of the logarithms of these probabilities over all its words. Words are lower-cased runs without ASCII white
space; the most frequent ones of the whole corpus have ids of their own, others share ids by their hash. The output is
a softmax over classes of ids, then over the ids of the class.

Vocabulary and network are learned from all documents. Training goes in rounds; each document is learned in one of them,
by its hash. A round's documents are dealt, by hash as well, over as many parts as keep a part's windows bounded; each
part trains its own copy in numpy, in an order of its own, and the copies are averaged, weighted by their windows,
with one shuffle of sums. So the result depends on the documents alone, not on tasks, files or settings of the session.
What is gathered grows with the corpus; what reaches the driver is one model.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglane.llm.shared import LOWER, SPACE, TEXT_ROWS, arrow_rows, bytes_of, hashes, in_batches, runs, slices, store, texts_of

CLASSES, PER_CLASS = 32, 128
VOCABULARY = CLASSES * PER_CLASS
# Ids of rare words, by hash; the last id of all stands outside the text.
RARE = 64
SIDE, WIDTH, HIDDEN = 2, 16, 32
ROUNDS = 3
BATCH, RATE = 4096, 0.08
# Greatest size of logits whose exponentials are summed up as they are.
MOST = 60.0
ONES = np.ones(max(CLASSES, PER_CLASS), np.float32)
# Words of a part that one copy is trained on, about; words whose windows are made at a time.
PART_WORDS, SOME_WORDS = 1 << 21, 1 << 17
# Distinct words that a task counts before it sends them on.
GATHER = 400_000


def _word_hashes(texts: pa.Array, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = bytes_of(texts, at, to)
    raw = LOWER[raw]
    begins, ends, rows = runs(raw, offsets, SPACE)
    return hashes(raw, begins, ends).view(np.int64), np.searchsorted(rows, np.arange(to - at + 1))


def frequent_words(docs: DataFrame) -> np.ndarray:
    """Hashes of the most frequent words of the corpus, the most frequent first; ties by hash."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            words, n = zip(*held, strict=True)
            words, inverse = np.unique(np.concatenate(words), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate(n)).astype(np.int64)
            return words, counts

        for batch in batches:
            texts = texts_of(batch, "text")
            for at, to in slices(texts):
                words, n = np.unique(_word_hashes(texts, at, to)[0], return_counts=True)
                held.append((words, n))
                size += len(words)
                if size > 4 * GATHER:
                    words, n = flush()
                    held, size = [(words, n)], len(words)
                    if size > GATHER:
                        yield pa.record_batch({"word": pa.array(words), "n": pa.array(n)})
                        held, size = [], 0
        if held:
            words, n = flush()
            yield pa.record_batch({"word": pa.array(words), "n": pa.array(n)})

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(fn, "word long, n long")
    counts = counts.groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY - RARE - 1).collect()
    return np.array([r["word"] for r in top], np.int64)


def with_ids(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``row`` (all columns but ``text``) and ``ids``: the words' ids, packed in two bytes each."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def fn(batch: pa.RecordBatch) -> pa.Table:
        frequent = shared.value
        order = np.argsort(frequent)
        sorted_words = frequent[order]
        texts, out = texts_of(batch, "text"), []
        for at, to in slices(texts):
            words, cuts = _word_hashes(texts, at, to)
            ids = (len(frequent) + (words.view(np.uint64) >> np.uint64(17)) % np.uint64(RARE)).astype(np.uint16)
            if len(frequent):
                k = np.minimum(np.searchsorted(sorted_words, words), len(frequent) - 1)
                ids = np.where(sorted_words[k] == words, order[k], ids).astype(np.uint16)
            out += [ids[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return pa.table({"row": batch.column(0), "ids": pa.array(out, pa.binary())})

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    df = docs.select(row, F.col("text").cast("string").alias("text"))
    return df.mapInArrow(in_batches(fn, ""), T.StructType([df.schema["row"], T.StructField("ids", T.BinaryType())]))


SHAPES = {
    "embed": (VOCABULARY, WIDTH), "inner": (2 * SIDE * WIDTH, HIDDEN), "bias": (HIDDEN,), "to_class": (HIDDEN, CLASSES),
    "class_bias": (CLASSES,), "to_id": (CLASSES, HIDDEN, PER_CLASS), "id_bias": (CLASSES, PER_CLASS),
}


def initial() -> dict[str, np.ndarray]:
    draw = np.random.default_rng(5)
    out = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
    out["embed"] = draw.normal(0, 0.3, SHAPES["embed"]).astype(np.float32)
    out["inner"] = draw.normal(0, 0.15, SHAPES["inner"]).astype(np.float32)
    return out


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in SHAPES])


def unflat(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = values[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def windows(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context ids, target ids and the number of words of each document; places outside a document have the last id."""
    ids = [np.frombuffer(d, np.uint16) for d in docs]
    sizes = np.array([len(x) for x in ids], np.int64)
    pad = np.full(SIDE, VOCABULARY - 1, np.uint16)
    line = np.concatenate([pad, *[y for x in ids for y in (x, pad)]])
    starts = np.cumsum(sizes + SIDE) - sizes
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    around = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])
    return line[at[:, None] + around].astype(np.int64), line[at].astype(np.int64), sizes


def _bounded(x: np.ndarray) -> np.ndarray:
    """Logits whose exponentials can be summed up: in place, rows lose their greatest value if any value is too large."""
    if x.size and (x.max() > MOST or x.min() < -MOST):
        x -= x.max(axis=1, keepdims=True)
    return x


def _log_share(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Logarithm of the chosen column's share in the softmax of each row."""
    x = _bounded(x)
    picked = x[np.arange(len(x)), chosen].astype(np.float64)
    return picked - np.log(np.exp(x, out=x) @ ONES[: x.shape[1]])


def _errors(x: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``e, per`` with ``e * per[:, None]`` the softmax of each row, less one at its chosen column."""
    e = _bounded(x)
    np.exp(e, out=e)
    sums = e @ ONES[: x.shape[1]]
    e[np.arange(len(e)), chosen] -= sums
    return e, 1 / sums


def _hidden(w: dict[str, np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = w["embed"].take(context, axis=0).reshape(len(context), -1)
    h = x @ w["inner"]
    h += w["bias"]
    return x, np.tanh(h, out=h)


def _class_order(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of class, and where each class begins in that order."""
    classes = (target // PER_CLASS).astype(np.uint8)
    return np.argsort(classes, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(classes, minlength=CLASSES))))


def log_probabilities(w: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Logarithm of the probability of each target in its context."""
    out = np.empty(len(target))
    for at in range(0, len(target), 16384):
        order, cuts = _class_order(target[at : at + 16384])
        some = target[at : at + 16384][order]
        _, h = _hidden(w, context[at : at + 16384][order])
        found = _log_share(h @ w["to_class"] + w["class_bias"], some // PER_CLASS)
        for c in np.flatnonzero(np.diff(cuts)).tolist():
            rows = slice(cuts[c], cuts[c + 1])
            found[rows] += _log_share(h[rows] @ w["to_id"][c] + w["id_bias"][c], some[rows] % PER_CLASS)
        out[at + order] = found
    return out


def _step(w: np.ndarray, past: np.ndarray, g: np.ndarray) -> None:
    """A step of Adagrad, in place; ``g`` is used up."""
    past += g * g
    g *= RATE
    g /= np.sqrt(past)
    w -= g


def train_on(w: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray, past: dict[str, np.ndarray], seed: int) -> None:
    """One pass over the windows in random order: steps by Adagrad, in place; ``past`` has the squares so far."""
    order = np.random.default_rng(seed).permutation(len(target))
    for at in range(0, len(order), BATCH):
        rows = order[at : at + BATCH]
        # In order of class, so that the rows of a class are a slice.
        by_class, cuts = _class_order(target[rows])
        rows = rows[by_class]
        c, t = context[rows], target[rows]
        x, h = _hidden(w, c)
        p, per = _errors(h @ w["to_class"] + w["class_bias"], t // PER_CLASS)
        p *= per[:, None]
        p /= len(t)
        grads = {"to_class": h.T @ p, "class_bias": p.sum(axis=0)} | {k: np.zeros_like(w[k]) for k in ("to_id", "id_bias")}
        back = p @ w["to_class"].T
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            some = slice(cuts[k], cuts[k + 1])
            e, per = _errors(h[some] @ w["to_id"][k] + w["id_bias"][k], t[some] % PER_CLASS)
            # Rows are divided by their sums on the narrow side.
            per /= len(t)
            back[some] += (e @ w["to_id"][k].T) * per[:, None]
            grads["to_id"][k], grads["id_bias"][k] = (h[some] * per[:, None]).T @ e, per @ e
        back *= 1 - h * h
        grads["inner"], grads["bias"] = x.T @ back, back.sum(axis=0)
        # Only words that occur have a gradient: their rows are summed up in order.
        words = c.ravel().astype(np.uint16)
        sorted_words = np.argsort(words, kind="stable")
        first = np.flatnonzero(np.diff(words[sorted_words].astype(np.int64), prepend=-1))
        sums = np.add.reduceat((back @ w["inner"].T).reshape(-1, WIDTH)[sorted_words], first, axis=0)
        met = words[sorted_words[first]]
        past["embed"][met] += sums * sums
        w["embed"][met] -= RATE * sums / np.sqrt(past["embed"][met])
        for k, g in grads.items():
            _step(w[k], past[k], g)


def id_counts(rows: DataFrame) -> np.ndarray:
    """How often each id occurs in all rows."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                sums += np.bincount(np.frombuffer(ids, np.uint16), minlength=VOCABULARY)
        at = np.flatnonzero(sums)
        yield pa.record_batch({"id": pa.array(at), "n": pa.array(sums[at])})

    got = rows.select("ids").mapInArrow(fn, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(VOCABULARY, np.int64)
    out[got["id"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def by_frequency(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Initial weights whose output biases give every id its share of the corpus."""
    w, n = initial(), (counts + 0.5).reshape(CLASSES, PER_CLASS)
    w["class_bias"] = np.log(n.sum(axis=1) / n.sum()).astype(np.float32)
    w["id_bias"] = np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32)
    return w


def _trained(values: np.ndarray, docs: Iterator[bytes], number: int) -> tuple[np.ndarray, int]:
    """Weights after one pass over the documents, and the number of their windows."""
    w, seen = unflat(values), 0
    past = {k: np.full(s, 1e-6, np.float32) for k, s in SHAPES.items()}

    def learn(some: list[bytes]) -> int:
        context, target, _ = windows(some)
        if len(target):
            train_on(w, context, target, past, (number << 32) + seen)
        return len(target)

    held, size = [], 0
    for doc in docs:
        # A long document is learned in pieces, like documents of their own.
        for at in range(0, len(doc), 2 * SOME_WORDS):
            held.append(doc[at : at + 2 * SOME_WORDS])
            size += len(held[-1]) // 2
            if size >= SOME_WORDS:
                seen += learn(held)
                held, size = [], 0
    if held:
        seen += learn(held)
    return flat(w), seen


def train(rows: DataFrame, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Weights from all rows of ``row, ids``, beginning with the shares of ids. Without windows these stay."""
    counts = id_counts(rows)
    weights = flat(by_frequency(counts))
    parts = max(1, -(-int(counts.sum()) // (rounds * PART_WORDS)))
    # Equal documents lie in one round, but in different parts if their rows differ.
    rows = rows.select("ids", F.xxhash64("ids").alias("text_hash"), F.xxhash64("row", "ids").alias("row_hash")).filter("length(ids) > 0")
    rows = rows.withColumn("part", F.pmod(F.col("row_hash"), F.lit(parts)))
    for number in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(weights)

        def fn(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            docs = ((part, ids) for b in batches for part, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            for _, mine in itertools.groupby(docs, key=lambda x: x[0]):
                w, seen = _trained(shared.value, (ids for _, ids in mine), number)
                if seen:
                    yield pa.record_batch({"i": pa.array(np.arange(len(w))), "sum": pa.array(w.astype(np.float64) * seen), "n": pa.array(np.full(len(w), seen))})

        now = rows.filter(F.pmod(F.xxhash64("text_hash"), F.lit(rounds)) == number)
        now = now.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "text_hash", "ids").select("part", "ids")
        sums = now.mapInArrow(fn, "i long, sum double, n long").groupBy("i").agg((F.sum("sum") / F.sum("n")).alias("w"))
        got = sums.toPandas()
        weights = weights.copy()
        weights[got["i"].to_numpy()] = got["w"].to_numpy()
    return unflat(weights)


def scored(rows: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """``row, n_tokens, log_likelihood, score``: the sum over the words, and its mean (null without words)."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def fn(batch: pa.RecordBatch) -> pa.Table:
        w, docs = shared.value, batch.column(1).to_pylist()
        sums, sizes = [], []
        at = 0
        while at < len(docs):
            to, size = at, 0
            while to < len(docs) and size < 200_000:
                size += len(docs[to])
                to += 1
            context, target, n = windows(docs[at:to])
            total = np.concatenate(([0.0], np.cumsum(log_probabilities(w, context, target))))
            ends = np.cumsum(n)
            sums.append(total[ends] - total[ends - n])
            sizes.append(n)
            at = to
        n, total = np.concatenate(sizes), np.concatenate(sums)
        mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
        return pa.table({"row": batch.column(0), "n_tokens": pa.array(n), "log_likelihood": pa.array(total), "score": mean})

    extra = [T.StructField("n_tokens", T.LongType()), T.StructField("log_likelihood", T.DoubleType()), T.StructField("score", T.DoubleType())]
    return rows.select("row", "ids").mapInArrow(in_batches(fn, ""), T.StructType([rows.schema["row"], *extra]))


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Score every row of ``docs`` (``text`` and any other columns); see :func:`scored` for the result.

    ``row`` has all columns but the text. Null, empty and wordless texts have no tokens, a sum of 0 and a null score.
    Equal texts have equal scores. No rows give no rows. Model and vocabulary are learned from ``docs``. Columns of a
    map type are refused.
    """
    arrow_rows(docs, TEXT_ROWS)
    rows = store(with_ids(docs, frequent_words(docs)), "ids")
    return scored(rows, train(rows, rounds))
