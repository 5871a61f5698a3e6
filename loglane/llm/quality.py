"""Quality classifier: histogram gradient-boosted trees over statistics of the text.

Statistics are computed once per document, in arrow batches. Trees are grown on histograms of binned statistics of a
bounded sample of labelled rows (``train_rows``, equal rows counted); all trees are flattened into arrays of the same shape, and
documents walk all of them level by level in numpy.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglane.llm.shared import (
    LOWER, NEWLINE, SPACE, TEXT_ROWS, arrow_rows, bytes_of, distinct_per_row, hashes, in_batches, runs, slices, store,
    sums_between, texts_in,
)

TRAIN_ROWS = 50_000
TREES, DEPTH, BINS, RATE = 80, 4, 64, 0.15
LEAST_HESSIAN, RIDGE = 2.0, 1.0
THRESHOLD = 0.3

# Shares of bytes: symbols, exclamation marks, table bars, digits, capitals, other punctuation, non-ASCII, white space.
CLASSES = {
    "symbols": b"#*$%&<>", "bangs": b"!?", "bars": b"|", "digits": b"0123456789", "capitals": bytes(range(65, 91)),
    "points": b".,;:'\"-()[]{}/\\@_=+~^`", "foreign": bytes(range(128, 256)), "space": b" \t\n\r\v\f",
}
NAMES = [
    *CLASSES, "log_bytes", "log_words", "word_length", "longest_word", "distinct_words", "repeated_pairs", "repeated_fives",
    "log_lines", "line_words", "repeated_lines", "open_lines", "capital_words", "marked_words", "short_words",
]


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.where(whole > 0, part / np.maximum(whole, 1), 0.0)


def _repeated(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Share of the values of each row beyond the distinct ones."""
    _, cuts = distinct_per_row(values, rows, n)
    count = np.bincount(rows, minlength=n)
    return _share(count - np.diff(cuts), count)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics per text, in the order of ``NAMES``; zeros for an empty text."""
    n, size = len(offsets) - 1, np.diff(offsets)
    out = {}
    for name, chars in CLASSES.items():
        chosen = np.zeros(256, np.int64)
        chosen[list(chars)] = 1
        out[name] = _share(sums_between(chosen[raw], offsets), size)
    begins, ends, rows = runs(raw, offsets, SPACE)
    words = hashes(LOWER[raw], begins, ends)
    count = np.bincount(rows, minlength=n)
    length = ends - begins
    out["log_bytes"], out["log_words"] = np.log1p(size), np.log1p(count)
    out["word_length"] = _share(np.bincount(rows, length, n), count)
    longest = np.zeros(n)
    np.maximum.at(longest, rows, length)
    out["longest_word"] = np.log1p(longest)
    out["distinct_words"] = 1 - _repeated(words, rows, n)
    with np.errstate(over="ignore"):
        for name, width in (("repeated_pairs", 2), ("repeated_fives", 5)):
            if len(words) >= width:
                wide = sum(words[i : len(words) - width + 1 + i] * np.uint64(2 * i + 3) for i in range(width))
                same = rows[width - 1 :] == rows[: len(rows) - width + 1]
                out[name] = _repeated(wide[same], rows[: len(wide)][same], n)
            else:
                out[name] = np.zeros(n)
    starts, stops, line_rows = runs(raw, offsets, NEWLINE)
    lines = np.bincount(line_rows, minlength=n)
    out["log_lines"], out["line_words"] = np.log1p(lines), np.log1p(_share(count, lines))
    out["repeated_lines"] = _repeated(hashes(raw, starts, stops), line_rows, n)
    closing = np.zeros(256, bool)
    closing[list(b".!?:;\"')")] = True
    out["open_lines"] = _share(np.bincount(line_rows, ~closing[raw[stops - 1]] if len(stops) else None, n), lines)
    capital, marked = np.zeros(256, bool), np.zeros(256, bool)
    capital[65:91] = True
    marked[list(b"#*$%&|<>!")] = True
    last, first = raw[ends - 1] if len(ends) else raw[:0], raw[begins] if len(begins) else raw[:0]
    inner = raw[np.minimum(begins + 1, np.maximum(ends - 1, 0))] if len(ends) else raw[:0]
    out["capital_words"] = _share(np.bincount(rows, capital[first] & capital[inner] & (length > 1), n), count)
    out["marked_words"] = _share(np.bincount(rows, marked[last], n), count)
    out["short_words"] = _share(np.bincount(rows, length <= 2, n), count)
    return np.stack([np.asarray(out[k], np.float64) for k in NAMES], axis=1)


def with_statistics(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` under ``row``, and the statistics of its ``text`` as an array ``stats``."""

    def fn(batch: pa.RecordBatch) -> pa.Table:
        texts = texts_in(batch.column(0))
        rows = np.concatenate([statistics(*bytes_of(texts, at, to)) for at, to in slices(texts)])
        stats = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))
        return pa.table({"row": batch.column(0), "stats": stats})

    from pyspark.sql import types as T

    arrow_rows(docs, TEXT_ROWS)
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return df.mapInArrow(in_batches(fn, ""), T.StructType([df.schema["row"], T.StructField("stats", T.ArrayType(T.DoubleType()))]))


@dataclass(frozen=True)
class Trees:
    """Trees of one depth, node by node: feature, cut (left if the value is at most the cut), and values of the leaves."""

    base: float
    feature: np.ndarray  # trees x (2**depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # trees x 2**depth

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1 for each row."""
        trees, depth = np.arange(len(self.feature))[None, :], int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        out = np.full(len(x), self.base)
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            node = np.zeros((len(part), len(self.feature)), np.int64)
            for _ in range(depth):
                value = np.take_along_axis(part, self.feature[trees, node], axis=1)
                node = 2 * node + 1 + (value > self.cut[trees, node])
            if depth:
                out[at : at + 4096] += self.leaf[trees, node - (2**depth - 1)].sum(axis=1)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boost trees on the logistic loss. Without rows, or with one label only, the score is constant."""
    n, m = x.shape
    rate = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(rate / (1 - rate)))
    if n == 0 or y.min() == y.max():
        return Trees(base, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, j], quantiles)) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], axis=1)
    columns = np.arange(m) * BINS
    margin = np.full(n, base)
    feature, cut = np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf)
    leaf = np.zeros((trees, 2**depth))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (m * BINS) + columns + binned).ravel()
            sums = [np.bincount(at, np.repeat(v, m), width * m * BINS).reshape(width, m, BINS) for v in (g, h)]
            left_g, left_h = (s.cumsum(axis=2) for s in sums)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(left_h < LEAST_HESSIAN) | (right_h < LEAST_HESSIAN)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    feature[t, first + k], cut[t, first + k] = j, edges[j][b]
            f, c = feature[t, node], cut[t, node]
            node = 2 * node + 1 + (x[np.arange(n), f] > c)
        at = node - (2**depth - 1)
        leaf[t] = -RATE * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + RIDGE)
        margin += leaf[t][at]
    return Trees(base, feature, cut, leaf)


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Trees:
    """Trees from ``stats, label`` (0 or 1; other labels are left out).

    Equal rows are one row with a count. If there are more than ``train_rows`` rows in all, each count is thinned to
    its share of about that many, rounded up or down by a hash of the row, so rows that occur often keep their weight.
    At most ``train_rows`` rows go to the driver and trees are grown on about as many, so its memory is bounded.
    """
    labelled = labelled.filter("label in (0, 1)").groupBy("stats", F.col("label").cast("double").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    n = labelled.agg(F.sum("n")).first()[0] or 0
    draw = F.pmod(F.xxhash64("stats", "label"), F.lit(1 << 20))
    if n > train_rows:
        labelled = labelled.withColumn("n", F.floor(F.col("n") * (train_rows / n) + draw / float(1 << 20))).filter("n > 0")
        labelled = labelled.orderBy(F.desc("n"), draw.desc(), "stats", "label").limit(train_rows)
    got = labelled.toPandas()
    x = np.array(got["stats"].tolist(), float).reshape(len(got), len(NAMES))
    # One order, so that reruns agree.
    order = np.lexsort((*x.T, got["label"].to_numpy()))
    order = np.repeat(order, got["n"].to_numpy(np.int64)[order])
    return grow(x[order], got["label"].to_numpy(float)[order])


def scored(rows: DataFrame, trees: Trees) -> DataFrame:
    """Adds ``score``, the probability of label 1, to rows with ``stats``."""
    shared = rows.sparkSession.sparkContext.broadcast(astuple(trees))

    def fn(batch: pa.RecordBatch) -> pa.Table:
        col = batch.column(batch.schema.get_field_index("stats"))
        x = np.asarray(col.flatten()).reshape(len(col), -1)
        return pa.Table.from_batches([batch]).append_column("score", pa.array(Trees(*shared.value).scores(x)))

    from pyspark.sql import types as T

    return rows.mapInArrow(in_batches(fn, ""), T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """All columns of ``docs`` (``doc_id, text, ...``) under ``row``, and ``score`` from 0 to 1; one row per row.

    ``labels`` has ``doc_id, label`` for the rows to learn from. A null or empty text has statistics of zero and is
    scored like any other. Labels other than 0 and 1, null ids and labels without a document are left out; several
    labels of one id all count. Without any label the score is 0.5; no rows give no rows.
    """
    narrow = store(with_statistics(docs.select("doc_id", "text")).select("row.doc_id", "stats"), "stats")
    trees = fit(narrow.join(labels.select("doc_id", "label"), "doc_id").select("stats", "label"), train_rows)
    return scored(with_statistics(docs), trees).select("row", "score")
