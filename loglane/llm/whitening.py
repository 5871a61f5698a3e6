"""Whitening of embeddings by a bidiagonal qd solver.

Entries become integers, so sums are exact and rows are centred without cancellation. Tasks reduce their centred rows
to a triangular factor, block by block (QR of the factor so far and the next block); factors meet in a tree of bounded
fan-in, and the last one, R, has the singular values and right singular vectors of all rows. R is of the size of a
vector squared, whatever the number of rows; it goes to the driver, where

* Householder reflections make it bidiagonal, R = U B V',
* dqds, the differential qd algorithm with shifts, finds the singular values of B to high relative accuracy,
* twisted factorisations of B'B - s**2 give each singular vector of B directly, with an inverse iteration only where
  values are so close that a vector is not orthogonal to those before it.

The components are these vectors, turned back by V. Vectors of some thousand entries are meant: R, V and one more
matrix of that size are held at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglane.llm.shared import store

# Entry c counts as floor(SCALE * c) + SHIFT; entries of this size or more are refused like infinite ones.
SCALE, SHIFT, LARGEST = 1024, 100_000, float(1 << 42)
# Triangular factors that meet in a task.
FAN_IN = 16
# Entries of the rows that are reduced at a time.
BLOCK = 1 << 20
EPS = float(np.finfo(float).eps)
SPLIT = 26


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and right factor of the bidiagonal form of a square matrix, by Householder reflections."""
    a, d = r.astype(float).copy(), len(r)
    right = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        """Unit vector v so that x - 2 v (v'x) is a multiple of the first axis, and that multiple."""
        top = np.abs(x).max(initial=0.0)
        if top == 0:
            return np.zeros(len(x)), 0.0
        v = x / top
        norm = np.sqrt(v @ v)
        sign = 1.0 if v[0] >= 0 else -1.0
        v[0] += sign * norm
        return v / np.sqrt(v @ v), -sign * norm * top

    diagonal, upper = np.zeros(d), np.zeros(max(0, d - 1))
    for i in range(d):
        v, diagonal[i] = reflector(a[i:, i])
        a[i:, i + 1 :] -= 2 * np.outer(v, v @ a[i:, i + 1 :])
        if i + 1 < d:
            v, upper[i] = reflector(a[i, i + 1 :])
            a[i + 1 :, i + 1 :] -= 2 * np.outer(a[i + 1 :, i + 1 :] @ v, v)
            right[:, i + 1 :] -= 2 * np.outer(right[:, i + 1 :] @ v, v)
    return diagonal, upper, right


def _qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One differential qd transform; None if the shift is too large. The last number is the least pivot."""
    d, least = q[0] - shift, q[0] - shift
    to_q, to_e = [], []
    for i in range(len(q) - 1):
        if d < 0:
            return None
        top = d + e[i]
        if top > 0:
            ratio = q[i + 1] / top
            to_e.append(e[i] * ratio)
            d = d * ratio - shift
        else:
            to_e.append(0.0)
            d = q[i + 1] - shift
        to_q.append(top)
        least = min(least, d)
    if not d >= 0:
        return None
    to_q.append(d)
    return to_q, to_e, least


def squared_singular_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling, by dqds with deflation."""
    small = (16 * EPS) ** 2
    found: list[float] = []
    blocks = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in upper], 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        shift, rounds = 0.0, 0
        while q:
            if len(q) == 1:
                found.append(moved + q[0])
                break
            if e[-1] <= small * (moved + q[-1]):
                found.append(moved + q[-1])
                q.pop()
                e.pop()
                continue
            cut = next((i for i in range(len(e) - 2, -1, -1) if e[i] <= small * (moved + min(q[i], q[i + 1]))), None)
            if cut is not None:
                blocks.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if 1.5 * q[0] < q[-1]:
                # The transform works small values down; turned round, a block has the same singular values.
                q, e = q[::-1], e[::-1]
                shift = 0.0
            step = _qd_step(q, e, shift)
            while step is None:
                shift = shift / 4 if shift > EPS * EPS * moved else 0.0
                step = _qd_step(q, e, shift)
            moved += shift
            q, e, least = step
            # The least pivot bounds the least value from above; once it settles, most of it is a safe shift.
            shift = max(0.0, least * (1 - 4 * EPS) if e[-1] < 0.01 * least else 0.75 * least)
            rounds += 1
            if rounds > 200 * (len(q) + 10):
                raise RuntimeError("the qd iteration did not settle")
    return np.sort(np.array(found))[::-1]


class Twisted:
    """Factors of B'B - value from the top and from the bottom, which meet at a twist."""

    def __init__(self, diagonal: np.ndarray, upper: np.ndarray, value: float):
        tiny = EPS * EPS * max(np.abs(diagonal).max(), np.abs(upper).max(initial=0.0), 1e-150) ** 2
        a = np.where(np.abs(diagonal) > np.sqrt(tiny), diagonal, np.sqrt(tiny))
        d, low, n = (a * a).tolist(), (upper / a[:-1]).tolist(), len(a)
        self.down, self.top, s = [0.0] * (n - 1), [0.0] * n, [0.0] * n
        s[0] = -value
        for i in range(n):
            pivot = d[i] + s[i]
            self.top[i] = pivot if abs(pivot) > tiny else -tiny
            if i < n - 1:
                self.down[i] = d[i] * low[i] / self.top[i]
                s[i + 1] = self.down[i] * low[i] * s[i] - value
        up, p = [0.0] * (n - 1), [0.0] * n
        p[n - 1] = d[n - 1] - value
        for i in range(n - 2, -1, -1):
            pivot = d[i] * low[i] ** 2 + p[i + 1]
            ratio = d[i] / (pivot if abs(pivot) > tiny else -tiny)
            up[i] = low[i] * ratio
            p[i] = p[i + 1] * ratio - value
        self.up = up
        self.twist = int(np.argmin(np.abs(np.array(s) + np.array(p) + value)))

    def vector(self) -> np.ndarray:
        """The singular vector: all equations hold but that of the twist, whose pivot is the least."""
        z = np.zeros(len(self.top))
        z[self.twist] = 1.0
        for i in range(self.twist - 1, -1, -1):
            z[i] = -self.down[i] * z[i + 1]
        for i in range(self.twist, len(z) - 1):
            z[i + 1] = -self.up[i] * z[i]
        return z / np.sqrt(z @ z)

    def solve(self, x: np.ndarray) -> np.ndarray:
        """(B'B - value) y = x, by the factors from the top."""
        y = x.copy()
        for i in range(len(y) - 1):
            y[i + 1] -= self.down[i] * y[i]
        y /= np.array(self.top)
        for i in range(len(y) - 2, -1, -1):
            y[i] -= self.down[i] * y[i + 1]
        return y


def singular_vectors(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Orthonormal right singular vectors of a bidiagonal matrix, as columns, for its largest squared values."""
    n, out = len(diagonal), np.zeros((len(diagonal), 0))
    draw = np.random.default_rng(n)
    for value in values:
        factors = Twisted(diagonal, upper, float(value))
        z = factors.vector()
        rest = z - out @ (out.T @ z)
        if rest @ rest < 0.5:
            # Of values this close, another vector of the same space: inverse iteration, kept off the vectors before.
            rest = draw.normal(size=n)
            for _ in range(4):
                rest -= out @ (out.T @ rest)
                rest = factors.solve(rest / np.sqrt(rest @ rest))
                rest /= np.abs(rest).max()
                rest -= out @ (out.T @ rest)
        for _ in range(2):
            rest -= out @ (out.T @ rest)
            rest /= np.sqrt(rest @ rest)
        out = np.column_stack([out, rest])
    return out


@dataclass
class Model:
    """Exact sums of ``n`` vectors, components as columns, their eigenvalues, and the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: whole parts as integers, so nothing cancels."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (x - whole) - np.array([s % self.n / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - sum)**2 of each row, exact; None beyond 64 bits."""
        whole, part = (np.array([f(s, self.n) for s in self.sums], np.int64) for f in (int.__floordiv__, int.__mod__))
        apart = x - whole
        if float(np.abs(apart).max(initial=0) + 1.0) * self.n < np.sqrt(2.0**62 / max(1, self.width)):
            return np.square(self.n * apart - part).sum(axis=1).tolist()
        rows = ((self.n * apart.astype(object) - part) ** 2).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in rows]


def integers(vectors: DataFrame, column: str) -> DataFrame:
    """``row, x`` (entries as whole numbers) of the vectors without null, infinite or refused entries."""
    c = F.col(f"`{column}`")
    row = F.struct(*[F.col(f"`{n}`") for n in vectors.columns]).alias("row")
    usable = (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < LARGEST))
    x = F.transform(c, lambda v: F.floor(v.cast("double") * SCALE) + SHIFT).cast("array<long>").alias("x")
    return vectors.filter(c.isNotNull() & usable).select(row, x)


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists of whole numbers as rows."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch], name: str = "x") -> Iterator[np.ndarray]:
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name))
        step = max(1, BLOCK // max(1, len(column[0]) if len(column) else 1))
        for at in range(0, len(column), step):
            yield _matrix(column[at : at + step])


def _totals(rows: DataFrame) -> dict[int, int]:
    """Exact sums per place; place -1 counts the rows. Halves of the numbers are summed apart, so nothing overflows."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = low = None
        n = 0
        for x in _blocks(batches):
            h, lo = (x >> SPLIT).sum(axis=0), (x & ((1 << SPLIT) - 1)).sum(axis=0)
            high, low, n = (h, lo, n + len(x)) if high is None else (high + h, low + lo, n + len(x))
        if n:
            place = np.arange(-1, len(high))
            yield pa.record_batch({"place": pa.array(place), "high": pa.array(np.append(0, high)), "low": pa.array(np.append(n, low))})

    parts = rows.select("x").mapInArrow(fn, "place long, high long, low long").groupBy("place")
    got = parts.agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]).collect()
    return {r["place"]: (int(r["high"]) << SPLIT) + int(r["low"]) for r in got}


def _triangle(rows: DataFrame, model: Model) -> np.ndarray:
    """The triangular factor of all centred rows."""

    def pack(part: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"part": pa.array([part], pa.int64()), "r": pa.array([r.astype("<f8").tobytes()], pa.binary())})

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.zeros((0, model.width))
        for x in _blocks(batches):
            r = np.linalg.qr(np.vstack([r, model.centred(x)]), mode="r")
        yield pack(TaskContext.get().partitionId(), r)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches)).sort_by("part")
        parts = [np.frombuffer(x.as_py(), "<f8").reshape(-1, model.width) for x in whole["r"]]
        yield pack(whole["part"][0].as_py() // FAN_IN, np.linalg.qr(np.vstack(parts), mode="r"))

    factors = store(rows.select("x").mapInArrow(reduce, "part long, r binary"), "factors")
    # Numbers of parts shrink with each level, to 0 in the end.
    while factors.count() > 1:
        group = F.floor(F.col("part") / FAN_IN).alias("group")
        factors = store(factors.select("part", "r", group).groupBy("group").applyInArrow(meet, "part long, r binary"), "factors")
    row = factors.first()
    r = np.frombuffer(bytes(row["r"]), "<f8").reshape(-1, model.width) if row else np.zeros((0, model.width))
    return np.vstack([r, np.zeros((model.width - len(r), model.width))])


def fit(rows: DataFrame, most: int = 8) -> Model | None:
    """The model of ``rows`` (from :func:`integers`); None without rows.

    Rows must have one width. Components are those of the ``most`` largest eigenvalues, without those that are zero to
    double precision; the largest entry of each is positive.
    """
    totals = _totals(rows)
    if not totals:
        return None
    model = Model(totals[-1], [totals[i] for i in range(len(totals) - 1)], np.zeros((len(totals) - 1, 0)), np.zeros(0), 0.0)
    r = _triangle(rows, model)
    diagonal, upper, right = bidiagonal(r)
    values = squared_singular_values(diagonal, upper)
    values = values[values > values[0] * (EPS * max(model.width, 8)) ** 2][:most]
    components = right @ singular_vectors(diagonal, upper, values)
    components *= np.sign(components[np.abs(components).argmax(axis=0), np.arange(len(values))]) if len(values) else 1.0
    return Model(model.n, model.sums, components, values / model.n, float(np.square(r).sum() / model.n))


def identity_error(rows: DataFrame, model: Model) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, over all rows."""
    k = len(model.values)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The first row and column sum the whitened values themselves.
        total = np.zeros((k + 1, k + 1))
        for x in _blocks(batches):
            w = np.column_stack([np.ones(len(x)), model.whitened(x)])
            total += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.record_batch({"i": pa.array(i.ravel()), "j": pa.array(j.ravel()), "v": pa.array(total.ravel())})

    got = rows.select("x").mapInArrow(fn, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((k + 1, k + 1))
    for r in got:
        total[r["i"], r["j"]] = r["v"] / model.n
    return float(np.abs(total[1:, 1:] - np.outer(total[0, 1:], total[0, 1:]) - np.eye(k)).max(initial=0.0))


def whiten(vectors: DataFrame, column: str = "embedding", most: int = 8) -> DataFrame:
    """``row`` (all columns of ``vectors``), ``n, deviation, whitened, explained, identity_error``.

    Vectors that are null or empty, hold null, NaN or infinite entries, or entries of 2**42 or more, are left out, as
    are vectors of another than the commonest width (of several, the least). ``whitened`` and ``explained`` have a
    value for each component, at most ``most``; equal vectors have equal values. Where all vectors are equal there is no
    component and the lists are empty. ``deviation`` is exact, null beyond 64 bits. No vectors give no rows.
    """
    if most < 1:
        raise ValueError("most must be positive")
    rows = integers(vectors, column)
    width = rows.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").first()
    if width is None:
        model, off = Model(0, [0], np.zeros((1, 0)), np.zeros(0), 0.0), 0.0
    else:
        rows = rows.filter(F.size("x") == width["width"])
        model = fit(rows, most)
        off = identity_error(rows, model)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, column = batch.column(0), batch.column(1)
            step = max(1, BLOCK // model.width)
            for at in range(0, len(column), step):
                x = _matrix(column[at : at + step])
                w = model.whitened(x)
                cuts = pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32())
                yield pa.record_batch({
                    "row": row[at : at + step], "deviation": pa.array(model.deviations(x), pa.int64()),
                    "whitened": pa.ListArray.from_arrays(cuts, pa.array(w.ravel())),
                })

    out = rows.mapInArrow(fn, rows.select("row").schema.add("deviation", "long").add("whitened", T.ArrayType(T.DoubleType())))
    explained = _literal(model.values / model.trace if model.trace else model.values)
    return out.select("row", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(off).alias("identity_error"))


def _literal(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")
