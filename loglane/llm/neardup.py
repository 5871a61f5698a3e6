"""Embedding near-duplicates by cross-polytope hashing.

A vector is rotated pseudo-randomly (three rounds of random signs and a fast Hadamard transform) and hashed to the
nearest of the ``2 d`` signed axes; ``hashes`` such axes make a bucket of a table. Every vector lies in one bucket of
each table and also probes the buckets of its next nearest axes. Pairs that meet in a bucket are verified by their
cosine in double precision.

Equal vectors are one node with a count. Buckets are verified as matrix products; what leaves a task is, for each
vector, how many others it is linked with and one link to the least of its group, never the pairs. A pair that meets
in several buckets counts in the first one only, which the vectors' codes tell. Large buckets are split into
parts that are compared part by part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglane.llm.components import components
from loglane.llm.shared import NARROW_ROWS, arrow_rows, in_batches, mix, store

TABLES, HASHES, PROBES = 6, 2, 4
# Vectors of a part of a bucket, and their bytes; components of vectors hashed at a time.
PART, PART_BYTES, BLOCK = 2048, 1 << 25, 1 << 22


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, orthonormal; the width must be a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def codes(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = 11) -> np.ndarray:
    """Buckets of unit vectors, ``n x tables x probes``; the first probe is the vector's own bucket.

    Each hash offers its nearest axis and the next one; probes are the combinations of least total loss.
    """
    n, width = x.shape
    d = 1 << max(1, (width - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - width)))
    draw = np.random.default_rng(seed)
    out = np.zeros((n, tables, probes), np.int64)
    choices = np.array([[(c >> k) & 1 for k in range(hashes)] for c in range(1 << hashes)])
    for t in range(tables):
        loss, axis = np.zeros((n, hashes, 2)), np.zeros((n, hashes, 2), np.int64)
        for k in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * draw.choice([-1.0, 1.0], d))
            size = np.abs(y)
            best = np.argpartition(-size, 1, axis=1)[:, :2] if d > 2 else np.tile([0, 1], (n, 1))
            value = np.take_along_axis(size, best, axis=1)
            order = np.argsort(-value, axis=1, kind="stable")
            best, value = np.take_along_axis(best, order, axis=1), np.take_along_axis(value, order, axis=1)
            loss[:, k] = value[:, :1] - value
            axis[:, k] = 2 * best + (np.take_along_axis(y, best, axis=1) < 0)
        total = np.zeros((n, len(choices)))
        bucket = np.zeros((n, len(choices)), np.int64)
        for k in range(hashes):
            total += loss[:, k][:, choices[:, k]]
            bucket = bucket * (2 * d) + axis[:, k][:, choices[:, k]]
        # The own bucket has no loss; equal losses keep the order of the choices.
        order = np.argsort(total, axis=1, kind="stable")[:, :probes]
        found = np.take_along_axis(bucket, order, axis=1)
        out[:, t, : found.shape[1]] = found
        out[:, t, found.shape[1] :] = -1
    return out


def _nodes(rows: DataFrame) -> DataFrame:
    """``vec_id, node, packed``: a number for each different vector; null where the vector can link with nothing."""

    def fn(batch: pa.RecordBatch) -> pa.Table:
        nodes, packed = [], []
        for v in batch.column(1).to_pylist():
            node = blob = None
            if v and None not in v:
                # Adding zero makes one zero of both.
                x = np.array(v, np.float64) + 0.0
                if np.isfinite(x).all() and x.any():
                    small = x.astype(np.float32)
                    blob = b"\4" + small.tobytes() if (small == x).all() else b"\10" + x.tobytes()
                    node = xxhash.xxh3_64_intdigest(blob) - (1 << 63)
            nodes.append(node)
            packed.append(blob)
        return pa.table({"vec_id": batch.column(0), "node": pa.array(nodes, pa.int64()), "packed": pa.array(packed, pa.binary())})

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "embedding").mapInArrow(in_batches(fn, ""), f"vec_id {kind}, node long, packed binary")


def units(packed: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision from packed ones of one length."""
    x = np.array([np.frombuffer(b[1:], np.float32 if b[0] == 4 else np.float64) for b in packed], np.float64)
    # Scaled first, so that very large and very small numbers keep their direction.
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _width(b: bytes) -> int:
    return (len(b) - 1) // (4 if b[0] == 4 else 8)


def _numbered(code: np.ndarray, width: int) -> np.ndarray:
    """Bucket numbers, not negative, of the codes of each table: distinct below 16,384 components, hashed beyond."""
    table = np.arange(code.shape[1])[None, :, None]
    if width < 1 << 14:
        return ((width * 256 + table) << 40) + code
    mixed = mix(mix(code.astype(np.uint64), 1) + table.astype(np.uint64), width % (1 << 32))
    return (mixed >> np.uint64(2)).astype(np.int64) | (1 << 62)


def _bucketed(nodes: DataFrame, tables: int, hashes: int, probes: int) -> DataFrame:
    """``bucket`` (of table, width and axes), ``base`` (own bucket or probe) and the vector, for each probe of each node."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(1).to_pylist()
            widths = np.array([_width(b) for b in packed])
            for w in np.unique(widths):
                for at in np.array_split(np.flatnonzero(widths == w), -(-int((widths == w).sum()) // max(1, min(1000, BLOCK // int(w))))):
                    code = codes(units([packed[i] for i in at]), tables, hashes, probes)
                    bucket = np.where(code >= 0, _numbered(code, int(w)), -1)
                    blobs = pa.array([c.astype(np.int64).tobytes() for c in bucket], pa.binary())
                    row, _, probe = np.nonzero(bucket >= 0)
                    index = pa.array(at[row])
                    yield pa.record_batch({
                        "bucket": pa.array(bucket[bucket >= 0]), "base": pa.array(probe == 0), "node": batch.column(0).take(index),
                        "packed": batch.column(1).take(index), "copies": batch.column(2).take(index), "codes": blobs.take(pa.array(row)),
                    })

    return nodes.select("node", "packed", "copies").mapInArrow(fn, "bucket long, base boolean, node long, packed binary, copies long, codes binary")


def _first_meeting(a: np.ndarray, b: np.ndarray, probes: int) -> np.ndarray:
    """The bucket where each pair (the lesser node's codes in ``a``) counts: the first that one has as its own and
    the other probes."""
    n, tables = len(a), a.shape[1] // probes
    a, b = a.reshape(n, tables, probes), b.reshape(n, tables, probes)
    x = (a == b[:, :, :1]).any(axis=2)
    y = (b == a[:, :, :1]).any(axis=2)
    met = np.stack((x, y), axis=2).reshape(n, -1)
    where = np.stack((b[:, :, 0], a[:, :, 0]), axis=2).reshape(n, -1)
    return where[np.arange(n), met.argmax(axis=1)]


def _verified(rows: DataFrame, least: float, probes: int) -> DataFrame:
    """``node, links, root``: verified links of a node in one bucket, and the least node of its group there."""

    def fn(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches))
        bucket = whole["bucket"][0].as_py()
        base, left, right = (whole[c].to_numpy() for c in ("base", "left", "right"))
        if not right.any() or len(whole) < 2:
            return
        node, copies = whole["node"].to_numpy(), whole["copies"].to_numpy()
        x = units(whole["packed"].to_pylist())
        code = np.array([np.frombuffer(c, np.int64) for c in whole["codes"].to_pylist()])
        links, parent = np.zeros(len(x), np.int64), np.arange(len(x))
        rows, columns = np.flatnonzero(left), np.flatnonzero(right)
        for at in range(0, len(rows), 512):
            some = rows[at : at + 512]
            i, j = np.nonzero(x[some] @ x[columns].T >= least)
            i, j = some[i], columns[j]
            # Two members that have the bucket as their own meet in both orders; one counts.
            keep = (node[i] != node[j]) & (~base[i] | (node[i] < node[j]))
            i, j = i[keep], j[keep]
            if len(i):
                lower = node[i] < node[j]
                a, b = np.where(lower, i, j), np.where(lower, j, i)
                here = _first_meeting(code[a], code[b], probes) == bucket
                a, b = a[here], b[here]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                for p, q in zip(a.tolist(), b.tolist(), strict=True):
                    while parent[p] != p:
                        parent[p] = parent[parent[p]]
                        p = parent[p]
                    while parent[q] != q:
                        parent[q] = parent[parent[q]]
                        q = parent[q]
                    if p != q:
                        parent[max(p, q)] = min(p, q)
        hit = np.flatnonzero(links)
        if not len(hit):
            return
        for p in hit.tolist():
            q = p
            while parent[q] != q:
                q = parent[q]
            parent[p] = q
        yield pa.record_batch({"node": pa.array(node[hit]), "links": pa.array(links[hit]), "root": pa.array(node[parent[hit]])})

    return rows.groupBy("bucket", "i", "j").applyInArrow(fn, "node long, links long, root long")


def near_duplicates(
    rows: DataFrame, least: float = 0.95, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one per row of ``rows`` (``vec_id, embedding``; more columns are ignored).

    Rows are linked when a bucket brings them together and their cosine is ``least`` or more; equal vectors always
    are. ``n_links`` counts linked other rows, ``component_id`` is the least ``vec_id`` that links reach and ``kept`` is
    true where it is the row's own. Vectors that are null, empty, zero, or have a null or non-finite component link
    with nothing: no links, their own component, kept. Vectors of different lengths never link. Rows with a null
    ``vec_id`` are counted as others, are not kept unless they link with nothing, and get null where their component has
    no id. No rows give no rows. Recall depends on tables, hashes and probes; the tests measure it.
    """
    if not 0 < least <= 1 or not 1 <= probes <= 1 << hashes:
        raise ValueError("least must be over 0 and at most 1, probes at most 2 to the power of hashes")
    arrow_rows(rows, NARROW_ROWS)
    found = store(_nodes(rows), "vectors")
    nodes = found.filter("node is not null").groupBy("node").agg(
        F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("packed").alias("packed")
    )
    nodes = store(nodes, "nodes")
    met = store(_bucketed(nodes, tables, hashes, probes), "buckets")
    sizes = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base").cast("int")).alias("bases"), F.sum(F.length("packed")).alias("bytes"))
    # Buckets with one vector, or that vectors only probe, link nothing.
    sizes = sizes.filter("n > 1 and bases > 0").select("bucket", F.greatest(F.ceil(F.col("n") / PART), F.ceil(F.col("bytes") / PART_BYTES)).alias("parts"))
    met = met.join(sizes, "bucket").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)
    # Part i of all members meets part j of those whose own bucket it is.
    asks = met.withColumn("i", F.col("part")).withColumn("j", F.explode(every)).withColumn("left", F.lit(True))
    asks = asks.withColumn("right", F.col("base") & (F.col("part") == F.col("j")))
    other = met.filter("base and parts > 1").withColumn("j", F.col("part")).withColumn("i", F.explode(every))
    other = other.filter("i <> part").withColumn("left", F.lit(False)).withColumn("right", F.lit(True))
    sides = asks.unionByName(other.select(asks.columns)).drop("parts", "part")
    links = store(_verified(sides, least, probes), "links")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    whole = nodes.select("node", "least_id", "copies").join(counts, "node", "left").join(roots, "node", "left")
    whole = whole.withColumn("root", F.coalesce("root", "node"))
    ids = whole.groupBy("root").agg(F.min("least_id").alias("component_id"))
    whole = whole.join(ids, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = found.select("vec_id", "node").join(whole, "node", "left")
    alone = F.col("node").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), alone.alias("alone"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("alone") | (F.col("n_links") == 0))
    return out.select("vec_id", "n_links", "component_id", kept.alias("kept"))


# All pairs in SQL, for tables small enough for that.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
  ok AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
  pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
  reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
  root AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM pairs p WHERE p.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN root ON v.vec_id = root.a
"""
