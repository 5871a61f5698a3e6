"""Helpers of the operators in this subpackage: shared storage, the arrow batches of tasks, words as numbers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglane.plans.lineage import ensure_checkpoint_dir

# Bytes of text worked on at a time; bounds the memory of a Python worker.
SLICE_BYTES = 1 << 20
# Rows of an arrow batch: of whole documents, and of anything narrow; and its bytes, about, but for a longer row.
TEXT_ROWS, NARROW_ROWS = 500, 10_000
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str = "llm") -> DataFrame:
    """Write ``df`` as compressed Parquet in the shared folder and read it from there; survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_by(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """As :func:`store`, bucketed by ``key``: grouping the result by it needs no shuffle.

    Only the files stay; the table's name is given up at once.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    table_name = path.rpartition("/")[2].replace("-", "_")
    buckets = min(buckets, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(table_name)
    rows = spark.table(table_name)
    spark.sql(f"DROP TABLE {table_name}")
    return rows


def arrow_rows(df: DataFrame, rows: int) -> None:
    """Rows and bytes of the arrow batches that tasks exchange with Python, for the jobs that follow in ``df``'s session.

    The buffers of a batch exist several times, in the executor and in its workers, so both bounds are short.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = NARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """Successive batches put together to at least ``rows`` rows each, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if sum(b.num_rows for b in held):
        yield pa.concat_batches(held)


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % n


def texts_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column as plain strings, null as empty."""
    return _plain(batch.column(batch.schema.get_field_index(name)))


def texts_in(row: pa.StructArray, name: str = "text") -> pa.Array:
    """A text field of structs that are not null, as plain strings, null as empty."""
    return _plain(row.field(next(i for i, f in enumerate(row.type) if f.name.lower() == name)))


def _plain(col: pa.Array) -> pa.Array:
    return col.cast(pa.string()).fill_null("") if not pa.types.is_string(col.type) else col.fill_null("")


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each; a longer text makes a range of its own."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, min(to, len(texts))
        at = to


def bytes_of(texts: pa.Array, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of rows ``at`` to ``to`` and where each row begins; the last offset is the end."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset + at : texts.offset + to + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, ends - ends[0]


# The white space of the word rule: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True

_draw = np.random.default_rng(20240607)
BYTE_VALUE = _draw.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit about half the time."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def runs(raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of each longest run of bytes that are not in ``gap``; runs end at the end of a row."""
    if not len(raw):
        none = np.empty(0, np.int64)
        return none, none, none
    inside = ~gap[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    begins = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    rows = np.searchsorted(offsets, begins, "right") - 1
    return begins, ends, rows


def hashes(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the rising, disjoint spans of ``raw``.

    Each span is a polynomial in the random values of its bytes, by differences of running sums; memory is
    bounded by working through the bytes in slices that end between spans.
    """
    out = np.empty(len(begins), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(begins):
            base = int(begins[at])
            to = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
            part = raw[base : int(ends[to - 1])]
            powers = np.full(len(part) + 1, BASE, np.uint64)
            powers[0] = 1
            np.cumprod(powers, out=powers)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(BYTE_VALUE[part] * powers[:-1], out=sums[1:])
            inverse = np.full(len(part) + 1, BASE_INVERSE, np.uint64)
            inverse[0] = 1
            np.cumprod(inverse, out=inverse)
            b, e = begins[at:to] - base, ends[at:to] - base
            out[at:to] = mix((sums[e] - sums[b]) * inverse[b])
            at = to
    return out


def distinct_per_row(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row (``rows`` must rise), and where each row begins in them."""
    values = values.copy()
    cuts = np.searchsorted(rows, np.arange(n_rows + 1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[keep], rows[keep]
    return values, np.searchsorted(rows, np.arange(n_rows + 1))


def sums_between(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive cuts."""
    total = np.zeros(len(values) + 1, values.dtype)
    with np.errstate(over="ignore"):
        np.cumsum(values, out=total[1:])
        return total[cuts[1:]] - total[cuts[:-1]]


def in_batches(fn, columns: str):
    """For ``mapInArrow``: ``fn`` maps one record batch to one table; empty batches are left out.

    ``columns`` is the result's schema as Spark writes it.
    """

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch).to_batches()

    return run
