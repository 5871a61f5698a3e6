"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are split into words (the pattern's matches). A task gathers its documents into *pieces* of a bounded number
of words and numbers each piece's distinct words; the words' positions stay with the piece, as numbers in order. The
distinct words of all pieces are shuffled by word, so that every distinct word of the corpus is encoded once; the ids go
back to the pieces that have the word, and the documents are put together again by position. A frequent word
is one entry per piece, however often it occurs, so no word makes a hot task. Words and ids travel in rows of
many, one for each piece and bucket of words, compressed; the pieces themselves are stored in buckets by piece and are
not shuffled. Decoding looks ids up in the table of token bytes, whose
size is fixed.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglane.llm.shared import TEXT_ROWS, arrow_rows, bytes_of, slices, store_by, texts_of

# Words of a piece, about, and rows that a task sends at a time. A text is never split over pieces.
PIECE_WORDS = 2_000_000
SEND_ROWS = 2_000
LEAST_BUCKETS = 64
# Bytes up to which a word is merged by plain search, and the rank of pairs that never merge.
SHORT = 64
NEVER = 1 << 60
# First byte of UTF-8 from which characters may be classed differently (U+0540 and above).
FAR_BYTE = 0xD5


def read_ranks(rank_file: str) -> dict[bytes, int]:
    """Ranks from a file of base64 words and numbers, read by the driver; the vocabulary's size is fixed."""
    with open(rank_file, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _ranges(chars: str) -> str:
    """The characters (in rising order) as ranges of a character class."""
    codes = np.frombuffer(chars.encode("utf-32-le"), np.uint32).astype(np.int64)
    cut = np.flatnonzero(np.diff(codes) > 1)
    first, last = codes[np.concatenate(([0], cut + 1))], codes[np.concatenate((cut, [len(codes) - 1]))]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first.tolist(), last.tolist(), strict=True))


def library_pattern(pattern: str) -> str:
    """``pattern`` with the letters and numbers of the tokenizer library's Unicode version spelled out.

    The two libraries know different versions of Unicode; they agree below U+0540.
    """
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out, inside, at = [], False, 0
    known = {}
    while at < len(pattern):
        name = pattern[at : at + 5]
        if name in (r"\p{L}", r"\p{N}"):
            if name not in known:
                probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks=single, special_tokens={})
                known[name] = _ranges(probe.decode_bytes(probe.encode_ordinary(every)).decode())
            out.append(known[name] if inside else f"[{known[name]}]")
            at += 5
            continue
        step = 2 if pattern[at] == "\\" else 1
        inside = {"[": True, "]": False}.get(pattern[at], inside)
        out.append(pattern[at : at + step])
        at += step
    return "".join(out)


def bpe(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of least rank is merged, leftmost first, until none has a rank."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > SHORT:
        return _bpe_long(word, ranks)
    get = ranks.get
    cuts = list(range(len(word) + 1))
    pairs = [get(word[i : i + 2], NEVER) for i in range(len(word) - 1)]
    while pairs and (least := min(pairs)) != NEVER:
        i = pairs.index(least)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(word[cuts[i] : cuts[i + 2]], NEVER)
        if i:
            pairs[i - 1] = get(word[cuts[i - 1] : cuts[i + 1]], NEVER)
    return [ranks[word[x:y]] for x, y in zip(cuts, cuts[1:])]  # noqa: B905


def _bpe_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for long words at n log n: a heap of candidate pairs over a linked list of parts."""
    n = len(word)
    end = list(range(1, n + 1))
    before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        if after[i] < n and (r := ranks.get(word[i : end[after[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[after[i]]))
        if (k := before[i]) >= 0 and (r := ranks.get(word[k : end[i]])) is not None:
            heapq.heappush(heap, (r, k, end[i]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def pack(numbers: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """The numbers between consecutive cuts, rising in each run, as differences of seven bits a byte.

    The last byte of each number is below 128. All runs are packed at once.
    """
    if not len(numbers):
        return [b""] * (len(cuts) - 1)
    gaps = np.diff(numbers, prepend=0)
    first = cuts[:-1][cuts[:-1] < cuts[1:]]
    gaps[first] = numbers[first]
    n = 1 + sum((gaps >= 1 << (7 * k)).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(n)
    out = np.zeros(ends[-1], np.uint8)
    for k in range(int(n.max())):
        has = np.flatnonzero(n > k)
        out[ends[has] - 1 - k] = ((gaps[has] >> (7 * k)) & 127) | (128 if k else 0)
    raw, at = out.tobytes(), np.concatenate(([0], ends))[cuts].tolist()
    return [raw[x:y] for x, y in zip(at, at[1:])]  # noqa: B905


def unpack(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the packed runs, and where each run begins in them; the last is the end."""
    raw = np.frombuffer(b"".join(packed), np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate((np.zeros(min(1, len(last)), np.int64), last[:-1] + 1))
    gaps = np.zeros(len(last), np.int64)
    for k in range(int((last - first).max(initial=0)) + 1):
        has = np.flatnonzero(last - first >= k)
        gaps[has] = (gaps[has] << 7) | (raw[first[has] + k] & 127)
    bytes_of_run = np.fromiter(map(len, packed), np.int64, len(packed))
    cuts = np.searchsorted(last, np.concatenate(([0], np.cumsum(bytes_of_run))))
    sums = np.concatenate(([0], np.cumsum(gaps)))
    return sums[1:] - np.repeat(sums[cuts[:-1]], np.diff(cuts)), cuts


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _expand(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)


def _pieces(docs: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """``piece, bucket, numbers, content`` from ``row, text``.

    In each piece words are numbered by falling frequency. One row, of bucket -1, has the numbers of the piece's words
    one after the other (a plane for each byte) and as an arrow stream ``row`` and the words of each document. For each
    bucket of words a row has the numbers and the words that the piece has in it.
    """
    full = docs.sparkSession.sparkContext.broadcast(library_pattern(pattern))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quick, slow = regex.compile(pattern).findall, None
        task, done = TaskContext.get().partitionId(), 0
        known: dict[str, int] = {}
        held: list[np.ndarray] = []
        rows: list[pa.RecordBatch] = []
        size = 0

        def flush():
            nonlocal known, held, rows, size, done
            order = np.concatenate(held)
            held, size = [], 0
            by_use = np.argsort(-np.bincount(order, minlength=len(known)), kind="stable")
            number = np.empty(len(known), np.int32)
            number[by_use] = np.arange(len(known), dtype=np.int32)
            planes = max(1, (len(known).bit_length() + 7) // 8)
            line = number[order].astype("<i4").view(np.uint8).reshape(-1, 4)[:, :planes].T.tobytes()
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, rows[0].schema) as stream:
                for r in rows:
                    stream.write_batch(r)
            names = [w.encode() for w in known]
            names = [names[i] for i in by_use.tolist()]
            bucket = np.fromiter(map(zlib.crc32, names), np.int64, len(names)) % buckets
            dealt = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[dealt], prepend=-1, append=-1))
            numbers = pack(dealt, cuts) if len(names) else []
            content = []
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                few = [names[i] for i in dealt[x:y].tolist()]
                content.append(_squeeze(np.fromiter(map(len, few), "<u4", len(few)).tobytes() + b"".join(few)))
            piece = (task << 32) + done
            known, rows, done = {}, [], done + 1
            yield _piece_rows([piece], [-1], [_squeeze(line)], [_squeeze(out.getvalue().to_pybytes())])
            for x in range(0, len(content), SEND_ROWS):
                y = min(x + SEND_ROWS, len(content))
                yield _piece_rows([piece] * (y - x), bucket[dealt[cuts[x:y]]], numbers[x:y], content[x:y])

        for batch in batches:
            texts = texts_of(batch, "text")
            for at, to in slices(texts):
                counts, find = [], quick
                raw = bytes_of(texts, at, to)[0]
                if len(raw) and raw.max() >= FAR_BYTE:
                    find = slow = slow or regex.compile(full.value).findall
                for text in texts[at:to].to_pylist():
                    words = find(text)
                    held.append(np.fromiter([known.setdefault(w, len(known)) for w in words], np.int32, len(words)))
                    counts.append(len(words))
                size += sum(counts)
                # A copy, so that the batch itself is not held.
                few = batch.column(0).slice(at, to - at).take(pa.array(range(to - at)))
                rows.append(pa.record_batch({"row": few, "words": pa.array(counts, pa.int64())}))
                if size >= PIECE_WORDS:
                    yield from flush()
        if rows:
            yield from flush()

    return docs.mapInArrow(fn, PIECE)


PIECE = "piece long, bucket long, numbers binary, content binary"


def _piece_rows(piece, bucket, numbers, content) -> pa.RecordBatch:
    return pa.record_batch({
        "piece": pa.array(piece, pa.int64()), "bucket": pa.array(bucket, pa.int64()),
        "numbers": pa.array(numbers, pa.binary()), "content": pa.array(content, pa.binary()),
    })


def _coded(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The rows of words with their ids (how many of each, then all) in place of the words.

    All rows of a word meet in its bucket, which encodes each distinct word once and joins its ids to all of them.
    """
    shared = words.sparkSession.sparkContext.broadcast(ranks)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = shared.value, {}
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for at in range(0, batch.num_rows, 256):
                numbers, out = cols["numbers"][at : at + 256].to_pylist(), []
                for packed, content in zip(numbers, cols["content"][at : at + 256].to_pylist(), strict=True):
                    raw, n = _expand(content), sum(x < 128 for x in packed)
                    ends = np.cumsum(np.frombuffer(raw, "<u4", n)).tolist()
                    ids, begin, names = [], 4 * n, []
                    for end in ends:
                        names.append(raw[begin : 4 * n + end])
                        begin = 4 * n + end
                    for w in names:
                        x = known.get(w)
                        if x is None:
                            x = known[w] = np.array(bpe(w, table), "<u4").tobytes()
                        ids.append(x)
                    out.append(_squeeze(np.fromiter(map(len, ids), "<u4", n).tobytes() + b"".join(ids)))
                yield _piece_rows(cols["piece"][at : at + 256], cols["bucket"][at : at + 256], numbers, out)

    return words.groupBy("bucket").applyInArrow(fn, PIECE)


def _assembled(pieces: DataFrame, coded: DataFrame, row_type: T.DataType, packed: bool) -> DataFrame:
    """``row, n_tokens`` of each document, and its ids ``packed`` (four bytes each) or as an array ``ids``.

    ``pieces`` has one row a piece, ``coded`` a row for each piece and bucket of words; a piece may have no words.
    """
    name, kind = ("packed", T.BinaryType()) if packed else ("ids", T.ArrayType(T.IntegerType()))

    def fn(piece: pa.Table, coded: pa.Table) -> pa.Table:
        numbers, lengths, flat, found = coded["numbers"].to_pylist(), [], [], []
        line, docs = _expand(piece["numbers"][0].as_py()), list(pa.ipc.open_stream(_expand(piece["content"][0].as_py())))
        for places, content in zip(numbers, coded["content"], strict=True):
            raw, n = _expand(content.as_py()), sum(x < 128 for x in places)
            lengths.append(np.frombuffer(raw, "<u4", n).astype(np.int64) // 4)
            flat.append(np.frombuffer(raw, "<u4", offset=4 * n))
        total = sum(pc.sum(d.column(1)).as_py() for d in docs)
        number = unpack(numbers)[0]
        length, begin = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        if len(number):
            length[number] = sizes = np.concatenate(lengths)
            begin[number] = np.cumsum(sizes) - sizes
        flat = np.concatenate(flat) if flat else np.empty(0, np.uint32)
        word = np.zeros((total, 4), np.uint8)
        if total:
            planes = np.frombuffer(line, np.uint8).reshape(-1, total)
            word[:, : len(planes)] = planes.T
        word = word.view("<i4").ravel()
        at = 0
        for d in docs:
            counts = d.column(1).to_numpy()
            few = word[at : at + int(counts.sum())]
            at += len(few)
            n = length[few]
            ends = np.cumsum(n)
            ids = flat[np.repeat(begin[few] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
            cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
            if packed:
                col = pa.array([ids[x:y].tobytes() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())
            else:
                col = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.view(np.int32)))
            found.append(pa.record_batch({"row": d.column(0), "n_tokens": pa.array(np.diff(cuts)), name: col}))
        return pa.Table.from_batches(found)

    schema = T.StructType([T.StructField("row", row_type), T.StructField("n_tokens", T.LongType()), T.StructField(name, kind)])
    return pieces.groupBy("piece").cogroup(coded.groupBy("piece")).applyInArrow(fn, schema)


def encode_packed(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: list[str] | None = None, packed: bool = True,
) -> DataFrame:
    """``row`` (the columns ``keep`` of each document, else all but ``text``), ``n_tokens``, ``packed``.

    ``packed`` has the ids, four bytes each, little-endian. One row per row of ``docs``; repeated rows stay.
    Null and empty texts have no ids. No rows give no rows. Other columns may have any names. A text's words must
    fit in a task; a corpus of any size has pieces of one size.
    """
    keep = [c for c in docs.columns if c != "text"] if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(True).alias("none"))
    rows = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"))
    arrow_rows(docs, TEXT_ROWS)
    parts = docs.rdd.getNumPartitions()
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Read again twice; a bucket's words come from all pieces, so buckets follow the input's size.
    pieces = store_by(_pieces(rows, pattern, max(LEAST_BUCKETS, 2 * parts)), "piece", max(least, parts), "pieces")
    coded = _coded(pieces.filter("bucket >= 0"), ranks)
    return _assembled(pieces.filter("bucket < 0"), coded, rows.schema["row"].dataType, packed)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: list[str] | None = None) -> DataFrame:
    """As :func:`encode_packed`, with ``ids`` as an array of int in place of ``packed``."""
    return encode_packed(docs, ranks, pattern, keep, packed=False)


class TokenBytes:
    """The bytes of every id, for decoding many ids at once."""

    def __init__(self, ranks: dict[bytes, int]):
        names = [b""] * (max(ranks.values(), default=-1) + 1)
        for word, i in ranks.items():
            names[i] = word
        self.size = np.fromiter(map(len, names), np.int64, len(names))
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(names), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.size[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.begin[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


def decode(rows: DataFrame, ids: str, ranks: dict[bytes, int]) -> DataFrame:
    """Adds ``decoded`` (binary) to rows with an array of ids; null ids give null, none give no bytes."""
    shared = rows.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("binary")
    def fn(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = TokenBytes(shared.value)
        for col in parts:
            yield col.map(lambda x: None if x is None else table.decode(np.asarray(x, np.int64)))

    return rows.withColumn("decoded", fn(F.col(ids)))


def digests(rows: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``row, n_tokens, ids_sha256, decoded_sha256`` from the result of :func:`encode_packed`."""
    shared = rows.sparkSession.sparkContext.broadcast(ranks)

    def fn(batches):
        ranks = shared.value
        table, text = TokenBytes(ranks), [str(i).encode() for i in range(max(ranks.values()) + 1)]
        for batch in batches:
            a, b = [], []
            for packed in batch.column(2).to_pylist():
                ids = np.frombuffer(packed, np.uint32)
                a.append(hashlib.sha256(b",".join([text[i] for i in ids.tolist()])).hexdigest())
                b.append(hashlib.sha256(table.decode(ids)).hexdigest())
            yield pa.record_batch({"row": batch.column(0), "n_tokens": batch.column(1), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())})

    extra = [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")]
    schema = T.StructType([rows.schema["row"], rows.schema["n_tokens"], *extra])
    return rows.select("row", "n_tokens", "packed").mapInArrow(fn, schema)
