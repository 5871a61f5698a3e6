"""Token ids in directly addressable codes.

An id is split into chunks of eight bits. Level 0 has the lowest chunk of every id and a bitmap that says which ids
go on; level 1 has the next chunk of those, and so on. The place of an id's next chunk is the number of set bits
before it, which a rank directory gives: set bits before every block of 512, plus a count inside one block. So any
token is read from a few bytes, without decoding its neighbours.

Format: a Parquet data set, one row per shard of whole documents. ``bucket, shard`` order the shards; ``doc_id`` and
``ends`` list its documents and where their ids end; ``n`` is the number of ids; ``chunks``, ``bitmaps`` and
``ranks`` have one binary per level (bytes; bits, lowest first; little-endian 32-bit counts).
"""

from __future__ import annotations

import json
import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglane.llm.shared import BATCH_BYTES, TEXT_ROWS, arrow_rows, shared_folder, slices, texts_of

# Ids of a shard, about; a longer document is a shard of its own.
SHARD_IDS = 1 << 20
RANK_BITS = 512
# Distinct strings whose ids a worker remembers, about.
REMEMBER = 400_000
# Strings whose ids are put in order at a time.
SOME_STRINGS = 1 << 18

COUNT_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode_levels(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, bitmaps and rank directories of the ids, level by level."""
    rest, chunks, bitmaps, ranks = ids.astype(np.uint32), [], [], []
    while True:
        chunks.append((rest & np.uint32(255)).astype(np.uint8).tobytes())
        rest = rest >> np.uint32(8)
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        bitmaps.append(bits.tobytes())
        blocks = np.add.reduceat(COUNT_BITS[bits].astype(np.uint32), np.arange(0, len(bits), RANK_BITS // 8)) if len(bits) else np.zeros(0, np.uint32)
        ranks.append((np.cumsum(blocks, dtype=np.uint32) - blocks).astype("<u4").tobytes())
        rest = rest[more]
        if not len(rest):
            return chunks, bitmaps, ranks


def decode_levels(chunks: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids of a shard."""
    out = np.frombuffer(chunks[0], np.uint8).astype(np.uint32)
    at = np.arange(len(out))
    for k in range(1, len(chunks)):
        bits = np.frombuffer(bitmaps[k - 1], np.uint8)
        at = at[np.unpackbits(bits, count=len(at), bitorder="little").astype(bool)]
        out[at] |= np.frombuffer(chunks[k], np.uint8).astype(np.uint32) << np.uint32(8 * k)
    return out


def token_at(chunks: list[bytes], bitmaps: list[bytes], ranks: list[bytes], i: int) -> int:
    """One id of a shard, by rank, without decoding others."""
    value = 0
    for k, chunk in enumerate(chunks):
        value |= chunk[i] << (8 * k)
        bits = bitmaps[k]
        if not bits[i >> 3] >> (i & 7) & 1:
            break
        block = i // RANK_BITS
        before = int.from_bytes(ranks[k][4 * block : 4 * block + 4], "little")
        before += sum(map(int.bit_count, bits[block * RANK_BITS // 8 : i >> 3]))
        i = before + (bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
    return value


def bounds_of(docs: DataFrame, buckets: int) -> list[int]:
    """Ids that cut the rows into about equal buckets; an id with many rows comes several times. Read from ids alone."""
    steps = [i / buckets for i in range(1, buckets)]
    got = docs.select(F.percentile_approx("doc_id", steps, 100 * buckets)).first()[0] if steps else None
    return sorted(got or [])


# ASCII signs that end a word apart from it; an apostrophe may begin a piece of its own.
SIGNS = "!#$%&()*+,-./:;=?@[]^_`{|}~"
# A run of Latin letters that composition leaves alone, and signs after it.
PLAIN = re.compile(f"([a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([{re.escape(SIGNS)}]*)")
# Steps of a tokenizer for which such a run is, in lower case, one string of the model, written by the byte-level table.
PLAIN_STEPS = [
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    [
        {
            "type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed", "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
]


def _encoder(tokenizer_file: str):
    """The encoder of this process: a worker keeps it for its next tasks, with the strings that it remembers.

    Functions of this package travel with each task anew, so what stays has a module of its own.
    """
    kept = sys.modules.setdefault("loglane_kept", types.ModuleType("loglane_kept")).__dict__
    if kept.get("tokenizer_file") != tokenizer_file:
        kept.update(tokenizer_file=tokenizer_file, encoder=_new_encoder(tokenizer_file))
    return kept["encoder"]


def _byte_level(text: str) -> str:
    from tokenizers import pre_tokenizers

    return "".join(x for x, _ in pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(text))


def _plain_steps(tokenizer) -> bool:
    """Whether runs of letters may be given to the tokenizer's model at once."""
    whole = json.loads(tokenizer.to_str())
    first, then = whole["normalizer"] or {}, whole["pre_tokenizer"] or {}
    steps = [first.get("normalizers"), then.get("pretokenizers")]
    return steps == PLAIN_STEPS and not whole["post_processor"] and all(x["content"].startswith("<|") for x in whole["added_tokens"])


def _in_order(found: list[bytes], words: np.ndarray, cuts: np.ndarray, kind: type) -> list[bytes]:
    """The packed ids of each text: those of its words, which are numbers in ``found``; ``cuts`` are where texts begin."""
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(kind).itemsize
    ids, begins = np.frombuffer(b"".join(found), kind), np.cumsum(sizes) - sizes
    out = np.empty(int(sizes[words].sum()), kind)
    ends = np.zeros(len(words) + 1, np.int64)
    np.cumsum(sizes[words], out=ends[1:])
    for at in range(0, len(words), SOME_STRINGS):
        some, stops = words[at : at + SOME_STRINGS], ends[at : at + SOME_STRINGS + 1]
        places = np.repeat(begins[some] - stops[:-1], sizes[some])
        out[stops[0] : stops[-1]] = ids[places + np.arange(stops[0], stops[-1])]
    ends = ends[cuts].tolist()
    return [out[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _new_encoder(tokenizer_file: str):
    """Packed ids of the strings of a text between white space, each distinct one encoded once by the library."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    kind = np.uint16 if tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
    code, model = "H" if kind is np.uint16 else "I", tokenizer.model
    written = {c: _byte_level(chr(c)) for c in range(0xC0, 0x100)} if _plain_steps(tokenizer) else None
    # Strings met lately, and before; those that are met again stay.
    known: dict[str, bytes] = {}
    older: dict[str, bytes] = {}

    def by_library(words: list[str]) -> None:
        found = tokenizer.encode_batch_fast(words, add_special_tokens=False)
        known.update(zip(words, [array(code, x.ids).tobytes() for x in found], strict=True))

    def by_model(runs: set[str]) -> None:
        for run in runs:
            found = model.tokenize(run if run.isascii() else run.lower().translate(written))
            known[run] = array(code, [x.id for x in found]).tobytes()

    def encode(texts: list[bytes]) -> list[bytes]:
        nonlocal known, older
        if 2 * len(known) > REMEMBER:
            known, older = {}, known
        # The library lower-cases, but finds special tokens before that.
        lines = pc.ascii_split_whitespace(pa.array([t if b"<|" in t else t.lower() for t in texts], pa.binary()).cast(pa.string()))
        words = lines.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        fresh = set(distinct).difference(known)
        again = {w: older[w] for w in fresh if w in older}
        known.update(again)
        fresh.difference_update(again)
        # Signs after an ASCII letter or digit, or a plain run, are encoded apart, as the library splits there.
        parts, runs = {}, set()
        for w in fresh:
            if written and (plain := PLAIN.fullmatch(w)):
                run, signs = plain.groups()
                if run not in known:
                    runs.add(run)
                if signs:
                    parts[w] = (run, signs)
                continue
            core = w.rstrip(SIGNS)
            if core and len(core) < len(w) and core[-1].isascii() and core[-1].isalnum():
                parts[w] = (core, w[len(core) :])
        by_model(runs)
        by_library(list(fresh.difference(parts).union(*parts.values()).difference(known)))
        known.update({w: known[a] + known[b] for w, (a, b) in parts.items()})
        return _in_order([known[w] for w in distinct], words.indices.to_numpy(), lines.offsets.to_numpy(), kind)

    return encode, kind


def tokenized(docs: DataFrame, tokenizer_file: str, end_id: int, bounds: list[int]) -> DataFrame:
    """``bucket, doc_id, tie, ids`` (packed) of every row of ``doc_id, text``.

    The strings between ASCII white space are encoded apart: the tokenizer must drop white space and join nothing
    over it, as word-level ones with lower case do. ``end_id`` ends each document. Null ids come first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bounds)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array(shared.value, np.int64)
        places = np.unique(cuts)
        first, last = np.searchsorted(cuts, places, "left"), np.searchsorted(cuts, places, "right")
        encode, kind = _encoder(tokenizer_file)
        # Small ids travel in two bytes.
        end, wide = np.array([end_id], kind).tobytes(), b"" if kind is np.uint16 else b"\0"
        for batch in batches:
            texts, doc_ids = texts_of(batch, "text"), batch.column(0)
            for at, to in slices(texts, BATCH_BYTES):
                raw = [t.encode() for t in texts[at:to].to_pylist()]
                blobs = [wide + x + end for x in encode(raw)]
                tie = np.fromiter((zlib.crc32(t) for t in raw), np.int64, len(raw))
                mine = doc_ids[at:to].fill_null(-(1 << 63)).to_numpy()
                bucket = np.searchsorted(cuts, mine, "right")
                if len(places):
                    # An id that fills several buckets is dealt over them by its text.
                    k = np.minimum(np.searchsorted(places, mine), len(places) - 1)
                    same = (places[k] == mine) & (last[k] - first[k] > 1)
                    bucket = np.where(same, first[k] + 1 + tie * (last[k] - first[k]) // (1 << 32), bucket)
                yield pa.record_batch({"bucket": pa.array(bucket), "doc_id": doc_ids[at:to], "tie": pa.array(tie), "ids": pa.array(blobs, pa.binary())})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(fn, "bucket long, doc_id long, tie long, ids binary")


SHARD = (
    "bucket long, shard long, n long, doc_id array<long>, ends array<long>, "
    "chunks array<binary>, bitmaps array<binary>, ranks array<binary>"
)


def shards(rows: DataFrame) -> DataFrame:
    """Rows of the format from ``bucket, doc_id, tie, ids``, in order of id."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches))
        order = np.lexsort((whole["tie"].to_numpy(), whole["doc_id"].fill_null(-(1 << 63)).to_numpy()))
        whole = whole.take(pa.array(order))
        bucket, doc_ids, shard = whole["bucket"][0].as_py(), whole["doc_id"].to_pylist(), 0
        held, names, size = [], [], 0

        def flush():
            ids = np.concatenate(held)
            chunks, bitmaps, ranks = encode_levels(ids)
            row = {"bucket": bucket, "shard": shard, "n": len(ids), "doc_id": names, "ends": np.cumsum([len(x) for x in held]).tolist()}
            return pa.RecordBatch.from_pylist([row | {"chunks": chunks, "bitmaps": bitmaps, "ranks": ranks}], schema=SHAPE)

        for name, blob in zip(doc_ids, whole["ids"], strict=True):
            blob = blob.as_py()
            held.append(np.frombuffer(blob, np.uint16) if len(blob) % 2 == 0 else np.frombuffer(blob[1:], np.uint32))
            names.append(name)
            size += len(held[-1])
            if size >= SHARD_IDS:
                yield flush()
                held, names, size, shard = [], [], 0, shard + 1
        if held:
            yield flush()

    return rows.groupBy("bucket").applyInArrow(fn, SHARD)


SHAPE = pa.schema([
    ("bucket", pa.int64()), ("shard", pa.int64()), ("n", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())),
    ("chunks", pa.list_(pa.binary())), ("bitmaps", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())),
])


def write(docs: DataFrame, tokenizer_file: str, path: str, end_id: int = 1, buckets: int | None = None) -> None:
    """Encode ``doc_id, text`` (more columns are ignored) and write the format at ``path`` in ascending order of id.

    Null and empty texts have the end id alone. Rows with one id follow each other by their text's checksum; null
    ids come first. No rows write no shards.
    """
    arrow_rows(docs, TEXT_ROWS)
    buckets = buckets or max(8, 2 * docs.rdd.getNumPartitions())
    rows = tokenized(docs, tokenizer_file, end_id, bounds_of(docs, buckets))
    shards(rows).write.parquet(path)


def with_starts(files: DataFrame) -> DataFrame:
    """The shards with ``start``, the number of ids in all shards before. Their sums per bucket meet in one task."""
    sums = files.groupBy("bucket").agg(F.sum("n").alias("all"))
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("bucket").alias("at"), F.coalesce(F.sum("all").over(order), F.lit(0)).alias("before"))
    inside = files.select("bucket", "shard", "n").withColumn(
        "inside", F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    inside = inside.join(sums, F.col("bucket") == F.col("at")).select(F.col("bucket").alias("b"), F.col("shard").alias("s"), (F.col("before") + F.col("inside")).alias("start"))
    return files.join(inside, (F.col("bucket") == F.col("b")) & (F.col("shard") == F.col("s"))).drop("b", "s")


def documents(files: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` (packed, four bytes each, little-endian) of every document in the files."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_levels(row["chunks"], row["bitmaps"]).astype("<u4")
                ends = row["ends"]
                begins = [0, *ends[:-1]]
                for at in range(0, len(ends), 2000):
                    some = list(zip(begins[at : at + 2000], ends[at : at + 2000], strict=True))
                    yield pa.record_batch({
                        "doc_id": pa.array(row["doc_id"][at : at + 2000], pa.int64()), "start": pa.array([row["start"] + a for a, _ in some], pa.int64()),
                        "ids": pa.array([ids[a:b].tobytes() for a, b in some], pa.binary()),
                    })

    rows = with_starts(files).select("start", "doc_id", "ends", "chunks", "bitmaps")
    return rows.mapInArrow(fn, "doc_id long, start long, ids binary")


def tokens_at(files: DataFrame, places: DataFrame) -> DataFrame:
    """``place, id`` for each row of ``place`` (a number of an id in the whole corpus), by random access.

    Places outside the corpus, and nulls, are left out.
    """
    wide = with_starts(files).withColumn("stop", F.col("start") + F.col("n"))
    narrow = wide.select("bucket", "shard", "start", "stop")
    # Shards and places meet in ranges of one shard's size, so no join compares all with all.
    unit = F.lit(SHARD_IDS)
    cells = narrow.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / unit), F.floor((F.col("stop") - 1) / unit))))
    asked = places.select("place").withColumn("cell", F.floor(F.col("place") / unit))
    asked = asked.join(cells, "cell").filter("place >= start and place < stop")
    asked = asked.groupBy("bucket", "shard").agg(F.collect_list(F.col("place") - F.col("start")).alias("asked"))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [token_at(row["chunks"], row["bitmaps"], row["ranks"], i) for i in row["asked"]]
                yield pa.record_batch({"place": pa.array([row["start"] + i for i in row["asked"]], pa.int64()), "id": pa.array(found, pa.int64())})

    rows = wide.join(asked, ["bucket", "shard"]).select("start", "asked", "chunks", "bitmaps", "ranks")
    return rows.mapInArrow(fn, "place long, id long")


def written(docs: DataFrame, tokenizer_file: str, end_id: int = 1) -> DataFrame:
    """Write the corpus to a new folder of the shared storage and read the files back."""
    path = shared_folder(docs.sparkSession, "tokens")
    write(docs, tokenizer_file, path, end_id)
    return docs.sparkSession.read.schema(SHARD).parquet(path)


def checked(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the documents in the files."""
    rows = documents(files)
    return rows.select("doc_id", "start", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
